"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint of 64 bits is cut into three blocks of at most 23 bits. The anchors of
each block are the 4096 words of the binary Golay code, whose covering radius is 3:
every block lies within 3 bits of exactly one anchor, its home. Two fingerprints that
differ in at most 4 bits differ in at most one bit in one of the blocks, so there the
second lies within 3 + 1 bits of the home anchor of the first. Each fingerprint goes to
all anchors within 4 bits, and every anchor compares those at home with those in reach.

Beyond MANY distinct fingerprints there are two blocks of 32 bits instead, which differ in
at most two bits; the code is the Golay code on 23 bits and all words on the other 9, two
million anchors a block. That makes 212 replicas of a fingerprint instead of 16, and
compares one pair in 10,000 instead of one in 256.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from strandline.llm.common import Scratch, spread_join, table

THRESHOLD = 4
#: (shift, bits) of the blocks, by their number. Bits of a block above the Golay code's 23 are taken as they are.
BLOCKS = {3: ((0, 22), (22, 21), (43, 21)), 2: ((0, 32), (32, 32))}
GOLAY_BITS, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GOLAY = 0xC75
#: Distinct fingerprints from which on two blocks cost less than three.
MANY = 1 << 25
#: Fingerprints of either role that one cell compares, and anchors that are cut into cells at most.
CELL, CUT_ANCHORS = 4096, 50_000


@cache
def _golay(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit value by three lookups; each syndrome's error patterns of at most ``most`` bits, the least weight first, padded by -1; their weights."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY << (bit - 11)
        return v

    units = [remainder(1 << i) for i in range(GOLAY_BITS)]
    tables = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for v in range(256):
            for bit in range(8):
                if v >> bit & 1 and 8 * byte + bit < GOLAY_BITS:
                    tables[byte, v] ^= units[8 * byte + bit]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    level = [(0, 0, -1)]
    for _ in range(most + 1):
        for value, syndrome, _ in level:
            patterns[syndrome].append(value)
        level = [(v | 1 << i, s ^ units[i], i) for v, s, top in level for i in range(top + 1, GOLAY_BITS)]
    padded = np.full((2048, max(map(len, patterns))), -1, np.int64)
    for s, found in enumerate(patterns):
        padded[s, : len(found)] = found
    return tables, padded, np.where(padded < 0, most + 1, np.bitwise_count(np.maximum(padded, 0))).astype(np.int64)


def anchors(block: np.ndarray, width: int, slack: int) -> np.ndarray:
    """For each block value the anchors that a value within ``slack`` bits of it may have as its home; its own home first, padded by -1."""
    tables, padded, weights = _golay(RADIUS + slack)
    code, rest = block & ((1 << GOLAY_BITS) - 1), block >> GOLAY_BITS
    syndrome = tables[0, code & 255] ^ tables[1, code >> 8 & 255] ^ tables[2, code >> 16 & 255]
    errors, weight = padded[syndrome], weights[syndrome]
    found = []
    for flipped in range(min(slack, max(0, width - GOLAY_BITS)) + 1):
        near = np.where(weight <= RADIUS + slack - flipped, errors ^ code[:, None], -1)
        for places in combinations(range(width - GOLAY_BITS), flipped):
            turned = rest ^ sum(1 << p for p in places)
            found.append(np.where(near < 0, -1, near | (turned << GOLAY_BITS)[:, None]))
    return np.concatenate(found, axis=1)


def hashed_shingles(text: str | None, shingle: int) -> np.ndarray:
    """A 64-bit hash of each run of ``shingle`` words, of the whole text where it has fewer. No word: none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)], "<u8")


def fingerprint_of(hashed: np.ndarray) -> int:
    """The fingerprint of the shingles' hashes, as a signed 64-bit number. None: 0."""
    if not len(hashed):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 65_536):
        part = hashed[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashed), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return fingerprint_of(hashed_shingles(text, shingle))


def with_fingerprint(docs: DataFrame, text_column: str = "text", to: str = "fingerprint_bits", shingle: int = 4) -> DataFrame:
    """The documents with their fingerprint as a long column; all columns stay."""
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.LongType())])
    at = docs.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            bits = pa.array([fingerprint(texts[i].as_py(), shingle) for i in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], names=schema.names)

    return docs.mapInArrow(task, schema)


def _replicas(fingerprints: DataFrame, number: int) -> DataFrame:
    """(anchor, home, bits): a row for each anchor in reach of a fingerprint, by ``number`` blocks; home marks its nearest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                bits = batch.column(0).slice(first, 2000).to_numpy(zero_copy_only=False)
                for k, (shift, width) in enumerate(BLOCKS[number]):
                    reach = anchors((bits.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1), width, THRESHOLD // number)
                    row, place = np.nonzero(reach >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(reach[row, place] | k << 32), pa.array(place == 0), pa.array(bits[row])], names=["anchor", "home", "bits"])

    return fingerprints.select("bits").mapInArrow(task, "anchor long, home boolean, bits long")


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j in place. A label is the least member of its group, before and after."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _links_of_cell(home: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint of a cell that has a partner there, the least fingerprint it is connected to within the cell. Each pair is compared once."""
    nodes = np.unique(np.concatenate((home, near)))
    label = np.arange(len(nodes))
    h, p = np.searchsorted(nodes, home), np.searchsorted(nodes, near)
    a, b = nodes[h].view(np.uint64), nodes[p].view(np.uint64)
    step = max(1, 1_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= THRESHOLD)
        _join_labels(label, h[i + at], p[j])
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def links(fingerprints: DataFrame, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """(bits, other): links that connect exactly those distinct fingerprints that links of at most THRESHOLD bits connect.

    An anchor with more than CELL fingerprints of a role, or 1 in CUT_ANCHORS of all
    replicas, is cut into cells: those at home are dealt to rows of cells and copied
    along them, those in reach to columns.
    """
    replicas = scratch.keep(_replicas(fingerprints, blocks or (3 if fingerprints.count() <= MANY else 2)), "replicas")
    size = max(CELL, replicas.count() // CUT_ANCHORS)
    parts = lambda c: F.ceil(F.greatest(c, F.lit(1)) / size).cast("int")
    large = replicas.groupBy("anchor").agg(parts(F.sum(F.col("home").cast("long"))).alias("rows"), parts(F.count("*")).alias("columns")).where("columns > 1")
    # each has more than 1 in CUT_ANCHORS of the replicas, so this table has fewer rows
    dealt = replicas.join(F.broadcast(large), "anchor", "left").fillna(1, ["rows", "columns"])
    salt = F.xxhash64("bits", F.lit(7))
    column, row = F.pmod(salt, F.col("columns")).cast("int"), F.pmod(salt, F.col("rows")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    near = dealt.select("anchor", F.explode(every("rows")).alias("row"), column.alias("column"), F.lit(False).alias("home"), "bits")
    home = dealt.where("home").select("anchor", row.alias("row"), F.explode(every("columns")).alias("column"), F.lit(True).alias("home"), "bits")

    def cell(found: pa.Table) -> pa.Table:
        at_home = found.column("home").to_numpy()
        bits = found.column("bits").to_numpy()
        one, other = _links_of_cell(bits[at_home], bits[~at_home])
        return pa.table({"bits": pa.array(one, pa.int64()), "other": pa.array(other, pa.int64())})

    found = near.unionByName(home).groupBy("anchor", "row", "column").applyInArrow(cell, "bits long, other long")
    kept = scratch.keep(found.distinct(), "links")
    scratch.drop("replicas")
    return kept


def roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(bits, root): the least member of the connected component of every end of an edge.

    Labels fall to the least label in sight and to the label of the label, until none
    changes; each round is written to the shared folder. Members with very many edges, and
    labels of very many members, are spread over tasks.
    """
    both = scratch.keep(edges.select("bits", "other").unionByName(edges.select(F.col("other").alias("bits"), F.col("bits").alias("other"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy("bits").agg(F.least(F.min("other"), F.first("bits")).alias("root")), "labels0")
    n_edges, n_labels, turn = both.count(), labels.count(), 0
    while True:
        turn += 1
        seen = spread_join(both, labels.select(F.col("bits").alias("other"), "root"), "other", ["bits"], n_edges).groupBy("bits").agg(F.min("root").alias("least"))
        # the spread rows are written as they lie: a further join, if broadcast, would inherit the shares of hot labels
        beyond = spread_join(labels.join(seen, "bits"), labels.select(F.col("bits").alias("root"), F.col("root").alias("beyond")), "root", ["bits"], n_labels, sizes=labels.groupBy("root").agg(F.count("*").alias("n")))
        stepped = scratch.keep(beyond.select("bits", F.least("root", "least", "beyond").alias("root"), F.col("root").alias("before")), f"labels{turn}")
        changed = stepped.where("root <> before").limit(1).count()
        labels = stepped.select("bits", "root")
        scratch.drop(f"labels{turn - 1}")
        if not changed:
            scratch.drop("edges")
            return labels


def components(stored: DataFrame, scratch: Scratch) -> DataFrame:
    """(bits, first): for each distinct fingerprint the least doc_id of its component, null if it has none.

    ``stored`` has the columns ``bits`` and ``doc_id``; copies meet in partial
    aggregates, so a group of any size is spread over the tasks that read it.
    """
    distinct = scratch.keep(stored.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct")
    label = roots(links(distinct, scratch), scratch)
    # fingerprints without a link are their own component and meet no other row
    linked = scratch.keep(distinct.join(label, "bits"), "linked")
    of_root = linked.groupBy("root").agg(F.min("first").alias("least"))
    least = spread_join(linked.select("bits", "root"), of_root, "root", ["bits"], linked.count()).select("bits", "least")
    return distinct.join(least.withColumn("linked", F.lit(True)), "bits", "left").select("bits", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    Null and empty texts have fingerprint zero and are linked like others. A component's
    id is its least id that is not null, null if there is none. Repeated rows and ids
    stay, each with its own row; other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    stored = scratch.keep(with_fingerprint(named, "text", "bits", shingle).select("doc_id", "bits", F.monotonically_increasing_id().alias("row")), "fingerprints")
    found = components(stored, scratch)
    return spread_join(stored, found, "bits", ["row"], stored.count(), "left").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Near-duplicates by their five-word shingles: all pairs of Jaccard similarity 0.8 or more, none lost by a sketch.

Fingerprints that the anchors of ``simhash`` link propose pairs, which the whole shingle
sets confirm. Four bits link most copies with few edits but not all pairs of similarity
0.8, so a prefix filter finds the rest: put the shingles of all documents
in one order. Two sets of sizes m and n and similarity t or more have t * max(m, n)
shingles in common, so the first n - ceil(t * n) + 1 of each set meet. Only documents that
meet there and are not connected yet are compared. Any order is right; here shingles that
a sample shows often come last, so what many texts share hardly ever makes them meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandline.llm.common import Scratch, free_prefix, most_frequent, spread_join
from strandline.llm.simhash import fingerprint_of, hashed_shingles, links, roots

#: Words of a shingle; the least similarity is LEAST / OF.
WIDTH, LEAST, OF = 5, 4, 5
#: Documents whose shingles are counted and shingles put last at most. They set the order only, never the result.
COUNTED, LAST = 5000, 100_000
#: Documents of a shingle that one cell compares, and rounds against heads at most, before and after shingles are put in exact order; then the rest is compared pair by pair.
CELL, ROUNDS = 1024, 4
#: Words of 64 bits in a broadcast bitmap.
BITMAP = 1 << 18
#: Shingles that a task puts together before it deals them out, and documents whose shingles one part counts, roughly.
CHUNK, DEALT = 1 << 20, 2000


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes. A text of fewer words is one shingle, none has none."""
    return np.unique(hashed_shingles(text, WIDTH))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= LEAST * (len(a) + len(b) - common)


def sketch(own: np.ndarray) -> bytes:
    """A bitmap of the shingles, of the first power of two bits from twice their number on."""
    bits = np.zeros(1 << max(6, (2 * len(own)).bit_length()), bool)
    bits[own & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def perhaps_similar(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """False only for sets that can't be similar: each bit of one that the other lacks stands for a shingle that the other lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    least = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
    common = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return (OF + LEAST) * common >= LEAST * (n_a + n_b)


def _weight(own: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each shingle's count in the sample, 0 where it is not among those that occur often."""
    if not len(often):
        return np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
    return np.where(often[at] == own, counts[at], 0)


def _prefix_length(n):
    return n - (LEAST * n + OF - 1) // OF + 1


def prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles by (count in the sample, hash)."""
    return own[np.argsort(_weight(own, often, counts), kind="stable")[: _prefix_length(len(own))]]


def _flagged(df: DataFrame, column: str, others: DataFrame, other: str) -> tuple[DataFrame, str]:
    """``df`` with a further column, and its name: true where the value occurs among the others, and for some that share a bit with one.

    The broadcast bitmap has a fixed size; where it fills up, more rows are true.
    """
    mark = free_prefix(df.columns)
    word = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(BITMAP))
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.lit(64)).cast("int")
    bits = others.groupBy(word(other).alias(f"{mark}word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(other))).alias(f"{mark}held"))
    met = df.withColumn(f"{mark}word", word(column)).join(F.broadcast(bits), f"{mark}word", "left")
    return met.select(*df.columns, F.coalesce(F.call_function("getbit", f"{mark}held", bit(column)) == 1, F.lit(False)).alias(f"{mark}met")), f"{mark}met"


def _perhaps_among(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """The rows whose value occurs among the others, and some more, which the next join drops: spares a shuffle of all rows."""
    flagged, met = _flagged(df, column, others, other)
    return flagged.where(F.col(met)).select(*df.columns)


def _without(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """The rows whose value does not occur among the others; only those that may occur are shuffled."""
    flagged, met = _flagged(df, column, others, other)
    rest = flagged.where(F.col(met)).join(others.select(F.col(other).alias(column)), column, "left_anti")
    return flagged.where(~F.col(met)).select(*df.columns).unionByName(rest.select(*df.columns))


def _often(texts: DataFrame, text_column: str, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) that occur most in a sample of the rows, by ascending shingle."""
    share = COUNTED / max(1, texts.count())
    sampled = texts.where(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).select(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                found = np.concatenate([shingles(t.as_py()) for t in batch.column(0).slice(at, 100)])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    counted = scratch.keep(sampled.mapInArrow(task, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2"), "counted")
    found = most_frequent(counted, "n", LAST).toPandas().to_numpy(np.int64).reshape(-1, 2)
    scratch.drop("counted")
    names = found[:, 0].copy().view(np.uint64)
    order = np.argsort(names)
    return names[order], found[order, 1]


def _described(docs: DataFrame, text_column: str, mark: str, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The documents with a digest of their shingle set, its size, prefix and sketch, and their fingerprint, in columns that begin with ``mark``."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(mark + n, t) for n, t in (("set", T.BinaryType()), ("size", T.IntegerType()), ("prefix", T.ArrayType(T.LongType())), ("sketch", T.BinaryType()), ("bits", T.LongType()))]])
    at = docs.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, heads, sketches, bits = [], [], [], [], []
            for t in batch.column(at):
                hashed = hashed_shingles(t.as_py(), WIDTH)
                own = np.unique(hashed)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                heads.append(prefix(own, often, counts).view(np.int64) if len(own) else own.view(np.int64))
                sketches.append(sketch(own))
                bits.append(fingerprint_of(hashed))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*heads, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), prefixes, pa.array(sketches, pa.binary()), pa.array(bits, pa.int64())], names=schema.names)

    return docs.mapInArrow(task, schema)


def _met(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b) with the columns of both rows. A document of very many pairs is spread over tasks."""
    total = pairs.count()
    end = lambda e: _perhaps_among(of.select(F.col("row").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in of.columns if c != "row"]), e, pairs, e)
    sizes = lambda e: pairs.groupBy(e).agg(F.count("*").alias("n"))
    return spread_join(spread_join(pairs, end("b"), "b", ["a"], total, sizes=sizes("b")), end("a"), "a", ["b"], total, sizes=sizes("a"))


def _confirmed(pairs: DataFrame, texts: DataFrame, whole: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(bits, other): the pairs (a, b) whose texts are similar by their whole sets, those alone whose sketches allow it being read."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([perhaps_similar(*x) for x in zip(*[c.to_pylist() for c in batch.columns[2:]])], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(keep)

    sketched = _met(pairs, texts.select("row", "sketch", "size")).select("a", "b", "sketch_a", "size_a", "sketch_b", "size_b")
    left = scratch.keep(sketched.mapInArrow(possible, "a long, b long"), f"{name}_left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for row, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if row != last:  # the pairs of one document mostly follow each other
                    last, own = row, shingles(a.as_py())
                keep.append(similar(own, shingles(b.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["bits", "other"]).filter(pa.array(keep, pa.bool_()))

    found = scratch.keep(_met(left, whole).select("a", "b", "text_a", "text_b").mapInArrow(task, "bits long, other long"), name)
    scratch.drop(f"{name}_left")
    scratch.settle()
    return found


def _fit(one: str, other: str) -> Column:
    """Sizes that allow the similarity."""
    return (F.col(one) * OF >= F.col(other) * LEAST) & (F.col(other) * OF >= F.col(one) * LEAST)


def _mixed(lists: DataFrame, labels: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The lists whose documents are not all connected yet, with each document's label and the list's length."""
    named = lists.drop("label", "n")
    if labels is None:
        named = named.withColumn("label", F.col("row"))
    else:
        named = named.join(labels.select(F.col("bits").alias("row"), F.col("root").alias("label")), "row", "left").withColumn("label", F.coalesce("label", "row"))
        named = scratch.keep(named, f"{name}_named")
    several = named.groupBy("shingle").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle", "n")
    several = scratch.keep(several, f"{name}_several")
    mixed = _perhaps_among(named, "shingle", several, "shingle")
    found = scratch.keep(spread_join(mixed, several, "shingle", ["row"], lists.count(), sizes=several), name)
    scratch.drop(f"{name}_several", *([f"{name}_named"] if labels is not None else []))
    scratch.settle()
    return found


def _against_heads(lists: DataFrame, turn: int, central: bool = False) -> DataFrame:
    """(a, b): each document b with that head of its lists which it meets most often. The rest is left to later rounds.

    A central head has the fewest shingles before the list's, so the fewest rare ones: among near
    copies that is the text they were made from, which is similar to many of them. Others are drawn by a hash.
    """
    by = F.xxhash64("row", F.lit(turn))
    head = lists.groupBy("shingle").agg(F.min(F.struct((F.struct("place", by) if central else by).alias("by"), F.col("row").alias("head"), F.col("size").alias("head_size"), F.col("label").alias("head_label"))).alias("h")).select("shingle", "h.*")
    sizes = lists.groupBy("shingle").agg(F.first("n").alias("n"))
    met = spread_join(lists, head, "shingle", ["row"], lists.count(), sizes=sizes).where((F.col("label") != F.col("head_label")) & _fit("size", "head_size"))
    often = met.groupBy("row", "head", "by").agg(F.count("*").alias("times"))
    return often.groupBy("row").agg(F.max(F.struct("times", "by", "head")).alias("best")).select(F.col("best.head").alias("a"), F.col("row").alias("b"))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32 byte plane by byte plane, compressed: small ones take one or two bytes each."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _nth(group: np.ndarray) -> np.ndarray:
    """The place of each element, from 0, in its run of equal elements."""
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]][: len(group)], at, 0))


#: What chunks and parts send each other: a chunk's shingles in a part (a: shorts as steps, b: documents, c: how many documents hold each), or
#: with a negative part its documents (a: rows, b: sizes, c: shingles to be counted; d, e, f: shingle, document and place of those put last).
_SENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in "abcdef"]])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in "abcdef"]])
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


def _dealt(rows: list[int], sets: list[np.ndarray], often: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A chunk of documents: its shingles for each part, and what the chunk needs again when their numbers come back."""
    sizes, own = np.array([len(s) for s in sets], np.int64), np.concatenate(sets)
    doc, weight = np.repeat(np.arange(len(sets)), sizes), _weight(own, often, counts)
    counted = np.bincount(doc[weight == 0], minlength=len(sets))
    tail = np.nonzero(weight)[0]
    tail = tail[np.lexsort((own[tail], weight[tail], doc[tail]))]
    place = counted[doc[tail]] + _nth(doc[tail]) + 1
    near = place <= _prefix_length(sizes)[doc[tail]]
    tail, place = tail[near], place[near]
    as_bytes = lambda v: v.astype("<i8").tobytes()
    sent = [(-1 - rows[0] % parts, rows[0], len(sets), as_bytes(np.array(rows, np.int64)), as_bytes(sizes), as_bytes(counted), own[tail].tobytes(), as_bytes(doc[tail]), as_bytes(place))]
    short, doc = (own[weight == 0] >> np.uint64(32)).astype(np.int64), doc[weight == 0]
    order = np.argsort(short, kind="stable")
    short, doc = short[order], doc[order]
    ends = np.searchsorted(short * parts >> 32, np.arange(parts + 1))
    for part in np.nonzero(np.diff(ends))[0].tolist():
        held = slice(ends[part], ends[part + 1])
        sent.append((part, rows[0], int(ends[part + 1] - ends[part]), _packed(np.diff(short[held], prepend=0)), _packed(doc[held]), None, None, None, None))
    return _sent(sent)


def _numbered(found: pa.Table) -> pa.Table:
    """What a part sends back: of each chunk the shingles that several documents hold, and how many do."""
    rows = found.to_pylist()
    if rows[0]["part"] < 0:
        return found
    shorts = [np.cumsum(_unpacked(r["a"], r["n"])) for r in rows]
    _, which, times = np.unique(np.concatenate(shorts), return_inverse=True, return_counts=True)
    times, at, sent = times[which], 0, []
    for r, short in zip(rows, shorts):
        n = times[at : at + len(short)]
        at, several = at + len(short), n > 1
        if several.any():
            sent.append((r["part"], r["chunk"], int(several.sum()), _packed(np.diff(short[several], prepend=0)), _packed(_unpacked(r["b"], r["n"])[several]), _packed(n[several]), None, None, None))
    return pa.Table.from_batches([_sent(sent)])


def _cut(found: pa.Table) -> pa.Table:
    """The new prefixes of a chunk's documents, without the shingles of one document."""
    rows = found.to_pylist()
    own = next(r for r in rows if r["part"] < 0)
    row, size, counted, tail, tail_doc, tail_place = (np.frombuffer(own[c], "<i8") for c in "abcdef")
    came = [(_unpacked(r["b"], r["n"]), _unpacked(r["c"], r["n"]), np.cumsum(_unpacked(r["a"], r["n"]))) for r in rows if r["part"] >= 0]
    doc, times, short = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (zip(*came) if came else ((), (), ())))
    order = np.lexsort((short, times, doc))
    doc, short = doc[order], short[order]
    place = (counted - np.bincount(doc, minlength=len(row)))[doc] + _nth(doc) + 1
    near = place <= _prefix_length(size)[doc]
    doc, short, place = (np.concatenate(v) for v in ((doc[near], tail_doc), (short[near], tail), (place[near], tail_place)))
    return pa.table({"shingle": pa.array(short, pa.int64()), "row": pa.array(row[doc], pa.int64()), "size": pa.array(size[doc].astype(np.int32)), "place": pa.array(place.astype(np.int32))})


def _by_frequency(lists: DataFrame, whole: DataFrame, scratch: Scratch, often: np.ndarray = np.zeros(0, np.uint64), counts: np.ndarray = np.zeros(0, np.int64)) -> DataFrame:
    """(shingle, row, size, place): prefixes of the documents of ``lists`` anew, their shingles ordered by the number of those documents that hold them.

    Similar documents that are not connected yet share a list, so no others matter, and any
    order is right. Shingles of one document come first and meet nobody: a document that has
    as many of them as its prefix is long drops out, whatever passages it shares with others. Those
    that a sample shows often come last, uncounted. Numbers are those of
    a shorter hash, which orders alike wherever the shingle occurs and names its list; others of the same hash only lengthen it. ``place`` counts from 1.

    Chunks of documents send their shingles to parts as packed arrays, and parts send back
    the numbers of those that are shared: a row for each chunk and part instead of one for each shingle.
    """
    # by a bitmap alone, which spares a shuffle of the texts: some documents more do no harm
    rows = scratch.keep(lists.select("row").distinct(), "few")
    few, parts = _perhaps_among(whole, "row", rows, "row").select("row", "text"), max(1, rows.count() // DEALT)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets, held = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(row)
                sets.append(shingles(text.as_py()))
                held += len(sets[-1])
                if held >= CHUNK:
                    yield _dealt(names, sets, often, counts, parts)
                    names, sets, held = [], [], 0
        if names:
            yield _dealt(names, sets, often, counts, parts)

    numbered = few.mapInArrow(task, _SENT).groupBy("part").applyInArrow(_numbered, _SENT)
    found = scratch.keep(numbered.groupBy("chunk").applyInArrow(_cut, "shingle long, row long, size int, place int"), "ordered")
    scratch.drop("few")
    scratch.settle()
    return found


def _all_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): all pairs of a list that are not connected yet and may be similar. Lists of more than CELL documents are cut into cells.

    At the first shingle that two sets have in common, what is left of each must hold the rest of what they need.
    """
    dealt = lists.withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")).withColumn("cell", F.pmod(F.xxhash64("row", F.lit(7)), F.col("cells")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    own = lambda e: [F.col("row").alias(e), F.col("size").alias(f"size_{e}"), F.col("label").alias(f"label_{e}"), (F.col("size") - F.col("place") + 1).alias(f"left_{e}")]
    a = dealt.select("shingle", F.col("cell").alias("x"), every.alias("y"), *own("a"))
    b = dealt.select("shingle", every.alias("x"), F.col("cell").alias("y"), *own("b"))
    enough = (OF + LEAST) * F.least("left_a", "left_b") >= LEAST * (F.col("size_a") + F.col("size_b"))
    return a.join(b, ["shingle", "x", "y"]).where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _fit("size_a", "size_b") & enough).select("a", "b").distinct()


def _by_fingerprint(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs that the fingerprints propose. Texts of one fingerprint go with its first, linked fingerprints by their first texts."""
    total = texts.count()
    prints = scratch.keep(texts.groupBy("bits").agg(F.min("row").alias("a"), F.count("*").alias("n")), "prints")
    same = spread_join(texts.select("bits", F.col("row").alias("b")), prints.where("n > 1").drop("n"), "bits", ["b"], total, sizes=prints.select("bits", "n")).where("a <> b").select("a", "b")
    linked = links(prints, scratch)
    one = linked.join(prints.select("bits", F.col("a").alias("b")), "bits")
    return same.unionByName(spread_join(one, prints.select(F.col("bits").alias("other"), "a"), "other", ["b"], linked.count(), sizes=linked.groupBy("other").agg(F.count("*").alias("n"))).select("a", "b"))


def _relabelled(labels: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(bits, root) after further links. Only the links and the roots they touch go through the rounds of labels, not all earlier links again."""
    total, known = found.count(), labels.select(F.col("bits").alias("end"), "root")
    one = spread_join(found.withColumnRenamed("bits", "end"), known, "end", ["other"], total, "left").select(F.coalesce("root", "end").alias("bits"), "other")
    both = spread_join(one.withColumnRenamed("other", "end"), known, "end", ["bits"], total, "left").select("bits", F.coalesce("root", "end").alias("other"))
    new = roots(scratch.keep(both.where("bits <> other").distinct(), f"{name}_links"), scratch)
    moved = spread_join(labels, new.select(F.col("bits").alias("root"), F.col("root").alias("least")), "root", ["bits"], labels.count(), "left").select("bits", F.coalesce("least", "root").alias("root"))
    return scratch.keep(moved.unionByName(new.join(labels.select("bits"), "bits", "left_anti")), name)


def _components(texts: DataFrame, whole: DataFrame, scratch: Scratch, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(bits, root): the least row of the component of each row that is similar to another.

    ``texts`` holds row, size, prefix, sketch and bits of the distinct sets, ``whole`` row and text.
    What the fingerprints propose and one central head for each shingle are compared first, which
    connects nearly all members of a large group of near copies; only documents that
    still are not connected are then put in order by the shingles' frequencies. In that order
    heads come first again, as central ones may differ from those by the sample; the rest is compared pair by pair.
    """
    # counted by a shorter hash, which also lets a few shingles of one document pass; _mixed drops them
    postings, short = texts.select(F.posexplode("prefix").alias("at", "shingle"), "row", "size").select("shingle", "row", "size", (F.col("at") + 1).alias("place")), F.hash("shingle")
    shared = scratch.keep(postings.groupBy(short.alias("short")).agg(F.count("*").alias("n")).where("n > 1").select("short"), "shared")
    near = scratch.keep(_perhaps_among(postings.withColumn("short", short), "short", shared, "short").drop("short"), "near")
    scratch.drop("shared")
    name = "lists0"
    lists = _mixed(near, None, scratch, name)
    # sum of n over the rows is the sum of squared lengths
    before = lists.agg(F.sum("n")).first()[0] or 0
    proposed = scratch.keep(_by_fingerprint(texts, scratch).unionByName(_against_heads(lists, 0, central=True)).distinct(), "proposed")
    edges = _confirmed(proposed, texts, whole, scratch, "found")
    labels, joined, ordered = roots(edges, scratch), True, 0
    scratch.drop("near", "prints", "links", "proposed")
    size = lambda: lists.agg(F.sum("n").alias("pairs"), F.count("*").alias("rows")).first()
    for turn in range(1, 2 * ROUNDS + 1):
        if joined:  # otherwise the lists stay
            unmixed, name = name, f"lists{turn}"
            lists = _mixed(lists, labels, scratch, name)
            scratch.drop(unmixed)
        left = size()
        if left["rows"] and left["pairs"] > 4 * left["rows"] and not ordered and (turn == ROUNDS or left["pairs"] > before / 2):
            unmixed, name, ordered = name, "lists_ordered", turn
            lists = _mixed(_by_frequency(lists, whole, scratch, often, counts), labels, scratch, name)
            scratch.drop(unmixed, "ordered")
            left = size()
        if not left["rows"]:
            break
        before = left["pairs"]
        # in exact order, heads are tried as long as a quarter of what they meet is similar
        last = left["pairs"] <= 4 * left["rows"] or ordered and (turn >= ordered + ROUNDS or turn > ordered and few)
        pairs = scratch.keep(_all_pairs(lists) if last else _against_heads(lists, turn, central=turn == ordered), f"pairs{turn}")
        found = _confirmed(pairs, texts, whole, scratch, f"found{turn}")
        n = found.count()
        joined, few = n > 0, 4 * n < pairs.count()
        scratch.drop(f"pairs{turn}")
        if joined:
            labels = _relabelled(labels, found, scratch, f"joined{turn}")
        if last:
            break
    return labels


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component of similar texts: the one of least id, the first of several rows with that id.

    Words are folded to lower case. Null and blank texts have the empty set and equal each
    other; a null id counts as the greatest; repeated rows are copies; other columns stay,
    whatever their names; an empty table gives no rows.
    """
    scratch, names, mark = Scratch(docs.sparkSession), docs.columns, free_prefix(docs.columns)
    often, counts = _often(docs, text_column, scratch)
    described = _described(docs, text_column, mark, often, counts).withColumn(f"{mark}row", F.monotonically_increasing_id())
    stored = scratch.keep(described, "documents")
    total = stored.count()
    plain = stored.select(*[F.col(mark + c).alias(c) for c in ("row", "set", "size", "prefix", "sketch", "bits")])
    rows = stored.select(F.col(f"{mark}set").alias("set"), F.col(f"{mark}row").alias("row"), F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).cast("long").alias("id"), F.col(f"{mark}row").alias("row")).alias("at"))
    first = scratch.keep(rows.groupBy("set").agg(F.min("at").alias("first"), F.count("*").alias("n")), "first")
    several = first.where("n > 1")
    copies = scratch.keep(spread_join(_perhaps_among(rows, "set", several, "set"), several.drop("n"), "set", ["row"], total, sizes=several).where(F.col("row") != F.col("first.row")).select("row"), "copies")
    # read again where it is used: a table of its own would hold the prefixes and sketches twice
    texts = _without(plain.drop("set"), "row", copies, "row")
    labels = _components(texts, stored.select(F.col(f"{mark}row").alias("row"), F.col(text_column).alias("text")), scratch, often, counts)
    member = scratch.keep(first.select("first", F.col("first.row").alias("bits")).join(labels, "bits"), "member")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    later = spread_join(member, least, "root", ["bits"], member.count()).where(F.col("first.row") != F.col("least.row")).select(F.col("first.row").alias("row"))
    others = scratch.keep(copies.unionByName(later), "others")
    scratch.drop(*[name for name in scratch.paths if name not in ("documents", "others")])
    return _without(stored, f"{mark}row", others, "row").select(*names)

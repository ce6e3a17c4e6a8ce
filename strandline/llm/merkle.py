"""A Merkle manifest of a table: one tree of rows for each source, one tree of their roots, and proofs.

Each task feeds its nodes to a builder. A parent opens with its first child's event and
collects digests by place until it has as many as the tree's size says; then it becomes
an event for its own parent. What is still open at the end of a task goes on by key, to
meet the rest in blocks of leaves that grow each round. Links from nodes to parents are
then followed from the root down, which gives every row its siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandline.llm.common import Scratch, fold, table

#: Bits of a place: a parent has 2**BITS children, the last one of a level fewer.
BITS = 4
ARITY = 1 << BITS
#: Levels by which a round's blocks are higher than those of the round before.
LEVELS = 3
#: Rows are altered where PARTS divides the checksum of their id.
PARTS = 5
NODES = "tree long, size long, level int, at long, digest string, children array<string>, is_open boolean"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values, each as ``-`` if null, else byte count, colon, value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in values]).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def joined(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def arity(size: int, level: int, at: int) -> int:
    """Children of the parent ``at`` of ``level`` in a tree of ``size`` leaves; 0 above the root."""
    below = -(-size >> BITS * (level - 1))
    return 0 if below == 1 else min(ARITY, below - (at << BITS))


class Builder:
    """Open parents by (tree, level, place), each with its children by place."""

    def __init__(self):
        self.open: dict[tuple[int, int, int], dict[int, str]] = {}
        self.sizes: dict[int, int] = {}
        self.rows: list[tuple] = []

    def event(self, tree: int, size: int, level: int, at: int, own: str, children: list[str] | None = None) -> None:
        """A node is complete: it is put out where it is no leaf or has no parent, and told to its parent."""
        while True:
            n = arity(size, level + 1, at >> BITS)
            if children is not None or not n:
                self.rows.append((tree, size, level, at, own, children, False))
            if not n:
                return
            key = (tree, level + 1, at >> BITS)
            held = self.open.setdefault(key, {})
            held[at & ARITY - 1] = own
            if len(held) < n:
                self.sizes[tree] = size
                return
            del self.open[key]
            children = [held[i] for i in range(n)]
            level, at, own = level + 1, at >> BITS, joined(children)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return _batch(rows)

    def frontier(self) -> pa.RecordBatch:
        """The children of parents that are still open."""
        return _batch([(tree, self.sizes[tree], level - 1, (at << BITS) + i, own, None, True) for (tree, level, at), held in self.open.items() for i, own in held.items()])


_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_()]
_NAMES = [x.split(" ")[0] for x in NODES.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of (tree, size, level, at, digest) in a task's own order."""
    builder = Builder()
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            builder.event(*row)
        if len(builder.rows) >= 2000:
            yield builder.taken()
    yield builder.taken()
    yield builder.frontier()


def _in_block(block: pa.Table) -> pa.Table:
    builder = Builder()
    for row in zip(*[block.column(c).to_pylist() for c in _NAMES[:5]]):
        builder.event(*row)
    return pa.Table.from_batches([builder.taken(), builder.frontier()])


def build(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """All parents of the trees, and leaves without one, as (tree, size, level, at, digest, children).

    ``leaves`` has tree, size, at and digest. Rows that lie near each other in a tree
    should lie in one task; then hardly anything is left for the rounds. A block of round r holds
    at most 16**3 nodes of the round's level and what was open at the ends of tasks.
    """
    done = scratch.keep(leaves.select("tree", "size", F.lit(0).alias("level"), "at", "digest").mapInArrow(_in_task, NODES), f"{name}0")
    found, turn = done.where("not is_open"), 0
    while done.where("is_open").limit(1).count():
        turn += 1
        block = F.shiftright(F.call_function("shiftleft", F.col("at"), F.col("level") * BITS), min(60, BITS * LEVELS * turn)).alias("block")
        done = scratch.keep(done.where("is_open").select(*_NAMES[:5], block).groupBy("tree", "block").applyInArrow(_in_block, NODES), f"{name}{turn}")
        found = found.unionByName(done.where("not is_open"))
    return scratch.keep(found.drop("is_open"), f"{name}_nodes")


def _step(child: Column, parent: Column) -> Column:
    """The child's place among its siblings and their digests, left to right."""
    place = (child % ARITY).cast("int")
    others = F.concat(F.slice(parent, F.lit(1), place), F.slice(parent, place + 2, F.lit(ARITY)))
    return F.struct(place.alias("place"), F.array_join(others, "").alias("others"))


def _above(nodes: DataFrame, tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(tree, at, children, path): what lies above leaf ``at`` << BITS of a tree; a lone leaf has no children there.

    ``tops`` gives the path above each tree's root. Levels are followed from the highest
    down, each a sixteenth of the next.
    """
    roots = nodes.where("at = 0").groupBy("tree").agg(F.max("level").alias("top")).join(tops, "tree")
    highest = nodes.agg(F.max("level")).first()[0] or 0
    begin = lambda level: roots.where(F.col("top") == level).select("tree", F.lit(0).cast("long").alias("at"), F.lit(None).cast("array<string>").alias("children"), "path")
    above = begin(highest)
    for level in range(highest, 0, -1):
        own = nodes.where(F.col("level") == level).select("tree", F.col("at").alias("own"), F.col("children").alias("below"), F.shiftright("at", BITS).alias("at"))
        met = own.join(above, ["tree", "at"])
        path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(F.array(_step(F.col("own"), F.col("children"))), F.col("path")))
        above = scratch.keep(met.select("tree", F.col("own").alias("at"), F.col("below").alias("children"), path.alias("path")).unionByName(begin(level - 1)), f"{name}_above{level}")
    return above


def _numbered(rows: DataFrame, by: list[Column], group: str, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in a global order, with their number within the group, and (group, tree, size): groups numbered in the same order.

    Rows are dealt out by ranges, each partition counts its groups, and the counts of the
    partitions before are added; a group of any size is spread over the partitions.
    """
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id())
    dealt = scratch.keep(dealt.withColumn("part", F.shiftright("row", 33)), f"{name}_sorted")
    runs = scratch.keep(dealt.groupBy("part", group).agg(F.count("*").alias("n"), F.min("row").alias("first")), f"{name}_runs")
    # a row for each partition: groups that begin in it
    begun = runs.groupBy(group).agg(F.sum("n").alias("size"), F.min("first").alias("begin"))
    begun = scratch.keep(begun, f"{name}_begun")
    before, starts = 0, [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for r in begun.groupBy(F.shiftright("begin", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts += [F.lit(r["part"]).cast("long"), F.lit(before).cast("long")]
        before += r["n"]
    order = Window.partitionBy(F.shiftright("begin", 33)).orderBy("begin")
    trees = begun.select(group, "size", (F.element_at(F.create_map(*starts[2:] or starts), F.shiftright("begin", 33)) + F.row_number().over(order) - 1).alias("tree"))
    trees = scratch.keep(trees, f"{name}_trees")
    same = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("part", group, "first", F.coalesce(F.sum("n").over(same), F.lit(0)).alias("carry"))
    known = carried.alias("c").join(trees.alias("t"), F.col(f"c.{group}").eqNullSafe(F.col(f"t.{group}"))).select("c.part", F.col(f"c.{group}").alias("__group"), "first", "carry", "size", "tree")
    met = dealt.alias("d").join(known.alias("k"), (F.col("d.part") == F.col("k.part")) & F.col(f"d.{group}").eqNullSafe(F.col("k.__group")))
    return met.select("d.*", "k.tree", "k.size", (F.col("carry") + F.col("row") - F.col("first")).alias("at")).drop("part", "row"), trees


def manifest(docs: DataFrame, columns: list[str], id_column: str = "doc_id", source_column: str = "source", altered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf is the digest of ``columns``. Where ``altered`` holds, the row is checked as if
    its columns were those of ``changed``: the root folded from it and the original
    siblings then differs from the root, if the row does. Within a source rows ascend by
    id, a null id first, rows of one id by their leaf; repeated rows are leaves each. A null
    source comes first. Null columns have a digest of their own kind. Other columns are
    not read. An empty table gives no rows.
    """
    scratch, changed = Scratch(docs.sparkSession), changed or {}
    leaf = digest([F.col(c) for c in columns])
    other = F.when(altered if altered is not None else F.lit(False), digest([changed.get(c, F.col(c)) for c in columns]))
    leaves = scratch.keep(docs.select(F.col(source_column).alias("source"), F.col(id_column).cast("long").alias("doc_id"), leaf.alias("digest"), other.alias("other")), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    # identical rows are told apart, so that any number of them is dealt to several partitions
    rows, trees = _numbered(leaves.withColumn("copy", F.monotonically_increasing_id()), [*order, F.col("copy")], "source", scratch, "rows")
    numbered = scratch.keep(rows.select("tree", "size", "at", "doc_id", "digest", "other").sortWithinPartitions("tree", "at"), "numbered")
    nodes = build(numbered, scratch, "row")
    subroots = scratch.keep(nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("subroot"), F.first("size").alias("size")), "subroots")
    # the roots of all sources are the leaves of one more tree, whose places are the sources' numbers
    several = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(subroots.count()).alias("size"), F.col("tree").alias("at"), F.col("subroot").alias("digest")).sort("at")
    top = build(several, scratch, "source")
    root = top.agg(F.max_by("digest", "level")).first()[0]
    nothing = F.array().cast("array<struct<place:int,others:string>>")
    start = docs.sparkSession.range(1).select(F.col("id").alias("tree"), nothing.alias("path"))
    over = _above(top, start, scratch, "source")
    tops = _with_path(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("tree").alias("of"), "subroot"), over)
    tops = scratch.keep(tops.select(F.col("of").alias("tree"), "path", "subroot"), "tops")
    # a source's root travels with the paths, which meet each row by its run of siblings: no source is one key
    above = _above(nodes, tops.select("tree", F.concat("path", F.array(F.struct(F.lit(-1).alias("place"), F.col("subroot").alias("others")))).alias("path")), scratch, "row")
    proven = _with_path(numbered, above).withColumn("subroot", F.element_at("path", -1)["others"]).withColumn("path", F.filter("path", lambda s: s["place"] >= 0))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["others"]), "").cast("binary"), 256)
    up = lambda own, s: F.sha2(F.concat(F.substring(s["others"], F.lit(1), 64 * s["place"]), own, F.substring(s["others"], 64 * s["place"] + 1, F.lit(64 * ARITY))).cast("binary"), 256)
    folded = F.aggregate("path", F.coalesce("other", "digest"), up)
    out = proven.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _with_path(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` (tree, at, ...) with the path above each."""
    up = above.select("tree", F.col("at").alias("up"), "children", F.col("path").alias("rest"))
    met = rows.withColumn("up", F.shiftright("at", BITS)).join(up, ["tree", "up"])
    path = F.when(F.col("children").isNull(), F.col("rest")).otherwise(F.concat(F.array(_step(F.col("at"), F.col("children"))), F.col("rest")))
    return met.select(*rows.columns, path.alias("path"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), COLUMNS, altered=fold(F.col("doc_id"), PARTS) == 0, changed={"text": ascii_lower(F.col("text"))})


def _sql_digest(text: str) -> str:
    named = [f"CAST({c} AS VARCHAR)" for c in COLUMNS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in named) + ")"


#: crc32 by bits: each character's code (plus 256, to tell it from a step) and eight steps of the register.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
    lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""


def _sql_tree(name: str, leaves: str) -> str:
    """Level by level: all nodes, then the children of each parent."""
    return f"""{name} AS (
  {leaves}
  UNION ALL
  SELECT tree, level + 1, spot // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY spot)) FROM {name} WHERE size > 1 GROUP BY ALL),
{name}_runs AS (SELECT tree, level, spot // 16 AS up, list(digest ORDER BY spot) AS kids FROM {name} WHERE size > 1 GROUP BY ALL)"""


def _sql_fold(name: str, rows: str, runs: str) -> str:
    return f"""{name} AS (
  {rows}
  UNION ALL
  SELECT f.key, f.tree, f.level + 1, f.spot // 16,
         sha256(array_to_string(list_concat(list_concat(kids[1:f.spot % 16], [f.own]), kids[f.spot % 16 + 2:]), '')),
         f.proof || array_to_string(list_concat(kids[1:f.spot % 16], kids[f.spot % 16 + 2:]), '')
  FROM {name} f JOIN {runs} r ON f.tree = r.tree AND f.level = r.level AND f.spot // 16 = r.up),
{name}_ends AS (SELECT key, max_by(own, level) AS own, max_by(proof, level) AS proof FROM {name} GROUP BY key)"""


OP13_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_sql_digest("text")} AS leaf,
         CASE WHEN {_SQL_CRC} % {PARTS} = 0 THEN {_sql_digest(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents),
base AS (
  SELECT *, row_number() OVER () AS key, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY source) AS size
  FROM hashed),
{_sql_tree("nodes", "SELECT tree, 0 AS level, spot, size, leaf AS digest FROM base")},
subroots AS (SELECT tree, digest AS subroot, count(*) OVER () AS sources FROM nodes WHERE size = 1),
{_sql_tree("tops", "SELECT 0::BIGINT AS tree, 0 AS level, tree AS spot, sources AS size, subroot AS digest FROM subroots")},
{_sql_fold("low", "SELECT key, tree, 0 AS level, spot, coalesce(other, leaf) AS own, '' AS proof FROM base", "nodes_runs")},
{_sql_fold("high", "SELECT key, 0::BIGINT AS tree, 0 AS level, tree AS spot, own, proof FROM low_ends JOIN base USING (key)", "tops_runs")}
SELECT doc_id, leaf, subroot, root, sha256(e.proof) AS proof_sha256, e.own AS folded_root, e.own = root AS verified
FROM base JOIN high_ends e USING (key) JOIN subroots USING (tree), (SELECT digest AS root FROM tops WHERE size = 1)
"""

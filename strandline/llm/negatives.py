"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With one more component, sqrt(M^2 - |x|^2), all vectors have the largest norm M, and the
distance of an anchor, whose further component is 0, is d^2 = M^2 + |q|^2 - 2 <q, x>. So the
largest inner products are the nearest rows, and a window of scores is an annulus. A leaf
keeps the least and largest distance of its rows from each vantage point above it, which
bound an anchor's distance to them. Leaves that an annulus meets are visited
nearest first; once an anchor has its k rows, only leaves that may hold a better one remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.common import Scratch, least_drawn, table

#: Vectors that the tree is fit on at most, and the share of the sample that a leaf holds at most.
SAMPLE, LEAF = 20_000, 1 / 32
#: Vantage points that are tried for a node, on so many of its vectors.
TRIED, SPREAD_OF = 8, 500
#: Shares of an anchor's leaves, nearest first, after which it is asked whether others can still hold a better row.
STEPS = (1 / 8, 1.0)
#: Vectors and anchors of one cell at most.
ROWS, ANCHORS = 4096, 512
#: What rounding may change in a squared distance, as a share of the largest.
ROUNDING = 1e-9
FLOOR, CEILING = -(1 << 63), (1 << 63) - 1
INDEX = "leaf int, vec_id long, label long, vector array<double>"
BEST = "anchor_id long, ceiling long, vec_id long, score long"


class VantageTree:
    """Inner nodes with vantage point and radius; ``path[leaf]`` names the nodes above a leaf, from the root down."""

    def __init__(self, scale: float, norm: float):
        self.scale, self.norm = scale or 1.0, norm
        self.points: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.path: list[list[int]] = []

    def augmented(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.scale
        rest = np.maximum(0.0, self.norm**2 - (scaled**2).sum(axis=1))
        return np.column_stack([scaled, np.sqrt(rest)])

    def fit(self, vectors: np.ndarray, least: int, seed: int = 5) -> VantageTree:
        rng = np.random.default_rng(seed)
        own = self.augmented(vectors)

        def grow(rows: np.ndarray, above: list[int]) -> int:
            """The node's number, or -1 - leaf."""
            if len(rows) > least:
                some = own[rng.permutation(rows)[:SPREAD_OF]]
                tried = some[:TRIED]
                point = tried[np.argmax([np.sqrt(((some - p) ** 2).sum(axis=1)).std() for p in tried])]
                far = np.sqrt(((own[rows] - point) ** 2).sum(axis=1))
                radius = float(np.median(far))
                inside = far <= radius
                if not inside.all():
                    node = len(self.points)
                    self.points.append(point)
                    self.radii.append(radius)
                    self.children.append((0, 0))
                    self.children[node] = (grow(rows[inside], [*above, node]), grow(rows[~inside], [*above, node]))
                    return node
            self.path.append(above)
            return -len(self.path)

        self.root = grow(np.arange(len(own)), [])
        return self

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's leaf, and its distances from the vantage points above it."""
        own, leaf = self.augmented(vectors), np.zeros(len(vectors), np.int32)
        reach: list = [None] * len(own)
        waiting = [(self.root, np.arange(len(own)), np.zeros((len(own), 0)))]
        while waiting:
            node, rows, far = waiting.pop()
            if node < 0:
                leaf[rows] = -1 - node
                for i, x in zip(rows, far):
                    reach[i] = x
            elif len(rows):
                d = np.sqrt(((own[rows] - self.points[node]) ** 2).sum(axis=1))
                inside, far = d <= self.radii[node], np.column_stack([far, d])
                waiting += [(child, rows[part], far[part]) for child, part in zip(self.children[node], (inside, ~inside))]
        return leaf, reach

    def bounds(self, anchor: np.ndarray, shells: dict[int, tuple[list[float], list[float]]]) -> list[tuple[float, int, float, float]]:
        """(least distance, leaf, least score, largest score) of each leaf that has rows, nearest first. The scores are unscaled and leave room for rounding."""
        q = anchor / self.scale
        square = float((q**2).sum())
        far = np.sqrt(((np.array(self.points) - np.append(q, 0.0)) ** 2).sum(axis=1)) if self.points else np.zeros(0)
        whole, out = self.norm**2 + square, []
        room = ROUNDING * whole
        for leaf, (low, high) in shells.items():
            d = far[self.path[leaf]]
            near = max(0.0, float(np.max(np.maximum(d - high, low - d), initial=0.0)))
            most = float(np.min(d + high, initial=self.norm + square**0.5))
            unit = self.scale**2
            out.append((near, leaf, (whole - most**2 - room) / 2 * unit, (whole - near**2 + room) / 2 * unit))
        return sorted(out)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those beyond 64 bits become the end of the range."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        whole = np.vectorize(int, otypes=[object])
        return np.clip(whole(a) @ whole(b).T, FLOOR, CEILING).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties by the smaller id."""
    if len(ids) > k:
        near = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def whole_vectors(vectors: DataFrame, id_column: str, label_column: str, vector_column: str, units: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, components as whole numbers."""
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    # a double that large is a whole number already, and has no room for the factor
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**45, F.floor(x * float(units)).cast("double")).otherwise(x * float(units)))
    return usable.withColumn("vector", whole)


class Index:
    """The rows by leaf, written to the shared folder, with the shells of each leaf."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.scratch, self.spark = scratch, rows.sparkSession
        most, norm = F.array_max(F.transform("vector", F.abs)), lambda scale: F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.lit(scale)) ** 2))
        scale = rows.agg(F.max(most)).first()[0] or 1.0
        tree = VantageTree(scale, float(rows.agg(norm(scale)).first()[0] or 0.0) ** 0.5)
        sample = np.array([r["vector"] for r in least_drawn(rows, F.xxhash64("vec_id"), SAMPLE).select("vector").collect()])
        self.tree = tree.fit(sample, max(16, int(LEAF * len(sample))))
        depth = max(map(len, tree.path))

        def leafed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    leaf, reach = tree.assign(_matrix(batch.column(2)))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns, pa.array([x.tolist() for x in reach], pa.list_(pa.float64()))], names=["leaf", "vec_id", "label", "vector", "reach"])

        # numbered, so that repeated rows are dealt to several cells too
        self.rows = scratch.keep(rows.mapInArrow(leafed, f"{INDEX}, reach array<double>").withColumn("row", F.monotonically_increasing_id()), "index")
        at = lambda j: F.get("reach", F.lit(j))
        found = self.rows.groupBy("leaf").agg(F.count("*").alias("n"), F.array(*[F.min(at(j)) for j in range(depth)]).alias("low"), F.array(*[F.max(at(j)) for j in range(depth)]).alias("high")).collect()
        part = lambda r, c: np.array(r[c][: len(tree.path[r["leaf"]])], float)
        self.held = {r["leaf"]: r["n"] for r in found}
        self.shells = {r["leaf"]: (part(r, "low"), part(r, "high")) for r in found}

    def best(self, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """anchor_id, ceiling, vec_id, score: for each window the ``k`` largest scores from its floor to its ceiling.

        ``asked`` has anchor_id, label, vector and windows, an array of (ceiling, low). Rows of
        the anchor's label count if ``same``, else those of other labels; the anchor itself never.
        """
        tree, shells, found = self.tree, self.shells, None
        asked = asked.withColumn("windows", F.transform("windows", lambda w: F.struct(w["ceiling"].alias("ceiling"), w["low"].alias("low"), w["low"].alias("floor"))))
        for turn, share in enumerate(STEPS):
            if found is not None:
                full = found.groupBy("anchor_id", "ceiling").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
                least = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("ceiling", "least"))).alias("least"))
                raised = F.transform("windows", lambda w: F.struct(w["ceiling"].alias("ceiling"), w["low"].alias("low"), F.coalesce(F.element_at("least", w["ceiling"]), w["low"]).alias("floor")))
                asked = asked.join(least, "anchor_id", "left").withColumn("windows", raised).drop("least")

            def visits(batches: Iterator[pa.RecordBatch], before=STEPS[turn - 1] if turn else 0.0, share=share) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    leaves, rows = [], []
                    for i, (vector, windows) in enumerate(zip(_matrix(batch.column(2)) if batch.num_rows else [], batch.column(3).to_pylist())):
                        meets = lambda least, most, at, windows=windows: any(most >= w[at] and least <= w["ceiling"] for w in windows)
                        order = [b for b in tree.bounds(vector, shells) if meets(b[2], b[3], "low")]
                        picked = [b[1] for b in order[int(np.ceil(before * len(order))) : int(np.ceil(share * len(order)))] if meets(b[2], b[3], "floor")]
                        leaves += picked
                        rows += [i] * len(picked)
                    places = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), *[c.take(places) for c in batch.columns]], names=["leaf", "anchor_id", "label", "vector", "windows"])

            columns = asked.select("anchor_id", "label", "vector", "windows")
            bins = self.scratch.keep(columns.mapInArrow(visits, "leaf int, anchor_id long, label long, vector array<double>, windows array<struct<ceiling:long,low:long,floor:long>>"), f"{name}_bins{turn}")
            near = self._cells(bins, same, k)
            order = Window.partitionBy("anchor_id", "ceiling").orderBy(F.col("score").desc(), "vec_id")
            every = near if found is None else found.unionByName(near)
            found = self.scratch.keep(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), f"{name}{turn}")
            self.scratch.drop(f"{name}_bins{turn}")
        return found

    def _cells(self, bins: DataFrame, same: bool, k: int) -> DataFrame:
        """The best rows of each cell: at most ROWS rows of a leaf and ANCHORS anchors that visit it."""
        wanted = {r["leaf"]: r["count"] for r in bins.groupBy("leaf").count().collect()}  # a row for each leaf
        cells = [(leaf, -(-self.held[leaf] // ROWS), -(-n // ANCHORS)) for leaf, n in wanted.items()]
        cells = F.broadcast(self.spark.createDataFrame(cells, "leaf int, blocks int, parts int"))
        salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows.join(cells, "leaf").select("leaf", salt("row", "blocks").alias("block"), every("parts").alias("part"), "vec_id", "label", "vector")
        asked = bins.join(cells, "leaf").select("leaf", every("blocks").alias("block"), salt("anchor_id", "parts").alias("part"), "anchor_id", "label", "vector", "windows")

        def cell(own: pa.Table, anchors: pa.Table) -> pa.Table:
            out = []
            if own.num_rows and anchors.num_rows:
                ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
                scores = products(_matrix(anchors.column("vector").combine_chunks()), _matrix(own.column("vector").combine_chunks()))
                for s, anchor, label, windows in zip(scores, *[anchors.column(c).to_pylist() for c in ("anchor_id", "label", "windows")]):
                    allowed = (ids != anchor) & ((labels == label) == same)
                    for w in windows:
                        rows = np.nonzero(allowed & (s <= w["ceiling"]) & (s >= w["floor"]))[0]
                        rows = rows[best_of(ids[rows], s[rows], k)]
                        out += [(anchor, w["ceiling"], v, x) for v, x in zip(ids[rows].tolist(), s[rows].tolist())]
            columns = list(zip(*out)) or [[]] * 4
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "ceiling", "vec_id", "score"])

        key = ("leaf", "block", "part")
        return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(cell, BEST)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and positive_rank.

    ``rows`` and ``anchors`` have vec_id, label and vector as ``whole_vectors`` gives them. An
    anchor's positives are its best other rows of the same label, by inner product, ties by
    the smaller id; for each the best ``k`` rows of other labels whose score lies between
    four fifths of the positive's and all of it come back. A negative positive score
    leaves no such row. An id asked more than once is asked with its least label and
    vector; a row is never its own partner, by id; repeated rows are candidates each, and
    of those with an anchor's own id none. Vectors of another length than the commonest take no part;
    zero vectors do. An empty table gives no rows.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    fit = lambda df: df.where(F.size("vector") == sizes[0]["d"])
    index = Index(fit(rows), scratch)
    least = fit(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "vector")).alias("own"))
    asked = scratch.keep(least.select("anchor_id", "own.label", "own.vector"), "anchors")
    window = lambda ceiling, low: F.struct(ceiling.cast("long").alias("ceiling"), low.cast("long").alias("low"))
    near = index.best(asked.withColumn("windows", F.array(window(F.lit(CEILING), F.lit(FLOOR)))), True, positives, "positives")
    order = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    chosen = near.withColumn("positive_rank", F.row_number().over(order("anchor_id"))).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("ceiling"), "positive_rank")
    # the least score allowed, rounded up, without a product that could overflow
    low = F.expr("ceiling - ceiling div 5")
    windows = chosen.where("ceiling >= 0").select("anchor_id", window(F.col("ceiling"), low).alias("w")).groupBy("anchor_id").agg(F.collect_set("w").alias("windows"))
    hard = index.best(asked.join(windows, "anchor_id"), False, k, "negatives")
    ranked = hard.withColumn("rank", F.row_number().over(order("anchor_id", "ceiling")))
    met = chosen.join(ranked, ["anchor_id", "ceiling"])
    return met.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("ceiling").alias("positive_score"), F.col("score").alias("negative_score"), "positive_rank")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    rows = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM scored WHERE same) WHERE positive_rank <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score, positive_rank::INT AS positive_rank FROM ranked WHERE rank <= 5
"""

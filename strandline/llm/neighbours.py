"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.common import Scratch, least_drawn, table

#: Vectors that the tree is fit on at most, children of a node, and the share of the sample that a leaf holds at most.
#: Leaves are shares of the table, so a query's visits do not grow with it; a large leaf is searched in blocks.
SAMPLE, BRANCHES, LEAF = 20_000, 8, 1 / 32
#: Queries that the number of leaf visits is calibrated on at most, and the recall to reach on them.
CALIBRATE, RECALL = 200, 0.96
#: What the order of summation may change in a cosine, at most.
ROUNDING = 1e-9
#: Vectors and queries of one cell of the search at most.
ROWS, QUERIES = 4096, 1024


class Tree:
    """centres of all nodes, the children of each, and the leaf number of those without."""

    def __init__(self):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    @classmethod
    def fit(cls, unit: np.ndarray, least: int, seed: int = 3) -> Tree:
        """Splits by k-means until a node has at most ``least`` of the sampled vectors, or only copies."""
        tree, rng = cls(), np.random.default_rng(seed)
        waiting = [(tree._node(unit.mean(axis=0) if len(unit) else np.zeros(unit.shape[1])), unit)]
        while waiting:
            node, own = waiting.pop()
            parts = cls._split(own, rng) if len(own) > least else []
            if len(parts) < 2:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
                continue
            for centre, members in parts:
                child = tree._node(centre)
                tree.children[node].append(child)
                waiting.append((child, members))
        return tree

    @staticmethod
    def _split(own: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = np.unique(own[rng.permutation(len(own))[: 4 * BRANCHES]], axis=0)
        centres = centres[rng.permutation(len(centres))[:BRANCHES]]
        for _ in range(12):
            nearest = np.argmax(own @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
            used = np.unique(nearest)
            moved = np.stack([own[nearest == k].mean(axis=0) for k in used])
            if len(moved) == len(centres) and np.allclose(moved, centres):
                break
            centres = moved
        nearest = np.argmax(own @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        return [(centres[k], own[nearest == k]) for k in np.unique(nearest)]

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf that each vector comes to by the nearest child of every node."""
        out = np.zeros(len(unit), np.int32)
        waiting = [(0, np.arange(len(unit)))]
        while waiting:
            node, rows = waiting.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            centres = np.stack([self.centres[c] for c in self.children[node]])
            nearest = np.argmax(unit[rows] @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
            waiting += [(child, rows[nearest == k]) for k, child in enumerate(self.children[node]) if (nearest == k).any()]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of the priority queue: the open node whose centre is nearest comes next."""
        far = ((np.stack(self.centres) - query) ** 2).sum(axis=1)
        queue = [(far[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for child in self.children[node]:
                heapq.heappush(queue, (far[child], child))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small components neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, vectors in double precision."""
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return named.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the ``k`` nearest of a block for each query, ties by id. Vectors of one direction stand together."""
    units = _unit(vectors)
    order = np.lexsort((ids, *units.T[::-1]))
    ids, units = ids[order], units[order]
    first = np.nonzero(np.concatenate(([True], (units[1:] != units[:-1]).any(axis=1))))[0]
    size = np.diff(np.append(first, len(ids)))
    distinct = units[first]
    units = _unit(queries)
    rough = units @ distinct.T
    # one direction may be the query's alone; all that reach the next one but for rounding are looked at, however many tie
    take = min(len(first), k + 1)
    least = -np.partition(-rough, take - 1, axis=1)[:, take - 1] - ROUNDING
    out = []
    for q in range(len(queries)):
        near = np.nonzero(rough[q] >= least[q])[0]
        exact = (distinct[near] * units[q]).sum(axis=1)
        # of a direction's copies the k + 1 of least id are enough: one may be the query itself
        rows = np.concatenate([first[d] + np.arange(min(size[d], k + 1)) for d in near])
        score = np.repeat(exact, np.minimum(size[near], k + 1))
        other = ids[rows] != query_ids[q]
        rows, score = rows[other], score[other]
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[rows[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _calibrate(index: DataFrame, tree: Tree, asked: list, k: int, recall: float) -> int:
    """The fewest leaf visits that find ``recall`` of the true neighbours of the calibration queries.

    The true ones come from all rows: every task keeps the ``k`` nearest of its blocks.
    """
    if not asked:
        return 1
    query_ids, queries = np.array([r["vec_id"] for r in asked]), np.array([r["vector"] for r in asked])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, leaves = part.column(1).to_numpy(), part.column(0).to_numpy()
                q, v, s = _nearest(ids, _matrix(part.column(2)), query_ids, queries, k)
                by_id = dict(zip(ids.tolist(), leaves.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array([by_id[x] for x in v.tolist()], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])

    near = index.select("leaf", "vec_id", "vector").mapInArrow(task, "query_id long, vec_id long, score double, leaf int")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    true = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "leaf").collect()
    places = {i: {leaf: n for n, leaf in enumerate(tree.best_bins(unit))} for i, unit in zip(query_ids.tolist(), _unit(queries))}
    needed = np.sort([places[r["query_id"]][r["leaf"]] + 1 for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each query, by largest cosine.

    The tree is fit on at most SAMPLE vectors; every vector is put in a leaf. Leaves are
    visited best bin first, as many as the calibration asks for and until they hold more
    than ``k`` rows. A leaf of any size is searched in cells of ROWS vectors by QUERIES
    queries. Vectors that are null, empty, zero or hold a null or non-finite component take no
    part, nor do those whose length is not the commonest. A row is never its own
    neighbour, by id; an id asked more than once is asked with its least vector; repeated
    rows are candidates each; ties, of any number, go to the smaller id. Other columns are
    not read, whatever their names; an empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    usable = _usable(vectors, id_column, vector_column)
    sizes = usable.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    d = sizes[0]["d"]
    usable = usable.where(F.size("vector") == d)
    asked = _usable(queries, id_column, vector_column).where(F.size("vector") == d).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    by_hash = F.xxhash64("vec_id")
    sample = np.array([r["vector"] for r in least_drawn(usable, by_hash, SAMPLE).collect()])
    tree = Tree.fit(_unit(sample), max(16, int(LEAF * len(sample))))

    def leafed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.assign(_unit(_matrix(batch.column(1)))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), *batch.columns], names=["leaf", "vec_id", "vector"])

    index = scratch.keep(usable.mapInArrow(leafed, "leaf int, vec_id long, vector array<double>"), "index")
    visits = _calibrate(index, tree, least_drawn(asked, by_hash, CALIBRATE).collect(), k, recall)
    # a row for each leaf, of which there are at most SAMPLE / 16
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(_matrix(batch.column(1))) if batch.num_rows else []
            for at in range(0, batch.num_rows, 256):
                rows, leaves = [], []
                for i in range(at, min(at + 256, batch.num_rows)):
                    seen = 0
                    for turn, leaf in enumerate(tree.best_bins(units[i])):
                        if turn >= visits and seen > k:
                            break
                        seen += held.get(leaf, 0)
                        if leaf in held:
                            rows.append(i)
                            leaves.append(leaf)
                picked = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), batch.column(0).take(picked), batch.column(1).take(picked)], names=["leaf", "vec_id", "vector"])

    bins = scratch.keep(asked.mapInArrow(visited, "leaf int, vec_id long, vector array<double>"), "bins")
    wanted = {r["leaf"]: r["count"] for r in bins.groupBy("leaf").count().collect()}
    cells = [(leaf, -(-rows // ROWS), -(-wanted[leaf] // QUERIES)) for leaf, rows in held.items() if leaf in wanted]
    cells = F.broadcast(spark.createDataFrame(cells, "leaf int, blocks int, parts int"))
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(cells, "leaf").select("leaf", salt("blocks").alias("block"), every("parts").alias("part"), "vec_id", "vector")
    questions = bins.join(cells, "leaf").select("leaf", every("blocks").alias("block"), salt("parts").alias("part"), "vec_id", "vector")

    def cell(own: pa.Table, asked: pa.Table) -> pa.Table:
        if own.num_rows and asked.num_rows:
            q, v, s = _nearest(own.column("vec_id").to_numpy(), _matrix(own.column("vector").combine_chunks()), asked.column("vec_id").to_numpy(), _matrix(asked.column("vector").combine_chunks()), k)
        else:
            q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    key = ("leaf", "block", "part")
    near = rows.groupBy(*key).cogroup(questions.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))

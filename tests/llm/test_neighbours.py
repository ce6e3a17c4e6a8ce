import numpy as np

from strandline.llm import neighbours
from strandline.llm.mixing import OP1_SQL, op1_mixing
from tests.oracle import DATA, connect, of_duckdb, of_spark


def brute(ids, vectors, query_ids, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in query_ids:
        s = unit @ unit[np.nonzero(ids == q)[0][0]]
        order = np.lexsort((ids, -s))
        out[q] = [int(ids[j]) for j in order if ids[j] != q][:k]
    return out


def test_recall_on_the_given_vectors(spark):
    folder = DATA.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = brute(ids, vectors, [int(i) for i in ids if i % 50 == 0])
    got = {}
    for r in neighbours.op10_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert got.keys() == want.keys()
    found = sum(len({v for _, v in got[q]} & set(want[q])) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    assert all([r for r, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())


def test_odd_vectors_take_no_part_and_ties_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [3.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [0.0, 1.0], 1), (8, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int")
    got = [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.search(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 7, 0.0)]
    assert neighbours.search(vectors.where("false"), vectors.where("false")).count() == 0


def test_any_number_of_ties_goes_to_the_smaller_ids(spark):
    """Scaled copies of one direction, mirrored directions of equal cosine, and repeated rows."""
    rows = [(i, [float(i), 3.0 * i, 0.5 * i]) for i in range(1, 61)]
    other = [(100 + i, [1.0, 1.0, 1.0 if i % 2 else -1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows + other + [(0, [1.0, 3.0, 0.5]), (7, [1.0, 0.0, 0.0]), (500, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>").repartition(3)
    got = [r["vec_id"] for r in neighbours.search(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]
    axis = spark.createDataFrame([(0, [1.0, 0.0])] + [(i, [1.0, 1.0 if i % 2 else -1.0]) for i in range(1, 41)] + [(i, [2.0 + i, -1.0 * (2 + i)]) for i in range(41, 60)], "vec_id long, embedding array<double>").withColumn("rank", neighbours.F.lit("x"))
    found = neighbours.search(axis, axis.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3, 4, 5]
    twice = neighbours.search(axis.union(axis), axis.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in twice] == [1, 1, 2, 2, 3]
    assert neighbours.search(axis.where("false"), axis).count() == 0


def test_mix_equals_sql(spark):
    assert of_spark(op1_mixing(spark, DATA)) == of_duckdb(connect(), OP1_SQL)

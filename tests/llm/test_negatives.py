"""Hard negatives against every pair's score."""

import math

import numpy as np
import pytest

from strandline.llm import negatives
from tests.oracle import DATA, connect, of_duckdb, of_spark

SCHEMA = "vec_id long, embedding array<double>, label int, leaf string, windows string"


def plain_rows(rows):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    return [(i, label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and ok(v)]


def brute(rows, anchors, k=5):
    out = []
    for a, label, q in anchors:
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, other == label) for i, other, v in rows if i != a))
        for place, (s, p, _) in enumerate([x for x in scored if x[2]][:k], 1):
            fit = [(t, n) for t, n, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r, n, -s, -t, place) for r, (t, n) in enumerate(fit[:k], 1)]
    return sorted(out)


def mined(df, anchors="vec_id % 100 = 0"):
    whole = negatives.whole_vectors(df, "vec_id", "label", "embedding")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    return sorted(tuple(r) for r in negatives.mine(whole, whole.where(anchors)).select(*names).collect())


def random_rows(n, d=6, labels=3, seed=1, size=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (size * rng.normal(size=d)).tolist(), int(rng.integers(labels)), "clash", "clash") for i in range(n)]


@pytest.mark.parametrize("size", [1.0, 3e4, 1e-3])
def test_rows_equal_every_pair(spark, size):
    rows = random_rows(900, size=size)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    whole = plain_rows(rows)
    assert got == brute(whole, [r for r in whole if r[0] % 100 == 0]) and (got or size < 1)


def test_ties_copies_zero_and_odd_vectors(spark):
    rows = random_rows(120, d=3, seed=2) + [(200 + i, [1.0, 0.5, 0.0], i % 2, "x", "y") for i in range(90)] + [(300 + i, [0.0, 0.0, 0.0], i % 3, "x", "y") for i in range(20)]
    rows += [(7, [1.0, 0.5, 0.0], 1, "x", "y"), (7, [1.0, 0.5, 0.0], 1, "x", "y"), (None, [1.0, 0.0, 0.0], 1, "x", "y"), (901, None, 1, "x", "y"), (902, [1.0, None, 0.0], 1, "x", "y"), (903, [float("nan"), 1.0, 0.0], 1, "x", "y")]
    rows += [(904, [float("inf"), 1.0, 0.0], 1, "x", "y"), (905, [1.0, 1.0, 1.0], None, "x", "y"), (906, [], 1, "x", "y")]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(4))
    whole = plain_rows(rows)
    assert got == brute(whole, [r for r in whole if r[0] % 100 == 0])


def test_small_hot_and_empty_tables(spark):
    df = spark.createDataFrame(random_rows(3), SCHEMA)
    assert mined(df) == brute(plain_rows(random_rows(3)), plain_rows(random_rows(3))[:1])
    assert mined(df.where("false")) == [] and mined(df, "false") == []
    one_label = spark.createDataFrame([(i, [1.0, float(i)], 4, "x", "y") for i in range(150)], SCHEMA)
    assert mined(one_label) == []


def test_a_large_leaf_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = [(i, [1.0, 2.0, i % 2 / 256], i % 3, "x", "y") for i in range(500)] + [(100, [1.0, 2.0, 0.0], 1, "x", "y")] * 200
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    whole = plain_rows(rows)
    anchors = [min(r for r in whole if r[0] == a) for a in range(0, 500, 100)]
    assert got == brute(whole, anchors)


def test_bounds_hold_and_leave_leaves_out(spark):
    """Clustered vectors: the least and largest score of a leaf hold all its rows, and most leaves miss a narrow window."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 40
    own = np.floor(np.concatenate([c + rng.normal(size=(50, 8)) for c in centres]) * 256)
    scale = np.abs(own).max()
    tree = negatives.VantageTree(scale, np.sqrt(((own / scale) ** 2).sum(axis=1)).max()).fit(own, 60)
    leaf, reach = tree.assign(own)
    shells = {k: tuple(np.array([reach[i] for i in np.nonzero(leaf == k)[0]]).__getattribute__(f)(axis=0) for f in ("min", "max")) for k in set(leaf.tolist())}
    missed = 0
    for q in own[::37]:
        scores = own @ q
        fifth = np.sort(scores)[-5]
        for _, k, least, most in tree.bounds(q, shells):
            assert least <= scores[leaf == k].min() and scores[leaf == k].max() <= most
            missed += most < fifth
    assert missed > 0.5 * len(own[::37]) * len(shells)


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**21 + 1, 5.0], [2.0**45, 2.0**45]])
    assert negatives.products(a, b).tolist() == [[(2**40 + 1) * (2**21 + 1) + 15, (1 << 63) - 1]]


def test_query_equals_sql(spark):
    assert of_spark(negatives.op12_negatives(spark, DATA)) == of_duckdb(connect(), negatives.OP12_SQL)
    folder = DATA.replace("0.001", "0.1")
    assert of_spark(negatives.op12_negatives(spark, folder)) == of_duckdb(connect(folder), negatives.OP12_SQL)

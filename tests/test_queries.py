import pytest

from strandline.plans import registry
from tests.oracle import DATA, connect, of_duckdb, of_spark

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, con, name):
    assert of_spark(QUERIES[name](spark, DATA)) == of_duckdb(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_repeats(spark, name):
    first = of_spark(QUERIES[name](spark, DATA))
    assert first[1] and first == of_spark(QUERIES[name](spark, DATA))


def test_approximate_count_is_near(spark):
    exact = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/lineitem.parquet").groupBy("l_returnflag").agg({"l_partkey": "count"}).collect()}
    distinct = {r["l_returnflag"]: r["parts"] for r in QUERIES["ext_approx_distinct"](spark, DATA).collect()}
    true = {r[0]: r[1] for r in spark.sql(f"SELECT l_returnflag, count(DISTINCT l_partkey) FROM parquet.`{DATA}/lineitem.parquet` GROUP BY 1").collect()}
    assert set(exact) == set(distinct)
    assert all(abs(distinct[k] - true[k]) <= 0.08 * true[k] for k in true)


def test_stream_filter_equals_batch(spark):
    got = {(r["user_id"], r["event_id"]): r["y"] for r in QUERIES["t01_stateful_filter"](spark, DATA).collect()}
    state, want = {}, {}
    for r in sorted(spark.read.parquet(f"{DATA}/events.parquet").collect(), key=lambda r: r["event_id"]):
        u, x = r["user_id"], r["value"]
        state[u] = x if u not in state else 0.25 * x + 0.75 * state[u]
        want[u, r["event_id"]] = round(state[u], 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

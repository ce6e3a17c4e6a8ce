"""The manifest against its SQL statement and a plain tree."""

import hashlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle
from tests.oracle import DATA, connect, of_duckdb, of_spark, plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, at long, path string"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def rows_like(n, source, first=0):
    return [(first + i, f"Text {i % 7} Ünï", None if i % 5 else "en", source, None if i % 3 else i, 1, "x", 2, "y") for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_like(700, "hot") + rows_like(1, "lone", 5000) + rows_like(17, None, 6000) + rows_like(16, "Zsixteen", 7000) + rows_like(257, "ähm", 8000)
    rows += [r for i in range(40) for r in rows_like(1, f"s{i}", 9000 + i)]
    rows += [(None, None, None, None, None, 1, "x", 2, "y"), (None, "", "", "", 0, 1, "x", 2, "y"), (3, "ABC", "en", "hot", 3, 1, "x", 2, "y"), (3, "ABC", "en", "hot", 3, 1, "x", 2, "y"), (4, "LONG " * 30_000, "en", "hot", 3, 1, "x", 2, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_rows_equal_sql_with_nulls_ties_copies_and_any_number_of_sources(spark, docs):
    found = merkle.manifest(docs, merkle.COLUMNS, altered=merkle.fold(F.col("doc_id"), 5) == 0, changed={"text": merkle.ascii_lower(F.col("text"))})
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
    assert of_spark(found) == of_duckdb(con, merkle.OP13_SQL)


def test_a_small_tree_by_hand(spark):
    docs = spark.createDataFrame([(2, "a"), (1, "b"), (None, "b")], "doc_id long, source string")
    leaf = lambda i, s: sha("-" if i is None else f"{len(str(i))}:{i}", f"1:{s}")
    a, b = leaf(2, "a"), sha(leaf(None, "b"), leaf(1, "b"))
    got = {(r["doc_id"], r["leaf"]): r for r in merkle.manifest(docs, ["doc_id", "source"], altered=F.col("doc_id") == 1, changed={"source": F.lit("c")}).collect()}
    assert {r["root"] for r in got.values()} == {sha(a, b)}
    assert got[2, a]["subroot"] == a and got[2, a]["proof_sha256"] == sha(b) and got[2, a]["verified"]
    changed = got[1, leaf(1, "b")]
    assert changed["proof_sha256"] == sha(leaf(None, "b"), a) and not changed["verified"]
    assert changed["folded_root"] == sha(a, sha(leaf(None, "b"), leaf(1, "c")))


def test_the_rounds_give_the_same_tree_however_leaves_are_dealt(spark):
    """20,000 leaves need four levels; dealt at random nothing closes within a task."""
    from strandline.llm.common import Scratch

    leaves = spark.range(20_000).select(F.lit(0).cast("long").alias("tree"), F.lit(20_000).cast("long").alias("size"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    got = [plain(merkle.build(leaves.repartition(n), Scratch(spark), f"t{n}").where("level >= 1").select("level", "at", "digest").collect()) for n in (1, 9)]
    level = [sha(str(i)) for i in range(20_000)]
    want, k = [], 0
    while len(level) > 1:
        level, k = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)], k + 1
        want += [(k, i, d) for i, d in enumerate(level)]
    assert got[0] == got[1] == plain(want)


def test_empty_table(docs):
    assert merkle.manifest(docs.where("false"), merkle.COLUMNS).count() == 0


def test_query_equals_sql(spark):
    assert of_spark(merkle.op13_merkle(spark, DATA)) == of_duckdb(connect(), merkle.OP13_SQL)

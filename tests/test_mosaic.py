"""Mosaics with hooks, bytes of measured files, grids and weights, and the publisher."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strandline.functions.encoding import int16_bytes, wave_bytes
from strandline.operators import relational as rel
from strandline.operators.mosaic import Layout, stitch
from strandline.sources import readers
from strandline.sources.shared import write_files
from strandline.streaming import windows as st

SCHEMA = "series string, row bigint, col bigint, y bigint, x bigint, v double"


def tiles(spark, n=2, size=3):
    rows = [("m", r, c, y, x, float(100 * r + 10 * c + y + x)) for r in range(n) for c in range(n) for y in range(size) for x in range(size)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(pixels, layout, f=lambda v: v, w=lambda r, c, y, x: 1.0):
    out = {}
    for p in pixels:
        k = (p["row"] * layout.down + p["y"], p["col"] * layout.right + p["x"])
        weight = w(p["row"], p["col"], p["y"], p["x"])
        v, total, n = out.get(k, (0.0, 0.0, 0))
        out[k] = v + f(p["v"]) * weight, total + weight, n + 1
    return out


def test_two_processors_and_masks(spark):
    t, layout = tiles(spark), Layout(3, 3, 2, 2)
    same = lambda d: d
    got = {(r["gy"], r["gx"]): (r["v"], r["n"]) for r in stitch(t, same, lambda d: d.withColumn("v", F.col("v") * 2), layout).collect()}
    assert got == {k: (v, n) for k, (v, _, n) in plain(t.collect(), layout, lambda v: 2 * v).items()}
    inner = F.when((F.col("x") == 0) & (F.col("col") > 0), 0.0).otherwise(1.0)
    got = {(r["gy"], r["gx"]): r["v"] for r in stitch(t, same, same, layout, inner, average=True).collect()}
    want = plain(t.collect(), layout, w=lambda r, c, y, x: 0.0 if x == 0 and c > 0 else 1.0)
    assert got == {k: pytest.approx(v / w if w else 0.0) for k, (v, w, _) in want.items()}


def test_normalised_nulls_and_empty(spark):
    t, layout = tiles(spark, 1), Layout(3, 3, 2, 2)
    same = lambda d: d
    holes = t.withColumn("v", F.when(F.col("x") > 0, F.col("v")))
    got = {(r["gy"], r["gx"]): r["v"] for r in stitch(holes, same, same, layout, normalise=True).collect()}
    assert got == {(y, x): pytest.approx((y + x) / 4) for y in range(3) for x in (1, 2)}
    assert stitch(t.where("false"), same, same, layout).count() == 0
    zero = stitch(t.withColumn("v", F.lit(0.0)), same, same, layout, normalise=True)
    assert {r["v"] for r in zero.collect()} == {0.0}


def test_wrong_schema_and_place_raise(spark):
    t, layout = tiles(spark, 1), Layout(3, 3, 2, 2)
    same = lambda d: d
    for bad in (lambda d: d.drop("y"), lambda d: d.withColumn("v", F.col("v").cast("float")), lambda d: d.withColumn("more", F.lit(1))):
        with pytest.raises(ValueError, match="process gives"):
            stitch(t, same, bad, layout)
        with pytest.raises(ValueError, match="load gives"):
            stitch(t, bad, same, layout)
    with pytest.raises(Exception, match="outside its tile"):
        stitch(t, same, lambda d: d.withColumn("x", F.col("x") + 1), layout).collect()


def test_files_come_back(spark, tmp_path):
    samples = [0, 1, -1, 32767, -32768, 255]
    df = spark.createDataFrame([("a", samples), ("b", [])], "series string, s array<bigint>")
    write_files(df.select(F.concat("series", F.lit(".bin")).alias("name"), int16_bytes(F.col("s")).alias("content")), str(tmp_path / "raw"))
    assert sorted((r["series"], r["i"], r["v"]) for r in readers.raw_int16(spark, str(tmp_path / "raw")).collect()) == [("a", i, float(v)) for i, v in enumerate(samples)]
    sound = df.select(F.concat("series", F.lit(".wav")).alias("name"), wave_bytes(F.col("s"), 2, 44100).alias("content"))
    write_files(sound, "file:" + str(tmp_path / "wav"))
    write_files(sound, "file://" + str(tmp_path / "wav"))
    got = sorted((r["channel"], r["i"], r["v"], r["rate"]) for r in readers.sound(spark, str(tmp_path / "wav")).collect())
    assert got == sorted((i % 2, i // 2, v, 44100) for i, v in enumerate(samples))
    assert sorted(os.listdir(tmp_path / "wav")) == ["a.wav", "b.wav"]


def test_grid_and_weights(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "k string")
    got = sorted((r["set_no"], r["k"], r["p"], r["q"]) for r in rel.parameter_grid(df, "k", p=[1, 2], q=["x", "y", "z"]).collect())
    assert [g[1:] for g in got] == [(k, p, q) for k in "ab" for p in (1, 2) for q in "xyz"] and [g[0] for g in got] == list(range(12))
    cells = spark.createDataFrame([(x, y) for x in range(6) for y in range(4)], "x long, y long")
    w = rel.overlap_weights(cells, "x", "y", 6, 4, 4, 2)
    assert {round(r["sum(weight)"], 9) for r in w.groupBy("x", "y").sum("weight").collect()} == {1.0}
    assert {(r["bx"], r["by_"]) for r in w.collect()} == {(0, 0), (2, 0)}
    with pytest.raises(ValueError):
        rel.overlap_weights(cells, "x", "y", 7, 4, 4, 2)


def test_publisher_sends_once_after_a_failure(spark, tmp_path):
    """The second batch's receiver fails after some rows; the query started again sends the batch under the same keys, and the first batch no more."""
    source, log, inbox, seen = (str(tmp_path / n) for n in ("in", "log", "inbox", "seen"))
    for i in range(3):
        spark.range(i * 100, i * 100 + 100, 1, 2).write.mode("append").parquet(source)
    os.mkdir(seen)
    broken = str(tmp_path / "broken")
    open(broken, "w").close()
    keep = st.Inbox(inbox)

    def send(messages):
        for key, text in messages:
            if os.path.exists(broken) and key.startswith("1-") and json.loads(text)["id"] % 50 == 30:
                raise OSError("the line is down")
            with open(f"{seen}/{key}", "a") as f:
                f.write("x")
            keep([(key, text)])

    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(source)
    with pytest.raises(Exception, match="the line is down"):
        st.publish(stream(), send, log, every=None, rows=7).awaitTermination()
    assert len(os.listdir(inbox)) < 300
    os.remove(broken)
    for _ in range(2):
        st.publish(stream(), send, log, every=None, rows=7).awaitTermination()
        assert sorted(json.loads(open(f"{inbox}/{f}").read())["id"] for f in os.listdir(inbox)) == list(range(300))
    times = {k: os.path.getsize(f"{seen}/{k}") for k in os.listdir(seen)}
    assert len(times) == 300 and {n for k, n in times.items() if not k.startswith("1-")} == {1}

import math
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.operators import relational as rel, segments as seg, series as ser
from strandline.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def series_of(spark, *values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, i long, v double")


def test_single_sample_and_empty_series(spark):
    one = series_of(spark, 5)
    assert ser.moving_average(one, "k", 3).first()["smooth"] == 5
    assert ser.rolling_median(one, "k", 1).first()["median"] == 5
    assert ser.sliding_slope(one, "k", 3, 1).count() == 0
    assert ser.moving_average(one.where("false"), "k", 3).count() == 0


def test_window_longer_than_series_and_flat_values(spark):
    flat = series_of(spark, 2, 2, 2)
    assert {r["smooth"] for r in ser.moving_average(flat, "k", 99).collect()} == {2.0}
    assert not any(r["outlier"] for r in ser.mad_outliers(flat, "k", 3, 3.0).collect())


def test_even_window_divides_by_one_more_at_the_start(spark):
    got = [r["smooth"] for r in ser.moving_average_even(series_of(spark, 1, 2, 3, 4, 5, 6), "k", 4).orderBy("i").collect()]
    assert got[2:5] == [2.5, 3.5, 4.5]


def test_quantile_of_type_eight(spark):
    q = ser.quantile_unbiased(series_of(spark, *[x * x for x in range(10)]).select("k", "v"), ["k"], "v", [0.3]).first()["q"]
    place = (10 + 1 / 3) * 0.3 + 1 / 3
    low = int(place)
    want = (low - 1) ** 2 + (place - low) * (low**2 - (low - 1) ** 2)
    assert abs(q - want) < 1e-9


def test_time_on_a_boundary_belongs_to_the_patch_before(spark):
    trial = spark.createDataFrame([("a", 0.0, 10.0)], "trial string, first double, last double")
    bounds = seg.boundaries(trial, "first", "last").select("trial", "b")
    points = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 2.1), ("a", 10.0)], "trial string, t double")
    assert rows(seg.point_in_patch(points, bounds, ["trial"]).select("t", "patch")) == [(0.0, -1), (2.0, 0), (2.1, 1), (10.0, 4)]


def test_gap_classes_by_exact_value(spark):
    g = spark.createDataFrame([(None,), (0.05,), (0.1,), (0.15,), (0.2,), (0.3,)], "g double")
    assert [r[0] for r in g.select(seg.gap_class(F.col("g"))).collect()] == ["noise", "noGap", "Gap0.1", "Gap0.3", "Gap0.2", "Gap0.3"]


def test_interval_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    points = [("a", float(x)) for x in rng.uniform(0, 50, 200)]
    spans = [("a", float(s), float(s + w)) for s, w in zip(rng.uniform(0, 50, 30), rng.uniform(0, 9, 30))]
    got = rel.interval_join(spark.createDataFrame(points, "k string, t double"), spark.createDataFrame(spans, "k string, s double, e double"), ["k"], "t", "s", "e", 2.0)
    want = sorted((t, s, e) for _, t in points for _, s, e in spans if s < t <= e)
    assert rows(got.select("t", "s", "e")) == want


def test_radius_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-5, 5, (60, 2)), rng.uniform(-5, 5, (60, 2))
    left = spark.createDataFrame([("g", float(x), float(y)) for x, y in a], "g string, tx double, ty double")
    right = spark.createDataFrame([("g", float(x), float(y)) for x, y in b], "g string, sx double, sy double")
    got = rel.radius_join(left, right, ["g"], 1.5).count()
    assert got == int((np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)) <= 1.5).sum())


def test_errors_are_raised(spark):
    left, twice = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(PySparkException):
        rel.lookup(left, twice, ["k"]).collect()
    with pytest.raises(PySparkException):
        rel.sample_per_group(spark.createDataFrame([("a", 1)], "g string, k long"), ["g"], "k", 3, 1).collect()


def test_mode_takes_the_least_of_equals(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("a", 2)], "g string, v int")
    assert rel.mode(df, ["g"], "v").first()["v"] == 1


def test_readers_of_raw_samples_and_sidecars(spark, tmp_path):
    np.arange(-3, 7, dtype="<i2").tofile(tmp_path / "one.bin")
    (tmp_path / "one.txt").write_text("a\nb\nstart: 1.0\nend: 2.0\n")
    signal = readers.trial_signals(readers.raw_int16(spark, str(tmp_path), "*.bin"), readers.sidecar(spark, str(tmp_path)))
    got = rows(signal.select("series", "i", "t", "v"))
    assert got[0] == ("one", 0, 0.0, -3.0) and len(got) == 10 and abs(got[9][2] - 0.9) < 1e-9


def test_reader_of_sound(spark, tmp_path):
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(np.array([[1, 10], [2, 20], [3, 30]], "<i2").tobytes())
    assert rows(readers.sound(spark, str(tmp_path)).select("channel", "i", "v", "rate")) == [(0, 0, 1, 8000), (0, 1, 2, 8000), (0, 2, 3, 8000), (1, 0, 10, 8000), (1, 1, 20, 8000), (1, 2, 30, 8000)]


def test_reader_of_thermal_frames_xml_and_parameters(spark, tmp_path):
    np.arange(12, dtype="<u2").tofile(tmp_path / "t.itv")
    got = rows(readers.thermal(spark, str(tmp_path / "t.itv"), 3, 2).select("frame", "x", "y", "v"))
    assert len(got) == 12 and (1, 2, 1, 11.0) in got
    (tmp_path / "t.xml").write_text("<a><Width>3</Width>\n<Height unit='px'>2</Height></a>")
    assert readers.xml_tags(spark, str(tmp_path / "t.xml"), ["Width", "Height"]).first() == ("3", "2")
    (tmp_path / "p.json").write_text('{"c0": {"magnitude": 5920, "unit": "m/s"}}')
    assert rows(readers.parameters(spark, str(tmp_path / "p.json"))) == [("c0", 5920.0, "m/s")]
    assert readers.two_row_header(["a", "b", "c", "d"], ["x", "", "y", "z"], 2, "end") == ["a_x", "b", "end"]


def test_intervals_that_begin_on_a_sample_equal_the_statement(spark, tmp_path):
    """Samples on whole milliseconds fall on the starts of segments, whose rounding to nine digits may move a last bit."""
    import duckdb

    from strandline.plans import registry
    from tests.oracle import connect, of_duckdb, of_spark

    con = duckdb.connect()
    con.execute("CREATE TABLE e AS SELECT u * 9 + k AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(u * 104729 + k * 21600000) AS ts, u AS user_id, 'a' AS event_type, (u + k) / 4.0::DOUBLE AS value, '' AS props FROM range(300) t(u), range(9) s(k)")
    con.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("j11_interval_extract", "w05_hopping_starts", "j02_point_in_patch", "f08_completeness_gap"):
        assert of_spark(registry.queries()[name](spark, str(tmp_path))) == of_duckdb(connect(str(tmp_path)), registry.oracle_sql()[name]), name


def test_pair_lags_equal_a_plain_loop(spark, monkeypatch):
    """All pairs of a key, across blocks, cells and far ids; a missing value counts as a pair, one that is no number stays so."""
    from strandline.operators import variogram

    monkeypatch.setattr(variogram, "BLOCK", 7)
    rng = np.random.default_rng(9)
    rows = [(k, 999 * i, float(x), float(y), None if i % 11 == 0 else float(v)) for k in (1, 2) for i, (x, y, v) in enumerate(rng.normal(size=(60, 3)) * 0.4)]
    rows += [(3, 1, 0.0, 0.0, float("nan")), (3, 2, 0.01, 0.0, 1.0), (3, 2, 0.3, 0.0, 2.0), (None, 3, 0.0, 0.0, 1.0), (3, 4, None, 0.0, 1.0), (3, 5, float("nan"), 0.0, 1.0)]
    got = {(r["k"], r["bin"]): (r["n"], r["held"], r["total"]) for r in variogram.pair_lags(spark.createDataFrame(rows, "k int, id long, x double, y double, v double"), "k", 0.3, 0.05).collect()}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] is not None and a[0] == b[0] and a[1] != b[1] and None not in (a[2], b[2]) and (d := math.hypot(a[2] - b[2], a[3] - b[3])) <= 0.3:
                n, held, total = want.get((a[0], int(d / 0.05)), (0, 0, 0.0))
                both = None not in (a[4], b[4])
                want[a[0], int(d / 0.05)] = n + 1, held + both, total + ((a[4] - b[4]) ** 2 if both else 0)
    assert got.keys() == want.keys()
    for k, (n, held, total) in want.items():
        assert got[k][:2] == (n, held or None) and got[k][2] == pytest.approx(total, nan_ok=True)


def test_pairs_of_far_ids_count(spark, tmp_path):
    """Ids a thousand and more apart pair, too."""
    from strandline.plans import registry

    spark.createDataFrame([(0, [0.0, 0.0, 1.0], 1), (5000, [0.01, 0.0, 3.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r["n"], r["gamma"]) for r in registry.queries()["j04_pair_lag_variogram"](spark, str(tmp_path)).collect()] == [(1, 2.0)]


def test_delay_and_sum_has_no_rows_for_each_scan(spark):
    """Traces of one place add up before they meet the pixels: what is joined doesn't grow with the scans."""
    from strandline.plans import registry
    from tests.oracle import DATA

    plan = registry.queries()["k24_saft_backproject"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "vec_id" not in below.split("Aggregate")[0] and below.count("Aggregate") >= 2


def test_generators_of_samples_stay_small(spark):
    """Spikes are summed in a customer's row, before rows for each sample are dealt out; a pulse's peak is found once, not for each sample."""
    from strandline.plans import registry
    from tests.oracle import DATA

    plan = lambda name: registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    spikes = plan("s25_sparse_spikes")
    assert "Aggregate" not in spikes[: spikes.index("Generate")] and spikes.count("Aggregate") == 1
    assert "lambda" not in plan("s24_clean_training_data")


def test_spikes_of_a_repeated_id_add_up(spark, tmp_path):
    from strandline.plans import registry
    from tests.oracle import connect, of_duckdb, of_spark

    spark.createDataFrame([(9, 100.0), (9, 50.0), (10, None), (None, 3.0), (64, -20.0), (11, -5.5)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/c")
    connect(f"{tmp_path}").execute(f"COPY (SELECT * FROM '{tmp_path}/c/*.parquet') TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    assert of_spark(registry.queries()["s25_sparse_spikes"](spark, str(tmp_path))) == of_duckdb(connect(str(tmp_path)), registry.oracle_sql()["s25_sparse_spikes"])

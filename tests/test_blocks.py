"""Series in blocks against one run over the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels as k
from strandline.operators import blocks as bl


def frame(spark, series):
    rows = [(key, i, float(x)) for key, v in series.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k long, i long, v double").repartition(5)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    return {n: np.cumsum(rng.normal(size=n)) + 20 for n in (1, 2, 3, 17, 40, 64, 129, 1000)}


def collected(df, series):
    out = {key: np.full(len(v), np.nan) for key, v in series.items()}
    for r in df.collect():
        out[r["k"]][r["i"]] = r["v"]
    return out


@pytest.mark.parametrize("block,fan", [(16, 4), (64, 256), (4096, 256)])
def test_split_filter_equals_one_run(spark, series, monkeypatch, block, fan):
    """Blocks of 16 with a fan of 4 need four levels of the scan for the longest series."""
    monkeypatch.setattr(bl, "FAN", fan)
    got = collected(bl.zero_phase(frame(spark, series), "k", "v", 0.1, block=block), series)
    for n, v in series.items():
        assert np.allclose(got[n], k.zero_phase(v, 0.1), atol=1e-8), n


@pytest.mark.parametrize("block", [8, 100])
def test_smoothing_in_blocks_equals_one_run(spark, series, block):
    weight = np.exp(-0.5 * (np.arange(-15, 16) / 5.0) ** 2)
    longer = {n: v for n, v in series.items() if n >= 31}  # the kernel of one run is no longer than the series
    got = collected(bl.smoothed(frame(spark, longer), "k", "v", weight, block=block), longer)
    for n, v in longer.items():
        assert np.allclose(got[n], k.gaussian_smooth(v, 5.0)), n


def test_transform_equals_the_library_and_comes_back(spark):
    rng = np.random.default_rng(6)
    v = {16: rng.normal(size=16), 256: rng.normal(size=200), 1024: rng.normal(size=1024)}
    df = frame(spark, v).select("k", "i", F.sqrt("k").cast("long").alias("size"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    there = bl.fourier(df, "k", ["re", "im"])
    got = {(r["k"], r["i"]): complex(r["re"], r["im"]) for r in there.collect()}
    for n, x in v.items():
        assert np.allclose([got[n, i] for i in range(n)], np.fft.fft(x, n))
    back = {(r["k"], r["i"]): r["re"] for r in bl.fourier(there, "k", ["re", "im"], inverse=True).collect()}
    assert all(np.isclose(back[n, i], x) for n, own in v.items() for i, x in enumerate(own))


def test_correlation_at_every_lag(spark, series):
    df = frame(spark, series).withColumn("w", F.col("v") * F.col("v") / 10 - F.col("i"))
    got = {(r["k"], r["lag"]): r["c"] for r in bl.correlation(df, "k", "v", "w").collect()}
    for n, v in series.items():
        want = np.correlate(v, v * v / 10 - np.arange(n), "full")
        assert np.allclose([got[n, lag] for lag in range(1 - n, n)], want, rtol=1e-9, atol=1e-6)
    assert len(got) == sum(2 * n - 1 for n in series)


def test_best_lag_takes_the_first_of_equal_peaks(spark):
    df = spark.createDataFrame([(1, i, float(i % 4 == 0), float(i % 4 == 1)) for i in range(64)], "k long, i long, v double, w double")
    got = bl.best_lag(df, "k", "v", "w", F.lit(-20), F.lit(20)).first()
    c = {lag: sum(1 for i in range(64) if i % 4 == 1 and 0 <= i + lag < 64 and (i + lag) % 4 == 0) for lag in range(-20, 21)}
    assert (got["lag"], got["c"]) == (min(x for x in c if c[x] == max(c.values())), max(c.values()))


def test_analytic_signal_equals_one_run(spark, series):
    """Even and odd lengths, one sample included; rows through the transform stay linear in the series."""
    found = bl.analytic(frame(spark, series), "k", "v").collect()
    assert len(found) == sum(map(len, series.values()))
    got = {(r["k"], r["i"]): complex(r["re"], r["im"]) for r in found}
    for n, v in series.items():
        assert np.allclose([got[n, i] for i in range(n)], k.analytic(v), atol=1e-8), n


def test_band_envelope_equals_one_run(spark, series):
    got = collected(bl.band_envelope(frame(spark, series), "k", "v", 0.2, 5), series)
    for n, v in series.items():
        whole = np.abs(k.analytic(k.zero_phase(v - v.mean(), 0.2)))
        want = np.convolve(np.pad(whole, 2), np.ones(5) / 5, "valid")
        assert np.allclose(got[n], want, atol=1e-8), n


def test_envelope_of_no_rows(spark):
    none = spark.createDataFrame([], "k long, i long, v double")
    assert bl.envelope(none, "k", "v").count() == 0


def test_filter_has_no_union_and_the_chain_reads_it_once(spark, series, monkeypatch):
    """Unions of reads of one table met joins with partitions of another number; an own table between the filter and the envelope cuts the plan."""
    kept = []
    keep = bl.Steps.keep
    monkeypatch.setattr(bl.Steps, "keep", lambda self, df, name: kept.append((name, df)) or keep(self, df, name))
    low = bl.zero_phase(frame(spark, series), "k", "v", 0.2)
    bl.band_envelope(frame(spark, series), "k", "v", 0.2, 5)
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (low, *[d for _, d in kept])]
    assert "low" in [name for name, _ in kept] and not any("Union" in p for p in plans)


def test_no_join_meets_samples_unpacked_from_transforms(spark, series, tmp_path):
    """Spark takes them for a few rows and would broadcast them all. In a plan's text, what comes last stands first."""
    frame(spark, series).withColumn("w", F.col("v") + 1).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    for found in (bl.envelope(df, "k", "v"), bl.correlation(df, "k", "v", "w"), bl.band_envelope(df, "k", "v", 0.2, 5)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" in plan and "Join" not in plan[: plan.index("collect_list")]

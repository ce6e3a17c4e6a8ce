"""Queries on series: each user of events is a signal."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandline.operators import blocks, series as ser
from strandline.plans.registry import S, T, query, series, traces

R = lambda c, n=6: F.round(c, n).alias(c if isinstance(c, str) else "x")


@query("w01_moving_average_edge", f"WITH {S} SELECT user_id, i, round(avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM s")
def moving_average(spark, d):
    return ser.moving_average(series(spark, d), "user_id", 7).select("user_id", "i", R("smooth"))


@query("w01_moving_average_even", f"""WITH {S}, w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS total FROM s)
 SELECT user_id, i, round(total / (least(i, 4) + least(n - i, 4) + CASE WHEN i < 4 THEN 1 ELSE 0 END), 6) AS smooth FROM w""")
def moving_average_even(spark, d):
    return ser.moving_average_even(series(spark, d), "user_id", 8).select("user_id", "i", R("smooth"))


@query("w02_rolling_mad_outlier", f"""WITH {S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id),
 r AS (SELECT user_id, i, v FROM s UNION ALL SELECT user_id, -1 - i, v FROM s WHERE i < 3 UNION ALL SELECT user_id, 2 * n - 1 - i, v FROM s JOIN n USING (user_id) WHERE i >= n - 3),
 m AS (SELECT user_id, i, v, median(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS median FROM r),
 d AS (SELECT m.*, abs(v - median) AS dev FROM m JOIN n USING (user_id) WHERE i BETWEEN 0 AND n - 1),
 r2 AS (SELECT user_id, i, dev FROM d UNION ALL SELECT user_id, -1 - i, dev FROM d WHERE i < 3 UNION ALL SELECT user_id, 2 * n - 1 - i, dev FROM d JOIN n USING (user_id) WHERE i >= n - 3),
 q AS (SELECT user_id, i, median(dev) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mad FROM r2)
 SELECT user_id, i, round(median, 6) AS median, round(mad, 6) AS mad, dev > 3 * mad AS outlier FROM d JOIN q USING (user_id, i)""")
def mad_outlier(spark, d):
    return ser.mad_outliers(series(spark, d).select("user_id", "i", "v"), "user_id", 7, 3.0).select("user_id", "i", R("median"), R("mad"), "outlier")


@query("w03_cumtrapz", f"""WITH {S}, d AS (SELECT user_id, i, coalesce((v + lag(v) OVER (PARTITION BY user_id ORDER BY i)) / 2, 0) AS st FROM s)
 SELECT user_id, i, round(sum(st) OVER (PARTITION BY user_id ORDER BY i), 4) AS integral FROM d""")
def cumtrapz(spark, d):
    return ser.cumulative_trapezoid(series(spark, d), "user_id").select("user_id", "i", R("integral", 4))


@query("w04_random_walk_path", f"""WITH {S}, d AS (SELECT user_id, i, CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN -1 ELSE 0 END AS dx, CASE WHEN event_id % 4 = 2 THEN 1 WHEN event_id % 4 = 3 THEN -1 ELSE 0 END AS dy FROM s)
 SELECT user_id, i, sum(dx) OVER w::BIGINT AS x, sum(dy) OVER w::BIGINT AS y FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def random_walk(spark, d):
    turn = F.col("event_id") % 4
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = series(spark, d).withColumn("dx", F.when(turn == 0, 1).when(turn == 1, -1).otherwise(0)).withColumn("dy", F.when(turn == 2, 1).when(turn == 3, -1).otherwise(0))
    return s.select("user_id", "i", F.sum("dx").over(w).alias("x"), F.sum("dy").over(w).alias("y"))


@query("a30_walk_coverage", f"""WITH {S}, d AS (SELECT user_id, i, CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN -1 ELSE 0 END AS dx, CASE WHEN event_id % 4 = 2 THEN 1 WHEN event_id % 4 = 3 THEN -1 ELSE 0 END AS dy FROM s),
 p AS (SELECT user_id, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i)), q AS (SELECT DISTINCT * FROM p WHERE x BETWEEN -5 AND 4 AND y BETWEEN -5 AND 4)
 SELECT user_id, round(count(*) / 100.0, 6) AS coverage FROM q GROUP BY user_id""")
def walk_coverage(spark, d):
    inside = random_walk(spark, d).where("x between -5 and 4 and y between -5 and 4").select("user_id", "x", "y").distinct()
    return inside.groupBy("user_id").agg(F.round(F.count("*") / 100.0, 6).alias("coverage"))


@query("w08_sliding_slope", f"""WITH {S}, w AS (SELECT user_id, i, count(*) OVER f AS n, regr_slope(v, i::DOUBLE) OVER f AS slope FROM s WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
 SELECT user_id, i, round(slope, 6) AS slope FROM w WHERE n = 10 AND i % 5 = 0""")
def sliding_slope(spark, d):
    return ser.sliding_slope(series(spark, d), "user_id", 10, 5).select("user_id", "i", R("slope"))


@query("k40_knee", f"""WITH {S}, w AS (SELECT user_id, i, count(*) OVER f AS n, round(regr_slope(v, i::DOUBLE) OVER f, 6) AS slope FROM s WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
 g AS (SELECT *, avg(slope) OVER (PARTITION BY user_id) AS m FROM w WHERE n = 10 AND i % 5 = 0) SELECT user_id, min(i) AS knee FROM g WHERE slope > m GROUP BY user_id""")
def knee(spark, d):
    return ser.first_slope_above_mean(sliding_slope(spark, d), "user_id", "slope")


@query("w07_frames", f"""WITH {S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), f AS (SELECT user_id, unnest(range((n - 16) // 8 + 1)) AS frame FROM n WHERE n >= 16)
 SELECT f.user_id, frame, i - frame * 8 AS n_in, round(v, 6) AS v FROM f JOIN s ON s.user_id = f.user_id AND i >= frame * 8 AND i < frame * 8 + 16""")
def framed(spark, d):
    return ser.frames(series(spark, d), "user_id", 16, 8).select("user_id", "frame", "n_in", R("v"))


@query("k04_stft", f"""WITH {S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), f AS (SELECT user_id, unnest(range((n - 16) // 8 + 1)) AS frame FROM n WHERE n >= 16),
 x AS (SELECT f.user_id, frame, i - frame * 8 AS m, v * (0.5 - 0.5 * cos((i - frame * 8) * 2 * pi() / 16)) AS v FROM f JOIN s ON s.user_id = f.user_id AND i >= frame * 8 AND i < frame * 8 + 16)
 SELECT user_id, frame, k::INT AS k, round(sqrt(pow(sum(v * cos(k * m * -2 * pi() / 16)), 2) + pow(sum(v * sin(k * m * -2 * pi() / 16)), 2)), 4) AS power FROM x, (SELECT unnest(range(5)) AS k) GROUP BY ALL""")
def stft(spark, d):
    f = ser.dft(ser.frames(series(spark, d), "user_id", 16, 8), ["user_id", "frame"], "n_in", 16, [0, 1, 2, 3, 4], window=True)
    return f.select("user_id", "frame", "k", F.round(F.hypot("re", "im"), 4).alias("power"))


@query("k03_dft_band_power", f"""WITH {T} SELECT vec_id, k::INT AS k, round(pow(sum(v * cos(k * z * -2 * pi() / 64)), 2) + pow(sum(v * sin(k * z * -2 * pi() / 64)), 2), 6) AS power FROM tr, (SELECT unnest([3, 4, 5]) AS k) GROUP BY ALL""")
def dft_band(spark, d):
    f = ser.dft(traces(spark, d), ["vec_id"], "z", 64, [3, 4, 5])
    return f.select("vec_id", "k", F.round(F.pow("re", F.lit(2)) + F.pow("im", F.lit(2)), 6).alias("power"))


@query("k37_phase_bin1", f"""WITH {T} SELECT vec_id, round(atan2(sum(v * (0.5 - 0.5 * cos(z * 2 * pi() / 64)) * sin(z * -2 * pi() / 64)), sum(v * (0.5 - 0.5 * cos(z * 2 * pi() / 64)) * cos(z * -2 * pi() / 64))), 5) AS phase FROM tr GROUP BY vec_id""")
def phase(spark, d):
    return ser.dft(traces(spark, d), ["vec_id"], "z", 64, [1], window=True).select("vec_id", F.round(F.atan2("im", "re"), 5).alias("phase"))


@query("w13_unwrap", f"""WITH {S}, p AS (SELECT user_id, i, (i * 2.0 + v / 1000) % 6.0 - 3.0 AS phase FROM s), j AS (SELECT *, coalesce(phase - lag(phase) OVER (PARTITION BY user_id ORDER BY i), 0) AS jump FROM p)
 SELECT user_id, i, round(phase - 2 * pi() * sum(round(jump / (2 * pi()))) OVER (PARTITION BY user_id ORDER BY i), 6) AS unwrapped FROM j""")
def unwrapped(spark, d):
    s = series(spark, d).withColumn("phase", (F.col("i") * 2.0 + F.col("v") / 1000) % 6.0 - 3.0)
    return ser.unwrap(s, "user_id", "phase", "i").select("user_id", "i", R("unwrapped"))


@query("a24_quantile_type8", f"""WITH {S}, r AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM s),
 h AS (SELECT r.*, p, least(greatest((n + 1.0::DOUBLE / 3) * p + 1.0::DOUBLE / 3, 1.0), n) AS h FROM r, (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS p))
 SELECT user_id, p, round(sum(CASE WHEN r = floor(h) THEN (1 - (h - floor(h))) * v WHEN r = floor(h) + 1 THEN (h - floor(h)) * v END), 6) AS q FROM h GROUP BY user_id, p""")
def quantiles(spark, d):
    return ser.quantile_unbiased(series(spark, d).select("user_id", "v", "event_id"), ["user_id"], "v", [0.1, 0.5, 0.9]).select("user_id", "p", R("q"))


@query("k11_xcorr_delay", f"""WITH {S}, c AS (SELECT b.user_id, a.i - b.i AS lag, sum(a.v * b.w) AS c FROM s a JOIN (SELECT user_id, i, v - 50 AS w, count(*) OVER (PARTITION BY user_id) AS n FROM s) b ON a.user_id = b.user_id AND a.i - b.i BETWEEN least(1 - n // 2, n // 2) AND n // 2 GROUP BY ALL)
 SELECT user_id, arg_min(lag, (-round(c, 4), lag))::INT AS lag, round(max(c), 4) AS peak FROM c GROUP BY user_id""")
def xcorr(spark, d):
    """The lag of largest correlation among all from 1 - n / 2 to n / 2, n being the length of the series: spectra by blocks, then the near best anew."""
    half = F.floor(F.col("n") / 2).cast("long")
    c = blocks.best_lag(series(spark, d).withColumn("w", F.col("v") - 50), "user_id", "v", "w", F.least(1 - half, half), half)
    return c.select("user_id", F.col("lag").cast("int").alias("lag"), F.col("c").alias("peak"))


@query("k09_linear_resample", f"""WITH {S}, p AS (SELECT user_id, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 g AS (SELECT *, unnest(range(ceil(t / 43200)::BIGINT, ceil(t1 / 43200)::BIGINT)) AS m FROM p WHERE t1 > t)
 SELECT user_id, m, round(v + (v1 - v) * (m * 43200.0 - t) / (t1 - t), 5) AS v FROM g""")
def resampled(spark, d):
    return ser.resample_linear(series(spark, d), "user_id", "t", "v", 43_200.0).select("user_id", "m", R("v", 5))


@query("k50_convolution", f"""WITH {T} SELECT vec_id, z + m AS z, round(sum(v * h), 6) AS y FROM tr, (SELECT unnest([0, 1, 2]) AS m, unnest([0.25, 0.5, 0.25]) AS h) WHERE z + m < 64 GROUP BY ALL""")
def convolution(spark, d):
    return ser.convolve(traces(spark, d), ["vec_id"], "z", "v", [0.25, 0.5, 0.25], 64).select("vec_id", F.col("z").cast("long").alias("z"), R("y"))


@query("a28_regression_line", f"WITH {S} SELECT user_id, round(regr_slope(v, i::DOUBLE), 6) AS slope, round(regr_intercept(v, i::DOUBLE), 6) AS intercept FROM s GROUP BY user_id")
def line(spark, d):
    x = F.col("i").cast("double")
    return series(spark, d).groupBy("user_id").agg(F.round(F.regr_slope("v", x), 6).alias("slope"), F.round(F.regr_intercept("v", x), 6).alias("intercept"))


@query("a23_chunk_mean", f"WITH {S} SELECT user_id, i // 8 AS chunk, round(avg(v), 6) AS mean FROM s GROUP BY ALL")
def chunk_mean(spark, d):
    return series(spark, d).groupBy("user_id", F.floor(F.col("i") / 8).alias("chunk")).agg(F.round(F.avg("v"), 6).alias("mean"))


@query("p12_decimate", f"WITH {S} SELECT user_id, i, v FROM s WHERE i % 10 = 0")
def decimate(spark, d):
    return series(spark, d).where(F.col("i") % 10 == 0).select("user_id", "i", "v")


@query("p13_quantile_gate", f"WITH {S}, q AS (SELECT user_id, quantile_cont(abs(v), 0.9) AS q FROM s GROUP BY user_id) SELECT user_id, i, CASE WHEN abs(v) <= q THEN 0.0 ELSE v END AS v FROM s JOIN q USING (user_id)")
def gate(spark, d):
    s = series(spark, d)
    q = s.groupBy("user_id").agg(F.percentile(F.abs("v"), F.lit(0.9)).alias("q"))
    return s.join(q, "user_id").select("user_id", "i", F.when(F.abs("v") <= F.col("q"), 0.0).otherwise(F.col("v")).alias("v"))


@query("p14_time_range", f"WITH {S} SELECT user_id, i, v FROM s WHERE i >= 5 AND i < 15")
def time_range(spark, d):
    return series(spark, d).where("i >= 5 and i < 15").select("user_id", "i", "v")


@query("a14_snr_db", f"""WITH {S}, m AS (SELECT user_id, v, avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a FROM s)
 SELECT user_id, round(10 * log10(sum(a * a) / sum((v - a) * (v - a))), 5) AS snr FROM m GROUP BY user_id""")
def snr(spark, d):
    m = ser.moving_average(series(spark, d), "user_id", 7, to="a")
    return m.groupBy("user_id").agg(F.round(10 * F.log10(F.sum(F.col("a") * F.col("a")) / F.sum(F.pow(F.col("v") - F.col("a"), 2))), 5).alias("snr"))


@query("f26_peak_normalise", f"WITH {S} SELECT user_id, i, round(v / max(abs(v)) OVER p, 6) AS peak, round((v - avg(v) OVER p) / stddev_pop(v) OVER p, 5) AS standard FROM s WINDOW p AS (PARTITION BY user_id)")
def normalise(spark, d):
    p = Window.partitionBy("user_id")
    return series(spark, d).select("user_id", "i", F.round(F.col("v") / F.max(F.abs("v")).over(p), 6).alias("peak"), F.round((F.col("v") - F.avg("v").over(p)) / F.stddev_pop("v").over(p), 5).alias("standard"))


@query("a18_descriptive", f"WITH {S} SELECT user_id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS sd_pop, round(stddev_samp(v), 6) AS sd_samp FROM s GROUP BY user_id")
def descriptive(spark, d):
    return series(spark, d).groupBy("user_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"), F.round(F.stddev_pop("v"), 6).alias("sd_pop"), F.round(F.stddev_samp("v"), 6).alias("sd_samp"))


@query("k12_variogram_lags", f"WITH {S} SELECT a.user_id, b.i - a.i AS lag, count(*) AS n, floor(sum(round((a.v - b.v) * (a.v - b.v) * 10000)::BIGINT) / (2e4 * count(*)) * 1e6 + 0.5) / 1e6 AS gamma FROM s a JOIN s b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND 5 GROUP BY ALL")
def variogram(spark, d):
    s = series(spark, d).select("user_id", "i", "v")
    ahead = s.select("user_id", "i", F.col("v").alias("w")).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("user_id", (F.col("i") - F.col("lag")).alias("i"), "w", F.col("lag").cast("long").alias("lag"))
    return s.join(ahead, ["user_id", "i"]).groupBy("user_id", "lag").agg(F.count("*").alias("n"), (F.floor(F.sum(F.round(F.pow(F.col("v") - F.col("w"), 2) * 10000).cast("long")) / (2e4 * F.count("*")) * 1e6 + 0.5) / 1e6).alias("gamma"))


@query("w15_peak_per_trace", f"WITH {T} SELECT vec_id, arg_min(z, (-abs(v), z))::INT AS z, round(max(abs(v)), 6) AS peak FROM tr GROUP BY vec_id")
def peak(spark, d):
    return traces(spark, d).groupBy("vec_id").agg(F.min_by("z", F.struct(-F.abs("v"), F.col("z"))).alias("z"), F.round(F.max(F.abs("v")), 6).alias("peak"))


@query("w16_windowed_argmax", f"WITH {T} SELECT vec_id, arg_min(z, (-v, z))::INT AS z FROM tr WHERE z BETWEEN 16 AND 47 GROUP BY vec_id")
def windowed_argmax(spark, d):
    return traces(spark, d).where("z between 16 and 47").groupBy("vec_id").agg(F.min_by("z", F.struct(-F.col("v"), F.col("z"))).alias("z"))


@query("p11_band_selection", f"""WITH {T} SELECT vec_id, round(sum(p), 6) AS band FROM (SELECT vec_id, k, pow(sum(v * cos(k * z * -2 * pi() / 64)), 2) + pow(sum(v * sin(k * z * -2 * pi() / 64)), 2) AS p FROM tr, (SELECT unnest(range(8, 12)) AS k) GROUP BY ALL) GROUP BY vec_id""")
def band(spark, d):
    f = ser.dft(traces(spark, d), ["vec_id"], "z", 64, [8, 9, 10, 11])
    return f.groupBy("vec_id").agg(F.round(F.sum(F.pow("re", F.lit(2)) + F.pow("im", F.lit(2))), 6).alias("band"))


@query("k06_mdct_frame", f"""WITH {T} SELECT vec_id, k::INT AS k, round(sum(v * sin((z + 0.5) * pi() / 64) * cos(pi() / 32 * (z + 0.5 + 16) * (k + 0.5))), 6) AS c FROM tr, (SELECT unnest(range(32)) AS k) GROUP BY ALL""")
def mdct(spark, d):
    pi = 3.141592653589793
    t = traces(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31))))
    x = F.col("v") * F.sin((F.col("z") + 0.5) * (pi / 64)) * F.cos(pi / 32 * (F.col("z") + 16.5) * (F.col("k") + 0.5))
    return t.groupBy("vec_id", "k").agg(F.round(F.sum(x), 6).alias("c"))

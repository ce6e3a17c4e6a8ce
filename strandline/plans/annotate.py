"""Queries on trials and segments: each user of events is a trial."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import relational as rel, segments as seg
from strandline.plans.registry import S, query, series, table

LENGTH, STEP = 86_400.0, 43_200.0

TRIALS = S + ", trials AS (SELECT user_id, round(min(t), 3) AS a, round(max(t), 3) AS b FROM s GROUP BY user_id)"
BOUNDS = TRIALS + ", bounds AS (SELECT user_id, k, round(a + k * (b - a) / 5, 9) AS b FROM trials, (SELECT unnest(range(6)) AS k))"
STARTS = """, starts AS (SELECT user_id, seg AS segment, round(a + seg * 43200.0, 9) AS t FROM
  (SELECT user_id, a, unnest(range(floor((b - a - 86400.0 + 1e-9) / 43200.0)::BIGINT + 1)) AS seg FROM trials WHERE b - a >= 86400.0))"""
PATCHED = STARTS + """, patched AS (SELECT st.user_id, segment, t, (SELECT count(*) FROM bounds b WHERE b.user_id = st.user_id AND b.b < t) - 1 AS patch FROM starts st)"""
FULL = PATCHED + """, whole AS (SELECT p.*, CASE WHEN t + 86400.0 <= n.b THEN 1.0 ELSE round((n.b - t) / 86400.0, 9) END AS share
  FROM patched p JOIN bounds n ON n.user_id = p.user_id AND n.k = greatest(p.patch, 0) + 1),
 gapped AS (SELECT *, round(CASE WHEN patch >= 4 THEN share * 0.3 ELSE share * [0.1,0.1,0.2,0.2,0.3][(greatest(patch, 0) + 1)::INT] + (1 - share) * [0.1,0.1,0.2,0.2,0.3][(least(greatest(patch, 0) + 2, 5))::INT] END, 9) AS gap FROM whole),
 classed AS (SELECT *, CASE WHEN gap < 0.1 THEN 'noGap' WHEN gap = 0.1 THEN 'Gap0.1' WHEN gap = 0.2 THEN 'Gap0.2' ELSE 'Gap0.3' END AS class FROM gapped)"""


def trials(spark, d):
    return series(spark, d).groupBy("user_id").agg(F.round(F.min("t"), 3).alias("a"), F.round(F.max("t"), 3).alias("b"))


def annotated(spark, d):
    """Segments with patch, completeness, gap and class. A start on the first boundary counts as patch 0."""
    tr = trials(spark, d)
    bounds = seg.boundaries(tr, "a", "b").select("user_id", "k", F.col("b").alias("b"))
    starts = seg.starts(tr, "a", "b", LENGTH, STEP).select("user_id", "segment", "t")
    placed = seg.point_in_patch(starts, bounds, ["user_id"])
    at = F.greatest("patch", F.lit(0))
    ends = bounds.select("user_id", (F.col("k") - 1).alias("__p"), F.col("b").alias("__end"))
    joined = placed.withColumn("__p", at).join(ends, ["user_id", "__p"])
    whole = joined.withColumn("share", seg.completeness(F.col("t"), F.col("__end"), LENGTH)).withColumn("gap", seg.gap(F.greatest("patch", F.lit(0)), F.col("share")))
    return whole.withColumn("class", seg.gap_class(F.col("gap")))


@query("w06_patch_boundaries", f"WITH {BOUNDS} SELECT user_id, k::BIGINT AS k, round(b, 3) AS b FROM bounds")
def boundaries(spark, d):
    return seg.boundaries(trials(spark, d), "a", "b").select("user_id", F.col("k").cast("long").alias("k"), F.round("b", 3).alias("b"))


@query("w05_hopping_starts", f"WITH {TRIALS}{STARTS} SELECT user_id, segment, t FROM starts")
def hopping(spark, d):
    return seg.starts(trials(spark, d), "a", "b", LENGTH, STEP).select("user_id", "segment", "t")


@query("j02_point_in_patch", f"WITH {BOUNDS}{PATCHED} SELECT user_id, segment, patch::BIGINT AS patch FROM patched")
def in_patch(spark, d):
    return annotated(spark, d).select("user_id", "segment", F.col("patch").cast("long").alias("patch"))


@query("f08_completeness_gap", f"WITH {BOUNDS}{FULL} SELECT user_id, segment, round(share, 6) AS share, round(gap, 6) AS gap, class FROM classed")
def completeness(spark, d):
    return annotated(spark, d).select("user_id", "segment", F.round("share", 6).alias("share"), F.round("gap", 6).alias("gap"), "class")


@query("segment_annotation", f"WITH {BOUNDS}{FULL} SELECT class, count(*) AS n, sum(CASE WHEN share = 1 THEN 1 ELSE 0 END)::BIGINT AS n_whole FROM classed GROUP BY class")
def segment_annotation(spark, d):
    return annotated(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("share") == 1).alias("n_whole"))


@query("j11_interval_extract", f"WITH {TRIALS}{STARTS} SELECT st.user_id, segment, count(*) AS n, round(sum(v), 4) AS total FROM starts st JOIN s ON s.user_id = st.user_id AND st.t < s.t AND s.t <= st.t + 86400.0 GROUP BY ALL")
def interval_extract(spark, d):
    starts = seg.starts(trials(spark, d), "a", "b", LENGTH, STEP).select("user_id", "segment", F.col("t").alias("t0"), (F.col("t") + LENGTH).alias("t1"))
    points = series(spark, d).select("user_id", "t", "v")
    return rel.interval_join(points, starts, ["user_id"], "t", "t0", "t1", LENGTH).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("j03_nearest_bin", """SELECT event_id, CASE WHEN value / 100 < e THEN k ELSE k + 1 END AS bin FROM
 (SELECT event_id, value, arg_min(k, (abs(value / 100 - e), k)) AS k, arg_min(e, (abs(value / 100 - e), k)) AS e FROM events, (VALUES (0, 0.5), (1, 1.5), (2, 2.5), (3, 4.0)) AS b(k, e) GROUP BY event_id, value)""")
def nearest_bin(spark, d):
    return table(spark, d, "events").select("event_id", seg.nearest_bin(F.col("value") / 100, [0.5, 1.5, 2.5, 4.0]).alias("bin"))


@query("a05_class_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def class_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


H = "((event_id * 1103515245 + {}) % 2147483648)"


@query("o05_sample_per_group", f"SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {H.format(7)}, event_id) AS r FROM events) WHERE r <= 20")
def sample_per_group(spark, d):
    return rel.sample_per_group(table(spark, d, "events"), ["event_type"], "event_id", 20, 7).select("event_type", "event_id")


@query("o06_balanced_class_sample", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {H.format(7)}, event_id) AS r FROM events),
 b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {H.format(99)}, event_id) AS q FROM a WHERE r <= 2) SELECT event_type, user_id, event_id FROM b WHERE q <= 50""")
def balanced_sample(spark, d):
    picks = rel.rank_within(table(spark, d, "events"), ["user_id", "event_type"], [rel.portable_hash("event_id", 7), F.col("event_id")], 2)
    return rel.rank_within(picks, ["event_type"], [rel.portable_hash("event_id", 99), F.col("event_id")], 50).select("event_type", "user_id", "event_id")


@query("o08_trial_split", """WITH t AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY (user_id * 1103515245 + 5) % 2147483648, user_id) AS r, count(*) OVER () AS n FROM t)
 SELECT event_id, CASE WHEN r <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM events JOIN r USING (user_id)""")
def trial_split(spark, d):
    return rel.split_by_trial(table(spark, d, "events"), "user_id", 0.2, 5).select("event_id", "part")


@query("o09_row_split", """SELECT event_id, CASE WHEN r <= floor(n * 0.25) THEN 'test' ELSE 'train' END AS part FROM
 (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)""")
def row_split(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type")
    e = table(spark, d, "events").withColumn("r", F.row_number().over(w.orderBy("event_id"))).withColumn("n", F.count("*").over(w))
    return e.select("event_id", F.when(F.col("r") <= F.floor(F.col("n") * 0.25), "test").otherwise("train").alias("part"))


@query("o10_priority_resample", f"""WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id), p AS (SELECT e.*, (value >= 1.5 * m)::INT AS hot FROM events e JOIN m USING (user_id))
 SELECT user_id, event_id, hot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hot DESC, {H.format(3)}, event_id) AS r FROM p) WHERE r <= 10""")
def priority_resample(spark, d):
    e = table(spark, d, "events")
    hot = e.join(e.groupBy("user_id").agg(F.avg("value").alias("m")), "user_id").withColumn("hot", (F.col("value") >= 1.5 * F.col("m")).cast("int"))
    return rel.rank_within(hot, ["user_id"], [F.col("hot").desc(), rel.portable_hash("event_id", 3), F.col("event_id")], 10).select("user_id", "event_id", "hot")

"""Queries on class labels, regions and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import classes, regions, relational as rel, segments as seg
from strandline.plans.annotate import LENGTH, STEP, trials
from strandline.plans.registry import S, query, table

LOW, HIGH = float("-inf"), float("inf")
#: Classes of the gap in mm (fixed values of the data model): equality names 0.1 and 0.2, all else is the widest.
SCHEMES = [
    ("multi", 0, "noGap", LOW, False, 0.1, False),
    ("multi", 1, "Gap0.1", 0.1, True, 0.1, True),
    ("multi", 2, "Gap0.2", 0.2, True, 0.2, True),
    ("multi", 3, "Gap0.3", 0.1, False, 0.2, False),
    ("multi", 3, "Gap0.3", 0.2, False, HIGH, False),
    ("binary", 0, "noGap", LOW, False, 0.1, False),
    ("binary", 1, "Gap", 0.1, True, HIGH, False),
]

TAIL = 3 * LENGTH
#: Segments from the first boundary until three lengths after the last; those that begin after it are noise.
LABELLED = S + """, tr AS (SELECT user_id, round(min(t), 3) AS a, round(max(t), 3) AS b FROM s GROUP BY user_id),
 bounds AS (SELECT user_id, a, b, [round(a + k * (b - a) / 5, 9) FOR k IN range(6)] AS e FROM tr),
 st AS (SELECT *, round(a + segment * 43200.0, 9) AS t FROM (SELECT *, unnest(range(floor((b + 259200.0 - a - 86400.0 + 1e-9) / 43200.0)::BIGINT + 1)) AS segment FROM bounds)),
 pt AS (SELECT *, greatest(0, len([1 FOR q IN e IF q < t]) - 1) AS p FROM st),
 sh AS (SELECT *, CASE WHEN t > e[6] THEN NULL WHEN t + 86400.0 <= e[p + 2] THEN 1.0 ELSE round((e[p + 2] - t) / 86400.0, 9) END AS share FROM pt),
 gp AS (SELECT *, round(CASE WHEN p >= 4 THEN share * 0.3 ELSE share * [0.1,0.1,0.2,0.2,0.3][p + 1] + (1 - share) * [0.1,0.1,0.2,0.2,0.3][p + 2] END, 9) AS gap FROM sh)"""


def with_noise(spark, d):
    """Segments with patch and gap, those after the last boundary as patch N without a gap."""
    tr = trials(spark, d).withColumn("end", F.col("b") + TAIL)
    bounds = seg.boundaries(tr, "a", "b").groupBy("user_id").agg(F.array_sort(F.collect_list("b")).alias("e"))
    starts = seg.starts(tr, "a", "end", LENGTH, STEP).select("user_id", "segment", "t").join(bounds, "user_id")
    p = F.greatest(F.lit(0), F.size(F.filter("e", lambda b: b < F.col("t"))) - 1)
    placed = starts.withColumn("p", p).withColumn("noise", F.col("t") > F.element_at("e", 6))
    share = seg.completeness(F.col("t"), F.get("e", F.col("p") + 1), LENGTH)
    gap = F.when(F.col("noise"), F.lit(float("nan"))).otherwise(seg.gap(F.col("p"), share))
    return placed.select("user_id", "segment", F.when(F.col("noise"), "N").otherwise(F.concat(F.lit("P"), F.col("p") + 1)).alias("patch"), gap.alias("gap"))


@query("f09_multi_labels", f"""WITH {LABELLED}, named AS (SELECT *, CASE WHEN gap IS NULL THEN 'noise' WHEN gap < 0.1 THEN 'noGap' WHEN gap = 0.1 THEN 'Gap0.1' WHEN gap = 0.2 THEN 'Gap0.2' ELSE 'Gap0.3' END AS multi,
  CASE WHEN gap IS NULL THEN 'noise' WHEN gap < 0.1 THEN 'noGap' ELSE 'Gap' END AS bin FROM gp)
 SELECT user_id, segment, CASE WHEN gap IS NULL THEN 'N' ELSE 'P' || (p + 1) END AS patch, 'multi' AS scheme, list_position(['noGap', 'Gap0.1', 'Gap0.2', 'Gap0.3', 'noise'], multi)::INT - 1 AS class_id, multi AS class FROM named
 UNION ALL SELECT user_id, segment, CASE WHEN gap IS NULL THEN 'N' ELSE 'P' || (p + 1) END, 'binary', list_position(['noGap', 'Gap', 'noise'], bin)::INT - 1, bin FROM named""")
def multi_labels(spark, d):
    """Each segment's class by every scheme of a table of bins, noise included."""
    bins = spark.createDataFrame(SCHEMES, f"scheme string, class_id int, class string, {classes.BIN}")
    schemes = bins.select("scheme").distinct()
    every = with_noise(spark, d).withColumn("scheme", F.explode(F.array(*[F.lit(s) for s in ("multi", "binary")]))).join(F.broadcast(schemes), "scheme")
    return classes.classify(every, bins, ["scheme"], "gap").select("user_id", "segment", "patch", "scheme", "class_id", "class")


EDGES = "SELECT event_type, k, floor((lo + (hi - lo) * k * k / 64) * 100) / 100 AS e FROM (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type), (SELECT unnest(range(1, 9)) AS k)"


@query("f09_binned_classes", f"""WITH edges AS ({EDGES}), m AS (SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 17 = 1 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events),
 n AS (SELECT event_id, m.event_type, v, count(e) FILTER (e <= v) AS below FROM m JOIN edges ON edges.event_type = m.event_type GROUP BY ALL)
 SELECT event_id, event_type, CASE WHEN v IS NULL OR isnan(v) THEN 8 WHEN below < 8 THEN below END::INT AS class_id,
  CASE WHEN v IS NULL OR isnan(v) THEN 'noise' WHEN below < 8 THEN '[' || coalesce((SELECT printf('%.2f', e) FROM edges x WHERE x.event_type = n.event_type AND x.k = below), '0') || ', ' || (SELECT printf('%.2f', e) FROM edges x WHERE x.event_type = n.event_type AND x.k = below + 1) || ')mm' END AS class FROM n""")
def binned_classes(spark, d):
    """Events by the bins of their own type, whose edges come from the data; some values are missing or not numbers, the largest lies in no bin."""
    e = table(spark, d, "events")
    spans = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    edges = spans.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long")))).select("event_type", (F.floor((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") * F.col("k") / 64) * 100) / 100).alias("e"))
    v = F.when(F.col("event_id") % 17 == 1, F.lit(float("nan"))).when(F.col("event_id") % 17 != 0, F.col("value"))
    rows = e.select("event_id", "event_type", v.alias("v"))
    return classes.classify(rows, classes.edges_to_bins(edges, ["event_type"], "e"), ["event_type"], "v").select("event_id", "event_type", "class_id", "class")


#: Seven images of 64 by 40 cells; every supplier is a defect of one of them.
IMAGE = """img AS (SELECT l_linenumber::BIGINT AS image, l_partkey % 64 AS x, (l_suppkey + l_orderkey) % 40 AS y, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
 def AS (SELECT DISTINCT s_suppkey % 7 + 1 AS image, s_suppkey * 5 % 64 AS x, s_suppkey * 3 % 40 AS y FROM supplier)"""
_ALONG = """SELECT DISTINCT s.image, s.{line} AS l, g.{along} AS p FROM def s JOIN top g ON g.image = s.image AND g.{line} = s.{line}
 WHERE (SELECT count(*) FROM top b WHERE b.image = s.image AND b.{line} = s.{line} AND b.{along} BETWEEN least(s.{along}, g.{along}) AND greatest(s.{along}, g.{along})) = abs(g.{along} - s.{along}) + 1"""


def _top(line: str) -> str:
    return f"SELECT image, x, y FROM (SELECT *, max(v) OVER (PARTITION BY image, {line}) AS m FROM img) WHERE v >= 0.7 * m"


@query("a12_defect_regions", f"""WITH {IMAGE}, tr AS ({_top("y")}), tc AS ({_top("x")}),
 rows_ AS ({_ALONG.format(line="y", along="x").replace("top ", "tr ")}), columns_ AS ({_ALONG.format(line="x", along="y").replace("top ", "tc ")})
 SELECT image, p AS x, l AS y FROM rows_ UNION SELECT image, l AS x, p AS y FROM columns_""")
def defect_regions(spark, d):
    """Cells connected to a defect along its row or column, at 0.7 of the line's largest value or more."""
    li = table(spark, d, "lineitem")
    image = li.groupBy(F.col("l_linenumber").cast("long").alias("image"), (F.col("l_partkey") % 64).alias("x"), ((F.col("l_suppkey") + F.col("l_orderkey")) % 40).alias("y")).agg(F.max("l_extendedprice").alias("v"))
    s = F.col("s_suppkey")
    seeds = table(spark, d, "supplier").select((s % 7 + 1).alias("image"), (s * 5 % 64).alias("x"), (s * 3 % 40).alias("y")).distinct()
    return regions.grow(image, seeds, ["image"], threshold=0.7)


@query("k46_training_windows", """WITH src AS (SELECT DISTINCT s_suppkey * 7 AS first FROM supplier),
 own AS (SELECT vec_id, (SELECT max(first) FROM src WHERE first <= vec_id) AS source, label, embedding FROM embeddings)
 SELECT o.vec_id, o.source, f AS bin, j AS place, round(e.embedding[(CASE WHEN f + j < 0 THEN -f - j WHEN f + j > 63 THEN 63 ELSE f + j END) + 1]::DOUBLE + 0.01 * o.embedding[f + 1]::DOUBLE, 6) AS v
 FROM own o JOIN embeddings e ON e.vec_id = o.source, (SELECT unnest(range(0, 64, 4)) AS f), (SELECT unnest(range(-2, 3)) AS j)""")
def training_windows(spark, d):
    """Features of every set: windows of five bins of the source that it reuses, mirrored below bin 0 and held beyond the last, with the set's own noise.

    A source serves all sets from its number to the next source's.
    """
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("own"))
    sources = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("source")).distinct()
    dealt = rel.latest_start(e, sources, "vec_id", "source", 1024)
    met = dealt.join(e.select(F.col("vec_id").alias("source"), F.col("own").alias("trace")), "source")
    bins = met.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(4)))).withColumn("place", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    at = F.least(F.abs(F.col("bin") + F.col("place")), F.lit(63))
    return bins.select("vec_id", "source", F.col("bin").cast("long").alias("bin"), F.col("place").cast("long").alias("place"), F.round(F.get("trace", at) + 0.01 * F.get("own", F.col("bin")), 6).alias("v"))

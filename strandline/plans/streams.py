"""Queries on streams: events arrive as files, results are what the drained stream wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.registry import micros, query
from strandline.sources.shared import new_folder
from strandline.streaming import windows as st

#: Windows end before the watermark: the latest event less ten minutes.
PASSED = "(SELECT epoch_us(max(ts)) - 600000000 FROM events)"


def _events(spark, d):
    """Events with an event time; a time without zone is read in the session's zone, and given back as microseconds without it."""
    return st.source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _micros(c: str):
    return _micros_of(c).alias(c)


def _micros_of(c: str):
    return micros(F.col(c).cast("timestamp_ntz"))


@query("t05_tumbling_blocks", f"""SELECT b * 3600000000 AS start, (b + 1) * 3600000000 AS "end", event_type, n, total FROM (
 SELECT epoch_us(ts) // 3600000000 AS b, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) WHERE (b + 1) * 3600000000 <= {PASSED}""")
def tumbling(spark, d):
    w = _events(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    out = st.drain(w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total"), "tumbling")
    return out.select(_micros("start"), _micros("end"), "event_type", "n", "total")


@query("t04_sliding_segments", f"""SELECT b * 3600000000 AS start, n FROM (SELECT epoch_us(ts) // 3600000000 - k AS b, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL)
 WHERE (b + 2) * 3600000000 <= {PASSED}""")
def sliding(spark, d):
    w = _events(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return st.drain(w.select(F.col("w.start").alias("start"), "n"), "sliding").select(_micros("start"), "n")


@query("t01_stateful_filter")
def stateful_filter(spark, d):
    """A one-pole filter of each user's events, its state kept between blocks; a test holds it against the batch recursion."""
    return st.drain(st.one_pole(st.source(spark, d, "events"), "user_id", "event_id", "value", 0.25), "filter").withColumn("y", F.round("y", 6))


@query("t02_block_spectrum", """WITH b AS (SELECT event_id // 64 AS block, event_id % 64 AS i, value AS v FROM events)
 SELECT block, k, round(sum(v * cos(2 * pi() * k * i / 64)), 4) AS re, round(sum(v * sin(2 * pi() * k * i / 64)), 4) AS im FROM b, (SELECT unnest([1, 2, 3]) AS k) GROUP BY block, k""")
def block_spectrum(spark, d):
    """Blocks of 64 events through three bins of a transform, as they come; the sums of a block meet after the stream is drained."""
    e = st.source(spark, d, "events").select(F.floor(F.col("event_id") / 64).alias("block"), (F.col("event_id") % 64).alias("i"), F.col("value").alias("v"))
    spread = e.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    angle = F.lit(2) * F.pi() * F.col("k") * F.col("i") / 64
    parts = st.drain(spread.select("block", "k", (F.col("v") * F.cos(angle)).alias("re"), (F.col("v") * F.sin(angle)).alias("im")), "spectrum")
    return parts.groupBy("block", "k").agg(F.round(F.sum("re"), 4).alias("re"), F.round(F.sum("im"), 4).alias("im"))


@query("t06_distinct_events", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_events(spark, d):
    return st.drain(_events(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "distinct")


@query("t06_stream_join", """SELECT a.event_id AS view_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
 WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def stream_join(spark, d):
    """Purchases within an hour of a view; both streams carry watermarks, so old rows leave the state."""
    a = _events(spark, d).where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id")).withWatermark("seen", "10 minutes")
    b = _events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought"), F.col("event_id").alias("buy_id")).withWatermark("bought", "10 minutes")
    joined = a.join(b, F.expr("user_id = buyer AND bought > seen AND bought <= seen + INTERVAL 1 HOUR"))
    return st.drain(joined.select("view_id", "buy_id"), "joined")


@query("t03_interval_publisher", f"""WITH w AS (SELECT epoch_us(ts) // 3600000000 - k AS b, event_type FROM events, (SELECT unnest([0, 1]) AS k)),
 c AS (SELECT b, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS buys FROM w GROUP BY b)
 SELECT b * 3600000000 AS start, n, round(100.0 * clicks / n, 4)::DOUBLE AS click, round(100.0 * buys / n, 4)::DOUBLE AS purchase FROM c WHERE (b + 2) * 3600000000 <= {PASSED}""")
def interval_publisher(spark, d):
    """Per cent of two classes in sliding windows, published as they close; rows are what the receiver has got."""
    share = lambda kind: F.round(100 * F.sum((F.col("event_type") == kind).cast("long")) / F.count("*"), 4).alias(kind)
    w = _events(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), share("click"), share("purchase"))
    inbox = new_folder(spark, "inbox")
    closed = w.select(_micros_of("w.start").alias("start"), "n", "click", "purchase")
    st.publish(closed, st.Inbox(inbox), new_folder(spark, "published"), every=None).awaitTermination()
    return spark.read.schema(closed.schema).json(inbox)

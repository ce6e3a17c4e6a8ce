"""Classes by a table of bins: any number of schemes, met by a join on equal buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Columns of a bin: lies from ``low`` to ``high``, each end included where its flag says so; an infinite end is open.
BIN = "low double, low_in boolean, high double, high_in boolean"


def checked_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The bins of each scheme, raising where one is empty or two overlap.

    In the order of their lower ends, each bin must begin beyond the end of all bins before.
    """
    order = Window.partitionBy(*keys).orderBy("low", F.col("low_in").desc(), "high", "high_in")
    before = F.max(F.struct("high", "high_in")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    empty = (F.col("low") > F.col("high")) | ((F.col("low") == F.col("high")) & ~(F.col("low_in") & F.col("high_in"))) | F.col("low").isNull() | F.col("high").isNull()
    overlap = (F.col("low") < before["high"]) | ((F.col("low") == before["high"]) & F.col("low_in") & before["high_in"])
    ok = F.when(empty, F.raise_error("a bin is empty").cast("boolean")).when(F.coalesce(overlap, F.lit(False)), F.raise_error("bins overlap").cast("boolean")).otherwise(True)
    return bins.withColumn("__ok", ok).where("__ok").drop("__ok")


def classify(rows: DataFrame, bins: DataFrame, keys: list[str], value: str, none: str = "noise") -> DataFrame:
    """``rows`` with class_id and class: those of the bin of their scheme that holds the value.

    ``bins`` has ``keys`` (the scheme), class_id, class, and the columns of BIN; a class may have
    several bins. A null or NaN value is of the class ``none``, numbered after the scheme's
    others; a value in no bin, or of a scheme without bins, has null for both. The span of a
    scheme's finite edges is cut into as many buckets as it has bins, and one more beyond each end; a bin is
    copied to the buckets that it touches and a value meets the bins of its own.
    """
    finite = lambda c: F.when(F.abs(c) != float("inf"), F.col(c))
    spans = bins.groupBy(*keys).agg(F.min(F.least(finite("low"), finite("high"))).alias("__from"), F.max(F.greatest(finite("low"), finite("high"))).alias("__to"), F.count("*").alias("__n"), F.max("class_id").alias("__last"))
    spans = spans.withColumn("__width", F.when(F.col("__to") > F.col("__from"), (F.col("__to") - F.col("__from")) / F.col("__n")).otherwise(1.0))
    place = lambda c: F.floor((c - F.coalesce("__from", F.lit(0.0))) / F.col("__width"))
    bucket = lambda c: F.when(c == float("inf"), F.col("__n")).when(c == float("-inf"), F.lit(-1)).otherwise(F.greatest(F.lit(-1), F.least(F.col("__n"), place(c)))).cast("long")
    dealt = checked_bins(bins, keys).join(spans, keys).withColumn("__bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high"))))).select(*keys, "__bucket", "class_id", "class", *[c.split(" ")[0] for c in BIN.split(", ")])
    v = F.col(value).cast("double")
    known = rows.join(spans.select(*keys, "__from", "__to", "__n", "__last", "__width"), keys, "left").withColumn("__bucket", F.when(v.isNotNull() & ~F.isnan(v), bucket(v)))
    inside = ((F.col(f"r.{value}") > F.col("b.low")) | (F.col("b.low_in") & (F.col(f"r.{value}") == F.col("b.low")))) & ((F.col(f"r.{value}") < F.col("b.high")) | (F.col("b.high_in") & (F.col(f"r.{value}") == F.col("b.high"))))
    on = inside & (F.col("r.__bucket") == F.col("b.__bucket"))
    for k in keys:
        on &= F.col(f"r.{k}") == F.col(f"b.{k}")
    met = known.alias("r").join(dealt.alias("b"), on, "left")
    noise = F.col("r.__bucket").isNull() & F.col("r.__last").isNotNull()
    class_id = F.when(noise, F.col("r.__last") + 1).otherwise(F.col("b.class_id")).cast("int")
    return met.select(*[F.col(f"r.{c}") for c in rows.columns], class_id.alias("class_id"), F.when(noise, F.lit(none)).otherwise(F.col("b.class")).alias("class"))


def edges_to_bins(edges: DataFrame, keys: list[str], edge: str) -> DataFrame:
    """Bins of the edges of each scheme: class k lies from edge k - 1, which it holds, to edge k; the first begins at zero, or below it where it must."""
    order = Window.partitionBy(*keys).orderBy(edge)
    low = F.lag(edge).over(order)
    text = lambda c: F.format_string("%.2f", c)
    name = F.concat(F.lit("["), F.when(low.isNull(), F.lit("0")).otherwise(text(low)), F.lit(", "), text(F.col(edge)), F.lit(")mm"))
    return edges.select(*keys, (F.row_number().over(order) - 1).alias("class_id"), name.alias("class"), F.coalesce(low, F.lit(float("-inf"))).alias("low"), low.isNotNull().alias("low_in"), F.col(edge).alias("high"), F.lit(False).alias("high_in"))

"""Joins, sets, sampling and aggregates over trial tables and scan grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.sources.shared import new_folder


def portable_hash(key: str, seed: int) -> Column:
    """A draw from 0 to 2**31 - 1 that other engines can repeat."""
    return F.pmod(F.col(key).cast("long") * F.lit(1103515245).cast("long") + F.lit(seed).cast("long"), F.lit(2147483648).cast("long"))


def lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join to a table that must have each key once; a repeated key raises."""
    n = right.groupBy(*on).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in on])
    checked = n.withColumn("__one", F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error("a key occurs more than once").cast("boolean")))
    return left.join(checked.where("__one").drop("__n", "__one"), on)


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with start < at <= end, by buckets of ``width``: an equal-key join and a filter, so no pair table is built.

    An interval is copied to the buckets it touches; choose ``width`` near their length.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = intervals.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return points.withColumn("__bucket", bucket(at)).join(spread, [*on, "__bucket"]).where((F.col(start) < F.col(at)) & (F.col(at) <= F.col(end))).drop("__bucket")


def radius_join(targets: DataFrame, samples: DataFrame, on: list[str], radius: float) -> DataFrame:
    """(targets, samples) no further apart than ``radius``; columns (tx, ty) and (sx, sy). Cells of the radius and their neighbours meet."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = targets.withColumn("__x", cell("tx")).withColumn("__y", cell("ty"))
    for c in ("__x", "__y"):
        around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    d = F.sqrt(F.pow(F.col("tx") - F.col("sx"), 2) + F.pow(F.col("ty") - F.col("sy"), 2))
    return around.join(samples.withColumn("__x", cell("sx")).withColumn("__y", cell("sy")), [*on, "__x", "__y"]).drop("__x", "__y").withColumn("d", d).where(F.col("d") <= radius)


def inverse_distance(pairs: DataFrame, keys: list[str], v: str) -> DataFrame:
    """sum(v / d) / sum(1 / d); a sample at distance zero stands alone."""
    exact = F.max(F.when(F.col("d") == 0, F.col(v)))
    return pairs.groupBy(*keys).agg(F.coalesce(exact, F.sum(F.when(F.col("d") > 0, F.col(v) / F.col("d"))) / F.sum(F.when(F.col("d") > 0, 1 / F.col("d")))).alias("v"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The latest ``value`` of the right side at or before each left row, by one union and one window: no pairs."""
    both = left.select(key, at, *[c for c in left.columns if c not in (key, at)], F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("__side"))
    other = right.select(key, at, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, at)], value, F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.unionByName(other).withColumn(value, F.last(value, True).over(w))
    return filled.where("__side = 1").drop("__side")


def latest_start(rows: DataFrame, starts: DataFrame, at: str, start: str, width: int) -> DataFrame:
    """``rows`` with the largest ``start`` that is not beyond ``at``; both are whole numbers, and rows before the first start drop out.

    Starts are ranked by ranges, so each knows the next; the spans between them are cut at
    every multiple of ``width`` and meet the rows on equal cells. No task sees all rows.
    """
    ranked = numbered(starts, start, "__k")
    after = ranked.select((F.col("__k") - 1).alias("__k"), F.col(start).alias("__next"))
    end = rows.agg(F.max(at).alias("__end"))
    spans = ranked.join(after, "__k", "left").crossJoin(F.broadcast(end)).withColumn("__to", F.coalesce(F.col("__next") - 1, F.col("__end"))).where(F.col("__to") >= F.col(start))
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = spans.withColumn("__cell", F.explode(F.sequence(cell(start), cell("__to")))).select("__cell", start, "__to")
    return rows.withColumn("__cell", cell(at)).join(spread, "__cell").where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col("__to"))).drop("__cell", "__to")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def sample_per_group(df: DataFrame, keys: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group without replacement; a smaller group raises."""
    taken = rank_within(df, keys, [portable_hash(key, seed), F.col(key)], n)
    # only the n rows of each group that are left are counted
    checked = taken.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).withColumn("__ok", F.when(F.col("__n") >= n, True).otherwise(F.raise_error("a group is smaller than its sample").cast("boolean")))
    return checked.where("__ok").drop("__n", "__ok")


def numbered(df: DataFrame, column: str, to: str) -> DataFrame:
    """The distinct values of a column and their places in ascending order, from 0.

    A sort by ranges is written to the shared folder; a value's place is its place in its
    partition after the rows of the partitions before, so no task holds all values.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "sorted")
    df.select(column).distinct().orderBy(column).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    ordered = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    parts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ordered.join(F.broadcast(before), "__part").select(column, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(to))


def parameter_grid(df: DataFrame, column: str, **values: list) -> DataFrame:
    """Each distinct value of a column with every choice of the listed parameters, and the place of each set in that order.

    Values are numbered by a sort by ranges and the short lists are exploded beside them, so no task holds the grid.
    """
    sets = numbered(df, column, "set_no")
    for name, choices in values.items():
        sets = sets.select("*", F.posexplode(F.array(*[F.lit(c) for c in choices])).alias("__place", name))
        sets = sets.withColumn("set_no", F.col("set_no") * len(choices) + F.col("__place")).drop("__place")
    return sets


def overlap_weights(df: DataFrame, x: str, y: str, width: int, height: int, size: int, step: int) -> DataFrame:
    """Each row beside every batch of ``size`` x ``size`` cells that covers its cell: origins ``bx`` and ``by_`` and ``weight``, one over their number.

    The batches follow from the cell itself, so weights need no count over the grid.
    """
    if (width - size) % step or (height - size) % step:
        raise ValueError("batches do not end at the border of the grid")

    def origins(c: str, cells: int) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / step)), F.least(F.lit((cells - size) // step), F.floor(F.col(c) / step))
        return F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda k: k * step)

    found = df.withColumn("__bx", origins(x, width)).withColumn("__by", origins(y, height)).withColumn("weight", 1.0 / (F.size("__bx") * F.size("__by")))
    return found.withColumn("bx", F.explode("__bx")).withColumn("by_", F.explode("__by")).drop("__bx", "__by")


def split_by_trial(df: DataFrame, trial: str, ratio: float, seed: int) -> DataFrame:
    """Adds ``part``: test for the int(ratio * n) trials of least hash, else train. Ranks come from counts per hash slice, so no task holds all trials."""
    trials = df.select(trial).distinct().withColumn("__h", portable_hash(trial, seed)).withColumn("__s", F.shiftright("__h", 19))
    slices = trials.groupBy("__s").agg(F.count("*").alias("n"))
    before = slices.withColumn("before", F.sum("n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)))  # at most 4096 rows
    total = F.broadcast(slices.agg(F.sum("n").alias("total")))
    ranked = trials.join(F.broadcast(before.select("__s", F.coalesce("before", F.lit(0)).alias("before"))), "__s")
    ranked = ranked.withColumn("__rank", F.col("before") + F.row_number().over(Window.partitionBy("__s").orderBy("__h", trial)))
    part = F.when(F.col("__rank") <= F.floor(F.col("total") * ratio), "test").otherwise("train")
    return df.join(ranked.crossJoin(total).select(trial, part.alias("part")), trial)


def mode(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """The commonest value of each group, the least of equals."""
    counts = df.groupBy(*keys, v).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(v, F.struct(-F.col("n"), F.col(v))).alias(v), F.max("n").alias("n"))


def otsu(df: DataFrame, keys: list[str], level: str, levels: int = 256) -> DataFrame:
    """The level that splits a histogram of whole-number levels with the largest variance between classes."""
    hist = df.groupBy(*keys, F.col(level).cast("long").alias("level")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = hist.withColumn("w0", F.sum("n").over(upto)).withColumn("s0", F.sum(F.col("n") * F.col("level")).over(upto)).withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * F.col("level")).over(whole))
    w1 = F.col("w") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1, 2)).otherwise(-1.0)
    return h.withColumn("between", F.round(between, 3)).groupBy(*keys).agg(F.min_by("level", F.struct(-F.col("between"), F.col("level"))).alias("threshold"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the new one wins."""
    both = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    return rank_within(both, [key], [F.col("__turn").desc()], 1).drop("__turn")


def bilinear_cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """The four grid cells around a point with weights by inverse distance; a point on a cell gives it all."""
    x0, y0 = F.floor(x), F.floor(y)
    cells = F.array(*[F.struct((x0 + a).alias("cx"), (y0 + b).alias("cy")) for a in (0, 1) for b in (0, 1)])
    d = F.sqrt(F.pow(F.col("cx") - F.col(x), 2) + F.pow(F.col("cy") - F.col(y), 2))
    return df.withColumn("__c", F.explode(cells)).withColumns({"cx": F.col("__c.cx"), "cy": F.col("__c.cy")}).drop("__c").withColumn("d", d)

"""Mixing sources to target weights by weighted sampling without replacement.

Within a source every document draws the key -ln(u) / weight, the arrival time of an
exponential clock whose rate is the document's quality weight; taking documents in key
order is Efraimidis-Spirakis sampling. Whole epochs come first, then documents in key
order until their words reach what is left of the source's budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.common import WORD, Scratch, free_prefix, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Slices of each unit of a key's logarithm; words are summed by slice, so only the slice on the edge of the budget is sorted.
#: The logarithm of an exponential key has a density of 1 / e at most, whatever its rate: no slice is expected to hold
#: more than 1 in 2700 of a source's documents, whatever their weights.
SLICES = 1024
#: Signs that lower a document's quality weight.
SIGNS = r"[#*$%&|<>{}\[\]\\=_~^@!0-9]"


def size_of(text):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(text):
    """Quality weight from 0.1 to 1: one less five times the share of signs among the characters."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    return F.greatest(F.lit(0.1), F.coalesce(1 - 5.0 * F.regexp_count(text, F.lit(SIGNS)) / chars, F.lit(0.1)))


def uniform(doc_id, text, seed: str):
    """A number in (0, 1) from the md5 of the id, or where that is null of the text, and a seed: the same on every run and engine."""
    name = F.when(doc_id.isNotNull(), doc_id.cast("string")).otherwise(F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.substring(F.md5(F.concat(name, F.lit(seed)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of ``share`` times all words by weight, none above ``most`` times its source.

    ``sources`` has one row for each source with its size. A level is raised until the
    sources below their limit, at level times weight, take what the others leave; each
    round adds up the table of sources, and only sums reach the driver.
    """
    spark = sources.sparkSession
    # ranks without one task for all: a global sort, then the rows of the partitions before
    ordered = scratch.keep(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    before, starts = 0, []
    for r in counts:
        starts.append((r["part"], before))
        before += r["n"]
    first = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.create_map(F.lit(0).cast("long"), F.lit(0))
    rank = F.coalesce(F.element_at(first, part), F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    weighed = ordered.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    limited, level = -1, 0.0
    full = lambda level: most * F.col("source_size") <= F.lit(level) * F.col("weight")
    while True:
        row = weighed.agg(
            F.count_if(full(level)).alias("n"), F.coalesce(F.sum(F.when(full(level), most * F.col("source_size"))), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~full(level), F.col("weight"))), F.lit(0)).alias("weight")
        ).first()
        if row["n"] == limited or not row["weight"]:
            break
        limited, level = row["n"], (share * total - row["taken"]) / row["weight"]
    target = F.least((most * F.col("source_size")).cast("double"), F.lit(float(level)) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, columns: list[str], id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = ":mix", weights=WEIGHTS, share: float = SHARE, most: int = MOST, prefix: str = "") -> DataFrame:
    """``columns`` of every document with size, source_size, target and taken, named after ``prefix``.

    ``taken`` is the size times the whole epochs, once more for a document of the
    fractional epoch: documents in key order whose middle word lies within the rest of
    the budget. Rows of one id share a draw, and so do rows without id of equal texts; equal
    keys are ordered by id, then by a hash of the text, so that no row's share depends on how the table is split. Sources with a null name are a source of their
    own, the last. Documents without words, or with null text, take nothing; an empty
    table gives no rows. The documents may have columns of any names.
    """
    scratch, mark = Scratch(docs.sparkSession), free_prefix(docs.columns)
    key = -F.ln(uniform(F.col(id_column), F.col(text_column), seed)) / weight_of(F.col(text_column))
    keyed = docs.select(
        *columns, F.col(source_column).alias(f"{mark}source"), F.col(id_column).alias(f"{mark}id"), size_of(F.col(text_column)).alias(f"{mark}size"), key.alias(f"{mark}key"), F.xxhash64(text_column).alias(f"{mark}text"), F.monotonically_increasing_id().alias(f"{mark}row")
    )
    keyed = scratch.keep(keyed.withColumn(f"{mark}slice", F.floor(F.ln(f"{mark}key") * SLICES).cast("int")), "keyed")
    slices = scratch.keep(keyed.groupBy(f"{mark}source", f"{mark}slice").agg(F.sum(f"{mark}size").alias("words")), "slices")
    target = scratch.keep(targets(slices.groupBy(F.col(f"{mark}source").alias("source")).agg(F.sum("words").alias("source_size")), scratch, weights, share, most), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    target = target.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # keys lie between 2^-54 and 370, so at most 45,000 slices of a source meet in this window
    order = Window.partitionBy(f"{mark}source").orderBy(f"{mark}slice")
    run = slices.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    edged = run.join(target, F.col(f"{mark}source").eqNullSafe(F.col("source"))).where("before < rest and rest < upto")
    edge = edged.select(F.col("source").alias("e"), F.col(f"{mark}slice").alias("edge"), F.col("before").alias("edge_before"))
    plan = target.join(edge, F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    plan = scratch.keep(plan.select(*[F.col(c).alias(f"{mark}plan_{c}") for c in plan.columns]), "plan")
    joined = keyed.join(plan, F.col(f"{mark}source").eqNullSafe(F.col(f"{mark}plan_source")))
    base, edge, rest = F.col(f"{mark}plan_epochs") * F.col(f"{mark}size"), F.col(f"{mark}plan_edge"), F.col(f"{mark}plan_rest")
    # below the edge all are taken; a source without edge takes all of the fraction or nothing
    inside = F.when(edge.isNull(), rest >= F.col(f"{mark}plan_source_size")).otherwise(F.col(f"{mark}slice") < edge)
    clear = joined.where(edge.isNull() | (F.col(f"{mark}slice") != edge)).withColumn(f"{mark}taken", base + F.when(inside, F.col(f"{mark}size")).otherwise(0))
    on_edge = joined.where(F.col(f"{mark}slice") == edge)
    sorted_ = Window.partitionBy(f"{mark}plan_source", f"{mark}slice").orderBy(f"{mark}key", F.col(f"{mark}id").asc_nulls_last(), f"{mark}text", f"{mark}row").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col(f"{mark}plan_edge_before") + F.sum(f"{mark}size").over(sorted_) - F.col(f"{mark}size") / 2
    cut = on_edge.withColumn(f"{mark}taken", base + F.when(middle <= rest, F.col(f"{mark}size")).otherwise(0))
    added = {"size": f"{mark}size", "source_size": f"{mark}plan_source_size", "target": f"{mark}plan_target", "taken": f"{mark}taken"}
    out = [*columns, *[(F.col(c).cast("long") if k == "taken" else F.col(c)).alias(prefix + k) for k, c in added.items()]]
    return clear.select(*out).unionByName(cut.select(*out))


def mixed_documents(docs: DataFrame, text_column: str = "text", **settings) -> DataFrame:
    """The documents of the mix with their own columns, whatever their names, a row for each time that the mix takes them.

    Documents without words, or with null text, are not taken; repeated rows are drawn
    alike and taken each; an empty table gives no rows.
    """
    names, mark = docs.columns, free_prefix(docs.columns, "mix_")
    taken = mix(docs, names, text_column=text_column, prefix=mark, **settings)
    size = F.col(f"{mark}size")
    times = F.when(size > 0, F.col(f"{mark}taken") / size).otherwise(0).cast("int")
    return taken.where(times > 0).withColumn(f"{mark}turn", F.explode(F.array_repeat(F.lit(1), times))).select(*names)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g')), 0) AS size,
         greatest(0.1, coalesce(1 - 5.0 * length(regexp_replace(text, '[^#*$%&|<>{}\[\]\\=_~^@!0-9]', '', 'g')) / greatest(length(text), 1), 0.1)) AS weight,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) || ':mix'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
capped AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS c_before, sum(w) OVER (ORDER BY source_size * 2.0 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after
  FROM sources WINDOW o AS (ORDER BY source_size * 2.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max((1.5 * (SELECT sum(source_size) FROM sources) - c_before) / w_after) AS l FROM capped
  WHERE 2 * source_size > (1.5 * (SELECT sum(source_size) FROM sources) - c_before) / w_after * w),
target AS (
  SELECT source, source_size, least(2.0 * source_size, l * w)::DOUBLE AS target FROM sources, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM target),
keyed AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY -ln(u) / weight, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + CASE WHEN middle <= rest THEN size ELSE 0 END)::BIGINT AS taken
FROM keyed
"""

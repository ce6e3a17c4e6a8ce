"""Queries on the pulse dictionary (its products, blind correction of positions, the pulse search) and on block kriging."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import kriging as kr, pulses as pl
from strandline.plans.registry import query, table

PULSE, DEEPEST = pl.Pulse(), 20.0

#: Scans are vectors along 40 cells, defects the cells that parts name.
_DICTIONARY = """sc AS (SELECT vec_id AS scan, vec_id % 40 + 0.25 * (vec_id % 3) AS x FROM embeddings),
 de AS (SELECT p_partkey % 40 AS gx, p_size % 20 + 1 AS gz, (p_partkey % 40) * 100 + p_size % 20 + 1 AS defect, max(p_retailprice) / 1000 AS amplitude FROM part GROUP BY ALL),
 pr AS (SELECT scan, defect, amplitude, x - gx AS dx, 2 / 0.7::DOUBLE * sqrt((x - gx) * (x - gx) + gz * gz) AS tau FROM sc, de WHERE abs(x - gx) <= tan(radians(40)) * gz),
 mx AS (SELECT scan, defect, amplitude, n, n - tau AS u, 4 / (0.7::DOUBLE * 0.7) * dx / tau AS by_x FROM pr, (SELECT unnest(range(64)) AS n) WHERE n BETWEEN tau - 6 AND tau + 6),
 hj AS (SELECT scan, defect, amplitude, n, exp(-0.08 * u * u) * cos(0.4 * pi() * u) AS h, by_x * exp(-0.08 * u * u) * (0.16 * u * cos(0.4 * pi() * u) + 0.4 * pi() * sin(0.4 * pi() * u)) AS j FROM mx)"""


def position():
    return (F.col("vec_id") % 40 + 0.25 * (F.col("vec_id") % 3)).cast("double")


def scans(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("scan"), position().alias("x"))


def defects(spark, d):
    gx, gz = F.col("p_partkey") % 40, F.col("p_size") % 20 + 1
    p = table(spark, d, "part").groupBy(gx.cast("double").alias("gx"), gz.cast("double").alias("gz")).agg((F.max("p_retailprice") / 1000).alias("amplitude"))
    return p.withColumn("defect", (F.col("gx") * 100 + F.col("gz")).cast("long"))


@query("k23_dictionary_forward", f"WITH {_DICTIONARY} SELECT scan, n, round(sum(h * amplitude), 5) AS model, round(sum(j * amplitude), 4) AS slope FROM hj GROUP BY scan, n")
def dictionary_forward(spark, d):
    """Each scan's modelled trace and its slope by the scan's position; scans of one position have one model."""
    de, sc = defects(spark, d), scans(spark, d)
    # x repeats after 120 scans, so there are 120 positions; they are numbered by x itself
    at = sc.where("x is not null").select(F.col("x").alias("scan"), "x").distinct()
    f = pl.forward(pl.dictionary(at, de, PULSE, DEEPEST), de.select("defect", "amplitude")).withColumnRenamed("scan", "x")
    rows = F.sort_array(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), F.round("model", 5).alias("model"), F.round("slope", 4).alias("slope"))))
    return sc.join(F.broadcast(f.groupBy("x").agg(rows.alias("r"))), "x").select("scan", F.inline("r"))


@query("k23_dictionary_adjoint", f"""WITH {_DICTIONARY}, tr AS (SELECT vec_id AS scan, generate_subscripts(embedding, 1) - 1 AS n, unnest(embedding)::DOUBLE AS v FROM embeddings)
 SELECT defect, round(sum(h * v), 5) AS image FROM hj JOIN tr USING (scan, n) GROUP BY defect""")
def dictionary_adjoint(spark, d):
    """The image that all traces make at the defects' places; the product is linear, so traces of one position add up first."""
    traces = table(spark, d, "embeddings").select(position().alias("scan"), F.posexplode("embedding").alias("n", "v"))
    sums = traces.where("scan is not null").groupBy("scan", "n").agg(F.sum(F.col("v").cast("double")).alias("v"))
    at = scans(spark, d).where("x is not null").select(F.col("x").alias("scan"), "x").distinct()
    return pl.adjoint(pl.dictionary(at, defects(spark, d), PULSE, DEEPEST), sums).select("defect", F.round("image", 5).alias("image"))


#: A wavelength is 1 / 0.2 samples of two-way travel, 1.75 cells; tracked positions are off by less than 0.4 of it.
OFF = 0.6


@query("k28_blind_correction", "SELECT vec_id AS scan, round(vec_id % 40 + 0.25 * (vec_id % 3), 3)::DOUBLE AS position FROM embeddings")
def blind_correction(spark, d):
    """Positions of scans whose tracked ones are off: the traces come from the true ones, and the loop must find them."""
    true, pulse = scans(spark, d), pl.Pulse(fading=True, reach=12)
    # one defect a column and depths apart, so that a trace tells where it was taken
    de = defects(spark, d).groupBy("gx").agg(F.max(F.struct("gz", "amplitude", "defect")).alias("m")).select("gx", "m.*")
    traces = pl.forward(pl.dictionary(true, de, pulse, DEEPEST), de.select("defect", "amplitude")).select("scan", "n", F.col("model").alias("v"))
    wrong = true.withColumn("x", F.col("x") + OFF * ((F.col("scan") * 7919 % 101) / 50.0 - 1))
    found = pl.corrected_positions(wrong, traces, de, pulse, DEEPEST, most=0.5, rounds=20, gain=1e-9, enough=1e-12, starts=(-0.5, -0.25, 0.0, 0.25, 0.5))
    return found.select("scan", F.round("position", 3).alias("position"))


@query("k41_pulse_search", """SELECT s_suppkey, round((s_suppkey % 7 - 3) * 0.2::DOUBLE, 2) AS phase, round(0.02 + 0.01 * (s_nationkey % 5), 2)::DOUBLE AS bandwidth, round(0.02 * (s_suppkey % 3 - 1), 2)::DOUBLE AS chirp FROM supplier""")
def pulse_search(spark, d):
    """Phase, bandwidth and chirp of a pulse for each supplier, made from the supplier's columns and found again by the search."""
    s = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 7 - 3) * 0.2).alias("phase"), (0.02 + 0.01 * (F.col("s_nationkey") % 5)).alias("bandwidth"), (0.02 * (F.col("s_suppkey") % 3 - 1)).alias("chirp"))
    u = lambda i: i - 32.0
    sample = lambda i: F.exp(-F.col("bandwidth") * u(i) * u(i)) * F.cos(0.4 * F.pi() * u(i) + F.col("chirp") * u(i) * u(i) + F.col("phase"))
    traces = s.select("s_suppkey", F.transform(F.sequence(F.lit(0), F.lit(63)), sample).alias("v"))
    found = pl.fitted_pulses(traces, "s_suppkey", {"phase": (-1.0, 1.0), "bandwidth": (0.005, 0.105), "chirp": (-0.05, 0.05)}, 0.2, rounds=9)
    # no zero with a sign
    return found.select("s_suppkey", *[(F.round(c, 2) + 0.0).alias(c) for c in ("phase", "bandwidth", "chirp")])


GRID, LENGTH = 10, 64


def reach(k: int) -> float:
    """Higher bins vary over shorter distances."""
    return 4.0 / (1 + k / 16)


def _cells(spark, d):
    """Vectors as traces at the cells of a batch for each label, the first of several in a cell; two thirds of the cells at least are left out."""
    e = table(spark, d, "embeddings").where("vec_id % 3 = 0 and label is not null and embedding is not null")
    return e.groupBy("label", (F.col("vec_id") % 10).alias("x"), (F.floor(F.col("vec_id") / 10) % 10).alias("y")).agg(F.min_by(F.transform("embedding", lambda x: x.cast("double")), "vec_id").alias("v"))


@query("k16_block_traces")
def block_traces(spark, d):
    """Traces of every unsampled cell, by weights of each frequency bin; tests hold them against plain systems."""
    traces, _ = kr.block_kriging(_cells(spark, d), "label", GRID, LENGTH, reach)
    return traces.select("label", "x", "y", F.transform("v", lambda x: F.round(x, 5) + 0.0).alias("v"))


@query("k16_block_error_map")
def block_error_map(spark, d):
    """Error of every unsampled cell and bin."""
    _, error = kr.block_kriging(_cells(spark, d), "label", GRID, LENGTH, reach)
    return error.select("label", "x", "y", "k", F.round("sigma", 6).alias("sigma"))


@query("k16_constant_blocks", """WITH c AS (SELECT label, vec_id % 10 AS x, vec_id // 10 % 10 AS y, arg_min(embedding, vec_id) AS v FROM embeddings WHERE vec_id % 3 = 0 GROUP BY ALL),
 f AS (SELECT label, arg_min(v, (x, y)) AS v FROM c GROUP BY label), g AS (SELECT unnest(range(10)) AS x, NULL::BIGINT AS y), h AS (SELECT a.x, b.x AS y FROM g a, g b)
 SELECT f.label, h.x, h.y, n, round(v[n + 1]::DOUBLE, 5) + 0.0 AS v FROM f, h, (SELECT unnest(range(64)) AS n) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.label = f.label AND c.x = h.x AND c.y = h.y)""")
def constant_blocks(spark, d):
    """Where all sampled cells of a batch have one trace, all others get it: through spectra, weights and back."""
    cells = _cells(spark, d)
    one = cells.groupBy("label").agg(F.min_by("v", F.struct("x", "y")).alias("v"))
    traces, _ = kr.block_kriging(cells.drop("v").join(one, "label"), "label", GRID, LENGTH, reach)
    rows = traces.select("label", "x", "y", F.posexplode("v").alias("n", "v"))
    return rows.select("label", "x", "y", F.col("n").cast("long").alias("n"), (F.round("v", 5) + 0.0).alias("v"))

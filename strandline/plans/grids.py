"""Queries on volumes, images and scan positions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandline.operators import relational as rel, variogram
from strandline.plans.registry import T, V, cells, query, table, traces


@query("a01_cscan_maxabs", f"WITH {V} SELECT x, y, round(max(abs(v)), 4) AS peak FROM vol GROUP BY x, y")
def cscan(spark, d):
    return cells(spark, d).groupBy("x", "y").agg(F.round(F.max(F.abs("v")), 4).alias("peak"))


@query("p07_roi_crop", f"WITH {V} SELECT x, y, z, round(v, 6) AS v FROM vol WHERE x BETWEEN 2 AND 6 AND y >= 2 AND y < 5 AND z < 32")
def roi(spark, d):
    return cells(spark, d).where("x between 2 and 6 and y >= 2 and y < 5 and z < 32").select("x", "y", "z", F.round("v", 6).alias("v"))


@query("p09_weak_trace_drop", f"WITH {V}, p AS (SELECT x, y, max(abs(v)) AS p FROM vol GROUP BY x, y) SELECT x, y, round(p / (SELECT max(p) FROM p), 6) AS share FROM p WHERE p >= 0.97 * (SELECT max(p) FROM p)")
def weak_traces(spark, d):
    p = cells(spark, d).groupBy("x", "y").agg(F.max(F.abs("v")).alias("p"))
    top = F.broadcast(p.agg(F.max("p").alias("top")))  # one row
    return p.crossJoin(top).where(F.col("p") >= 0.97 * F.col("top")).select("x", "y", F.round(F.col("p") / F.col("top"), 6).alias("share"))


@query("p08_zero_trace_drop", "WITH t AS (SELECT l_partkey % 500 AS tr, l_discount AS v FROM lineitem WHERE l_linenumber = 7) SELECT tr, count(*) AS n FROM t GROUP BY tr HAVING max(abs(v)) > 0")
def zero_traces(spark, d):
    t = table(spark, d, "lineitem").where("l_linenumber = 7").select((F.col("l_partkey") % 500).alias("tr"), F.col("l_discount").alias("v"))
    return t.groupBy("tr").agg(F.count("*").alias("n"), F.max(F.abs("v")).alias("m")).where("m > 0").select("tr", "n")


HALVES = """h AS (SELECT l_suppkey % 10 AS x, l_linenumber::BIGINT AS y, avg(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity END) AS r, avg(CASE WHEN l_orderkey % 2 = 1 THEN l_quantity END) AS w FROM lineitem GROUP BY ALL)"""


def halves(spark, d):
    """Two images of the same scene, from even and odd orders: (x, y, r, w)."""
    odd = F.col("l_orderkey") % 2
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("x"), F.col("l_linenumber").cast("long").alias("y")).agg(F.avg(F.when(odd == 0, F.col("l_quantity"))).alias("r"), F.avg(F.when(odd == 1, F.col("l_quantity"))).alias("w"))


@query("a08_scaled_error", f"WITH {HALVES} SELECT y, round(sqrt(greatest(sum(r * r) - sum(r * w) * sum(r * w) / sum(w * w), 0)) / sqrt(sum(r * r)), 5) AS se FROM h WHERE r IS NOT NULL AND w IS NOT NULL GROUP BY y")
def scaled_error(spark, d):
    h = halves(spark, d).where("r is not null and w is not null")
    s = h.groupBy("y").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("w")).alias("rw"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    return s.select("y", F.round(F.sqrt(F.greatest(F.col("rr") - F.col("rw") * F.col("rw") / F.col("ww"), F.lit(0.0))) / F.sqrt("rr"), 5).alias("se"))


@query("a09_artefact_area", f"WITH {V}, p AS (SELECT x, y, max(abs(v)) AS p FROM vol GROUP BY x, y) SELECT y, count(*) FILTER (p >= 0.9 * m) * 0.25 / 1.5 AS area FROM (SELECT *, max(p) OVER (PARTITION BY y) AS m FROM p) GROUP BY y")
def artefact_area(spark, d):
    p = cells(spark, d).groupBy("x", "y").agg(F.max(F.abs("v")).alias("p")).withColumn("m", F.max("p").over(Window.partitionBy("y")))
    return p.groupBy("y").agg((F.count_if(F.col("p") >= 0.9 * F.col("m")) * 0.25 / 1.5).alias("area"))


@query("a10_gcnr_overlap", f"""WITH {V}, r AS (SELECT x, x < 5 AS inside, v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM vol), b AS (SELECT inside, least(floor((v - lo) / (hi - lo) * 32), 31) AS bin FROM r),
 c AS (SELECT bin, count(*) FILTER (inside) AS a, count(*) FILTER (NOT inside) AS o FROM b GROUP BY bin) SELECT round(1 - sum(least(a / (SELECT sum(a) FROM c), o / (SELECT sum(o) FROM c))), 6) AS gcnr FROM c""")
def gcnr(spark, d):
    v = cells(spark, d)
    edge = F.broadcast(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum((F.col("x") < 5).cast("long")).alias("n_in"), F.count("*").alias("n")))  # one row
    b = v.crossJoin(edge).withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 32), F.lit(31)))
    c = b.groupBy("bin", "n_in", "n").agg(F.count_if(F.col("x") < 5).alias("a"), F.count_if(F.col("x") >= 5).alias("o"))
    return c.agg(F.round(1 - F.sum(F.least(F.col("a") / F.col("n_in"), F.col("o") / (F.col("n") - F.col("n_in")))), 6).alias("gcnr"))


@query("a11_min_overlap", f"""WITH {V}, q AS (SELECT floor(v / 500) AS e, count(*) FILTER (x < 5) AS a, count(*) FILTER (x >= 5) AS o FROM vol GROUP BY 1),
 r AS (SELECT coalesce(sum(a) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(o) OVER (ORDER BY e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM q) SELECT min(n)::BIGINT AS overlap FROM r""")
def min_overlap(spark, d):
    q = cells(spark, d).groupBy(F.floor(F.col("v") / 500).alias("e")).agg(F.count_if(F.col("x") < 5).alias("a"), F.count_if(F.col("x") >= 5).alias("o"))
    w = Window.orderBy("e")  # a few hundred steps of the threshold, whatever the input
    n = F.coalesce(F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("o").over(w.rowsBetween(0, Window.unboundedFollowing))
    return q.select(n.alias("n")).agg(F.min("n").alias("overlap"))


@query("a16_centroid", f"WITH {V}, p AS (SELECT z, x, y, CASE WHEN v >= 30000 THEN 1 ELSE 0 END AS m FROM vol) SELECT z, floor(sum(x * m) / nullif(sum(m), 0))::BIGINT AS cx, floor(sum(y * m) / nullif(sum(m), 0))::BIGINT AS cy FROM p GROUP BY z")
def centroid(spark, d):
    p = cells(spark, d).withColumn("m", F.when(F.col("v") >= 30000, 1).otherwise(0))
    at = lambda c: F.floor(F.try_divide(F.sum(F.col(c) * F.col("m")), F.sum("m"))).alias(f"c{c}")
    return p.groupBy("z").agg(at("x"), at("y"))


@query("a17_otsu", f"""WITH {V}, l AS (SELECT x, floor((v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) * 255)::BIGINT AS level FROM vol WINDOW p AS (PARTITION BY x)), h AS (SELECT x, level, count(*) AS n FROM l GROUP BY ALL),
 c AS (SELECT x, level, sum(n) OVER u AS w0, sum(n * level) OVER u AS s0, sum(n) OVER (PARTITION BY x) AS w, sum(n * level) OVER (PARTITION BY x) AS s FROM h WINDOW u AS (PARTITION BY x ORDER BY level))
 SELECT x, arg_min(level, (-b, level)) AS threshold FROM (SELECT x, level, CASE WHEN w > w0 THEN round(w0::DOUBLE * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 3) ELSE -1 END AS b FROM c) GROUP BY x""")
def otsu(spark, d):
    p = Window.partitionBy("x")
    level = F.floor((F.col("v") - F.min("v").over(p)) / (F.max("v").over(p) - F.min("v").over(p)) * 255)
    return rel.otsu(cells(spark, d).withColumn("level", level), ["x"], "level")


@query("f27_min_max_8bit", f"WITH {V} SELECT x, y, z, floor((v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) * 255 + 0.5)::BIGINT AS level FROM vol WINDOW p AS (PARTITION BY x)")
def eight_bit(spark, d):
    p = Window.partitionBy("x")
    return cells(spark, d).select("x", "y", "z", F.floor((F.col("v") - F.min("v").over(p)) / (F.max("v").over(p) - F.min("v").over(p)) * 255 + 0.5).alias("level"))


POS = "pos AS (SELECT p_partkey AS id, p_partkey % 50 AS px, p_partkey // 50 % 40 AS py, p_partkey // 2000 AS batch, p_retailprice AS v FROM part)"


def positions(spark, d):
    """Parts as samples on a 50 x 40 grid in batches: (id, px, py, batch, v)."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k % 50).alias("px"), (F.floor(k / 50) % 40).alias("py"), F.floor(k / 2000).alias("batch"), F.col("p_retailprice").alias("v"))


@query("j06_radius_join", f"WITH {POS} SELECT a.id, count(*) AS n, round(sum(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py))), 5) AS total FROM pos a JOIN pos b ON a.batch = b.batch AND (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 6.25 GROUP BY a.id")
def radius(spark, d):
    p = positions(spark, d)
    a = p.select("id", "batch", F.col("px").alias("tx"), F.col("py").alias("ty"))
    b = p.select("batch", F.col("px").alias("sx"), F.col("py").alias("sy"))
    return rel.radius_join(a, b, ["batch"], 2.5).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("d"), 5).alias("total"))


@query("k17_idw_predict", f"""WITH {POS}, s AS (SELECT * FROM pos WHERE id % 3 = 0), t AS (SELECT * FROM pos WHERE id % 3 <> 0), p AS (SELECT t.id, s.v, sqrt((t.px - s.px) * (t.px - s.px) + (t.py - s.py) * (t.py - s.py)) AS d FROM t JOIN s ON t.batch = s.batch)
 SELECT id, round(sum(v / d) / sum(1 / d), 5) AS v, FALSE AS sampled FROM p WHERE d <= 3 GROUP BY id UNION ALL SELECT id, round(v, 5), TRUE FROM s""")
def idw(spark, d):
    p = positions(spark, d)
    s, t = p.where("id % 3 = 0"), p.where("id % 3 <> 0")
    pairs = rel.radius_join(t.select("id", "batch", F.col("px").alias("tx"), F.col("py").alias("ty")), s.select("batch", F.col("px").alias("sx"), F.col("py").alias("sy"), "v"), ["batch"], 3.0)
    found = rel.inverse_distance(pairs, ["id"], "v")
    return found.select("id", F.round("v", 5).alias("v"), F.lit(False).alias("sampled")).unionByName(s.select("id", F.round("v", 5).alias("v"), F.lit(True).alias("sampled")))


@query("j07_pixel_allocate_last", "SELECT l_suppkey % 10 AS x, l_linenumber::BIGINT AS y, max(l_orderkey) AS scan FROM lineitem GROUP BY ALL")
def allocate(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("x"), F.col("l_linenumber").cast("long").alias("y")).agg(F.max("l_orderkey").alias("scan"))


@query("j09_unsampled_cells", f"WITH {POS}, g AS (SELECT x, y FROM (SELECT unnest(range(50)) AS x), (SELECT unnest(range(40)) AS y)) SELECT x, y FROM g WHERE NOT EXISTS (SELECT 1 FROM pos WHERE id % 7 = 0 AND px = x AND py = y)")
def unsampled(spark, d):
    grid = spark.range(50).select(F.col("id").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    taken = positions(spark, d).where("id % 7 = 0").select(F.col("px").alias("x"), F.col("py").alias("y"))
    return grid.join(taken, ["x", "y"], "left_anti")


@query("w14_overlap_weights", f"""WITH {POS}, b AS (SELECT b1.k AS bx, b2.k AS by_ FROM (SELECT unnest(range(0, 41, 5)) AS k) b1, (SELECT unnest(range(0, 31, 5)) AS k) b2)
 SELECT id, bx, by_, 1.0 / count(*) OVER (PARTITION BY id) AS weight FROM pos JOIN b ON px >= bx AND px < bx + 10 AND py >= by_ AND py < by_ + 10""")
def overlap_weights(spark, d):
    """Positions beside the batches of 10 x 10 cells, 5 apart, that cover them; the weights of a position add up to one."""
    return rel.overlap_weights(positions(spark, d), "px", "py", 50, 40, 10, 5).select("id", "bx", "by_", "weight")


@query("a26_mosaic_sum", "WITH t AS (SELECT l_suppkey % 4 * 5 + l_partkey % 8 AS gx, l_linenumber * 3 + l_orderkey % 6 AS gy, l_quantity AS v FROM lineitem) SELECT gx, gy, sum(v) AS v, count(*) AS n FROM t GROUP BY gx, gy")
def mosaic(spark, d):
    """Tiles of 8 x 6 pixels at origins 5 and 3 apart, summed on the global grid."""
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4 * 5 + F.col("l_partkey") % 8).alias("gx"), (F.col("l_linenumber") * 3 + F.col("l_orderkey") % 6).alias("gy"), F.col("l_quantity").alias("v"))
    return t.groupBy("gx", "gy").agg(F.sum("v").alias("v"), F.count("*").alias("n"))


@query("k36_mosaic_weighted", """WITH t AS (SELECT l_suppkey % 4 AS tx, l_linenumber AS ty, l_partkey % 8 AS px, l_orderkey % 6 AS py, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
 w AS (SELECT tx * 5 + px AS gx, ty * 3 + py AS gy, v, least(1, (px + 1) / 3.0, (8 - px) / 3.0) * least(1, (py + 1) / 3.0, (6 - py) / 3.0) AS w FROM t) SELECT gx, gy, round(sum(v * w) / sum(w), 6) AS v FROM w GROUP BY gx, gy""")
def mosaic_weighted(spark, d):
    li = table(spark, d, "lineitem")
    t = li.groupBy((F.col("l_suppkey") % 4).alias("tx"), F.col("l_linenumber").alias("ty"), (F.col("l_partkey") % 8).alias("px"), (F.col("l_orderkey") % 6).alias("py")).agg(F.avg("l_quantity").alias("v"))
    ramp = lambda c, n: F.least(F.lit(1.0), (F.col(c) + 1) / 3.0, (n - F.col(c)) / 3.0)
    w = t.withColumn("w", ramp("px", 8) * ramp("py", 6))
    return w.groupBy((F.col("tx") * 5 + F.col("px")).alias("gx"), (F.col("ty") * 3 + F.col("py")).alias("gy")).agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6).alias("v"))


@query("w09_area_mean", f"""WITH {HALVES} SELECT a.x, a.y, round(sum(b.r * CASE WHEN a.x = b.x AND a.y = b.y THEN 4 WHEN a.x = b.x OR a.y = b.y THEN 2 ELSE 1 END) / 16, 5) AS v FROM h a JOIN h b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y""")
def area_mean(spark, d):
    """3 x 3 weighted mean, zero outside: each pixel is dealt to its nine neighbours, so cells meet by equal keys."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((2 - abs(i)) * (2 - abs(j))).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    h = halves(spark, d)
    spread = h.select("x", "y", "r", F.explode(steps).alias("s")).select((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), (F.col("r") * F.col("s.w")).alias("p"))
    return spread.groupBy("x", "y").agg(F.round(F.sum("p") / 16, 5).alias("v")).join(h.select("x", "y"), ["x", "y"], "left_semi")


@query("f45_energy_split", """WITH p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 97) / 7.0 AS y FROM customer), c AS (SELECT id, x, y, floor(x) + a AS cx, floor(y) + b AS cy FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
 d AS (SELECT *, sqrt(pow(cx - x, 2) + pow(cy - y, 2)) AS d FROM c) SELECT id, cx::BIGINT AS cx, cy::BIGINT AS cy, round(CASE WHEN min(d) OVER p = 0 THEN (d = 0)::INT ELSE 1 / d / sum(1 / nullif(d, 0)) OVER p END, 6) AS share FROM d WINDOW p AS (PARTITION BY id)""")
def energy_split(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), ((F.col("c_custkey") % 97) / 7.0).alias("y"))
    c = rel.bilinear_cells(p, "x", "y")
    w = Window.partitionBy("id")
    share = F.when(F.min("d").over(w) == 0, (F.col("d") == 0).cast("double")).otherwise(1 / F.nullif(F.col("d"), F.lit(0.0)) / F.sum(1 / F.nullif(F.col("d"), F.lit(0.0))).over(w))
    return c.select("id", "cx", "cy", F.round(share, 6).alias("share"))


@query("k24_saft_backproject", f"""WITH {T}, a AS (SELECT vec_id, vec_id % 40 AS sx, z, v FROM tr), g AS (SELECT gx, gz FROM (SELECT unnest(range(0, 40, 4)) AS gx), (SELECT unnest(range(1, 20, 2)) AS gz)),
 t AS (SELECT gx, gz, vec_id, floor(2 * sqrt((gx - sx) * (gx - sx) * 0.25 + gz * gz) + 0.5) AS tau FROM g, (SELECT DISTINCT vec_id, sx FROM a)) SELECT gx, gz, round(sum(v), 6) AS v FROM t JOIN a ON a.vec_id = t.vec_id AND a.z = t.tau GROUP BY gx, gz""")
def saft(spark, d):
    """Delay and sum: the travel time from a place to a pixel picks one sample. Traces of one of the 40 places add up first, so few rows meet."""
    a = traces(spark, d).groupBy((F.col("vec_id") % 40).alias("sx"), "z").agg(F.sum("v").alias("v"))
    pixels = F.array(*[F.struct(F.lit(x).cast("long").alias("gx"), F.lit(z).cast("long").alias("gz")) for x in range(0, 40, 4) for z in range(1, 20, 2)])
    t = a.select("sx").distinct().withColumn("p", F.explode(pixels)).select("sx", "p.*")
    tau = F.floor(2 * F.sqrt(F.pow(F.col("gx") - F.col("sx"), 2) * 0.25 + F.col("gz") * F.col("gz")) + 0.5).cast("int")
    return t.withColumn("z", tau).join(a, ["sx", "z"]).groupBy("gx", "gz").agg(F.round(F.sum("v"), 6).alias("v"))


@query("j04_pair_lag_variogram", f"""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v FROM embeddings),
 p AS (SELECT a.label, floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 0.05)::BIGINT AS bin, pow(a.v - b.v, 2) AS q, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id > b.vec_id)
 SELECT label, bin, count(*) AS n, round(avg(q) / 2, 6) AS gamma FROM p WHERE d <= 0.3 GROUP BY label, bin""")
def pair_variogram(spark, d):
    """All pairs of one class within a lag limit, compared block by block and never as rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyv")])
    p = variogram.pair_lags(e, "label", 0.3, 0.05)
    return p.select("label", "bin", "n", F.round(F.col("total") / F.col("held") / 2, 6).alias("gamma"))

"""Queries beyond the measured-data operators: grouping sets, ranking, outer joins, sessions, approximate counts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandline.operators import relational as rel
from strandline.plans.registry import S, V, cells, query, series, table

_SUMS = "count(*) AS n, round(sum(l_quantity), 2) AS quantity"


def _grouped(df):
    return df.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_rollup", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return _grouped(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query("ext_cube", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return _grouped(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus"))


@query("ext_grouping_sets", f"SELECT l_returnflag, l_linenumber, {_SUMS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
def grouping_sets(spark, d):
    li = table(spark, d, "lineitem")
    return _grouped(li.groupingSets([[F.col("l_returnflag")], [F.col("l_linenumber")], []], F.col("l_returnflag"), F.col("l_linenumber")))


@query("ext_rank", """SELECT c_custkey, ntile(4) OVER w AS quarter, rank() OVER w AS rank, round(percent_rank() OVER w, 6) AS percent, round(cume_dist() OVER w, 6) AS share
 FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
def rank(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.rank().over(w).alias("rank"), F.round(F.percent_rank().over(w), 6).alias("percent"), F.round(F.cume_dist().over(w), 6).alias("share"))


@query("ext_full_outer", """WITH a AS (SELECT l_quantity::BIGINT % 60 AS bin, count(*) AS n_a FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 40 GROUP BY 1),
 b AS (SELECT l_quantity::BIGINT % 60 AS bin, count(*) AS n_b FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 GROUP BY 1)
 SELECT bin, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (bin)""")
def full_outer(spark, d):
    li = table(spark, d, "lineitem").withColumn("bin", F.col("l_quantity").cast("long") % 60)
    a = li.where("l_returnflag = 'A' and l_quantity < 40").groupBy("bin").agg(F.count("*").alias("n_a"))
    b = li.where("l_returnflag = 'R' and l_quantity > 10").groupBy("bin").agg(F.count("*").alias("n_b"))
    return a.join(b, "bin", "full").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")])


@query("ext_session", f"""WITH {S}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY i) < 21600 THEN 0 ELSE 1 END AS new FROM s),
 k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS session FROM g)
 SELECT user_id, session::BIGINT AS session, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM k GROUP BY user_id, session""")
def session(spark, d):
    w = Window.partitionBy("user_id").orderBy("i")
    new = F.when(F.col("t") - F.lag("t").over(w) < 21600, 0).otherwise(1)
    k = series(spark, d).withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return k.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@query("ext_approx_distinct")
def approx_distinct(spark, d):
    """HyperLogLog counts; the sketch is not the same in other engines, so tests bound its error."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("p15_channel", "SELECT event_type AS channel, event_id, value FROM events WHERE event_type = 'click'")
def channel(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").select(F.col("event_type").alias("channel"), "event_id", "value")


@query("a12_roi_growth", f"""WITH {V}, m AS (SELECT x, y, z, v, max(v) OVER (PARTITION BY x, y) AS line FROM vol)
 SELECT x, y, min(z) AS z0, max(z) AS z1, count(*) AS n FROM m WHERE v >= 0.8 * line GROUP BY x, y""")
def roi_growth(spark, d):
    m = cells(spark, d).withColumn("line", F.max("v").over(Window.partitionBy("x", "y")))
    return m.where("v >= 0.8 * line").groupBy("x", "y").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.count("*").alias("n"))


@query("u06_unique_positions", "SELECT DISTINCT l_suppkey % 50 AS x, l_linenumber::BIGINT AS y FROM lineitem WHERE l_discount > 0.05")
def unique_positions(spark, d):
    return table(spark, d, "lineitem").where("l_discount > 0.05").select((F.col("l_suppkey") % 50).alias("x"), F.col("l_linenumber").cast("long").alias("y")).dropDuplicates(["x", "y"])


@query("j14_index_intersection", "SELECT i FROM (SELECT p_size::BIGINT AS i FROM part WHERE p_retailprice < 950 INTERSECT SELECT l_quantity::BIGINT FROM lineitem WHERE l_tax < 0.03)")
def index_intersection(spark, d):
    a = table(spark, d, "part").where("p_retailprice < 950").select(F.col("p_size").cast("long").alias("i"))
    return a.intersect(table(spark, d, "lineitem").where("l_tax < 0.03").select(F.col("l_quantity").cast("long").alias("i")))


@query("j15_four_neighbours", """SELECT c_custkey AS id, floor(c_acctbal / 100)::BIGINT + a AS cx, floor(c_custkey / 7)::BIGINT + b AS cy
 FROM customer, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)""")
def four_neighbours(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("px"), (F.col("c_custkey") / 7).alias("py"))
    return rel.bilinear_cells(c, "px", "py").select("id", "cx", "cy")


@query("j10_scan_defect_product", "SELECT s.s_suppkey AS scan, n.n_nationkey AS defect, round(sqrt(pow(s.s_suppkey - n.n_nationkey, 2) + 25), 6) AS distance FROM supplier s, nation n")
def scan_defect(spark, d):
    """Every scan by the few defects, whose table is of fixed size."""
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("defect")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("scan")).crossJoin(n).withColumn("distance", F.round(F.sqrt(F.pow(F.col("scan") - F.col("defect"), 2) + 25), 6))


@query("s23_defect_source", f"""WITH {V}, h AS (SELECT x, y, z, ((x * 1009 + y * 31 + z) * 1103515245 + 7) % 2147483648 AS h FROM vol)
 SELECT x, y, z, round(0.5 + (h % 1000) / 2000.0, 6)::DOUBLE AS amplitude FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY h, x, y) AS r FROM h) WHERE r <= 6""")
def defects(spark, d):
    """Six positions of each depth of the measured volume without replacement, with amplitudes from 0.5 to 1."""
    h = cells(spark, d).withColumn("key", F.col("x") * 1009 + F.col("y") * 31 + F.col("z")).withColumn("h", rel.portable_hash("key", 7))
    picked = rel.rank_within(h, ["z"], [F.col("h"), F.col("x"), F.col("y")], 6)
    return picked.select("x", "y", "z", F.round(0.5 + (F.col("h") % 1000) / 2000.0, 6).cast("double").alias("amplitude"))


@query("o11_walk_sample", f"""WITH {S}, p AS (SELECT user_id, i, 10 + sum(CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN -1 ELSE 0 END) OVER w AS x,
 10 + sum(CASE WHEN event_id % 5 < 2 THEN 1 ELSE -1 END) OVER w AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
 SELECT DISTINCT user_id, x::BIGINT AS x, y::BIGINT AS y FROM p WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 19""")
def walk_sample(spark, d):
    w = Window.partitionBy("user_id").orderBy("i")
    e = F.col("event_id")
    dx = F.when(e % 3 == 0, 1).when(e % 3 == 1, -1).otherwise(0)
    dy = F.when(e % 5 < 2, 1).otherwise(-1)
    p = series(spark, d).withColumn("dx", dx).withColumn("dy", dy).select("user_id", (10 + F.sum("dx").over(w)).alias("x"), (10 + F.sum("dy").over(w)).alias("y"))
    return p.where("x between 0 and 19 and y between 0 and 19").distinct()


@query("k41_grid_search", f"""WITH {S}, g AS (SELECT a, b FROM (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS a), (SELECT unnest([-20, 0, 20]) AS b)),
 e AS (SELECT user_id, a::DOUBLE AS a, b, round(sqrt(sum(pow(v - (a * i + 200 + b), 2))), 4) AS error FROM s, g GROUP BY user_id, a, b)
 SELECT user_id, arg_min(a, (error, a, b)) AS a, arg_min(b, (error, a, b))::INT AS b, min(error) AS error FROM e GROUP BY user_id""")
def grid_search(spark, d):
    """The twelve parameter pairs are exploded beside each sample: sums are combined before they meet."""
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0.5, 1.0, 1.5, 2.0) for b in (-20, 0, 20)])
    s = series(spark, d).withColumn("g", F.explode(grid)).select("user_id", "i", "v", "g.a", "g.b")
    e = s.groupBy("user_id", "a", "b").agg(F.round(F.sqrt(F.sum(F.pow(F.col("v") - (F.col("a") * F.col("i") + 200 + F.col("b")), 2))), 4).alias("error"))
    best = e.groupBy("user_id").agg(F.min(F.struct("error", "a", "b")).alias("m"))
    return best.select("user_id", "m.a", "m.b", "m.error")


@query("k46_training_rows", """SELECT e.vec_id, e.label, l.k AS bin, round(e.embedding[l.k]::DOUBLE, 6) AS v FROM embeddings e, (SELECT unnest(range(1, 9)) AS k) l WHERE e.label % 2 = 0""")
def training_rows(spark, d):
    e = table(spark, d, "embeddings").where("label % 2 = 0")
    cut = e.select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 8)).alias("p", "v"))
    return cut.select("vec_id", "label", (F.col("p") + 1).cast("long").alias("bin"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query("k49_error_profile", f"""WITH {S} SELECT user_id, k::INT AS offset, round(sqrt(sum(pow(v * (1 + k / 100.0) - v, 2)) / sum(v * v)), 6) AS error FROM s, (SELECT unnest(range(-5, 6)) AS k) GROUP BY user_id, k""")
def error_profile(spark, d):
    s = series(spark, d).withColumn("offset", F.explode(F.sequence(F.lit(-5), F.lit(5))))
    return s.groupBy("user_id", "offset").agg(F.round(F.sqrt(F.sum(F.pow(F.col("v") * (1 + F.col("offset") / 100.0) - F.col("v"), 2)) / F.sum(F.col("v") * F.col("v"))), 6).alias("error"))

"""Queries of filters, joins, sets, sorts and aggregates on trial tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandline.operators import relational as rel
from strandline.plans.registry import query, table


@query("p02_row_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'")
def row_lookup(spark, d):
    return table(spark, d, "customer").where(F.col("c_name") == "Customer#000000042").select("c_custkey", "c_name", "c_acctbal")


@query("p03_trial_semi_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def semi(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi")


@query("p04_trial_anti_filter", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
def anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("p05_not_null", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE m IS NOT NULL")
def not_null(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").where(F.col("m").isNotNull()).select("c_custkey")


ROUTE = "CASE WHEN starts_with(o_orderpriority, '1') THEN 'urgent' WHEN starts_with(o_orderpriority, '2') OR starts_with(o_orderpriority, '3') THEN 'normal' ELSE 'standard' END"


@query("p06_prefix_route", f"SELECT {ROUTE} AS route, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def route(spark, d):
    p = F.col("o_orderpriority")
    r = F.when(p.startswith("1"), "urgent").when(p.startswith("2") | p.startswith("3"), "normal").otherwise("standard")
    return table(spark, d, "orders").groupBy(r.alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("p10_column_elimination", "SELECT x, row_number() OVER (ORDER BY x) - 1 AS dense FROM (SELECT DISTINCT l_suppkey AS x FROM lineitem) WHERE x % 10 NOT IN (3, 7)")
def eliminate(spark, d):
    """Columns left, numbered anew."""
    return rel.numbered(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("x")).where(~(F.col("x") % 10).isin(3, 7)), "x", "dense")


@query("p16_tolerance_match", "SELECT p_partkey FROM part WHERE abs(p_retailprice - 1000.5) <= 1e-8 + 1e-1 * 1000.5 AND abs(p_size - 25) <= 5")
def tolerance(spark, d):
    near = lambda c, v, r, a: F.abs(F.col(c) - v) <= a + r * abs(v)
    return table(spark, d, "part").where(near("p_retailprice", 1000.5, 1e-1, 1e-8) & near("p_size", 25, 0, 5)).select("p_partkey")


@query("p21_signed_region", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity) >= 25 THEN 1 ELSE -1 END AS region FROM lineitem")
def signed(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.abs("l_quantity") >= 25, 1).otherwise(-1).alias("region"))


@query("p22_nested_lookup", "SELECT event_type, list_position(['click', 'view', 'purchase'], event_type) - 1 AS place, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL")
def nested(spark, d):
    names = F.array(*[F.lit(x) for x in ("click", "view", "purchase")])
    e = table(spark, d, "events").withColumn("place", (F.array_position(names, F.col("event_type")) - 1).cast("int")).where("place >= 0")
    return e.groupBy("event_type", "place").agg(F.count("*").alias("n"))


@query("j01_delay_lookup", "SELECT c_custkey, n_name, round(o.total, 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def delay_lookup(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rel.lookup(table(spark, d, "customer"), n, ["c_nationkey"]).join(o, "c_custkey").select("c_custkey", "n_name", "total")


@query("j05_distance_matrix", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(sqrt(pow(a.m - b.m, 2)), 4) AS d FROM (SELECT n_nationkey, avg(c_acctbal) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) a, (SELECT n_nationkey, avg(c_acctbal) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) b WHERE a.n_nationkey < b.n_nationkey")
def distances(spark, d):
    """All distances within one batch: the 25 nations, gathered into one row before they are paired."""
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("m"))
    m = m.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "k", "left_semi")
    batch = m.agg(F.collect_list(F.struct("k", "m")).alias("all"))
    one = batch.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.k < b.k")
    return one.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.round(F.abs(F.col("a.m") - F.col("b.m")), 4).alias("d"))


@query("j08_parameter_grid", """SELECT batch, n_ss, bin, row_number() OVER (ORDER BY batch, n_ss, bin) - 1 AS set_no
 FROM (SELECT DISTINCT p_partkey // 200 AS batch FROM part), (SELECT unnest([1, 2, 4, 8]) AS n_ss), (SELECT unnest([3, 5, 7, 9, 11]) AS bin)""")
def grid(spark, d):
    """Every batch of positions with each subsampling and frequency bin, numbered in order."""
    batches = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 200).alias("batch"))
    return rel.parameter_grid(batches, "batch", n_ss=[1, 2, 4, 8], bin=[3, 5, 7, 9, 11])


@query("j13_lookup_with_default", "WITH t AS (SELECT l_linenumber AS lag, max(l_tax) AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(v, (SELECT max(v) FROM t)) AS v FROM lineitem LEFT JOIN t ON lag = l_linenumber")
def with_default(spark, d):
    li = table(spark, d, "lineitem")
    t = li.where("l_linenumber <= 4").groupBy("l_linenumber").agg(F.max("l_tax").alias("v"))
    top = F.broadcast(t.agg(F.max("v").alias("top")))  # one row
    return li.select("l_orderkey", "l_linenumber").join(t, "l_linenumber", "left").crossJoin(top).select("l_orderkey", "l_linenumber", F.coalesce("v", "top").alias("v"))


@query("j16_as_of", "SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'view' GROUP BY e.event_id")
def as_of(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return rel.as_of(views, buys, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("a03_lag_histogram", "WITH b AS (SELECT unnest(range(0, 12)) AS bin), c AS (SELECT l_linenumber AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin")
def lag_histogram(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(12).withColumnRenamed("id", "bin").join(c, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("a04_ceil_histogram", "SELECT ceil(l_extendedprice / 5000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def ceil_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.ceil(F.col("l_extendedprice") / 5000).alias("bin")).agg(F.count("*").alias("n"))


@query("a06_majority_vote", "SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def majority(spark, d):
    return rel.mode(table(spark, d, "events"), ["user_id"], "event_type")


@query("a07_distinct_in_order", "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type")
def appearance(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_seen"))


@query("a15_mean_power", "WITH p AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS p FROM embeddings) SELECT label, round(avg(p), 6) AS power, count(*) AS n FROM p GROUP BY label")
def mean_power(spark, d):
    p = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(p), 6).alias("power"), F.count("*").alias("n"))


@query("a19_argmax_payload", "SELECT c_nationkey, arg_min(c_name, (-c_acctbal, c_custkey)) AS c_name, max(c_acctbal) AS c_acctbal FROM customer GROUP BY c_nationkey")
def argmax(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", F.struct(-F.col("c_acctbal"), F.col("c_custkey"))).alias("c_name"), F.max("c_acctbal").alias("c_acctbal"))


@query("a20_frequency_table", "SELECT sym, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS sym FROM benchmark) WHERE sym <> '' GROUP BY sym")
def frequency(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.split("text", "")).alias("sym")).where("sym <> ''").groupBy("sym").agg(F.count("*").alias("n"))


@query("a21_duplicate_groups", "SELECT l_partkey, l_suppkey, list(l_orderkey ORDER BY l_orderkey, l_linenumber)::VARCHAR AS at FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("a"))
    return g.where(F.size("a") > 1).select("l_partkey", "l_suppkey", F.concat(F.lit("["), F.array_join(F.transform("a", lambda s: s["l_orderkey"].cast("string")), ", "), F.lit("]")).alias("at"))


@query("a22_duplicate_average", "SELECT l_orderkey, l_linenumber, round(l_quantity / count(*) OVER (PARTITION BY l_partkey, l_suppkey), 6) AS v FROM lineitem")
def duplicate_average(spark, d):
    w = Window.partitionBy("l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / F.count("*").over(w), 6).alias("v"))


@query("a25_monte_carlo_mean", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def monte_carlo(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.count("*").alias("n"))


@query("a27_nan_tolerant_sum", "SELECT user_id, round(sum(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END), 4) AS total FROM events GROUP BY user_id")
def nan_sum(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.nanvl(v, F.lit(None).cast("double"))), 4).alias("total"))


@query("a29_bin_histogram", "SELECT label, k, count(*) AS n FROM (SELECT label, least(greatest(floor((embedding[1]::DOUBLE + 0.5) / 0.1), 0), 9)::BIGINT AS k FROM embeddings) GROUP BY ALL")
def bin_histogram(spark, d):
    k = F.least(F.greatest(F.floor((F.col("embedding")[0].cast("double") + 0.5) / 0.1), F.lit(0)), F.lit(9))
    return table(spark, d, "embeddings").groupBy("label", k.alias("k")).agg(F.count("*").alias("n"))


@query("a31_sum_rate", "SELECT l_suppkey, round(log2(1 + sum(l_quantity) FILTER (l_linenumber = 1) / (sum(l_quantity) - sum(l_quantity) FILTER (l_linenumber = 1) + 1)), 6) AS rate FROM lineitem GROUP BY l_suppkey")
def sum_rate(spark, d):
    own = F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.log2(1 + own / (F.sum("l_quantity") - own + 1)), 6).alias("rate"))


@query("a32_step_size", "SELECT event_type, round((max(value) - min(value)) / 256, 9) AS step FROM events GROUP BY event_type")
def step_size(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round((F.max("value") - F.min("value")) / 256, 9).alias("step"))


@query("a33_trimmed_mean", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events WHERE event_id <> 63 GROUP BY event_type")
def trimmed(spark, d):
    return table(spark, d, "events").where("event_id <> 63").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("a34_mean_relative_threshold", "SELECT l_suppkey, round(avg(l_discount), 6) AS e FROM lineitem GROUP BY l_suppkey HAVING avg(l_discount) > 1.01 * (SELECT avg(l_discount) FROM lineitem)")
def mean_threshold(spark, d):
    li = table(spark, d, "lineitem")
    mean = F.broadcast(li.agg(F.avg("l_discount").alias("m")))  # one row
    return li.groupBy("l_suppkey").agg(F.avg("l_discount").alias("e")).crossJoin(mean).where(F.col("e") > 1.01 * F.col("m")).select("l_suppkey", F.round("e", 6).alias("e"))


@query("w11_rank_polar", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS r FROM part")
def rank_polar(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_retailprice", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("r"))


@query("w12_first_occurrence", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_occurrence(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f")).select("l_partkey", "l_suppkey", "f.*")


@query("w17_bit_positions", "SELECT item_id, p, sum(len) OVER (PARTITION BY item_id ORDER BY p)::BIGINT AS upto FROM (SELECT item_id, generate_subscripts(w, 1) AS p, length(unnest(w)) AS len FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))")
def bit_positions(spark, d):
    w = Window.partitionBy("item_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    return b.select("item_id", (F.col("p") + 1).cast("long").alias("p"), F.sum(F.char_length("w")).over(w).alias("upto"))


@query("o01_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").select("c_custkey", "c_name")


@query("o02_natural_sort", "SELECT c_custkey, dense_rank() OVER (ORDER BY regexp_extract(c_name, '([0-9]+)', 1)::BIGINT) AS place FROM customer")
def natural(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).cast("long").alias("number"))
    return c.join(rel.numbered(c, "number", "place"), "number").select("c_custkey", (F.col("place") + 1).alias("place"))


@query("o03_head_slice", "SELECT event_id, value FROM events WHERE event_id < 100")
def head(spark, d):
    return table(spark, d, "events").where("event_id < 100").select("event_id", "value")


@query("o04_top1_nearest", "SELECT c_nationkey, arg_min(c_custkey, (abs(c_acctbal - 1000), c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey")
def top1(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(F.abs(F.col("c_acctbal") - 1000), F.col("c_custkey"))).alias("c_custkey"))


@query("o07_uniform_cells", """SELECT batch, x, y FROM (SELECT p_partkey // 2000 AS batch, p_partkey % 50 AS x, p_partkey // 50 % 40 AS y,
 row_number() OVER (PARTITION BY p_partkey // 2000 ORDER BY (p_partkey * 1103515245 + 11) % 2147483648, p_partkey) AS r FROM part) WHERE r <= 100""")
def uniform_cells(spark, d):
    """A hundred cells of each batch without replacement; a smaller batch gives all it has."""
    k = F.col("p_partkey")
    cells = table(spark, d, "part").select(k, F.floor(k / 2000).alias("batch"), (k % 50).alias("x"), (F.floor(k / 50) % 40).alias("y"))
    return rel.rank_within(cells, ["batch"], [rel.portable_hash("p_partkey", 11), k], 100).select("batch", "x", "y")


@query("u01_concat", "SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def concat(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")))


@query("u02_distinct_rows", "SELECT DISTINCT l_suppkey % 50 AS x, l_partkey % 40 AS y FROM lineitem")
def distinct(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("x"), (F.col("l_partkey") % 40).alias("y")).distinct()


@query("u03_set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 1")
def difference(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_linenumber = 1").select("l_partkey"))


@query("u04_set_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def intersection(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(li.where("l_linestatus = 'O'").select("l_partkey"))


@query("u05_upsert", "SELECT c_custkey AS k, coalesce(n.v, c_acctbal) AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def upsert(spark, d):
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return rel.upsert(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), new, "k")

"""Queries of column formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import acoustics as ac, geometry as geo
from strandline.plans.registry import query, table


def _part(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("f"), ((F.col("p_partkey") % 201 - 100) / 100.0).alias("x"), (F.col("p_size") * 1.0).alias("h"))


P = "p AS (SELECT p_partkey AS id, p_retailprice AS f, (p_partkey % 201 - 100) / 100.0::DOUBLE AS x, p_size * 1.0::DOUBLE AS h FROM part)"


@query("f01_decibel", f"WITH {P} SELECT id, round(20 * log10(abs(f + pow(10, -57.0 / 20))), 6) AS db FROM p")
def decibel(spark, d):
    return _part(spark, d).select("id", F.round(ac.decibel(F.col("f")), 6).alias("db"))


@query("f02_bark", f"WITH {P} SELECT id, round(6 * asinh(f / 600), 6) AS bark, round(600 * sinh(6 * asinh(f / 600) / 6), 4) AS back, round_even(6 * asinh(f / 600) / 0.5, 0)::BIGINT AS band FROM p")
def bark(spark, d):
    b = ac.bark(F.col("f"))
    return _part(spark, d).select("id", F.round(b, 6).alias("bark"), F.round(ac.hertz(b), 4).alias("back"), F.rint(b / 0.5).cast("long").alias("band"))


@query("f04_mulaw", f"WITH {P}, y AS (SELECT id, x, sign(x) * ln(1 + 255 * abs(x)) / ln(256) AS y FROM p) SELECT id, round(y, 6) AS y, round(sign(y) * (pow(256, abs(y)) - 1) / 255, 6) AS back FROM y")
def mulaw(spark, d):
    y = ac.compress(F.col("x"))
    return _part(spark, d).select("id", F.round(y, 6).alias("y"), F.round(ac.expand(y), 6).alias("back"))


@query("f05_quantise", f"WITH {P} SELECT id, greatest(-128, least(127, round_even(x / 0.0071, 0)))::INT AS q, round(greatest(-128, least(127, round_even(x / 0.0071, 0))) * 0.0071, 6) AS back FROM p")
def quantise(spark, d):
    q = ac.quantise(F.col("x"), 0.0071)
    return _part(spark, d).select("id", q.alias("q"), F.round(q * 0.0071, 6).alias("back"))


@query("f06_log_step", f"WITH {P} SELECT id, greatest(round_even(4 * log2(f / 950), 0), 0) AS q, round(pow(2, greatest(round_even(4 * log2(f / 950), 0), 0) / 4), 6) AS back FROM p")
def log_step(spark, d):
    q = ac.log_step(F.col("f") / 950)
    return _part(spark, d).select("id", q.alias("q"), F.round(F.pow(F.lit(2.0), q / 4), 6).alias("back"))


@query("f34_quiet_threshold", f"WITH {P} SELECT id, round(greatest(-20, least(160, 3.64 * pow(f / 1000, -0.8) - 6.5 * exp(-0.6 * pow(f / 1000 - 3.3, 2)) + 0.001 * pow(f / 1000, 4))), 6) AS db FROM p")
def quiet(spark, d):
    return _part(spark, d).select("id", F.round(ac.quiet_threshold(F.col("f")), 6).alias("db"))


@query("k35_bark_masking", f"""WITH {P}, b AS (SELECT floor(6 * asinh(f / 600) / 0.5)::BIGINT AS band, sum(f) AS e FROM p GROUP BY 1), m AS (SELECT j.band, pow(sum(pow(i.e * pow(10, (CASE WHEN j.band < i.band THEN 27 * (j.band - i.band) * 0.5 ELSE -12 * (j.band - i.band) * 0.5 END - 23.5) / 10), 0.8)), 1 / 0.8) AS m FROM b i, b j WHERE abs(i.band - j.band) <= 40 GROUP BY j.band)
 SELECT band, round(m, 4) AS masked FROM m""")
def masking(spark, d):
    """Energies by half-Bark band, spread over the bands; a few dozen bands, whatever the input."""
    p = _part(spark, d).groupBy(F.floor(ac.bark(F.col("f")) / 0.5).alias("band")).agg(F.sum("f").alias("e"))
    spread = p.withColumn("to", F.explode(F.sequence(F.col("band") - 40, F.col("band") + 40)))
    part = F.pow(F.col("e") * F.pow(F.lit(10.0), ac.spreading((F.col("to") - F.col("band")) * 0.5) / 10), F.lit(0.8))
    m = spread.groupBy("to").agg(F.pow(F.sum(part), F.lit(1 / 0.8)).alias("m"))
    return m.join(p.select(F.col("band").alias("to")), "to", "left_semi").select(F.col("to").alias("band"), F.round("m", 4).alias("masked"))


@query("f10_polar", f"WITH {P} SELECT id, round(sqrt(x * x + h * h), 6) AS r, round(degrees(atan2(h, x)), 6) AS phi, round(0.8660254037844387 * x - 0.49999999999999994 * h, 6) AS rx, round(0.49999999999999994 * x + 0.8660254037844387 * h, 6) AS ry FROM p")
def polar(spark, d):
    rx, ry = geo.rotate(F.col("x"), F.col("h"), 30.0)
    return _part(spark, d).select("id", F.round(F.hypot("x", "h"), 6).alias("r"), F.round(F.degrees(F.atan2("h", "x")), 6).alias("phi"), F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"))


@query("f12_lag_limit", f"WITH {P} SELECT id, CASE WHEN sqrt(x * x + h * h) <= 20 AND degrees(atan2(h, x)) <= 91 THEN round(sqrt(x * x + h * h), 6) END AS r, round_even(h / 3.0, 0)::BIGINT AS lag FROM p")
def lag_limit(spark, d):
    r = F.hypot("x", "h")
    return _part(spark, d).select("id", F.when((r <= 20) & (F.degrees(F.atan2("h", "x")) <= 91), F.round(r, 6)).alias("r"), geo.to_tolerance(F.col("h"), 3.0).alias("lag"))


@query("f14_density_variogram", f"WITH {P} SELECT id, round(exp(-pow((x - 0.1) / 0.4, 2) / 2) / (0.4 * sqrt(2 * pi())), 6) AS density, round(2.5 * (1 - exp(-h * h / 400)), 6) AS gamma FROM p")
def density(spark, d):
    return _part(spark, d).select("id", F.round(geo.normal_density(F.col("x"), 0.1, 0.4), 6).alias("density"), F.round(geo.gaussian_variogram(F.col("h"), 2.5, 20.0), 6).alias("gamma"))


@query("f15_gabor_pulse", f"WITH {P} SELECT id, round(exp(-1.5 * pow(h / 10 - x, 2)) * cos(2 * pi() * 0.7 * (h / 10 - x) + 0.3), 6) AS pulse FROM p")
def gabor(spark, d):
    return _part(spark, d).select("id", F.round(geo.gabor(F.col("h") / 10, F.col("x"), 0.7, 1.5, 0.3), 6).alias("pulse"))


@query("f17_travel_time", f"WITH {P} SELECT id, CASE WHEN abs(x * 20) <= tan(radians(25)) * h THEN round(2 * sqrt(x * 20 * x * 20 + h * h) / 5.9, 6) END AS tau, round(exp(-pow(x * 20, 2) / pow(tan(radians(25)) * h, 2)), 6) AS weight FROM p")
def travel(spark, d):
    return _part(spark, d).select("id", F.round(geo.travel_time(F.col("x") * 20, F.col("h"), 5.9, 25.0), 6).alias("tau"), F.round(geo.apodization(F.col("x") * 20, F.col("h"), 25.0), 6).alias("weight"))


@query("f24_shrink_clamp", f"WITH {P} SELECT id, round(sign(x) * greatest(abs(x) - 0.25, 0), 6) AS shrunk, round(greatest(-0.5, least(0.5, x)), 6) AS clamped, round(CASE WHEN abs(x) <= 0.1 THEN x / 0.1 ELSE sign(x) * (1 + log10(abs(x) / 0.1)) END, 6) AS slog FROM p")
def shrink(spark, d):
    x = F.col("x")
    return _part(spark, d).select("id", F.round(geo.soft_threshold(x, 0.25), 6).alias("shrunk"), F.round(geo.clamp(x, 0.5), 6).alias("clamped"), F.round(geo.symmetric_log(x, 0.1), 6).alias("slog"))


@query("f29_modular_shift", "SELECT p_partkey AS id, ((p_partkey % 50 - 60) % 50 + 50) % 50 AS x, ((p_partkey // 50 + 7) % 40) AS y FROM part")
def shift(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.pmod(k % 50 - 60, F.lit(50)).alias("x"), F.pmod(F.floor(k / 50) + 7, F.lit(40)).alias("y"))


@query("f33_water_filling", """WITH g AS (SELECT c_custkey AS id, 0.1 + abs(c_acctbal) / 1000 AS gain FROM customer), m AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS mu)
 SELECT id, mu, round(CASE WHEN gain > mu THEN (gain - mu) / (gain * mu) ELSE 0 END, 6)::DOUBLE AS power FROM g, m""")
def water(spark, d):
    """Power of each channel under three water levels, 1 / mu: the level less the channel's noise, never below zero."""
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (0.1 + F.abs("c_acctbal") / 1000).alias("gain"), F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("mu"))
    return g.select("id", "mu", F.round(F.greatest(1 / F.col("mu") - 1.0 / F.col("gain"), F.lit(0.0)), 6).alias("power"))


@query("f38_padded_ids", "SELECT c_custkey, printf('%03d', c_custkey) AS padded, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS short FROM customer")
def padded(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.format_string("%03d", k).alias("padded"), F.lpad((k % 1000).cast("string"), 3, "0").alias("short"))


@query("f39_date_strings", "SELECT event_id, strftime(ts, '%y%m%d') AS day, strftime(ts, '%Y%m%d_%Hh%Mm%Ss') AS stamp FROM events")
def dates(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyMMdd").alias("day"), F.date_format("ts", "yyyyMMdd_HH'h'mm'm'ss's'").alias("stamp"))


@query("f40_duration_text", "SELECT event_id, CASE WHEN value < 60 THEN printf('%.1f s', value) WHEN value < 3600 THEN printf('%.1f min', value / 60) ELSE printf('%.1f h', value / 3600) END AS text FROM events WHERE event_id % 1 = 0 AND abs(value * 10 - floor(value * 10) - 0.5) > 0.01 AND abs(value / 6 - floor(value / 6) - 0.5) > 0.01")
def durations(spark, d):
    """Halves that printf rounds differently on the two engines are left out by value, in both."""
    v = F.col("value")
    clear = lambda c: F.abs(c - F.floor(c) - 0.5) > 0.01
    text = F.when(v < 60, F.format_string("%.1f s", v)).when(v < 3600, F.format_string("%.1f min", v / 60)).otherwise(F.format_string("%.1f h", v / 3600))
    return table(spark, d, "events").where(clear(v * 10) & clear(v / 6)).select("event_id", text.alias("text"))


@query("f41_number_in_parentheses", "SELECT event_id, coalesce(try_cast(regexp_extract(s, '\\(([^)]*)\\)', 1) AS INT), 0) AS n FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tile (' || event_id % 64 || ')' ELSE 'tile (x)' END AS s FROM events)")
def parentheses(spark, d):
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tile ("), (F.col("event_id") % 64).cast("string"), F.lit(")"))).otherwise("tile (x)")
    return table(spark, d, "events").select("event_id", F.coalesce(F.regexp_extract(s, r"\(([^)]*)\)", 1).try_cast("int"), F.lit(0)).alias("n"))


@query("f43_bit_pack", "SELECT p_partkey, rpad(lpad(bin(p_size), 6, '0'), 8, '0') AS bits, lpad(hex((p_size * 4) % 256), 2, '0') AS byte FROM part")
def bits(spark, d):
    b = F.rpad(F.lpad(F.bin("p_size"), 6, "0"), 8, "0")
    return table(spark, d, "part").select("p_partkey", b.alias("bits"), F.lpad(F.conv(b, 2, 16), 2, "0").alias("byte"))


@query("f44_density", "SELECT l_suppkey, round(count(*) / pow(50 * 0.5 / 1.26, 2), 6) AS density FROM lineitem GROUP BY l_suppkey")
def sample_density(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.count("*") / (50 * 0.5 / 1.26) ** 2, 6).alias("density"))


@query("f46_map_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS code FROM events")
def map_lookup(spark, d):
    codes = F.create_map(*[F.lit(x) for pair in (("click", 1), ("view", 2), ("purchase", 3)) for x in pair])
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit(0)).alias("code"))


@query("f47_json_props", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("f47_json_payload", """SELECT user_id, '{"time":' || max(event_id) || ',"classes":[' || string_agg('{"name":"' || event_type || '","n":' || n || '}', ',' ORDER BY event_type) || ']}' AS payload FROM (SELECT user_id, event_type, count(*) AS n, max(event_id) AS event_id FROM events GROUP BY ALL) GROUP BY user_id""")
def payload(spark, d):
    n = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.max("event_id").alias("e"))
    return n.groupBy("user_id").agg(F.to_json(F.struct(F.max("e").alias("time"), F.array_sort(F.collect_list(F.struct("name", "n"))).alias("classes"))).alias("payload"))

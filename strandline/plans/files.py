"""Queries that write a table in another format and read it again: the rows must come back unchanged."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandline.functions.encoding import int16_bytes, wave_bytes
from strandline.operators.mosaic import TILE, Layout, stitch
from strandline.plans.registry import query, table
from strandline.sources import readers
from strandline.sources.shared import new_folder, write_files


@query("s05_csv_projection", "SELECT round(epoch_us(ts) / 1e6, 6) AS t, value AS sync FROM events")
def csv_projection(spark, d):
    from strandline.plans.registry import micros

    path = new_folder(spark, "csv")
    table(spark, d, "events").select((micros(F.col("ts")) / 1e6).alias("Time_s"), F.col("value").alias("sync"), "event_type").write.option("header", True).csv(path)
    return readers.logger_csv(spark, path, ["sync"])


@query("s07_csv_metadata", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_metadata(spark, d):
    path, c = new_folder(spark, "meta"), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    c.write.option("header", True).csv(path)
    return spark.read.schema(c.schema).option("header", True).csv(path)


@query("s08_traces_by_set", "SELECT vec_id, label, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE label = 3")
def traces_by_set(spark, d):
    """One row a trace, a folder for each label: the filter on the label reads one folder."""
    path = new_folder(spark, "traces")
    table(spark, d, "embeddings").select("vec_id", "label", "embedding").write.partitionBy("label").parquet(path)
    one = spark.read.parquet(path).where("label = 3")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return one.select("vec_id", F.col("label").cast("int").alias("label"), F.size("embedding").alias("n"), F.round(total, 5).alias("total"))


@query("s09_text_dump", "SELECT p_partkey::DOUBLE AS k, p_size::DOUBLE AS size FROM part")
def dump(spark, d):
    path = new_folder(spark, "dump")
    table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", "p_size")).write.text(path)
    return readers.text_dump(spark, path).select(F.col("v")[0].alias("k"), F.col("v")[1].alias("size"))


@query("s10_json_parameters", "SELECT n_name AS name, n_nationkey::DOUBLE AS magnitude, 'm' AS unit FROM nation")
def json_parameters(spark, d):
    path = new_folder(spark, "json")
    entry = F.map_from_arrays(F.array("n_name"), F.array(F.struct(F.col("n_nationkey").cast("double").alias("magnitude"), F.lit("m").alias("unit"))))
    table(spark, d, "nation").repartition(5, "n_nationkey").select(F.to_json(entry)).write.text(path)
    text = spark.read.text(path)
    return text.select(F.explode(F.from_json("value", "map<string,struct<magnitude:double,unit:string>>")).alias("name", "p")).select("name", "p.magnitude", "p.unit")


@query("s12_codec_dump", "SELECT item_id, octet_length(encode(text)) AS bytes FROM benchmark")
def codec_dump(spark, d):
    path = new_folder(spark, "codec")
    table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("payload")).write.parquet(path)
    return spark.read.parquet(path).select("item_id", F.octet_length("payload").cast("long").alias("bytes"))


@query("s16_serpentine_files", """SELECT plate, n AS number, (n - 1) // 8 AS "column", CASE WHEN (n - 1) // 8 % 2 = 1 THEN 7 - (n - 1) % 8 ELSE (n - 1) % 8 END AS row
 FROM (SELECT p_partkey // 70 AS plate, p_partkey % 70 + 1 AS n FROM part) WHERE n <= 64""")
def serpentine_files(spark, d):
    """Names of tiles with their place on the plate; numbers beyond the 64 places of a plate are no tiles."""
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(F.format_string("plate-%d/tile (%d).bin", F.floor(k / 70), k % 70 + 1).alias("path"))
    found = readers.grid_files(files, readers.serpentine(spark, 8, 8))
    return found.select(F.regexp_extract("path", "plate-([0-9]+)", 1).cast("long").alias("plate"), "number", "column", "row")


#: A hundred traces are a recording; samples are thousandths, rounded down.
REC = """rec AS (SELECT (vec_id // 100)::VARCHAR AS series, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
 smp AS (SELECT series, frame, k, floor(embedding[k + 1]::DOUBLE * 1000) AS v FROM rec, (SELECT unnest(range(64)) AS k))"""


def _recordings(spark, d):
    """(series, samples): the traces of each hundred ids, one after the other."""
    one = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000))
    e = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).cast("string").alias("series"))
    traces = e.agg(F.sort_array(F.collect_list(F.struct("vec_id", one.alias("s")))).alias("t"))
    return traces.select("series", F.flatten(F.transform("t", lambda t: t["s"])).alias("samples"))


def _raw_files(spark, d) -> str:
    path = new_folder(spark, "raw")
    write_files(_recordings(spark, d).select(F.concat("series", F.lit(".bin")).alias("name"), int16_bytes(F.col("samples")).alias("content")), path)
    return path


def _sidecars(spark, d, path: str) -> None:
    """A text beside each recording that names its start and its end, 0.64 later."""
    start = F.col("vec_id") / 10
    lines = F.concat_ws("\n", F.lit("trial"), F.lit("signal"), F.format_string("start: %.3f", start), F.format_string("end: %.3f", start + 0.64))
    trials = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("vec_id")).agg(F.count("*").alias("n"))
    write_files(trials.select(F.concat(F.col("vec_id").cast("string"), F.lit(".txt")).alias("name"), F.encode(lines, "UTF-8").alias("content")), path)


@query("s01_raw_samples", f"WITH {REC} SELECT series, frame * 64 + k AS i, v FROM smp")
def raw_samples(spark, d):
    return readers.raw_int16(spark, _raw_files(spark, d), "*.bin")


@query("s02_sidecar_duration", """SELECT k::VARCHAR AS series, k / 10.0 AS start, round(k / 10.0 + 0.64, 3)::DOUBLE AS "end", 0.64::DOUBLE AS duration FROM (SELECT DISTINCT vec_id // 100 AS k FROM embeddings)""")
def sidecar_duration(spark, d):
    path = new_folder(spark, "sidecar")
    _sidecars(spark, d, path)
    return readers.sidecar(spark, path)


@query("s03_trial_signals", f"WITH {REC}, n AS (SELECT series, count(*) AS n FROM smp GROUP BY series) SELECT series, frame * 64 + k AS i, round(0.64 * (frame * 64 + k) / n, 6)::DOUBLE AS t, v FROM smp JOIN n USING (series)")
def trial_signals(spark, d):
    path = _raw_files(spark, d)
    _sidecars(spark, d, path)
    found = readers.trial_signals(readers.raw_int16(spark, path, "*.bin"), readers.sidecar(spark, path))
    return found.select("series", "i", F.round("t", 6).alias("t"), "v")


@query("s13_sound_channels", f"WITH {REC} SELECT series, 8000 AS rate, ((frame * 64 + k) % 2)::INT AS channel, (frame * 64 + k) // 2 AS i, v::INT AS v FROM smp")
def sound_channels(spark, d):
    """Recordings as sound files of two channels: even samples are the first, odd ones the second."""
    path = new_folder(spark, "sound")
    write_files(_recordings(spark, d).select(F.concat("series", F.lit(".wav")).alias("name"), wave_bytes(F.col("samples"), 2, 8000).alias("content")), path)
    return readers.sound(spark, path)


@query("s14_xml_tags", "SELECT max(p_size)::VARCHAR AS Width, count(*)::VARCHAR AS Height, max(p_partkey)::VARCHAR AS CountFrames FROM part GROUP BY p_partkey // 50")
def xml_tags(spark, d):
    """A description file for each fifty parts; of a tag that occurs twice the first text counts."""
    path, k = new_folder(spark, "xml"), F.col("p_partkey")
    plates = table(spark, d, "part").groupBy(F.floor(k / 50).alias("plate")).agg(F.max("p_size").alias("w"), F.count("*").alias("h"), F.max(k).alias("n"))
    text = F.format_string("<Info><Width unit='px'>%d</Width><Height>%d</Height>\n<CountFrames>%d</CountFrames><Width>0</Width></Info>", "w", "h", "n")
    write_files(plates.select(F.format_string("%d.xml", "plate").alias("name"), F.encode(text, "UTF-8").alias("content")), path)
    return readers.xml_tags(spark, path, ["Width", "Height", "CountFrames"])


@query("s15_thermal_frames", f"WITH {REC} SELECT series, frame::INT AS frame, (k % 8)::INT AS x, (k // 8)::INT AS y, v FROM smp")
def thermal_frames(spark, d):
    """Recordings as films of 8 x 8 pixels."""
    return readers.thermal(spark, _raw_files(spark, d), 8, 8, "<i2")


def _tiles(files):
    """Frames as tiles, ten in a row of the mosaic."""
    place = [F.floor(F.col("frame") / 10).alias("row"), (F.col("frame") % 10).cast("long").alias("col")]
    return readers.frames(files, 8, 8, "<i2").select("series", *place, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


def _decibels(pixels):
    return pixels.withColumn("v", 20 * F.log10(F.greatest(F.abs("v"), F.lit(1.0)) / 1000))


def _centred(pixels):
    """Each tile less its mean; a tile has a fixed number of pixels."""
    return pixels.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*TILE)))


@query("x02_mosaic_hooks", f"""WITH {REC}, px AS (SELECT series, frame // 10 AS r, frame % 10 AS c, k // 8 AS y, k % 8 AS x, v, avg(v) OVER (PARTITION BY series, frame) AS mean FROM smp),
 w AS (SELECT *, least(1, (x + 1) / 3.0, (8 - x) / 3.0) * least(1, (y + 1) / 3.0, (8 - y) / 3.0) AS w FROM px)
 SELECT 'centred' AS kind, series, r * 6 + y AS gy, c * 6 + x AS gx, round(sum((v - mean) * w) / sum(w), 6) AS v, count(*) AS n FROM w GROUP BY ALL
 UNION ALL SELECT 'decibels', series, r * 6 + y, c * 6 + x, round(sum(20 * log10(CASE WHEN abs(v) < 1 THEN 1 ELSE abs(v) END / 1000)), 6), count(*) FROM w GROUP BY ALL""")
def mosaic_hooks(spark, d):
    """One mosaic of each recording by two processors: tiles less their mean, averaged by weight, and decibels, summed."""
    files, layout = readers.contents(spark, _raw_files(spark, d)), Layout(8, 8, 6, 6)
    centred = stitch(files, _tiles, _centred, layout, layout.ramp(3), average=True).withColumn("kind", F.lit("centred"))
    both = centred.unionByName(stitch(files, _tiles, _decibels, layout).withColumn("kind", F.lit("decibels")))
    return both.withColumn("v", F.round("v", 6))

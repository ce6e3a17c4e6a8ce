"""All queries of the library by name, with their SQL twins."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
MODULES = ("annotate", "signals", "grids", "tables", "formulas", "projections", "kernels", "studies", "streams", "files", "extensions", "labels", "inverse")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query, with the DuckDB statement that gives the same rows."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    whole = F.unix_date(F.to_date(ts)) * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one series for each user: (user_id, i, t, v, event_id, event_type), t in seconds."""
    from strandline.operators.series import number

    e = table(spark, sf_dir, "events")
    d = e.select("user_id", "event_id", "event_type", (micros(F.col("ts")) / 1e6).alias("t"), F.col("value").alias("v"))
    return number(d, "user_id", ["t", "event_id"])


#: The same series in SQL, as a common table expression named s.
S = """s AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a volume: (x, y, z, v), the mean price of each cell."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 10).alias("x"), F.col("l_linenumber").cast("long").alias("y"), (F.col("l_partkey") % 64).alias("z")).agg(F.avg("l_extendedprice").alias("v"))


V = """vol AS (SELECT l_suppkey % 10 AS x, l_linenumber::BIGINT AS y, l_partkey % 64 AS z, avg(l_extendedprice) AS v
  FROM lineitem GROUP BY ALL)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as traces of 64 samples: (vec_id, label, z, v)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("z", "v")).withColumn("v", F.col("v").cast("double"))


T = """tr AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS z, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def _load() -> None:
    for name in MODULES:
        import_module(f"strandline.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Views of the driver's tables as the relations that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by key on as many tasks as a shuffle has: a table of few splits would keep the rest idle where each row is much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, user_id, x = ln(value)."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "event_type", "user_id", F.when(F.col("value") > 0, F.ln("value")).alias("x"))


RESIDUALS = "SELECT event_id, event_type, user_id, CASE WHEN value > 0 THEN ln(value) END AS x FROM events"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """board, channel, toa (microseconds), hit_id."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("hit_id"), F.col("user_id").alias("board"), F.col("event_type").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("toa"), "value")


HITS = "SELECT event_id AS hit_id, user_id AS board, event_type AS channel, epoch_us(ts) AS toa, value FROM events"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relations by order id, joined: a = order total, b = summed line prices."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("a"), F.col("o_orderpriority").alias("grp"))
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.sum("l_extendedprice").alias("b"))
    return o.join(b, "event_id")


PAIRS = """SELECT o_orderkey AS event_id, o_totalprice AS a, o_orderpriority AS grp, b FROM orders
  JOIN (SELECT l_orderkey, sum(l_extendedprice) AS b FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, two detectors' 32 samples and a target."""
    e = read(spark, sf_dir, "embeddings")
    w = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("event_id"), F.slice(w, 1, 32).alias("s1"), F.slice(w, 33, 32).alias("s2"), F.col("label").cast("double").alias("y"))


WAVES = "SELECT vec_id AS event_id, embedding[1:32]::DOUBLE[] AS s1, embedding[33:64]::DOUBLE[] AS s2, label::DOUBLE AS y FROM embeddings"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, -0.0 made 0.0, so that engines compare."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

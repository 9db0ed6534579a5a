"""Small helpers on sessions, scratch tables and columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
NO_ID = -(1 << 63)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="picotick-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/picotick/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: a cut of its lineage."""
    path = scratch(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", ways: int = 16) -> DataFrame:
    """Joins ``right`` (one short row for each key) to ``left``, a key's rows dealt to ``ways`` tasks by ``by``."""
    dealt = left.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    copies = right.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(copies, [key, "_way"], how).drop("_way")


#: Rows up to which a stored table of a few numbers a row is broadcast (some 10 MB).
SHORT = 200_000


def short(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most SHORT rows; beyond, joins with it shuffle."""
    return F.broadcast(table) if table.count() <= SHORT else table


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, although body uses it repeatedly."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The operator's own view of a table: ``doc`` (null ids first), ``text`` as bytes (null: empty)."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def text_hash(col: str = "text") -> Column:
    """64-bit hash of a text, null as empty; tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def id_back(name: str, col: str = "doc") -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col)).alias(name)

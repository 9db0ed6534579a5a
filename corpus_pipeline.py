"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Every stage takes all rows that the one before kept; its result is written as Parquet and
read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picotick.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from picotick.llm._spark import NO_ID, short, stored, text_hash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and least Jaccard similarity of near duplicates, in percent; op10 has settings of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule.

    Row by row: null or repeated ids make no difference, null texts have no words and are rejected, very
    long ones are judged whole, and an empty table gives none.
    """
    return quality_rules.score(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every near-duplicate group, one row of it; a null id is the least.

    Of different texts with that id the one with the least hash stays. Texts without words are
    in no group: of those only rows that repeat id and text go. Very long texts are compared whole;
    an empty table gives none.
    """
    found = jaccard_join.join(docs, width=NEAR_WORDS, percent=NEAR_PERCENT, groups=True)
    # a document is an id and a text hash; m is the number of its rows
    each = stored(found.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.col("tag").alias("_tag"), "root").agg(F.count("*").alias("m")))
    first = each.where("root is not null").groupBy("root").agg(F.min(F.struct("_doc", "_tag")).alias("f")).select("root", "f.*")
    gone = each.where("root is not null").join(first, ["root", "_doc", "_tag"], "left_anti").select("_doc", "_tag")
    again = each.where("m > 1").select("_doc", "_tag")
    named = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), text_hash("text").alias("_tag"))
    apart = stored(gone.withColumn("once", F.lit(False)).unionAll(again.join(gone, ["_doc", "_tag"], "left_anti").withColumn("once", F.lit(True))))
    # while few rows go, their names travel to the texts and not all texts to them
    single = named.join(short(apart), ["_doc", "_tag"], "left_anti")
    once = named.join(short(stored(apart.where("once").drop("once"))), ["_doc", "_tag"], "left_semi").dropDuplicates(["_doc", "_tag"])
    return single.unionByName(once).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated byte strings; a character cut in two becomes U+FFFD.

    Null texts become empty ones, null ids come before all others, and rows that repeat an id are told
    apart by their texts. A very long text is one value, searched whole; an empty table gives none.
    """
    rest = tuple(c for c in COLUMNS if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup.dedup(docs, keep=rest)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", text.alias("text"), *[F.col(f"carried.{c}").alias(c) for c in rest]).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes.

    Null and empty texts have no words and are not taken; a null source is a source; rows that repeat an
    id count each; very long texts are only counted; an empty table gives none.
    """
    copies = mixing.mix(docs, keep=COLUMNS).where("times > 0")
    return copies.select("kept.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024 tokens.

    Null texts have the end token only, null ids stay null, repeated rows are packed each, long texts are
    cut; an empty table gives none.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", drop_rejected),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Tokenizing, suffix sorting and Jaccard groups have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

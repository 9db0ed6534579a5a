"""URL filters: a blocked Bloom filter in front of an exact hash join, all in DataFrame functions.

A list holds canonical entries ``host/path`` with an action. A page's candidate keys are its
host and every parent domain, joined with every path prefix of a length that the list uses.
The Bloom filter (one row, at most ``MAX_BLOCKS`` blocks of 256 bits, so at most 4 MB to
broadcast whatever the list's size) drops the keys that cannot be listed. The few keys that
pass meet the list in an equi-join, which removes false positives; Spark broadcasts the
list only under its own size limit and splits skewed keys of a shuffled join otherwise.

Null URLs and URLs without ``://`` have empty host and path and fit no rule. Ties between
rules of one length cannot occur, because a listed key is unique after ``distinct``; of
contradictory actions for one key, block wins. Null ids and repeated rows are judged row by
row; other columns are ignored; an empty list allows every page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import let

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17
WORDS_PER_BLOCK = 4
PROBES = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> Column:
    """The four words of a key's block with the key's probe bits set."""

    def of(h: Column) -> Column:
        places = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]
        word = lambda w: [F.when(F.shiftright(p, 6) == w, F.expr("1L")).otherwise(F.expr("0L")) for p in places]

        def bits(w: int) -> Column:
            out = F.lit(0).cast("long")
            for p, on in zip(places, word(w), strict=True):
                out = out.bitwiseOR(F.call_function("shiftleft", on, p.bitwiseAND(F.lit(63))))
            return out

        return F.array(*[bits(w) for w in range(WORDS_PER_BLOCK)])

    return let(F.xxhash64(key, F.lit(1)), of)


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks.cast("long")).cast("int")


def bloom(listed: DataFrame) -> DataFrame:
    """One row: ``blocks`` and ``filter``, the words of every block in order.

    The number of blocks follows the list's size up to MAX_BLOCKS; beyond it the filter
    passes more keys but stays as small, and the join stays exact.
    """
    blocks = listed.agg(
        F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.count("*") * BITS_PER_KEY / (64 * WORDS_PER_BLOCK)))).cast("int").alias("blocks")
    )
    keyed = listed.select(_block(F.col("key"), blocks.scalar()).alias("block"), _bits(F.col("key")).alias("b"))
    words = [F.bit_or(F.get("b", F.lit(w))) for w in range(WORDS_PER_BLOCK)]
    used = keyed.groupBy("block").agg(F.array(*words).alias("words"))
    every = blocks.select("blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    empty = F.array(*[F.lit(0).cast("long")] * WORDS_PER_BLOCK)
    held = every.join(used, "block", "left").select("blocks", F.struct("block", F.coalesce("words", empty).alias("words")).alias("held"))
    return held.groupBy("blocks").agg(F.transform(F.sort_array(F.collect_list("held")), lambda x: x["words"]).alias("filter"))


def _passes(key: Column, blocks: Column, bloom_filter: Column) -> Column:
    held = F.get(bloom_filter, _block(key, blocks))
    return F.forall(F.arrays_zip(_bits(key).alias("want"), held.alias("have")), lambda x: x["want"].bitwiseAND(x["have"]) == x["want"])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule`` (longest that fits, or null) and ``verdict``.

    ``rules`` has ``rule`` (``host/path``) and ``action`` (allow or block). Pages that no
    rule fits are allowed.
    """
    listed = (
        rules.where("rule is not null and action is not null")
        .groupBy("rule").agg(F.max("action").alias("action"))
        .select(F.col("rule").alias("key"), "action", F.length(F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)).alias("n_path"))
    )
    lengths = listed.agg(F.array_sort(F.collect_set("n_path")).alias("lengths"))  # a few distinct path lengths
    guard = bloom(listed).select("blocks", "filter", lengths.scalar().alias("lengths"))  # one row
    parsed = pages.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    parents = let(labels, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.concat_ws(".", F.slice(x, i, F.size(x)))))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    keys = let(fitting, lambda ns: F.flatten(F.transform(parents, lambda p: F.transform(ns, lambda n: F.concat(p, F.substring(F.col("path"), F.lit(1), n))))))
    tested = parsed.join(F.broadcast(guard), how="left").select(
        "_id", "_row", "host", "path",
        F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
            F.coalesce(F.filter(keys, lambda k: _passes(k, F.col("blocks"), F.col("filter"))), F.array().cast("array<string>"))).alias("keys"),
    )
    hits = tested.where(F.size("keys") > 0).select("*", F.explode("keys").alias("key"))
    joined = hits.join(listed, "key", "left")
    best = joined.groupBy("_row").agg(
        F.first("_id").alias("_id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("key").alias("n"), "key", "action"))).alias("best"),
    ).select("_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.action"), F.lit("allow")).alias("verdict"))
    rest = tested.where(F.size("keys") == 0).select("_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return best.unionByName(rest).select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")

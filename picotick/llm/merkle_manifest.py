"""Merkle manifest of a dataset, level by level with windows.

Each row is a leaf, the SHA-256 of its fields; each group's leaves form a tree of its own
(``fanout`` wide), and the groups' roots, in order, form the tree above. A field enters as ``-``
if it is null, else as its length in UTF-8 bytes, ``:`` and its value, so no two rows share a
preimage; digests enter as lowercase hex.

Leaves get their place in their group without a global sort in one task: they are sorted by
ranges of (group, id), so a group with a third of all rows lies in many ranges, and the counts
of (range, group) are summed up. A level is then one window by (group, parent's place), whose
ordered full frame is both the parent's preimage and each node's siblings; no window has more
than ``fanout`` rows. Parents are made distinct and are the next level, 1/``fanout`` of the
rows. Proofs come back down the same way: each level's nodes meet their parents' paths in an
equi-join on (group, parent's place), so leaves are joined once, to a table 1/``fanout`` as long.

Null groups are a group, the first; null ids come first in theirs; rows of equal id follow by
their leaf; rows that repeat in every field are leaves each, and which of their places a row gets
makes no difference to the set of results. Very long texts are hashed where they lie and never
move. Columns that are not fields are ignored; columns may have any name. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import partitions, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The table of (range, group) offsets is broadcast up to so many rows (a few MB), and joined otherwise.
MOST_BROADCAST = 20_000


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def preimage(*fields: Column) -> Column:
    """The fields' text: ``-`` for null, else byte count, ``:`` and value."""
    each = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.concat(*each)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give: each step hashes what lies left of the node, the node, and what lies right."""
    return F.aggregate(proof, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def siblings_of(proof: Column) -> Column:
    """The proof's digests, from the leaf's level to the root, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _numbered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds ``at`` (from 0) in each ``grp`` by ``order``, and ``members``, the group's size."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    # ids rise by one within a task, and a task writes what it numbered
    told = stored(ranged.withColumn("_n", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_n", 33)))
    each = told.groupBy("grp", "_range").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    by_range = Window.partitionBy("grp").orderBy("_range")
    ahead = F.coalesce(F.sum("_rows").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_rows").over(Window.partitionBy("grp"))
    offsets = stored(each.select("grp", "_range", (ahead - F.col("_first")).alias("_shift"), whole.alias("members")))
    if offsets.count() <= MOST_BROADCAST:
        offsets = F.broadcast(offsets)
    return told.join(offsets, ["grp", "_range"]).withColumn("at", F.col("_n") + F.col("_shift")).drop("_n", "_range", "_shift")


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (``grp``, ``at``, ``members``, ``h``) with ``up``, the parent's place, ``step`` of their proofs and ``parent``, its digest."""
    run = Window.partitionBy("grp", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = nodes.withColumn("up", F.floor(F.col("at") / fanout).cast("long")).withColumn("run", F.collect_list("h").over(run))
    mine = (F.col("at") % fanout).cast("int")
    step = F.struct(
        F.array_join(F.slice("run", F.lit(1), mine), "").alias("left"),
        F.array_join(F.slice("run", mine + 2, F.lit(fanout)), "").alias("right"),
    )
    alone = F.col("members") == 1  # the group's root already: nothing is hashed
    return placed.withColumn("step", F.when(~alone, step)).withColumn("parent", F.when(alone, F.col("h")).otherwise(digest(F.array_join("run", "")))).drop("run")


def _tree(leaves: DataFrame, fanout: int, above=None) -> DataFrame:
    """Leaves (``grp``, ``at``, ``members``, ``h``, others) with ``top``, their group's root, and ``proof``.

    ``above(tops)`` continues upwards: it takes each group's ``grp`` and ``h`` and returns ``grp``, ``proof`` and ``root``.
    """
    most = leaves.agg(F.max("members")).first()[0] or 1
    levels, nodes = [], leaves
    while True:
        # the first level goes on to carry the rows' other columns; those above are short, and cut off from it
        done = _level(nodes, fanout)
        levels.append(done if not levels else stored(done))
        if most <= fanout:
            break
        most = -(-most // fanout)
        nodes = stored(levels[-1].groupBy("grp", "up").agg(F.first("parent").alias("h"), F.first("members").alias("members"))).select(
            "grp", F.col("up").alias("at"), F.ceil(F.col("members") / fanout).cast("long").alias("members"), "h")
    tops = stored(levels[-1].groupBy("grp").agg(F.first("parent").alias("h")))
    paths = (above(tops) if above else tops.select("grp", F.array().cast(_PROOF).alias("proof"), F.col("h").alias("root"))).join(tops.withColumnRenamed("h", "top"), "grp")
    paths = paths.withColumn("up", F.lit(0).cast("long"))
    for level in reversed(levels):
        own = F.when(F.col("step").isNull(), F.col("proof")).otherwise(F.concat(F.array("step"), F.col("proof")))
        paths = level.join(paths, ["grp", "up"]).withColumn("proof", own).drop("step", "parent", "up")
        if level is not levels[0]:
            paths = paths.select("grp", F.col("at").alias("up"), "proof", "root", "top")
    return paths


_PROOF = "array<struct<left: string, right: string>>"


def manifest(
    df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, *, fanout: int = FANOUT, keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: id, ``leaf``, ``subroot``, ``root``, ``proof`` (array of ``left``, ``right``) and the columns of ``keep``."""
    group = F.col(group_col).cast("string")
    kept = F.struct(*[c.alias(k) for k, c in keep.items()]) if keep else F.lit(0)
    # the mark before a group's name tells a null group from an empty name, and sorts it first
    leaves = df.select(F.coalesce(F.concat(F.lit(":"), group), F.lit("")).alias("grp"), F.col(id_col).alias("id"), digest(preimage(*[F.col(f) for f in fields])).alias("h"), kept.alias("kept"))

    def above(tops: DataFrame) -> DataFrame:
        named = _numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), ("name",))
        return _tree(named, fanout).select(F.col("name").alias("grp"), "proof", "root")

    # stored: the ranges are sampled from the leaves first, which would read and hash all texts twice
    found = _tree(_numbered(stored(leaves), ("id", "h")), fanout, above)
    return found.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), F.col("top").alias("subroot"), "root", "proof", *([F.col(f"kept.{k}").alias(k) for k in keep] if keep else []))

"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the axis it
then points along most is its cross-polytope hash. ``HASHES`` of them name a bucket, in each of
``TABLES`` tables. Every vector lies in its own bucket of a table and also looks into
``PROBES`` others, which the second-best axes name. Two vectors *meet* in a table if one's own
bucket is the other's own or probed one; at cosine 0.9 in 64 dimensions that is 60 % a table,
so 8 tables find over 99.9 % (tests measure recall against brute force).

Equal vectors are one node with a multiplicity. Each pair is verified by its cosine in double
precision in the first table where it meets, which the hash codes that travel along decide, so
links are counted in place: no pair is written out, only a count for each vector and the links
that connect groups inside a bucket. Buckets over ``BLOCK`` entries are split into pairs of
blocks. Vectors that are null, zero or hold null or non-finite components link with nothing,
as do vectors of different lengths; null ids come first; repeated rows are equal vectors;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import Groups, components
from ._spark import NO_ID, id_back, partitions, spread_join, stored
from ._windows import batch

THRESHOLD = 0.9
TABLES, HASHES, PROBES, TURNS = 8, 2, 3, 3
BLOCK = 1024
#: Large buckets (24 bytes each) that are broadcast to the entries; with more, both sides are shuffled.
MOST_BROADCAST = 100_000
SEED = 5
#: Probes to choose from: which of a hash's best axes to take, for the two hashes.
_OPTIONS = ((1, 0), (0, 1), (2, 0), (0, 2), (1, 1), (3, 0), (0, 3))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two)."""
    rows, n = x.shape
    h = 1
    while h < n:
        pairs = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x


def _best_axes(x: np.ndarray, signs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    top = np.argsort(-size, axis=1, kind="stable")[:, :most]
    return 2 * top + (np.take_along_axis(x, top, 1) > 0), np.take_along_axis(size, top, 1)


def codes(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(vector, table, 1 + probes) bucket codes; the first is the vector's own."""
    n, d = vectors.shape
    width = max(4, 1 << (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    r = np.random.default_rng(seed)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        (c0, s0), (c1, s1) = (_best_axes(x, r.choice([-1.0, 1.0], size=(TURNS, width)), 4) for _ in range(HASHES))
        bucket = lambda i, j: c0[:, i] * (2 * width) + c1[:, j]  # noqa: E731, B023
        loss = np.stack([s0[:, 0] - s0[:, i] + s1[:, 0] - s1[:, j] for i, j in _OPTIONS], axis=1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = bucket(0, 0)
        out[:, t, 1:] = np.take_along_axis(np.stack([bucket(i, j) for i, j in _OPTIONS], axis=1), pick, 1)
    return out


def _usable(single: bool):
    """id, the vector's bytes (null if it links with nothing), single or double as it is stored, and its 128-bit signature."""

    def run(batches):
        yield from _checked(batches, "<f4" if single else "<f8")

    return run


def _checked(batches, kind: str):
    for b in batches:
        lists = b.column("vec")
        flat = lists.flatten()
        null = ~flat.is_valid().to_numpy(zero_copy_only=False)
        flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        flat = np.where(null, np.nan, flat)
        size = np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)
        end = np.cumsum(size)
        out = []
        for n, e in zip(size, end, strict=True):
            v = flat[e - n : e] + 0.0
            if not n or not np.isfinite(v).all() or not v.any():
                out.append(None)
                continue
            # a power of two brings the largest component to 0.5..1: cosines stay, and no square under- or overflows
            out.append((np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0).astype(kind).tobytes())
        sig = [v and hashlib.blake2b(v, digest_size=16).digest() for v in out]
        yield batch(id=b.column("id"), vec=pa.array(out, pa.binary()), sig=pa.array(sig, pa.binary()))


_CODED = "g long, m long, vec binary, codes binary, buckets array<struct<t: int, bucket: long, own: boolean>>"


def _doubles(vectors: list[bytes], single: bool) -> np.ndarray:
    """One row a vector, all of one length."""
    return np.frombuffer(b"".join(vectors), dtype="<f4" if single else "<f8").reshape(len(vectors), -1).astype(np.float64)


def _coded(nodes: DataFrame, tables: int, probes: int, single: bool) -> DataFrame:
    kind = pa.list_(pa.struct([("t", pa.int32()), ("bucket", pa.int64()), ("own", pa.bool_())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                vecs = b.column("vec").to_pylist()
                by_length: dict[int, list[int]] = {}
                for i, v in enumerate(vecs):
                    by_length.setdefault(len(v) // (4 if single else 8), []).append(i)
                for d, mine in by_length.items():
                    c = codes(_doubles([vecs[i] for i in mine], single), tables, probes)
                    # vectors of one length meet only their like
                    names = c + (d << 40)
                    own = np.zeros((tables, 1 + probes), dtype=bool)
                    own[:, 0] = True
                    t = np.repeat(np.arange(tables, dtype=np.int32), 1 + probes)
                    n = tables * (1 + probes)
                    entries = pa.StructArray.from_arrays([pa.array(np.tile(t, len(mine))), pa.array(names.ravel()), pa.array(np.tile(own.ravel(), len(mine)))], fields=list(kind.value_type))
                    buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(mine) + 1, n, dtype=np.int32)), entries).cast(kind)
                    part = b.take(pa.array(mine))
                    packed = c.astype("<i4").reshape(len(mine), -1)
                    yield batch(g=part.column("g"), m=part.column("m"), vec=part.column("vec"), codes=pa.array([p.tobytes() for p in packed], pa.binary()), buckets=buckets)

    return nodes.mapInArrow(run, _CODED)


def _bucket_links(rows: DataFrame, threshold: float, tables: int, probes: int, single: bool) -> DataFrame:
    """(a, b, n): n of b's copies link to a (b null), or a and b connect two groups (n null)."""

    def run(batches):
        key, held, found, size = None, [], [], 0
        for b in batches:
            names = [b.column(k).to_pylist() for k in ("t", "bucket", "i", "j", "block", "own", "g", "m", "vec", "codes")]
            for t, bucket, i, j, *row in zip(*names, strict=True):
                if (t, bucket, i, j) != key:
                    got = _links_of(key, held, threshold, tables, probes, single)
                    if got:
                        found.append(got)
                        size += len(got[0])
                    key, held = (t, bucket, i, j), []
                    if size > 50_000:
                        yield _link_batch(found)
                        found, size = [], 0
                held.append(row)
        got = _links_of(key, held, threshold, tables, probes, single)
        if got:
            found.append(got)
        if found:
            yield _link_batch(found)

    return rows.mapInArrow(run, "a long, b long, n long")


def _link_batch(found):
    a, n, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    none_a, none_x = pa.nulls(len(a), pa.int64()), pa.nulls(len(x), pa.int64())
    return batch(a=pa.array(np.concatenate((a, x))), b=pa.concat_arrays([none_a, pa.array(y)]), n=pa.concat_arrays([pa.array(n), none_x]))


def _links_of(key, held, threshold: float, tables: int, probes: int, single: bool):
    """Counts and connecting links of the pairs that this group of a bucket has to settle."""
    if len(held) < 2 or not any(row[1] for row in held):
        return None
    t, bucket, i, j = key
    block, own, g, m = (np.array(c) for c in list(zip(*held, strict=True))[:4])
    x = _doubles([row[4] for row in held], single)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = np.flatnonzero(own)
    near = x[a] @ x.T >= threshold
    p, q = np.nonzero(near)
    p = a[p]
    keep = (g[p] != g[q]) & (~own[q] | (g[p] < g[q]))
    if i != j:
        keep &= block[p] != block[q]
    p, q = p[keep], q[keep]
    if not len(p):
        return None
    c = np.frombuffer(b"".join(row[5] for row in held), dtype="<i4").reshape(len(held), tables, 1 + probes)
    # a pair that looks into each other's buckets is settled in the one of the smaller id
    mutual = (c[p, t, 1:] == c[q, t, :1]).any(axis=1)
    keep = own[q] | ~mutual | (g[p] < g[q])
    p, q = p[keep], q[keep]
    if t and len(p):
        before_p, before_q = c[p, :t], c[q, :t]
        met = (before_p == before_q[:, :, :1]).any(axis=(1, 2)) | (before_q == before_p[:, :, :1]).any(axis=(1, 2))
        p, q = p[~met], q[~met]
    if not len(p):
        return None
    n = np.bincount(p, weights=m[q], minlength=len(held)) + np.bincount(q, weights=m[p], minlength=len(held))
    groups = Groups(len(held))
    links = [(g[u], g[v]) for u, v in zip(p.tolist(), q.tolist(), strict=True) if groups.join(u, v)]
    has = np.flatnonzero(n)
    return g[has], n[has].astype(np.int64), np.array([u for u, _ in links], dtype=np.int64), np.array([v for _, v in links], dtype=np.int64)


def dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Per row: id, ``n_links`` (other vectors linked directly) and ``component_id``."""
    spark = df.sparkSession
    given = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    single = df.schema[vec_col].dataType.simpleString() == "array<float>"  # then doubles carry no more than the stored floats
    rows = stored(given.mapInArrow(_usable(single), "id long, vec binary, sig binary"))
    nodes = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("g"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    # ids may repeat: a node is numbered by its signature if its least id is not its own
    coded = stored(_coded(nodes.select(F.xxhash64("sig").alias("g"), "m", "vec"), tables, probes, single))
    entries = coded.select("g", F.explode("buckets").alias("e")).groupBy("e.t", "e.bucket").agg(F.count("*").alias("n"))
    large = stored(entries.where(F.col("n") > BLOCK).select("t", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if large.count() <= MOST_BROADCAST:  # then vectors are shuffled once, to their buckets
        large = F.broadcast(large)
    spread = coded.select(F.explode("buckets").alias("e"), "g", "m", "vec", "codes").select("e.*", "g", "m", "vec", "codes")
    placed = spread.join(large, ["t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    whole = placed.where("blocks = 1").select("t", "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "block", "own", "g", "m", "vec", "codes")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    split = placed.where("blocks > 1").select("t", "bucket", "block", "own", "g", "m", "vec", "codes", other).select(
        "t", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "g", "m", "vec", "codes")
    groups = whole.unionAll(split).repartition(partitions(spark), "t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j", "g")
    links = stored(_bucket_links(groups, threshold, tables, probes, single))
    roots = components(links.where("b is not null").select("a", "b"))
    counts = links.where("n is not null").groupBy(F.col("a").alias("g")).agg(F.sum("n").alias("n"))
    named = nodes.select("sig", F.xxhash64("sig").alias("g"), F.col("g").alias("least"), "m")
    placed = named.join(counts, "g", "left").join(roots, named["g"] == roots["node"], "left").select(
        "sig", "least", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "g").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    known = spread_join(placed, least, "root", "sig").select("sig", "n", "component")
    linked = rows.where("sig is not null").join(known, "sig").select("id", "n", "component")
    alone = rows.where("sig is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return linked.unionAll(alone).select(
        id_back(id_col, "id"), F.col("n").alias("n_links"), id_back("component_id", "component"), (F.col("id") == F.col("component")).alias("kept"))

"""N-gram Jaccard join by several global token orders.

A document is its set of word shingles; two link when their Jaccard similarity reaches
``percent``. If they do, the first few tokens of both sets under *any* global order of tokens
(the prefix, about 1 - percent of a set) must meet. All orders here put frequent tokens last
(by a bounded frequency sketch of the whole corpus). The first then takes tokens of rare words
before others (by a bounded sketch of the words), as these are seldom shared by chance; the others
break ties by different hashes:

1. tokens of the first order's prefixes are grouped. Up to ``FEW`` sets that meet there become
   pairs at once, so a set that shares one passage with another and a second passage with a third
   does not bring the two together; more sets become a star, and stars candidate clusters;
2. pairs, and pairs inside clusters, are cut by parity sketches (about n / 4 bytes a set):
   sketches differ in at most as many bits as the sets differ in tokens, so sets whose sketches
   differ in more bits than the similarity allows cannot link;
3. what is left connects sets to clusters, and each set's text travels to its cluster (a cluster of
   many or of long sets is split into pairs of blocks, in both steps, so no task holds more than
   two blocks);
4. there, a pair is a candidate only if its prefixes meet under all ``ORDERS`` orders and its
   sizes allow the similarity; candidates are verified by exact counts of shared shingles.

Equal sets are one node, and inside a block a verified link is passed on only if it connects
two groups, so copies and near copies never become all pairs, yet no connection is lost. All verified
links are counted in place, each pair of sets in one block or pair of blocks only.
Orders only decide what is looked at first: the result does not depend on them. Sets are held
as 64-bit hashes of shingles.

A set's text and hashes are held whole by one task, whatever its length (some 40 bytes of memory
for each of its bytes), and a block's sets together.

Null texts and texts without words have no set, link with nothing and keep their own id;
null ids come before all others; rows that share an id are judged each by its own text;
repeated rows are equal sets; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import Groups, components
from ._hashing import Chunk, U, chunks, concatenated_ranges, mix, shingle_hashes
from ._spark import NO_ID, documents, id_back, partitions, short, spread_join, stored, text_hash
from ._windows import batch, signed

WORDS_PER_SHINGLE = 4
PERCENT = 85
ORDERS = 3
#: Buckets of the frequency sketch: one byte each on the driver and in tasks, whatever the corpus.
SKETCH = 1 << 21
#: A bucket is reported by a task only if it saw this many repeats there.
LEAST_COUNT = 1
#: Buckets of the words' own sketch, and of one row of it.
WORDS, WORDS_ROW = 1 << 18, 1 << 12
#: Sets that share a token are compared pair by pair if they are at most so many.
FEW = 32
#: Sets of a block of a cluster: as few as SMALL_BLOCK, at most MOST_BLOCKS blocks until they reach LARGE_BLOCK.
SMALL_BLOCK, LARGE_BLOCK, MOST_BLOCKS = 512, 5_000, 16
#: Shingles of a block, on average, whatever its sets: what a task holds of a pair of blocks is about 150 bytes for each.
BLOCK_SHINGLES = 150_000
#: The same two bounds for blocks of sketches, which are a hundredth as large.
SKETCH_BLOCK, SKETCH_SHINGLES = 20_000, 40_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(chunk: Chunk, width: int, rarity: np.ndarray | None = None, words: np.ndarray | None = None):
    """(document, shingle hash), sorted and distinct; a text of fewer words is one shingle.

    With ``rarity`` (a class for each bucket of words) a third array has the sum of each shingle's classes.
    """
    if words is None:
        words = word_hashes(chunk)
    n = chunk.last - chunk.first
    start = concatenated_ranges(chunk.first, np.where(n > 0, np.maximum(n - width + 1, 1), 0))
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    token = shingle_hashes(words, start, np.minimum(start + width, chunk.last[doc]), width)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    if rarity is None:
        return doc[keep], token[keep]
    of_word, at = rarity[(words & U(WORDS - 1)).astype(np.int64)], start[order[keep]]
    end = np.minimum(at + width, chunk.last[doc[keep]])
    common = np.zeros(len(at), dtype=np.int64)
    for j in range(width):
        common += np.where(at + j < end, of_word[np.minimum(at + j, len(words) - 1)], 0)
    return doc[keep], token[keep], np.minimum(common, 255).astype(np.uint8)


def word_hashes(chunk: Chunk) -> np.ndarray:
    """Finds the words of a chunk and gives their hashes in lower case."""
    chunk.words()
    return chunk.word_hashes(_LOWER)


def set_hashes(doc: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit hash of each document's set."""
    size = np.bincount(doc, minlength=n).astype(np.int64)
    total = np.zeros(len(token) + 1, dtype=U)
    np.cumsum(mix(token + U(11)), out=total[1:])
    last = np.cumsum(size)
    return size, mix(total[last] - total[last - size] + size.astype(U))


def prefix_size(n, percent: int):
    """Of two sets with the similarity, each shares more than n - prefix_size tokens."""
    return n - -(-n * percent // 100) + 1


def order_keys(token: np.ndarray, common: np.ndarray, classes: np.ndarray, which: int) -> np.ndarray:
    """Sort keys of a global order: rare classes first, in the first order then rare words, and a hash of its own."""
    keys = (classes[(token & U(SKETCH - 1)).astype(np.int64)].astype(U) << U(56)) | (mix(token + U(which * 7919)) >> U(8))
    return keys if which else keys & U(0xFF00FFFFFFFFFFFF) | (common.astype(U) << U(48))


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of a set of n: a power of two, at least 256 and 2 n."""
    return (np.uint64(1) << np.ceil(np.log2(np.maximum(n, 128) * 2)).astype(np.uint64)).astype(np.int64)


def parity_sketches(doc: np.ndarray, token: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Per set: bit i is the parity of the number of tokens whose hash ends in i."""
    bits = sketch_bits(n)
    base = np.cumsum(bits) - bits
    at = base[doc] + (mix(token + U(29)) & (bits[doc] - 1).astype(U)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[i // 8 : (i + m) // 8] for i, m in zip(base.tolist(), bits.tolist(), strict=True)]


#: Rows of ``_measure``: documents, buckets of the shingles' sketch, parts of the words' sketch.
DOCUMENT, BUCKET, WORD = 0, 1, 2
_NARROW = "a long, b long, n int, kind byte, parity binary, tag long"


def _measure(docs: DataFrame, width: int) -> DataFrame:
    """Per document (a: id, b: set hash, n: size, parity, tag), rows of the sketch of shingles that repeat
    (a: bucket, b: count) and of that of words (a: part, parity: its counts)."""

    def others(kind, a, b, parity):
        none = np.zeros(len(a), np.int32)
        return batch(a=a, b=b, n=none, kind=np.full(len(a), kind, np.int8), parity=parity, tag=none.astype(np.int64))

    def run(batches):
        seen, words_seen = np.zeros(SKETCH, dtype=np.int64), np.zeros(WORDS, dtype=np.int64)
        for b in batches:
            texts, ids, tag = b.column("text").to_pylist(), b.column("doc").to_numpy(), b.column("tag").to_numpy()
            held, size = [], 0
            for part, chunk in chunks(texts, texts):
                words = word_hashes(chunk)
                words_seen += np.bincount((words & U(WORDS - 1)).astype(np.int64), minlength=WORDS)
                doc, token = shingles(chunk, width, words=words)
                n, node = set_hashes(doc, token, len(chunk.start))
                parity = pa.array(parity_sketches(doc, token, n), pa.binary())
                yield batch(a=ids[part], b=signed(node), n=n.astype(np.int32), kind=np.full(len(n), DOCUMENT, np.int8), parity=parity, tag=tag[part])
                held.append(token)
                size += len(token)
                if size > 2_000_000:
                    _count(held, seen)
                    held, size = [], 0
            _count(held, seen)
        at = np.flatnonzero(seen >= LEAST_COUNT)
        if len(at):
            yield others(BUCKET, at, seen[at], pa.nulls(len(at), pa.binary()))
        if words_seen.any():
            parts = words_seen.reshape(-1, WORDS_ROW)
            yield others(WORD, np.arange(len(parts)), np.zeros(len(parts), np.int64), pa.array([x.tobytes() for x in parts], pa.binary()))

    return docs.mapInArrow(run, _NARROW)


def _count(held: list[np.ndarray], seen: np.ndarray) -> None:
    """Adds the tokens that repeat in a part of a task's input to its sketch."""
    if held:
        token = np.sort(np.concatenate(held))
        again = token[1:][token[1:] == token[:-1]]
        seen += np.bincount((again & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)


def _classes(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How frequent the shingles of each bucket are (0: not known to be), and its words: both in powers of two."""

    def added(batches):
        part, total = None, None
        for b in batches:
            for a, counts in zip(b.column("a").to_pylist(), b.column("parity").to_pylist(), strict=True):
                if a != part:
                    if part is not None:
                        yield batch(a=np.array([part]), counts=pa.array([total.tobytes()], pa.binary()))
                    part, total = a, np.zeros(WORDS_ROW, dtype=np.int64)
                total += np.frombuffer(counts, dtype=np.int64)
        if part is not None:
            yield batch(a=np.array([part]), counts=pa.array([total.tobytes()], pa.binary()))

    def powers(n):
        return np.floor(np.log2(np.maximum(n, 1))).astype(np.uint8)

    buckets = measured.where(F.col("kind") == BUCKET).groupBy(F.col("a").alias("bucket")).agg(F.sum("b").alias("n")).toArrow()  # at most SKETCH rows
    n = np.zeros(SKETCH, dtype=np.int64)
    n[buckets.column("bucket").to_numpy()] = buckets.column("n").to_numpy()
    least = max(n.mean(), 2)  # what many rare tokens of a bucket add up to is no sign
    of_shingles = np.where(n >= least, 1 + powers(n / least), 0).astype(np.uint8)
    parts = measured.where(F.col("kind") == WORD).select("a", "parity").repartition(partitions(measured.sparkSession), "a").sortWithinPartitions("a")
    of_words = np.zeros((WORDS // WORDS_ROW, WORDS_ROW), dtype=np.uint8)
    for row in parts.mapInArrow(added, "a long, counts binary").toArrow().to_pylist():  # WORDS / WORDS_ROW rows
        of_words[row["a"]] = powers(np.frombuffer(row["counts"], dtype=np.int64))
    return of_shingles, of_words.ravel()


def _prefix_rows(docs: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """(token, node) of the first order's prefixes; equal rows of a batch once."""

    def run(batches):
        of_shingles, of_words = classes.value
        for b in batches:
            texts = b.column("text").to_pylist()
            held, size = [], 0
            for _, chunk in chunks(texts, texts):
                doc, token, common = shingles(chunk, width, of_words)
                n, node = set_hashes(doc, token, len(chunk.start))
                order = np.lexsort((order_keys(token, common, of_shingles, 0), doc))
                doc, token = doc[order], token[order]
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                take = rank < prefix_size(n, percent)[doc]
                held.append((token[take], node[doc[take]], n[doc[take]]))
                size += len(held[-1][0])
                if size > 300_000:
                    yield _distinct(held)
                    held, size = [], 0
            if size:
                yield _distinct(held)

    return docs.select("text").mapInArrow(run, "token long, n int, node long")


def _distinct(held) -> pa.RecordBatch:
    token, node, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((node, token))
    token, node, n = token[order], node[order], n[order]
    keep = np.ones(len(token), dtype=bool)
    keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    return batch(token=signed(token[keep]), n=n[keep].astype(np.int32), node=signed(node[keep]))


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Nodes that share a token and may be similar by size: all pairs of a few of them, of more star links
    (leader, another node).

    Nodes of a token come in order of size; where the next is too large for the one before, no
    smaller one can meet it or a larger one, so a new run begins.
    """

    def run(batches):
        held, leader = np.zeros((3, 0), dtype=np.int64), None  # the latest run, and of one of more than FEW its last row and leader
        for b in batches:
            token, n, node = held = np.concatenate((held, [b.column(c).to_numpy() for c in ("token", "n", "node")]), axis=1)
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
            again = np.zeros(len(token), dtype=bool)  # equal sets of several batches
            again[1:] = ~fresh[1:] & (node[1:] == node[:-1])
            token, n, node = held = held[:, ~again]
            start = np.flatnonzero(fresh[~again])
            size = np.diff(np.append(start, len(token)))
            first = node[start]
            many = size > FEW
            if leader is not None:
                first[0], many[0] = leader, True
            star = np.flatnonzero(np.repeat(many, size))
            found = [(np.repeat(first, size)[star], node[star], True)]
            of_run, few = np.repeat(np.arange(len(start)), size), ~many
            few[-1] = False  # not known to be whole
            found += _pairs(n, node, of_run, few, percent)
            leader = first[-1] if many[-1] else None
            held = held[:, start[-1] :] if leader is None else held[:, -1:]
            yield from _meeting_rows(found)
        if leader is None:
            _, n, node = held
            yield from _meeting_rows(_pairs(n, node, np.zeros(len(n), dtype=np.int64), np.ones(1, dtype=bool), percent))

    dealt = rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(run, "a long, b long, star boolean")


def _pairs(n, node, of_run, few, percent: int) -> list[tuple]:
    """Pairs of nodes of the runs marked in ``few`` whose sizes allow the similarity, the smaller first."""
    at = np.flatnonzero(few[of_run])
    found = []
    for apart in range(1, FEW):
        at = at[at + apart < len(n)]
        at = at[of_run[at] == of_run[at + apart]]
        if not len(at):
            break
        fits = at[100 * n[at] >= percent * n[at + apart]]
        found.append((node[fits], node[fits + apart], False))
    return found


def _meeting_rows(found: list[tuple]):
    for star in (False, True):
        pairs = [np.stack([a, b])[:, a != b] for a, b, s in found if s == star]
        a, b = np.unique(np.concatenate([*pairs, np.zeros((2, 0), dtype=np.int64)], axis=1), axis=1)
        if len(a):
            yield batch(a=a, b=b, star=np.full(len(a), star))


def _fitting(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes whose parity sketches allow the similarity."""

    def run(batches):
        for b in batches:
            n = sum(b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            a, b, x, y = b.column("a").to_numpy(), b.column("b").to_numpy(), b.column("parity_a").to_pylist(), b.column("parity_b").to_pylist()
            sizes = np.array([[len(v) // 8 for v in x], [len(v) // 8 for v in y]])
            apart = np.zeros(len(a), dtype=np.int64)
            for s, t in np.unique(sizes, axis=1).T.tolist():
                at = np.flatnonzero((sizes[0] == s) & (sizes[1] == t))
                u, v = (np.frombuffer(b"".join([z[i] for i in at]), dtype=np.uint64).reshape(len(at), -1, min(s, t)) for z in (x, y))
                # a larger sketch folds to a smaller one
                apart[at] = np.bitwise_count(np.bitwise_xor.reduce(u, axis=1) ^ np.bitwise_xor.reduce(v, axis=1)).sum(axis=1, dtype=np.int64)
            fits = apart * (100 + percent) <= n * (100 - percent)
            if fits.any():
                yield batch(a=a[fits], b=b[fits])

    def of(side):
        return sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}"))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def _compressed(docs: DataFrame) -> DataFrame:
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            text = pa.array([press.compress(t) for t in b.column("text").to_pylist()], pa.binary())
            yield batch(doc=b.column("doc"), tag=b.column("tag"), text=text)

    return docs.mapInArrow(run, "doc long, tag long, text binary")


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of a block or a pair of blocks whose parity sketches allow the similarity."""

    def run(batches):
        key, held = None, []
        for b in batches:
            c = [b.column(k).to_pylist() for k in ("cluster", "i", "j", "node", "block", "n", "parity")]
            for *k, node, block, n, parity in zip(*c, strict=True):
                if k != key:
                    yield from _near_links(held, key, percent)
                    key, held = k, []
                if not held or node != held[-1][1]:
                    held.append((n, node, block, parity))
        yield from _near_links(held, key, percent)

    return rows.mapInArrow(run, "a long, b long")


def _near_links(held: list[tuple], key, percent: int):
    """One batch of links, enough to connect all nodes that pairs of fitting sketches connect."""
    if len(held) < 2:
        return
    held = sorted(held, key=lambda x: x[:2])
    size, node, block = (np.array([x[c] for x in held], dtype=np.int64) for c in range(3))
    bits = sketch_bits(size)
    classes = {}  # bits -> (first place, sketches): sizes are sorted, so a class is one range
    for m in np.unique(bits).tolist():
        lo, hi = np.searchsorted(bits, [m, m + 1])
        classes[m] = lo, np.frombuffer(b"".join(x[3] for x in held[lo:hi]), dtype=np.uint64).reshape(hi - lo, -1)
    group, a, b = np.arange(len(held)), [], []
    for x in range(1, len(held)):
        m = int(bits[x])
        least = int(np.searchsorted(size, -(-percent * size[x] // 100)))
        lo, table = classes[m]
        mine, apart = table[x - lo], []
        if least < lo:  # smaller sets may have half the bits, to which this sketch folds
            first, lower = classes[m // 2]
            half = mine.reshape(2, -1)
            apart.append(np.bitwise_count(lower[least - first :] ^ (half[0] ^ half[1])).sum(axis=1, dtype=np.int64))
        apart.append(np.bitwise_count(table[max(least - lo, 0) : x - lo] ^ mine).sum(axis=1, dtype=np.int64))
        fits = np.concatenate(apart) * (100 + percent) <= (size[least:x] + size[x]) * (100 - percent)
        if key[1] != key[2]:
            fits &= block[least:x] != block[x]
        ys = np.flatnonzero(fits) + least
        if len(ys):
            roots, at = np.unique(group[ys], return_index=True)
            for root, y in zip(roots.tolist(), ys[at].tolist(), strict=True):
                if root != group[x]:
                    group[group == root] = group[x]
                    a.append(node[x])
                    b.append(node[y])
    if a:
        yield batch(a=np.array(a), b=np.array(b))


def _members(links: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node in a link, roots included."""
    found = components(links)
    return stored(found.unionAll(found.select(F.col("root").alias("node"), "root")).distinct())


def _placed(clusters: DataFrame, small: int, large: int, shingles: int) -> DataFrame:
    """Members (``root``, ``node``, ``n``, others) with their ``block`` of the cluster and its number of ``blocks``.

    A block has about ``small`` sets, up to ``large`` if there would be more than MOST_BLOCKS, and at most about ``shingles`` shingles.
    """
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where((F.col("m") > small) | (F.col("total") > shingles))
    block = F.least(F.lit(large), F.greatest(F.lit(small), F.ceil(F.col("m") / MOST_BLOCKS)))
    blocks = sizes.select("root", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("total") / shingles)).cast("int").alias("blocks"))
    placed = spread_join(clusters, blocks, "root", "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _dealt(placed: DataFrame, *carried: str) -> DataFrame:
    """Every member once for each block of its cluster, dealt out by pair of blocks."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = placed.select(F.col("root").alias("cluster"), "node", "block", other, *carried).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", *carried)
    return paired.repartition(partitions(placed.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")


def _verified(rows: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """Of a block or a pair of blocks: links that connect groups there (``n`` 0), and per node the
    number ``n`` of documents in linked nodes (``a`` = ``b``)."""

    def run(batches):
        key, nodes, blocks, texts, copies = None, [], [], [], []
        for b in batches:
            c = [b.column(k).to_pylist() for k in ("cluster", "i", "j", "node", "block", "text", "copies")]
            found = []
            for *k, node, block, text, n in zip(*c, strict=True):
                if k != key:
                    found += _links(nodes, blocks, texts, copies, key, classes.value, width, percent)
                    key, nodes, blocks, texts, copies = k, [], [], [], []
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    blocks.append(block)
                    texts.append(text)
                    copies.append(n)
            if found:
                yield _link_rows(found)
        found = _links(nodes, blocks, texts, copies, key, classes.value, width, percent)
        if found:
            yield _link_rows(found)

    return rows.mapInArrow(run, "a long, b long, n long")


def _link_rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, n = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
    return batch(a=a, b=b, n=n)


def _links(nodes, blocks, texts, copies, key, classes, width: int, percent: int) -> list[tuple[int, int, int]]:
    if len(nodes) < 2:
        return []
    unpress = zstandard.ZstdDecompressor()
    of_shingles, of_words = classes
    texts, sets, prefixes = [unpress.decompress(t) for t in texts], [], []
    for part, chunk in chunks(texts, texts):
        doc, token, common = shingles(chunk, width, of_words)
        cut = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
        for at in (slice(cut[i], cut[i + 1]) for i in range(part.stop - part.start)):
            sets.append(token[at].copy())
            prefixes.append([_prefix(token[at], common[at], of_shingles, order, percent) for order in range(ORDERS)])
    del texts
    rank = sorted(range(len(nodes)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in rank]
    nodes, block, copies = [nodes[i] for i in rank], np.array([blocks[i] for i in rank]), np.array([copies[i] for i in rank])
    linked = np.zeros(len(nodes), dtype=np.int64)
    size = np.array([len(s) for s in sets])
    prefixes = [Postings([prefixes[i][order] for i in rank]) for order in range(ORDERS)]
    whole = Postings(sets)
    groups, links = Groups(len(nodes)), []
    for x in range(1, len(nodes)):
        near = 100 * size[:x] >= percent * size[x]
        if key[1] != key[2]:
            near &= block[:x] != block[x]
        for p in prefixes:
            if near.any():
                near &= p.meets(x)[:x] > 0
        ys = np.flatnonzero(near)
        if not len(ys):
            continue
        both = whole.meets(x)[ys]
        ys = ys[100 * both >= percent * (size[x] + size[ys] - both)]
        linked[ys] += copies[x]
        linked[x] += copies[ys].sum()
        for y in ys.tolist():
            if groups.join(x, y):
                links.append((nodes[x], nodes[y], 0))
    return links + [(nodes[x], nodes[x], int(linked[x])) for x in np.flatnonzero(linked)]


def _prefix(tokens: np.ndarray, common: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    p = prefix_size(len(tokens), percent)
    return tokens[np.argpartition(order_keys(tokens, common, classes, order), p - 1)[:p]]


class Postings:
    """Which sets share a token, for the sets of one block or pair of blocks.

    Tokens of a single set are left out: they are in no intersection.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable").astype(np.int32)
        token = token[order]
        fresh = np.concatenate(([True], token[1:] != token[:-1]))
        del token
        start = np.flatnonzero(fresh)
        count = np.diff(np.append(start, len(order)))
        shared = np.repeat(count > 1, count)
        order, count = order[shared], count[count > 1]
        owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in sets])
        self.held = owner[order]
        group = np.repeat(np.arange(len(count), dtype=np.int32), count)
        back = np.argsort(order, kind="stable")
        group = group[back]
        self.at = np.searchsorted(self.held[back], np.arange(self.n + 1))
        self.start, self.count = (np.cumsum(count) - count)[group].astype(np.int32), count[group].astype(np.int32)

    def meets(self, x: int) -> np.ndarray:
        """Tokens that each set shares with set x."""
        mine = slice(self.at[x], self.at[x + 1])
        return np.bincount(self.held[concatenated_ranges(self.start[mine], self.count[mine].astype(np.int64))], minlength=self.n)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WORDS_PER_SHINGLE, percent: int = PERCENT, groups: bool = False) -> DataFrame:
    """Per row: id, ``n_shingles``, ``n_links`` (other rows linked directly, equal sets included)
    and ``component_id`` (least id reachable by links).

    With ``groups`` also ``tag`` (``text_hash``) and ``root``, which tell rows of one id and
    groups of one least id apart; texts without words have a null root.
    """
    spark = df.sparkSession
    docs = documents(df, id_col, text_col).withColumn("tag", text_hash("text"))
    measured = stored(_measure(docs, width))
    found = measured.where(F.col("kind") == DOCUMENT)
    sets = found.where("n > 0").select(F.col("a").alias("doc"), F.col("b").alias("node"), "n", "tag")
    classes = spark.sparkContext.broadcast(_classes(measured))

    # a node's text is found by id and text hash: rows that share an id (all null ids do) may differ in text
    nodes = sets.groupBy("node").agg(F.min("doc").alias("doc"), F.min_by("tag", "doc").alias("tag"), F.count("*").alias("copies"), F.first("n").alias("n"))
    repeats = sets.groupBy("doc", "tag").count().where("count > 1").limit(1).count() > 0
    sketches = found.where("n > 0").select(F.col("b").alias("node"), "n", "parity").dropDuplicates(["node"])
    met = stored(_meetings(_prefix_rows(docs, classes, width, percent), percent))
    fitting = _fitting(met.where("not star").select("a", "b").distinct(), sketches, percent)
    sketched = _placed(_members(met.where("star").select("a", "b")).join(sketches, "node"), SKETCH_BLOCK, SKETCH_BLOCK, SKETCH_SHINGLES)
    cut = _members(fitting.unionAll(_near(_dealt(sketched, "n", "parity"), percent)))
    # stored: while the clusters' members are few, they go to the texts and not all texts to them
    placed = stored(_placed(cut.join(nodes, "node"), SMALL_BLOCK, LARGE_BLOCK, BLOCK_SHINGLES))
    pressed = _compressed(docs)
    if repeats:
        pressed = pressed.dropDuplicates(["doc", "tag"])
    texts = pressed.join(short(placed), ["doc", "tag"]).select("root", "node", "block", "blocks", "text", "copies")
    verified = stored(_verified(_dealt(texts, "text", "copies"), classes, width, percent))
    roots = components(verified.where("n = 0").select("a", "b"))

    # what is known of nodes that have a link or a copy, one row each; a node of many copies is dealt to several tasks
    none = F.lit(None).cast("long").alias("root")
    known = roots.select("node", "root", F.lit(0).cast("long").alias("n_links")).unionAll(verified.where("n > 0").select(F.col("a").alias("node"), none, F.col("n").alias("n_links"))).unionAll(
        nodes.where("copies > 1").select("node", none, (F.col("copies") - 1).alias("n_links"))).groupBy("node").agg(F.max("root").alias("root"), F.sum("n_links").alias("n_links"))
    rooted = spread_join(sets, known, "node", "doc", "left").withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    linked = spread_join(rooted, least, "root", "doc").select("doc", "n", "n_links", "component", "tag", "root")
    alone = found.where("n = 0").select(F.col("a").alias("doc"), "n", F.lit(0).cast("long").alias("n_links"), F.col("a").alias("component"), "tag", F.lit(None).cast("long").alias("root"))
    return linked.unionAll(alone).select(
        id_back(id_col), F.col("n").cast("long").alias("n_shingles"), "n_links", id_back("component_id", "component"), *(["tag", "root"] if groups else []))

"""Vectorised hashing of words, bytes and windows inside a task.

Every function works on flat NumPy arrays for a *chunk* of documents at once; ``bounds``
holds the chunk's document limits, so that no window crosses from one document to the next.

``Roller`` only names anchors: where two of them collide, more is compared and nothing is
lost. What decides equality is ``digests`` (BLAKE2b of the bytes themselves) or, for sets of
shingles, ``word_hashes`` and ``shingle_hashes``, which mix block by block and so have no
words that collide by their form, as polynomials modulo 2**64 do.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Chunks are cut at about this many bytes; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Hashes of any span of a sequence from one running sum (a polynomial modulo 2**64)."""

    def __init__(self, seed: int):
        self.table = mix(np.arange(256, dtype=U) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        self.base = int(mix(np.array([seed + 77], dtype=U))[0]) | 1
        self.seed = U(seed)
        self.up = np.ones(1, dtype=U)
        self.down = np.ones(1, dtype=U)

    def __reduce__(self):
        return Roller, (int(self.seed),)  # the powers grow again where they are needed

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.full(n, U(self.base))
            self.down = np.full(n, U(inverse))
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def sums(self, tokens: np.ndarray) -> np.ndarray:
        """Running sums of 64-bit tokens (or of bytes, which go through the table)."""
        self._grow(len(tokens) + 1)
        values = self.table[tokens] if tokens.dtype == np.uint8 else tokens
        out = np.zeros(len(tokens) + 1, dtype=U)
        np.cumsum(values * self.down[: len(tokens)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of tokens start..end-1, equal for equal content at any place."""
        return mix((sums[end] - sums[start]) * self.up[start] + self.seed)

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of every span of ``width`` tokens."""
        n = len(sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix((sums[width:] - sums[:n]) * self.up[:n] + self.seed)


SHINGLES, BYTES = Roller(3), Roller(5)
#: Longer words are hashed one by one.
LONG_WORD = 64


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit BLAKE2b digest of each data[start:end]."""
    made = b"".join([hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(made, dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def shingle_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Hash of words start..end-1 (at most ``width`` of them) from their hashes, in order."""
    h = mix((end - start).astype(U) + U(0x51ED270B))
    for j in range(width):
        at = start + j
        inside = at < end
        h = np.where(inside, mix((h * U(0x9E3779B97F4A7C15)) ^ words[np.minimum(at, len(words) - 1)]), h)
    return h


def is_space(data: np.ndarray) -> np.ndarray:
    """The bytes 0x20 and 0x09 to 0x0D, which separate words."""
    return (data == 32) | ((data >= 9) & (data <= 13))


class Chunk:
    """Texts of some documents laid end to end with a separator after each."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.end = self.start + sizes

    def words(self) -> None:
        """Finds the words: ``ws``/``we`` byte limits, ``first``/``last`` word limits per document."""
        edge = np.diff(np.concatenate(([1], is_space(self.data).view(np.int8), [1])))
        self.ws = np.flatnonzero(edge == -1)
        self.we = np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.ws, self.start)
        self.last = np.searchsorted(self.ws, self.end)

    def word_hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of every word, each byte looked up in ``table`` before."""
        data = np.concatenate((self.data if table is None else table[self.data], np.zeros(8, np.uint8)))
        eights = np.lib.stride_tricks.sliding_window_view(data, 8)
        size = self.we - self.ws
        h = mix(size.astype(U) + U(0xA0761D64))
        active, at = np.flatnonzero(size <= LONG_WORD), 0
        while len(active):
            block = np.ascontiguousarray(eights[self.ws[active] + at]).view("<u8").ravel()
            rest = np.minimum(size[active] - at, 8)
            block &= U(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * rest).astype(U)
            h[active] = mix((h[active] * U(0x9E3779B97F4A7C15)) ^ block)
            at += 8
            active = active[size[active] > at]
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            h[long] = digests(data.tobytes(), self.ws[long], self.we[long])[0]
        return h

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space, and each word's start and end there."""
        space = is_space(self.data)
        kept = ~space
        kept[self.we] = True
        size = self.we - self.ws + 1
        end = np.cumsum(size)
        return np.where(space, np.uint8(32), self.data)[kept].tobytes(), end - size, end - 1


def chunks(ids: list, texts: list[bytes], most: int = CHUNK_BYTES):
    """(slice, Chunk) over the documents of a batch, cut at about ``most`` bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(at, i), Chunk(texts[at:i])
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield slice(at, len(texts)), Chunk(texts[at:])


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width`` entries, by doubling."""
    if len(a) < width:
        return a[:0]
    span = 1
    while span * 2 <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return op(a[:-rest], a[rest:]) if rest else a


def concatenated_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0].. count[0] numbers, then start[1].. and so on."""
    count = np.maximum(count, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ahead = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - ahead, count)


def segments(roller: Roller, sums: np.ndarray, first: np.ndarray, last: np.ndarray, n: int, k: int):
    """Splits the n-token windows of each document into runs that share an anchor.

    The anchor of a window is the rightmost of its smallest k-token hashes, so it depends on
    the window's content alone: equal windows anywhere have equal anchors at the same offset.
    Returns (document, anchor hash, first window, last window) per run.
    """
    width = n - k + 1
    keys = roller.windows(sums, k)
    low = sliding(keys, width, np.minimum)
    has = np.flatnonzero(last - first >= n)
    none = np.zeros(0, dtype=np.int64)
    if not len(has) or not len(low):
        return none, none.view(U), none, none
    count = (last - first)[has] - n + 1
    places = concatenated_ranges(first[has], count)
    ok = np.zeros(len(low), dtype=bool)
    ok[places] = True
    padded = np.zeros(len(low) + 2 * (width - 1), dtype=U)
    padded[width - 1 : width - 1 + len(low)] = np.where(ok, low, U(0))
    used = np.zeros(len(padded) + 1, dtype=np.int64)
    np.cumsum(np.concatenate((np.zeros(width - 1, bool), ok, np.zeros(width - 1, bool))), out=used[1:])
    any_ok = used[width:] - used[:-width] > 0
    pick = np.flatnonzero((sliding(padded, width, np.maximum) == keys) & any_ok)
    doc = has[np.searchsorted(first[has], pick, side="right") - 1]
    value = keys[pick]
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    lo = np.where(np.concatenate(([False], value[1:] <= value[:-1])), pick - width + 1, np.concatenate(([0], pick[:-1] + 1)))
    lo = np.where(fresh, first[doc], np.maximum(lo, first[doc]))
    lo = np.maximum.accumulate(lo)
    hi = np.concatenate((lo[1:] - 1, [0]))
    final = np.concatenate((fresh[1:], [True]))
    hi[final] = last[doc[final]] - n
    keep = hi >= lo
    return doc[keep], value[keep], lo[keep], hi[keep]


def runs(doc: np.ndarray, place: np.ndarray):
    """Merges sorted (document, place) points into (document, first place, count) runs."""
    if not len(doc):
        return doc, place, place
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1))))
    return doc[cut], place[cut], np.diff(np.concatenate((cut, [len(doc)])))


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of ``size`` tokens that some [start, end) range covers."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0

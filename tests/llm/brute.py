"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    w = words(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_links(rows, width=4, percent=85):
    """{id: number of other rows linked directly}, all pairs compared"""
    sets = [(i, shingles(text, width)) for i, text in rows]
    return {i: sum(x != y and bool(s & t) and 100 * len(s & t) >= percent * len(s | t) for y, (_, t) in enumerate(sets)) for x, (i, s) in enumerate(sets)}


def jaccard(rows, width=4, percent=85):
    """{id: (size of the set, least id of the component)}"""
    sets = {i: shingles(text, width) for i, text in rows}
    groups, where = Groups(sets), defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for t in s for j in where[t]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
        for t in s:
            where[t].append(i)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def without_repeats(rows, width, split, glue):
    """{id: (tokens, removed, kept)}: windows seen before, in id order, are removed."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        tokens = split(text or "")
        gone = [False] * len(tokens)
        for p in range(len(tokens) - width + 1):
            window = tuple(tokens[p : p + width])
            if window in seen:
                gone[p : p + width] = [True] * width
            seen.add(window)
        out[i] = len(tokens), sum(gone), glue([t for t, g in zip(tokens, gone, strict=True) if not g])
    return out


def byte_repeats(rows, width=100):
    return without_repeats(rows, width, lambda t: t.encode(), bytes)


def word_repeats(rows, width=20):
    return without_repeats(rows, width, words, " ".join)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()

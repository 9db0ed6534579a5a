"""Greedy one-to-one matchers as walks over two sorted lists, cell by cell.

A walk stands at one element of each list and either pairs the two or passes one of them over;
what it does depends on elements near the two only. Time is cut into cells. What an earlier cell
leaves to a later one is the *lag*: how many elements of one list, the other being used up to
the border, are still to be met. Elements further back than ``reach`` are never met, so a cell
knows all lags that can enter it, and tells for each which lag leaves it: a short table, and
most often a single number, for walks from different lags soon meet.

1. Each cell makes its table from its own elements and copies of those just outside it.
2. The tables, one short row a cell, are followed in order: that gives each cell its true lag.
3. Each cell walks once more from there and gives its pairs.

So a key that never pauses is as many tasks as it has cells, and no group holds more than a cell
and its borders, whatever the data: without regular pauses the tables only get longer. Cells
are made so wide that the densest key has about ``CELL_ROWS`` elements in each.

Null keys are a key. Null times are left out. Equal times are taken in the order of the second
value of an element. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Elements of the densest key that a cell has on average.
CELL_ROWS = 20_000
#: What a walk does next.
PAIR, PASS_A, PASS_B = 0, 1, 2
#: A rule sees the times and second values of both lists and the walk's places in them.
Rule = Callable[[list, list, list, list, int, int], int]


def first_in_range(low: int, high: int) -> Rule:
    """Each b takes the first unused a that is ``low``..``high`` before it."""

    def rule(a, _, b, __, i, j):
        age = b[j] - a[i]
        return PASS_A if age > high else PASS_B if age < low else PAIR

    return rule


def nearest_in_order(window: int, later_on_tie: bool) -> Rule:
    """Pairs within the window, unless the next element of a list is nearer to the other's present one."""

    def rule(a, _, b, __, i, j):
        gap = a[i] - b[j]
        if abs(gap) > window:
            return PASS_A if gap < 0 else PASS_B
        gap = abs(gap)
        if i + 1 < len(a) and abs(a[i + 1] - b[j]) < gap + later_on_tie:
            return PASS_A
        if j + 1 < len(b) and abs(a[i] - b[j + 1]) < gap:
            return PASS_B
        return PAIR

    return rule


def overlapping() -> Rule:
    """Pairs of closed intervals (time, second value) that meet; else the one that ends first is passed over."""

    def rule(a, a_end, b, b_end, i, j):
        if a[i] <= b_end[j] and b[j] <= a_end[i]:
            return PAIR
        return PASS_A if a_end[i] < b[j] else PASS_B

    return rule


class Cell:
    """The elements of a cell and its borders."""

    def __init__(self, t: np.ndarray, side: np.ndarray, e: np.ndarray, start: int, end: int, reach: int):
        order = np.lexsort((e, t))
        t, side, e = t[order], side[order], e[order]
        self.t = [t[side == k].tolist() for k in (0, 1)]
        self.e = [e[side == k].tolist() for k in (0, 1)]
        before = lambda at: [bisect_left(x, at) for x in self.t]
        self.begin, self.stop = before(start), before(end)
        self.live, self.kept = before(start - reach), before(end - reach)

    def entry(self, lag: int) -> tuple[int, int]:
        i, j = self.begin
        return (i - lag, j) if lag > 0 else (i, j + lag)

    def lags(self) -> range:
        """All that can enter: elements of b (negative) or of a before the cell and within reach."""
        return range(self.live[1] - self.begin[1], self.begin[0] - self.live[0] + 1)

    def leave(self, i: int, j: int) -> int:
        i, j = max(i, self.kept[0]), max(j, self.kept[1])
        return self.stop[0] - i if i < self.stop[0] else j - self.stop[1]

    def walk(self, rule: Rule, lag: int, pairs: list | None = None, met: dict | None = None) -> int:
        """The lag that leaves; pairs are added to ``pairs``, and a walk that meets an earlier one of ``met`` ends as that did."""
        (a, b), (a_end, b_end), (stop_a, stop_b) = self.t, self.e, self.stop
        i, j = self.entry(lag)
        path = []
        while i < stop_a and j < stop_b:
            if met is not None:
                if (i, j) in met:
                    break
                path.append((i, j))
            what = rule(a, a_end, b, b_end, i, j)
            if what == PAIR and pairs is not None:
                pairs.append((a[i], a_end[i], b[j], b_end[j], max(0, bisect_left(a, b[j]) - i - 1)))
            i += what != PASS_B
            j += what != PASS_A
        out = met[i, j] if met is not None and i < stop_a and j < stop_b else self.leave(i, j)
        if met is not None:
            met.update(dict.fromkeys(path, out))
        return out

    def table(self, rule: Rule) -> list[int]:
        """Lag that leaves by lag that enters; a single number if it is always the same."""
        met: dict = {}
        outs = [self.walk(rule, lag, met=met) for lag in self.lags()]
        return outs[:1] if len(set(outs)) == 1 else outs


def _cell_of(table: pa.Table, start: int, span: int, reach: int) -> Cell:
    t, side, e = (table.column(c).to_numpy() for c in ("_t", "_side", "_e"))
    return Cell(t, side, e, start, start + span, reach)


def _follow(keys: list[str]):
    """Sorted rows (key, cell, first lag, table) -> (key, cell, lag) where a lag enters."""

    def run(batches):
        key, cell, lag = None, None, 0
        for b in batches:
            found = []
            columns = [b.column(c).to_pylist() for c in (*keys, "_cell", "low", "outs")]
            for n, (*k, c, low, outs) in enumerate(zip(*columns, strict=True)):
                if k != key or c != cell + 1:  # nothing lies within reach before it
                    lag = 0
                if lag:
                    found.append((n, lag))
                key, cell, lag = k, c, outs[0] if len(outs) == 1 else outs[lag - low]
            if found:
                rows = b.take(pa.array([n for n, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (*keys, "_cell")), pa.array([x for _, x in found], pa.int64())], names=[*keys, "_cell", "_lag"])

    return run


def _cell_number(t: Column, span: int) -> Column:
    """floor(t / span) in whole numbers: ticks may be beyond what a double holds."""
    return F.call_function("div", t - F.pmod(t, F.lit(span).cast("long")), F.lit(span).cast("long"))


def width(elements: DataFrame, keys: list[str], least: int) -> int:
    """Time units of a cell: the densest key has about CELL_ROWS elements in one, and it is no shorter than ``least``."""
    each = elements.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("_t") - F.min("_t") + 1).alias("ticks"))
    found = each.agg(F.min(F.col("ticks") / F.ceil(F.col("n") / CELL_ROWS))).first()[0]
    return max(least, int(found or 1))


def walked(elements: DataFrame, keys: list[str], rule: Rule, reach: int, look: int = 0, span: int | None = None) -> DataFrame:
    """Pairs of the walk over ``_side`` 0 and 1: keys, ``a``, ``a_end``, ``b``, ``b_end`` and ``between``, the number of a after the paired one and before b.

    ``elements`` has the keys, ``_t``, ``_side`` and ``_e`` (a second value); ``reach`` bounds how
    far back an element can be met, ``look`` how far ahead of the walk the rule looks.
    """
    types = dict(elements.dtypes)
    named = "".join(f"{k} {types[k]}, " for k in keys)
    elements = stored(elements.where("_t is not null"))
    # reach and span may be anything up to the whole range of times; a border is never wider than its cell
    span = max(reach + look + 1, span or width(elements, keys, 8 * (reach + look) + 1))
    cells = F.sequence(_cell_number(F.col("_t") - look, span), _cell_number(F.col("_t") + reach, span))
    dealt = elements.withColumn("_cell", F.explode(cells))

    def of_group(group: tuple) -> tuple[list[pa.Array], int]:
        return [pa.array([k.as_py()], k.type) for k in group], group[-1].as_py() * span

    def tell(group: tuple, table: pa.Table) -> pa.Table:
        names, start = of_group(group)
        cell = _cell_of(table, start, span, reach)
        return pa.Table.from_arrays([*names, pa.array([cell.lags().start], pa.int64()), pa.array([cell.table(rule)], pa.list_(pa.int64()))], names=[*keys, "_cell", "low", "outs"])

    tables = stored(dealt.groupBy(*keys, "_cell").applyInArrow(tell, f"{named}_cell long, low long, outs array<long>"))
    in_order = tables.repartition(*keys) if keys else tables.repartition(1)
    lags = in_order.sortWithinPartitions(*keys, "_cell").mapInArrow(_follow(keys), f"{named}_cell long, _lag long")

    def emit(group: tuple, table: pa.Table) -> pa.Table:
        names, start = of_group(group)
        is_lag = table.column("_side").to_numpy() == 2
        lag = int(table.column("_t").to_numpy()[is_lag].sum())
        pairs: list = []
        _cell_of(table.filter(pa.array(~is_lag)), start, span, reach).walk(rule, lag, pairs)
        columns = list(zip(*pairs, strict=True)) or [()] * 5
        # the keys' own arrays, repeated for every pair
        at = pa.array(np.zeros(len(pairs), np.int64))
        return pa.Table.from_arrays([*(k.take(at) for k in names[:-1]), *(pa.array(c, pa.int64()) for c in columns)], names=[*keys, "a", "a_end", "b", "b_end", "between"])

    entering = lags.select(*keys, F.col("_lag").alias("_t"), F.lit(2).alias("_side"), F.lit(0).cast("long").alias("_e"), "_cell")
    return dealt.unionByName(entering).groupBy(*keys, "_cell").applyInArrow(emit, f"{named}a long, a_end long, b long, b_end long, between long")


def elements(df: DataFrame, keys: list[str], time, side, second=None) -> DataFrame:
    """The relation that ``walked`` takes; rows whose side is null are left out."""
    t = time.cast("long")
    return df.select(*keys, t.alias("_t"), side.cast("int").alias("_side"), (t if second is None else second.cast("long")).alias("_e")).where("_side is not null")

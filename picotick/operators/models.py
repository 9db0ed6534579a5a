"""Linear, neighbour and component models by distributed sums.

Fitting adds up sufficient statistics inside tasks: ``mapInArrow`` turns a partition into one
Gram matrix, and ``sum_arrays`` adds the partitions' matrices entry by entry in an
aggregation. What reaches the driver is (features + 2)^2 numbers, whatever the number of
rows; ``MOST_FEATURES`` bounds it. Models are applied in tasks from a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

MOST_FEATURES = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def gram(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Per key: rows ``n`` and entries (i, j, v) of Z'Z for Z = [1, x, y], the upper triangle only."""
    keys = keys or []
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "i int, j int, v double"])

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        kinds = None
        for b in batches:
            z = _matrix(b.column("x"))
            if z.shape[1] > MOST_FEATURES:
                raise ValueError(f"{z.shape[1]} features; at most {MOST_FEATURES}")
            z = np.column_stack([np.ones(len(z)), z, b.column("y").to_numpy(zero_copy_only=False)])
            names = [b.column(k).to_pylist() for k in keys]
            kinds = [b.column(k).type for k in keys]
            groups: dict[tuple, list[int]] = {}
            for r, name in enumerate(zip(*names, strict=True) if keys else [()] * len(z)):
                groups.setdefault(name, []).append(r)
            for name, rows in groups.items():
                part = z[rows].T @ z[rows]
                sums[name] = sums[name] + part if name in sums else part
        for name, s in sums.items():
            i, j = np.triu_indices(len(s))
            columns = [pa.array([v] * len(i), k) for v, k in zip(name, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], names=[*keys, "i", "j", "v"])

    rows = df.where(F.col(y).isNotNull()).select(*keys, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.mapInArrow(run, schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _square(table: pa.Table) -> np.ndarray:
    """The full matrix of the entries (i, j, v) of an upper triangle."""
    i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
    n = int(max(i.max(), j.max())) + 1
    out = np.zeros((n, n))
    out[i, j] = out[j, i] = v
    return out


def squares(sums: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """The matrices of ``gram`` by group; entries reach the driver as Arrow columns."""
    table = sums.toArrow()
    if not len(table):
        return {}
    if not keys:
        return {(): _square(table)}
    names = table.select(keys).group_by(keys).aggregate([]).to_pylist()
    out = {}
    for name in names:
        own = None
        for k in keys:
            same = pc.is_null(table.column(k)) if name[k] is None else pc.equal(table.column(k), pa.scalar(name[k], table.column(k).type))
            own = same if own is None else pc.and_(own, same)
        out[tuple(name[k] for k in keys)] = _square(table.filter(own))
    return out


def solve_ridge(z: np.ndarray, alpha: float | np.ndarray, intercept: bool = True) -> np.ndarray:
    """[intercept, weights] minimising |y - Xw|^2 + alpha |w|^2 from Z'Z; the intercept is free."""
    a, b = z[:-1, :-1].copy(), z[:-1, -1]
    penalty = np.broadcast_to(alpha, len(a) - 1)
    if not intercept:
        return np.append(0.0, np.linalg.solve(a[1:, 1:] + np.diag(penalty), b[1:]))
    a[np.arange(1, len(a)), np.arange(1, len(a))] += penalty
    return np.linalg.solve(a, b)


def fit_ridge(df: DataFrame, x: str, y: str, alpha: float, *, intercept: bool = True, blocks: tuple[int, ...] | None = None, alphas: tuple[float, ...] | None = None) -> np.ndarray:
    """Ridge weights. ``blocks`` and ``alphas`` give groups of features penalties of their own."""
    penalty = np.repeat(alphas, blocks) if blocks else alpha
    return solve_ridge(_square(gram(df, x, y).toArrow()), penalty, intercept)


def fit_ridge_by_group(df: DataFrame, x: str, y: str, keys: list[str], alphas: list[float]) -> dict[tuple, dict[float, np.ndarray]]:
    """One pass over the data for all groups and penalties; a group is e.g. a fold."""
    return {k: {a: solve_ridge(z, a) for a in alphas} for k, z in squares(gram(df, x, y, keys), keys).items()}


def fold_errors(by: dict[int, np.ndarray], alphas: list[float]) -> list[tuple[float, int, float]]:
    """(alpha, fold, RMSE) from the Gram sums of each fold: the others are the whole less the fold's own."""
    whole, out = sum(by.values()), []
    for k, z in by.items():
        for a in alphas:
            w = solve_ridge(whole - z, a)
            # the error of a fold follows from its own sums: y'y - 2 w'Z'y + w'Z'Zw
            sse = z[-1, -1] - 2 * w @ z[:-1, -1] + w @ z[:-1, :-1] @ w
            out.append((a, k, float(np.sqrt(max(0.0, sse) / z[0, 0]))))
    return out


def cross_validate(df: DataFrame, x: str, y: str, fold: str, alphas: list[float]) -> DataFrame:
    """RMSE per (alpha, fold): Gram sums of each fold are subtracted from the whole, so data is read twice in all."""
    by = {k: z for (k,), z in squares(gram(df, x, y, [fold]), [fold]).items()}
    out = [(f"alpha={a:g}", int(k), e) for a, k, e in fold_errors(by, alphas)]
    return df.sparkSession.createDataFrame(out, "candidate_id string, fold_id int, rmse double")


def select_candidate(folds: DataFrame, metric: str, n_folds: int) -> DataFrame:
    """Mean and std over folds, whether complete, and the best complete one (smallest mean, then name)."""
    s = folds.groupBy("candidate_id").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("completed"))
    s = s.withColumn("partial", F.col("completed") < n_folds)
    best = s.where("not partial and mean is not null").orderBy("mean", "candidate_id").limit(1).select("candidate_id")
    return s.withColumn("selected", F.coalesce(F.col("candidate_id") == best.scalar(), F.lit(False)))


def pruned(folds: DataFrame, metric: str, incumbent: str, tolerance: float) -> DataFrame:
    """Candidates worse than the incumbent by more than ``tolerance`` on the folds that both have done; a difference of exactly it stays."""
    base = folds.where(F.col("candidate_id") == incumbent).select("fold_id", F.col(metric).alias("_base"))
    return folds.where(F.col("candidate_id") != incumbent).join(base, "fold_id").groupBy("candidate_id").agg(
        F.count("*").alias("common_folds"), F.avg(F.col(metric) - F.col("_base")).alias("excess")).withColumn("pruned", F.col("excess") > tolerance)


def linear(x: Column, weights: np.ndarray) -> Column:
    """Prediction with built-in functions."""
    w = F.lit(np.asarray(weights[1:], dtype=np.float64))  # one literal, however many weights
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(weights[0])), lambda s, v: s + v)


def pair_features(s1: Column, s2: Column, shared: bool) -> Column:
    """Direct: both detectors side by side. Shared: their difference, so a swap changes only the sign."""
    return F.zip_with(s1, s2, lambda a, b: a - b) if shared else F.concat(s1, s2)


def swap_rmse(df: DataFrame, s1: str, s2: str, predict: Callable[[Column, Column], Column]) -> DataFrame:
    """RMSE of f(a, b) + f(b, a): zero for an antisymmetric model."""
    both = predict(F.col(s1), F.col(s2)) + predict(F.col(s2), F.col(s1))
    return df.agg(F.sqrt(F.avg(both * both)).alias("swap_rmse"))


#: Rows of a block of references at least, pivots at most (their vectors are sent to every task), and blocks of
#: larger tables: a query travels to so many at most, however large the table.
BLOCK_ROWS, MOST_PIVOTS, BLOCKS = 2048, 1024, 64
#: Numbers of a table of distances, and pairs measured exactly, at once.
TABLE, PAIRS_AT_ONCE = 4_000_000, 100_000


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id``, ``v`` -> and ``pivot``, the nearest one (the first of equal ones), and ``away``, its distance."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                v = _matrix(part.column("v"))
                d = _distances(v, pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(near.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(v)), near]))], names=["id", "v", "pivot", "away"])

    return rows.mapInArrow(run, "id long, v array<double>, pivot int, away double")


def _distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distances, each summed in the same way wherever it is needed."""
    step = max(1, 4_000_000 // max(1, w.size))
    return np.concatenate([((v[i : i + step, None, :] - w[None]) ** 2).sum(axis=2) for i in range(0, len(v), step)]) if len(v) else np.zeros((0, len(w)))


def _nearest_of(i: np.ndarray, v: np.ndarray, bound: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int):
    """Places of rows of ``v``, and their k nearest of ``vecs`` (ids ascend) within ``bound``: (row, place, squared distance).

    A matrix product tells distances but for rounding; pairs that may be among the k nearest are measured exactly.
    """
    with np.errstate(all="ignore"):
        centre = vecs.mean(axis=0)
        centre = np.where(np.isfinite(centre), centre, 0.0)
        w = vecs - centre
        w2 = (w * w).sum(axis=1)
        for at in range(0, len(v), step := max(1, TABLE // len(vecs))):
            part, own = v[at : at + step] - centre, i[at : at + step]
            v2 = (part * part).sum(axis=1)
            slack = 1e-12 * (v2 + w2.max()) + 1e-300
            about = v2[:, None] + w2 - 2 * (part @ w.T)
            limit = bound[at : at + step] ** 2 * (1 + 1e-9) + slack
            maybe = ~(about > limit[:, None])  # what is no number is measured
            wide = np.flatnonzero(maybe.sum(axis=1) > 4 * k)
            same = np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left")
            place = k - 1 + int(same.max(initial=0))
            if len(wide) and place < len(vecs):
                kth = np.partition(about[wide], place, axis=1)[:, place]
                maybe[wide] &= ~(about[wide] > (kth + 2 * slack[wide])[:, None])
            row, col = np.nonzero(maybe)
            other = own[row] != ids[col]
            row, col = row[other] + at, col[other]
            d = np.concatenate([np.zeros(0), *(((v[row[p : p + PAIRS_AT_ONCE]] - vecs[col[p : p + PAIRS_AT_ONCE]]) ** 2).sum(axis=1) for p in range(0, len(row), PAIRS_AT_ONCE))])
            fine = np.isfinite(d)
            row, col, d = row[fine], col[fine], d[fine]
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield row[best], col[best], d[best]


def _best_of_blocks(ref: DataFrame, ask: DataFrame, k: int) -> DataFrame:
    """Each asked (``pivot``, ``sub``, ``id``, ``v``, perhaps ``bound``) with its k nearest references of that block: ``id``, ``ref_id``, ``distance2``."""

    def run(batches):
        held, ids, vecs = None, [], []

        def found(i, v, bound, ids, vecs):
            bound = np.where(np.isnan(bound), np.inf, bound)
            for row, col, d in _nearest_of(i, v, bound, ids, vecs, k):
                yield pa.RecordBatch.from_arrays([pa.array(i[row]), pa.array(ids[col]), pa.array(d)], names=["id", "ref_id", "distance2"])

        for b in batches:
            block = b.column("pivot").to_numpy().astype(np.int64) << 32 | b.column("sub").to_numpy()
            is_ref, i, v = b.column("is_ref").to_numpy(zero_copy_only=False), b.column("id").to_numpy(), _matrix(b.column("v"))
            bound = b.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            for lo, hi in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[lo] != held:
                    held, ids, vecs = block[lo], [], []
                r = slice(lo, lo + int(is_ref[lo:hi].sum()))  # references come first
                if r.stop > lo:
                    ids.append(i[r])
                    vecs.append(v[r])
                if r.stop < hi and ids:
                    if len(ids) > 1 or not np.all(ids[0][1:] >= ids[0][:-1]):
                        ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                        order = np.argsort(ids[0], kind="stable")
                        ids, vecs = [ids[0][order]], [vecs[0][order]]
                    yield from found(i[r.stop : hi], v[r.stop : hi], bound[r.stop : hi], ids[0], vecs[0])

    columns = ("pivot", "sub", "is_ref", "id", "v", "bound")
    none = F.lit(None).cast("double")
    ask = ask if "bound" in ask.columns else ask.withColumn("bound", none)
    both = ref.withColumns({"is_ref": F.lit(True), "bound": none}).select(*columns).unionAll(ask.withColumn("is_ref", F.lit(False)).select(*columns))
    dealt = both.repartition(int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pivot", "sub").sortWithinPartitions("pivot", "sub", F.desc("is_ref"), "id")
    return dealt.mapInArrow(run, "id long, ref_id long, distance2 double")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance2", "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "ref_id", "distance2")


def visits(queries: DataFrame, reference: DataFrame, id_col: str, vec: str, k: int, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The references in blocks, and every query with each block that can hold one of its k nearest.

    References are dealt to the nearest of some pivots (rows of the smallest hashes, one for about
    ``block`` rows, BLOCK_ROWS or a share of BLOCKS if not given), and those of a pivot with many to blocks of about ``block`` rows. A query's
    k-th distance in one block near it bounds its true one; by the triangle inequality it need not
    visit pivots whose references are all farther off, nor those beyond the plane half way to them.
    """
    wanted = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null and id is not null")
    ref, ask = stored(wanted(reference)), wanted(queries)
    n = ref.count()
    block = block or max(BLOCK_ROWS, -(-n // BLOCKS))
    some = ref.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(1, -(-n // block)))).toArrow()
    pivots = np.unique(_matrix(some.column("v").combine_chunks()), axis=0) if n else np.zeros((0, 0))
    if not n:
        empty = ask.limit(0).withColumn("pivot", F.lit(0)).withColumn("sub", F.lit(0).cast("long"))
        return empty, empty
    placed = stored(_assigned(ref, pivots))
    about = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("far")).toArrow()  # a row a pivot
    rows, far = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    rows[about.column("pivot").to_numpy()], far[about.column("pivot").to_numpy()] = about.column("n").to_numpy(), about.column("far").to_numpy()
    subs = np.maximum(1, -(-rows // block))
    number = F.get(F.array(*[F.lit(int(s)) for s in subs]), F.col("pivot"))
    spread = lambda df: df.withColumn("sub", F.pmod(F.xxhash64("id"), number))
    ref = spread(placed).select("pivot", "sub", "id", "v")
    homes = stored(spread(_assigned(ask, pivots)).select("pivot", "sub", "id", "v"))
    bound = _best_of_blocks(ref, homes, k).groupBy("id").agg(F.count("*").alias("_n"), F.sqrt(F.max("distance2")).alias("bound")).where(F.col("_n") >= k)
    known = homes.join(bound.select("id", "bound"), "id", "left")
    between = np.sqrt(_distances(pivots, pivots))

    def reached(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                v, limit = _matrix(part.column("v")), part.column("bound").to_numpy(zero_copy_only=False)
                limit = np.where(np.isnan(limit), np.inf, limit)[:, None]
                d2 = _distances(v, pivots)
                near = d2.argmin(axis=1)
                apart = between[near]
                with np.errstate(invalid="ignore", divide="ignore"):
                    plane = np.where(apart > 0, (d2 - d2[np.arange(len(v)), near][:, None]) / (2 * apart), -np.inf)
                # a little more than the bound, for what rounding may have taken
                slack = limit * (1 + 1e-9) + 1e-9 * np.sqrt(d2.max(axis=1, initial=0))[:, None]
                go = (np.sqrt(d2) - far <= slack) & (plane <= slack) & (rows > 0)
                row, pivot = np.nonzero(go)
                times = subs[pivot]
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at_row = pa.array(np.repeat(row, times))
                columns = [*(part.column(c).take(at_row) for c in ("id", "v", "bound")), pa.array(np.repeat(pivot, times).astype(np.int32)), pa.array(within)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "bound", "pivot", "sub"])

    return ref, known.select("id", "v", "bound").mapInArrow(reached, "id long, v array<double>, bound double, pivot int, sub long")


def nearest(queries: DataFrame, reference: DataFrame, id_col: str, vec: str, k: int, block: int | None = None) -> DataFrame:
    """Exact k nearest reference rows of every query row, itself left out: ``id``, ``rank``, ``ref_id``, ``distance2``.

    Queries travel only to blocks that can hold a neighbour (``visits``); each gives its k best within the bound,
    and a window over (id) keeps the best k of all. Ties take the smaller reference id. Rows without
    an id or a vector are left out; vectors have one length. The query set is stated by the caller.
    """
    return _best(_best_of_blocks(*visits(queries, reference, id_col, vec, k, block), k), k)


def tuned_neighbours(df: DataFrame, id_col: str, x: str, hidden: list[int], most: int) -> DataFrame:
    """Error of hidden samples filled by neighbours in the others: ``k``, ``by_distance``, ``rmse``, ``selected``.

    Every row is left out of its own neighbours. The best pair has the smallest error, then the smaller k, then equal weights.
    """
    all_but = F.filter(F.col(x), lambda _, i: ~i.isin(*hidden))
    seen = df.select(F.col(id_col).alias("id"), all_but.alias("_v"))
    truth = df.select(F.col(id_col).alias("id"), F.posexplode(x).alias("i", "y")).where(F.col("i").isin(*hidden))
    met = stored(nearest(seen, seen, "id", "_v", most))
    errors = []
    for by_distance in (False, True):
        weight = _neighbour_weights(met, by_distance)
        each = weight.join(truth.select(F.col("id").alias("ref_id"), "i", F.col("y").alias("_y")), "ref_id")
        w = Window.partitionBy("id", "i").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = each.select("id", "i", F.col("rank").alias("k"), (F.sum(F.col("_w") * F.col("_y")).over(w) / F.nullif(F.sum("_w").over(w), F.lit(0.0))).alias("p"))
        errors.append(filled.join(truth, ["id", "i"]).groupBy("k").agg(F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2)).alias("rmse")).select("k", F.lit(by_distance).alias("by_distance"), "rmse"))
    found = errors[0].unionAll(errors[1])
    first = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("rmse", "k", "by_distance"))  # a row for each k and weight
    return found.withColumn("selected", first == 1)


def _neighbour_weights(neighbours: DataFrame, by_distance: bool) -> DataFrame:
    """Adds ``_w``: 1, or the inverse distance; zero distances decide alone."""
    if not by_distance:
        return neighbours.withColumn("_w", F.lit(1.0))
    none = F.min("distance2").over(Window.partitionBy("id")) == 0
    return neighbours.withColumn("_w", F.when(none, (F.col("distance2") == 0).cast("double")).otherwise(1 / F.sqrt(F.nullif("distance2", F.lit(0.0)))))


def neighbour_mean(neighbours: DataFrame, labels: DataFrame, id_col: str, value: str, by_distance: bool = False) -> DataFrame:
    """Prediction for every k at once: the running mean over ranks; inverse-distance weights let zero distances decide alone."""
    j = _neighbour_weights(neighbours, by_distance).join(labels.select(F.col(id_col).alias("ref_id"), F.col(value).alias("_y")), "ref_id")
    w = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select("id", F.col("rank").alias("k"), (F.sum(F.col("_w") * F.col("_y")).over(w) / F.nullif(F.sum("_w").over(w), F.lit(0.0))).alias("prediction"))


def fit_ppca(df: DataFrame, x: str, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, loadings and noise variance of probabilistic PCA, from the same sums."""
    z = _square(gram(df.withColumn("_zero", F.lit(0.0)), x, "_zero").toArrow())[:-1, :-1]
    n, mean = z[0, 0], z[0, 1:] / z[0, 0]
    cov = z[1:, 1:] / n - np.outer(mean, mean)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    noise = float(value[components:].mean()) if components < len(value) else 1e-12
    w = vector[:, :components] * np.sqrt(np.maximum(value[:components] - noise, 0))
    return mean, w, max(noise, 1e-12)


def ppca_fill(df: DataFrame, id_col: str, x: str, model: tuple[np.ndarray, np.ndarray, float], missing: list[int]) -> DataFrame:
    """Conditional mean of the missing places given the others: ``id``, ``filled``."""
    mean, w, noise = model
    gone = np.zeros(len(mean), dtype=bool)
    gone[missing] = True
    c = w @ w.T + noise * np.eye(len(mean))
    back = np.linalg.solve(c[np.ix_(~gone, ~gone)], c[np.ix_(~gone, gone)])

    def run(batches):
        for b in batches:
            v = _matrix(b.column("x")).copy()
            v[:, gone] = mean[gone] + (v[:, ~gone] - mean[~gone]) @ back
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), out], names=["id", "filled"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "id long, filled array<double>")


def window_shapley(df: DataFrame, id_col: str, x: str, references: list[list[float]], width: int, stride: int, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Two-player Shapley value of every window against the rest, averaged over references.

    phi(W) = [(v(W) - v(none)) + (v(all) - v(all but W))] / 2, where samples outside a
    coalition are taken from the reference. References are a stated, small list.
    """
    refs = np.array(references, dtype=np.float64)

    def run(batches):
        for b in batches:
            v = _matrix(b.column("x"))
            starts = range(0, v.shape[1] - width + 1, stride)
            full = predict(v)
            phi = np.zeros((len(v), len(starts)))
            for r in refs:
                none = predict(np.broadcast_to(r, v.shape))
                for s, a in enumerate(starts):
                    only, rest = np.tile(r, (len(v), 1)), v.copy()
                    only[:, a : a + width] = v[:, a : a + width]
                    rest[:, a : a + width] = r[a : a + width]
                    phi[:, s] += (predict(only) - none + full - predict(rest)) / 2
            phi /= len(refs)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), len(starts))), pa.array(np.tile(np.array(starts, np.int32), len(v))), pa.array(phi.ravel())], names=["id", "start", "phi"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "id long, start int, phi double")


def signed_summary(attributions: DataFrame) -> DataFrame:
    """Means of the positive and negative parts per window."""
    return attributions.groupBy("start").agg(F.count("*").alias("n"), F.avg("phi").alias("mean"), F.avg(F.greatest("phi", F.lit(0.0))).alias("positive"), F.avg(F.least("phi", F.lit(0.0))).alias("negative"), F.avg(F.abs("phi")).alias("absolute"))


def blend_weight(df: DataFrame, a: str, b: str, truth: str) -> DataFrame:
    """The share of a in a + b's best blend: clip(sum((y-b)(a-b)) / sum((a-b)^2), 0, 1)."""
    d = F.col(a) - F.col(b)
    return df.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.sum((F.col(truth) - F.col(b)) * d), F.sum(d * d)))).alias("alpha"))


def spectral_lowpass(df: DataFrame, id_col: str, x: str, cutoff: float, order: int = 4) -> DataFrame:
    """Zero-phase Butterworth-shaped low-pass of each waveform: gain 1 / (1 + (f / cutoff)^(2 order)), padded by reflection.

    ``cutoff`` is in cycles per sample.
    """

    def run(batches):
        for b in batches:
            v = _matrix(b.column("x"))
            n = v.shape[1]
            odd = np.concatenate([2 * v[:, :1] - v[:, n - 1 : 0 : -1], v, 2 * v[:, -1:] - v[:, n - 2 :: -1]], axis=1)
            f = np.fft.rfftfreq(odd.shape[1])
            out = np.fft.irfft(np.fft.rfft(odd, axis=1) / (1 + (f / cutoff) ** (2 * order)), odd.shape[1], axis=1)[:, n - 1 : 2 * n - 1]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n, dtype=np.int32)), pa.array(out.ravel()))], names=["id", "filtered"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "id long, filtered array<double>")


def periodogram(df: DataFrame, x: str) -> DataFrame:
    """Averaged spectrum: total, coherent and variable power and phase consistency per frequency bin.

    Tasks add up transforms per bin, so only (bins x tasks) rows are shuffled.
    """

    def run(batches):
        re = im = power = unit_re = unit_im = None
        n = 0
        for b in batches:
            v = _matrix(b.column("x"))
            f = np.fft.rfft((v - v.mean(axis=1, keepdims=True)) * np.hanning(v.shape[1]), axis=1)
            u = f / np.maximum(np.abs(f), 1e-300)
            part = (f.real.sum(0), f.imag.sum(0), (np.abs(f) ** 2).sum(0), u.real.sum(0), u.imag.sum(0))
            re, im, power, unit_re, unit_im = part if re is None else (a + c for a, c in zip((re, im, power, unit_re, unit_im), part, strict=True))
            n += len(v)
        if n:
            k = len(re)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, n, np.int64)), *(pa.array(c) for c in (re, im, power, unit_re, unit_im))], names=["bin", "n", "re", "im", "power", "ur", "ui"])

    s = df.select(F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "bin int, n long, re double, im double, power double, ur double, ui double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "re", "im", "power", "ur", "ui")])
    coherent = (F.col("re") / F.col("n")) ** 2 + (F.col("im") / F.col("n")) ** 2
    return s.select("bin", "n", (F.col("power") / F.col("n")).alias("total"), coherent.alias("coherent"), (F.col("power") / F.col("n") - coherent).alias("variable"), (F.hypot("ur", "ui") / F.col("n")).alias("consistency"))

"""Bootstrap intervals, shadow floors, permutation p-values and false discovery rates.

Replicates are drawn on counts and not on rows, one way at every size: a bootstrap is a multinomial over the cells of (item, class), a permutation a table
with the same margins. Items are the side of many values (x, or a numeric y against levels of x), classes the other. The distinct items of a feature are cut, in their order, into
blocks of BLOCK. How many rows of each class a replicate has in a block comes from splitting the whole in halves down to the block, by binomial or hypergeometric
draws whose generators are named by seed, feature and half, so tasks agree without talking. In its block a task draws the items' counts and sums up what the metric needs; sums of blocks
add up to the metric of the replicate. Values are never binned, but for Spearman's coefficient (see GRID).

A function of (x, y) as metric is called on whole columns of replicates, a feature to a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pandas
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.thresholds import SHADOW_PCT
from ..sources.scratch import keep
from .folds import Folds
from .longform import cells
from .ranking import cumulative, row_numbers

BLOCK = 50_000  # distinct items of a block
ROWS = 1 << 22  # up to so many rows of a block are drawn one by one, more by splitting counts: the same distribution
EACH = 8, 8  # the same bound for each item of the block, for a bootstrap and for a permutation (and class but one): beyond it splitting is quicker
#: Both sides of Spearman's coefficient have many values. Over (GRID, CLASSES) of them, the replicates use ranks of quantile bins, whose variance is less by 1 / GRID**2 and
#: 1 / CLASSES**2 of the whole at most, so a replicate is off by less than 2e-5.
GRID, CLASSES = 1024, 256
TURNED = ("Cliff's δ", "point-biserial", "η²")  # items are the values of y
PART = 16  # replicates of a row of sums
LARGE = 10**9


# draws


def _stirling(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula."""
    n = np.maximum(n, 1.0)
    small = np.array([math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) if k else 0.0 for k in range(16)])
    return np.where(n < 16, small[np.minimum(n, 15).astype(int)], (1 / 12 - (1 / 360 - 1 / (1260 * n * n)) / (n * n)) / n)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation."""
    d = (x - mean) / mean
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, mean * ((1 + d) * np.log1p(np.maximum(d, -1 + 1e-300)) - d), mean)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the binomial probability."""
    q = 1 - p
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * np.log(n / (2 * np.pi * x * (n - x)))
        return np.where(x <= 0, n * np.log1p(-p), np.where(x >= n, n * np.log(p), inner))


def _large(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Hypergeometric draws from populations of any size: one by one for up to 10, else by the ratio of uniforms."""
    least, total = np.minimum(good, bad).astype(float), (good + bad).astype(float)
    n = np.minimum(sample, good + bad - sample).astype(float)
    out = np.zeros(len(good))
    few = n <= 10
    for k in range(10):
        on = few & (k < n)
        out += on & (rng.random(len(n)) * (total - k) < least - out)
    todo = np.flatnonzero(~few & (least > 0))
    share = least / np.maximum(total, 1)
    centre = n * share + 0.5
    sd = np.sqrt((total - n) * n * share * (1 - share) / np.maximum(total - 1, 1) + 0.5)
    width = 1.7155277699214135 * sd + 0.8989161620588988
    end = np.minimum(np.minimum(n, least) + 1, np.floor(centre + 16 * sd))
    mode = np.floor((n + 1) * (least + 1) / (total + 2))
    log_p = lambda k, i: _log_binomial(k, least[i], n[i] / total[i]) + _log_binomial(n[i] - k, total[i] - least[i], n[i] / total[i])
    top = np.zeros(len(n))
    top[todo] = log_p(mode[todo], todo)
    while len(todo):
        u, v = rng.random(len(todo)), rng.random(len(todo))
        w = centre[todo] + width[todo] * (v - 0.5) / np.maximum(u, 1e-300)
        k = np.floor(w)
        fit = (w >= 0) & (k < end[todo])
        ok = np.zeros(len(todo), bool)
        i = todo[fit]
        ok[fit] = 2 * np.log(np.maximum(u[fit], 1e-300)) <= log_p(k[fit], i) - top[i]
        out[todo[ok]] = k[ok]
        todo = todo[~ok]
    out = np.where(good > bad, n - out, out)
    return np.where(n < sample, good - out, out).astype(np.int64)


def hypergeometric(rng: np.random.Generator, good, bad, sample) -> np.ndarray:
    """How many of a sample without replacement are good, elementwise; exact at every size."""
    good, bad, sample = np.broadcast_arrays(*(np.asarray(v, np.int64) for v in (good, bad, sample)))
    big = (good >= LARGE) | (bad >= LARGE)
    if not big.any():
        return rng.hypergeometric(good, bad, sample)
    out = np.empty(good.shape, np.int64)
    out[~big] = rng.hypergeometric(good[~big], bad[~big], sample[~big])
    out[big] = _large(rng, good[big], bad[big], sample[big])
    return out


def deal(rng: np.random.Generator, classes: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Of populations with classes[..., k] of each class, the classes of a sample without replacement."""
    out, left, rest = np.zeros_like(classes), classes.sum(-1), np.broadcast_to(sample, classes.shape[:-1]).astype(np.int64)
    for k in range(classes.shape[-1] - 1):
        left = left - classes[..., k]
        out[..., k] = hypergeometric(rng, classes[..., k], left, rest)
        rest = rest - out[..., k]
    out[..., -1] = rest
    return out


def _halves(lo: int, hi: int, block: int):
    while hi - lo > 1:
        middle = (lo + hi) // 2
        yield lo, middle, hi
        lo, hi = (lo, middle) if block < middle else (middle, hi)


def classes_of_block(at: np.ndarray, block: int, b: int, permute: bool, name: list[int]) -> np.ndarray:
    """(b, classes): rows of each class that b replicates have in a block. at[i]: rows of each class before block i."""
    total = at[-1]
    if permute:
        now = np.tile(total, (b, 1))
    else:
        now = np.random.default_rng([*name, 0, 0]).multinomial(int(total.sum()), total / total.sum(), b)
    for lo, middle, hi in _halves(0, len(at) - 1, block):
        rng = np.random.default_rng([*name, lo + 1, hi])
        left, whole = at[middle] - at[lo], at[hi] - at[lo]
        part = deal(rng, now, left.sum()) if permute else rng.binomial(now, np.minimum(left / np.maximum(whole, 1), 1))
        now = part if block < middle else now - part
    return now


def tables(rng: np.random.Generator, t: np.ndarray, classes: np.ndarray, permute: bool):
    """For each row of classes a replicate of the block t (items, classes) that has so many of each class."""
    items, k = t.shape
    rows = t.sum(1)
    if not permute:
        size = t.sum(0)
        place = [np.repeat(np.arange(items), t[:, c]) if size[c] <= min(ROWS, EACH[0] * items) else None for c in range(k)]
        for want in classes:
            out = np.zeros((items, k))
            for c in np.flatnonzero(want):
                out[:, c] = np.bincount(place[c][rng.integers(0, size[c], want[c])], minlength=items) if place[c] is not None else rng.multinomial(want[c], t[:, c] / size[c])
            yield out
    elif rows.sum() <= min(ROWS, EACH[1] * items * max(k - 1, 1)):
        place = np.repeat(np.arange(items), rows) * k
        for want in classes:
            yield np.bincount(place + rng.permutation(np.repeat(np.arange(k), want)), minlength=items * k).reshape(items, k).astype(float)
    else:
        sums = [np.concatenate([rows, np.zeros((1 << (items - 1).bit_length()) - items, np.int64)])]
        while len(sums[-1]) > 1:
            sums.append(sums[-1].reshape(-1, 2).sum(1))
        for want in classes:
            now = want[None, :].astype(np.int64)
            for below in sums[-2::-1]:
                left = deal(rng, now, below[::2])
                now = np.stack([left, now - left], 1).reshape(-1, k)
            yield now[:items].astype(float)


# metrics as sums over blocks


def _rank_sums(t, v, _):
    n = t.sum(1)
    return np.concatenate([t.sum(0), (np.cumsum(n) - n + (n + 1) / 2) @ t, [(n**3 - n).sum()]])


def _iv_sums(t, v, _):
    ratio = np.log((t[:, 0] + 0.5) / (t[:, 1] + 0.5)) if t.shape[1] == 2 else np.zeros(len(t))
    return np.concatenate([t.sum(0)[:2], ratio @ t[:, :2]])


def _share_sums(t, v, _):
    n = t.sum(1)
    return np.concatenate([t.sum(0), (t * t / np.maximum(n, 1)[:, None]).sum(0), [(n > 0).sum()]])


def _moment_sums(t, v, _):
    return np.concatenate([t.sum(0), v @ t, [v * v @ t.sum(1)]])


def _fold_sums(t, v, folds):
    """Classes are (y, fold), y first. Of each fold the sums of its test rows' counts with their weights, and of all its counts."""
    out, by = [], t.reshape(len(t), 2, -1)
    for test, train in folds:
        e, r = by[:, :, test].sum(2), by[:, :, train].sum(2)
        has = r.sum(1) > 0
        w = np.where(has, np.log((r[:, 0] + 0.5) / (r[:, 1] + 0.5)), 0.0)
        out += [*(w @ e), *(has @ e), *e.sum(0), *r.sum(0)]
    return np.array(out)


def _spearman(t, v, _):
    r = lambda n: np.cumsum(n) - n + (n + 1) / 2
    rows, cols, n = t.sum(1), t.sum(0), t.sum()
    a, b = r(rows) - (n + 1) / 2, r(cols) - (n + 1) / 2
    below = (rows @ (a * a)) * (cols @ (b * b))
    return np.array([abs(a @ t @ b) / below**0.5 if below > 0 else math.nan])


def _ranked(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """m: sums of the blocks in order."""
    n = m[:, :k]
    size = n.sum(1)
    return n.sum(0), (m[:, k : 2 * k] + n * (np.cumsum(size) - size)[:, None]).sum(0), m[:, 2 * k].sum()


def _area(m, k, _):
    (neg, pos), (_, s), _ = _ranked(m, k) if k == 2 else ((0, 0), (0, 0), 0)
    return (s - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else math.nan


def _auc(m, k, _):
    a = _area(m, k, _)
    return max(a, 1 - a) if a == a else a


def _kruskal(m, k, _):
    c, s, ties = _ranked(m, k)
    c, s, n = c[c > 0], s[c > 0], c.sum()
    if len(c) < 2 or ties >= n**3 - n:
        return math.nan
    return (12 / (n * (n + 1)) * (s * s / c).sum() - 3 * (n + 1)) / (1 - ties / (n**3 - n)) / (n - 1)


def _iv(m, k, _):
    g, b, x, y = m.sum(0) if k == 2 else (0, 0, 0, 0)
    return x / g - y / b if g and b else math.nan


def _bergsma(m, k, _):
    m = m.sum(0)
    c, q, r = m[:k], m[k : 2 * k], m[-1]
    q, c = q[c > 0], c[c > 0]
    k, n = len(c), c.sum()
    if min(r, k) < 2 or n < 2:
        return math.nan
    phi = max(0.0, (q / c).sum() - 1 - (r - 1) * (k - 1) / (n - 1))
    least = min(r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)) - 1
    return (phi / least) ** 0.5 if least > 0 else math.nan


def _correlation(m, k, values):
    m = m.sum(0)
    c, s, q = m[:k], m[k : 2 * k], m[-1]
    n = c.sum()
    a = np.asarray(values, float) - (c @ np.asarray(values, float)) / max(n, 1)
    below = (c @ (a * a)) * (q - s.sum() ** 2 / max(n, 1))
    return abs(a @ s) / below**0.5 if below > 0 else math.nan


def _eta(m, k, _):
    m = m.sum(0)
    c, s, q = m[:k], m[k : 2 * k], m[-1]
    mean = s.sum() / max(c.sum(), 1)
    total = q - c.sum() * mean**2
    return float(np.clip((s[c > 0] ** 2 / c[c > 0]).sum() - c.sum() * mean**2, 0, None) / total) if total > 0 else 0.0


def _iv_oof(m, k, _):
    found = []
    for wg, wb, hg, hb, eg, eb, rg, rb in m.sum(0).reshape(-1, 8):
        if min(eg, eb, rg, rb) > 0:
            low = math.log((rg + 0.5) / (rb + 0.5))
            found.append((wg - low * hg) / eg - (wb - low * hb) / eb)
    return float(np.mean(found)) if found else math.nan


#: metric -> (sums of a block from its table, item values and folds; metric from the sums of the blocks, number of classes and class values).
METRICS = {
    "AUC": (_rank_sums, _auc), "Cliff's δ": (_rank_sums, lambda m, k, v: abs(2 * _area(m, k, v) - 1)), "KW ε²": (_rank_sums, _kruskal), "IV": (_iv_sums, _iv), "Cramér's V": (_share_sums, _bergsma),
    "point-biserial": (_moment_sums, _correlation), "η²": (_moment_sums, _eta), "IV (oof)": (_fold_sums, _iv_oof), "Spearman ρ": (_spearman, lambda m, k, v: m[0, 0]),
    "ties": (_rank_sums, lambda m, k, v: m[:, 2 * k].sum()), "positives": (_rank_sums, lambda m, k, v: m[:, 1].sum()),  # margins, which permutations keep
}


def of_table(metric: str, t: np.ndarray, items: np.ndarray, classes: np.ndarray, folds=None) -> float:
    """The metric of one table (items, classes)."""
    sums, close = METRICS[metric]
    return float(close(sums(t.astype(float), items, folds)[None, :], t.shape[1], classes))


def _binned(c: DataFrame, by: list[str], column: str, into: str, grid: int) -> DataFrame:
    """(by, column, into): position of the value's bin, in ascending order; one value a bin if there are no more than grid."""
    one = c.groupBy(*by, column).agg(F.sum("n").alias("__n"))
    size = one.groupBy(*by).agg(F.count(F.lit(1)).alias("__d"), F.sum("__n").alias("__t"))
    placed = cumulative(one, by, [F.col(column)], "__n", "__at").join(F.broadcast(size), by)
    return placed.select(*by, column, F.when(F.col("__d") <= grid, F.col("__at")).otherwise(F.floor(F.col("__at") * F.lit(float(grid)) / F.col("__t"))).cast("long").alias(into))


def _cells(long: DataFrame, metric: str) -> DataFrame:
    """(feature, item, cls, n) as the metric wants it."""
    x, y = ("y", "x") if metric in TURNED else ("x", "y")
    if metric == "IV (oof)":
        return long.groupBy("feature", F.coalesce("x", F.lit("\0")).alias("item"), F.struct("y", "fold").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    c = cells(long, ["feature"], "x", "y")
    if metric == "Spearman ρ":
        c = keep(c)
        c = c.join(_binned(c, ["feature"], "x", "item", GRID), ["feature", "x"]).join(_binned(c, ["feature"], "y", "cls", CLASSES), ["feature", "y"])
        return c.groupBy("feature", "item", "cls").agg(F.sum("n").alias("n"))
    number = dict(long.dtypes)[x] != "string"
    return c.select("feature", F.col(x).cast("double" if number else "string").alias("item"), F.col(y).alias("cls"), "n")


def _name(seed: int, feature: str) -> list[int]:
    return [seed, zlib.crc32(feature.encode())]


def _spread(blocks: int, parts: int, cores: int) -> tuple[int, int]:
    """Into how many units the replicates of a block are dealt, and the number of tasks. Few blocks are drawn by more tasks than blocks. The tasks are heavy for their
    bytes, so their number is named: it isn't coalesced."""
    share = max(1, min(parts, -(-4 * cores // max(blocks, 1))))
    return share, max(1, min(blocks * share, max(4 * cores, blocks * share // 4)))


def replicates(long: DataFrame, metric: str, ci_b: int, shadow_b: int, seed: int, folds: Folds | None = None, block: int = BLOCK) -> DataFrame:
    """(feature, kind, part, v): the metric of PART replicates, of bootstraps (kind 0) and permutations (kind 1), for all features of a metric."""
    block = GRID if metric == "Spearman ρ" else block  # its table is one block
    spark = long.sparkSession
    c = keep(_cells(long, metric))
    found: dict[str, list] = {}
    for r in c.select("feature", "cls").distinct().collect():
        found.setdefault(r["feature"], []).append(r["cls"])
    train = None
    if folds is not None:
        fs = list(range(folds.k + 1))
        codes = {f: [(y, k) for y in (0, 1) for k in fs] for f in found}
        flag = lambda made: [bool(r) for r in spark.range(1).select(*[made(F.lit(k)) for k in fs]).first()]
        train = [(np.array(flag(lambda k, f=f: folds.is_test(k, f))), np.array(flag(lambda k, f=f: folds.is_train(k, f)))) for f in range(1, folds.k + 1)]
    else:
        codes = {f: sorted(v) for f, v in found.items()}
    kind = dict(c.dtypes)["cls"]
    table = spark.createDataFrame([(f, v, k) for f, vs in codes.items() for k, v in enumerate(vs)], f"feature string, cls {kind}, k int")
    # levels of the classes: as many rows as the driver has just read
    items = c.join(F.broadcast(table), ["feature", "cls"]).groupBy("feature", "item").agg(F.collect_list(F.struct("k", "n")).alias("per"))
    placed = keep(row_numbers(items, ["feature"], ["item"]).withColumn("block", F.floor(F.col("rn") / block)))
    at: dict[str, np.ndarray] = {}
    size = {r["feature"]: r["b"] + 1 for r in placed.groupBy("feature").agg(F.max("block").alias("b")).collect()}
    for r in placed.select("feature", "block", F.explode("per").alias("e")).groupBy("feature", "block", "e.k").agg(F.sum("e.n").alias("n")).toLocalIterator():
        at.setdefault(r["feature"], np.zeros((size[r["feature"]] + 1, len(codes[r["feature"]])), np.int64))[r["block"] + 1, r["k"]] += r["n"]
    at = {f: np.cumsum(v, 0) for f, v in at.items()}
    numeric = dict(c.dtypes)["item"] == "double"
    centre = {r["feature"]: r["m"] for r in c.groupBy("feature").agg((F.sum(F.col("item") * F.col("n")) / F.sum("n")).alias("m")).collect()} if numeric else {}
    shared = spark.sparkContext.broadcast((at, centre, train))
    parts = [(kind, i) for kind, b in enumerate((ci_b, shadow_b)) for i in range(0, b, PART)]
    share, tasks = _spread(sum(size.values()), len(parts), spark.sparkContext.defaultParallelism)
    before = {f: sum(v for g, v in size.items() if g < f) for f in size}
    serial = spark.createDataFrame(list(before.items()), "feature string, first long")
    units = placed.join(F.broadcast(serial), "feature").withColumn("unit", F.explode(F.array([F.lit(i) for i in range(share)])))
    units = units.withColumn("task", (((F.col("first") + F.col("block")) * share + F.col("unit")) % tasks).cast("int")).drop("first")

    def draw(g: pa.Table) -> pa.Table:
        at, centre, train = shared.value
        g = g.sort_by("rn").combine_chunks()
        feature, number = g["feature"][0].as_py(), g["block"][0].as_py()
        k, per = at[feature].shape[1], g["per"].combine_chunks()
        t = np.zeros((g.num_rows, k), np.int64)
        flat = per.flatten()
        t[np.repeat(np.arange(g.num_rows), per.value_lengths().to_numpy()), flat.field("k").to_numpy()] = flat.field("n").to_numpy()
        v = g["item"].to_numpy() - centre[feature] if numeric else np.zeros(g.num_rows)
        rows, unit = [], g["unit"][0].as_py()
        want: dict[int, np.ndarray] = {}
        for kind, i in parts[unit::share]:
            name = [*_name(seed, feature), kind]
            if kind not in want:
                want[kind] = classes_of_block(at[feature], number, (ci_b, shadow_b)[kind], bool(kind), name)
            rng = np.random.default_rng([*name, 1 << 31, number, i])
            made = np.array([METRICS[metric][0](s, v, train) for s in tables(rng, t, want[kind][i : i + PART], bool(kind))])
            rows.append((feature, kind, i, number, made.tobytes()))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["feature", "kind", "part", "block", "m"])

    def close(g: pa.Table) -> pa.Table:
        g = g.sort_by("block")
        feature = g["feature"][0].as_py()
        values, b = codes[feature], min(PART, (ci_b, shadow_b)[g["kind"][0].as_py()] - g["part"][0].as_py())
        m = np.stack([np.frombuffer(x, float).reshape(b, -1) for x in g["m"].to_pylist()], 1)
        v = [float(METRICS[metric][1](r, len(values), values)) for r in m]
        return pa.Table.from_arrays([g["feature"][:1], g["kind"][:1], g["part"][:1], pa.array([v], pa.list_(pa.float64()))], ["feature", "kind", "part", "v"])

    if not ci_b and not shadow_b:
        return spark.createDataFrame([], "feature string, kind int, part int, v array<double>")
    drawn = units.repartitionById(tasks, F.col("task")).groupBy("task", "feature", "block", "unit").applyInArrow(draw, "feature string, kind int, part int, block long, m binary")
    return drawn.groupBy("feature", "kind", "part").applyInArrow(close, "feature string, kind int, part int, v array<double>")


def _called(long: DataFrame, fn: Callable, ci_b: int, shadow_b: int, seed: int) -> DataFrame:
    """The same for a function of two arrays, on the rows of a feature."""
    c = cells(long, ["feature"], "x", "y")

    def one(key: tuple, g: pandas.DataFrame) -> pandas.DataFrame:
        g = g.sort_values(["x", "y"])
        x, y = (np.repeat(g[k].to_numpy(), g["n"]) for k in ("x", "y"))
        rng, rows = np.random.default_rng(_name(seed, key[0])), []
        for kind, b in enumerate((ci_b, shadow_b)):
            v = []
            for _ in range(b):
                i = rng.integers(0, len(x), len(x))
                v.append(float(fn(x, rng.permutation(y)) if kind else fn(x[i], y[i])))
            rows += [(key[0], kind, j, v[j : j + PART]) for j in range(0, b, PART)]
        return pandas.DataFrame(rows, columns=["feature", "kind", "part", "v"])

    return c.groupBy("feature").applyInPandas(one, "feature string, kind int, part int, v array<double>")


def resample(long: DataFrame, metrics: dict[str, str | Callable], ci_b: int = 200, shadow_b: int = 50, seed: int = 42, ci: float = 0.95, folds: Folds | None = None, block: int = BLOCK) -> DataFrame:
    """(feature, ci_lo, ci_hi, shadow array): see the module. long: (feature, x, y), for 'IV (oof)' with fold; metrics: feature -> name in METRICS, or
    a function of the arrays x and y of a sample. A metric that isn't defined on a replicate is NaN and left out of the interval. Features without rows have no row."""
    groups: dict = {}
    for f, m in metrics.items():
        groups.setdefault(m, []).append(f)
    made = None
    for m, fs in groups.items():
        some = long.where(F.col("feature").isin(*fs))
        part = _called(some, m, ci_b, shadow_b, seed) if callable(m) else replicates(some, m, ci_b, shadow_b, seed, folds if m == "IV (oof)" else None, block)
        made = part if made is None else made.unionByName(part)

    def one(key: tuple, g: pandas.DataFrame) -> pandas.DataFrame:
        g = g.sort_values("part")
        boot, shadow = (np.concatenate([np.zeros(0), *g.loc[g["kind"] == k, "v"]]) for k in (0, 1))
        boot = boot[np.isfinite(boot)]
        lo, hi = np.quantile(boot, [(1 - ci) / 2, (1 + ci) / 2]) if len(boot) else (math.nan, math.nan)
        return pandas.DataFrame([[key[0], lo, hi, shadow.tolist()]])

    return made.groupBy("feature").applyInPandas(one, "feature string, ci_lo double, ci_hi double, shadow array<double>")


def shadow_floor(shadow: np.ndarray, pct: float = SHADOW_PCT) -> float:
    good = np.asarray(shadow, float)
    good = good[np.isfinite(good)]
    return float(np.quantile(good, pct)) if len(good) else float("nan")


def permutation_p(effect: float, shadow) -> float:
    """(1 + number of shadows that reach the effect) / (number + 1); NaN for an effect that isn't finite."""
    good = np.asarray(shadow, float)
    good = good[~np.isnan(good)]
    return float((1 + (good >= effect).sum()) / (len(good) + 1)) if effect is not None and np.isfinite(effect) else float("nan")


def bh_fdr(tests: DataFrame, p: str = "p", into: str = "q") -> DataFrame:
    """tests (one row for each, few) with Benjamini-Hochberg q; null for a null or NaN p, which isn't counted."""
    ok = tests.withColumn("__p", F.when(~F.isnan(p), F.col(p)))
    m = F.count("__p").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.col("__p").isNull()).orderBy("__p"))
    rest = Window.partitionBy(F.col("__p").isNull()).orderBy("__p", "__r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scored = ok.withColumn("__m", m).withColumn("__r", rank)
    return scored.withColumn(into, F.when(F.col("__p").isNotNull(), F.least(F.lit(1.0), F.min(F.col("__p") * F.col("__m") / F.col("__r")).over(rest)))).drop("__p", "__m", "__r")

"""All-relevant cross-check: which columns does a random forest prefer to shuffled copies of columns?"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_number, number
from ..sources.scratch import keep, small
from .profile import _text
from .ranking import row_numbers


def _coded(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with the number of the column's value in their order, null for null."""
    levels = keep(df.select(_text(df, column).alias("__v")).where("__v is not null").distinct())
    coded = keep(row_numbers(levels, [], ["__v"]).select("__v", F.col("rn").cast("double").alias(into)))
    return df.join(small(coded), _text(df, column) == F.col("__v"), "left").drop("__v")


def _encoded(df: DataFrame, target: str, target_type: str, features: list[str]) -> DataFrame:
    """Numbers as they are and strings by the order of their values, nulls as the median; rows without a target are left out."""
    rows = df.where(F.col(target).isNotNull())
    rows = rows.withColumn("__y", number(target)) if target_type == "regression" else _coded(rows, target, "__y")
    cols = {}
    for i, f in enumerate(features):
        if is_number(df.schema[f].dataType):
            cols[f] = number(f)
        else:
            rows = _coded(rows, f, f"__c_{i}")
            cols[f] = F.col(f"__c_{i}")
    wide = keep(rows.select(F.col("__y").alias("label"), *[c.alias(f"x{i}") for i, c in enumerate(cols.values())]))
    medians = wide.agg(*[F.percentile_approx(f"x{i}", 0.5).alias(f"x{i}") for i in range(len(features))]).first()
    return wide.na.fill({f"x{i}": float(medians[f"x{i}"] or 0.0) for i in range(len(features))})


COPIES = 5  # at least so many shuffled columns compete
BINS = 32  # of a column; cuts lie between them
LEAST, MOST = 1 << 15, 1 << 17  # rows of a block
WEIGHTS = 8  # a row is drawn fewer times than WEIGHTS + 1; the weights' probabilities are multiples of 2**-16
CHUNK_MB, PASS_MB = 1, 48  # counts of the trees that are summed up together, and of those that a task grows together


def _bin_edges(wide: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """The upper ends of a column's bins but the last: its values if there are no more than BINS, else quantiles."""

    def some_values(batches):
        found = [np.zeros(0)] * len(columns)
        for b in batches:
            for i, c in enumerate(columns):
                if len(found[i]) <= BINS:
                    found[i] = np.unique(np.concatenate([found[i], b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)]))[: BINS + 1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), pa.array([v.tolist() for v in found], pa.list_(pa.float64()))], ["i", "v"])

    edges = [np.zeros(0)] * len(columns)
    for r in wide.select(*columns).mapInArrow(some_values, "i int, v array<double>").collect():
        edges[r["i"]] = np.unique(np.concatenate([edges[r["i"]], r["v"]]))
    many = [i for i, v in enumerate(edges) if len(v) > BINS]
    if many:
        at = [k / BINS for k in range(1, BINS)]
        q = wide.agg(*[F.percentile_approx(columns[i], at, 10_000).alias(columns[i]) for i in many], *[F.max(columns[i]).alias(f"m{i}") for i in many]).first()
        for i in many:
            edges[i] = np.append(np.unique([v for v in q[columns[i]] if v < q[f"m{i}"]]), np.inf)
    return [v[:-1] for v in edges]


def _blocks(wide: DataFrame, columns: list[str], seed: int, size: int) -> DataFrame:
    """(block, y, x): bins of size rows, a byte for each row and column, columns one after the other. The rows lie in an order that has nothing to do with their values."""
    edges = _bin_edges(wide, columns)
    mixed = wide.withColumn("__h", F.xxhash64("label", *columns, F.lit(seed)))
    rows = row_numbers(mixed, [], ["__h", "label", *columns]).withColumn("block", F.floor(F.col("rn") / size))

    def pack(g: pa.Table) -> pa.Table:
        g = g.sort_by("rn")
        x = np.stack([np.searchsorted(e, g[c].to_numpy(), "left").astype(np.uint8) for c, e in zip(columns, edges, strict=True)])
        return pa.Table.from_arrays([g["block"][:1], pa.array([g["label"].to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "y", "x"])

    return keep(rows.select("block", "rn", "label", *columns).groupBy("block").applyInArrow(pack, "block long, y binary, x binary"))


_OVER = [min(round(math.fsum(math.exp(-1) / math.factorial(i) for i in range(k)) * (1 << 16)), (1 << 16) - 1) for k in range(1, WEIGHTS + 1)]


def _weights(name: list[int], size: int) -> np.ndarray:
    """How often each of size rows is drawn: Poisson of mean 1."""
    r = np.random.SFC64(name).random_raw(-(-size // 4)).view(np.uint16)[:size]
    w = (r >= np.uint16(_OVER[0])).astype(np.int8)
    for least in _OVER[1:]:
        w += r >= np.uint16(least)
    return w


def _subsets(name: list[int], trees: int, nodes: int, columns: int) -> np.ndarray:
    """(trees, nodes, m): the columns that a node may be split by."""
    return np.argsort(np.random.default_rng(name).random((trees, nodes, columns)), 2)[:, :, : math.ceil(columns**0.5)]


def _counts(rows: np.ndarray, at: list[np.ndarray], y: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """For each of the columns (BINS, k) drawn rows of each class, or (BINS, 3) their number, sum and sum of squares if k is 0. For up to 16 classes y holds
    weight and class in one and the result is (BINS, WEIGHTS * k)."""
    y = y.take(rows)
    if 0 < k <= 16:
        step = WEIGHTS * k
        return np.stack([np.bincount(x.take(rows) * np.int16(step) + y, minlength=BINS * step) for x in at])
    w = w.take(rows).astype(float)
    if k:
        return np.stack([np.bincount(x.take(rows) * np.int64(k) + y, w, BINS * k) for x in at])
    return np.stack([np.stack([np.bincount(x.take(rows), v, BINS) for v in (w, w * y, w * y * y)], 1) for x in at])


def _grow(chunks, columns, copied, grown, level, k, mean, seed, parts):
    """Task: the counts at the open nodes of a level, summed over its blocks. chunks: (round, first tree, trees); grown: chunk -> (column or -1, cut) of each node."""
    first = (1 << level) - 1
    width = len(columns) + len(copied)
    m = math.ceil(width**0.5)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, part, yb, xb in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "part", "y", "x")], strict=True):
                label = np.frombuffer(yb)
                x = np.frombuffer(xb, np.uint8).reshape(-1, len(label)).astype(np.int16)
                size, made = len(label), None
                y = label - mean if not k else label.astype(np.int16)
                for c in range(part, len(chunks), parts):
                    r, start, trees = chunks[c]
                    if made != r:
                        rng = np.random.default_rng([seed, r, 0, block])
                        at, made = [x[i] for i in columns] + [x[i][rng.permutation(size)] for i in copied], r
                    if c not in sums:
                        sums[c] = np.zeros((trees, 1 << level, m, BINS, k or 3))
                    by, cut = grown[c]
                    subset = _subsets([seed, r, 1, start, level], trees, 1 << level, width)
                    for t in range(trees):
                        w = _weights([seed, r, 2, start + t, block], size)
                        coded = (w.astype(np.int16) - 1) * np.int16(k) + y if 0 < k <= 16 else y
                        nodes = {0: np.flatnonzero(w > 0)}
                        for _ in range(level):
                            below = {}
                            for node, rows in nodes.items():
                                if by[t, node] >= 0:
                                    left = at[by[t, node]].take(rows) <= cut[t, node]
                                    for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
                                        if by[t, child] >= -1:
                                            below[child] = rows.take(np.flatnonzero(side))
                            nodes = below
                        found = [node for node, rows in nodes.items() if len(rows)]
                        if found:
                            n = np.stack([_counts(nodes[node], [at[f] for f in subset[t, node - first]], coded, w, k) for node in found])
                            if 0 < k <= 16:
                                n = n.reshape(len(found), m, BINS, WEIGHTS, k)
                                n = sum(n[:, :, :, v] * (v + 1) for v in range(WEIGHTS))
                            sums[c][t, np.array(found) - first] += n.reshape(len(found), m, BINS, k or 3)
        kept = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([sums[c].astype(np.float64 if not k else np.int64).tobytes() for c in kept], pa.binary())], ["chunk", "n"])

    return run


def _impurity(n: np.ndarray, k: int) -> np.ndarray:
    """Gini impurity, or the variance, times the number of rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = n.sum(-1) - (n * n).sum(-1) / n.sum(-1) if k else n[..., 2] - n[..., 1] ** 2 / n[..., 0]
    return np.where(np.isfinite(v), np.maximum(v, 0), 0)


def _best(n: np.ndarray, k: int):
    """Of counts (trees, nodes, m, BINS, k or 3): which of the m columns, the last bin on the left, the gain (0: no split) and whether the parts are pure, each (trees, nodes)."""
    left = np.cumsum(n, 3)
    whole, left = left[..., -1:, :], left[..., :-1, :]
    right = whole - left
    a, b, top = _impurity(left, k), _impurity(right, k), _impurity(whole, k)
    size = (lambda v: v.sum(-1)) if k else (lambda v: v[..., 0])
    gain = np.where((size(left) > 0) & (size(right) > 0), top - a - b, 0)
    flat = lambda v: v.reshape(*v.shape[:2], -1)
    at = flat(gain).argmax(2)[..., None]
    take = lambda v: np.take_along_axis(flat(v), at, 2)[..., 0]
    least = 1e-12 * np.maximum(flat(top)[..., 0], 1e-300)
    best = take(gain)
    return at[..., 0] // (BINS - 1), at[..., 0] % (BINS - 1), np.where(best > least, best, 0), take(a) <= least, take(b) <= least


def _choose(chunks, width: int, level: int, k: int, seed: int):
    """Group: the splits of a chunk's nodes from the tasks' counts, each (trees * nodes)."""

    def choose(g: pa.Table) -> pa.Table:
        r, start, n = chunks[g["chunk"][0].as_py()]
        here, m = 1 << level, math.ceil(width**0.5)
        added = sum(np.frombuffer(v, np.int64 if k else float) for v in g["n"].to_pylist()).astype(float).reshape(n, here, m, BINS, k or 3)
        j, cut, gain, *pure = _best(added, k)
        by = np.take_along_axis(_subsets([seed, r, 1, start, level], n, here, width), j[..., None], 2)[..., 0]
        found = [v.ravel().astype(float).tolist() for v in (by, cut, gain, *pure)]
        return pa.Table.from_arrays([g["chunk"][:1], *[pa.array([v], pa.list_(pa.float64())) for v in found]], ["chunk", "by", "cut", "gain", "a", "b"])

    return choose


def _importances(blocks: DataFrame, count: int, columns: list[int], copies: list[int], rounds: list[int], trees: int, depth: int, k: int, mean: float, seed: int) -> dict[int, np.ndarray]:
    """round -> importances of columns and copies in its forest. All trees of all rounds grow by a level at a time."""
    width = len(columns) + len(copies)
    m = math.ceil(width**0.5)
    tree = (1 << depth - 1) * m * BINS * (k or 3) * 8 / (1 << 20)
    step = max(1, int(CHUNK_MB / tree))
    chunks = [(r, t, min(step, trees - t)) for r in rounds for t in range(0, trees, step)]
    per = max(1, int(PASS_MB / (tree * step)))
    spark = blocks.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    out = {r: np.zeros(width) for r in rounds}
    for first in range(0, len(chunks), per):
        some = chunks[first : first + per]
        parts = min(len(some), max(1, -(-2 * tasks // count)))
        unit = (F.col("block") * parts + F.col("part")) % tasks
        units = blocks.withColumn("part", F.explode(F.array([F.lit(p) for p in range(parts)]))).repartitionById(tasks, unit.cast("int"))
        nodes = (1 << depth + 1) - 1
        # of a node: its column, -1: ends here, though it was counted, -2: is pure or isn't there
        grown = {c: (np.full((n, nodes), -1, np.int16), np.zeros((n, nodes), np.int16)) for c, (_, _, n) in enumerate(some)}
        gained = {c: np.zeros((n, width)) for c, (_, _, n) in enumerate(some)}
        for level in range(depth):
            lo, here = (1 << level) - 1, 1 << level
            sums = units.mapInArrow(_grow(some, columns, copies, grown, level, k, mean, seed, parts), "chunk int, n binary")
            for row in sums.groupBy("chunk").applyInArrow(_choose(some, width, level, k, seed), "chunk int, by array<double>, cut array<double>, gain array<double>, a array<double>, b array<double>").collect():
                c = row["chunk"]
                by, cut = grown[c]
                to = [np.array(row[v]).reshape(-1, here) for v in ("by", "cut", "gain", "a", "b")]
                split = to[2] > 0
                by[:, lo : lo + here] = np.where(split, to[0], by[:, lo : lo + here])
                cut[:, lo : lo + here] = to[1]
                np.add.at(gained[c], (np.nonzero(split)[0], to[0][split].astype(int)), to[2][split])
                for side in (0, 1):
                    by[:, 2 * lo + 1 + side : 2 * (lo + here) + side : 2] = np.where(split & (to[3 + side] == 0), -1, -2)
        for c, (r, _, _) in enumerate(some):
            total = gained[c].sum(1, keepdims=True)
            out[r] += (gained[c] / np.where(total > 0, total, 1)).sum(0)
    return out


def _binomial_tail(hits: int, n: int) -> float:
    return sum(math.comb(n, k) for k in range(hits, n + 1)) / 2**n


def _verdict(hits: int, n: int, columns: int, alpha: float) -> str | None:
    if _binomial_tail(hits, n) * columns < alpha:
        return "confirmed"
    return "rejected" if _binomial_tail(n - hits, n) * columns < alpha else None


def crosscheck(df: DataFrame, features, target, target_type, seed: int = 42, rounds: int = 40, trees: int = 200, depth: int = 5, alpha: float = 0.05) -> dict[str, str]:
    """feature -> confirmed, tentative or rejected. In each round the columns still open compete with shuffled copies in a random forest: a hit
    is an importance over the best copy's. Hits are held against a fair coin, two-sided, corrected for the number of columns.

    Values are binned and rows laid out once, in blocks in an order by a hash of their values; a round's copies are shuffled inside blocks. A tree draws each row with a Poisson weight from a generator
    named by round, tree and block, so nothing is kept for a row and tree. The rounds before any column can get its verdict don't depend on each other and grow together."""
    if not features:
        return {}
    wide = _encoded(df, target, target_type, features)
    xs = [f"x{i}" for i in range(len(features))]
    about = wide.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top"), F.avg("label").alias("mean")).first()
    if not about["n"]:
        return dict.fromkeys(features, "tentative")
    k = 0 if target_type == "regression" else int(about["top"]) + 1
    size = min(max(-(-about["n"] // 64), LEAST), MOST)
    blocks = _blocks(wide, xs, seed, size)
    hits, played, status = dict.fromkeys(features, 0), 0, {}
    while played < rounds and not all(f in status for f in features):
        open_ = [f for f in features if status.get(f) != "rejected"]
        wait = next((n for n in range(1, rounds - played) if any(_verdict(h, played + n, len(features), alpha) for f in open_ if f not in status for h in (hits[f], hits[f] + n))), rounds - played)
        at = [features.index(f) for f in open_]
        copied = at * -(-COPIES // len(at)) if len(at) < COPIES else at
        found = _importances(blocks, -(-about["n"] // size), at, copied, list(range(played, played + wait)), trees, depth, k, about["mean"], seed)
        played += wait
        for importance in found.values():
            for f, v in zip(open_, importance, strict=False):
                hits[f] += bool(v > importance[len(open_) :].max())
        for f in open_:
            if f not in status and (v := _verdict(hits[f], played, len(features), alpha)):
                status[f] = v
    return {f: status.get(f, "tentative") for f in features}

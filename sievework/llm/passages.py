"""Fuzzy passages shared by documents: seeds, collinear chains, alignment.

1. Seeds are the minimisers of word 5-grams over windows of 8 (any run of 12 words equal in two documents has one), but for 5-grams of one repeated word.
   The i-th occurrence of a seed in a document is keyed by (seed, i), so repetitive texts pair in order, and by (seed, 0), so
   all copies in a document pair with the source's first.
2. Every occurrence joins the key's first occurrence (least doc_id) and the one before it, never all others: the
   work is linear in the occurrences, and a passage in a thousand documents gives 999 partners and 998 more.
   So that shorter passages in earlier documents don't take a longer one's seeds apart, an occurrence joins also the first
   that has the same seeds around it: the NEAR before or after it, and the run of seeds that reaches MIN_WORDS words before or after it. A match by such a run
   brings the run's middle and far seed along, so it's a chain by itself: a run of MIN_WORDS + K + WINDOW equal words is always found with some source.
3. The matches of a pair of documents, ordered in one, are chained in the other by prefix maxima
   in a Fenwick tree, with a gap cost for each word that is stepped over.
4. The words of a chain and of MARGIN words around it are aligned: equal runs pass at once, other stretches by
   edit distance, and both ends are extended while they match.

Seeds that a large share of the documents have (licences, notices) don't meet in one task: keys of more than about HOT occurrences, found in a sample, take their
first occurrences from sums that are combined before the shuffle. What is asked of one document is split into rows of at most about ASKED ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, _pow, buffer_of, col, each_of, free_name, grams, ints, mix, read, slices, small_side, span_hash, words_of

K, WINDOW = 5, 8
GAP_COST, MAX_GAP = 0.1, 40
MIN_WORDS, MIN_IDENTITY, MIN_SEEDS = 45, 0.7, 3
MARGIN = K + WINDOW + 4
NEAR = 3  # seeds
AROUND = ("near_after", "near_before", "wide_after", "wide_before")
HOT = 1 << 20  # occurrences of a key that one task may see
SAMPLED = 1 << 14  # of them in the sample that finds such keys
ASKED = 2_000


LAST = U64((1 << 64) - 1)


def repeated(w: Words, k: int) -> np.ndarray:
    """Of the runs that grams() gives, those of one word k times."""
    n = len(w.hash) - k + 1
    same = np.ones(n, bool)
    for j in range(1, k):
        same &= w.hash[:n] == w.hash[j : j + n]
    inside = np.ones(n, bool)
    for j in range(1, k):
        cross = w.lo[1:] - j
        inside[cross[(cross >= 0) & (cross < n)]] = False
    return same[inside]


def minimisers(w: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, position, hash): the least hash of each window, the first of equal ones."""
    g, lo = grams(w, k)
    count = np.diff(lo)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    g[repeated(w, k)] = LAST
    doc = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(g)) - lo[:-1][doc]
    n = max(len(g) - window + 1, 1)
    best = np.arange(n)
    for j in range(1, min(window, len(g))):
        at = np.minimum(np.arange(n) + j, len(g) - 1)
        best = np.where(g[at] < g[best], at, best)
    whole = (count[doc[:n]] - pos[:n]) >= window
    taken = np.zeros(len(g), bool)
    taken[best[whole]] = True
    for d in np.flatnonzero((count > 0) & (count < window)):
        taken[lo[d] + g[lo[d] : lo[d + 1]].argmin()] = True
    at = np.flatnonzero(taken & (g < LAST))
    return doc[at], pos[at], g[at]


def around(doc: np.ndarray, pos: np.ndarray, h: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """(32-bit hash, whether the document has it) of the seeds after and before each, in the order of AROUND; and for the last two the
    distance to the run's far seed times 256 plus that to its middle one."""
    n, i = len(h), np.arange(len(h))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _pow(n)[0], out=sums[1:])
    at = doc * (int(pos.max(initial=0)) + 4 * MIN_WORDS) + pos
    reach = MIN_WORDS - K
    out, far = [], []
    for wide, j in enumerate((i + NEAR, i - NEAR, np.searchsorted(at, at + reach), np.searchsorted(at, at - reach, "right") - 1)):
        has = (j >= 0) & (j < n)
        has[has] = doc[j[has]] == doc[has]
        j = np.where(has, j, i)
        v = span_hash(sums, np.minimum(i, j), np.maximum(i, j) + 1)
        if wide > 1:
            gap, mid = np.abs(pos[j] - pos), np.abs(pos[(i + j) // 2] - pos)
            has &= gap < 2 * MIN_WORDS
            far.append(np.where(has, gap * 256 + mid, 0))
            v = mix(v + far[-1].astype(np.uint64))
        out.append(((v >> U64(32)).astype(np.uint32).view(np.int32), has))
    return out, far


def _seeds(batches):
    for b in slices(batches, "text"):
        doc, pos, h = minimisers(words_of(buffer_of(col(b, "text"))))
        near, far = around(doc, pos, h)
        order = np.lexsort((pos, h, doc))
        doc, pos, h = doc[order], pos[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        turn = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        again = np.flatnonzero(turn)  # also under turn 0, which alone has the seeds around
        h = np.concatenate([mix(h + turn.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), mix(h[again])])
        none = np.concatenate([turn > 0, np.zeros(len(again), bool)])
        every = np.concatenate([order, order[again]])
        near = [np.where(has[every] & ~none, np.maximum(v[every].view(np.uint32), 1), 0).astype(np.uint64) for v, has in near]
        place = pos.astype(np.int64)
        place, doc = np.concatenate([place, place[again]]) << 32 | far[0][every] << 16 | far[1][every], np.concatenate([doc, doc[again]])
        pair = lambda x, y: pa.array((x << U64(32) | y).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ints(b, "_id")[doc]), pa.array(place), pair(*near[:2]), pair(*near[2:])], ["key", "_id", "place", "near", "wide"])


SEED = "key long, _id long, place long, near long, wide long"  # small rows: most of what is shuffled


def _unpacked(seeds: DataFrame) -> DataFrame:
    bits = lambda c, by, mask: F.shiftright(c, by).bitwiseAND(F.lit(mask))
    half = {"near_after": ("near", 32), "near_before": ("near", 0), "wide_after": ("wide", 32), "wide_before": ("wide", 0)}
    around = [F.nullif(bits(c, by, 0xFFFFFFFF), F.lit(0)).alias(name) for name, (c, by) in half.items()]
    return seeds.select("key", "_id", F.shiftright("place", 32).cast("int").alias("pos"), *around, bits("place", 16, 0xFFFF).cast("int").alias("far_after"), bits("place", 0, 0xFFFF).cast("int").alias("far_before"))


def _hot(sc: Scratch, src: DataFrame, hot: int) -> DataFrame | None:
    """The keys of more than about hot occurrences, by a sample of documents; None if there are none. Which are found changes the plan, not the result."""
    share = min(1.0, SAMPLED / hot)
    some = src.sample(share, 6) if share < 1 else src
    keys = sc.table(some.mapInArrow(_seeds, SEED).groupBy("key").count().where(F.col("count") > hot * share / 2).select("key"))
    return keys if keys.limit(1).count() else None


def before(sc: Scratch, rows: DataFrame) -> DataFrame:
    """rows with f_last, the occurrence of the same key before each in the order of (_id, pos), without a task for a key: rows are range-partitioned, and the first
    rows of a partition take theirs from the last rows of the partitions before."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sc.table(rows.repartitionByRange(tasks, "key", "_id", "pos").withColumn("_p", F.spark_partition_id()))
    head, order = F.struct("_id", "pos"), ["_id", "pos"]
    ends = ranged.groupBy("key", "_p").agg(F.max(head).alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(Window.partitionBy("key").orderBy("_p")))
    inside = F.lag(head).over(Window.partitionBy("key", "_p").orderBy(*order))
    return ranged.withColumn("inside", inside).join(small_side(sc.table(ends)), ["key", "_p"]).withColumn("f_last", F.coalesce("inside", "end")).drop("inside", "end", "_p")


def first_matches(sc: Scratch, src: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b, x, y): seeds of document b at y and of an earlier document a at x that match."""
    seeds = src.mapInArrow(_seeds, SEED)
    head = F.struct("_id", "pos")

    def windowed(rows: DataFrame) -> DataFrame:
        by = lambda *c: Window.partitionBy("key", *c).orderBy("_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        hit = _unpacked(rows.repartition("key")).select("*", F.first(head).over(by()).alias("f"), F.last("_id").over(whole).alias("z")).where("f._id <> z").drop("z")
        for c in AROUND:  # all in the partitions of the key
            hit = hit.withColumn(f"f_{c}", F.when(F.col(c).isNotNull(), F.first(head).over(by(c))))
        return hit.withColumn("f_last", F.lag(head).over(Window.partitionBy("key").orderBy("_id", "pos")))

    def joined(rows: DataFrame) -> DataFrame:
        for name, on in (("f", []), *[(f"f_{c}", [c]) for c in AROUND]):
            some = rows.where(F.col(on[0]).isNotNull()) if on else rows
            least = sc.table(some.groupBy("key", *on).agg(F.min(head).alias(name)))
            rows = rows.join(small_side(least), ["key", *on], "left")
        return before(sc, rows)

    keys = _hot(sc, src, hot)
    if keys is None:
        hit = windowed(seeds)
    else:
        keys = small_side(keys)
        hit = windowed(seeds.join(keys, "key", "left_anti")).unionByName(joined(sc.table(_unpacked(seeds.join(keys, "key", "left_semi")))))
    point = lambda f, d: F.struct(F.col(f"{f}._id").alias("a"), (F.col(f"{f}.pos") + d).alias("x"), (F.col("pos") + d).alias("y"))
    far = lambda c, sign: [point(f"f_wide_{c}", sign * F.shiftright(f"far_{c}", 8)), point(f"f_wide_{c}", sign * F.col(f"far_{c}").bitwiseAND(F.lit(255)))]
    points = F.array(*[point(f, F.lit(0)) for f in ("f", "f_last", *[f"f_{c}" for c in AROUND])], *far("after", 1), *far("before", -1))
    return hit.select(F.col("_id").alias("b"), F.explode(F.array_distinct(points)).alias("m")).where("m.a <> b").select("m.a", "b", "m.x", "m.y")


def chains(x: np.ndarray, y: np.ndarray, gap_cost: float = GAP_COST, weight: int = K) -> list[np.ndarray]:
    """Chains of matches (x[i], y[i]), each strictly increasing in both, as index arrays. A match
    adds weight, and stepping from one to the next costs gap_cost for each word in x and in y; prefix
    maxima over y in a Fenwick tree find the best predecessor of each in O(log n). A match is in
    one chain; a chain is cut where a step exceeds MAX_GAP words."""
    order = np.lexsort((-y, x))
    levels, rank = np.unique(y, return_inverse=True)
    size = len(levels)
    tree, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    xs, ys, rs = x.tolist(), y.tolist(), rank.tolist()
    for i in order.tolist():
        best, prev, r = -1e18, -1, rs[i]
        while r > 0:
            if tree[r] > best:
                best, prev = tree[r], who[r]
            r &= r - 1
        reach = gap_cost * (xs[i] + ys[i])
        gain = best - reach
        score[i] = weight + gain if gain > 0 else float(weight)
        back[i] = prev if gain > 0 else -1
        mine, r = score[i] + reach, rs[i] + 1
        while r <= size:
            if mine > tree[r]:
                tree[r], who[r] = mine, i
            r += r & -r
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], xs[i], ys[i])):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        path.reverse()
        begin = 0
        for j in range(1, len(path) + 1):
            if j == len(path) or xs[path[j]] - xs[path[j - 1]] > MAX_GAP or ys[path[j]] - ys[path[j - 1]] > MAX_GAP:
                if j > begin:
                    out.append(np.array(path[begin:j]))
                begin = j
    return out


def _chain(batches):
    for b in each_of(batches):
        rows = {k: [] for k in ("a", "b", "n", "xa", "xb")}
        for a, d, m in zip(ints(b, "a"), ints(b, "b"), col(b, "m"), strict=True):
            x, y = (m.values.field(f).to_numpy().astype(np.int64) for f in (0, 1))
            for n, c in enumerate(c for c in chains(x, y) if len(c) >= MIN_SEEDS and x[c[-1]] - x[c[0]] + K + 2 * MARGIN >= MIN_WORDS):
                for k, v in zip(rows, (a, d, n, x[c].astype(np.int32), y[c].astype(np.int32)), strict=True):
                    rows[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], list(rows))


def _pieces(batches):
    """Cut the asked word ranges out of each document, as 32-bit word hashes."""
    for b in slices(batches, "text"):
        w = words_of(buffer_of(col(b, "text")))
        h = (w.hash >> U64(32)).astype(np.uint32)
        rows = [[], [], [], [], [], []]
        for d, asked in enumerate(col(b, "asked").to_pylist()):
            for q in asked:
                lo = max(q["lo"], 0)
                at = w.lo[d] + lo
                for r, v in zip(rows, (q["a"], q["b"], q["n"], q["side"], lo, h[at : min(w.lo[d] + q["hi"], w.lo[d + 1])].tobytes()), strict=True):
                    r.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["a", "b", "n", "side", "lo", "h"])


def _edits(p: np.ndarray, q: np.ndarray) -> int:
    """Word edit distance of two short stretches, by rows."""
    if not len(p) or not len(q):
        return max(len(p), len(q))
    ramp = np.arange(len(q) + 1)
    row = ramp.copy()
    for i, v in enumerate(p):
        step = np.minimum(row[1:] + 1, row[:-1] + (q != v))
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - ramp) + ramp
    return int(row[-1])


def _grow(p: np.ndarray, q: np.ndarray, slip: int = 3) -> tuple[int, int, int]:
    """(words of p, words of q, edits) by which a match can be carried on over both: equal words, and
    stretches of up to slip words on either side if three equal words follow."""
    i = j = edits = 0
    while True:
        n = min(len(p) - i, len(q) - j)
        run = np.flatnonzero(p[i : i + n] != q[j : j + n])
        same = int(run[0]) if len(run) else n
        i, j = i + same, j + same
        if same == n:
            return i, j, edits
        for cost, u, v in sorted((max(u, v), u, v) for u in range(slip + 1) for v in range(slip + 1) if u + v):
            if len(p) >= i + u + 3 and len(q) >= j + v + 3 and (p[i + u : i + u + 3] == q[j + v : j + v + 3]).all():
                i, j, edits = i + u, j + v, edits + cost
                break
        else:
            return i, j, edits


def align(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int, float]:
    """(start and end in p, start and end in q, identity) of the alignment through the seeds x, y."""
    up, uq, e0 = _grow(p[: x[0]][::-1], q[: y[0]][::-1])
    vp, vq, e1 = _grow(p[x[-1] :], q[y[-1] :])
    edits = e0 + e1
    for i in range(len(x) - 1):
        s, t = p[x[i] : x[i + 1]], q[y[i] : y[i + 1]]
        if len(s) != len(t) or (s != t).any():
            edits += _edits(s, t)
    a0, a1, b0, b1 = x[0] - up, x[-1] + vp, y[0] - uq, y[-1] + vq
    return int(a0), int(a1), int(b0), int(b1), 1 - edits / max(a1 - a0, b1 - b0, 1)


def _align(batches):
    names = ["doc_id", "first_word", "end_word", "source_doc_id", "source_first_word", "source_end_word", "identity"]
    for b in each_of(batches):
        rows = [[] for _ in names]
        for r in b.to_pylist():
            p, q = (np.frombuffer(r[k], np.uint32) for k in ("ha", "hb"))
            x, y = np.array(r["xa"]) - r["la"], np.array(r["xb"]) - r["lb"]
            a0, a1, b0, b1, identity = align(p, q, x, y)
            if min(a1 - a0, b1 - b0) >= MIN_WORDS and identity >= MIN_IDENTITY:
                for o, v in zip(rows, (r["b"], b0 + r["lb"], b1 + r["lb"], r["a"], a0 + r["la"], a1 + r["la"], round(identity, 6)), strict=True):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names)


FOUND = "doc_id long, first_word int, end_word int, source_doc_id long, source_first_word int, source_end_word int, identity double"


def shared_passages(spark: SparkSession, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row for each passage of doc_id that an earlier document (source_doc_id < doc_id) has too, in word positions.

    A passage has at least MIN_WORDS words in both and a word identity of at least MIN_IDENTITY. One that lies in another
    that doc_id shares with the same source isn't reported again.
    Case, punctuation and spaces don't count. Repeats inside one document aren't reported, and a run of one word over and over is no passage. Rows that repeat a doc_id are
    taken as one document. Very long texts are searched to their end. Null or empty texts and null doc_ids have no passages; an empty table gives an empty result. Only doc_id
    and text are read.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("text")).where("_id is not null and text is not null")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not to be coalesced
    with Scratch(spark) as sc:
        pairs = first_matches(sc, src, hot).groupBy("a", "b").agg(F.collect_set(F.struct("x", "y")).alias("m"))
        chained = sc.table(pairs.where(f"size(m) >= {MIN_SEEDS}").repartition(tasks, "a", "b").mapInArrow(_chain, "a long, b long, n int, xa array<int>, xb array<int>"))
        ask = lambda side, doc, xs: F.struct("a", "b", "n", F.lit(side).alias("side"), doc.alias("_id"), (xs[0] - MARGIN).alias("lo"), (F.element_at(xs, -1) + K + MARGIN).alias("hi"))
        asked = chained.select(F.explode(F.array(ask(0, F.col("a"), F.col("xa")), ask(1, F.col("b"), F.col("xb")))).alias("q")).select("q.*")
        asked = sc.table(asked)
        times = sc.table(asked.groupBy("_id").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("parts")))
        salted = asked.join(small_side(times), "_id").withColumn("part", F.pmod(F.xxhash64("a", "b", "n"), F.col("parts")))
        asked = sc.table(salted.groupBy("_id", "part").agg(F.collect_list(F.struct("a", "b", "n", "side", "lo", "hi")).alias("asked")).drop("part"))
        rows = asked.agg(F.sum(F.size("asked"))).first()[0] or 0
        cut = src.join(small_side(asked, rows), "_id").select("text", "asked").mapInArrow(_pieces, "a long, b long, n int, side int, lo int, h binary")
        side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
        both = cut.groupBy("a", "b", "n").agg(side(0, "lo").alias("la"), side(0, "h").alias("ha"), side(1, "lo").alias("lb"), side(1, "h").alias("hb"))
        found = both.join(chained, ["a", "b", "n"]).repartition(tasks, "a", "b", "n").mapInArrow(_align, FOUND)
        before = Window.partitionBy("doc_id", "source_doc_id").orderBy("first_word", F.col("end_word").desc(), "source_first_word", "source_end_word").rowsBetween(Window.unboundedPreceding, -1)
        return sc.result(found.withColumn("reach", F.coalesce(F.max("end_word").over(before), F.lit(0))).where("end_word > reach").drop("reach"))


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """text without the word ranges; of no words left, null."""
    out = []
    for b in slices([pa.record_batch([text, spans], ["text", "spans"])], "text"):
        buf = buffer_of(b.column(0), lower=False)
        w = words_of(buf, hashes=False)
        for d, cuts in enumerate(b.column(1).to_pylist()):
            lo, hi = w.lo[d], w.lo[d + 1]
            at, kept, words = buf.at[d], [], 0
            done = 0
            for c in sorted((c["first_word"], min(c["end_word"], hi - lo)) for c in cuts):
                if c[0] > done:
                    words += c[0] - done
                    kept.append(buf.data[at : w.start[lo + c[0]]].tobytes())
                if c[1] > done:
                    done = c[1]
                    at = w.start[lo + done] if lo + done < hi else buf.at[d + 1]
            words += hi - lo - done
            kept.append(buf.data[at : buf.at[d + 1]].tobytes())
            out.append(b"".join(kept).decode("utf-8") if words > 0 else None)
    return pa.array(out, pa.string())


def cut_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every shared passage cut from all documents but its source, n_chars (if there) set anew.

    Documents of which no word is left go; all others stay, untouched ones as they are. Every row of a repeated doc_id is cut at the same words. Rows with a null
    doc_id and null, empty or short texts stay as they are, very long ones are cut up to their end. An empty table gives an empty result."""
    key, cuts, new = (free_name(docs, c) for c in ("_cut_id", "_spans", "_new"))
    found = shared_passages(spark, docs)
    spans = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("first_word", "end_word")).alias(cuts))
    with Scratch(spark) as sc:
        spans = sc.result(spans)
    spans = small_side(spans)
    rest = docs.join(spans.select(key), docs["doc_id"] == F.col(key), "left_anti")
    once = F.arrow_udf(_cut, "string").asNondeterministic()  # else it runs for the filter and again for the columns
    changed = docs.join(spans, docs["doc_id"] == F.col(key)).withColumn(new, once(docs["text"], F.col(cuts))).where(F.col(new).isNotNull())
    names = {c.lower() for c in ("text", "n_chars")}
    value = {"text": F.col(new), "n_chars": F.length(new)}
    cast = dict(docs.dtypes)
    shown = [value[c.lower()].cast(cast[c]).alias(c) if c.lower() in names else F.col(f"`{c}`") for c in docs.columns]
    return rest.unionByName(changed.select(*shown))


def op6_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(spark, read(spark, sf_dir, "documents"))

"""Katz backoff language model of word trigrams, counted and scored without a row for each token.

    P3(w | u v) = d3(r) r / c(u v)      if u v w was seen r >= least times
                = alpha(u v) P2(w | v)  otherwise, and P2(w | v) if the context u v is new
    P2(w | v)   the same over pairs, backing off to P1
    P1(w)       = d1(r) r / N           if w was seen, else the mass that is left, which is that of one unknown word

d_n(r) is the Good-Turing discount of order n for r <= GT_MAX, from counts of counts over all documents. Any other r keeps all but 1/N of
its count, so every context leaves some mass. alpha gives the words not stored after a context exactly the mass that is left:
(1 - sum of the stored P) / (1 - sum of the next lower P of the same words). As the unknown word is after no context, no context has all
words, and the probabilities after each sum to 1. A document is BOS, BOS, its words, EOS. No word is left out of the model.

The rows of the model itself have all their n-grams in it, so none of their tokens backs off. The query therefore scores each document twice: under the model of all
documents, and under that of the half of them (dealt by doc_id) that it isn't in, where the recursion goes down to pairs, words and the unknown word.

Counting and scoring move packed blocks. A chunk of documents of one half (side) is written once, as its distinct words and the sequence of their numbers. It gives one row for
each bucket of n-grams of orders 1 to 3: their 64-bit keys, sorted and delta-coded in byte planes, with their numbers. A bucket sums them over the chunks of each side and
answers each chunk with counts in the same order; the chunk then evaluates the recursion for its tokens.
Keys of n-grams of frequent words are the numbers of the words side by side, which compresses well; all others are hashes. Which words are frequent doesn't change
the result. Only their table, of at most FREQUENT rows, is broadcast; everything that grows with the corpus is shuffled. For backoff weights, the first chunk of a side that has an
n-gram sends its count and that of its next lower order to the bucket of its context. That bucket sums them and answers the chunks in which some token backs off from the context.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, buffer_of, col, ints, mix, read, release, slices, words_of

FREQUENT = (1 << 20) - 3
BOS, EOS, FIRST = 1, 2, 3
ORDERS, GT_MAX = (1, 2, 3), 5
CHUNK, BUCKET = 8 << 20, 2_000_000  # bytes of text in a chunk; tokens to a bucket of n-grams of one order
RARE = U64(1 << 63)


def pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


@dataclass
class Frequent:
    """Words that have a number. ends[n] is the number of tokens of the words up to n."""

    hash: np.ndarray  # ascending
    ends: np.ndarray
    buckets: int

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return h | RARE
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at.astype(np.uint64) + U64(FIRST), h | RARE)

    def bucket(self, first: np.ndarray, key: np.ndarray) -> np.ndarray:
        """N-grams of a rare first word stay together, those of a frequent one are spread over buckets by their share of the tokens."""
        part = mix(key).astype(np.float64) / 2.0**64
        known = np.where(first < RARE, first, U64(0)).astype(np.int64)
        lo = self.ends[np.maximum(known - 1, 0)]
        place = np.where(first < RARE, (lo + part * (self.ends[known] - lo)) / max(self.ends[-1], 1), part)
        return np.minimum((place * self.buckets).astype(np.int64), self.buckets - 1)


def _word_counts(batches):
    """Partial sums of a partition; the words of documents in all, under hash null the number of documents."""
    docs, held, n, size = 0, [], [], 0

    def merged():
        k, back = np.unique(np.concatenate(held), return_inverse=True)
        return k, np.bincount(back, np.concatenate(n)).astype(np.int64)

    for b in slices(batches, "text"):
        w = words_of(buffer_of(col(b, "text")))
        docs += int((w.count > 0).sum())
        k, c = np.unique(w.hash, return_counts=True)
        held.append(k), n.append(c)
        size += len(k)
        if size > 4_000_000:
            k, c = merged()
            held, n, size = [k], [c], 0
    if held:
        k, c = merged()
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["h", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], ["h", "n"])


def frequent(sc: Scratch, src: DataFrame, limit: int = FREQUENT) -> Frequent:
    """The words of the highest counts, as many whole counts as limit has room for."""
    counts = sc.table(src.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    by_count = counts.where("h is not null").groupBy("n").count().orderBy(F.col("n").desc()).collect()
    total, room, least = sum(r["n"] * r["count"] for r in by_count), limit, 1 << 62
    for r in by_count:
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    docs = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= least).where("h is not null").toArrow()
    h, n = kept["h"].to_numpy().view(np.uint64), kept["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return Frequent(h[order], np.cumsum(np.concatenate([[0, 2 * docs, docs], n[order]])), max(1, -(-(total + docs) // BUCKET)))


CHUNKS = "chunk long, side int, ndocs long, docs binary, words binary, codes binary, seq binary"


def _chunks(shared, side: int | None):
    """Rows of CHUNKS: doc_ids, their numbers of words, the codes of the distinct words and the words as places in codes. A chunk is of one side; without side,
    documents are dealt to two by doc_id."""

    def flush(number, at, ids, counts, hashes):
        h, seq = np.unique(np.concatenate(hashes), return_inverse=True)
        codes = shared.value.codes(h)
        order = np.argsort(codes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        ids = np.concatenate(ids)
        row = (number, at, len(ids), pack(ids), pack(np.concatenate(counts).astype(np.uint32)), pack_sorted(codes[order]), pack(place[seq]))
        kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["chunk", "side", "ndocs", "docs", "words", "codes", "seq"])

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        held = {k: [first + k, [], [], [], 0] for k in ((0, 1) if side is None else (side,))}
        for b in slices(batches, "text"):
            buf = buffer_of(col(b, "text"))
            w = words_of(buf)
            ids = ints(b, "_id")
            of = side_of(ids) if side is None else np.full(len(ids), side)
            for k, h in held.items():
                has = (w.count > 0) & (of == k)
                if not has.any():
                    continue
                h[1].append(ids[has]), h[2].append(w.count[has]), h[3].append(w.hash[np.repeat(has, w.count)])
                h[4] += int(np.diff(buf.at)[has].sum()) + 16 * int(has.sum())
                if h[4] > CHUNK:
                    yield flush(h[0], k, *h[1:4])
                    held[k] = [h[0] + 2, [], [], [], 0]
        for k, h in held.items():
            if h[3]:
                yield flush(h[0], k, *h[1:4])

    return run


def side_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> U64(63)).astype(np.int64)


def _key(*codes: np.ndarray) -> np.ndarray:
    out, mixed, rare = codes[0], codes[0], codes[0] >= RARE
    for c in codes[1:]:
        out = (out << U64(21)) | c
        mixed = mix(mixed) + c
        rare = rare | (c >= RARE)
    return np.where(rare, mix(mixed) | RARE, out) if len(codes) > 1 else out


@dataclass
class Grams:
    """The distinct n-grams of one order in a chunk."""

    key: np.ndarray
    of: np.ndarray  # by token: place in key
    token: np.ndarray  # by n-gram: a token of it
    order: np.ndarray  # places in key by bucket and key
    cut: np.ndarray  # where buckets begin in order
    bucket: np.ndarray  # of each run of order


class Chunk:
    """A chunk's tokens (words and EOS) as places in codes, with the two before each, and its n-grams."""

    def __init__(self, voc: Frequent, row: dict):
        self.ids, self.n = unpack(row["docs"], np.int64), unpack(row["words"], np.uint32).astype(np.int64) + 1
        codes, seq = unpack_sorted(row["codes"]), unpack(row["seq"], np.uint32)
        codes = np.concatenate([np.array([BOS, EOS], np.uint64), codes])
        self.first = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        x, inner = np.ones(total, np.int64), np.ones(total, bool)
        inner[self.first + self.n - 1] = False
        x[inner] = seq.astype(np.int64) + 2
        del inner, seq
        v = np.concatenate([x[:1], x[:-1]])
        v[self.first] = 0
        self.start = np.zeros(total, bool)
        self.start[self.first] = True
        self.v = v.astype(np.uint32)
        self.codes = codes
        k = len(codes)
        one, at, of = np.unique(x, return_index=True, return_inverse=True)
        self.grams = {1: self._of(voc, codes[one], codes[one], of, at)}
        v *= k
        v += x
        pair, at, of = np.unique(v, return_index=True, return_inverse=True)
        del v
        before = np.concatenate([of[:1], of[:-1]])
        before[self.first] = len(pair)  # BOS, BOS
        self.before = before.astype(np.uint32)
        v2, x2 = codes[pair // k], codes[pair % k]
        key = _key(v2, x2)
        self.context = np.append(key, _key(np.array([BOS], np.uint64), np.array([BOS], np.uint64)))  # of orders 3
        self.grams[2] = self._of(voc, v2, key, of, at)
        del pair, at, of, key
        before *= k
        before += x
        del x
        triple, at, of = np.unique(before, return_index=True, return_inverse=True)
        del before
        of, at = of.astype(np.uint32), at.astype(np.uint32)
        ctx = triple // k
        u3, v3 = np.append(v2, U64(BOS))[ctx], np.append(x2, U64(BOS))[ctx]
        key = _key(u3, v3, codes[triple % k])
        del triple, ctx, v2, x2, v3
        self.grams[3] = self._of(voc, u3, key, of, at)

    @staticmethod
    def _of(voc: Frequent, first: np.ndarray, key: np.ndarray, of: np.ndarray, token: np.ndarray) -> Grams:
        b = voc.bucket(first, key)
        order = np.lexsort((key, b))
        run = b[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1]) if len(run) else np.zeros(0, np.int64)
        return Grams(key, of.astype(np.uint32), token.astype(np.uint32), order.astype(np.uint32), cut, run[cut])


def _asked(shared):
    """Rows (chunk, ngram, bucket, side, keys, sums): a chunk's n-grams of a bucket and how often it has each."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c, rows = Chunk(shared.value, r), []
                for n, g in c.grams.items():
                    sums = np.bincount(g.of, minlength=len(g.key)).astype(np.uint32)
                    for bucket, at in zip(g.bucket, np.split(g.order, g.cut[1:]), strict=True):
                        rows.append((r["chunk"], n, bucket, r["side"], pack_sorted(g.key[at]), pack(sums[at])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "ngram", "bucket", "side", "keys", "sums"])
                del c, rows
        release()

    return run


COUNTED = "chunk long, ngram int, bucket long, counts array<binary>, moments array<long>, part string"
WHOLE = 2  # the model of both sides; those of one side go by its number


def _each(fn):
    """fn of a group; memory is released when what fn held is gone."""

    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        release()
        return out

    return run


def _pair(fn):
    """The same of cogrouped tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        release()
        return out

    return run


def _sum_bucket(table: pa.Table) -> pa.Table:
    """Of a bucket: the counts of counts and the sum of each model (part 'model'); for each chunk and its n-grams, the counts of both sides and whether it is the
    first chunk of its side to have them (part 'answer')."""
    rows = table.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    size = [len(k) for k in keys]
    cut = np.cumsum(size)[:-1]
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums, side = np.concatenate([unpack(r["sums"], np.uint32) for r in rows]), np.repeat([r["side"] for r in rows], size)
    total, owned = [], np.zeros(len(back), bool)
    for k in (0, 1):
        total.append(np.bincount(back, sums * (side == k), len(every)).astype(np.int64))
        mine, first = np.flatnonzero(side == k)[::-1], np.full(len(every), -1)
        first[back[mine]] = mine
        owned[first[first >= 0]] = True
    n, bucket = rows[0]["ngram"], rows[0]["bucket"]
    parts = [np.split(x, cut) for x in (total[0][back], total[1][back], owned.view(np.uint8))]
    out = [(r["chunk"], n, bucket, [pack(x) for x in p], None, "answer") for r, *p in zip(rows, *parts, strict=True)]
    moments = []
    for t in (*total, total[0] + total[1]):
        moments += [0, *np.bincount(np.minimum(t, GT_MAX + 2), minlength=GT_MAX + 2)[1 : GT_MAX + 2].tolist(), int(t.sum())]
    out.append((0, n, bucket, None, moments, "model"))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.string())
    return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "ngram", "bucket", "counts", "moments", "part"])


def _joined(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk with its answers, for each order one block of each kind."""
    answers = sorted(right.to_pylist(), key=lambda r: (r["ngram"], r["bucket"]))
    blocks = []
    for n in ORDERS:
        mine = [r["counts"] for r in answers if r["ngram"] == n]
        blocks += [pack(np.concatenate([unpack(c[k], kind) for c in mine])) for k, kind in enumerate((np.int64, np.int64, np.uint8))]
    return left.append_column("counts", pa.array([blocks] * left.num_rows, pa.list_(pa.binary())))


def discounts(coc: np.ndarray, rest: float) -> np.ndarray:
    """d_0..d_GT_MAX of the counts of counts coc. rest for r = 0, which stands for all r above, and where they don't give a value in (0, 1)."""
    d = np.full(GT_MAX + 1, rest)
    top = (GT_MAX + 1) * coc[GT_MAX + 1] / coc[1] if coc[1] else 1.0
    for r in range(1, GT_MAX + 1):
        if coc[r] and top < 1:
            x = ((r + 1) * coc[r + 1] / (r * coc[r]) - top) / (1 - top)
            if 0 < x < 1:
                d[r] = x
    return d


@dataclass
class Model:
    """What all chunks need of it besides counts."""

    tokens: int
    docs: int
    d: dict[int, np.ndarray]
    unknown: float
    least: int


def model_of(moments: dict[int, np.ndarray], docs: int, least: int) -> Model:
    none = np.zeros(GT_MAX + 3)
    tokens = int(moments.get(1, none)[-1])
    rest = 1 - 1 / (tokens + 1)
    d = {n: discounts(moments.get(n, none), rest) for n in ORDERS}
    low = moments.get(1, none)[: GT_MAX + 1] * np.arange(GT_MAX + 1)
    left = ((1 - d[1]) * low).sum() + (1 - rest) * (tokens - low.sum())
    return Model(tokens, docs, d, left / tokens if tokens else 1.0, least)


class Scores:
    """The recursion over the tokens of a chunk, under one model."""

    def __init__(self, m: Model, c: Chunk, count: dict[int, np.ndarray]):
        self.chunk, self.model, self.count = c, m, count
        c1, c2 = count[1][c.grams[1].of], count[2][c.grams[2].of]
        self.total = {3: np.where(c.start, m.docs, np.append(count[2], m.docs)[c.before]), 2: np.where(c.start, m.docs, np.concatenate([c1[:1], c1[:-1]]))}
        self.r = {3: count[3][c.grams[3].of], 2: c2, 1: c1}
        self.seen = {n: self.r[n] >= m.least for n in (3, 2)}

    def share(self, n: int) -> np.ndarray:
        """The discounted share by order n of tokens that it has."""
        r, d = self.r[n], self.model.d[n]
        below = self.total[n] if n > 1 else np.full(len(r), self.model.tokens)
        return d[np.where(r <= GT_MAX, r, 0)] * r / np.maximum(below, 1)

    def unigram(self) -> np.ndarray:
        return np.where(self.r[1] > 0, self.share(1), self.model.unknown)

    def contexts(self, n: int) -> np.ndarray:
        return self.chunk.context[self.chunk.before] if n == 3 else self.chunk.codes[self.chunk.v]

    def open(self, n: int) -> np.ndarray:
        """Tokens for which alpha of order n counts."""
        return ~self.seen[3] & ((n == 3) | ~self.seen[2]) & (self.total[n] > 0)

    def wanted(self, n: int, buckets: int) -> tuple[np.ndarray, ...]:
        """The contexts whose alpha of order n counts, by bucket and context; where buckets begin; the buckets; of each open token, the place of its context."""
        key, of = np.unique(self.contexts(n)[self.open(n)], return_inverse=True)
        order, cut, bucket = by_bucket(key, buckets)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return key[order], cut, bucket, place[of]

    def log_p(self, alphas: list[dict], buckets: int) -> np.ndarray:
        p = np.log(np.where(self.seen[3], self.share(3), np.where(self.seen[2], self.share(2), self.unigram())))
        for n in (2, 3):
            key, _, bucket, place = self.wanted(n, buckets)
            if len(key):
                mine = {r["bucket"]: r["alpha"] for r in alphas if r["ngram"] == n}
                p[self.open(n)] += np.log(np.concatenate([unpack(mine[b], np.float64) for b in bucket.tolist()]))[place]
        return p


def by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Order of sorted contexts by bucket, where buckets begin in it, and which they are."""
    b = np.minimum((mix(key) / 2.0**64 * buckets).astype(np.int64), buckets - 1)
    order = np.argsort(b, kind="stable")
    run = b[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1]) if len(run) else np.zeros(0, np.int64)
    return order, cut, run[cut]


@dataclass
class Plan:
    """What each side is scored under, and which sides are models that others back off in."""

    under: dict[int, int]
    taught: tuple[int, ...]
    both: bool = False  # scored under the whole model, too


class Known:
    """A chunk with the counts of its n-grams."""

    def __init__(self, models: dict[int, Model], voc: Frequent, row: dict):
        self.models, self.chunk, self.side, self.number = models, Chunk(voc, row), row["side"], row["chunk"]
        self.counts, self.owned = {}, {}
        for i, (n, g) in enumerate(self.chunk.grams.items()):
            a, b, own = (self._placed(g, unpack(x, kind)) for x, kind in zip(row["counts"][3 * i : 3 * i + 3], (np.int64, np.int64, np.uint8), strict=True))
            self.counts[n], self.owned[n] = (a, b), own > 0

    @staticmethod
    def _placed(g: Grams, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g.key), x.dtype)
        out[g.order] = x
        return out

    def scores(self, k: int) -> Scores:
        return Scores(self.models[k], self.chunk, {n: c[0] + c[1] if k == WHOLE else c[k] for n, c in self.counts.items()})


WEIGHED = "chunk long, model int, ngram int, bucket long, contexts binary, sizes binary, r binary, low binary, below binary"


def _weighed(models, voc, plan: Plan):
    """Rows of WEIGHED: the contexts whose alpha a chunk asks for, by bucket; those of the n-grams that it is the first to have, with the number of these, the
    counts of these and of their next lower order, and what the next lower order divides by."""

    def asked(k: Known, buckets: int):
        model = plan.under[k.side]
        s = k.scores(model)
        for n in (2, 3):
            key, cut, bucket, _ = s.wanted(n, buckets)
            for at, x in zip(bucket.tolist(), np.split(key, cut[1:]), strict=len(key) > 0):
                yield k.number, model, n, at, pack_sorted(x), None, None, None, None

    def told(k: Known, buckets: int):
        s = k.scores(k.side)
        for n in (2, 3):
            token = k.chunk.grams[n].token[k.owned[n]]
            key, of, size = np.unique(s.contexts(n)[token], return_inverse=True, return_counts=True)
            order, cut, bucket = by_bucket(key, buckets)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            token = token[np.argsort(place[of], kind="stable")]
            key, size = key[order], size[order].astype(np.uint32)
            begin = np.cumsum(size, dtype=np.int64) - size
            r, low = s.r[n][token].astype(np.uint32), s.r[n - 1][token].astype(np.uint32)
            below = (s.total[2][token[begin]] if n == 3 else np.full(len(begin), s.model.tokens)).astype(np.int64)
            at = begin[cut[1:]]
            del of, order, place, token, begin
            cuts = (cut[1:], cut[1:], at, at, cut[1:])
            for b, x, *rest in zip(bucket.tolist(), *(np.split(v, c) for v, c in zip((key, size, r, low, below), cuts, strict=True)), strict=len(key) > 0):
                yield k.number, k.side, n, b, pack_sorted(x), *map(pack, rest)

    def each(row: dict) -> list[tuple]:
        k, buckets = Known(models.value, voc.value, row), voc.value.buckets
        return [*(asked(k, buckets) if k.side in plan.under else ()), *(told(k, buckets) if k.side in plan.taught else ())]

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
        for b in batches:
            for row in b.to_pylist():
                if out := each(row):
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "model", "ngram", "bucket", "contexts", "sizes", "r", "low", "below"])
                del row, out
                release()

    return run


ALPHAS = "chunk long, ngram int, bucket long, alpha binary"


def _weights(models):
    """Of a bucket of contexts: alpha of those that each chunk asks for, in its order."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        m, n = models.value[rows[0]["model"]], rows[0]["ngram"]
        asked, told = [r for r in rows if r["sizes"] is None], [r for r in rows if r["sizes"] is not None]
        empty = [np.zeros(0, np.int64)]
        key, back = np.unique(np.concatenate([unpack_sorted(r["contexts"]) for r in told] or [np.zeros(0, np.uint64)]), return_inverse=True)
        of = np.repeat(back, np.concatenate([unpack(r["sizes"], np.uint32) for r in told] or empty))
        r, low = (np.concatenate([unpack(x[c], np.uint32) for x in told] or empty).astype(np.int64) for c in ("r", "low"))
        below = np.ones(len(key))
        below[back] = np.concatenate([unpack(x["below"], np.int64) for x in told] or empty)
        kept = lambda n, x: m.d[n][np.where(x <= GT_MAX, x, 0)] * x * (r >= m.least)
        total, high, lower = (np.bincount(of, x, len(key)) for x in (r, kept(n, r), kept(n - 1, low)))
        alpha = np.append(np.maximum(1 - high / np.maximum(total, 1), 0) / (1 - lower / below), 1.0)
        out = []
        for x in asked:
            k = unpack_sorted(x["contexts"])
            at = np.searchsorted(key, k)
            if len(key):
                at = np.where(key[np.minimum(at, len(key) - 1)] == k, at, len(key))
            out.append((x["chunk"], n, x["bucket"], pack(alpha[at])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["chunk", "ngram", "bucket", "alpha"])

    return run


SCORED = "doc_id long, tokens long, log_prob double, perplexity double, backed_off long"
HELD = ", held_log_prob double, held_perplexity double, held_backed_off long"


def _scores(models, voc, plan: Plan):
    """A function of (joined chunk, its alphas) for cogrouped maps."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        alphas, tables = right.to_pylist(), []
        for row in left.to_pylist():
            k = Known(models.value, voc.value, row)
            c, cols = k.chunk, {"doc_id": pa.array(k.chunk.ids), "tokens": pa.array(k.chunk.n)}
            for prefix, model in [("", WHOLE)] * plan.both + [("held_" * plan.both, plan.under[k.side])]:
                s = k.scores(model)
                total = np.add.reduceat(s.log_p(alphas if model != WHOLE else [], voc.value.buckets), c.first)
                cols |= {f"{prefix}log_prob": pa.array(total), f"{prefix}perplexity": pa.array(np.exp(-total / c.n)), f"{prefix}backed_off": pa.array(np.add.reduceat((~s.seen[3]).astype(np.int64), c.first))}
                del s
            tables.append(pa.table(cols))
            del k, c
        return pa.concat_tables(tables)

    return run


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each shuffle's files go when the query that made them ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(spark: SparkSession, docs: DataFrame, train: DataFrame | None = None, least: int = 1, limit: int = FREQUENT, held: bool = False) -> DataFrame:
    """(doc_id, tokens, log_prob, perplexity, backed_off) of each row of docs that has a word and a doc_id.

    The model is counted over train, by default the same rows; pairs and triples that it has less than least times are left to backing off. tokens counts the words and
    EOS, log_prob is the natural logarithm, backed_off the tokens that no trigram gave: 0 for the rows of the model itself with
    least = 1. held, without train: also held_log_prob, held_perplexity, held_backed_off, under the model of the half of the documents (by doc_id) that doesn't have
    the row. Texts without words (null, empty) and rows with a null doc_id are neither counted nor scored. Repeated rows are counted and scored each. Very long texts are
    whole; the longest makes a chunk by itself and must fit in a task. Only doc_id and text are read. An empty table gives an empty result, an empty train or other half the
    probability 1 to the unknown word."""
    if held and (train is not None or least > 1):
        raise ValueError("held is for the rows of the model themselves, with least = 1")
    one = lambda df: df.select(F.col("doc_id").cast("long").alias("_id"), df["text"].alias("text")).where("_id is not null and text is not null")
    src = one(docs if train is None else train)
    ctx = spark.sparkContext
    plan = Plan({0: 1, 1: 0}, (0, 1), True) if held else Plan({0: 0}, (0,)) if train is None else Plan({1: 0}, (0,))
    with Scratch(spark) as sc, _shuffles_removed(spark):
        with Scratch(spark) as first:
            voc = frequent(first, src, limit)
            shared, tasks = ctx.broadcast(voc), max(voc.buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
            chunks = src.mapInArrow(_chunks(shared, None if held else 0), CHUNKS)
            if train is not None:
                chunks = chunks.unionByName(one(docs).mapInArrow(_chunks(shared, 1), CHUNKS))
            chunks = first.table(chunks)
            asked = chunks.mapInArrow(_asked(shared), "chunk long, ngram int, bucket long, side int, keys binary, sums binary")
            counted = first.table(asked.repartition(tasks, "ngram", "bucket").groupBy("ngram", "bucket").applyInArrow(_each(_sum_bucket), COUNTED), "part")
            size = GT_MAX + 3
            moments = {k: {} for k in (0, 1, WHOLE)}
            for r in counted.where("part = 'model'").groupBy("ngram").agg(*[F.sum(F.col("moments")[i]).alias(f"m{i}") for i in range(3 * size)]).collect():
                for k, of in moments.items():
                    of[r["ngram"]] = np.array([r[f"m{k * size + i}"] for i in range(size)], float)
            n = {r["side"]: r["n"] for r in chunks.groupBy("side").agg(F.sum("ndocs").alias("n")).collect()}
            n[WHOLE] = sum(n.values())
            models = ctx.broadcast({k: model_of(moments[k], n.get(k, 0), least) for k in moments})
            answers = counted.where("part = 'answer'").select("chunk", "ngram", "bucket", "counts")
            joined = sc.table(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_pair(_joined), f"{CHUNKS}, counts array<binary>"))
        if train is None and least <= 1 and not held:  # every n-gram is in the model
            alphas = spark.createDataFrame([], ALPHAS)
        else:
            weighed = joined.mapInArrow(_weighed(models, shared, plan), WEIGHED)
            alphas = sc.table(weighed.repartition(tasks, "model", "ngram", "bucket").groupBy("model", "ngram", "bucket").applyInArrow(_each(_weights(models)), ALPHAS))
        scored = joined if train is None else joined.where("side = 1")
        return sc.result(scored.groupBy("chunk").cogroup(alphas.groupBy("chunk")).applyInArrow(_pair(_scores(models, shared, plan)), SCORED + HELD * held))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, read(spark, sf_dir, "documents"), held=True)

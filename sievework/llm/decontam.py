"""Benchmark decontamination by Wu-Manber search over word symbols.

The symbols are word hashes, the patterns all runs of N words of the benchmark items (whole items
if shorter, of at least LEAST words: "the" or "yes" in a text is no contamination). Patterns of about the same length have their own tables, so that a short item doesn't
make the windows of the others short. For windows of m words, m being the shortest pattern of the tables, the shift table gives how far a
window may move from its last block of BLOCK words. A block that is in no pattern moves it by m - BLOCK + 1. Where
the shift is 0 the block's suffix bucket gives the patterns to compare directly, those with the window's prefix hash. All windows of a slice move at the same
time, one cursor for each stretch of STRETCH words, so the loop runs in numpy.

The benchmark is read in blocks of at most about BLOCK_WORDS words. Each block's tables are broadcast and searched for in all documents, so a large benchmark costs
more passes, not more memory.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, buffer_of, col, ints, mix, read, slices, words_of

N, BLOCK, STRETCH = 13, 2, 256
LEAST = 4  # words of an item that is searched for
CLASSES = (4, 7, 13)  # least lengths of the patterns that share tables
BLOCK_WORDS = 2_000_000


@dataclass
class Tables:
    """Patterns in the order of their suffix block; bucket[i]:bucket[i+1] are those of block i of zero."""

    m: int
    words: list[np.ndarray]
    item: np.ndarray
    block: np.ndarray  # sorted hashes of all blocks of the first m words of patterns
    shift: np.ndarray
    zero: np.ndarray  # sorted blocks of shift 0
    bucket: np.ndarray
    prefix: np.ndarray  # hash of the first BLOCK words of each pattern
    both: np.ndarray  # sorted hashes of (suffix block, prefix) of the patterns


def blocks(h: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Hash of the block that begins at each position; the last size - 1 positions have none."""
    n = max(len(h) - size + 1, 0)
    g = h[:n].copy()
    for j in range(1, size):
        g = g * U64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(g)


def patterns_of(items: list[tuple[int, str]], n: int = N, least: int = LEAST) -> list[tuple[int, np.ndarray]]:
    """Items of fewer than min(least, n) words give none."""
    w = words_of(buffer_of(pa.array([t for _, t in items], pa.string())))
    out = []
    for i, (item, _) in enumerate(items):
        h = w.hash[w.lo[i] : w.lo[i + 1]]
        if len(h) >= max(min(least, n), 1):
            out += [(item, h[j : j + n]) for j in range(max(len(h) - n + 1, 1))]
    return out


def build(patterns: list[tuple[int, np.ndarray]]) -> list[Tables]:
    """Tables of each class of lengths that has patterns."""
    found: dict[int, list] = {}
    for item, p in patterns:
        found.setdefault(max((c for c in CLASSES if c <= len(p)), default=1), []).append((item, p))
    return [_tables(some) for _, some in sorted(found.items())]


def _tables(patterns: list[tuple[int, np.ndarray]], size: int = BLOCK) -> Tables:
    m = min(len(p) for _, p in patterns)
    size = min(size, m)
    shift: dict[int, int] = {}
    suffix, prefix = [], []
    for _, p in patterns:
        b = blocks(p[:m], size).tolist()
        for j, x in enumerate(b):
            shift[x] = min(shift.get(x, m - size + 1), len(b) - 1 - j)
        suffix.append(b[-1])
        prefix.append(b[0])
    order = np.argsort(np.array(suffix, np.uint64), kind="stable")
    sorted_suffix = np.array(suffix, np.uint64)[order]
    zero = np.unique(sorted_suffix)
    block = np.array(sorted(shift), np.uint64)
    return Tables(m, [patterns[i][1] for i in order], np.array([patterns[i][0] for i in order], np.int64), block, np.array([shift[int(x)] for x in block], np.int64), zero, np.append(np.searchsorted(sorted_suffix, zero), len(order)), np.array(prefix, np.uint64)[order], np.unique(_both(np.array(suffix, np.uint64), np.array(prefix, np.uint64))))


def _both(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return mix(suffix * U64(0xD6E8FEB86659FD93) + prefix)


def search(tables: list[Tables], w: Words) -> tuple[np.ndarray, ...]:
    """(document, word position, item) of every occurrence of a pattern."""
    found = [_search(t, w) for t in tables if len(w.hash) >= t.m]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _search(t: Tables, w: Words) -> tuple[np.ndarray, ...]:
    size = min(BLOCK, t.m)
    b = blocks(w.hash, size)
    count = np.maximum(w.count - t.m + 1, 0)  # window positions of each document
    pieces = -(-count // STRETCH)
    doc = np.repeat(np.arange(len(count)), pieces)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = w.lo[:-1][doc] + turn * STRETCH
    stop = np.minimum(at + STRETCH, (w.lo[:-1] + count)[doc])
    out_d, out_at, out_p = [], [], []
    while len(at):
        last = b[at + t.m - size]
        k = np.minimum(np.searchsorted(t.block, last), len(t.block) - 1)
        step = np.where(t.block[k] == last, t.shift[k], t.m - size + 1)
        here = np.flatnonzero(step == 0)
        pair = _both(last[here], b[at[here]])
        for c in here[t.both[np.minimum(np.searchsorted(t.both, pair), len(t.both) - 1)] == pair]:
            z = int(np.searchsorted(t.zero, last[c]))
            begin, d = int(at[c]), int(doc[c])
            for p in range(t.bucket[z], t.bucket[z + 1]):
                want = t.words[p]
                if t.prefix[p] == b[begin] and begin + len(want) <= w.lo[d + 1] and (w.hash[begin : begin + len(want)] == want).all():
                    out_d.append(d), out_at.append(begin - w.lo[d]), out_p.append(int(t.item[p]))
        at = at + np.maximum(step, 1)
        go = at < stop
        at, stop, doc = at[go], stop[go], doc[go]
    return tuple(np.array(x, np.int64) for x in (out_d, out_at, out_p))


def _found(tables):
    def run(batches):
        t = tables.value
        for b in slices(batches, "text"):
            d, at, item = search(t, words_of(buffer_of(col(b, "text"))))
            if not len(d):
                continue
            key = np.stack([d, item, at], axis=1)
            key = np.unique(key, axis=0)
            pair, first, n = np.unique(key[:, :2], axis=0, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ints(b, "_id")[pair[:, 0]]), pa.array(pair[:, 1]), pa.array(n.astype(np.int64)), pa.array(key[first, 2])], ["doc_id", "item_id", "hits", "first_word"])

    return run


def tables_of(spark: SparkSession, benchmark: DataFrame, n: int = N, block: int = BLOCK_WORDS) -> list:
    """The tables of each block of items, as broadcast variables."""
    out, items, words = [], [], 0

    def close() -> None:
        if found := build(patterns_of(sorted(items), n)):
            out.append(spark.sparkContext.broadcast(found))
        items.clear()

    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        items.append((r["item_id"], r["text"]))
        words += r["text"].count(" ") + 1
        if words >= block:
            close()
            words = 0
    close()
    return out


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = N, block: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, hits, first_word) for each document and benchmark item that share a run of n words.

    Items of fewer than n words count where they occur whole, those of fewer than LEAST words not at all; items and documents without words (null, empty) never. hits is
    the number of word positions of the document at which a shared run begins, first_word the least of them. Case, punctuation and spaces don't count. Very long texts are
    searched to their end. Rows with a null doc_id are left out, repeated rows are summed up. An empty table on either side gives an empty result. Only doc_id, item_id and
    text are read."""
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("text"))
    kind = "doc_id long, item_id long, hits long, first_word long"
    parts = [src.mapInArrow(_found(t), kind) for t in tables_of(spark, benchmark, n, block)]
    found = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)
    return found.groupBy("doc_id", "item_id").agg(F.sum("hits").alias("hits"), F.min("first_word").alias("first_word"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = N, block: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows whose text shares a run of n words with a benchmark item, as in contaminated(); columns as they are. Each row is judged on its own text:
    repeated rows share their fate, a null doc_id doesn't matter, null and empty texts stay. An empty table on either side drops nothing."""

    def hit_of(tables):
        def hit(text: pa.Array) -> pa.Array:
            parts = []
            for b in slices([pa.record_batch([text], ["text"])], "text"):
                found = np.zeros(b.num_rows, bool)
                found[search(tables.value, words_of(buffer_of(b.column(0))))[0]] = True
                parts.append(found)
            return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

        return F.arrow_udf(hit, "boolean")

    for t in tables_of(spark, benchmark, n, block):
        docs = docs.where(~hit_of(t)(docs["text"]))
    return docs


SQL = f"""
with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') w from documents where doc_id is not null and text is not null),
b as (select distinct item_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') w from benchmark where item_id is not null and text is not null),
bg as (select distinct item_id, len(p) n, array_to_string(p, ' ') g from (select item_id, w[i:i + {N - 1}] p from (select item_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) i from b where len(w) >= {LEAST}))),
sizes as (select distinct n from bg),
dg as (select doc_id, i, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n))
select doc_id, item_id, cast(count(distinct i) as bigint) hits, cast(min(i) - 1 as bigint) first_word from dg join bg using (g) group by doc_id, item_id
"""


def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

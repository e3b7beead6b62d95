"""MinHash near-duplicate groups with tensored banding.

A table key is a pair (x, y): x from one of SIDE left collections and y from one of SIDE right
collections, each made of DEPTH minhashes. SIDE**2 tables of 2*DEPTH minhashes a key so need only
2*SIDE*DEPTH minhash functions (96 for 256 tables) in place of 2*DEPTH*SIDE**2 (1,536). The tensor form
also prunes: a document can only share a table (x, y) with another if it shares x and y, so
values that no other document has are dropped before any pair is formed.

Candidates are verified by the exact Jaccard similarity of their sets of word shingles. In a
table bucket every member is first compared with the bucket's least document, which makes the work
linear in the size of a group of copies. What this leaves in different components is then compared
pair by pair, so the components are those of all candidate pairs; no bucket is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, buffer_of, col, each_of, free_name, grams, ints, lists, mix, read, slices, small_side, words_of
from .graph import components

SHINGLE, SIDE, DEPTH, THRESHOLD = 3, 16, 3, 0.6
RUN = 2000  # comparisons with one pivot that go to one task


def shingles(w, k: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(hashes, lo): the shingles of each document; all its words as one if it has fewer than k."""
    g, lo = grams(w, k)
    count = np.diff(lo)
    short = np.flatnonzero((count == 0) & (w.count > 0))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for n, d in enumerate(short):
            h = U64(len(w.hash[w.lo[d] : w.lo[d + 1]]))
            for x in w.hash[w.lo[d] : w.lo[d + 1]]:
                h = mix(np.array([h ^ x]))[0]
            whole[n] = h
        g = np.insert(g, lo[short], whole)
        count[short] = 1
    return g, np.concatenate([[0], np.cumsum(count)])


def distinct(g: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same without repeats, ascending in each document."""
    count = np.diff(lo)
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(g: np.ndarray, lo: np.ndarray, side: int = SIDE, depth: int = DEPTH, seed: int = 9) -> np.ndarray:
    """int64 (documents, 2 * side): the value of each collection. Every document must have a shingle."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 31, 2 * side * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, 2 * side * depth, dtype=np.uint32)
    x = (g >> U64(32)).astype(np.uint32)
    out = np.empty((len(lo) - 1, 2 * side), np.uint64)
    y = np.empty_like(x)
    for c in range(2 * side):
        v = np.full(len(lo) - 1, c + 1, np.uint64)
        for d in range(depth):
            f = c * depth + d
            np.multiply(x, mul[f], out=y)
            y += add[f]
            v = mix(v ^ np.minimum.reduceat(y, lo[:-1]).astype(np.uint64) * U64(0x2545F4914F6CDD1D))
        out[:, c] = v
    return out.view(np.int64)


def _sign(batches):
    for b in slices(batches, "text"):
        w = words_of(buffer_of(col(b, "text")))
        has = w.count > 0
        if not has.any():
            continue
        g, lo = shingles(w)
        glo = np.concatenate([[0], np.cumsum(np.diff(lo)[has])])
        sig = signatures(g, glo)
        weight = mix(w.hash ^ mix(np.arange(len(w.hash), dtype=np.uint64) - w.lo[:-1].astype(np.uint64)[w.doc()]))
        begin = w.lo[:-1][has]
        whole = np.add.reduceat(weight, begin)
        other = np.bitwise_xor.reduceat(weight * U64(0x9E3779B97F4A7C15), begin) + w.count[has].astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(ints(b, "_id")[has]), pa.array(ints(b, "_mark")[has]), pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), lists(sig.ravel(), np.arange(len(sig) + 1) * sig.shape[1], pa.int64())], ["_id", "_mark", "h1", "h2", "sig"])


def _sets(batches):
    for b in slices(batches, "text"):
        g, lo = distinct(*shingles(words_of(buffer_of(col(b, "text")))))
        raw, at = g.tobytes(), lo * 8
        yield pa.RecordBatch.from_arrays([col(b, "_id"), pa.array([raw[at[i] : at[i + 1]] for i in range(len(lo) - 1)], pa.binary())], ["_id", "s"])


def _compare(batches):
    """Rows sorted by pivot and salt, the pivot's own row first."""
    key, own = None, np.zeros(0, np.uint64)
    for b in each_of(batches):
        out_a, out_b, out_j = [], [], []
        for a, salt, m, s in zip(ints(b, "a"), ints(b, "salt"), ints(b, "m"), col(b, "s").to_pylist(), strict=True):
            s = np.frombuffer(s, np.uint64)
            if a == m:
                key, own = (a, salt), s
            elif key == (a, salt):
                same = len(np.intersect1d(own, s, assume_unique=True))
                out_a.append(a), out_b.append(m), out_j.append(same / (len(own) + len(s) - same))
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_j, pa.float64())], ["a", "b", "jaccard"])


def _least_of_equal(sc: Scratch, one: DataFrame) -> DataFrame:
    """(_id, _mark, rep): the least _id of the same words in order. A text that a third of all documents have is summed up before the shuffle."""
    least = sc.table(one.groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return one.join(small_side(least), ["h1", "h2"], "left").select("_id", "_mark", F.coalesce("rep", "_id").alias("rep"))


def verify(sc: Scratch, docs: DataFrame, pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(a, b, jaccard) of each pair. docs: _id, _mark, text; pairs: written table of distinct (a, b); chosen: the _mark of each _id that counts."""
    ids = sc.table(chosen.join(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "_id", "left_semi"))
    sets = sc.table(docs.join(small_side(ids), ["_id", "_mark"], "left_semi").mapInArrow(_sets, "_id long, s binary"))
    turn = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    salted = pairs.select("a", "b", F.floor((turn - 1) / RUN).alias("salt"))
    members = salted.join(sets.select(F.col("_id").alias("b"), "s"), "b").select("a", "salt", F.col("b").alias("m"), "s")
    pivots = salted.select("a", "salt").distinct().join(sets.select(F.col("_id").alias("a"), "s"), "a").select("a", "salt", F.col("a").alias("m"), "s")
    rows = members.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", (F.col("m") != F.col("a")).cast("int"), "m")
    return rows.mapInArrow(_compare, "a long, b long, jaccard double")


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keeper, kept, group_size) for every document that has an exact or near copy.

    Two documents are near copies if the Jaccard similarity of their sets of 3-word shingles is at
    least threshold; groups are the connected components, keeper the least doc_id of the group.
    Documents whose words are equal in order are copies whatever their case, punctuation or spaces.
    Documents without words (null, empty, only punctuation) and rows without doc_id are in no group.
    Rows that repeat a doc_id are one document; of differing texts under one id that of the least hashes is used. Very long texts are compared whole. Only doc_id and text are
    read, so other columns may have any name. An empty table gives an empty result.
    """
    return _groups(spark, docs, threshold).drop("_mark")


def _groups(spark: SparkSession, docs: DataFrame, threshold: float) -> DataFrame:
    """The same with _mark, a hash of the text that was used."""
    src = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_mark"), F.col("text").alias("text")).where("_id is not null and text is not null")
    with Scratch(spark) as sc:
        sig = sc.table(src.mapInArrow(_sign, "_id long, _mark long, h1 long, h2 long, sig array<long>"))
        one = sig.groupBy("_id").agg(F.min(F.struct("h1", "h2", "_mark")).alias("h")).select("_id", "h.*")
        same = sc.table(_least_of_equal(sc, one))
        chosen = same.select("_id", "_mark")
        reps = sig.join(same.where("_id = rep"), ["_id", "_mark"], "left_semi").dropDuplicates(["_id"]).select("_id", F.posexplode("sig").alias("slot", "val"))
        shared = reps.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("val"))).where("n > 1")
        pick = lambda cond: F.collect_list(F.when(cond, F.col("val")))
        keys = sc.table(shared.groupBy("_id").agg(pick(F.col("slot") < SIDE).alias("x"), pick(F.col("slot") >= SIDE).alias("y")).where("size(x) > 0 and size(y) > 0"))
        rows = keys.select("_id", F.explode("x").alias("x"), "y").select("_id", "x", F.explode("y").alias("y")).select("_id", F.xxhash64("x", "y").alias("key"))
        star = rows.withColumn("a", F.min("_id").over(Window.partitionBy("key"))).where("a <> _id").select("a", F.col("_id").alias("b")).distinct()
        tried = sc.table(star)
        checked = sc.table(verify(sc, src, tried, chosen))
        edges = checked.where(F.col("jaccard") >= threshold).select("a", "b")
        root = components(sc, edges).withColumnRenamed("node", "_id")
        rooted = sc.table(rows.join(root, "_id", "left").select("key", F.coalesce("root", "_id").alias("root"), "_id"))
        split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        part = rooted.join(split, "key", "left_semi").groupBy("key", "root").agg(F.collect_list("_id").alias("ids"))
        left, right = (part.select("key", F.col("root").alias(f"r{n}"), F.col("ids").alias(f"i{n}")) for n in (1, 2))
        cross = left.join(right, "key").where("r1 < r2").select(F.explode("i1").alias("p"), "i2").select("p", F.explode("i2").alias("q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        more = sc.table(cross.distinct().join(tried, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            edges = edges.unionByName(verify(sc, src, more, chosen).where(F.col("jaccard") >= threshold).select("a", "b"))
        copies = same.where("_id <> rep").select(F.col("rep").alias("a"), F.col("_id").alias("b"))
        all_edges = sc.table(edges.unionByName(copies))
        root = sc.table(components(sc, all_edges))
        sized = root.join(root.groupBy("root").agg(F.count(F.lit(1)).alias("group_size")), "root")
        marked = sized.join(chosen, F.col("node") == F.col("_id"))
        return sc.result(marked.select(F.col("node").alias("doc_id"), F.col("root").alias("keeper"), (F.col("node") == F.col("root")).alias("kept"), "group_size", "_mark"))


def keep_one(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents of a group other than its keeper; columns and other rows as they are.

    A row goes if its doc_id and text are those of such a document, so of differing texts under one doc_id only the one that was compared can go. Repeated rows go or stay
    together. Rows with a null doc_id and texts without words (null, empty) stay. An empty table gives an empty result."""
    name, mark = free_name(docs, "_gone"), free_name(docs, "_mark")
    gone = _groups(spark, docs, threshold).where("not kept").select(F.col("doc_id").alias(name), F.col("_mark").alias(mark))
    return docs.join(small_side(gone), (docs["doc_id"] == F.col(name)) & (F.xxhash64(docs["text"]) == F.col(mark)), "left_anti")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"))

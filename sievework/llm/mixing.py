"""Mixing sources to target weights over fixed-length token blocks.

1. Texts become token ids, a document ending in END. The ids of a source are one stream, in the order of
   (doc_id, text hash); block i of the source holds tokens i*LENGTH to (i+1)*LENGTH - 1. Only a source's last block may be
   shorter and is padded with END.
2. Output shard s of SHARD slots draws its numbers of blocks by source from the multinomial of the target weights.
3. Slot j of a source (counted over shards) maps to block P(j mod n) of the epoch j div n, where P is
   a pseudorandom permutation of the source's n block indices, a Feistel network keyed by seed, source and epoch. Within
   an epoch no block repeats.
4. Slots join blocks by (source, index). There are as many slots as blocks.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, buffer_of, col, each_of, ints, mix, read, slices, small_side, span_hash

LENGTH, SHARD, SEED = 1024, 256, 4
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
CACHE = 1_000_000


class Encoder:
    """Byte-pair ids of whole slices. A text is cut before each single space between two other
    characters, where the tokenizer's own pattern always cuts too, and every distinct piece is
    encoded once and remembered (the memory is emptied at CACHE pieces), so the ids are those of encoding the whole text."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple] = []  # (sorted keys, places, sizes), each over twice as long as the next
        self.pool = np.zeros(0, np.uint16)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        new = [self.bpe.encode_ordinary(t) for t in texts]
        size = np.array([len(x) for x in new], np.int32)
        place = (len(self.pool) + np.cumsum(size) - size).astype(np.int32)
        self.pool = np.concatenate([self.pool, np.array([i for x in new for i in x], np.uint16)])
        self.levels.append((keys, place, size))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            both = [np.concatenate(x) for x in zip(self.levels[-2], self.levels[-1], strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels[-2:] = [tuple(x[order] for x in both)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in the pool, -1 if unknown; size) of each key."""
        place, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for known, places, sizes in self.levels:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = np.flatnonzero(known[at] == keys)
            place[hit], size[hit] = places[at[hit]], sizes[at[hit]]
        return place, size

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, ...]:
        """(ids, lo): ids[lo[i]:lo[i + 1]] are those of text i, without an end mark."""
        buf = buffer_of(text, lower=False)
        n = len(buf.data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(buf.at), np.int64)
        plain = np.ones(256, bool)
        plain[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = False  # white space, also as part of a wider character
        cut = np.zeros(n, bool)
        p = plain[buf.data]
        cut[1:-1] = (buf.data[1:-1] == 32) & p[:-2] & p[2:]
        cut[buf.at[:-1][buf.at[:-1] < n]] = True
        last = buf.at[1:] - 1
        cut[last[(last >= 0) & (np.diff(buf.at) > 1)]] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        key = span_hash(buf.sums(), start, end)
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        place, size = self.find(uniq)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = buf.data.tobytes()
            if sum(len(x[0]) for x in self.levels) > CACHE:
                self.clear()
                new = np.arange(len(uniq))
            self.learn(uniq[new], [raw[start[i] : end[i]].decode("utf-8") for i in first[new]])
            place, size = self.find(uniq)
        size = size[back]
        total = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(place[back] - total[:-1], size) + np.arange(total[-1])
        return self.pool[pick], total[np.searchsorted(start, buf.at)]


_encoders: dict[int, Encoder] = {}


def tokenizer_of(path: str) -> tuple[bytes, str]:
    """(vocabulary file, pattern), read on the driver and sent to the workers: a few MB, whatever the corpus."""
    import public_tokenizers

    with open(path, "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoder(shared) -> Encoder:
    name = hash(shared.value)
    if name not in _encoders:
        _encoders[name] = Encoder(*shared.value)
    return _encoders[name]


def _tokenise(shared, end: int):
    def run(batches):
        enc = encoder(shared)
        for b in slices(batches, "text", 1 << 18):
            ids, lo = enc(col(b, "text"))
            mark = np.array([end], np.uint16).tobytes()
            out = [ids[lo[i] : lo[i + 1]].tobytes() + mark if lo[i + 1] > lo[i] else None for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([col(b, "_id"), col(b, "source"), col(b, "tie"), pa.array(out, pa.binary())], ["_id", "source", "tie", "ids"])

    return run


def starts(sc: Scratch, sizes: DataFrame, group: str, order: list[str], value: str, tasks: int) -> DataFrame:
    """sizes with start: the sum of value over the rows before in the group. Rows are range-partitioned and summed
    inside each partition; only the partitions' totals, written with them, are summed over partitions, so that a large
    group isn't one task's work."""
    ranged = sizes.repartitionByRange(tasks, group, *order).withColumn("_p", F.spark_partition_id())
    ranged = sc.table(ranged)
    inner = Window.partitionBy("_p", group).orderBy(*order)
    before = ranged.groupBy("_p", group).agg(F.sum(value).alias("_t")).withColumn("_b", F.sum("_t").over(Window.partitionBy(group).orderBy("_p")) - F.col("_t")).drop("_t")
    before = small_side(sc.table(before))  # a row for each partition and group in it
    return ranged.withColumn("_s", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)).join(before, ["_p", group]).withColumn("start", F.col("_s") + F.col("_b")).drop("_s", "_b", "_p")


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each i under the pseudorandom permutation of range(n) named by key: a Feistel
    network of 6 rounds over the least even number of bits that holds n, walked until the value is below n."""
    i, n = i.astype(np.uint64), n.astype(np.uint64)
    bits = np.ones(len(i), np.uint64)
    while (todo := (U64(1) << (U64(2) * bits)) < n).any():
        bits[todo] += U64(1)
    mask = (U64(1) << bits) - U64(1)
    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(6):
            left, right = right, left ^ (mix(right ^ mix(k + U64(r))) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _name_key(name: str) -> int:
    h = 1469598103934665603
    for c in name.encode():
        h = ((h ^ c) * 1099511628211) & ((1 << 64) - 1)
    return h


def draw(shard: int, slots: int, weights: np.ndarray, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, shard]).multinomial(slots, weights)


def _draws(sources, weights, total, per_shard, seed):
    def run(batches):
        for b in batches:
            rows = [[], [], []]
            for s in ints(b, "id"):
                n = draw(int(s), int(min(per_shard, total - s * per_shard)), weights, seed)
                for k in np.flatnonzero(n):
                    for r, v in zip(rows, (s, sources[k], n[k]), strict=True):
                        r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())], ["shard", "source", "n"])

    return run


def _slots(counts, seed):
    def run(batches):
        for b in batches:
            name, n = col(b, "source").to_pylist(), ints(b, "n")
            j = np.repeat(ints(b, "start"), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size = np.repeat(np.array([counts[s] for s in name], np.int64), n)
            key = np.repeat(np.array([_name_key(s) for s in name], np.uint64), n)
            epoch = j // np.maximum(size, 1)
            key = mix(key ^ mix(epoch.astype(np.uint64) + U64(seed)))
            block = permute(j % np.maximum(size, 1), size, key)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ints(b, "shard"), n)), pa.array([s for s, k in zip(name, n, strict=True) for _ in range(k)], pa.string()), pa.array(block), pa.array(j), pa.array(epoch)], ["shard", "source", "block", "slot", "epoch"])

    return run


def _split(length: int):
    """Cut documents at the block borders of their source's stream."""

    def run(batches):
        for b in each_of(batches):
            rows = [[], [], [], [], []]
            for d, s, start, ids in zip(ints(b, "_id"), col(b, "source").to_pylist(), ints(b, "start"), col(b, "ids"), strict=True):
                raw = ids.as_py()
                at, n = 0, len(raw) // 2
                while at < n:
                    block, inside = divmod(int(start) + at, length)
                    take = min(length - inside, n - at)
                    for r, v in zip(rows, (s, block, inside, d, raw[2 * at : 2 * (at + take)]), strict=True):
                        r.append(v)
                    at += take
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["source", "block", "inside", "_id", "ids"])

    return run


def mix_sources(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, tokenizer: str = TOKENIZER, length: int = LENGTH, per_shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, source, slot, epoch, block, doc_ids, tokens): one row for each slot.

    weights: target share by source; sources that are not named get none, and those without documents are left out before
    the rest are scaled to 1. None gives equal weights. tokens is a binary of length little-endian uint16
    ids, doc_ids the documents in the block, in order. A null source is the source ''. Null or empty texts have no
    tokens; rows with a null doc_id come first in their source and give no doc_id; repeated rows count each. The result doesn't depend on the partitioning.
    Very long texts are encoded whole. Only doc_id, source and text are read. An empty table gives an empty result."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(docs["source"], F.lit("")).alias("source"), F.xxhash64(docs["text"]).alias("tie"), docs["text"].alias("text")).where("text is not null and text <> ''")
    with Scratch(spark) as sc:
        shared = spark.sparkContext.broadcast(tokenizer_of(tokenizer))
        tokens = sc.result(src.mapInArrow(_tokenise(shared, END), "_id long, source string, tie long, ids binary"))
        sizes = tokens.select("_id", "source", "tie", (F.octet_length("ids") / 2).cast("long").alias("n"))
        one = sizes.groupBy("source", "_id", "tie").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
        at = sc.result(starts(sc, one, "source", ["_id", "tie"], "n", tasks))
        total = {r["source"]: r["t"] for r in tokens.select("source", (F.octet_length("ids") / 2).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("t")).collect()}
        blocks = {s: -(-t // length) for s, t in total.items() if weights is None or weights.get(s, 0) > 0}
        names = sorted(blocks)
        share = np.array([1.0 if weights is None else weights[s] for s in names])
        slots = sum(-(-t // length) for t in total.values()) if names else 0
        drawn = spark.range(-(-slots // per_shard)).mapInArrow(_draws(names, share / share.sum() if len(names) else share, slots, per_shard, seed), "shard long, source string, n long")
        drawn = starts(sc, drawn, "source", ["shard"], "n", min(tasks, 8 + slots // 100_000))
        slot = sc.result(drawn.mapInArrow(_slots(blocks, seed), "shard long, source string, block long, slot long, epoch long"))
    same = [tokens["source"] == at["source"], tokens["_id"].eqNullSafe(at["_id"]), tokens["tie"].eqNullSafe(at["tie"])]
    placed = tokens.join(small_side(at), same).select(tokens["source"], tokens["_id"], tokens["tie"], "ids", "start", "c")
    again = placed.where("c > 1").dropDuplicates(["source", "_id", "tie"]).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("c") - 1).cast("int"))))
    again = again.withColumn("start", F.col("start") + F.col("k") * (F.octet_length("ids") / 2).cast("long")).drop("k")
    pieces = placed.where("c = 1").unionByName(again).select("source", "_id", "start", "ids").mapInArrow(_split(length), "source string, block long, inside int, _id long, ids binary")
    packed = pieces.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("inside", "_id", "ids"))).alias("p"))
    pad = END.to_bytes(2, "little").hex()
    return packed.join(slot, ["source", "block"]).select(
        "shard", "source", "slot", "epoch", "block", F.expr("array_compact(transform(p, x -> x._id))").alias("doc_ids"), F.expr(f"rpad(aggregate(p, X'', (t, x) -> concat(t, x.ids)), {2 * length}, X'{pad}')").alias("tokens")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, read(spark, sf_dir, "documents"))

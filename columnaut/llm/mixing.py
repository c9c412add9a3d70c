"""Mixing sources to target weights by blocks of words.

The words of each source are laid end to end (documents by bucket of their id, then by id) and cut into blocks of a fixed length. Every source gets a
target number of words: its weight's share of the whole, but at most `max_repeats` times its size, the excess being shared out again.
The mix is a sequence of slots, cut into shards; each slot takes one block. How many slots of a shard fall to each source is drawn from a multinomial
conditioned on the targets: the slots of the whole are split in halves again and again, the left half's counts being drawn at random, so every
shard finds its own counts and offsets in a few steps, without a list of all shards. The i-th slot of a source takes the block that a keyed pseudorandom
permutation (a Feistel network, walked until it falls into range) gives for i; when a source has fewer blocks than slots, the permutation is
drawn anew for each pass. Slots and blocks are joined by source and block index.

The last slot of a source takes only as many words of its block as the target leaves, so a source misses its target by rounding alone, as long as
max_repeats allows. Results depend on ids, sizes and the seed only, so reruns agree.

Edge cases: a null or empty text has no words and is never taken; a null source is a source of its own, the last; repeated rows are rows of their own; a null
id sorts first; rows may share an id, each keeps its own text. An empty table gives an empty result; other columns aren't read. Texts are counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, documents, map_batches, materialize, slices, texts_of, words_of

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
BUCKET_ROWS = 65_536
SEED = 20_240_101


def targets(sizes: list[int], weights: list[float], max_repeats: int) -> list[float]:
    """Words for each source: shares of all words by weight, none above max_repeats times its size. The cap binds for the sources whose
    size is least against their weight, so they are settled in that order."""
    left, weight = float(sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i]):
        out[i] = min(max_repeats * sizes[i], left * weights[i] / weight)
        left -= out[i]
        weight -= weights[i]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """The places of i under a pseudorandom permutation of 0 .. n - 1, one for each key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x, k = out[todo], key[todo]
        a, b = x >> np.uint64(half), x & low
        for r in range(4):
            a, b = b, a ^ (_mix(b + k + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & low)
        x = a << np.uint64(half) | b
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


#: numpy draws exactly from populations up to this size.
_NUMPY_LIMIT = 900_000_000


def _log_ratio(a: int, b: int) -> float:
    """log(a! / b!) without the loss of digits that a difference of two large logarithms has."""
    if min(a, b) < 10_000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    return d * math.log(b) + (a + 0.5) * math.log1p(d / b) - d + (1 / a - 1 / b) / 12


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of `take` things drawn without replacement are good, at any size: by the ratio of uniforms (Stadlober), whose acceptance test uses the distribution itself."""
    n, few, many = good + bad, min(good, bad), max(good, bad)
    m, z = min(take, n - take), 0
    if m and few:
        centre, sd = m * (few / n) + 0.5, math.sqrt((n - m) / (n - 1) * m * (few / n) * (many / n) + 0.5)
        height = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
        mode, top = (m + 1) * (few + 1) // (n + 2), min(min(m, few) + 1, math.floor(centre + 16 * sd))
        while True:
            u, v = rng.random(2)
            x = centre + height * (v - 0.5) / u if u else -1.0
            if 0 <= x < top:
                z = int(x)
                t = _log_ratio(mode, z) + _log_ratio(few - mode, few - z) + _log_ratio(m - mode, m - z) + _log_ratio(many - m + mode, many - m + z)
                if 2 * math.log(u) <= t:
                    break
    if good > bad:
        z = m - z
    return good - z if m < take else z


def _split(counts: np.ndarray, take: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of `take` slots drawn at random without replacement fall to each source; exact at any size."""
    rng = np.random.default_rng(seed)
    left = int(counts.sum())
    if left < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out = np.zeros_like(counts)
    for s, own in enumerate(map(int, counts)):
        left -= own
        out[s] = hypergeometric(own, left, take, rng)
        take -= int(out[s])
    return out


def shard_counts(slots: np.ndarray, shard: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot number of each source in this shard, number of slots of each source)."""
    lo, hi, counts, before = 0, n_shards, slots.astype(np.int64), np.zeros(len(slots), np.int64)
    total = int(slots.sum())
    edge = lambda k: total * k // n_shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(counts, edge(mid) - edge(lo), (seed, lo, hi))
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, counts - left, before + left
    return before, counts


class Mix:
    """The parts of a mix as DataFrames: sized (one row per document with its place in its source), sources (on the driver, one entry per source), and taken
    (slots joined with the documents of their blocks). key_col: a binary column that tells rows with the same id apart; sized and taken then bear it as `key`."""

    def __init__(self, docs: DataFrame, weights=lambda i: (5, 2, 1)[i % 3], max_repeats: int = 3, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None, max_sources: int = 100_000):
        spark = docs.sparkSession
        self.block, self.id_col = block, id_col
        own_key = ["key"] if key_col else []
        source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{key_col}`").alias(k) for k in own_key))
        kind = source.schema["id"].dataType

        def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sizes = [len(words_of(t)) for part in slices(batch, "text") for t in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(sizes, pa.int64()), *map(batch.column, own_key)], names=["id", "source", "size", *own_key])

        counted = materialize(map_batches(source, count, f"id {kind.simpleString()}, source string, size bigint{', key binary' if own_key else ''}"), "mix-sizes")
        rows = counted.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
        if len(rows) > max_sources:
            raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
        rows.sort(key=lambda r: (r.source is None, r.source or ""))  # code points order as Python's strings do
        self.sources = [r.source for r in rows]
        self.sizes = [int(r["size"]) for r in rows]
        self.weights = [weights(i) for i in range(len(rows))]
        self.targets = targets(self.sizes, self.weights, max_repeats)

        # place of every document within its source: rows that are alike are one entry with a count, so that no value can fill a bucket; buckets of bounded size are
        # sorted, and their totals summed up
        n_buckets = max(1, -(-sum(r.n for r in rows) // BUCKET_ROWS))
        at = spark.createDataFrame([(k, s) for k, s in enumerate(self.sources)], "s int, source string")
        keyed = counted.join(F.broadcast(at), counted["source"].eqNullSafe(at["source"])).groupBy("s", "id", *own_key, "size").agg(F.count(F.lit(1)).alias("k"))
        keyed = keyed.withColumn("b", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), *map(F.hex, own_key)), "size"), F.lit(n_buckets)).cast("int"))
        keyed = materialize(keyed, "mix-entries")
        totals = keyed.groupBy("s", "b").agg(F.sum(F.col("size") * F.col("k")).alias("t"))
        base = totals.withColumn("base", F.sum("t").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("s", "b", F.coalesce("base", F.lit(0)).alias("base"))
        inside = Window.partitionBy("s", "b").orderBy("id", "size", *own_key).rowsBetween(Window.unboundedPreceding, -1)
        placed = keyed.withColumn("own", F.coalesce(F.sum(F.col("size") * F.col("k")).over(inside), F.lit(0))).join(F.broadcast(base) if n_buckets * len(rows) <= 100_000 else base, ["s", "b"])
        placed = placed.select("id", *own_key, "s", "size", (F.col("base") + F.col("own")).alias("start"), "k")
        one = placed.where("k = 1").drop("k")
        many = placed.where("k > 1").withColumn("c", F.explode(F.expr(f"sequence(0L, k - 1, {BUCKET_ROWS}L)")))
        if not many.isEmpty():  # entries of many rows are cut up and dealt out before they become rows again
            many = many.repartition("id", *own_key, "s", "size", "c").withColumn("i", F.explode(F.expr(f"sequence(c, least(c + {BUCKET_ROWS}L, k) - 1)")))
            one = one.unionByName(many.select("id", *own_key, "s", "size", (F.col("start") + F.col("i") * F.col("size")).alias("start")))
        self.sized = materialize(one, "mix-places")

        # slots: as many blocks as the target needs, the last perhaps in part; passes over a source are whole but the last
        sizes, goal = np.array(self.sizes, np.int64), np.array([round(t) for t in self.targets], np.int64)
        goal = np.minimum(goal, max_repeats * sizes)
        blocks = -(-sizes // block)
        passes = np.where(sizes > 0, goal // np.maximum(sizes, 1), 0)
        rest = goal - passes * sizes  # words of the last pass
        self.last = []  # of each source: slots in the last pass, and the words that its last slot takes
        for s in range(len(rows)):
            short = int(sizes[s] - (blocks[s] - 1) * block) if blocks[s] else 0  # words of the final block
            need, k = int(rest[s]), 0
            if need:
                key = np.full(1, _key(seed, s, int(passes[s])), np.uint64)
                where = _inverse(int(blocks[s]) - 1, int(blocks[s]), key)
                k = -(-need // block)
                if where < k:  # the final, shorter block is among them
                    k = -(-(need + block - short) // block)
                    need -= (k - 2) * block + short if k - 1 != where and k > 1 else (k - 1) * block
                else:
                    need -= (k - 1) * block
            self.last.append((k, need))
        slots = passes * blocks + np.array([k for k, _ in self.last], np.int64)
        total = int(slots.sum())
        n_shards = max(1, -(-total // shard_slots))
        last, nb = self.last, [int(x) for x in blocks]

        def shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for shard in batch.column("id").to_pylist():
                before, n = shard_counts(slots, shard, n_shards, seed)
                for s in np.flatnonzero(n):
                    i = np.arange(before[s], before[s] + n[s])
                    turn = i // nb[s]
                    keys = np.array([_key(seed, int(s), int(t)) for t in np.unique(turn)], np.uint64)[np.searchsorted(np.unique(turn), turn)]
                    at = permuted(i % nb[s], nb[s], keys)
                    most = np.full(len(i), block, np.int64)
                    most[i == slots[s] - 1] = last[s][1] if last[s][0] else block
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shard)), pa.array(np.full(len(i), s, np.int32)), pa.array(i), pa.array(at), pa.array(most)], names=["shard", "s", "slot", "block", "most"])

        tasks = min(n_shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.slots = map_batches(spark.range(0, n_shards if total else 0, 1, tasks), shards, "shard bigint, s int, slot bigint, block bigint, most bigint")
        covered = self.sized.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
        left, right = F.col("start") - F.col("block") * block, F.col("start") + F.col("size") - F.col("block") * block
        covered = covered.select("s", "block", "id", *own_key, "start", F.greatest(left, F.lit(0)).alias("lo"), F.least(right, F.lit(block)).alias("hi"))
        # the size of what slots hold is not known beforehand, so a broadcast of it would have no bound
        joined = self.slots.hint("merge").join(covered, ["s", "block"]).where("lo < most")
        # words [first, last) of the document that this slot of the mix takes
        self.taken = joined.select("shard", "s", "slot", "block", "id", *own_key, "start", (F.col("block") * block + F.col("lo") - F.col("start")).alias("first"), (F.col("block") * block + F.least("hi", "most") - F.col("start")).alias("last"))

    def digest(self) -> DataFrame:
        """One row per document: size, source_size, target of its source, and the words of it that the mix takes."""
        spark = self.sized.sparkSession
        per = spark.createDataFrame([(k, a, float(t)) for k, (a, t) in enumerate(zip(self.sizes, self.targets))], "s int, source_size long, target double")
        took = self.taken.groupBy("s", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken")).withColumnRenamed("s", "_s").withColumnRenamed("start", "_start")
        # a place in the source tells rows apart, repeated ones too; rows without words have the place of the next one
        rows = self.sized.join(took, (F.col("s") == F.col("_s")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
        return rows.join(F.broadcast(per), "s").select(F.col("id").alias(self.id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _key(seed: int, s: int, turn: int) -> int:
    x = np.array([(seed * 0x9E3779B97F4A7C15 + s * 0xD1B54A32D192ED03 + turn * 0x8CB92BA72F3D8DD7) % 2**64], np.uint64)
    return int(_mix(x)[0])


def _inverse(place: int, n: int, key: np.ndarray) -> int:
    """The i whose permuted place is `place`: the network run backwards."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = np.array([place], np.uint64)
    while True:
        a, b = x >> np.uint64(half), x & low
        for r in reversed(range(4)):
            a, b = b ^ (_mix(a + key + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & low), a
        x = a << np.uint64(half) | b
        if x[0] < n:
            return int(x[0])


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus with the columns of docs. A document that the mix takes k times over comes k times; where it takes only some of a document's
    words, rows hold the runs of words taken. Texts that are taken whole stay as they are; length_col follows the text. Rows are told apart by a digest of all their columns, so ids may be null or repeated; of rows that are alike in every column one bears the words of all."""
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)))
    docs = docs.withColumn("__mix_key", F.unhex(F.sha2(F.concat(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256), others), 256)))
    mix = Mix(docs, id_col=id_col, text_col=text_col, key_col="__mix_key", **options)
    # how often each stretch of words is taken: +1 at its begin, -1 at its end
    edges = mix.taken.select("key", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("d")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    plan = edges.groupBy("key", "e.at").agg(F.sum("e.d").alias("d")).where("d <> 0").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "d"))).alias("__mix_edges")).withColumnRenamed("key", "__mix_key")
    columns, fields = docs.columns[:-1], docs.schema.fields[:-1]
    if not mix.sized.groupBy("key").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["__mix_key"])
    whole = docs.join(plan, "__mix_key").drop("__mix_key")
    at, length_at = columns.index(text_col), columns.index(length_col) if length_col in columns else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, batch.schema.names[at]):
            rows, out = [], []
            for i, (text, edges) in enumerate(zip(texts_of(part, text_col), part.column(part.num_columns - 1).to_pylist())):
                depth, open_at, runs = 0, [], []
                for e in edges:
                    for _ in range(e["d"]):
                        open_at.append(e["at"])
                    for _ in range(-e["d"]):
                        runs.append((open_at.pop(), e["at"]))
                    depth += e["d"]
                places = None
                for a, b in sorted(runs):
                    if places is None:
                        places = [m.span() for m in WORD.finditer(text)]
                    b = min(b, len(places))
                    if a >= b:
                        continue
                    rows.append(i)
                    out.append(text if (a, b) == (0, len(places)) else text[places[a][0] : places[b - 1][1]])
            take = pa.array(rows, pa.int64())
            arrays = [c.take(take) for c in part.columns[:-1]]
            arrays[at] = pa.array(out, arrays[at].type)
            if length_at is not None:
                arrays[length_at] = pa.array([len(x) for x in out], arrays[length_at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_batches(whole, run, T.StructType(fields))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(documents(spark, sf_dir)).digest()


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_mixing that SQL can express, and how near its source's taken words come to the target."""
    found = op5_mixing(spark, sf_dir)
    source = documents(spark, sf_dir).select("doc_id", "source")
    near = found.join(source, "doc_id").groupBy("source").agg((F.abs(F.sum("taken") - F.max("target")) <= 1).alias("met"))
    rows = found.join(source, "doc_id").join(F.broadcast(near.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"), "met")


#: In the order of their size against their weight, the sources whose cap binds come first: each is tried as if all before it were capped.
TARGETS_ORACLE = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY 1),
    o AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER before, 0) AS b, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest FROM s
        WINDOW before AS (ORDER BY source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, bool_and(3 * source_size <= (total - 3 * b) * w / rest::DOUBLE) OVER (ORDER BY source_size / w::DOUBLE, source NULLS LAST) AS capped FROM o),
    t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size ELSE (total - 3 * coalesce(sum(source_size) FILTER (capped) OVER (), 0)) * w / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END::DOUBLE AS target FROM c)
    SELECT doc_id, size, source_size, round(target, 3) AS target, true AS within, true AS met FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

QUERIES = {"op5_mixing": op5_mixing, "mixing_targets": mixing_targets}
ORACLES = {"mixing_targets": TARGETS_ORACLE}

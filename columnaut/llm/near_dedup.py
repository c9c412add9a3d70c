"""Near-duplicate documents: an exact similarity join on shared shingles, with verification.

1. Equal texts are folded into one node, by 128 bits of their SHA-256.
2. Shingles are word triples of the lower-cased text, weighted by how often they occur. The likeness of two texts is the probability Jaccard J of their weights.
3. Shingles have one order for all texts: those that are common in a sample come last, the commonest at the very end, others by their hash. The sample steers the effort, not the result.
   If A and B are the shares of two texts' weights that lie on the shingles they have in common, J <= f(A, B) = 1 / (1/A + 1/B - 1), as x y / (y + (1 - B) x) is concave. At a shingle in common, before
   which the texts have shares u and v of their weights, the rest gives f(1 - u, 1 - v) at most, and less at each further one. Texts meet at their shingles in common as long as f(1 - u, 1 - v)
   is `_SLACK` times the threshold at least; so u and v are at most 1 - `_SLACK` times the threshold, and only the shingles up to there travel. What two texts have in common without meeting
   there gives less than `_SLACK` times the threshold, and f grows by no more than A and B do. So the weights, of both texts, on the shingles where two texts of J >= threshold meet add up to at least
   (1 - `_SLACK`) times the threshold; pairs that reach this are candidates. No link can be missed: there is no draw and no cap, and shares are rounded so that they let more through.
   A task holds its part of the shingles compressed and matches it in turns, all texts with a shingle in one turn; only a turn is held as arrays.
4. Large clusters are looked for in a sample, by the least shingles of texts. Texts near the middle of one are its members; all pairs of members are verified where their shingles lie, without
   being listed before, so that what travels doesn't grow with the square of a cluster. Pairs of other texts, or of members of different clusters, are left to 3. Which cluster a text belongs to is a
   function of the text, so each pair is looked at in one way or the other, whatever the sample.
5. Candidates are verified by the exact probability Jaccard of their shingles, which are sent from the texts to where they are needed. A pair is sent to a group by the least candidate of its lesser node,
   and groups beyond about `_BLOCK` bytes of shingles or `_PAIRS` pairs are cut into pairs of blocks, so that the shingles of a cluster travel together, about once, and a task holds two blocks at most.
   Members of a cluster are cut into blocks of about `_BLOCK` bytes and `_TEXTS` texts. Unless links are to be listed, a task gives the links of each of its texts, and the least text that they lead to.
6. Links are closed to classes by label propagation with pointer jumping; each round is written to the shared folder.

Result: one row per row of docs: id, class_id (the least id of its class; its own if alone), n_links (links of its text to different texts, all of them), n_copies (rows with this very
text). `links` gives the links themselves. n different texts that are all alike have n (n - 1) / 2 links, and cost that many verifications.

Edge cases: null counts as the empty text; texts without a word have no shingles and only equal ones share a class; texts of one or two words have one
shingle. Repeated rows are copies. Rows are known by their texts: they may share an id, or have none, and a class without any id has none itself. An empty table gives an empty
result. Other columns aren't read. Texts are read whole, shingles are counted without a bound. The threshold must be above 0.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, discard, documents, map_batches, materialize, slices, small_enough, texts_of, two_columns

_WORD = re.compile(r"\w+")
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class NearDedup:
    """words: words in a shingle. threshold: least probability Jaccard of a link. broadcast_rows: up to so many digests of texts are sent to all executors to pick the texts; beyond
    that the texts are joined by a shuffle, once. sample: one text in so many tells which shingles are common, common: the most shingles that are listed as such; both only steer the effort."""

    words: int = 3
    threshold: float = 0.45
    broadcast_rows: int = 500_000
    sample: int = 8
    common: int = 1_000_000


#: The part of the threshold down to which meetings count.
_SLACK = 0.75
#: Bytes of shingles that a block of texts has at most, about, pairs that two blocks have, about, and weights that a part of the shingles has, about.
_BLOCK, _PAIRS, _PART = 16 << 20, 100_000, 3 << 20
#: First shingles of a part that are matched at a time, about, and meetings whose weights are added at a time; a worker holds the rest of the part compressed.
_TURN = 1 << 19
#: Texts of a cluster that a block has at most, about.
_TEXTS = 2048
#: Shingles of a text that its sketch has, texts that are searched for clusters, about, those that make a cluster, and clusters at most.
_SKETCH, _SAMPLED, _MEMBERS, _CLUSTERS = 128, 8192, 4, 1000
#: Bytes of shingles that a character stands for, about.
_BYTES = 3

_HASH = Memo(xxhash.xxh3_64_intdigest)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a text, ascending, and how often each occurs."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    if not k:
        return h, np.zeros(0)
    g = h[: len(h) - k + 1]
    for i in range(1, k):
        g = _mix(g * _C1 + h[i : len(h) - k + 1 + i])
    g, counts = np.unique(g, return_counts=True)
    return g, counts.astype(np.float64)


def prob_minhash(hashes: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of several weighted sets, len(hashes) x m: the element that owns each register. Rows of empty sets are 0."""
    n = len(hashes)
    sizes = [len(h) for h in hashes]
    of = np.repeat(np.arange(n), sizes)
    h = np.concatenate(hashes) if n else np.zeros(0, np.uint64)
    w = np.concatenate(weights) if n else np.zeros(0)
    x = np.zeros(len(h))
    first = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint64)
    step = 0
    while len(h):
        step += 1
        draw = _mix(h + np.uint64(step * int(_C1) % 2**64))
        x = x - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        slot = of * m + (_mix(draw ^ _C3) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, x)
        won = first[slot] == x
        owner[slot[won]] = h[won]
        still = x < first.reshape(n, m).max(axis=1)[of]
        h, w, x, of = h[still], w[still], x[still], of[still]
    return owner.reshape(n, m)


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two weighted sets (hashes ascending): sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    common = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    if not common.any():
        return 0.0
    p, q = a[1][common], b[1][at[common]]
    only_a, only_b = a[1].sum() - p.sum(), b[1].sum() - q.sum()
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    a_until, b_after = np.cumsum(p), q.sum() - np.cumsum(q)
    return float((1 / ((only_a + a_until) / p + (only_b + b_after) / q)).sum())


def prefixes(found: list[tuple[np.ndarray, np.ndarray]], common: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """The first shingles of several texts (none empty), as long as they can be met at: number of the text, hash, the share of the text's weight before it in 255ths, rounded down, and its own
    share in 65535ths, rounded up. common: hashes of common shingles, ascending; rank: their places in the order, from 1."""
    sizes = np.array([len(h) for h, _ in found])
    h, c = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    of = np.repeat(np.arange(len(found)), sizes)
    place = np.zeros(len(h), np.int64)
    if len(common):
        at = np.searchsorted(common, h)
        at[at == len(common)] = 0
        place = np.where(common[at] == h, rank[at], 0)
    order = np.argsort((of << 32) | place, kind="stable")  # of one place the hashes ascend already
    h, c = h[order], c[order]
    before = np.cumsum(c) - c
    total = np.bincount(of, c)[of]
    share = (before - before[np.cumsum(sizes) - sizes][of]) / total
    first = share <= 1 - _SLACK * threshold + 1e-9
    return of[first], h[first], np.minimum(share[first] * 255, 255).astype(np.uint8), np.minimum(np.ceil(c[first] / total[first] * 65535), 65535).astype(np.uint16)


def centres(sketches: list[np.ndarray], least: float) -> list[int]:
    """Numbers of the sketches that lie in the middle of a cluster: `_MEMBERS` sketches or more that have a part `least` in common with it. No sketch counts for two of them; the largest `_CLUSTERS` at most."""
    sizes = np.array([len(x) for x in sketches], np.int64)
    if not sizes.sum():
        return []
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, at, count = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    often = count[at] >= _MEMBERS
    popular = np.bincount(of, np.where(often, count[at], 0), len(sizes)) / np.maximum(sizes, 1)
    left = (np.bincount(of, often, len(sizes)) >= least * sizes) & (sizes > 0)
    keep = often & left[of]
    of, at = of[keep], at[keep]
    own = np.searchsorted(of, np.arange(len(sizes) + 1))
    order = np.argsort(at, kind="stable")
    holders, start = of[order], np.searchsorted(at[order], np.arange(len(count) + 1))
    found = []
    for k in np.argsort(-popular, kind="stable").tolist():
        if left[k]:
            common = np.bincount(np.concatenate([holders[start[t] : start[t + 1]] for t in at[own[k] : own[k + 1]]]), minlength=len(sizes))
            near = left & (common >= least * np.maximum(sizes, sizes[k]))
            left[k] = False
            if near.sum() >= _MEMBERS:
                left &= ~near
                found.append((int(near.sum()), k))
    return [k for _, k in sorted(found, key=lambda x: (-x[0], x[1]))[:_CLUSTERS]]


def nearest(sketches: list[np.ndarray], middles: list[np.ndarray], least: float) -> np.ndarray:
    """For each sketch the cluster, from 1, whose middle has most in common with it, if that is a part `least`; 0 for others."""
    if not middles:
        return np.zeros(len(sketches), np.uint16)
    sizes, held = (np.array([len(x) for x in y], np.int64) for y in (sketches, middles))
    token, number = np.concatenate(middles), np.repeat(np.arange(len(held)), held)
    order = np.argsort(token, kind="stable")
    token, number = token[order], number[order]
    h, of = np.concatenate(sketches), np.repeat(np.arange(len(sizes)), sizes)
    low = np.searchsorted(token, h)
    n = np.searchsorted(token, h, "right") - low
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    common = np.bincount(np.repeat(of, n) * len(held) + number[at], minlength=len(sizes) * len(held)).reshape(len(sizes), len(held))
    part = common / np.maximum(sizes[:, None], held)
    best = part.argmax(axis=1)
    return np.where(part[np.arange(len(sizes)), best] >= least, best + 1, 0).astype(np.uint16)


def meetings(token: np.ndarray, share: np.ndarray, weight: np.ndarray, node: np.ndarray, threshold: float, most: int = _TURN, cluster: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of nodes that meet at tokens, with the sum of their weights there; about `most` meetings at a time, and sums of these. Pairs of one cluster (not 0) are left out."""
    cluster = np.zeros(len(token), np.uint16) if cluster is None else cluster
    order = np.lexsort((cluster, token))
    token, share, weight, node, cluster = token[order], share[order], weight[order], node[order], cluster[order]
    if not len(token):
        return
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    end = np.append(start[1:], len(token))
    mixed = np.repeat((cluster[start] == 0) | (cluster[start] != cluster[end - 1]), end - start)
    token, share, weight, node, cluster = token[mixed], share[mixed], weight[mixed], node[mixed], cluster[mixed]
    again = token[1:] == token[:-1]
    shared = np.append(False, again) | np.append(again, False)
    if not shared.any():
        return
    token, share, weight, (nodes, at) = token[shared], share[shared].astype(np.int64), weight[shared].astype(np.int64), np.unique(node[shared], return_inverse=True)
    its = np.zeros(len(nodes), np.uint16)
    its[at] = cluster[shared]
    order = np.lexsort((at, share, token))
    token, share, weight, at = token[order], share[order], weight[order], at[order]
    new = np.append(True, token[1:] != token[:-1])
    once = new | np.append(True, (at[1:] != at[:-1]) | (share[1:] != share[:-1]))  # rows that are copies bring their text more than once
    weight = np.add.reduceat(weight, np.flatnonzero(once))
    new, share, at = new[once], share[once], at[once]
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)[group]
    # with u before it, the other may have v: 1 / (1 - v) <= 1 + 1 / lowest - 1 / (1 - u)
    rest = np.maximum(1 - np.arange(256) / 255, 1e-9)
    limit = np.floor((1 - 1 / np.maximum(1 + 1 / (_SLACK * threshold) - 1 / rest, 1) + 1e-9) * 255).astype(np.int64)
    partners = np.minimum(np.searchsorted(group * 256 + share, group * 256 + limit[share], "right"), np.arange(len(at))) - start
    until = np.cumsum(partners)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + most, "right")))
        k = partners[i:j]
        x = np.repeat(np.arange(i, j), k)
        y = start[x] + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        apart = (its[at[x]] == 0) | (its[at[x]] != its[at[y]])
        x, y = x[apart], y[apart]
        pair, both = np.minimum(at[x], at[y]) * len(nodes) + np.maximum(at[x], at[y]), weight[x] + weight[y]
        order = np.argsort(pair)
        pair, both = pair[order], both[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        if len(first):
            pair, both = pair[first], np.add.reduceat(both, first)
            real = pair // len(nodes) != pair % len(nodes)  # two shingles of a text may have one token
            yield nodes[pair[real] // len(nodes)], nodes[pair[real] % len(nodes)], both[real]
        i = j


def _key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Shingles as bytes: hashes, then counts."""
    return hashes.tobytes() + counts.astype(np.float64).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 16
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.float64, n, 8 * n)


def planes(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, byte by byte and compressed."""
    return pa.compress(b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns), codec="zstd", asbytes=True)


def unplaned(blob: bytes, n: int, kinds: list[type], least: int = 0, below: int = 256) -> list[np.ndarray]:
    """The columns of n values that `planes` was given; of these the rows whose first value ends in a byte from `least` to before `below`."""
    widths = [np.dtype(kind).itemsize for kind in kinds]
    raw = np.frombuffer(pa.decompress(blob, n * sum(widths), codec="zstd", asbytes=True), np.uint8).reshape(-1, n)
    if below - least < 256:
        raw = np.take(raw, np.flatnonzero((raw[0] >= least) & (raw[0] < below)), axis=1)
    return [np.ascontiguousarray(raw[i - w : i].T).view(kind).reshape(-1) for kind, w, i in zip(kinds, widths, np.cumsum(widths))]


def turns(blobs: list[tuple[bytes, int]], kinds: list[type]) -> Iterator[list[np.ndarray]]:
    """The columns of all blobs (of `planes`, with their lengths), in turns of about `_TURN` rows; rows of one first value come in one turn. Blobs stay compressed, and are read again for each turn."""
    n = min(256, 1 + sum(n for _, n in blobs) // _TURN)
    for i in range(n):
        yield [np.concatenate(x) for x in zip(*(unplaned(*blob, kinds, 256 * i // n, 256 * (i + 1) // n) for blob in blobs))]


def _picked(source: DataFrame, wanted: DataFrame, few: bool, *more: str) -> DataFrame:
    """node, text and more columns of the wanted nodes (node, key, tid). Of the copies of a text only those with its least id are looked at; repeated rows give their node more than once."""
    wanted = wanted.select("node", F.col("key").alias("_key"), "tid", *more)
    wanted = F.broadcast(wanted) if few else wanted
    return source.withColumn("key", _key(F.col("text"))).join(wanted, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("tid"))).select("node", "text", *more)


def _common(texts: DataFrame, p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the shingles that occur in two texts of the sample or more, the most frequent `common` of them at most; and their places, the rarest first."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            h = [shingles(t, p.words)[0] for t in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    counts = materialize(map_batches(texts, run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-common")
    least, held = 2, 0
    for r in sorted(counts.groupBy("n").count().collect(), reverse=True):
        held += r["count"]
        if held > p.common:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    discard(counts)
    h, n = found.column("h").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def _middles(texts: DataFrame, p: NearDedup) -> list[np.ndarray]:
    """Sketches of the middles of the large clusters among some texts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            f = [shingles(t, p.words)[0][:_SKETCH].tobytes() for t in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(f, pa.binary())], names=["node", "f"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: f for batch in batches for n, f in zip(batch.column("node").to_pylist(), batch.column("f").to_pylist())}
        blobs = [held[n] for n in sorted(held)]
        found = [blobs[k] for k in centres([np.frombuffer(f, np.uint64) for f in blobs], p.threshold)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["f"])

    found = map_batches(texts, run, "node bigint, f binary").repartition(1).mapInArrow(search, "f binary").toArrow()
    return [np.frombuffer(f, np.uint64) for f in found.column("f").to_pylist()]


def _candidates(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], middles: list[np.ndarray], parts: int, p: NearDedup) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that can be links and aren't of one cluster, and members of clusters: a, and less than 0, as b, the cluster. In the shared folder. The first shingles of the
    texts travel by `parts` of the shingles, known there by 32 bits of their hashes."""
    known = texts.sparkSession.sparkContext.broadcast((common, middles))
    kinds = [np.uint32, np.int64, np.uint16, np.uint8, np.uint16]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        common, middles = known.value
        for piece in slices(batch, "text", 4 << 20):
            found = [shingles(t, p.words) for t in texts_of(piece, "text")]
            full = [k for k, f in enumerate(found) if len(f[0])]
            if not full:
                continue
            found, nodes = [found[k] for k in full], piece.column("node").to_numpy()[full]
            its = nearest([h[:_SKETCH] for h, _ in found], middles, p.threshold)
            of, h, share, weight = prefixes(found, *common, p.threshold)
            node, cluster = nodes[of], its[of]
            part = (h % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, *columns = (x[order] for x in (part, (h >> np.uint64(32)).astype(np.uint32), node, weight, share, cluster))
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            blobs = [planes([x[i:j] for x in columns]) for i, j in zip(cuts[:-1], cuts[1:])]
            to, n = part[cuts[:-1]], np.diff(cuts).astype(np.int32)
            if its.any():  # members have parts of their own, below 0
                to, n = np.append(to, np.int32(-1 - nodes[0] % 16)), np.append(n, np.int32((its > 0).sum()))
                blobs.append(planes([nodes[its > 0], its[its > 0]]))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(n), pa.array(blobs, pa.binary())], names=["part", "n", "blob"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for part, n, blob in zip(*(batch.column(x).to_pylist() for x in ("part", "n", "blob"))):
                if part < 0:
                    node, its = unplaned(blob, n, [np.int64, np.uint16])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, -its.astype(np.int64), np.zeros(n, np.int64))], names=["a", "b", "w"])
                else:
                    found.append((blob, n))
        for token, node, weight, share, cluster in turns(found, kinds) if found else ():
            for columns in meetings(token, share, weight, node, p.threshold, cluster=cluster):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "w"])

    met = map_batches(texts, run, "part int, n int, blob binary").groupBy("part").applyInArrow(match, "a bigint, b bigint, w bigint")
    enough = (F.col("b") < 0) | (F.col("w") >= int((1 - _SLACK) * p.threshold * 65535))
    return materialize(met.groupBy("a", "b").agg(F.sum("w").alias("w")).where(enough).select("a", "b"), "near-candidates")


def _ends(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.explode(F.array("a", "b")).alias("node")).distinct()


def _routed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) and the group g in which each is verified, in the shared folder."""
    groups = 1 + (_ends(pairs).join(sizes, "node").agg(F.sum("size")).first()[0] or 0) // (_BLOCK // 2)
    # the lesser node's least candidate, or itself, names the group; nearly all pairs of a cluster get one name
    least = pairs.groupBy("b").agg(F.min("a").alias("home")).select(F.col("b").alias("a"), "home")
    homes = materialize(pairs.join(least, "a", "left").select("a", "b", F.coalesce("home", "a").alias("home")), "near-homes")
    held = _ends(homes, "home").join(sizes, "node").groupBy("home").agg(F.sum("size").alias("bytes"))
    count = homes.groupBy("home").agg(F.count(F.lit(1)).alias("pairs"))
    blocks = held.join(count, "home").select("home", F.greatest(F.ceil(F.col("bytes") / _BLOCK), F.ceil(F.sqrt(F.col("pairs") / _PAIRS))).alias("n"))
    block = lambda x: F.pmod(F.xxhash64(x), F.col("n"))
    routed = materialize(homes.join(blocks, "home").select("a", "b", F.pmod(F.xxhash64("home", block("a"), block("b")), F.lit(groups)).alias("g")), "near-routed")
    discard(homes)
    return routed


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """For members (node, cluster): to, less than 0, each pair of blocks of the cluster that has the node, twice over, and 1 added where it is in the second block."""
    held = members.join(sizes, "node")
    cut = F.greatest(F.ceil(F.sum("size") / _BLOCK), F.ceil(F.count(F.lit(1)) / _TEXTS), F.lit(1))
    blocks = held.groupBy("cluster").agg(cut.alias("n"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    own = members.join(F.broadcast(blocks), "cluster").withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")))
    other = own.select("cluster", "node", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j"))
    to = -(1 + F.col("cluster") * (1 << 44) + F.least("i", "j") * (1 << 22) + F.greatest("i", "j"))
    return other.select("node", (2 * to + F.when(F.col("i") > F.col("j"), 1).otherwise(0)).alias("to"))


def _linked(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """node, head (the least node that the links lead to) and n (its links) of every node in links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    head = np.arange(len(nodes))
    while True:
        low, new = np.minimum(head[a], head[b]), head.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == head).all():
            return pa.table({"node": nodes, "head": nodes[head], "n": np.bincount(at, minlength=len(nodes)).astype(np.int64)})
        head = new


def _verified(routed: DataFrame, sent: DataFrame, listed: bool, p: NearDedup) -> DataFrame:
    """Those of the pairs, routed and of members of clusters, that meet the threshold, with their probability Jaccard jp; or, unless listed, what `_linked` says of those of each task. In the shared
    folder. sent: to, side, node and shingles f."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, sides = {}, ([], [])
        for n, side, f in zip(*(right.column(x).to_pylist() for x in ("node", "side", "f"))):
            if n not in known:  # rows that are copies bring their text more than once
                known[n] = unpacked(f)
                sides[side].append(n)
        pairs = zip(left.column("a").to_pylist(), left.column("b").to_pylist())
        to = right.column("to")[0].as_py() if right.num_rows else 0
        if to < 0:
            i, j = (-1 - to) >> 22 & 0x3FFFFF, (-1 - to) & 0x3FFFFF
            pairs = combinations(sorted(sides[0]), 2) if i == j else ((min(x, y), max(x, y)) for x in sides[0] for y in sides[1])
        ends, likeness = array("q"), array("d")
        for x, y in pairs:
            if (jp := prob_jaccard(known[x], known[y])) >= p.threshold:
                ends.extend((x, y))
                likeness.append(jp)
        a, b = np.array(ends[::2], np.int64), np.array(ends[1::2], np.int64)
        return pa.table({"a": a, "b": b, "jp": np.array(likeness, np.float64)}) if listed else _linked(a, b)

    schema = "a bigint, b bigint, jp double" if listed else "node bigint, head bigint, n bigint"
    return materialize(routed.groupBy("g").cogroup(sent.groupBy("to")).applyInArrow(run, schema), "near-pairs")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node in links (a, b)."""
    # each node hangs on its least neighbour; a link holds together what its ends hang on, which for most links of a cluster is one node
    ends = links.select("a", "b").union(links.select("b", "a"))
    least = materialize(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("head")), "near-heads")
    head = lambda x: least.select(F.col("node").alias(x), F.col("head").alias(f"h{x}"))
    few = links.join(head("a"), "a").join(head("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")).where("a <> b")
    few = few.union(least.where("node <> head").select("node", "head")).distinct()
    both = materialize(few.union(few.select("b", "a")).distinct(), "near-links")
    now = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        labels = now.select("node", "label")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")).select(F.col("a").alias("node"), "m")
        own = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = materialize(own.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "near-labels")
        discard(now)
        now = new
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")


def _sent(texts: DataFrame, p: NearDedup) -> DataFrame:
    """to, side, node and packed shingles f: the texts (node, text, to), each sent wherever it is needed."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            rows, held = [], 0
            for n, t, places in zip(part.column("node").to_pylist(), texts_of(part, "text"), part.column("to").to_pylist()):
                f = packed(*shingles(t, p.words))
                for to in places:
                    rows.append((to >> 1, to & 1, n, f))
                    held += len(f)
                    if held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int8(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=["to", "side", "node", "f"])

    return map_batches(texts, run, "to bigint, side tinyint, node bigint, f binary")


def _links(source: DataFrame, distinct: DataFrame, p: NearDedup, listed: bool) -> DataFrame:
    """All links (a, b, jp) of nodes, a < b: the pairs of different texts that meet the threshold. Unless listed: node, head and n, in several rows a node; n adds up to its links, and heads lead to all of its class."""
    few = small_enough(distinct, p.broadcast_rows)
    texts = _picked(source, distinct, few)
    if not few:
        texts = materialize(texts, "near-texts")
    some = lambda one: _picked(source, distinct.where(F.col("node") % one == 0), True) if few else texts.where(F.col("node") % one == 0)
    common = _common(some(p.sample), p)
    middles = _middles(some(1 + distinct.count() // _SAMPLED), p)
    parts = 1 + (distinct.agg(F.sum("size")).first()[0] or 0) // (12 * _PART)
    found = _candidates(texts, common, middles, int(parts), p)
    sizes = distinct.select("node", (F.col("size") * _BYTES).alias("size"))
    routed = _routed(found.where("b >= 0"), sizes)
    inside = _blocks(found.where("b < 0").select(F.col("a").alias("node"), (-F.col("b")).alias("cluster")), sizes)
    places = _ends(routed, "g").select("node", (2 * F.col("g")).alias("to")).unionByName(inside)
    places = materialize(places.groupBy("node").agg(F.collect_list("to").alias("to")), "near-places")
    if few and (places.agg(F.sum(F.size("to"))).first()[0] or 0) <= 4 * p.broadcast_rows:
        needed = _picked(source, distinct.join(places, "node"), True, "to")
    else:
        needed = texts.join(places, "node")
    verified = _verified(routed, _sent(needed, p), listed, p)
    for table in (found, routed, places) if few else (found, routed, places, texts):
        discard(table)
    return verified


def _nodes(source: DataFrame, p: NearDedup) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row; and every different text: node, key, tid (its least id), n_copies and size (characters)."""
    signed = materialize(source.select("id", _key(F.col("text")).alias("key"), F.length("text").alias("size")), "near-signed")
    texts = signed.groupBy("key").agg(F.min("id").alias("tid"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"))
    # node numbers are given as the table is written, and stay
    return signed.select("id", "key"), materialize(texts.withColumn("node", F.monotonically_increasing_id()), "near-distinct")


def _classes(source: DataFrame, p: NearDedup) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row; and of every different text: key, tid, class_id, least (the key of the text that stands for its class), n_links and n_copies."""
    rows, distinct = _nodes(source, p)
    linked = _links(source, distinct, p, False)
    degree = linked.groupBy("node").agg(F.sum("n").alias("n_links"))
    heads = linked.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    texts = materialize(distinct.drop("size").join(components(heads), "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labelled")
    # a class is known by its least id; of texts with that id the least digest stands for it, and of classes without ids the least digest alone
    first = F.min(F.struct(F.col("tid").isNull().alias("no"), "tid", "key")).alias("first")
    of_class = texts.groupBy("label").agg(first).select("label", F.col("first.tid").alias("class_id"), F.col("first.key").alias("least"))
    found = texts.join(of_class, "label").select("key", "tid", "class_id", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows, materialize(found, "near-classes")


def links(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness): all links, each text named by the least id that has it."""
    source = two_columns(docs, id_col, text_col)
    _, distinct = _nodes(source, p)
    found = _links(source, distinct, p, True)
    name = lambda x: distinct.select(F.col("node").alias(x), F.col("tid").alias(f"_{x}"))
    return found.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("jp").alias("likeness"))


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows, classes = _classes(two_columns(docs, id_col, text_col), p)
    classes = classes.select("key", "class_id", "n_links", "n_copies")
    # a text with more than a thousandth of all copies is joined by a broadcast of at most a thousand rows, so no task gets all of its rows
    often = classes.where(F.col("n_copies") > max(1, rows.count() // 1000))
    hot = rows.join(F.broadcast(often), "key")
    rest = rows.join(F.broadcast(often.select("key")), "key", "left_anti").join(classes, "key")
    return hot.unionByName(rest).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each class: the one with the least id; of rows that share that id, one whose text stands for the class. Rows without an id stay only where
    no other row of their class has one; ids may repeat, texts of different classes all stay."""
    source = two_columns(docs, id_col, text_col)
    rows, classes = _classes(source, p)
    stay = classes.where("key = least").select(F.col("key").alias("__near_stay"), F.col("tid").alias("__near_tid"))
    gone = rows.join(stay, (F.col("key") == F.col("__near_stay")) & F.col("id").eqNullSafe(F.col("__near_tid")), "left_anti").distinct()
    gone = materialize(gone.select(F.col("id").alias("__near_id"), F.col("key").alias("__near_gone")), "near-gone")
    keyed = docs.withColumn("__near_key", _key(F.col(f"`{text_col}`")))
    out = F.broadcast(gone) if small_enough(gone, p.broadcast_rows) else gone
    kept = keyed.join(out, (F.col("__near_key") == F.col("__near_gone")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__near_id")), "left_anti")
    twice = materialize(rows.groupBy("id", "key").count().where("count > 1").select(F.col("id").alias("__near_id"), F.col("key").alias("__near_again")), "near-twice")
    if twice.isEmpty():
        return kept.drop("__near_key")
    again = F.broadcast(twice) if small_enough(twice, p.broadcast_rows) else twice
    same = (F.col("__near_key") == F.col("__near_again")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__near_id"))
    once = kept.join(again, same, "left_anti")
    return once.union(kept.join(again, same, "left_semi").dropDuplicates([id_col, "__near_key"])).drop("__near_key")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}

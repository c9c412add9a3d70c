import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import GroupedData

from columnaut.llm import near_dedup as N

SF = "/root/testdata/sf0.001"


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 60).astype(np.uint64)
    h.sort()
    a, b = (h[:45], rng.integers(1, 6, 45).astype(float)), (h[15:], rng.integers(1, 6, 45).astype(float))
    sig = N.prob_minhash([a[0], b[0]], [a[1], b[1]], 20_000)
    assert abs((sig[0] == sig[1]).mean() - N.prob_jaccard(a, b)) < 0.015
    assert N.prob_jaccard(a, a) == pytest.approx(1) and N.prob_jaccard(a, (h[:0], np.zeros(0))) == 0


def test_prob_jaccard_equals_definition():
    rng = random.Random(2)
    for _ in range(50):
        x = {i: rng.randint(1, 4) for i in rng.sample(range(12), 7)}
        y = {i: rng.randint(1, 4) for i in rng.sample(range(12), 7)}
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float))
        assert N.prob_jaccard(pack(x), pack(y)) == pytest.approx(want)


def brute_classes(rows, p):
    """Classes by all pairs that share a shingle."""
    feats = {i: N.shingles(t or "", p.words) for i, t in rows}
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(i, j):
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)

    by_text, by_shingle = {}, collections.defaultdict(set)
    for i, t in rows:
        join(i, by_text.setdefault(t or "", i))
        for g in feats[i][0].tolist():
            by_shingle[g].add(i)
    pairs = {(i, j) for s in by_shingle.values() for i in s for j in s if i < j}
    for i, j in pairs:
        if N.prob_jaccard(feats[i], feats[j]) >= p.threshold:
            join(i, j)
    return {i: top(i) for i, _ in rows}


def grown(seed=3):
    """The smallest table with a group of many near copies of one text, some of them far apart."""
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    rng = random.Random(seed)
    for k in range(40):
        words = rows[1][1].split(" ")
        for _ in range(1 + k % 8):
            words[rng.randrange(len(words))] = rng.choice(words)
        rows.append((10_000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_classes_equal_brute_force(spark, broadcast_rows):
    rows = grown()
    rows += [(20_001, None), (20_002, ""), (20_003, "One"), (20_004, "one!"), (20_005, "?!"), (20_006, "x y " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as key", "'y' as tid", "1 as node")
    p = N.NearDedup(broadcast_rows=broadcast_rows)
    got = {r.doc_id: r for r in N.near_duplicates(docs, p).collect()}
    want = brute_classes(rows, p)
    assert {i: r.class_id for i, r in got.items()} == want
    assert got[20_001].n_copies == 2 and got[20_006].n_links == 0
    kept = sorted(r.doc_id for r in N.keep_one(docs, p).select("doc_id", "tid").collect())
    assert kept == sorted(set(want.values()))


def test_links_are_true_and_meet_every_representative(spark):
    rows = grown(5)[:240]
    p = N.NearDedup()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.a, r.b): r.likeness for r in N.links(docs, p).collect()}
    texts = {i: t or "" for i, t in rows}
    feats = {i: N.shingles(t, p.words) for i, t in texts.items()}
    for (i, j), likeness in found.items():
        assert i != j and texts[i] != texts[j] and likeness == pytest.approx(N.prob_jaccard(feats[i], feats[j])) and likeness >= p.threshold
    counted = collections.Counter(x for pair in found for x in pair)
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t, i)
    assert {r.doc_id: r.n_links for r in N.near_duplicates(docs, p).collect()} == {i: counted[first[t]] for i, t in texts.items()}


def test_counts_of_shingles_have_no_bound(spark):
    """Shingles that occur 70,000 times in one text and once or twice in the other don't make them alike; nor are they lost where they do."""
    long, short = "a b c " * 70_000 + "x y z " * 3, "a b c " * 3 + "x y z " * 70_000
    f, g = N.shingles(long, 3), N.shingles(short, 3)
    assert f[1].max() == g[1].max() == 70_000
    assert N.prob_jaccard(*(N.unpacked(N.packed(*x)) for x in (f, g))) == pytest.approx(N.prob_jaccard(f, g)) and N.prob_jaccard(f, g) < 0.01
    docs = spark.createDataFrame([(1, long), (2, short), (3, long + "tail")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "alone"), (2, "f g h i j"), (None, "k l m n o"), (None, "k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _id", "'x' as key", "2 as class_id")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_copies) for r in N.near_duplicates(docs).collect())
    assert got == [(-1, -1, 1), (-1, -1, 2), (-1, -1, 2), (-1, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1)]
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "alone"), (-1, "k l m n o"), (1, "a b c d e"), (2, "f g h i j")]
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_rows_are_known_by_their_texts(spark, broadcast_rows):
    """(2, B) stays though another row with its id is a copy."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([("1", a), ("2", a), ("2", b)], "doc_id string, text string")
    p = N.NearDedup(broadcast_rows=broadcast_rows)
    assert sorted(map(tuple, N.keep_one(docs, p).collect())) == [("1", a), ("2", b)]
    assert sorted(map(tuple, N.near_duplicates(docs, p).collect())) == [("1", "1", 0, 2), ("2", "1", 0, 2), ("2", "2", 0, 1)]


def brute_links(rows, p):
    """All pairs of different texts that meet the threshold, by their least ids."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t or "", i)
    feats = {i: N.shingles(t, p.words) for t, i in first.items()}
    found = {(i, j): N.prob_jaccard(feats[i], feats[j]) for i in feats for j in feats if i < j}
    return {pair: jp for pair, jp in found.items() if jp >= p.threshold}


@pytest.mark.parametrize("broadcast_rows, block", [(1_000_000, 16 << 20), (0, 20_000)])
def test_no_link_is_left_out(spark, monkeypatch, broadcast_rows, block):
    """Pairs just above the threshold, of texts of one length or of two, with shingles that repeat, and those between members of one class."""
    monkeypatch.setattr(N, "_BLOCK", block, raising=False)
    monkeypatch.setattr(N, "_PART", 200, raising=False)
    rng = random.Random(8)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(300 if base % 2 else 30)}" for _ in range(rng.randrange(20, 120))]
        for k in range(5):
            other = list(words)
            for _ in range(round(len(words) * rng.uniform(0.08, 0.16)) if k else 0):
                other[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
            if k == 3:
                other += other[: len(other) // 3] * 3
            elif k == 4:
                other = other[: len(other) * 2 // 3]
            rows.append((5 * base + k, " ".join(other)))
    rows += [(1000 + i, t) for i, t in rows[::7]]
    p = N.NearDedup(broadcast_rows=broadcast_rows)
    want = brute_links(rows, p)
    assert sum(jp < 0.5 for jp in want.values()) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(min(r.a, r.b), max(r.a, r.b)): r.likeness for r in N.links(docs, p).collect()}
    assert got == pytest.approx(want)
    count = collections.Counter(x for pair in want for x in pair)
    assert {r.doc_id: r.n_links for r in N.near_duplicates(docs, p).collect() if r.doc_id < 1000} == {i: count[i] for i, _ in rows if i < 1000}


def test_meetings_keep_every_pair_that_meets_the_threshold():
    """Whatever the order of shingles, in chunks of one meeting or many, and with tokens that clash and texts that come twice."""
    rng = np.random.default_rng(9)
    for threshold, most in ((0.1, 1), (0.45, 1), (0.45, 10**6), (0.9, 7), (1.0, 1)):
        sets = []
        for k in range(60):
            h = np.sort(rng.choice(40, rng.integers(1, 30), replace=False)).astype(np.uint64)
            sets.append((h, rng.integers(1, 5, len(h)).astype(float)) if k % 3 else sets[-1] if k else (h, np.ones(len(h))))
        common = np.sort(rng.choice(40, 12, replace=False)).astype(np.uint64)
        of, h, share, weight = N.prefixes(sets, common, rng.permutation(12) + 1, threshold)
        columns = [np.tile(x, 2) for x in ((h % np.uint64(37)).astype(np.uint32), share, weight, of * 3 + 2**40)]
        got = collections.Counter()
        for found in N.meetings(*columns, threshold, most):
            for a, b, w in zip(*(x.tolist() for x in found)):
                got[(a - 2**40) // 3, (b - 2**40) // 3] += w
        assert all(a < b for a, b in got)
        got = {pair for pair, w in got.items() if w >= int((1 - N._SLACK) * threshold * 65535)}
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if N.prob_jaccard(sets[i], sets[j]) >= threshold - 1e-12}
        assert want <= got and len(want) >= 10


def test_shingles_of_a_part_are_matched_in_bounded_memory(spark, monkeypatch):
    """A part of millions of shingles takes a few times the memory of what is matched at a time, and gives what it gives when matched at once."""
    caught = []

    def catching(self, fn, schema, run=GroupedData.applyInArrow):
        caught.append(fn)
        return run(self, fn, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", catching)
    texts = spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "node long, text string")
    N._candidates(texts, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 1, N.NearDedup())
    rng = np.random.default_rng(10)
    blobs, held = [], []
    for k in range(40):
        n = 60_000
        token, node = rng.integers(0, 2**22, n).astype(np.uint32), np.sort(rng.integers(50 * k, 50 * k + 50, n))
        columns = [token, node, rng.integers(1, 9, n).astype(np.uint16), rng.integers(0, 160, n).astype(np.uint8), (node % 50 == 0).astype(np.uint16)]
        blobs.append((0, n, N.planes(columns)))
        held.append(columns)
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*blobs), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "n", "blob"])
    got, most = [], 0

    def summed(found):
        every = np.concatenate([a * 2000 + b for a, b, _ in found])
        pairs, at = np.unique(every, return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([w for _, _, w in found]))

    tracemalloc.start()
    for found in caught[0](iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1] - sum(x.nbytes for y in got for x in y))
        got.append([x.to_numpy() for x in found.columns])
    tracemalloc.stop()
    token, node, weight, share, cluster = map(np.concatenate, zip(*held))
    want = summed(list(N.meetings(token, share, weight, node, 0.45, 10**9, cluster)))
    assert all(np.array_equal(x, y) for x, y in zip(summed(got), want)) and len(want[0]) > 100_000
    assert most < 100e6, most


def of_one_cluster(n, most):
    """Texts of which nearly all are near copies of one, and some that are none or only of a few."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, most)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        rows.append((k, " ".join(words)))
    return rows + [(n + k, " ".join(f"u{rng.randrange(400)}" for _ in range(60))) for k in range(30)] + [(2 * n + k, t) for k, (_, t) in enumerate(rows[:9])]


def test_intermediate_tables_grow_with_the_texts_not_with_the_links(spark, monkeypatch):
    """400 near copies of one text have tens of thousands of links, which are counted without being written."""
    written = {}

    def counting(df, name, materialize=N.materialize):
        out = materialize(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(N, "materialize", counting)
    rows = of_one_cluster(400, 14)
    p = N.NearDedup()
    want = collections.Counter(x for pair in brute_links(rows, p) for x in pair)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in N.near_duplicates(docs, p).collect()}
    assert sum(want.values()) // 2 > 30_000
    assert {i: r.n_links for i, r in got.items() if i < 800} == {i: want[i] for i, _ in rows if i < 800}
    assert {i: r.class_id for i, r in got.items()} == brute_classes(rows, p)
    assert max(written.values()) < 10 * len(rows), written


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_clusters_in_blocks_lose_no_link(spark, monkeypatch, broadcast_rows):
    """Several blocks of a cluster, clusters that are found in part only, and links between clusters."""
    monkeypatch.setattr(N, "_TEXTS", 30, raising=False)
    monkeypatch.setattr(N, "_SAMPLED", 60, raising=False)
    rows = of_one_cluster(150, 24)
    p = N.NearDedup(broadcast_rows=broadcast_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows, p)
    assert {(min(r.a, r.b), max(r.a, r.b)): r.likeness for r in N.links(docs, p).collect()} == pytest.approx(want)
    count = collections.Counter(x for pair in want for x in pair)
    assert {r.doc_id: r.n_links for r in N.near_duplicates(docs, p).collect() if r.doc_id < 300} == {i: count[i] for i, _ in rows if i < 300}

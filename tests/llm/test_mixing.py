import collections
import math
import random

import numpy as np
import pytest

from columnaut.llm import mixing as M


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "é", "z", None])
        out.append((i * 7, " ".join(f"w{i}_{k}" for k in range(int(rng.expovariate(1 / 120)))), source, 0))
    return out


SCHEMA = "doc_id long, text string, source string, n_chars long"


def water(sizes, weights, repeats):
    """Targets by repeated resharing, from the definition."""
    t, capped = {}, set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = sum(sizes) - sum(repeats * sizes[i] for i in capped)
        t = {i: repeats * sizes[i] if i in capped else left * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))}
        more = {i for i in free if t[i] > repeats * sizes[i]}
        if not more:
            return t
        capped |= more


def test_targets():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        sizes, weights = [rng.choice([0, 1, 10, 500, 9000]) for _ in range(n)], [(5, 2, 1)[i % 3] for i in range(n)]
        want = water(sizes, weights, 3)
        assert M.targets(sizes, weights, 3) == pytest.approx([want[i] for i in range(n)])


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        key = np.full(n, M._key(1, 2, 3), np.uint64)
        at = M.permuted(np.arange(n), n, key)
        assert sorted(at) == list(range(n))
        assert all(M._inverse(int(p), n, key[:1]) == i for i, p in enumerate(at))


def test_shards_add_up():
    slots = np.array([1000, 0, 37, 512])
    seen = np.zeros(4, np.int64)
    for k in range(11):
        before, n = M.shard_counts(slots, k, 11, 5)
        assert (before == seen).all()
        seen += n
    assert (seen == slots).all()


def test_draws_are_exact_at_any_size():
    rng = np.random.default_rng(6)
    for good, bad, take in ((50, 80, 40), (900, 100, 700), (7, 3, 5), (1, 1, 1), (0, 9, 4), (30_000, 50_000, 20_000)):
        got = np.array([M.hypergeometric(good, bad, take, rng) for _ in range(8000)])
        want = rng.hypergeometric(good, bad, take, 8000)
        assert got.min() >= max(0, take - bad) and got.max() <= min(good, take)
        p = good / (good + bad)
        sd = max(1e-9, np.sqrt(take * p * (1 - p) * (good + bad - take) / (good + bad - 1)))
        assert abs(got.mean() - take * p) < 5 * sd / 80 + 1e-9 and abs(got.std() / sd - 1) < 0.05 or sd < 1e-6
        edges = np.quantile(want, np.linspace(0.1, 0.9, 9))
        assert np.abs(np.searchsorted(np.sort(got), edges, side="right") - np.searchsorted(np.sort(want), edges, side="right")).max() < 300
    # beyond numpy's range: a few things among very many are drawn as by single coin tosses
    got = np.array([M.hypergeometric(3 * 10**12, 7 * 10**12, 10, rng) for _ in range(20_000)])
    want = np.array([math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(11)])
    assert np.abs(np.bincount(got, minlength=11) / 20_000 - want).max() < 0.015
    big = np.array([M.hypergeometric(4 * 10**11, 6 * 10**11, 5 * 10**11, rng) for _ in range(2000)])
    sd = np.sqrt(5e11 * 0.24 * 0.5)
    assert abs(big.mean() - 2e11) < 5 * sd / 45 and abs(big.std() / sd - 1) < 0.1


def test_shards_add_up_beyond_the_range_of_numpy():
    slots = np.array([2_000_000_000, 0, 37, 1_500_000_000, 5])
    before = np.zeros(5, np.int64)
    for k in range(6):
        first, n = M.shard_counts(slots, k, 6, 5)
        assert (first == before).all() and (n >= 0).all()
        before += n
    assert (before == slots).all()


@pytest.mark.parametrize("block", [16, 256])
def test_mix(spark, block):
    data = rows() + [(1_000_001, None, "a", 0), (1_000_002, "", "q", 0), (None, "no id", "b", 0), (1_000_003, "twice same row", "c", 0), (1_000_003, "twice same row", "c", 0), (1_000_004, "long " * 30_000, "z", 0)]
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as s", "2 as block")
    got = M.Mix(docs, block=block, shard_slots=8).digest().collect()
    assert len(got) == len(data)
    size = collections.Counter()
    for _, t, s, _ in data:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = water([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    by_id = {d: s for d, _, s, _ in data}
    taken = collections.Counter()
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[names.index(s)])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for i, s in enumerate(names):
        assert abs(taken[s] - want[i]) <= 1
    again = M.Mix(docs.repartition(5), block=block, shard_slots=8).digest()
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    mixed = M.mix_documents(docs, block=block, shard_slots=8).collect()
    words = collections.Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.block == 2
    per = collections.Counter()
    for r in got:
        per[r.doc_id] += r.taken
    assert {k: v for k, v in per.items() if v} == dict(words)


def test_rows_that_share_an_id_keep_their_texts(spark):
    data = [(None if i % 2 else 5, " ".join(f"v{i}_{k}" for k in range(40)), "a", 0) for i in range(30)]
    data += [(9, "same text twice", "a", 0), (9, "same text twice", "a", 1), (9, "same text twice", "a", 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    mixed = M.mix_documents(docs, length_col=None, block=16, shard_slots=8).collect()
    got, want = collections.Counter(), collections.Counter()
    for r in mixed:
        got.update((r.doc_id, r.n_chars, w) for w in r.text.split())
    for i, t, _, n in data:
        want.update((i, n, w) for w in t.split())
    assert got == want  # one source alone is taken once, whole
    again = M.mix_documents(docs.repartition(3), length_col=None, block=16, shard_slots=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_many_rows_that_are_alike(spark, monkeypatch):
    """A third of the rows have neither id nor different sizes: they are counted, not sorted in one task."""
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    data = [(None, "same words here", "a", 0)] * 300 + [(i, "w " * (i % 9), "ab"[i % 2], 0) for i in range(600)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = M.Mix(docs, block=16, shard_slots=8).digest().collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((i, len(t.split())) for i, t, _, _ in data)
    by = {s: sum(len(t.split()) for _, t, x, _ in data if x == s) for s in "ab"}
    assert {s: v for s, v in by.items()} == {s: {r.source_size for r in got if (r.doc_id or 0) % 2 == k}.pop() for s, k in (("a", 0), ("b", 1))}
    assert sum(r.taken for r in got) == pytest.approx(sum(by.values()), abs=2)
    again = M.Mix(docs.repartition(5), block=16, shard_slots=8).digest()
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert M.Mix(docs).digest().count() == 0 and M.mix_documents(docs).count() == 0

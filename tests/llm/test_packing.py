import collections
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from columnaut.llm import packing as P


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(P.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(reference):
    rng = random.Random(3)
    parts = ["a", "Der", " ", " ", "  ", "\n", "\t", "é", ".", "'s", " the", "12", "\x85", " ", "　", "\x1c", "<|endoftext|>", "#", "日本"]
    tokenize = P.Tokenize(P.tokenizer_path())
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(tokenize(text), "<u4").tolist() == reference(text), repr(text)


def optimum(lengths, size):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + lengths[i] <= size:
                k = bins.index(room)
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def bins_hold(lengths, size, where, offset):
    for k in set(where):
        own = sorted(zip(offset[where == k], lengths[where == k]))
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= size


def test_few_pieces_are_packed_optimally():
    rng = random.Random(7)
    better = 0
    for i in range(200):
        size = rng.choice([10, 20, 50])
        most = size if i % 2 else size // 4  # five pieces and more in a bin
        lengths = [rng.randint(1, most) for _ in range(rng.randint(1, 14))]
        if i % 3 == 0:  # bins that can be filled exactly
            cuts = [sorted(rng.sample(range(1, 50), 2)) for _ in range(4)]
            size, lengths = 50, [x for a, b in cuts for x in (a, b - a, 50 - b)]
        lengths = np.array(lengths)
        where, offset = P.place(lengths, size, None)
        bins_hold(lengths, size, where, offset)
        best, counts = optimum(lengths.tolist(), size), np.bincount(lengths, minlength=size + 1)
        assert P.lower_bound(counts, size) <= best == where.max() + 1
        better += best < len(P.best_fit_decreasing(counts, size))
    assert better


def test_fillings_are_complete_and_undominated():
    rng = random.Random(8)
    for _ in range(200):
        pieces, room = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))], rng.randint(1, 30)
        spare = rng.randint(0, room)
        left = P._Left(np.bincount(pieces, minlength=31))
        subsets = {tuple(sorted((x for i, x in enumerate(pieces) if k >> i & 1), reverse=True)) for k in range(2 ** len(pieces))}
        fit = {f for f in subsets if room - spare <= sum(f) <= room}
        got = list(P.fillings(left, room, spare))
        assert len(got) == len(set(got)) and set(got) <= fit
        assert not any(P.dominates(a, b) for a in got for b in got if a != b)
        assert all(any(P.dominates(a, b) for a in got) for b in fit)


def test_bin_completion_beats_best_fit():
    # triples that fill a bin exactly: best fit decreasing misses them
    rng = random.Random(4)
    lengths = []
    for _ in range(60):
        a, b = rng.randint(260, 400), rng.randint(260, 400)
        lengths += [a, b, 1024 - a - b]
    counts = np.bincount(lengths, minlength=1025)
    found = P.complete_bins(counts, 1024)
    assert sorted(x for b in found for x in b) == sorted(lengths) and max(map(sum, found)) <= 1024
    assert P.lower_bound(counts, 1024) <= len(found) < len(P.best_fit_decreasing(counts, 1024))


def test_very_many_small_pieces_take_no_longer():
    """Bins of hundreds of pieces: neither the recursion nor the test of dominance gets out of hand."""
    rng = random.Random(11)
    lengths = [rng.randint(330, 420) for _ in range(300)] + [1] * 1200 + [2] * 400 + [3] * 90
    counts = np.bincount(lengths, minlength=1025)
    found = P.complete_bins(counts, 1024, 6000)
    assert sorted(x for b in found for x in b) == sorted(lengths) and max(map(sum, found)) <= 1024
    assert not P.dominates((1,) * 1000, (1,) * 999 + (2,)) and P.dominates((5, 3), (3, 2, 2, 1))
    left = P._Left(np.bincount([1] * 1023 + [2] * 300, minlength=1025))
    assert [sum(f) for f, _ in zip(P.fillings(left, 1023, 1023), range(50))] == [1023] * 50


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_search_reaches_the_bound_where_best_fit_does_not(sf):
    """Lengths of the pieces of whole tables."""
    tokenize = P.Tokenize(P.tokenizer_path())
    counts = np.zeros(1025, np.int64)
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist():
        n = len(tokenize(text or "")) // 4 + 1
        counts[1024] += (n - 1) // 1024
        counts[n - (n - 1) // 1024 * 1024] += 1
    assert len(P.complete_bins(counts, 1024)) == P.lower_bound(counts, 1024) < len(P.best_fit_decreasing(counts, 1024))


def test_groups_follow_the_pieces_not_the_documents(spark):
    """One document of a million pieces is dealt into many groups."""
    items = spark.range(0, 1_000_000, 1, 8).selectExpr("7L as doc_id", "cast(id as int) as piece", "if(id = 0, 100L, 1024L) as length")
    before = items.schema.names
    got = P.pack(items).groupBy((F.col("sequence_id") / 2**40).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins")).collect()
    assert items.schema.names == before and len(got) == 31
    assert sum(r.n for r in got) == sum(r.bins for r in got) == 1_000_000 and max(r.n for r in got) < 1.1 * P.GROUP_ROWS


def test_pieces_and_sequences(spark, reference):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (5, "word " * 5000)] + [(100 + i, "ab " * (i % 700)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "'z' as _group", "2 as ids")
    got = P.placements(docs, P.tokenizer_path()).collect()
    full = P.pack_documents(docs, P.tokenizer_path()).collect()
    assert sorted(map(str, [(r.doc_id, r.piece, r.sequence_id, r.offset, zlib.crc32(r.ids)) for r in full])) == sorted(map(str, [(r.doc_id, r.piece, r.sequence_id, r.offset, r.ids_crc32) for r in got]))
    want = collections.Counter()
    for d, t in rows:
        ids = reference(t or "") + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(r.length for r in got)
    assert len(bins) <= -(-tokens // 1024) + 1
    several = P.pack(P.pieces(docs, P.tokenizer_path()).drop("ids"), group_rows=60)
    assert several.count() == len(got) and several.select("sequence_id").distinct().count() <= len(bins) + 8
    assert P.placements(docs.limit(0), P.tokenizer_path()).count() == 0

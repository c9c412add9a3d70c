import collections
import os
import random

import corpus_pipeline
from columnaut.llm import common, mixing, near_dedup, packing, quality, secrets

from .test_near_dedup import brute_classes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = [r.asDict() for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r.asDict() for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
        ids = lambda rows: collections.Counter(r["doc_id"] for r in rows)
        if name == "quality_rules":
            assert ids(after) == ids(r for r in before if quality.measure_text(r["text"], quality.QualityRules())[6])
        elif name == "near_duplicates":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in before], near_dedup.NearDedup())
            assert ids(after) == collections.Counter(set(classes.values()))
        elif name == "secret_scans":
            new = {r["doc_id"]: r for r in after}
            assert ids(after) == ids(before)
            for r in before:
                assert new[r["doc_id"]]["text"] == secrets.redact_text(r["text"]) and not secrets.scan_text(new[r["doc_id"]]["text"])
                assert new[r["doc_id"]]["n_chars"] == len(new[r["doc_id"]]["text"])
        elif name == "mixing_sources":
            size, took, of, got = collections.Counter(), collections.Counter(), {}, collections.Counter()
            for r in before:
                size[r["source"]] += len(r["text"].split())
                of[r["doc_id"]] = r
            for r in after:
                assert r["text"] in of[r["doc_id"]]["text"] and r["source"] == of[r["doc_id"]]["source"]
                took[r["source"]] += len(r["text"].split())
                got[r["doc_id"]] += len(r["text"].split())
            names = sorted(size)
            want = mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
            assert all(abs(took[s] - t) <= 1 for s, t in zip(names, want))
            assert all(n <= 3 * len(of[i]["text"].split()) for i, n in got.items())
        else:
            tokenize = packing.Tokenize(packing.tokenizer_path())
            tokens = sum(len(tokenize(r["text"])) // 4 + 1 for r in before)
            assert sum(r["length"] for r in after) == tokens
            assert len({r["sequence_id"] for r in after}) <= -(-tokens // 1024) + 1
        before = after


def odd_rows(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("river stone walks under light house green any town water bridge".split()) + str(rng.randrange(90)) for _ in range(n))
    same = prose(120)
    rows = [(1, prose(100), "a"), (2, None, "a"), (3, "", None), (4, same, "b"), (5, same, "b"), (4, same, "b"), (None, same, "b"), (None, prose(90), None), (6, prose(80) + " password=abcdefghijkl123", "a")]
    rows += [(7, prose(70), "b"), (7, prose(75), "b"), (8, prose(30_000), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars", "1 as piece", "'k' as key", "2 as node", "3 as s", "4 as length", "5 as __x")


def test_every_stage_takes_odd_rows(spark, tmp_path):
    docs = odd_rows(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        if name == "best_fit_packing":
            assert stage(spark, docs, SF).select("doc_id", "piece").count() >= docs.count()
        else:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            assert docs.columns == before.columns
        got = sorted((r.doc_id or -1, len(r.text or "")) for r in docs.collect())
        if name == "quality_rules":
            assert [i for i, _ in got] == [-1, -1, 1, 4, 4, 5, 6, 7, 7, 8]
        elif name in ("near_duplicates", "secret_scans"):
            assert [i for i, _ in got] == [-1, 1, 4, 6, 7, 7, 8]  # the copy without an id goes, the other row without one stays
        elif name == "mixing_sources":
            assert {i for i, _ in got} <= {-1, 1, 4, 6, 7, 8}
        if name == "secret_scans":
            assert "abcdefghijkl123" not in " ".join(r.text for r in docs.collect())


def test_every_stage_takes_an_empty_table(spark):
    empty = odd_rows(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_nothing_is_left_behind(spark):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [x.partition("-")[0] + "-" + x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["pipeline-best_fit_packing"]


def pairs_at_the_threshold(n=150, seed=6):
    """Texts 2 k and 2 k + 1 are just alike enough to be near duplicates."""
    rng, rows = random.Random(seed), []
    while len(rows) < 2 * n:
        a = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        b = [w if rng.random() > 0.13 else f"v{rng.randrange(10**6)}" for w in a]
        texts = [" ".join(x) for x in (a, b)]
        if 0.45 <= near_dedup.prob_jaccard(*(near_dedup.shingles(t, 3) for t in texts)) < 0.48:
            rows += [(len(rows) + k, t, "a", "en", len(t)) for k, t in enumerate(texts)]
    return rows


def test_near_duplicates_at_the_threshold_all_go(spark):
    docs = spark.createDataFrame(pairs_at_the_threshold(), "doc_id long, text string, source string, lang string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept) == list(range(0, 300, 2))

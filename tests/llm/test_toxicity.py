import random
import zlib

import pytest

from columnaut.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i] + [0] * len(b) if False else _next(row, i, c, b)
    return row[-1]


def _next(row, i, c, b):
    new = [i]
    for j, d in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
    return new


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = [("loser", False), ("moron", False), ("scum", False), ("worthless", False), ("disgustingly", False), ("lowei", True)]
    auto = X.LexiconAutomaton(terms)
    words = [t for t, _ in terms] + ["loweischaft", "lowe", "x", ""]
    for _ in range(6000):
        w = list(rng.choice(words) or "a")
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "o", "e", "s", "q", "ß"])
        w = "".join(w)
        near = [(0 if p and w.startswith(t) else distance(w, t), k) for k, (t, p) in enumerate(terms)]
        want = [(d, k) for d, k in near if d <= X.edits_allowed(*terms[k])]
        got = auto.match(w)
        assert (got is None) == (not want), w
        if got:
            assert got[1] == min(want)[0], w


def test_context():
    text = "you are a loser and everyone knows"
    at = text.index("loser")
    direct = X.context_score(text, at, at + 5)
    quoted = 'he wrote that the term "loser" is unkind'
    at = quoted.index("loser")
    assert X.context_score(quoted, at, at + 5) < 1 < direct


def corpus(n=900):
    rng = random.Random(3)
    common = ["the", "of", "and", "river", "stone", "walks", "under", "light", "seven", "closer", "house", "green", "trees", "slowly", "bread", "water"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) + rng.choice(["", "", "s", "x"]) for _ in range(rng.randint(30, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                bad = rng.choice(["loser", "idiot", "worthless", "scumbag"])
                if rng.random() < 0.2:
                    bad = bad[:2] + rng.choice("xyz") + bad[3:]
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = corpus()
    rows += [(10_001, None), (10_002, ""), (None, "loser"), (0, rows[0][1]), (10_003, "closer " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as y", "'lang' as lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = X.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(by_id[i].predicted, y) for i, y in labels if by_id[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert by_id[10_001].score == by_id[10_002].score < 0.5 and by_id[10_003].predicted == 0


def test_misspellings_of_a_term_with_a_prefix_entry(spark):
    rows, labels = corpus(400)
    rng = random.Random(4)
    for k, (i, text) in enumerate(rows):
        if labels[k][1]:
            words = [w for w in text.split() if w[:2] not in ("lo", "id", "wo", "sc")]
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "idiots", "idiotic"]))
            rows[k] = (i, " ".join(words))
    model = X.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(p and "idiotic".startswith(t) for t, p, _ in model.terms)
    matcher = X.Matcher(model)
    assert all(matcher[w] for w in ("idiot", "idiots", "idiotic", "ideot", "iddiot", "idiotc"))
    assert not matcher["river"] and not matcher["walks"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    assert [r.score for r in X.score(docs, model).collect()] == [0.0]
    assert X.score(docs.limit(0), model).count() == 0


def test_contexts_are_told_apart():
    assert len({X._bit(f"context {i}") for i in range(2000)}) == 63


def test_forgetting_states_changes_nothing():
    rng = random.Random(5)
    terms = [("".join(rng.choice("abcd") for _ in range(rng.randint(3, 13))), rng.random() < 0.2) for _ in range(60)]
    small, large = X.LexiconAutomaton(terms, most_states=20), X.LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 14)))
        assert small.match(word) == large.match(word)
    assert len(small.states) < 100 < len(large.states)


def test_every_telling_term_enters_the_lexicon(spark):
    """700 terms, more than the lexicon once took."""
    rng = random.Random(6)
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i * 7919 % 100000:05d}") + "zq"
    terms = [word(i) for i in range(700)]
    rows = [(i, " ".join(f"w{rng.randrange(500)} {rng.choice(terms)} v{rng.randrange(500)}" for _ in range(60)), 1) for i in range(200)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(500)} v{rng.randrange(500)}" for _ in range(60)), 0) for i in range(200)]
    rows += [(1, "another text of that id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit(docs, docs.select("doc_id", "toxic"))
    whole = {t for t, prefix, _ in model.terms if not prefix}
    assert sum(t in whole for t in terms) > 650


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").selectExpr("*", "0.5 as score", "true as held_out", "1 as y", "2 as lid")
    got = X.score(docs, X.ToxicityModel())
    assert got.columns == ["doc_id", "score"] and sorted(r.score for r in got.collect()) == [0.0, 0.0]
    assert X.fit(docs, docs.selectExpr("doc_id", "1 as toxic")).weights is None

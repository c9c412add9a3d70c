import random
import re

from columnaut.llm import quality as Q


def brute(text, rules):
    """The measures from their definitions, with strings for hashes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))

    def inside(k):
        grams = [tuple(words[i : i + k]) for i in range(n - k + 1)]
        return [any(grams.count(grams[j]) > 1 for j in range(max(0, i - k + 1), min(i, n - k) + 1)) for i in range(n)]

    lines = text.split("\n")
    again = [x for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i]]
    line_chars = sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in again)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    repeat = sum(inside(3))
    gram = {k: sum(len(w) for w, x in zip(words, inside(k)) if x) for k in rules.ngram_pct}
    failed = n < rules.min_words or 100 * repeat > rules.base_repeat_pct * n
    good = not failed and all(100 * gram[k] <= p * chars for k, p in rules.ngram_pct.items()) and 100 * line_chars <= rules.line_pct * chars and 100 * symbols <= rules.symbol_pct * n
    return (n, chars, symbols, len(again), repeat, failed, good, line_chars, *(gram[k] for k in sorted(gram)))


def test_equals_brute_force():
    rng, rules = random.Random(1), Q.QualityRules(min_words=5)
    for _ in range(600):
        parts = [rng.choice(["a", "bb", "é", "#", "<x>", "c\xa0d", "\n", "\n", " ", "\t", "\x1c", "word"]) + rng.choice([" ", " ", "\n", "　"]) for _ in range(rng.randint(0, 40))]
        text = "".join(parts) + rng.choice(["", "".join(parts), "".join(parts[:12])])
        assert Q.measure_text(text, rules) == brute(text, rules), repr(text)


def test_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, "spam here now " * 40_000), (None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "true as kept", "1 as id", "5 as n_words")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in Q.measure(docs).collect())
    assert got == [(0, 80, False, True), (1, 0, True, False), (2, 0, True, False), (3, 80, False, True), (3, 80, False, True), (4, 120_000, True, False)]
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 3]
    assert Q.measure(docs.limit(0)).count() == 0 and Q.keep_good(docs.limit(0)).count() == 0


def test_windows_of_three_words_are_seen_whatever_the_rules():
    text = "one two three " * 40
    assert Q.measure_text(text, Q.QualityRules(ngram_pct={2: 30}))[4] == Q.measure_text(text, Q.QualityRules())[4] == 120
    assert Q.measure_text(text, Q.QualityRules(ngram_pct={}))[4] == 120

"""Toxicity by a learned lexicon, matched through Levenshtein automata, and scores of the context of each match.

Training (`fit`) takes a bounded sample of labelled rows: words and word beginnings are counted in toxic texts by the number of different
contexts that they stand in (so that copies of one text count once) and held against the clean texts; the best make up the lexicon. Its entries form a
trie, and the Levenshtein automata of all entries are run on it at once: a state is a set of (trie node, edits so far), made deterministic as words are read, so a
misspelled term costs one table step per letter; the tables are built anew when they have grown too large. A beginning stands for the words as they are; the telling words that it covers stay in the lexicon beside it,
so that their misspellings are found. Entries of under 5 letters allow no edits. Words that clean training texts hold aren't taken for misspellings.

Each match is weighed by its window: quotation marks around it and words of reporting lower it, direct address raises it. Sums and density of the weighed
matches enter a logistic regression. Scores depend on the text alone. Scoring needs no shuffle. Only the number of labelled rows is bounded (`rows_per_class`); every telling term of theirs
enters the lexicon, and every word of theirs the exceptions, so the model is bounded by what these rows hold.

Edge cases: of labelled rows with the same id and several texts one text is learnt from (that of the least digest); null and empty texts get the score of a text without matches; repeated rows get the same row each; without positive labels all scores are 0. An empty table
gives an empty result; other columns aren't read. Texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, bound_batches, documents, map_batches, materialize, slices, texts_of, two_columns

_TOKEN = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457", "oieast")
_QUOTES_OPEN, _QUOTES_CLOSE = "\"“„«‹'‘", "\"”“»›'’"
_REPORT = frozenset("said says wrote writes called calls quoted quote quoting according reported reports insult insults slur term word dit écrit selon appelé cite citation dijo escribió según llamó cita palabra sagte schrieb laut nannte zitat zitiert wort".split())
_DIRECT = frozenset("you your youre u ur du dich dir dein deine ihr euch tu toi ton ta vous votre tú usted eres vos".split())
_WINDOW = 80


@dataclass(frozen=True)
class ToxicityTraining:
    """rows_per_class: labelled rows of each class to learn from, at most.
    min_contexts: different contexts that a term needs in toxic texts. min_ratio: how much likelier it must be in toxic than in clean texts."""

    rows_per_class: int = 6000
    min_contexts: int = 6
    min_ratio: float = 8.0


@dataclass
class ToxicityModel:
    """terms: entry, whether it stands for all words that begin with it, and its weight (0 to 1). exceptions: words that are no misspellings."""

    terms: list[tuple[str, bool, float]] = field(default_factory=list)
    exceptions: frozenset[str] = frozenset()
    mean: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    weights: np.ndarray | None = None  # None: nothing to learn from
    bias: float = 0.0


def edits_allowed(term: str, prefix: bool) -> int:
    return 0 if prefix or len(term) < 5 else 1 if len(term) < 12 else 2


class LexiconAutomaton:
    """Finds the entry of a lexicon that a word equals, begins with, or misspells. most_states: states of the deterministic automaton that are remembered, about."""

    def __init__(self, terms: list[tuple[str, bool]], most_states: int = 50_000):
        self.most_states = most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.terms = terms
        self.most = [edits_allowed(*t) for t in terms]
        for k, (term, _) in enumerate(terms):
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = self.children[at][c]
            self.ends[at].append(k)
        self.reach = [0] * len(self.children)  # edits that some entry below a node allows
        for at in range(len(self.children) - 1, -1, -1):
            self.reach[at] = max([*(self.most[k] for k in self.ends[at]), *(self.reach[c] for c in self.children[at].values()), 0])
        self.letters = {c for x in self.children for c in x}
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []  # (entry, edits) for a word that ends here
        self.begins: list[int | None] = []  # entry that stands for every word that gets here
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        work, best = list(pairs), {}
        while work:  # leaving out letters of the entry
            at, e = work.pop()
            if e > self.reach[at] or best.get(at, 9) <= e:
                continue
            best[at] = e
            work += [(c, e + 1) for c in self.children[at].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            whole = [(e, k) for at, e in best.items() for k in self.ends[at] if e <= self.most[k]]
            self.accept.append(min(whole)[::-1] if whole else None)
            starts = [k for at, e in best.items() if e == 0 for k in self.ends[at] if self.terms[k][1]]
            self.begins.append(min(starts) if starts else None)
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        pairs = set()
        for at, e in self.states[state]:
            if letter in self.children[at]:
                pairs.add((self.children[at][letter], e))
            pairs.add((at, e + 1))
            pairs |= {(c, e + 1) for c in self.children[at].values()}
        return self._state(pairs)

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits), fewest edits first; None if no entry is near."""
        if len(self.states) > self.most_states:
            self._forget()
        state, begun, steps, begins = self.start, None, self.steps, self.begins
        for c in word:
            if c not in self.letters:
                c = ""
            nxt = steps[state].get(c)
            if nxt is None:
                nxt = steps[state][c] = self._step(state, c)
            state = nxt
            if not self.states[state]:
                break
            if begun is None:
                begun = begins[state]
        found = self.accept[state]
        if begun is not None:
            return begun, 0
        return found


class Matcher(Memo):
    """word -> (weight, entry) or None, remembered up to a bound."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = LexiconAutomaton([t[:2] for t in model.terms])
        super().__init__(self.find)

    def find(self, word: str) -> tuple[float, int] | None:
        found = None
        for w in {word, word.translate(_LEET)} if not word.isalpha() else (word,):
            hit = self.automaton.match(w)
            if hit and not (hit[1] and w in self.model.exceptions):
                value = self.model.terms[hit[0]][2] * (1.0, 0.5, 0.3)[hit[1]]
                if found is None or value > found[0]:
                    found = (value, hit[0])
        return found


def context_score(text: str, start: int, end: int) -> float:
    """How much a match at text[start:end] counts: under 1 if it is quoted or reported, over 1 if someone is addressed."""
    before, after = text[max(0, start - _WINDOW) : start], text[end : end + _WINDOW]
    quoted = False
    for a, b in zip(_QUOTES_OPEN, _QUOTES_CLOSE):
        opened = before.rfind(a)
        if opened >= 0 and b in after and (a != b or before.count(a) % 2) and (a not in "'‘" or opened == 0 or not before[opened - 1].isalnum()):
            quoted = True
    near = set(_TOKEN.findall(before.lower())) | set(_TOKEN.findall(after.lower()))
    return 1.0 - 0.6 * quoted - 0.2 * bool(near & _REPORT) + 0.3 * (bool(near & _DIRECT) and not quoted)


def features_of(text: str, matcher: Matcher) -> np.ndarray:
    """log of the weighed matches' sum, of their number per hundred words, the heaviest match, log of how many entries match."""
    low = text.lower()
    words = _TOKEN.findall(low)
    hits = [h for h in map(matcher.__getitem__, words) if h]
    if not hits:
        return np.zeros(4)
    values = []
    if len(low) != len(text):  # positions would differ; the lower-cased text has the same marks
        text = low
    for m in _TOKEN.finditer(low):
        h = matcher[m.group()]
        if h:
            values.append(h[0] * context_score(text, m.start(), m.end()))
    total = sum(values)
    return np.array([np.log1p(total), np.log1p(100 * total / len(words)), max(values), np.log1p(len({h[1] for h in hits}))])


def score_of(x: np.ndarray, model: ToxicityModel) -> float:
    if model.weights is None:
        return 0.0
    z = float(((x - model.mean) / model.scale) @ model.weights + model.bias)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _regression(x: np.ndarray, y: np.ndarray, by: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, rows weighed by `by`."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (by * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (by * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _bit(text: str) -> int:
    return 1 << (xxhash.xxh3_64_intdigest(text) % 63)


def _terms(words: list[str]) -> Iterator[tuple[str, str, str]]:
    """(entry, context, word): every word of 3 letters or more, and its beginnings of 4 to 7, marked by *."""
    for i, w in enumerate(words):
        if len(w) >= 3 and not w.isdigit():
            context = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
            yield w, context, w
            for n in range(4, min(len(w), 8)):
                yield w[:n] + "*", context, w


def _beginnings(word: str) -> list[str]:
    """The entries for beginnings that cover a word, or a beginning given without its mark."""
    return [word[:n] + "*" for n in range(4, min(len(word), 7) + 1)]


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityTraining = ToxicityTraining(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the labelled rows given; leave out of `labels` what is to be held out."""
    known = labels.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{label_col}`").cast("int").alias("y")).where("lid is not null and y in (0, 1)").groupBy("lid").agg(F.max("y").alias("y"))
    picks = [known.where(f"y = {y}").orderBy(F.xxhash64("lid"), "lid").limit(p.rows_per_class) for y in (0, 1)]
    bound_batches(docs.sparkSession)
    source = two_columns(docs, id_col, text_col)
    found = source.join(F.broadcast(picks[0].union(picks[1])), F.col("id") == F.col("lid")).select("lid", "y", F.coalesce("text", F.lit("")).alias("text"))
    one = found.groupBy("lid").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text", "y")).alias("r"))  # ids may repeat
    sample = materialize(one.select("r.y", "r.text").distinct(), "toxic-sample")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return ToxicityModel()

    def count(y: int, out_bits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, list[int]] = {}
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    of_text = set()
                    for term, context, word in _terms(_TOKEN.findall(text.lower())):
                        row = seen.get(term)
                        if row is None:
                            row = seen[term] = [0, 0, 0]
                        if out_bits:
                            row[0] |= _bit(context)
                            row[1] |= _bit(word)
                        of_text.add(term)
                    for term in of_text:
                        seen[term][2] += 1
                if len(seen) > 500_000:
                    yield _batch(seen)
                    seen = {}
            yield _batch(seen)

        rows = sample.where(f"y = {y}").select("text").mapInArrow(run, "term string, contexts bigint, words bigint, n bigint")
        return rows.groupBy("term").agg(F.bit_or("contexts").alias("contexts"), F.bit_or("words").alias("words"), F.sum("n").alias("n"))

    bad = count(1, True).select("term", F.bit_count("contexts").alias("contexts"), F.bit_count("words").alias("words"), "n").where(f"contexts >= {p.min_contexts} and (not endswith(term, '*') or words >= 3)")
    clean = count(0, False).select("term", F.col("n").alias("m"))
    odds_of = F.expr(f"((n + 0.5D) / {sizes[1] + 1}) / ((coalesce(m, 0) + 0.5D) / {sizes[0] + 1})")
    telling = bad.join(clean, "term", "left").select("term", "n", odds_of.alias("odds"), "m").where(f"odds >= {p.min_ratio!r}D and coalesce(m, 0) * 20 <= n")
    rows = telling.collect()
    odds, n_of = {r.term: r.odds for r in rows}, {r.term: r.n for r in rows}
    good = set(odds)
    begins = {t for t in good if t.endswith("*")}
    # of beginnings that say the same the longest
    begins -= {t for u in begins for t in _beginnings(u[:-1]) if t != u and t in begins and n_of[u] >= 0.95 * n_of[t]}
    begins = {t for t in begins if not any(u != t and u in begins for u in _beginnings(t[:-1]))}
    covered = {t for t in good if not t.endswith("*") and any(u in begins for u in _beginnings(t))}
    chosen = sorted(begins | {t for t in good if not t.endswith("*")} - covered, key=lambda t: (-odds[t], t))
    top = max((np.log(odds[t]) for t in chosen), default=1.0)
    # words that a chosen beginning covers are needed for their misspellings
    chosen += sorted((t for t in covered if edits_allowed(t, False)), key=lambda t: (-n_of[t], t))
    model = ToxicityModel([(t.rstrip("*"), t.endswith("*"), float(min(1.0, np.log(odds[t]) / top))) for t in chosen])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton([t[:2] for t in model.terms])
        words = {w for batch in batches for text in batch.column("text").to_pylist() for w in _TOKEN.findall(text.lower())}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(w for w in words if (automaton.match(w) or (0, 0))[1]), pa.string())], names=["word"])

    found = sample.where("y = 0").select("text").mapInArrow(near, "word string").distinct().collect()
    model.exceptions = frozenset(r.word for r in found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            x = [features_of(t, matcher).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.mapInArrow(measure, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.y, r.x))
    all_of = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = {y: all_of[y] / sizes[y] for y in (0, 1)}  # classes count as often as among all labels, not as in the sample
    share = {y: v / max(share.values()) for y, v in share.items()}
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    model.weights, model.bias = _regression((x - model.mean) / model.scale, y, np.where(y == 1, share[1], share[0]))
    return model


def _batch(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([r[i] for r in seen.values()], pa.int64()) for i in range(3))], names=["term", "contexts", "words", "n"])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    bound_batches(docs.sparkSession)
    source = two_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            for part in slices(batch, "text"):
                scores = [score_of(features_of(t, matcher), model) for t in texts_of(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)['id']}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.expr("cast(score >= 0.7 as int)").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}

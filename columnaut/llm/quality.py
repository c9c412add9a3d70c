"""Quality rules by repetition coverage.

Words are hashed to 64 bits and n-gram hashes are rolled along the text in numpy. For several lengths the characters of all
words inside n-grams that occur twice or more in the text are measured, and so are the characters of repeated lines; a
text with too large a share of them is rejected. Everything happens inside the row: no shuffle, no state between texts.

Edge cases: null and empty texts have no words and fail the base rule (n_words < 50); repeated rows get the same row each;
an empty table gives an empty result; other columns are not read by `measure` and pass through `keep_good` untouched,
whatever their names. A text of any length is measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, slices, texts_of, two_columns, words_of

_P = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """min_words and base_repeat_pct: the base rules. ngram_pct: largest percentage of word characters inside duplicated
    n-grams, by n. line_pct: largest percentage of word characters in lines that equal an earlier one. symbol_pct: most
    symbols per hundred words."""

    min_words: int = 50
    base_repeat_pct: int = 50
    ngram_pct: dict[int, int] = field(default_factory=lambda: {n: 30 for n in range(5, 11)})
    line_pct: int = 30
    symbol_pct: int = 25


def _covered(same: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of n words whose start is marked."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(same)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _duplicated(grams: np.ndarray) -> np.ndarray | None:
    """Which n-grams occur twice or more; None if none does."""
    s = np.sort(grams)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    at = np.searchsorted(twice, grams)
    at[at == len(twice)] = 0
    return twice[at] == grams


def measure_text(text: str, rules: QualityRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars, *dup_chars by n)."""
    words = words_of(text)
    n = len(words)
    symbols = sum(map(text.count, _SYMBOLS))
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())

    dup_lines = dup_line_chars = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                own = words_of(line)
                dup_lines += 1
                dup_line_chars += sum(map(len, own))
            elif words_of(line):
                seen.add(line)

    gram = {k: 0 for k in rules.ngram_pct}
    repeat = 0
    if n >= 4:  # a window of 3 words can't occur twice in fewer
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        g = h
        for k in range(2, max([3, *rules.ngram_pct]) + 1):
            if n <= k:
                break
            g = g[:-1] * _P + h[k - 1 :]  # the hash of k words from that of the first k - 1
            if k == 3 or k in gram:
                same = _duplicated(g)
                if same is None:
                    break  # nor does any longer n-gram occur twice
                inside = _covered(same, k, n)
                if k == 3:
                    repeat = int(inside.sum())
                if k in gram:
                    gram[k] = int(lengths[inside].sum())
    base_failed = n < rules.min_words or 100 * repeat > rules.base_repeat_pct * n
    good = (
        not base_failed
        and all(100 * gram[k] <= pct * chars for k, pct in rules.ngram_pct.items())
        and 100 * dup_line_chars <= rules.line_pct * chars
        and 100 * symbols <= rules.symbol_pct * n
    )
    return n, chars, symbols, dup_lines, repeat, base_failed, good, dup_line_chars, *(gram[k] for k in sorted(gram))


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars"]


def measure(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the counts, base_failed, kept and dup_chars_<n> for each n-gram length."""
    lengths = sorted(rules.ngram_pct)
    names = [*_BASE, *(f"dup_chars_{k}" for k in lengths)]
    flags = {"base_failed", "kept"}
    source = two_columns(docs, id_col, text_col)
    types = [pa.bool_() if x in flags else pa.int64() for x in names]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [measure_text(t, rules) for part in slices(batch, "text") for t in texts_of(part, "text")]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *names])

    schema = f"`{id_col}` {dict(source.dtypes)['id']}, " + ", ".join(f"{x} {'boolean' if x in flags else 'bigint'}" for x in names)
    return map_batches(source, run, schema)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text the rules keep."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(at)
        good = [measure_text(x.as_py() or "", rules)[6] for x in texts]
        yield batch.filter(pa.array(good, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))


def _gram_sql(k: int) -> str:
    return f"""g{k} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS same FROM (
            SELECT doc_id, i, {" || ' ' || ".join("w" if j == 0 else f"lead(w, {j}) OVER (PARTITION BY doc_id ORDER BY i)" for j in range(k))} AS g FROM w) WHERE g IS NOT NULL),
        c{k} AS (SELECT w.doc_id, coalesce(sum(CASE WHEN near THEN 1 END), 0)::BIGINT AS n, coalesce(sum(CASE WHEN near THEN length(w) END), 0)::BIGINT AS chars FROM (
            SELECT w.doc_id, w.w, coalesce(bool_or(same) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), false) AS near
            FROM w LEFT JOIN g{k} USING (doc_id, i)) w GROUP BY 1)"""


_RULES = QualityRules()
ORACLE = (
    r"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
        l AS (SELECT doc_id, line, count(*) - 1 AS again, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
        d AS (SELECT doc_id, sum(again)::BIGINT AS n_dup_lines, sum(again * chars)::BIGINT AS dup_line_chars FROM l GROUP BY 1),
        b AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY 1),"""
    + ",".join(_gram_sql(k) for k in (3, *_RULES.ngram_pct))
    + r""", a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
            coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, """
    + ", ".join(f"coalesce(c{k}.chars, 0) AS dup_chars_{k}" for k in _RULES.ngram_pct)
    + " FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN d USING (doc_id) "
    + " ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in (3, *_RULES.ngram_pct))
    + f"), f AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.base_repeat_pct} * n_words AS base_failed FROM a) "
    + f"SELECT *, NOT base_failed AND 100 * dup_line_chars <= {_RULES.line_pct} * word_chars AND 100 * n_symbols <= {_RULES.symbol_pct} * n_words AND "
    + " AND ".join(f"100 * dup_chars_{k} <= {p} * word_chars" for k, p in _RULES.ngram_pct.items())
    + " AS kept FROM f"
)

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": ORACLE}

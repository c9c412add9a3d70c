"""Document fingerprints: a quartile bucket digest.

Byte triplets (three spacings within a sliding window) are hashed into 512 buckets and counted; each bucket is encoded as the quartile that its count
falls in, two bits each, after one byte for the logarithm of the length. Two digests are compared by the sum of the differences of their
quartiles and a bounded difference of their lengths, scaled to a likeness from 0 to 1 (1: equal digests).

Edge cases: null counts as the empty text, whose quartiles are all 0; texts shorter than the window are padded with zero bytes, so they too have
triplets; equal texts have equal digests. Texts are hashed whole. For the edited texts, rows are ordered by id (null ids first, equal ids by
their place in the table, in a fixed but arbitrary order if they are very many), the last is followed by the first, and a single row by itself. Ids may be of any type that can be
ordered. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, documents, map_batches, slices, texts_of, two_columns

BUCKETS = 512
TRIPLETS = ((2, 5), (3, 7), (1, 6))
#: Steps of the length byte for each factor e, the largest difference that counts, and how much of the whole score it makes up.
LENGTH_STEPS, LENGTH_MOST, LENGTH_SHARE = 12, 24, 0.1
_SLAB = 1 << 20


def _counts(blob: bytes) -> np.ndarray:
    """How often each bucket is hit."""
    blob = blob + b"\0" * 7 if blob else b""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(blob), _SLAB):
        v = np.frombuffer(blob, np.uint8, min(_SLAB + 7, len(blob) - at), at).astype(np.uint32)
        for k, (i, j) in enumerate(TRIPLETS):
            n = min(_SLAB, len(v) - j)
            if n <= 0:
                continue
            x = v[:n] | v[i : i + n] << np.uint32(8) | v[j : j + n] << np.uint32(16)
            x = (x + np.uint32((k * 0x3C6EF372 + 0x9E37) % 2**32)) * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA77)
            x ^= x >> np.uint32(13)
            total += np.bincount(x & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return total


def fingerprint(text: str) -> str:
    """The digest in hexadecimal: a byte of length, then two bits per bucket."""
    blob = text.encode()
    counts = _counts(blob)
    at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    quartiles = np.partition(counts, at)[at]
    code = (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8)
    packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    return f"{min(255, round(LENGTH_STEPS * float(np.log1p(len(blob))))):02x}" + packed.tobytes().hex()


def _decoded(digest: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    body = raw[1:]
    return int(raw[0]), np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=1).astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, towards 0 the more quartiles and lengths differ."""
    (m, x), (n, y) = _decoded(a), _decoded(b)
    body = float(np.abs(x - y).sum()) / (3 * x.size)
    return (1 - LENGTH_SHARE) * (1 - body) + LENGTH_SHARE * (1 - min(abs(m - n), LENGTH_MOST) / LENGTH_MOST)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and fingerprint of every row."""
    source = two_columns(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            texts = texts_of(part, "text")
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())], names=[id_col, "n_chars", "fingerprint"])

    return map_batches(source, run, f"`{id_col}` {dict(source.dtypes)['id']}, n_chars bigint, fingerprint string")


#: Bytes of text that a range of ids holds, about; and how many ranges there are at most.
RANGE_BYTES, MOST_RANGES = 64 << 20, 200_000
#: Sampled ids for each range.
_SAMPLES = 20


class Ranges:
    """Numbers of ranges, ascending with the id: range 0 holds the rows without one, and each further one the ids after a bound up to the next. An id, or no id, that makes up more than a range is
    dealt into several by the rows' places."""

    def __init__(self, sample: np.ndarray, n: int, nulls: int):
        sample = np.sort(sample)
        picks = sample[np.linspace(0, len(sample), n + 1)[1:-1].astype(np.int64)] if len(sample) else sample
        self.splits = np.unique(picks) if len(picks) else picks
        width = np.ones(len(self.splits) + 2, np.int64)
        width[0] = nulls
        self.hot = []  # ids of several parts; each is the last one of its range
        if len(sample):
            for value, k in zip(*np.unique(sample, return_counts=True)):
                if k * n > 2 * len(sample):
                    width[np.searchsorted(self.splits, value) + 1] = -(-int(k) * n // len(sample))
                    self.hot.append(value)
        self.width, self.before = width, np.concatenate([[0], np.cumsum(width)[:-1]])
        self.total = int(width.sum())

    def __call__(self, ids: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, part of an id, or -1 for an id that isn't cut) of rows."""
        some = np.asarray(ids.is_valid())
        values = ids.drop_null().to_numpy(zero_copy_only=False)
        at, cut = np.zeros(len(ids), np.int64), ~some & (self.width[0] > 1)
        if len(values):
            at[some] = np.searchsorted(self.splits, values) + 1
            for v in self.hot:
                cut[some] |= values == v
        mixed = (places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        part = np.where(cut, mixed.astype(np.int64) % self.width[at], -1)
        return self.before[at] + np.maximum(part, 0), part


def in_order(docs: DataFrame, id_col: str, text_col: str, range_bytes: int = RANGE_BYTES, least_ranges: int | None = None) -> DataFrame:
    """(range, copy, id, part, place, text): all rows dealt into ranges of ids, each sorted in a partition of its own, and after the rows of each range (copy = true) the one row that follows
    it (or, if rows share its id, all of these). The number of ranges follows from the bytes of the table; their bounds come from a sample of the ids and only balance the work. Texts are shuffled
    once. The table is read three times; if an id is cut into parts, rows must be in the same places each time, as in files (else the run fails)."""
    spark = docs.sparkSession
    source = two_columns(docs, id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    size = source.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = min(max(least_ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // range_bytes)), MOST_RANGES)
    drawn = source.where("id is not null").select("id").sample(min(1.0, 2 * _SAMPLES * n / max(1, size.n)), 7).toArrow().column("id")
    ranges = Ranges(drawn.to_numpy(), n, max(1, -(-(size.n - size.ids) * n // max(1, size.n))))

    def least(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, part = ranges(batch.column("id"), batch.column("place").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("id"), pa.array(part), batch.column("place")], names=["range", "id", "part", "place"])

    kind = dict(source.dtypes)["id"]
    ends = map_batches(source.select("id", "place"), least, f"range bigint, id {kind}, part bigint, place bigint")
    ends = ends.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "part", "place")).alias("first"))
    firsts = sorted((r.range, r.first) for r in ends.collect())  # one row for each range
    # the range before, by the id with which a range begins, or by the place of its first row if that id is cut into parts
    by_id = {r.id: firsts[i - 1][0] for i, (_, r) in enumerate(firsts) if r.part < 0}
    by_place = {r.place: firsts[i - 1][0] for i, (_, r) in enumerate(firsts) if r.part >= 0}
    begins = pa.array([i for i in by_id if i is not None], to_arrow_type(source.schema["id"].dataType))
    starts = np.array(sorted(by_place), np.int64)

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some in slices(batch, "text"):
            places = some.column("place").to_numpy()
            at, part = ranges(some.column("id"), places)
            ids = some.column("id")
            same = np.asarray(pc.is_in(ids, begins)) | (np.asarray(ids.is_null()) if None in by_id else False)
            again = np.flatnonzero(same & (part < 0) | np.isin(places, starts) & (part >= 0))
            to = np.concatenate([at, np.array([by_id[ids[i].as_py()] if part[i] < 0 else by_place[int(places[i])] for i in again], np.int64)])
            rows = pa.array(np.concatenate([np.arange(len(places)), again]).astype(np.int64))
            copy = pa.array(np.arange(len(rows)) >= len(places))
            yield pa.RecordBatch.from_arrays([pa.array(to), copy, some.column("id").take(rows), pa.array(part).take(rows), some.column("place").take(rows), some.column("text").take(rows)], names=["range", "copy", "id", "part", "place", "text"])

    dealt = map_batches(source, deal, f"range bigint, copy boolean, id {kind}, part bigint, place bigint, text string")
    return dealt.repartitionById(ranges.total, F.col("range").cast("int")).sortWithinPartitions("range", "copy", F.asc_nulls_first("id"), "part", "place")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, least_ranges: int | None = None) -> DataFrame:
    """Every row's fingerprint beside that of its edited text, whose last quarter of code points is replaced by the first as many of the next row's text; and
    the likeness of its fingerprint to the edited text's and to the next row's."""
    rows = in_order(docs, id_col, text_col, range_bytes, least_ranges)
    kind = docs.schema[id_col].dataType
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one hasn't come yet: range, id, text, fingerprint
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for at, own_id, copy, text in zip(part.column("range").to_pylist(), part.column("id").to_pylist(), part.column("copy").to_pylist(), texts_of(part, "text")):
                    if held is None and copy:
                        continue  # rows with the same id as the one that follows
                    if held is not None and held[0] != at:
                        raise RuntimeError("rows have changed their places; write the table before")
                    own = fingerprint(text)
                    if held is not None:
                        _, i, t, f = held
                        k = len(t) // 4
                        edited = t[: len(t) - k] + text[:k]
                        e = fingerprint(edited)
                        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, likeness(f, e), likeness(f, own)))
                    held = None if copy else (at, own_id, text, own)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)
        if held is not None:
            raise RuntimeError("rows have changed their places; write the table before")

    bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_fingerprints that SQL can express."""
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM d)
    SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substring(t, 1, (length(t) - length(t) // 4)::BIGINT) || substring(u, 1, (length(t) // 4)::BIGINT)) AS edited_sha256 FROM n"""

QUERIES = {"op7_fingerprints": op7_fingerprints, "edited_texts": edited_texts}
ORACLES = {"edited_texts": EDITED_ORACLE}

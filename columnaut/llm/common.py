"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space of Unicode that str.split() would cut at, but WORD would not.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def words_of(text: str) -> list[str]:
    """The words of a text; the same as WORD.findall, but mostly by the faster str.split."""
    return text.split() if not _OTHER_SPACE.search(text) else WORD.findall(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where that is unset (local runs and tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="columnaut-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    folder = shared_dir(spark)
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    elif "://" not in folder and spark.sparkContext.master.startswith("local"):
        folder = "file://" + folder
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: The paths in the shared folder that were given out, by application, until they are discarded.
_WRITTEN: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that `shared_path` gave and nothing needs any more."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in written:
        written.remove(path)
        _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete an intermediate table, as `materialize` gave it, that nothing needs any more."""
    remove(df.sparkSession, df.written_at)


class scratch:
    """with scratch(spark): whatever the operators write into the shared folder meanwhile is deleted at the end; results that read it must have been written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = len(_WRITTEN.setdefault(self.spark.sparkContext.applicationId, []))

    def __exit__(self, *_) -> None:
        written = _WRITTEN[self.spark.sparkContext.applicationId]
        while len(written) > self.before:
            _delete(self.spark, written.pop())


#: Bytes that one Arrow batch holds, about, unless the session says otherwise; the default counts rows only, and texts can be long.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


_ABSENT = object()


class Memo(dict):
    """Remembers what `compute` gave for about the last 2 * `most` keys: when a generation is full it becomes the old one, from which keys that are asked for again move on."""

    def __init__(self, compute: Callable, most: int = 75_000):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key, _ABSENT)
        if value is _ABSENT:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of text (a longer text stands alone); bounds the memory of Python workers."""
    sizes = batch.column(text).nbytes
    if sizes <= most or batch.num_rows < 2:
        yield batch
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held + n > most and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, as columns `id` and `text`, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; looks at no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

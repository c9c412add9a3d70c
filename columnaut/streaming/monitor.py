"""Profiling a stream: each micro-batch is summarised by the same fused aggregate as a table, and the rows are appended to a sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import number_where
from ..plans.columns import every, normalised
from ..plans.fused import per_column


def batch_profile(batch: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_rows, null_count, approx_unique) of one batch, from one pass."""
    measures = {"n_rows": lambda c: F.count(F.lit(1)), "null_count": lambda c: number_where(c.isNull()), "approx_unique": F.approx_count_distinct}
    return per_column(batch, every(batch, columns), measures, "n_rows bigint, null_count bigint, approx_unique bigint")


def monitor(stream: DataFrame, path: str, checkpoint: str, profile: Callable[[DataFrame], DataFrame] = batch_profile, trigger: dict | None = None) -> StreamingQuery:
    """Write the profile of every micro-batch as Parquet under path/batch=<id>. A batch that is replayed overwrites its own folder, so each counts once."""

    def each(batch: DataFrame, number: int) -> None:
        profile(normalised(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

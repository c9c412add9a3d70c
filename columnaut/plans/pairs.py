"""Sums over all pairs of many columns, in one pass: blocks of rows are multiplied as matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMS = ("n", "x", "xx", "xy")


def pair_sums(df: DataFrame, values: Sequence[Column]) -> dict[str, np.ndarray]:
    """For every pair (i, j) of numeric columns, over the rows where both have a value: n, their number; x, the sum of i; xx, that of its squares; xy, that of the products. Each task multiplies its
    rows as matrices and gives one row per column, so the table is scanned once however many columns there are; a number for each pair and sum reaches the driver."""
    k = len(values)
    out = {s: np.zeros((k, k)) for s in _SUMS}
    if not k:
        return out
    frame = df.select(*(v.cast("double").alias(f"c{i}") for i, v in enumerate(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((len(_SUMS), k, k)), 0
        for batch in batches:
            rows += batch.num_rows
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(x)
            x[~there] = 0.0
            there = there.astype(float)
            for s, (a, b) in enumerate(((there, there), (x, there), (x * x, there), (x, x))):
                total[s] += a.T @ b
        if rows:
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, k * k + 1, k), pa.int32()), pa.array(t.ravel())) for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), *lists], names=["i", *_SUMS])

    parts = frame.mapInArrow(run, "i int, " + ", ".join(f"{s} array<double>" for s in _SUMS))
    cells = parts.select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("j", "v")).groupBy("i", "j").agg(*(F.sum(f"v.{s}").alias(s) for s in _SUMS))
    for r in cells.collect():
        for s in _SUMS:
            out[s][r.i, r.j] = r[s]
    return out

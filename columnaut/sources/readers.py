"""Where tables come from: files by extension, named data sets, frames, and samples of them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.columns import normalised, ref, strings

#: What a CSV file may write for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A table by its path; the kind follows from the extension unless given: csv, tsv, parquet, json (one object per line), orc, or a table name. A schema saves CSV
    and JSON a pass over the data."""
    kind = kind or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "table"
    if kind in ("csv", "tsv"):
        return _read_csv(spark, path, "\t" if kind == "tsv" else ",", schema, options)
    if kind in ("json", "jsonl", "ndjson"):
        reader = spark.read.options(**options)
        return normalised((reader.schema(schema) if schema else reader).json(path))
    if kind in ("parquet", "orc"):
        return normalised(spark.read.options(**options).format(kind).load(path))
    if kind == "table":
        return normalised(spark.table(path))
    raise ValueError(f"unknown kind of table: {kind}")


def _read_csv(spark: SparkSession, path: str, separator: str, schema: str | None, options: dict) -> DataFrame:
    base = {"header": True, "sep": separator, "multiLine": False, "escape": '"', "mode": "PERMISSIVE"} | options
    if schema:
        return normalised(spark.read.options(**base).schema(schema).csv(path))
    text = spark.read.options(**base).csv(path)  # all strings; every token for a missing value is then one
    text = text.withColumns({c: F.when(~F.trim(ref(c)).isin(MISSING), ref(c)) for c in text.columns}) if text.columns else text
    types = _column_types(text)
    return normalised(text.select(*(ref(c).cast(types[c]).alias(c) for c in text.columns)))


def _column_types(text: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or timestamp if every value of a column is one, else string; one pass for all columns."""
    if not text.columns:
        return {}
    tests = {
        "bigint": lambda c: c.rlike(r"^\s*[+-]?\d{1,18}\s*$"),
        "double": lambda c: c.try_cast("double").isNotNull(),
        "boolean": lambda c: F.lower(F.trim(c)).isin("true", "false"),
        "timestamp": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}") & c.try_cast("timestamp").isNotNull(),
    }
    row = text.agg(*(F.bool_and(F.when(ref(c).isNotNull(), t(ref(c)))).alias(f"{i}_{k}") for i, c in enumerate(text.columns) for k, t in tests.items())).first()
    return {c: next((k for k in tests if row[f"{i}_{k}"]), "string") for i, c in enumerate(text.columns)}


class Datasets:
    """Named data sets: name -> path or table. No network is used."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.paths = spark, {}
        if folder:
            for name in sorted(os.listdir(folder)):
                stem, extension = os.path.splitext(name)
                if extension.lstrip(".") in ("csv", "tsv", "parquet", "json", "jsonl", "orc"):
                    self.paths[stem] = os.path.join(folder, name)

    def register(self, name: str, path: str) -> None:
        self.paths[name] = path

    def names(self) -> list[str]:
        return sorted(self.paths | {t.name: "" for t in self.spark.catalog.listTables()})

    def load(self, name: str) -> DataFrame:
        if name in self.paths:
            return read_table(self.spark, self.paths[name])
        if self.spark.catalog.tableExists(name):
            return read_table(self.spark, name, "table")
        raise ValueError(f"unknown data set {name!r}; known are {self.names()}")


def as_frame(spark: SparkSession, data) -> DataFrame:
    """A Spark DataFrame from one, from a pandas frame, or from a path."""
    if isinstance(data, DataFrame):
        return normalised(data)
    if isinstance(data, str):
        return read_table(spark, data)
    if hasattr(data, "iloc"):
        return normalised(spark.createDataFrame(data))
    raise ValueError("give a DataFrame or a path")


def sample_rows(df: DataFrame, threshold: int = 1_000_000, strategy: str = "head", n: int | None = None, seed: int = 42, strata: str | None = None) -> tuple[DataFrame, dict | None]:
    """At most `threshold` rows (n, if given) of a larger table, and what was done; None if the table is small enough. head: any first rows; random: exactly n by a
    seeded order; stratified: the same share of each value of `strata`. Off unless called: operators look at whole tables."""
    keep, total = n or threshold, df.count()
    if total <= threshold:
        return df, None
    if strategy == "random":
        out = df.orderBy(F.rand(seed)).limit(keep)
    elif strategy == "stratified" and strata:
        fraction = keep / total
        values = [r[0] for r in df.select(ref(strata)).where(ref(strata).isNotNull()).distinct().limit(10_001).collect()]
        if len(values) > 10_000:
            raise ValueError(f"{strata} has too many values to stratify by")
        out = df.sampleBy(ref(strata), {v: fraction for v in values}, seed).union(df.where(ref(strata).isNull()).sample(fraction, seed))
    else:
        out = df.limit(keep)
    return out, {"original_rows": total, "sampled_rows": out.count(), "strategy": strategy}

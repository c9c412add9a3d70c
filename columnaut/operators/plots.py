"""The data of plots, aggregated in Spark; raw values never reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import numeric, value
from ..plans.fused import melted, per_column, quantiles
from .multivariate import correlations
from .summaries import missing_together, null_patterns, value_counts


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """(column, bin, lower, upper, n): equal bins between least and greatest value, empty ones included; the last bin holds its upper end."""
    names = numeric(df, columns)
    ends = per_column(df, names, {"lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")}, "lo double, hi double").where("lo is not null")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    ends = ends.withColumn("w", width)
    rows = melted(df, names, lambda c: value(df, c), "double").where("value is not null").join(F.broadcast(ends), "column")
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy("column", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every_bin = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every_bin.join(F.broadcast(counted), ["column", "bin"], "left")
    return out.select("column", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """(column, q1, median, q3, whisker_low, whisker_high): whiskers end at the outermost values within `factor` quartile distances of the box."""
    names = numeric(df, columns)
    q = quantiles(df, names, (0.25, 0.5, 0.75), exact).where("n > 0").select("column", *(F.col("q")[i].alias(x) for i, x in enumerate(("q1", "median", "q3"))))
    reach = factor * (F.col("q3") - F.col("q1"))
    rows = melted(df, names, lambda c: value(df, c), "double").where("value is not null").join(F.broadcast(q), "column").where((F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach))
    return rows.groupBy("column").agg(*(F.first(x).alias(x) for x in ("q1", "median", "q3")), F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))


def bars(df: DataFrame, columns: Sequence[str] | None = None, top_k: int = 20) -> DataFrame:
    """(column, value, n): the true counts of the most frequent values."""
    return value_counts(df, columns, top_k)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for the whole square, the diagonal included."""
    names = numeric(df, columns)
    r = correlations(df, names)
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in names], "a string, b string, r double")
    return r.union(r.select("b", "a", "r")).union(diagonal)


def null_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return null_patterns(df, columns)


def missingness_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return missing_together(df, columns)

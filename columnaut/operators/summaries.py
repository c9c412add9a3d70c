"""Summaries of single columns. Every function takes a table and returns a DataFrame with one row per column, unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import has_symbols, number_where, share, word_count
from ..plans.columns import every, numeric, ref, strings, value
from ..plans.fused import distinct_counts, frequencies, per_column, places_of, quantiles, value_counts_of
from ..plans.pairs import pair_sums

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def dataset_shape(df: DataFrame) -> DataFrame:
    """One row: num_rows, num_columns, null_cell_share (rounded to 4 digits), approx_memory_mb (2 digits; what the optimizer takes the table's size to be, as there is no in-memory size to measure)."""
    nulls = [F.coalesce(F.sum(value(df, c).isNull().cast("long")), F.lit(0)) for c in df.columns]
    size = F.lit(round(estimated_bytes(df) / 2**20, 2))
    cells = F.greatest(F.count(F.lit(1)) * len(df.columns), F.lit(1))
    total = sum(nulls, F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("num_rows"), F.lit(len(df.columns)).cast("long").alias("num_columns"), F.round(total / cells, 4).alias("null_cell_share"), size.alias("approx_memory_mb"))


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes the table's size to be."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def null_counts(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """null_count, null_share, and whether the share reaches the threshold."""
    found = per_column(df, every(df, columns), {"null_count": lambda c: number_where(c.isNull()), "null_share": lambda c: F.coalesce(share(c.isNull()), F.lit(0.0))}, "null_count bigint, null_share double")
    return found.withColumn("high_null", F.col("null_share") >= threshold)


def null_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(pattern, n): which columns are null together; a pattern has a 1 for each null column, in the table's order."""
    names = every(df, columns)
    return df.select(F.concat(F.lit(""), *(value(df, c).isNull().cast("int").cast("string") for c in names)).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def missing_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the number of missing cells."""
    return null_counts(df, columns).agg(F.coalesce(F.sum("null_count"), F.lit(0)).alias("missing_cells"))


def missing_together(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, n): in how many rows both columns are null, for every pair in the table's order, from one pass: an aggregate, or products of blocks for wide tables."""
    names = every(df, columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n bigint")
    if len(pairs) > 500:
        n = pair_sums(df, [F.when(value(df, c).isNull(), 1.0) for c in names])["n"]
        rows = [(a, b, int(n[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
        return df.sparkSession.createDataFrame(rows, "a string, b string, n bigint")
    parts = []
    for k in range(0, len(pairs), 500):
        wide = df.agg(*(number_where(value(df, a).isNull() & value(df, b).isNull()).alias(f"_{i}") for i, (a, b) in enumerate(pairs[k : k + 500])))
        parts.append(wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").cast("long").alias("n")) for i, (a, b) in enumerate(pairs[k : k + 500]))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def summarize_numeric(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std (ddof 1), min, seven percentiles (interpolated), max, near_zero_variance (population variance < 1e-4). Columns without a value are left out."""
    names = numeric(df, columns)
    measures = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "var": F.var_pop,
    }
    base = per_column(df, names, measures, "count bigint, mean double, std double, min double, max double, var double")
    q = quantiles(df, names, PERCENTILES, exact)
    points = [F.col("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(PERCENTILES)]
    return base.join(F.broadcast(q), "column").where("count > 0").select("column", "count", "mean", "std", "min", *points, "max", (F.col("var") < 1e-4).alias("near_zero_variance"))


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False, count_nulls: bool = False) -> DataFrame:
    """n_unique; exact by one exchange of distinct values, or approximate in one pass."""
    names = every(df, columns)
    if approximate:
        return per_column(df, names, {"n_unique": lambda c: F.approx_count_distinct(c, 0.01)}, "n_unique bigint")
    return distinct_counts(df, names, count_nulls)


def modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): the most frequent values, all of them if tied."""
    found = frequencies(df, every(df, columns))
    top = found.groupBy("column").agg(F.max("n").alias("_top"))  # one row per column; nothing is put in order
    return found.join(F.broadcast(top), "column").where("n = _top").drop("_top")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, top_k: int = 5) -> DataFrame:
    """(column, value, n): the top_k most frequent values of each column, null included; ties by value, null first."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return frequencies(df, every(df, columns), nulls=True).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")


def boolean_fields(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """pct_true, pct_false and pct_null over all rows, of columns whose values are all true, false, 0 or 1; columns without a value qualify too."""
    fits = (T.BooleanType, T.NumericType, T.NullType)
    names = [c for c in every(df, columns) if isinstance(df.schema[c].dataType, fits)]
    measures = {
        "pct_true": lambda c: share(c.cast("double") == 1),
        "pct_false": lambda c: share(c.cast("double") == 0),
        "pct_null": lambda c: share(c.isNull()),
        "fits": lambda c: F.coalesce(F.bool_and(c.cast("double").isin(0.0, 1.0)), F.lit(True)),
    }
    return per_column(df, names, measures, "pct_true double, pct_false double, pct_null double, fits boolean").where("fits").drop("fits")


def text_fields(df: DataFrame, columns: Sequence[str] | None = None, with_mode: bool = True) -> DataFrame:
    """avg_char_length, avg_word_count, avg_word_length (characters by words, spaces included), total_chars, contains_symbols and most_frequent_value (the least of those
    tied) of string columns that hold a value."""
    names = strings(df, columns)
    measures = {
        "n": F.count,
        "avg_char_length": lambda c: F.avg(F.char_length(c)),
        "avg_word_count": lambda c: F.avg(word_count(c)),
        "words": lambda c: F.sum(word_count(c)),
        "total_chars": lambda c: F.sum(F.char_length(c)),
        "contains_symbols": lambda c: F.bool_or(has_symbols(c)),
    }
    base = per_column(df, names, measures, "n bigint, avg_char_length double, avg_word_count double, words bigint, total_chars bigint, contains_symbols boolean").where("n > 0")
    base = base.withColumn("avg_word_length", F.when(F.col("words") > 0, F.col("total_chars") / F.col("words")).otherwise(0.0))
    out = ["column", "avg_char_length", "avg_word_count", "avg_word_length", "total_chars", "contains_symbols"]
    if not with_mode:
        return base.select(*out)
    # values are compared as strings of their hash first, so that long texts are not shuffled whole
    return base.join(F.broadcast(most_frequent(df, names)), "column", "left").select(*out, F.col("value").alias("most_frequent_value"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): one most frequent value per column, the least of those tied; a plain aggregate, without ordering all values."""
    best = F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best")
    return frequencies(df, columns).groupBy("column").agg(best).select("column", "best.value", (-F.col("best.m")).alias("n"))


def length_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, max and min length in characters of the values, taken as strings; columns without a value are left out."""
    length = lambda c: F.char_length(c.cast("string"))
    measures = {"mean_length": lambda c: F.avg(length(c)), "max_length": lambda c: F.max(length(c)), "min_length": lambda c: F.min(length(c))}
    return per_column(df, strings(df, columns), measures, "mean_length double, max_length int, min_length int").where("max_length is not null")


def sample_head(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first n rows in the order given; any n rows if none is."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def sample_tail(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The last n rows in the order given, ascending again; without an order the last rows of the last partitions."""
    if order_by:
        return df.orderBy(*(ref(c).desc_nulls_last() for c in order_by)).limit(n).orderBy(*order_by)
    return df.sparkSession.createDataFrame(df.tail(n), df.schema) if n else df.limit(0)


def entropy(df: DataFrame, columns: Sequence[str] | None = None, count_nulls: bool = False) -> DataFrame:
    """entropy in bits of the value frequencies, n (rows counted) and low_n (n < 30); columns without a value are left out."""
    names = strings(df, columns) if columns is None else every(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n bigint, entropy double, low_n boolean")
    total = F.sum("n").alias("n")
    bits = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    found = value_counts_of(df, names, count_nulls).groupBy("place").agg(total, F.greatest(bits, F.lit(0.0)).alias("entropy"))
    return places_of(df, names).join(F.broadcast(found), "place").select("column", "n", "entropy", (F.col("n") < 30).alias("low_n"))

"""Detectors of odd distributions and odd columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import BASE64, HEX, UUID, number_where
from ..plans.columns import as_text, complete_rows, every, numeric, ref, strings, value
from ..plans.fused import AGGREGATES_A_PASS, distinct_counts, frequencies, melted, per_column, quantiles
from .summaries import most_frequent


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population skewness (0 for constants), and the impact score that it earns: 0.6 above 1, 0.8 above 2."""
    g = lambda c: F.when(F.count(c) > 0, F.coalesce(F.when(F.var_pop(c) > 0, F.skewness(c)), F.lit(0.0)))
    found = per_column(df, numeric(df, columns), {"skewness": g}, "skewness double").where("skewness is not null")
    return found.withColumn("score", F.expr("case when abs(skewness) > 2 then 0.8D when abs(skewness) > 1 then 0.6D end"))


def outlier_bounds(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """lower and upper: quartiles less and plus `factor` times their distance."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    found = quantiles(df, numeric(df, columns), (0.25, 0.75), exact).where("n > 0")
    return found.select("column", (q1 - factor * (q3 - q1)).alias("lower"), (q3 + factor * (q3 - q1)).alias("upper"))


def outliers(df: DataFrame, columns: Sequence[str] | None = None, flag_threshold: float = 0.01, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """outlier_count, lower, upper, and flagged: more than flag_threshold of all rows, nulls among them, are outliers."""
    # the bounds, two numbers per column, are literals of the pass that counts
    bounds = [(r.column, r.lower, r.upper) for r in outlier_bounds(df, columns, factor, exact).collect()]
    parts = [df.sparkSession.createDataFrame([], "column string, outlier_count bigint, lower double, upper double, flagged boolean")]
    for k in range(0, len(bounds), AGGREGATES_A_PASS):
        some = bounds[k : k + AGGREGATES_A_PASS]
        wide = df.agg(F.count(F.lit(1)).alias("_n"), *(number_where((value(df, c) < F.lit(lo)) | (value(df, c) > F.lit(hi))).cast("long").alias(f"_{i}") for i, (c, lo, hi) in enumerate(some)))
        rows = (F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("outlier_count"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), (F.col(f"_{i}") > flag_threshold * F.col("_n")).alias("flagged")) for i, (c, lo, hi) in enumerate(some))
        parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.union, parts[1:] or parts)


def outlier_rows(df: DataFrame, column: str, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """The rows themselves that are outliers in one column."""
    b = outlier_bounds(df, [column], factor, exact).select(F.col("lower").alias("_lower"), F.col("upper").alias("_upper"))
    return df.join(F.broadcast(b), (ref(column) < F.col("_lower")) | (ref(column) > F.col("_upper"))).drop("_lower", "_upper")


def zeros(df: DataFrame, columns: Sequence[str] | None = None, flag_threshold: float = 0.95) -> DataFrame:
    """zero_count, zero_share of all rows, and whether it exceeds the threshold."""
    measures = {"zero_count": lambda c: number_where(c == 0), "_n": lambda c: F.count(F.lit(1))}
    found = per_column(df, numeric(df, columns), measures, "zero_count bigint, _n bigint").withColumn("zero_share", F.col("zero_count") / F.greatest("_n", F.lit(1)))
    return found.select("column", "zero_count", "zero_share", (F.col("zero_share") > flag_threshold).alias("flagged"))


def near_zero_variance(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1e-4, listwise: bool = True) -> DataFrame:
    """Columns whose sample variance is at most the threshold: std and variance, rounded to 8 digits. listwise: only rows without a null in any of the columns."""
    names = numeric(df, columns)
    rows = complete_rows(df, names) if listwise else df
    found = per_column(rows, names, {"std": F.stddev_samp, "variance": F.var_samp}, "std double, variance double").where(F.col("variance") <= threshold)
    return found.select("column", F.round("std", 8).alias("std"), F.round("variance", 8).alias("variance"))


def bimodal(df: DataFrame, columns: Sequence[str] | None = None, bic_threshold: float = 10.0, bins: int = 2048, iterations: int = 300) -> DataFrame:
    """bic1, bic2 and is_bimodal (bic1 - bic2 > threshold) of Gaussian mixtures with one and two components, for columns of 10 values or more that aren't constant.

    Values are counted in `bins` equal bins per column (two passes, a bounded result), and the mixture is fitted to the bins on the driver; it starts from quantiles, so it
    needs no random draws."""
    names = numeric(df, columns)
    spark = df.sparkSession
    out: list[tuple] = []
    if names:
        limits = per_column(df, names, {"n": F.count, "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")}, "n bigint, lo double, hi double").where("n >= 10 and hi > lo")
        rows = melted(df, names, lambda c: value(df, c), "double").where("value is not null").join(F.broadcast(limits), "column")
        place = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        cells = rows.groupBy("column", place.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("value").alias("x")).collect()  # at most bins rows a column
        for name in names:
            own = sorted((r.bin, r.k, r.x) for r in cells if r.column == name)
            if own:
                k, x = np.array([r[1] for r in own], float), np.array([r[2] for r in own])
                out.append((name, *_mixture_bics(x, k, iterations)))
    found = spark.createDataFrame([(c, float(a), float(b)) for c, a, b in out], "column string, bic1 double, bic2 double")
    return found.withColumn("is_bimodal", F.col("bic1") - F.col("bic2") > bic_threshold)


def _mixture_bics(x: np.ndarray, k: np.ndarray, iterations: int) -> tuple[float, float]:
    n = k.sum()
    mean = (k * x).sum() / n
    var = (k * (x - mean) ** 2).sum() / n
    floor = 1e-6 * var
    one = -n / 2 * (np.log(2 * np.pi * var) + 1)
    at = np.searchsorted(np.cumsum(k), [0.25 * n, 0.75 * n])
    m, v, w = x[np.minimum(at, len(x) - 1)].astype(float), np.array([var, var]) / 4 + floor, np.array([0.5, 0.5])
    if m[0] == m[1]:
        m = np.array([x[0], x[-1]], float)
    before = -np.inf
    for _ in range(iterations):
        logs = np.log(w) - 0.5 * (np.log(2 * np.pi * v) + (x[:, None] - m) ** 2 / v)
        top = logs.max(axis=1)
        total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
        two = (k * total).sum()
        if two - before < 1e-9 * abs(two):
            break
        before = two
        r = np.exp(logs - total[:, None]) * k[:, None]
        s = np.maximum(r.sum(axis=0), 1e-12)
        w, m = s / n, (r * x[:, None]).sum(axis=0) / s
        v = (r * (x[:, None] - m) ** 2).sum(axis=0) / s + floor
    return -2 * one + 2 * np.log(n), -2 * two + 5 * np.log(n)


def dominant_values(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """dominant_value and proportion of columns where one value makes up the threshold or more of all that aren't null."""
    names = every(df, columns)
    total = frequencies(df, names).groupBy("column").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best"))
    found = total.select("column", F.col("best.value").alias("dominant_value"), (-F.col("best.m") / F.col("t")).alias("proportion"))
    return found.where(F.col("proportion") >= threshold)


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with exactly one value; found without counting distinct values, by comparing the least with the greatest."""
    names = every(df, columns)
    plain = [c for c in names if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    found = per_column(df, plain, {"constant": lambda c: F.min(c) == F.max(c)}, "constant boolean").where("constant").select("column")
    rest = [c for c in names if c not in plain]
    return found.union(distinct_counts(df, rest).where("n_unique = 1").select("column")) if rest else found


def high_cardinality(df: DataFrame, columns: Sequence[str] | None = None, threshold: int = 50) -> DataFrame:
    """n_unique of columns with more than `threshold` values."""
    return distinct_counts(df, every(df, columns)).where(F.col("n_unique") > threshold)


def id_columns(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """Columns whose distinct values number at least `threshold` of the rows."""
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    found = distinct_counts(df, every(df, columns)).join(F.broadcast(rows)).where(F.col("n_unique") >= threshold * F.col("n_rows"))
    return found.where("n_rows > 0").select("column", "n_unique", "n_rows")


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: num_rows and duplicate_count, the rows beyond the first of their kind. Nulls equal each other."""
    names = every(df, columns)
    keys = df.select(*(as_text(df, c).alias(f"_{i}") for i, c in enumerate(names)))
    # rows are counted by a digest of 256 bits, so that wide rows don't travel
    digest = F.sha2(F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), f"_{i}"), F.lit("")) for i in range(len(names))))), 256)
    counted = keys.groupBy(digest.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b): pairs of columns of one type that agree in every row, null equal to null. A first pass compares one fingerprint per column; only columns whose fingerprints
    agree are compared value by value, in one pass."""
    names = [c for c in every(df, columns)]
    schema = "a string, b string"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    row = df.agg(*(F.bit_xor(F.xxhash64(as_text(df, c), F.lit(1))).alias(f"x{i}") for i, c in enumerate(names)), *(F.sum(F.hash(as_text(df, c)).cast("decimal(38,0)")).alias(f"s{i}") for i, c in enumerate(names))).first()
    prints = {c: (df.schema[c].dataType, row[f"x{i}"], row[f"s{i}"]) for i, c in enumerate(names)}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if prints[a] == prints[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    same = df.agg(*(F.bool_and(as_text(df, a).eqNullSafe(as_text(df, b))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(f"_{i}", F.lit(True)).alias("same")) for i, (a, b) in enumerate(pairs)))
    return same.select(F.inline(rows)).where("same").drop("same")


def encoded_columns(df: DataFrame, columns: Sequence[str] | None = None, min_entropy: float = 4.5, length_std_threshold: float = 2.0, base64: bool = True, hexadecimal: bool = True, uuid: bool = True, min_rows: int = 10) -> DataFrame:
    """String columns that look encoded: encoding (uuid, hex, base64 if all values match; else high_entropy for many different characters in values of like
    length), avg_length, length_std and entropy (bits of a character over all values)."""
    names = strings(df, columns)
    measures = {
        "n": F.count,
        "avg_length": lambda c: F.avg(F.char_length(c)),
        "length_std": lambda c: F.coalesce(F.stddev_samp(F.char_length(c)), F.lit(0.0)),
        "all_uuid": lambda c: F.bool_and(c.rlike(UUID)),
        "all_hex": lambda c: F.bool_and(c.rlike(HEX)),
        "all_base64": lambda c: F.bool_and(c.rlike(BASE64)),
    }
    base = per_column(df, names, measures, "n bigint, avg_length double, length_std double, all_uuid boolean, all_hex boolean, all_base64 boolean").where(F.col("n") >= min_rows)
    # characters are counted in the row before they travel: a map-side combine of at most the alphabet's size
    letters = melted(df, names).where("value is not null").select("column", F.explode(F.split("value", "")).alias("letter")).where("letter <> ''").groupBy("column", "letter").agg(F.count(F.lit(1)).alias("k"))
    bits = letters.groupBy("column").agg((F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")).alias("entropy"))
    cases = [(F.col("all_uuid") & uuid, "uuid"), (F.col("all_hex") & hexadecimal, "hex"), (F.col("all_base64") & base64, "base64"), ((F.col("entropy") > min_entropy) & (F.col("length_std") < length_std_threshold), "high_entropy")]
    kind = F.when(cases[0][0], cases[0][1])
    for test, name in cases[1:]:
        kind = kind.when(test, name)
    found = base.join(F.broadcast(bits), "column").withColumn("encoding", kind).where("encoding is not null")
    return found.select("column", "encoding", "avg_length", "length_std", "entropy")


def class_imbalance(df: DataFrame, target: str, threshold: float = 0.9) -> DataFrame:
    """One row: n, n_classes, majority_class (the least of those tied), majority_ratio (4 digits) and is_imbalanced (by the unrounded ratio)."""
    best = most_frequent(df, [target]).select("value", F.col("n").alias("top"))
    total = df.agg(F.count(ref(target)).alias("n"))
    classes = distinct_counts(df, [target]).select(F.col("n_unique").alias("n_classes"))
    one = total.join(F.broadcast(classes)).join(F.broadcast(best), F.lit(True), "left")
    ratio = F.coalesce(F.col("top") / F.col("n"), F.lit(0.0))
    return one.select("n", "n_classes", F.col("value").alias("majority_class"), F.round(ratio, 4).alias("majority_ratio"), (ratio >= threshold).alias("is_imbalanced"))

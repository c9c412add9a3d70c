"""Statistics of several columns at once. Pairwise measures of all pairs come from one aggregate (in passes of bounded width)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.columns import as_text, complete_rows, numeric, ref, strings, value
from ..plans.fused import distinct_counts, per_column, quantiles
from ..plans.pairs import pair_sums

PAIRS_A_PASS = 300


def _pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def correlations(df: DataFrame, columns: Sequence[str] | None = None, by_blocks: bool | None = None) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of numeric columns over the rows where both have a value; null if one is constant. Pairs that one aggregate can hold come from it; those of wider
    tables come from products of blocks (by_blocks: one or the other), also in one scan."""
    names = numeric(df, columns)
    pairs = _pairs(names)
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    if by_blocks or by_blocks is None and len(pairs) > PAIRS_A_PASS:
        return _correlations_by_blocks(df, names)

    def r(a: Column, b: Column) -> Column:
        both = a.isNotNull() & b.isNotNull()
        x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
        # corr itself fails on a constant where ANSI mode is on
        spread = F.var_pop(x) * F.var_pop(y)
        return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), F.sqrt(spread)))

    parts = []
    for k in range(0, len(pairs), PAIRS_A_PASS):
        some = pairs[k : k + PAIRS_A_PASS]
        wide = df.agg(*(r(value(df, a), value(df, b)).alias(f"_{i}") for i, (a, b) in enumerate(some)))
        parts.append(wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(some))))))
    return reduce(DataFrame.union, parts)


def _correlations_by_blocks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    # values are centred, so that sums of squares keep their digits; constants become 0
    ends = {r.column: r for r in per_column(df, names, {"m": F.avg, "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")}, "m double, lo double, hi double").collect()}
    middle = [(r.lo if r.lo == r.hi else r.m) or 0.0 for r in (ends[c] for c in names)]
    s = pair_sums(df, [value(df, c).cast("double") - F.lit(float(m)) for c, m in zip(names, middle)])
    rows = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            n, r = s["n"][i, j], None
            if n:
                x, y = s["x"][i, j] / n, s["x"][j, i] / n
                # a column that is constant where both have a value leaves nothing but rounding
                vx, vy = s["xx"][i, j] / n - x * x, s["xx"][j, i] / n - y * y
                if vx > 1e-14 * s["xx"][i, j] / n and vy > 1e-14 * s["xx"][j, i] / n:
                    r = float((s["xy"][i, j] / n - x * y) / np.sqrt(vx * vy))
            rows.append((a, names[j], r))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def data_leakage(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.99) -> DataFrame:
    """Pairs of numeric columns whose correlation reaches the threshold in size."""
    return correlations(df, columns).where(F.abs("r") >= threshold)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, n) of two columns' values where both have one."""
    return df.select(as_text(df, a).alias("x"), as_text(df, b).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None, columns: Sequence[str] | None = None, yates: bool = True) -> DataFrame:
    """(a, b, n, chi2, dof, v) of pairs of string columns. Chi-squared is summed over the cells that occur, since sum((o - e)^2 / e) = sum(o^2 / e) - n; only two-by-two tables, which
    are corrected after Yates, need their empty cells, and those follow from the margins."""
    pairs = list(pairs) if pairs is not None else _pairs(strings(df, columns))
    schema = "a string, b string, n bigint, chi2 double, dof bigint, v double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    # all tables are counted in one exchange, and the margins come from the counted cells
    rows = F.array(*(F.struct(F.lit(i).alias("p"), as_text(df, a).alias("x"), as_text(df, b).alias("y")) for i, (a, b) in enumerate(pairs)))
    cells = df.select(F.inline(rows)).where("x is not null and y is not null").groupBy("p", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    across, down = cells.groupBy("p", "x").agg(F.sum("n").alias("rx")), cells.groupBy("p", "y").agg(F.sum("n").alias("ry"))
    sums = cells.join(across, ["p", "x"]).join(down, ["p", "y"]).groupBy("p")
    sums = sums.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("rx") * F.col("ry"))).alias("s"), F.max(F.struct("x", "y", "n", "rx", "ry")).alias("last"))
    shape = across.groupBy("p").agg(F.count(F.lit(1)).alias("r")).join(F.broadcast(down.groupBy("p").agg(F.count(F.lit(1)).alias("k"))), "p")
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "p int, a string, b string")
    one = names.join(F.broadcast(sums.join(F.broadcast(shape), "p")), "p", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "r": F.coalesce("r", F.lit(0).cast("long")), "k": F.coalesce("k", F.lit(0).cast("long"))})
    n = F.col("n").cast("double")
    plain = n * (F.col("s") - 1)
    # in a two-by-two table all |o - e| are equal
    rx, ry = F.col("last.rx").cast("double"), F.col("last.ry").cast("double")
    d = F.abs(F.col("last.n") - rx * ry / n)
    d = d - F.least(F.lit(0.5), d) if yates else d
    square = d * d * n * n * n / (rx * (n - rx) * ry * (n - ry))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), square).when((F.col("r") < 2) | (F.col("k") < 2), F.lit(0.0)).otherwise(F.greatest(plain, F.lit(0.0)))
    least = F.least("r", "k") - 1
    v = F.when((n > 0) & (least > 0), F.sqrt(F.col("chi2") / n / least)).otherwise(F.lit(0.0))
    # without a row in common there is no table: 0 degrees of freedom
    dof = F.when(F.col("n") > 0, (F.col("r") - 1) * (F.col("k") - 1)).otherwise(F.lit(0)).cast("long")
    return one.withColumn("chi2", chi2).select("a", "b", "n", "chi2", dof.alias("dof"), v.alias("v"))


def gram(df: DataFrame, columns: Sequence[str] | None = None, by_blocks: bool | None = None) -> tuple[list[str], np.ndarray, int]:
    """Column names, X'X over rows without a null in any of them, and their number; a bounded result of one pass."""
    names = numeric(df, columns)
    if not names:
        return names, np.zeros((0, 0)), 0
    rows = complete_rows(df, names)
    k = len(names)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    if by_blocks or by_blocks is None and len(cells) > 2 * PAIRS_A_PASS:
        s = pair_sums(rows, [ref(c) for c in names])
        return names, s["xy"], int(s["n"][0, 0])
    g, n = np.zeros((k, k)), 0
    for at in range(0, len(cells), 2 * PAIRS_A_PASS):
        some = cells[at : at + 2 * PAIRS_A_PASS]
        row = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(ref(names[i]).cast("double") * ref(names[j]).cast("double")).alias(f"_{i}_{j}") for i, j in some)).first()
        n = row.n
        for i, j in some:
            g[i, j] = g[j, i] = row[f"_{i}_{j}"] or 0.0
    return names, g, n


def collinear_features(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 10.0) -> DataFrame:
    """(column, vif, flagged, score): variance inflation without intercept, from the inverse of X'X; infinite where the matrix is singular. Fewer than two columns: no rows."""
    names, g, n = gram(df, columns)
    rows: list[tuple] = []
    if len(names) >= 2 and n:
        scale = np.sqrt(np.diag(g))
        unit = g / np.maximum(np.outer(scale, scale), 1e-300)
        vif = np.full(len(names), np.inf)
        for i in range(len(names)):
            rest = [j for j in range(len(names)) if j != i and scale[j] > 0]
            if not scale[i]:
                vif[i] = 1.0
                continue
            beta, *_ = np.linalg.lstsq(unit[np.ix_(rest, rest)], unit[rest, i], rcond=1e-12)
            left = 1 - float(beta @ unit[rest, i])
            vif[i] = 1 / left if left > 1e-12 else np.inf
        rows = [(c, float(v), bool(v > threshold), (0.85 if v >= 15 else 0.75) if v > threshold else None) for c, v in zip(names, vif)]
    return df.sparkSession.createDataFrame(rows, "column string, vif double, flagged boolean, score double")


def encoding_suggestions(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None, low: int = 10, high: int = 50, correlation_threshold: float = 0.3) -> DataFrame:
    """(column, n_unique, target_correlation, suggestion): one-hot up to `low` values, frequency above; target encoding beside it if the label-encoded column correlates with a
    numeric target. Labels number the values in their order."""
    names = [c for c in strings(df, columns) if c != target]
    found = distinct_counts(df, names).withColumn("target_correlation", F.lit(None).cast("double"))
    if target is not None and target in numeric(df):
        parts = []
        for c in names:
            # per value: rows and moments of the target; the correlation then needs the values only, not the rows
            t = ref(target).cast("double")
            per = df.where(ref(c).isNotNull() & t.isNotNull()).groupBy(ref(c).alias("v")).agg(F.count(F.lit(1)).alias("k"), F.sum(t).alias("sy"), F.sum(t * t).alias("syy"))
            # the place of a value among all: that of its first letters, plus its own among those that begin alike; no task orders all values
            per = per.withColumn("head", F.substring("v", 1, 3))
            before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
            heads = per.groupBy("head").agg(F.count(F.lit(1)).alias("h")).select("head", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("base"))
            place = F.col("base") + F.row_number().over(Window.partitionBy("head").orderBy("v")) - 1
            coded = per.join(heads, "head").withColumn("x", place.cast("double"))
            s = coded.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("x")).alias("sx"), F.sum(F.col("k") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("sy")).alias("sxy"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
            cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
            spread = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
            parts.append(s.select(F.lit(c).alias("column"), F.when(spread > 0, cov / spread).alias("r")))
        if parts:
            found = found.drop("target_correlation").join(F.broadcast(reduce(DataFrame.union, parts)), "column", "left").withColumnRenamed("r", "target_correlation")
    basic = F.when(F.col("n_unique") <= low, "one-hot").when(F.col("n_unique") <= high, "frequency").otherwise("frequency (high-cardinality)")
    more = F.when(F.abs("target_correlation") > correlation_threshold, " + target encoding").otherwise("")
    return found.select("column", "n_unique", "target_correlation", F.concat(basic, more).alias("suggestion"))


def unbiased_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).when(n > 0, F.lit(0.0))


def reliability_flags(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per numeric column, over rows without a null in any of them: n_rows, low_row_count (< 30), mean, std, skew (bias-corrected), median, mad, extreme_outliers (a value more than three
    median deviations away), high_skew (above 2) and zero_variance."""
    names = numeric(df, columns)
    rows = complete_rows(df, names)
    measures = {"n_rows": F.count, "mean": F.avg, "std": F.stddev_samp, "skew": unbiased_skewness, "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")}
    base = per_column(rows, names, measures, "n_rows bigint, mean double, std double, skew double, lo double, hi double")
    median = quantiles(rows, names, (0.5,), exact).select("column", F.col("q")[0].alias("median"))
    # one number per column comes to the driver, so that the second pass has them as literals and the first isn't planned again inside it
    middle = {r.column: r.median for r in median.collect()}
    one = base.join(F.broadcast(df.sparkSession.createDataFrame(list(middle.items()), "column string, median double")), "column")
    away = rows.select(*(F.abs(ref(c).cast("double") - F.lit(middle[c])).alias(c) for c in names))
    mad = quantiles(away, names, (0.5,), exact).select("column", F.col("q")[0].alias("mad"))
    found = one.join(F.broadcast(mad), "column")
    far = F.greatest(F.col("hi") - F.col("median"), F.col("median") - F.col("lo"))
    spread = F.when(F.col("mad") == 0, F.lit(1e-8)).otherwise(F.col("mad"))
    return found.select(
        "column", "n_rows", (F.col("n_rows") < 30).alias("low_row_count"), "mean", "std", "skew", "median", "mad",
        F.coalesce(far / spread > 3, F.lit(False)).alias("extreme_outliers"), F.coalesce(F.abs("skew") > 2, F.lit(False)).alias("high_skew"), F.coalesce(F.col("std") < 1e-8, F.lit(False)).alias("zero_variance"),
    )


def reliability_warnings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(level, code, columns) that qualify correlations: low_row_count, zero_variance, extreme_outliers and high_skew (strong ones with _low_n on few rows)."""
    f = reliability_flags(df, columns)
    few = F.max(F.col("low_row_count").cast("int")) == 1
    rows = f.agg(
        few.alias("low"),
        *(F.sort_array(F.collect_list(F.when(F.col(x), F.col("column")))).alias(x) for x in ("zero_variance", "extreme_outliers", "high_skew")),
        F.sort_array(F.collect_list("column")).alias("all"),
    )
    entries = [
        F.struct(F.lit("strong").alias("level"), F.lit("low_row_count").alias("code"), F.when(F.col("low"), F.col("all")).alias("columns")),
        F.struct(F.lit("strong").alias("level"), F.lit("zero_variance").alias("code"), F.col("zero_variance").alias("columns")),
        *(F.struct(F.when(F.col("low"), "strong").otherwise("heuristic").alias("level"), F.when(F.col("low"), x + "_low_n").otherwise(x).alias("code"), F.col(x).alias("columns")) for x in ("extreme_outliers", "high_skew")),
    ]
    return rows.select(F.inline(F.array(*entries))).where("size(columns) > 0")


def binning_suggestions(df: DataFrame, columns: Sequence[str] | None = None, skew_threshold: float = 1.0) -> DataFrame:
    """(column, skew, suggestion): log-transform for a skew above the threshold, equal-width for a range above three deviations, else quantile; constants are left out."""
    names = numeric(df, columns)
    rows = complete_rows(df, names)
    measures = {"std": F.stddev_samp, "skew": unbiased_skewness, "range": lambda c: F.max(c).cast("double") - F.min(c).cast("double")}
    found = per_column(rows, names, measures, "std double, skew double, range double").where("std >= 1e-8")
    kind = F.when(F.col("skew") > skew_threshold, "log-transform").when(F.col("range") > 3 * F.col("std"), "equal-width").otherwise("quantile")
    return found.select("column", F.round("skew", 4).alias("skew"), kind.alias("suggestion"))

"""Drift between a table and a reference of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.tails import chi2_sf, ks_two_sample_p
from ..plans.columns import as_text, every, is_nested, numeric, value
from ..plans.fused import melted, per_column


def severity(value: Column, threshold: float) -> Column:
    return F.when(value < threshold, "low").when(value < 2 * threshold, "moderate").otherwise("high")


def _shared(df: DataFrame, reference: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return [c for c in every(df, columns) if c in reference.columns]


def _numeric(df: DataFrame, reference: DataFrame, columns: Sequence[str] | None) -> list[str]:
    there = set(numeric(reference))
    return [c for c in numeric(df, columns) if c in there]


def _values(df: DataFrame, reference: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value, cur, ref): how often each number occurs on both sides; counted before anything is ordered."""
    side = lambda t, c, r: melted(t, names, lambda x: value(t, x), "double").where("value is not null").select("column", "value", F.lit(c).alias("c"), F.lit(r).alias("r"))
    both = side(df, 1, 0).union(side(reference, 0, 1))
    return both.groupBy("column", "value").agg(F.sum("c").alias("cur"), F.sum("r").alias("ref"))


def psi(df: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None, bins: int = 10, density: bool = False) -> DataFrame:
    """(column, psi): population stability over equal bins of the joint range. density=True scales the proportions by the width of the bins. Empty bins count as 1e-6."""
    names = _numeric(df, reference, columns)
    counted = _values(df, reference, names)
    ends = counted.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("cur").alias("nc"), F.sum("ref").alias("nr")).where("nc > 0 and nr > 0")
    flat = F.col("lo") == F.col("hi")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    ends = ends.select("column", lo.alias("lo"), width.alias("w"), "nc", "nr").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    # (columns x bins) rows meet the counts of their bin
    limits = ends.where("bin = 0").select("column", "lo", "w")
    place = F.greatest(F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.lit(bins - 1)), F.lit(0)).cast("int")
    per = counted.join(F.broadcast(limits), "column").groupBy("column", place.alias("bin")).agg(F.sum("cur").alias("cur"), F.sum("ref").alias("ref"))
    all_bins = ends.join(per, ["column", "bin"], "left")
    scale = F.col("w") if density else F.lit(1.0)
    p = F.coalesce(F.col("ref"), F.lit(0)) / F.col("nr") / scale
    q = F.coalesce(F.col("cur"), F.lit(0)) / F.col("nc") / scale
    p, q = F.when(p == 0, 1e-6).otherwise(p), F.when(q == 0, 1e-6).otherwise(q)
    return all_bins.groupBy("column").agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))


def ks_statistics(df: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None, range_rows: int = 250_000, most_ranges: int = 20_000) -> DataFrame:
    """(column, d, n_ref, n_cur): the two-sample Kolmogorov-Smirnov statistic. Counts of values are dealt into ranges first, whose totals are summed up, so the running sums need the
    values of one range only. The number of ranges follows from the rows, range_rows in each, about."""
    names = _numeric(df, reference, columns)
    counted = _values(df, reference, names)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, d double, n_ref bigint, n_cur bigint")
    buckets = min(most_ranges, max(16, -(-(df.count() + reference.count()) // range_rows)))
    cuts = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    splits = counted.groupBy("column").agg(F.percentile_approx("value", cuts, 20 * buckets).alias("splits"), F.sum("cur").alias("nc"), F.sum("ref").alias("nr")).where("nc > 0 and nr > 0")
    dealt = counted.join(F.broadcast(splits), "column").withColumn("bucket", F.expr("size(filter(splits, x -> x < value))")).drop("splits")
    totals = dealt.groupBy("column", "bucket").agg(F.sum("cur").alias("c"), F.sum("ref").alias("r"))
    w = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("column", "bucket", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"), F.coalesce(F.sum("r").over(w), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ecdf = dealt.join(F.broadcast(base), ["column", "bucket"])
    gap = F.abs((F.col("c0") + F.sum("cur").over(inside)) / F.col("nc") - (F.col("r0") + F.sum("ref").over(inside)) / F.col("nr"))
    return ecdf.select("column", gap.alias("gap"), "nc", "nr").groupBy("column").agg(F.max("gap").alias("d"), F.first("nr").alias("n_ref"), F.first("nc").alias("n_cur"))


def category_drift(df: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, tvd, chi2, dof, goodness_chi2, goodness_dof, entropy_delta): total variation distance of the value shares; chi-squared of the contingency table, corrected after Yates at one degree
    of freedom; chi-squared of the
    current counts against the reference's scaled to the same total; difference of the entropies (natural logarithm, shares plus 1e-6)."""
    names = [c for c in _shared(df, reference, columns) if not isinstance(df.schema[c].dataType, T.NumericType) and not is_nested(df.schema[c].dataType)]
    side = lambda t, c, r: melted(t, names, lambda x: as_text(t, x)).where("value is not null").select("column", "value", F.lit(c).alias("c"), F.lit(r).alias("r"))
    counted = side(df, 1, 0).union(side(reference, 0, 1)).groupBy("column", "value").agg(F.sum("c").alias("cur"), F.sum("r").alias("ref"))
    totals = counted.groupBy("column").agg(F.sum("cur").alias("nc"), F.sum("ref").alias("nr"), F.count(F.lit(1)).alias("values")).where("nc > 0 and nr > 0")
    rows = counted.join(F.broadcast(totals), "column")
    p, q = F.col("ref") / F.col("nr"), F.col("cur") / F.col("nc")
    n = F.col("nc") + F.col("nr")
    ec, er = (F.col("cur") + F.col("ref")) * F.col("nc") / n, (F.col("cur") + F.col("ref")) * F.col("nr") / n
    away = F.abs(F.col("cur") - ec)  # on both sides alike
    away = F.when(F.col("values") == 2, away - F.least(F.lit(0.5), away)).otherwise(away)
    cell = away**2 / ec + away**2 / er
    expected = F.col("ref") * F.col("nc") / F.col("nr")
    goodness = F.when(F.col("ref") > 0, (F.col("cur") - expected) ** 2 / expected)
    bits = lambda x: -F.sum((x + 1e-6) * F.ln(x + 1e-6))
    return rows.groupBy("column").agg(
        (F.sum(F.abs(p - q)) / 2).alias("tvd"),
        F.sum(cell).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("dof"),
        # a value that the reference lacks can't be expected at all
        F.when(F.max(F.when(F.col("ref") == 0, 1)).isNotNull(), F.lit(float("inf"))).otherwise(F.sum(goodness)).alias("goodness_chi2"),
        (F.sum((F.col("ref") > 0).cast("int")) - 1).alias("goodness_dof"),
        F.abs(bits(q) - bits(p)).alias("entropy_delta"),
    )


def _threshold(options: Mapping, *names: str, default: float) -> float:
    return next((options[n] for n in names if options.get(n) is not None), default)


def feature_drift(df: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None, density: bool = False, **options) -> DataFrame:
    """(column, type, psi, ks_statistic, ks_p, tvd, chi2_p, severity, error) for the columns that both tables have. Options: psi (or psi_threshold) 0.1, tvd (or tvd_threshold) 0.2. p-values are
    computed on the driver from one row per column."""
    by_psi, by_tvd = _threshold(options, "psi", "psi_threshold", default=0.1), _threshold(options, "tvd", "tvd_threshold", default=0.2)
    names, numbers = _shared(df, reference, columns), _numeric(df, reference, columns)
    stats = {r.column: r for r in psi(df, reference, numbers, density=density).join(ks_statistics(df, reference, numbers), "column").collect()}
    cats = {r.column: r for r in category_drift(df, reference, names).collect()}
    rows = []
    for c in names:
        if c in stats:
            s = stats[c]
            rows.append((c, "numeric", s.psi, s.d, round(ks_two_sample_p(s.d, s.n_ref, s.n_cur), 4), None, None, _level(s.psi, by_psi), None))
        elif c in cats:
            s = cats[c]
            rows.append((c, "categorical", None, None, None, s.tvd, round(chi2_sf(s.chi2, s.dof), 4) if s.dof else 1.0, _level(s.tvd, by_tvd), None))
        else:
            why = "no values on one side" if c in numbers or not is_nested(df.schema[c].dataType) else f"type {df.schema[c].dataType.simpleString()} is not supported"
            rows.append((c, "unsupported", None, None, None, None, None, None, why))
    return df.sparkSession.createDataFrame(rows, "column string, type string, psi double, ks_statistic double, ks_p double, tvd double, chi2_p double, severity string, error string")


def _level(value: float, threshold: float) -> str:
    return "low" if value < threshold else "moderate" if value < 2 * threshold else "high"


def target_drift(df: DataFrame, reference: DataFrame, target: str, density: bool = False, **options) -> DataFrame:
    """One row on a target column: psi, ks_statistic and ks_p if it is numeric; else tvd, chi2_p (goodness of fit, the reference scaled to the current total) and entropy_delta; and drift: significant,
    moderate or none. No row if a side lacks the column or has no values. Options: psi 0.1, ks_pvalue 0.05, chi2_pvalue 0.05, entropy_delta 0.5."""
    by_psi, by_ks = _threshold(options, "psi", "psi_threshold", default=0.1), _threshold(options, "ks_pvalue", default=0.05)
    by_chi, by_entropy = _threshold(options, "chi2_pvalue", default=0.05), _threshold(options, "entropy_delta", default=0.5)
    rows = []
    if target in df.columns and target in reference.columns:
        if _numeric(df, reference, [target]):
            for s in psi(df, reference, [target], density=density).join(ks_statistics(df, reference, [target]), "column").collect():
                p = ks_two_sample_p(s.d, s.n_ref, s.n_cur)
                drift = "significant" if s.psi >= 0.25 or p < by_ks / 2 else "moderate" if s.psi >= by_psi or p < by_ks else "none"
                rows.append((target, "numeric", s.psi, s.d, p, None, None, None, drift))
        else:
            for s in category_drift(df, reference, [target]).collect():
                p = 0.0 if s.goodness_chi2 == float("inf") else chi2_sf(s.goodness_chi2, s.goodness_dof) if s.goodness_dof else 1.0
                e = s.entropy_delta
                drift = "significant" if p < by_chi / 2 or e > 2 * by_entropy else "moderate" if p < by_chi or e > by_entropy else "none"
                rows.append((target, "categorical", None, None, None, s.tvd, p, e, drift))
    return df.sparkSession.createDataFrame(rows, "column string, type string, psi double, ks_statistic double, ks_p double, tvd double, chi2_p double, entropy_delta double, drift string")

"""Operators over the results of others: data stage, quality score, recommendations, risks, run statistics."""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import every, numeric
from ..plans.fused import distinct_counts
from .summaries import null_counts


def infer_stage(df: DataFrame, raw_nulls: float = 0.4, ready_numeric: float = 0.7, ready_nulls: float = 0.05, clean_nulls: float = 0.1, clean_unique: int = 50) -> DataFrame:
    """One row: stage (raw, model_ready, cleaned, exploratory), mean_null_share, numeric_share, max_unique."""
    names = every(df)
    share = len(numeric(df)) / max(1, len(names))
    nulls = null_counts(df).agg(F.coalesce(F.avg("null_share"), F.lit(0.0)).alias("mean_null_share"))
    unique = distinct_counts(df, names).agg(F.coalesce(F.max("n_unique"), F.lit(0)).alias("max_unique"))
    n = F.col("mean_null_share")
    stage = (
        F.when(n > raw_nulls, "raw")
        .when((F.lit(share) >= ready_numeric) & (n < ready_nulls), "model_ready")
        .when((n < clean_nulls) & (F.col("max_unique") <= clean_unique), "cleaned")
        .otherwise("exploratory")
    )
    return nulls.join(F.broadcast(unique)).select(stage.alias("stage"), "mean_null_share", F.lit(share).alias("numeric_share"), "max_unique")


QUALITY_WEIGHTS = {"completeness": 0.3, "consistency": 0.2, "distribution": 0.2, "redundancy": 0.15, "drift": 0.15}


def quality_parts(null_shares: Sequence[float], inconsistent: int, skewed: int, zero_variance: bool, outliers: bool, redundant_pairs: int, drifted: int) -> dict[str, float]:
    """The five parts of the quality score, each from 0 to 100."""
    missing = sum(1 for s in null_shares if s > 0)
    return {
        "completeness": max(0.0, 100.0 - min(2 * missing, 50) - (10 if any(s > 0.3 for s in null_shares) else 0)),
        "consistency": max(0.0, 100.0 - 5 * inconsistent),
        "distribution": max(0.0, 100.0 - min(5 * skewed, 30) - 10 * zero_variance - 10 * outliers),
        "redundancy": 100.0 - min(2 * redundant_pairs, 30),
        "drift": 100.0 - min(5 * drifted, 30),
    }


def quality_score(df: DataFrame, reference: DataFrame | None = None, weights: Mapping[str, float] | None = None, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row: the five parts and overall, their rounded weighted mean. Built from the operators' own results: null shares, mixed types and format breaches, skew, variance and outliers, collinear
    and duplicate columns, drifted features (0 without a reference). Each contributes one row per column to the driver."""
    from .anomalies import duplicate_columns, skewness
    from .drift import feature_drift
    from .multivariate import collinear_features, reliability_flags
    from .schema import mixed_types, regex_violations

    weights = dict(QUALITY_WEIGHTS if weights is None else weights)
    shares = [r.null_share for r in null_counts(df).collect()]
    inconsistent = mixed_types(df).where("is_minority").select("column").distinct().count()
    inconsistent += regex_violations(df, patterns or {}).where("violations > 0").count()
    flags = reliability_flags(df).collect()
    skewed = skewness(df).where("abs(skewness) > 2").count()
    pairs = duplicate_columns(df).count() + collinear_features(df).where("flagged").count() // 2
    drifted = feature_drift(df, reference).where("severity in ('moderate', 'high')").count() if reference is not None else 0
    parts = quality_parts(shares, inconsistent, skewed, any(f.zero_variance for f in flags), any(f.extreme_outliers for f in flags), pairs, drifted)
    total = sum(weights.values()) or 1.0
    overall = round(sum(parts[k] * weights.get(k, 0) for k in parts) / total)
    return df.sparkSession.createDataFrame([(*parts.values(), int(overall))], ", ".join(f"{k} double" for k in parts) + ", overall bigint")


def bottlenecks(metrics: DataFrame, top_n: int = 5, slow: float = 5.0) -> DataFrame:
    """(task, seconds, slow): the longest tasks of a run, from (task, seconds) rows; seconds rounded to 4 digits."""
    return metrics.orderBy(F.desc("seconds"), "task").limit(top_n).select("task", F.round("seconds", 4).alias("seconds"), (F.col("seconds") > slow).alias("slow"))


def resource_usage(metrics: DataFrame, slow_total: float = 30.0, slow_mean: float = 5.0) -> DataFrame:
    """One row: task_count, total_seconds (2 digits), mean_seconds (4 digits), and whether either is slow."""
    total, mean = F.coalesce(F.sum("seconds"), F.lit(0.0)), F.coalesce(F.avg("seconds"), F.lit(0.0))
    return metrics.agg(F.count(F.lit(1)).alias("task_count"), F.round(total, 2).alias("total_seconds"), F.round(mean, 4).alias("mean_seconds"), (total > slow_total).alias("slow_total"), (mean > slow_mean).alias("slow_mean"))


def top_risks(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Results that bear an impact score, the highest first; ties by task."""
    out = scored.where("score is not null").orderBy(F.desc("score"), "task")
    return out.limit(n) if n is not None else out


#: What the impact of a finding is taken to be, from 0 to 1.
IMPACT = {
    "detect_constant_columns": 1.0, "detect_data_leakage": 1.0, "detect_encoded_columns": 0.9, "detect_duplicate_columns": 0.85, "detect_near_zero_variance": 0.85,
    "detect_collinear_features": 0.75, "detect_class_imbalance": 0.8, "detect_target_drift": 0.8, "detect_skewness": 0.6, "suggest_categorical_encoding": 0.6,
    "detect_feature_drift": 0.7, "detect_high_cardinality": 0.7, "detect_outliers": 0.7, "detect_mixed_type_columns": 0.6, "suggest_numerical_binning": 0.6,
}

#: (tasks that it applies to, condition over the task's figures, recommendation); the first that holds is taken.
RULES = [
    (("detect_skewness",), "max_abs_skew > 2", "Transform strongly skewed columns, by a logarithm or a power, before fitting linear models."),
    (("detect_skewness",), "max_abs_skew > 1", "Consider a transformation of skewed columns."),
    (("detect_outliers",), "n_flagged > 0", "Look at the flagged outliers; cap or model them apart if they are errors."),
    (("detect_class_imbalance",), "majority_ratio >= 0.9", "Weigh classes or resample, and judge models by more than accuracy."),
    (("detect_collinear_features",), "max_vif >= 10", "Drop or combine collinear columns, or use a penalised model."),
    (("detect_constant_columns",), "n_columns > 0", "Drop constant columns; they carry no information."),
    (("detect_high_cardinality",), "n_columns > 0", "Group rare values or encode by frequency."),
    (("summarize_nulls",), "n_high_null > 0", "Impute or drop columns that are mostly missing."),
    (("detect_feature_drift", "detect_target_drift"), "n_drifted > 0", "Check the pipeline for a change at the source, and retrain if the drift is real."),
    (("detect_duplicates",), "duplicate_count > 0", "Remove duplicate rows before splitting the data."),
]

_OPERATORS = {ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def holds(condition: str, figures: Mapping) -> bool:
    """Whether a condition of comparisons, and, or, not over names and literals holds. Nothing else is evaluated; what can't be evaluated doesn't hold."""

    def value(node: ast.AST):
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            return figures[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return not value(node.operand)
        if isinstance(node, ast.BoolOp):
            parts = (bool(value(v)) for v in node.values)
            return all(parts) if isinstance(node.op, ast.And) else any(parts)
        if isinstance(node, ast.Compare):
            left = value(node.left)
            for op, right in zip(node.ops, node.comparators):
                right = value(right)
                if type(op) not in _OPERATORS or not _OPERATORS[type(op)](left, right):
                    return False
                left = right
            return True
        raise ValueError(ast.dump(node))

    try:
        return bool(value(ast.parse(condition, mode="eval").body))
    except (ValueError, KeyError, TypeError, SyntaxError):
        return False


def recommendation(task: str, figures: Mapping, rules=RULES) -> str | None:
    """The first rule's text that applies to the task and whose condition holds."""
    return next((text for tasks, condition, text in rules if task in tasks and holds(condition, figures)), None)


def unmet_conditions(figures_by_task: Mapping[str, Sequence[str]], rules=RULES) -> list[tuple[str, str]]:
    """(task, name) for each name that a rule's condition reads but the task doesn't give: an audit of rules against tasks."""
    out = []
    for tasks, condition, _ in rules:
        names = {n.id for n in ast.walk(ast.parse(condition, mode="eval")) if isinstance(n, ast.Name)}
        out += [(t, n) for t in tasks for n in sorted(names) if n not in figures_by_task.get(t, ())]
    return out

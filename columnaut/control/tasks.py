"""The built-in tasks: each puts an operator's plan into a result and draws the few figures that rules and scores need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomalies, drift, meta, multivariate, schema, summaries
from ..operators.meta import IMPACT, recommendation
from . import registry
from .registry import register_task
from .results import TaskResult


def _count(frame: DataFrame, condition: str = "true") -> int:
    return frame.where(condition).count()


#: Results up to so many rows are run once and kept, since figures, scores and reports look at them several times.
SETTLED_ROWS = 1000


def _settled(frame: DataFrame) -> DataFrame:
    rows = frame.limit(SETTLED_ROWS + 1).collect()
    return frame if len(rows) > SETTLED_ROWS else frame.sparkSession.createDataFrame(rows, frame.schema)


def _task(name: str, build, figures=None, finds=None, **spec):
    """Register a task. build(context): the frame. figures(frame, context): numbers for the rules. finds(figures): whether the finding counts for the impact score."""

    def run(context) -> TaskResult:
        frame = build(context)
        if frame is None:
            return TaskResult(name, "skipped", "nothing to look at with these settings")
        result = TaskResult(name, frame=_settled(frame))
        frame = result.frame
        if figures:
            result.figures = figures(frame, context)
            result.summary = ", ".join(f"{k} = {v}" for k, v in result.figures.items())
            advice = recommendation(name, result.figures)
            if finds and name in IMPACT and finds(result.figures) and context.option("enable_impact_scoring", True):
                score = finds(result.figures)
                result.signal(IMPACT[name] if score is True else float(score), spec.get("tags", []), advice)
            elif advice:
                result.recommendations.append(advice)
        return result

    run.__name__ = name
    run.__doc__ = spec.pop("about", name.replace("_", " ").capitalize() + ".")
    register_task(name, **spec)(run)


def _of_type(context, *kinds: str) -> list[str]:
    return [c for c, k in context.semantic_types().items() if k in kinds]


_AFTER = {"depends_on": ["infer_types"]}
_n = lambda frame, context: {"n_columns": frame.count()}

_task("infer_types", lambda x: x.typed(), depth="basic", stage="raw", tags=["schema"], about="Storage and semantic type of every column.")
_task("schema_validation", lambda x: schema.validate_schema(x.df, x.contract()) if x.contract() else None, lambda f, x: {"n_breaches": f.count()}, depth="full", stage="raw", tags=["schema"], about="Breaches of a declared contract.")
_task("compare_with_reference_dataset", lambda x: x.reference and schema.compare_tables(x.df, x.reference, **x.params("compare_with_reference_dataset", missing_pct_threshold="missing_threshold", unique_count_ratio_threshold="unique_threshold", minmax_numeric_tolerance="minmax_tolerance")), lambda f, x: {"n_changed": _count(f, "change <> 'shared' or missing_flag or unique_flag or minmax_flag")}, depth="basic", stage="raw", tags=["drift"], **_AFTER)
_task("check_datetime_consistency", lambda x: schema.datetime_consistency(x.df, _of_type(x, "datetime")), depth="standard", stage="raw", tags=["schema"], **_AFTER)
_task("detect_mixed_type_columns", lambda x: schema.mixed_types(x.df, **x.params("detect_mixed_type_columns")), lambda f, x: {"n_columns": f.where("is_minority").select("column").distinct().count()}, lambda g: g["n_columns"] > 0, depth="standard", stage="cleaned", tags=["schema"], **_AFTER)
_task("detect_regex_format_violations", lambda x: schema.regex_violations(x.df, x.params("detect_regex_format_violations").get("custom_patterns") or {}), lambda f, x: {"n_columns": _count(f, "violations > 0")}, depth="full", stage="cleaned", tags=["format"], **_AFTER)
_task("detect_out_of_bounds", lambda x: schema.out_of_bounds(x.df, x.params("detect_out_of_bounds").get("custom_bounds")), _n, depth="standard", stage="cleaned", tags=["range"], **_AFTER)


def _coverage(x):
    rows = [(w["plugin"], w["warning"]) for w in registry.PLUGIN_WARNINGS]
    return x.df.sparkSession.createDataFrame(rows, "plugin string, warning string")


_task("validate_plugin_coverage", _coverage, depth="basic", domain="core", tags=["plugins"], about="Plugin files that registered nothing.")

_task("summarize_dataset_shape", lambda x: summaries.dataset_shape(x.df), depth="basic", stage="raw", tags=["summary"], **_AFTER)
_task("summarize_nulls", lambda x: summaries.null_counts(x.df, threshold=x.param("summarize_nulls", "null_threshold", 0.5)), lambda f, x: {"n_high_null": _count(f, "high_null")}, depth="basic", stage="raw", tags=["nulls"], **_AFTER)
_task("summarize_numeric", lambda x: summaries.summarize_numeric(x.df, exact=x.option("exact_quantiles", True)), depth="basic", stage="cleaned", tags=["summary"], **_AFTER)
_task("summarize_unique", lambda x: summaries.unique_counts(x.df), depth="basic", stage="raw", tags=["cardinality"], **_AFTER)
_task("summarize_modes", lambda x: summaries.modes(x.df), depth="standard", stage="cleaned", tags=["summary"], **_AFTER)
_task("summarize_value_counts", lambda x: summaries.value_counts(x.df, top_k=x.param("summarize_value_counts", "top_k", 5)), depth="basic", stage="cleaned", tags=["summary"], **_AFTER)
_task("summarize_boolean_fields", lambda x: summaries.boolean_fields(x.df), depth="basic", stage="cleaned", tags=["summary"], **_AFTER)
_task("summarize_text_fields", lambda x: summaries.text_fields(x.df), depth="standard", stage="cleaned", tags=["text"], **_AFTER)
_task("categorical_length_stats", lambda x: summaries.length_stats(x.df, _of_type(x, "categorical", "text")), depth="standard", stage="cleaned", tags=["text"], **_AFTER)
_task("sample_head", lambda x: summaries.sample_head(x.df, x.param("sample_head", "n", 5), x.order()), depth="basic", stage="raw", tags=["sample"], **_AFTER)
_task("sample_tail", lambda x: summaries.sample_tail(x.df, x.param("sample_tail", "n", 5), x.order()), depth="basic", stage="raw", tags=["sample"], **_AFTER)
_task("missingness_heatmap", lambda x: summaries.missing_cells(x.df), depth="standard", stage="report", tags=["nulls"], **_AFTER)
_task("missingness_matrix", lambda x: summaries.missing_together(x.df), depth="standard", stage="report", tags=["nulls"], **_AFTER)
_task("compute_entropy", lambda x: summaries.entropy(x.df, _of_type(x, "categorical", "text")), depth="full", stage="cleaned", runtime="moderate", tags=["summary"], **_AFTER)


def _skewed(x):
    chosen = _of_type(x, "continuous")
    return anomalies.skewness(x.df, chosen or None)


def _max_skew(frame, context):
    return {"max_abs_skew": float(frame.agg(F.max(F.abs("skewness"))).first()[0] or 0.0)}


_task("detect_skewness", _skewed, _max_skew, lambda g: 0.8 if g["max_abs_skew"] > 2 else 0.6 if g["max_abs_skew"] > 1 else 0, depth="standard", stage="cleaned", tags=["distribution"], **_AFTER)
_task("detect_outliers", lambda x: anomalies.outliers(x.df, flag_threshold=x.param("detect_outliers", "flag_threshold", 0.01), exact=x.option("exact_quantiles", True)), lambda f, x: {"n_flagged": _count(f, "flagged")}, lambda g: g["n_flagged"] > 0, depth="full", stage="cleaned", runtime="moderate", tags=["outliers"], **_AFTER)
_task("detect_zeros", lambda x: anomalies.zeros(x.df, flag_threshold=x.param("detect_zeros", "flag_threshold", 0.95)), depth="basic", stage="cleaned", tags=["distribution"], **_AFTER)
_task("detect_near_zero_variance", lambda x: anomalies.near_zero_variance(x.df, threshold=x.param("detect_near_zero_variance", "threshold", 1e-4)), _n, lambda g: g["n_columns"] > 0, depth="standard", stage="modeling", tags=["variance"], **_AFTER)
_task("detect_bimodal_distribution", lambda x: anomalies.bimodal(x.df, bic_threshold=x.param("detect_bimodal_distribution", "bic_threshold", 10)), depth="full", stage="cleaned", runtime="moderate", tags=["distribution"], **_AFTER)
_task("detect_single_dominant_value", lambda x: anomalies.dominant_values(x.df, threshold=x.param("detect_single_dominant_value", "dominance_threshold", 0.95)), _n, depth="basic", stage="raw", tags=["distribution"], **_AFTER)
_task("detect_constant_columns", lambda x: anomalies.constant_columns(x.df), _n, lambda g: g["n_columns"] > 0, depth="basic", stage="raw", tags=["redundancy", "drop"], **_AFTER)
_task("detect_high_cardinality", lambda x: anomalies.high_cardinality(x.df, threshold=x.param("detect_high_cardinality", "cardinality_threshold", 50)), _n, lambda g: g["n_columns"] > 0, depth="standard", stage="cleaned", tags=["cardinality"], **_AFTER)
_task("detect_id_columns", lambda x: anomalies.id_columns(x.df, threshold=x.param("detect_id_columns", "threshold_ratio", 0.95)), depth="standard", stage="raw", tags=["identifiers"], **_AFTER)
_task("detect_duplicates", lambda x: anomalies.duplicate_rows(x.df), lambda f, x: {"duplicate_count": f.first().duplicate_count}, depth="basic", stage="raw", tags=["redundancy"], **_AFTER)
_task("detect_duplicate_columns", lambda x: anomalies.duplicate_columns(x.df), lambda f, x: {"n_pairs": f.count()}, lambda g: g["n_pairs"] > 0, depth="standard", stage="raw", tags=["redundancy"], **_AFTER)
_task("detect_encoded_columns", lambda x: anomalies.encoded_columns(x.df, **x.params("detect_encoded_columns", detect_base64="base64", detect_hex="hexadecimal", detect_uuid="uuid")), _n, lambda g: g["n_columns"] > 0, depth="standard", stage="cleaned", tags=["format"], **_AFTER)


def _target(x, task: str) -> str | None:
    t = x.param(task, "target_column", None) or x.param(task, "target", None) or x.option("target_column", None)
    return t if t in x.df.columns else None


_task("detect_class_imbalance", lambda x: anomalies.class_imbalance(x.df, _target(x, "detect_class_imbalance"), x.param("detect_class_imbalance", "imbalance_ratio_threshold", 0.9)) if _target(x, "detect_class_imbalance") else None, lambda f, x: (lambda r: {"majority_ratio": r.majority_ratio, "is_imbalanced": r.is_imbalanced})(f.first()), lambda g: g["is_imbalanced"], depth="standard", stage="modeling", tags=["target"], **_AFTER)

_task("compute_correlations", lambda x: multivariate.correlations(x.df), depth="full", stage="cleaned", runtime="moderate", tags=["correlation"], **_AFTER)
_task("compute_category_associations", lambda x: multivariate.cramers_v(x.df, columns=_of_type(x, "categorical")), depth="full", stage="cleaned", runtime="moderate", tags=["correlation"], about="Cramer's V of categorical columns.", **_AFTER)
_task("detect_collinear_features", lambda x: multivariate.collinear_features(x.df, threshold=x.param("detect_collinear_features", "vif_threshold", 10)), lambda f, x: {"max_vif": float(f.agg(F.max("vif")).first()[0] or 0.0)}, lambda g: 0.85 if g["max_vif"] >= 15 else 0.75 if g["max_vif"] >= 10 else 0, depth="full", stage="modeling", runtime="slow", tags=["redundancy"], **_AFTER)
_task("detect_data_leakage", lambda x: multivariate.data_leakage(x.df, threshold=x.param("detect_data_leakage", "correlation_threshold", 0.99)), lambda f, x: {"n_pairs": f.count()}, lambda g: g["n_pairs"] > 0, depth="full", stage="modeling", runtime="moderate", tags=["leakage"], **_AFTER)


def _encoding(x):
    p = x.params("suggest_categorical_encoding", low_cardinality_threshold="low", high_cardinality_threshold="high", target_column="target")
    p["target"] = _target(x, "suggest_categorical_encoding")
    return multivariate.encoding_suggestions(x.df, **p)


_task("suggest_categorical_encoding", _encoding, lambda f, x: {"n_high": _count(f, "suggestion like '%high-card%'"), "n_columns": f.count()}, lambda g: 0.8 if g["n_high"] else 0.6 if g["n_columns"] else 0, depth="standard", stage="modeling", tags=["encoding"], **_AFTER)
_task("suggest_numerical_binning", lambda x: multivariate.binning_suggestions(x.df, **x.params("suggest_numerical_binning")), _n, lambda g: g["n_columns"] > 0, depth="standard", stage="modeling", tags=["binning"], **_AFTER)
_task("detect_feature_drift", lambda x: x.reference and drift.feature_drift(x.df, x.reference, **x.params("detect_feature_drift")), lambda f, x: {"n_drifted": _count(f, "severity in ('moderate', 'high')")}, lambda g: g["n_drifted"] > 0, depth="full", stage="cleaned", runtime="slow", tags=["drift"], **_AFTER)


def _target_drift(x):
    t = _target(x, "detect_target_drift")
    p = {k: v for k, v in x.params("detect_target_drift").items() if k not in ("target", "target_column")}
    return drift.target_drift(x.df, x.reference, t, **p) if x.reference and t else None


_task("detect_target_drift", _target_drift, lambda f, x: {"n_drifted": _count(f, "drift <> 'none'")}, lambda g: g["n_drifted"] > 0, depth="full", stage="cleaned", runtime="slow", tags=["drift", "target"], **_AFTER)
_task("data_quality_scorer", lambda x: meta.quality_score(x.df, x.reference, x.params("data_quality_scorer").get("weights"), x.params("detect_regex_format_violations").get("custom_patterns")), lambda f, x: f.first().asDict(), depth="basic", stage="report", tags=["score"], depends_on=["infer_types"], last=True)
_task("identify_bottleneck_tasks", lambda x: meta.bottlenecks(x.timings(), x.param("identify_bottleneck_tasks", "top_n", 5)) if x.seconds else None, lambda f, x: {"n_slow": _count(f, "slow")}, depth="full", tags=["diagnostic"], last=True)
_task("log_resource_usage", lambda x: meta.resource_usage(x.timings()) if x.seconds else None, lambda f, x: f.first().asDict(), depth="full", tags=["diagnostic"], last=True)
DIAGNOSTIC = ("identify_bottleneck_tasks", "log_resource_usage")

"""All queries of the profiling library, each with its SQL for DuckDB where SQL can express it. Queries run over whole tables; results are rounded so that the order of summation doesn't show."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .control.engine import profile
from .operators import anomalies, drift, meta, multivariate, plots, schema, summaries
from .sources.readers import Datasets, read_table, sample_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


#: events with nulls put in, the same on both sides.
EVENTS = "SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 2 END AS flag FROM events"
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HALF_NOW, HALF_THEN = "ts >= TIMESTAMP '2024-01-16'", "ts < TIMESTAMP '2024-01-16'"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id", "user_id", "nullif(event_type, 'error') as event_type", "case when event_id % 7 = 0 then null else value end as value", "case when event_id % 3 = 0 then null else user_id % 2 end as flag")


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf, "events").select("ts", "user_id", "event_type", "value")
    return t.where(HALF_NOW), t.where(HALF_THEN)


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


# --- summaries ---------------------------------------------------------------------------------------------------------------------------------

_NUMERIC = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) + 0.0 AS min,
    round(quantile_cont({c}::DOUBLE, 0.01), 4) AS p1, round(quantile_cont({c}::DOUBLE, 0.05), 4) AS p5, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
    round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(quantile_cont({c}::DOUBLE, 0.95), 4) AS p95, round(quantile_cont({c}::DOUBLE, 0.99), 4) AS p99,
    round(max({c})::DOUBLE, 4) AS max, var_pop({c}) < 1e-4 AS near_zero_variance FROM lineitem"""


@query("summarize_numeric", union(*(_NUMERIC.format(c=c) for c in LINE)))
def _(spark, sf):
    return rounded(summaries.summarize_numeric(table(spark, sf, "lineitem"), LINE), 4, "mean", "std", "min", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "max")


@query("summarize_numeric_approx")
def _(spark, sf):
    return summaries.summarize_numeric(table(spark, sf, "lineitem"), LINE, exact=False)


@query("dataset_shape", f"WITH e AS ({EVENTS}) SELECT count(*) AS num_rows, 5::BIGINT AS num_columns, round((count(*) * 3 - count(event_type) - count(value) - count(flag)) / (5.0 * count(*))::DOUBLE, 4) AS null_cell_share FROM e")
def _(spark, sf):
    return summaries.dataset_shape(events(spark, sf)).drop("approx_memory_mb")  # an estimate of the optimizer


@query(
    "summarize_nulls",
    f"WITH e AS ({EVENTS}) "
    + union(*(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_share, (count(*) - count({c})) / count(*)::DOUBLE >= 0.3 AS high_null FROM e""" for c in ("event_id", "user_id", "event_type", "value", "flag"))),
)
def _(spark, sf):
    return rounded(summaries.null_counts(events(spark, sf), threshold=0.3), 6, "null_share")


@query("null_patterns", f"WITH e AS ({EVENTS}) SELECT concat('00', (event_type IS NULL)::INT, (value IS NULL)::INT, (flag IS NULL)::INT) AS pattern, count(*) AS n FROM e GROUP BY 1")
def _(spark, sf):
    return summaries.null_patterns(events(spark, sf))


@query("missingness_heatmap", f"WITH e AS ({EVENTS}) SELECT (count(*) * 3 - count(event_type) - count(value) - count(flag))::BIGINT AS missing_cells FROM e")
def _(spark, sf):
    return summaries.missing_cells(events(spark, sf))


@query(
    "missingness_matrix",
    f"WITH e AS ({EVENTS}) " + union(*(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS n FROM e" for a, b in (("event_type", "value"), ("event_type", "flag"), ("value", "flag")))),
)
def _(spark, sf):
    return plots.missingness_matrix(events(spark, sf), ["event_type", "value", "flag"])


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("summarize_unique", union(*(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM customer""" for c in _CUSTOMER)))
def _(spark, sf):
    return summaries.unique_counts(table(spark, sf, "customer"))


_PART = ("p_name", "p_brand", "p_type", "p_size")


def _counts_sql(t: str, cols) -> str:
    return union(*(f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n FROM {t} GROUP BY ALL""" for c in cols))


@query("summarize_modes", f"""WITH f AS ({_counts_sql("part", _PART)}) SELECT "column", value, n FROM (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY n DESC) AS r FROM f) WHERE r = 1""")
def _(spark, sf):
    return summaries.modes(table(spark, sf, "part"), _PART)


@query("summarize_value_counts", f"""WITH e AS ({EVENTS}), f AS ({_counts_sql("e", ("event_type", "flag"))}) SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS r FROM f) WHERE r <= 3""")
def _(spark, sf):
    return summaries.value_counts(events(spark, sf), ["event_type", "flag"], top_k=3)


@query(
    "summarize_boolean_fields",
    f"WITH e AS ({EVENTS}) SELECT 'flag' AS \"column\", round(count(*) FILTER (flag = 1) / count(*)::DOUBLE, 6) AS pct_true, round(count(*) FILTER (flag = 0) / count(*)::DOUBLE, 6) AS pct_false, round(count(*) FILTER (flag IS NULL) / count(*)::DOUBLE, 6) AS pct_null FROM e",
)
def _(spark, sf):
    return rounded(summaries.boolean_fields(events(spark, sf)), 6, "pct_true", "pct_false", "pct_null")


_TEXT = r"""SELECT '{c}' AS "column", round(avg(length({c})), 6) AS avg_char_length, round(avg(len(regexp_extract_all({c}, '[^\t\n\x0B\f\r ]+'))), 6) AS avg_word_count,
    round(sum(length({c})) / sum(len(regexp_extract_all({c}, '[^\t\n\x0B\f\r ]+')))::DOUBLE, 6) AS avg_word_length, sum(length({c}))::BIGINT AS total_chars,
    bool_or(regexp_matches({c}, '[^\pL\pM\pN_\s]')) AS contains_symbols,
    (SELECT {c} FROM documents GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS most_frequent_value FROM documents"""


@query("summarize_text_fields", union(*(_TEXT.format(c=c) for c in ("text", "lang", "source"))))
def _(spark, sf):
    return rounded(summaries.text_fields(table(spark, sf, "documents"), ["text", "lang", "source"]), 6, "avg_char_length", "avg_word_count", "avg_word_length")


@query("categorical_length_stats", union(*(f"""SELECT '{c}' AS "column", round(avg(length({c})), 6) AS mean_length, max(length({c}))::INT AS max_length, min(length({c}))::INT AS min_length FROM documents""" for c in ("text", "lang", "source"))))
def _(spark, sf):
    return rounded(summaries.length_stats(table(spark, sf, "documents")), 6, "mean_length")


@query("sample_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, sf):
    return summaries.sample_head(table(spark, sf, "orders"), 5, ["o_orderkey"])


@query("sample_tail", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def _(spark, sf):
    return summaries.sample_tail(table(spark, sf, "orders"), 5, ["o_orderkey"])


@query("compute_entropy", f"""WITH e AS ({EVENTS}), f AS ({_counts_sql("e", ("event_type", "flag"))}), g AS (SELECT * FROM f WHERE value IS NOT NULL) SELECT "column", sum(n)::BIGINT AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, sum(n) < 30 AS low_n FROM g GROUP BY 1""")
def _(spark, sf):
    return rounded(summaries.entropy(events(spark, sf), ["event_type", "flag"]), 6, "entropy")


# --- types, contracts, formats -------------------------------------------------------------------------------------------------------------------


def _typed(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "value", "event_type", "ts", "cast(to_date(ts) as string) as day", "md5(cast(event_id as string)) as digest", "user_id % 2 as parity", "cast(null as string) as nothing", "event_id % 5 = 0 as fifth", "repeat('abc def ', cast(5 + event_id % 5 as int)) as phrase")


@query(
    "infer_types",
    "SELECT * FROM (VALUES ('event_id', 'bigint', 'continuous'), ('value', 'double', 'continuous'), ('event_type', 'string', 'categorical'), ('ts', (SELECT CASE WHEN true THEN 'timestamp_ntz' END), 'datetime'), ('day', 'string', 'datetime'), ('digest', 'string', 'id'), ('parity', 'bigint', 'categorical'), ('nothing', 'string', 'unknown'), ('fifth', 'boolean', 'categorical'), ('phrase', 'string', 'text')) t(\"column\", storage_type, semantic_type)",
)
def _(spark, sf):
    return schema.infer_types(_typed(spark, sf))


_CONTRACT = {
    "required_columns": ["o_orderkey", "o_comment"],
    "dtypes": {"o_orderkey": "int64", "o_totalprice": "int", "o_orderstatus": "str"},
    "value_ranges": {"o_totalprice": {"min": 1000, "max": 300000}},
    "categories": {"o_orderstatus": ["F", "O"]},
}


@query(
    "schema_validation",
    """SELECT 'required_columns' AS "check", 'o_comment' AS "column", 'missing' AS detail, NULL::BIGINT AS n
    UNION ALL SELECT 'dtypes', 'o_totalprice', 'expected int, found double', NULL
    UNION ALL SELECT 'value_ranges', 'o_totalprice', '< 1000', count(*) FILTER (o_totalprice < 1000) FROM orders HAVING count(*) FILTER (o_totalprice < 1000) > 0
    UNION ALL SELECT 'value_ranges', 'o_totalprice', '> 300000', count(*) FILTER (o_totalprice > 300000) FROM orders HAVING count(*) FILTER (o_totalprice > 300000) > 0
    UNION ALL SELECT 'categories', 'o_orderstatus', coalesce(o_orderstatus, 'null'), count(*) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O') GROUP BY 3""",
)
def _(spark, sf):
    return schema.validate_schema(table(spark, sf, "orders"), _CONTRACT)


def _side(c: str, where: str, number: bool) -> str:
    ends = f"min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi" if number else "NULL::DOUBLE AS lo, NULL::DOUBLE AS hi"
    return f"SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing, count(DISTINCT {c}) AS u, {ends} FROM (SELECT *, ts::DATE AS day FROM events) WHERE {where}"


_COMPARED = [("user_id", True, "bigint"), ("event_type", False, "string"), ("value", True, "double"), ("day", False, "date")]


@query(
    "compare_with_reference_dataset",
    union(
        *(
            f"""SELECT '{c}' AS "column", 'shared' AS change, '{kind}' AS type, '{kind}' AS ref_type, round(abs(a.missing - b.missing), 4) AS missing_diff, abs(a.missing - b.missing) > 0.3 AS missing_flag, round(b.missing, 4) AS ref_missing,
        round(greatest(abs(a.lo - b.lo) / (abs(b.lo) + 1e-6), abs(a.hi - b.hi) / (abs(b.hi) + 1e-6)), 4) AS minmax_diff, coalesce(greatest(abs(a.lo - b.lo) / (abs(b.lo) + 1e-6), abs(a.hi - b.hi) / (abs(b.hi) + 1e-6)) > 0.01, false) AS minmax_flag, a.u AS n_unique, b.u AS ref_n_unique, round(a.lo, 4) + 0.0 AS lo, round(b.lo, 4) + 0.0 AS ref_lo, round(a.hi, 4) AS hi, round(b.hi, 4) AS ref_hi, round(abs(a.u - b.u) / greatest(b.u, 1)::DOUBLE, 4) AS unique_ratio_diff,
        abs(a.u - b.u) / greatest(b.u, 1)::DOUBLE > 0.5 AS unique_flag, round(a.missing, 4) AS missing FROM ({_side(c, HALF_NOW, n)}) a, ({_side(c, HALF_THEN, n)}) b"""
            for c, n, kind in _COMPARED
        )
    ),
)
def _(spark, sf):
    now, then = (t.withColumn("ts", F.to_date("ts")).withColumnRenamed("ts", "day") for t in halves(spark, sf))
    return rounded(schema.compare_tables(now, then), 4, "lo", "ref_lo", "hi", "ref_hi", "missing", "ref_missing", "missing_diff", "unique_ratio_diff", "minmax_diff")


@query("check_datetime_consistency", "SELECT 'day' AS \"column\", count(*) AS num_values, count(*) FILTER (event_id % 11 = 0) AS num_invalid, round(100.0 * count(*) FILTER (event_id % 11 <> 0)::DOUBLE / count(*), 2) AS percent_valid FROM events")
def _(spark, sf):
    t = table(spark, sf, "events").selectExpr("case when event_id % 11 = 0 then 'no date' else cast(to_date(ts) as string) end as day")
    return schema.datetime_consistency(t)


_MIXED = "CASE event_id % 10 WHEN 0 THEN '2024-01-02' WHEN 1 THEN 'word' WHEN 2 THEN '1.5' WHEN 3 THEN 'true' ELSE cast(event_id AS {s}) END"


@query(
    "detect_mixed_type_columns",
    f"""WITH v AS (SELECT event_id, {_MIXED.format(s="VARCHAR")} AS v FROM events), k AS (SELECT v, CASE WHEN event_id % 10 = 0 THEN 'datetime' WHEN event_id % 10 = 1 THEN 'string' WHEN event_id % 10 = 2 THEN 'float' WHEN event_id % 10 = 3 THEN 'bool' ELSE 'int' END AS kind FROM v),
    c AS (SELECT kind, count(*) AS n FROM k GROUP BY 1), x AS (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY v) AS i FROM (SELECT DISTINCT kind, v FROM k)),
    g AS (SELECT kind, string_agg(v, ' ' ORDER BY v) AS examples FROM x WHERE i <= 5 GROUP BY 1)
    SELECT 'v' AS "column", kind, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, n < max(n) OVER () AND n / sum(n) OVER ()::DOUBLE >= 0.05 AS is_minority, examples FROM c JOIN g USING (kind)""",
)
def _(spark, sf):
    t = table(spark, sf, "events").selectExpr(f"{_MIXED.format(s='STRING')} as v")
    return rounded(schema.mixed_types(t), 6, "share").withColumn("examples", F.array_join("examples", " "))


@query("detect_regex_format_violations", r"""SELECT 'url' AS "column", count(*) FILTER (NOT regexp_full_match(url, 'https://[a-z.-]+/[^?#]*')) AS violations,
    (SELECT coalesce(string_agg(url, ' ' ORDER BY url), '') FROM (SELECT DISTINCT url FROM pages WHERE NOT regexp_full_match(url, 'https://[a-z.-]+/[^?#]*') ORDER BY url LIMIT 5)) AS examples FROM pages""")
def _(spark, sf):
    return schema.regex_violations(table(spark, sf, "pages"), {"url": "https://[a-z.-]+/[^?#]*", "absent": "x", "html": "("}).withColumn("examples", F.array_join("examples", " "))


@query(
    "detect_out_of_bounds",
    """SELECT 'l_quantity' AS "column", 1.0::DOUBLE AS lower, 40.0::DOUBLE AS upper, count(*) AS violations, min(l_quantity) AS min_violation, max(l_quantity) AS max_violation FROM lineitem WHERE l_quantity < 1 OR l_quantity > 40""",
)
def _(spark, sf):
    return schema.out_of_bounds(table(spark, sf, "lineitem"), {"l_quantity": [1, 40], "l_tax": [0, 1]})


# --- anomalies -------------------------------------------------------------------------------------------------------------------------------------


@query(
    "detect_skewness",
    union(*(f"""SELECT '{c}' AS "column", round(s, 6) + 0.0 AS skewness, CASE WHEN abs(s) > 2 THEN 0.8 WHEN abs(s) > 1 THEN 0.6 END::DOUBLE AS score FROM (SELECT skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS s FROM {t})""" for t, c in (("events", "value"), ("events", "user_id")))),
)
def _(spark, sf):
    return rounded(anomalies.skewness(table(spark, sf, "events"), ["value", "user_id"]), 6, "skewness")


@query(
    "detect_outliers",
    union(
        *(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lower OR {c} > upper) AS outlier_count, round(any_value(lower), 4) AS lower, round(any_value(upper), 4) AS upper, count(*) FILTER ({c} < lower OR {c} > upper) > 0.01 * count(*) AS flagged FROM e,
        (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM e)"""
            for c in ("value", "user_id")
        )
    ).join([f"WITH e AS ({EVENTS}) ", ""]),
)
def _(spark, sf):
    return rounded(anomalies.outliers(events(spark, sf), ["value", "user_id"]), 4, "lower", "upper")


@query("detect_zeros", union(*(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} = 0) AS zero_count, round(count(*) FILTER ({c} = 0) / count(*)::DOUBLE, 6) AS zero_share, count(*) FILTER ({c} = 0) / count(*)::DOUBLE > 0.05 AS flagged FROM lineitem""" for c in LINE)))
def _(spark, sf):
    return rounded(anomalies.zeros(table(spark, sf, "lineitem"), LINE, flag_threshold=0.05), 6, "zero_share")


@query("detect_near_zero_variance", union(*(f"""SELECT '{c}' AS "column", round(stddev_samp({c}), 6) AS std, round(var_samp({c}), 6) AS variance FROM lineitem HAVING var_samp({c}) <= 0.001""" for c in LINE)))
def _(spark, sf):
    return rounded(anomalies.near_zero_variance(table(spark, sf, "lineitem"), LINE, threshold=0.001), 6, "std", "variance")


@query("detect_bimodal_distribution")
def _(spark, sf):
    t = table(spark, sf, "events").selectExpr("value", "value + if(event_id % 2 = 0, 500, 0) as shifted")
    return rounded(anomalies.bimodal(t), 1, "bic1", "bic2")


@query("detect_single_dominant_value", f"""WITH e AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'b' ELSE 'a' END AS mostly, event_type FROM events), f AS ({_counts_sql("e", ("mostly", "event_type"))}) SELECT "column", arg_max(value, n) AS dominant_value, round(max(n) / sum(n)::DOUBLE, 6) AS proportion FROM f GROUP BY 1 HAVING max(n) / sum(n)::DOUBLE >= 0.95""")
def _(spark, sf):
    t = table(spark, sf, "events").selectExpr("case when event_id % 50 = 0 then 'b' else 'a' end as mostly", "event_type")
    return rounded(anomalies.dominant_values(t), 6, "proportion")


@query("detect_constant_columns", "SELECT 'always' AS \"column\"")
def _(spark, sf):
    return anomalies.constant_columns(table(spark, sf, "customer").withColumn("always", F.lit("x")).withColumn("never", F.lit(None).cast("int")))


@query("detect_high_cardinality", union(*(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM part HAVING count(DISTINCT {c}) > 30""" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))))
def _(spark, sf):
    return anomalies.high_cardinality(table(spark, sf, "part"), threshold=30)


@query("detect_id_columns", union(*(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(*) AS n_rows FROM customer HAVING count(DISTINCT {c}) >= 0.95 * count(*)""" for c in _CUSTOMER)))
def _(spark, sf):
    return anomalies.id_columns(table(spark, sf, "customer"))


@query("detect_duplicates", "SELECT count(*) AS num_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_count FROM documents")
def _(spark, sf):
    return anomalies.duplicate_rows(table(spark, sf, "documents"), ["text", "lang"])


@query("detect_duplicate_columns", "SELECT 'o_custkey' AS a, 'copy' AS b")
def _(spark, sf):
    t = table(spark, sf, "orders")
    return anomalies.duplicate_columns(t.withColumn("copy", F.col("o_custkey")).withColumn("other", F.col("o_custkey") + 1))


_ENCODED = "md5(event_id::VARCHAR)"


@query(
    "detect_encoded_columns",
    f"""WITH t AS (SELECT {_ENCODED} AS digest, concat(substr({_ENCODED}, 1, 8), '-', substr({_ENCODED}, 9, 4), '-', substr({_ENCODED}, 13, 4), '-', substr({_ENCODED}, 17, 4), '-', substr({_ENCODED}, 21, 12)) AS uid FROM events),
    """
    + "c AS ("
    + union(*(f"""SELECT '{c}' AS "column", letter, count(*) AS k FROM (SELECT unnest(string_split({c}, '')) AS letter FROM t) GROUP BY 2""" for c in ("digest", "uid")))
    + """), h AS (SELECT "column", log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM c WHERE letter <> '' GROUP BY 1)
    SELECT 'digest' AS "column", 'hex' AS encoding, avg(length(digest)) AS avg_length, 0.0::DOUBLE AS length_std, round((SELECT e FROM h WHERE "column" = 'digest'), 6) AS entropy FROM t
    UNION ALL SELECT 'uid', 'uuid', avg(length(uid)), 0.0, round((SELECT e FROM h WHERE "column" = 'uid'), 6) FROM t""",
)
def _(spark, sf):
    t = table(spark, sf, "events").selectExpr("md5(cast(event_id as string)) as digest", "event_type")
    t = t.selectExpr("digest", "concat(substr(digest, 1, 8), '-', substr(digest, 9, 4), '-', substr(digest, 13, 4), '-', substr(digest, 17, 4), '-', substr(digest, 21, 12)) as uid", "event_type")
    return rounded(anomalies.encoded_columns(t), 6, "length_std", "entropy")


@query(
    "detect_class_imbalance",
    "WITH f AS (SELECT toxic::VARCHAR AS v, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT sum(n)::BIGINT AS n, count(*) AS n_classes, arg_max(v, n) AS majority_class, round(max(n) / sum(n)::DOUBLE, 4) AS majority_ratio, max(n) / sum(n)::DOUBLE >= 0.8 AS is_imbalanced FROM f",
)
def _(spark, sf):
    return anomalies.class_imbalance(table(spark, sf, "labels"), "toxic", threshold=0.8)


# --- several columns -------------------------------------------------------------------------------------------------------------------------------

_LINE_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query("compute_correlations", union(*(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a, b in _LINE_PAIRS)))
def _(spark, sf):
    return rounded(multivariate.correlations(table(spark, sf, "lineitem"), LINE), 6, "r")


def _cramer_sql(t: str, a: str, b: str) -> str:
    return f"""(WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {t} GROUP BY ALL), r AS (SELECT x, sum(n) AS rx FROM c GROUP BY 1), k AS (SELECT y, sum(n) AS ry FROM c GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
    g AS (SELECT coalesce(n, 0) AS o, rx * ry / t AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (x, y)), m AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk),
    s AS (SELECT sum((abs(o - e) - CASE WHEN nr = 2 AND nk = 2 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e) AS chi2 FROM g, m)
    SELECT '{a}' AS a, '{b}' AS b, t::BIGINT AS n, round(chi2, 4) AS chi2, (nr - 1) * (nk - 1) AS dof, round(sqrt(chi2 / t / least(nr - 1, nk - 1)), 6) AS v FROM s, m, t)"""


@query("cramers_v", union(f"SELECT * FROM {_cramer_sql('lineitem', 'l_returnflag', 'l_linestatus')}", f"SELECT * FROM {_cramer_sql('orders', 'o_orderstatus', 'o_orderpriority')}", f"SELECT * FROM {_cramer_sql('l2', 'x', 'l_linestatus')}").join(["WITH l2 AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'n' ELSE 'o' END AS x, l_linestatus FROM lineitem) ", ""]))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    two = lines.selectExpr("if(l_returnflag = 'N', 'n', 'o') as x", "l_linestatus")
    found = multivariate.cramers_v(lines).union(multivariate.cramers_v(table(spark, sf, "orders"), [("o_orderstatus", "o_orderpriority")])).union(multivariate.cramers_v(two))
    return rounded(rounded(found, 4, "chi2"), 6, "v")


def _warnings_sql(t: str, columns) -> str:
    flags = union(
        *(
            f"""SELECT '{c}' AS c, count({c}) < 30 AS low, coalesce(stddev_samp({c}) < 1e-8, false) AS zero_variance, coalesce(abs(skewness({c})) > 2, false) AS high_skew,
        max(abs({c} - (SELECT median({c}::DOUBLE) FROM {t}))) / (CASE WHEN mad({c}::DOUBLE) = 0 THEN 1e-8 ELSE mad({c}::DOUBLE) END) > 3 AS extreme_outliers FROM {t}"""
            for c in columns
        )
    )
    codes = union(
        "SELECT 'strong' AS level, 'low_row_count' AS code, string_agg(c, ',' ORDER BY c) AS \"columns\" FROM f HAVING bool_or(low)",
        "SELECT 'strong', 'zero_variance', string_agg(c, ',' ORDER BY c) FROM f WHERE zero_variance HAVING count(*) > 0",
        *(f"SELECT CASE WHEN bool_or(low) THEN 'strong' ELSE 'heuristic' END, CASE WHEN bool_or(low) THEN '{x}_low_n' ELSE '{x}' END, string_agg(c, ',' ORDER BY c) FROM f WHERE {x} HAVING count(*) > 0" for x in ("extreme_outliers", "high_skew")),
    )
    return f"f AS ({flags}) {codes}"


@query("reliability_warnings", "WITH e AS (SELECT event_id, user_id, value, 7 AS same, value * value * value AS cubed FROM events), " + _warnings_sql("e", ("event_id", "user_id", "value", "same", "cubed")))
def _(spark, sf):
    t = table(spark, sf, "events").selectExpr("event_id", "user_id", "value", "7 as same", "value * value * value as cubed")
    return multivariate.reliability_warnings(t).withColumn("columns", F.array_join("columns", ","))


@query("reliability_warnings_few_rows", "WITH e AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey = 3 THEN 100000 ELSE n_nationkey END AS far FROM nation), " + _warnings_sql("e", ("n_nationkey", "n_regionkey", "far")))
def _(spark, sf):
    t = table(spark, sf, "nation").selectExpr("n_nationkey", "n_regionkey", "if(n_nationkey = 3, 100000, n_nationkey) as far")
    return multivariate.reliability_warnings(t).withColumn("columns", F.array_join("columns", ","))


# of three columns, from the correlations of the columns as they stand (not centred): the inverse has a closed form
@query(
    "detect_collinear_features",
    """WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_discount * l_discount) AS b, sum(l_tax * l_tax) AS c, sum(l_quantity * l_discount) / sqrt(sum(l_quantity * l_quantity) * sum(l_discount * l_discount)) AS x,
        sum(l_quantity * l_tax) / sqrt(sum(l_quantity * l_quantity) * sum(l_tax * l_tax)) AS y, sum(l_discount * l_tax) / sqrt(sum(l_discount * l_discount) * sum(l_tax * l_tax)) AS z FROM lineitem), d AS (SELECT *, 1 + 2 * x * y * z - x * x - y * y - z * z AS det FROM g)
    SELECT 'l_quantity' AS "column", round((1 - z * z) / det, 4) AS vif, (1 - z * z) / det > 10 AS flagged, CASE WHEN (1 - z * z) / det >= 15 THEN 0.85 WHEN (1 - z * z) / det > 10 THEN 0.75 END::DOUBLE AS score FROM d UNION ALL SELECT 'l_discount', round((1 - y * y) / det, 4), (1 - y * y) / det > 10, CASE WHEN (1 - y * y) / det >= 15 THEN 0.85 WHEN (1 - y * y) / det > 10 THEN 0.75 END::DOUBLE FROM d UNION ALL SELECT 'l_tax', round((1 - x * x) / det, 4), (1 - x * x) / det > 10, CASE WHEN (1 - x * x) / det >= 15 THEN 0.85 WHEN (1 - x * x) / det > 10 THEN 0.75 END::DOUBLE FROM d""",
)
def _(spark, sf):
    return rounded(multivariate.collinear_features(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 4, "vif")


@query("detect_data_leakage", "SELECT 'l_tax' AS a, 'double_tax' AS b, round(corr(l_tax, 2 * l_tax), 6) AS r FROM lineitem")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select("l_quantity", "l_tax", (2 * F.col("l_tax")).alias("double_tax"))
    return rounded(multivariate.data_leakage(t), 6, "r")


@query(
    "suggest_categorical_encoding",
    union(
        *(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, round(corr(x, p_retailprice), 6) + 0.0 AS target_correlation, (CASE WHEN count(DISTINCT {c}) <= 10 THEN 'one-hot' WHEN count(DISTINCT {c}) <= 50 THEN 'frequency' ELSE 'frequency (high-cardinality)' END) || (CASE WHEN abs(corr(x, p_retailprice)) > 0.3 THEN ' + target encoding' ELSE '' END) AS suggestion
        FROM (SELECT {c}, p_retailprice, dense_rank() OVER (ORDER BY {c}) - 1 AS x FROM part)"""
            for c in ("p_name", "p_brand", "p_type")
        )
    ),
)
def _(spark, sf):
    return rounded(multivariate.encoding_suggestions(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], target="p_retailprice"), 6, "target_correlation")


@query(
    "suggest_numerical_binning",
    union(*(f"""SELECT '{c}' AS "column", round(skewness({c}), 4) + 0.0 AS skew, CASE WHEN skewness({c}) > 1 THEN 'log-transform' WHEN max({c}) - min({c}) > 3 * stddev_samp({c}) THEN 'equal-width' ELSE 'quantile' END AS suggestion FROM {t}""" for t, c in (("events", "value"), ("events", "user_id")))),
)
def _(spark, sf):
    return rounded(multivariate.binning_suggestions(table(spark, sf, "events"), ["value", "user_id"]), 4, "skew")


@query(
    "reliability_flags",
    union(
        *(
            f"""SELECT '{c}' AS "column", count({c}) AS n_rows, count({c}) < 30 AS low_row_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) + 0.0 AS skew, round(median({c}::DOUBLE), 4) AS median, round(mad({c}::DOUBLE), 4) AS mad,
        max(abs({c} - (SELECT median({c}::DOUBLE) FROM e))) / (CASE WHEN mad({c}::DOUBLE) = 0 THEN 1e-8 ELSE mad({c}::DOUBLE) END) > 3 AS extreme_outliers, abs(skewness({c})) > 2 AS high_skew, stddev_samp({c}) < 1e-8 AS zero_variance FROM e"""
            for c in ("user_id", "value")
        )
    ).join([f"WITH e AS (SELECT * FROM ({EVENTS}) WHERE value IS NOT NULL) ", ""]),
)
def _(spark, sf):
    return rounded(multivariate.reliability_flags(events(spark, sf), ["user_id", "value"]), 4, "mean", "std", "skew", "median", "mad")


# --- drift -------------------------------------------------------------------------------------------------------------------------------------------


def _psi_sql(c: str) -> str:
    return f"""(WITH v AS (SELECT {c}::DOUBLE AS v, {HALF_NOW} AS cur FROM events), m AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS w, count(*) FILTER (cur) AS nc, count(*) FILTER (NOT cur) AS nr FROM v),
    b AS (SELECT least(floor((v - lo) / w), 9) AS bin, count(*) FILTER (cur) AS c, count(*) FILTER (NOT cur) AS r FROM v, m GROUP BY 1), a AS (SELECT range AS bin FROM range(10)),
    p AS (SELECT CASE WHEN coalesce(r, 0) = 0 THEN 1e-6 ELSE r / nr::DOUBLE END AS p, CASE WHEN coalesce(c, 0) = 0 THEN 1e-6 ELSE c / nc::DOUBLE END AS q FROM a CROSS JOIN m LEFT JOIN b USING (bin)) SELECT sum((p - q) * ln(p / q)) AS psi FROM p)"""


def _ks_sql(c: str) -> str:
    return f"""(WITH v AS (SELECT {c} AS v, count(*) FILTER ({HALF_NOW}) AS c, count(*) FILTER ({HALF_THEN}) AS r FROM events GROUP BY 1) SELECT max(abs(fc - fr)) AS d FROM (SELECT sum(c) OVER (ORDER BY v) / (sum(c) OVER ())::DOUBLE AS fc, sum(r) OVER (ORDER BY v) / (sum(r) OVER ())::DOUBLE AS fr FROM v))"""


@query("detect_feature_drift", union(*(f"""SELECT '{c}' AS "column", round(psi, 6) AS psi, round(d, 6) AS ks_statistic, CASE WHEN psi < 0.1 THEN 'low' WHEN psi < 0.2 THEN 'moderate' ELSE 'high' END AS severity FROM {_psi_sql(c)}, {_ks_sql(c)}""" for c in ("user_id", "value"))))
def _(spark, sf):
    found = drift.feature_drift(*halves(spark, sf), ["user_id", "value"]).select("column", "psi", "ks_statistic", "severity")
    return rounded(found, 6, "psi", "ks_statistic")


@query("feature_drift_p_values")
def _(spark, sf):
    return drift.feature_drift(*halves(spark, sf))


_CAT = f"""WITH v AS (SELECT event_type AS v, count(*) FILTER ({HALF_NOW})::DOUBLE AS c, count(*) FILTER ({HALF_THEN})::DOUBLE AS r FROM events GROUP BY 1), t AS (SELECT sum(c) AS nc, sum(r) AS nr FROM v)
    SELECT 'event_type' AS "column", round(sum(abs(r / nr - c / nc)) / 2, 6) AS tvd, round(sum((c - (c + r) * nc / (nc + nr)) ** 2 / ((c + r) * nc / (nc + nr)) + (r - (c + r) * nr / (nc + nr)) ** 2 / ((c + r) * nr / (nc + nr))), 4) AS chi2, count(*) - 1 AS dof,
    round(sum((c - r * nc / nr) ** 2 / (r * nc / nr)), 4) AS goodness_chi2, (count(*) - 1)::BIGINT AS goodness_dof, round(abs(-sum((c / nc + 1e-6) * ln(c / nc + 1e-6)) + sum((r / nr + 1e-6) * ln(r / nr + 1e-6))), 6) AS entropy_delta FROM v, t"""


@query("category_drift", _CAT)
def _(spark, sf):
    return rounded(rounded(drift.category_drift(*halves(spark, sf), ["event_type"]), 6, "tvd", "entropy_delta"), 4, "chi2", "goodness_chi2")


@query(
    "category_drift_two_values",
    f"""WITH v AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS v, count(*) FILTER ({HALF_NOW})::DOUBLE AS c, count(*) FILTER ({HALF_THEN})::DOUBLE AS r FROM events WHERE event_id % 3 <> 0 OR {HALF_NOW} GROUP BY 1), t AS (SELECT sum(c) AS nc, sum(r) AS nr FROM v),
    d AS (SELECT *, (c + r) * nc / (nc + nr) AS ec, (c + r) * nr / (nc + nr) AS er, abs(c - (c + r) * nc / (nc + nr)) AS a FROM v, t)
    SELECT 'event_type' AS "column", round(sum(abs(r / nr - c / nc)) / 2, 6) AS tvd, round(sum((a - least(a, 0.5)) ** 2 / ec + (a - least(a, 0.5)) ** 2 / er), 4) AS chi2, 1::BIGINT AS dof FROM d""",
)
def _(spark, sf):
    t = table(spark, sf, "events").selectExpr("ts", "event_id", "if(event_type in ('view', 'click'), 'a', 'b') as event_type")
    found = drift.category_drift(t.where(HALF_NOW), t.where(HALF_THEN).where("event_id % 3 <> 0"), ["event_type"]).select("column", "tvd", "chi2", "dof")
    return rounded(rounded(found, 6, "tvd"), 4, "chi2")


@query("population_stability", union(*(f"""SELECT '{c}' AS "column", round(psi, 6) AS psi FROM {_psi_sql(c)}""" for c in ("user_id", "value"))))
def _(spark, sf):
    return rounded(drift.psi(*halves(spark, sf), ["user_id", "value"]), 6, "psi")


@query("ks_two_sample", union(*(f"""SELECT '{c}' AS "column", round(d, 6) AS d, (SELECT count({c}) FROM events WHERE {HALF_THEN}) AS n_ref, (SELECT count({c}) FROM events WHERE {HALF_NOW}) AS n_cur FROM {_ks_sql(c)}""" for c in ("user_id", "value"))))
def _(spark, sf):
    return rounded(drift.ks_statistics(*halves(spark, sf), ["user_id", "value"]), 6, "d")


@query("detect_target_drift", f"""SELECT 'value' AS "column", 'numeric' AS type, round(psi, 6) AS psi, round(d, 6) AS ks_statistic FROM {_psi_sql("value")}, {_ks_sql("value")}""")
def _(spark, sf):
    return rounded(drift.target_drift(*halves(spark, sf), "value").select("column", "type", "psi", "ks_statistic"), 6, "psi", "ks_statistic")


# with 4 degrees of freedom the tail of chi-squared has a closed form
@query(
    "target_drift_categorical",
    f"""WITH v AS (SELECT event_type AS v, count(*) FILTER ({HALF_NOW})::DOUBLE AS c, count(*) FILTER ({HALF_THEN})::DOUBLE AS r FROM events GROUP BY 1), t AS (SELECT sum(c) AS nc, sum(r) AS nr FROM v),
    m AS (SELECT sum(abs(r / nr - c / nc)) / 2 AS tvd, sum((c - r * nc / nr) ** 2 / (r * nc / nr)) AS x, abs(-sum((c / nc + 1e-6) * ln(c / nc + 1e-6)) + sum((r / nr + 1e-6) * ln(r / nr + 1e-6))) AS e, count(*) AS k FROM v, t),
    p AS (SELECT *, CASE WHEN k = 5 THEN exp(-x / 2) * (1 + x / 2) END AS p FROM m)
    SELECT 'event_type' AS "column", 'categorical' AS type, NULL::DOUBLE AS psi, NULL::DOUBLE AS ks_statistic, NULL::DOUBLE AS ks_p, round(tvd, 6) AS tvd, round(p, 6) AS chi2_p, round(e, 6) AS entropy_delta,
    CASE WHEN p < 0.025 OR e > 1 THEN 'significant' WHEN p < 0.05 OR e > 0.5 THEN 'moderate' ELSE 'none' END AS drift FROM p""",
)
def _(spark, sf):
    return rounded(drift.target_drift(*halves(spark, sf), "event_type"), 6, "tvd", "chi2_p", "entropy_delta")


# --- meta, plots, sources ------------------------------------------------------------------------------------------------------------------------------


@query(
    "infer_stage",
    f"WITH e AS ({EVENTS}), s AS (SELECT (3 * count(*) - count(event_type) - count(value) - count(flag)) / (5.0 * count(*))::DOUBLE AS m, greatest(count(DISTINCT event_id), count(DISTINCT user_id), count(DISTINCT event_type), count(DISTINCT value)) AS u FROM e) SELECT CASE WHEN m > 0.4 THEN 'raw' WHEN m < 0.05 THEN 'model_ready' WHEN m < 0.1 AND u <= 50 THEN 'cleaned' ELSE 'exploratory' END AS stage, round(m, 6) AS mean_null_share, 0.8::DOUBLE AS numeric_share, u AS max_unique FROM s",
)
def _(spark, sf):
    return rounded(meta.infer_stage(events(spark, sf)), 6, "mean_null_share")


def _quality_sql() -> str:
    """The parts of the quality score of the later half of events against the earlier one, each from its own definition."""
    now = f"(SELECT ts, user_id, event_type, value FROM events WHERE {HALF_NOW})"
    names, numbers = ("ts", "user_id", "event_type", "value"), ("user_id", "value")
    nulls = ", ".join(f"avg(({c} IS NULL)::INT) AS null_{c}" for c in names)
    skew = " + ".join(f"(abs(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0))) > 2)::INT" for c in numbers)
    far = " OR ".join(f"greatest(max({c}) - median({c}::DOUBLE), median({c}::DOUBLE) - min({c})) / (CASE WHEN mad({c}::DOUBLE) = 0 THEN 1e-8 ELSE mad({c}::DOUBLE) END) > 3" for c in numbers)
    same = " OR ".join(f"stddev_samp({c}) < 1e-8" for c in numbers)
    # the inflation of two columns as they stand is the same for both
    vif = "1 / (1 - sum(user_id * value) ** 2 / (sum(user_id::DOUBLE * user_id) * sum(value * value)))"
    tvd = f"""(SELECT sum(abs(r / nr - c / nc)) / 2 FROM (SELECT count(*) FILTER ({HALF_NOW})::DOUBLE AS c, count(*) FILTER ({HALF_THEN})::DOUBLE AS r, sum(count(*) FILTER ({HALF_NOW})) OVER () AS nc, sum(count(*) FILTER ({HALF_THEN})) OVER () AS nr FROM events GROUP BY {{c}}))"""
    drifted = " + ".join([*(f"(SELECT (psi >= 0.1)::INT FROM {_psi_sql(c)})" for c in numbers), *(f"({tvd.format(c=c)} >= 0.2)::INT" for c in ("ts", "event_type"))])
    missing, much = " + ".join(f"(null_{c} > 0)::INT" for c in names), " OR ".join(f"null_{c} > 0.3" for c in names)
    return f"""WITH a AS (SELECT {nulls}, {skew} AS skewed, {far} AS far, {same} AS same, (2 * ({vif} > 10)::INT) // 2 AS pairs, {drifted} AS drifted FROM {now}),
    p AS (SELECT (100 - least(2 * ({missing}), 50) - CASE WHEN {much} THEN 10 ELSE 0 END)::DOUBLE AS completeness, 100::DOUBLE AS consistency,
        (100 - least(5 * skewed, 30) - 10 * same::INT - 10 * far::INT)::DOUBLE AS distribution, (100 - least(2 * pairs, 30))::DOUBLE AS redundancy, (100 - least(5 * drifted, 30))::DOUBLE AS drift FROM a)
    SELECT *, round_even(0.3 * completeness + 0.2 * consistency + 0.2 * distribution + 0.15 * redundancy + 0.15 * drift, 0)::BIGINT AS overall FROM p"""


@query("data_quality_scorer", _quality_sql())
def _(spark, sf):
    now, then = halves(spark, sf)
    return meta.quality_score(now, then)


_RUNS = "SELECT o_orderpriority AS task, sum(o_totalprice) / 1e7 AS seconds FROM orders GROUP BY 1"


def _runs(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg((F.sum("o_totalprice") / 1e7).alias("seconds"))


@query("identify_bottleneck_tasks", f"SELECT task, round(seconds, 4) AS seconds, seconds > 5 AS slow FROM ({_RUNS}) ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, sf):
    return meta.bottlenecks(_runs(spark, sf), 3)


@query("log_resource_usage", f"SELECT count(*) AS task_count, round(sum(seconds), 2) AS total_seconds, round(avg(seconds), 4) AS mean_seconds, sum(seconds) > 30 AS slow_total, avg(seconds) > 5 AS slow_mean FROM ({_RUNS})")
def _(spark, sf):
    return meta.resource_usage(_runs(spark, sf))


@query("top_ml_risks", "SELECT task, score FROM (VALUES ('detect_constant_columns', 1.0::DOUBLE), ('detect_outliers', 0.7::DOUBLE), ('detect_skewness', 0.6::DOUBLE)) t(task, score) ORDER BY score DESC")
def _(spark, sf):
    rows = [("detect_outliers", 0.7), ("summarize_nulls", None), ("detect_constant_columns", 1.0), ("detect_skewness", 0.6)]
    return meta.top_risks(spark.createDataFrame(rows, "task string, score double"))


@query("plot_histogram", """WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events), b AS (SELECT least(floor((value - lo) / w), 29)::INT AS bin, count(*) AS n FROM events, m GROUP BY 1) SELECT 'value' AS "column", range::INT AS bin, round(lo + range * w, 4) + 0.0 AS lower, round(lo + (range + 1) * w, 4) + 0.0 AS upper, coalesce(n, 0) AS n FROM range(30) CROSS JOIN m LEFT JOIN b ON b.bin = range""")
def _(spark, sf):
    return rounded(plots.histogram(table(spark, sf, "events"), ["value"]), 4, "lower", "upper")


@query("plot_boxplot", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events) SELECT 'value' AS "column", round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, round(min(value), 4) AS whisker_low, round(max(value), 4) AS whisker_high FROM events, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _(spark, sf):
    return rounded(plots.boxplot(table(spark, sf, "events"), ["value"]), 4, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("plot_bars", f"""WITH f AS ({_counts_sql("part", ("p_brand",))}) SELECT "column", value, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS r FROM f) WHERE r <= 20""")
def _(spark, sf):
    return plots.bars(table(spark, sf, "part"), ["p_brand"])


@query("plot_correlation", union(*(f"SELECT '{a}' AS a, '{b}' AS b, {'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 6) + 0.0'} AS r FROM lineitem{' HAVING count(*) > 0' if a == b else ''}" for a in LINE for b in LINE)))
def _(spark, sf):
    return rounded(plots.correlation_matrix(table(spark, sf, "lineitem"), LINE), 6, "r")


@query("task_catalogue")
def _(spark, sf):
    from .control import registry

    return registry.catalogue(spark)


# --- sources and the control plane ---------------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or in a temporary folder in local runs without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/columnaut-{name}-{uuid.uuid4().hex}"


@query(
    "read_csv",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_custkey % 2 = 0 AS even, c_mktsegment || ',' || c_nationkey AS both FROM customer""",
)
def _(spark, sf):
    """Missing values by several names, quoted commas, and types told from the text."""
    path = _folder(spark, "csv") + ".csv"
    t = table(spark, sf, "customer")
    t.selectExpr(
        "c_custkey", "if(c_custkey % 5 = 0, element_at(array('NA', 'null', '', 'NaN', 'N/A'), cast(c_custkey div 5 % 5 + 1 as int)), c_name) as c_name", "if(c_custkey % 7 = 0, 'nan', cast(c_acctbal as string)) as c_acctbal",
        "cast(c_custkey % 2 = 0 as string) as even", "concat(c_mktsegment, ',', c_nationkey) as both",
    ).write.option("header", True).option("emptyValue", "").csv(path)
    return read_table(spark, path)


@query("data_sets", "SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'region', (SELECT count(*) FROM region)")
def _(spark, sf):
    """Named data sets of a folder, loaded by their names."""
    known = Datasets(spark)
    for name in ("nation", "region"):
        known.register(name, f"{sf}/{name}.parquet")
    parts = [known.load(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("nation", "region")]
    return parts[0].union(parts[1])


@query("sample_rows_head", "SELECT least(count(*), 500) AS n, least(count(*), 500) AS distinct_keys, count(*) AS original_rows, least(count(*), 500) AS sampled_rows, 'head' AS strategy FROM orders")
def _(spark, sf):
    got, about = sample_rows(table(spark, sf, "orders"), 500)
    about = about or {"original_rows": got.count(), "sampled_rows": got.count(), "strategy": "head"}
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys")).select("n", "distinct_keys", *(F.lit(about[k]).cast("long").alias(k) for k in ("original_rows", "sampled_rows")), F.lit(about["strategy"]).alias("strategy"))


_RUN = {"task_selection": {"include": ["summarize_nulls", "summarize_unique", "detect_id_columns", "compare_with_reference_dataset"]}, "metadata": {"message_verbosity": "quiet"}}


@query("run_of_selected_tasks", "SELECT * FROM (VALUES ('infer_types', 'success'), ('summarize_nulls', 'success'), ('summarize_unique', 'success'), ('detect_id_columns', 'success'), ('compare_with_reference_dataset', 'skipped')) t(task, status)")
def _(spark, sf):
    """A run takes the tasks that are selected and those that they depend on; without a reference the comparison has nothing to look at."""
    found = profile(spark, f"{sf}/nation.parquet", _RUN)
    return spark.createDataFrame([(n, r.status) for n, r in found.items()], "task string, status string")


@query("run_distinct_counts", union(*(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM customer""" for c in _CUSTOMER)))
def _(spark, sf):
    """What a run reports is what the operator gives alone, though the run shares its statistics."""
    return profile(spark, f"{sf}/customer.parquet", _RUN)["summarize_unique"].frame


@query("run_against_reference", """SELECT 'added' AS change, 'n_regionkey' AS "column" UNION ALL SELECT 'dropped', 'r_name' UNION ALL SELECT 'shared', 'k' UNION ALL SELECT 'type_mismatch', 'name'""")
def _(spark, sf):
    now = table(spark, sf, "nation").selectExpr("n_regionkey as k", "n_name as name", "n_regionkey")
    then = table(spark, sf, "region").selectExpr("r_regionkey as k", "r_regionkey as name", "r_name")
    return profile(spark, now, _RUN, reference=then)["compare_with_reference_dataset"].frame.select("change", "column")


@query(
    "run_reports",
    """SELECT * FROM (VALUES ('report.json', 'summarize_nulls', 'success'), ('report.json', 'infer_types', 'success'), ('report.json', 'detect_constant_columns', 'success'), ('report.json', 'top risk: detect_constant_columns', NULL),
    ('metadata_report.json', 'constant', 'categorical'), ('runs.json', 'runs', '1'), ('dag.dot', 'infer_types -> summarize_nulls', NULL), ('dag.dot', 'infer_types -> detect_constant_columns', NULL)) t(report, entry, value)""",
)
def _(spark, sf):
    """What a run writes: results, top risks, types, history and the graph of its tasks."""
    with tempfile.TemporaryDirectory() as folder:  # on the driver alone, which writes the reports
        t = table(spark, sf, "nation").selectExpr("n_name", "true as constant")
        profile(spark, t, {"task_selection": {"include": ["summarize_nulls", "detect_constant_columns"]}, "metadata": {"output_dir": folder, "message_verbosity": "quiet"}})
        read = lambda name: json.loads((Path(folder) / name).read_text())
        report, about = read("report.json"), read("metadata_report.json")
        rows = [("report.json", n, r["status"]) for n, r in report["results"].items()] + [("report.json", f"top risk: {r['task']}", None) for r in report["top_ml_risks"]]
        rows += [("metadata_report.json", "constant", about["semantic_types"]["constant"]), ("runs.json", "runs", str(len(read("runs.json"))))]
        rows += [("dag.dot", f"{a} -> {b}", None) for a, b in re.findall(r'"(\w+)" -> "(\w+)"', (Path(folder) / "dag.dot").read_text())]
    return spark.createDataFrame(rows, "report string, entry string, value string")


@query("plugin_coverage", "SELECT NULL::VARCHAR AS plugin, NULL::VARCHAR AS warning WHERE false")
def _(spark, sf):
    """No plugin file is loaded that registers nothing."""
    return profile(spark, f"{sf}/region.parquet", {"task_selection": {"include": ["validate_plugin_coverage"]}, "metadata": {"message_verbosity": "quiet"}})["validate_plugin_coverage"].frame


@query(
    "schema_validation_mixed_types",
    f"""WITH v AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'datetime' WHEN event_id % 10 = 1 THEN 'string' WHEN event_id % 10 = 2 THEN 'float' WHEN event_id % 10 = 3 THEN 'bool' ELSE 'int' END AS kind FROM events)
    SELECT 'mixed_types' AS "check", 'v' AS "column", kind || ' beside int' AS detail, count(*) AS n FROM v WHERE kind <> 'int' GROUP BY kind""",
)
def _(spark, sf):
    return schema.validate_schema(table(spark, sf, "events").selectExpr(f"{_MIXED.format(s='STRING')} as v", "event_type"), {"mixed_types": True})

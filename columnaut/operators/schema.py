"""Types, contracts and formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import full_match, number_where, parsed_time
from ..plans.columns import as_text, every, is_nested, numeric, ref, storage_types, strings, value
from ..plans.fused import distinct_counts, frequencies, melted, names_of, per_column

_ID = r"^[A-Fa-f0-9\-]{8,}\z"


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "other"


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """storage_type and semantic_type (categorical, continuous, datetime, id, text, unknown) of each column.

    Numbers with two values, or with few (at most 20, and under 5 % of the values), are categorical, others continuous. Strings are datetime if every value parses, id if most look like
    hexadecimal ids or nearly all differ, text if long on average, else categorical. Columns without a value and nested ones are unknown."""
    names = every(df, columns)
    kinds = {c: df.schema[c].dataType for c in names}
    flat = [c for c in names if not is_nested(kinds[c])]
    text = strings(df, names)
    told = df.sparkSession.createDataFrame([(c, kinds[c].simpleString(), _family(kinds[c])) for c in names], "column string, storage_type string, family string")
    looks = {
        "is_time": lambda c: F.bool_and(parsed_time(c).isNotNull()),
        "id_share": lambda c: F.avg(c.rlike(_ID).cast("int")),
        "mean_length": lambda c: F.avg(F.char_length(c)),
    }
    shape = per_column(df, text, looks, "is_time boolean, id_share double, mean_length double")
    totals = per_column(df, names, {"total": F.count}, "total bigint")
    found = told.join(F.broadcast(totals), "column").join(F.broadcast(distinct_counts(df, flat)), "column", "left").join(F.broadcast(shape), "column", "left")
    ratio = F.col("n_unique") / F.col("total")
    semantic = (
        F.when((F.col("total") == 0) | (F.col("family") == "other"), "unknown")
        .when(F.col("family") == "boolean", "categorical")
        .when(F.col("family") == "numeric", F.when((F.col("n_unique") == 2) | ((ratio < 0.05) & (F.col("n_unique") <= 20)), "categorical").otherwise("continuous"))
        .when(F.col("family") == "time", "datetime")
        .when(F.col("is_time"), "datetime")
        .when((F.col("id_share") > 0.8) | (ratio > 0.9), "id")
        .when(F.col("mean_length") > 30, "text")
        .otherwise("categorical")
    )
    return found.select("column", "storage_type", semantic.alias("semantic_type"))


#: What a contract may call a type, and the storage types that it covers.
ALIASES = {
    "int": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double", "decimal"),
    "str": ("string", "varchar", "char"),
    "bool": ("boolean",),
    "datetime": ("timestamp", "timestamp_ntz", "date"),
    "int64": ("bigint",),
    "int32": ("int",),
    "float64": ("double",),
    "float32": ("float",),
    "object": ("string",),
}
CONTRACT_KEYS = {"required_columns", "dtypes", "value_ranges", "categories", "mixed_types"}


def validate_schema(df: DataFrame, contract: Mapping) -> DataFrame:
    """(check, column, detail, n) for each breach of a contract: required_columns [names], dtypes {column: alias}, value_ranges {column: {min, max}}, categories {column: [values]}, mixed_types
    [string columns whose values must all look of one kind] (or true for all of them; one row for each kind but the most frequent); and for keys that a contract doesn't know. n counts rows where that means something. Columns that are absent are only reported as required."""
    rows: list[tuple] = [("unknown_key", None, k, None) for k in contract if k not in CONTRACT_KEYS]
    rows += [("required_columns", c, "missing", None) for c in contract.get("required_columns") or [] if c not in df.columns]
    actual = storage_types(df)
    for c, want in (contract.get("dtypes") or {}).items():
        if c in actual and not any(actual[c] == t or actual[c].startswith(t + "(") for t in ALIASES.get(want, (want,))):
            rows.append(("dtypes", c, f"expected {want}, found {actual[c]}", None))
    spark = df.sparkSession
    schema = "check string, column string, detail string, n bigint"
    out = spark.createDataFrame(rows, schema)
    tests = []
    for c, limits in (contract.get("value_ranges") or {}).items():
        if c in actual:
            lo, hi = (limits.get("min"), limits.get("max")) if isinstance(limits, Mapping) else limits
            v = value(df, c)
            tests += [(c, f"< {lo}", v < F.lit(lo))] * (lo is not None) + [(c, f"> {hi}", v > F.lit(hi))] * (hi is not None)
    if tests:
        wide = df.agg(*(number_where(t).alias(f"_{i}") for i, (*_, t) in enumerate(tests)))
        found = wide.select(F.inline(F.array(*(F.struct(F.lit("value_ranges").alias("check"), F.lit(c).alias("column"), F.lit(d).alias("detail"), F.col(f"_{i}").cast("long").alias("n")) for i, (c, d, _) in enumerate(tests)))))
        out = out.union(found.where("n > 0"))
    for c, allowed in (contract.get("categories") or {}).items():
        if c in actual:
            text = as_text(df, c)
            bad = df.where(text.isNull() | ~text.isin([str(v) for v in allowed])).groupBy(text.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            out = out.union(bad.select(F.lit("categories"), F.lit(c), F.coalesce("v", F.lit("null")), "n"))
    mixed = contract.get("mixed_types") or []
    mixed = strings(df) if mixed is True else [c for c in strings(df) if c in mixed]
    if mixed:
        kinds = mixed_types(df, mixed, 0.0)
        most = kinds.groupBy("column").agg(F.max(F.struct("n", "kind")).alias("most"))
        others = kinds.join(F.broadcast(most), "column").where("kind <> most.kind")
        out = out.union(others.select(F.lit("mixed_types"), "column", F.concat(F.col("kind"), F.lit(" beside "), F.col("most.kind")), "n"))
    return out


def compare_tables(df: DataFrame, reference: DataFrame, missing_threshold: float = 0.3, unique_threshold: float = 0.5, minmax_tolerance: float = 0.01) -> DataFrame:
    """One row for each column of either table: change (added, dropped, type_mismatch, shared) and, for shared ones, the shares of missing values, distinct counts, and least and greatest numbers
    on both sides, their differences (4 digits) and flags."""
    now, then = storage_types(df), storage_types(reference)
    told = []
    for c in sorted(now.keys() | then.keys()):
        told.append((c, "added" if c not in then else "dropped" if c not in now else "type_mismatch" if now[c] != then[c] else "shared", now.get(c), then.get(c)))
    names = df.sparkSession.createDataFrame(told, "column string, change string, type string, ref_type string")
    both = [c for c in df.columns if c in then]
    ranged = [c for c in numeric(df, both) if now[c] == then[c]]

    def side(t: DataFrame, prefix: str) -> DataFrame:
        missing = per_column(t, both, {"missing": lambda c: F.coalesce(F.avg(c.isNull().cast("double")), F.lit(0.0))}, "missing double")
        ends = per_column(t, ranged, {"lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")}, "lo double, hi double")
        one = missing.join(F.broadcast(distinct_counts(t, both)), "column").join(F.broadcast(ends), "column", "left")
        return one.select("column", *(F.col(c).alias(f"{prefix}{c}") for c in ("missing", "n_unique", "lo", "hi")))

    found = names.join(F.broadcast(side(df, "")), "column", "left").join(F.broadcast(side(reference, "ref_")), "column", "left")
    relative = lambda a, b: F.abs(F.col(a) - F.col(b)) / (F.abs(F.col(b)) + 1e-6)
    missing = F.abs(F.col("missing") - F.col("ref_missing"))
    unique = F.abs(F.col("n_unique") - F.col("ref_n_unique")) / F.greatest("ref_n_unique", F.lit(1))
    ends = F.greatest(relative("lo", "ref_lo"), relative("hi", "ref_hi"))
    return found.select(
        "column", "change", "type", "ref_type", "missing", "ref_missing", "n_unique", "ref_n_unique", "lo", "ref_lo", "hi", "ref_hi",
        F.round(missing, 4).alias("missing_diff"), F.round(unique, 4).alias("unique_ratio_diff"), F.round(ends, 4).alias("minmax_diff"),
        F.coalesce(missing > missing_threshold, F.lit(False)).alias("missing_flag"),
        F.coalesce(unique > unique_threshold, F.lit(False)).alias("unique_flag"),
        F.coalesce(ends > minmax_tolerance, F.lit(False)).alias("minmax_flag"),
    )


def datetime_consistency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """num_values, num_invalid (null or no date) and percent_valid (2 digits) of columns that hold times, or strings that may be times."""
    names = [c for c in every(df, columns) if _family(df.schema[c].dataType) in ("time", "text")]
    valid = {c: F.count(parsed_time(ref(c)) if _family(df.schema[c].dataType) == "text" else ref(c)) for c in names}
    if not names:
        return df.sparkSession.createDataFrame([], "column string, num_values bigint, num_invalid bigint, percent_valid double")
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *(v.alias(f"_{i}") for i, v in enumerate(valid.values())))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("_n").alias("num_values"), (F.col("_n") - F.col(f"_{i}")).alias("num_invalid"), F.round(100 * F.col(f"_{i}") / F.greatest("_n", F.lit(1)), 2).alias("percent_valid")) for i, c in enumerate(names)))
    return wide.select(F.inline(rows))


def mixed_types(df: DataFrame, columns: Sequence[str] | None = None, min_ratio: float = 0.05, samples: int = 5) -> DataFrame:
    """(column, kind, n, share, is_minority, examples): what the values of string columns look like (int, float, bool, datetime, string). A kind is a minority if it
    has fewer values than the most frequent one and at least min_ratio of all."""
    v = F.col("value")
    kind = (
        F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), "int")
        .when(v.rlike(r"^\s*[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?\s*$"), "float")
        .when(F.lower(F.trim(v)).isin("true", "false"), "bool")
        .when(parsed_time(v).isNotNull(), "datetime")
        .otherwise("string")
    )
    rows = frequencies(df, strings(df, columns)).withColumn("kind", kind)
    # the least few values of each kind, by a bounded aggregate
    seen = F.slice(F.sort_array(F.collect_set(F.when(F.col("_k") <= samples, F.col("value")))), 1, samples)
    from pyspark.sql.window import Window

    firsts = rows.withColumn("_k", F.row_number().over(Window.partitionBy("column", "kind").orderBy("value"))).where(F.col("_k") <= samples)
    kinds = rows.groupBy("column", "kind").agg(F.sum("n").alias("n"))
    total = kinds.groupBy("column").agg(F.sum("n").alias("_t"), F.max("n").alias("_top"))
    out = kinds.join(F.broadcast(total), "column").join(F.broadcast(firsts.groupBy("column", "kind").agg(seen.alias("examples"))), ["column", "kind"])
    share = F.col("n") / F.col("_t")
    return out.select("column", "kind", "n", share.alias("share"), ((F.col("n") < F.col("_top")) & (share >= min_ratio)).alias("is_minority"), "examples")


def regex_violations(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """(column, violations, examples): values of string columns that don't match their pattern from end to end, and the five least of them. Columns that are absent or no strings, and
    patterns that don't compile, are left out. `regex_violation_rows` gives all rows."""
    good = {c: p for c, p in patterns.items() if c in strings(df) and _compiles(df, p)}
    if not good:
        return df.sparkSession.createDataFrame([], "column string, violations bigint, examples array<string>")
    bad = {c: F.when(~full_match(ref(c), p), ref(c)) for c, p in good.items()}
    rows = melted(df, list(good), lambda c: bad[c]).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where("_k <= 5").groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("examples"))
    counts = rows.groupBy("column").agg(F.sum("n").alias("violations"))
    found = counts.join(F.broadcast(few), "column")
    return names_of(df, list(good)).join(F.broadcast(found), "column", "left").select("column", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def regex_violation_rows(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """All rows whose value doesn't match."""
    return df.where(ref(column).isNotNull() & ~full_match(ref(column), pattern))


def _compiles(df: DataFrame, pattern: str) -> bool:
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # the JVM's PatternSyntaxException, in whatever form it is handed over
        return False
    return True


DEFAULT_BOUNDS = {"age": [0, 120], "temperature": [-100, 150], "percent": [0, 100], "score": [0, 1]}


def out_of_bounds(df: DataFrame, bounds: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(column, lower, upper, violations, min_violation, max_violation) of numeric columns with bounds and values beyond them."""
    bounds = DEFAULT_BOUNDS if bounds is None else bounds
    names = [c for c in numeric(df) if c in bounds]
    schema = "column string, lower double, upper double, violations bigint, min_violation double, max_violation double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    off = {c: (value(df, c) < F.lit(bounds[c][0])) | (value(df, c) > F.lit(bounds[c][1])) for c in names}
    wide = df.agg(*(x for i, c in enumerate(names) for x in (number_where(off[c]).alias(f"n{i}"), F.min(F.when(off[c], ref(c))).cast("double").alias(f"a{i}"), F.max(F.when(off[c], ref(c))).cast("double").alias(f"b{i}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(float(bounds[c][0])).alias("lower"), F.lit(float(bounds[c][1])).alias("upper"), F.col(f"n{i}").cast("long").alias("violations"), F.col(f"a{i}").alias("min_violation"), F.col(f"b{i}").alias("max_violation")) for i, c in enumerate(names)))
    return wide.select(F.inline(rows)).where("violations > 0")

"""Plans that serve many columns in one pass.

`per_column` puts the measures of all columns into one aggregate, so the table is scanned once and only one row per task is shuffled. `frequencies` turns columns
into (column, value) rows that are counted in one exchange, combined before the shuffle; distinct counts, modes, entropy and the like all build on it.
`quantiles` is exact, though only the values near the wanted ranks are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .columns import as_text, ref, value

#: Aggregates that one pass computes at most; wider tables take further passes, so that generated code stays within the JVM's limits.
AGGREGATES_A_PASS = 600


def per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, Callable[[Column], Column]], schema: str) -> DataFrame:
    """One row per column: its name, then each measure, an aggregate of the column's values (NaN is null). schema: of the measures, for a table without columns."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, {schema}")
    step = max(1, AGGREGATES_A_PASS // max(1, len(measures)))
    types = T.StructType.fromDDL(schema)
    parts, values = [], {c: value(df, c) for c in columns}
    for k in range(0, len(columns), step):
        some = columns[k : k + step]
        wide = df.agg(*(m(values[c]).cast(types[name].dataType).alias(f"_{i}_{name}") for i, c in enumerate(some) for name, m in measures.items()))
        rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"_{i}_{name}").alias(name) for name in measures)) for i, c in enumerate(some)))
        parts.append(wide.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def melted(df: DataFrame, columns: Sequence[str], of: Callable[[str], Column] | None = None, kind: str = "string") -> DataFrame:
    """(column, value) rows of the columns given. of: the value of a column, its text unless given."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, value {kind}")
    of = of or (lambda c: as_text(df, c))
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), of(c).cast(kind).alias("value")) for c in columns))))


def short(text: Column, most: int = 64) -> Column:
    """A text by which it can be told from others: itself, or a digest of 256 bits if it is long."""
    return F.when(F.octet_length(text) > most, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


#: Types whose values are told apart as whole numbers, without being written out.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType)


def _whole(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else c


def value_counts_of(df: DataFrame, columns: Sequence[str], nulls: bool = False) -> DataFrame:
    """(place, n): how often each value occurs, without the values: place is the column's place in `columns`. Values travel in their own types, long texts as digests."""
    rows = []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        whole, double = isinstance(kind, _WHOLE), isinstance(kind, (T.FloatType, T.DoubleType))
        v = value(df, c)
        rows.append(F.struct(
            F.lit(i).alias("place"), (_whole(v, kind) if whole else F.lit(None)).cast("long").alias("l"), (v if double else F.lit(None)).cast("double").alias("d"),
            (F.lit(None).cast("string") if whole or double else short(as_text(df, c))).alias("s"),
        ))
    long = df.select(F.inline(F.array(*rows)))
    return (long if nulls else long.where("l is not null or d is not null or s is not null")).groupBy("place", "l", "d", "s").agg(F.count(F.lit(1)).alias("n")).select("place", "n")


def frequencies(df: DataFrame, columns: Sequence[str], nulls: bool = False, digests: bool = False) -> DataFrame:
    """(column, value, n): how often each value occurs. digests: long values are replaced by digests, which is enough where only the counts matter; long texts then don't travel."""
    rows = melted(df, columns, (lambda c: short(as_text(df, c))) if digests else None)
    return (rows if nulls else rows.where("value is not null")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def names_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each name, in a column `column`; so that columns without any value keep their row."""
    return df.sparkSession.createDataFrame([(c,) for c in columns], "column string")


class Shared:
    """with Shared(df): distinct counts and quantiles of df are worked out once, for all columns, and kept on the driver (a few numbers per column); used by a run of many tasks."""

    active: "Shared | None" = None
    PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)

    def __init__(self, df: DataFrame):
        self.df, self._distinct, self._quantiles = df, None, None

    def __enter__(self) -> "Shared":
        self.before, Shared.active = Shared.active, self
        return self

    def __exit__(self, *_) -> None:
        Shared.active = self.before

    def distinct(self, columns: Sequence[str]) -> DataFrame:
        if self._distinct is None:
            self._distinct = {r.column: r.n_unique for r in _distinct_counts(self.df, self.df.columns, False).collect()}
        return self.df.sparkSession.createDataFrame([(c, self._distinct[c]) for c in columns], "column string, n_unique bigint")

    def quantiles(self, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
        if self._quantiles is None:
            numbers = [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.NumericType)]
            self._quantiles = {r.column: (r.n, r.q) for r in _quantiles(self.df, numbers, self.PROBABILITIES).collect()}
        at = [self.PROBABILITIES.index(p) for p in probabilities]
        rows = [(c, n, q and [q[k] for k in at]) for c in columns for n, q in [self._quantiles[c]]]
        return self.df.sparkSession.createDataFrame(rows, "column string, n bigint, q array<double>")


def places_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(place, column) of columns."""
    return df.sparkSession.createDataFrame(list(enumerate(columns)), "place int, column string")


def distinct_counts(df: DataFrame, columns: Sequence[str], count_nulls: bool = False) -> DataFrame:
    """(column, n_unique). Nulls aren't counted unless asked for."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint")
    if Shared.active and Shared.active.df is df and not count_nulls:
        return Shared.active.distinct(columns)
    return _distinct_counts(df, columns, count_nulls)


def _distinct_counts(df: DataFrame, columns: Sequence[str], count_nulls: bool) -> DataFrame:
    counted = value_counts_of(df, columns, count_nulls).groupBy("place").agg(F.count(F.lit(1)).alias("n_unique"))
    return places_of(df, columns).join(F.broadcast(counted), "place", "left").select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


class _Bracket:
    """Values from lo to hi of a column, in which wanted ranks lie; below: how many values are less than lo, inside: how many lie within."""

    def __init__(self, column: int, lo: float, hi: float, ranks: set[int]):
        self.column, self.lo, self.hi, self.ranks, self.below, self.inside = column, lo, hi, ranks, 0, 0

    def holds(self, c: Column) -> Column:
        return (c >= F.lit(self.lo)) & (c <= F.lit(self.hi))


def _wide(df: DataFrame, aggregates: Sequence[Column]) -> list:
    """The values of aggregates, in passes of bounded width."""
    out: list = []
    for k in range(0, len(aggregates), AGGREGATES_A_PASS):
        out += list(df.agg(*(a.alias(f"_{i}") for i, a in enumerate(aggregates[k : k + AGGREGATES_A_PASS]))).first())
    return out


def _narrowed(df: DataFrame, values: Sequence[Column], brackets: list[_Bracket], few: int, accuracy: int) -> list[_Bracket]:
    """Brackets of at most `few` values each, or of values that can't be told further apart; each round counts what lies in a bracket and takes a part of it."""
    done: list[_Bracket] = []
    while brackets:
        counts = _wide(df, [x for b in brackets for x in (F.count_if(values[b.column] < F.lit(b.lo)), F.count_if(b.holds(values[b.column])))])
        todo: list[_Bracket] = []
        for b, below, inside in zip(brackets, counts[::2], counts[1::2]):
            b.below, b.inside = below, inside
            (done if inside <= few or b.lo == b.hi else todo).append(b)
        wanted = [(b, r) for b in todo for r in sorted(b.ranks)]
        eps = 2 / accuracy
        found = _wide(df, [F.percentile_approx(F.when(b.holds(values[b.column]), values[b.column]), F.array(*(F.lit(min(1.0, max(0.0, (r - b.below) / b.inside + e))) for e in (-eps, eps))), accuracy) for b, r in wanted])
        brackets = []
        for (b, r), (lo, hi) in zip(wanted, found):
            part = _Bracket(b.column, lo, hi, {r})
            if (lo, hi) == (b.lo, b.hi):
                part.below, part.inside = b.below, b.inside
                done.append(part)
            else:
                brackets.append(part)
    return done


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], exact: bool = True, accuracy: int = 2_000, few: int = 200_000) -> DataFrame:
    """(column, n, q): q holds the quantiles of the column's values, interpolated between neighbours, null if there are none.

    Exact: approximate quantiles a little below and above each wanted one bracket it; what lies below and in a bracket is counted, and brackets of more than `few` values are narrowed
    further, so only the values near the wanted ranks are ever shuffled and put in order. A few numbers per column and quantile reach the driver. exact=False: one pass with
    percentile_approx."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint, q array<double>")
    if not exact:
        p = F.array(*(F.lit(float(x)) for x in probabilities))
        return per_column(df, columns, {"n": F.count, "q": lambda c: F.percentile_approx(c.cast("double"), p, 10_000)}, "n bigint, q array<double>")
    if Shared.active and Shared.active.df is df and set(probabilities) <= set(Shared.PROBABILITIES):
        return Shared.active.quantiles(columns, probabilities)
    return _quantiles(df, columns, probabilities, accuracy, few)


def _quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 2_000, few: int = 200_000) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint, q array<double>")
    # each value is worked out once a row and then compared with many bounds: the row number keeps the optimizer from putting its expression into every comparison. NaN is beyond all bounds
    rows = df.select(*(ref(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)), F.monotonically_increasing_id().alias("row")).where("row >= 0")
    values = [F.col(f"v{i}") for i in range(len(columns))]
    cuts = F.array(*(F.lit(min(1.0, max(0.0, x + e))) for x in probabilities for e in (-2 / accuracy, 2 / accuracy)))
    measures = {"n": F.count, "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double"), "q": lambda c: F.percentile_approx(c.cast("double"), cuts, accuracy)}
    first = {r.column: r for r in per_column(df, columns, measures, "n bigint, lo double, hi double, q array<double>").collect()}
    place = {c: [x * (first[c].n - 1) for x in probabilities] for c in columns}
    ready: list[_Bracket] = []
    todo: list[_Bracket] = []
    for i, c in enumerate(columns):
        r = first[c]
        if r.n and r.n <= few:
            ready.append(_Bracket(i, r.lo, r.hi, {f(x) for x in place[c] for f in (math.floor, math.ceil)}))
        elif r.n:
            todo += [_Bracket(i, r.q[2 * k], r.q[2 * k + 1], {math.floor(x), math.ceil(x)}) for k, x in enumerate(place[c])]
    sure = []
    for b in _narrowed(rows, values, todo, few, accuracy):
        missed = {r for r in b.ranks if not b.below <= r < b.below + b.inside}
        if missed:  # beyond what the approximation promises: the whole column is narrowed for these
            r = first[columns[b.column]]
            sure += _narrowed(rows, values, [_Bracket(b.column, r.lo, r.hi, missed)], few, accuracy)
            b.ranks -= missed
        sure.append(b)
    ready += sure
    at = {(b.column, r): b.lo for b in ready for r in b.ranks if b.lo == b.hi}
    open_ = [b for b in ready if b.lo < b.hi]
    if open_:
        hit = reduce(lambda a, b: a | b, (b.holds(values[b.column]) for b in open_))
        parts = F.array(*(F.struct(F.lit(k).alias("k"), F.when(b.holds(values[b.column]), values[b.column]).alias("v")) for k, b in enumerate(open_)))
        counted = rows.where(hit).select(F.inline(parts)).where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
        homes = df.sparkSession.createDataFrame([(k, b.below, sorted(b.ranks)) for k, b in enumerate(open_)], "k int, below bigint, ranks array<bigint>")
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
        last = counted.join(F.broadcast(homes), "k").withColumn("last", F.col("below") + upto - 1)
        for r in last.select("k", "v", F.explode(F.expr("filter(ranks, r -> r <= last and r > last - n)")).alias("rank")).collect():  # one row for each wanted rank
            at[open_[r.k].column, r["rank"]] = r.v
    out = []
    for i, c in enumerate(columns):
        ends = [(at[i, math.floor(x)], at[i, math.ceil(x)], x - math.floor(x)) for x in place[c]] if first[c].n else None
        out.append((c, first[c].n, ends and [lo + (hi - lo) * part for lo, hi, part in ends]))
    return df.sparkSession.createDataFrame(out, "column string, n bigint, q array<double>")

"""Which columns an operator looks at, and how values are brought into a common form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _picked(df: DataFrame, names: Iterable[str] | None, kind: tuple) -> list[str]:
    wanted = None if names is None else set(names)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind) and (wanted is None or f.name in wanted)]


def numeric(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    return _picked(df, names, (T.NumericType,))


def strings(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    return _picked(df, names, (T.StringType, T.CharType, T.VarcharType))


def every(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    return _picked(df, names, (T.DataType,))


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def value(df: DataFrame, name: str) -> Column:
    """A column's value, NaN as null and -0.0 as 0.0."""
    return _plain(ref(name), df.schema[name].dataType)


def _plain(c: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(c), c + F.lit(0.0).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def normalised(df: DataFrame) -> DataFrame:
    """NaN becomes null and -0.0 becomes 0.0 in floating-point columns; other columns stay as they are."""
    change = {f.name: value(df, f.name) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(change) if change else df


def as_text(df: DataFrame, name: str) -> Column:
    """A value as a string that tells different values apart: nested ones as JSON, binary ones in hexadecimal."""
    kind = df.schema[name].dataType
    if is_nested(kind):
        return F.when(ref(name).isNotNull(), F.to_json(F.struct(ref(name))))
    if isinstance(kind, T.BinaryType):
        return F.hex(ref(name))
    return value(df, name).cast("string")


def storage_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def complete_rows(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The rows without a null in any of the columns."""
    for name in names:
        df = df.where(value(df, name).isNotNull())
    return df

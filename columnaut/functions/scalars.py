"""Scalar expressions that the operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that count as a date or a time, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyyMMdd", "yyyy/MM/dd")

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
HEX = r"(?i)^[0-9a-f]{16,}\z"
BASE64 = r"^(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def parsed_time(c: Column) -> Column:
    """The timestamp that a string stands for, or null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS), F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(c)))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def has_symbols(c: Column) -> Column:
    """Whether anything but letters, digits, underscores and white space occurs."""
    return c.rlike(r"(?U)[^\w\s]")


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(r"^(?:" + pattern + r")\z")


def share(condition: Column) -> Column:
    """Share of all rows for which a condition holds; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def number_where(condition: Column) -> Column:
    """Number of rows for which a condition holds."""
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0))

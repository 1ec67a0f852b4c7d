"""Column helpers shared by all operators. Everything stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, T.DoubleType | T.FloatType)


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Booleans are not numbers here."""
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_string(f.dataType)]


def missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN of floating columns."""
    c = col(name)
    return c.isNull() | F.isnan(c) if is_floating(df.schema[name].dataType) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, NULL where it is missing."""
    return F.when(~missing(df, name), col(name)) if is_floating(df.schema[name].dataType) else col(name)


def finite(df: DataFrame, name: str) -> Column:
    """The value as a double, NULL where it is missing or infinite."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != INFINITY), c) if is_floating(df.schema[name].dataType) else c


def infinite(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.abs(col(name)) == INFINITY, F.lit(False)) if is_floating(df.schema[name].dataType) else F.lit(False)


def strip(c: Column) -> Column:
    """Without white space at the ends; trim() knows spaces alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def matches(c: Column, pattern: str) -> Column:
    """The whole value matches; rlike() searches, and ``$`` would let a final line break pass."""
    return c.rlike(rf"^(?:{pattern})\z")


def blank(c: Column) -> Column:
    return strip(c) == ""


def changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def long_form(row: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """One output row per record of expressions over a one-row table: the aggregate is computed once."""
    structs = [F.struct(*(c.alias(k) for k, c in r.items())) for r in records]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")

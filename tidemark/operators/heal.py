"""Healing: DataFrame to DataFrame repairs. A repair takes its statistics once and holds them as constants; several repairs that are made
together (``repaired``, ``fit``) share one aggregate for each level of columns that depend on each other. See fitted.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import changed, col, is_numeric, is_string, is_temporal, long_form, missing, numeric_columns, string_columns
from ..functions.formats import to_boolean, to_integer, to_number, to_timestamp
from .fitted import Fitted, Repair, clip, fit, levels, repaired, replaced, shaped

__all__ = ["Fitted", "Repair", "clip", "fit", "levels", "repaired", "replaced", "shaped"]


def impute(df: DataFrame, strategy: str, columns: list[str], value: object = 0) -> DataFrame:
    """mean, median, mode (the smallest of equals) or constant. Means and medians turn whole numbers into doubles; a column
    without values stays as it is."""
    return repaired(df, [Repair("impute", tuple(columns), {"strategy": strategy, "value": value})])


def auto_impute(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Missing numbers take the median, others the mode, or the empty text where a text column has no values."""
    numbers = [c for c in numeric_columns(df) if c not in skip]
    columns = [c for c in df.columns if c not in skip]
    return repaired(df, [Repair("auto_impute", tuple(columns), {"numbers": numbers})])


def drop_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Without rows that miss any of the values."""
    keep = F.lit(True)
    for c in subset or df.columns:
        keep = keep & ~missing(df, c)
    return df.where(keep)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Without rows that miss all values."""
    keep = F.lit(False)
    for c in df.columns:
        keep = keep | ~missing(df, c)
    return df.where(keep)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def clamp(df: DataFrame, method: str, columns: list[str] | None = None, **how) -> DataFrame:
    """iqr (``factor``), zscore (``threshold``) or percentile (``lower_pct``, ``upper_pct``) bounds; clamped columns become doubles. Fewer
    than four finite values, or no spread, leave a column as it is (percentiles bind whatever the spread)."""
    return repaired(df, [Repair("clamp", tuple(columns or numeric_columns(df)), {"method": method, **how})])


def scale(df: DataFrame, columns: list[str], method: str = "minmax") -> DataFrame:
    """minmax to [0, 1], or zscore; a constant column becomes 0."""
    return repaired(df, [Repair("scale", tuple(columns), {"method": method})])


def cast_to(df: DataFrame, c: str, target: str, pattern: str | None = None) -> Column:
    """float, int, datetime, bool or str; what cannot be cast is NULL, and NULL stays NULL even as text."""
    v = col(c)
    if target == "float":
        return to_number(v) if is_string(df.schema[c].dataType) else v.cast("double")
    if target == "int":
        return to_integer(v)
    if target == "datetime":
        return v.cast("timestamp") if is_temporal(df.schema[c].dataType) else to_timestamp(v, pattern)
    if target == "bool":
        return to_boolean(v)
    return v.cast("string")


def type_cast(df: DataFrame, targets: dict[str, str], pattern: str | None = None) -> DataFrame:
    """An int cast of a column that holds a fraction somewhere leaves the column as it is (told by one aggregate)."""
    whole = [c for c, t in targets.items() if t == "int"]
    vetoed: set[str] = set()
    if whole:
        row = df.agg(*(F.coalesce(F.max((to_number(col(c)) != F.floor(to_number(col(c)))).cast("int")), F.lit(0)).alias(f"v{i}") for i, c in enumerate(whole))).first()
        vetoed = {c for i, c in enumerate(whole) if row[f"v{i}"]}
    return replaced(df, {c: cast_to(df, c, t, pattern) for c, t in targets.items() if c not in vetoed})


#: Semantic type to the type it is cast to without being asked.
AUTO_CAST = {"numeric": "float", "numeric_id": "int", "datetime": "datetime", "date": "datetime", "boolean": "bool"}


def auto_cast(df: DataFrame, semantic: dict[str, str]) -> DataFrame:
    return type_cast(df, {c: AUTO_CAST[t] for c, t in semantic.items() if c in df.columns and t in AUTO_CAST and is_string(df.schema[c].dataType)})


def normalise(df: DataFrame, columns: list[str], **how) -> DataFrame:
    return repaired(df, [Repair("normalise", tuple(columns), how)])


def auto_normalise(df: DataFrame, most: int = 50) -> DataFrame:
    """Strips and lower-cases text columns with at most ``most`` distinct values; one aggregate of their names decides."""
    columns = string_columns(df)
    return repaired(df, [Repair("auto_normalise", tuple(columns), {"most": most})]) if columns else df


def standardise(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Format fixers of semantic types, on text columns alone."""
    return repaired(df, [Repair("standardise", tuple(c for c in kinds if c in df.columns), {"kinds": kinds})])


def corrections(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """column, corrections of a repair that keeps rows: ``after`` is made from ``before`` with these columns kept beside as
    <column>__before, so both are read in one pass."""
    row = after.agg(*(F.count_if(changed(col(f"{c}__before").cast("string"), col(c).cast("string"))).alias(f"k{i}") for i, c in enumerate(columns)))
    return long_form(row, [{"column": F.lit(c), "corrections": F.col(f"k{i}")} for i, c in enumerate(columns)])


def remembered(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__before": col(c) for c in columns})


def validate_transformation(before: DataFrame, after: DataFrame) -> DataFrame:
    """warning: rows added, columns added or removed, nulls added, a numeric column no longer numeric."""
    common = [c for c in before.columns if c in after.columns]
    count = lambda d: d.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(missing(d, c)).alias(f"m{i}") for i, c in enumerate(common)))
    row = count(before).select(F.struct("*").alias("b")).crossJoin(count(after).select(F.struct("*").alias("a")))
    records = [{"warning": F.lit("rows increased"), "column": F.lit("*"), "hit": F.col("a.n") > F.col("b.n")}]
    for i, c in enumerate(common):
        records.append({"warning": F.lit("nulls increased"), "column": F.lit(c), "hit": F.col(f"a.m{i}") > F.col(f"b.m{i}")})
        lost = is_numeric(before.schema[c].dataType) and is_string(after.schema[c].dataType)
        records.append({"warning": F.lit("numeric column became text"), "column": F.lit(c), "hit": F.lit(lost)})
    records += [{"warning": F.lit("column removed"), "column": F.lit(c), "hit": F.lit(True)} for c in before.columns if c not in after.columns]
    records += [{"warning": F.lit("column added"), "column": F.lit(c), "hit": F.lit(True)} for c in after.columns if c not in before.columns]
    return long_form(row, records).where("hit").drop("hit")

"""Anomaly detectors; findings are rows of (column, anomaly_type, severity, affected_rows, affected_rate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, finite, long_form, missing, numeric_columns, present
from .profile import duplicate_groups

SEVERITIES = ["critical", "high", "medium", "low"]


def _record(column: str, kind: str, severity: Column, rows: Column, rate: Column) -> dict[str, Column]:
    return {"column": F.lit(column), "anomaly_type": F.lit(kind), "severity": severity, "affected_rows": rows.cast("long"), "affected_rate": F.round(rate, 4)}


def anomaly_missing(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)))

    def record(i: int, c: str) -> dict[str, Column]:
        rate = F.when(F.col("n") > 0, F.col(f"m{i}") / F.col("n")).otherwise(0.0)
        level = F.when(rate > 0.5, "critical").when(rate > 0.3, "high").when(rate > threshold, "medium").otherwise("low")
        return _record(c, "missing_values", level, F.col(f"m{i}"), rate)

    return long_form(row, [record(i, c) for i, c in enumerate(df.columns)]).where("affected_rows > 0")


def zscore_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mu<i>, sd<i> (sample) of finite values."""
    return df.agg(*(f(finite(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("mu", F.avg), ("sd", F.stddev_samp))))


def outlying(df: DataFrame, c: str, i: int, z: float) -> Column:
    """NULL-safe: further than z deviations from the mean; never where all values are equal."""
    return F.coalesce((F.col(f"sd{i}") > 0) & (F.abs(finite(df, c) - F.col(f"mu{i}")) / F.nullif(F.col(f"sd{i}"), F.lit(0.0)) > z), F.lit(False))


def anomaly_zscore(df: DataFrame, z: float = 3.0, columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df)
    both = df.crossJoin(F.broadcast(zscore_stats(df, columns)))
    row = both.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(outlying(df, c, i, z)).alias(f"m{i}") for i, c in enumerate(columns)))

    def record(i: int, c: str) -> dict[str, Column]:
        rate = F.when(F.col("n") > 0, F.col(f"m{i}") / F.col("n")).otherwise(0.0)
        return _record(c, "outlier", F.when(rate > 0.05, "high").otherwise("medium"), F.col(f"m{i}"), rate)

    return long_form(row, [record(i, c) for i, c in enumerate(columns)]).where("affected_rows > 0")


def anomaly_zscore_rows(df: DataFrame, column: str, key: str, z: float = 3.0, samples: int | None = None) -> DataFrame:
    """key and value of the outlying rows; the first ``samples`` in order of the key, or all."""
    hit = df.crossJoin(F.broadcast(zscore_stats(df, [column]))).where(outlying(df, column, 0, z)).select(col(key), col(column))
    return hit.orderBy(col(key)).limit(samples) if samples else hit


def anomaly_duplicates(df: DataFrame) -> DataFrame:
    row = duplicate_groups(df).agg(F.sum("tm_cnt").alias("n"), F.sum(F.col("tm_cnt") - 1).alias("m"))
    rate = F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0)
    return long_form(row, [_record("*", "duplicate_rows", F.when(rate > 0.1, "high").otherwise("medium"), F.col("m"), rate)]).where("affected_rows > 0")


def anomaly_constant(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value; two extremes tell it, so nothing is counted distinct."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(f(present(df, c)).alias(f"{k}{i}") for i, c in enumerate(df.columns) if f_ok(df, c) for k, f in (("lo", F.min), ("hi", F.max))))
    records = [_record(c, "constant_column", F.lit("low"), F.when(F.col(f"lo{i}").eqNullSafe(F.col(f"hi{i}")), F.col("n")).otherwise(0), F.lit(1.0)) for i, c in enumerate(df.columns) if f_ok(df, c)]
    return long_form(row, records).where("affected_rows > 0")


def f_ok(df: DataFrame, c: str) -> bool:
    """Whether the column's type has an order."""
    return df.schema[c].dataType.typeName() not in ("map", "variant")


def anomaly_report(df: DataFrame, z: float = 3.0) -> DataFrame:
    """All findings with the rank of their severity; the most severe first when ordered by (rank, anomaly_type, column)."""
    found = anomaly_missing(df).unionByName(anomaly_zscore(df, z)).unionByName(anomaly_duplicates(df)).unionByName(anomaly_constant(df))
    rank = F.create_map(*(F.lit(x) for k, s in enumerate(SEVERITIES) for x in (s, k)))
    return found.withColumn("severity_rank", rank[F.col("severity")]).orderBy("severity_rank", "anomaly_type", "column")


def anomaly_severity_counts(report: DataFrame) -> DataFrame:
    """severity, cnt; severities without findings have 0."""
    row = report.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return long_form(row, [{"severity": F.lit(s), "cnt": F.col(s)} for s in SEVERITIES])


def filtered(report: DataFrame, severity: str | None = None, text: str = "") -> DataFrame:
    """Findings of a severity whose column or type contains the text, whatever its case."""
    out = report.where(F.col("severity") == severity) if severity else report
    return out.where(F.lower(F.concat_ws(" ", "column", "anomaly_type")).contains(text.lower())) if text else out

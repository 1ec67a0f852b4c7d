"""Semantic types: match rates of all detectors in one aggregate over whole columns; the first above its threshold wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col, is_numeric, is_string, is_temporal, long_form, matches, present, strip
from ..functions.formats import DATE_PATTERNS, DATETIME_PATTERNS, first_parsed, to_number

# Detector patterns and tokens.
EMAIL = r"[a-zA-Z0-9_.+%-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}(?:\s?(?:x|ext)\.?\s?\d{1,5})?"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
URL = r"(?i)https?://[^\s/$.?#].[^\s]*"
IP_V4 = r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IP_V6 = r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
CURRENCY = r"(?i)[£€$¥₹₩฿]?\s?-?\d{1,3}(?:[,._]\d{3})*(?:[.,]\d{1,4})?|-?\d{1,3}(?:[,._]\d{3})*(?:[.,]\d{1,4})?\s?(?:USD|EUR|GBP|JPY|INR|CNY)"
PERCENTAGE = r"-?\d+(?:[.,]\d+)?\s?%"
ZIP_US = r"\d{5}(?:-\d{4})?"
ZIP_CA = r"(?i)[A-Z]\d[A-Z]\s?\d[A-Z]\d"
ZIP_UK = r"(?i)[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}"
NUMERIC_ID = r"\d+"
JSON_START = r"^\s*[\[{]"
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "on", "off"]


@dataclass(frozen=True)
class Detector:
    name: str
    threshold: float
    predicates: tuple[callable, ...]  # each Column of stripped text -> Column; the best one counts


def _json(v: Column) -> Column:
    return v.rlike(JSON_START) & F.try_parse_json(v).isNotNull()


#: In order of precedence. Users may pass a list of their own.
DETECTORS = (
    Detector("boolean", 1.0, (lambda v: F.lower(v).isin(BOOLEAN_TOKENS),)),
    Detector("uuid", 0.90, (lambda v: matches(v, UUID),)),
    Detector("email", 0.85, (lambda v: matches(v, EMAIL),)),
    Detector("phone", 0.85, (lambda v: matches(v, PHONE),)),
    Detector("ip_address", 0.85, (lambda v: matches(v, IP_V4), lambda v: matches(v, IP_V6))),
    Detector("url", 0.85, (lambda v: matches(v, URL),)),
    Detector("currency", 0.80, (lambda v: matches(v, CURRENCY),)),
    Detector("percentage", 0.85, (lambda v: matches(v, PERCENTAGE),)),
    Detector("numeric_id", 0.92, (lambda v: matches(v, NUMERIC_ID),)),
    Detector("datetime", 0.85, (lambda v: first_parsed(v, DATETIME_PATTERNS).isNotNull(),)),
    Detector("date", 0.85, (lambda v: first_parsed(v, DATE_PATTERNS).isNotNull(),)),
    Detector("zipcode", 0.85, (lambda v: matches(v, ZIP_US), lambda v: matches(v, ZIP_CA), lambda v: matches(v, ZIP_UK))),
    Detector("json_string", 0.70, (_json,)),
    Detector("numeric", 0.90, (lambda v: to_number(F.regexp_replace(v, r"[, ]", "")).isNotNull(),)),
)


def semantic_match_rates(df: DataFrame, columns: list[str] | None = None, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """column, detector, rate: the share of present values that match, 0 without values."""
    columns = columns or [f.name for f in df.schema if is_string(f.dataType)]
    exprs = []
    for i, c in enumerate(columns):
        v = strip(present(df, c).cast("string"))
        exprs += [F.avg(F.when(v.isNotNull(), F.coalesce(p(v), F.lit(False)).cast("double"))).alias(f"m{i}_{j}_{k}") for j, d in enumerate(detectors) for k, p in enumerate(d.predicates)]
    row = df.agg(*exprs)

    def best(i: int, j: int, d: Detector) -> Column:
        rates = [F.coalesce(F.col(f"m{i}_{j}_{k}"), F.lit(0.0)) for k in range(len(d.predicates))]
        return F.round(rates[0] if len(rates) == 1 else F.greatest(*rates), 4)

    return long_form(row, [{"column": F.lit(c), "detector": F.lit(d.name), "rate": best(i, j, d)} for i, c in enumerate(columns) for j, d in enumerate(detectors)])


def semantic_types(df: DataFrame, columns: list[str] | None = None, detectors: tuple[Detector, ...] = DETECTORS, *, numeric_dtype_first: bool = True) -> DataFrame:
    """column, semantic_type, confidence.

    Booleans and temporal columns are what their type says, and so are numbers unless ``numeric_dtype_first`` is false. A number
    that identifies rows must be nearly unique; few distinct values make a category, and all else is text."""
    columns = columns or df.columns
    typed = {f.name: "boolean" if isinstance(f.dataType, T.BooleanType) else "datetime" if is_temporal(f.dataType) else "numeric" if numeric_dtype_first and is_numeric(f.dataType) else None for f in df.schema}
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = strip(present(df, c).cast("string"))
        exprs += [F.count(v).alias(f"m{i}_present"), F.count_distinct(v).alias(f"m{i}_unique")]
        if typed[c] is None:
            exprs += [F.avg(F.when(v.isNotNull(), F.coalesce(p(v), F.lit(False)).cast("double"))).alias(f"m{i}_{j}_{k}") for j, d in enumerate(detectors) for k, p in enumerate(d.predicates)]
    row = df.agg(*exprs)

    def record(i: int, c: str) -> dict[str, Column]:
        if typed[c]:
            return {"column": F.lit(c), "semantic_type": F.lit(typed[c]), "confidence": F.lit(1.0)}
        n, unique = F.col(f"m{i}_present"), F.col(f"m{i}_unique")
        kind, sure = F.when(n == 0, F.lit("text")), F.when(n == 0, F.lit(0.5))

        def then(when: Column, name: str, confidence: Column) -> None:
            nonlocal kind, sure
            kind, sure = kind.when(when, F.lit(name)), sure.when(when, confidence)

        for j, d in enumerate(detectors):
            if d.name == "numeric":
                few = (unique / n <= 0.05) | (unique <= 20)
                then(few, "categorical", F.when((unique / n <= 0.02) | (unique <= 10), F.lit(0.90)).otherwise(F.lit(0.75)))
            rates = [F.coalesce(F.col(f"m{i}_{j}_{k}"), F.lit(0.0)) for k in range(len(d.predicates))]
            best = rates[0] if len(rates) == 1 else F.greatest(*rates)
            hit = best >= d.threshold
            then(hit & (unique / n >= 0.8) if d.name == "numeric_id" else hit, d.name, F.lit(0.97) if d.name == "boolean" else F.round(best, 4))
        return {"column": F.lit(c), "semantic_type": kind.otherwise(F.lit("text")), "confidence": sure.otherwise(F.lit(0.5))}

    return long_form(row, [record(i, c) for i, c in enumerate(columns)])


def detected(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Column to semantic type, on the driver: metadata of one row per column."""
    return {r["column"]: r["semantic_type"] for r in semantic_types(df, columns).collect()}


def tagged(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The same rows with each column's semantic type in its metadata."""
    return df.select(*(col(f.name).alias(f.name, metadata=(f.metadata or {}) | ({"semantic_type": types[f.name]} if f.name in types else {})) for f in df.schema))

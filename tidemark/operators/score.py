"""Quality from 0 to 100 over five weighted dimensions. Each score is a lazy plan: fences join as one broadcast row."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, finite, infinite, is_floating, is_string, is_temporal, long_form, matches, missing, numeric_columns, present, ratio, strip
from ..functions.formats import first_parsed, DATE_PATTERNS, DATETIME_PATTERNS, to_number
from .profile import duplicate_groups
from .quantiles import exact_quantiles

# Weights of the dimensions, grades, tokens that mean null, truth tokens.
WEIGHTS = {"completeness": 0.30, "format_validity": 0.25, "uniqueness": 0.20, "schema_consistency": 0.15, "outlier_health": 0.10}
GRADES = [(90, "A"), (80, "B"), (65, "C"), (50, "D")]
NULL_LIKE = ["none", "nan", "null", "na", "n/a", "nil"]
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]
EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s]+"
TIME_NAMES = ["updated", "created", "timestamp", "date"]
LABELS = {"completeness": "Completeness", "format_validity": "Format Validity", "uniqueness": "Uniqueness", "schema_consistency": "Schema Consistency", "outlier_health": "Outlier Health"}


def _invalid_number(v: Column) -> Column:
    return to_number(v).isNull()


#: Semantic type to "is this text invalid"; users may add their own.
CHECKERS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: ~matches(strip(v), EMAIL),
    "numeric": _invalid_number,
    "numeric_id": _invalid_number,
    "datetime": lambda v: first_parsed(strip(v), [*DATETIME_PATTERNS, *DATE_PATTERNS]).isNull(),
    "date": lambda v: first_parsed(strip(v), [*DATETIME_PATTERNS, *DATE_PATTERNS]).isNull(),
    "boolean": lambda v: ~F.lower(strip(v)).isin(BOOLEAN_TOKENS),
}


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], F.lit(GRADES[0][1]))
    for least, letter in GRADES[1:]:
        out = out.when(score >= least, F.lit(letter))
    return out.otherwise(F.lit("F"))


def _ratio_row(issues: Column, total: Column) -> dict[str, Column]:
    return {"ratio": F.round(ratio(issues, total), 6), "issue_count": F.coalesce(issues, F.lit(0)).cast("long")}


def missing_ratio(df: DataFrame) -> DataFrame:
    """ratio of missing cells, issue_count."""
    gone = sum((missing(df, c).cast("int") for c in df.columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(gone).alias("gone"))
    return row.select(*(v.alias(k) for k, v in _ratio_row(F.col("gone"), F.col("n") * len(df.columns)).items()))


def duplicate_ratio(df: DataFrame) -> DataFrame:
    row = duplicate_groups(df).agg(F.sum("tm_cnt").alias("n"), F.sum(F.col("tm_cnt") - 1).alias("again"))
    return row.select(*(v.alias(k) for k, v in _ratio_row(F.col("again"), F.col("n")).items()))


def fences(df: DataFrame, columns: list[str], factor: float = 1.5, *, approximate: bool = False) -> DataFrame:
    """One row: lo<i> and hi<i> of each column. Exact ones are found when this is called, in bounded memory."""
    if approximate:
        row = df.agg(*(F.percentile_approx(finite(df, c), [0.25, 0.75], 10_000).alias(f"q{i}") for i, c in enumerate(columns)))
        ends = [(F.get(F.col(f"q{i}"), 0), F.get(F.col(f"q{i}"), 1)) for i in range(len(columns))]
    else:
        found = exact_quantiles(df, {c: finite(df, c) for c in columns}, dict.fromkeys(columns, [0.25, 0.75]))
        row = df.sparkSession.range(1)
        ends = [tuple(F.lit(x).cast("double") for x in found[c]) for c in columns]
    out = []
    for i, (q1, q3) in enumerate(ends):
        out += [(q1 - factor * (q3 - q1)).alias(f"lo{i}"), (q3 + factor * (q3 - q1)).alias(f"hi{i}")]
    return row.select(*out)


def outlier_ratio_iqr(df: DataFrame, factor: float = 1.5, *, approximate: bool = False) -> DataFrame:
    """Outliers over present numeric cells; a column without spread between its quartiles only adds cells."""
    columns = numeric_columns(df)
    if not columns:
        return df.agg(F.lit(0.0).alias("ratio"), F.lit(0).cast("long").alias("issue_count"))
    both = df.crossJoin(F.broadcast(fences(df, columns, factor, approximate=approximate)))
    out = F.lit(0).cast("long")
    cells = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        v = finite(df, c)
        out = out + F.coalesce(((F.col(f"hi{i}") > F.col(f"lo{i}")) & ((v < F.col(f"lo{i}")) | (v > F.col(f"hi{i}")))).cast("long"), F.lit(0))
        cells = cells + (~missing(df, c)).cast("long")
    row = both.agg(F.sum(out).alias("out"), F.sum(cells).alias("cells"))
    return row.select(*(v.alias(k) for k, v in _ratio_row(F.col("out"), F.col("cells")).items()))


def format_validity(df: DataFrame, semantic: dict[str, str] | None = None) -> DataFrame:
    """ratio of valid present cells, issue_count. A column with a checked semantic type is checked as text, a
    floating one for infinities; ones without values are left out by weighing nothing."""
    bad, cells = F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in df.columns:
        check = CHECKERS.get((semantic or {}).get(c, ""))
        wrong = F.coalesce(check(present(df, c).cast("string")), F.lit(False)) & ~missing(df, c) if check else infinite(df, c)
        bad, cells = bad + wrong.cast("long"), cells + (~missing(df, c)).cast("long")
    row = df.agg(F.sum(bad).alias("bad"), F.sum(cells).alias("cells"))
    return row.select(F.round(F.when(F.col("cells") > 0, 1 - F.col("bad") / F.col("cells")).otherwise(1.0), 6).alias("ratio"), F.coalesce("bad", F.lit(0)).cast("long").alias("issue_count"))


def inconsistent(df: DataFrame, c: str, *, lexical: bool = False) -> Column:
    """Aggregate: a text column holds a token that means null, or a floating one an infinity. With ``lexical`` a text column that
    is partly numbers is inconsistent too, as columns here have one type."""
    kind = df.schema[c].dataType
    if is_string(kind):
        v = F.lower(strip(col(c)))
        out = F.coalesce(F.max(v.isin(NULL_LIKE)), F.lit(False))
        if lexical:
            share = F.avg(F.when(col(c).isNotNull(), to_number(col(c)).isNotNull().cast("double")))
            out = out | F.coalesce((share > 0) & (share < 1), F.lit(False))
        return out
    if is_floating(kind):
        return F.coalesce(F.max(infinite(df, c)), F.lit(False))
    return F.lit(False)


def schema_consistency(df: DataFrame, *, lexical: bool = False) -> DataFrame:
    """ratio of consistent columns, issue_count."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(inconsistent(df, c, lexical=lexical).alias(f"b{i}") for i, c in enumerate(df.columns)))
    bad = sum((F.col(f"b{i}").cast("long") for i in range(len(df.columns))), F.lit(0).cast("long"))
    return row.select(F.round(1 - bad / F.lit(float(len(df.columns))), 6).alias("ratio"), bad.alias("issue_count"))


def timeliness(df: DataFrame, as_of: datetime, days: int = 365) -> DataFrame:
    """Share of rows whose first time column is at most ``days`` old; NULL counts as old, no such column as timely."""
    name = next((f.name for f in df.schema if any(t in f.name.lower() for t in TIME_NAMES) and (is_temporal(f.dataType) or is_string(f.dataType))), None)
    if name is None:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1.0).alias("timeliness"))
    ts = col(name).cast("timestamp") if is_temporal(df.schema[name].dataType) else first_parsed(strip(col(name)), [*DATETIME_PATTERNS, *DATE_PATTERNS])
    fresh = F.coalesce(ts >= F.lit(as_of - timedelta(days=days)).cast("timestamp"), F.lit(False))
    return df.agg(F.round(F.coalesce(F.avg(fresh.cast("double")), F.lit(1.0)), 6).alias("timeliness"))


def measured(df: DataFrame, semantic: dict[str, str] | None = None, *, approximate: bool = False) -> DataFrame:
    """One row of all five ratios and counts. Missing, format and schema share one pass; duplicates and outliers take one each."""
    nulls, bad, cells = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in df.columns:
        check = CHECKERS.get((semantic or {}).get(c, ""))
        gone = missing(df, c)
        wrong = F.coalesce(check(present(df, c).cast("string")), F.lit(False)) & ~gone if check else infinite(df, c)
        nulls, bad, cells = nulls + gone.cast("long"), bad + wrong.cast("long"), cells + (~gone).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("nulls"), F.sum(bad).alias("bad"), F.sum(cells).alias("cells"), *(inconsistent(df, c).alias(f"b{i}") for i, c in enumerate(df.columns)))
    odd = sum((F.col(f"b{i}").cast("long") for i in range(len(df.columns))), F.lit(0).cast("long"))
    one = one.select(
        F.round(ratio(F.col("nulls"), F.col("n") * len(df.columns)), 6).alias("missing"), F.coalesce("nulls", F.lit(0)).alias("missing_n"),
        F.round(F.when(F.col("cells") > 0, 1 - F.col("bad") / F.col("cells")).otherwise(1.0), 6).alias("format"), F.coalesce("bad", F.lit(0)).alias("format_n"),
        F.round(1 - odd / F.lit(float(len(df.columns))), 6).alias("schema"), odd.alias("schema_n"),
    )
    two = duplicate_ratio(df).withColumnsRenamed({"ratio": "duplicate", "issue_count": "duplicate_n"})
    three = outlier_ratio_iqr(df, approximate=approximate).withColumnsRenamed({"ratio": "outlier", "issue_count": "outlier_n"})
    return one.crossJoin(two).crossJoin(three)


def quality_breakdown(df: DataFrame, semantic: dict[str, str] | None = None, *, approximate: bool = False) -> DataFrame:
    """dimension, score, ratio, issue_count, weight: one row per dimension."""
    row = measured(df, semantic, approximate=approximate)
    good = {"completeness": 1 - F.col("missing"), "format_validity": F.col("format"), "uniqueness": 1 - F.col("duplicate"), "schema_consistency": F.col("schema"), "outlier_health": 1 - F.col("outlier")}
    issues = {"completeness": "missing_n", "format_validity": "format_n", "uniqueness": "duplicate_n", "schema_consistency": "schema_n", "outlier_health": "outlier_n"}
    return long_form(row, [{"dimension": F.lit(d), "score": F.round(good[d] * 100, 2), "ratio": F.round(good[d], 6), "issue_count": F.col(issues[d]).cast("long"), "weight": F.lit(w)} for d, w in WEIGHTS.items()])


def quality_score(breakdown: DataFrame) -> DataFrame:
    """total_score, grade."""
    row = breakdown.agg(F.round(F.sum(F.col("score") * F.col("weight")), 2).alias("total_score"))
    return row.withColumn("grade", grade(F.col("total_score")))


def quality_pillars(breakdown: DataFrame) -> DataFrame:
    """pillar, weight, raw_score, weighted_score."""
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return breakdown.select(names[F.col("dimension")].alias("pillar"), "weight", F.col("score").alias("raw_score"), F.round(F.col("score") * F.col("weight"), 2).alias("weighted_score"))


def legacy_pillars(df: DataFrame) -> DataFrame:
    """completeness, uniqueness, validity, consistency as complements."""
    row = measured(df)
    return row.select(F.round(1 - F.col("missing"), 6).alias("completeness"), F.round(1 - F.col("duplicate"), 6).alias("uniqueness"), F.col("format").alias("validity"), F.col("schema").alias("consistency"))


def improvement_suggestions(breakdown: DataFrame, k: int = 5) -> DataFrame:
    """rank, dimension, estimated_gain, action: what raises the total most."""
    gain = F.round((100 - F.col("score")) * F.col("weight"), 2)
    n = F.col("issue_count").cast("string")
    said = {
        "completeness": F.concat(n, F.lit(" empty cells: fill them, or leave their rows out")), "uniqueness": F.concat(n, F.lit(" rows repeat others: keep one of each")),
        "outlier_health": F.concat(n, F.lit(" values lie beyond the fences: clamp them")), "format_validity": F.concat(n, F.lit(" values do not fit their type: standardise them")),
        "schema_consistency": F.concat(n, F.lit(" columns mix kinds of values: cast each to one")),
    }
    text = F.coalesce(*(F.when(F.col("dimension") == d, t) for d, t in said.items()))
    some = breakdown.withColumn("estimated_gain", gain).where((F.col("estimated_gain") >= 0.01) & (F.col("score") < 100))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("estimated_gain")).alias("g"), F.col("dimension"), text.alias("action"))))
    top = some.agg(F.slice(ordered, 1, k).alias("top"))  # five dimensions at most
    return top.select(F.posexplode("top").alias("p", "s")).select((F.col("p") + 1).alias("rank"), F.col("s.dimension").alias("dimension"), (-F.col("s.g")).alias("estimated_gain"), F.col("s.action").alias("action"))


def quality_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, delta, improvement_pct from two breakdowns."""
    b, a = quality_score(before).select(F.col("total_score").alias("before")), quality_score(after).select(F.col("total_score").alias("after"))
    delta = F.round(F.col("after") - F.col("before"), 2)
    return b.crossJoin(a).select("before", "after", delta.alias("delta"), F.round(F.when(F.col("before") > 0, delta / F.col("before") * 100).otherwise(0.0), 2).alias("improvement_pct"))

"""Before and after: cell differences, null rates, pillars, chart rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import changed, col, long_form
from .ordered import own_names, ranged
from .profile import profile_nulls


def _pairs(columns: list[str]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(c).alias("col"), col(f"b_{c}").alias("before"), col(f"a_{c}").alias("after")) for c in columns)))


def _texts(df: DataFrame, columns: list[str], prefix: str) -> list[Column]:
    return [col(c).cast("string").alias(f"{prefix}_{c}") for c in columns]


def diff_keyed(before: DataFrame, after: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """row, col, before, after (as text) of the cells that differ in rows of one key."""
    columns = columns or [c for c in before.columns if c in after.columns and c != key]
    both = before.select(col(key).alias("row"), *_texts(before, columns, "b")).join(after.select(col(key).alias("row"), *_texts(after, columns, "a")), "row")
    return both.select("row", _pairs(columns).alias("p")).select("row", "p.*").where(changed(F.col("before"), F.col("after")))


def positions(df: DataFrame, key: str, name: str = "tm_pos") -> DataFrame:
    """Adds the row's place by key from 0 as ``name``: sorted by ranges, whose sizes are then summed, so no task holds all rows."""
    made = own_names(df)
    at_range, i, base = made("range"), made("i"), made("base")
    dealt = ranged(df, [key], name=at_range)
    local = dealt.withColumn(i, F.row_number().over(Window.partitionBy(at_range).orderBy(col(key))))
    before = Window.orderBy(at_range).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = dealt.groupBy(at_range).agg(F.count(F.lit(1)).alias(made("n"))).select(at_range, F.coalesce(F.sum(made("n")).over(before), F.lit(0)).alias(base))
    return local.join(sizes, at_range).select(*map(col, df.columns), (F.col(base) + F.col(i) - 1).alias(name))


def diff_positional(before: DataFrame, after: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """As diff_keyed, by place in the order of the key: rows beyond the shorter table are left out."""
    columns = columns or [c for c in before.columns if c in after.columns]
    at = own_names(before, after)("pos")
    b, a = positions(before, key, at), positions(after, key, at)
    both = b.select(F.col(at).alias("row"), *_texts(b, columns, "b")).join(a.select(F.col(at).alias("row"), *_texts(a, columns, "a")), "row")
    return both.select("row", _pairs(columns).alias("p")).select("row", "p.*").where(changed(F.col("before"), F.col("after")))


def diff_cells(diff: DataFrame, per_column: int = 500, most: int | None = None) -> DataFrame:
    """The first cells of each column in order of the row: a report with limits. The limit is pushed below the shuffle."""
    by = Window.partitionBy("col").orderBy("row")
    some = diff.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_column).drop("r")
    return some.orderBy("col", "row").limit(most) if most else some


def diff_page(cells: DataFrame, text: str = "", page: int = 0, size: int = 50) -> DataFrame:
    """One page of the cells whose column contains the text."""
    return cells.where(F.lower("col").contains(text.lower())).orderBy("row", "col").offset(page * size).limit(size)


def diff_summary(before: DataFrame, after: DataFrame, diff: DataFrame) -> DataFrame:
    """row_count_before, row_count_after, row_delta, columns_added, columns_removed, changed_cells (uncapped)."""
    n = lambda d, k: d.agg(F.count(F.lit(1)).alias(k))
    row = n(before, "row_count_before").crossJoin(n(after, "row_count_after")).crossJoin(n(diff, "changed_cells"))
    added, removed = [c for c in after.columns if c not in before.columns], [c for c in before.columns if c not in after.columns]
    return row.select("row_count_before", "row_count_after", (F.col("row_count_after") - F.col("row_count_before")).alias("row_delta"), F.lit(",".join(added)).alias("columns_added"), F.lit(",".join(removed)).alias("columns_removed"), "changed_cells")


def null_rate_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, before, after (per cent); 0 where the column has gone."""
    b = profile_nulls(before).select("column", F.col("null_pct").alias("before"))
    a = profile_nulls(after).select("column", F.col("null_pct").alias("after"))
    return b.join(F.broadcast(a), "column", "left").select("column", "before", F.coalesce("after", F.lit(0.0)).alias("after"))


def pillar_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """pillar, before, after, delta from two tables of pillars."""
    b = before.select("pillar", F.col("raw_score").alias("before"))
    a = after.select("pillar", F.col("raw_score").alias("after"))
    return b.join(a, "pillar").select("pillar", "before", "after", F.round(F.col("after") - F.col("before"), 2).alias("delta"))


def null_bar_chart(nulls: DataFrame, k: int = 20) -> DataFrame:
    """column, null_count, null_pct of the columns with the most nulls."""
    return nulls.where("null_count > 0").orderBy(F.desc("null_count"), "column").limit(k).select("column", "null_count", "null_pct")


def duplicate_severity(duplicates: DataFrame) -> DataFrame:
    p = F.col("duplicate_pct")
    return duplicates.select("duplicate_pct", F.when(p == 0, "None").when(p < 1, "Minimal").when(p < 5, "Low").when(p < 15, "Moderate").otherwise("High").alias("severity"))


def box_plot(numeric: DataFrame, quartiles: DataFrame, k: int = 12, pad: float = 0.08) -> DataFrame:
    """column, min, q1, median, q3, max, and the drawn range, padded by a share of the spread."""
    both = numeric.join(quartiles, "column").orderBy("column").limit(k)
    wide = (F.col("max") - F.col("min")) * pad
    return both.select("column", "min", "q1", "median", "q3", "max", F.round(F.col("min") - wide, 6).alias("lo"), F.round(F.col("max") + wide, 6).alias("hi"))


def corrections_by_strategy(log: DataFrame, k: int = 15) -> DataFrame:
    """strategy, corrections, by_ai, by_rule of the strategies with the most."""
    out = log.groupBy("strategy").agg(F.sum("corrections").alias("corrections"), F.sum(F.when(F.col("source") == "ai", F.col("corrections")).otherwise(0)).alias("by_ai"), F.sum(F.when(F.col("source") == "ai", 0).otherwise(F.col("corrections"))).alias("by_rule"))
    return out.orderBy(F.desc("corrections"), "strategy").limit(k)


def total_nulls(nulls: DataFrame) -> DataFrame:
    return nulls.agg(F.sum("null_count").alias("total_nulls"))


def overall_score(delta: DataFrame) -> DataFrame:
    return long_form(delta, [{"stage": F.lit(s), "score": F.col(s)} for s in ("before", "after")])

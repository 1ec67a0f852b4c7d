"""Column and dataset profiles. All columns are measured in one aggregate; a profile is a table with a row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import blank, col, finite, infinite, is_numeric, is_string, is_temporal, long_form, missing, numeric_columns, percent, present, string_columns
from .quantiles import exact_quantiles

TOP_VALUES = 5
#: Values that the sketch of frequent ones tracks.
TRACKED_VALUES = 10_000
BINS = 20
ALLOWED_VALUES = 30
SAMPLE_VALUES = 5

# Patterns that a semantic type implies.
PATTERNS = {
    "email": r"^[a-zA-Z0-9_.+%-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[\d\s\-().]{7,20}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "ip_address": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "zipcode": r"^\d{5}(?:-\d{4})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}",
    "currency": r"^[£€$¥₹]?[\d,]+(\.\d{1,4})?$",
    "percentage": r"^-?\d+(\.\d+)?\s?%$",
}


def _aggregated(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """One pass: n, and each measure of each column under the name m<i>_<measure>."""
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        exprs += [m(df, c).alias(f"m{i}_{k}") for k, m in measures.items()]
    return df.agg(*exprs)


def profile_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, null_count, non_null_count, null_pct."""
    columns = columns or df.columns
    row = _aggregated(df, columns, {"nulls": lambda d, c: F.count_if(missing(d, c))})
    return long_form(row, [{"column": F.lit(c), "n": F.col("n"), "null_count": F.col(f"m{i}_nulls"), "non_null_count": F.col("n") - F.col(f"m{i}_nulls"), "null_pct": percent(F.col(f"m{i}_nulls"), F.col("n"))} for i, c in enumerate(columns)])


def profile_distinct(df: DataFrame, columns: list[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """column, unique_count, unique_pct (of present values). ``approximate`` trades exactness for one pass without a shuffle of the values."""
    columns = columns or df.columns
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    row = _aggregated(df, columns, {"unique": lambda d, c: distinct(present(d, c)), "present": lambda d, c: F.count(present(d, c))})
    return long_form(row, [{"column": F.lit(c), "unique_count": F.col(f"m{i}_unique"), "unique_pct": percent(F.col(f"m{i}_unique"), F.col(f"m{i}_present"))} for i, c in enumerate(columns)])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text), cnt; map-side sums before the one shuffle."""
    pairs = [F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def frequent_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES, *, tracked: int = TRACKED_VALUES) -> tuple[dict[str, list[tuple[str, int]]], list[str], int]:
    """The exact k most frequent values of each column (as text; ties go to the smaller value) where it is proven that they are, the columns
    where it is not, and the number of rows.

    A mergeable sketch of ``tracked`` values names candidates, which are then counted exactly; both passes shuffle no more than candidates.
    A value that the sketch does not name is not more frequent than its last candidate, or than twice its largest error, which is
    below 2.7 rows in ``tracked``, nor than all rows that candidates leave. If the k-th exact count is above that, nothing can be missing."""
    asked = min(4 * k + 16, tracked)
    text = {c: present(df, c).cast("string") for c in columns}
    sketch = []
    for i, c in enumerate(columns):
        sketch += [F.count(text[c]).alias(f"n{i}"), F.call_function("approx_top_k", text[c], F.lit(asked), F.lit(tracked)).alias(f"t{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sketch).first()
    named = {c: {x["item"]: x["count"] for x in row[f"t{i}"] if x["item"] is not None} for i, c in enumerate(columns)}
    hits = [F.when(text[c].isin(list(v)), F.struct(F.lit(i).alias("i"), text[c].alias("value"))) for i, (c, v) in enumerate(named.items()) if v]
    exact: dict[str, dict[str, int]] = {c: {} for c in columns}
    if hits:
        found = df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.value").agg(F.count(F.lit(1)).alias("cnt"))
        for r in found.collect():  # at most ``asked`` rows a column
            exact[columns[r["i"]]][r["value"]] = r["cnt"]
    proven, rest = {}, []
    for i, c in enumerate(columns):
        top = sorted(exact[c].items(), key=lambda x: (-x[1], x[0].encode()))[:k]
        last = min(named[c].values(), default=0) if len(named[c]) + 1 >= asked else 0  # a null may be a candidate
        bound = min(max(last, 2 * 2.7 * row["n"] / tracked), row[f"n{i}"] - sum(exact[c].values()))
        if bound < 1 or (len(top) == k and top[-1][1] > bound):
            proven[c] = top
        else:
            rest.append(c)
    return proven, rest, row["n"]


def profile_top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """column, value, cnt, pct of all rows, rank; ties go to the smaller value. Columns with frequent values are done without shuffling the
    others (see frequent_values); those whose values are all about as rare are counted in full, the rank limit below the shuffle."""
    columns = columns or string_columns(df)
    proven, rest, n = frequent_values(df, columns, k)
    rows = [(c, value, cnt, rank) for c, top in proven.items() for rank, (value, cnt) in enumerate(top, 1)]
    out = df.sparkSession.createDataFrame(rows, "column string, value string, cnt long, rank int")
    if rest:
        by = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
        ranked = value_counts(df, rest).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        out = out.unionByName(ranked)
    return out.select("column", "value", "cnt", percent(F.col("cnt"), F.lit(n)).alias("pct"), "rank")


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, cnt, min, max, mean, std, variance (sample), zeros, negatives, infinite; over finite values but for the last."""
    columns = columns or numeric_columns(df)
    measures = {
        "cnt": lambda d, c: F.count(finite(d, c)), "min": lambda d, c: F.min(finite(d, c)), "max": lambda d, c: F.max(finite(d, c)), "mean": lambda d, c: F.avg(finite(d, c)),
        "std": lambda d, c: F.stddev_samp(finite(d, c)), "variance": lambda d, c: F.var_samp(finite(d, c)),
        "zeros": lambda d, c: F.count_if(finite(d, c) == 0), "negatives": lambda d, c: F.count_if(finite(d, c) < 0), "infinite": lambda d, c: F.count_if(infinite(d, c)),
    }
    row = _aggregated(df, columns, measures)
    return long_form(row, [{"column": F.lit(c)} | {k: F.col(f"m{i}_{k}") for k in measures} for i, c in enumerate(columns)])


def profile_quartiles(df: DataFrame, columns: list[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """column, q1, median, q3, iqr. Exact interpolated quantiles are found in three passes for all columns when this is called, in bounded
    memory; ``approximate`` takes one pass, when rows are read."""
    columns = columns or numeric_columns(df)
    if approximate:
        row = _aggregated(df, columns, {"q": lambda d, c: F.percentile_approx(finite(d, c), [0.25, 0.5, 0.75], 10_000)})
        at = lambda i, k: F.get(F.col(f"m{i}_q"), k)
    else:
        found = exact_quantiles(df, {c: finite(df, c) for c in columns}, dict.fromkeys(columns, [0.25, 0.5, 0.75]))
        row = df.sparkSession.range(1)
        at = lambda i, k: F.lit(found[columns[i]][k]).cast("double")
    return long_form(row, [{"column": F.lit(c), "q1": at(i, 0), "median": at(i, 1), "q3": at(i, 2), "iqr": F.round(at(i, 2) - at(i, 0), 6)} for i, c in enumerate(columns)])


def profile_shape(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, skewness, kurtosis, bias-corrected; NULL below three or four values, or without spread."""
    columns = columns or numeric_columns(df)
    row = _aggregated(df, columns, {"cnt": lambda d, c: F.count(finite(d, c)).cast("double"), "g1": lambda d, c: F.skewness(finite(d, c)), "g2": lambda d, c: F.kurtosis(finite(d, c))})

    def record(i: int, c: str) -> dict[str, Column]:
        n, g1, g2 = F.col(f"m{i}_cnt"), F.col(f"m{i}_g1"), F.col(f"m{i}_g2")
        return {"column": F.lit(c), "skewness": F.when((n >= 3) & ~F.isnan(g1), g1 * F.sqrt(n * (n - 1)) / (n - 2)), "kurtosis": F.when((n >= 4) & ~F.isnan(g2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))}

    return long_form(row, [record(i, c) for i, c in enumerate(columns)])


def profile_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, min_length (of values that are not blank), max_length, mean_length, blank_count."""
    columns = columns or string_columns(df)
    measures = {
        "min_length": lambda d, c: F.min(F.when(~blank(col(c)), F.length(col(c)))), "max_length": lambda d, c: F.max(F.length(col(c))),
        "mean_length": lambda d, c: F.round(F.avg(F.length(col(c))), 2), "blank_count": lambda d, c: F.count_if(blank(col(c))),
    }
    row = _aggregated(df, columns, measures)
    return long_form(row, [{"column": F.lit(c)} | {k: F.col(f"m{i}_{k}") for k in measures} for i, c in enumerate(columns)])


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def profile_datetime(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, min_ts, max_ts (ISO 8601), range_days (whole days)."""
    columns = columns or [f.name for f in df.schema if is_temporal(f.dataType)]
    row = _aggregated(df, columns, {"lo": lambda d, c: F.min(col(c).cast("timestamp")), "hi": lambda d, c: F.max(col(c).cast("timestamp"))})
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return long_form(row, [{"column": F.lit(c), "min_ts": iso(F.col(f"m{i}_lo")), "max_ts": iso(F.col(f"m{i}_hi")), "range_days": F.floor((micros(F.col(f"m{i}_hi")) - micros(F.col(f"m{i}_lo"))) / 86_400_000_000).cast("long")} for i, c in enumerate(columns)])


def _histogram(values: DataFrame, bins: int) -> DataFrame:
    """Equal widths from the least to the greatest of column ``v``, the last bin closed; a constant gets half a unit to either side;
    fewer than two values give no bins. Bins without values have the count 0."""
    edge = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).where("n >= 2")
    edge = edge.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = values.where("v is not null").crossJoin(F.broadcast(edge)).select(F.least(F.lit(bins), F.width_bucket("v", "lo", "hi", F.lit(bins))).cast("int").alias("bin"))
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    frame = edge.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(F.broadcast(counted), "bin", "left").select("bin", F.round(F.col("lo") + (F.col("bin") - 1) * width, 6).alias("bucket_start"), F.round(F.col("lo") + F.col("bin") * width, 6).alias("bucket_end"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def profile_histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin, bucket_start, bucket_end, cnt of finite values; of epoch seconds for a temporal column."""
    if is_temporal(df.schema[column].dataType):
        return _histogram(df.select((micros(col(column)) / 1e6).alias("v")), bins)
    return _histogram(df.select(finite(df, column).alias("v")), bins)


def profile_constraints(df: DataFrame, columns: list[str] | None = None, semantic: dict[str, str] | None = None) -> DataFrame:
    """column, is_nullable, is_unique, is_constant, min_value, max_value, min_length, max_length, pattern."""
    columns, semantic = columns or df.columns, semantic or {}
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        exprs += [F.count_if(missing(df, c)).alias(f"m{i}_nulls"), F.count_distinct(present(df, c)).alias(f"m{i}_unique")]
        value = finite(df, c) if is_numeric(kind) else micros(col(c)) / 1e6 if is_temporal(kind) else F.lit(None).cast("double")
        length = F.length(col(c)) if is_string(kind) else F.lit(None).cast("int")
        exprs += [F.min(value).alias(f"m{i}_lo"), F.max(value).alias(f"m{i}_hi"), F.min(length).alias(f"m{i}_short"), F.max(length).alias(f"m{i}_long")]
    row = df.agg(*exprs)

    def record(i: int, c: str) -> dict[str, Column]:
        m = lambda k: F.col(f"m{i}_{k}")
        return {
            "column": F.lit(c), "is_nullable": m("nulls") > 0, "is_unique": (m("unique") == F.col("n") - m("nulls")) & (m("unique") > 0), "is_constant": m("unique") == 1,
            "min_value": m("lo"), "max_value": m("hi"), "min_length": m("short"), "max_length": m("long"), "pattern": F.lit(PATTERNS.get(semantic.get(c, ""))).cast("string"),
        }

    return long_form(row, [record(i, c) for i, c in enumerate(columns)])


def profile_allowed_values(df: DataFrame, columns: list[str] | None = None, most: int = ALLOWED_VALUES) -> DataFrame:
    """column, value of the columns that have at most ``most`` distinct values. Distinct values are counted before any are gathered."""
    counts = value_counts(df, columns or df.columns)
    few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most)
    return counts.join(F.broadcast(few), "column", "left_semi").select("column", "value")


def profile_samples(df: DataFrame, columns: list[str] | None = None, k: int = SAMPLE_VALUES, seed: int = 0) -> DataFrame:
    """column, samples: up to k distinct present values, those with the smallest seeded hashes."""
    counts = value_counts(df, columns or df.columns).withColumn("h", F.xxhash64(F.lit(seed), "column", "value"))
    by = Window.partitionBy("column").orderBy("h", "value")
    return counts.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """cnt of each distinct row; NULLs are equal, and NaNs are."""
    return df.groupBy(*(col(c) for c in columns or df.columns)).agg(F.count(F.lit(1)).alias("tm_cnt")).select("tm_cnt")


def dataset_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n, duplicate_rows (beyond the first of each), duplicate_pct."""
    out = duplicate_groups(df, columns).agg(F.coalesce(F.sum("tm_cnt"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("tm_cnt") - 1), F.lit(0)).alias("duplicate_rows"))
    return out.withColumn("duplicate_pct", percent(F.col("duplicate_rows"), F.col("n")))


def dataset_completeness(df: DataFrame) -> DataFrame:
    """n, complete_rows, complete_pct."""
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & ~missing(df, c)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("complete_rows"))
    return out.withColumn("complete_pct", percent(F.col("complete_rows"), F.col("n")))


def dtype_category(kind: T.DataType, semantic: str | None = None) -> str:
    if isinstance(kind, T.BooleanType) or semantic == "boolean":
        return "boolean"
    if is_temporal(kind) or semantic in ("date", "datetime"):
        return "datetime"
    if is_numeric(kind) or semantic in ("numeric", "currency", "percentage", "numeric_id"):
        return "numeric"
    if semantic == "categorical":
        return "categorical"
    return "text"


def dataset_type_breakdown(df: DataFrame, semantic: dict[str, str] | None = None) -> DataFrame:
    """dtype_category, cnt of columns, with the number of rows read so that the schema belongs to data."""
    kinds = [dtype_category(f.dataType, (semantic or {}).get(f.name)) for f in df.schema]
    row = df.agg(F.count(F.lit(1)).alias("n"))
    return long_form(row, [{"dtype_category": F.lit(k), "n": F.col("n")} for k in kinds]).groupBy("dtype_category").agg(F.count(F.lit(1)).alias("cnt"), F.max("n").alias("n"))


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row: n, n_columns, duplicate_rows, duplicate_pct, complete_rows, complete_pct, null_cells."""
    whole, nulls = F.lit(True), F.lit(0)
    for c in df.columns:
        gone = missing(df, c)
        whole, nulls = whole & ~gone, nulls + gone.cast("int")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("complete_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells"))
    return row.crossJoin(dataset_duplicates(df).select("duplicate_rows", "duplicate_pct")).select("n", F.lit(len(df.columns)).alias("n_columns"), "duplicate_rows", "duplicate_pct", "complete_rows", percent(F.col("complete_rows"), F.col("n")).alias("complete_pct"), "null_cells")


def size_estimate_mb(df: DataFrame) -> float:
    """What the optimiser holds the table to measure; an estimate."""
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20

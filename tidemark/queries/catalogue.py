"""The queries by name. A query is (view, DataFrame -> DataFrame); its SQL twin is written out, or built per column."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as X
from ..functions.exprs import col
from ..operators import anomaly as N
from ..operators import heal as H
from ..operators import multivariate as MV
from ..operators import ordered as W
from ..operators import profile as P
from ..operators import report as R
from ..operators import score as Q
from ..operators import semantic as D
from ..sources.flatten import flatten_json
from ..staging import staged
from ..streaming.quality import quality_by_day
from . import dirty

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUMBERS = LINE[:8]
LINE_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TEXTS = ["l_returnflag", "l_linestatus"]
CUSTOMER_TEXTS = ["c_name", "c_mktsegment", "email", "phone", "zip", "price_txt", "pct_txt", "active_txt", "amount_txt", "count_txt"]


def add(name: str, view: str | tuple[str, ...], run: Callable[..., DataFrame], sql: str | None = None) -> None:
    views = (view,) if isinstance(view, str) else view
    FOUND[name] = lambda spark, sf_dir: run(*(dirty.table(spark, sf_dir, v) for v in views))
    if sql is not None:
        made = [dirty.sql(v) for v in views if v in dirty.VIEWS]
        body = sql.strip()
        SQL[name] = (f"WITH {', '.join(made)}" + (", " + body[5:] if body.startswith("WITH ") else " " + body)) if made else body


def each(columns: list[str], text: str) -> str:
    return " UNION ALL ".join(text.replace("{c}", c) for c in columns)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# profile
add("profile_nulls", "lineitem_dirty", P.profile_nulls, each(LINE, """SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM lineitem_dirty"""))
add("profile_distinct", "lineitem_dirty", P.profile_distinct, each(LINE, """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0::DOUBLE / count({c}), 2) AS unique_pct FROM lineitem_dirty"""))
_TOP = """SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM customer_dirty), 2) AS pct, (row_number() OVER (ORDER BY count(*) DESC, {c}))::INT AS rank FROM customer_dirty WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""
add("profile_top_values", "customer_dirty", P.profile_top_values, each(CUSTOMER_TEXTS, _TOP))
_NUMERIC = """SELECT '{c}' AS "column", count({c}) AS cnt, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 0) AS variance, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, 0::BIGINT AS infinite FROM lineitem_dirty"""
add("profile_numeric", "lineitem_dirty", lambda d: rounded(rounded(P.profile_numeric(d), "mean", "std"), "variance", digits=0).withColumn("infinite", F.col("infinite").cast("long")), each(LINE_NUMBERS, _NUMERIC))
add("profile_numeric_infinite", "events_dirty", lambda d: rounded(P.profile_numeric(d, ["value"]), "mean", "std", "variance"), """SELECT 'value' AS "column", count(value) FILTER (isfinite(value)) AS cnt, min(value) FILTER (isfinite(value)) AS min, max(value) FILTER (isfinite(value)) AS max, round(avg(value) FILTER (isfinite(value)), 4) AS mean, round(stddev_samp(value) FILTER (isfinite(value)), 4) AS std, round(var_samp(value) FILTER (isfinite(value)), 4) AS variance, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value < 0 AND isfinite(value)) AS negatives, count(*) FILTER (isinf(value)) AS infinite FROM events_dirty""")
add("profile_quartiles", "lineitem_dirty", lambda d: rounded(P.profile_quartiles(d), "q1", "median", "q3", "iqr"), each(LINE_NUMBERS, """SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 4) AS iqr FROM lineitem_dirty"""))
add("profile_shape", "lineitem_dirty", lambda d: rounded(P.profile_shape(d), "skewness", "kurtosis"), each(LINE_NUMBERS, """SELECT '{c}' AS "column", round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis FROM lineitem_dirty"""))
_STRINGS = """SELECT '{c}' AS "column", min(length({c})) FILTER (trim({c}) <> '')::INT AS min_length, max(length({c}))::INT AS max_length, round(avg(length({c})), 2) AS mean_length, count(*) FILTER (trim({c}) = '') AS blank_count FROM TABLE"""
add("profile_strings", "customer_dirty", P.profile_strings, each(CUSTOMER_TEXTS, _STRINGS.replace("TABLE", "customer_dirty")))
add("profile_strings_documents", "documents", lambda d: P.profile_strings(d, ["text", "lang", "source"]), each(["text", "lang", "source"], _STRINGS.replace("TABLE", "documents").replace("trim({c})", r"regexp_replace({c}, '^\s+|\s+$', '', 'g')")))
_DATES = """SELECT '{c}' AS "column", strftime(min({c}), '%Y-%m-%dT%H:%M:%S') AS min_ts, strftime(max({c}), '%Y-%m-%dT%H:%M:%S') AS max_ts, floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0)::BIGINT AS range_days FROM TABLE"""
add("profile_datetime", "orders", P.profile_datetime, _DATES.replace("{c}", "o_orderdate").replace("TABLE", "orders"))
add("profile_datetime_events", "events", P.profile_datetime, _DATES.replace("{c}", "ts").replace("TABLE", "events"))
_HIST = """WITH e AS (SELECT min({v}) AS lo, max({v}) AS hi FROM {t}), p AS (SELECT least(20, floor(({v} - lo) / ((hi - lo) / 20)) + 1)::INT AS bin FROM {t}, e WHERE {v} IS NOT NULL), b AS (SELECT range::INT AS bin FROM range(1, 21))
SELECT b.bin, round(lo + (b.bin - 1) * ((hi - lo) / 20), 6) AS bucket_start, round(lo + b.bin * ((hi - lo) / 20), 6) AS bucket_end, count(p.bin) AS cnt FROM b CROSS JOIN e LEFT JOIN p ON p.bin = b.bin GROUP BY b.bin, lo, hi"""
add("profile_histogram", "lineitem_dirty", lambda d: P.profile_histogram(d, "l_quantity"), _HIST.replace("{v}", "l_quantity").replace("{t}", "lineitem_dirty"))
add("profile_histogram_ts", "events", lambda d: rounded(P.profile_histogram(d, "ts"), "bucket_start", "bucket_end", digits=2), _HIST.replace("{v}", "(epoch_us(ts) / 1e6)").replace("{t}", "events").replace(", 6)", ", 2)"))
_CONSTRAINT = """SELECT '{c}' AS "column", count(*) > count({c}) AS is_nullable, count(DISTINCT {c}) = count({c}) AND count({c}) > 0 AS is_unique, count(DISTINCT {c}) = 1 AS is_constant, {n} AS min_value, {x} AS max_value, {s} AS min_length, {l} AS max_length, {p} AS pattern FROM customer_dirty"""


def _constraint(c: str) -> str:
    text = c in CUSTOMER_TEXTS
    return _CONSTRAINT.replace("{n}", "NULL::DOUBLE" if text else "min({c})::DOUBLE").replace("{x}", "NULL::DOUBLE" if text else "max({c})::DOUBLE").replace("{s}", "min(length({c}))::INT" if text else "NULL::INT").replace("{l}", "max(length({c}))::INT" if text else "NULL::INT").replace("{p}", f"'{P.PATTERNS['email']}'" if c == "email" else "NULL::VARCHAR").replace("{c}", c)


add("profile_constraints", "customer_dirty", lambda d: P.profile_constraints(d, semantic={"email": "email"}), " UNION ALL ".join(_constraint(c) for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "email", "phone", "zip", "price_txt", "pct_txt", "active_txt", "amount_txt", "count_txt"]))
add("profile_allowed_values", "customer_dirty", lambda d: P.profile_allowed_values(d, ["c_nationkey", "c_mktsegment", "email", "active_txt"]), each(["c_nationkey", "c_mktsegment", "email", "active_txt"], """SELECT DISTINCT '{c}' AS "column", {c}::VARCHAR AS value FROM customer_dirty WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM customer_dirty) <= 30"""))
add("profile_samples", "customer_dirty", lambda d: P.profile_samples(d, CUSTOMER_TEXTS))
_GROUPS = "g AS (SELECT count(*) AS k FROM lineitem_dirty GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY " + ", ".join(LINE))
add("dataset_duplicates", "lineitem_dirty", P.dataset_duplicates, f"WITH {_GROUPS} SELECT sum(k)::BIGINT AS n, sum(k - 1)::BIGINT AS duplicate_rows, round(sum(k - 1) * 100.0::DOUBLE / sum(k), 2) AS duplicate_pct FROM g")
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in LINE)
add("dataset_completeness", "lineitem_dirty", P.dataset_completeness, f"SELECT count(*) AS n, count(*) FILTER ({_WHOLE}) AS complete_rows, round(count(*) FILTER ({_WHOLE}) * 100.0::DOUBLE / count(*), 2) AS complete_pct FROM lineitem_dirty")
add("dataset_type_breakdown", "lineitem_dirty", P.dataset_type_breakdown, "SELECT k AS dtype_category, c::BIGINT AS cnt, (SELECT count(*) FROM lineitem_dirty) AS n FROM (VALUES ('numeric', 8), ('text', 2), ('datetime', 1)) v(k, c)")
add("profile_dataset", "lineitem_dirty", P.profile_dataset, f"WITH {_GROUPS} SELECT count(*) AS n, 11::INT AS n_columns, (SELECT sum(k - 1)::BIGINT FROM g) AS duplicate_rows, (SELECT round(sum(k - 1) * 100.0::DOUBLE / sum(k), 2) FROM g) AS duplicate_pct, count(*) FILTER ({_WHOLE}) AS complete_rows, round(count(*) FILTER ({_WHOLE}) * 100.0::DOUBLE / count(*), 2) AS complete_pct, ({' + '.join(f'(count(*) - count({c}))' for c in LINE)})::BIGINT AS null_cells FROM lineitem_dirty")

# semantic types
_FULL = lambda rx: f"regexp_full_match(trim({{c}}), '{rx}')"
_DATE_SQL = "['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%Y', '%m-%d-%Y', '%d.%m.%Y', '%Y.%m.%d', '%b %d, %Y', '%B %d, %Y', '%d %b %Y', '%d %B %Y']"
_TS_SQL = "['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%m/%d/%Y %H:%M:%S']"
_NUM_SQL = r"regexp_full_match(replace(replace(trim({c}), ',', ''), ' ', ''), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity)')"
_RATES = {
    "boolean": "lower(trim({c})) IN ('true', 'false', 'yes', 'no', 'y', 'n', '1', '0', 't', 'f', 'on', 'off')", "uuid": _FULL(D.UUID), "email": _FULL(D.EMAIL), "phone": _FULL(D.PHONE),
    "ip_address": _FULL(D.IP_V4), "url": _FULL(D.URL), "currency": _FULL(D.CURRENCY), "percentage": _FULL(D.PERCENTAGE), "numeric_id": _FULL(D.NUMERIC_ID), "datetime": f"try_strptime(trim({{c}}), {_TS_SQL}) IS NOT NULL",
    "date": f"try_strptime(trim({{c}}), {_DATE_SQL}) IS NOT NULL", "zipcode": _FULL(D.ZIP_US), "json_string": r"regexp_matches(trim({c}), '^\s*[\[{]') AND json_valid(trim({c}))", "numeric": _NUM_SQL,
}


def _rates(columns: list[str], table: str) -> str:
    one = """SELECT '{c}' AS "column", '{d}' AS detector, round(coalesce(avg((PRED)::INT), 0), 4) AS rate FROM {t} WHERE {c} IS NOT NULL"""
    return " UNION ALL ".join(one.replace("PRED", p).replace("{d}", d).replace("{t}", table).replace("{c}", c) for c in columns for d, p in _RATES.items())


add("semantic_match_rates", "customer_dirty", D.semantic_match_rates, _rates(CUSTOMER_TEXTS, "customer_dirty"))
add("semantic_match_rates_pages", "pages", lambda d: D.semantic_match_rates(d, ["url"]), _rates(["url"], "pages"))
add("semantic_match_rates_orders", "orders_dirty", lambda d: D.semantic_match_rates(d, ["date_txt", "datetime_txt"]), _rates(["date_txt", "datetime_txt"], "orders_dirty"))
add("semantic_types", "customer_dirty", lambda d: D.semantic_types(d))
add("semantic_types_events", "events", lambda d: D.semantic_types(d, ["props", "event_type", "value", "ts"]), """SELECT * FROM (VALUES ('props', 'json_string', 1.0::DOUBLE), ('event_type', 'categorical', 0.9::DOUBLE), ('value', 'numeric', 1.0::DOUBLE), ('ts', 'datetime', 1.0::DOUBLE)) v("column", semantic_type, confidence) WHERE (SELECT count(*) FROM events) > 0""")

# scores
_OUT_Q = ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS a{i}, quantile_cont({c}::DOUBLE, 0.75) AS b{i}" for i, c in enumerate(LINE_NUMBERS))
_OUT_N = " + ".join(f"count(*) FILTER (b{i} > a{i} AND ({c} < a{i} - 1.5 * (b{i} - a{i}) OR {c} > b{i} + 1.5 * (b{i} - a{i})))" for i, c in enumerate(LINE_NUMBERS))


def _measures(view: str) -> str:
    """CTE m: one row of ratios and counts of a line-item view."""
    return f"""q AS (SELECT {_OUT_Q} FROM {view}), g_ AS (SELECT count(*) AS k FROM {view} GROUP BY {', '.join(LINE)}), m AS (SELECT
  round(({' + '.join(f'(count(*) - count({c}))' for c in LINE)}) / (count(*) * 11.0::DOUBLE), 6) AS missing, ({' + '.join(f'(count(*) - count({c}))' for c in LINE)})::BIGINT AS missing_n,
  round(1 - ({' + '.join(f'count(*) FILTER (isinf({c}))' for c in LINE_DOUBLES)}) / ({' + '.join(f'count({c})' for c in LINE)})::DOUBLE, 6) AS format, ({' + '.join(f'count(*) FILTER (isinf({c}))' for c in LINE_DOUBLES)})::BIGINT AS format_n,
  round(1 - ({' + '.join(f"max((lower(trim({c})) IN ('none', 'nan', 'null', 'na', 'n/a', 'nil'))::INT)" for c in LINE_TEXTS)} + {' + '.join(f'coalesce(max(isinf({c})::INT), 0)' for c in LINE_DOUBLES)}) / 11.0::DOUBLE, 6) AS schema,
  ({' + '.join(f"max((lower(trim({c})) IN ('none', 'nan', 'null', 'na', 'n/a', 'nil'))::INT)" for c in LINE_TEXTS)} + {' + '.join(f'coalesce(max(isinf({c})::INT), 0)' for c in LINE_DOUBLES)})::BIGINT AS schema_n,
  (SELECT round(sum(k - 1) / sum(k)::DOUBLE, 6) FROM g_) AS duplicate, (SELECT sum(k - 1)::BIGINT FROM g_) AS duplicate_n,
  round(({_OUT_N}) / ({' + '.join(f'count({c})' for c in LINE_NUMBERS)})::DOUBLE, 6) AS outlier, ({_OUT_N})::BIGINT AS outlier_n
  FROM {view}, q)"""


_BREAKDOWN = """SELECT 'completeness' AS dimension, round((1 - missing) * 100, 2) AS score, round(1 - missing, 6) AS ratio, missing_n AS issue_count, 0.3::DOUBLE AS weight FROM m
UNION ALL SELECT 'format_validity', round(format * 100, 2), round(format, 6), format_n, 0.25::DOUBLE FROM m UNION ALL SELECT 'uniqueness', round((1 - duplicate) * 100, 2), round(1 - duplicate, 6), duplicate_n, 0.2::DOUBLE FROM m
UNION ALL SELECT 'schema_consistency', round(schema * 100, 2), round(schema, 6), schema_n, 0.15::DOUBLE FROM m UNION ALL SELECT 'outlier_health', round((1 - outlier) * 100, 2), round(1 - outlier, 6), outlier_n, 0.1::DOUBLE FROM m"""
_M = "WITH " + _measures("lineitem_dirty")
_TOTAL = "round(sum(score * weight), 2)"
_GRADE = f"CASE WHEN {_TOTAL} >= 90 THEN 'A' WHEN {_TOTAL} >= 80 THEN 'B' WHEN {_TOTAL} >= 65 THEN 'C' WHEN {_TOTAL} >= 50 THEN 'D' ELSE 'F' END"
add("quality_breakdown", "lineitem_dirty", Q.quality_breakdown, f"{_M} {_BREAKDOWN}")
add("quality_score", "lineitem_dirty", lambda d: Q.quality_score(Q.quality_breakdown(d)), f"{_M}, b AS ({_BREAKDOWN}) SELECT {_TOTAL} AS total_score, {_GRADE} AS grade FROM b")
_PILLAR = "CASE dimension WHEN 'completeness' THEN 'Completeness' WHEN 'format_validity' THEN 'Format Validity' WHEN 'uniqueness' THEN 'Uniqueness' WHEN 'schema_consistency' THEN 'Schema Consistency' ELSE 'Outlier Health' END"
add("quality_pillars", "lineitem_dirty", lambda d: Q.quality_pillars(Q.quality_breakdown(d)), f"{_M}, b AS ({_BREAKDOWN}) SELECT {_PILLAR} AS pillar, weight, score AS raw_score, round(score * weight, 2) AS weighted_score FROM b")
add("legacy_pillars", "lineitem_dirty", Q.legacy_pillars, f"{_M} SELECT round(1 - missing, 6) AS completeness, round(1 - duplicate, 6) AS uniqueness, format AS validity, schema AS consistency FROM m")
_GAIN = "round((100 - score) * weight, 2)"
_ACTION = "issue_count || CASE dimension WHEN 'completeness' THEN ' empty cells: fill them, or leave their rows out' WHEN 'uniqueness' THEN ' rows repeat others: keep one of each' WHEN 'outlier_health' THEN ' values lie beyond the fences: clamp them' WHEN 'format_validity' THEN ' values do not fit their type: standardise them' ELSE ' columns mix kinds of values: cast each to one' END"
add("improvement_suggestions", "lineitem_dirty", lambda d: Q.improvement_suggestions(Q.quality_breakdown(d)), f"{_M}, b AS ({_BREAKDOWN}) SELECT (row_number() OVER (ORDER BY {_GAIN} DESC, dimension))::INT AS rank, dimension, {_GAIN} AS estimated_gain, {_ACTION} AS action FROM b WHERE {_GAIN} >= 0.01 AND score < 100")
add("missing_ratio", "lineitem_dirty", Q.missing_ratio, f"{_M} SELECT missing AS ratio, missing_n AS issue_count FROM m")
add("duplicate_ratio", "lineitem_dirty", Q.duplicate_ratio, f"{_M} SELECT duplicate AS ratio, duplicate_n AS issue_count FROM m")
add("outlier_ratio_iqr", "lineitem_dirty", Q.outlier_ratio_iqr, f"{_M} SELECT outlier AS ratio, outlier_n AS issue_count FROM m")
_EMAIL_BAD = r"count(*) FILTER (NOT regexp_full_match(trim(email), '[^@\s]+@[^@\s]+\.[^@\s]+'))"
_NUM_BAD = "count(*) FILTER (amount_txt IS NOT NULL AND try_cast(amount_txt AS DOUBLE) IS NULL)"
_BOOL_BAD = "count(*) FILTER (lower(trim(active_txt)) NOT IN ('true', 'false', 'yes', 'no', '1', '0', 't', 'f', 'y', 'n'))"
add("format_validity", "customer_dirty", lambda d: Q.format_validity(d, {"email": "email", "amount_txt": "numeric", "active_txt": "boolean"}), f"SELECT round(1 - ({_EMAIL_BAD} + {_NUM_BAD} + {_BOOL_BAD}) / (count(*) * 13.0::DOUBLE), 6) AS ratio, ({_EMAIL_BAD} + {_NUM_BAD} + {_BOOL_BAD})::BIGINT AS issue_count FROM customer_dirty")
add("schema_consistency", "customer_dirty", Q.schema_consistency, """WITH s AS (SELECT max((lower(trim(c_mktsegment)) IN ('none', 'nan', 'null', 'na', 'n/a', 'nil'))::INT) AS bad FROM customer_dirty) SELECT round(1 - bad / 13.0::DOUBLE, 6) AS ratio, bad::BIGINT AS issue_count FROM s""")
add("timeliness", "orders", lambda d: Q.timeliness(d, datetime(1998, 8, 2)), "SELECT round(avg((o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 365 DAY)::INT), 6) AS timeliness FROM orders")

# anomalies
_LEVEL = "CASE WHEN r > 0.5 THEN 'critical' WHEN r > 0.3 THEN 'high' WHEN r > 0.05 THEN 'medium' ELSE 'low' END"
_MISS = "SELECT c AS \"column\", 'missing_values' AS anomaly_type, " + _LEVEL + " AS severity, m AS affected_rows, round(r, 4) AS affected_rate FROM (" + each(LINE, "SELECT '{c}' AS c, count(*) - count({c}) AS m, (count(*) - count({c})) / count(*)::DOUBLE AS r FROM lineitem_dirty") + ") WHERE m > 0"
_Z = "SELECT c AS \"column\", 'outlier' AS anomaly_type, CASE WHEN r > 0.05 THEN 'high' ELSE 'medium' END AS severity, m AS affected_rows, round(r, 4) AS affected_rate FROM (" + each(LINE_NUMBERS, "SELECT '{c}' AS c, count(*) FILTER (abs({c} - mu) / sd > 3) AS m, count(*) FILTER (abs({c} - mu) / sd > 3) / count(*)::DOUBLE AS r FROM lineitem_dirty, (SELECT avg({c}::DOUBLE) AS mu, stddev_samp({c}::DOUBLE) AS sd FROM lineitem_dirty)") + ") WHERE m > 0"
_DUP = f"SELECT '*' AS \"column\", 'duplicate_rows' AS anomaly_type, CASE WHEN sum(k - 1) / sum(k) > 0.1 THEN 'high' ELSE 'medium' END AS severity, sum(k - 1)::BIGINT AS affected_rows, round(sum(k - 1) / sum(k), 4) AS affected_rate FROM ({_GROUPS[6:-1]}) HAVING sum(k - 1) > 0"
_CONST = "SELECT c AS \"column\", 'constant_column' AS anomaly_type, 'low' AS severity, n AS affected_rows, 1.0::DOUBLE AS affected_rate FROM (" + each(LINE, "SELECT '{c}' AS c, count(*) AS n, count(DISTINCT {c}) AS k FROM lineitem_dirty") + ") WHERE k <= 1"
add("anomaly_missing", "lineitem_dirty", N.anomaly_missing, _MISS)
add("anomaly_zscore", "lineitem_dirty", N.anomaly_zscore, _Z)
add("anomaly_duplicates", "lineitem_dirty", N.anomaly_duplicates, _DUP)
add("anomaly_constant", "events", lambda d: N.anomaly_constant(d.where("event_type is not null").select("event_id", F.lit("fixed").alias("fixed"), F.lit(None).cast("int").alias("empty"), "value")), """SELECT c AS "column", 'constant_column' AS anomaly_type, 'low' AS severity, (SELECT count(*) FROM events) AS affected_rows, 1.0::DOUBLE AS affected_rate FROM (VALUES ('fixed'), ('empty')) v(c)""")
add("anomaly_zscore_rows", "lineitem_dirty", lambda d: N.anomaly_zscore_rows(d, "l_extendedprice", "l_orderkey"), "WITH d AS MATERIALIZED (SELECT l_orderkey, l_extendedprice FROM lineitem_dirty), m AS MATERIALIZED (SELECT avg(l_extendedprice) AS mu, stddev_samp(l_extendedprice) AS sd FROM d) SELECT l_orderkey, l_extendedprice FROM d, m WHERE abs(l_extendedprice - mu) / sd > 3")
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_ALL = f"({_MISS}) UNION ALL ({_Z}) UNION ALL ({_DUP}) UNION ALL ({_CONST})"
add("anomaly_report", "lineitem_dirty", N.anomaly_report, f"SELECT *, {_RANK} AS severity_rank FROM ({_ALL})")
add("anomaly_severity_counts", "lineitem_dirty", lambda d: N.anomaly_severity_counts(N.anomaly_report(d)), f"WITH r AS ({_ALL}) SELECT s AS severity, (SELECT count(*) FROM r WHERE severity = s) AS cnt FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(s)")
add("anomaly_multivariate", "lineitem_dirty", lambda d: MV.multivariate_outliers(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], only=True).select("l_orderkey", "l_linenumber", "tm_isolation", "tm_lof"))

# healing: missing values
_EV = lambda d: d.select("event_id", "value")
add("heal_mean_impute", "events_gaps", lambda d: rounded(H.impute(_EV(d), "mean", ["value"]), "value"), "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM events_gaps)), 4) AS value FROM events_gaps")
add("heal_median_impute", "events_gaps", lambda d: rounded(H.impute(_EV(d), "median", ["value"]), "value"), "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_gaps)), 4) AS value FROM events_gaps")
add("heal_mode_impute", "orders_dirty", lambda d: H.impute(d.select("o_orderkey", "o_orderpriority"), "mode", ["o_orderpriority"]), "SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_dirty WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM orders_dirty")
add("heal_constant_impute", "events_gaps", lambda d: H.impute(_EV(d), "constant", ["value"], -1), "SELECT event_id, coalesce(value, -1) AS value FROM events_gaps")
add("heal_auto_impute", "events_gaps", lambda d: rounded(H.auto_impute(_EV(d), skip=("event_id",)), "value"), "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_gaps)), 4) AS value FROM events_gaps")
add("heal_drop_rows", "lineitem_dirty", lambda d: H.drop_rows(d).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("cnt")), f"SELECT l_linestatus, count(*) AS cnt FROM lineitem_dirty WHERE {_WHOLE} GROUP BY 1")
add("heal_drop_column", "customer_dirty", lambda d: H.drop_columns(d.select("c_custkey", "email", "phone"), ["phone"]), "SELECT c_custkey, email FROM customer_dirty")
add("drop_blank_rows", "events_gaps", lambda d: H.drop_blank_rows(d.select("value")).agg(F.count(F.lit(1)).alias("cnt")), "SELECT count(value) AS cnt FROM events_gaps")
_PAST, _FUTURE = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
add("heal_ffill", "events_gaps", lambda d: W.forward_fill(_EV(d), "value", "event_id"), f"SELECT event_id, last_value(value IGNORE NULLS) {_PAST} AS value FROM events_gaps")
add("heal_bfill", "events_gaps", lambda d: W.backward_fill(_EV(d), "value", "event_id"), f"SELECT event_id, first_value(value IGNORE NULLS) {_FUTURE} AS value FROM events_gaps")
add("heal_ffill_by_user", "events_gaps", lambda d: W.forward_fill(d.select("event_id", "user_id", "value"), "value", "event_id", ["user_id"]), "SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events_gaps")
add("heal_interpolate", "events_gaps", lambda d: rounded(W.interpolate(_EV(d), "value", "event_id"), "value"), f"""WITH i AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS i FROM events_gaps), p AS (SELECT *, last_value(value IGNORE NULLS) {_PAST} AS pv, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) {_PAST} AS pi, first_value(value IGNORE NULLS) {_FUTURE} AS nv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) {_FUTURE} AS ni FROM i)
SELECT event_id, round(coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv), 4) AS value FROM p""")

# healing: duplicates
_EVK = lambda d: d.select("event_id", "user_id", "event_type", "value")
for _keep, _order in (("first", "ASC"), ("last", "DESC")):
    add(f"dedup_{_keep}", "events", lambda d, k=_keep: W.deduplicate(_EVK(d), "event_id", ["user_id", "event_type"], k), f"SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {_order}) = 1")
add("dedup_none", "events", lambda d: W.deduplicate(_EVK(d), "event_id", ["user_id", "event_type"], False), "SELECT event_id, user_id, event_type, value FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) = 1")
add("dedup_ignore_columns", "events", lambda d: W.deduplicate(_EVK(d), "event_id", None, "first", ["value"]), "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
add("dedup_rows", "lineitem_dirty", lambda d: W.deduplicate(d, None).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("cnt")), "SELECT l_linestatus, count(*) AS cnt FROM (SELECT DISTINCT * FROM lineitem_dirty) GROUP BY 1")

# healing: types
_CAST = lambda c, t: lambda d: H.type_cast(d.select("c_custkey", c), {c: t})
add("heal_cast_float", "customer_dirty", _CAST("amount_txt", "float"), "SELECT c_custkey, try_cast(amount_txt AS DOUBLE) AS amount_txt FROM customer_dirty")
add("heal_cast_int", "customer_dirty", _CAST("count_txt", "int"), "SELECT c_custkey, try_cast(count_txt AS BIGINT) AS count_txt FROM customer_dirty")
add("heal_cast_int_vetoed", "customer_dirty", _CAST("amount_txt", "int"), "SELECT c_custkey, amount_txt FROM customer_dirty")
add("heal_cast_bool", "customer_dirty", lambda d: H.type_cast(d.select("c_custkey", "active_txt"), {"active_txt": "bool"}).withColumn("active_txt", F.col("active_txt").cast("string")), "SELECT c_custkey, CASE WHEN lower(trim(active_txt)) IN ('1', 'true', 'yes', 'y', 't', 'on') THEN 'true' WHEN lower(trim(active_txt)) IN ('0', 'false', 'no', 'n', 'f', 'off') THEN 'false' END AS active_txt FROM customer_dirty")
add("heal_cast_str", "customer_dirty", _CAST("c_nationkey", "str"), "SELECT c_custkey, c_nationkey::VARCHAR AS c_nationkey FROM customer_dirty")
add("heal_cast_datetime", "orders_dirty", lambda d: H.type_cast(d.select("o_orderkey", "date_txt"), {"date_txt": "datetime"}).withColumn("date_txt", F.date_format("date_txt", "yyyy-MM-dd HH:mm:ss")), f"SELECT o_orderkey, strftime(try_strptime(date_txt, {_DATE_SQL}), '%Y-%m-%d %H:%M:%S') AS date_txt FROM orders_dirty")
add("heal_auto_cast", "customer_dirty", lambda d: H.auto_cast(d.select("c_custkey", "amount_txt", "active_txt"), {"amount_txt": "numeric", "active_txt": "boolean"}).withColumn("active_txt", F.col("active_txt").cast("string")), "SELECT c_custkey, try_cast(amount_txt AS DOUBLE) AS amount_txt, CASE WHEN lower(trim(active_txt)) IN ('1', 'true', 'yes', 'y', 't', 'on') THEN 'true' WHEN lower(trim(active_txt)) IN ('0', 'false', 'no', 'n', 'f', 'off') THEN 'false' END AS active_txt FROM customer_dirty")

# healing: outliers and scaling
_SUMS = lambda d: d.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("l_extendedprice"), 1).alias("total"), F.round(F.max("l_extendedprice"), 4).alias("top"))
_CLAMPED = "SELECT l_linestatus, count(*) AS cnt, round(sum(CASE WHEN l_extendedprice < lo THEN lo WHEN l_extendedprice > hi THEN hi ELSE l_extendedprice END), 1) AS total, round(max(CASE WHEN l_extendedprice < lo THEN lo WHEN l_extendedprice > hi THEN hi ELSE l_extendedprice END), 4) AS top FROM lineitem_dirty, (SELECT {lo} AS lo, {hi} AS hi FROM lineitem_dirty) GROUP BY 1"
_QC = lambda q: f"quantile_cont(l_extendedprice, {q})"
_IQR = _CLAMPED.replace("{lo}", f"{_QC(0.25)} - 1.5 * ({_QC(0.75)} - {_QC(0.25)})").replace("{hi}", f"{_QC(0.75)} + 1.5 * ({_QC(0.75)} - {_QC(0.25)})")
add("heal_iqr_clamp", "lineitem_dirty", lambda d: _SUMS(H.clamp(d, "iqr", ["l_extendedprice"])), _IQR)
add("heal_auto_cap", "lineitem_dirty", lambda d: _SUMS(H.clamp(d, "iqr")), _IQR)
add("heal_zscore_clamp", "lineitem_dirty", lambda d: _SUMS(H.clamp(d, "zscore", ["l_extendedprice"])), _CLAMPED.replace("{lo}", "avg(l_extendedprice) - 3 * stddev_samp(l_extendedprice)").replace("{hi}", "avg(l_extendedprice) + 3 * stddev_samp(l_extendedprice)"))
add("heal_percentile_clamp", "lineitem_dirty", lambda d: _SUMS(H.clamp(d, "percentile", ["l_extendedprice"])), _CLAMPED.replace("{lo}", _QC(0.01)).replace("{hi}", _QC(0.99)))
add("heal_minmax_normalize", "customer", lambda d: rounded(H.scale(d.select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal", digits=6), "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
add("heal_zscore_normalize", "customer", lambda d: rounded(H.scale(d.select("c_custkey", "c_acctbal"), ["c_acctbal"], "zscore"), "c_acctbal", digits=6), "SELECT c_custkey, round((c_acctbal - mu) / sd, 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS mu, stddev_samp(c_acctbal) AS sd FROM customer)")

# healing: categories and formats
_PRI = lambda d: d.select("o_orderkey", "o_orderpriority")
add("heal_category_normalize", "orders_dirty", lambda d: H.normalise(_PRI(d), ["o_orderpriority"], case="upper"), "SELECT o_orderkey, upper(trim(o_orderpriority)) AS o_orderpriority FROM orders_dirty")
add("heal_category_alias", "orders_dirty", lambda d: H.normalise(_PRI(d), ["o_orderpriority"], aliases={"1-urgent": "urgent", "2-high": "high"}), "SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'high' ELSE lower(trim(o_orderpriority)) END AS o_orderpriority FROM orders_dirty")
add("heal_category_unknown", "orders_dirty", lambda d: H.normalise(_PRI(d), ["o_orderpriority"], allowed=["1-urgent", "2-high"]), "SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL THEN NULL WHEN lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') THEN lower(trim(o_orderpriority)) ELSE 'UNKNOWN' END AS o_orderpriority FROM orders_dirty")
add("heal_auto_normalize", "customer_dirty", lambda d: H.auto_normalise(d.select("c_custkey", "c_mktsegment", "c_name")), "SELECT c_custkey, lower(trim(c_mktsegment)) AS c_mktsegment, c_name FROM customer_dirty")
_FIX = lambda c, f: lambda d: d.select("c_custkey", col(c).alias("raw"), f(col(c)).alias("fixed"))
_DIG = "regexp_replace({c}, '[^0-9]', '', 'g')"
add("fmt_email", "customer_dirty", _FIX("email", X.fix_email), "SELECT c_custkey, email AS raw, lower(trim(email)) AS fixed FROM customer_dirty")
add("fmt_phone", "customer_dirty", _FIX("phone", X.fix_phone), "WITH p AS (SELECT c_custkey, phone, " + _DIG.replace("{c}", "phone") + " AS g FROM customer_dirty) SELECT c_custkey, phone AS raw, CASE WHEN length(g) = 10 THEN '+1' || g WHEN length(g) = 11 AND g LIKE '1%' THEN '+' || g ELSE g END AS fixed FROM p")
add("fmt_currency", "customer_dirty", _FIX("price_txt", X.fix_currency), "SELECT c_custkey, price_txt AS raw, coalesce(try_cast(regexp_replace(price_txt, '[$,]', '', 'g') AS DOUBLE)::VARCHAR, price_txt) AS fixed FROM customer_dirty")
add("fmt_percentage", "customer_dirty", _FIX("pct_txt", X.fix_percentage), "SELECT c_custkey, pct_txt AS raw, coalesce(try_cast(rtrim(trim(pct_txt), '%') AS DOUBLE)::VARCHAR, pct_txt) AS fixed FROM customer_dirty")
add("fmt_zipcode", "customer_dirty", _FIX("zip", X.fix_zipcode), "WITH p AS (SELECT c_custkey, zip, " + _DIG.replace("{c}", "zip") + " AS g FROM customer_dirty) SELECT c_custkey, zip AS raw, CASE WHEN length(g) BETWEEN 3 AND 5 THEN lpad(g, 5, '0') ELSE zip END AS fixed FROM p")
add("fmt_date", "orders_dirty", lambda d: d.select("o_orderkey", F.col("date_txt").alias("raw"), X.fix_date(F.col("date_txt")).alias("fixed")), f"SELECT o_orderkey, date_txt AS raw, coalesce(strftime(try_strptime(date_txt, {_DATE_SQL}), '%Y-%m-%d'), date_txt) AS fixed FROM orders_dirty")
add("fmt_datetime", "orders_dirty", lambda d: d.select("o_orderkey", F.col("datetime_txt").alias("raw"), X.fix_datetime(F.col("datetime_txt")).alias("fixed")), f"SELECT o_orderkey, datetime_txt AS raw, coalesce(strftime(try_strptime(datetime_txt, {_TS_SQL}), '%Y-%m-%dT%H:%M:%S'), datetime_txt) AS fixed FROM orders_dirty")
add("fmt_url", "pages", lambda d: d.select("page_id", F.upper("url").alias("raw"), X.fix_url(F.upper("url")).alias("fixed")), r"WITH p AS (SELECT page_id, upper(url) AS u, regexp_extract(upper(url), '^([^:/]*://[^/]*)', 1) AS h FROM pages) SELECT page_id, u AS raw, lower(h) || substr(u, length(h) + 1) AS fixed FROM p")
add("heal_auto_format", "customer_dirty", lambda d: H.standardise(d.select("c_custkey", "email", "zip"), {"email": "email", "zip": "zipcode", "c_custkey": "phone"}), "SELECT c_custkey, lower(trim(email)) AS email, lpad(zip, CASE WHEN length(zip) BETWEEN 3 AND 5 THEN 5 ELSE length(zip) END::INT, '0') AS zip FROM customer_dirty")


# the whole repair, reports
def healed_lines(d: DataFrame) -> DataFrame:
    """Rows without repeats are written once; the repairs, of columns of their own, share the passes over them."""
    d = staged(W.deduplicate(d, None), "deduplicated")
    return H.repaired(d, [H.Repair("impute", ("l_quantity",), {"strategy": "median"}), H.Repair("clamp", ("l_extendedprice",), {"method": "iqr"}), H.Repair("normalise", ("l_returnflag",), {"case": "upper"})])


_HEALED = f"""u AS (SELECT DISTINCT * FROM lineitem_dirty), f AS (SELECT quantile_cont(l_quantity, 0.5) AS med, {_QC(0.25)} - 1.5 * ({_QC(0.75)} - {_QC(0.25)}) AS lo, {_QC(0.75)} + 1.5 * ({_QC(0.75)} - {_QC(0.25)}) AS hi FROM u),
healed AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(l_quantity, med) AS l_quantity, CASE WHEN l_extendedprice < lo THEN lo WHEN l_extendedprice > hi THEN hi ELSE l_extendedprice END AS l_extendedprice, l_discount, l_tax, upper(trim(l_returnflag)) AS l_returnflag, l_linestatus, l_shipdate FROM u, f)"""
add("heal_pipeline", "lineitem_dirty", lambda d: healed_lines(d).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 1).alias("price")), f"WITH {_HEALED} SELECT l_returnflag, count(*) AS cnt, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 1) AS price FROM healed GROUP BY 1")
_AFTER = _measures("healed").replace("q AS", "q2 AS").replace("g_ ", "g2_ ").replace("FROM g_", "FROM g2_").replace(", m AS", ", m2 AS").replace("FROM healed, q)", "FROM healed, q2)")
_BOTH = f"{_M}, {_HEALED}, {_AFTER}, b AS ({_BREAKDOWN}), a AS ({_BREAKDOWN.replace('FROM m', 'FROM m2')})"
_B, _A = "(SELECT round(sum(score * weight), 2) FROM b)", "(SELECT round(sum(score * weight), 2) FROM a)"
_DELTA = f"SELECT {_B} AS before, {_A} AS after, round({_A} - {_B}, 2) AS delta, round(round({_A} - {_B}, 2) / {_B} * 100, 2) AS improvement_pct"
add("quality_delta", "lineitem_dirty", lambda d: Q.quality_delta(Q.quality_breakdown(d), Q.quality_breakdown(healed_lines(d))), f"{_BOTH} {_DELTA}")
add("overall_score", "lineitem_dirty", lambda d: R.overall_score(Q.quality_delta(Q.quality_breakdown(d), Q.quality_breakdown(healed_lines(d)))), f"{_BOTH} SELECT 'before' AS stage, {_B} AS score UNION ALL SELECT 'after', {_A}")
add("pillar_comparison", "lineitem_dirty", lambda d: R.pillar_comparison(Q.quality_pillars(Q.quality_breakdown(d)), Q.quality_pillars(Q.quality_breakdown(healed_lines(d)))), f"{_BOTH} SELECT {_PILLAR.replace('dimension', 'b.dimension')} AS pillar, b.score AS before, a.score AS after, round(a.score - b.score, 2) AS delta FROM b JOIN a ON a.dimension = b.dimension")
add("null_rate_comparison", "lineitem_dirty", lambda d: R.null_rate_comparison(d, healed_lines(d)), f"WITH {_HEALED} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", (SELECT round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) FROM lineitem_dirty) AS before, (SELECT round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) FROM healed) AS after""" for c in LINE))
add("validate_transformation", "lineitem_dirty", lambda d: H.validate_transformation(healed_lines(d), d), f"WITH {_HEALED} SELECT 'rows increased' AS warning, '*' AS \"column\" WHERE (SELECT count(*) FROM lineitem_dirty) > (SELECT count(*) FROM healed) UNION ALL SELECT 'nulls increased', 'l_quantity' WHERE (SELECT count(*) - count(l_quantity) FROM lineitem_dirty) > (SELECT count(*) - count(l_quantity) FROM healed)")
add("heal_corrections", "customer_dirty", lambda d: H.corrections(d, H.standardise(H.remembered(d, ["email", "zip", "phone"]), {"email": "email", "zip": "zipcode", "phone": "phone"}), ["email", "zip", "phone"]), """SELECT 'email' AS "column", count(*) FILTER (email IS DISTINCT FROM lower(trim(email))) AS corrections FROM customer_dirty UNION ALL SELECT 'zip', count(*) FILTER (length(zip) BETWEEN 3 AND 4) FROM customer_dirty UNION ALL SELECT 'phone', count(*) FROM customer_dirty""")
_FILLED = "a AS (SELECT event_id, coalesce(value, 0) AS value FROM events_gaps)"
_FILL = lambda d: H.impute(_EV(d), "constant", ["value"], 0)
add("diff_keyed", "events_gaps", lambda d: R.diff_keyed(_EV(d), _FILL(d), "event_id"), f"WITH {_FILLED} SELECT b.event_id AS row, 'value' AS col, b.value::VARCHAR AS before, a.value::VARCHAR AS after FROM events_gaps b JOIN a ON a.event_id = b.event_id WHERE b.value IS DISTINCT FROM a.value")
add("diff_positional", "events_gaps", lambda d: R.diff_positional(d.select("event_id", "event_type"), d.where("event_id % 100 <> 7").select("event_id", "event_type"), "event_id", ["event_type"]), "WITH b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row, event_type FROM events_gaps), a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row, event_type FROM events_gaps WHERE event_id % 100 <> 7) SELECT b.row, 'event_type' AS col, b.event_type AS before, a.event_type AS after FROM b JOIN a ON a.row = b.row WHERE b.event_type <> a.event_type")
add("diff_cells", "events_gaps", lambda d: R.diff_cells(R.diff_keyed(_EV(d), _FILL(d), "event_id")), f"WITH {_FILLED} SELECT b.event_id AS row, 'value' AS col, b.value::VARCHAR AS before, a.value::VARCHAR AS after FROM events_gaps b JOIN a ON a.event_id = b.event_id WHERE b.value IS DISTINCT FROM a.value ORDER BY row LIMIT 500")
add("diff_summary", "events_gaps", lambda d: R.diff_summary(_EV(d), _FILL(d), R.diff_keyed(_EV(d), _FILL(d), "event_id")), "SELECT count(*) AS row_count_before, count(*) AS row_count_after, 0::BIGINT AS row_delta, '' AS columns_added, '' AS columns_removed, count(*) - count(value) AS changed_cells FROM events_gaps")
add("null_bar_chart", "lineitem_dirty", lambda d: R.null_bar_chart(P.profile_nulls(d)), "SELECT 'l_quantity' AS \"column\", count(*) - count(l_quantity) AS null_count, round((count(*) - count(l_quantity)) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM lineitem_dirty")
add("total_nulls", "lineitem_dirty", lambda d: R.total_nulls(P.profile_nulls(d)), "SELECT count(*) - count(l_quantity) AS total_nulls FROM lineitem_dirty")
add("duplicate_severity", "lineitem_dirty", lambda d: R.duplicate_severity(P.dataset_duplicates(d)), f"WITH {_GROUPS}, p AS (SELECT round(sum(k - 1) * 100.0::DOUBLE / sum(k), 2) AS duplicate_pct FROM g) SELECT duplicate_pct, CASE WHEN duplicate_pct = 0 THEN 'None' WHEN duplicate_pct < 1 THEN 'Minimal' WHEN duplicate_pct < 5 THEN 'Low' WHEN duplicate_pct < 15 THEN 'Moderate' ELSE 'High' END AS severity FROM p")
_BOX = each(sorted(LINE_NUMBERS), """SELECT '{c}' AS "column", min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, max({c})::DOUBLE AS max, round(min({c})::DOUBLE - (max({c}) - min({c}))::DOUBLE * 0.08::DOUBLE, 4) AS lo, round(max({c})::DOUBLE + (max({c}) - min({c}))::DOUBLE * 0.08::DOUBLE, 4) AS hi FROM lineitem_dirty""")
add("box_plot", "lineitem_dirty", lambda d: rounded(R.box_plot(P.profile_numeric(d), P.profile_quartiles(d)), "q1", "median", "q3", "lo", "hi"), _BOX)
add("anomaly_filter", "lineitem_dirty", lambda d: N.filtered(N.anomaly_report(d), "medium", "L_"), f"SELECT *, {_RANK} AS severity_rank FROM ({_ALL}) WHERE severity = 'medium' AND lower(\"column\" || ' ' || anomaly_type) LIKE '%l\\_%' ESCAPE '\\'")

# sources and streams
add("flatten_props", "events", lambda d: flatten_json(d.select("event_id", "props"), "props"), "SELECT event_id, (props::JSON->>'k')::BIGINT AS props_k FROM events")
add("quality_by_day", "events_gaps", lambda d: quality_by_day(d).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "missing", F.round("mean", 4).alias("mean")), "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(*) - count(value) AS missing, round(avg(value), 4) AS mean FROM events_gaps GROUP BY 1")


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

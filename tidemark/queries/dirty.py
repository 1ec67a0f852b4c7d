"""Dirty versions of the clean tables: one SQL text per table, which Spark and the SQL twin both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NUM4 = "lpad(cast(c_custkey % 10000 as string), 4, '0')"
_Y, _M, _D = "cast(year(o_orderdate) as string)", "lpad(cast(month(o_orderdate) as string), 2, '0')", "lpad(cast(day(o_orderdate) as string), 2, '0')"

#: View: (table, select list, condition of the rows that come a second time).
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "lineitem_dirty": ("lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "CASE WHEN (l_orderkey * 7 + l_partkey) % 997 = 0 THEN l_extendedprice * 1000 ELSE l_extendedprice END AS l_extendedprice",
        "l_discount", "l_tax",
        "CASE WHEN l_orderkey % 13 = 0 THEN ' ' || lower(l_returnflag) ELSE l_returnflag END AS l_returnflag",
        "l_linestatus", "l_shipdate",
    ], "l_orderkey % 50 = 0"),
    "orders_dirty": ("orders", [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 5 = 1 THEN lower(o_orderpriority) ELSE ' ' || o_orderpriority END AS o_orderpriority",
        f"CASE WHEN o_orderkey % 41 = 0 THEN 'not-a-date' WHEN o_orderkey % 3 = 0 THEN {_Y} || '-' || {_M} || '-' || {_D} WHEN o_orderkey % 3 = 1 THEN {_D} || '/' || {_M} || '/' || {_Y} ELSE {_D} || '.' || {_M} || '.' || {_Y} END AS date_txt",
        f"{_Y} || '-' || {_M} || '-' || {_D} || ' 10:20:30' AS datetime_txt",
    ], None),
    "customer_dirty": ("customer", [
        "c_custkey", "c_name", "c_nationkey", "c_acctbal",
        "CASE WHEN c_custkey % 23 = 0 THEN 'N/A' ELSE c_mktsegment END AS c_mktsegment",
        "CASE WHEN c_custkey % 17 = 0 THEN 'bad' ELSE ' User' || cast(c_custkey as string) || '@Example.COM ' END AS email",
        f"CASE WHEN c_custkey % 3 = 0 THEN '(555) 123-' || {_NUM4} WHEN c_custkey % 3 = 1 THEN '1-555-123-' || {_NUM4} ELSE '555123' || {_NUM4} END AS phone",
        "cast(c_custkey % 100000 as string) AS zip",
        "'$1,' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '.50' AS price_txt",
        "cast(c_custkey % 100 as string) || '.5%' AS pct_txt",
        "CASE WHEN c_custkey % 5 = 0 THEN 'Yes' WHEN c_custkey % 5 = 1 THEN ' no' WHEN c_custkey % 5 = 2 THEN 'TRUE' WHEN c_custkey % 5 = 3 THEN '0' ELSE 'maybe' END AS active_txt",
        "CASE WHEN c_custkey % 19 = 0 THEN 'n.a.' ELSE cast(c_custkey as string) || '.25' END AS amount_txt",
        "CASE WHEN c_custkey % 29 = 0 THEN 'x' ELSE cast(c_custkey as string) END AS count_txt",
    ], None),
    "events_gaps": ("events", ["event_id", "ts", "user_id", "event_type", "CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value", "props"], None),
    "events_dirty": ("events", [
        "event_id", "ts", "user_id", "event_type",
        "CASE WHEN event_id % 1999 = 0 THEN CASE WHEN event_id % 2 = 0 THEN cast('Infinity' as double) ELSE cast('-Infinity' as double) END WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value",
    ], None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, columns, again = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    out = rows.selectExpr(*columns)
    return out.unionAll(rows.where(again).selectExpr(*columns)) if again else out


def sql(name: str) -> str:
    """The view as a named subquery, for WITH."""
    base, columns, again = VIEWS[name]
    body = f"SELECT {', '.join(columns)} FROM {base}"
    return f"{name} AS ({body}" + (f" UNION ALL {body} WHERE {again}" if again else "") + ")"

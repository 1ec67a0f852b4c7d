"""Nested data to columns, one level deep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col


def flatten(df: DataFrame) -> DataFrame:
    """Fields of struct columns become columns <column>_<field>; deeper levels stay as they are."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            out += [col(f.name).getField(g).alias(f"{f.name}_{g}") for g in f.dataType.names]
        else:
            out.append(col(f.name))
    return df.select(*out)


def flatten_json(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """A column of JSON objects as text; its schema is inferred unless it is given."""
    if schema is None:  # of all values, in one aggregate
        found = df.select(F.schema_of_variant_agg(F.try_parse_json(col(column).cast("string"))).alias("s")).first()["s"]
        schema = found.replace("OBJECT<", "STRUCT<")
    return flatten(df.withColumn(column, F.from_json(col(column), schema)))

"""Rows written once to the folder that the cluster shares, and read from there: the lineage ends, and what was dealt stays dealt."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """The folder is the session's spark.checkpoint.dir; one is made only where the session names none (tests)."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{at.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast only when it is proven to be below this.
BROADCAST_BYTES = 48 << 20


def fits(df: DataFrame, bytes_per_row: int | None = None) -> bool:
    """Whether a staged table of numbers surely fits in BROADCAST_BYTES: its rows are counted."""
    return df.count() * (bytes_per_row or 8 * len(df.columns) + 16) <= BROADCAST_BYTES

"""Helpers shared by the corpus operators: input columns, written tables, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Stands for a null document id while rows are ordered: a null id counts as the largest.
NULL_ID = 2**63 - 1
#: A side of a join is broadcast only when its written size is proven to be below this.
BROADCAST_BYTES = 48 << 20
#: Of the rows that Spark hands to a Python worker at once. Spark's 64 MB would be held several times over, in the executor and in
#: the worker, by each task.
BATCH_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about BATCH_BYTES, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, binary: bool = False) -> DataFrame:
    """Two columns with names of their own, ``tm_id`` and ``tm_text``; null texts are empty,
    null ids are NULL_ID. Other columns, whatever their names, are left behind here."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("tm_id"),
        (text.cast("binary") if binary else text).alias("tm_text"),
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def given_id(column: str = "tm_id") -> Column:
    """The id as it was given: null where it was null."""
    return F.nullif(F.col(column), F.lit(NULL_ID))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one is made only where the session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder and read from there, so a lost
    executor costs no more than the tasks it was running."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, bytes_per_row: Column | None = None, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table's rows surely fit in ``limit`` bytes: it is measured, not guessed."""
    per_row = F.lit(8 * len(df.columns) + 16) if bytes_per_row is None else bytes_per_row
    total = df.select(F.sum(per_row).alias("n")).first()["n"]
    return (total or 0) <= limit


def joined(big: DataFrame, side: DataFrame, on: str, how: str, bytes_per_row: Column | None = None) -> DataFrame:
    """Joins a written side to a table with texts: broadcast below the bound, else by shuffle
    (AQE splits hot keys)."""
    return big.join(F.broadcast(side) if small_enough(side, bytes_per_row) else side, on, how)

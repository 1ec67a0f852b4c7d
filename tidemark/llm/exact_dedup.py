"""Exact dedup: two-pass Bloom filtering, then a shuffle of the possibly repeated hashes alone.

Pass one fills a Bloom filter whose cells count to two (two bit arrays, "once" and "again"), built per
partition and merged segment by segment. Pass two asks it: a document whose cells were not all hit again
has no equal, and goes straight to the output; the others shuffle as (hash, id), never with their texts.
The filter has 16 bits a document up to ``max_bits``, a fixed bound on what is broadcast. Beyond the bound
more documents pass for possibly repeated and shuffle; the result stays exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, given_id, prepared, written

SEGMENT_BITS = 1 << 19
CELLS = 4


def normalised(text: Column) -> Column:
    """Each run of the six ASCII white-space characters becomes one space (a single space is one already)."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def cells(digests: pa.Array, bits: int) -> np.ndarray:
    """Cells (n, CELLS) of 32-byte digests; ``bits`` is a power of two."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)
    return raw & np.uint64(bits - 1)


def fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.sort(cells(batch.column(0), bits), axis=1)
            rows = rows[np.c_[np.full(len(rows), True), rows[:, 1:] != rows[:, :-1]]]  # a document counts once a cell
            at, n = np.unique(rows, return_counts=True)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
            twice = (n > 1) | (once[byte] & bit != 0)
            np.bitwise_or.at(again, byte[twice], bit[twice])
            np.bitwise_or.at(once, byte, bit)
        size = SEGMENT_BITS // 8
        for k in range(0, len(once), size):
            if once[k : k + size].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k // size], pa.int32()), "once": [once[k : k + size].tobytes()], "again": [again[k : k + size].tobytes()]})

    return run


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of several partitions become one each; the rows come dealt by segment."""
    once: dict[int, np.ndarray] = {}
    again: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if k in once:
                again[k] |= b | (once[k] & a)
                once[k] |= a
            else:
                once[k], again[k] = a.copy(), b.copy()
    for k, b in again.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "again": [b.tobytes()]})


def possibly_repeated(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.zeros(bits // 8, np.uint8)
        size = SEGMENT_BITS // 8
        for k, b in shared.value:
            again[k * size : k * size + len(b)] = np.frombuffer(b, np.uint8)
        for batch in batches:
            at = cells(batch.column(1), bits)
            hit = (again[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1))], names=[*batch.schema.names, "tm_maybe"])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_bits: int = 1 << 28) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal; of equal texts the smallest doc_id stays (a null id counts as the
    largest). Of rows that repeat both id and text one has kept = true. An empty table gives no rows."""
    spark = docs.sparkSession
    hashed = written(prepared(docs, id_col, text_col).select("tm_id", F.unhex(F.sha2(normalised(F.col("tm_text")), 256)).alias("tm_sha")), "exact-hashes")
    bits = min(max_bits, max(SEGMENT_BITS, 1 << (16 * hashed.count()).bit_length()))
    filled = hashed.select("tm_sha").mapInArrow(fill(bits), "segment int, once binary, again binary")
    parts = filled.repartition(max(1, min(64, bits // SEGMENT_BITS)), "segment").mapInArrow(merge, "segment int, again binary")
    shared = spark.sparkContext.broadcast([(r.segment, bytes(r.again)) for r in parts.collect()])  # at most max_bits / 8 bytes
    asked = hashed.mapInArrow(possibly_repeated(shared, bits), "tm_id long, tm_sha binary, tm_maybe boolean")

    maybe = written(asked.where("tm_maybe").drop("tm_maybe"), "exact-candidates")
    groups = maybe.groupBy("tm_sha").agg(F.min("tm_id").alias("tm_keep"), F.count(F.lit(1)).alias("tm_n"))
    same = Window.partitionBy("tm_sha", "tm_id").orderBy("tm_id")
    repeated = maybe.withColumn("tm_copy", F.row_number().over(same)).join(groups, "tm_sha")
    alone = asked.where("not tm_maybe").select("tm_sha", "tm_id", F.lit(1).alias("tm_copy"), F.col("tm_id").alias("tm_keep"), F.lit(1).cast("long").alias("tm_n"))
    return alone.unionByName(repeated.select(alone.columns)).select(
        given_id().alias("doc_id"),
        given_id("tm_keep").alias("keep_id"),
        F.col("tm_n").alias("group_size"),
        ((F.col("tm_id") == F.col("tm_keep")) & (F.col("tm_copy") == 1)).alias("kept"),
        F.lower(F.hex("tm_sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

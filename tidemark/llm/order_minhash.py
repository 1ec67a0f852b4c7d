"""Document fingerprints by Order MinHash.

A text becomes its words (runs longer than WORD_CHARS code points are cut), and these its k-mers, each numbered by
its earlier occurrences. ``SELECTIONS`` hashes, each with a seed of its own, rank the (k-mer, number) pairs; each keeps the
``KEPT`` smallest of all, puts them back into text order and hashes the tuple. Likeness comes from the share of
selections on which two fingerprints agree: moving text about changes tuples that plain MinHash would leave alike, in
short texts as in long ones. A text with fewer k-mers has them all in every tuple; one without words has zeros.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, given_id, prepared

WORD_CHARS = 24
RUNS = re.compile(r"[^\x20\x09-\x0D]{1,%d}" % WORD_CHARS)
K, SELECTIONS, KEPT = 2, 128, 2
#: K-mers ranked at once.
BLOCK = 4096
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_random = np.random.default_rng(42)
FACTORS = _random.integers(0, 2**31, (SELECTIONS, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
ADDED = _random.integers(0, 2**32, (SELECTIONS, 1)).astype(np.uint32)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    words = text.split()
    if any(map(WORD_CHARS.__lt__, map(len, words))) or not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        words = RUNS.findall(text)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w.encode()) for w in words]), "<u8")


def smallest(x: np.ndarray) -> np.ndarray:
    """Places of the KEPT smallest (or all) for each selection, in text order; of equal ranks the earlier ones."""
    at, rank = [], []
    every = np.arange(SELECTIONS)
    for k in range(0, len(x), BLOCK):
        h = x[k : k + BLOCK] * FACTORS + ADDED
        for j in range(min(KEPT, h.shape[1])):
            i = h.argmin(axis=1)
            at.append(i + k)
            rank.append(h[every, i].astype(np.int64) if j == 0 else np.maximum(h[every, i].astype(np.int64), rank[-1]))
            h[every, i] = np.uint32(2**32 - 1)
    at, rank = np.array(at).T, np.array(rank).T
    if at.shape[1] > KEPT:
        at = np.take_along_axis(at, np.argsort(rank, axis=1, kind="stable")[:, :KEPT], 1)
    return np.sort(at, axis=1)


def sketch(words: np.ndarray) -> np.ndarray:
    """One 32-bit value for each selection; zeros without words."""
    if not len(words):
        return np.zeros(SELECTIONS, np.uint32)
    k = min(K, len(words))
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * A + words[i : len(words) - k + 1 + i]
    order = np.argsort(grams, kind="stable")  # equal k-mers stay in text order
    g = grams[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    number = np.empty(len(g), np.uint64)
    number[order] = (np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))).astype(np.uint64)
    at = smallest((scrambled(grams + number * A) >> np.uint64(32)).astype(np.uint32))
    h = np.zeros(SELECTIONS, np.uint64)
    for c in range(at.shape[1]):
        h = scrambled(h * A + grams[at[:, c]])
    return np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of k-mers in common: a tuple agrees when all its KEPT k-mers do, so it is the KEPT-th root of the
    share of selections that agree. Texts without words are alike."""
    return float((a == b).mean() ** (1 / KEPT))


def fingerprint(text: str) -> np.ndarray:
    return sketch(word_hashes(text))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, id, text, own): each bucket's documents in order of id, followed by the next bucket's first (own =
    false), the last bucket's by the very first document. Only this many rows travel twice, and no text passes
    through the driver: it sees one id a bucket."""
    spark = docs.sparkSession
    found = docs.select(F.percentile_approx("tm_id", [k / buckets for k in range(1, buckets)], 10_000).alias("e")).first()["e"] if buckets > 1 else []
    edges = Counter(found or [])
    # bucket k: ids above edge k-1, up to edge k; an edge's own id has buckets of its own where it fills several
    docs = docs.withColumn("tm_order", F.xxhash64("tm_text"))
    bucket = F.lit(0).cast("long")
    if edges:
        cuts = F.array(*(F.lit(e) for e in sorted(edges)))
        bucket = F.size(F.filter(cuts, lambda e: e < F.col("tm_id"))).cast("long") * 2 * buckets
        part = lambda n: F.floor((F.col("tm_order").cast("double") / 2.0**64 + 0.5) * n).cast("long") + 1
        for e, n in edges.items():
            if n > 1:
                bucket = bucket + F.when(F.col("tm_id") == e, part(n)).otherwise(F.lit(0))
    dealt = docs.withColumn("tm_bucket", bucket)
    least = {r["tm_bucket"]: r["m"] for r in dealt.groupBy("tm_bucket").agg(F.min(F.struct("tm_id", "tm_order")).alias("m")).collect()}  # one row a bucket
    filled = sorted(least)
    if not filled:
        return dealt.withColumn("tm_own", F.lit(True))
    # the first bucket's lead closes the last
    lead = spark.createDataFrame([(b, least[b].tm_id, least[b].tm_order, filled[k - 1]) for k, b in enumerate(filled)], "tm_bucket long, tm_first long, tm_first_order long, tm_before long")
    marked = dealt.join(F.broadcast(lead), "tm_bucket")
    to = F.array(F.struct(F.col("tm_bucket").alias("b"), F.lit(True).alias("own")))
    also = F.array(F.struct(F.col("tm_bucket").alias("b"), F.lit(True).alias("own")), F.struct(F.col("tm_before").alias("b"), F.lit(False).alias("own")))
    leads = (F.col("tm_id") == F.col("tm_first")) & (F.col("tm_order") == F.col("tm_first_order"))
    sent = F.explode(F.when(leads, also).otherwise(to)).alias("to")
    return marked.select("tm_id", "tm_text", "tm_order", sent).select(F.col("to.b").alias("tm_bucket"), "tm_id", "tm_text", "tm_order", F.col("to.own").alias("tm_own"))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, own rows first, then id and hash of the text; of the rows that are not the bucket's own, the first counts."""
    last: tuple[int, int, str, np.ndarray] | None = None  # bucket, id, text, fingerprint
    names = ["tm_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for bucket, i, text, own in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if not own and (last is None or last[0] != bucket):
                    continue
                mine = fingerprint(text)
                if last and last[0] == bucket:
                    b, j, was, print_ = last
                    n = len(was)
                    edited = was[: n - n // 2] + text[: n // 2]
                    changed = print_ if edited == was else fingerprint(edited)
                    rows.append((j, n, hashlib.sha256(edited.encode()).hexdigest(), print_.astype("<u4").tobytes().hex(), changed.astype("<u4").tobytes().hex(), likeness(print_, changed), likeness(print_, mine)))
                last = (bucket, i, text, mine) if own else None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's by ascending id; the first document follows the last. Null ids come last; rows that repeat an id follow
    each other by the hash of their text. A document that is alone follows itself. Null and empty texts are empty: fingerprint of
    zeros, likeness 1 to another such. An empty table gives no rows."""
    spark = docs.sparkSession
    table = prepared(docs, id_col, text_col)
    if buckets is None:
        buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = with_next(table, min(buckets, 4000)).repartition("tm_bucket").sortWithinPartitions("tm_bucket", F.desc("tm_own"), "tm_id", "tm_order", "tm_text")
    out = dealt.select("tm_bucket", "tm_id", "tm_text", "tm_own").mapInArrow(compared, "tm_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(given_id().alias("doc_id"), *out.columns[1:])


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(documents(spark, sf_dir))

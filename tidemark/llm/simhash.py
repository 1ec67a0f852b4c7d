"""SimHash near-dedup by deletion-variant signatures.

Equal fingerprints are collapsed first. A fingerprint of 64 bits is cut into two segments: of three differing bits one
segment has at most one. Each segment is indexed under its 32 one-wildcard variants, so fingerprints at most
three bits apart meet under at least one variant; those that meet are verified on all 64 bits. A pair is
taken only under its first common variant, and each task keeps a spanning forest of the pairs that it
verified, so large groups give as many links as members, not their square. Components of the links are found by
alternating star contraction with written tables between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, given_id, joined, prepared, written

SEED = 42
WORDS = 3
PAIRS_HELD = 1 << 20


def simhash(text: bytes, words_each: int = WORDS, seed: int = SEED) -> bytes:
    """Eight bytes, most significant first; zero without words. bytes.lower() and bytes.split() are ASCII's alone."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    whole = b" ".join(words)
    if len(words) <= words_each:
        hashes = digest(whole, seed)
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-words_each]]).tolist()
        hashes = b"".join([digest(whole[a:b], seed) for a, b in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)])
        n = len(starts)
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
    full = n // 255 * 255  # sums of 255 bits still fit in a byte
    counts = np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.frombuffer(b"".join([simhash(t.as_py(), words_each) for t in batch.column(1)]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["tm_id", "tm_print"])

    return run


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, fingerprint): segment 1 bit, wildcard 5 bits, the segment with that bit cleared 32 bits."""
    wild = np.arange(32, dtype=np.uint64)
    clear, mark = ~(np.uint64(1) << wild), wild << np.uint64(32)
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            prints = batch.column(0).slice(at, 8192).to_numpy().view(np.uint64)
            for s, seg in ((0, prints >> np.uint64(32)), (1, prints & np.uint64(0xFFFFFFFF))):
                keys = (seg[:, None] & clear) | mark | np.uint64(s << 37)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(prints, 32).view(np.int64))], names=["tm_variant", "tm_print"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes with at most one link a node: each to the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (jumped := new[new]).tolist() != new.tolist() if len(new) < 64 else not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def verified(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come dealt and sorted by variant; a variant may go on in the next batch."""
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, prints = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        new_a: list[np.ndarray] = []
        new_b: list[np.ndarray] = []

        def settle(k: np.ndarray, p: np.ndarray) -> None:
            nonlocal a, b
            at, step, held = np.arange(len(k)), 1, 0
            while True:
                at = at[: np.searchsorted(at, len(k) - step)]
                at = at[k[at] == k[at + step]]
                if not len(at):
                    return
                diff = p[at] ^ p[at + step]
                hit = np.bitwise_count(diff) <= max_bits
                d, here = diff[hit], k[at[hit]]
                high, low = d >> np.uint64(32), d & np.uint64(0xFFFFFFFF)
                first = np.bitwise_count(high) <= 1  # the first segment that differs by one bit at most
                seg = np.where(first, high, low)
                wild = np.where(seg > 0, np.bitwise_count(np.maximum(seg, np.uint64(1)) - np.uint64(1)), 0).astype(np.uint64)
                own = (here >> np.uint64(37) == np.where(first, 0, 1).astype(np.uint64)) & ((here >> np.uint64(32)) & np.uint64(31) == wild)
                got = at[hit][own]
                new_a.append(p[got].view(np.int64))
                new_b.append(p[got + step].view(np.int64))
                held += len(got)
                if held > PAIRS_HELD:
                    shrink()
                    held = 0
                step += 1

        def shrink() -> None:
            nonlocal a, b
            a, b = forest(np.concatenate([a, *new_a]), np.concatenate([b, *new_b]))
            new_a.clear()
            new_b.clear()

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy().view(np.uint64)])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys):
                whole = int(np.searchsorted(keys, keys[-1]))  # the last variant waits for the next batch
                settle(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
                if sum(map(len, new_a)) > PAIRS_HELD:
                    shrink()
        settle(keys, prints)
        shrink()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["tm_u", "tm_v"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(tm_u, tm_root): every node of ``links`` (tm_u > tm_v) but the least of its component, with that least.

    Large-star and small-star rounds; both are one sum per node and one join, which AQE splits at hot nodes."""
    links = written(links.distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("tm_v").alias("tm_u"), F.col("tm_u").alias("tm_v")))
        least = both.groupBy("tm_u").agg(F.min("tm_v").alias("tm_m")).select("tm_u", F.least("tm_u", "tm_m").alias("tm_m"))
        large = both.where("tm_v > tm_u").join(least, "tm_u").select(F.col("tm_v").alias("tm_u"), F.col("tm_m").alias("tm_v")).where("tm_u > tm_v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("tm_u").agg(F.min("tm_v").alias("tm_m"))
        small = large.join(least, "tm_u").select(F.col("tm_v").alias("tm_u"), F.col("tm_m").alias("tm_v")).where("tm_u > tm_v")
        links = written(small.unionByName(least.select("tm_u", F.col("tm_m").alias("tm_v"))).distinct(), "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("tm_u", "tm_v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.withColumnRenamed("tm_v", "tm_root")
        before = now


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_bits: int = 3, words_each: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that
    links reach, its own included).

    Documents without words (null, empty or white space) have the fingerprint zero and link like any others. A null id counts
    as the largest and is returned as null. Rows that repeat an id are documents of their own. An empty table gives no rows.
    ``max_bits`` is at most 3: with more, both segments may differ by two bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be from 0 to 3")
    prints = written(prepared(docs, id_col, text_col, binary=True).mapInArrow(fingerprints(words_each), "tm_id long, tm_print long"), "simhashes")
    classes = written(prints.groupBy("tm_print").agg(F.min("tm_id").alias("tm_least")), "simhash-classes")
    spread = classes.select("tm_print").mapInArrow(variants, "tm_variant long, tm_print long")
    links = spread.repartition("tm_variant").sortWithinPartitions("tm_variant").mapInArrow(verified(max_bits), "tm_u long, tm_v long")
    roots = components(links)
    rooted = classes.join(roots.withColumnRenamed("tm_u", "tm_print"), "tm_print", "left").withColumn("tm_root", F.coalesce("tm_root", "tm_print"))
    named = rooted.groupBy("tm_root").agg(F.min("tm_least").alias("tm_component"))
    found = written(rooted.select("tm_print", "tm_root").join(named, "tm_root").select("tm_print", "tm_component"), "simhash-components")
    return joined(prints, found, "tm_print", "inner").select(
        given_id().alias("doc_id"), F.lower(F.lpad(F.hex("tm_print"), 16, "0")).alias("fingerprint"), given_id("tm_component").alias("component_id")
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))

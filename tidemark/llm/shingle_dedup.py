"""Near copies by Jaccard similarity of word shingles, on top of SimHash links.

Rows of equal fingerprints or equal shingle sets are linked first. Of each distinct set ``BANDS`` bands of ``BAND_ROWS`` MinHashes
are taken; a pair at a similarity of 0.8 shares a bucket with a probability of 1 - (1 - 0.8 ** 5) ** 32, more than 0.99999.
Pairs that share one are sifted by two bounds that lose none (sizes, and the parity bits in which they differ), and
verified by the exact intersection of their sets. Each member of a bucket is first checked against its nearest in a salted part of the bucket;
what then lies in one component needs no further pairs, and all other pairs of a bucket are checked, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_id, joined, prepared, small_enough, written
from .simhash import SEED, components, simhash, variants, verified

BANDS, BAND_ROWS = 32, 5
#: Parity bits of a set, in words of 64.
PARITY_WORDS = 8
#: Members of a bucket that are compared at once.
CHUNK = 256
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDED = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """Sorted distinct hashes; words and short texts are those of simhash()."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= words_each:
        hashes = xxhash.xxh64_digest(whole, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-words_each]]).tolist()
        hashes = b"".join([xxhash.xxh64_digest(whole[a:b], SEED) for a, b in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A bucket for each band."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * FACTORS + ADDED).min(axis=0), out=least)
    raw = least.tobytes()
    step = 8 * BAND_ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)], np.uint64)


def parity(shingles: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of shingles fall on it: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketches(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = some.column(1).to_pylist()
                prints = np.frombuffer(b"".join([simhash(t, words_each) for t in texts]), ">i8").astype(np.int64)
                sets = [shingle_set(t, words_each) for t in texts]
                rows = pa.array(np.arange(row, row + len(texts)))
                row += len(texts)
                buckets = [bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), rows, pa.array(prints), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["tm_id", "tm_row", "tm_print", "tm_name", "tm_n", "tm_parity", "tm_buckets", "tm_set"],
                )

    return run


SKETCH = "tm_id long, tm_row long, tm_print long, tm_name binary, tm_n long, tm_parity binary, tm_buckets array<long>, tm_set array<long>"


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """The other columns of each run of equal keys; rows come sorted, a run may go on in the next batch."""
    held = None
    for batch in batches:
        cols = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, PARITY_WORDS) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        held = cols if held is None else [np.concatenate(p) for p in zip(held, cols, strict=True)]
        if not len(held[0]):
            continue
        changed = np.logical_or.reduce([k[1:] != k[:-1] for k in held[:n_keys]])
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield [c[a:b] for c in held[n_keys:]]
        held = [c[starts[-1] :] for c in held]
    if held is not None and len(held[0]):
        yield held[n_keys:]


def apart(n: np.ndarray, bits: np.ndarray, i: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits between row i and those before ``upto``, and whether the pair can be at 0.8: at most a ninth of both sizes differs."""
    diff = np.bitwise_count(bits[:upto] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return diff, (9 * diff <= n[:upto] + n[i]) & (5 * np.minimum(n[:upto], n[i]) >= 4 * np.maximum(n[:upto], n[i]))


def pairs_batch(u: list, v: list) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (u, v))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["tm_u", "tm_v"])


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a part with the nearest of those before it."""
    for rows, n, bits in grouped(batches, 2):
        u, v = [], []
        for i in range(1, len(rows)):
            diff, may = apart(n, bits, i, i)
            if may.any():
                u.append(rows[i : i + 1])
                v.append(rows[[np.flatnonzero(may)[diff[may].argmin()]]])
        if u:
            yield pairs_batch(u, v)


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of different components; of two blocks only those between them."""
    for block, other, own, rows, n, bits, root in grouped(batches, 1):
        u, v, held = [], [], 0
        for i in range(1, len(rows)):
            may = apart(n, bits, i, i)[1] & (root[:i] != root[i])
            if block[0] != other[0]:
                may &= own[:i] != own[i]
            hit = np.flatnonzero(may)
            if len(hit):
                u.append(np.repeat(rows[i], len(hit)))
                v.append(rows[hit])
                held += len(hit)
            if held > 100_000:
                yield pairs_batch(u, v)
                u, v, held = [], [], 0
        if u:
            yield pairs_batch(u, v)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets share at least 0.8 of their union."""
    pairs = written(pairs.distinct(), "shingle-pairs")
    ends = written(pairs.select(F.col("tm_u").alias("tm_row")).union(pairs.select("tm_v")).distinct(), "shingle-ends")
    some = written(joined(sets, ends, "tm_row", "left_semi"), "shingle-sets")
    side = F.broadcast(some) if small_enough(some, F.size("tm_set") * 8 + 32) else some
    a, b = (side.select(F.col("tm_row").alias(f"tm_{x}"), F.col("tm_set").alias(f"tm_set_{x}")) for x in "uv")
    both = pairs.join(a, "tm_u").join(b, "tm_v").withColumn("tm_common", F.size(F.array_intersect("tm_set_u", "tm_set_v")))
    return both.where(9 * F.col("tm_common") >= 4 * (F.size("tm_set_u") + F.size("tm_set_v"))).select("tm_u", "tm_v")


def to_least(table: DataFrame, by: str) -> DataFrame:
    """Links of rows to the least row of their value of ``by``."""
    least = table.groupBy(by).agg(F.min("tm_row").alias("tm_v"), F.count(F.lit(1)).alias("tm_k")).where("tm_k > 1").drop("tm_k")
    least = written(least, "shingle-least")
    return joined(table.select(by, "tm_row"), least, by, "inner", F.lit(48)).where("tm_row > tm_v").select(F.col("tm_row").alias("tm_u"), "tm_v")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words_each: int = 5, max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id that links reach, its own included).

    Links are fingerprints at most ``max_bits`` apart and Jaccard similarities of 0.8 or more over shingles of ``words_each`` words. Documents without
    words link with each other. Ids are as in simhash_groups; an empty table gives no rows."""
    table = written(prepared(docs, id_col, text_col, binary=True).mapInArrow(sketches(words_each), SKETCH), "shingle-sketches")
    prints = written(table.groupBy("tm_print").agg(F.min("tm_row").alias("tm_least")), "shingle-prints")
    spread = prints.select("tm_print").mapInArrow(variants, "tm_variant long, tm_print long")
    close = spread.repartition("tm_variant").sortWithinPartitions("tm_variant").mapInArrow(verified(max_bits), "tm_u long, tm_v long")
    ends = [prints.select(F.col("tm_print").alias(f"tm_{x}"), F.col("tm_least").alias(f"tm_row_{x}")) for x in "uv"]
    close = close.join(ends[0], "tm_u").join(ends[1], "tm_v").select(F.greatest("tm_row_u", "tm_row_v").alias("tm_u"), F.least("tm_row_u", "tm_row_v").alias("tm_v"))

    copies = written(to_least(table, "tm_name"), "shingle-copies")
    gone = copies.select(F.col("tm_u").alias("tm_row"))
    own = joined(table.where("tm_n > 0").drop("tm_id", "tm_print", "tm_name"), written(gone, "shingle-gone"), "tm_row", "left_anti")
    buckets = own.select("tm_row", F.explode("tm_buckets").alias("tm_bucket"))
    shared = written(buckets.groupBy("tm_bucket").agg(F.count(F.lit(1)).alias("tm_members")).where("tm_members > 1"), "shingle-buckets")
    placed = written(joined(buckets, shared, "tm_bucket", "inner"), "shingle-members")
    seen = written(placed.select("tm_row").distinct(), "shingle-rows")
    bounds = written(joined(table.select("tm_row", "tm_n", "tm_parity"), seen, "tm_row", "left_semi"), "shingle-bounds")
    members = written(joined(placed, bounds, "tm_row", "inner", F.lit(128)), "shingle-bounded")

    part = F.pmod(F.xxhash64("tm_row", "tm_bucket"), F.ceil(F.col("tm_members") / CHUNK)).cast("long")
    parts = members.select("tm_bucket", part.alias("tm_part"), "tm_row", "tm_n", "tm_parity").repartition("tm_bucket", "tm_part").sortWithinPartitions("tm_bucket", "tm_part")
    sets = own.select("tm_row", "tm_set")
    first = similar(parts.mapInArrow(nearest, "tm_u long, tm_v long"), sets)
    links = written(close.unionByName(to_least(table, "tm_print")).unionByName(copies).unionByName(first).distinct(), "shingle-links")

    roots = components(links).withColumnRenamed("tm_u", "tm_row")
    rooted = written(joined(members, roots, "tm_row", "left").withColumn("tm_root", F.coalesce("tm_root", "tm_row")), "shingle-rooted")
    open_ = written(rooted.groupBy("tm_bucket").agg(F.min("tm_root").alias("a"), F.max("tm_root").alias("b")).where("a < b").select("tm_bucket"), "shingle-open")
    blocks = F.ceil(F.col("tm_members") / CHUNK)
    dealt = joined(rooted, open_, "tm_bucket", "left_semi").withColumn("tm_own", F.pmod(F.xxhash64("tm_row"), blocks).cast("long"))
    dealt = dealt.withColumn("tm_with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("tm_own", "tm_with"), F.greatest("tm_own", "tm_with")
    dealt = dealt.select(F.xxhash64("tm_bucket", low, high).alias("tm_key"), low.alias("tm_low"), high.alias("tm_high"), "tm_own", "tm_row", "tm_n", "tm_parity", "tm_root")
    more = similar(dealt.repartition("tm_key", "tm_low", "tm_high").sortWithinPartitions("tm_key", "tm_low", "tm_high").mapInArrow(across, "tm_u long, tm_v long"), sets)
    more = written(more, "shingle-more")
    if not more.isEmpty():
        roots = components(links.unionByName(more)).withColumnRenamed("tm_u", "tm_row")
    found = written(joined(table.select("tm_id", "tm_row"), roots, "tm_row", "left").select("tm_id", F.coalesce("tm_root", "tm_row").alias("tm_root")), "shingle-found")
    named = written(found.groupBy("tm_root").agg(F.min("tm_id").alias("tm_component")), "shingle-components")
    return joined(found, named, "tm_root", "inner").select(given_id().alias("doc_id"), given_id("tm_component").alias("component_id"))

"""Line dedup: a sharded minimal perfect hash over line hashes; documents probe arrays, lines are never joined.

Pass one ships one (128-bit hash, doc_id) row per distinct long line of a document; Spark sums them before
and after the shuffle, so a line found in every document is one row a task. The hashes found in at least
``min_docs`` documents are dealt to shards; each shard becomes a minimal perfect hash with three arrays
beside it: fingerprints (the other 64 bits of the hash), document counts and last holders. Pass two
hashes the lines again and looks them up.

The shards are broadcast only while their measured size is below ``round_bytes``. Larger indexes are probed
in rounds of that size, each a pass that writes (document, dropped lines); these few rows are then joined.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import NULL_ID, documents, unused, written

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
KEYS_PER_SHARD = 1 << 18
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = (keys ^ np.uint64(level * 0x632BE59BD9B4E019 % 2**64)) * GOLD
    x ^= x >> np.uint64(32)
    x *= GOLD
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Maps each of n distinct 64-bit keys to a place of its own below n; any other key to some place, or to -1.

    Keys that hit a cell alone are settled at that level, the rest go on to the next, smaller one."""

    def __init__(self, keys: np.ndarray, room: float = 1.5):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        placed = 0
        while len(keys):
            n = max(64, -(-int(room * len(keys)) // 64) * 64)
            at = (mixed(keys, len(self.levels)) % np.uint64(n)).astype(np.int64)
            taken = np.bincount(at, minlength=n) == 1
            words = np.packbits(taken, bitorder="little").view("<u8")
            before = placed + np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype(np.int64)
            self.levels.append((n, words, before))
            placed += int(taken.sum())
            keys = keys[~taken[at]]

    def place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (n, words, before) in enumerate(self.levels):
            at = (mixed(keys[left], k) % np.uint64(n)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = before[at[hit] >> 6] + below
            left = left[~hit]
        return out


class Shard:
    def __init__(self, low: np.ndarray, high: np.ndarray, docs: np.ndarray, last: np.ndarray):
        self.hash = PerfectHash(low)
        order = np.empty(len(low), np.int64)
        order[self.hash.place(low)] = np.arange(len(low))
        self.prints, self.docs, self.last = high[order], docs[order].astype(np.uint32), last[order]

    def last_holder(self, low: np.ndarray, high: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is indexed with so many documents, and the largest document that holds it."""
        at = self.hash.place(low)
        found = at >= 0
        found[found] = (self.prints[at[found]] == high[found]) & (self.docs[at[found]] >= min_docs)
        return found, self.last[np.where(found, at, 0)]


def long_lines(text: bytes, min_chars: int) -> list[tuple[int, int]]:
    """(line number, 128-bit hash of its key) of the lines whose key has at least ``min_chars`` code points."""
    out = []
    for k, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars and (key.isascii() or len(key.decode(errors="replace")) >= min_chars):
            out.append((k, xxhash.xxh3_128_intdigest(key.lower())))
    return out


def hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {h for _, h in long_lines(text, min_chars)}
                found.extend(keys)
                ids.extend([i] * len(keys))
            both = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], names=["low", "high", "tm_id"])

    return run


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, low, high, docs, last) of whole shards to one (shard, n, arrays) row a shard."""
    rows = [np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]) for b in batches if b.num_rows]
    if not rows:
        return
    shard, low, high, docs, last = np.concatenate(rows, axis=1)
    for k in np.unique(shard):
        mine = shard == k
        made = pickle.dumps(Shard(low[mine].view(np.uint64), high[mine].view(np.uint64), docs[mine], last[mine]), 5)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([int(k)], pa.int32()), "size": pa.array([len(made)], pa.int64()), "arrays": [made]})


def dropped_lines(ids: list[int], texts: list[bytes], shards: dict[int, Shard], n_shards: int, min_chars: int, min_docs: int) -> dict[int, list[int]]:
    """For rows that lose lines, their line numbers."""
    rows, lines, raw = [], [], []
    for r, text in enumerate(texts):
        for k, h in long_lines(text, min_chars):
            rows.append(r)
            lines.append(k)
            raw.append(h.to_bytes(16, "little"))
    both = np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2)
    shard = np.ascontiguousarray(both[:, 1]).view(np.int64) % n_shards
    mine = np.array(ids, np.int64)[rows] if rows else np.zeros(0, np.int64)
    out: dict[int, list[int]] = {}
    for k, s in shards.items():
        at = np.flatnonzero(shard == k)
        found, last = s.last_holder(both[at, 0], both[at, 1], min_docs)
        for j in at[found & (mine[at] != last)]:
            out.setdefault(rows[j], []).append(lines[j])
    return out


def without(text: bytes, gone) -> bytes:
    gone = set(gone)
    return b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone) if gone else text


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5, round_bytes: int = 32 << 20) -> DataFrame:
    """All columns of ``docs`` with the text that is left, then tm_n_lines and tm_n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points found in at least ``min_docs`` documents loses its lines except in the largest
    doc_id holding it. Null and empty texts are one empty line; a null id counts as the largest; rows that
    repeat an id count as so many documents, and all of the largest id keep the line. Extra columns pass
    through untouched, whatever their names; only columns already called tm_n_lines or tm_n_dropped make way for these."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("tm_n_lines", "tm_n_dropped")
    id_, hash_, gone_ = (unused(docs, n) for n in ("tm_id", "tm_hash", "tm_gone"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("tm_id"), text.alias("tm_text"))
    counted = keyed.mapInArrow(hashes(min_chars), "low long, high long, tm_id long").groupBy("low", "high").agg(F.count(F.lit(1)).alias("docs"), F.max("tm_id").alias("last"))
    frequent = written(counted.where(F.col("docs") >= min_docs), "line-counts")
    n_shards = max(1, -(-frequent.count() // KEYS_PER_SHARD))
    dealt = frequent.select(F.pmod("high", F.lit(n_shards)).cast("int").alias("shard"), "low", "high", "docs", "last")
    index = written(dealt.repartition(n_shards, "shard").mapInArrow(build, "shard int, size long, arrays binary"), "line-index")

    rounds: list[list[int]] = [[]]
    held = 0
    for r in index.select("shard", "size").orderBy("shard").collect():  # one row for each 2^18 indexed lines
        if held and held + r.size > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(r.shard)
        held += r.size

    def loaded(shards: list[int]):
        return spark.sparkContext.broadcast([(r.shard, bytes(r.arrays)) for r in index.where(F.col("shard").isin(shards)).collect()] if shards else [])

    wide = docs.withColumn(id_, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))).withColumn(text_col, text)
    raw = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in wide.schema])
    at = raw.names.index(text_col)
    counts = [T.StructField("tm_n_lines", T.LongType()), T.StructField("tm_n_dropped", T.LongType())]

    def finish(batch: pa.RecordBatch, texts: list[bytes], gone: dict) -> pa.RecordBatch:
        left = [without(t, gone.get(r, ())) for r, t in enumerate(texts)]
        cols = [pa.array(left, c.type) if k == at else c for k, c in enumerate(batch.columns)]
        n_lines = pa.array([t.count(b"\n") + 1 for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*cols, n_lines, pa.array([len(gone.get(r, ())) for r in range(len(texts))], pa.int64())], names=[*raw.names, "tm_n_lines", "tm_n_dropped"])

    if len(rounds) == 1:
        shared = loaded(rounds[0])
        id_at = raw.names.index(id_)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = {k: pickle.loads(b) for k, b in shared.value}
            for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
                texts = batch.column(at).to_pylist()
                yield finish(batch, texts, dropped_lines(batch.column(id_at).to_pylist(), texts, shards, n_shards, min_chars, min_docs))

        out = wide.mapInArrow(probe, T.StructType([*raw.fields, *counts]))
    else:
        wide = wide.withColumn(hash_, F.xxhash64(f"`{text_col}`"))
        hits = None
        for shards in rounds:
            shared = loaded(shards)

            def hit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                mine = {k: pickle.loads(b) for k, b in shared.value}
                for batch in batches:
                    ids, texts, h = (c.to_pylist() for c in batch.columns)
                    gone = dropped_lines(ids, texts, mine, n_shards, min_chars, min_docs)
                    yield pa.RecordBatch.from_pydict({"tm_id": pa.array([ids[r] for r in gone], pa.int64()), "tm_hash": pa.array([h[r] for r in gone], pa.int64()), "tm_gone": pa.array(list(gone.values()), pa.list_(pa.int32()))})

            part = written(wide.select(id_, f"`{text_col}`", hash_).mapInArrow(hit, "tm_id long, tm_hash long, tm_gone array<int>").dropDuplicates(["tm_id", "tm_hash"]), "line-hits")
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("tm_id", "tm_hash").agg(F.flatten(F.collect_list("tm_gone")).alias(gone_))  # one array for each round

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gone = {r: g for r, g in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if g}
                yield finish(pa.RecordBatch.from_arrays(batch.columns[: len(raw.names)], names=raw.names), batch.column(at).to_pylist(), gone)

        hits = hits.withColumnsRenamed({"tm_id": id_, "tm_hash": hash_})
        with_gone = wide.join(hits, [id_, hash_], "left").select(*(F.col(f"`{n}`") for n in raw.names), gone_)
        out = with_gone.mapInArrow(cut, T.StructType([*raw.fields, *counts]))
    return out.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).drop(id_)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("tm_n_lines").alias("n_lines"), F.col("tm_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, k, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)
), f AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL AND l.doc_id <> f.last) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY k) FILTER (f.key IS NULL OR l.doc_id = f.last), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY l.doc_id
"""

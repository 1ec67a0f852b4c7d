"""LM scoring by a probabilistic suffix tree over words.

States are contexts of none, one or more words. A context of k words is examined when it stands at least ``least`` times in the
training text and its longest suffix is a state; it is retained when its successors diverge from those of that
suffix: their gain in likelihood must exceed both the cost of the numbers it stores (half a logarithm each) and
``divergence`` nats an occurrence. Successors seen ``least`` times with it are stored with an absolute discount; what is left goes to all
others in proportion to the suffix's distribution, so every state sums to one. A token is scored in the longest
retained state. ``least`` is a constant, so the tree grows with the corpus; levels are added until no
context of a level is retained, or ``depth`` is reached.

As a state's distribution is its suffix's times a factor, a text's score is its base score plus one term for each
state passed. Texts are split once, into written chunks of about ``chunk_tokens`` tokens: the words' hashes and a code for
each token. All else is asked and answered: for each level a chunk asks once for each of its distinct word sequences, how
often it occurs in all training text, and then for each of its contexts, whether it is a state. Questions are dealt by range of their hash;
as each chunk asks once, a sequence or context that fills the corpus is no more than one question a chunk. Only sequences
whose shorter ones occur ``least`` times are asked for. Chunks are bucketed, so they stay where they are while
answers come to them; nothing is broadcast, and the driver sees four numbers a level.

Words count by 64-bit hashes. Longer sequences are told apart by hashes of at least 44 bits and 2 to the 18 times as many values as
there are tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, given_id, prepared, shared_dir, written

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Questions of a level for each shard that answers them, and chunks for each bucket.
SHARD_TOKENS = 1 << 20
BUCKET_BYTES = 24 << 20
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # a worker's own; tasks are single threads


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case (A-Z alone) of all texts, and how many each has; Arrow's ASCII functions part at the same white space as bytes.split()."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(pa.string()))))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(words).to_numpy() > 0  # a text without words is split to one empty word
    if not some.all():
        sizes[sizes == 1] = some[(np.cumsum(sizes) - sizes)[sizes == 1]]
        words = words.filter(pa.array(some))
    return words, sizes


def trains(doc_id: int, folds: int, held_out: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds != held_out


def thin(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed."""
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return PACK.compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def thick(raw: bytes) -> list[np.ndarray]:
    data = UNPACK.decompress(raw)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for one in data[4:at].decode().split(","):
        kind, n = np.dtype(one.rpartition(":")[0]), int(one.rpartition(":")[2])
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """First differences of sorted keys; np.cumsum gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def ordered(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys. What fits of a key is sorted in one number with its place, which is several times as fast as argsort;
    keys that agree so far and stand wrong, which are few, make one pass more."""
    if not len(keys):
        return np.zeros(0, np.int64)
    least, bits = keys.min(), np.uint64(len(keys).bit_length())
    cut = np.uint64(max(0, int(keys.max() - least).bit_length() + int(bits) - 64))
    packed = ((keys - least) >> cut) << bits
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= (np.uint64(1) << bits) - np.uint64(1)
    order = packed.view(np.int64)
    if cut:
        ranked = keys[order]
        if (ranked[1:] < ranked[:-1]).any():
            order = order[np.argsort(ranked, kind="stable")]
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and which of them stands at each place."""
    order = ordered(keys)
    ranked = keys[order]
    new = np.concatenate([np.ones(min(1, len(keys)), bool), ranked[1:] != ranked[:-1]])
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], order[new], of


def narrow(n: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on, in the fewest bytes that hold them."""
    return n.astype(np.min_scalar_type(n.max(initial=0)))


def chunked(chunk_tokens: int, folds: int, held_out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents end to end: ids, sizes, which train, the hashes of the distinct words by falling frequency, and the words' places there."""
        chunk = TaskContext.get().partitionId() << 32
        words, sizes, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal words, sizes, ids, held, chunk
            n = np.concatenate(sizes) + 1
            spelt = pa.chunked_array([pa.array([b""], pa.binary()), *(w.view(pa.binary()) for w in words)]).combine_chunks().dictionary_encode()
            code = np.zeros(n.sum(), np.int32)  # 0 is the end, the empty word
            inner = np.ones(len(code), bool)
            inner[np.cumsum(n) - 1] = False
            code[inner] = spelt.indices.to_numpy()[1:]
            order = np.argsort(-np.bincount(code), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, spelt.dictionary.to_numpy(zero_copy_only=False))), ">u8").astype(np.uint64)[order]
            train = np.array([trains(i, folds, held_out) for i in ids])
            blob = thin(np.array(ids, np.int64), n, train, hashes, rank[code])
            row = {"chunk": chunk, "tokens": len(code), "trained": int(n[train].sum()), "blob": blob}
            chunk += 1
            words, sizes, ids, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("trained", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                found, n = tokens(some.column(1))
                upto, at, a = np.cumsum(n + 1), np.concatenate([[0], np.cumsum(n)]), 0
                while a < len(n):
                    b = min(len(n), 1 + int(np.searchsorted(upto, chunk_tokens - held + (upto[a - 1] if a else 0))))
                    words.append(found.slice(at[a], at[b] - at[a]))
                    sizes.append(n[a:b])
                    ids += some.column(0).slice(a, b - a).to_pylist()
                    held += int((n[a:b] + 1).sum())
                    a = b
                    if held >= chunk_tokens:
                        yield flush()
        if ids:
            yield flush()

    return run


class Chunk:
    def __init__(self, raw: bytes):
        self.ids, self.sizes, self.train, self.vocabulary, self.code = thick(raw)
        self.word = self.vocabulary[self.code]

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)

    @cached_property
    def before(self) -> np.ndarray:
        """Words before each in its document."""
        return np.arange(len(self.code), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)

    @cached_property
    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)

    def grams(self, ends: np.ndarray, k: int, bits: int) -> np.ndarray:
        """Hashes of the k words that end at each place."""
        h = self.word[ends]
        for j in range(1, k):
            h = h * ODD + self.word[ends - j]
        h = (h ^ (h >> np.uint64(29))) * MIX
        h = (h ^ (h >> np.uint64(32))) * ODD
        return (h ^ (h >> np.uint64(31))) >> np.uint64(64 - bits)

    def per_doc(self, places: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc[places], values, minlength=len(self.ids))


class Model:
    """The numbers that all share."""

    def __init__(self, least: int, divergence: float, discount: float):
        self.least, self.divergence, self.discount = least, divergence, discount
        self.bits, self.norm = 64, 1.0


class Level:
    """The tokens of a chunk whose context of ``level`` words is examined: ``place``, and how often these occur: ``total`` the context,
    ``below`` the token after the context's suffix (0 below ``least``), ``wider`` that suffix."""

    def __init__(self, chunk: Chunk, level: int, model: Model, state: bytes):
        self.chunk, self.level, self.model = chunk, level, model
        self.base, self.known, self.gain, *whole = thick(state)
        place, self.total, self.below, self.wider = (n.astype(np.int64) for n in whole)
        if level == 1:  # every token but a document's first, by the counts of words
            n = self.total[chunk.code]
            self.place = np.flatnonzero((chunk.before > 0) & (np.concatenate([[0], n[:-1]]) >= model.least))
            self.total, self.below = n[self.place - 1], n[self.place]
            self.below = np.where(self.below >= model.least, self.below, 0)
        else:
            self.place = np.cumsum(place)

    @staticmethod
    def blob(base: np.ndarray, known: np.ndarray, gain: np.ndarray, place: np.ndarray, total: np.ndarray, below: np.ndarray, wider: np.ndarray) -> bytes:
        return thin(base, known, gain, *map(narrow, (np.diff(place, prepend=0), total, below, wider)))

    def sequences(self) -> np.ndarray:
        """Those whose count may reach ``least``."""
        self.asked = np.flatnonzero(self.below >= self.model.least)
        keys, self.one, self.of = distinct(self.chunk.grams(self.place[self.asked], self.level + 1, self.model.bits))
        return keys

    def count_questions(self) -> tuple[np.ndarray, np.ndarray]:
        """The sequences, and how often each occurs in the chunk's training documents."""
        keys = self.sequences()
        return keys, np.bincount(self.of[self.chunk.trained[self.place[self.asked]]], minlength=len(keys))

    def take_counts(self, answers: list[bytes]) -> None:
        self.sequences()
        answer = np.concatenate([np.zeros(0, np.int64), *(thick(a)[0] for a in answers)])
        self.n = answer >> 1
        self.own = np.flatnonzero(answer & 1)  # the sequences that this chunk speaks for
        self.stored = np.zeros(len(self.place), np.int64)
        self.stored[self.asked] = self.n[self.of]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        keys, one, self.context = distinct(self.chunk.grams(self.place - 1, self.level, self.model.bits))
        return keys, one

    def shares(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the tokens after their context, and after its suffix."""
        m = self.model
        lower = (self.below[at] + 0.5) / m.norm if self.level == 1 else (self.below[at] - m.discount) / self.wider[at]
        return (n - m.discount) / self.total[at], lower

    def state_questions(self) -> tuple[np.ndarray, ...]:
        """The contexts, how often each occurs, and of the stored successors that this chunk speaks for, by context: their
        number and the sums of their occurrences, probabilities here and after the suffix, and logarithms of their ratio."""
        keys, one = self.contexts()
        at, n = self.asked[self.one[self.own]], self.n[self.own]
        p, lower = self.shares(at, n)
        sums = [np.bincount(self.context[at], w, minlength=len(keys)) for w in (None, n, p, lower, n * np.log(p / lower))]
        some = sums[0] > 0
        return keys, self.total[one], some, *(s[some].astype(kind) for s, kind in zip(sums, (np.int64, np.int64, np.float32, np.float32, np.float32), strict=True))

    def next_state(self, answers: list[bytes]) -> tuple[bytes, int]:
        """What retained states add to the scores, and the tokens whose longer context is to be examined."""
        self.contexts()
        other = np.concatenate([np.zeros(0, np.float32), *(thick(a)[0] for a in answers)])[self.context].astype(float)
        kept = np.flatnonzero(~np.isnan(other))
        stored = self.stored[kept] > 0
        p, lower = self.shares(kept, np.maximum(self.stored[kept], 1))
        factor = np.where(stored, np.log10(p / np.where(stored, lower, 1.0)), other[kept])
        gain = self.gain + self.chunk.per_doc(self.place[kept], factor)
        counts = np.zeros(len(self.chunk.code), np.int64)
        counts[self.place] = self.stored
        kept = kept[(self.chunk.before[self.place[kept]] > self.level) & (counts[self.place[kept] - 1] >= self.model.least)]
        place = self.place[kept]
        return self.blob(self.base, self.known, gain, place, counts[place - 1], counts[place], self.total[kept]), len(place)


def dealt(chunk: int, shards: int, bits: int, keys: np.ndarray, *columns: np.ndarray, some: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted questions packed by range of the key; after ``columns`` come those that only ``some`` have."""
    of = ((keys >> np.uint64(bits - 32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    place = None if some is None else np.concatenate([[0], np.cumsum(some)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = 1 if some is None else 2
        cut = [c[a:b] for c in columns[:n]] + [c[place[a] : place[b]] for c in columns[n:]]
        cut = [narrow(c) if c.dtype == np.int64 else c for c in cut]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([int(of[a])], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "blob": [thin(steps(keys[a:b]), *cut)]})


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[list[np.ndarray]]]]:
    """All questions of a shard, by chunk; rows come sorted, and a shard may go on in the next batch."""
    held, chunks, parts = None, [], []
    for batch in batches:
        for shard, chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if shard != held and parts:
                yield held, chunks, parts
                chunks, parts = [], []
            held = shard
            chunks.append(chunk)
            parts.append(thick(raw.as_py()))
    if parts:
        yield held, chunks, parts


def grouped(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of all questions by key, earlier chunks first; the first of each key and each one's key there; where the parts end."""
    key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    order = ordered(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return order, np.flatnonzero(new), np.cumsum(new) - 1, np.cumsum([len(p[0]) for p in parts])


def counts_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each question twice the count over all chunks, 0 below ``least``, and 1 more for the chunk that is to speak for the sequence."""
        for shard, chunks, parts in by_shard(batches):
            order, first, of, ends = grouped(parts)
            n = np.concatenate([p[1] for p in parts]).astype(np.int64)[order]
            total = np.add.reduceat(n, first)
            total[total < least] = 0
            speaker = np.minimum.reduceat(np.where(n > 0, np.arange(len(n)), len(n)), first)[total > 0]
            said = 2 * total[of]
            said[speaker] += 1
            out = np.empty(len(n), np.int64)
            out[order] = said
            for chunk, mine in zip(chunks, np.split(out, ends[:-1]), strict=True):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "shard": pa.array([shard], pa.int32()), "spoken": pa.array([int((mine & 1).sum())], pa.int64()), "blob": [thin(narrow(mine))]})

    return run


def states_of(divergence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each context that is a state log10 of the factor of successors that are not stored, else NaN."""
        for shard, chunks, parts in by_shard(batches):
            order, first, of, ends = grouped(parts)
            total = np.concatenate([p[1] for p in parts])[order][first].astype(float)
            some = np.concatenate([p[2] for p in parts])
            group = np.empty(len(of), np.int64)
            group[order] = of
            size, n, p, lower, logs = (np.bincount(group[some], np.concatenate([q[k] for q in parts]), minlength=len(first)) for k in range(3, 8))
            other = np.maximum(1 - p, 1e-12) / np.maximum(1 - lower, 1e-12)
            gain = logs + (total - n) * np.log(other)
            kept = (size > 0) & (gain > 0.5 * (size + 1) * np.log(total + 1)) & (gain > divergence * total)
            out = np.where(kept, np.log10(other), np.nan).astype(np.float32)[group]
            for chunk, mine in zip(chunks, np.split(out, ends[:-1]), strict=True):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "shard": pa.array([shard], pa.int32()), "spoken": pa.array([0], pa.int64()), "blob": [thin(mine)]})

    return run


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Written to the shared folder by bucket of the chunk, so that joins leave it where it is. The catalogue forgets it at once."""
    spark, table = df.sparkSession, f"tm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tidemark/{name}-{table}"
    df.write.bucketBy(buckets, "chunk").format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    folds: int = 5,
    held_out: int = 1,
    least: int = 2,
    depth: int = 3,
    divergence: float = 0.01,
    discount: float = 0.75,
    chunk_tokens: int = 1 << 19,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Documents with crc32(id as text) mod ``folds`` = ``held_out`` are scored but not learned from. Null and empty texts are one
    end token. A null id counts as 2^63 - 1; rows that repeat an id are documents of their own. Without training
    documents all counts are zero. An empty table gives no rows."""
    spark = docs.sparkSession
    table = prepared(docs, id_col, text_col, binary=True)
    n_bytes = table.agg(F.sum(F.octet_length("tm_text").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES + 1)
    chunks = bucketed(table.mapInArrow(chunked(chunk_tokens, folds, held_out), "chunk long, tokens long, trained long, blob binary"), "lm-chunks", buckets)
    sizes = chunks.agg(F.sum("tokens").alias("tokens"), F.sum("trained").alias("trained")).first()
    n_all, n_tokens = sizes.tokens or 0, sizes.trained or 0
    model = Model(least, divergence, discount)
    answered = "chunk long, shard int, spoken long, blob binary"

    def asked(rows: DataFrame, questions, shards: int) -> DataFrame:
        made = rows.mapInArrow(questions, "shard int, chunk long, blob binary")
        return made.repartition(shards, "shard").sortWithinPartitions("shard", "chunk")

    def with_answers(left: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        """Answers by chunk, in order of their shards."""
        mine = answers.repartition(buckets, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "blob"))).alias(name))
        return left.join(mine.hint("shuffle_hash"), "chunk", "left")  # a bucket's answers are few beside its texts

    def lists(column: pa.Array) -> list[list[bytes]]:
        return [[x["blob"] for x in row or []] for row in column.to_pylist()]

    def one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.slice(k, 1) for b in batches for k in range(b.num_rows))

    # level 0: words
    shards = n_all // SHARD_TOKENS + 1

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in one_each(batches):
            c = Chunk(b.column(1)[0].as_py())
            order = np.argsort(c.vocabulary)
            n = np.bincount(c.code[c.trained], minlength=len(order))
            yield from dealt(b.column(0)[0].as_py(), shards, 64, c.vocabulary[order], n[order])

    counts = written(asked(chunks.select("chunk", "blob"), words, shards).mapInArrow(counts_of(1), answered), "lm-words")
    n_words = counts.agg(F.sum("spoken")).first()[0] or 0
    model.norm = n_tokens + 0.5 * (n_words + 1)
    model.bits = min(64, max(44, 18 + int(n_all).bit_length()))

    def first_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in one_each(batches):
            c = Chunk(b.column(1)[0].as_py())
            n = np.empty(len(c.vocabulary), np.int64)
            n[np.argsort(c.vocabulary)] = np.concatenate([thick(a)[0] for a in lists(b.column(2))[0]]) >> 1
            base = c.per_doc(np.arange(len(c.code)), np.log10((n + 0.5) / model.norm)[c.code])
            none = np.zeros(0, np.int64)
            blob = Level.blob(base, c.per_doc(np.flatnonzero(n[c.code])), np.zeros(len(c.ids)), none, n, none, none)
            yield pa.RecordBatch.from_pydict({"chunk": b.column(0), "active": pa.array([len(c.code) if (n >= model.least).any() else 0], pa.int64()), "state": [blob]})

    kinds = "chunk long, active long, state binary"
    state = bucketed(with_answers(chunks.select("chunk", "blob"), counts, "counts").mapInArrow(first_state, kinds), "lm-state", buckets)

    for level in range(1, depth + 1):
        active = state.agg(F.sum("active")).first()[0] or 0
        if not active:
            break
        shards = active // SHARD_TOKENS + 1
        placed = chunks.select("chunk", "blob").join(state.select("chunk", "state").hint("shuffle_hash"), "chunk")

        def levels(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[tuple[int, Level, list[list[bytes]]]]:
            for b in one_each(batches):
                yield b.column(0)[0].as_py(), Level(Chunk(b.column(1)[0].as_py()), level, model, b.column(2)[0].as_py()), [lists(c)[0] for c in b.columns[3:]]

        def ask_counts(batches: Iterator[pa.RecordBatch], levels=levels, shards=shards) -> Iterator[pa.RecordBatch]:
            for chunk, at, _ in levels(batches):
                yield from dealt(chunk, shards, model.bits, *at.count_questions())

        def ask_states(batches: Iterator[pa.RecordBatch], levels=levels, shards=shards) -> Iterator[pa.RecordBatch]:
            for chunk, at, (n,) in levels(batches):
                at.take_counts(n)
                keys, total, some, *sums = at.state_questions()
                yield from dealt(chunk, shards, model.bits, keys, total, some, *sums, some=some)

        def go_on(batches: Iterator[pa.RecordBatch], levels=levels) -> Iterator[pa.RecordBatch]:
            for chunk, at, (n, other) in levels(batches):
                at.take_counts(n)
                blob, left = at.next_state(other)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "active": pa.array([left], pa.int64()), "state": [blob]})

        counts = written(asked(placed, ask_counts, shards).mapInArrow(counts_of(least), answered), "lm-counts")
        counted = with_answers(placed, counts, "counts")
        states = written(asked(counted, ask_states, shards).mapInArrow(states_of(divergence), answered), "lm-states")
        state = bucketed(with_answers(counted, states, "states").mapInArrow(go_on, kinds), "lm-state", buckets)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in one_each(batches):
            ids, sizes, train, _, _ = thick(b.column(0)[0].as_py())
            base, known, gain, *_ = thick(b.column(1)[0].as_py())
            names = ["tm_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, ~train, sizes, known, np.full(len(ids), n_tokens), base, base + gain)], names=names)

    out = chunks.select("chunk", "blob").join(state.hint("shuffle_hash"), "chunk").select("blob", "state").mapInArrow(scored, "tm_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(given_id().alias("doc_id"), *out.columns[1:])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))

"""Best-fit packing by large-item matching, planned on the histogram of lengths.

Documents become runs of token ids, cut at the capacity. Pieces above a third of it can share a sequence only
two by two: they are matched greedily, each with the largest partner that fits. Smaller pieces, by falling
length, go to the smallest gap that holds them. Pieces of one length are alike, so the driver plans on counts by
length - at most as many rows as the capacity has tokens, at any corpus size - and the plan is a list of
runs: the n pieces of a length from rank r on go to the sequences from s on. Ranks are counted per
partition and lifted by the counts of the partitions before, so no length is sorted or held in one task.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, given_id, prepared, small_enough, written

CAPACITY = 4096
END_ID = 1
#: Words and parts of words remembered by a task.
CACHED = 400_000
#: White space to the tokenizer; Python's str.split() also parts at these four.
PARTS_TOO = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[^\\S\x1c-\x1f]+")
#: How the tokenizer parts a lower-case word without ODD characters.
PART = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
#: Anything but ASCII's white space and printable characters and the plain Latin letters, which have one form and one lower case each.
ODD = re.compile(r"[^\x09-\x0d\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")


class Words:
    """Token ids, as little-endian bytes. The tokenizer drops white space and never joins across it, so each word between white
    space is looked up, and learned once for all texts.

    New words of a text of plain characters split here as the tokenizer splits them, into parts that many words share.
    Words of other texts go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.odd_words: dict[str, bytes] = {}

    def learn_parts(self, new: set[str]) -> None:
        """ASCII parts are their own bytes, so the tokenizer's model takes them as they are; the others go through its normalizer."""
        tokenize = self.tokenizer.model.tokenize
        plain = list(filter(str.isascii, new))
        made = [[t.id for t in tokenize(part)] for part in plain]
        self.parts.update(zip(plain, [struct.pack(f"<{len(ids)}I", *ids) for ids in made], strict=True))
        others = [part for part in new if not part.isascii()]
        for k in range(0, len(others), 2_000):
            some = others[k : k + 2_000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not split words as expected")
            raw, start = ids.tobytes(), 0
            for part, end in zip(some, ends.tolist(), strict=True):
                self.parts[part] = raw[start:end]
                start = end

    def learn_words(self, new: set[str]) -> None:
        """Words in lower case, of plain characters."""
        if len(self.parts) > CACHED:
            self.parts.clear()
        whole = set(filter(str.isalpha, new))  # these are one part
        mixed = list(new - whole)
        split = list(map(PART.findall, mixed))
        self.learn_parts(whole.union(*split).difference(self.parts))
        get = self.parts.__getitem__
        self.words.update(zip(whole, map(get, whole), strict=True))
        self.words.update(zip(mixed, [b"".join(map(get, parts)) for parts in split], strict=True))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        odd = [ODD.search(t) is not None for t in texts]
        split = [(WHITE.split(t) if PARTS_TOO.search(t) else t.split()) if o else t.lower().split() for t, o in zip(texts, odd, strict=True)]
        here = set().union(*(words for words, o in zip(split, odd, strict=True) if not o))
        if len(self.words) > CACHED:  # words of these texts stay: the frequent ones among them
            self.words = {w: self.words[w] for w in here if w in self.words}
        self.learn_words(here.difference(self.words))
        end, get = np.array([END_ID], "<u4").tobytes(), self.words.__getitem__
        for words, o in zip(split, odd, strict=True):
            yield b"".join(map(self.odd_word if o else get, words)) + end

    def odd_word(self, word: str) -> bytes:
        if (ids := self.odd_words.get(word)) is None:
            if len(self.odd_words) > CACHED:
                self.odd_words.clear()
            ids = self.odd_words[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return ids


LOADED: dict[str, Words] = {}


def pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = LOADED.get(path) or LOADED.setdefault(path, Words(path))
        part, seen = TaskContext.get().partitionId(), Counter()
        names = ["tm_id", "piece", "start", "length", "ids_crc32", "tm_part", "tm_nth"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows = []
                for i, ids in zip(some.column(0).to_pylist(), words.ids(some.column(1).to_pylist()), strict=True):
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[b : b + 4 * capacity]
                        n = len(cut) // 4
                        rows.append((i, k, b // 4, n, zlib.crc32(cut), part, seen[n]))
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def planned(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, offset, pieces a sequence) sorted by length and
    rank, and the number of sequences."""
    left, rank = dict(counts), Counter()
    runs: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    open_gaps: list[int] = []
    n_seq = 0

    def put(length: int, n: int, seq: int, offset: int, each: int = 1) -> None:
        runs.append((length, rank[length], n, seq, offset, each))
        rank[length] += n
        left[length] -= n

    def opened(gap: int, seq: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((seq, n))

    large = sorted(k for k in counts if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            k = bisect.bisect_right(large, min(length, capacity - length)) - 1
            while k >= 0 and (left[large[k]] == 0 or large[k] == length and left[length] < 2):
                k -= 1
            if k < 0:
                n = left[length]
                opened(capacity - length, n_seq, n)
                put(length, n, n_seq, 0)
            elif (other := large[k]) == length:
                n = left[length] // 2
                opened(capacity - 2 * length, n_seq, n)
                put(length, 2 * n, n_seq, 0, 2)
            else:
                n = min(left[length], left[other])
                opened(capacity - length - other, n_seq, n)
                put(length, n, n_seq, 0)
                put(other, n, n_seq, length)
            n_seq += n

    for length in sorted((k for k in counts if 3 * k <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(open_gaps, length)
            if k == len(open_gaps):  # nothing holds it: new sequences
                n = -(-left[length] // (capacity // length))
                opened(capacity, n_seq, n)
                n_seq += n
                k = len(open_gaps) - 1
            gap = open_gaps[k]
            seq, n = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(k)
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, seq, capacity - gap, each)
                opened(gap - each * length, seq, full)
                seq, n = seq + full, n - full
            if n and left[length]:  # fewer than one sequence takes
                last = left[length]
                put(length, last, seq, capacity - gap, last)
                opened(gap - last * length, seq, 1)
                seq, n = seq + 1, n - 1
            opened(gap, seq, n)
    return np.array(sorted(runs), np.int64).reshape(-1, 6), n_seq


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the one end id; rows that repeat an id are documents of their own; ids are returned as
    given, null ones too. An empty table gives no rows."""
    spark = docs.sparkSession
    cut = written(prepared(docs, id_col, text_col).mapInArrow(pieces(tokenizer, capacity), "tm_id long, piece int, start long, length long, ids_crc32 long, tm_part int, tm_nth long"), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(planned(counts, capacity)[0])

    before = Window.partitionBy("length").orderBy("tm_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    lifts = written(cut.groupBy("tm_part", "length").agg(F.count(F.lit(1)).alias("tm_n")).select("tm_part", "length", F.coalesce(F.sum("tm_n").over(before), F.lit(0)).alias("tm_lift")), "pack-lifts")
    ranked = cut.join(F.broadcast(lifts) if small_enough(lifts) else lifts, ["tm_part", "length"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        span = int(runs[:, 1:3].sum(axis=1).max()) + 1 if len(runs) else 1
        keys = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy().astype(np.int64) for k in ("length", "tm_rank"))
            r = runs[np.searchsorted(keys, length * span + rank, "right") - 1]
            nth = rank - r[:, 1]
            seq, offset = r[:, 3] + nth // r[:, 5], r[:, 4] + nth % r[:, 5] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    rows = ranked.select("tm_id", "piece", "start", "length", "ids_crc32", (F.col("tm_nth") + F.col("tm_lift")).alias("tm_rank"))
    out = rows.mapInArrow(placed, "tm_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(given_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())

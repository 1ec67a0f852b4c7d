"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Every word starts a suffix of up to ``longest`` words that ends with its piece of text. Suffixes are routed by their leading words
to shards over all texts; a shard sorts pointers to its suffixes with one word as the key at a time: those below the
pivot, those equal and those above. The weight of an equal partition is the count of its phrase, and the partition goes on with the next word.
A partition below the least count is abandoned: all that starts with these words is in this shard, so no phrase of it can be frequent.

How words are dealt: a task first counts equal suffixes of about a million words, and sends each shard one compressed run of them.
A leading word of too many suffixes for one shard is routed with the word behind it, and so on up to all words. Which words those are is
estimated on a sample of texts; that decides where suffixes go, never what is counted: phrases that are shorter than their route are
counted by the tasks themselves and summed, one row a run. Frequent phrases, their cuts and the longer phrases that cover them meet in
joins of tables; nothing about phrases passes through the driver.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import documents, small_enough, written

LEAST, LONGEST, TOP, COVER, SCORE = 30, 4, 2000, 80, 2_000_000
#: Suffixes of a shard, about, and words of a run.
SHARD_ROWS, RUN_WORDS = 500_000, 1_000_000
#: Words of the sample from which crowded leading words are told, about, and how often one must be in it.
SAMPLE_WORDS, SEEN = 8_000_000, 8
#: Tasks that shards are dealt to at most; a task works on one shard at a time.
MOST_TASKS = 8192
#: Distinct words that a task remembers.
WORDS = 600_000

END = b"."  #: ends a piece; no word holds it
_PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Words to numbers, given as they come; 0 ends a piece."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.numbers[END]
        self.words: list[bytes] = [END]

    def __len__(self) -> int:
        return len(self.numbers)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))

    def text(self) -> list[bytes]:
        self.words += islice(self.numbers, len(self.words), None)
        return self.words


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, END between pieces."""
    return text.translate(_PIECES).replace(END, b" . ").split()


def suffixes(codes: np.ndarray, longest: int) -> np.ndarray:
    """A row for each word: itself and the words behind it within its piece, then zeros."""
    wide = np.zeros((len(codes), longest), np.int32)
    wide[:, 0] = codes
    for k in range(1, longest):
        wide[:-k, k] = codes[k:]
        wide[:, k][wide[:, k - 1] == 0] = 0
    return wide[codes != 0]


def mixed(hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the leading words, by how many."""
    out = [hashes[rows[:, 0]]]
    for k in range(1, rows.shape[1]):
        out.append((out[-1] * _MIX) ^ hashes[rows[:, k]])
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    """From two checksums of different starts, spread by a multiplication; 0 for the end of a piece."""
    out = np.array([zlib.crc32(w) << 32 | zlib.adler32(w, zlib.crc32(w, 7)) for w in words], np.uint64) * _MIX
    out[0] = 0
    return out


def in_order(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and words, and whether each is the first of its kind in it."""
    columns = [groups.astype(np.uint64), *(c.astype(np.uint64) for c in rows.T)]
    bits = [int(c.max() if len(c) else 0).bit_length() for c in columns]
    keys, room = [columns[0]], 64 - bits[0]
    for c, b in zip(columns[1:], bits[1:], strict=True):  # as few keys as hold them
        if b <= room:
            keys[-1] = keys[-1] << np.uint64(b) | c
            room -= b
        else:
            keys.append(c)
            room = 64 - b
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    first = np.zeros(len(order), bool)
    first[:1] = True
    for key in keys:
        key = key[order]
        first[1:] |= key[1:] != key[:-1]
    return order, np.flatnonzero(first)


def counted(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of one group in order, their groups and how often they come."""
    order, at = in_order(rows, groups)
    return rows[order[at]], groups[order[at]], np.diff(np.append(at, len(rows)))


def summed(rows: np.ndarray, groups: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, at = in_order(rows, groups)
    return rows[order[at]], groups[order[at]], np.add.reduceat(weights[order], at)


def packed(rows: np.ndarray, groups: np.ndarray, weights: np.ndarray, lead: np.ndarray, words: list[bytes], names: list[str], scratch: np.ndarray) -> bytes:
    """A run: its own words and groups, and the columns of its suffixes, compressed. ``scratch`` has a place for each word."""
    used = np.unique(rows)
    scratch[used] = np.arange(len(used), dtype=np.int32)
    small = np.min_scalar_type(len(used))
    columns = [*(scratch[c].astype(small) for c in rows.T), groups.astype(np.uint16 if len(names) < 65536 else np.uint32), weights.astype(np.min_scalar_type(int(weights.max()))), lead.astype(np.uint8)]
    named = np.unique(groups)
    head = json.dumps({"n": len(rows), "kinds": [c.dtype.str for c in columns], "groups": {int(g): names[g] for g in named}}).encode()
    body = END.join(words[u] if u else b"" for u in used.tolist())
    raw = b"".join([len(head).to_bytes(4, "little"), len(body).to_bytes(4, "little"), head, body, *(np.ascontiguousarray(c).tobytes() for c in columns)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[list[bytes], dict[int, str], list[np.ndarray]]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    a, b = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    head, at, columns = json.loads(raw[8 : 8 + a]), 8 + a + b, []
    for kind in head["kinds"]:
        columns.append(np.frombuffer(raw, kind, head["n"], at))
        at += columns[-1].nbytes
    return raw[8 + a : 8 + a + b].split(END), {int(g): name for g, name in head["groups"].items()}, columns


class Runs:
    """Words of one task's texts; makes its runs."""

    def __init__(self, longest: int):
        self.longest, self.vocabulary, self.groups = longest, Vocabulary(), {}
        self.hashes = np.zeros(0, np.uint64)
        self.codes: list[np.ndarray] = []
        self.of: list[int] = []

    def add(self, group: str, text: bytes) -> int:
        words = words_of(text)
        self.codes.append(self.vocabulary.of(words))
        self.of.append(self.groups.setdefault(group, len(self.groups)))
        return len(words)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct suffixes, their groups, their counts; and forgets the texts."""
        ended = [x for codes in self.codes for x in (codes, np.zeros(1, np.int32))]
        flat = np.concatenate(ended) if ended else np.zeros(0, np.int32)
        of = np.repeat(self.of, [len(c) + 1 for c in self.codes]).astype(np.int32)
        self.codes, self.of = [], []
        made = counted(suffixes(flat, self.longest), of[flat != 0])
        words = self.vocabulary.text()
        if len(self.hashes) < len(words):
            self.hashes = np.concatenate([self.hashes, word_hashes([END, *words[len(self.hashes) :]])[1:] if len(self.hashes) else word_hashes(words)])
        return made

    def forget(self) -> None:
        if len(self.vocabulary) > WORDS:
            self.vocabulary, self.hashes = Vocabulary(), np.zeros(0, np.uint64)


def texts_in(batches: Iterator[pa.RecordBatch], runs: Runs, words: int) -> Iterator[None]:
    """Stops at each run of about as many words, and at the end."""
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for group, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                n += runs.add(group, text)
                if n >= words:
                    yield
                    n = 0
    if n:
        yield


def leading(longest: int):
    """How often the sample's texts have which leading words: a row for each run, number of words and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(longest)
        for _ in texts_in(batches, runs, RUN_WORDS):
            rows, _, weights = runs.take()
            hashes = mixed(runs.hashes, rows)
            for k in range(longest - 1):
                there = rows[:, k] != 0
                h, at = np.unique(hashes[k][there], return_inverse=True)
                n = np.bincount(at, weights[there], len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k + 1, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["k", "h", "n"])
            runs.forget()

    return run


def routed(longest: int, crowded: list[np.ndarray], shards: int):
    """A row for each run and shard: the run's suffixes for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(longest)
        for _ in texts_in(batches, runs, RUN_WORDS):
            rows, groups, weights = runs.take()
            if not len(rows):
                continue
            names, words, hashes = list(runs.groups), runs.vocabulary.text(), mixed(runs.hashes, rows)
            scratch = np.zeros(len(words), np.int32)
            # words that lead the way: one, and one more as long as they are crowded
            lead, still = np.ones(len(rows), np.uint8), np.ones(len(rows), bool)
            to = hashes[0].copy()
            parts = []
            for k in range(longest - 1):
                still &= np.isin(hashes[k], crowded[k])
                if not still.any():
                    break
                lead[still], to[still] = k + 2, hashes[k + 1][still]
                # a crowded phrase is spread over shards: counted here, as whole
                short = rows[still].copy()
                short[:, k + 1 :] = 0
                parts.append((short, groups[still], weights[still], np.zeros(len(short), np.uint8), hashes[k][still]))
            parts.append((rows, groups, weights, lead, to))
            for rows_, groups_, weights_, lead_, to_ in parts:
                shard = (to_ % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                numbers, blobs = [], []
                for some in np.split(order, cuts):
                    r, g, n = rows_[some], groups_[some], weights_[some]
                    if not lead_[some[0]]:  # crowded phrases of one run: summed first
                        r, g, n = summed(r, g, n)
                    numbers.append(int(shard[some[0]]))
                    blobs.append(packed(r, g, n, lead_[some][: len(r)], words, names, scratch))
                    if len(blobs) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "run"])
                        numbers, blobs = [], []
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "run"])
            runs.forget()

    return run


def multikey(keys: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Three-way quicksort of pointers, one key after another. Yields the equal partitions of at least the least weight as (number of keys
    they share, pointers, weight); a 0 behind the first key is no key, and nothing comes behind it."""
    stack = [(np.arange(len(weights)), 0, int(weights.sum()))] if len(weights) else []
    while stack:
        at, depth, total = stack.pop()
        key, own = keys[depth][at], weights[at]
        some = np.sort(key[:: len(key) // 32 + 1])
        pivot = some[len(some) // 2]
        same = key == pivot
        n = int(own[same].sum())
        if n < total:  # what is too rare is abandoned with all that starts so
            below = key < pivot
            n_below = int(own[below].sum())
            if n_below >= least:
                stack.append((at[below], depth, n_below))
            if total - n - n_below >= least:
                stack.append((at[key > pivot], depth, total - n - n_below))
            at = at[same]
        if n >= least and (pivot or depth == 0):
            yield depth + 1, at, n
            if depth + 1 < len(keys):
                stack.append((at, depth + 1, n))


class Shard:
    """Suffixes of one shard, gathered run by run in numbers of its own."""

    def __init__(self, longest: int, least: int):
        self.longest, self.least = longest, least
        self.vocabulary, self.groups = Vocabulary(), {}
        self.columns: list[list[np.ndarray]] = [[] for _ in range(longest + 3)]

    def add(self, blob: bytes) -> None:
        words, groups, columns = unpacked(blob)
        own = self.vocabulary.of([w or END for w in words[:1]] + words[1:])
        renamed = np.zeros(max(groups) + 1, np.int32)
        for g, name in groups.items():
            renamed[g] = self.groups.setdefault(name, len(self.groups))
        for k in range(self.longest):
            self.columns[k].append(own[columns[k]])
        self.columns[-3].append(renamed[columns[-3]])
        self.columns[-2].append(columns[-2].astype(np.int64))
        self.columns[-1].append(columns[-1])

    def phrases(self) -> Iterator[pa.RecordBatch]:
        """(group, number of words, phrase, count); of no words: all words of the group here."""
        *words, group, weights, lead = (np.concatenate(c) for c in self.columns)
        names, text = list(self.groups), self.vocabulary.text()
        made: list[tuple[str, int, str, int]] = []
        inside = lead > 0
        for g, n in enumerate(np.bincount(group[inside], weights[inside], len(names)).astype(np.int64).tolist()):
            made.append((names[g], 0, "", n))  # sums below 2**53 are exact
        say = lambda at, k: b" ".join(text[words[j][at]] for j in range(k)).decode()
        whole = np.flatnonzero(~inside)
        if len(whole):  # crowded phrases, one row for each run
            rows, of, n = summed(np.stack([w[whole] for w in words], axis=1), group[whole], weights[whole])
            for r, g, c in zip(rows.tolist(), of.tolist(), n.tolist(), strict=True):
                got = [text[w] for w in r if w]
                made.append((names[g], len(got), b" ".join(got).decode(), c))
        kept = np.flatnonzero(inside)
        lead, weights = lead[kept], weights[kept]
        keys = [group[kept], *(w[kept] for w in words)]
        over = np.ones(len(kept), bool)
        for k in range(self.longest):  # a word that is too rare at its place here ends the suffix
            often = np.bincount(keys[k + 1], weights, len(text)) >= self.least
            over &= often[keys[k + 1]]
            keys[k + 1] = np.where(over, keys[k + 1], 0)
        for depth, at, n in multikey(keys, weights, self.least):
            if depth > 1 and depth - 1 >= lead[at[0]]:  # crowded ones are counted elsewhere
                made.append((names[keys[0][at[0]]], depth - 1, say(kept[at[0]], depth - 1), n))
            if len(made) >= 50_000:
                yield self.batch(made)
                made = []
        if made:
            yield self.batch(made)

    @staticmethod
    def batch(rows: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tm_group", "k", "phrase", "f"])


def sorted_shards(longest: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                if (n := batch.column(0)[k].as_py()) != number:
                    if shard:
                        yield from shard.phrases()
                    number, shard = n, Shard(longest, least)
                shard.add(batch.column(1)[k].as_py())
        if shard:
            yield from shard.phrases()

    return run


def crowded_words(table: DataFrame, longest: int, shard_rows: int, sample_words: int) -> tuple[list[np.ndarray], int]:
    """Hashes of leading words of more suffixes than a shard is to hold, by number of words, and all words, about.

    Both come from a sample of texts by hash; nothing is lost by what it misses, as it only deals suffixes to shards. It gives at most
    ``sample_words`` / SEEN hashes for each number of words, whatever the size of the corpus."""
    size = table.agg(F.sum(F.octet_length("tm_text")).alias("n")).first()["n"] or 0
    about = size // 6 + 1
    share = min(1.0, sample_words / about)
    some = table if share == 1 else table.where(F.pmod(F.xxhash64("tm_text", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = some.mapInArrow(leading(longest), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    crowd = counts.where(F.col("n") >= max(SEEN, int(shard_rows * share))).select("k", "h").toPandas()
    return [np.sort(crowd["h"][crowd["k"] == k + 1].to_numpy(np.int64).view(np.uint64)) for k in range(longest - 1)], about


def frequent_phrases(
    docs: DataFrame, group_col: str | None = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST, shard_rows: int = SHARD_ROWS, sample_words: int = SAMPLE_WORDS
) -> DataFrame:
    """tm_group, k (words), phrase, f of all phrases of up to ``longest`` words with f >= ``least``; with k = 0 the number of all words
    of the group. Counted are all occurrences within pieces, overlapping ones too."""
    spark = docs.sparkSession
    ship(spark)
    group = F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")) if group_col else F.lit("und")
    table = docs.select(group.alias("tm_group"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("tm_text"))
    crowded, about = crowded_words(table, longest, shard_rows, sample_words)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(about // shard_rows + 1, min(tasks, about // (shard_rows // 8 + 1) + 1))
    runs = table.mapInArrow(routed(longest, crowded, shards), "shard long, run binary")
    dealt = runs.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(sorted_shards(longest, least), "tm_group string, k int, phrase string, f long")
    total = found.groupBy("tm_group", "k", "phrase").agg(F.sum("f").alias("f"))
    return written(total.where((F.col("f") >= least) | (F.col("k") == 0)), "frequent-phrases")


def collocations(
    docs: DataFrame, group_col: str | None = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, cover: int = COVER, shard_rows: int = SHARD_ROWS, sample_words: int = SAMPLE_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each group's ``top`` phrases (all with None), by falling score, falling a, and phrase in the
    order of its UTF-8 bytes.

    A phrase of 2 to ``longest`` words with a >= ``least`` is scored at its weakest cut, floor(2000000 * a / (l + r)) with l and r the
    counts of both sides, of equals the first cut. It goes if a longer one holds its words in a row and has ``cover`` % of its count. Null texts
    are empty, null groups ``und``; repeated rows count as often as they come; columns of any other name are left behind; texts
    without words and empty tables give no rows."""
    phrases = frequent_phrases(docs, group_col, text_col, least=least, longest=longest, shard_rows=shard_rows, sample_words=sample_words)
    words = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")
    found = phrases.where("k > 1").withColumn("w", words)
    counts = phrases.where("k between 1 and " + str(longest - 1)).select(F.col("tm_group").alias("g"), F.col("phrase").alias("p"), F.col("f").alias("c"))
    cut = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("tm_group", "phrase", "k", "f", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    side = lambda of, name: counts.select(F.col("g").alias("tm_group"), F.col("p").alias(of), F.col("c").alias(name))
    cut = cut.join(side("head", "l"), ["tm_group", "head"]).join(side("tail", "r"), ["tm_group", "tail"])
    wide = lambda c: c.cast("decimal(19,0)")
    score = F.expr(f"cast(cast({SCORE} as decimal(19,0)) * cast(f as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    weakest = cut.withColumn("score", score).groupBy("tm_group", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "f")).alias("x"))
    inner = found.where("k > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)))
    covers = inner.groupBy("tm_group", part(F.col("at"), F.col("n")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = weakest.join(covers, ["tm_group", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * wide(F.col("longer")) < F.lit(cover).cast("decimal(5,0)") * wide(F.col("x.f"))))
    total = written(phrases.where("k = 0").select("tm_group", F.col("f").alias("n")), "group-words")
    size = F.octet_length("tm_group") + 40
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    out = left.select("tm_group", "phrase", F.col("x.f").alias("a"), F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))
    if top is not None:  # first within parts of a group, so that no task ranks all of one
        out = written(out, "collocations")
        parts = out.count() // 500_000 + 8
        out = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        out = out.withColumn("tm_rank", F.row_number().over(Window.partitionBy("tm_group", "salt").orderBy(*order))).where(F.col("tm_rank") <= top).drop("salt", "tm_rank")
    rank = F.row_number().over(Window.partitionBy("tm_group").orderBy(*order)).cast("long")
    out = out.withColumn("rank", rank)
    if top is not None:
        out = out.where(F.col("rank") <= top)
    out = out.join(F.broadcast(total) if small_enough(total, size) else total, "tm_group")
    return out.select(F.col("tm_group").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x{A}-\x{D}]')) AS t FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x{20}\x{9}]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) s(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.f, s.i AS cut, array_to_string(w[1 : s.i], ' ') AS head, array_to_string(w[s.i + 1 : c.k], ' ') AS tail FROM c, range(1, 4) s(i) WHERE s.i < c.k),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, cut, h.f AS l, t.f AS r, (2000000::HUGEINT * cuts.f // (h.f::HUGEINT + t.f))::BIGINT AS score FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covers AS (SELECT lang, array_to_string(w[s.i : s.i + m.k - 1], ' ') AS phrase, max(c.f) AS longer FROM c, range(1, 4) s(i), range(2, 4) m(k) WHERE m.k < c.k AND s.i + m.k - 1 <= c.k GROUP BY ALL),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN covers ON covers.lang = weakest.lang AND covers.phrase = weakest.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""

"""Quality classifier: a weak-label model over heuristic labellers, then a hashed linear scorer.

Each labeller says reject or nothing of a document. One of them counts stems that labelled
rows show to be many times as frequent in toxic texts; the others need no labels. Expectation
maximisation over the counts of vote patterns (at most 2 to the number of labellers, over all documents) finds how
often each labeller speaks in either class, and so the posterior of each pattern. The posteriors of a sample of
``train_docs`` documents teach a logistic scorer over hashed words, word starts and binned
statistics; features are shares of the words, so a document's score is one sum over its words, whatever its length.

Bounds: stems are learned on at most ``label_rows`` labelled rows, the scorer on about ``train_docs``
documents. Vote patterns are counted over, and the scorer is applied to, all documents and whole texts.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import documents, small_batches, written

PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
INSULTS = frozenset("idiot idiots idiotic moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown bastard bitch whore slut fool jerk crap shit fuck fucking asshole retard filthy vermin".split())
LABELLERS = ("shouting", "symbols", "stutter", "fragments", "monotony", "insults", "stems")
#: Labellers of one fault start out together; what each class says of each labeller is estimated.
FAULTS = (("shouting",), ("symbols",), ("stutter", "monotony"), ("fragments",), ("insults", "stems"))
HASHED = 1 << 16
#: Words' weight is their share of the text times this, so that one word in fifty counts as one.
SHARE_SCALE = 50.0
#: Added to the number of words, so that few words weigh less.
SMOOTH = 20
UPPER, NO_LETTER, INSULT, STEM = 1, 2, 4, 8
WITH_BIT = {bit: np.array([k for k in range(16) if k & bit]) for bit in (UPPER, NO_LETTER, INSULT, STEM)}
#: Taken off at both ends of a word before it is looked up.
EDGES = "\"'.,;:!?()[]{}<>*$%&#|"
CACHED = 150_000
#: Texts taken from a batch at once.
ROWS = 512


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def stems_of(word: str) -> list[str]:
    """The bare word in lower case, marked as whole, and its starts."""
    w = word.strip(EDGES).lower()
    n = len(w)
    return [w + "$", w[:5], w[:7]] if n >= 7 else [w + "$", w[:5]] if n >= 5 else [w + "$"] if n else []


class Kinds(dict):
    """Bit flags of a word, remembered; with weights its gain too, the sum of the weights of its features."""

    def __init__(self, stems: frozenset[str], weights: np.ndarray | None = None):
        self.stems, self.gains = stems, {}
        self.weights = None if weights is None else weights.tolist()

    def __missing__(self, word: str) -> int:
        found = stems_of(word)
        if found:
            k = UPPER * word.isupper() | INSULT * (found[0][:-1] in INSULTS) | STEM * (not self.stems.isdisjoint(found))
        else:
            k = NO_LETTER * (not any(map(str.isalnum, word)))
        self[word] = k
        if self.weights is not None:
            self.gains[word] = sum([self.weights[place(s)] for s in found])
        return k

    def trim(self) -> None:
        """Called between texts: memory stays bounded."""
        if len(self) > CACHED:
            self.clear()
            self.gains.clear()


def counted(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct words and how often each stands in the text."""
    counts = Counter(words)
    return list(counts), np.fromiter(counts.values(), np.int64, len(counts))


def statistics(text: str, words: list[str], distinct: list[str], times: np.ndarray, kinds: Kinds) -> tuple[float, ...]:
    """Shares: upper-case words, punctuation bytes, words that repeat the one before, words without letters or digits, distinct words, insults, stems."""
    n = len(words)
    if not n:
        return (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    raw = text.encode(errors="replace")
    each = np.bincount(np.fromiter(map(kinds.__getitem__, distinct), np.int64, len(distinct)), times, minlength=16)
    share = lambda bit: float(each[WITH_BIT[bit]].sum()) / n
    return (share(UPPER), (len(raw) - len(raw.translate(None, PUNCTUATION))) / len(raw), sum(map(operator.eq, words, words[1:])) / n, share(NO_LETTER), len(distinct) / n, share(INSULT), share(STEM))


def votes(n: int, s: tuple[float, ...]) -> str:
    """A letter a labeller: r(eject) or - (nothing)."""
    upper, punctuation, repeats, no_letter, distinct, insults, stems = s
    some = n >= 8
    said = (some and upper > 0.3, some and punctuation > 0.12, some and repeats > 0.2, some and no_letter > 0.1, n >= 30 and distinct < 0.25, insults > 0.004, n >= 4 and stems >= 0.01)
    return "".join("r" if v else "-" for v in said)


def em(patterns: dict[str, int], rounds: int = 60, seldom: float = 0.05) -> tuple[dict[str, float], dict[str, float]]:
    """The posterior of "reject" for each vote pattern, and each labeller's accuracy: how often it is right when it speaks.

    Clean documents are one class and each of FAULTS is another, as a text is rarely bad in every way at once; votes are
    independent within a class. The prior holds that labellers seldom speak of clean documents: it weighs as
    ``seldom`` of the documents, all clean and without a vote, and keeps the classes from changing places."""
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], float)
    spoke = np.array([[v == "r" for v in p] for p in names], float).reshape(len(names), len(LABELLERS))
    group = np.array([[name in f for name in LABELLERS] for f in FAULTS], float)
    post = np.c_[np.full(len(names), 0.5), np.minimum(spoke @ group.T, 1) * 4 + 0.01]
    post /= post.sum(axis=1, keepdims=True)
    total = max(weight.sum(), 1.0)
    for _ in range(rounds):
        n = weight @ post
        extra = np.r_[seldom * total + 1.0, np.full(len(FAULTS), 1.0)]
        p = ((weight[:, None] * post).T @ spoke + 0.05) / (n + extra)[:, None]
        p[0] = np.minimum(p[0], p[1:].max(axis=0) / 2)
        z = np.log((n + 0.1) / (n + 0.1).sum()) + spoke @ np.log(p).T + (1 - spoke) @ np.log1p(-p).T
        post = np.exp(z - z.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
    bad, all_ = (weight * (1 - post[:, 0])) @ spoke, weight @ spoke
    return dict(zip(names, (1 - post[:, 0]).tolist(), strict=True)), dict(zip(LABELLERS, (bad / np.maximum(all_, 1e-9)).tolist(), strict=True))


def place(feature: str) -> int:
    return zlib.crc32(feature.encode(errors="replace")) % HASHED


def binned(n: int, s: tuple[float, ...]) -> list[int]:
    """Hashed one-of-k features of the statistics; a text of few words has none to speak of."""
    return [place(f"\x00{j}:{min(9, int(v * 20))}") for j, v in enumerate(s[:5])] if n >= 8 else []


def shares(n: int, times: np.ndarray) -> np.ndarray:
    """Scaled shares of the distinct words, each one at most: a word that fills the text says no more than a frequent one."""
    return np.minimum(times * (SHARE_SCALE / (n + SMOOTH)), 1.0)


class Places(dict):
    def __missing__(self, word: str) -> list[int]:
        self[word] = out = list(map(place, stems_of(word)))
        return out


def mined(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_rows: int, ratio: float = 8.0) -> frozenset[str]:
    """Stems at least ``ratio`` times as frequent, word for word, in toxic texts, seen in one of 25 toxic texts and in 5."""
    ids = labels.select(F.col("doc_id").cast("long").alias("tm_id"), F.col("toxic").cast("int").alias("tm_toxic")).where("tm_id is not null and tm_toxic is not null")
    ids = ids.orderBy(F.xxhash64("tm_id"), "tm_id", "tm_toxic").limit(label_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("tm_id"), F.col(f"`{text_col}`").cast("string").alias("tm_text")).join(F.broadcast(ids), "tm_id").where("tm_text is not null")
    # copies would make any of their words look toxic; the least id tells the label of a text
    texts = texts.groupBy("tm_text").agg(F.min(F.struct("tm_id", "tm_toxic")).alias("tm_first")).select("tm_text", F.col("tm_first.tm_toxic").alias("tm_toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine: Counter = Counter()
                for w, n in Counter(text.split()).items():
                    for s in stems_of(w):
                        mine[s] += n
                words[toxic > 0].update(mine)
                held[toxic > 0].update(mine.keys())
                for c in (words, held):
                    c[toxic > 0][""] += 1 if c is held else len(text.split())
        keys = [*(words[0].keys() | words[1].keys() | {""})]
        for k in range(0, len(keys), 100_000):
            some = keys[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"stem": pa.array(some, pa.string()), "toxic": pa.array([words[1][s] for s in some], pa.int64()), "docs": pa.array([held[1][s] for s in some], pa.int64()), "clean": pa.array([words[0][s] for s in some], pa.int64())})

    sums = texts.select("tm_text", "tm_toxic").mapInArrow(count, "stem string, toxic long, docs long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"), F.sum("clean").alias("clean"))
    sums = written(sums, "quality-stems")
    total = sums.where("stem = ''").first()
    if total is None or not total.toxic:
        return frozenset()
    rate = (total.clean + 1) / total.toxic
    often = (F.col("stem") != "") & (F.col("docs") >= max(5.0, total.docs / 25)) & (F.col("toxic") * rate >= ratio * (F.col("clean") + 4))
    return frozenset(r.stem for r in sums.where(often).select("stem").collect())  # at most 25 times the stems of a toxic text


def fitted(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, decay: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; features of fewer than one in 400 documents (at least 5) keep the weight 0."""
    if not rows:
        return np.zeros(HASHED), -9.0
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    often = np.bincount(at, minlength=HASHED)[at] >= min(max(5, len(rows) // 400), len(rows))
    at, value, row = at[often], value[often], row[often]
    w, b = np.zeros(HASHED), 0.0
    m, v, mb, vb = np.zeros(HASHED), np.zeros(HASHED), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[at] * value, minlength=len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        g = np.bincount(at, d[row] * value, minlength=HASHED) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.99 * vb + 0.01 * d.sum() ** 2
        step = 0.15 * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (vb**0.5 + 1e-8)
    return w, b


def quality_scores(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", *, train_docs: int = 4000, label_rows: int = 8000) -> DataFrame:
    """All columns of ``docs``, then tm_votes, tm_posterior, tm_score (probability of "reject") and tm_kept (score below a half).

    Null and empty texts, and those of white space alone, get no votes, the score 0 and are kept. Ids only link labels:
    null and repeated ones are scored like any row. Equal texts count once in the sample. Without labels the stems are
    empty. An empty table gives no rows. Extra columns pass through, but those already called as the new ones make way."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    docs = docs.drop("tm_votes", "tm_posterior", "tm_score", "tm_kept")
    stems = mined(docs, labels, id_col, text_col, label_rows) if labels is not None else frozenset()
    lexicon = spark.sparkContext.broadcast(stems)
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("tm_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, seen = Kinds(lexicon.value), Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                words = text.split()
                kinds.trim()
                seen[votes(len(words), statistics(text, words, *counted(words), kinds))] += 1
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    patterns_ = texts.select("tm_text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = {r.pattern: r.n for r in patterns_.collect()}  # at most 2 to the number of labellers
    posterior, _ = em(patterns)
    total = sum(patterns.values())
    one_in = max(1, total // train_docs)
    shared = spark.sparkContext.broadcast(posterior)
    drawn = F.xxhash64("tm_text", F.lit(11))  # one in so many of the distinct texts, so their number is about train_docs at most
    sample = texts.where(F.pmod(drawn, F.lit(one_in)) == 0).groupBy(drawn.alias("tm_drawn")).agg(F.min("tm_text").alias("tm_text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, places = Kinds(lexicon.value), Places()
        for batch in sliced(batches):
            at, values, soft = [], [], []
            for text in batch.column(0).to_pylist():
                kinds.trim()
                if len(places) > CACHED:
                    places.clear()
                if not (words := text.split()):
                    continue
                distinct, times = counted(words)
                s = statistics(text, words, distinct, times, kinds)
                held: Counter = Counter()
                for w, v in zip(distinct, shares(len(words), times).tolist(), strict=True):
                    for p in places[w]:
                        held[p] += v
                fixed = binned(len(words), s)
                at.append([*held, *fixed])
                values.append([*held.values(), *[1.0] * len(fixed)])
                soft.append(shared.value[votes(len(words), s)])
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.list_(pa.int32())), "value": pa.array(values, pa.list_(pa.float32())), "soft": pa.array(soft, pa.float64())})

    made = sample.select("tm_text").mapInArrow(features, "at array<int>, value array<float>, soft double").toArrow()
    rows = list(zip((np.asarray(x.values) for x in made.column("at")), (np.asarray(x.values) for x in made.column("value")), made.column("soft").to_pylist(), strict=True))
    model = spark.sparkContext.broadcast(fitted(rows))

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in (("tm_votes", T.StringType()), ("tm_posterior", T.DoubleType()), ("tm_score", T.DoubleType())))])
    index = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        kinds = Kinds(lexicon.value, w)
        gain = kinds.gains.__getitem__
        for batch in sliced(batches):
            said, post, scores = [], [], []
            for text in batch.column(index).to_pylist():
                words = (text or "").split()
                kinds.trim()
                distinct, times = counted(words)
                s = statistics(text, words, distinct, times, kinds) if words else None
                said.append(votes(len(words), s) if s else "-" * len(LABELLERS))
                post.append(shared.value.get(said[-1]))
                if s:
                    z = float(np.fromiter(map(gain, distinct), float, len(distinct)) @ shares(len(words), times)) + float(w[np.array(binned(len(words), s), np.int64)].sum()) + b
                    scores.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
                else:
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(post, pa.float64()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema).withColumn("tm_kept", F.col("tm_score") < 0.5)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, votes, posterior, score and kept of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.col("tm_votes").alias("votes"), F.col("tm_posterior").alias("posterior"), F.col("tm_score").alias("score"), F.col("tm_kept").alias("kept"))

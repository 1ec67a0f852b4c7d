"""License scans over a positional rare-token index.

The index holds templates: a label, the words of a licence in order, and the place of a mandatory key phrase; it maps each word to its
postings, (template, position) pairs. Every licence word has an inverse document frequency counted over all documents. A
file's licence words are looked up from the highest IDF on, at most LOOKUPS for each template: places in the file less
positions in the template are the starts that a word speaks for. Starts on which all words of the key phrase agree
hold the phrase. What the other looked-up words say within DRIFT words of such a start bounds the weight that can be found, and
where it suffices the words are aligned: those that stand in order, each up to DRIFT words off its place, must make up SHARE of the
template's weight. Exact phrases are all key phrase.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, given_id, prepared

#: Exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: (sentence of the licence, its mandatory key phrase).
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    "apache": ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    "gpl": ("gnu general public license as published by the free software foundation", "gnu general public license"),
    "lgpl": ("gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    "agpl": ("gnu affero general public license as published by the free software foundation", "affero general public license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    "public-domain": ("dedicated to the public domain", "public domain"),
    "cc": ("licensed under a creative commons attribution license", "creative commons"),
    "no-copy": ("no part of this publication may be reproduced", "may be reproduced"),
}
#: Label: (name of the licence, its SPDX identifier). Notices put the thing under the name; a name alone is none, but those of CC.
NAMES = {
    "mit": ("the mit license", "mit"),
    "apache": ("the apache license", "apache 2 0"),
    "bsd": ("the bsd license", "bsd 3 clause"),
    "gpl": ("the gnu general public license", "gpl 3 0"),
    "lgpl": ("the gnu lesser general public license", "lgpl 3 0"),
    "agpl": ("the gnu affero general public license", "agpl 3 0"),
    "mpl": ("the mozilla public license", "mpl 2 0"),
    "epl": ("the eclipse public license", "epl 2 0"),
    "isc": ("the isc license", "isc"),
    "cc-by-nc": ("cc by nc", "cc by nc 4 0"),
    "cc-by-nd": ("cc by nd", "cc by nd 4 0"),
    "cc-by-sa": ("cc by sa", "cc by sa 4 0"),
    "cc0": ("cc0", "cc0 1 0"),
}
FORMS = ("licensed under", "released under", "distributed under", "available under", "under the terms of")
NOTICES = [(label, f"{form} {name}", name if name.startswith("cc") else f"{form.split(' ', 1)[-1]} {name}") for label, (name, _) in NAMES.items() for form in FORMS]
NOTICES += [(label, f"spdx license identifier {spdx}", f"identifier {spdx}") for label, (_, spdx) in NAMES.items()]

WORD_BYTES = bytes(b if chr(b).isdigit() and b < 0x80 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: The share of a template's weight that must be found, how many words a word may stand off its place, and the words looked up for a template.
SHARE = 0.6
DRIFT = 4
LOOKUPS = 8


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of ASCII letters, digits and anything beyond ASCII."""
    return text.lower().translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: range  # places of the key phrase
    exact: bool


def templates(phrases: dict[str, str], longer: list[tuple[str, str, str]]) -> list[Template]:
    out = [Template(label, tuple(words_of(p.encode())), range(len(words_of(p.encode()))), True) for p, label in phrases.items()]
    for label, sentence, key in longer:
        w, k = tuple(words_of(sentence.encode())), tuple(words_of(key.encode()))
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        out.append(Template(label, w, range(at, at + len(k)), False))
    return out


def frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold each word of the templates, one row a word and task; the empty word counts all."""
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
            seen[b""] += batch.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    return run


class Index:
    def __init__(self, found: list[Template], idf: dict[bytes, float]):
        self.templates, self.idf, self.vocabulary = found, idf, frozenset(idf)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.keys: dict[bytes, list[int]] = defaultdict(list)  # word: templates whose key phrase has it
        for k, t in enumerate(found):
            for i, w in enumerate(t.words):
                self.postings[w].append((k, i))
            for w in {t.words[i] for i in t.key}:
                self.keys[w].append(k)
        self.key_words = [len({t.words[i] for i in t.key}) for t in found]
        self.weight = [sum(idf[w] for w in t.words) for t in found]

    def looked_up(self, mine: set[bytes]) -> dict[int, set[int]]:
        """Of each template whose key phrase the file has all words of, the positions of the file's highest-IDF licence words; the key's always."""
        held = Counter(k for w in mine for k in self.keys.get(w, ()))
        out = {k: set(self.templates[k].key) for k, n in held.items() if n == self.key_words[k]}
        if not out:
            return out
        taken: Counter = Counter()
        for w in sorted(mine, key=lambda w: (-self.idf[w], w)):
            for k in {k for k, _ in self.postings[w]}.intersection(out):
                if taken[k] < LOOKUPS:
                    taken[k] += 1
                    out[k].update(i for j, i in self.postings[w] if j == k)
        return out

    def aligned(self, t: Template, words: list[bytes], start: int) -> float:
        """The largest weight of words of ``t`` that stand in order within DRIFT of their places; the key phrase is at its own."""

        def side(places: range, low: int, high: int) -> float:
            best = [0.0] * (high - low + 1)  # by how many words of the text are taken
            for i in places:
                new = best[:]
                for j in range(low, high):
                    if words[j] == t.words[i] and abs(j - start - i) <= DRIFT:
                        new[j - low + 1] = max(new[j - low + 1], best[j - low] + self.idf[t.words[i]])
                    new[j - low + 1] = max(new[j - low + 1], new[j - low])
                best = new
            return best[-1]

        a, b = start + t.key.start, start + t.key.stop
        low, high = max(0, start - DRIFT), min(len(words), start + len(t.words) + DRIFT)
        return sum(self.idf[t.words[i]] for i in t.key) + side(range(t.key.start), low, a) + side(range(t.key.stop, len(t.words)), b, high)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, str, float]]]:
        """Exact phrases as (place, label), longer templates as (place, label, share of their weight found)."""
        lookups = self.looked_up(self.vocabulary.intersection(words))
        if not lookups:
            return [], []
        places: dict[bytes, list[int]] = {self.templates[k].words[i]: [] for k, at in lookups.items() for i in at}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        exact, longer = [], {}
        for k, looked in sorted(lookups.items()):
            t = self.templates[k]
            rare = min(t.key, key=lambda i: len(places[t.words[i]]))
            starts = {p - i for i in (rare,) for p in places[t.words[i]]}
            for i in t.key:
                if i != rare and starts:
                    starts.intersection_update(p - i for p in places[t.words[i]])
            if t.exact:
                exact.extend((s, t.label) for s in starts)
                continue
            for s in starts:
                lost = 0.0
                for i in looked.difference(t.key):
                    at = places[t.words[i]]
                    n = bisect.bisect_left(at, s + i - DRIFT)
                    lost += self.idf[t.words[i]] * (n == len(at) or at[n] > s + i + DRIFT)
                if self.weight[k] - lost < SHARE * self.weight[k]:
                    continue
                share = min(1.0, self.aligned(t, words, s) / self.weight[k])
                at = (max(s, 0), t.label)
                if share >= SHARE and share > longer.get(at, 0.0):
                    longer[at] = share
        return exact, [(p, label, share) for (p, label), share in longer.items()]


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases: dict[str, str] = PHRASES, longer: dict[str, tuple[str, str]] = TEMPLATES, notices: list[tuple[str, str, str]] = NOTICES
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches
    (label, first word, share of weight).

    n_base counts every place of an exact phrase; first_word and last_word are its smallest and largest starts, null
    without any. The score is the best match's share of weight (an exact phrase: 1), 0 without one. Null and empty texts have
    no words; null and repeated ids give a row each, as given. An empty table gives no rows."""
    spark = docs.sparkSession
    table = prepared(docs, id_col, text_col, binary=True)
    found = templates(phrases, [(label, *rest) for label, rest in longer.items()] + list(notices))
    vocabulary = frozenset(w for t in found for w in t.words)
    df = table.select("tm_text").mapInArrow(frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {bytes(r.word): r.n for r in df.collect()}  # one row for each word of the templates
    total = n.get(b"", 0)
    shared = spark.sparkContext.broadcast(Index(found, {w: math.log((total + 1) / (n.get(w, 0) + 1)) + 1e-9 for w in vocabulary}))
    schema = "tm_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,share:double>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                cols: list[list] = [[] for _ in range(8)]
                for text in some.column(1).to_pylist():
                    words = words_of(text)
                    exact, more = index.scan(words)
                    places = [p for p, _ in exact]
                    base = {label for _, label in exact}
                    hits = sorted([(p, label, 1.0) for p, label in exact] + more)
                    for c, v in zip(cols, (len(words), len(exact), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[1] for x in more})), max([x[2] for x in hits], default=0.0), [{"label": label, "first_word": p, "share": s} for p, label, s in hits]), strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["tm_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    out = table.mapInArrow(scan, schema)
    return out.select(given_id().alias("doc_id"), *out.columns[1:])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("matches")

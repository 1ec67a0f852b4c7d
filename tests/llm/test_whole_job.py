"""Cases in which an operator once did less than its whole job."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, licenses, lm_scoring, quality, shingle_dedup, simhash


def brute_near(table, n=5):
    """The ids that stay: least of each component of pairs within three bits or at a Jaccard similarity of 0.8; and the pairs that only Jaccard finds."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in table}
    sets = {i: {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set() for i, w in words.items()}
    prints = {i: int.from_bytes(simhash.simhash(t.encode(), n), "big") for i, t in table}
    ids, label, only = sorted(sets), {i: i for i in sets}, 0

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for b in ids:
        for a in ids[: ids.index(b)]:
            close = (prints[a] ^ prints[b]).bit_count() <= 3
            alike = sets[a] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])
            only += bool(alike and not close)
            if close or alike:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) == i}, only


def near_table():
    """Copies of several distances about 0.8, chains, a large group and texts that share much but not enough."""
    rng = np.random.default_rng(3)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 10**6, k)]
    out = []
    for length in (6, 30, 120, 400):
        for _ in range(8):
            last = word(length)
            out.append(last)
            for _ in range(4):
                last = list(last)
                for p in rng.integers(0, length, max(1, int(length * rng.choice([0.005, 0.015, 0.02, 0.025, 0.03])))):
                    last[p] = f"x{rng.integers(0, 10**6)}"
                out.append(last)
    hot = word(100)
    for _ in range(60):
        copy = list(hot)
        copy[int(rng.integers(0, 100))] = f"y{rng.integers(0, 10**6)}"
        out.append(copy)
    shared = word(60)
    out += [shared + word(20) for _ in range(40)]
    return [(k, " ".join(w)) for k, w in enumerate(out)] + [(10_000, ""), (10_001, " \n")]


def test_near_copies_at_jaccard_of_four_fifths(spark, monkeypatch):
    table = near_table()
    want, only = brute_near(table)
    assert only > 100
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for chunk in (256, 8):  # whole buckets, and buckets dealt in blocks
        monkeypatch.setattr(shingle_dedup, "CHUNK", chunk)
        assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == want


def test_stems_do_not_depend_on_tasks(spark):
    """An ordinary word that stands once in each text is no stem, however the labelled rows are dealt; copies count once, in whichever task they are."""
    toxic = [(k, f"vilest ordinary t{k}", 1) for k in range(12)]
    clean = [(100 + k, f"plain ordinary c{k}", 0) for k in range(100)]
    copies = [(300 + k, "copied text of one author", 1) for k in range(12)]
    rows = toxic + clean + copies
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = [quality.mined(df.select("doc_id", "text").repartition(n), df.select("doc_id", "toxic"), "doc_id", "text", 8000) for n in (1, len(rows))]
    assert found[0] == found[1] == {"vilest$", "viles"}


def test_short_notice_and_real_header_of_apache(spark):
    """Among documents that hold no other licence words, and with words between those of the template."""
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'
    texts = ["Some page. Licensed under the Apache License, Version 2.0.", header, "the apache license of the tribe", "Apache helicopters are under the bridge"]
    df = spark.createDataFrame([*enumerate(texts), *((10 + k, "the page of a plain text under the sun") for k in range(200))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(df).collect()}
    assert [got[k] for k in range(4)] == ["apache", "apache", "", ""] and not any(got[10 + k] for k in range(200))
    full = spark.createDataFrame([(1, header)], "doc_id long, text string")
    longer = {"apache": licenses.TEMPLATES["apache"]}
    assert 0.99 < licenses.license_scan(full, longer=longer, notices=[]).first().score <= 1


def test_workers_get_small_batches_of_texts(spark):
    """The pipeline ran out of an executor's memory: 10,000 texts at once were held several times over by each task."""
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1600).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes]), "rows": pa.array([b.num_rows])})

    got = common.prepared(docs).mapInArrow(sizes, "n long, rows long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.n for r in got) < 2 * common.BATCH_BYTES


def test_words_of_a_batch_are_those_of_bytes_split():
    """Splitting a word at a time made op6 exceed its CPU seconds; Arrow's split must part texts at the same places."""
    texts = ["Foo  bar\x85\x1f \u00c9\u0130", "  lead", "", "\t\x0b ", "trail \n", "one", " ", "a\x1cb\xa0c\u2003d", "x" * 5000, "\x00 \x0c\r y"]
    raw = pa.array([t.encode() for t in texts], pa.binary())
    for part in (raw, raw.slice(2), raw.slice(3, 1), raw.slice(4, 2)):
        words, sizes = lm_scoring.tokens(part)
        want = [t.as_py().lower().split() for t in part]
        assert sizes.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == sum(want, [])


@pytest.mark.parametrize(("n", "top"), [(0, 9), (1, 64), (5000, 3), (5000, 46), (5000, 63), (1 << 17, 64), (1 << 17, 20)])
def test_order_of_keys_is_the_stable_one(n, top):
    """Also where keys and places do not fit in 64 bits together, and keys that differ in their last bits alone."""
    keys = np.random.default_rng(n + top).integers(0, 1 << top, n, dtype=np.uint64) if top < 64 else np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
    keys[: n // 2] = (keys[: n // 2] & np.uint64(15)) | (keys[:1] & ~np.uint64(15))
    assert (lm_scoring.ordered(keys) == np.argsort(keys, kind="stable")).all()

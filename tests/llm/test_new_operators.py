"""Collocations, clustering and online packing against brute force, and their cases at the edge."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import clustering, collocations, online_packing, packing

DOCS = "doc_id long, text string, lang string, tm_text string, tm_id string, shard string"


def brute_collocations(rows, least, cover, top, longest=4):
    """Straight from the definition, in Python's whole numbers."""
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {(g, p): c for (g, p), c in f.items() if len(p) > 1 and c >= least}
    for (g, p), a in found.items():
        longer = [c for (h, q), c in found.items() if h == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * c >= cover * a for c in longer):
            continue
        score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out.append((g, " ".join(p), a, l, r, n[g], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    made = set()
    for row in out:
        rank[row[0]] += 1
        if rank[row[0]] <= top:
            made.add((row[0], rank[row[0]], *row[1:]))
    return made


def collocated(df, **how):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **how).collect()}


@pytest.mark.parametrize("shard_rows", [100, 500_000])  # crowded leading words of up to three words, or none
def test_collocations_match_brute_force(spark, shard_rows):
    rng = random.Random(5)
    words = ["the", "of", "Déjà", "\x00odd", "x\x1fy", "La", "zebra", "un", "\U0001f600"]
    texts = [" ".join(rng.choices(words, [9, 7, 3, 1, 1, 2, 1, 2, 1], k=rng.randrange(0, 60))) for _ in range(80)]
    texts = [re.sub(" ", lambda m: rng.choice([" ", " ", " ", "\t", ", ", "\n", " ... "]), t) for t in texts]
    rows = [(i, t, rng.choice(["en", "und", None, ""]), "x", "y", "z") for i, t in enumerate(texts)]
    rows += rows[:9] + [(None, None, "en", "", "", ""), (5, "", None, "", "", ""), (6, "of the " * 900, "fr", "", "", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for top in (7, 2000):
        assert collocated(df, least=4, top=top, shard_rows=shard_rows) == brute_collocations([(r[1], r[2]) for r in rows], 4, 80, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    empty = spark.createDataFrame([(1, None, None, "", "", ""), (2, " \t.,", "en", "", "", "")], DOCS)
    assert collocations.collocations(empty).count() == 0


def test_products_of_scores_pass_64_bits(spark):
    """The score of counts beyond 2**53, by the expression that the operator uses."""
    a, l, r = 9_000_000_000_000_007, 9_000_000_000_000_011, 9_100_000_000_000_003
    df = spark.createDataFrame([(a, l, r)], "f long, l long, r long")
    from pyspark.sql import functions as F

    made = df.select(F.expr(f"cast(cast({collocations.SCORE} as decimal(19,0)) * cast(f as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")).first()[0]
    assert made == 2_000_000 * a // (l + r)


def test_multikey_quicksort_counts_what_sorting_counts():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, k, 3000) for k in (3, 5, 4, 6)]
    weights = rng.integers(1, 4, 3000)
    want = Counter()
    for *row, w in zip(*keys, weights, strict=True):
        for k in range(1, 5):
            if 0 not in row[1:k]:
                want[tuple(int(x) for x in row[:k])] += int(w)
    got = {tuple(int(keys[j][at[0]]) for j in range(k)): n for k, at, n in collocations.multikey(keys, weights, 40)}
    assert got == {p: n for p, n in want.items() if n >= 40}


def test_threshold_walk_finds_the_nearest(spark):
    """Ties, equal centroids, values beyond all centroids, blocks of one row."""
    rng = np.random.default_rng(1)
    for k, d in ((1, 3), (2, 1), (8, 64), (40, 5)):
        c = rng.integers(-3, 4, (k, d))
        c[k // 2] = c[0]
        x = rng.integers(-6, 7, (200, d))
        away = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        label, best = clustering.nearest(x.astype(np.int64), c.astype(np.int64))
        assert (best == away.min(axis=1)).all() and (label == away.argmin(axis=1)).all()


VECTORS = "vec_id long, embedding array<float>, tm_id string, cluster string, tm_v string, tm_cluster string"


def test_clustering_at_the_edge(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(i % 3), -0.3, 0.7] for i in range(20)]
    rows = [(i, v, "", "", "", "") for i, v in enumerate(good)] + [(5, good[5], "", "", "", ""), (None, good[1], "", "", "", "")]
    bad = [(50, None, "", "", "", ""), (51, [1.0, 2.0], "", "", "", ""), (52, [1.0, nan, 0.0], "", "", "", ""), (53, [1.0, inf, 0.0], "", "", "", ""), (54, [1.0, None, 0.0], "", "", "", ""), (55, [], "", "", "", "")]
    df = spark.createDataFrame(rows + bad, VECTORS)
    found, centroids = clustering.cluster_vectors(df, dimensions=3, clusters=3)
    got = found.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert len(centroids) == 3 and sum(r.distance for r in got) == got[0].inertia
    few, centroids = clustering.cluster_vectors(df.where("vec_id in (1, 2)"), dimensions=3)
    assert len(centroids) == 2 and {r.distance for r in few.collect()} == {0}
    none, centroids = clustering.cluster_vectors(df.where("vec_id >= 50"), dimensions=3)
    assert none.count() == 0 and centroids == []
    assert clustering.cluster_vectors(spark.createDataFrame([], VECTORS))[0].count() == 0
    wide = clustering.clustered(df.where("vec_id <> 5"), dimensions=3, clusters=3)
    assert wide.columns == [*df.columns, "tm_cluster_", "tm_distance"] and wide.where("tm_cluster_ is null").count() == 0
    with pytest.raises(Exception, match="no exact distance"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [3e5, 0.0, 0.0], "", "", "", "")], VECTORS), dimensions=3)[0].count()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ODD_TEXTS = ["", " ", "\n\n  x", "it's  we'll 'S", "naïve café Ünïcode", "日本語 テキスト", "a b c", "tabs\t\tand\r\nbreaks \n", "12,345.67 %$#@!  ", "x\x1cy\x00z", "<|endoftext|> as text", "é İ", "\x85 \x0b\x0c", "ÿ×÷À ß", "'t'lls 'd 've", "a" * 5000]


def test_parts_are_the_tokenizers(tokenizer):
    parts = online_packing.Parts(packing.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    letters = " \n\t'abcst.,!?01é×" + "\r\x0b"
    texts = ODD_TEXTS + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(parts.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("partitions", "windows", "fan_in"), [(1, 16, 64), (7, 2, 2), (5, 1, 3)])
def test_online_packing_loses_nothing_and_pads_nothing(spark, tokenizer, monkeypatch, partitions, windows, fan_in):
    """Merges over several levels; every id once, gapless sequences within the capacity."""
    monkeypatch.setattr(online_packing, "FAN_IN", fan_in)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "Gamma", "δ", "12"], k=rng.choice([0, 1, 5, 40, 300]))), "en", "", "", "") for i in range(60)]
    rows += [(100 + i, t, None, "", "", "") for i, t in enumerate(ODD_TEXTS)] + [(7, "again", "", "", "", ""), (None, None, "", "", "", ""), (None, "x " * 3000, "", "", "", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(partitions)
    got = online_packing.pack_online(df, packing.tokenizer_path("byte_bpe_50k.json"), capacity=256, windows=windows, keep_ids=True).collect()
    want = Counter(tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows if r[0] not in (7, None))
    ids = {}
    for r in sorted(got, key=lambda r: r.start):
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        if r.doc_id not in (7, None):
            assert r.start == len(ids.get(r.doc_id, []))
            ids.setdefault(r.doc_id, []).extend(own)
            assert len(ids[r.doc_id]) <= r.doc_tokens
    assert Counter(map(tuple, ids.values())) == want
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in got) == total and sum(r.doc_tokens for r in got if r.start == 0) == total
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= 256 and online_packing.padding(n, 256) == 0 for n in filled.values())


def test_online_packing_of_nothing(spark):
    assert online_packing.pack_online(spark.createDataFrame([], DOCS), packing.tokenizer_path("byte_bpe_50k.json")).count() == 0

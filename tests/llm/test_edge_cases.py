"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, licenses, line_dedup, lm_scoring, mixing, order_minhash, packing, quality, simhash, suffix_dedup

LINE = "This shared line is certainly longer than forty characters, yes."
LONG = "Lorem ipsum dolor sit amet " * 30_000
PASSAGE = "An identical passage of well over fifty bytes, which repeats in several documents."
TEXTS = [
    (1, "alpha  beta\tgamma"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, " \n "), (6, f"{LINE}\nown six\n{PASSAGE}"), (7, f"  {LINE.upper()} \nown seven {PASSAGE}"), (8, f"{LINE}\n{LINE}\nown eight"), (9, f"x\n{LINE}"),
    (10, f"{LINE}\t\nlast {PASSAGE} end"), (11, "ünïcödé wörds — ñandú " * 3 + PASSAGE), (12, LONG), (13, "word"), (14, "CC BY 4.0, all rights reserved; GNU general public-license cc by"), (None, "no id here"), (15, PASSAGE + PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that operators use."""
    rows = [(i, t, ["b", "a", None][k % 3], k, f"x{k}", float(k)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, kept string, sequence_id double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_empty_tables(empty):
    for made in (exact_dedup.exact_dedup(empty), line_dedup.line_dedup(empty), mixing.mix_sources(empty), simhash.simhash_groups(empty), order_minhash.order_minhash(empty), licenses.license_scan(empty), suffix_dedup.suffix_dedup(empty), lm_scoring.lm_scores(empty), packing.pack(empty, packing.tokenizer_path()), quality.quality_scores(empty)):
        assert made.count() == 0


def test_exact_dedup(docs):
    for some in (docs, docs.unionByName(docs)):
        got = exact_dedup.exact_dedup(some).collect()
        assert len(got) == some.count()
        want = defaultdict(list)
        for r in some.collect():
            want[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
        by = {sha(t.encode()): ids for t, ids in want.items()}
        for r in got:
            ids = by[r.text_sha256]
            least = min((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size) == (least, len(ids))
        for ids in by.values():
            assert sum(r.kept for r in got if by[r.text_sha256] is ids) == 1


def test_bloom_keeps_all_repeats_when_full(docs):
    """A filter far too small lets more rows pass, but loses none."""
    got = rows(exact_dedup.exact_dedup(docs, max_bits=exact_dedup.SEGMENT_BITS))
    assert got[2].keep_id == 1 and got[4].keep_id == 3 and got[5].keep_id == 5


def brute_lines(table, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in table:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(2**63 if i is None else i)
    out = {}
    for i, t in table:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("round_bytes", [1 << 25, 1])
def test_line_dedup(docs, round_bytes, monkeypatch):
    """Whether the index goes out at once or in rounds."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 1)
    got = line_dedup.line_dedup(docs, round_bytes=round_bytes, min_docs=3)
    assert got.columns == [*docs.columns, "tm_n_lines", "tm_n_dropped"]
    assert {i: (r.tm_n_lines, r.tm_n_dropped, r.text) for i, r in rows(got).items()} == brute_lines(TEXTS, 3)
    assert rows(got)[8]["kept"] == "x7"


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    made = line_dedup.PerfectHash(keys)
    assert sorted(made.place(keys)) == list(range(len(keys)))


@pytest.mark.parametrize("table", [TEXTS, [(i, t) for i, t in TEXTS if i in (1, 6, 13)]])
def test_mixing(spark, table):
    sources = {i: ["b", "a", None][k % 3] for k, (i, _) in enumerate(TEXTS)}
    df = spark.createDataFrame([(i, t, sources[i]) for i, t in table], "doc_id long, text string, source string")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in table}
    total = Counter()
    for i in size:
        total[sources[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        for s in over or free:
            target[s] = float(3 * total[s]) if over else share[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    first, again = rows(mixing.mix_sources(df)), rows(mixing.mix_sources(df.repartition(5)))
    for i, r in first.items():
        s = sources[i]
        assert (r.tm_size, r.tm_source_size) == (size[i], total[s]) and math.isclose(r.tm_target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.tm_taken <= 3 * size[i] and r.tm_taken == again[i].tm_taken
    for s in order:
        assert sum(r.tm_taken for i, r in first.items() if sources[i] == s) == round(target[s])


def test_mixing_runs_no_python(spark, docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_simhash(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    got = rows(simhash.simhash_groups(docs))
    prints = {i: brute_simhash(t if i != 12 else "Lorem ipsum dolor sit amet " * 300) for i, t in TEXTS}
    for i, p in prints.items():
        if i != 12:
            assert got[i].fingerprint == f"{p:016x}"
    groups = {i: min((j for j in prints if j is not None and bin(prints[i] ^ prints[j]).count("1") <= 3), default=i) for i in prints if i != 12}
    assert {i: got[i].component_id for i in groups} == groups
    assert got[3].component_id == got[4].component_id == got[5].component_id == 3


def test_simhash_links_chains(spark):
    """All links of up to three bits are found, chains are followed, and dense groups give no more links than members."""
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    for p in list(prints):
        for _ in range(6):
            p ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
            prints.append(p)
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)]
    prints = sorted(set(prints))
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "tm_print long")
    links = df.mapInArrow(simhash.variants, "tm_variant long, tm_print long").repartition(3, "tm_variant").sortWithinPartitions("tm_variant").mapInArrow(simhash.verified(3), "tm_u long, tm_v long")
    assert links.count() < 4 * len(prints)
    found = {r.tm_u: r.tm_root for r in simhash.components(links).collect()}
    label = lambda p: found.get(p, p)
    got, want = defaultdict(set), defaultdict(set)
    for i, p in enumerate(a.view(np.int64).tolist()):
        got[label(p)].add(p)
        want[root(i)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_packing(docs):
    got = packing.pack(docs, packing.tokenizer_path(), capacity=256).collect()
    tokenizer = packing.Words(packing.tokenizer_path()).tokenizer
    want = {}
    for i, t in TEXTS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 256):
            want[i, k // 256] = (k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 256


def test_plan_is_tight_and_whole():
    rng = np.random.default_rng(2)
    for capacity in (10, 100, 4096):
        counts = Counter(rng.integers(1, capacity + 1, 5000).tolist())
        runs, n_seq = packing.planned(dict(counts), capacity)
        fill = Counter()
        for length, n in counts.items():
            mine = runs[runs[:, 0] == length]
            assert mine[:, 2].sum() == n
        for length, _, n, seq, _, each in runs.tolist():
            for j in range(n):
                fill[seq + j // each] += length
        assert max(fill.values()) <= capacity and len(fill) == n_seq
        assert n_seq <= 1.1 * sum(k * v for k, v in counts.items()) / capacity + sum(3 * k > 2 * capacity for k in counts.elements()) / 3 + 2


def test_tokens_equal_the_tokenizers():
    words = packing.Words(packing.tokenizer_path())
    rng = np.random.default_rng(1)
    for alphabet in ("aB'st 1.,-_!é ßÄ\n\t\x1c\x85\xa0ΣİŁ日ﬁ²½ªµ́e$<|endoftext|>", "aB'st 1.,-_!é ßÄ\n\t\x0b\x0crevmld$<|>/\\9Z"):
        for _ in range(300):
            t = "".join(rng.choice(list(alphabet), int(rng.integers(0, 30))))
            assert np.frombuffer(next(words.ids([t])), "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def brute_spans(table):
    seen, out = {}, {}
    for i, t in sorted(table, key=lambda r: 2**63 if r[0] is None else r[0]):
        b = (t or "").encode()
        gone, own = np.zeros(len(b), bool), []
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if seen.get(w, i) != i:
                gone[p : p + 50] = True
            own.append(w)
        for w in own:
            seen.setdefault(w, i)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_suffix_dedup(docs, spark):
    table = [(i, t) for i, t in TEXTS if i != 12] + [(20, "a" * 120), (21, "b" + "a" * 90 + "c"), (22, "xyz" * 40), (23, "yzx" * 40)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in rows(suffix_dedup.suffix_dedup(df)).items()}
    assert got == brute_spans(table)


def test_suffix_dedup_of_long_texts_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    long = bytes(rng.integers(97, 123, suffix_dedup.CHUNK_BYTES + 5000, dtype=np.uint8)).decode()
    cut = suffix_dedup.CHUNK_BYTES
    df = spark.createDataFrame([(1, long), (2, long[cut - 300 : cut + 300]), (3, "Q" + long[10:100]), (3, "Z" + long[5:80]), (3, "Z" + long[5:80])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df).collect())
    assert got == [(1, len(long), 0, 0), (2, 600, 600, 1), (3, 76, 75, 1), (3, 76, 75, 1), (3, 91, 90, 1)]


@pytest.mark.parametrize("hot", [1, 1 << 13])
def test_suffix_dedup_of_one_passage_in_all_documents(spark, monkeypatch, hot):
    """A passage with other text around it in each document, and several ranges, runs and passes of the first digit."""
    monkeypatch.setattr(suffix_dedup, "RANGE_PAIRS", 40)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 40)
    rng = np.random.default_rng(6)
    own = lambda n: bytes(rng.integers(97, 100, n, dtype=np.uint8)).decode()
    table = [(k - 20, own(int(rng.integers(0, 90))) + (PASSAGE[: int(rng.integers(45, len(PASSAGE)))] if k % 3 else PASSAGE) + own(int(rng.integers(0, 300)))) for k in range(80)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = suffix_dedup.suffix_dedup(df, fan_out=4096 if hot > 1 else 1, hot=hot)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in rows(got).items()} == brute_spans(table)


@pytest.mark.parametrize("broadcast", [True, False])
def test_suffix_dedup_sets_copies_aside(spark, monkeypatch, broadcast):
    """Whole copies take no part in the search; ids that repeat, null ids, short texts and near copies do."""
    counted, written = {}, suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: counted.setdefault(name, written(df, name)))
    if not broadcast:
        monkeypatch.setattr(suffix_dedup, "joined", lambda big, side, on, how, _: big.join(side.hint("merge"), on, how))
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, 200, dtype=np.uint8)).decode() for _ in range(5)] + ["short", "", PASSAGE[:60]]
    table = [(100 * k + i, t) for k in range(12) for i, t in enumerate(texts)] + [(5000, texts[0][:120] + "!" + texts[1][60:])]
    got = rows(suffix_dedup.suffix_dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(4)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == brute_spans(table)
    assert counted["suffix-copies"].count() == 6 * 11
    assert counted["suffix-keys"].select("tm_id").distinct().count() == 3  # the two originals and their near copy
    table = [(7, texts[0]), (7, texts[1]), (3, texts[1]), (None, texts[2]), (None, texts[2]), (9, texts[2]), (None, texts[3]), (None, texts[3]), (8, texts[0]), (8, texts[0])]
    counted.clear()
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.n_spans) for r in got) == sorted([(7, 0, 0), (7, 200, 1), (3, 0, 0), (-1, 200, 1), (-1, 200, 1), (9, 0, 0), (-1, 0, 0), (-1, 0, 0), (8, 200, 1), (8, 200, 1)])


def test_suffix_dedup_packets_are_cheap(monkeypatch):
    """Packets of few rows add little to them and travel together; many rows of a range are compared by parts."""
    rng = np.random.default_rng(9)
    n = 3000
    doc, place = rng.integers(0, 40, n), rng.integers(0, 1000, n)
    around = rng.integers(97, 99, (n, suffix_dedup.AROUND)).astype(np.uint8)
    around[:, suffix_dedup.REACH :] = around[rng.integers(0, 300, n), suffix_dedup.REACH :]
    starts, sure = rng.integers(1, 1 << 31, n).astype(np.uint32), rng.random(n) < 0.3
    batches = list(suffix_dedup.dealt_rows(np.arange(n) % 1000, doc, place.astype(np.int32), place, starts, around, sure=sure))
    assert len(batches) == 1 and batches[0].num_rows == 1000
    assert sum(len(suffix_dedup.UNPACK.decompress(x)) for x in batches[0].column(1).to_pylist()) < 1000 * 216 + n * 110
    back = [np.concatenate(x) for x in zip(*(suffix_dedup.unpacked(x, 9) for x in batches[0].column(1).to_pylist()), strict=True)]
    assert len(back[0]) == (~sure).sum() and sorted(zip(back[5], back[7], back[8], strict=True)) == sorted(zip(doc[sure], place[sure], starts[sure], strict=True))
    whole = suffix_dedup.repeated(doc, starts, around)
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", 100)
    assert whole.any() and (suffix_dedup.repeated_by_part(doc, starts, around) == whole).all()


def test_order_minhash(docs):
    table = sorted(TEXTS, key=lambda r: 2**63 if r[0] is None else r[0])
    got = rows(order_minhash.order_minhash(docs, buckets=3))
    for (i, t), (_, nxt) in zip(table, [*table[1:], table[0]], strict=True):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited.encode()))
        a, b, c = map(order_minhash.fingerprint, (t, edited, nxt))
        assert r.near_edited == order_minhash.likeness(a, b) and r.near_next == order_minhash.likeness(a, c)
        assert r.fingerprint == a.astype("<u4").tobytes().hex()


def brute_sketch(t):
    """Every selection by itself, with plain integers."""
    m = lambda v: v % 2**64

    def mix(v):
        v = m((v ^ (v >> 30)) * int(order_minhash.B))
        v = m((v ^ (v >> 27)) * int(order_minhash.C))
        return v ^ (v >> 31)

    a = int(order_minhash.A)
    w = [int.from_bytes(xxhash.xxh64_digest(x.encode()), "little") for x in re.findall(r"[^\x20\x09-\x0D]{1,24}", t)]
    grams = [m(x * a + y) for x, y in zip(w, w[1:])] if len(w) > 1 else w
    seen, ranked = Counter(), []
    for g in grams:
        ranked.append(mix(m(g + seen[g] * a)) >> 32)
        seen[g] += 1
    out = []
    for f, b in zip(order_minhash.FACTORS[:, 0].tolist(), order_minhash.ADDED[:, 0].tolist(), strict=True):
        picked = sorted(sorted(range(len(grams)), key=lambda i: ((ranked[i] * f + b) % 2**32, i))[:2])
        h = 0
        for i in picked:
            h = mix(m(h * a + grams[i]))
        out.append(max(h >> 32, 1) if picked else 0)
    return out


def test_order_minhash_against_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [t or "" for _, t in TEXTS if t != LONG] + [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (2, 3, 20, 300)]
    for block in (4096, 7):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        for t in texts:
            assert order_minhash.fingerprint(t).tolist() == brute_sketch(t)


@pytest.mark.parametrize("n", [20, 40, 60, 100, 200, 1000])
def test_swapped_halves_are_told(n):
    w = [f"w{k}" for k in range(n)]
    like = order_minhash.likeness(order_minhash.fingerprint(" ".join(w)), order_minhash.fingerprint(" ".join(w[n // 2 :] + w[: n // 2])))
    assert 0.5 < like < 0.8


def test_order_minhash_splits_a_repeated_id(spark):
    """An id of most rows fills several buckets; each row is still followed by the next one."""
    df = spark.createDataFrame([(5, f"text number {k}") for k in range(60)] + [(k, f"own {k}") for k in (1, 9)], "doc_id long, text string").repartition(3)
    dealt = order_minhash.with_next(common.prepared(df), 8)
    assert dealt.where("tm_id = 5").select("tm_bucket").distinct().count() > 3
    got = order_minhash.order_minhash(df, buckets=8)
    assert got.count() == 62 and got.where("doc_id = 9").count() == 1
    prints = {order_minhash.fingerprint(r.text).astype("<u4").tobytes().hex() for r in df.collect()}
    assert {r.fingerprint for r in got.collect()} == prints


def test_order_minhash_knows_order():
    a = [f"w{k}" for k in range(400)]
    moved = a[200:] + a[:200]
    changed = a[:395] + ["new"] * 5
    like = lambda x, y: order_minhash.likeness(order_minhash.fingerprint(" ".join(x)), order_minhash.fingerprint(" ".join(y)))
    assert like(a, a) == 1 and like(a, changed) > 0.8 > like(a, moved) and like(a, [f"v{k}" for k in range(400)]) < 0.05


def test_licenses(docs):
    got = rows(licenses.license_scan(docs))
    for i, t in TEXTS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
        places = [(k, v) for p, v in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({v for _, v in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[14].score == 1 and got[13].score == 0


def test_license_templates_need_the_key_phrase(spark):
    df = spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (2, "permission was granted free of charge to any person obtaining a copy of this software")], "doc_id long, text string")
    got = rows(licenses.license_scan(df))
    assert got[1].labels == "mit" and got[2].labels == ""


def brute_labels(texts):
    """By trying every start of every template: (label, best share) of each text."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t)) for t in texts]
    held = Counter(w for x in words for w in set(x))
    idf = lambda w: math.log((len(texts) + 1) / (held[w] + 1)) + 1e-9
    out = []
    for x in words:
        mine = {}
        for label, sentence, key in [*((k, *v) for k, v in licenses.TEMPLATES.items()), *licenses.NOTICES]:
            t, k = sentence.split(), key.split()
            at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for s in range(-at, len(x)):
                if x[s + at : s + at + len(k)] != k or s + at < 0:
                    continue

                @functools.cache
                def best(i, j, stop, s=s, t=t, x=x):
                    """Of the template's words from i on and the text's from j on, both before a stop."""
                    if i >= stop[0] or j >= stop[1]:
                        return 0.0
                    pick = idf(t[i]) + best(i + 1, j + 1, stop) if t[i] == x[j] and abs(j - s - i) <= licenses.DRIFT else 0.0
                    return max(pick, best(i + 1, j, stop), best(i, j + 1, stop))

                found = sum(map(idf, k)) + best(0, max(0, s - 4), (at, s + at)) + best(at + len(k), s + at + len(k), (len(t), min(len(x), s + len(t) + 4)))
                share = found / sum(map(idf, t))
                if share >= licenses.SHARE:
                    mine[label] = max(mine.get(label, 0), share)
        out.append(mine)
    return out


def test_license_labels_against_brute_force(spark):
    rng = np.random.default_rng(11)
    sentences = [v[0].split() for v in licenses.TEMPLATES.values()] + [n[1].split() for n in licenses.NOTICES]
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "# SPDX-License-Identifier: MIT", "the MIT license office", "", "the of to"]
    for _ in range(150):
        words = []
        for k in rng.integers(0, len(sentences), int(rng.integers(0, 4))):
            w = [x for x in sentences[k] if rng.random() > 0.15]
            for p in sorted(rng.integers(0, len(w) + 1, int(rng.integers(0, 4)))):
                w.insert(p, "filler")
            words += ["plain", "text", *w]
        texts.append(" ".join(words))
    want = brute_labels(texts)
    base = [{v for p, v in licenses.PHRASES.items() if f" {p} " in " " + re.sub(r"[^a-z0-9]+", " ", t.lower()).strip() + " "} for t in texts]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert sum(map(bool, want)) > 40
    for i, (mine, b) in enumerate(zip(want, base, strict=True)):
        assert got[i].labels == ",".join(sorted({*mine, *b})) and math.isclose(got[i].score, max([*mine.values(), *(1.0 for _ in b)], default=0), rel_tol=1e-6)
    assert [got[k].labels for k in range(8)] == ["mit", "apache", "cc-by,cc-by-nc", "gpl", "mit", "", "", ""]


def test_every_license_line_of_the_documents_is_labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "GNU General Public License, version 3.": "gpl"}
    got = licenses.license_scan(docs).join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").rlike("(?i)licen")).collect()
    assert len(got) > 10
    for r in got:
        assert {v for k, v in lines.items() if k in r.text} <= set(r.labels.split(","))


def test_lm_scores(docs):
    got = rows(lm_scoring.lm_scores(docs))
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")), None] for i, t in TEXTS}
    name = lambda i: 2**63 - 1 if i is None else i
    out = {i: zlib.crc32(str(name(i)).encode()) % 5 == 1 for i, _ in TEXTS}
    c = Counter(w for i, x in toks.items() if not out[i] for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (out[i], len(x), n, sum(c[w] > 0 for w in x))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9)
    assert got[12].score > got[12].base_score


def brute_tree(table, least=2, depth=3, divergence=0.01, discount=0.75):
    """Scores by id, whether each trains, and the distribution after every state (None: any unknown word)."""
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")), ""] for i, t in table}
    train = [x for i, x in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    count = [None, *(Counter(tuple(x[j : j + k]) for x in train for j in range(len(x) - k + 1)) for k in range(1, depth + 2))]
    norm = sum(count[1].values()) + 0.5 * (len(count[1]) + 1)
    p0 = lambda w: (count[1][w,] + 0.5) / norm
    stored, other = {}, {}
    examined = {c for c, n in count[1].items() if n >= least and c != ("",)}
    for k in range(1, depth + 1):
        after = defaultdict(dict)
        for g, n in count[k + 1].items():
            if n >= least and g[:-1] in examined:
                after[g[:-1]][g[-1]] = n
        for c, n in after.items():
            total = count[k][c]
            p = {w: (n[w] - discount) / total for w in n}
            q = {w: p0(w) if k == 1 else stored[c[1:]][w] for w in n}
            rest = max(1 - sum(p.values()), 1e-12) / max(1 - sum(q.values()), 1e-12)
            gain = sum(n[w] * math.log(p[w] / q[w]) for w in n) + (total - sum(n.values())) * math.log(rest)
            stored[c] = p
            if gain > 0.5 * (len(n) + 1) * math.log(total + 1) and gain > divergence * total:
                other[c] = rest
        examined = {g for g, n in count[k + 1].items() if n >= least and g[:-1] in examined and g[1:] in other and g[-1]}

    def p_after(context, w):
        """In the longest state; states are followed from the shortest on."""
        p = p0(w)
        for k in range(1, depth + 1):
            c = tuple(context[-k:])
            if len(c) < k or c not in other:
                break
            p = stored[c].get(w, p * other[c])
        return p

    scores = {i: sum(math.log10(p_after(x[:j], w)) for j, w in enumerate(x)) for i, x in toks.items()}
    return scores, other, {c: sum(p_after(c, w) for w in [*(g[0] for g in count[1]), None]) for c in other}


@pytest.mark.parametrize("chunk_tokens", [60, 1 << 19])
def test_suffix_tree_against_brute_force(spark, monkeypatch, chunk_tokens):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 200)
    rng = np.random.default_rng(8)
    phrases = [[f"w{x}" for x in rng.integers(0, 60, int(rng.integers(2, 9)))] for _ in range(40)]
    table = [(i, " ".join(w for k in rng.integers(0, 40, int(rng.integers(0, 30))) for w in [*phrases[k], f"w{rng.integers(0, 60)}"])) for i in range(120)]
    table += [(200, None), (201, ""), (202, table[5][1]), (203, table[5][1].upper()), (204, "unheard of")]
    want, states, sums = brute_tree(table)
    assert max(map(len, states)) > 2 and all(math.isclose(v, 1, abs_tol=1e-9) for v in sums.values())
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = {i: r.score for i, r in rows(lm_scoring.lm_scores(df, chunk_tokens=chunk_tokens)).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)


def test_held_out_gain_grows_with_the_corpus(spark):
    """More text retains more contexts, so texts that are not learned from are told better."""

    def gain(docs):
        r = lm_scoring.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        return (r[0] - r[1]) / r[2]

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert gain(docs) > gain(docs.where("doc_id % 4 = 1")) > 0


def test_quality(docs, spark):
    got = quality.quality_scores(docs)
    assert got.columns == [*docs.columns, "tm_votes", "tm_posterior", "tm_score", "tm_kept"]
    kept = rows(got)
    assert all(kept[i].tm_kept and kept[i].tm_score == 0 for i in (3, 4, 5))


def test_em_finds_accuracies():
    """Planted classes and labellers: the posterior finds the class, the accuracies their order."""
    rng = np.random.default_rng(0)
    seen, truth = Counter(), defaultdict(Counter)
    for _ in range(20_000):
        fault = rng.random() < 0.2
        kind = int(rng.integers(0, 5))
        said = "".join("r" if rng.random() < (0.9 if fault and quality.LABELLERS[j] in quality.FAULTS[kind] else 0.0005 * (j + 1)) else "-" for j in range(7))
        seen[said] += 1
        truth[said][fault] += 1
    posterior, right = quality.em(dict(seen))
    wrong = sum(min(truth[p][(post < 0.5)], 10**9) for p, post in posterior.items())
    assert wrong / 20_000 < 0.05 and min(right.values()) > 0.8


def test_quality_held_out_accuracy(spark):
    """Labels of other documents are kept out of the stems that are mined."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    r = out.agg(F.avg(F.when(bad, (~F.col("tm_kept")).cast("int"))).alias("caught"), F.avg(F.when(~bad, F.col("tm_kept").cast("int"))).alias("left")).first()
    assert r.caught > 0.75 and r.left > 0.97


def test_columns_that_are_called_like_ours(docs):
    """They pass through, or make way where the result itself has the name."""
    clash = docs.withColumnsRenamed({"n": "tm_id", "kept": "tm_hash", "sequence_id": "tm_gone"}).withColumn("tm_n_lines", F.lit("old")).withColumn("tm_score", F.lit("old"))
    for round_bytes in (1 << 25, 1):
        got = rows(line_dedup.line_dedup(clash, min_docs=3, round_bytes=round_bytes))
        assert {i: (r.tm_n_lines, r.tm_n_dropped, r.text) for i, r in got.items()} == brute_lines(TEXTS, 3)
        assert got[8].tm_id == 7 and got[8].tm_hash == "x7" and got[8].tm_score == "old"
    assert all(isinstance(r.tm_score, float) and r.tm_hash for r in quality.quality_scores(clash).collect())


def test_one_repeated_id_does_not_fill_the_sample(spark):
    """The sample is drawn by text, so rows that share an id are not drawn together, and copies count once."""
    df = spark.createDataFrame([(3, f"plain words number {k} of a text" if k % 2 else "the same text again and again") for k in range(400)], "doc_id long, text string")
    got = quality.quality_scores(df, train_docs=20).collect()
    assert len(got) == 400 and all(r.tm_kept for r in got)

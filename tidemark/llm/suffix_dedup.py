"""Suffix-array dedup by depth-limited radix sort.

A byte is removed when a window of ``WINDOW`` bytes over it also starts in a document with a smaller id. All
suffixes need ordering through WINDOW bytes only, and those that can share a window with another document are few, so
the most significant digit comes first and drops the rest:

0. A text that a smaller document has too, told by SHA-256, is gone whole and takes no part in the rest: all its windows start there.
1. First digit: of every window the KEY-byte string with the least hash (any two equal windows choose the same).
   Each task ships its distinct (hash, document) pairs in sorted runs, dealt by range of the hash; a range keeps the
   hashes of two documents or more and tells each document which of its strings those are.
2. Next digits: at these strings documents cut out the bytes that their windows reach. Suffixes to the right and
   reversed prefixes to the left are radix sorted, eight bytes a digit, most significant first, and only groups that
   are not yet single go on to the next digit. Adjacent lengths of agreement then give, for each start of a window, groups that
   are equal through all its bytes: exactly the repeated windows. No hash decides equality of windows.
3. Spans are merged by document and cut out.

Ordering all suffixes outright would ship 12 bytes or more for each byte of text; the first digit ships about six for each
16. A range holds about RANGE_PAIRS pairs at any corpus size, as their number follows the text's measured bytes, and
a task works on one range after another. Beyond ``fan_out`` ranges the digit itself is dealt in two passes. Each run of a task sends a packet
to every range, so packets grow with the square of the ranges: surroundings are dealt to few wide ones, which their task cuts into parts by string. Strings of
more than ``hot`` documents are dealt by the bytes of each of their windows instead, and equal windows are settled
before they are sent, so no string gathers in one range. Texts are dealt by document once, and both joins read that
exchange; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, given_id, joined, prepared, written

WINDOW, KEY = 50, 20
#: Starts of windows that hold a given string: from REACH bytes before it to the string itself.
REACH = WINDOW - KEY
STARTS = REACH + 1
AROUND = REACH + WINDOW
#: Text hashed at once; longer texts go in parts, so memory does not grow with them.
CHUNK_BYTES = 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
KEY_BITS = 40
#: Marks a key, of which 32 bits are kept, as hot.
HOT = 1 << 32
#: Pairs that a task holds before it ships a sorted run, and about as many as a range gets; surroundings weigh ten times as much.
RUN_PAIRS, RANGE_PAIRS = 1 << 20, 1 << 19
RUN_ROWS, HOT_ROWS, RANGE_ROWS = 1 << 16, 1 << 12, 1 << 18
#: Surroundings that are compared at once; up to so many ranges hold no more than that each, so small corpora keep all cores busy.
PART_ROWS, FEW_RANGES = 1 << 16, 256
#: Of arrays in packets. Packets are many and may be small, so they have no more than their kinds and shapes before the data.
KINDS = [np.dtype(x) for x in ("u1", "<i4", "<u4", "<i8", "<u8")]
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([(KINDS.index(a.dtype), len(a), a.shape[1] if a.ndim > 1 else 0) for a in arrays], np.int64)
    return PACK.compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    data, at, out = UNPACK.decompress(raw), 24 * n, []
    for kind, rows, width in np.frombuffer(data, np.int64, 3 * n).reshape(n, 3).tolist():
        a = np.frombuffer(data, KINDS[kind], rows * (width or 1), at)
        at += a.nbytes
        out.append(a.reshape(rows, width) if width else a)
    return out


def batch_of(shards: list[int], packets: list[bytes], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(packets, pa.binary())], names=["shard", name])


def narrow(sorted_values: np.ndarray) -> np.ndarray:
    """First differences in the fewest bytes; np.cumsum gives the values back."""
    d = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    return d.astype(np.uint32) if not len(d) or d.max() < 1 << 32 else d


def sliding(a: np.ndarray, width: int, of) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours."""
    done, out = 1, a
    while 2 * done <= width:
        out = of(out[:-done], out[done:])
        done *= 2
    return of(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


class Chunk:
    """Texts, or parts of one, end to end, and the hash of the string at each place that some window within a text chooses."""

    def __init__(self, rows: list[int], offsets: list[int], texts: list[bytes]):
        self.rows, self.offsets, self.data = np.array(rows), np.array(offsets), np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        n = len(self.data)
        inside = np.zeros(n - WINDOW + 1, bool)  # windows that lie within one text
        for a, b in zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True):
            inside[a : max(a, b - WINDOW + 1)] = True
        h, width = self.data.astype(np.uint64) + np.uint64(1), 1
        parts = {1: h}  # hashes of strings of 1, 2, 4, ... bytes, and of KEY bytes from these
        power = lambda k: np.uint64(pow(int(ODD), k, 2**64))
        while 2 * width <= KEY:
            h = h[:-width] * power(width) + h[width:]
            width *= 2
            parts[width] = h
        while width < KEY:
            step = max(k for k in parts if k <= KEY - width)
            m = n - width - step + 1
            h = h[:m] * power(step) + parts[step][width : width + m]
            width += step
        h = (h ^ (h >> np.uint64(29))) * MIX
        self.hash = h ^ (h >> np.uint64(32))
        least = sliding(self.hash, STARTS, np.minimum)
        self.least = np.where(inside, least, 0)  # 0: no window
        pad = np.zeros(REACH, np.uint64)
        chosen = sliding(np.concatenate([pad, self.least, pad]), STARTS, np.maximum)
        self.at = np.flatnonzero((chosen == self.hash) & (self.hash > 0))
        self.row_of = np.searchsorted(self.ends, self.at, "right")

    def starts(self, at: np.ndarray) -> np.ndarray:
        """Bit o of each: the window that starts o bytes before the string chooses it."""
        out = np.zeros(len(at), np.uint32)
        padded = np.concatenate([np.zeros(REACH, np.uint64), self.least, np.zeros(REACH + 1, np.uint64)])
        for o in range(STARTS):
            out |= (padded[at - o + REACH] == self.hash[at]).astype(np.uint32) << np.uint32(o)
        return out

    def around(self, at: np.ndarray) -> np.ndarray:
        padded = np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(WINDOW, np.uint8)])
        return padded[at[:, None] + np.arange(AROUND)]


def chunks(batch: pa.RecordBatch, column: int, wanted=None) -> Iterator[Chunk]:
    """Parts of a long text overlap by all but one byte of a window: each window lies in just one part."""
    rows, offsets, texts, size = [], [], [], 0
    column_ = batch.column(column)
    for r in range(batch.num_rows):
        if wanted is not None and wanted[r] is None:
            continue
        text = column_[r].as_buffer()
        for a in range(0, max(1, len(text) - WINDOW + 1), CHUNK_BYTES):
            part = text[a : a + CHUNK_BYTES + WINDOW - 1].to_pybytes() if len(text) else b""
            if len(part) < WINDOW:
                continue
            rows.append(r)
            offsets.append(a)
            texts.append(part)
            size += len(part)
            if size >= CHUNK_BYTES:
                yield Chunk(rows, offsets, texts)
                rows, offsets, texts, size = [], [], [], 0
    if rows:
        yield Chunk(rows, offsets, texts)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The packed rows of each shard; rows come sorted by shard, and a shard may go on in the next batch."""
    held, rows = None, []
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != held and rows:
                yield held, rows
                rows = []
            held = k
            rows.append(raw.as_py())
    if rows:
        yield held, rows


def in_order(packed_rows: DataFrame, shards: int) -> DataFrame:
    return packed_rows.repartition(shards, "shard").sortWithinPartitions("shard")


def run_of(key: np.ndarray, doc: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Distinct pairs, sorted and packed by range of the key, of which there are ``ranges``."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    key, doc = key[new], doc[new]
    of = (key * np.uint64(ranges)) >> np.uint64(KEY_BITS)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(key))
    packets = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        d = doc[a:b]
        packets.append(packed(narrow(key[a:b]), d if d.max() >> 31 or d.min() < 0 else d.astype(np.int32)))
    yield batch_of(of[cuts[:-1]].tolist(), packets, "pairs")


def first_digits(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for c in chunks(batch, 1):
                keys.append(c.hash[c.at] >> np.uint64(64 - KEY_BITS))
                docs.append(ids[c.rows[c.row_of]])
                held += len(c.at)
                if held > RUN_PAIRS:
                    yield from run_of(np.concatenate(keys), np.concatenate(docs), ranges)
                    keys, docs, held = [], [], 0
        if held:
            yield from run_of(np.concatenate(keys), np.concatenate(docs), ranges)

    return run


def pairs_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, d = unpacked(raw, 2)
    return np.cumsum(k.astype(np.uint64), dtype=np.uint64), d.astype(np.int64)


def dealt_again(ranges: int):
    """The second pass of the first digit: the runs of a wide range are merged and cut into their narrow ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in one_by_one(batches):
            found, held = [], 0
            for raw in rows:
                found.append(pairs_of(raw))
                held += len(found[-1][0])
                if held > RUN_PAIRS:
                    yield from run_of(*(np.concatenate(x) for x in zip(*found, strict=True)), ranges)
                    found, held = [], 0
            if found:
                yield from run_of(*(np.concatenate(x) for x in zip(*found, strict=True)), ranges)

    return run


def shared_digits(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(document, key) of the keys that two documents have, keys of many documents marked."""
        for _, rows in one_by_one(batches):
            key, doc = (np.concatenate(x) for x in zip(*map(pairs_of, rows), strict=True))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            several = doc[starts] != doc[starts + sizes - 1]  # sorted by document: the first differs from the last
            mine, many = np.repeat(several, sizes), np.repeat(sizes > hot, sizes)
            doc, key = doc[mine], (key[mine] & np.uint64(HOT - 1)).astype(np.int64) + HOT * many[mine]
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(doc[k : k + 100_000]), pa.array(key[k : k + 100_000])], names=["tm_id", "tm_key"])

    return run


def extremes(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the highest and the lowest bit that is set; exact, as doubles hold 32 bits."""
    bits = starts.astype(np.int64)
    return np.log2(np.maximum(bits, 1)).astype(np.int64), np.log2(np.maximum(bits & -bits, 1)).astype(np.int64)


def settled(key: np.ndarray, doc: np.ndarray, starts: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a smaller document of the run has the same surroundings, so that the row's windows are repeated for sure;
    the surroundings that the windows cover; a hash of these."""
    far, near = extremes(starts)
    reached = np.arange(AROUND)
    around = around * ((reached >= (REACH - far)[:, None]) & (reached < (REACH - near + WINDOW)[:, None]))
    view = np.ascontiguousarray(np.c_[around, starts.astype(np.uint64).view(np.uint8).reshape(-1, 8)]).view(np.uint64)
    order = np.lexsort((doc, *view.T, key))
    same = np.concatenate([[False], (key[order[1:]] == key[order[:-1]]) & (view[order[1:]] == view[order[:-1]]).all(axis=1)])
    first = np.flatnonzero(~same)
    sure = np.zeros(len(key), bool)
    sure[order] = doc[order] > np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
    mixed = np.zeros(len(view), np.uint64)
    for column in view.T:
        mixed = (mixed ^ column) * ODD
        mixed ^= mixed >> np.uint64(29)
    return sure, around, mixed


def dealt_rows(to: np.ndarray, *columns: np.ndarray, sure: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Columns packed by shard; of ``sure`` rows (document, variant, place, starts) alone, after those of the open ones."""
    if not len(to):
        return
    by = np.argsort(to, kind="stable") if sure is None else np.lexsort((sure, to))
    to, columns = to[by], [c[by] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    open_rows = np.diff(cuts) if sure is None else np.add.reduceat(~sure[by], cuts[:-1], dtype=np.int64)
    packets = []
    for a, m, b in zip(cuts[:-1].tolist(), (cuts[:-1] + open_rows).tolist(), cuts[1:].tolist(), strict=True):
        packets.append(packed(*(c[a:m] for c in columns), *([] if sure is None else (c[m:b] for c in columns[:4]))))
    yield batch_of(to[cuts[:-1]].tolist(), packets, "rows")


def surroundings(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        held = 0

        def ship() -> Iterator[pa.RecordBatch]:
            nonlocal held
            key, doc, variant, place, starts, around, hot = (np.concatenate(x) for x in got)
            for x in got:
                x.clear()
            held = 0
            sure, around, _ = settled(key, doc, starts, around)
            now = sure | ~hot
            to = np.where(sure, doc % shards, (key >> np.uint64(32)).astype(np.int64) % shards)
            yield from dealt_rows(to[now], *(c[now] for c in (doc, variant, place, starts, around)), sure=sure[now])
            left = np.flatnonzero(~now)
            for k in range(0, len(left), HOT_ROWS):  # each window of a hot string by itself
                at = left[k : k + HOT_ROWS]
                row, o = np.nonzero(starts[at, None] >> np.arange(STARTS, dtype=np.uint32) & np.uint32(1))
                row, one = at[row], np.uint32(1) << o.astype(np.uint32)
                sure, whole, mixed = settled(key[row], doc[row], one, around[row])
                to = np.where(sure, doc[row] % shards, (mixed >> np.uint64(32)).astype(np.int64) % shards)
                yield from dealt_rows(to, doc[row], variant[row], place[row], one, whole, sure=sure)

        for batch in batches:
            ids, variants, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [x.values.to_numpy() if x.is_valid else None for x in batch.column(3)]
            for c in chunks(batch, 2, wanted):
                short = (c.hash[c.at] >> np.uint64(64 - KEY_BITS)).astype(np.int64) & (HOT - 1)
                hit, hot = np.zeros(len(c.at), bool), np.zeros(len(c.at), bool)
                edges = np.searchsorted(c.row_of, np.arange(len(c.rows) + 1))
                for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    asked = wanted[c.rows[r]]
                    many = asked >= HOT
                    hit[a:b] = np.isin(short[a:b], asked & (HOT - 1))
                    if many.any():
                        hot[a:b] = np.isin(short[a:b], asked[many] - HOT)
                at, r = c.at[hit], c.row_of[hit]
                begin = np.concatenate([[0], c.ends[:-1]])[r] - c.offsets[r]
                for to, a in zip(got, (c.hash[at], ids[c.rows[r]], variants[c.rows[r]], at - begin, c.starts(at), c.around(at), hot[hit]), strict=True):
                    to.append(a)
                held += len(at)
                if held > RUN_ROWS:
                    yield from ship()
        if held:
            yield from ship()

    return run


def radix(groups: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by group, then by digits: most significant digit first, single rows drop out."""
    place = np.searchsorted(np.sort(groups), groups)  # first place of the row's group
    left = np.arange(len(groups))
    for digit in digits:
        left = left[np.bincount(place[left], minlength=len(groups))[place[left]] > 1]
        if not len(left):
            break
        s = left[np.lexsort((digit[left], place[left]))]
        new_group = np.concatenate([[True], place[s[1:]] != place[s[:-1]]])
        new_digit = new_group | np.concatenate([[True], digit[s[1:]] != digit[s[:-1]]])
        i = np.arange(len(s))
        place[s] = place[s] + np.maximum.accumulate(np.where(new_digit, i, 0)) - np.maximum.accumulate(np.where(new_group, i, 0))
    return np.argsort(place, kind="stable")


def agreement(order: np.ndarray, groups: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Bytes in which each row agrees with the one before it in the order; -1 at the start of a group."""
    out = np.full(len(order), -1, np.int64)
    for k in range(1, len(order), 1 << 16):
        a, b = order[k - 1 : k - 1 + (1 << 16)], order[k : k + (1 << 16)]
        a = a[: len(b)]
        differ = text[a] != text[b]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
        out[k : k + len(b)] = np.where(groups[a] == groups[b], n, -1)
    return out


def eights(text: np.ndarray) -> list[np.ndarray]:
    width = -(-text.shape[1] // 8) * 8
    padded = np.zeros((len(text), width), np.uint8)
    padded[:, : text.shape[1]] = text
    return list(padded.view(">u8").astype(np.uint64).T)


def repeated(doc: np.ndarray, starts: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of the windows in ``starts``, those whose bytes a smaller document has too."""
    n = len(doc)
    right, left = around[:, REACH:], np.ascontiguousarray(around[:, :REACH][:, ::-1])
    by_right = radix(np.zeros(n, np.int64), eights(right))
    right_same = agreement(by_right, np.zeros(n, np.int64), right)
    string = np.empty(n, np.int64)
    string[by_right] = np.cumsum(right_same < KEY)  # rows with the same KEY bytes
    by_left = radix(string, eights(left))
    left_same = agreement(by_left, string, left)
    out = np.zeros(n, np.uint32)
    cls_r, cls_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(STARTS):
        at = np.flatnonzero(starts >> np.uint32(o) & np.uint32(1))
        if not len(at):
            continue
        cls_r[by_right], cls_l[by_left] = np.cumsum(right_same < WINDOW - o), np.cumsum(left_same < o)
        both = cls_r[at] * (n + 1) + cls_l[at]
        order = np.argsort(both)
        first = np.flatnonzero(np.concatenate([[True], both[order[1:]] != both[order[:-1]]]))
        d = doc[at[order]]
        hit = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
        out[at[order[hit]]] |= np.uint32(1 << o)
    return out


def repeated_by_part(doc: np.ndarray, starts: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The same for many rows: those of one string are in one part."""
    mixed = np.zeros(len(doc), np.uint64)
    for column in np.ascontiguousarray(around[:, REACH : REACH + KEY]).view(np.uint32).T:
        mixed = (mixed ^ column) * ODD
        mixed ^= mixed >> np.uint64(29)
    part = mixed % np.uint64(len(doc) // PART_ROWS + 1)
    by = np.argsort(part, kind="stable")
    out = np.zeros(len(doc), np.uint32)
    for at in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
        if len(at):
            out[at] = repeated(doc[at], starts[at], around[at])
    return out


def spans(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that share a string overlap, so they cover one span."""
        for _, rows in one_by_one(batches):
            doc, variant, place, starts, around, *settled = (np.concatenate(x) for x in zip(*(unpacked(p, 9) for p in rows), strict=True))
            hit = repeated_by_part(doc, starts, around)
            doc, variant, place, hit = (np.concatenate([a, b]) for a, b in zip((doc, variant, place, hit), settled, strict=True))
            doc, variant, place, hit = (a[hit > 0] for a in (doc, variant, place, hit))
            far, near = extremes(hit)
            begin, end = place - far, place - near + WINDOW
            yield from dealt_rows(doc % shards, doc, variant, begin.astype(np.int64), end.astype(np.int64))

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal spans of each document."""
    for _, rows in one_by_one(batches):
        doc, variant, begin, end = (np.concatenate(x) for x in zip(*(unpacked(p, 4) for p in rows), strict=True))
        order = np.lexsort((begin, variant, doc))
        doc, variant, begin, end = doc[order], variant[order], begin[order], end[order]
        nth = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])])).astype(np.int64)
        span = int(end.max()) + 2
        reach = np.maximum.accumulate(nth * span + end)
        first = np.flatnonzero(np.concatenate([[True], nth[1:] * span + begin[1:] > reach[:-1]]))
        last = np.append(first[1:], len(doc)) - 1
        b, e = begin[first], reach[last] - nth[last] * span
        doc, variant = doc[first], variant[first]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for k in range(0, len(cut), 10_000):
            c = cut[k : k + 10_000]
            stop = cut[k + 10_000] if k + 10_000 < len(cut) else len(doc)
            at = pa.array(np.append(c, stop) - c[0], pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x[c[0] : stop])) for x in (variant, b, e)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[c]), *lists], names=["tm_id", "tm_of", "tm_begin", "tm_end"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
        _, variants, texts, of, begins, ends = (c.to_pylist() for c in batch.columns)
        left, removed, n_spans = [], [], []
        for v, text, o, b, e in zip(variants, texts, of, begins, ends, strict=True):
            mine = [(x, y) for w, x, y in zip(o, b, e, strict=True) if w == v] if b else []
            if mine:
                left.append(b"".join(text[x:y] for x, y in zip([0, *(y for _, y in mine)], [*(x for x, _ in mine), len(text)], strict=True)))
            else:
                left.append(text)
            removed.append(sum(y - x for x, y in mine))
            n_spans.append(len(mine))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(left, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())],
            names=["tm_id", "kept", "n_bytes", "n_removed", "n_spans"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fan_out: int = 4096, hot: int = 1 << 13) -> DataFrame:
    """One row per document: doc_id, kept (the bytes that are left; a cut may part a character), n_bytes, n_removed, n_spans.

    Null and empty texts, and those shorter than a window, lose nothing. A null id counts as the largest; rows that repeat an
    id are not smaller than each other, so none takes from the other. An empty table gives no rows."""
    table = prepared(docs, id_col, text_col, binary=True).withColumn("tm_sum", F.unhex(F.sha2("tm_text", 256)))
    sums = written(table.select("tm_id", "tm_sum", F.octet_length("tm_text").cast("long").alias("tm_bytes")), "suffix-sums")
    again = sums.groupBy("tm_id").count().where("count > 1")
    repeats = again.limit(1).count() > 0
    first = written(sums.where(F.col("tm_bytes") >= WINDOW).groupBy("tm_sum").agg(F.min("tm_id").alias("tm_first"), F.max("tm_id").alias("tm_last")).where("tm_first < tm_last").drop("tm_last"), "suffix-first")
    copies = written(joined(sums, first, "tm_sum", "inner", F.lit(128)).where("tm_id > tm_first").select(*sums.columns), "suffix-copies")
    key = ["tm_id", "tm_sum"] if repeats else ["tm_id"]
    table = joined(table, copies.select(*key), key, "left_anti", F.lit(128 if repeats else 24))
    if repeats:  # texts of one id are told apart
        variants = table.join(again.select("tm_id"), "tm_id", "left_semi").select("tm_id", F.xxhash64("tm_text").alias("tm_hash")).distinct()
        variants = variants.withColumn("tm_variant", F.row_number().over(Window.partitionBy("tm_id").orderBy("tm_hash")))
        table = table.withColumn("tm_hash", F.xxhash64("tm_text")).join(variants, ["tm_id", "tm_hash"], "left").select("tm_id", F.coalesce("tm_variant", F.lit(0)).alias("tm_variant"), "tm_text")
    else:
        table = table.select("tm_id", F.lit(0).alias("tm_variant"), "tm_text")

    n_bytes = sum((x.agg(F.sum("tm_bytes")).first()[0] or 0) * sign for x, sign in ((sums, 1), (copies, -1)))
    ranges = n_bytes // 16 // RANGE_PAIRS + 1  # a window chooses a string of its own at about every 16th byte
    texts = table.select("tm_id", "tm_text")
    if ranges <= fan_out:
        pairs = texts.mapInArrow(first_digits(ranges), "shard int, pairs binary")
    else:
        wide = int(ranges**0.5) + 1
        pairs = in_order(texts.mapInArrow(first_digits(wide), "shard int, pairs binary"), wide).mapInArrow(dealt_again(ranges), "shard int, pairs binary")
    shared = written(in_order(pairs, ranges).mapInArrow(shared_digits(hot), "tm_id long, tm_key long"), "suffix-keys")
    wanted = shared.groupBy("tm_id").agg(F.collect_list("tm_key").alias("tm_keys"))

    n = shared.count()
    shards = max(n // RANGE_ROWS, min(n // PART_ROWS, FEW_RANGES)) + 1
    dealt = table.repartition("tm_id")  # texts travel once: both joins read this exchange
    asked = dealt.join(wanted, "tm_id").select("tm_id", "tm_variant", "tm_text", "tm_keys")
    rows = asked.mapInArrow(surroundings(shards), "shard int, rows binary")
    found = in_order(rows, shards).mapInArrow(spans(shards), "shard int, rows binary")
    gone = in_order(found, shards).mapInArrow(merged, "tm_id long, tm_of array<int>, tm_begin array<long>, tm_end array<long>")
    out = dealt.join(gone, "tm_id", "left").select("tm_id", "tm_variant", "tm_text", "tm_of", "tm_begin", "tm_end")
    out = out.mapInArrow(cut_out, "tm_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    whole = copies.select("tm_id", F.lit(b"").alias("kept"), F.col("tm_bytes").alias("n_bytes"), F.col("tm_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))
    out = out.unionAll(whole)
    return out.select(given_id().alias("doc_id"), *out.columns[1:])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

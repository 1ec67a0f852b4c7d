"""Bounded-space online packing: a task keeps a few open windows and never looks back at those it has closed.

A document is laid best-fit: into the open window with the smallest gap that holds it, or a new one while fewer are open than
allowed. When none fits, the fullest window is emitted. As documents may be cut anywhere, its gap first takes the head of the
document and the rest is laid on its own, so an emitted window is full; one filled to a power of two costs no padding
and is emitted as it is. What is open when a task ends goes on, with its token ids, to a merge of 64 tasks' leftovers by the same
rules, and so on until one task merges the last; there the last window is cut into powers of two, whole sequences all.

Each level is written once, so a task that is run again repeats its own windows alone, and a merge holds at most
64 tasks' windows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, given_id, prepared, written
from .packing import tokenizer_path

CAPACITY, END_ID, WINDOWS = 1024, 0, 16
#: Tasks whose leftovers one task merges.
FAN_IN = 64
#: Parts of words remembered by a task.
CACHED = 600_000
#: How the tokenizer parts texts without ODD characters.
PART = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
#: Anything but ASCII's white space and printable characters and the plain Latin letters: whether it is a letter or a space is the tokenizer's to say.
ODD = re.compile(r"[^\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]")

FIELDS = [("tm_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tm_ids", pa.binary()), ("tm_task", pa.int64())]
SCHEMA = "tm_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tm_ids binary, tm_task long"
#: (id, start, ids, tokens of the document)
Piece = tuple[int, int, bytes, int]


def padding(length: int, capacity: int = CAPACITY) -> int:
    """Tokens added to a sequence: up to the capacity, none at a power of two."""
    return 0 if length & (length - 1) == 0 else capacity - length


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class Parts:
    """Token ids as little-endian bytes. Texts of plain characters are parted here as the tokenizer parts them, and each part is
    learned once for all texts; others go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for part in new:
            self.known[part] = np.array([t.id for t in tokenize("".join(map(letters.__getitem__, part.encode())))], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = PART.findall(text)
        new = set(parts).difference(self.known)
        if new:
            if len(self.known) > CACHED:
                self.known.clear()
                new = set(parts)
            self.learn(new)
        return b"".join(map(self.known.__getitem__, parts))


LOADED: dict[str, Parts] = {}


class Packer:
    """The open windows of one task. ``put`` lays a piece; full windows go to ``emit`` as lists of pieces."""

    def __init__(self, capacity: int, windows: int, emit: Callable[[list[Piece]], None]):
        self.capacity, self.windows, self.emit = capacity, windows, emit
        self.open: list[tuple[int, list[Piece]]] = []  # (tokens, pieces), the emptiest first

    def _lay(self, at: int | None, piece: Piece) -> None:
        """Into an open window or, at None, a new one."""
        n, pieces = self.open.pop(at) if at is not None else (0, [])
        n += len(piece[2]) // 4
        pieces.append(piece)
        if n == self.capacity:
            self.emit(pieces)
            return
        k = len(self.open)
        while k and self.open[k - 1][0] > n:
            k -= 1
        self.open.insert(k, (n, pieces))

    def put(self, piece: Piece) -> None:
        doc, start, ids, whole = piece
        while len(ids) >= 4 * self.capacity:  # a sequence of its own
            self.emit([(doc, start, ids[: 4 * self.capacity], whole)])
            start, ids = start + self.capacity, ids[4 * self.capacity :]
        while n := len(ids) // 4:
            # the fullest of those that hold it has the smallest gap
            best = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] + n <= self.capacity), None)
            if best is not None or len(self.open) < self.windows:
                self._lay(best, (doc, start, ids, whole))
                return
            filled, pieces = self.open[-1]
            if padding(filled, self.capacity) == 0:
                self.open.pop()
                self.emit(pieces)
                continue
            gap = self.capacity - filled
            self._lay(len(self.open) - 1, (doc, start, ids[: 4 * gap], whole))  # full now
            start, ids = start + gap, ids[4 * gap :]

    def close(self) -> None:
        """Merges what is open: the emptiest window's pieces fill the others; the last is cut into powers of two."""
        rest, self.open, self.windows = self.open, [], 1
        for _, pieces in reversed(rest):
            for piece in pieces:
                self.put(piece)
        for n, pieces in self.open:
            left = list(reversed(pieces))
            for power in (1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1):
                made, room = [], power
                while room:
                    doc, start, ids, whole = left.pop()
                    made.append((doc, start, ids[: 4 * room], whole))
                    if len(ids) > 4 * room:
                        left.append((doc, start + room, ids[4 * room :], whole))
                    room -= len(made[-1][2]) // 4
                self.emit(made)
        self.open = []


class Sink:
    """Rows of one task: pieces in sequences of its own numbers, ids only with those that go on or are asked for."""

    def __init__(self, level: int, task: int, keep_ids: bool):
        self.base, self.task, self.keep_ids, self.made, self.rows = (level << 56) + (task << 28), task, keep_ids, 0, []

    def emit(self, pieces: list[Piece], *, done: bool = True) -> None:
        offset = 0
        for doc, start, ids, whole in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids) if done else None, whole, self.base + self.made, offset, ids if self.keep_ids or not done else None, None if done else self.task))
            offset += n
        self.made += 1

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*self.rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])
            self.rows = []


def online(path: str, capacity: int, end_id: int, windows: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = LOADED.get(path) or LOADED.setdefault(path, Parts(path))
        sink = Sink(0, TaskContext.get().partitionId(), keep_ids)
        packer = Packer(capacity, windows, sink.emit)
        for batch in batches:
            for k in range(batch.num_rows):  # a text at a time: long ones are not held side by side
                ids = parts.ids(batch.column(1)[k].as_py()) + end
                packer.put((batch.column(0)[k].as_py(), 0, ids, len(ids) // 4))
                yield from sink.batches(4_000)
        for _, pieces in packer.open:
            sink.emit(pieces, done=False)
        yield from sink.batches()

    return run


def merged(level: int, capacity: int, windows: int, keep_ids: bool, last: bool):
    """Lays the leftovers of up to FAN_IN tasks, the longest pieces first."""

    def run(table: pa.Table) -> pa.Table:
        task = table.column("tm_task")[0].as_py() // FAN_IN
        names = ["tm_id", "start", "tm_ids", "doc_tokens", "tm_task"]
        rows = sorted(zip(*(table.column(n).to_pylist() for n in names), strict=True), key=lambda r: (-len(r[2]), r[4], r[0], r[1]))
        sink = Sink(level, task, keep_ids)
        packer = Packer(capacity, windows, sink.emit)
        for doc, start, ids, whole, _ in rows:
            packer.put((doc, start, ids, whole))
        if last:
            packer.close()
        for _, pieces in packer.open:
            sink.emit(pieces, done=False)
        return pa.Table.from_batches(sink.batches(), pa.schema(FIELDS))

    return run


def pack_online(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, windows: int = WINDOWS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``keep_ids`` its ids as
    little-endian unsigned 32-bit numbers in ``ids``.

    Each id of a document, the end id behind it included, lies in exactly one piece. Null and empty texts are the one end id;
    rows that repeat an id are documents of their own; ids are returned as given, null ones too; columns of any other name
    are left behind. An empty table gives no rows. No sequence is padded, whatever the documents."""
    level = written(prepared(docs, id_col, text_col).mapInArrow(online(tokenizer, capacity, end_id, windows, keep_ids), SCHEMA), "online-0")
    levels, k = [level], 1
    tasks = level.agg(F.max("tm_task")).first()[0]
    while tasks is not None:  # each level leaves a 64th of the tasks
        last = tasks < FAN_IN
        rest = levels[-1].where("tm_task is not null").groupBy(F.expr(f"tm_task div {FAN_IN}"))
        levels.append(written(rest.applyInArrow(merged(k, capacity, windows, keep_ids, last), SCHEMA), f"online-{k}"))
        tasks, k = None if last else tasks // FAN_IN, k + 1
    out = levels[0].where("tm_task is null")
    for more in levels[1:]:
        out = out.unionAll(more.where("tm_task is null"))
    ids = [F.col("tm_ids").alias("ids")] if keep_ids else []
    return out.select(given_id().alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids)


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))

"""Numbered lines of text files, and records of quoted text that may go over several lines, read by many tasks.

A task reads a byte range of a file, so it knows neither how many lines come before nor whether its first line stands within quotes.
What a line does to that is a function of two states; a range's lines together are one as well. One pass tells each range's function and
number of lines; running over the ranges in order - one row a range - gives each the state and the number it starts with, and a second pass
cuts lines into records. Only the pieces of records that go over the end of a range meet again in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import staged
from . import encoding as E

#: A quoted field of more lines is a stray quote: its lines are records of their own.
MOST_LINES = 1000
QUOTE = '"'


def lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, block (where its range starts), i (rising within a range, by one a line), value. The text reader knows UTF-8 alone; for
    others the delimited reader is told to split nothing, which drops empty lines."""
    if encoding == "utf-8":
        out = spark.read.text(path)
    else:
        out = spark.read.option("encoding", E.spark_name(encoding)).option("sep", "\x01").option("quote", "").option("escape", "").option("ignoreLeadingWhiteSpace", False).schema("value string").csv(path)
    return out.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.regexp_replace(F.coalesce("value", F.lit("")), "^﻿|\r$", "").alias("value"))


def through(line: str, inside: bool, separator: str) -> tuple[bool, bool]:
    """Whether a line ends within quotes if it starts so or not, and whether a quote is out of place: within quotes, neither doubled nor
    before a separator or the end. Quotes within a field that does not start with one are text."""
    at, n, odd = 0, len(line), False
    while True:
        if inside:
            k = line.find(QUOTE, at)
            while k >= 0:
                if line.startswith(QUOTE, k + 1):
                    k = line.find(QUOTE, k + 2)
                    continue
                if k + 1 == n or line.startswith(separator, k + 1):
                    break
                odd = True
                k = line.find(QUOTE, k + 1)
            if k < 0:
                return True, odd
            if k + 1 == n:
                return False, odd
            inside, at = False, k + 1 + len(separator)
        if line.startswith(QUOTE, at):
            inside, at = True, at + 1
            continue
        k = line.find(separator, at)
        if k < 0:
            return False, odd
        at = k + len(separator)


def _ranges(separator: str | None):
    """A row for each range: its lines, its first i, blank lines before the first other, where it leads from both states, whether a
    record ends in it when it starts within quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "first", "n", "lead", "outside", "inside", "ends", "plain"]
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.bool_()] * 4]
        now, made = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "block", "i", "quoted", "blank")]
            for file, block, i, quoted, blank in zip(*columns, strict=True):
                if (file, block) != now:
                    if made:
                        yield row()
                    now, made = (file, block), [file, block, i, 0, None, False, True, False, True]
                if made[4] is None and not blank:
                    made[4] = made[3]
                made[3] += 1
                if quoted is not None and separator is not None:
                    a, b = through(quoted, False, separator)[0], through(quoted, True, separator)[0]
                    made[8] = made[8] and not a and b
                    made[5], was = (b if made[5] else a), made[6]
                    made[6] = b if made[6] else a
                    made[7] = made[7] or (was and not made[6])
        if made:
            yield row()

    return run


def ranges(text: DataFrame, separator: str | None) -> DataFrame:
    """For each range of ``lines``: file, block, first, n (its lines), base (lines before it in its file), header (number of the file's first line that
    is not blank), within (whether it starts within quotes), owner (the range whose last record goes on into it), plain (no line of any
    range changes the state). One row a range, as many as the scan has tasks."""
    ship(text.sparkSession)
    quoted = F.when(F.col("value").contains(QUOTE), F.col("value"))
    seen = text.select("file", "block", "i", quoted.alias("quoted"), (F.trim("value") == "").alias("blank"))
    got = staged(seen.mapInArrow(_ranges(separator), "file string, block long, first long, n long, lead long, outside boolean, inside boolean, ends boolean, plain boolean"), "ranges-of-lines")
    of = Window.partitionBy("file")
    before = of.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the state: that of the last range that leads to one whatever it starts with, turned by each range since that turns it
    fixed, turns = F.col("outside") == F.col("inside"), (F.col("outside") & ~F.col("inside")).cast("int")
    got = got.withColumn("turns", F.coalesce(F.sum(turns).over(of.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    last = F.last(F.when(fixed, F.struct(F.col("outside").alias("state"), F.col("turns"))), True).over(before)
    so_far = F.coalesce(F.lag("turns").over(of.orderBy("block")), F.lit(0))
    within = F.when(last.isNull(), so_far % 2 == 1).otherwise((last["state"].cast("int") + so_far - last["turns"]) % 2 == 1)
    got = got.withColumn("within", within)
    opens = F.when(F.col("within"), F.col("inside") & F.col("ends")).otherwise(F.col("outside"))  # its last record goes on
    got = got.withColumn("owner", F.last(F.when(opens, F.col("block")), True).over(before))
    header = F.min(F.when(F.col("lead").isNotNull(), F.col("base") + F.col("lead") + 1)).over(of)
    return got.select("file", "block", "first", "n", "base", header.alias("header"), "within", "owner", F.min("plain").over(Window.partitionBy()).alias("plain"))


def numbered(text: DataFrame, at: DataFrame) -> DataFrame:
    """file, line (from 1), header, value: numbers come from the ranges' bases, nothing is sorted."""
    own = at.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", "base", "header")
    both = text.join(F.broadcast(own), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))  # a row a task of the scan
    return both.select("file", (F.col("base") + F.col("i") - F.col("first") + 1).alias("line"), "header", "value")


def _cut(separator: str):
    """Records that lie within a range, and the pieces of others: (file, header, line, record, odd, owner of a piece, lines, closed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "header", "line", "record", "odd", "owner", "lines", "closed"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
        now, inside, number, held, start, odd, piece = None, False, 0, [], 0, False, None
        rows: list[tuple] = []

        def whole() -> None:
            if piece is None and len(held) > MOST_LINES:
                rows.extend((file_, header_, start + k, line, False, None, [], True) for k, line in enumerate(held))
            else:
                rows.append((file_, header_, start, "\n".join(held), odd, piece, held if piece is not None or len(held) > 1 else [], not inside))

        file_, header_ = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "block", "base", "header", "within", "owner", "value")]
            for file, block, base, header, within, owner, value in zip(*columns, strict=True):
                if (file, block) != now:
                    if held:  # goes on in the next range
                        piece = now[1] if piece is None else piece
                        whole()
                        held = []
                    now, inside, number, file_, header_ = (file, block), within, base, file, header
                    piece, start, odd = (owner if within else None), base + 1, False
                number += 1
                if not held:
                    start, odd = number, False
                held.append(value)
                if inside or QUOTE in value:
                    inside, off = through(value, inside, separator) if QUOTE in value else (inside, False)
                    odd = odd or off
                if not inside:
                    whole()
                    held, piece = [], None
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows.clear()
        if held:
            piece = now[1] if piece is None else piece
            whole()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def quoted_records(text: DataFrame, at: DataFrame, separator: str) -> DataFrame:
    """file, line (of its first line), header, record, odd (a quote is out of place in it, or never closed), lines (those of a record of several). A quoted field of
    more than MOST_LINES lines makes no record: its lines come one by one."""
    own = at.select(F.col("file").alias("f"), F.col("block").alias("b"), "base", "header", "within", "owner")
    both = text.join(F.broadcast(own), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    cut = staged(both.select("file", "block", "base", "header", "within", "owner", "value").mapInArrow(_cut(separator), "file string, header long, line long, record string, odd boolean, owner long, lines array<string>, closed boolean"), "records")
    done = cut.where("owner is null").select("file", "line", "header", "record", "odd", "lines")
    pieces = cut.where("owner is not null")
    # a piece that starts a record is told by its number: an owner has one record that goes on
    size = pieces.groupBy("file", "owner").agg(F.sum(F.size("lines")).alias("n"))
    size = size.withColumnsRenamed({"file": "f", "owner": "o"})
    both = pieces.join(size, (F.col("file") == F.col("f")) & (F.col("owner") == F.col("o"))).drop("f", "o")
    single = both.where(F.col("n") > MOST_LINES).select("file", "header", "line", F.posexplode("lines").alias("k", "record"))
    single = single.select("file", (F.col("line") + F.col("k")).alias("line"), "header", "record", F.lit(False).alias("odd"), F.array().cast("array<string>").alias("lines"))
    joined = both.where(F.col("n") <= MOST_LINES).groupBy("file", "owner").agg(F.min("line").alias("line"), F.min("header").alias("header"), F.array_sort(F.collect_list(F.struct("line", "lines"))).alias("p"), (F.max("odd") | ~F.max("closed")).alias("odd"))
    parts = F.flatten(F.transform("p", lambda x: x["lines"]))
    joined = joined.select("file", "line", "header", F.array_join(parts, "\n").alias("record"), "odd", parts.alias("lines"))
    return done.unionByName(single).unionByName(joined)


def made_once(text: DataFrame, separator: str | None, make: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows that ``make`` derives from lines and their ranges, written. Spark may cut a file otherwise when more executors have come
    since the ranges were told: each range's lines are counted again while rows are written, and if they differ all is done anew."""
    mark = F.pmod(F.xxhash64("file", "block"), F.lit(1_000_003))
    for _ in range(3):
        at = ranges(text, separator)
        want = at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * mark), F.lit(0)).alias("m")).first()
        seen = Observation()
        out = staged(make(text.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(mark), F.lit(0)).alias("m")), at), name)
        if not want["n"] or (seen.get["n"], seen.get["m"]) == (want["n"], want["m"]):
            return out
    raise RuntimeError("the files were cut otherwise each time they were read")

"""Files to DataFrames: Spark's readers do the work, told by the first bytes of a file what they need to know.

Rows that cannot be read are counted, never silently lost: the gate raises when they are more than a share of all.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import encoding as E
from . import lines as L
from .errors import CorruptRowsError, EmptyDatasetError, ParseError, SchemaError, UnsupportedFormatError, ValidationError
from .flatten import flatten
from .naming import normalise_columns, with_normal_names

# Formats by extension, separators in order of preference, keys that hold the records, limits.
FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "excel", ".xls": "excel", ".xlsm": "excel", ".parquet": "parquet"}
SEPARATORS = [",", ";", "\t", "|", ":"]
RECORD_KEYS = ["data", "records", "items", "rows", "results"]
CORRUPT_SHARE = 0.20
MAX_COLUMNS = 500
SNIFFED_BYTES = 8192
CORRUPT = "tm_corrupt"


@dataclass(frozen=True)
class Limits:
    """None: no limit. Rows have none by default, as data need not fit anywhere."""

    file_bytes: int | None = None
    rows: int | None = None
    columns: int | None = MAX_COLUMNS


@dataclass(frozen=True)
class Parsed:
    frame: DataFrame
    format: str
    encoding: str | None = None
    separator: str | None = None
    corrupt_rows: int = 0
    corrupt: DataFrame | None = None  # the records left out, with file and line or their index in the array


def detect_format(name: str) -> str:
    found = FORMATS.get(PurePosixPath(name).suffix.lower())
    if not found:
        raise UnsupportedFormatError(f"no reader for {name}", name=name)
    return found


def sniff_separator(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(SEPARATORS)).delimiter
    except csv.Error:
        return next((s for s in SEPARATORS if s in sample), ",")


def head(spark: SparkSession, path: str, n: int = E.SAMPLE_BYTES) -> bytes:
    """First bytes of a file, through Spark, so that any store it can read will do."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(fs_path).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(fs_path) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not files:
            raise EmptyDatasetError(f"{path} holds no files", path=path)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(fs_path)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def size_of(spark: SparkSession, path: str) -> int:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength()


def gate(frame: DataFrame, corrupt: int, total: int, share: float) -> None:
    if total and corrupt / total > share:
        raise CorruptRowsError(f"{corrupt} of {total} rows cannot be read", frame=frame, corrupt=corrupt, total=total)


def first_record(spark: SparkSession, path: str, encoding: str, separator: str) -> list[str]:
    """Fields of the first record, however long."""
    n = E.SAMPLE_BYTES
    while len(raw := head(spark, path, n)) == n and b"\n" not in raw:
        n *= 4
    try:
        return next((r for r in csv.reader(io.StringIO(raw.decode(encoding, "replace").lstrip("\ufeff"), newline=""), delimiter=separator) if r), [])
    except csv.Error as e:
        raise ParseError(f"{path} has no header", path=path) from e


def whole_files(spark: SparkSession, path: str, width: int, separator: str, encoding: str) -> DataFrame:
    """Text columns c0, c1, ..., the record where it does not have ``width`` fields, its file; for encodings whose lines cannot be told from
    bytes. Each file's header is left out. A file is one task's work, and lines have no numbers."""
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField(CORRUPT, T.StringType())])
    options = {"sep": separator, "header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "encoding": E.spark_name(encoding), "columnPruning": False, "multiLine": True}
    bad = F.coalesce(CORRUPT, F.when(F.length("c0") < 0, F.col("c0")))  # Spark refuses queries on the corrupt record alone
    return spark.read.options(**options).schema(fields).csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line")).withColumn(CORRUPT, bad).where(F.col(CORRUPT).isNull() | (F.trim(CORRUPT) != ""))


def fields_of(records: DataFrame, width: int, separator: str) -> DataFrame:
    """Text columns c0, c1, ..., and the record where it does not have ``width`` fields, told with quotes and, where that fails, with
    quotes taken as text. Records of several lines that fail, or that have a quote out of place, are taken apart into their lines."""
    kinds = ", ".join([*(f"c{i} string" for i in range(width)), f"{CORRUPT} string"])
    options = {"sep": separator, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}
    told = lambda df, **more: F.from_csv("record", kinds, options | more)
    fine = lambda c: F.col(c)[CORRUPT].isNull()
    tried = records.where(F.trim("record") != "").withColumn("x", told(records))
    good = (F.size("lines") < 2) | (fine("x") & ~F.col("odd"))
    lone = tried.where(~good).select("file", "header", F.posexplode("lines").alias("k", "record"), "line").withColumn("line", F.col("line") + F.col("k")).where(F.trim("record") != "")
    lone = lone.withColumn("x", told(lone))
    both = tried.where(good).select("file", "line", "header", "record", "x").unionByName(lone.select("file", "line", "header", "record", "x"))
    both = both.where(F.col("line") != F.col("header"))
    plain = F.when(~fine("x"), told(both, quote=""))  # quotes as text
    both = both.withColumn("y", plain).withColumn("x", F.when(fine("x"), F.col("x")).when(F.col("y").isNotNull() & fine("y"), F.col("y")))
    return both.select(*(F.col("x")[f"c{i}"].alias(f"c{i}") for i in range(width)), F.when(F.col("x").isNull(), F.col("record")).alias(CORRUPT), "file", "line")


def read_csv(spark: SparkSession, path: str, *, separator: str | None = None, encoding: str | None = None, corrupt_share: float = CORRUPT_SHARE) -> Parsed:
    """Header row, inferred types. Records whose number of fields is not the header's are left out, counted and kept with their file
    and the number of their first line.

    A quoted field may hold line breaks, and files are still read by many tasks (see lines.py). A stray quote is contained: what it would
    swallow is taken apart into lines again, and a record that fails with quotes is tried with quotes as text. The rows are written once to the
    shared folder, so that what follows does not parse again."""
    raw = head(spark, path)
    if not raw:
        raise ParseError(f"{path} is empty", path=path)
    encoding = encoding or E.detect(raw)
    sample = raw[: SNIFFED_BYTES * 4].decode(encoding, "replace").lstrip("\ufeff")[:SNIFFED_BYTES]
    separator = separator or ("\t" if path.endswith(".tsv") else sniff_separator(sample))
    names = first_record(spark, path, encoding, separator)
    if not names:
        raise ParseError(f"{path} has no header", path=path)
    if encoding.startswith(("utf-16", "utf-32")):  # lines are told from bytes, so these are read as whole files
        found = whole_files(spark, path, len(names), separator, encoding)
    else:

        def told(text: DataFrame, at: DataFrame) -> DataFrame:
            first = at.select("plain").first()
            if first is None or first["plain"]:
                records = L.numbered(text, at).select("file", "line", "header", F.col("value").alias("record"), F.lit(False).alias("odd"), F.array().cast("array<string>").alias("lines"))
            else:
                records = L.quoted_records(text, at, separator)
            return fields_of(records, len(names), separator)

        found = L.made_once(L.lines(spark, path, encoding), separator, told, "csv-rows")
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count(CORRUPT).alias("bad")).first()
    good = found.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file", "line")
    bad = found.where(F.col(CORRUPT).isNotNull()).select("file", "line", F.col(CORRUPT).alias("record"))
    typed = typed_text(good).toDF(*normalise_columns(names))
    gate(typed, counts["bad"], counts["n"], corrupt_share)
    return Parsed(typed, "csv", encoding, separator, counts["bad"], bad)


def typed_text(df: DataFrame) -> DataFrame:
    """Text columns become longs, doubles or booleans where every present value is one; told in one aggregate. Empty is missing."""
    from ..functions.formats import NUMBER
    from ..functions.exprs import col, matches

    clean = df.select(*(F.when(col(c) != "", col(c)).alias(c) for c in df.columns))
    checks = []
    for i, c in enumerate(df.columns):
        v = col(c)
        checks += [F.count(v).alias(f"n{i}"), F.count_if(v.try_cast("long").isNotNull() & matches(v, r"[+-]?\d+")).alias(f"l{i}"), F.count_if(matches(v, NUMBER)).alias(f"d{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}")]
    row = clean.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        kind = "string" if not n else "long" if row[f"l{i}"] == n else "double" if row[f"d{i}"] == n else "boolean" if row[f"b{i}"] == n else "string"
        out.append(col(c).try_cast(kind).alias(c) if kind != "string" else col(c))
    return clean.select(*out)


def _only_records(df: DataFrame, path: str) -> DataFrame:
    """The root's records: a single array field, or the first of the usual names, or the first array; else the object itself."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not arrays:
        return df
    name = arrays[0] if len(arrays) == 1 else next((k for k in RECORD_KEYS if k in arrays), arrays[0])
    return df.select(F.explode(F.col(f"`{name}`")).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, *, corrupt_share: float = CORRUPT_SHARE) -> Parsed:
    """A document: an array of objects, an object that holds one, or one object. Elements that are no objects are left out
    and counted. One document is one task's work in any reader; larger data come as JSON lines."""
    raw = head(spark, path)
    if not raw.strip():
        raise ParseError(f"{path} is empty", path=path)
    encoding = E.detect(raw)
    text = spark.read.option("wholetext", True).option("encoding", E.spark_name(encoding)).text(path) if encoding == "utf-8" else spark.read.format("binaryFile").load(path).select(F.decode("content", E.spark_name(encoding)).alias("value"))
    first = raw.decode(encoding, "replace").lstrip("﻿ \t\r\n")[:1]
    if first not in "[{":
        raise SchemaError(f"{path} holds neither an array nor an object", path=path)
    if first == "[":
        elements = text.select(F.posexplode(F.from_json(F.regexp_replace("value", "^﻿", ""), "array<string>")).alias("index", "value"))
        objects = elements.where(F.ltrim("value").startswith("{"))
        counts = elements.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.ltrim(F.col("value")).startswith("{")).alias("good")).first()
        if not counts["good"]:
            raise EmptyDatasetError(f"{path} holds no objects", path=path)
        found = objects.select(F.schema_of_variant_agg(F.try_parse_json("value")).alias("s")).first()["s"].replace("OBJECT<", "STRUCT<")
        frame = objects.select(F.from_json("value", found).alias("r")).select("r.*")
        bad, total = counts["n"] - counts["good"], counts["n"]
        left = elements.where(~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False))).select("index", F.col("value").alias("record"))
    else:
        left = None
        frame, bad, total = _only_records(spark.read.option("multiLine", True).option("encoding", E.spark_name(encoding)).json(path), path), 0, 0
        if frame.columns == ["_corrupt_record"]:
            raise ParseError(f"{path} is no JSON", path=path)
    frame = with_normal_names(flatten(frame))
    gate(frame, bad, total, corrupt_share)
    return Parsed(frame, "json", encoding, corrupt_rows=bad, corrupt=left)


def read_jsonl(spark: SparkSession, path: str, *, corrupt_share: float = CORRUPT_SHARE) -> Parsed:
    """An object a line; lines that hold none are left out, counted, and kept with file and line number. Splits and scales as text does."""
    raw = head(spark, path)
    if not raw.strip():
        raise ParseError(f"{path} is empty", path=path)
    encoding = E.detect(raw)
    text = L.lines(spark, path, encoding)
    lines = text.where(F.trim("value") != "")
    good = F.trim(F.col("value")).startswith("{") & F.try_parse_json("value").isNotNull()
    counts = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good")).first()
    if not counts["good"]:
        raise EmptyDatasetError(f"{path} holds no objects", path=path)
    objects = lines.where(good)
    found = objects.select(F.schema_of_variant_agg(F.try_parse_json("value")).alias("s")).first()["s"].replace("OBJECT<", "STRUCT<")
    frame = with_normal_names(flatten(objects.select(F.from_json("value", found).alias("r")).select("r.*")))
    gate(frame, counts["n"] - counts["good"], counts["n"], corrupt_share)
    left = None
    if counts["n"] > counts["good"]:  # the only lines that need numbers
        left = L.made_once(text, None, lambda t, at: L.numbered(t, at).where((F.trim("value") != "") & ~good).select("file", "line", F.col("value").alias("record")), "corrupt-lines")
    return Parsed(frame, "jsonl", encoding, corrupt_rows=counts["n"] - counts["good"], corrupt=left)


def read_excel(spark: SparkSession, path: str) -> Parsed:
    """The first sheet with rows, from any store; columns whose cells all show dates become timestamps. A workbook is a zipped archive that one task reads; each file of a folder is a task, and the
    first by path gives the columns."""
    from .excel import DATED, ROWS, sheets

    if path.lower().endswith(".xls"):
        raise UnsupportedFormatError("old binary workbooks cannot be read; save them as .xlsx", path=path)
    ship(spark)
    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(sheets, ROWS)
    header = cells.where("place = 0").orderBy("path").select("cells").first()
    if header is None:
        raise EmptyDatasetError(f"{path} holds no rows", path=path)
    names = [(n or "").removeprefix(DATED) for n in header["cells"]]
    frame = cells.where("place > 0").select(*(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(names))))
    frame = frame.na.drop("all")
    counts = frame.agg(*(f(c).alias(f"{k}{c}") for c in frame.columns for k, f in (("n", F.count), ("d", lambda c: F.count_if(F.col(c).startswith(DATED)))))).first()
    times = [c for c in frame.columns if counts[f"d{c}"] and counts[f"d{c}"] == counts[f"n{c}"]]
    plain = frame.select(*(F.regexp_replace(c, f"^{DATED}", "").alias(c) for c in frame.columns))
    typed = typed_text(plain)
    typed = typed.select(*((F.col(c).cast("timestamp") if c in times else F.col(c)).alias(c) for c in frame.columns))
    return Parsed(typed.toDF(*normalise_columns(names)), "excel")


def read(spark: SparkSession, path: str, *, limits: Limits = Limits(), corrupt_share: float = CORRUPT_SHARE) -> Parsed:
    """Any supported file by its extension, checked against the limits."""
    kind = detect_format(path)
    if limits.file_bytes is not None and (n := size_of(spark, path)) > limits.file_bytes:
        raise ValidationError("the file is too large", reason="FILE_TOO_LARGE", bytes=n)
    if kind == "csv":
        out = read_csv(spark, path, corrupt_share=corrupt_share)
    elif kind == "json":
        out = read_json(spark, path, corrupt_share=corrupt_share)
    elif kind == "jsonl":
        out = read_jsonl(spark, path, corrupt_share=corrupt_share)
    elif kind == "excel":
        out = read_excel(spark, path)
    else:
        out = Parsed(with_normal_names(spark.read.parquet(path)), "parquet")
    validate(out.frame, limits)
    return out


def validate(df: DataFrame, limits: Limits = Limits()) -> None:
    if not df.columns or df.isEmpty():
        raise EmptyDatasetError("there are no rows")
    if limits.columns is not None and len(df.columns) > limits.columns:
        raise ValidationError("too many columns", reason="TOO_MANY_COLUMNS", columns=len(df.columns))
    if limits.rows is not None and df.limit(limits.rows + 1).count() > limits.rows:
        raise ValidationError("too many rows", reason="TOO_MANY_ROWS", limit=limits.rows)


def numbered(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """Adds the order of reading as a column, to be written with the rows: it is not stable over repeated reads."""
    return df.withColumn(name, F.monotonically_increasing_id())

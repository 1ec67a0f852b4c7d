import csv
import io
import json
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.engine import DataQuality
from tidemark.functions import formats
from tidemark.sources import encoding, errors, excel, lines, naming, readers
from tidemark.sources.sinks import DatasetStore, write_csv
from tidemark.streaming import quality


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(parsed):
    return [tuple(r) for r in parsed.frame.collect()]


def test_names():
    assert naming.normalise_columns(["a", "a", "a"]) == ["a", "a_2", "a_3"]
    assert naming.normalise_columns(["price$", "$change"]) == ["price", "change"]
    assert naming.normalise_columns([" Ünïcode Name ", "None", "9x"]) == ["unicode_name", "unnamed_1", "col_9x"]


@pytest.mark.parametrize(("raw", "want"), [(b"\xef\xbb\xbfa", "utf-8"), (b"\xff\xfea\x00", "utf-16-le"), (b"\xff\xfe\x00\x00", "utf-32-le"), ("Grüße".encode(), "utf-8"), (b"abc", "utf-8")])
def test_encodings(raw, want):
    assert encoding.detect(raw) == want


def test_formats():
    assert [readers.detect_format(x) for x in ("a.CSV", "b.tsv", "c.ndjson", "d.xlsx", "e.json", "f.parquet")] == ["csv", "csv", "jsonl", "excel", "json", "parquet"]
    with pytest.raises(errors.UnsupportedFormatError):
        readers.detect_format("x.doc")


@pytest.mark.parametrize(("text", "want"), [("a,b\n1,2\n", ","), ("a;b\n1;2\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b\n1|2\n", "|")])
def test_separators(text, want):
    assert readers.sniff_separator(text) == want


def test_csv(spark, tmp_path):
    out = readers.read(spark, put(tmp_path, "a.csv", "Id,Full Name,Score\n1,Ann,1.5\n2,,2\n"))
    assert out.frame.dtypes == [("id", "bigint"), ("full_name", "string"), ("score", "double")]
    assert rows(out) == [(1, "Ann", 1.5), (2, None, 2.0)]
    assert rows(readers.read(spark, put(tmp_path, "b.csv", "﻿a;b\nx;1\n"))) == [("x", 1)]
    assert rows(readers.read(spark, put(tmp_path, "c.tsv", "a\tb\nx\t1\n"))) == [("x", 1)]


def test_csv_latin1(spark, tmp_path):
    rows_ = "".join(f"Müller{i},Zürich\n" for i in range(40))
    out = readers.read_csv(spark, put(tmp_path, "a.csv", ("name,city\n" + rows_).encode("latin-1")), encoding="latin-1")
    assert ("Müller3", "Zürich") in rows(out) and out.frame.count() == 40


def test_csv_corrupt_rows(spark, tmp_path):
    good = "a,b,c\n" + "1,2,3\n" * 9
    out = readers.read(spark, put(tmp_path, "a.csv", good + "1,2,3,4\n"))
    assert out.corrupt_rows == 1 and out.frame.count() == 9
    with pytest.raises(errors.CorruptRowsError) as e:
        readers.read(spark, put(tmp_path, "b.csv", "a,b\n1,2,3\n4,5,6\n"))
    assert e.value.code == "CORRUPT_ROWS_EXCEEDED_THRESHOLD"
    with pytest.raises(errors.ParseError):
        readers.read(spark, put(tmp_path, "c.csv", ""))


def test_csv_breaks_and_headers(spark, tmp_path):
    out = readers.read(spark, put(tmp_path, "a.csv", 'id,note\n1,"x\ny, ""z"""\n2,w\nid,note\n3,"a,"""\n'))
    assert rows(out) == [("1", 'x\ny, "z"'), ("2", "w"), ("id", "note"), ("3", 'a,"')] and out.corrupt_rows == 0
    stray = readers.read(spark, put(tmp_path, "b.csv", 'id,note\n0,v\n1,"x\n' + "".join(f"{i},w\n" for i in range(2, 30))))
    assert stray.frame.count() == 30 and stray.corrupt_rows == 0
    names = ["x" * 6000 + f"_{i}" for i in range(20)]
    long = readers.read_csv(spark, put(tmp_path, "c.csv", ",".join(names) + "\n" + ",".join(["v"] * 20) + "\n"))
    assert long.frame.columns == names


def test_corrupt_records_are_kept(spark, tmp_path):
    out = readers.read(spark, put(tmp_path, "a.csv", "a,b\n" + "1,2\n" * 9 + "7,8,9\n"))
    assert [(r["file"].rsplit("/")[-1], r["record"]) for r in out.corrupt.collect()] == [("a.csv", "7,8,9")]
    mixed = readers.read(spark, put(tmp_path, "b.json", '[{"a": 1}, "x", {"a": 3}, null]'), corrupt_share=0.5)
    assert sorted(r["index"] for r in mixed.corrupt.collect()) == [1, 3] and mixed.corrupt_rows == 2
    lines = readers.read(spark, put(tmp_path, "c.jsonl", '{"a": 1}\n' * 9 + "[2]\n"))
    assert [r["record"] for r in lines.corrupt.collect()] == ["[2]"]


def written_csv(rng, n, stray=()):
    """Rows with quotes, breaks and separators in them, as the csv module writes them; and those rows."""
    made = [["id", "note", "more"]] + [[str(i), "".join(rng.choices(['"', "\n", ",", "a", "b ", "\u00e9", "\n\n"], k=rng.choice([0, 1, 2, 9]))), rng.choice(["", "x", "y\nz"])] for i in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(made)
    return out.getvalue(), made[1:]


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])  # bytes of a range: records lie over several ranges
def test_csv_breaks_are_split_over_many_tasks(spark, tmp_path, monkeypatch, split):
    rng = random.Random(split)
    text, want = written_csv(rng, 150)
    path = put(tmp_path, "a.csv", text)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert split > 1000 or lines.lines(spark, path, "utf-8").rdd.getNumPartitions() > 2
        at = lines.ranges(lines.lines(spark, path, "utf-8"), ",")
        found = readers.fields_of(lines.quoted_records(lines.lines(spark, path, "utf-8"), at, ","), 3, ",").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [[r["c0"] or "", r["c1"] or "", r["c2"] or ""] for r in sorted(found, key=lambda r: r["line"])]
    assert got == want and all(r["tm_corrupt"] is None for r in found)
    numbers, at = [], 2
    for row in want:
        numbers.append(at)
        at += 1 + sum(c.count("\n") for c in row)
    assert sorted(r["line"] for r in found) == numbers


def test_lines_of_corrupt_records(spark, tmp_path):
    """Numbers as a sequential reader counts them, over several ranges and files; blank lines before the header."""
    (tmp_path / "d").mkdir()
    body = [f"{i},v{i}" if i % 50 else f"{i},v,w" for i in range(1, 400)]
    for name, blank in (("a.csv", 0), ("b.csv", 2)):
        put(tmp_path / "d", name, "\n" * blank + "id,v\n" + "\n".join(body) + "\n")
    put(tmp_path, "c.jsonl", "".join('{"a": 1}\n' if i % 40 else "[no]\n" for i in range(1, 200)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = readers.read_csv(spark, str(tmp_path / "d"))
        left = sorted((r["file"].rsplit("/")[-1], r["line"], r["record"]) for r in out.corrupt.collect())
        broken = readers.read(spark, str(tmp_path / "c.jsonl")).corrupt.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert left == sorted((name, blank + 1 + i, f"{i},v,w") for name, blank in (("a.csv", 0), ("b.csv", 2)) for i in range(50, 400, 50))
    assert out.frame.count() == 2 * (399 - 7) and out.frame.dtypes[0] == ("id", "bigint")
    assert sorted(r["line"] for r in broken) == [40, 80, 120, 160]


def test_stray_quotes_are_contained(spark, tmp_path, monkeypatch):
    """A quote that is never closed, one that a later field seems to close, quotes within fields, fields beyond the most lines."""
    text = 'id,note\n1,"never\n2,b\n3,5" pipe\n4,"q"\n5,"x\ny"\n6,"so ""it"" is"\n' + "".join(f"{i},w\n" for i in range(7, 40))
    out = readers.read(spark, put(tmp_path, "a.csv", text))
    assert out.frame.count() == 39 and out.corrupt_rows == 0
    got = dict(rows(out))
    assert got[2] == "b" and got[3] == '5" pipe' and got[4] == "q" and got[5] == "x\ny" and got[6] == 'so "it" is' and got[39] == "w"
    monkeypatch.setattr(lines, "MOST_LINES", 20)
    long = readers.read(spark, put(tmp_path, "b.csv", 'id,note\n1,"a\nb"\n2,"open\n' + "".join(f"{i},w\n" for i in range(3, 60))))
    assert long.frame.count() == 59 and dict(rows(long))[1] == "a\nb"


def test_date_shapes_lose_nothing(spark):
    values = ["2024-1-5", "05/06/2024", "Jan 5, 2024", "january 5, 2024", "5 mar 2024", "2024-01-05t01:02:03", "2024.1.5", "0005/6/2024", "x", "", "1 2", "2024-13-45", "31-12-2024", "5 March 2024", "+12024-1-5", " 2024-1-5"]
    patterns = [*formats.DATETIME_PATTERNS, *formats.DATE_PATTERNS]
    plain = F.coalesce(*(F.try_to_timestamp("v", F.lit(p)) for p in patterns))
    df = spark.createDataFrame([(v,) for v in values], "v string").select(formats.first_parsed(F.col("v"), patterns).cast("string").alias("a"), plain.cast("string").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
    assert formats.shape("yyyy-MM-dd[ HH]") is None and formats.shape("EEE") is None


def test_json(spark, tmp_path):
    assert sorted(rows(readers.read(spark, put(tmp_path, "a.json", json.dumps([{"id": 1, "n": {"x": 2}}, {"id": 3, "n": {"x": 4}}]))))) == [(1, 2), (3, 4)]
    assert sorted(rows(readers.read(spark, put(tmp_path, "b.json", json.dumps({"data": [{"id": 1}, {"id": 2}], "meta": {"k": 1}}))))) == [(1,), (2,)]
    assert rows(readers.read(spark, put(tmp_path, "c.json", '{"a": 1, "b": "x"}'))) == [(1, "x")]
    mixed = readers.read(spark, put(tmp_path, "d.json", '[{"a": 1}, "x", {"a": 3}]'), corrupt_share=0.5)
    assert sorted(rows(mixed)) == [(1,), (3,)] and mixed.corrupt_rows == 1
    with pytest.raises(errors.EmptyDatasetError):
        readers.read(spark, put(tmp_path, "e.json", '["a", "b"]'))
    with pytest.raises(errors.SchemaError):
        readers.read(spark, put(tmp_path, "f.json", '"just text"'))


def test_jsonl(spark, tmp_path):
    out = readers.read(spark, put(tmp_path, "a.ndjson", '{"id": 1, "v": 2}\n\n{"id": 2, "v": 3}\n{bad\n{"id": 3, "v": 4}\n{"id": 4, "v": 4}\n{"id": 5, "v": 4}\n'))
    assert out.corrupt_rows == 1 and sorted(rows(out))[:2] == [(1, 2), (2, 3)]


def test_excel(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "a.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="e" sheetId="1" r:id="r1"/><sheet name="s" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Age</t></is></c></row><row/><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>41</v></c></row></sheetData></worksheet>')
    assert rows(readers.read(spark, str(path))) == [("Ann", 41)]
    (tmp_path / "books").mkdir()
    for name in ("a.xlsx", "b.xlsx"):
        (tmp_path / "books" / name).write_bytes(path.read_bytes())
    assert rows(readers.read_excel(spark, str(tmp_path / "books"))) == [("Ann", 41)] * 2
    with pytest.raises(errors.UnsupportedFormatError):
        readers.read(spark, str(tmp_path / "b.xls"))


@pytest.mark.parametrize(("code", "want"), [("yyyy\\-mm\\-dd", True), ("h:mm", True), ("0.00", False), ('0 "days"', False), ("[Red]0", False), ("General", False), ("[$-409]d mmm", True), ("#,##0_);(#,##0)", False)])
def test_formats_that_show_dates(code, want):
    assert excel.shows_dates(code) is want


@pytest.mark.parametrize(("setting", "first"), [("", datetime(2024, 1, 5, 12, 0)), ('<workbookPr date1904="1"/>', datetime(2028, 1, 6, 12, 0))])
def test_excel_dates(spark, tmp_path, setting, first):
    """Styles tell dates from numbers; a column of both stays text; rows are pulled one by one."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{setting}<sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm/dd hh:mm"/><numFmt numFmtId="171" formatCode="0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        head = "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in ("when", "n", "both"))
        body = "".join(f'<row><c s="{1 + i % 2}"><v>{45296.5 + i}</v></c><c s="3"><v>{45296 + i}</v></c><c s="{i % 2}"><v>7</v></c></row>' for i in range(3))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{head}</row>{body}</sheetData></worksheet>")
    out = readers.read(spark, str(tmp_path / "a.xlsx")).frame
    assert [t for _, t in out.dtypes] == ["timestamp", "bigint", "string"]
    rows_ = out.selectExpr("cast(when as string) w", "n", "both").collect()
    assert rows_[0]["w"] == str(first) and rows_[2]["n"] == 45298 and rows_[0]["both"] == "7"
    assert excel.dated("1", excel.DAY_ZERO) == excel.DATED + "1900-01-01 00:00:00" and excel.dated("61", excel.DAY_ZERO) == excel.DATED + "1900-03-01 00:00:00" and excel.dated("x", excel.DAY_ZERO) == "x"


def test_limits(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b\n1,2\n3,4\n")
    for limits, reason in ((readers.Limits(rows=1), "TOO_MANY_ROWS"), (readers.Limits(columns=1), "TOO_MANY_COLUMNS"), (readers.Limits(file_bytes=3), "FILE_TOO_LARGE")):
        with pytest.raises(errors.ValidationError) as e:
            readers.read(spark, path, limits=limits)
        assert e.value.details["reason"] == reason


def test_flow(spark, tmp_path):
    text = "id,email,score,grp\n" + "".join(f"{i}, U{i}@X.com ,{'' if i % 7 == 0 else i},{'A' if i % 2 else ' a'}\n" for i in range(60))
    done = DataQuality(spark).run(put(tmp_path, "a.csv", text), "d1", str(tmp_path / "out"), key="id")
    healed = spark.read.parquet(done["path"])
    assert healed.count() == 60 and healed.where("score is null").count() == 0
    assert healed.where(F.col("id") == 3).first()["email"] == "u3@x.com"
    store = DatasetStore(spark, str(tmp_path / "out"))
    delta = store.load("reports/delta", "d1").first()
    assert delta["after"] >= delta["before"]
    write_csv(healed, str(tmp_path / "csv"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 60


def test_store_replaces_safely_and_expires(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path / "s"), kept=1000, grace=50)
    with pytest.raises(FileNotFoundError):
        store.load("raw", "d")
    store.save("raw", "d", spark.range(3))
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        store.save("raw", "d", broken)
    assert store.load("raw", "d").count() == 3  # a failed save leaves the old version
    first = store.load("raw", "d")
    again = store.save("raw", "d", first.selectExpr("id + 10 as id"))  # reads what it replaces
    assert sorted(r["id"] for r in again.collect()) == [10, 11, 12] and first.count() == 3
    old, new = store.versions("raw", "d")[::-1]
    assert store.expire("raw", "d", now=new.saved + 10) == []
    gone = store.expire("raw", "d", now=new.saved + 60)
    assert old.path in gone and new.path not in gone and store.load("raw", "d").count() == 3
    with pytest.raises(FileNotFoundError):
        store.path("raw", "d", now=new.saved + 2000)
    assert store.expire("raw", "d", now=new.saved + 2000)[0] == new.path and store.versions("raw", "d") == []


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = quality.quality_by_day(stream)
    q = out.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    key = lambda r: (r["day"], r["n"], r["missing"], round(r["mean"], 6))
    assert sorted(map(key, spark.table("days").collect())) == sorted(map(key, quality.quality_by_day(events).collect()))
    q = quality.each_batch(stream, lambda b: b.groupBy().count(), str(tmp_path / "rep"), str(tmp_path / "ck2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "rep")).agg(F.sum("count")).first()[0] == events.count()

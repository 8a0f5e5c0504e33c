"""The archive source: ranges, quotes, sheets, partitions and columns."""

import csv
import io
import random
import zipfile
from xml.sax.saxutils import escape

import pytest

from marlstone.sources.archives import _ArchiveReader, records, sheet_records
from marlstone.sources.readers import xlsx, zipped_csv

COLUMNS = {"id": ["Id", "ID"], "note": ["Note"], "gone": ["Nowhere"]}


def made_table(seed, n, sep=","):
    rng, out = random.Random(seed), io.StringIO(newline="")
    write = csv.writer(out, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]))
    write.writerow(["Other", "ID", "Note"])
    for k in range(n):
        write.writerow([rng.choice(["x", 'q"q', "a,b", ""]), f"{seed}-{k}", rng.choice(["plain", "two\nlines", 'a ""quote""\n, end', "é" * rng.randint(0, 9), "tab\there"])])
    return out.getvalue()


def plain_rows(text, sep=","):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))[1:]
    return [(r[1], r[2], None) for r in rows if len(r) > 2]


@pytest.mark.parametrize("sep", [",", "\t", ";"])
def test_ranges_hold_every_record_once(spark, tmp_path, sep):
    tables = {f"part_{k}.csv": made_table(k, 200, sep) for k in range(5)}
    for name, members in (("a", list(tables)[:4]), ("b", list(tables)[4:])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in members:
                z.writestr(m, "﻿" + tables[m] if m == "part_2.csv" else tables[m])
            z.writestr("readme.txt", "no table")
    want = sorted(r for t in tables.values() for r in plain_rows(t, sep))
    for range_bytes in (97, 1000, 1 << 20):
        df = zipped_csv(spark, str(tmp_path / "*.zip"), r"part_\d+\.csv", COLUMNS, sep, range_bytes)
        assert sorted(map(tuple, df.collect())) == want
        assert df.rdd.getNumPartitions() >= (5 if range_bytes > 1000 else 5 * len(tables["part_0.csv"]) // range_bytes)
    assert zipped_csv(spark, str(tmp_path), "none", COLUMNS).count() == 0


def test_stray_quotes_and_short_records(spark, tmp_path):
    text = 'Id,Note\n1,a 5" rod\n2\n\n3,"closed" more\n4,"open ""and"" shut"\n5,last'
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("t.csv", text)
        z.writestr("empty.csv", "")
    want = [("1", 'a 5" rod', None), ("3", "closed more", None), ("4", 'open "and" shut', None), ("5", "last", None)]
    for range_bytes in (5, 20, 1000):
        got = zipped_csv(spark, str(tmp_path / "q.zip"), r".*\.csv", COLUMNS, range_bytes=range_bytes)
        assert sorted(map(tuple, got.collect())) == want


def test_only_asked_columns_are_taken_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "Id,Note\n1,a\n2\n")
    df = spark.read.format("archive_rows").schema("id string").option("columns", '{"id": ["Id"], "note": ["Note"]}').load(str(tmp_path / "t.zip"))
    assert df.columns == ["id"] and sorted(r.id for r in df.collect()) == ["1", "2"]  # the second record lacks a cell that nobody asks for


def test_parts_of_a_stream_are_joined(monkeypatch):
    from marlstone.sources import archives

    monkeypatch.setattr(archives, "PIECE", 7)
    text = made_table(9, 60).encode()
    whole = [r for _, r in records(io.BytesIO(text), b",")]
    assert b"".join(whole) == text and len(whole) == 61
    for start in (0, 50, 333, len(text), len(text) + 9):
        assert [at for at, _ in records(io.BytesIO(text), b",", start)] == [at for at, _ in records(io.BytesIO(text), b",") if at >= start]
    sheet = b'<x:worksheet xmlns:x="u"><x:sheetData><x:row r="1"><x:c><x:v>1</x:v></x:c></x:row><x:row r="2"/><x:row r="3"><x:c/></x:row></x:sheetData></x:worksheet>'
    rows = list(sheet_records(io.BytesIO(sheet)))
    assert rows[0] == (-1, b'<x:worksheet xmlns:x="u">') and [sheet[at : at + len(r)] for at, r in rows[1:]] == [r for _, r in rows[1:]] and len(rows) == 4


@pytest.mark.parametrize("prefix", ["", "x:"])
def test_sheets(spark, tmp_path, prefix):
    ns, p = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", prefix
    rng, shared, want = random.Random(3), ["STATUS", "WAGE", "Certified", "a & <b>", "Denied"], []
    cell = lambda ref, kind, value: f'<{p}c r="{ref}"{kind}><{p}v>{value}</{p}v></{p}c>'
    rows = [f'<{p}row r="1">{cell("A1", " t=" + chr(34) + "s" + chr(34), 0)}{cell("C1", " t=" + chr(34) + "s" + chr(34), 1)}</{p}row>']
    for k in range(2, 150):
        s = rng.randint(2, 4)
        wage = f"{k}.5"
        rows.append(f'<{p}row r="{k}" spans="1:3">{cell(f"A{k}", " t=" + chr(34) + "s" + chr(34), s)}{cell(f"C{k}", "", wage)}</{p}row>')
        want.append((wage, shared[s], None))
    rows.append(f'<{p}row r="150"/>')
    rows.append(f'<{p}row r="151"><{p}c r="A151" t="inlineStr"><{p}is><{p}t>{escape("x & y")}</{p}t></{p}is></{p}c><{p}c r="C151"><{p}v>7</{p}v></{p}c></{p}row>')
    want.append(("7", "x & y", None))
    declared = f'xmlns{":x" if p else ""}="{ns}"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<{p}sst {declared}>" + "".join(f"<{p}si><{p}t>{escape(t)}</{p}t></{p}si>" for t in shared) + f"</{p}sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<?xml version='1.0'?><{p}worksheet {declared}><{p}sheetData>{''.join(rows)}</{p}sheetData></{p}worksheet>")
    for range_bytes in (300, 1 << 20):
        df = xlsx(spark, str(tmp_path / "w.xlsx"), {"wage": ["WAGE"], "status": ["CASE_STATUS", "STATUS"], "gone": ["X"]}, range_bytes=range_bytes)
        assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.rdd.getNumPartitions() == 1


def test_partitions_are_those_of_the_directories(tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("a.csv", "Id\n" + "1\n" * 100)
        z.writestr("b.csv", "Id\n1\n")
    reader = _ArchiveReader(["id"], {"path": str(tmp_path / "t.zip"), "columns": '{"id": ["Id"]}', "range": "100"})
    assert [(p.member, p.start, p.end) for p in reader.partitions()] == [("a.csv", 0, 100), ("a.csv", 100, 200), ("a.csv", 200, 203), ("b.csv", 0, 5)]

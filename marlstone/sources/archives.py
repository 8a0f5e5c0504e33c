"""A Spark data source for rows in archives: tables in zip files and sheets in workbooks, read by ranges.

A partition is a range of bytes of one member, as it is unpacked, so that an archive of many members and a long
member are read by many tasks. A member can't be entered in the middle: a task
unpacks what is before its range and passes over it record by record, without taking it apart. The driver reads each archive's
directory, its last bytes, and nothing else.

A record belongs to the range in which it begins. Quoted line ends are no ends of records.
Only columns of the read schema are taken out of a record. Of a sheet, each task reads those shared strings
that its own rows name.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, unpacked; and those that are unpacked at once.
RANGE, PIECE = 32 << 20, 1 << 20
BATCH = 20_000


def store_of(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def archives_at(path: str) -> list[str]:
    """The files of a path: one, those of a folder, or those of a pattern in the last part; sorted."""
    from pyarrow import fs

    store, base = store_of(path)
    if any(c in base for c in "*?["):
        folder, pattern = base.rsplit("/", 1)
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern))
    if store.get_file_info(base).type == fs.FileType.Directory:
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.is_file)
    return [base]


def records(stream, sep: bytes, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(where it begins, record with its line end) of a delimited stream, of the records that begin at ``start`` and later.

    A quote opens a quoted field at a field's beginning only, and two are one within it, as csv reads them.
    """
    s = re.escape(sep)
    field = b'(?:"(?:[^"]|"")*+"[^' + s + b'\\n]*|(?!")[^' + s + b"\\n]*)"
    record = re.compile(field + b"(?:" + s + field + b")*\\n")
    held, at, more = b"", 0, True
    while more:
        piece = stream.read(PIECE)
        more = bool(piece)
        held += piece
        done = 0
        if b'"' not in held:
            done = held.rfind(b"\n") + 1
            if at + done > start:
                place = 0
                for line in held[:done].split(b"\n")[:-1]:
                    if at + place >= start:
                        yield at + place, line + b"\n"
                    place += len(line) + 1
        else:
            while found := record.match(held, done):
                if at + done >= start:
                    yield at + done, found[0]
                done = found.end()
        held, at = held[done:], at + done
    if held and at >= start:
        yield at, held


def sheet_records(stream, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(where it begins, row element) of a sheet, of the rows that begin at ``start`` and later; first (-1, the root's tag)."""
    begin, held, at, more, root = re.compile(rb"<(?:\w+:)?row[\s>/]"), b"", 0, True, False
    whole = re.compile(rb"<(?:\w+:)?row(?:\s[^>]*)?(?:/>|(?<!/)>.*?</(?:\w+:)?row>)", re.S)
    while more:
        piece = stream.read(PIECE)
        more = bool(piece)
        held += piece
        if not root and (tag := re.search(rb"<(?:\w+:)?worksheet[^>]*>", held)):
            root = True
            yield -1, tag[0]
        done = 0
        while found := begin.search(held, done):
            row = whole.match(held, found.start())
            if not row:
                done = found.start()
                break
            if at + found.start() >= start:
                yield at + found.start(), row[0]
            done = row.end()
        else:
            done = max(done, len(held) - 64)
        held, at = held[done:], at + done


def _cells(root: bytes, rows: list[bytes]) -> Iterator[list[tuple[bool, str]]]:
    """For each row its cells: whether it names a shared string, and the text."""
    name = re.match(rb"<((?:\w+:)?worksheet)", root)[1]
    tree = ElementTree.fromstring(root + b"".join(rows) + b"</" + name + b">")
    tail = lambda e: e.tag.rsplit("}", 1)[-1]
    for row in tree:
        cells: list[tuple[bool, str]] = []
        for c in row:
            at = len(cells)
            if letters := re.match("[A-Z]+", c.get("r") or ""):
                at = 0
                for x in letters[0]:
                    at = at * 26 + ord(x) - 64
                at -= 1
            value = next((e.text or "" for e in c if tail(e) == "v"), None)
            text = "".join(t.text or "" for t in c.iter() if tail(t) == "t") if value is None else value
            cells += [(False, "")] * (at - len(cells)) + [(c.get("t") == "s", text)]
        yield cells


def _shared(z: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings of these numbers."""
    found: dict[int, str] = {}
    if wanted and "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as raw:
            k, last = 0, max(wanted)
            for _, e in ElementTree.iterparse(raw):
                if e.tag.rsplit("}", 1)[-1] == "si":
                    if k in wanted:
                        found[k] = "".join(t.text or "" for t in e.iter() if t.tag.rsplit("}", 1)[-1] == "t")
                    k += 1
                    e.clear()
                    if k > last:
                        break
    return found


@dataclass
class MemberRange(InputPartition):
    path: str
    member: str
    start: int
    end: int


class _ArchiveReader(DataSourceReader):
    def __init__(self, names: list[str], options: dict[str, str]):
        self.path, self.member = options["path"], options.get("member", ".*")
        self.kind, self.sep, self.range = options.get("kind", "csv"), options.get("sep", ","), int(options.get("range", RANGE))
        known = json.loads(options["columns"])
        self.names, self.headings = names, [known.get(n, [n]) for n in names]

    def partitions(self) -> list[MemberRange]:
        found = []
        for path in archives_at(self.path):
            store, base = store_of(self.path)
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for m in z.infolist():
                    if not m.is_dir() and re.fullmatch(self.member, m.filename):
                        found += [MemberRange(path, m.filename, a, min(a + self.range, m.file_size)) for a in range(0, max(m.file_size, 1), self.range)]
        return found or [MemberRange("", "", 0, 0)]

    def _places(self, header: list[str]) -> tuple[list[int | None], int]:
        """Columns by any of their headings, and the cells that a record needs."""
        at = [next((header.index(h) for h in names if h in header), None) for names in self.headings]
        return at, max((k for k in at if k is not None), default=0)

    def _batches(self, rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(self.names))], names=self.names)

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            yield from self._batches((self._sheet if self.kind == "xlsx" else self._table)(z, partition))

    def _table(self, z: zipfile.ZipFile, p: MemberRange) -> Iterator[list]:
        sep = self.sep.encode()
        with z.open(p.member) as raw:
            header = next(records(raw, sep), (0, b""))[1]
        names = next(csv.reader([header.decode("utf-8-sig")], delimiter=self.sep), [])
        at, need = self._places(names)
        with z.open(p.member) as raw:
            texts = (r.decode() for _, r in _upto(records(raw, sep, max(p.start, len(header))), p.end))
            for row in csv.reader(texts, delimiter=self.sep):
                if len(row) > need:
                    yield [None if k is None else row[k] for k in at]

    def _sheet(self, z: zipfile.ZipFile, p: MemberRange) -> Iterator[list]:
        with z.open(p.member) as raw:
            rows = sheet_records(raw)
            root, (first, header) = next(rows, (-1, b""))[1], next(rows, (0, b""))
        if not header:
            return
        head = next(_cells(root, [header]))
        strings = _shared(z, {int(t) for s, t in head if s})
        at, need = self._places([strings[int(t)] if s else t for s, t in head])
        with z.open(p.member) as raw:
            rows = sheet_records(raw, max(p.start, first + 1))
            next(rows, None)
            own = [row for _, row in _upto(rows, p.end)]
        kept = [[None if k is None else cells[k] for k in at] for cells in (_cells(root, own) if own else ()) if len(cells) > need]
        strings = _shared(z, {int(c[1]) for row in kept for c in row if c and c[0]})
        for row in kept:
            yield [None if c is None else strings[int(c[1])] if c[0] else c[1] for c in row]


def _upto(found: Iterator[tuple[int, bytes]], end: int) -> Iterator[tuple[int, bytes]]:
    for at, record in found:
        if at >= end:
            return
        yield at, record


class ArchiveRows(DataSource):
    """``spark.read.format("archive_rows")``: strings of tables in archives.

    Options: path, a file, folder or pattern; member, a pattern for the whole name of a member; kind, csv or xlsx; sep; columns, JSON of each
    column's headings; range, bytes of a partition. A schema of fewer columns reads only these. Records with
    too few cells are dropped; a heading that is nowhere gives nulls.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_rows"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(schema.fieldNames(), dict(self.options))

"""Readers of landed files: staging JSON, tables, archives, sheets, XML, pages.

Plain formats use Spark's own sources, so files come from any store that Spark reads. Archives and
sheets are read by a source of their own (``archives``), from local folders and the stores that Arrow opens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from marlstone.sources.archives import RANGE, ArchiveRows


def _schema(spark: SparkSession, schema: StructType | str) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: StructType | str) -> DataFrame:
    """What read gives, or an empty table if the path isn't there."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], _schema(spark, schema))


def staging_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file with a JSON list of records; empty if it is missing, broken records dropped."""
    return or_empty(spark, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True), schema)


def optional_parquet(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """Some columns of a Parquet table; empty if it is missing."""
    return or_empty(spark, lambda: spark.read.parquet(path).select(*columns), schema)


def event_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, also gzipped; broken lines dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def xml_rows(spark: SparkSession, path: str, schema: StructType | str, tag: str = "row") -> DataFrame:
    """Elements as rows; attributes are columns with a leading underscore."""
    return spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)


def oai_records(spark: SparkSession, path: str, sets: str = "cs") -> DataFrame:
    """(identifier, datestamp, title, sets) of landed answers of a repository, by the records in them; which order they came in doesn't matter.

    Deleted records are left out, and those of no set or category that is ``sets`` or begins with it and a dot or colon. A
    record that several answers have counts once, by its last datestamp.
    """
    schema = "header struct<_status:string,identifier:string,datestamp:string,setSpec:array<string>>, metadata struct<arXiv:struct<title:string,categories:string>>"
    rows = xml_rows(spark, path, schema, "record").where("coalesce(header._status, '') <> 'deleted'")
    paper = F.col("metadata.arXiv")
    named = F.concat(F.coalesce("header.setSpec", F.array().cast("array<string>")), F.filter(F.split(F.coalesce(paper["categories"], F.lit("")), " +"), lambda c: c != ""))
    rows = rows.select("header.identifier", "header.datestamp", F.btrim(F.regexp_replace(paper["title"], "\\s+", " ")).alias("title"), named.alias("sets"))
    rows = rows.where(F.exists("sets", lambda x: x.rlike(f"^{re.escape(sets)}([.:]|$)")))
    last = rows.groupBy("identifier").agg(F.max(F.struct("datestamp", "title", "sets")).alias("m"))
    return last.select("identifier", "m.*")


def resumption_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, token) of landed answers that go on: what a collector asks for next."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.btrim(F.regexp_extract("value", "(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", 1)).alias("token"))
    return text.where("token <> ''")


def sniffed_csv(spark: SparkSession, path: str, separators: str = ",;\t") -> DataFrame:
    """A delimited file with a header, by the separator that its first line has most of.

    A file that begins with a bracket is JSON: a list of records, or an object whose fields are the columns.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    if line.lstrip("\ufeff \t")[:1] in ("[", "{"):
        return spark.read.json(path, multiLine=True)
    return spark.read.option("header", True).option("multiLine", True).option("sep", max(separators, key=line.count)).csv(path)


def _archive_rows(spark: SparkSession, path: str, columns: Mapping[str, Sequence[str]], **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveRows)
    return spark.read.format("archive_rows").options(columns=json.dumps({c: list(names) for c, names in columns.items()}), **options).load(path)


def zipped_csv(spark: SparkSession, path: str, member: str, columns: Mapping[str, Sequence[str]], sep: str = ",", range_bytes: int = RANGE) -> DataFrame:
    """Strings of delimited members (a pattern) of each zip file, by ranges of their bytes; columns: name to the headings that it has had."""
    return _archive_rows(spark, path, columns, member=member, kind="csv", sep=sep, range=str(range_bytes))


def xlsx(spark: SparkSession, path: str, columns: Mapping[str, Sequence[str]], sheet: str = "xl/worksheets/sheet1.xml", range_bytes: int = RANGE) -> DataFrame:
    """Strings of a sheet of each workbook, by ranges of its XML; columns: name to the headings that it has had."""
    return _archive_rows(spark, path, columns, member=re.escape(sheet), kind="xlsx", range=str(range_bytes))


def json_ld(html: Column, kind: str = "JobPosting") -> Column:
    """The JSON-LD objects of a type in a page, as an array of JSON strings: single objects, lists and graphs."""
    scripts = F.regexp_extract_all(html, F.lit('(?is)<script[^>]*application/ld[+]json[^>]*>(.*?)</script>'), 1)
    listed = lambda s, path: F.coalesce(F.from_json(F.get_json_object(s, path), "array<string>"), F.array().cast("array<string>"))
    objects = F.flatten(F.transform(scripts, lambda s: F.concat(listed(s, "$['@graph']"), F.when(F.btrim(s).startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(s)))))
    return F.filter(objects, lambda o: F.get_json_object(o, "$['@type']") == kind)


def next_data(html: Column, path: str) -> Column:
    """A field of the state that a page's framework embeds, by JSON path."""
    return F.get_json_object(F.regexp_extract(html, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), path)


def url_range(index: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows of an index whose reversed-host key starts with a prefix; on a sorted table Spark skips whole row groups."""
    return index.where(F.col(key).startswith(prefix))


class Registry:
    """Connectors by name: each gives a table of landed files."""

    def __init__(self) -> None:
        self.connectors: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def register(self, name: str, connector: Callable[[SparkSession, str], DataFrame]) -> None:
        self.connectors[name] = connector

    def run(self, spark: SparkSession, root: str, names: Sequence[str] | None = None) -> dict[str, tuple[str, DataFrame | None]]:
        """Status (ok, skipped or error: why) and table by name; one that fails doesn't end the others."""
        out: dict[str, tuple[str, DataFrame | None]] = {}
        for name in names or sorted(self.connectors):
            if name not in self.connectors:
                out[name] = ("skipped", None)
                continue
            try:
                out[name] = ("ok", self.connectors[name](spark, root))
            except AnalysisException as e:
                out[name] = (f"error: {e.getCondition()}", None)
        return out

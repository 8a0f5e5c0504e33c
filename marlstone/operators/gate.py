"""A gate of checks as data, a publisher that it can stop, and manifests of what was read.

Counts that checks of one table need are aggregates of one pass. ``publish_checked`` observes
them while the tables are written, so that they cost no pass of their own, and sets the pointer only
if no check fails.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.aggregate import medians
from marlstone.sources.sinks import append_pointer, new_version

RESULT = "name string, category string, status string, detail string"
Finding = tuple[str, str, str, str]


@dataclass
class RowFloor:
    """Rows that a table has at least; one of floor 0 may be missing."""

    table: str
    least: int
    category = "floor"

    def metrics(self, columns: Sequence[str]) -> dict[str, Column]:
        return {"rows": F.count(F.lit(1))}

    def judge(self, found: Mapping[str, int] | None, df: DataFrame | None) -> tuple[str, str]:
        if found is None:
            return ("skip", "absent, optional") if self.least <= 0 else ("fail", f"absent, floor {self.least}")
        return ("pass" if found["rows"] >= self.least else "fail"), f"{found['rows']} rows, floor {self.least}"


@dataclass
class Contract:
    """Columns that a table has, and those without nulls."""

    table: str
    required: Sequence[str]
    non_null: Sequence[str] = ()
    category = "contract"

    def metrics(self, columns: Sequence[str]) -> dict[str, Column]:
        return {f"nulls_{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in self.non_null if c in columns}

    def judge(self, found: Mapping[str, int] | None, df: DataFrame | None) -> tuple[str, str]:
        if found is None:
            return "skip", "absent"
        if missing := [c for c in self.required if c not in df.columns]:
            return "fail", f"missing {', '.join(missing)}"
        nulls = {c: found[f"nulls_{c}"] for c in self.non_null if c in df.columns and found[f"nulls_{c}"]}
        return ("fail", "nulls " + ", ".join(f"{c} {n}" for c, n in nulls.items())) if nulls else ("pass", "held")


@dataclass
class Suppressed:
    """No row of fewer than ``least`` by its own count carries a value."""

    table: str
    value: str
    size: str
    least: int
    category = "suppression"

    def metrics(self, columns: Sequence[str]) -> dict[str, Column]:
        return {f"thin_{self.value}": F.count(F.when(F.col(self.value).isNotNull() & (F.col(self.size) < self.least), 1))} if {self.value, self.size} <= {*columns} else {}

    def judge(self, found: Mapping[str, int] | None, df: DataFrame | None) -> tuple[str, str]:
        if found is None or f"thin_{self.value}" not in found:
            return "skip", "absent"
        n = found[f"thin_{self.value}"]
        return ("pass" if n == 0 else "fail"), f"{n} thin rows with a value, floor {self.least}"


@dataclass
class Share:
    """The share of rows of which a condition (SQL) holds; rows of a null don't count as such."""

    table: str
    name: str
    condition: str
    least: float
    category = "disclosure"

    def metrics(self, columns: Sequence[str]) -> dict[str, Column]:
        return {"rows": F.count(F.lit(1)), f"share_{self.name}": F.count(F.when(F.expr(self.condition), 1))}

    def judge(self, found: Mapping[str, int] | None, df: DataFrame | None) -> tuple[str, str]:
        if found is None:
            return "skip", "absent"
        share = found[f"share_{self.name}"] / found["rows"] if found["rows"] else 0.0
        return ("pass" if share >= self.least else "fail"), f"{found[f'share_{self.name}']} of {found['rows']}, least {self.least}"


@dataclass
class Volume:
    """Rows that each value of a column has at least; fewer are a warning."""

    table: str
    by: str
    least: int
    category = "volume"

    def metrics(self, columns: Sequence[str]) -> dict[str, Column]:
        return {}

    def judge(self, found: Mapping[str, int] | None, df: DataFrame | None) -> tuple[str, str]:
        if found is None or self.by not in df.columns:
            return "skip", "absent"
        thin = df.where(F.col(self.by).isNotNull()).groupBy(self.by).agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") < self.least, 1))).first()[0]
        return ("pass" if thin == 0 else "warn"), f"{thin} below {self.least}"


@dataclass
class Band:
    """The median of each group lies within a band about its anchor; groups without a positive anchor aren't checked.

    anchors: (by, anchor). Values that aren't positive don't count.
    """

    table: str
    value: str
    by: str
    anchors: DataFrame
    low: float = 0.2
    high: float = 5.0
    category = "sanity"

    def metrics(self, columns: Sequence[str]) -> dict[str, Column]:
        return {}

    def judge(self, found: Mapping[str, int] | None, df: DataFrame | None) -> tuple[str, str]:
        if found is None or not {self.value, self.by} <= {*df.columns}:
            return "skip", "absent"
        cells = medians(df.where(F.col(self.value) > 0), [self.by], {"_median": F.col(self.value)})
        both = cells.join(self.anchors.where("anchor > 0").select(self.by, "anchor"), self.by)
        checked, out = both.agg(F.count("*"), F.count(F.when(~F.col("_median").between(self.low * F.col("anchor"), self.high * F.col("anchor")), 1))).first()
        return ("skip" if not checked else "fail" if out else "pass"), f"{out} of {checked} out of the band"


Check = RowFloor | Contract | Suppressed | Share | Volume | Band


class GateError(ValueError):
    """A publication that the gate has refused."""


def _metrics(checks: Sequence[Check], table: str, df: DataFrame) -> dict[str, Column]:
    found: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for c in checks:
        if c.table == table:
            found |= c.metrics(df.columns)
    return found


def _judged(checks: Sequence[Check], found: Mapping[str, Mapping[str, int]], tables: Mapping[str, DataFrame]) -> list[Finding]:
    return [(f"{c.category}.{c.table}", c.category, *c.judge(found.get(c.table), tables.get(c.table))) for c in checks]


def run_gate(spark: SparkSession, tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """(name, category, status, detail): pass, warn, fail or skip for each check; tables that aren't there are absent ones."""
    found = {}
    for table in {c.table for c in checks} & {*tables}:
        metrics = _metrics(checks, table, tables[table])
        found[table] = tables[table].agg(*[m.alias(name) for name, m in metrics.items()]).first().asDict()
    return spark.createDataFrame(_judged(checks, found, tables), RESULT)


def publish_checked(tables: Mapping[str, DataFrame], root: str, checks: Sequence[Check], strict: bool = True) -> list[Finding]:
    """Write all tables as a new version and point readers to it, if no check fails or ``strict`` is off; the findings.

    A refused version stays unread: no pointer names it, and the error has the findings that failed.
    """
    spark = next(iter(tables.values())).sparkSession
    version, written, found = new_version(), {}, {}
    for name, df in tables.items():
        seen = Observation(name)
        path = f"{root}/versions/{version}/{name}.parquet"
        df.observe(seen, *[m.alias(k) for k, m in _metrics(checks, name, df).items()]).write.parquet(path)
        found[name], written[name] = seen.get, spark.read.schema(df.schema).parquet(path)
    findings = _judged(checks, found, written)
    if strict and (failed := [f for f in findings if f[2] == "fail"]):
        raise GateError("publication refused: " + "; ".join(f"{name}: {detail}" for name, _, _, detail in failed))
    append_pointer(spark, root, version)
    return findings


def within_band(df: DataFrame, value: str, by: str, anchors: DataFrame, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Rows whose value lies within a band about their group's anchor (by, anchor); all where there is no positive anchor."""
    known = anchors.where("anchor > 0").select(by, F.col("anchor").alias("_anchor"))
    joined = df.join(known, by, "left")
    kept = joined.where(F.col("_anchor").isNull() | F.col(value).between(low * F.col("_anchor"), high * F.col("_anchor")))
    return kept.select(df.columns)


def file_manifest(spark: SparkSession, path: str, source: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source, n_files, n_bytes, as_of, snapshot) of the files below a path: a digest that changes with any name or content.

    ``source`` makes a source of a file's path; all are one without it. Files are digested where they are read, each whole;
    the snapshot is of sums over files, so their order doesn't matter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace("path", "^[a-z]+:/*", "/")
    named = files.select((source(name) if source else F.lit("all")).alias("source"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("at"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))
    sums = [F.sum(F.xxhash64("file", "digest", F.lit(seed)).cast("decimal(38, 0)")).cast("string") for seed in (1, 2)]
    return named.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.max("at").alias("as_of"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("snapshot"))

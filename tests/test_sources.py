"""Readers, writers and streams on small files."""

import gzip
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from marlstone.sources import readers, sinks
from marlstone.streaming import events


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1, "v": "x"}, {"k": 2}]))
    assert readers.staging_json(spark, str(tmp_path / "a.json"), "k long, v string").count() == 2
    assert readers.staging_json(spark, str(tmp_path / "none.json"), "k long").count() == 0
    assert readers.optional_parquet(spark, str(tmp_path / "none"), "k long").count() == 0
    with gzip.open(tmp_path / "e.json.gz", "wt") as f:
        f.write('{"k": 1}\nbroken\n{"k": 3}\n')
    assert sorted(r.k for r in readers.event_lines(spark, str(tmp_path / "e.json.gz"), "k long").collect()) == [1, 3]


def test_xml_csv_and_zip(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1"/><row Id="2" PostTypeId="2"/></posts>')
    assert readers.xml_rows(spark, str(tmp_path / "p.xml"), "_Id long, _PostTypeId long").where("_PostTypeId = 1").count() == 1
    (tmp_path / "d.csv").write_text("a;b\n1;2\n")
    assert readers.sniffed_csv(spark, str(tmp_path / "d.csv")).columns == ["a", "b"]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("survey_2019.csv", 'Country,Pay\nIndia,"1,2"\nshort\n')
        z.writestr("survey_2017.csv", "Salary,Country\n5,Spain\n")
    got = readers.zipped_csv(spark, str(tmp_path / "s.zip"), r"survey_.*\.csv", {"country": ["Country"], "pay": ["Pay", "Salary"]})
    assert sorted(map(tuple, got.collect())) == [("India", "1,2"), ("Spain", "5")]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>STATUS</t></si><si><t>WAGE</t></si><si><t>CERTIFIED</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7.5</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.xlsx(spark, str(tmp_path / "w.xlsx"), {"wage": ["WAGE"], "status": ["STATUS", "CASE_STATUS"]}).collect()] == [("7.5", "CERTIFIED")]


def test_pages(spark):
    page = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "a"}, {"@type": "X"}]}</script><script type="application/ld+json">[{"@type": "JobPosting", "title": "b"}]</script><script id="__NEXT_DATA__" type="x">{"props": {"n": 3}}</script>'
    row = spark.createDataFrame([(page,)], "html string").select(F.transform(readers.json_ld(F.col("html")), lambda o: F.get_json_object(o, "$.title")).alias("t"), readers.next_data(F.col("html"), "$.props.n").alias("n")).first()
    assert row.t == ["a", "b"] and row.n == "3"


def test_registry(spark, tmp_path):
    r = readers.Registry()
    r.register("good", lambda s, root: s.range(2))
    r.register("bad", lambda s, root: s.read.parquet(f"{root}/none"))
    got = r.run(spark, str(tmp_path), ["good", "bad", "unknown"])
    assert got["good"][0] == "ok" and got["bad"][0].startswith("error") and got["unknown"][0] == "skipped"


def test_publish_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, c string")
    sinks.publish({"t": df}, str(tmp_path / "w"))
    sinks.publish({"t": df.limit(1)}, str(tmp_path / "w"))
    assert spark.read.parquet(f"{sinks.published(spark, str(tmp_path / 'w'))}/t.parquet").count() == 1
    sinks.export(df, str(tmp_path / "m"), ["c"])
    assert (tmp_path / "m" / "c=a").is_dir()
    work = lambda u: u.withColumn("twice", F.col("k") * 2)
    out = str(tmp_path / "units")
    assert sinks.resume_units(spark, df.limit(1), "k", out, work).count() == 1
    assert sorted(r.twice for r in sinks.resume_units(spark, df, "k", out, work).collect()) == [2, 4]
    sinks.audit(df, str(tmp_path / "log"), "units")
    assert spark.read.json(str(tmp_path / "log")).first()["rows"] == 2


def test_streams(spark, tmp_path):
    def land(name, rows):
        frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        frame["ts"] = pd.to_datetime(frame["ts"]).astype("datetime64[us]")
        (tmp_path / "in").mkdir(exist_ok=True)
        frame.to_parquet(tmp_path / "in" / name, index=False)

    def run(result, name, mode):
        events.run_available(result, str(tmp_path / name), str(tmp_path / f"{name}-c"), mode)
        return spark.read.parquet(str(tmp_path / name)).collect()

    stream = lambda: events.event_stream(spark, str(tmp_path / "in"), "*.parquet")
    land("1.parquet", [(1, "2024-01-01 00:10", 1, "error", 1.0, "{}"), (2, "2024-01-01 00:20", 1, "error", 2.0, "{}"), (2, "2024-01-01 00:20", 1, "error", 2.0, "{}")])
    assert {(r.event_type, r.n) for r in run(events.tumbling(stream()), "t", "complete")} == {("error", 3)}
    assert [r.open for r in run(events.breaker(stream()), "b", "update")] == [True]
    assert len(run(events.without_repeats(stream()), "d", "append")) == 2
    land("2.parquet", [(3, "2024-01-01 05:00", 1, "view", 1.0, "{}")])
    assert sum(r.n for r in run(events.tumbling(stream()), "t", "complete")) == 4
    assert [(r.events, r.open) for r in run(events.breaker(stream()), "b", "update")][-1] in [(4, False), (3, True)]
    assert sorted(r.n for r in run(events.sessions(stream()), "s", "complete")) == [1, 3]
    assert sum(r.n for r in run(events.sliding(stream()), "l", "complete")) == 16


def test_repository_answers(spark, tmp_path):
    record = lambda i, stamp, cats, status="": f"<record><header{status}><identifier>{i}</identifier><datestamp>{stamp}</datestamp><setSpec>physics</setSpec></header><metadata><arXiv><title> A  {i}\n b </title><categories>{cats}</categories></arXiv></metadata></record>"
    page = lambda records, token: f"<OAI-PMH><ListRecords>{records}{token}</ListRecords></OAI-PMH>"
    (tmp_path / "1.xml").write_text(page(record("x", "2024-01-01", "math.CO cs.LG") + record("y", "2024-01-01", "csx.A") + record("z", "2024-01-01", "cs.AI", ' status="deleted"'), '<resumptionToken cursor="0"> t|1001 </resumptionToken>'))
    (tmp_path / "2.xml").write_text(page(record("x", "2024-02-01", "cs.LG") + record("w", "2024-01-05", "cs.CV"), "<resumptionToken/>"))
    got = {r.identifier: (r.datestamp, r.title, r.sets) for r in readers.oai_records(spark, str(tmp_path)).collect()}
    assert got == {"x": ("2024-02-01", "A x b", ["physics", "cs.LG"]), "w": ("2024-01-05", "A w b", ["physics", "cs.CV"])}
    assert [r.token for r in readers.resumption_tokens(spark, str(tmp_path)).collect()] == ["t|1001"]


def test_sniffed_json_and_consolidate(spark, tmp_path):
    (tmp_path / "a.csv").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    assert sorted((r.a, r.b) for r in readers.sniffed_csv(spark, str(tmp_path / "a.csv")).collect()) == [(1, "x"), (2, "y")]
    parts = spark.createDataFrame([("p", "old", 1, None), ("p", "new", 2, None), ("q", "only", 1, 5), ("p", "late", 2, 3)], "id string, v string, seq int, n int")
    got = sinks.consolidate(parts, ["id"], ["seq"], str(tmp_path / "all"))
    assert got.columns == parts.columns and [tuple(r) for r in got.orderBy("id").collect()] == [("p", "new", 2, None), ("q", "only", 1, 5)]

"""Recovered answers, sorted indexes and streams of pages."""

import json

from pyspark.sql import functions as F

from marlstone.functions import answers
from marlstone.sources import index
from marlstone.sources.pages import TokenPages
from marlstone.streaming.events import run_available


def test_answers_are_held_to_their_schema(spark):
    whole = {"role": " Data Engineer ", "level": "SENIOR", "skills": ["SQL", "cobol", 5, None, ["x"]], "certs": ["A", " ", "B", "C"], "tongues": ["EN", "english", "de", "e1", "x"], "years": 7.9, "most": "12", "flag": "no", "note": "n" * 50, "none": None}
    raws = [json.dumps(whole), f"Well:\n{json.dumps(whole)}\nDone {{}}", f"Well {json.dumps(whole)} done", "[1]", "nothing", "", None, '{"a": {', '{"years": true, "flag": 0, "level": 3, "skills": "sql", "years2": 61}', '{"years": 60, "flag": [], "role": ""}']
    a = F.col("a")
    rows = spark.createDataFrame(list(enumerate(raws)), "k int, raw string").select("k", answers.recovered(F.col("raw")).alias("a")).select(
        "k", a.isNotNull().alias("found"), answers.text_of(a, "role", other="unknown").alias("role"), answers.word_of(a, "level", ("senior", "junior"), "unknown").alias("level"), answers.words_of(a, "skills", ("sql", "5")).alias("skills"), answers.words_of(a, "certs", most=2).alias("certs"),
        answers.codes_of(a, "tongues", 8).alias("tongues"), answers.number_of(a, "years", 0, 60).alias("years"), answers.number_of(a, "most", 0, 60).alias("most"), answers.flag_of(a, "flag").alias("flag"), answers.text_of(a, "note", 10).alias("note"), answers.text_of(a, "none").alias("none"),
    )
    got = {r.k: tuple(r)[1:] for r in rows.collect()}
    full = (True, "Data Engineer", "senior", ["sql", "5"], ["A", "B"], ["en", "eng", "de"], 7, None, True, "n" * 10, None)
    none = (False, "unknown", "unknown", [], [], [], None, None, False, None, None)
    assert got[0] == got[1] == got[2] == full and got[3] == got[4] == got[5] == got[6] == got[7] == none
    assert got[8] == (True, *none[1:]) and got[9] == (True, "unknown", "unknown", [], [], [], 60, None, False, None, None)


def test_a_range_of_keys_opens_few_files(spark, tmp_path):
    keys = [f"com,site{k % 50:02d})/page/{k}" for k in range(2000)] + ["com,site07)/page/hot"] * 500 + [None, "", "com"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "urlkey string, n long").repartition(4)
    path = str(tmp_path / "index")
    index.write_index(df, "urlkey", path, 16)
    every = len(spark.read.parquet(f"{path}/rows").inputFiles())
    for prefix, most in (("com,site07)", 3), ("com,site1", 6), ("org", 0), ("com,site49)/page/1949", 2), ("com", every)):
        found = index.key_range(spark, path, "urlkey", prefix)
        want = sorted(i for i, k in enumerate(keys) if k is not None and k.startswith(prefix))
        assert sorted(r.n for r in found.collect()) == want
        assert len(found.inputFiles()) <= most if want else found.isEmpty()
    assert every >= 10 and sorted(r.n for r in index.key_range(spark, path, "urlkey", "").collect()) == sorted(i for i, k in enumerate(keys) if k is not None)


def test_stream_goes_on_at_its_token(spark, tmp_path):
    spark.dataSource.register(TokenPages)
    pages, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    pages.mkdir()
    land = lambda name, k, token: (pages / f"{name}.xml").write_text(f"<r><record>{k}</record>{'' if token is None else f'<resumptionToken>{token}</resumptionToken>'}</r>")
    run = lambda: run_available(spark.readStream.format("token_pages").load(str(pages)), out, checkpoint)

    def seen():
        return sorted((r.page, r.token) for r in spark.read.parquet(out).collect())

    land("first", 1, "a|1")
    land("a_1", 2, "b")
    run()
    assert seen() == [(0, "first"), (1, "a|1")]
    run()  # the next answer hasn't landed
    assert seen() == [(0, "first"), (1, "a|1")]
    land("b", 3, "c")
    land("c", 4, "")
    run()
    run()
    assert seen() == [(0, "first"), (1, "a|1"), (2, "b"), (3, "c")]

"""The jobs: growing input in two runs, reruns, runs that were cut short, odd rows, and the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import condition_report, text_intake
from jobs.common import config_of, stored

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def files(path) -> dict:
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def result(spark, config, batches=True):
    rows = stored(spark, f"{config['output']}/rows", text_intake.ROWS)
    reports = stored(spark, f"{config['output']}/sections", text_intake.section_schema(config["word_edges"], config["quantiles"]))
    if not batches:
        rows, reports = rows.drop("batch"), reports.drop("through_batch")
    return sorted(map(str, rows.collect())), sorted(map(str, reports.collect()))


@pytest.fixture
def intake(spark, tmp_path):
    """Documents of the smallest tables in three files, of which the first is there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1 and lang = 'en'"), docs.where("not (doc_id % 3 = 0 or doc_id % 3 = 1 and lang = 'en')")]
    config = config_of(text_intake.CONFIG, input=f"{tmp_path}/in", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/check")
    parts[0].write.parquet(config["input"])
    return config, parts, docs


def test_intake_takes_only_what_is_new(spark, intake, tmp_path):
    config, parts, docs = intake
    first = text_intake.run(spark, config)
    assert first["rows_taken"] == parts[0].count() and first["batches"] == 1 and first["languages"] == 4
    before, there = result(spark, config), files(config["output"])
    assert text_intake.run(spark, config) == {"rows_taken": 0, "batches": 0, "languages": 0, "sections_written": 0}
    assert result(spark, config) == before and files(config["output"]) == there

    parts[1].write.mode("append").parquet(config["input"])
    second = text_intake.run(spark, config)
    assert second["rows_taken"] == parts[1].count() and second["languages"] == 1
    now = files(config["output"])
    # Rows of the first run, and reports of languages without news, are the same files.
    assert all(now[f] == t for f, t in there.items() if f.startswith("rows/") or "lang=en" not in f)
    assert {f.split("/")[1] for f in set(now) - set(there)} == {"batch=1", "lang=en"}

    parts[2].write.mode("append").parquet(config["input"])
    assert text_intake.run(spark, config)["rows_taken"] == parts[2].count()
    whole = config | {"input": f"{tmp_path}/whole", "output": f"{tmp_path}/once", "checkpoint": f"{tmp_path}/check2"}
    docs.write.parquet(whole["input"])
    text_intake.run(spark, whole)
    assert result(spark, config, batches=False) == result(spark, whole, batches=False)


def test_intake_is_made_good_after_a_failure(spark, intake, monkeypatch):
    config, parts, _ = intake
    text_intake.run(spark, config)
    parts[1].write.mode("append").parquet(config["input"])

    def broken(*_):
        raise RuntimeError("lost")

    # After the rows, before the reports.
    with monkeypatch.context() as m:
        m.setattr(text_intake, "sections", broken)
        with pytest.raises(RuntimeError):
            text_intake.run(spark, config)
    again = text_intake.run(spark, config)
    assert again["rows_taken"] == 0 and again["languages"] == 1
    # In the middle of a batch, its rows written already: it is run again under its own number.
    parts[2].write.mode("append").parquet(config["input"])
    write = text_intake.written
    with monkeypatch.context() as m:
        m.setattr(text_intake, "written", lambda *a, **k: (write(*a, **k), broken()))
        with pytest.raises(Exception, match="lost"):
            text_intake.run(spark, config)
    text_intake.run(spark, config)
    rows, reports = result(spark, config)
    assert len(rows) == sum(p.count() for p in parts)
    assert sum(r.n_documents for r in stored(spark, f"{config['output']}/sections", text_intake.section_schema(config["word_edges"], config["quantiles"])).collect()) == len(rows)


def test_intake_of_odd_rows(spark, tmp_path):
    config = config_of(text_intake.CONFIG, input=f"{tmp_path}/in", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/check", files_per_batch=1)
    rows = [(1, None, "en", "a", 3, 0), (2, "", "en", "a", 0, 0), (3, " \n\t", "", "a", 3, 0), (None, "é é", None, None, 3, 0), (5, "x " * 50_000, "10", "a/b=c", 100_000, 0), (6, "same words here", "en", "a", 15, 0), (6, "same words here", "en", "a", 15, 0), (7, "one\ntwo\n", "en", " ", 9, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(config["input"])
    assert text_intake.run(spark, config)["rows_taken"] == len(rows)
    got = {(r.doc_id, r.lang, r.source): r for r in stored(spark, f"{config['output']}/rows", text_intake.ROWS).collect()}
    assert len(got) == len(rows) - 1
    assert (got[1, "en", "a"].n_chars, got[1, "en", "a"].faults) == (None, "no text; length differs")
    assert (got[2, "en", "a"].n_lines, got[2, "en", "a"].faults) == (0, "empty text")
    assert got[3, "und", "a"].faults == "empty text; no language"
    assert got[None, "und", "und"].faults == "no id; no language; no source; few words" and got[None, "und", "und"].n_bytes == 5
    assert got[5, "10", "a/b=c"].n_words == 50_000 and got[5, "10", "a/b=c"].stratum == 4 and got[5, "10", "a/b=c"].faults == ""
    assert got[7, "en", "und"].n_lines == 3 and got[7, "en", "und"].faults == "no source; length differs; few words"
    report = {(r.lang, r.source): r for r in stored(spark, f"{config['output']}/sections", text_intake.section_schema(config["word_edges"], config["quantiles"])).collect()}
    a = report["en", "a"]
    assert (a.n_documents, a.n_faulty, a.n_no_text, a.n_texts, a.n_repeated, a.words_p50, a.n_words) == (4, 4, 1, 2, 2, 3.0, 6)
    assert report["10", "a/b=c"].words_pct == 100.0 and report["und", "und"].n_no_id == 1


def test_intake_of_nothing(spark, tmp_path):
    config = config_of(text_intake.CONFIG, input=f"{tmp_path}/in", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/check")
    spark.createDataFrame([], DOCS).write.parquet(config["input"])
    assert text_intake.run(spark, config)["sections_written"] == 0


def test_report_reruns_with_the_same_result(spark, tmp_path):
    config = config_of(condition_report.CONFIG, input=f"{SF}/lineitem.parquet", output=f"{tmp_path}/out")
    read = lambda: {t: sorted(map(str, spark.read.parquet(f"{tmp_path}/out/{t}").collect())) for t in condition_report.TABLES}
    first = condition_report.run(spark, config)
    before = read()
    assert first == {"quality": 12, "sections": 24, "replicates": 12, "contrasts": 10} and {t: len(r) for t, r in before.items()} == first
    assert condition_report.run(spark, config) == first and read() == before
    assert sorted(os.listdir(f"{tmp_path}/out/quality"))[-2:] == ["arm=arm1", "arm=arm2"]


def test_report_needs_the_design(spark, tmp_path):
    config = config_of(condition_report.CONFIG, input=f"{SF}/lineitem.parquet", output=f"{tmp_path}/out")
    for field, value in (("animal", "CAST(l_partkey % 12 AS INT)"), ("arm", "'arm1'"), ("object_type", "'?'"), ("area", "-1.0D")):
        with pytest.raises(ValueError):
            condition_report.run(spark, config | {"fields": config["fields"] | {field: value}})
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="unknown settings"):
        config_of(condition_report.CONFIG, inputs="x")


def test_command_line(tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    run = lambda *more: subprocess.run([sys.executable, "-m", "jobs.text_intake", *more], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)
    own = tmp_path / "own.json"
    own.write_text(json.dumps(json.loads((ROOT / "jobs" / "text_intake.json").read_text()) | {"output": f"{tmp_path}/out"}))
    for rows in ("'rows_taken': 200", "'rows_taken': 0"):
        done = run("--config", str(own), "--set", f"input={SF}/documents.parquet", f"checkpoint={tmp_path}/check", "quantiles=[0.5]")
        assert done.returncode == 0 and rows in done.stderr, done.stderr[-2000:]
        assert "wrote 200 rows" in done.stderr or "took 0 rows" in done.stderr


def test_report_contrasts_read_no_exports(spark, tmp_path):
    """What is made of the replicates' rows does not read the exports again."""
    config = config_of(condition_report.CONFIG, input=f"{SF}/lineitem.parquet", output=f"{tmp_path}/out")
    objects = condition_report.objects_of(spark, config)
    made = condition_report.tables(objects, objects.select("job", "animal", "grp", "arm").distinct(), config)
    assert objects.inputFiles() and not made["replicates"].inputFiles() and not made["contrasts"].inputFiles()

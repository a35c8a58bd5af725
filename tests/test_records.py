"""Catalogs, summaries and templates with what is missing, blank or old."""

import json

import pytest

from lectio.operators import runs
from lectio.sources import records


def test_template_where_counts_are_blank(spark):
    rows = [("a", "m:1", "ok", "", ""), ("b", "m:1", "ok", "nan", "3"), ("c", "m 1/x", "ok", "  ", None), ("d", "m", "error", "7", "7"), ("e", "m:1", "ok", "0", " NaN ")]
    summary = spark.createDataFrame(rows, "pdf_id string, model string, status string, quiz_num_questions string, pptx_num_slides_total string")
    found = runs.judging_template(summary).groupBy("execution_id", "artifact_type").count().collect()
    assert sorted(map(tuple, found)) == [("b__m_1", "pptx", 7), ("e__m_1", "quiz", 8)]
    numbers = summary.selectExpr("pdf_id", "model", "status", "try_cast(quiz_num_questions AS double) AS quiz_num_questions", "double('nan') AS pptx_num_slides_total")
    assert runs.judging_template(numbers).select("execution_id").distinct().collect()[0][0] == "e__m_1"


def test_catalog_knows_which_files_are_there(spark, tmp_path):
    entries = [{"id": " x ", "filename": "x.pdf", "title": ""}, {"id": "y", "filename": "y.pdf", "title": "Y"}, {"id": "", "filename": "z.pdf"}]
    (tmp_path / "c.json").write_text(json.dumps({"pdfs": entries}))
    (tmp_path / "files").mkdir()
    for name in ("x.pdf", "other.pdf"):
        (tmp_path / "files" / name).write_bytes(b"%PDF")
    assert sorted((r.id, r.title) for r in records.catalog(spark, str(tmp_path / "c.json")).collect()) == [("x", "x"), ("y", "Y")]
    there = records.catalog(spark, str(tmp_path / "c.json"), str(tmp_path / "files")).collect()
    assert [(r.id, r.length) for r in there] == [("x", 4)]
    (tmp_path / "empty.json").write_text(json.dumps({"pdfs": []}))
    with pytest.raises(RuntimeError, match="empty.json"):
        records.catalog(spark, str(tmp_path / "empty.json"))
    with pytest.raises(ValueError, match="nobody"):
        runs.requested(records.catalog(spark, str(tmp_path / "c.json")), ["y", "nobody"])


@pytest.mark.parametrize(("sep", "mark"), [(";", "﻿"), (",", "")])
def test_old_summaries_get_todays_columns(spark, tmp_path, sep, mark):
    (tmp_path / "s.csv").write_text(mark + sep.join(["pdf_id", "model", "old_column", "kb_atoms"]) + "\n" + sep.join(["a", "m", "gone", "5"]) + "\n", encoding="utf-8")
    found = records.summary_csv(spark, str(tmp_path / "s.csv"))
    assert found.columns == runs.SUMMARY and len(found.columns) == 24
    row = found.first()
    assert (row.pdf_id, row.model, row.kb_atoms, row.status, row.quiz_num_questions) == ("a", "m", "5", "", "")

"""Packages read back: the rows that they were written from, also after a task that was killed."""

import subprocess
import sys
import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path

import pytest

from lectio.operators import package, quiz
from lectio.sources import packages

LESSON = """# Energía eólica
**Turbina**: máquina que convierte el viento en electricidad útil & barata <siempre>.
**Rotor**: parte giratoria que mueve el eje de la máquina principal.
**Góndola**: caja que protege el generador y los engranajes de la torre.
"""


def test_decks_and_exams_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, LESSON), (2, LESSON.replace("eólica", "solar"))], "doc_id long, text string")
    m = package.study(docs)
    lines = quiz.exam_lines(m.quiz)
    packages.write_packages(packages.deck_files(m.deck).unionByName(packages.exam_files(lines)), str(tmp_path / "out"))
    files = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert len(files) == 4 and [f.rsplit(".", 1)[1] for f in files] == ["docx", "pptx", "docx", "pptx"]
    for f in files:
        with zipfile.ZipFile(tmp_path / "out" / f) as z:
            assert z.testzip() is None
            for part in z.namelist():
                ET.fromstring(z.read(part))
            listed = {e.attrib["PartName"][1:] for e in ET.fromstring(z.read("[Content_Types].xml")) if "PartName" in e.attrib}
            assert listed <= set(z.namelist())
    back = packages.read_packages(spark, str(tmp_path / "out")).collect()
    exam = {d: [r.line for r in lines.filter(f"doc_id = {d}").orderBy("line_no").collect()] for d in (1, 2)}
    deck = {d: m.deck.filter(f"doc_id = {d}").collect() for d in (1, 2)}
    for d in (1, 2):
        own = [r for r in back if r.name.startswith(f"{d}-")]
        assert [r.text for r in sorted((r for r in own if r.name.endswith("docx")), key=lambda r: r.line_no)] == exam[d]
        shown = [r.text for r in sorted((r for r in own if r.name.endswith("pptx")), key=lambda r: (int(r.part.split("slide")[-1][:-4]), r.line_no))]
        place = {"cover": 0, "index": 1, "content": 2, "conclusions": 3}
        want = [r.text for r in sorted(deck[d], key=lambda r: (place[r.section], r.slide_no, r.line_no))]
        assert [t for t in shown if t != "Índice"] == want and shown.count("Índice") == 1


@pytest.mark.parametrize("text", ["a & b <c> \"d\" 'e'", "tab\tand \x00 \x0b \x1f", "back\\slash \\0041", "é 🙂 ￾", ""])
def test_any_text_comes_back(spark, tmp_path, text):
    rows = spark.createDataFrame([(1, 1, text), (1, 2, "x")], "doc_id long, line_no int, line string")
    packages.write_packages(packages.exam_files(rows), str(tmp_path / "o"))
    assert [r.text for r in sorted(packages.read_packages(spark, str(tmp_path / "o")).collect(), key=lambda r: r.line_no)] == [text, "x"]


def test_overwriting_appending_and_failing(spark, tmp_path):
    one = lambda d, text: packages.exam_files(spark.createDataFrame([(d, 1, text)], "doc_id long, line_no int, line string"))
    names = lambda: sorted(p.name.split("-")[0] for p in (tmp_path / "o").iterdir() if p.suffix == ".docx")
    packages.write_packages(one(1, "a"), str(tmp_path / "o"))
    packages.write_packages(one(2, "b"), str(tmp_path / "o"), "append")
    assert names() == ["1", "2"]
    with pytest.raises(Exception, match="unknown"):
        packages.write_packages(one(3, "c").withColumn("kind", __import__("pyspark").sql.functions.lit("unknown")), str(tmp_path / "o"))
    assert names() == ["1", "2"] and not any(p.name.startswith("_temporary") for p in (tmp_path / "o").iterdir())
    packages.write_packages(one(4, "d"), str(tmp_path / "o"))
    assert names() == ["4"]


KILLED = """
import os, sys; sys.path.insert(0, {root!r})
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from lectio.sources import packages
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

@F.udf("string")
def dies(text):
    flag = Path({flag!r})
    if text == "line 57" and not flag.exists():
        flag.write_text("x")
        os._exit(1)
    return text

rows = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("line_no"), F.concat(F.lit("line "), "id").alias("line"))
files = packages.exam_files(rows)
line = F.struct(*(F.col("lines")[0][c].alias(c) for c in ("section", "slide_no", "line_no")), dies(F.col("lines")[0]["text"]).alias("text"))
packages.write_packages(files.withColumn("lines", F.array(line)), {out!r})
got = sorted(r.text for r in packages.read_packages(spark, {out!r}).collect())
assert got == sorted(f"line {{k}}" for k in range(60)), len(got)
"""


def test_after_a_killed_worker_each_file_is_there_once(tmp_path):
    code = KILLED.format(root=str(Path(__file__).resolve().parents[1]), flag=str(tmp_path / "died"), out=str(tmp_path / "out"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "died").exists()
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == [".docx"] * 60

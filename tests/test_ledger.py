"""A scripted model that counts its calls: across reruns, repeated prompts, tasks that are retried, timeouts and bad answers."""

import json
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from lectio.functions.tables import written
from lectio.operators import package, planning, prompts
from lectio.operators.ledger import Ledger


def counted(folder, answer=lambda p, t: f"{p}!"):
    """A model that leaves a file for each call."""
    folder.mkdir(exist_ok=True)
    place = str(folder)

    def call(prompt, warmth):
        import uuid

        Path(f"{place}/{uuid.uuid4().hex}").write_text(f"{prompt}\t{warmth}")
        return answer(prompt, warmth)

    return call, lambda: Counter(tuple(f.read_text().split("\t")) for f in folder.iterdir())


def rows(spark, *prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "doc_id long, p string").repartition(2)


def test_nothing_is_asked_twice(spark, tmp_path):
    call, calls = counted(tmp_path / "calls")
    ledger = Ledger(spark, str(tmp_path / "ledger"), "m")
    got = ledger.answered(rows(spark, "a", "b", "a", None), F.col("p"), call)
    assert sorted((r.doc_id, r.answer, r.error, r.tries) for r in got.collect()) == [(0, "a!", None, 1), (1, "b!", None, 1), (2, "a!", None, 1), (3, None, None, None)]
    assert got.columns == ["doc_id", "p", "answer", "error", "tries", "seconds"]
    again = ledger.answered(rows(spark, "b", "c"), F.col("p"), call)
    assert sorted((r.doc_id, r.answer) for r in again.collect()) == [(0, "b!"), (1, "c!")]
    assert calls() == {("a", "0.7"): 1, ("b", "0.7"): 1, ("c", "0.7"): 1}
    Ledger(spark, str(tmp_path / "ledger"), "another").answered(rows(spark, "a"), F.col("p"), call)
    assert calls()["a", "0.7"] == 2
    assert ledger.waits().first().n == 4
    assert not (tmp_path / "ledger" / "notes").exists() or not any((tmp_path / "ledger" / "notes").iterdir())


def test_second_tries_timeouts_and_errors(spark, tmp_path):
    def answer(prompt, warmth):
        if prompt == "slow":
            time.sleep(30)
        if prompt == "down":
            raise OSError("no server")
        return json.dumps({"ok": 1}) if warmth < 0.5 and prompt == "cool" else "not json"

    call, calls = counted(tmp_path / "calls", answer)
    ledger = Ledger(spark, str(tmp_path / "ledger"), "m")
    got = ledger.answered(rows(spark, "cool", "slow", "down", "bad"), F.col("p"), call, accept=lambda x: x.startswith("{"), timeout=1.0)
    found = {r.p: r for r in got.collect()}
    assert (found["cool"].answer, found["cool"].tries, found["cool"].error) == ('{"ok": 1}', 2, None)
    assert "TimeoutError" in found["slow"].error and found["slow"].answer is None
    assert "no server" in found["down"].error and found["down"].tries == 2
    assert (found["bad"].answer, found["bad"].error) == ("not json", "not accepted")
    good, _ = counted(tmp_path / "calls", lambda p, t: "{}")
    now = {r.p: r.error for r in ledger.answered(rows(spark, "cool", "down", "bad"), F.col("p"), good).collect()}
    assert now == {"cool": None, "down": None, "bad": None}
    assert calls()["cool", "0.7"] == 1 and calls()["down", "0.7"] == 2


RETRY = """
import sys; sys.path.insert(0, {root!r})
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from lectio.functions.tables import written
from lectio.operators import package, planning, prompts
from lectio.operators.ledger import Ledger
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def call(prompt, warmth):
    import uuid
    Path({calls!r} + "/" + uuid.uuid4().hex).write_text(prompt)
    once = Path({calls!r}).parent / "failed"
    if prompt == "p17" and not once.exists():
        once.write_text("x")
        raise RuntimeError("the executor goes down")
    return prompt + "!"

rows = spark.createDataFrame([(k, f"p{{k}}") for k in range(40)], "doc_id long, p string")
got = Ledger(spark, {ledger!r}, "m").answered(rows, F.col("p"), call, at_once=3, partitions=2)
assert sorted((r.doc_id, r.answer) for r in got.collect()) == [(k, f"p{{k}}!") for k in range(40)]
"""


def test_a_retried_task_asks_nothing_twice(tmp_path):
    (tmp_path / "calls").mkdir()
    root = str(Path(__file__).resolve().parents[1])
    code = RETRY.format(root=root, calls=str(tmp_path / "calls"), ledger=str(tmp_path / "ledger"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    calls = Counter(f.read_text() for f in (tmp_path / "calls").iterdir())
    assert (tmp_path / "failed").exists()
    assert calls.pop("p17") == 2 and set(calls.values()) == {1} and len(calls) == 39


ANSWER = json.dumps({"main_topic": "Molinos", "definitions": [{"term": "Turbina", "definition": "máquina que convierte el viento en electricidad"}]})
PLAN = json.dumps({"presentation_title": "Molinos de hoy", "slides": [{"title": f"Parte {k}", "kind": "definition", "atom_ids": ["def:turbina"], "enfoque": f"idea {k}"} for k in range(4)]})
TEXT = "# Viento\n**Turbina**: máquina que convierte el viento en electricidad útil."


def test_the_engine_with_second_tries(spark, tmp_path):
    """A model whose first answers can't be read: behind a ledger, and as a text function with a cooler form."""
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    call, calls = counted(tmp_path / "calls", lambda p, t: ANSWER if t < 0.5 else "no idea")
    asked = package.Asked(Ledger(spark, str(tmp_path / "ledger"), "m"), call, accept=lambda x: x.startswith("{"))
    kb, atoms = package.knowledge_base(docs, package.Models(knowledge=asked))
    assert kb.first().main_topic == "Molinos" and atoms.filter("definition LIKE '%electricidad'").count() == 1
    assert sorted(t for _, t in calls()) == ["0.2", "0.7"]
    package.knowledge_base(docs, package.Models(knowledge=asked))
    assert sum(calls().values()) == 2

    cooled = prompts.text_function(lambda p: "no idea", wait=0, cooler=lambda p: PLAN)
    kb, atoms = (written(x, "x") for x in package.knowledge_base(docs))  # as study() has them
    plan, _, _, titles = package.deck_of(kb, atoms, package.Models(slide_plan=cooled))
    assert titles.first().title == "Molinos de hoy" and "Parte 0" in [r.title for r in plan.collect()]
    stubborn = prompts.text_function(lambda p: "no idea", wait=0, cooler=lambda p: "nothing")
    plan, _, _, titles = package.deck_of(kb, atoms, package.Models(slide_plan=stubborn))
    assert titles.first().title == "Viento" and plan.count() >= 3


def test_titles_and_focus_of_a_models_plan(spark):
    answers = spark.createDataFrame([(1, PLAN), (2, json.dumps({"plan": {"slides": [{"title": "x y"}]}})), (3, "nothing"), (4, json.dumps({"output": {"titulo": "En español", "diapositivas": []}}))], "doc_id long, payload string")
    kb = spark.createDataFrame([(d, f"Tema {d}") for d in (1, 2, 3, 4)], "doc_id long, main_topic string")
    assert {r.doc_id: r.title for r in planning.titles_from_answers(answers, kb).collect()} == {1: "Molinos de hoy", 2: "Tema 2", 3: "Tema 3", 4: "En español"}
    assert [r.focus for r in planning.slide_plan_from_answers(answers).orderBy("slide_index").collect()] == [f"idea {k}" for k in range(4)]


def test_text_functions_give_up_on_time(spark):
    slow = prompts.text_function(lambda p: time.sleep(20) or p, attempts=1, wait=0, timeout=0.5)
    began = time.monotonic()
    assert spark.createDataFrame([("a",)], "p string").select(slow(F.col("p")).alias("x")).first().x is None
    assert time.monotonic() - began < 15

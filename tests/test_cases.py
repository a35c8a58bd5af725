"""Cases that the tables don't have, each with its result as SQL writes it down: text functions, Markdown, models' answers and
plans, ids, judges' files."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.functions.text import clean_option, entity, file_stem, json_body, path_name, safe_double, slug, split_camel
from lectio.operators import chunking, deck, extract, knowledge, planning, review, runs
from lectio.sources.records import flat_scores


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _check(spark: SparkSession, cases: list[str], f: Column) -> DataFrame:
    return _rows(spark, list(enumerate(cases)), "i long, c string").select("i", f.cast("string").alias("result"))


def fixture_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions on cases that the tables don't have."""
    c = F.col("c")
    parts = {
        "camel": (["BicicletaDeMontaña", "sinCambio ya"], entity(split_camel(c))),
        "slug": (["Energía Eólica", "Poo: Orientación a Objetos", "¿¡!?"], slug(c)),
        "option": (["Hereda de A (correcto)", "Usa estado (Comparte todos los campos heredados)", "Ya acaba.", "Hija (hija)"], clean_option(c)),
        "file": (["gemma3:4b", "  ", "a/b  c--d"], file_stem(c)),
        "path": (["gemma3:4b", "a/b c"], path_name(c)),
        "number": (["True", "", "x", "2.5", "nan"], safe_double(c)),
        "preamble": (["Según el texto, ¿qué es una clase?", "¿Qué es una clase?"], review.stripped_preamble(c)),
        "relation": (["subclase_de", "related_to", ""], knowledge.relation_phrase(c)),
        "json": (['Claro:\n```json\n{"a": 1}\n```\nfin', "nada"], json_body(c)),
        "bullet": (["En esta diapositiva se resumen las ideas.", "Una clase agrupa objetos que comparten estado y conducta,·", "Una clase agrupa objetos que comparten estado y conducta.", "corto."], deck.clean_bullet(c)),
        "kind": (["Ejemplo", "raro"], planning.question_kind(c, F.lit("analizar"))),
    }
    out = None
    for name, (cases, f) in parts.items():
        rows = _check(spark, cases, f).select(F.lit(name).alias("operator"), "i", "result")
        out = rows if out is None else out.unionByName(rows)
    return out


def fixture_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code fences, bold definitions, tables and chunks."""
    docs = _rows(spark, [(1, "# A\nx\n## B\ny"), (2, "**Objeto**: entidad con estado propio.\n\n```python\nx = 1\n```\n"), (3, "|a|b|\nmore\n\ntext"), (4, "z" * 7000)], "doc_id long, text string")
    s = lambda df, name, *c: df.select(F.lit(name).alias("operator"), "doc_id", F.concat_ws("|", *c).alias("result"))
    return (
        s(chunking.chunks(docs), "chunk", F.col("chunk_index"), F.char_length("text"))
        .unionByName(s(extract.definitions(docs), "definition", "term", "definition"))
        .unionByName(s(extract.code_blocks(docs), "code", "language", "content"))
        .unionByName(s(chunking.repaired_tables(docs.filter("doc_id = 3")), "table", F.col("line_index"), "line"))
    )


ANSWER = """Respuesta: ```json
{"tema": "Energía", "definiciones": [{"termino": "Turbina", "definicion": "máquina que gira"}, {"definicion": "sin término"}, {"nombre": "Turbina", "descripcion": "otra"}],
 "examples": [{"name": "ParqueEólico", "attributes": ["viento", "coral"], "methods": "girar; volar"}], "datos": [{"valor": 42, "descripcion": "por ciento"}],
 "relations": [{"from": "Turbina", "to": "viento", "type": "usa"}, {"from": "Turbina", "to": "Marte"}]}
```"""


def fixture_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer read into atoms, those without ground in the text dropped, new definitions added."""
    docs = _rows(spark, [(1, "El parque eólico usa el viento. La turbina puede girar.\n**Rotor**: parte que gira con el viento.")], "doc_id long, text string")
    _, atoms = knowledge.from_answers(_rows(spark, [(1, ANSWER)], "doc_id long, payload string"))
    found = knowledge.enriched(knowledge.grounded(atoms, docs), docs)
    return found.select("atom_id", F.concat_ws("|", "term", "definition", "name", "description", "value", "rel_kind", F.array_join("attributes", ","), F.array_join("methods", ",")).alias("result"))


QUIZ_PLAN = """{"plan": {"preguntas": [{"nivel": "understand", "concepto": "DEF:Turbina", "tipo": "definition"}, {"concept": "def:roto"}, {"nivel": "crear"}, {"bloom": "raro", "ref": "ex:parque", "kind": "???"}]}}"""
SLIDE_PLAN = """```json
{"slides": [{"titulo": "las_turbinas", "tipo": "Definición", "atomos": "DEF:Turbina; def:zz"}, {"title": "Partes", "kind": "proceso", "atom_ids": ["def:rotor_del_eje", "def:rotor_del_eje"]}, {"kind": "intro"}, {"heading": "Mapa", "layout": "mapa"}]}
```"""


def fixture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's plans read, their ids matched with those of atoms."""
    atoms = knowledge.as_atoms(_rows(spark, [(1, "def", 1, "def:turbina", "Turbina"), (1, "def", 2, "def:roto_del_eje", "Rotor"), (1, "ex", 1, "ex:parque", "Parque")], "doc_id long, kind string, pos int, atom_id string, term string"))
    answer = lambda text: _rows(spark, [(1, text)], "doc_id long, payload string")
    asked = planning.sanitized_quiz_plan(planning.quiz_plan_from_answers(answer(QUIZ_PLAN)), atoms)
    listed = planning.sanitized_quiz_plan(planning.quiz_plan_from_answers(answer('[{"concept_id": "def:turbina", "level": "recordar"}]')), atoms)
    slides = planning.slide_plan_from_answers(answer(SLIDE_PLAN))
    s = lambda df, name, i, *c: df.select(F.lit(name).alias("plan"), F.col(i).cast("long").alias("i"), F.concat_ws("|", *c).alias("result"))
    return s(asked, "quiz", "question_id", "bloom", "concept_id", "kind").unionByName(s(listed, "list", "question_id", "bloom", "concept_id", "kind")).unionByName(s(slides, "slides", "slide_index", "title", "kind", F.array_join("atom_ids", ",")))


def fixture_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that clash, long terms, kinds of formulas, and bounds of a model's atoms."""
    docs = _rows(spark, [(1, "**Rotor 2**: parte que gira con el viento.\n**Rotor!**: parte que gira en la torre.\n**Rotor?**: parte que gira en el agua.")], "doc_id long, text string")
    literal = knowledge.fallback_atoms(docs).select("pos", F.col("atom_id").alias("id"), F.lit("").alias("result"))
    long = "Energía: " + "fuerza que mueve las cosas " * 6
    rows = [{"term": long.strip(), "definition": "con nombre propio"}, {"term": "x", "definition": "y" * 601}]
    codes = [{"content": "for i in 1..n: s = s + i"}, {"content": "E = m * 2"}, {"content": "x" * 2001}]
    payload = json.dumps({"definitions": rows, "formulas": codes, "subtemas": "uno; dos", "conclusiones": ["fin", " "]}, ensure_ascii=False)
    kb, atoms = knowledge.from_answers(_rows(spark, [(1, payload)], "doc_id long, payload string"))
    told = atoms.select((F.col("pos") + 10).alias("pos"), F.left("atom_id", F.lit(12)).alias("id"), F.coalesce(F.concat_ws("|", "term", F.right("definition", F.lit(30))), F.lit("")).alias("result")).filter("id LIKE 'def%'")
    kinds = atoms.filter("kind = 'fc'").select((F.col("pos") + 20).alias("pos"), F.lit("fc").alias("id"), F.col("fc_kind").alias("result"))
    lists = kb.select(F.lit(30).alias("pos"), F.lit("kb").alias("id"), F.concat_ws("|", F.array_join("subtopics", ","), F.array_join("conclusions", ",")).alias("result"))
    return literal.unionByName(told).unionByName(kinds).unionByName(lists)


def fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' files in their three shapes, and the means over them."""
    body = '"overall": {"score": 4, "comment": "x"}, "clarity": {"score": 5, "comment": "y"}, "summary_comment": "z"'
    meta = '"metadata": {"model_used": "m:%d", "pdf_source": "A.PDF"}'
    rows = [("quiz", "{%s, %s}" % (meta % 1, body)), ("quiz", '{%s, "quiz_evaluation": {%s}}' % (meta % 1, body)), ("pptx", '{%s, "evaluation_presentation": {%s}}' % (meta % 2, body))]
    return runs.score_means(flat_scores(_rows(spark, rows, "artifact string, value string")))


_d = lambda v, t="VARCHAR": ", ".join("(" + ", ".join("NULL" if x is None else ("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)) for x in r) + ")" for r in v)
EXPECTED_TEXT = [
    ("camel", 0, "bicicleta de montana"), ("camel", 1, "sin cambio ya"), ("slug", 0, "energia_eolica"), ("slug", 1, "orientacion_a_objetos"), ("slug", 2, "item"),
    ("option", 0, "Hereda de A."), ("option", 1, "Usa estado."), ("option", 2, "Ya acaba."), ("option", 3, "Hija (hija)."), ("file", 0, "gemma3-4b"), ("file", 1, "salida"), ("file", 2, "a-b_c-d"), ("path", 0, "gemma3_4b"), ("path", 1, "a_b_c"),
    ("number", 0, "1.0"), ("number", 1, None), ("number", 2, None), ("number", 3, "2.5"), ("number", 4, None), ("preamble", 0, "¿Qué es una clase?"), ("preamble", 1, "¿Qué es una clase?"),
    ("relation", 0, "es subclase de"), ("relation", 1, "related to"), ("relation", 2, "se relaciona con"), ("json", 0, '{"a": 1}'), ("json", 1, None),
    ("bullet", 0, None), ("bullet", 1, None), ("bullet", 2, "Una clase agrupa objetos que comparten estado y conducta."), ("bullet", 3, None), ("kind", 0, "caso_practico"), ("kind", 1, "comparacion"),
]
EXPECTED_MARKDOWN = [
    ("chunk", 1, "0|13"), ("chunk", 2, "0|59"), ("chunk", 3, "0|16"), ("chunk", 4, "0|3000"), ("chunk", 4, "1|3252"), ("chunk", 4, "2|1252"),
    ("definition", 2, "Objeto|entidad con estado propio."), ("code", 2, "python|x = 1"), ("table", 3, "0||a|b| more"), ("table", 3, "1|"), ("table", 3, "2|text"),
]
EXPECTED_ANSWER = [
    ("def:turbina", "Turbina|máquina que gira"), ("def:turbina_2", "Turbina|Concepto: Turbina"), ("ex:parqueeolico", "ParqueEólico|Ejemplo: ParqueEólico|viento|girar"), ("dt:42", "por ciento|42"), ("rel:turbina", "usa"), ("def:rotor", "Rotor|parte que gira con el viento."),
]
EXPECTED_PLAN = [
    ("quiz", 1, "comprender|def:turbina|definicion"), ("quiz", 2, "comprender|def:roto_del_eje|definicion"), ("quiz", 3, "analizar|ex:parque|comparacion"),
    ("list", 1, "recordar|def:turbina|definicion"), ("slides", 1, "las_turbinas|definition|DEF:Turbina,def:zz"), ("slides", 2, "Partes|process|def:rotor_del_eje"), ("slides", 3, "Mapa|outlook|"),
]
EXPECTED_IDS = [
    (1, "def:rotor_2", ""), (2, "def:rotor", ""), (3, "def:rotor_3", ""), (10, "def:energia", "Energía|mueve las cosas con nombre propio"[:8] + ("fuerza que mueve las cosas " * 6 + "con nombre propio")[-30:]),
    (20, "fc", "code"), (21, "fc", "formula"), (30, "kb", "uno,dos|fin"),
]

RESULTS = {
    "fixture_plan": f"SELECT * FROM (VALUES {_d(EXPECTED_PLAN)}) AS t(plan, i, result)",
    "fixture_ids": f"SELECT * FROM (VALUES {_d(EXPECTED_IDS)}) AS t(pos, id, result)",
    "fixture_text": f"SELECT * FROM (VALUES {_d(EXPECTED_TEXT)}) AS t(operator, i, result)",
    "fixture_markdown": f"SELECT * FROM (VALUES {_d(EXPECTED_MARKDOWN)}) AS t(operator, doc_id, result)",
    "fixture_answer": f"SELECT * FROM (VALUES {_d(EXPECTED_ANSWER)}) AS t(atom_id, result)",
    "fixture_scores": "SELECT * FROM (VALUES ('m:1', 'quiz', 'overall', 2, 4.0::DOUBLE), ('m:1', 'quiz', 'clarity', 2, 5.0), ('m:2', 'pptx', 'overall', 1, 4.0), ('m:2', 'pptx', 'clarity', 1, 5.0)) AS t(model, artifact, criterion, n, mean_score)",
}


@pytest.mark.parametrize("name", [*RESULTS])
def test_cases(spark, name):
    a, b = globals()[name](spark, "").toPandas(), duckdb.sql(RESULTS[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    shown = lambda d: d[cols].astype(object).where(d[cols].notna(), None).map(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(shown(a), shown(b))

"""Operators of the study-material engine on small inputs, and queries against their SQL."""

import hashlib
import json
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectio.functions.text import TOKEN3, entity, entity_in, humanized, slug, tokens, truncated, unaccented
from lectio.operators import chunking, deck, extract, knowledge, metrics, package, planning, prompts, quiz, review, runs, simjoin
from lectio.plans import registry
from lectio.sources import documents, records, reports

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["deck_json", "doc_without_hints", "doc_token_top", "doc_key_terms", "doc_definitions", "doc_chunks", "doc_near_dup", "passage_containment", "page_topic", "page_sections", "kb_atoms", "quiz_questions", "run_upsert", "run_averages", "criteria_template", "conversation_last5", "label_means", "deck_metrics", "study_record", "quiz_exam", "deck_rows", "slide_review", "kb_document", "slide_plan_sanitized", "bullet_clean"]


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i").select(column).collect()]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{SF}/{t}.parquet') else ''}'")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    shown = lambda d: d[cols].astype(object).where(d[cols].notna(), None).map(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(shown(a), shown(b))


def test_last_turns_are_whole(spark, tmp_path):
    """Texts that differ after their first 40 characters give different results."""
    rows = [(c, turn, "user", "x" * 60 + end) for c, end in ((1, "a"), (2, "b")) for turn in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.before_md5 for r in registry.QUERIES["conversation_last5"](spark, str(tmp_path)).collect()}
    assert got[1, 1] != got[2, 1] and got[1, 1] == hashlib.md5(("- [user] " + "x" * 60 + "a").encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_near_dup_members_against_sql(spark):
    test_query_against_sql(spark, "doc_near_dup_members")


def test_near_dup_members(spark, tmp_path):
    """Every document is there: copies in other case, order or spacing, single ones, and those without tokens."""
    texts(spark, "Perro gato", "gato  PERRO gato", "pájaro", "", None).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["doc_near_dup_members"](spark, str(tmp_path)).select("doc_id", "class_id", "n").collect()))
    assert got == [(0, 0, 2), (1, 0, 2), (2, 2, 1), (3, 3, 2), (4, 3, 2)]


def test_entry_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text(spark):
    assert one(spark, slug(F.col("c")), "a" * 39 + " bcd") == ["a" * 39 + "_"]
    assert one(spark, humanized(F.col("c")), "poo_y_java", "uml-avanzado", "UML") == ["POO Y Java", "Uml Avanzado", "UML"]
    assert one(spark, truncated(F.col("c"), 6), "abc  def", "ab") == ["abc d…", "ab"]
    assert one(spark, tokens(F.col("c"), TOKEN3, ["del"]), "Él ñandú DEL Ñandú y árbol") == [["nandu", "arbol"]]
    md = entity(F.lit("La bicicleta de montaña corre."))
    assert one(spark, entity_in(F.col("c"), md), "BicicletaDeMontaña", "tademon", "coche", "", None) == [True, True, False, False, False]


def test_chunks_cover_and_overlap(spark):
    r = random.Random(1)
    docs = ["\n".join(r.choice(["# T", "", "x" * r.randrange(1, 40), "y " * r.randrange(30)]) for _ in range(r.randrange(60))) for _ in range(40)] + ["", None]
    for text in docs:
        raw = list(chunking.pieces(text or "", 100))
        assert "".join("".join(raw).split()) == "".join((text or "").split())
        assert all(len(p) <= 100 for p in raw)
    got = chunking.chunks(texts(spark, *docs), 100, 10).toPandas()
    for i, text in enumerate(docs):
        raw, rows = list(chunking.pieces(text or "", 100)), got[got.doc_id == i].sort_values("chunk_index").text.tolist()
        assert rows == [p if not k else raw[k - 1][-10:] + "\n\n" + p for k, p in enumerate(raw)]


def test_hints(spark):
    docs = texts(spark, "Se llama Polea a una rueda con ranura.\nEk = m * 2\nclave=valor sin carga\n# Índice\n## La Fuerza\n**Fuerza** y **la masa**", None, "")
    assert extract.definitions(docs).select("term").collect() == [("Polea",)]
    assert [r.content for r in extract.formulas(docs).collect()] == ["Ek = m * 2"]
    assert [r.term for r in extract.key_terms(docs).orderBy("n").collect()] == ["Fuerza", "masa"]
    assert "### Definiciones" in extract.hint_block(docs).first().block
    assert knowledge.topics(docs).filter("doc_id = 0").first().main_topic == "La Fuerza"
    assert [r.subtopic for r in knowledge.subtopics(docs).filter("doc_id = 0").collect()] == ["La Fuerza"]


def atoms_of(spark):
    rows = [
        ("def", 1, "def:a", {"term": "Alfa", "definition": "una letra del alfabeto griego antiguo", "subtopic": "letras"}),
        ("def", 2, "def:b", {"term": "Beta", "definition": "segundo signo de cierta escritura clásica", "subtopic": "letras"}),
        ("ex", 1, "ex:c", {"name": "Carta", "description": "texto escrito con letras", "subtopic": "usos"}),
        ("rel", 1, "rel:d", {"source": "Carta", "rel_kind": "usa", "target": "Alfa", "subtopic": "usos"}),
        ("dt", 1, "dt:e", {"value": "24", "description": "letras del alfabeto"}),
        ("fc", 1, "fc:f", {"fc_kind": "formula", "content": "a = b"}),
    ]
    fields = [c for c in knowledge.TEXTS]
    data = [(1, k, p, i, *(f.get(c) for c in fields), ["x", "y"] if k == "ex" else None, None) for k, p, i, f in rows]
    return spark.createDataFrame(data, "doc_id long, kind string, pos int, atom_id string, " + ", ".join(f"{c} string" for c in fields) + ", attributes array<string>, methods array<string>")


def test_quiz_and_deck(spark):
    atoms = atoms_of(spark).cache()
    kb = spark.createDataFrame([(1, "Alfabetos")], "doc_id long, main_topic string")
    plan = planning.quiz_plan(atoms)
    assert [r.concept_id for r in plan.orderBy("question_id").collect()] == ["def:a", "def:b", "ex:c", "rel:d", "fc:f", "dt:e", "def:a", "def:b"]
    asked = quiz.questions(plan, atoms).cache()
    assert asked.filter("concept_id = 'rel:d'").first().options.A == "Carta usa Alfa (así consta en la base)."
    vocab = review.vocabulary(atoms, kb)
    issues = review.quiz_issues(asked, vocab)
    assert {(r.question_id, r.issue) for r in issues.filter("severity = 'high'").collect()} == {(7, "duplicate"), (8, "duplicate")}
    assert review.refined_quiz(asked, issues).count() == 6
    assert review.unused_concepts(asked.filter("concept_id <> 'dt:e'"), atoms).first().atom_id == "dt:e"
    m = metrics.quiz_metrics(asked, atoms).first()
    assert (m.num_questions, m.duplicate_pairs, m.kb_term_coverage) == (8, 2, 1.0)
    assert quiz.graded(asked, asked.select("doc_id", "question_id", F.lit("a").alias("answer"))).first().score == 1.0
    assert [r.related_id for r in quiz.related(atoms).filter("atom_id = 'ex:c'").orderBy("n").collect()][:1] == ["rel:d"]
    answers = spark.createDataFrame([(1, 1, json.dumps({"question": "¿Una pregunta larga?", "options": {x: x for x in "ABCD"}, "correct_answer": "b", "justification": "porque es así"})), (1, 2, "nada")], "doc_id long, question_id int, payload string")
    mixed = {r.question_id: r for r in quiz.from_answers(answers, plan, atoms).collect()}
    assert mixed[1].correct == "B" and mixed[1].options.C == "C." and mixed[2].correct == "A" and len(mixed) == 8
    slides = planning.slide_plan(kb, atoms)
    assert [(r.title, r.kind) for r in slides.orderBy("slide_index").collect()] == [("Introducción", "intro"), ("Letras", "definition"), ("Usos", "example")]
    shown = deck.bullets(slides, atoms, kb)
    assert shown.filter("bullet LIKE 'Alfa:%'").count() == 1
    dm = metrics.deck_metrics(slides, shown).first()
    assert dm.num_slides_total == dm.num_content_slides + 2
    assert review.slide_issues(shown, slides, vocab).filter("issue = 'not_grounded'").count() == 0
    assert deck.deck_rows(kb, slides, shown).filter("section = 'index'").count() == dm.num_content_slides
    assert planning.id_lists(atoms).filter("prefix = 'def'").first().ids == "def:a, def:b"
    assert knowledge.by_subtopic(atoms).filter("subtopic = 'letras'").first().atom_ids == ["def:a", "def:b"]


def test_sanitized_slides(spark):
    atoms = atoms_of(spark)
    rows = [(1, 1, "intro", "intro", []), (1, 2, "las letras", "definition", ["DEF:A", "def:nada"]), (1, 3, "Las Letras", "example", ["ex:c"]), (1, 4, "Intro otra", "intro", []), (1, 5, "usos varios", "example", []), (1, 6, "fin", "conclusion", []), (1, 7, "datos", "outlook", ["dt:e"])]
    got = planning.sanitized_slide_plan(spark.createDataFrame(rows, "doc_id long, slide_index int, title string, kind string, atom_ids array<string>"), atoms).orderBy("slide_index").collect()
    assert [(r.title, r.kind, r.atom_ids) for r in got] == [("Intro", "intro", []), ("Las Letras", "definition", ["def:a"]), ("Usos Varios", "example", ["ex:c", "def:b", "fc:f"]), ("Datos", "outlook", ["dt:e"])]


def test_bullets(spark):
    long = "Una frase que acaba pronto. " + "y sigue sin parar " * 12
    assert one(spark, deck.clean_bullet(F.col("c"), F.lit("La Clase")), "La clase: agrupa objetos con estado propio.", "Sirve para ilustrar la herencia de clases.", long, "def:x algo bastante largo para contar.", "Termina mal con la preposición de.") == [None] * 5
    same = [(1, 1, k, t) for k, t in enumerate(["El viento mueve la turbina grande.", "el  viento mueve la turbina grande.", "La turbina grande mueve el viento.", "Otra idea distinta que no repite nada."])]
    rows = spark.createDataFrame(same, "doc_id long, slide_index int, bullet_index int, bullet string")
    assert deck.balanced(rows).count() == 3
    assert [r.bullet for r in deck.unrepeated(rows).orderBy("bullet_index").collect()] == [same[0][3], same[3][3]]
    fonts = spark.createDataFrame([(8, 10.0), (9, 10.0), (14, 10.0), (9, 60.0), (9, 80.0), (90, 80.0)], "n int, c double").select(deck.index_font(F.col("n"), F.col("c"))).collect()
    assert [f[0] for f in fonts] == [20.0, 19.25, 15.5, 17.75, 16.25, 9.0]


def test_similar_pairs(spark):
    r = random.Random(4)
    sets = [sorted(set(r.choices(range(14), k=r.randrange(1, 8)))) for _ in range(80)]
    for t in (0.5, 0.7, 0.9):
        df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)] + [(99, [])], "id long, tokens array<string>")
        got = {(x.a, x.b) for x in simjoin.similar_pairs(df, t).collect()}
        assert got == {(i, j) for j in range(80) for i in range(j) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= t - 1e-9}


def test_sources_and_runs(spark, tmp_path):
    record = {"pdf_id": "a", "model": "m", "status": "ok", "error": "x\ny", "timings": {"total_s": 1.5}, "quiz_metrics": {"num_questions": 7}}
    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "metrics.json").write_text(json.dumps(record))
    (tmp_path / "1" / "bad.json").write_text("{")
    flat = runs.flat(records.run_records(spark, str(tmp_path / "1" / "*.json")))
    assert [(r.pdf_id, r.error, r.time_total_s, r.quiz_num_questions) for r in flat.collect()] == [("a", "x y", 1.5, 7)]
    assert runs.judging_template(flat).count() == 8
    records.write_summary_csv(flat, str(tmp_path / "csv"))
    assert records.summary_csv(spark, str(tmp_path / "csv")).first().pdf_id == "a"
    (tmp_path / "c.json").write_text(json.dumps({"pdfs": [{"id": "x", "filename": "x.pdf"}, {"id": " ", "filename": "y"}]}))
    catalog = records.catalog(spark, str(tmp_path / "c.json"))
    assert catalog.count() == 1 and runs.run_matrix(catalog, ["m", "n"]).count() == 2 and runs.requested(catalog, [catalog.first().id]).first().place == 1
    pages = spark.createDataFrame([(1, "x" * 50), (1, ""), (2, ""), (2, "y"), (2, None), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.scanned for r in documents.scanned(pages).collect()} == {1: False, 2: True}
    assert [r.error_kind for r in documents.admitted(texts(spark, "", "a")).orderBy("doc_id").collect()] == ["empty", None]
    images = spark.createDataFrame([(1, 1, 1, 0.1, 10.0, 20.0), (1, 1, 2, 0.001, 0.0, 1.0)], "doc_id long, page int, image int, share double, y0 double, y1 double")
    blocks = spark.createDataFrame([(1, 1, 1, 22.0, 30.0, "pie de la figura"), (1, 1, 2, 90.0, 99.0, "otro texto lejano")], "doc_id long, page int, block int, y0 double, y1 double, text string")
    assert [r.caption for r in documents.captions(images, blocks).collect()] == ["pie de la figura"]
    sized = images.withColumn("width", F.lit(320.7)).withColumn("height", F.lit(200.0))
    assert [r.caption for r in documents.captions(sized, blocks).collect()] == ["[p.1, 320x200] pie de la figura"]
    nearer = blocks.unionByName(spark.createDataFrame([(1, 1, 3, 20.5, 21.0, "Fig. 1"), (1, 1, 4, 20.1, 21.0, "  ")], blocks.schema))
    assert documents.captions(images, nearer).collect() == []  # the nearest block with text is too short
    assert sorted(map(tuple, documents.image_counts(spark.createDataFrame([(1, 2), (1, None), (2, None)], "doc_id long, images int")).collect())) == [(1, 2), (2, 0)]


def test_reports(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = [("a", "m:1", "ok", (7,)), ("a", "m/2 x", "error", None), ("b:c", "m:1", "ok", (9,))]
    given = spark.createDataFrame(rows, "pdf_id string, model string, status string, quiz_metrics struct<num_questions: int>")
    reports.write_records(given, at("runs"))
    assert sorted(p.parent.name + "/" + p.name for p in (tmp_path / "runs").glob("*/*") if p.is_dir()) == ["run_pdf=a/run_model=m_1", "run_pdf=a/run_model=m_2 x".replace(" ", "_"), "run_pdf=b_c/run_model=m_1"]
    reports.write_records(given.filter("pdf_id = 'a' AND status = 'ok'").withColumn("quiz_metrics", F.struct(F.lit(8).alias("num_questions"))), at("runs"))
    back = reports.written_records(spark, at("runs"), records.RECORD)
    assert sorted((r.pdf_id, r.model, r.quiz_metrics and r.quiz_metrics.num_questions) for r in back.collect()) == [("a", "m/2 x", None), ("a", "m:1", 8), ("b:c", "m:1", 9)]
    places = reports.write_reports(runs.flat(back), at("reports"))
    assert records.summary_csv(spark, places["summary"]).count() == 3
    assert [(r.model, r.runs_ok, r.quiz_num_questions) for r in records.report_csv(spark, places["model_averages"]).collect()] == [("m:1", "2", "8.5")]
    assert {r.execution_id for r in records.report_csv(spark, places["manual_template"]).collect()} == {"a__m_1", "b:c__m_1"}
    lines = [r.value for r in spark.read.text(places["rubric"]).collect()]
    assert lines == [r.line for r in reports.rubric(spark).orderBy("n").collect()] and len(lines) == 1 + 2 + 8 + 2 + 7
    asked = reports.eval_prompts(spark.createDataFrame([("a", "T", "m:1", "{q}", None)], "pdf_id string, pdf_title string, model string, quiz string, deck string")).collect()
    assert [(r.execution_id, r.artifact) for r in asked] == [("a__m_1", "quiz")] and asked[0].prompt.endswith("{q}") and "T (a), m:1" in asked[0].prompt


def test_judges_files(spark, tmp_path):
    """Criteria at the top or in a wrapper; the artifact is in the file's name; comments and metadata are no criteria."""
    meta = {"metadata": {"model_used": "m:1", "pdf_source": "Doc.pdf"}}
    one, two = {"overall": {"score": 4, "comment": "x"}}, {"overall": {"score": 5, "comment": "y"}, "clarity": {"score": "3"}}
    (tmp_path / "Doc_quiz_1b.json").write_text(json.dumps(meta | one | {"summary_comment": "z"}))
    (tmp_path / "Doc_quiz_2b.json").write_text(json.dumps(meta | {"quiz_evaluation": two}))
    (tmp_path / "Doc_pptx_1b.json").write_text(json.dumps(meta | {"presentation_evaluation": one}))
    got = runs.score_means(records.judge_scores(spark, str(tmp_path / "*.json")))
    assert sorted(map(tuple, got.collect())) == [("m:1", "pptx", "overall", 1, 4.0), ("m:1", "quiz", "clarity", 1, 3.0), ("m:1", "quiz", "overall", 2, 4.5)]


def test_no_hints(spark):
    docs = texts(spark, "Se llama Polea a una rueda con ranura.", "nada", "", None, "```\nx = 1\n```", "**Fuerza**", "nada")
    assert sorted(r.doc_id for r in extract.without_hints(docs).collect()) == [1, 2, 3, 6]


def test_text_function(spark):
    chunked = chunking.chunks(texts(spark, "a" * 10)).transform(prompts.map_prompts)
    calls = prompts.text_function(lambda p: str(len(p)), wait=0)
    assert chunked.select(calls(F.col("prompt")).alias("x")).first().x.isdigit()

    def fails(prompt):
        raise OSError

    assert chunked.select(prompts.text_function(fails, wait=0)(F.col("prompt")).alias("x")).first().x is None
    assert "overall" in spark.range(1).select(prompts.judge_prompt("quiz", F.lit("s"), F.lit("c"))).first()[0]


LESSON = """# Energía eólica
**Turbina**: máquina que convierte el viento en electricidad útil.
**Rotor**: parte giratoria que mueve el eje de la máquina principal.
**Góndola**: caja que protege el generador y los engranajes de la torre.
El parque Tramontana usa turbinas de tres palas.
"""


def test_study_without_a_model(spark):
    docs = texts(spark, LESSON, None, "  ", "sin conceptos aquí")
    m = package.study(docs)
    record = {r["doc_id"]: r for r in m.record.collect()}
    assert {k: (r["status"], r["error_kind"], r["kb_atoms"]) for k, r in record.items()} == {0: ("ok", None, 3), 1: ("error", "empty", 0), 2: ("error", "empty", 0), 3: ("error", "no_atoms", 0)}
    asked = m.quiz.orderBy("question_id").collect()
    assert [q["question_id"] for q in asked] == [1, 2, 3] and len({q["concept_id"] for q in asked}) == 3
    assert review.quiz_issues(m.quiz, review.vocabulary(m.atoms, m.kb)).filter("severity = 'high'").count() == 0
    assert record[0]["num_questions"] == 3 and record[0]["duplicate_pairs"] == 0 and record[0]["num_content_slides"] == m.deck.filter("section = 'content' AND line_no = 0").count() > 0
    assert m.plan.orderBy("slide_index").first()["kind"] == "intro" and m.conclusions.count() == 0
    assert [(r.stage, r.n_rows) for r in m.stages.orderBy("n").collect()][:4] == [("taken", 4), ("atoms", 3), ("topics", 1), ("quiz", 3)] and m.stages.filter("seconds <= 0").count() == 0
    assert package.study(docs.limit(0)).record.count() == 0
    bare = planning.topic_plan(docs.selectExpr("doc_id", "'x' AS main_topic"), m.atoms).collect()
    assert sorted(r.doc_id for r in bare) == [1, 2, 3] and {(r.question_id, r.concept_id) for r in bare} == {(1, "main_topic")}


def test_accents_of_all_alphabets(spark):
    assert one(spark, unaccented(F.col("c")), "Ελληνικά", "йод", "cafe\u0301", "ñandú", "Việt", "plain", "日本") == ["Ελληνικα", "иод", "cafe", "nandu", "Viet", "plain", "日本"]


def test_study_with_a_model(spark):
    kb = json.dumps({"main_topic": "Viento", "definitions": [{"term": "Turbina", "definition": "máquina que convierte el viento"}], "examples": [{"name": "Tramontana", "description": "un parque", "attributes": ["palas", "coral"]}, {"name": "Marte"}]})
    question = json.dumps({"bloom_level": "recordar", "question": "Según el texto, ¿qué mueve el viento?", "options": {x: f"La pieza número {x}" for x in "ABCD"}, "correct_answer": "b", "justification": "El viento mueve la pieza."})
    said = lambda text: lambda c: F.when(F.length(c) > 0, F.lit(text))
    bullets = json.dumps({"bullets": [f"El viento mueve la pieza {x} de la turbina en el parque." for x in ("primera", "segunda", "tercera")]})
    ended = json.dumps({"bullets": ["El viento es una fuente de energía que no se agota."]})
    m = package.study(texts(spark, LESSON), package.Models(said("resumen"), said(kb), said(question), said(bullets), said(ended)))
    atoms = {r["atom_id"]: r for r in m.atoms.collect()}
    assert set(atoms) == {"def:turbina", "ex:tramontana", "def:rotor", "def:gondola"} and atoms["ex:tramontana"]["attributes"] == ["palas"]
    assert m.kb.first()["main_topic"] == "Viento"
    asked = m.quiz.orderBy("question_id").collect()
    # the answer is the same for all: one stays, three are written again without the model, one on the first concept tops up
    assert [q["question"] for q in asked].count("¿Qué mueve el viento?") == 1 and len({q["question"] for q in asked}) == len(asked) == 5
    assert [r["text"] for r in m.conclusions.collect()] == ["El viento es una fuente de energía que no se agota."]
    assert m.deck.filter("section = 'conclusions'").count() == 1
    # a model that never answers leaves what there is without one
    silent = lambda c: F.lit(None).cast("string")
    both = [package.study(texts(spark, LESSON), x).quiz.orderBy("question_id").collect() for x in (package.Models(), package.Models(*[silent] * 5))]
    assert both[0] == both[1]


def test_long_terms_are_split(spark):
    term = "Fotosíntesis: proceso por el que las plantas convierten la luz en energía química que luego usan"
    _, atoms = knowledge.from_answers(spark.createDataFrame([(1, json.dumps({"definitions": [{"term": term}]}))], "doc_id long, payload string"))
    r = atoms.first()
    assert r["term"] == "Fotosíntesis" and r["definition"].startswith("proceso por el que")


def test_ids_are_unique(spark):
    """A made id that another base is equal to is not taken twice, whatever the order."""
    rows = spark.createDataFrame([(1, k, b) for k, b in enumerate(["a_2", "a", "a", "a", "b", "a_2"])] + [(2, 0, "a"), (2, 1, "c")], "doc_id long, n int, base string")
    got = {(r.doc_id, r.n): r.atom_id for r in knowledge.unique_ids(rows, "base", ["n"]).collect()}
    assert [got[1, k] for k in range(6)] == ["a_2", "a", "a_3", "a_4", "b", "a_2_2"] and got[2, 0] == "a" and got[2, 1] == "c"
    taken = spark.createDataFrame([(2, ["a", "a_2"])], "doc_id long, ids array<string>")
    assert {r.atom_id for r in knowledge.unique_ids(rows.filter("doc_id = 2"), "base", ["n"], taken).collect()} == {"a_3", "c"}


def test_repeated_contents_end_a_slide(spark):
    """What follows a repeated bullet on its slide is not registered, as in the order of the check."""
    rows = [(1, 1, 1, "x"), (1, 2, 1, "x"), (1, 2, 2, "y"), (1, 3, 1, "y"), (1, 4, 1, "y"), (1, 4, 2, "z"), (2, 1, 1, "x"), (2, 1, 2, "x")]
    keyed = spark.createDataFrame(rows, "doc_id long, slide_index int, bullet_index int, key string")
    assert sorted(map(tuple, review.repeated_contents(keyed).collect())) == [(1, 2), (1, 4)]


def test_intro_is_moved_or_put_first(spark):
    rows = [(1, 1, "Una cosa", "definition"), (1, 2, "¡Introducción!", "outlook"), (2, 1, "Otra", "code"), (2, 2, "Más", "outlook")]
    plan = spark.createDataFrame([(*r, []) for r in rows], "doc_id long, slide_index int, title string, kind string, atom_ids array<string>")
    got = planning.intro_first(plan).orderBy("doc_id", "slide_index").collect()
    assert [(r.doc_id, r.title) for r in got] == [(1, "¡Introducción!"), (1, "Una cosa"), (2, "Introducción"), (2, "Otra"), (2, "Más")]


def test_plans_of_a_model(spark):
    """Plans that can be read are followed, others leave the deterministic ones in place."""
    quiz_plan = json.dumps({"questions": [{"concept_id": "DEF:Rotor", "bloom_level": "apply"}, {"concept_id": "def:turbina"}]})
    slides = json.dumps({"slides": [{"title": t, "kind": k, "atom_ids": a} for t, k, a in (("partes de la torre", "definition", ["def:gondola"]), ("Giro", "process", ["def:rotor"]), ("Viento", "example", []))]})
    said = lambda text: lambda c: F.when(F.length(c) > 0, F.lit(text))
    m = package.study(texts(spark, LESSON), package.Models(quiz_plan=said(quiz_plan), slide_plan=said(slides)))
    asked = m.quiz.orderBy("question_id").collect()
    assert [(q["concept_id"], q["bloom"]) for q in asked[:2]] == [("def:rotor", "aplicar"), ("def:turbina", "comprender")]
    titles = [r.title for r in m.plan.orderBy("slide_index").collect()]
    assert titles[0] == "Introducción" and "Partes De La Torre" in titles and "Giro" in titles
    assert m.slide_issues.columns == ["doc_id", "slide_index", "issue", "severity"]
    nothing = package.study(texts(spark, LESSON), package.Models(quiz_plan=said("no"), slide_plan=said("{}")))
    assert nothing.quiz.count() == 3 and nothing.plan.count() == package.study(texts(spark, LESSON)).plan.count()


def test_text_function_keeps_bugs(spark):
    def broken(prompt):
        raise KeyError(prompt)

    with pytest.raises(Exception, match="KeyError"):
        spark.range(1).select(prompts.text_function(broken, wait=0)(F.lit("x"))).collect()

"""Multiple-choice questions from atoms, without a model or with one as a text function; grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.tables import written
from lectio.functions.text import clean_option, folded, json_body, let
from lectio.functions.values import MAX_QUESTIONS, MIN_QUESTIONS, QUIZ_ORDER
from lectio.operators.knowledge import first_by_id, kind_rank
from lectio.operators.planning import adaptive_target, bloom, quiz_plan

# --- wording of questions ------------------------------------------------------------------------------------------------
STEMS = {
    "def": ("¿Con qué frase queda explicado «", "term", "»?"),
    "ex": ("¿Qué frase cuenta algo cierto de «", "name", "»?"),
    "rel": ("¿Cómo se vinculan «", "source", "» y «", "target", "»?"),
    "dt": ("¿Cuál de estas cifras da el texto?",),
    "fc": ("¿Cuál de estas frases acierta sobre la fórmula o el código del texto?",),
}
JUSTIFICATION = "Solo la opción A dice lo que se sabe de este punto; las demás lo contradicen."


def stem() -> Column:
    out = F.lit(None)
    fields = {"term", "name", "source", "target"}
    for kind, parts in STEMS.items():
        out = F.when(F.col("kind") == kind, F.concat(*(F.col(p) if p in fields else F.lit(p) for p in parts))).otherwise(out)
    return out


def options() -> Column:
    """The four options of an atom by its kind; A is right."""
    low = F.lower("term")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    listed = lambda c, n, none: F.coalesce(F.nullif(F.array_join(F.slice(F.col(c), 1, n), ", "), F.lit("")), F.lit(none))
    s, g = F.col("source"), F.col("target")
    by_kind = {
        "def": (F.left("definition", F.lit(220)), say("Es justo lo contrario de ", low, "."), say("Nombra un caso suelto de ", low, ", sin explicarlo."), say("Trata de otro asunto que no toca ", low, ".")),
        "ex": (say("Reúne ", listed("attributes", 3, "rasgos propios"), " y ", listed("methods", 2, "acciones propias"), "."), say("Carece de rasgos y de acciones propias."), say("Solo es una cifra suelta."), say("Es un vínculo entre dos cosas y no un caso.")),
        "rel": (say(s, " ", F.col("rel_kind"), " ", g, " (", F.coalesce(F.nullif("description", F.lit("")), F.lit("así consta en la base")), ")."), say(g, " ", F.col("rel_kind"), " ", s, ", justo al revés."), say(s, " y ", g, " no guardan ningún vínculo."), say(s, " y ", g, " son siempre la misma cosa.")),
        "dt": (say(F.col("value"), ": ", F.col("description")), say("0%: no se observa nada en absoluto."), say("100%: ocurre siempre y sin excepción."), say("El texto no da ninguna cifra.")),
        "fc": (say("Es ", F.when(F.col("fc_kind") == "formula", "una fórmula").otherwise("código"), " que figura en el texto."), say("Es un invento que el texto no recoge."), say("Solo son palabras, sin signos ni código."), say("Es el resumen final del texto.")),
    }
    raw = F.lit(None)
    for kind, four in by_kind.items():
        raw = F.when(F.col("kind") == kind, F.array(*four)).otherwise(raw)
    return let(F.transform(raw, clean_option), lambda o: F.struct(*(o[k].alias(x) for k, x in enumerate("ABCD"))))


def questions(plan: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, question_id, bloom, concept_id, kind (of atom), question, options, correct, justification for a plan's rows."""
    a = first_by_id(atoms).withColumnRenamed("atom_id", "concept_id")
    rows = plan.select("doc_id", "question_id", "bloom", "concept_id").join(a, ["doc_id", "concept_id"])
    return rows.select("doc_id", "question_id", "bloom", "concept_id", "kind", stem().alias("question"), options().alias("options"), F.lit("A").alias("correct"), F.lit(JUSTIFICATION).alias("justification"))


def from_answers(answers: DataFrame, plan: DataFrame, atoms: DataFrame) -> DataFrame:
    """Questions as questions() gives them: what a model answered (doc_id, question_id, payload) where it can be read and is
    whole, the deterministic one otherwise."""
    schema = "bloom_level string, question string, options struct<A: string, B: string, C: string, D: string>, correct_answer string, justification string"
    read = answers.select("doc_id", "question_id", F.from_json(json_body(F.col("payload")), schema).alias("m"))
    whole = (F.char_length("m.question") >= 10) & (F.char_length("m.justification") >= 10) & F.upper(F.trim("m.correct_answer")).isin(*"ABCD")
    for x in "ABCD":
        whole = whole & (F.trim(F.col(f"m.options.{x}")) != "")
    read = read.filter(whole).select("doc_id", "question_id", F.lit(True).alias("ok"), "m")
    base = questions(plan, atoms).join(read, ["doc_id", "question_id"], "left")
    given = F.struct(*(clean_option(F.col(f"m.options.{x}")).alias(x) for x in "ABCD"))
    take = lambda c, own: F.when(F.col("ok"), c).otherwise(F.col(own)).alias(own)
    return base.select("doc_id", "question_id", take(F.coalesce(bloom(F.col("m.bloom_level")), "bloom"), "bloom"), "concept_id", "kind", take(F.trim("m.question"), "question"), take(given, "options"), take(F.upper(F.trim("m.correct_answer")), "correct"), take(F.trim("m.justification"), "justification"))


def filled(asked: DataFrame, atoms: DataFrame, least: int = MIN_QUESTIONS) -> DataFrame:
    """asked, topped up to `least` questions a document with deterministic ones whose stem is new; so are documents of atoms that
    asked has no question of."""
    n = asked.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("question_id").alias("last"))
    a = first_by_id(atoms).withColumn("question", stem()).withColumn("key", folded(F.col("question")))
    a = a.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "key").orderBy(kind_rank(F.col("kind"), QUIZ_ORDER), "pos"))).filter("r = 1")
    fresh = a.join(asked.select("doc_id", folded(F.col("question")).alias("key")), ["doc_id", "key"], "left_anti").join(n, "doc_id", "left").fillna(0, ["n", "last"])
    fresh = fresh.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(kind_rank(F.col("kind"), QUIZ_ORDER), "pos"))).filter(F.col("n") + F.col("r") <= least)
    more = fresh.select("doc_id", (F.col("last") + F.col("r")).cast("int").alias("question_id"), F.lit("recordar").alias("bloom"), F.col("atom_id").alias("concept_id"), "kind", "question", options().alias("options"), F.lit("A").alias("correct"), F.lit(JUSTIFICATION).alias("justification"))
    return asked.unionByName(more)


def renumbered(asked: DataFrame, most: int = MAX_QUESTIONS) -> DataFrame:
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("question_id"))
    return asked.withColumn("question_id", n).filter(F.col("question_id") <= most)


def quiz(atoms: DataFrame) -> DataFrame:
    """The whole quiz of each document without a model."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    sized = atoms.withColumn("lectio_n", n).withColumn("lectio_target", adaptive_target(F.col("lectio_n")))
    plan = quiz_plan(sized.drop("lectio_n", "lectio_target"))
    return renumbered(filled(questions(plan, atoms), atoms))


def related(atoms: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, atom_id, n, related_id, score: for each atom up to `most` others of its document, those of its subtopic first (2), then
    examples and relations (1), then by id.

    The others come from ranked lists, as many entries of each as can be needed: of the atom's subtopic, the first most + 1 of
    each kind; of the document, most + most + 1, since a subtopic with fewer than `most` others has no more than that to skip."""
    once = first_by_id(atoms).select("doc_id", "atom_id", "kind", F.nullif("subtopic", F.lit("")).alias("subtopic"))
    once = written(once.withColumn("more", F.col("kind").isin("ex", "rel").cast("int")), "once")

    def first(rows: DataFrame, by: list[str], least: int, name: str) -> DataFrame:
        n = F.row_number().over(W.partitionBy(*by, "more").orderBy("atom_id"))
        entry = F.struct((least + F.col("more")).alias("score"), F.col("atom_id").alias("id"), F.col("subtopic").alias("sub"))
        return rows.withColumn("n", n).filter(F.col("n") <= (most + 1 if least else 2 * most + 1)).groupBy(*by).agg(F.collect_list(entry).alias(name))

    near = first(once.filter("subtopic IS NOT NULL"), ["doc_id", "subtopic"], 2, "near")
    far = first(once, ["doc_id"], 0, "far")
    none = F.array().cast("array<struct<score: int, id: string, sub: string>>")
    both = once.join(near, ["doc_id", "subtopic"], "left").join(far, "doc_id", "left")
    others = F.concat(F.coalesce("near", none), F.filter(F.coalesce("far", none), lambda x: ~F.coalesce(x["sub"] == F.col("subtopic"), F.lit(False))))
    ranked = F.array_sort(F.transform(F.filter(others, lambda x: x["id"] != F.col("atom_id")), lambda x: F.struct((-x["score"]).alias("s"), x["id"].alias("id"))))
    return both.select("doc_id", "atom_id", F.posexplode(F.slice(ranked, 1, most)).alias("n", "x")).select("doc_id", "atom_id", (F.col("n") + 1).alias("n"), F.col("x.id").alias("related_id"), (-F.col("x.s")).alias("score"))


def last_before(rows: DataFrame, by: str, order: str, text: Column, most: int = 5) -> DataFrame:
    """rows with `before`: the texts of up to `most` rows before each, joined by new lines."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(-most, -1)
    return rows.withColumn("before", F.array_join(F.collect_list(text).over(w), "\n"))


def graded(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, n_questions, n_correct, score (share, 3 digits): answers are doc_id, question_id, answer."""
    both = asked.select("doc_id", "question_id", "correct").join(answers.select("doc_id", "question_id", "answer"), ["doc_id", "question_id"], "left")
    right = F.sum(F.when(F.upper(F.trim("answer")) == F.col("correct"), 1).otherwise(0))
    return both.groupBy("doc_id").agg(F.count("*").alias("n_questions"), right.alias("n_correct"), F.bround(right / F.count("*"), 3).alias("score"))


def exam_lines(asked: DataFrame) -> DataFrame:
    """doc_id, line_no, line: an exam sheet, then its answers, for any text sink."""
    q = F.concat(F.col("question_id").cast("string"), F.lit(". "), F.col("question"))
    lines = F.array(F.struct(F.lit(0).alias("sheet"), F.lit(0).alias("i"), q.alias("line")), *(F.struct(F.lit(0).alias("sheet"), F.lit(k + 1).alias("i"), F.concat(F.lit(f"   {x}) "), F.col(f"options.{x}")).alias("line")) for k, x in enumerate("ABCD")), F.struct(F.lit(1).alias("sheet"), F.lit(0).alias("i"), F.concat(F.col("question_id").cast("string"), F.lit(". "), F.col("correct"), F.lit(" · "), F.col("justification")).alias("line")))
    rows = asked.select("doc_id", "question_id", F.inline(lines))
    return rows.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("sheet", "question_id", "i")).alias("line_no"), "line")

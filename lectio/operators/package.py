"""From documents to quiz and deck in one call, with a record for each document of what came out.

Every stage has a deterministic form. A text function (see prompts) may stand in for any of them; an answer that is missing or
can't be read leaves the deterministic form in its place, row by row. What several stages use is written once.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.tables import written
from lectio.functions.text import json_body, truncated
from lectio.functions.values import MAX_TITLE_CHARS, MIN_SLIDES
from lectio.operators import chunking, deck, extract, knowledge, metrics, planning, prompts, quiz, review, runs
from lectio.operators import ledger as ledgers
from lectio.sources.documents import admitted

Text = Callable[[Column], Column]


class Models(NamedTuple):
    """A text function, or a model behind a ledger (Asked), for each kind of request; None: the deterministic form."""

    summary: Text | None = None
    knowledge: Text | None = None
    question: Text | None = None
    bullets: Text | None = None
    conclusion: Text | None = None
    quiz_plan: Text | None = None
    slide_plan: Text | None = None


class Material(NamedTuple):
    """What study() gives, a table each."""

    kb: DataFrame
    atoms: DataFrame
    quiz: DataFrame
    plan: DataFrame
    bullets: DataFrame
    conclusions: DataFrame
    deck: DataFrame
    record: DataFrame
    slide_issues: DataFrame
    stages: DataFrame


class Asked(NamedTuple):
    """A model behind a ledger: in the place of a text function, for requests that are to be asked once, with second tries and a
    time limit."""

    ledger: ledgers.Ledger
    call: Callable[[str, float], str]
    accept: Callable[[str], bool] = bool
    timeout: float | None = None


def answers_of(rows: DataFrame, prompt: Column, model: Text | Asked) -> DataFrame:
    """rows with payload, what the model says to each row's prompt."""
    if isinstance(model, Asked):
        found = model.ledger.answered(rows, prompt, model.call, model.accept, model.timeout)
        return found.withColumnRenamed("answer", "payload").drop("error", "tries", "seconds")
    return rows.withColumn("payload", model(prompt))


def once_more(answers: DataFrame, rows: DataFrame, prompt: Column, model: Text | Asked, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answers (doc_id, payload), those that nothing can be read of asked for once more: by the model's cooler form where it has one
    (a ledger's model makes its second tries itself)."""
    cooler = getattr(model, "cooler", None)
    if cooler is None:
        return answers
    good = answers.join(written(read(answers).select("doc_id").distinct(), "read"), "doc_id", "left_semi")
    bad = rows.join(good.select("doc_id"), "doc_id", "left_anti")
    return written(good.unionByName(answers_of(bad, prompt, cooler).select("doc_id", "payload")), "answers")


def knowledge_base(docs: DataFrame, models: Models = Models()) -> tuple[DataFrame, DataFrame]:
    """(kb: doc_id, main_topic, subtopics, conclusions; atoms) of documents that have a text.

    Chunks are summarised, the summaries and the literal hints of a document make one request, and of its answer stays what the
    text bears out, with the literal atoms that are new. A document that gets no atoms this way has its literal ones.
    """
    literal = knowledge.fallback_atoms(docs)
    listed = knowledge.subtopics(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "subtopic"))), lambda s: s["subtopic"]).alias("subtopics"))
    none = F.array().cast("array<string>")
    topics = knowledge.topics(docs).join(listed, "doc_id", "left").select("doc_id", "main_topic", F.coalesce("subtopics", none).alias("subtopics"), none.alias("conclusions"))
    if models.knowledge is None:
        return topics, literal
    asked = prompts.map_prompts(chunking.chunks(docs))
    if models.summary is not None:
        asked = written(answers_of(asked, F.col("prompt"), models.summary), "summaries")
    partials = chunking.summarised(asked, F.col("payload") if models.summary is not None else None)
    request = partials.join(extract.hint_block(docs), "doc_id", "left")
    prompt = prompts.knowledge_prompt(F.col("partials"), F.col("block"))
    request = written(request, "request")
    answers = written(answers_of(request, prompt, models.knowledge).select("doc_id", "payload"), "answers")
    answers = once_more(answers, request, prompt, models.knowledge, lambda a: knowledge.from_answers(a)[1])
    named, found = knowledge.from_answers(answers)
    found = written(knowledge.grounded(found, docs), "answered")
    has = found.select("doc_id").distinct()
    own = docs.join(has, "doc_id", "left_semi")
    atoms = knowledge.enriched(found, own).unionByName(literal.join(has, "doc_id", "left_anti"))
    given = named.select("doc_id", F.col("main_topic").alias("lectio_topic"), F.nullif("subtopics", none).alias("lectio_sub"), F.col("conclusions").alias("lectio_end"))
    kb = topics.join(given, "doc_id", "left").select(
        "doc_id", F.coalesce("lectio_topic", "main_topic").alias("main_topic"), F.coalesce("lectio_sub", "subtopics").alias("subtopics"), F.coalesce("lectio_end", "conclusions").alias("conclusions")
    )
    return kb, atoms


def replanned(asked: DataFrame, issues: DataFrame, atoms: DataFrame) -> DataFrame:
    """The plan of new questions in the place of those with a high issue: of the same concept, or for a repeated question of the
    next concept, in the order of atoms, that no question is of (its own again where none is left)."""
    repeated = issues.filter("issue = 'duplicate'").select("doc_id", "question_id").distinct()
    turn = F.row_number().over(W.partitionBy("doc_id").orderBy("question_id"))
    free = knowledge.first_by_id(atoms).join(asked.select("doc_id", F.col("concept_id").alias("atom_id")), ["doc_id", "atom_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(knowledge.kind_rank(F.col("kind")), "pos"))
    other = free.select("doc_id", F.col("atom_id").alias("lectio_other"), place.alias("lectio_n"))
    moved = repeated.withColumn("lectio_n", turn).join(other, ["doc_id", "lectio_n"]).select("doc_id", "question_id", "lectio_other")
    bad = asked.select("doc_id", "question_id", "bloom", "concept_id").join(review.blockers(issues), ["doc_id", "question_id"], "left_semi")
    plan = bad.join(moved, ["doc_id", "question_id"], "left").select("doc_id", "question_id", "bloom", F.coalesce("lectio_other", "concept_id").alias("concept_id"))
    return plan.withColumn("kind", planning.recommended(F.col("bloom"))[0])


def asked_for(plan: DataFrame, atoms: DataFrame, models: Models) -> DataFrame:
    """The questions of a plan: a model's where there is one and it gives one, else the deterministic ones. A request knows
    the concept, what is related to it and the questions, in their deterministic form, that the plan has before."""
    if models.question is None:
        return quiz.questions(plan, atoms)
    plan = written(plan, "plan")
    lines = knowledge.first_by_id(atoms).select("doc_id", "atom_id", knowledge.atom_line(True).alias("line"))
    near = quiz.related(atoms).join(lines.select("doc_id", F.col("atom_id").alias("related_id"), F.col("line").alias("l")), ["doc_id", "related_id"])
    near = near.groupBy("doc_id", F.col("atom_id").alias("concept_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l"))), lambda x: x["l"]), "\n").alias("related"))
    stems = quiz.questions(plan, atoms).select("doc_id", "question_id", F.concat(F.lit("- ["), "bloom", F.lit("] "), "question").alias("s"))
    before = quiz.last_before(stems, "doc_id", "question_id", F.col("s")).select("doc_id", "question_id", "before")
    context = plan.join(lines.withColumnRenamed("atom_id", "concept_id"), ["doc_id", "concept_id"]).join(near, ["doc_id", "concept_id"], "left").join(before, ["doc_id", "question_id"], "left")
    prompt = prompts.question_prompt(F.col("line"), F.col("bloom"), F.col("kind"), F.col("related"), F.col("before"))
    return quiz.from_answers(answers_of(context, prompt, models.question).select("doc_id", "question_id", "payload"), plan, atoms)


def planned_by(model: Text | Asked | None, kb: DataFrame, atoms: DataFrame, prompt: Callable[..., Column], read: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """doc_id and payload: a model's answers to a request for a plan, which knows the knowledge base and its ids."""
    if model is None:
        return None
    ids = planning.id_lists(atoms).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "prefix", F.lit(": "), "ids"))), "\n").alias("valid"))
    n = atoms.groupBy("doc_id").agg(planning.adaptive_target(F.count("*")).alias("target"))
    source = knowledge.document_markdown(kb, atoms, 5000).join(ids, "doc_id").join(n, "doc_id")
    source, asked = written(source, "source"), prompt(F.col("markdown"), F.col("valid"), F.col("target"))
    return once_more(written(answers_of(source, asked, model).select("doc_id", "payload"), "plans"), source, asked, model, read)


def or_else(given: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of given, and those of own for documents that it has none of."""
    given = written(given, "given")
    return given.unionByName(own.join(given.select("doc_id").distinct(), "doc_id", "left_anti"))


def quiz_of(kb: DataFrame, atoms: DataFrame, models: Models = Models()) -> DataFrame:
    """The quiz of each document: planned, written, reviewed, questions with a high issue written once more and dropped if they
    still have one, topped up and numbered."""
    own = planning.sanitized_quiz_plan(planning.quiz_plan(atoms), atoms)
    answers = planned_by(models.quiz_plan, kb, atoms, prompts.quiz_plan_prompt, planning.quiz_plan_from_answers)
    plan = own if answers is None else or_else(planning.sanitized_quiz_plan(planning.quiz_plan_from_answers(answers), atoms), own)
    asked = asked_for(plan, atoms, models)
    asked = written(asked, "asked")
    vocabulary = written(review.vocabulary(atoms, kb), "vocabulary")
    issues = written(review.quiz_issues(asked, vocabulary), "issues")
    good = asked.join(review.blockers(issues), ["doc_id", "question_id"], "left_anti")
    again = written(good.unionByName(asked_for(replanned(asked, issues, atoms), atoms, models)), "again")
    kept = review.refined_quiz(again, review.quiz_issues(again, vocabulary))
    return quiz.renumbered(quiz.filled(written(kept, "kept"), atoms))


def deck_of(kb: DataFrame, atoms: DataFrame, models: Models = Models(), subtopics: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(plan, bullets, conclusions, titles) of each document: slides planned and put right, their bullets without repetition, what a
    model calls the deck, or its topic."""
    own = written(planning.sanitized_slide_plan(planning.slide_plan(kb, atoms, subtopics), atoms), "own")
    answers = planned_by(models.slide_plan, kb, atoms, prompts.slide_plan_prompt, planning.slide_plan_from_answers)
    titles = kb.select("doc_id", F.col("main_topic").alias("title")) if answers is None else written(planning.titles_from_answers(answers, kb), "titles")
    if answers is not None:
        given = written(planning.sanitized_slide_plan(planning.slide_plan_from_answers(answers), atoms), "planned")
        short = written(given.groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set(F.lower("title")).alias("titles")).filter(F.col("n") < MIN_SLIDES), "short")
        more = own.join(short, "doc_id").filter(~F.array_contains("titles", F.lower("title"))).select("doc_id", (F.col("slide_index") + F.col("n")).cast("int").alias("slide_index"), "title", "kind", "atom_ids")
        merged = written(planning.sanitized_slide_plan(written(given.join(short, "doc_id", "left_semi").unionByName(more), "both"), atoms), "merged")
        own = or_else(given.join(short, "doc_id", "left_anti").unionByName(merged), own)
    plan = planning.intro_first(own).withColumn("title", truncated(F.col("title"), MAX_TITLE_CHARS))
    plan = written(plan, "slides")
    shown = deck.bullets(plan, atoms, kb)
    lines = atoms_of_slides(plan, atoms)
    if models.bullets is not None:
        lines = written(lines.join(before_slides(shown, plan), ["doc_id", "slide_index"], "left"), "lines")
        once = bullets_asked(lines, models.bullets, False)
        new = deck.unrepeated(once)  # repeats don't count
        few = lines.join(enough(new), ["doc_id", "slide_index"], "left_anti")
        again = bullets_asked(few, models.bullets, True)
        better = again.select("doc_id", "slide_index").distinct()
        answered = written(once.join(better, ["doc_id", "slide_index"], "left_anti").unionByName(again), "answered")
        shown = answered.unionByName(shown.join(answered.select("doc_id", "slide_index").distinct(), ["doc_id", "slide_index"], "left_anti"))
    none = kb.select("doc_id", F.lit(0).alias("n"), F.lit("").alias("text")).limit(0)
    ended = none
    if models.conclusion is not None:
        source = knowledge.document_markdown(kb, atoms, 6000).join(kb.select("doc_id", "main_topic"), "doc_id")
        asked = answers_of(source, prompts.conclusion_prompt(F.col("main_topic"), F.col("markdown")), models.conclusion)
        listed = F.from_json(json_body(F.col("payload")), "bullets array<string>")["bullets"]
        rows = asked.select("doc_id", F.lit(0).alias("slide_index"), F.posexplode(listed).alias("bullet_index", "t"))
        clean = rows.select("doc_id", "slide_index", "bullet_index", deck.clean_bullet(F.col("t")).alias("bullet")).filter("bullet IS NOT NULL")
        ended = deck.balanced(clean).select("doc_id", F.col("bullet_index").alias("n"), F.col("bullet").alias("text"))
    return plan, deck.unrepeated(written(shown, "shown")), written(ended, "conclusions"), titles


def bullets_asked(lines: DataFrame, model: Text, again: bool) -> DataFrame:
    """A model's bullets for slides (doc_id, slide_index, title, lines, before), written; `again` with a word on what was missing."""
    prompt = prompts.bullets_prompt(F.col("title"), F.col("lines"), F.col("before"), again)
    return written(deck.bullets_from_answers(written(answers_of(lines, prompt, model).select("doc_id", "slide_index", "title", "payload"), "asked")), "bullets")


def enough(bullets: DataFrame, least: int = 3) -> DataFrame:
    return bullets.groupBy("doc_id", "slide_index").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("doc_id", "slide_index")


def before_slides(shown: DataFrame, plan: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, slide_index, before: the last bullets, in their deterministic form, of the slides before each."""
    text = shown.groupBy("doc_id", "slide_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("bullet_index", "bullet"))), lambda b: F.concat(F.lit("- "), b["bullet"])).alias("b"))
    w = W.partitionBy("doc_id").orderBy("slide_index").rowsBetween(W.unboundedPreceding, -1)
    every = plan.select("doc_id", "slide_index").join(text, ["doc_id", "slide_index"], "left").withColumn("all", F.flatten(F.collect_list("b").over(w)))
    return every.select("doc_id", "slide_index", F.array_join(F.slice("all", F.greatest(F.lit(1), F.size("all") - most + 1), F.lit(most)), "\n").alias("before"))


def atoms_of_slides(plan: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, slide_index, title, lines: a slide's atoms, a line each, in the order of the plan; a remark where it has none."""
    ids = plan.filter("kind <> 'intro'").select("doc_id", "slide_index", F.posexplode("atom_ids").alias("at", "atom_id"))
    known = knowledge.first_by_id(atoms).select("doc_id", "atom_id", knowledge.atom_line().alias("line"))
    met = ids.join(known, ["doc_id", "atom_id"]).groupBy("doc_id", "slide_index").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return plan.filter("kind <> 'intro'").join(met, ["doc_id", "slide_index"], "left").select("doc_id", "slide_index", "title", F.coalesce(lines, F.lit("(sin átomos asociados)")).alias("lines"))


def record_of(docs: DataFrame, atoms: DataFrame, asked: DataFrame, plan: DataFrame, shown: DataFrame, conclusions: DataFrame) -> DataFrame:
    """doc_id, status, error_kind, atoms, then the metrics of quiz and deck (null where there is none), a row for each of docs
    (doc_id, error_kind). A document without atoms has no_atoms as its error; without a question no_quiz; without a slide no_deck."""
    n = atoms.groupBy("doc_id").agg(F.count("*").alias("kb_atoms"))
    q = metrics.quiz_metrics(asked, atoms).select("doc_id", "num_questions", "bloom_diversity", "duplicate_pairs", "kb_term_coverage")
    d = metrics.deck_metrics(plan, shown, conclusions).select("doc_id", "num_slides_total", "num_content_slides", "avg_bullets", "bullets_total", "index_coherence")
    all_of = docs.select("doc_id", "error_kind").join(n, "doc_id", "left").join(q, "doc_id", "left").join(d, "doc_id", "left")
    missing = lambda c, kind: F.when(F.col(c).isNull(), F.coalesce("error_kind", F.when(F.col("kb_atoms").isNull(), "no_atoms"), F.lit(kind)))
    quiz_error, deck_error = missing("num_questions", "no_quiz"), missing("num_content_slides", "no_deck")
    rest = [c for c in all_of.columns if c not in ("doc_id", "error_kind", "kb_atoms")]
    return all_of.select("doc_id", runs.run_status(quiz_error, deck_error).alias("status"), F.coalesce(quiz_error, deck_error).alias("error_kind"), F.coalesce("kb_atoms", F.lit(0)).alias("kb_atoms"), *rest)


class Stages:
    """Stages are written one after the other; of each, how many rows it gave and how long it took."""

    def __init__(self) -> None:
        self.done: list[tuple[str, int, float]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        seen, began = Observation(), time.monotonic()
        found = written(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), name)
        self.done.append((name, seen.get["n_rows"], round(time.monotonic() - began, 3)))
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, n_rows, seconds, in order: a row a stage, whatever the documents are."""
        return spark.createDataFrame([(k, *x) for k, x in enumerate(self.done)], "n int, stage string, n_rows long, seconds double")


def study(docs: DataFrame, models: Models = Models(), pages: str | None = None, cut: bool = False) -> Material:
    """Quiz, deck and record of each of docs (doc_id, text; doc_id is unique). Whole texts are used; with `cut`, what a model with
    a bounded input takes."""
    stages = Stages()
    taken = admitted(docs.withColumn("lectio_whole", F.col("text")), pages)
    taken = stages.written(taken if cut else taken.withColumn("text", F.col("lectio_whole")), "taken")
    good = taken.filter("error_kind IS NULL").select("doc_id", "text")
    kb, atoms = knowledge_base(good, models)
    atoms = stages.written(atoms, "atoms")
    kb = stages.written(kb.join(atoms.select("doc_id").distinct(), "doc_id", "left_semi"), "topics")
    asked = stages.written(quiz_of(kb, atoms, models), "quiz")
    subtopics = kb.select("doc_id", F.posexplode("subtopics").alias("p", "subtopic")).select("doc_id", (F.col("p") + 1).alias("n"), "subtopic")
    plan, shown, ended, titles = deck_of(kb, atoms, models, subtopics)
    shown = stages.written(shown, "deck")
    issues = stages.written(review.slide_issues(shown, plan, review.vocabulary(atoms, kb)), "slide_issues")
    record = record_of(taken, atoms, asked, plan, shown, ended)
    return Material(kb, atoms, asked, plan, shown, ended, deck.deck_rows(titles.withColumnRenamed("title", "main_topic"), plan, shown, ended), record, issues, stages.table(docs.sparkSession))

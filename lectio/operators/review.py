"""Review of quizzes and slides by rules, and refinement without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.phrases import folded_has_phrase, has_phrase
from lectio.functions.text import TOKEN4, folded, jaccard, let, tokens
from lectio.functions.values import BANNED_OPTION_PHRASES, DUPLICATE_QUESTION, MAX_QUESTIONS, QUIZ_META_PHRASES, REVIEW_STOPWORDS, SLIDE_META_PHRASES
from lectio.operators.knowledge import first_by_id, kind_rank

# --- fixed values: openings that can be cut off -------------------------------------------------------------------------
PREAMBLE = r"(?iU)^\s*(?:segun|conforme\s+a[l]?|de\s+acuerdo\s+con|basandose\s+en|como\s+se\s+(?:indica|menciona|define)\s+en)\b[^,.:;¿?]{1,80}[,:;]\s*"
ISSUE = "doc_id", "question_id", "issue", "severity", "detail"


def review_tokens(c: Column) -> Column:
    return tokens(c, TOKEN4, REVIEW_STOPWORDS)


def vocabulary(atoms: DataFrame, kb: DataFrame | None = None) -> DataFrame:
    """doc_id, vocab: the tokens of all atoms, of the topic and (where kb has them) the subtopics of a document."""
    text = F.concat_ws(" ", "term", "definition", "name", "description", "content", "caption", "value", "rel_kind", "source", "target", "subtopic", F.array_join("attributes", " "), F.array_join("methods", " "))
    rows = atoms.select("doc_id", review_tokens(text).alias("t"))
    if kb is not None:
        rows = rows.unionByName(kb.select("doc_id", review_tokens(F.concat_ws(" ", "main_topic", *([F.array_join("subtopics", " ")] if "subtopics" in kb.columns else []))).alias("t")))
    return rows.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("vocab"))


def stripped_preamble(c: Column) -> Column:
    """A question without an opening such as Según el texto, its first letter a capital again."""
    end = F.lit(1 << 30)
    capital = lambda t: F.concat(F.regexp_extract(t, "^[¿¡]*", 0), let(F.regexp_replace(t, "^[¿¡]*", ""), lambda b: F.concat(F.upper(F.left(b, F.lit(1))), F.substring(b, F.lit(2), end))))
    return let(F.char_length(F.regexp_extract(folded(c), PREAMBLE, 0)), lambda n: let(F.trim(F.substring(c, n + 1, end)), lambda t: F.when((n > 0) & (F.char_length(t) >= 10), capital(t)).otherwise(c)))


def options_of() -> list[Column]:
    return [F.col(f"options.{x}") for x in "ABCD"]


def quiz_issues(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """ISSUE: banned phrases and repeats (high), unbalanced options, meta language and what is not grounded (low)."""
    opts = options_of()
    row = lambda df, issue, severity, detail=None: df.select("doc_id", "question_id", F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    banned = F.exists(F.array(*(folded(o) for o in opts)), lambda o: has_phrase(o, BANNED_OPTION_PHRASES))
    lengths = F.array(*(F.char_length(o) for o in opts))
    longest = F.array_max(lengths)
    rest = (F.aggregate(lengths, F.lit(0), lambda a, x: a + x) - longest) / 3
    unbalanced = (longest >= 40) & (rest > 0) & (longest >= 2.2 * rest)
    meta = folded_has_phrase(F.concat_ws(" ", "question", "justification"), QUIZ_META_PHRASES)
    correct = F.col("options.D")
    for x in "CBA":
        correct = F.when(F.col("correct") == x, F.col(f"options.{x}")).otherwise(correct)
    said = review_tokens(F.concat_ws(" ", "question", correct, "justification"))
    known = asked.join(vocab, "doc_id", "left")
    loose = known.filter((F.size(F.coalesce("vocab", F.array().cast("array<string>"))) > 0) & ~F.coalesce(F.arrays_overlap(said, F.col("vocab")), F.lit(False)))
    issues = row(asked.filter(banned), "banned_phrase", "high").unionByName(row(asked.filter(unbalanced), "unbalanced_options", "low")).unionByName(row(asked.filter(meta), "meta_language", "low")).unionByName(row(loose, "not_grounded", "low"))
    signed = asked.select("doc_id", "question_id", review_tokens(F.concat_ws(" ", "question", *opts)).alias("sig"))
    p = signed.select(F.col("doc_id").alias("p_doc"), F.col("question_id").alias("p_id"), F.col("sig").alias("p_sig"))
    pairs = signed.join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("p_id") < F.col("question_id"))).filter(jaccard(F.col("sig"), F.col("p_sig")) >= DUPLICATE_QUESTION)
    repeats = pairs.groupBy("doc_id", "question_id").agg(F.min("p_id").alias("first"))
    return issues.unionByName(row(repeats, "duplicate", "high", F.col("first")))


def blockers(issues: DataFrame) -> DataFrame:
    return issues.filter("severity = 'high'").select("doc_id", "question_id").distinct()


def unused_concepts(asked: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, atom_id: the first atom that no question is of."""
    free = first_by_id(atoms).join(asked.select("doc_id", F.col("concept_id").alias("atom_id")), ["doc_id", "atom_id"], "left_anti")
    return free.groupBy("doc_id").agg(F.min_by("atom_id", F.struct(kind_rank(F.col("kind")), F.col("pos"))).alias("atom_id"))


def refined_quiz(asked: DataFrame, issues: DataFrame, most: int = MAX_QUESTIONS) -> DataFrame:
    """Questions without preambles and without those that have a high issue, at most `most`."""
    good = asked.withColumn("question", stripped_preamble(F.col("question"))).join(blockers(issues), ["doc_id", "question_id"], "left_anti")
    return good.withColumn("lectio_r", F.row_number().over(W.partitionBy("doc_id").orderBy("question_id"))).filter(F.col("lectio_r") <= most).drop("lectio_r")


def repeated_contents(keyed: DataFrame) -> DataFrame:
    """doc_id, slide_index: slides with a bullet (key) that a slide before has. What counts as before depends on where a
    slide's check ended, so a document's bullets, at most some hundred, are folded in order."""
    state = "struct<seen: map<string, int>, hits: array<int>>"
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("seen"), F.array().cast("array<int>").alias("hits")).cast(state)

    def step(s: Column, b: Column) -> Column:
        first = F.try_element_at(s["seen"], b["key"])
        ended = F.array_contains(s["hits"], b["slide_index"])
        hit = ~ended & first.isNotNull() & (first != b["slide_index"])
        new = F.map_concat(s["seen"], F.map_from_arrays(F.array(b["key"]), F.array(b["slide_index"])))
        return F.struct(F.when(ended | first.isNotNull(), s["seen"]).otherwise(new).alias("seen"), F.when(F.coalesce(hit, F.lit(False)), F.concat(s["hits"], F.array(b["slide_index"]))).otherwise(s["hits"]).alias("hits")).cast(state)

    ordered = F.array_sort(F.collect_list(F.struct(F.col("slide_index").cast("int").alias("slide_index"), "bullet_index", "key")))
    return keyed.groupBy("doc_id").agg(ordered.alias("rows")).select("doc_id", F.explode(F.aggregate("rows", start, step)["hits"]).alias("slide_index"))


def slide_issues(shown: DataFrame, plan: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, slide_index, issue, severity (low): meta language in a bullet, bullets that share nothing with the vocabulary,
    and contents that a slide before has word for word (what follows on the slide then isn't looked at)."""
    text = shown.groupBy("doc_id", "slide_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bullet_index", "bullet"))), lambda b: b["bullet"]), " ").alias("text"))
    slides = text.join(plan.select("doc_id", "slide_index", "kind"), ["doc_id", "slide_index"])
    row = lambda df, issue: df.select("doc_id", "slide_index", F.lit(issue).alias("issue"), F.lit("low").alias("severity"))
    meta = shown.filter(folded_has_phrase(F.col("bullet"), SLIDE_META_PHRASES)).select("doc_id", "slide_index").distinct()
    known = slides.filter("kind NOT IN ('intro', 'conclusion')").join(vocab, "doc_id", "left")
    loose = known.filter((F.size(F.coalesce("vocab", F.array().cast("array<string>"))) > 0) & ~F.coalesce(F.arrays_overlap(review_tokens(F.col("text")), F.col("vocab")), F.lit(False)))
    keyed = shown.select("doc_id", "slide_index", "bullet_index", F.left(F.array_join(F.array_sort(review_tokens(F.col("bullet"))), " "), F.lit(120)).alias("key")).filter("key <> ''")
    again = repeated_contents(keyed)
    return row(meta, "meta_language").unionByName(row(loose, "not_grounded")).unionByName(row(again, "duplicate_content"))

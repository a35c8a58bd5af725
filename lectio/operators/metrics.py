"""Metrics of quizzes and decks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.functions.text import TOKEN3, jaccard, tokens
from lectio.functions.values import DUPLICATE_STEM, METRIC_STOPWORDS, OUTLINE_MATCH


def metric_tokens(c: Column) -> Column:
    return tokens(c, TOKEN3, METRIC_STOPWORDS)


def bloom_distribution(asked: DataFrame) -> DataFrame:
    return asked.groupBy("doc_id", F.coalesce(F.nullif("bloom", F.lit("")), F.lit("?")).alias("bloom")).agg(F.count("*").alias("n"))


def duplicate_pairs(asked: DataFrame) -> DataFrame:
    """doc_id, first, second: questions of a document with much the same stem."""
    a = asked.select("doc_id", F.col("question_id").alias("first"), metric_tokens(F.col("question")).alias("a"))
    b = asked.select(F.col("doc_id").alias("b_doc"), F.col("question_id").alias("second"), metric_tokens(F.col("question")).alias("b"))
    return a.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("first") < F.col("second"))).filter(jaccard(F.col("a"), F.col("b")) >= DUPLICATE_STEM).select("doc_id", "first", "second")


def term_coverage(asked: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, coverage: the share of terms and example names with a token that the quiz has."""
    text = F.concat_ws(" ", "question", "justification", "options.A", "options.B", "options.C", "options.D")
    said = asked.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(metric_tokens(text)))).alias("said"))
    terms = atoms.filter("kind IN ('def', 'ex')").select("doc_id", F.coalesce("term", "name").alias("t")).filter("trim(t) <> ''")
    hit = F.coalesce(F.arrays_overlap(metric_tokens(F.col("t")), F.col("said")), F.lit(False))
    return terms.join(said, "doc_id", "left").groupBy("doc_id").agg(F.avg(hit.cast("double")).alias("coverage"))


def quiz_metrics(asked: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, num_questions, bloom_diversity, duplicate_pairs, pct_with_explanation, kb_term_coverage."""
    base = asked.groupBy("doc_id").agg(F.count("*").alias("num_questions"), F.countDistinct(F.nullif("bloom", F.lit(""))).alias("bloom_diversity"), F.bround(F.avg((F.char_length(F.trim(F.coalesce("justification", F.lit("")))) >= 10).cast("double")), 3).alias("pct_with_explanation"))
    pairs = duplicate_pairs(asked).groupBy("doc_id").agg(F.count("*").alias("p"))
    joined = base.join(pairs, "doc_id", "left").join(term_coverage(asked, atoms), "doc_id", "left")
    return joined.select("doc_id", "num_questions", "bloom_diversity", F.coalesce("p", F.lit(0)).alias("duplicate_pairs"), "pct_with_explanation", F.bround(F.coalesce("coverage", F.lit(0.0)), 3).alias("kb_term_coverage"))


def outline_coherence(outline: DataFrame, slides: DataFrame) -> DataFrame:
    """doc_id, coherence: the share of outline titles (doc_id, title) that a slide's title is much like."""
    o = outline.select("doc_id", F.monotonically_increasing_id().alias("o"), metric_tokens(F.coalesce("title", F.lit(""))).alias("a"))
    s = slides.select(F.col("doc_id").alias("s_doc"), metric_tokens(F.col("title")).alias("b"))
    met = o.join(s, F.col("doc_id") == F.col("s_doc"), "left").groupBy("doc_id", "o").agg(F.max(F.coalesce(jaccard(F.col("a"), F.col("b")), F.lit(0.0))).alias("best"))
    return met.groupBy("doc_id").agg(F.bround(F.avg((F.col("best") >= OUTLINE_MATCH).cast("double")), 3).alias("coherence"))


def deck_metrics(plan: DataFrame, shown: DataFrame, conclusions: DataFrame | None = None) -> DataFrame:
    """doc_id, num_slides_total, num_content_slides, avg_bullets, slides_with_few, slides_with_many, bullets_total, index_coherence."""
    per = shown.groupBy("doc_id", "slide_index").agg(F.count("*").alias("n"))
    built = plan.join(per, ["doc_id", "slide_index"])
    base = built.groupBy("doc_id").agg(F.count("*").alias("num_content_slides"), F.bround(F.avg("n"), 2).alias("avg_bullets"), F.sum((F.col("n") < 3).cast("int")).alias("slides_with_few"), F.sum((F.col("n") > 5).cast("int")).alias("slides_with_many"), F.sum("n").alias("bullets_total"))
    ended = conclusions.select("doc_id").distinct().withColumn("c", F.lit(1)) if conclusions is not None else base.select("doc_id").withColumn("c", F.lit(0))
    joined = base.join(outline_coherence(plan, built), "doc_id", "left").join(ended, "doc_id", "left")
    return joined.select("doc_id", (F.col("num_content_slides") + 2 + F.coalesce("c", F.lit(0))).alias("num_slides_total"), "num_content_slides", "avg_bullets", "slides_with_few", "slides_with_many", "bullets_total", F.col("coherence").alias("index_coherence"))


def deck_json(kb: DataFrame, plan: DataFrame, shown: DataFrame, conclusions: DataFrame | None = None) -> DataFrame:
    """doc_id, deck: each deck as JSON: title, outline (titles planned), slides (title, bullets, kind) of those with bullets, conclusion."""
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])
    per = shown.groupBy("doc_id", "slide_index").agg(ordered("bullet_index", F.col("bullet")).alias("bullets"))
    slides = plan.join(per, ["doc_id", "slide_index"], "left")
    slide = F.when(F.col("bullets").isNotNull(), F.struct("title", "bullets", "kind"))
    built = slides.groupBy("doc_id").agg(ordered("slide_index", F.col("title")).alias("outline"), F.filter(ordered("slide_index", slide), lambda s: s.isNotNull()).alias("slides"))
    named = kb.select("doc_id", F.col("main_topic").alias("title")).join(built, "doc_id")
    none = F.array().cast("array<string>")
    if conclusions is None:
        named = named.withColumn("conclusion", none)
    else:
        named = named.join(conclusions.groupBy("doc_id").agg(ordered("n", F.col("text")).alias("conclusion")), "doc_id", "left").withColumn("conclusion", F.coalesce("conclusion", none))
    return named.select("doc_id", F.to_json(F.struct("title", "outline", "slides", "conclusion")).alias("deck"))

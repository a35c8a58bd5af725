"""Records of runs: flat rows, upserts, averages, templates for judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.functions.text import path_name, safe_double
from lectio.functions.values import AVERAGED, DECK_CRITERIA, QUIZ_CRITERIA


#: Columns of a summary
SUMMARY = """pdf_id pdf_title model status error pdf_length_category pdf_has_images pdf_has_tables time_total_s time_kb_s time_quiz_s time_pptx_s kb_atoms kb_subtopics
quiz_num_questions quiz_bloom_diversity quiz_duplicate_pairs quiz_pct_explanation quiz_kb_term_coverage
pptx_num_slides_total pptx_num_content_slides pptx_avg_bullets pptx_bullets_total pptx_index_coherence""".split()


def flat(records: DataFrame) -> DataFrame:
    """One row of 24 columns, SUMMARY, for each record."""
    g = lambda path, name: F.col(path).alias(name)
    return records.select(
        "pdf_id", "pdf_title", "model", "status", F.left(F.replace(F.coalesce("error", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(300)).alias("error"),
        g("pdf_info.length_category", "pdf_length_category"), g("pdf_info.has_images", "pdf_has_images"), g("pdf_info.has_tables", "pdf_has_tables"),
        g("timings.total_s", "time_total_s"), g("timings.kb_s", "time_kb_s"), g("timings.quiz_s", "time_quiz_s"), g("timings.pptx_s", "time_pptx_s"),
        g("kb_info.atoms", "kb_atoms"), g("kb_info.subtopics", "kb_subtopics"),
        g("quiz_metrics.num_questions", "quiz_num_questions"), g("quiz_metrics.bloom_diversity", "quiz_bloom_diversity"), g("quiz_metrics.duplicate_pairs", "quiz_duplicate_pairs"), g("quiz_metrics.pct_with_explanation", "quiz_pct_explanation"), g("quiz_metrics.kb_term_coverage", "quiz_kb_term_coverage"),
        g("pptx_metrics.num_slides_total", "pptx_num_slides_total"), g("pptx_metrics.num_content_slides", "pptx_num_content_slides"), g("pptx_metrics.avg_bullets_per_slide", "pptx_avg_bullets"), g("pptx_metrics.bullets_total", "pptx_bullets_total"), g("pptx_metrics.index_coherence", "pptx_index_coherence"),
    )


def upserted(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing with its rows replaced by, and joined by, the last of each key in new."""
    struct = F.struct(*(F.col(c) for c in new.columns))
    last = new.groupBy(*keys).agg(F.max_by(struct, F.struct(*order)).alias("r")).select("r.*")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def model_averages(summary: DataFrame) -> DataFrame:
    """model, runs_ok and the mean of each AVERAGED column, without blanks, to three digits, over runs with status ok."""
    means = [F.bround(F.avg(safe_double(F.col(c).cast("string"))), 3).alias(c) for c in AVERAGED if c in summary.columns]
    return summary.filter("status = 'ok'").groupBy("model").agg(F.count("*").alias("runs_ok"), *means)


def execution(pdf: Column, model: Column) -> Column:
    """The name of a run."""
    return F.concat_ws("__", pdf, path_name(model))


def present(c: Column) -> Column:
    """Whether a summary has a value there: neither null nor blank nor nan."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin("", "nan"), F.lit(False))


def judging_template(summary: DataFrame) -> DataFrame:
    """A row for each run with status ok, artifact it has and criterion, to be filled in."""
    none = F.array().cast("array<struct<artifact_type: string, criterion: string>>")
    rows_of = lambda artifact, criteria: F.transform(F.array(*map(F.lit, criteria)), lambda c: F.struct(F.lit(artifact).alias("artifact_type"), c.alias("criterion")))
    both = F.concat(
        F.when(present(F.col("quiz_num_questions")), rows_of("quiz", QUIZ_CRITERIA)).otherwise(none),
        F.when(present(F.col("pptx_num_slides_total")), rows_of("pptx", DECK_CRITERIA)).otherwise(none),
    )
    rows = summary.filter("status = 'ok'").select("pdf_id", "model", F.inline(both))
    return rows.select(execution(F.col("pdf_id"), F.col("model")).alias("execution_id"), "pdf_id", "model", "artifact_type", "criterion", F.lit(None).cast("int").alias("score_1_5"), F.lit("").alias("notes"))


def score_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "artifact", "criterion").agg(F.count("*").alias("n"), F.bround(F.avg("score"), 2).alias("mean_score"))


def run_matrix(catalog: DataFrame, models: list[str]) -> DataFrame:
    """Each entry of the catalog with each model."""
    return catalog.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def requested(catalog: DataFrame, ids: list[str]) -> DataFrame:
    """The entries asked for, with their place in the request. Ids that the catalog doesn't have are an error."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col("id"))
    found = catalog.withColumn("place", place).filter("place > 0")
    missing = sorted(set(ids) - {r["id"] for r in found.select("id").distinct().collect()})  # no more than were asked for
    if missing:
        raise ValueError(f"not in the catalog: {', '.join(missing)}")
    return found


def run_status(quiz_error: Column, deck_error: Column) -> Column:
    """ok if one of the artifacts came without an error."""
    return F.when(quiz_error.isNull() | deck_error.isNull(), "ok").otherwise("error")

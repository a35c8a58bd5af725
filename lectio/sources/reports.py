"""Reports of runs as files: records by document and model, summary, averages, template and rubric for judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.functions.text import path_name
from lectio.functions.values import CRITERION_QUESTIONS, DECK_CRITERIA, QUIZ_CRITERIA, SCORE_NAMES
from lectio.operators.prompts import judge_prompt
from lectio.operators.runs import execution, judging_template, model_averages
from lectio.sources.records import write_summary_csv

#: Columns of a folder's name; the record keeps its own, whose characters a path might not take
PLACE = ("run_pdf", "run_model")


def write_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines in a folder for each document and model. One task writes a run, so there are as many files as
    runs; folders that get no record stay as they are."""
    placed = records.withColumn(PLACE[0], path_name(F.col("pdf_id"))).withColumn(PLACE[1], path_name(F.col("model")))
    placed.repartition(*PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).json(path)


def written_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_records wrote."""
    return spark.read.schema(schema).json(path, recursiveFileLookup=True).filter("pdf_id IS NOT NULL AND model IS NOT NULL")


def eval_prompts(runs: DataFrame) -> DataFrame:
    """execution_id, artifact, prompt: a request for each artifact that a run (pdf_id, pdf_title, model, quiz, deck as JSON) has."""
    found = None
    for artifact, column in (("quiz", "quiz"), ("pptx", "deck")):
        source = F.concat(F.coalesce("pdf_title", F.lit("")), F.lit(" ("), F.col("pdf_id"), F.lit("), "), F.col("model"))
        rows = runs.filter(F.col(column).isNotNull()).select(execution(F.col("pdf_id"), F.col("model")).alias("execution_id"), F.lit(artifact).alias("artifact"), judge_prompt(artifact, source, F.col(column)).alias("prompt"))
        found = rows if found is None else found.unionByName(rows)
    return found


def rubric(spark: SparkSession) -> DataFrame:
    """n, line: scale and criteria of both artifacts, in order."""
    lines = ["Escala: " + ", ".join(f"{i} {name}" for i, name in enumerate(SCORE_NAMES, 1))]
    for title, criteria in (("Cuestionario", QUIZ_CRITERIA), ("Presentación", DECK_CRITERIA)):
        lines += ["", title] + [f"{c}: {CRITERION_QUESTIONS[title][c]}" for c in criteria]
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


def write_reports(summary: DataFrame, path: str) -> dict[str, str]:
    """Writes the four reports of flat run records under path and gives their places."""
    places = {name: f"{path}/{name}" for name in ("summary", "model_averages", "manual_template", "rubric")}
    write_summary_csv(summary, places["summary"])
    write_summary_csv(model_averages(summary), places["model_averages"])
    write_summary_csv(judging_template(summary), places["manual_template"])
    # one partition: a dozen lines whose order is the file's
    rubric(summary.sparkSession).orderBy("n").coalesce(1).select("line").write.mode("overwrite").text(places["rubric"])
    return places

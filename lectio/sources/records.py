"""Sources and sinks of catalogs, run records and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.operators.runs import SUMMARY

RECORD = """pdf_id string, pdf_title string, pdf_filename string, model string, status string, error string,
timings struct<kb_s: double, quiz_s: double, pptx_s: double, total_s: double>,
pdf_info struct<length_category: string, has_images: boolean, has_tables: boolean>,
kb_info struct<atoms: int, subtopics: int, main_topic: string, definitions: int, examples: int, formulas_code: int, numeric_data: int, relations: int>,
quiz_metrics struct<num_questions: int, bloom_distribution: map<string, int>, bloom_diversity: int, duplicate_pairs: int, pct_with_explanation: double, kb_term_coverage: double, error: string>,
pptx_metrics struct<num_slides_total: int, num_content_slides: int, avg_bullets_per_slide: double, slides_with_few_bullets: int, slides_with_many_bullets: int, bullets_total: int, index_coherence: double, has_conclusion: boolean, error: string>,
artifacts struct<quiz: string, pptx: string, plan: string>"""


def catalog(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The entries of a catalog (a JSON object with the list `pdfs`) that have an id and a file name; with a folder, those whose file
    is there, with its path and length. A catalog of which nothing is left is an error."""
    schema = "pdfs array<struct<id: string, filename: string, title: string, num_chars: bigint, has_tables: boolean, has_images: boolean, domain: string, length_category: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("pdfs"))
    rows = rows.withColumn("id", F.trim("id")).withColumn("filename", F.trim("filename")).filter("coalesce(id, '') <> '' AND coalesce(filename, '') <> ''")
    rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "id"))
    if folder is not None:
        files = spark.read.format("binaryFile").load(folder).select("path", "length")  # contents aren't read
        rows = rows.join(files.withColumn("filename", F.substring_index("path", "/", -1)), "filename")
    if not rows.take(1):
        raise RuntimeError(f"nothing of the catalog {path} is there")
    return rows


def length_category(chars):
    """bajo up to 20,000 characters, medio up to 50,000, alto beyond."""
    return F.when(chars <= 20_000, "bajo").when(chars <= 50_000, "medio").otherwise("alto")


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of runs, one a JSON file; what can't be read or has no id or model is passed over."""
    return spark.read.schema(RECORD).json(path, multiLine=True, mode="PERMISSIVE").filter("pdf_id IS NOT NULL AND model IS NOT NULL")


def report_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report in CSV, whichever of ; and , it uses, with or without a byte order mark."""
    head = spark.read.text(path).limit(1).first()
    line = (head[0] if head else "")[:2048]
    rows = spark.read.csv(path, header=True, sep=";" if line.count(";") >= line.count(",") else ",")
    return rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))


def summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """A summary in the columns of SUMMARY: empty where an older file lacks one, without what it has beside them."""
    rows = report_csv(spark, path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in SUMMARY))


def write_summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=";")


def judge_scores(spark: SparkSession, path: str) -> DataFrame:
    """model, source, artifact, criterion, score, comment from judges' files, which hold the criteria at the top or in one
    of several wrappers; quiz or pptx is in the file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return flat_scores(raw.withColumn("artifact", F.regexp_extract("file", r"_(quiz|pptx)_[^/]*$", 1)))


def flat_scores(raw: DataFrame) -> DataFrame:
    wrappers = ("quiz_evaluation", "evaluation_quiz", "presentation_evaluation", "evaluation_presentation")
    body = F.coalesce(*(F.get_json_object("value", f"$.{w}") for w in wrappers), F.col("value"))
    fields = F.explode(F.from_json(body, "map<string, string>")).alias("criterion", "found")
    rows = raw.select("artifact", F.get_json_object("value", "$.metadata.model_used").alias("model"), F.get_json_object("value", "$.metadata.pdf_source").alias("source"), fields)
    score = F.get_json_object("found", "$.score").try_cast("int")
    return rows.select("model", F.lower("source").alias("source"), "artifact", "criterion", score.alias("score"), F.get_json_object("found", "$.comment").alias("comment")).filter("score IS NOT NULL")

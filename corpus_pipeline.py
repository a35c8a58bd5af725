"""From documents to packed training sequences: five of the operators, one after the other.

Each stage works on all rows that the one before it kept. All but the last return the columns of documents. A stage's result
is written before the next stage begins; what the stage itself has written for that goes then, so that the shared folder
holds the tables of one stage and not of all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.functions import tables
from lectio.llm import line_dedup, mixing, packing, quality_rules, simhash
from lectio.llm.common import table, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The written tables of the stage that ran last, by context
_last: dict[str, list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """The stage, after which its written tables are noted, and before which those of the stage before go, unless docs still
    reads them because it was not written in between."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        context = spark.sparkContext.applicationId
        old = _last.pop(context, [])
        read = docs.inputFiles() if old else []
        tables.dropped(spark, [p for p in old if not any(p.rsplit("/", 1)[-1] in f for f in read)])
        place = tables.mark(spark)
        found = stage(spark, docs, sf_dir)
        _last[context] = tables.since(spark, place)
        return found

    return run


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    return quality_rules.keep(docs)


@tidy
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    found = line_dedup.dedup(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else found


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: linked by SimHash fingerprints and
    checked, then what these can't tell by the sets of shingles."""
    return simhash.dedup(docs)


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights, in the order of the mix; a document that is taken twice is there twice. n_chars
    follows the text, which may be cut for the last document of a source."""
    found = mixing.mix(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else found


@tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fingerprints, similar groups and token ids are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            place = tables.mark(spark)
            docs = written(docs, "stage")
            tables.dropped(spark, before)
            before = tables.since(spark, place)
    return docs

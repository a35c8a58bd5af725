"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.plans import corpus, scaled, study

Query = Callable[[SparkSession, str], DataFrame]


def long_integers(query: Query) -> Query:
    """The query with all whole numbers as long, as the SQL has them."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))

    return run


QUERIES: dict[str, Query] = {n: long_integers(q) for n, q in {**corpus.QUERIES, **study.QUERIES, **scaled.QUERIES}.items()}
ORACLES: dict[str, str] = {**corpus.ORACLES, **study.ORACLES, **scaled.ORACLES}

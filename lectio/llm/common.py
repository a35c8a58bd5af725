"""Small helpers that the operators share: reading a table, and from the library the shared folder and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectio.functions.deploy import deployed, ship  # noqa: F401
from lectio.functions.tables import shared_dir, written  # noqa: F401  the operators take both from here

#: The white space of every contract: space, \t, \n, \v, \f and \r. bytes.split() splits at exactly these.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return deployed(spark).read.parquet(f"{sf_dir}/{name}.parquet")

"""A model's answer read once: the JSON in it as a VARIANT, of which fields are taken by any of their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.functions.text import json_body


def parsed(answers: DataFrame, keep: Iterable[str], name: str = "v") -> DataFrame:
    """The columns `keep` and the payload's JSON as a VARIANT, null where there is none. A generator stands between: what is read
    of it later doesn't parse it again."""
    return answers.select(*keep, F.explode(F.array(F.try_parse_json(json_body(F.col("payload"))))).alias(name))


def path(*names: str) -> str:
    return "$" + "".join(f"['{n}']" for n in names)


def text_at(v: Column, *names: str) -> Column:
    """What is there as a text (lists and objects as JSON), bare; null where nothing is said."""
    return F.nullif(F.nullif(F.trim(F.try_variant_get(v, path(*names), "string")), F.lit("")), F.lit("[]"))


def picked(v: Column, names: Iterable[str]) -> Column:
    """The first of the fields that says something."""
    return F.coalesce(*(text_at(v, n) for n in names))


def unwrapped(v: Column, wrappers: Iterable[str], probes: Iterable[str]) -> Column:
    """What the first wrapper holds that is an object with one of the fields; else the whole."""
    probes = list(probes)
    holds = lambda w: F.coalesce(*(F.try_variant_get(v, path(w, p), "string") for p in probes)).isNotNull()
    return F.coalesce(*(F.when(holds(w), F.try_variant_get(v, path(w), "variant")) for w in wrappers), v)


def entries(v: Column, *names: str) -> Column:
    """The objects of the list that is there, as maps of text, each with its place: array of (pos, m). Null where there is no list."""
    found = F.try_variant_get(v, path(*names), "array<variant>")
    every = F.transform(found, lambda x, i: F.struct(i.alias("pos"), F.try_variant_get(x, "$", "map<string, string>").alias("m")))
    return F.filter(every, lambda e: e["m"].isNotNull())


def texts(c: Column) -> Column:
    """A list of texts from a JSON array as a text."""
    return F.try_variant_get(F.try_parse_json(c), "$", "array<string>")

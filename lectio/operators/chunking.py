"""Sections, chunks with overlap, table repair, partial summaries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.deploy import deployed
from lectio.functions.values import CHUNK_CHARS, CHUNK_OVERLAP

HEADING = re.compile(r"(?m)^(?=#{1,6}\s)")
BLANK_LINE = re.compile(r"\n\s*\n")


def sections(text: Column) -> Column:
    """The text cut before each heading, bare, without empty parts."""
    parts = F.split(text, r"(?m)^(?=#{1,6}\s)", -1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def filled(units: Iterable[str], most: int) -> Iterator[str]:
    """Units joined by blank lines as long as they fit."""
    held = ""
    for unit in units:
        if held and len(held) + len(unit) + 2 > most:
            yield held.strip()
            held = unit
        else:
            held = f"{held}\n\n{unit}" if held else unit
    if held:
        yield held.strip()


def pieces(text: str, most: int) -> Iterator[str]:
    """The chunks of a text before they overlap. Sections fill chunks; a section that is too long does so by its
    paragraphs, and a paragraph that is too long is sliced."""
    waiting: list[str] = []
    parts = [p for p in (s.strip() for s in HEADING.split(text)) if p] or [text]
    for part in parts:
        if len(part) <= most:
            waiting.append(part)
            continue
        yield from filter(str.strip, filled(waiting, most))
        waiting = []
        for paragraph in BLANK_LINE.split(part):
            if len(paragraph) <= most:
                waiting.append(paragraph)
                continue
            yield from filled(waiting, most)
            waiting = []
            yield from (paragraph[k : k + most] for k in range(0, len(paragraph), most))
        yield from filled(waiting, most)
        waiting = []
    yield from filter(str.strip, filled(waiting, most))


def chunks(docs: DataFrame, most: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_index, text: each chunk but a document's first begins with the end of the one before it."""
    deployed(docs.sparkSession)

    @F.arrow_udf("array<string>")
    def lectio_pieces(texts: pa.Array) -> pa.Array:
        return pa.array([list(pieces(t or "", most)) for t in texts.to_pylist()], pa.list_(pa.string()))

    cut = docs.select("doc_id", lectio_pieces("text").alias("raw"))
    before = F.right(F.element_at("raw", F.col("chunk_index")), F.lit(overlap))
    rows = cut.select("doc_id", "raw", F.posexplode("raw").alias("chunk_index", "piece"))
    text = F.when((F.col("chunk_index") == 0) | F.lit(overlap <= 0), F.col("piece")).otherwise(F.concat(before, F.lit("\n\n"), F.col("piece")))
    return rows.select("doc_id", "chunk_index", text.alias("text"))


def summarised(chunked: DataFrame, summarise: Column | None = None) -> DataFrame:
    """doc_id and partials: a summary of each chunk (any text function as a column; the chunk itself without one), numbered
    and joined in order."""
    text = F.col("text") if summarise is None else summarise
    rows = chunked.select("doc_id", "chunk_index", text.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    parts = F.transform(ordered, lambda c: F.concat(F.lit("[Resumen parcial "), (c["chunk_index"] + 1).cast("string"), F.lit("]\n"), c["text"]))
    return rows.groupBy("doc_id").agg(F.array_join(parts, "\n\n---\n\n").alias("partials"))


def is_table_row(line: Column) -> Column:
    t = F.trim(line)
    return F.startswith(t, F.lit("|")) & (F.char_length(t) - F.char_length(F.replace(t, F.lit("|"), F.lit(""))) >= 2)


def repaired_tables(docs: DataFrame) -> DataFrame:
    """doc_id, line_index, line: lines that broke off from a table row are joined to it. After a row, up to the next blank
    line, whatever isn't a row belongs to the line before."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    row, blank = is_table_row(F.col("raw")), F.trim("raw") == ""
    clean = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?i)<br\s*/?>", " / "), r"\s+", " "))
    shown = F.when(row, clean).otherwise(F.regexp_replace("raw", r"\s+$", ""))
    by = W.partitionBy("doc_id").orderBy("at")
    sofar = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.select(
        "doc_id", "at", "raw", shown.alias("shown"), row.alias("is_row"), blank.alias("is_blank"),
        F.last(F.when(row, F.col("at")), True).over(sofar).alias("last_row"), F.last(F.when(blank, F.col("at")), True).over(sofar).alias("last_blank"),
    )
    joins = ~F.col("is_row") & ~F.col("is_blank") & (F.col("last_row") > F.coalesce("last_blank", F.lit(-1)))
    marked = marked.withColumn("joins", F.coalesce(joins, F.lit(False)))
    numbered = marked.withColumn("line_index", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(sofar) - 1)
    part = F.when(F.col("joins"), F.trim("raw")).otherwise(F.col("shown"))
    joined = numbered.groupBy("doc_id", "line_index").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("t")))).alias("parts"))
    return joined.select("doc_id", F.col("line_index").cast("int").alias("line_index"), F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("line"))

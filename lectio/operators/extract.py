"""What can be taken literally from a text: definitions, code, formulas, key terms, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.text import clean_definition, clean_term, stripped
from lectio.functions.values import HEADING_TERMS_OUT

# --- fixed values: what counts as a definition, code, a formula or a term --------------------------------------------
BOLD_COLON = r"\*\*([^*\n]{2,80})\*\*\s*[:\-—]\s*([^.\n]{10,300}\.)"
IS_A = (
    r"(?U)(?<![\w¿])((?:[A-ZÁÉÍÓÚÜÑ][\wÁÉÍÓÚÜÑáéíóúüñ\-]*(?:\s+[a-záéíóúüñ]{1,4}\s+|\s+)){0,3}[A-ZÁÉÍÓÚÜÑ][\wÁÉÍÓÚÜÑáéíóúüñ\-]*)"
    r"\s+(?:es|son)\s+([^.;:\n]{8,240}[.;:])"
)
CALLED = r"(?iU)Se\s+(?:llama|denomina|define(?:\s+como)?)\s+([\wÁÉÍÓÚÜÑáéíóúüñ\-]{2,60})\s+(?:a|como)\s+([^.;:\n]{8,240}[.;:])"
FENCE = r"(?s)```([a-zA-Z0-9_+\-]*)\s*\n(.*?)```"
FORMULA = r"(?m)^\s*([^\n]{3,160}=[^\n]{1,160})\s*$"
FORMULA_SIGN = r"[\d\+\-\*/\^±√π∑∏∞≤≥≠∈∉⊂⊃∪∩∂Δ∇αβγδεθλμνξρστφχψω]"
BOLD = r"\*\*([^\*\n]{2,60})\*\*"
TITLE = r"(?m)^#{1,6}\s+(.+?)\s*$"
MAX_DEFINITIONS, MAX_CODE, CODE_CHARS, MAX_FORMULAS, MAX_TERMS = 20, 10, 1500, 15, 60


def matches(c: Column, pattern: str, groups: int = 1) -> Column:
    """Structs g1.. of all matches, in order."""
    found = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)]
    return F.arrays_zip(*found)


def firsts(rows: DataFrame, key: Column, order: list[str], most: int, rank: str) -> DataFrame:
    """Of rows of one doc_id and key the first by order; then the first `most` of a document, numbered from 1."""
    once = rows.withColumn("lectio_key", key).withColumn("lectio_n", F.row_number().over(W.partitionBy("doc_id", "lectio_key").orderBy(*order)))
    once = once.filter("lectio_n = 1 AND lectio_key <> ''").drop("lectio_key")
    numbered = once.withColumn(rank, F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    return numbered.filter(F.col(rank) <= most).drop("lectio_n")


def definitions(docs: DataFrame) -> DataFrame:
    """doc_id, n, term, definition. A bold term with a colon comes before X es Y, that before Se llama X a Y; the first
    definition of a term stays."""
    found = []
    for rank, pattern in enumerate((BOLD_COLON, IS_A, CALLED)):
        likely = {0: F.contains("text", F.lit("**")), 1: F.col("text").rlike(r"\s(?:es|son)\s"), 2: F.col("text").rlike(r"(?i)se\s")}[rank]
        rows = docs.filter(likely).select("doc_id", F.posexplode(matches(F.col("text"), pattern, 2)).alias("pos", "m"))
        rows = rows.select("doc_id", F.lit(rank).alias("rank"), "pos", clean_term(F.col("m.g1")).alias("term"), clean_definition(F.col("m.g2")).alias("definition"))
        rows = rows.filter("term <> '' AND definition <> ''")
        if rank:
            words = lambda c: F.size(F.split(F.trim(c), r"(?U)\s+"))
            rows = rows.filter((F.char_length("term") <= 60) & (words("term") <= 6) & (words("definition") >= 3))
        found.append(rows)
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return firsts(rows, F.lower("term"), ["rank", "pos"], MAX_DEFINITIONS, "n").select("doc_id", "n", "term", "definition")


def code_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, n, language (null where none is named), content (cut to CODE_CHARS)."""
    rows = docs.filter(F.contains("text", F.lit("```"))).select("doc_id", F.posexplode(matches(F.col("text"), FENCE, 2)).alias("pos", "m"))
    body = F.regexp_replace("m.g2", r"(?U)\s+$", "")
    cut = F.when(F.char_length(body) > CODE_CHARS, F.concat(F.regexp_replace(F.left(body, F.lit(CODE_CHARS - 1)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(body)
    rows = rows.select("doc_id", "pos", F.nullif("m.g1", F.lit("")).alias("language"), cut.alias("content")).filter(F.trim("content") != "")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).filter(F.col("n") <= MAX_CODE).select("doc_id", "n", "language", "content")


def formulas(docs: DataFrame) -> DataFrame:
    """doc_id, n, content: whole lines with one to three = signs, a digit or a mathematical sign, 18 words at most."""
    rows = docs.filter(F.contains("text", F.lit("="))).select("doc_id", F.posexplode(matches(F.col("text"), FORMULA)).alias("pos", "m"))
    rows = rows.select("doc_id", "pos", stripped(F.col("m.g1")).alias("content"))
    signs = F.char_length("content") - F.char_length(F.replace("content", F.lit("="), F.lit("")))
    rows = rows.filter((signs <= 3) & F.col("content").rlike(FORMULA_SIGN) & (F.size(F.split("content", r"(?U)\s+")) <= 18))
    return firsts(rows, F.lower("content"), ["pos"], MAX_FORMULAS, "n").select("doc_id", "n", "content")


def key_terms(docs: DataFrame) -> DataFrame:
    """doc_id, n, term: bold terms, then titles."""
    text = F.col("text")
    bold = F.transform(matches(text, BOLD), lambda m, i: F.struct(F.lit(0).alias("rank"), i.alias("pos"), clean_term(m["g1"]).alias("term")))
    titles = F.transform(matches(text, TITLE), lambda m, i: F.struct(F.lit(1).alias("rank"), i.alias("pos"), clean_term(m["g1"]).alias("term")))
    titles = F.filter(titles, lambda t: ~F.lower(t["term"]).isin(*HEADING_TERMS_OUT))
    rows = docs.select("doc_id", F.inline(F.concat(bold, titles)))
    rows = rows.withColumn("term", stripped(F.col("term"))).filter("char_length(term) BETWEEN 2 AND 80")
    return firsts(rows, F.lower("term"), ["rank", "pos"], MAX_TERMS, "n").select("doc_id", "n", "term")


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, pos, level, title of all headings."""
    rows = docs.select("doc_id", F.posexplode(matches(F.col("text"), r"(?m)^(#{1,6})\s+(.+?)\s*$", 2)).alias("pos", "m"))
    return rows.select("doc_id", "pos", F.char_length("m.g1").alias("level"), stripped(F.col("m.g2")).alias("title"))


def hints(docs: DataFrame) -> dict[str, DataFrame]:
    return {"definitions": definitions(docs), "code": code_blocks(docs), "formulas": formulas(docs), "terms": key_terms(docs)}


def without_hints(docs: DataFrame) -> DataFrame:
    """The ids of documents in which there is no hint of any kind."""
    kinds = [h.select("doc_id") for h in hints(docs).values()]
    some = kinds[0]
    for h in kinds[1:]:
        some = some.unionByName(h)
    return docs.select("doc_id").distinct().join(some.distinct(), "doc_id", "left_anti")


def hint_block(docs: DataFrame, most: int = 3500) -> DataFrame:
    """doc_id, block: all hints as Markdown lines under headings, whole lines of `most` characters at most, then an ellipsis."""
    h = hints(docs)
    line = lambda df, order, text: df.select("doc_id", F.lit(order).alias("part"), "n", text.alias("line"))
    rows = (
        line(h["definitions"], 0, F.concat(F.lit("- **"), F.col("term"), F.lit("**: "), F.col("definition")))
        .unionByName(line(h["code"], 1, F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("content"), F.lit("\n```"))))
        .unionByName(line(h["formulas"], 2, F.concat(F.lit("- "), F.col("content"))))
        .unionByName(line(h["terms"], 3, F.concat(F.lit("- "), F.col("term"))))
    )
    title = F.element_at(F.array(*map(F.lit, ("### Definiciones", "### Código", "### Fórmulas", "### Términos"))), F.col("part") + 1)
    first = F.row_number().over(W.partitionBy("doc_id", "part").orderBy("n")) == 1
    rows = rows.withColumn("line", F.when(first, F.concat(title, F.lit("\n"), F.col("line"))).otherwise(F.col("line")))
    upto = F.sum(F.char_length("line") + 1).over(W.partitionBy("doc_id").orderBy("part", "n"))
    rows = rows.withColumn("upto", upto)
    kept = F.array_sort(F.collect_list(F.when(F.col("upto") <= most, F.struct("part", "n", "line"))))
    text = F.array_join(F.transform(kept, lambda r: r["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.when(F.max("upto") > most, F.concat(text, F.lit("\n…"))).otherwise(text).alias("block"))

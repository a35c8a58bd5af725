"""Sources: tables of documents and pages, HTML as Markdown, page-level checks of scanned input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.values import MAX_INPUT_CHARS, MAX_PAGES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_of(html: Column) -> Column:
    """HTML as Markdown: headings, bold, list items and line breaks; no scripts, styles, navigation, comments or tags."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|head)\b.*?</\1>", "")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, r"(?i)</?(?:b|strong)\b[^>]*>", "**")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)<br\b[^>]*>|</?(?:p|h[1-6]|ul|ol|div|article|section)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for mark, what in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(mark), F.lit(what))
    t = F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n")
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \t\n"))


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """doc_id and text (Markdown) of pages."""
    return pages.select(F.col("page_id").alias("doc_id"), markdown_of(F.col("html")).alias("text"))


def admitted(docs: DataFrame, pages: str | None = None) -> DataFrame:
    """docs with error_kind (empty, too_large or null) and the text cut to what is processed, a marker after the cut."""
    too_large = (F.col(pages) > MAX_PAGES) if pages else F.lit(False)
    text = F.when(F.char_length("text") > MAX_INPUT_CHARS, F.concat(F.left("text", F.lit(MAX_INPUT_CHARS)), F.lit("\n\n[cut]"))).otherwise(F.col("text"))
    kind = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(too_large, "too_large")
    return docs.withColumn("error_kind", kind).withColumn("text", text)


def scanned(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, scanned: fewer than 0.3 of its pages have 40 characters of text."""
    return pages.groupBy(doc).agg((F.avg((F.char_length(F.trim(F.coalesce(text, F.lit("")))) >= 40).cast("double")) < 0.3).alias("scanned"))


def captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, image, caption: the text of the block next to each image of 0.02 of the page or more (share, y0, y1), with
    page and size before it where images have width and height. Blocks have block, y0, y1, text; a caption of fewer than 10 or
    more than 300 characters is none, even if another block would do.

    Next to is where the image's lower edge is nearest to a block's upper one, or the other way round, of equally near blocks the
    first. A page's edges are sorted once: at each image the last block edge before it and the first one after it are the nearest."""
    images = images.filter("share >= 0.02")
    blocks = blocks.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " "))).filter("text <> ''")
    edge = lambda df, y, side, image, block: df.select("doc_id", "page", F.col(y).cast("double").alias("y"), F.lit(side).alias("side"), image.alias("image"), block.alias("block"))
    found = F.struct(F.col("block"), F.col("text"))
    nobody, nothing = F.lit(None).cast(images.schema["image"].dataType), F.lit(None).cast(blocks.select(found).schema[0].dataType)
    edges = edge(blocks, "y0", 0, nobody, found).unionByName(edge(blocks, "y1", 1, nobody, found))
    edges = edges.unionByName(edge(images, "y1", 0, F.col("image"), nothing)).unionByName(edge(images, "y0", 1, F.col("image"), nothing))
    by = W.partitionBy("doc_id", "page", "side")
    ends = [F.col("block").isNull(), F.col("block.block").desc()]  # at one place blocks first, the first of them last
    at = F.when(F.col("block").isNotNull(), F.struct(F.col("y"), F.col("block")))
    last = lambda *order: F.last(at, ignorenulls=True).over(by.orderBy(*order, *ends).rowsBetween(W.unboundedPreceding, 0))
    near = edges.withColumn("before", last(F.col("y").asc())).withColumn("after", last(F.col("y").desc())).filter("block IS NULL")
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("y") - F.col(f"{c}.y")).alias("gap"), F.col(f"{c}.block").alias("block")))
    best = near.groupBy("doc_id", "page", "image").agg(F.min(F.least(F.coalesce(gap("before"), gap("after")), F.coalesce(gap("after"), gap("before")))).alias("b"))
    best = best.select("doc_id", "page", "image", F.col("b.block.text").alias("caption")).filter("char_length(caption) BETWEEN 10 AND 300")
    if {"width", "height"} <= set(images.columns):
        size = images.groupBy("doc_id", "page", "image").agg(F.first(F.concat(F.lit("[p."), F.col("page"), F.lit(", "), F.col("width").cast("int"), F.lit("x"), F.col("height").cast("int"), F.lit("] "))).alias("place"))
        best = best.join(size, ["doc_id", "page", "image"]).withColumn("caption", F.concat("place", "caption"))
    return best.select("doc_id", "page", "image", "caption")


def image_counts(pages: DataFrame) -> DataFrame:
    """doc_id, n_images: the images of all pages (doc_id, images, null where a page could not be read)."""
    return pages.groupBy("doc_id").agg(F.sum(F.coalesce("images", F.lit(0)).cast("long")).alias("n_images"))


def with_context(markdown: Column, found: Column) -> Column:
    """The text with a section of its images' captions, where there are any."""
    lines = F.array_join(F.transform(F.array_distinct(found), lambda c: F.concat(F.lit("- "), c)), "\n")
    return F.when(F.size(found) > 0, F.concat(markdown, F.lit("\n\n## Contexto visual detectado\n"), lines)).otherwise(markdown)


def looks_tabular(markdown: Column) -> Column:
    return markdown.rlike(r"\n\s*\|?\s*-{3,}\s*\|")

"""Line dedup on the JVM alone: DataFrame functions, no Python on the executors.

The keys of all lines are hashed (128 bits) and range-partitioned by hash, document and text, with a secondary sort by
position, so that the lines of one very common key are spread over as many partitions as they need. Streaming through
that order, a window that needs no sort of its own, marks the first occurrence of a key in each document. Facts of a key (in
how many documents it is, the largest doc_id that has it) come from these marks, pre-aggregated in each range, and then meet, one
row a range. What
is to go comes back as a sparse bitmap for each document, never as text: 64 lines a word, only words with a dropped line.

Defined results. A null or empty text is one empty line. Each input row counts as a document and gives one row of the
result; rows with the same doc_id and the same text count each and get the same bitmap. A null doc_id is smaller than any other. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.llm.common import table, written

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z in lower case."""
    bare = F.btrim(line, F.lit(STRIPPED))
    # lower() is fast, and right where there are only ASCII characters
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, text_id, pos, first: every line with a key of min_chars code points or more; first: whether the key is at its
    first place in the document there. The hashes are written first, since ranges are found by a pass over a sample; a range is
    sorted by document and position, and streaming through it tells first places."""
    lines = docs.select("doc_id", text_id(F.col("text")).alias("text_id"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_id", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_id", "pos")
    by = ["h1", "h2", "doc_id", "text_id"]
    hashed = written(hashed, "hashes")
    ranged = hashed.repartitionByRange(*by).sortWithinPartitions(*by, "pos")
    least = F.first("pos").over(W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return ranged.select(*by, "pos", (F.col("pos") == least).alias("first"))  # rows that are equal have their first place each


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id and words, a row for each document that loses a line.

    words: array of (word, bits); line p is dropped where bit p % 64 of the word p / 64 is set. All other lines are kept.
    """
    found = written(occurrences(docs, min_chars), "lines")
    facts = found.filter("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays_in")).filter(F.col("n") >= min_docs)
    facts = written(facts, "facts")  # so that both sides of the join come from a shuffle of their own, which can be split where a key is hot
    goes = found.join(facts, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("stays_in")))
    bits = goes.select("doc_id", "text_id", F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, pos & 63)").alias("bit"))
    words = bits.repartition("doc_id", "text_id").groupBy("doc_id", "text_id", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs and the column lectio_words__ (null: nothing is dropped)."""
    b = bitmaps.select(F.col("doc_id").alias("lectio_doc__"), F.col("text_id").alias("lectio_text__"), F.col("words").alias("lectio_words__"))
    on = docs["doc_id"].eqNullSafe(b["lectio_doc__"]) & (text_id(docs["text"]) == b["lectio_text__"])
    return docs.join(b, on, "left").drop("lectio_doc__", "lectio_text__")


def kept_text(text: str = "text", words: str = "lectio_words__") -> Column:
    """The lines that the bitmap keeps, joined by \\n; the text itself where there is no bitmap."""
    gap = f"x.word - if(i = 0, 0, coalesce(get({words}, i - 1).word, 0) + 1)"
    dense = f"flatten(transform({words}, (x, i) -> concat(array_repeat(0L, {gap}), array(x.bits))))"
    kept = (
        f"array_join(transform(array(struct(split({text}, '\\n', -1) AS x, {dense} AS d)), "
        "s -> array_join(filter(s.x, (line, i) -> coalesce(shiftright(get(s.d, shiftright(i, 6)), i & 63) & 1L, 0L) = 0L), '\\n')), '')"
    )
    return F.when(F.col(words).isNull(), F.col(text)).otherwise(F.expr(kept))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs without the repeated lines, with the columns that docs has."""
    columns = docs.columns
    return with_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs)).withColumn("text", kept_text()).select(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_bitmaps(docs, drop_bitmaps(docs))
    return found.select(
        "doc_id",
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.expr("coalesce(aggregate(lectio_words__, 0L, (a, w) -> a + bit_count(w.bits)), 0L)").alias("n_dropped"),
        F.sha2(F.coalesce(kept_text(), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS stays_in FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.stays_in AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

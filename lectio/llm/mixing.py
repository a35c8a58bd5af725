"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled order, up to three times over. A copy's virtual finish time is the words
that its source has sent once it is through, divided by the source's target. The mix is all copies in the order of their
finish times, cut where the total budget is used up: targets sum up to the budget, so that is at time 1, where each source
has sent its target. The document that a source is sending then is taken in part, by its first words.

Cumulative sizes are prefix sums over fixed ranges of the shuffled order and windows within a range, so that no source is
ever in one task. In virtual time words come evenly: equal ranges of time are equal shares of the mix, and the global sort
is by range of time, then within the range.

The shuffled order is that of md5 over the doc_id, hence the same at every rerun and for any partitioning.

Defined results. A null text has size 0. A null source is a source, and the last. Rows that repeat a doc_id are
documents of their own; equal rows come next to each other. Documents without words are never taken; sources without
words have target 0. A null doc_id is shuffled as the empty string. Columns besides doc_id, text and source are ignored by
plan() and kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.llm.common import WORD, table, written

MAX_COPIES = 3
BUCKET_DIGITS = 3
#: A range of time of the mix has about so many words; beyond so many ranges they grow instead.
RANGE_WORDS, MOST_RANGES = 4 << 20, 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target. Sources that would get more than three times their size stop there, and the rest is
    shared again: in the order of size over weight, the sources that stop are the first ones."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(1))  # a row a source
    ranked = by.withColumn("weight", (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ratio = (F.col("source_size") * 6 / F.col("weight")).cast("long")
    before = one.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    d = "decimal(38,0)"
    left = F.sum("source_size").over(one).cast(d) - F.coalesce(F.sum(F.col("source_size") * MAX_COPIES).over(before), F.lit(0)).cast(d)
    weights = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    stops = ranked.select("*", left.alias("left"), weights.alias("weights")).withColumn(
        "stops", (F.col("left") * F.col("weight")).cast("decimal(38,0)") > (F.col("source_size") * MAX_COPIES * F.col("weights")).cast(d)
    )
    rest = F.sum("source_size").over(one) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size") * MAX_COPIES)).over(one), F.lit(0))
    shares = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(one)
    return stops.select(
        "source", "source_size",
        F.when(F.col("stops"), (F.col("source_size") * MAX_COPIES).cast("double")).otherwise((rest * F.col("weight")).cast("double") / shares.cast("double")).alias("target"),
    )


def plan(sized: DataFrame) -> DataFrame:
    """sized (source, mix_key, doc_id, size and others) with source_size, target and sent: the words that the source has
    sent once the document is through, the first time."""
    columns = sized.columns
    by_source = written(targets(sized), "targets").withColumnRenamed("source", "t_source")
    bucketed = sized.withColumn("bucket", F.substring("mix_key", 1, BUCKET_DIGITS))
    starts = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    starts = starts.withColumn("start", F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")) - F.col("in_bucket"))
    starts = starts.join(by_source, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "start", "source_size", "target")
    within = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    found = bucketed.withColumn("within", within).join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    return found.select(*columns, "source_size", "target", (F.col("within") + F.col("start")).alias("sent"))


def words_of(copy: int) -> Column:
    """How many words of a copy (of plan()) come before the end of the mix."""
    begins = copy * F.col("source_size") + F.col("sent") - F.col("size")
    return F.greatest(F.lit(0).cast("long"), F.least("size", F.floor("target").cast("long") - begins))


def finish(sent: Column) -> Column:
    return F.when(F.col("target") > 0, sent.cast("double") / F.col("target"))


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and the shuffled order's key of each document, written once."""
    return written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("mix_key"), *more), "sizes")


def range_of(time: Column, ranges: int) -> Column:
    """Equal ranges of virtual time, which are equal shares of the words of a mix."""
    return F.least(F.floor(time * ranges).cast("int"), F.lit(ranges - 1))


def ordered(copies: DataFrame, ranges: int | None = None) -> DataFrame:
    """copies (number, copy, words, time, mix_key) in the order of the mix with through, the words of the mix up to the end of each:
    a prefix sum over ranges of time and a window within each range."""
    if ranges is None:
        ranges = min(MOST_RANGES, 1 + (copies.agg(F.sum("words")).first()[0] or 0) // RANGE_WORDS)
    placed = copies.withColumn("range", range_of(F.col("time"), ranges))
    sums = placed.groupBy("range").agg(F.sum("words").alias("in_range"))
    sums = sums.select(F.col("range").alias("r_range"), (F.sum("in_range").over(W.partitionBy(F.lit(1)).orderBy("range")) - F.col("in_range")).alias("start"))  # MOST_RANGES rows at most
    within = F.sum("words").over(W.partitionBy("range").orderBy("time", "mix_key", "copy", "number").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("within", within).join(sums, F.col("range") == F.col("r_range")).withColumn("through", F.col("start") + F.col("within")).drop("range", "r_range", "start", "within")


def shares(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes), copies (that it takes words of) and finish (of
    the first copy; null: the source has no words): the mix in its order, cut where the total budget is used up. The budget is
    the sum of all targets in whole words; a copy that its source hasn't sent by time 1 ends there."""
    planned = written(plan(sizes(docs, F.monotonically_increasing_id().alias("number"))), "planned")
    each = F.array(*(F.struct(words_of(e).alias("words"), F.lit(e).alias("copy"), F.least(F.lit(1.0), finish(e * F.col("source_size") + F.col("sent"))).alias("time")) for e in range(MAX_COPIES)))
    copies = planned.select("number", "mix_key", F.inline(each)).filter("words > 0")
    budget = F.lit(planned.select("source", "target").distinct().agg(F.sum(F.floor("target"))).first()[0] or 0)
    cut = F.greatest(F.lit(0), F.least(F.col("words"), budget - (F.col("through") - F.col("words"))))
    taken = ordered(copies, ranges).withColumn("words", cut).filter("words > 0").groupBy("number").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return planned.join(taken, "number", "left").select("doc_id", "size", "source_size", "target", none("taken"), none("copies"), finish(F.col("sent")).alias("finish"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"(?s)[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame) -> DataFrame:
    """The mix in its order (partitions follow each other in time): the rows of docs, each as often as the mix takes it, with
    the columns that docs has. Of the last document of each source the text may end before its end."""
    columns = docs.columns
    ids = [F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias(f"lectio_id{seed}__") for seed in (1, 2)]
    by = ["lectio_id1__", "lectio_id2__"]
    planned = plan(sizes(docs, *ids))
    copies = F.filter(F.array(*(F.struct(words_of(e).alias("words"), finish(e * F.col("source_size") + F.col("sent")).alias("finish"), F.lit(e).alias("copy")) for e in range(MAX_COPIES))), lambda c: c["words"] > 0)
    taken = written(planned.withColumn("copies", copies).filter(F.size("copies") > 0).select(*by, "sent", "mix_key", "size", "copies"), "copies")
    budget = taken.select(F.explode("copies").alias("c")).agg(F.sum("c.words")).first()[0] or 0
    ranges = min(MOST_RANGES, 1 + budget // RANGE_WORDS)
    # equal rows are dealt to the copies of each other by number
    dealt = taken.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sent", "mix_key", "size", "copies"))).alias("lectio_rows__"))
    numbered = docs.withColumns({c: i for c, i in zip(by, ids)}).withColumn("lectio_no__", F.row_number().over(W.partitionBy(*by).orderBy(F.lit(1))))
    found = numbered.join(dealt, by).withColumn("lectio_row__", F.get("lectio_rows__", F.col("lectio_no__") - 1))
    found = found.withColumn("lectio_copy__", F.explode("lectio_row__.copies"))
    text = F.when(F.col("lectio_copy__.words") < F.col("lectio_row__.size"), first_words(F.col("text"), F.col("lectio_copy__.words"))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    time = range_of(F.col("lectio_copy__.finish"), ranges)
    return found.repartitionById(ranges, time).sortWithinPartitions("lectio_copy__.finish", "lectio_row__.mix_key", "lectio_copy__.copy", *by).select(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS mix_key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, (sum(s) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY s * 6 // w, source NULLS LAST) AS j FROM s),
p AS (SELECT *, total - coalesce(sum(3 * s) OVER before, 0) AS num, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS den
      FROM o WINDOW before AS (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, num * w > 3 * s * den AS stops FROM p),
t AS (SELECT source, s AS source_size, total, CASE WHEN stops THEN (3 * s)::DOUBLE
        ELSE ((total - coalesce(sum(3 * s) FILTER (stops) OVER (), 0)) * w)::DOUBLE / (sum(w) FILTER (NOT stops) OVER ())::DOUBLE END AS target FROM c),
q AS (SELECT d.*, t.source_size::BIGINT AS source_size, t.target, (sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING))::BIGINT AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT r, greatest(0, least(size, floor(target)::BIGINT - (k * source_size + sent - size))) AS words FROM q, (VALUES (0), (1), (2)) AS x(k)),
n AS (SELECT r, sum(words)::BIGINT AS taken, count(*) FILTER (words > 0) AS copies FROM e GROUP BY r)
SELECT doc_id, size, source_size, target, taken, copies, CASE WHEN target > 0 THEN sent::DOUBLE / target END AS finish FROM q JOIN n USING (r)
"""

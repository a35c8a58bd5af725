"""Greedy acceptance as a Spark job: of rows in an order, each stays unless it is much like one that stayed before it.

What stays is the lexicographically first maximal independent set of the graph of similar rows. Equal sets are one vertex, since
of these only the first can stay. A set that shares no key (two of its rare tokens, mostly) with another is left out of all that
follows. A row that shares no key with an earlier undecided one stays for sure, and whatever it
meets is compared with it alone: a few such rounds settle the groups of near copies with a comparison a row. Of what is still
undecided all similar pairs are found, and rounds over these edges decide the rest: a row without an earlier undecided
neighbour stays, its later neighbours go. State is written after each round, a row a set or edge; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.functions.tables import written
from lectio.functions.text import jaccard
from lectio.operators.simjoin import distinct_pairs, shared_keys, token_ids

LEADER_ROUNDS = 3
#: With more pairs a key than this, pairs are found by blocks of sets
MOST_PAIRS = 64


def independent(edges: DataFrame) -> DataFrame:
    """The ids that do not stay: edges are (x, y), x before y. All others stay."""
    edges = written(edges.select("x", "y"), "edges")
    out = edges.select(F.col("y").alias("id")).limit(0)
    while edges.take(1):
        first = edges.select("x").distinct().join(edges.select(F.col("y").alias("x")).distinct(), "x", "left_anti")
        goes = written(edges.join(first, "x", "left_semi").select(F.col("y").alias("id")).distinct(), "goes")
        out = out.unionByName(goes)
        edges = edges.join(goes.withColumnRenamed("id", "y"), "y", "left_anti").join(goes.withColumnRenamed("id", "x"), "x", "left_anti")
        edges = written(edges.select("x", "y"), "edges")
    return out


def alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (x, y) of sets (id, tokens) that are similar enough."""
    full = pairs.join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("xt")), "x").join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("yt")), "y")
    return full.filter(jaccard(F.col("xt"), F.col("yt")) >= threshold - 1e-9).select("x", "y")


def accepted(rows: DataFrame, by: list[str], order: list[str], tokens: Column, threshold: float, rounds: int = LEADER_ROUNDS, drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows that stay, within each group of `by` in the order of `order`. tokens: an array without repeats; rows without
    tokens are like nothing and stay. Rows of a group with the same place and the same tokens are one: all of them stay or none. Columns
    in `drop` go once the tokens are taken."""
    # a token counts within its group only
    ids = token_ids(F.transform(tokens, lambda t: F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in by), t)))
    rows = rows.withColumn("lectio_tokens", ids).drop(*drop)
    rows = written(rows.withColumn("lectio_id", F.struct(*order, *by, F.xxhash64("lectio_tokens").alias("lectio_hash"))), "rows")
    some = rows.filter("size(lectio_tokens) > 0")
    sets = some.groupBy(F.col("lectio_tokens").alias("tokens")).agg(F.min("lectio_id").alias("id"))
    sets = written(sets.withColumn("number", F.monotonically_increasing_id()), "sets")
    keys = written(shared_keys(sets.select(F.col("number").alias("id"), "tokens"), threshold).withColumnRenamed("id", "number"), "keys")
    # who shares no key is like nothing and stays
    undecided = written(sets.join(keys.select("number").distinct(), "number", "left_semi"), "undecided")
    open_keys = written(keys.join(undecided.select("number", "id"), "number").select("id", "token"), "open")
    undecided = undecided.select("id", "tokens")
    gone = None
    for _ in range(rounds):
        leads = open_keys.groupBy("token").agg(F.min("id").alias("lead"))
        met = written(open_keys.select("id", "token").join(leads, "token").select("id", "lead").distinct(), "met")
        # not sure: whoever has an earlier one under one of its keys
        sure = met.groupBy("id").agg(F.min("lead").alias("lead")).filter("lead <=> id").select(F.col("id").alias("lead"))
        pairs = met.filter("NOT id <=> lead").join(sure, "lead", "left_semi")
        goes = written(alike(pairs.withColumnRenamed("lead", "x").withColumnRenamed("id", "y"), undecided, threshold).select(F.col("y").alias("id")).distinct(), "goes")
        gone = goes if gone is None else gone.unionByName(goes)
        if not goes.take(1):
            break  # nothing is like what is sure; who is left is settled by pairs
        settled = written(goes.unionByName(sure.withColumnRenamed("lead", "id")), "settled")
        # an accepted row has been compared with those that it leads; with others under its keys too, since it is the first of all of them
        undecided = written(undecided.join(settled, "id", "left_anti"), "undecided")
        open_keys = written(open_keys.join(settled, "id", "left_anti"), "open")
    met = open_keys.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"), F.sum("n").alias("keys")).first()
    if (met["pairs"] or 0) <= MOST_PAIRS * (met["keys"] or 0):
        x, y = (open_keys.select("token", F.col("id").alias(c)) for c in "xy")
        edges = alike(x.join(y, "token").filter("x < y").select("x", "y").distinct(), undecided, threshold)
    else:
        edges = distinct_pairs(undecided, threshold)
    rest = independent(edges)
    gone = rest if gone is None else gone.unionByName(rest)
    stays = sets.select("id").join(gone, "id", "left_anti")
    found = some.join(stays.withColumnRenamed("id", "lectio_id"), "lectio_id", "left_semi")
    return found.unionByName(rows.filter("size(lectio_tokens) = 0")).drop("lectio_id", "lectio_tokens")

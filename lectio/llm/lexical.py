"""Ranked lexical search by sort-based accumulation.

The items' different terms, numbered, are all that a document is looked through for. First pass: each slice of texts is cut
into terms by array operations, those of the items are counted, and what matched (term numbers and counts of each document)
is written, together with partial sums: documents, terms, documents that hold each term. Second pass, once the weights of the
terms are known: of each slice the arrays of item, document and impact of all matches are concatenated, packed into keys, put
in order by radix sort, and summed where the key changes; a heap keeps each item's best documents of the partition. These are
range-partitioned by item and score, so that no task has more of an item than its share; each range keeps the first ones of
an item, and ranks are numbered over what is left, a few rows an item and range.

Items are taken in blocks of at most BLOCK_TERMS different terms, each of which reads the documents once, so that what is
sent to all executors is bounded whatever the items are.

Defined results. A null or empty text has no terms; such documents don't count. Rows that repeat a doc_id are documents of
their own and rank each, rows that repeat an item_id are items of their own. Of equal scores the smaller doc_id is first, a
null one before all. Items without terms, or without a document scoring above 0, have no rows. Empty tables give no rows.
Only doc_id and text, item_id and text are read; other columns and their names don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.llm.common import ship, table, written
from lectio.llm.tokens import binary_parts, slices

TOP = 10
#: Different terms of a block of items, and matches summed at once
BLOCK_TERMS, AT_ONCE = 200_000, 1 << 22
#: Terms are of letters, digits and what is beyond ASCII
IS_TERM = np.array([chr(b).isalnum() or b >= 0x80 for b in range(0x80)] + [True] * 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts (null: none), one after the other, as bytes; how many each text has."""
    begin, data = binary_parts(pc.fill_null(texts, ""))
    inside = IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)  # where a term may begin or has ended
    edge[begin] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    number = np.searchsorted(first, begin)
    # without the bytes between terms, each ends where the next begins
    kept = np.concatenate([[0], np.cumsum(inside)])
    at = np.append(kept[first], kept[-1]).astype(np.int32)
    octets = LOWER[data[inside]]
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(octets)]), np.diff(number)


class Items:
    """A block of items: their different terms, and for each term the items that have it, as a range of one array."""

    def __init__(self, texts: list[str | None]):
        found, n = terms(pa.array(texts, pa.string()))
        coded = found.dictionary_encode()
        self.terms = coded.dictionary
        pairs = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | np.repeat(np.arange(len(texts)), n)) if len(found) else np.zeros(0, np.int64)
        self.items = pairs & 0xFFFFFFFF
        self.first = np.searchsorted(pairs >> 32, np.arange(len(self.terms) + 1))

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The terms of each text; text, term and number of occurrences of all that matched, in order."""
        found, n = terms(texts)
        which = pc.fill_null(pc.index_in(found, self.terms), -1).to_numpy(zero_copy_only=False)
        hit = which >= 0
        keys, times = np.unique(np.repeat(np.arange(len(n)), n)[hit] << 32 | which[hit].astype(np.int64), return_counts=True)
        return n, keys >> 32, keys & 0xFFFFFFFF, times


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[tuple[list, list[str | None]]]:
    """The items, in blocks of at most so many terms (an item at least): ids and texts. They stream through the driver."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        n = len(terms(pa.array([row["text"]], pa.string()))[0])
        if ids and size + n > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield ids, texts


def matched(docs: DataFrame, block: Items) -> DataFrame:
    """doc_id, n (terms), term and times (arrays) for each document with a term; in the last row of each partition, all with
    terms are null, the partition's sums: n_docs, n_terms, and term and times with the documents that hold each term."""
    ship()
    kind = docs.schema["doc_id"].dataType
    arrow = f"doc_id {kind.simpleString()}, n bigint, n_docs bigint, n_terms bigint, term array<int>, times array<bigint>"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_terms, made = np.zeros(len(block.terms), np.int64), 0, 0, None
        for whole in batches:
            made = whole.schema.field("doc_id").type
            for batch in slices(whole, "text"):
                n, doc, term, times = block.count(batch.column("text"))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                held += np.bincount(term, minlength=len(held))
                at = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                edges = pa.array(np.append(at[some], at[-1]))  # texts between have no matches
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(some)), pa.array(n[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()),
                        pa.ListArray.from_arrays(edges, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(times)),
                    ],
                    ["doc_id", "n", "n_docs", "n_terms", "term", "times"],
                )
        if made is not None:
            there = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, made), pa.nulls(1, pa.int64()), pa.array([n_docs]), pa.array([n_terms]), pa.array([there.astype(np.int32)], pa.list_(pa.int32())), pa.array([held[there]], pa.list_(pa.int64()))],
                ["doc_id", "n", "n_docs", "n_terms", "term", "times"],
            )

    return docs.select("doc_id", "text").mapInArrow(match, arrow)


def weights(found: DataFrame, n_block_terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term of the block, the number of documents with terms and of all their terms. At most one row a
    term of the block is collected."""
    sums = found.filter("n_docs IS NOT NULL")
    total = sums.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n, all_terms = total["d"] or 0, total["t"] or 0
    held = sums.select(F.explode(F.arrays_zip("term", "times")).alias("x")).groupBy("x.term").agg(F.sum("x.times").alias("df")).collect()
    out = np.zeros(n_block_terms, np.int64)
    for term, df in held:
        out[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return out, n, all_terms


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of non-negative 64-bit keys, by their digits of 16 bits from the lowest, each in a stable counting sort."""
    order, top = np.arange(len(keys)), int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # of 16 bits: numpy sorts by radix
    return order


def sums(block: Items, weight: np.ndarray, n_docs: int, n_terms: int, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """item, document and score of all pairs that share a term of a weight above 0, in the order of items and documents."""
    m = 10 + 90 * n * n_docs // max(n_terms, 1)
    impact = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
    many = np.where(impact > 0, block.first[term + 1] - block.first[term], 0)
    if not many.sum():
        return (np.zeros(0, np.int64),) * 3
    ends = np.cumsum(many)
    item = block.items[np.repeat(block.first[term] - (ends - many), many) + np.arange(ends[-1])]
    bits = max(int(len(n) - 1).bit_length(), 1)
    keys = item << bits | np.repeat(doc, many)
    order = radix_order(keys)
    keys, impact = keys[order], np.repeat(impact, many)[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new] >> bits, keys[new] & (1 << bits) - 1, np.add.reduceat(impact, new)


def best(found: DataFrame, block: Items, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (number in the block), doc_id and score: the best documents of each partition for each item."""
    ship()
    kind = found.schema["doc_id"].dataType.simpleString()

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        made, row = None, 0
        for batch in batches:
            made = batch.schema.field("doc_id").type
            length = pc.list_value_length(batch.column("term")).to_numpy(zero_copy_only=False)
            n, ids = batch.column("n").to_numpy(zero_copy_only=False), batch.column("doc_id").to_pylist()
            per_term = np.diff(block.first)
            term, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "times"))
            doc = np.repeat(np.arange(len(n)), length)
            # as many documents at once as have about AT_ONCE matches together
            part = np.cumsum(np.bincount(doc, per_term[term], len(n))).astype(np.int64) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
            for a, b in zip(cuts, cuts[1:]):
                x, y = np.searchsorted(doc, [a, b])
                item, which, score = sums(block, weight, n_docs, n_terms, n[a:b], doc[x:y] - a, term[x:y], times[x:y])
                at = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else []
                for k, j in zip(at, [*at[1:], len(item)]):
                    heap = heaps.setdefault(int(item[k]), [])
                    value = score[k:j]
                    if j - k > top:  # those below the top-th value, or below what the heap holds, can't enter
                        least = max(np.partition(value, len(value) - top)[len(value) - top], heap[0][0] if len(heap) == top else 0)
                        pick = np.flatnonzero(value >= least)
                    else:
                        pick = range(len(value))
                    for p in pick:
                        d = ids[a + int(which[k + p])]
                        entry = (int(value[p]), Falling(d), row)
                        row += 1  # entries with equal ids stay comparable
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        if heaps:
            rows = [(i, e[1].value, e[0]) for i, heap in heaps.items() for e in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], made), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    return found.filter("n IS NOT NULL").select("doc_id", "n", "term", "times").mapInArrow(accumulate, f"item bigint, doc_id {kind}, score bigint")


class Falling:
    """An id in falling order: of equal scores the heap lets the largest id go first, a null one last."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: Falling) -> bool:
        a, b = self.value, other.value
        return b is None and a is not None or a is not None and b is not None and a > b

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Falling) and self.value == other.value


def ranked(found: DataFrame, top: int) -> DataFrame:
    """item, rank, doc_id, score of the best of all partitions."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    found = written(found, "best")
    ranged = found.repartitionByRange("item", *order).sortWithinPartitions("item", *order)
    kind = found.schema["doc_id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            items, keep = batch.column("item").to_pylist(), []
            for k, i in enumerate(items):
                seen = seen + 1 if i == last else 1
                last = i
                if seen <= top:
                    keep.append(k)
            if keep:
                yield batch.take(pa.array(keep))

    few = ranged.mapInArrow(first, f"item bigint, doc_id {kind}, score bigint")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the best documents of each item."""
    spark, out = docs.sparkSession, None
    item_kind, doc_kind = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    for ids, texts in blocks(items, block_terms):
        block = Items(texts)
        found = written(matched(docs, block), "matches")
        weight, n_docs, n_terms = weights(found, len(block.terms))
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {item_kind.simpleString()}")
        one = ranked(best(found, block, weight, n_docs, n_terms, top), top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score bigint")
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
dt AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS raw FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS tf
       FROM dt GROUP BY ALL),
s AS (SELECT count(*) AS nd, sum(len(ts))::BIGINT AS nt FROM d WHERE len(ts) > 0),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, nd),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
it AS (SELECT DISTINCT i, item_id, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM i),
sc AS (SELECT i, item_id, r, doc_id,
              sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::BIGINT AS score
       FROM it JOIN tf USING (t) JOIN w USING (t), s GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS k FROM sc WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM k WHERE k <= 10
"""

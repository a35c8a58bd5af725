"""Suffix-array dedup: removes every byte covered by a string of WINDOW bytes that also starts anywhere else.

A suffix array of everything is not needed at once, only of suffixes that can share WINDOW bytes. Each window of WINDOW
bytes has an anchor, the leftmost of its GRAM-byte strings with the smallest hash; equal windows have equal anchors, so
the anchor's hash deals windows out to shards without losing a pair. Neighbouring windows with one anchor form a span,
about one for each half WINDOW bytes of text, and spans travel as hashes:

1. Spans that occur twice as a whole are repeats in all their windows; nothing more is needed for them.
2. Only spans whose anchor has another, different span can share some of their windows: the edges of repeated passages.
   One text of each is fetched and a shard's suffixes are sorted by induced sorting; neighbours of the array with a common
   prefix of WINDOW bytes are repeats. What a shard holds is bounded: an anchor with more than SHARD_SPANS spans is cut
   into several shards, and the prefixes that each shard's array has left meet by hash.

Positions are bytes of the UTF-8 text. Matches never cross documents, strings of one document count against each other,
overlapping too. In a text of short periods neighbouring spans are equal; a run of them travels as one row.

A passage of 50 words may have fewer than WINDOW bytes. digests() therefore also reports, without removing anything,
strings that documents share in terms of words: of each PASSAGE words (ASCII white space between them, A-Z in lower case)
the one of STRING words with the smallest hash is looked up in all other documents. A passage of PASSAGE words or more
that another document has is always seen, and nothing that is shorter than STRING words ever is.

Defined results. A null or empty text has no bytes and keeps none. Each row is a document, rows that repeat a doc_id as
well; a row that is there twice is a copy of itself. A null doc_id is an id like others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.common import ship, table, written
from lectio.llm.suffix import permuted_prefixes, suffix_array

WINDOW, GRAM = 400, 96
#: Texts are read in chunks of so many bytes, which overlap by a window.
CHUNK_BITS = 21
SHARD_SPANS, SHARD_BYTES = 4096, 1 << 20
PASSAGE, STRING = 50, 40
#: Up to so many anchors with several shards, 12 bytes each, are sent to all executors; with more the join is a shuffle.
BROADCAST_ANCHORS = 200_000
MULTIPLIER = 0x9E3779B97F4A7C15


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    n = (1 << CHUNK_BITS) + 1
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of `gram` bytes."""
    up, down = powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * up[: len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each `width` neighbouring hashes the place of the smallest, the leftmost of equal ones."""
    low = np.uint64((1 << (CHUNK_BITS + 1)) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = key
    rows = padded.reshape(blocks, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return (np.minimum(after[:n], upto[width - 1 : width - 1 + n]) & low).astype(np.int64)


def spans_in(data: bytes, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """start, windows, left (bytes before the anchor), anchor's hash, span's hash and run (how many equal spans follow each
    other) of the spans of texts that follow each other in data; bounds: where they start, and the end."""
    bytes_ = np.frombuffer(data, np.uint8)
    h = gram_hashes(bytes_, gram)
    anchor = anchors(h, window - gram + 1)
    inside = np.zeros(len(anchor) + 1, np.int64)
    long = np.diff(bounds) >= window
    inside[bounds[:-1][long]] += 1
    inside[np.minimum(bounds[1:][long] - window + 1, len(anchor))] -= 1
    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor[at]) != 0)])
    first = np.flatnonzero(new)
    start, n = at[first], np.diff(np.append(first, len(at)))
    left = anchor[start] - start
    digest = xxhash.xxh3_64_intdigest
    span = np.array([digest(data[a:b], c) for a, b, c in zip(start.tolist(), (start + n - 1 + window).tolist(), left.tolist())], np.uint64)
    hashed = h[anchor[start]]
    same = (span[1:] == span[:-1]) & (hashed[1:] == hashed[:-1]) & (n[1:] == n[:-1]) & (left[1:] == left[:-1]) & (start[1:] == start[:-1] + n[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    run = np.diff(np.append(head, len(start)))
    return start[head], n[head], left[head], hashed[head].view(np.int64), span[head].view(np.int64), run


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def strings_in(data: bytes, bounds: np.ndarray, passage: int = PASSAGE, string: int = STRING) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of words that stand for the passages of texts, which follow each other in data with a space
    between them, and which text each is of."""
    up, down = powers()
    octets = np.frombuffer(data.lower(), np.uint8)
    word = np.concatenate([[False], ~SPACE[octets], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if len(start) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * down[: len(octets)], out=total[1:])
    h = (total[end] - total[start]) * up[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h ^ (h >> np.uint64(29))) * down[: len(h)], out=total[1:])
    h = (total[string:] - total[:-string]) * up[: len(h) - string + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = anchors(h, passage - string + 1)
    of = np.searchsorted(bounds, start, side="right") - 1
    at = np.unique(least[of[: len(least)] == of[passage - 1 :]])
    return h[at].view(np.int64), of[at]


def word_parts(data: bytes, most: int, words: int) -> Iterator[bytes]:
    """data in parts of at most `most` bytes; the last `words` words of a part begin the next one."""
    while len(data) > most:
        end = max(data.rfind(b" ", 0, most), data.rfind(b"\n", 0, most))
        end = end if end > 0 else most
        yield data[:end]
        tail = data[max(0, end - 64 * words) : end].split()[-words:]
        back = sum(map(len, tail)) + len(tail)
        data = data[max(end - max(back, 1), 1) :] if back < end // 2 else data[end:]
    yield data


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


NAMES = ["doc_id", "text_id", "start", "windows", "lead", "anchor", "span", "run"]


def occurrences(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, passages: bool = False) -> DataFrame:
    """NAMES: the spans of all documents; for passages also their strings, with 0 windows and the hash as anchor."""
    ship()
    kind = docs.schema["doc_id"].dataType.simpleString()

    class Parts:
        """Parts of texts, read together once there are enough of them."""

        def __init__(self, batch: pa.RecordBatch, least: int):
            self.batch, self.least, self.held = batch, least, 0
            self.rows: list[int] = []
            self.offsets: list[int] = []
            self.parts: list[bytes] = []

        def full(self, part: bytes) -> bool:
            return bool(self.parts) and self.held + len(part) + len(self.parts) > 1 << CHUNK_BITS

        def add(self, row: int, offset: int, part: bytes) -> None:
            self.rows.append(row), self.offsets.append(offset), self.parts.append(part)
            self.held += len(part)

        def rows_of(self, of: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            row = pa.array(np.array(self.rows)[of])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([self.batch.column("doc_id").take(row), self.batch.column("text_id").take(row), *(pa.array(c, k) for c, k in zip(columns, kinds))], NAMES)

        def bounds(self, between: int) -> np.ndarray:
            return np.concatenate([[0], np.cumsum([len(p) + between for p in self.parts])]).astype(np.int64)

        def spans(self) -> Iterator[pa.RecordBatch]:
            bounds = self.bounds(0)
            start, n, left, anchor, span, run = spans_in(b"".join(self.parts), bounds, window, gram)
            if len(start):
                of = np.searchsorted(bounds, start, side="right") - 1
                yield self.rows_of(of, start - bounds[of] + np.array(self.offsets)[of], n, left, anchor, span, run)
            self.__init__(self.batch, self.least)

        def strings(self) -> Iterator[pa.RecordBatch]:
            found, of = strings_in(b" ".join(self.parts), self.bounds(1))
            if len(found):
                zero = np.zeros(len(found), np.int64)
                yield self.rows_of(of, zero, zero, zero, found, zero, zero)
            self.__init__(self.batch, self.least)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 1 << CHUNK_BITS
        for batch in batches:
            spans, strings = Parts(batch, window), Parts(batch, 2 * PASSAGE - 1)
            for k in range(batch.num_rows):
                data = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass")
                for at in range(0, max(0, len(data) - window) + 1, chunk - window + 1) if len(data) >= window else ():
                    part = data[at : at + chunk]
                    if spans.full(part):
                        yield from spans.spans()
                    spans.add(k, at, part)
                for part in word_parts(data, chunk - 1, PASSAGE) if passages and len(data) >= strings.least else ():
                    if strings.full(part):
                        yield from strings.strings()
                    strings.add(k, 0, part)
            if spans.parts:
                yield from spans.spans()
            if strings.parts:
                yield from strings.strings()

    schema = f"doc_id {kind}, text_id bigint, start bigint, windows int, lead int, anchor bigint, span bigint, run int"
    return docs.select("doc_id", text_id(F.col("text")).alias("text_id"), "text").mapInArrow(find, schema)


def fetched(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, span, part, alone, and the text (bytes) of each wanted span (doc_id, text_id, start, windows and the rest)."""
    ship()
    per_doc = wanted.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "windows", "anchor", "span", "part", "alone", "shards")).alias("spans"))
    per_doc = per_doc.select(F.col("doc_id").alias("w_doc"), F.col("text_id").alias("w_text"), "spans")
    with_id = docs.select("doc_id", text_id(F.col("text")).alias("text_id"), "text")
    on = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_id") == F.col("w_text"))
    joined = with_id.join(per_doc, on).select("text", "spans")

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for s in spans.as_py():
                    found = data[s["start"] : s["start"] + s["windows"] - 1 + window]
                    rows.append((s["anchor"], s["part"], s["span"], s["alone"], s["shards"], found))
                    held += len(found)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["anchor", "part", "span", "alone", "shards", "bytes"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    return joined.mapInArrow(slice_, "anchor bigint, part int, span bigint, alone boolean, shards int, bytes binary")


FOUND = "anchor bigint, span bigint, low int, high int, lead int, prefix bigint"
FOUND_NAMES = ["anchor", "span", "low", "high", "lead", "prefix"]


def repeats(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the texts, in order: whether the window is there again; whether it is the first of its kind in
    the suffix array; which text it is of."""
    data = b"\xff".join(texts)  # no byte of UTF-8
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    number = np.full(len(data), -1, np.int64)
    n = size - window + 1
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    number[at] = np.arange(len(at))
    sa = suffix_array(data)
    shared, windows = permuted_prefixes(data, sa, window)[sa], np.flatnonzero(number[sa] >= 0)
    sa = sa[windows]
    same = np.zeros(len(sa), bool)  # as the window before, over all suffixes between them
    if len(sa) > 1:
        same[1:] = np.minimum.reduceat(shared[: windows[-1] + 1], windows[:-1] + 1) >= window
    again = same.copy()
    again[:-1] |= same[1:]
    twice, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
    twice[number[sa]] = again
    first[number[sa]] = ~same
    return twice, first, np.repeat(np.arange(len(texts)), n)


def shards(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """FOUND_NAMES: the windows low to high of a span that are repeats; of anchors with several shards also, with prefix
    set, each shard's different windows (low, of its span; lead: the place in it, seen from the anchor)."""
    ship()

    def one(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        twice, first, of = repeats([g[4] for g in group], window)
        edge = np.flatnonzero(np.concatenate([[True], (twice[1:] != twice[:-1]) | (of[1:] != of[:-1])]))
        begin = np.searchsorted(of, np.arange(len(group)))
        end = np.append(edge[1:], len(of)) - 1
        keep = twice[edge]
        edge, end = edge[keep], end[keep]
        which = of[edge]
        anchor, span = np.array([g[0] for g in group], np.int64), np.array([g[2] for g in group], np.int64)
        alone = np.array([g[3] for g in group])
        use = alone[which]
        edge, end, which = edge[use], end[use], which[use]
        yield batch_of(anchor[which], span[which], edge - begin[which], end - begin[which], None)
        split = np.array([g[5] > 1 for g in group])
        if split.any():
            at = np.flatnonzero(first & split[of])
            prefix = np.array([xxhash.xxh3_64_intdigest(group[k][4][a : a + window]) for k, a in zip(of[at].tolist(), (at - begin[of[at]]).tolist())], np.uint64).view(np.int64)
            yield batch_of(anchor[of[at]], span[of[at]], at - begin[of[at]], at - begin[of[at]], prefix)

    def batch_of(anchor, span, low, high, prefix) -> pa.RecordBatch:
        n = len(anchor)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(span), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()) if prefix is None else pa.array(prefix)], FOUND_NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "span", "alone", "bytes", "shards"))):
                if group and held >= SHARD_BYTES and row[:2] != group[-1][:2]:
                    yield from one(group)
                    group, held = [], 0
                group.append(row)
                held += len(row[4])
        if group:
            yield from one(group)

    dealt = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "span")
    return dealt.select("anchor", "part", "span", "alone", "bytes", "shards").mapInArrow(run, FOUND)


def shared_strings(found: DataFrame) -> DataFrame:
    """doc_id, text_id and passages: how many of the strings (anchor) of a document other documents have, if any."""
    who = F.xxhash64("doc_id", "text_id")
    several = found.groupBy("anchor").agg(F.min(who).alias("a"), F.max(who).alias("b")).filter("a <> b").select("anchor")
    several = written(several, "strings")
    return found.join(several, "anchor").groupBy("doc_id", "text_id").agg(F.count("*").alias("passages"))


def intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, passages: bool = False) -> DataFrame:
    """doc_id, text_id, repeats (array of low, high: windows that start there are repeats) and passages, a row for each
    document that has any."""
    found = written(occurrences(docs, window, gram, passages), "spans")
    all_ = found.filter("windows > 0")
    shared = all_.groupBy("anchor").agg(F.min("span").alias("a"), F.max("span").alias("b")).filter("a <> b").select("anchor")
    shared = written(shared, "shared")
    rep = F.min(F.struct("doc_id", "text_id", "start", "windows")).alias("rep")
    edges = all_.join(shared, "anchor").groupBy("anchor", "span").agg(F.sum("run").alias("n"), rep)
    edges = written(edges.select("anchor", "span", "n", "rep.*"), "edges")
    large = written(edges.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > SHARD_SPANS).select(F.col("anchor").alias("large"), F.ceil(F.col("k") / SHARD_SPANS).cast("int").alias("shards")), "large")
    n_large = large.limit(BROADCAST_ANCHORS + 1).count()
    alone = F.col("n") == 1
    if n_large:
        wanted = edges.join(F.broadcast(large) if n_large <= BROADCAST_ANCHORS else large, F.col("anchor") == F.col("large"), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        wanted = wanted.withColumn("part", F.pmod("span", "shards").cast("int"))
    else:
        wanted = edges.withColumn("shards", F.lit(1)).withColumn("part", F.lit(0))
    sorted_ = written(shards(fetched(docs, wanted.withColumn("alone", alone), window), window), "repeats")
    parts = sorted_.filter("prefix IS NULL").select("anchor", "span", "low", "high")
    if n_large:
        left = sorted_.filter("prefix IS NOT NULL").select("anchor", "span", "low", "prefix")
        again = left.groupBy("anchor", "prefix").agg(F.count("*").alias("k")).filter("k > 1").select("anchor", "prefix")
        across = left.join(again, ["anchor", "prefix"]).select("anchor", "span", "low", F.col("low").alias("high"))
        parts = parts.union(across)
    # -1: all windows of the span
    whole = all_.groupBy("anchor", "span").agg(F.sum("run").alias("n")).filter("n > 1").select("anchor", "span", F.array(F.struct(F.lit(0).alias("low"), F.lit(-1).alias("high"))).alias("r"))
    some = parts.groupBy("anchor", "span").agg(F.collect_list(F.struct("low", "high")).alias("r"))
    hit = written(whole.union(some), "hit")
    joined = all_.join(hit, ["anchor", "span"])
    moved = F.transform("r", lambda x: F.struct((F.col("start") + x["low"]).alias("low"), (F.col("start") + F.when(x["high"] < 0, F.col("windows") * F.col("run") - 1).otherwise(x["high"])).alias("high")))
    rows = joined.select("doc_id", "text_id", moved.alias("r"), F.lit(0).cast("long").alias("passages"))
    if passages:
        rows = rows.unionByName(shared_strings(found.filter("windows = 0").select("doc_id", "text_id", "anchor")).withColumn("r", F.lit(None).cast(rows.schema["r"].dataType)))
    return rows.groupBy("doc_id", "text_id").agg(F.flatten(F.collect_list("r")).alias("repeats"), F.sum("passages").alias("passages"))


def removed(lows: np.ndarray, highs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs [start, end) of bytes that windows starting at lows..highs cover."""
    order = np.argsort(lows, kind="stable")
    lows, ends = lows[order], np.maximum.accumulate((highs + window)[order])
    new = np.flatnonzero(np.concatenate([[True], lows[1:] > ends[:-1]]))
    return lows[new], ends[np.append(new[1:], len(lows)) - 1]


def with_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs and the columns lectio_repeats__ and lectio_passages__ (null: none)."""
    found = written(found, "intervals").select(
        F.col("doc_id").alias("lectio_doc__"), F.col("text_id").alias("lectio_text__"), F.col("repeats").alias("lectio_repeats__"), F.col("passages").alias("lectio_passages__")
    )
    on = docs["doc_id"].eqNullSafe(F.col("lectio_doc__")) & (text_id(docs["text"]) == F.col("lectio_text__"))
    return docs.join(found, on, "left").drop("lectio_doc__", "lectio_text__")


def _kept(text: str | None, repeated, window: int) -> tuple[int, int, int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not repeated:
        return len(data), 0, 0, data
    start, end = removed(np.array([r["low"] for r in repeated]), np.array([r["high"] for r in repeated]), window)
    stays = [data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)])]
    return len(data), int((end - start).sum()), len(start), b"".join(stays)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the column kept (binary): the text's bytes without the repeats."""
    ship()

    @F.arrow_udf("binary")
    def lectio_kept(texts: pa.Array, repeated: pa.Array) -> pa.Array:
        return pa.array([_kept(t, r, window)[3] for t, r in zip(texts.to_pylist(), repeated.to_pylist())], pa.binary())

    return with_repeats(docs, intervals(docs, window)).withColumn("kept", lectio_kept("text", "lectio_repeats__")).drop("lectio_repeats__", "lectio_passages__")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passages (how many strings of STRING words other documents have)
    and shares_passage (whether there are any), a row for each row of docs."""
    ship()

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    def lectio_digest(texts: pa.Array, repeated: pa.Array) -> pa.Array:
        rows = [_kept(t.as_py(), r.as_py(), window) for t, r in zip(texts, repeated)]
        numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        return pa.StructArray.from_arrays([*numbers, pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_repeats(docs.select("doc_id", "text"), intervals(docs, window, gram, passages=True))
    passages = F.coalesce("lectio_passages__", F.lit(0)).cast("long").alias("passages")
    return found.select("doc_id", lectio_digest("text", "lectio_repeats__").alias("d"), passages).select("doc_id", "d.*", "passages", (F.col("passages") > 0).alias("shares_passage"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""SimHash near-dedup with the pigeonring filter.

Documents with the same fingerprint form a class, named by its smallest doc_id; only classes are compared. A fingerprint
is a ring of m segments. If two differ in at most t bits, some chain of neighbouring segments has at most l * t / m
differences in its first l segments, for every l at once. With m = t + 1 such a chain begins with a segment without a
difference and has at most one difference in the second: a class is therefore indexed under each pair of neighbouring
segments and looked up there and, a bit of the second segment cleared, under the pairs one bit away. What meets under a
key must have a chain within its budgets, then is compared in full.

Under a key, links are followed from one class to all others that are not yet reached, so that a dense group gives a
spanning tree and never all its pairs. Keys with more than BLOCK classes are cut into blocks, and each pair of blocks is
a group of its own, so that no group grows with the data.

dedup(), the near-dedup of the pipeline, links texts by their fingerprints in this way, then checks each link exactly, by
the Jaccard similarity of the sets of shingles. No bound on bits finds all pairs of a similarity, so what is similar and
still in different groups after that is found by the sets (jaccard.py); no pair is left to the bits alone.

Defined results. A null text has no words, as an empty one; no words give fingerprint zero. Rows that repeat a doc_id
are compared each. A null doc_id gets its fingerprint, links with nothing and has a null component. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm import jaccard
from lectio.llm.common import ship, table, written
from lectio.llm.components import components
from lectio.llm.jaccard import shingle_hashes

BLOCK = 50_000
#: So many heavy keys, or documents to drop, are sent to all executors; with more of them the join is a shuffle.
BROADCAST_ROWS = 1_000_000
AT_ONCE = 1 << 19
ROWS = "key bigint, probe boolean, fp binary, node bigint"


# --- fingerprints --------------------------------------------------------------------------------------------------


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 1024:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash that follows from h (k = 0: h itself)."""
    if not k:
        return h
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int = 4, longs: int = 1) -> bytes:
    """64 * longs bits, little-endian; bit set: set in over half the hashes."""
    counts, n = np.zeros((longs, 64), np.int64), 0
    for h in shingle_hashes(text, words):
        counts += [bit_counts(mixed(h, k)) for k in range(longs)]
        n += len(h)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").tobytes()


def fingerprint_of(words: int, longs: int) -> Column:
    ship()
    @F.arrow_udf("binary")
    def lectio_fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words, longs) for t in texts.to_pylist()], pa.binary())

    return lectio_fingerprint("text")


# --- the ring ------------------------------------------------------------------------------------------------------


class Ring:
    """How fingerprints of `bits` bits are cut into segments, and which chains may differ how much."""

    def __init__(self, bits: int, within: int, segments: int, chain: int = 4):
        self.bits, self.within, self.m = bits, within, segments
        edges = [bits * k // segments for k in range(segments + 1)]
        self.width = [b - a for a, b in zip(edges, edges[1:])]
        self.start = edges[:-1]
        self.budget = [math.floor((k + 1) * within / segments) for k in range(min(chain, segments))]
        # A segment may lie across two of the longs
        self.where = [(a // 64, a % 64, w) for a, w in zip(self.start, self.width)]

    def segment(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k-th segment of fingerprints or their differences (rows of longs), as numbers."""
        at, shift, width = self.where[k % self.m]
        found = x[:, at] >> np.uint64(shift)
        if shift + width > 64:
            found = found | (x[:, at + 1] << np.uint64(64 - shift))
        return found & np.uint64((1 << width) - 1)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows differ in at most `within` bits: those with a chain within its budgets, compared in full."""
        x = a ^ b
        d = np.stack([np.bitwise_count(self.segment(x, k)) for k in range(self.m)], axis=1).astype(np.int16)
        total, fits = d, d <= self.budget[0]
        for k, budget in enumerate(self.budget[1:], 1):
            total = total + np.roll(d, -k, axis=1)
            fits &= total <= budget
        found = fits.any(axis=1)
        found[found] = np.bitwise_count(x[found]).sum(axis=1) <= self.within
        return found

    def keys(self, x: np.ndarray, probes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Keys with the rows they are of: where a fingerprint is indexed and, as probes, where else it is looked up."""
        rows = np.arange(len(x))
        for k in range(self.m):
            first = (np.uint64(k) << np.uint64(56)) | self.segment(x, k)
            width = np.uint64(self.width[(k + 1) % self.m])
            second = self.segment(x, k + 1)
            first = first << width
            yield first | second, rows, False
            for bit in range(int(width)) if probes else ():
                has = (second >> np.uint64(bit)) & np.uint64(1) == 1
                yield first[has] | (second[has] ^ np.uint64(1 << bit)), rows[has], True


def longs_of(column: pa.Array, longs: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, longs)


def emitted(classes: DataFrame, ring: Ring, probes: bool = True) -> DataFrame:
    """key, probe, fp, node: where each class (fp, node) is indexed and looked up."""
    ship()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, node = batch.column("fp"), batch.column("node")
            for key, rows, probe in ring.keys(longs_of(fps, ring.bits // 64), probes):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(rows), probe)), fps.take(at), node.take(at)], ["key", "probe", "fp", "node"])

    return classes.select("fp", "node").mapInArrow(emit, ROWS)


def spread(rows: DataFrame, classes: DataFrame, ring: Ring) -> DataFrame:
    """rows with the column part: keys of over BLOCK classes are cut into blocks, each pair of them a part of the key."""
    counts = emitted(classes, ring, probes=False).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    heavy = written(counts.select(F.col("key").alias("heavy"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "heavy")
    n = heavy.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows.withColumn("part", F.lit(0))
    joined = rows.join(F.broadcast(heavy) if n <= BROADCAST_ROWS else heavy, F.col("key") == F.col("heavy"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = joined.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    part = F.least("own", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("own", "other")
    return both.withColumn("part", part).select("key", "probe", "fp", "node", "part")


def links(classes: DataFrame, ring: Ring) -> DataFrame:
    """u, v: links between classes, enough of them to connect what is linked under each key."""
    ship()
    longs = ring.bits // 64
    rows = spread(emitted(classes, ring), classes, ring)
    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "probe")

    def follow(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links within one group, from each reached row to those not yet reached."""
        left = np.arange(len(x))
        while len(left) > 1:
            reached, left = [int(left[0])], left[1:]
            while reached and len(left):
                a = reached.pop()
                hit = np.concatenate([ring.near(x[a][None, :], x[left[k : k + AT_ONCE]]) for k in range(0, len(left), AT_ONCE)])
                new = left[hit]
                if len(new):
                    yield np.full(len(new), a), new
                    reached += new.tolist()
                    left = left[~hit]

    def compare(key: np.ndarray, part: np.ndarray, probe: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links within the groups of whole groups that stand in order."""
        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, len(key)))
        for b, n in zip(begin[size > 16].tolist(), size[size > 16].tolist()):
            if not probe[b]:  # without an index row there is nothing to find
                for u, v in follow(x[b : b + n]):
                    yield b + u, b + v
        small = np.repeat(size <= 16, size) & (np.repeat(size, size) > 1)
        at = np.flatnonzero(small)
        group = np.cumsum(edge)[at]
        for d in range(1, 16):
            if len(at) <= d:
                break
            same = group[:-d] == group[d:]
            if not same.any():
                break
            u, v = at[:-d][same], at[d:][same]
            u, v = u[~probe[u]], v[~probe[u]]
            for k in range(0, len(u), AT_ONCE):
                hit = ring.near(x[u[k : k + AT_ONCE]], x[v[k : k + AT_ONCE]])
                yield u[k : k + AT_ONCE][hit], v[k : k + AT_ONCE][hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(block: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            *group, node = block
            for u, v in compare(*group):
                u, v = node[u], node[v]
                differ = u != v
                if differ.any():
                    yield pa.RecordBatch.from_arrays([pa.array(u[differ]), pa.array(v[differ])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, probe, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "probe", "node"))
            block = (key, part, probe, longs_of(batch.column("fp"), longs), node)
            cut = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1] + 1) if (key[0], part[0]) != (key[-1], part[-1]) else 0
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (key[0], part[0])):
                head = [tuple(c[:cut] for c in block)] if cut else []
                yield from out(tuple(map(np.concatenate, zip(*held, *head))))
                held = []
            held.append(tuple(c[cut:] for c in block))
        if held:
            yield from out(tuple(map(np.concatenate, zip(*held))))

    return ordered.select("key", "part", "probe", "fp", "node").mapInArrow(run, "u bigint, v bigint")


# --- documents -----------------------------------------------------------------------------------------------------


def grouped(docs: DataFrame, ring: Ring, words: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable), a row for each row of docs."""
    found = docs.select("doc_id", fingerprint_of(words, ring.bits // 64).alias("fp"))
    found = written(found, "fingerprints")
    classes = written(found.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("node")), "classes")
    reached = components(links(classes, ring))
    named = classes.join(reached, "node", "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "node").alias("component_id"))
    named = written(named, "named")
    joined = found.join(named, found["fp"] == named["class_fp"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: 64 bits, links within 4
NARROW = Ring(64, 4, 5)


def near(texts: DataFrame, ring: Ring = NARROW, words: int = jaccard.WORDS) -> DataFrame:
    """u, v: texts (node, text) whose fingerprints the ring links, enough of them to connect all that it does. Those with
    the same fingerprint are tied to the smallest node of their class."""
    found = written(texts.select("node", fingerprint_of(words, ring.bits // 64).alias("fp")), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("node").alias("node")), "classes")
    same = found.join(classes.select("fp", F.col("node").alias("u")), "fp").filter("node <> u").select("u", F.col("node").alias("v"))
    return same.union(links(classes, ring).select(F.least("u", "v"), F.greatest("u", "v"))).distinct()


def dedup(docs: DataFrame, similarity: float = jaccard.SIMILARITY, words: int = jaccard.WORDS) -> DataFrame:
    """One document of each group of near duplicates (the smallest doc_id), with the columns that docs has. Rows of one
    doc_id stay or go together; rows without a doc_id stay."""
    ids = jaccard.grouped(docs, similarity, words, lambda texts: near(texts, NARROW, words))
    drops = written(ids.filter("component_id <> doc_id").select(F.col("doc_id").alias("lectio_drop__")).distinct(), "drops")
    few = drops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(drops) if few else drops, docs["doc_id"] == drops["lectio_drop__"], "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"), NARROW)
    digits = F.concat(*(F.hex(F.substring("fp", k, 1)) for k in range(8, 0, -1)))  # the first byte is the lowest
    return found.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id")

"""Near-dedup by the exact Jaccard similarity of shingle sets.

A document is the set of its different shingles, as 64-bit hashes; documents with the same words form a class. Texts are
written, sets are not: hashes don't compress. All shingles are put in one order, the rarest first, by how often the classes have
the shingles of their bucket: a table of a fixed size, counted over all classes, whose order is nearly that of the shingles
themselves. Two sets that are similar enough share one of the first n - ceil(t n) + 1 of theirs, whatever the order is, so the
classes meet under these keys and no pair is missed; the counts decide only how large the groups under a key are. Of what meets, sizes and positions rule out what can't be similar. A class also has a bitmap of its shingles: each
bit that one of two has alone is a shingle that it has alone, which rules out nearly all that is left without any text. The
sets of the remaining pairs decide.

Only what is linked is of interest, not all its pairs. Pairs that a caller already has (those of near fingerprints,
simhash.py) are decided first. In each round every class is compared with some of those that lead a key
of it and are in another component, more of them in later rounds, and what is found joins components; at the end all pairs
that meet and are not yet in one component are compared. A dense group thus costs a few comparisons a class, also where only
half of its pairs are similar: a class that has few shingles rarer than the key leads it, since most of these are in no other
class, so that the ones with the fewest changes lead and the more changed ones find them.

Defined results. A null text has no words, as an empty one; documents without words are one class. Rows that repeat a
doc_id are compared each. A null doc_id links with nothing and has a null component. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import ship, written
from lectio.llm.components import components

SEED = 42
AT_ONCE = 1 << 19
SIMILARITY, WORDS = 0.8, 5
#: So many leaders a class, round by round (powers of two); keys are dealt to as many hashes, each of which chooses its own among equals
LEADERS = (2, 8)
#: The turn before these: pairs that come from elsewhere
FIRST = -1
#: The order of shingles: those of all classes are counted in so many buckets, in parts that are summed by a task each
BUCKETS, COUNT_PARTS = 1 << 22, 64
#: With so many classes to compare they are sent to all executors; with more of them the join is a shuffle.
BROADCAST_ROWS = 1_000_000
#: So many documents, or pairs of a key, are handled at once
ROWS_AT_ONCE = 500
#: Keys with no more classes are looked through pair by pair before the rounds
FEW = 32
#: Sets that a task keeps while it compares pairs
KNOWN = 64
EPS = 1e-9


# --- sets ----------------------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of so many words, in blocks; of the whole sequence if it is shorter; nothing without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, ASCII white space
    if not found:
        return
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, AT_ONCE):
        pairs = zip(starts[k : min(n, k + AT_ONCE)].tolist(), last[k : k + AT_ONCE].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def shingle_set(text: str | None, words: int) -> bytes:
    """The different shingles' hashes in order, little-endian."""
    found = [np.unique(h) for h in shingle_hashes(text, words)]
    return (np.unique(np.concatenate(found)) if len(found) > 1 else found[0]).astype("<u8").tobytes() if found else b""


def words_digest() -> Column:
    """128 bits of the words of the column text, A-Z in lower case."""
    ship()

    @F.arrow_udf("binary")
    def lectio_words(texts: pa.Array) -> pa.Array:
        words = (b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts.to_pylist())
        return pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in words], pa.binary())

    return lectio_words("text")


def prefix_size(n: int, t: float) -> int:
    return n - math.ceil(n * t - EPS) + 1


def frequencies(texts: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each bucket are in the sets of all texts (node, text), as eighths of powers of two."""
    ship()
    size = BUCKETS // COUNT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                sets = [shingle_set(x.as_py(), words) for x in whole.column("text").slice(k, ROWS_AT_ONCE)]
                at, n = np.unique(bucket(np.frombuffer(b"".join(sets), "<u8"), BUCKETS), return_counts=True)
                counts[at] += n.astype(np.uint32)
        for part, x in enumerate(np.minimum(counts, 65535).astype("<u2").reshape(COUNT_PARTS, size)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "counts"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("counts")):
                sums[part] = sums.get(part, 0) + np.frombuffer(x.as_buffer(), "<u2").astype(np.int64)
        for part, x in sums.items():
            levels = np.minimum(np.round(8 * np.log2(x + 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition(COUNT_PARTS, "part").mapInArrow(level, schema).toArrow()
    found = np.zeros((COUNT_PARTS, size), np.uint8)
    for part, x in zip(rows.column("part").to_pylist(), rows.column("counts").to_pylist()):
        found[part] = np.frombuffer(x, np.uint8)
    return found.reshape(-1)


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """The one of n buckets, a power of two, of each hash."""
    return (h >> np.uint64(64 - (n - 1).bit_length())).astype(np.int64)


def signatures(texts: DataFrame, levels: np.ndarray, t: float, words: int) -> DataFrame:
    """node, n (shingles), keys (the first of them, in order) and bits of each text (node, text)."""
    ship()

    def keys(x: np.ndarray) -> np.ndarray:
        x = x[np.argsort(levels[bucket(x, len(levels))], kind="stable")]
        return x[: prefix_size(len(x), t)].view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                sets = [np.frombuffer(shingle_set(x.as_py(), words), "<u8") for x in batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node"), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.binary()),
                    ],
                    ["node", "n", "keys", "bits"],
                )

    return texts.select("node", "text").mapInArrow(sign, "node bigint, n int, keys array<bigint>, bits binary")


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle, by its last bits; two to four times as many bits as shingles."""
    m = 1 << max(6, (2 * len(s)).bit_length())
    bits = np.zeros(m, bool)
    bits[s & np.uint64(m - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(n: int, a: np.ndarray, m: int, b: np.ndarray, t: float) -> bool:
    """Whether sets of n and m shingles with these bitmaps can be similar."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return most >= t / (1 + t) * (n + m) - EPS


# --- what meets ----------------------------------------------------------------------------------------------------


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, which stand in the order of key, in tables that cut no key in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1] + 1) if key[0] != key[-1] else 0
        if cut or (held and held[-1].column("key")[0].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(key: np.ndarray) -> list[tuple[int, int]]:
    """Where the keys with two rows or more begin and end."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(begin[1:], len(key))
    several = end - begin > 1
    return list(zip(begin[several].tolist(), end[several].tolist()))


def possible(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of n and m shingles, of which the one at pos and at is the first that both have, can be similar."""
    most = 1 + np.minimum(n - 1 - pos, m - 1 - at)
    return (np.minimum(n, m) >= t * np.maximum(n, m) - EPS) & (most >= t / (1 + t) * (n + m) - EPS)


def shared(keys: DataFrame, t: float) -> DataFrame:
    """The rows of keys under which classes meet that can be similar. Of keys with few classes, only these classes."""
    ship()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            key, n, pos = (rows.column(c).to_numpy() for c in ("key", "n", "pos"))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            stays = np.repeat(size > FEW, size)
            for d in range(1, FEW):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                i = i[possible(n[i], pos[i], n[i + d], pos[i + d], t)]
                stays[i] = stays[i + d] = True
            yield from rows.filter(pa.array(stays)).combine_chunks().to_batches()

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(several, keys.schema)


def pairs(met: DataFrame, t: float, turn: int | None) -> DataFrame:
    """u, v: classes of different components that meet under a key (met: key, node, n, pos, component), each pair once;
    in a turn only each class with some of the classes that lead its keys (LEADERS at most), else all."""
    lanes = 1 if turn is None else LEADERS[turn]
    first = 0 if turn is None else sum(LEADERS[:turn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, hs, size = [], [], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, hs)], ["u", "v", "h"])
        for rows in groups(batches):
            key, node, n, pos, comp = (rows.column(c).to_numpy() for c in ("key", "node", "n", "pos", "component"))
            for a, b in bounds(key):
                if (comp[a:b] == comp[a]).all():
                    continue
                lane = int(key[a]) % lanes
                if turn is None:
                    leaders, h = range(a, b - 1), np.zeros(b - a, np.int64)
                else:
                    mix = np.uint64((2 * (first + lane) + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                    h = (node[a:b].view(np.uint64) + mix) * mix
                    h = ((h ^ (h >> np.uint64(29))) * mix >> np.uint64(24)).astype(np.int64) // lanes * lanes + lane  # one lane's are comparable
                    h += np.minimum(pos[a:b], (1 << 20) - 1).astype(np.int64) << 40
                    leaders = [a + int(np.argmin(h))]
                for i in leaders:
                    j = np.arange(a if turn is not None else i + 1, b)
                    j = j[(comp[j] != comp[i]) & possible(n[j], pos[j], n[i], pos[i], t)]
                    if len(j):
                        us.append(np.full(len(j), node[i]))
                        vs.append(node[j])
                        hs.append(np.full(len(j), h[i - a]))
                        size += len(j)
                        if size >= AT_ONCE:
                            yield flush()
                            us, vs, hs, size = [], [], [], 0
        if size:
            yield flush()

    ordered = met.repartition("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(run, "u bigint, v bigint, h bigint")
    if turn is not None:
        found = found.groupBy("v", F.pmod("h", F.lit(lanes))).agg(F.min_by("u", "h").alias("u"))
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def plausible(found: DataFrame, signed: DataFrame, t: float) -> DataFrame:
    """Those of the pairs that their bitmaps (node, n, bits) don't rule out."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            bits = zip(batch.column("x"), batch.column("y"))
            may = [may_be_similar(n[k], np.frombuffer(x.as_buffer(), np.uint8), m[k], np.frombuffer(y.as_buffer(), np.uint8), t) for k, (x, y) in enumerate(bits)]
            yield batch.select(["u", "v"]).filter(pa.array(may, pa.bool_()))

    x, y = (signed.select(F.col("node").alias(c), F.col("n").alias(n), F.col("bits").alias(b)) for c, n, b in (("u", "n", "x"), ("v", "m", "y")))
    return found.join(x, "u").join(y, "v").select("u", "v", "n", "m", "x", "y").mapInArrow(run, "u bigint, v bigint")


def similar(found: DataFrame, texts: DataFrame, t: float, words: int) -> DataFrame:
    """Those of the pairs whose texts (node, text) have sets with the similarity."""
    ship()
    nodes = written(found.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    texts = only(texts, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def set_of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[node] = np.frombuffer(shingle_set(text.as_py(), words), "<u8")
            return known[node]

        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = set_of(u[k], x), set_of(v[k], y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit[k] = both >= t * (len(x) + len(y) - both) - EPS
            yield batch.select(["u", "v"]).filter(pa.array(hit))

    x, y = (texts.select(F.col("node").alias(c), F.col("text").alias(s)) for c, s in (("u", "x"), ("v", "y")))
    return found.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint")


def only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose node is one of nodes (node, without repeats)."""
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def links(texts: DataFrame, t: float, words: int, first: DataFrame | None = None) -> DataFrame:
    """u, v: nodes whose sets are similar, enough of them to connect all that are (texts: node, text). Pairs that something
    else has found (first: u, v) are decided before any others are looked for."""
    signed = written(signatures(texts, frequencies(texts, words), t, words), "signatures")
    keys = signed.select("node", "n", F.posexplode("keys").alias("pos", "key")).select("key", "node", "n", "pos")
    met = written(shared(keys, t), "met")
    bits = signed.select("node", "n", "bits")
    edges, rows = None, met.withColumn("component", F.col("node"))
    for turn in [*([] if first is None else [FIRST]), *range(len(LEADERS)), None]:
        found = written(plausible(first if turn == FIRST else pairs(rows, t, turn), bits, t), "pairs")
        new = written(similar(found, texts, t, words), "links")
        edges = new if edges is None else edges.union(new)
        if turn is not None:
            reached = components(edges)
            rows = met.join(reached, "node", "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    return edges


def grouped(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable), a row for each row of docs. first finds pairs (u, v) of
    texts (node, text) that are decided before all others."""
    found = docs.select("doc_id", "text", words_digest().alias("digest"), F.monotonically_increasing_id().alias("node"))
    found = written(found, "texts")
    classes = found.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").cast("bigint").alias("doc"), F.min("node").alias("node"))
    classes = written(classes, "classes")
    texts = only(found.select("node", "text"), classes.select("node"))
    linked = links(texts, similarity, words, first and first(texts))
    a, b = (classes.select(F.col("node").alias(n), F.col("doc").alias(d)) for n, d in (("u", "a"), ("v", "b")))
    reached = components(linked.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("digest", F.col("doc").alias("node")).join(reached, "node", "left")
    named = written(named.select(F.col("digest").alias("class"), F.coalesce("component", "node").alias("component_id")), "named")
    joined = found.select("doc_id", "digest").join(named, F.col("digest") == F.col("class"), "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

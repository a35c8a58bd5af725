"""Conversation prefix tries: which conversations begin with the same turns, and what sharing these saves.

A turn becomes a label of 16 bytes and its number of words before anything is shuffled; a conversation is its path, the chain
of labels, and each prefix is named by 128 bits of hash along the chain. Equal conversations are one path with a count, so
that copies are never compared. Prefixes that more than a share of the paths go through are the heavy upper levels; every other
path belongs to the shard of its first prefix that isn't heavy. A task builds the tries of its shards as one forest in level
order: the LOUDS bit vector (each node's number of children in unary), the labels, and by add.at in reverse breadth-first order
the sums over subtrees. The upper levels have a row for each heavy prefix, to which the sums of the shards below are added up;
they are merged into a trie of their own. At most paths / limit prefixes of a level are heavy, so this last step is small.

The conversations that end at a node are range-partitioned by path and id, so that the copies of one conversation are spread
over as many tasks as they need; their ids go on to the hash in blocks of ENDS_AT_ONCE.

Defined results. Turns are ordered by turn, null first, rows of the same turn by the MD5 of role and text; null roles and
texts are empty ones; repeated rows are turns of their own. Rows without a conv_id belong to no conversation. A conversation
whose rebuilt form has no turn ends at the root. An empty table has no nodes. One conversation is one row, like a text: a
long one isn't split. Only conv_id, turn, role and text are read; other columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.common import WORD, ship, table, written

#: A rebuilt conversation begins with up to FIRST - 1 turns of the one at the multiple of GROUP below it
GROUP, FIRST = 20, 4
#: A shard holds at most so many different paths: one of SHARES of them, but LEAST at least and MOST at most
SHARES, LEAST, MOST = 2000, 64, 50_000
#: So many turns are built into one forest; with so many heavy prefixes they are sent to all executors, with more they are shuffled
TURNS_AT_ONCE, BROADCAST_ROWS = 1 << 18, 1_000_000
ENDS_AT_ONCE = 1000
ROOT = bytes(16)
TURN = np.dtype([("a", "<u8"), ("b", "<u8"), ("words", "<u4")])
NOBODY = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
VALUES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
COLUMNS = [c.split()[0] for c in VALUES.split(", ")]


# --- paths -----------------------------------------------------------------------------------------------------------


def chain(turns: bytes) -> Iterator[bytes]:
    """The names of all prefixes, from that of one turn on."""
    name = ROOT
    for k in range(0, len(turns), TURN.itemsize):
        name = hashlib.md5(name + turns[k : k + 16]).digest()
        yield name


def labelled(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, label and words of each row with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("label"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )


def rebuilt(conversations: DataFrame, group: int = GROUP, first: int = FIRST) -> DataFrame:
    """conv_id, path (its name) and turns (packed) of each rebuilt conversation. A group of conversations streams through a
    task, the one that lends its beginning first."""
    ship()
    base = F.expr(f"conv_id - conv_id % {group}")
    rows = labelled(conversations).withColumn("base", base).repartition("base")
    rows = rows.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "label")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lender, head, now, own, out = None, [], None, [], []

        def done() -> None:
            nonlocal lender, head
            if now is None:
                return
            of, conv = now
            if of != lender:
                lender, head = of, own[: first - 1] if conv == of else []
            h = zlib.crc32(str(conv).encode()) % first
            turns = b"".join([*head[:h], *own[h:]])
            name = ROOT
            for name in chain(turns):
                pass
            out.append((conv, name, turns))

        for batch in batches:
            for of, conv, label, words in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "label", "words"))):
                if (of, conv) != now:
                    done()
                    now, own = (of, conv), []
                own.append(label + words.to_bytes(4, "little"))
            if out:
                yield _rows(out, PATHS)
                out = []
        done()
        if out:
            yield _rows(out, PATHS)

    return rows.select("base", "conv_id", "label", "words").mapInArrow(rebuild, "conv_id bigint, path binary, turns binary")


PATHS = [("conv_id", pa.int64()), ("path", pa.binary()), ("turns", pa.binary())]
PARTS = [("path", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ends", pa.string()), ("ids", pa.string())]


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def ends(paths: DataFrame) -> DataFrame:
    """path, first (smallest conv_id), copies and ends (the hash of all conv_ids) of each different path."""
    ship()
    ranged = paths.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each path that begins and ends in this partition; blocks of ids of the others."""
        now, ids, blocks, out, begun = None, [], 0, [], False

        def close(last: bool) -> None:
            text = ",".join(map(str, ids))
            whole = last and begun and not blocks
            out.append((now, ids[0], len(ids), hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text))

        for batch in batches:
            for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
                if path != now:
                    if ids:
                        close(True)
                        begun = True  # the first path of a partition may have begun in the one before
                    now, ids, blocks = path, [], 0
                elif len(ids) == ENDS_AT_ONCE:
                    close(False)
                    ids, blocks = [], blocks + 1
                ids.append(conv)
            if out:
                yield _rows(out, PARTS)
                out = []
        if ids:
            close(False)  # and the last may go on
        if out:
            yield _rows(out, PARTS)

    parts = written(ranged.mapInArrow(part, "path binary, first bigint, n bigint, ends string, ids string"), "ends")
    cut = parts.filter("ends IS NULL").repartition("path").sortWithinPartitions("path", "first")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, digest, out = None, 0, 0, None, []
        for batch in batches:
            for path, a, k, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n", "ids"))):
                if path != now:
                    if now is not None:
                        out.append((now, first, n, digest.hexdigest()))
                    now, first, n, digest = path, a, 0, hashlib.sha256()
                elif n:
                    digest.update(b",")
                digest.update(ids.encode())
                n += k
            if out:
                yield _rows(out, PARTS[:4])
                out = []
        if now is not None:
            yield _rows([*out, (now, first, n, digest.hexdigest())], PARTS[:4])

    joined = cut.mapInArrow(join, "path binary, first bigint, n bigint, ends string")
    return parts.filter("ends IS NOT NULL").select("path", "first", "n", "ends").unionByName(joined).withColumnRenamed("n", "copies")


def prefixes(paths: DataFrame) -> DataFrame:
    """path, prefix, parent, depth and words of the last turn, for all prefixes of one turn and more."""
    ship()
    fields = [("path", pa.binary()), ("prefix", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, turns in zip(batch.column("path").to_pylist(), batch.column("turns").to_pylist()):
                parent = ROOT
                for k, (name, words) in enumerate(zip(chain(turns), np.frombuffer(turns, TURN)["words"].tolist())):
                    out.append((path, name, parent, k + 1, words))
                    parent = name
                    if len(out) == 10_000:
                        yield _rows(out, fields)
                        out = []
            if out:
                yield _rows(out, fields)

    return paths.select("path", "turns").mapInArrow(run, "path binary, prefix binary, parent binary, depth bigint, words bigint")


# --- tries -----------------------------------------------------------------------------------------------------------


class Louds:
    """A forest in level order below one root. bits: for each node, root first, a one for every child and a zero."""

    def __init__(self, degree: np.ndarray, levels: list[int]):
        self.n, self.levels = len(degree), levels
        bits = np.ones(2 * self.n - 1, np.uint8)
        bits[np.cumsum(degree + 1) - 1] = 0
        self.bits, self.size = np.packbits(bits), len(bits)

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=self.size)

    def parent(self) -> np.ndarray:
        """The parent of each node but the root: the zeros before its one are the nodes that are finished."""
        ones = np.flatnonzero(self.unpacked())
        return ones - np.arange(len(ones))

    def degree(self) -> np.ndarray:
        zeros = np.flatnonzero(self.unpacked() == 0)
        return np.diff(zeros, prepend=-1) - 1

    def upward(self, add: np.ufunc, *values: np.ndarray) -> None:
        """Adds the values of all nodes to their parents', from the last level to the first."""
        parent = np.concatenate([[0], self.parent()])
        for a, b in list(zip(self.levels, self.levels[1:]))[::-1]:
            for v in values:
                add.at(v, parent[a:b], v[a:b])


def forest(turns: list[bytes], shards: list[bytes]) -> tuple[Louds, np.ndarray, np.ndarray, np.ndarray]:
    """The trie of many paths, those of a shard under one child of the root: words of each node, the node at which each path
    ends, and a path that goes through each node."""
    flat = np.frombuffer(b"".join(turns), TURN)
    length = np.array([len(t) // TURN.itemsize for t in turns], np.int64)
    start = np.cumsum(length) - length
    key = np.frombuffer(b"".join(shards), "<u8").reshape(-1, 2)
    node, live = np.zeros(len(turns), np.int64), np.arange(len(turns))
    words, through, degree, levels = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [1]
    level, before = 0, 1
    while len(live := live[length[live] > level]):
        at = flat[start[live] + level]
        a, b = (key[live, 0], key[live, 1]) if not level else (at["a"], at["b"])
        order = np.lexsort((b, a, node[live]))
        a, b, parent, live = a[order], b[order], node[live][order], live[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (parent[1:] != parent[:-1])])
        degree.append(np.bincount(parent[new] - (levels[-1] - before), minlength=before))
        node[live] = levels[-1] + np.cumsum(new) - 1
        words.append(at["words"][order][new].astype(np.int64))
        through.append(live[new])
        before, level = int(new.sum()), level + 1
        levels.append(levels[-1] + before)
    degree.append(np.zeros(before, np.int64))
    return Louds(np.concatenate(degree), levels), np.concatenate(words), node, np.concatenate(through)


def rolled(trie: Louds, words: np.ndarray, copies: np.ndarray, first: np.ndarray, below: tuple[np.ndarray, ...] | None = None) -> dict[str, np.ndarray]:
    """What each node has in its subtree. copies, first: the conversations that end at a node, and the smallest of them.
    below: children, leaves and saved tokens of shards under the nodes, whose conversations are in copies and first."""
    kids, leaves, saved = (x.copy() for x in below) if below else (np.zeros(trie.n, np.int64) for _ in range(3))
    n, least, children = copies.copy(), first.copy(), trie.degree() + kids
    trie.upward(np.add, n)
    trie.upward(np.minimum, least)
    leaves += children == 0
    saved += (n - 1) * words
    trie.upward(np.add, leaves, saved)
    return {"n_convs": n, "conv_id": least, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}


def shards(paths: DataFrame) -> DataFrame:
    """The nodes of all shards. paths: path, turns, above (how many heavy prefixes the path has), first, copies, ends. top is
    the name of the heavy prefix above, where a node has one."""
    ship()
    keyed = [("shard", pa.binary()), ("top", pa.binary()), ("above", pa.int64()), ("turns", pa.binary()), ("first", pa.int64()), ("copies", pa.int64()), ("ends", pa.string())]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns, above, *rest in zip(*(batch.column(c).to_pylist() for c in ("turns", "above", "first", "copies", "ends"))):
                top, shard = ROOT, ROOT
                for k, name in enumerate(chain(turns[: TURN.itemsize * (above + 1)])):
                    top, shard = shard, name
                out.append((shard, top, above, turns[TURN.itemsize * above :], *rest))
            if out:
                yield _rows(out, keyed)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c, _ in keyed)):
                if size >= TURNS_AT_ONCE and row[0] != last:
                    yield nodes(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3]) // TURN.itemsize
                last = row[0]
        if rows:
            yield nodes(rows)

    def nodes(rows: list[tuple]) -> pa.RecordBatch:
        shard, top, above, turns, first, copies, hashes = zip(*rows)
        trie, words, at, through = forest(list(turns), list(shard))
        n, least, final = np.zeros(trie.n, np.int64), np.full(trie.n, NOBODY), np.full(trie.n, -1)
        n[at], least[at], final[at] = copies, first, np.arange(len(rows))  # at most one path ends at a node
        found = rolled(trie, words, n, least)
        level = np.repeat(np.arange(len(trie.levels)), np.diff(trie.levels, prepend=0))
        parent, upper = found["conv_id"][trie.parent()], level[1:] == 1
        values = {
            **{c: pa.array(v[1:]) for c, v in found.items()},
            "depth": pa.array((np.array(above)[through] + level)[1:]),
            "parent_conv_id": pa.array(parent, mask=upper),
            "ends_sha256": pa.array([hashes[k] if k >= 0 else NO_ENDS for k in final[1:].tolist()], pa.string()),
            "top": pa.array([top[k] if u else None for k, u in zip(through[1:].tolist(), upper.tolist())], pa.binary()),
        }
        return pa.RecordBatch.from_arrays([values[c] for c in [*COLUMNS, "top"]], [*COLUMNS, "top"])

    rows = paths.select("turns", "above", "first", "copies", "ends").mapInArrow(
        key, "shard binary, top binary, above bigint, turns binary, first bigint, copies bigint, ends string"
    )
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, VALUES + ", top binary")


def upper(heavy: DataFrame, final: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of the heavy prefixes (prefix, parent, depth, words) and of the root, with their names. final: the paths that
    end there; nodes: those of the shards, whose sums are added up for each heavy prefix before they get here."""
    ship()
    spark = nodes.sparkSession
    root = spark.createDataFrame([(bytearray(ROOT), None, 0, 0)], "prefix binary, parent binary, depth bigint, words bigint")
    below = nodes.filter("top IS NOT NULL").groupBy(F.col("top").alias("prefix")).agg(
        F.count("*").alias("kids"), F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    rows = root.unionByName(heavy).join(below, "prefix", "left").join(final.select(F.col("path").alias("prefix"), "first", "copies", "ends"), "prefix", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("kids", "n", "leaves", "saved", "copies")]
    least = F.coalesce(F.least("least", "first"), F.lit(NOBODY)).alias("least")
    rows = rows.select("prefix", "parent", "depth", "words", "ends", least, *zero)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).sort_by("depth")
        names, parents = whole["prefix"].to_pylist(), whole["parent"].to_pylist()
        depth = whole["depth"].to_numpy()
        levels, order, place = [], [], {None: -1}
        for d in range(int(depth[-1]) + 1):  # a level's nodes in the order of their parents
            a, b = np.searchsorted(depth, [d, d + 1])
            level = sorted(range(a, b), key=lambda k: (place[parents[k]], names[k]))
            place |= {names[k]: len(order) + i for i, k in enumerate(level)}
            order += level
            levels.append(len(order))
        column = {c: whole[c].to_numpy()[order] for c in ("words", "least", "kids", "n", "leaves", "saved", "copies")}
        parent = np.array([place[parents[k]] for k in order[1:]], np.int64)
        trie = Louds(np.bincount(parent, minlength=len(order)), levels)
        found = rolled(trie, column["words"], column["n"] + column["copies"], column["least"], (column["kids"], column["leaves"], column["saved"]))
        if not found["n_convs"][0]:
            return
        above = found["conv_id"][np.concatenate([[0], trie.parent()])]
        hashes = whole["ends"].to_pylist()
        values = {
            **{c: pa.array(v) for c, v in found.items()},
            "depth": pa.array(depth[order]), "parent_conv_id": pa.array(above, mask=np.arange(len(order)) == 0),
            "ends_sha256": pa.array([hashes[k] or NO_ENDS for k in order], pa.string()), "prefix": pa.array([names[k] for k in order], pa.binary()),
        }
        yield pa.RecordBatch.from_arrays([values[c] for c in [*COLUMNS, "prefix"]], [*COLUMNS, "prefix"])

    return rows.coalesce(1).mapInArrow(merge, VALUES + ", prefix binary")


def prefix_trie(conversations: DataFrame, group: int = GROUP, first: int = FIRST, shares: int = SHARES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    whole = written(rebuilt(conversations, group, first), "paths")
    same = ends(whole)
    paths = written(same.join(whole.withColumnRenamed("conv_id", "first").drop("path"), "first"), "different")
    limit = min(max(paths.count() // shares, least), most)
    names = prefixes(paths)
    heavy = written(names.groupBy("prefix", "parent", "depth", "words").agg(F.count("*").alias("n")).filter(F.col("n") > limit).drop("n"), "heavy")
    few = heavy.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = F.broadcast(heavy.select("prefix")) if few else heavy.select("prefix")
    above = names.join(known, "prefix", "left_semi").groupBy("path").agg(F.max("depth").alias("above"))
    paths = paths.join(above, "path", "left").withColumn("above", F.coalesce("above", F.lit(0)))
    own = F.expr(f"octet_length(turns) div {TURN.itemsize}")
    nodes = written(shards(paths.filter(own > F.col("above"))), "nodes")
    high = written(upper(heavy, paths.filter(own == F.col("above")), nodes), "upper")
    over = high.select(F.col("prefix").alias("top"), F.col("conv_id").alias("over"))
    tops = nodes.filter("top IS NOT NULL").join(F.broadcast(over) if few else over, "top").withColumn("parent_conv_id", F.col("over"))
    return nodes.filter("top IS NULL").select(*COLUMNS).unionByName(tops.select(*COLUMNS)).unionByName(high.select(*COLUMNS))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The remainder of a byte string by the polynomial of CRC-32, bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END))"""
ORACLE = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, turn, md5(length(r) || ':' || r || x) AS label, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, label) AS p FROM l),
h AS (SELECT c, c - c % 20 AS b, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
rb AS (SELECT h.c, 0 AS part, p.p, label, w FROM h JOIN p ON p.c = h.b AND p.p <= h.h
       UNION ALL SELECT h.c, 1, p.p, label, w FROM h JOIN p ON p.c = h.c AND p.p > h.h),
g AS (SELECT h.c, coalesce(list(label ORDER BY part, p) FILTER (label IS NOT NULL), []) AS ls,
             coalesce(list(w ORDER BY part, p) FILTER (label IS NOT NULL), []) AS ws FROM h LEFT JOIN rb USING (c) GROUP BY h.c),
m AS (SELECT c, ls, ws, unnest(generate_series(0, len(ls))) AS d FROM g),
n AS (SELECT d, array_to_string(ls[1:d], ',') AS k, any_value(coalesce(ws[d], 0)) AS w, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len(ls)), '')) AS ends_sha256
      FROM m GROUP BY ALL),
u AS (SELECT *, left(k, greatest(33 * (d - 1) - 1, 0)) AS pk FROM n),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids USING (d, k)),
sub AS (SELECT a AS d, left(k, greatest(33 * a - 1, 0)) AS k, count(*) FILTER (n_children = 0) AS n_leaves,
               sum((n_convs - 1) * w)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d::BIGINT AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN sub USING (d, k) LEFT JOIN n o ON o.d = v.d - 1 AND o.k = v.pk
"""

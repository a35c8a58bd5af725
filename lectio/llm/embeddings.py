"""Embedding near-dedup by PCA-ordered tiles.

Equal vectors form a class, and only classes are compared. They are turned into the basis of their principal components,
the largest first, put in the order of the first and cut into tiles of TILE, whatever the partitions are. Vectors of
different lengths never link; each length has a basis and tiles of its own. Tiles whose boxes over the leading
components are too far from each other are never paired. Within a pair of tiles the products of the leading components
are accumulated first; the rest of a product is at most the product of the two suffix norms, and where both together
can't reach the threshold the comparison ends. What is left is decided in double precision on the vectors as given.

The basis is from at most SAMPLE vectors; any orthonormal basis gives the same result. A pair of tiles gives counts and
a spanning forest of its links, never all its pairs.

Defined results. Null and zero vectors and vectors with null or non-finite components link with nothing, vectors of
different lengths not with each other. Rows without a vec_id are not compared and get a null component. Rows that repeat a vec_id
are counted each in n_links, by their own vectors, and are one vertex of components, whatever their vectors are. A vec_id may be
of any type that has an order. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.llm.common import ship, table, written
from lectio.llm.components import components

THRESHOLD = 0.95
TILE, SAMPLE, BOX = 4096, 8192, 8
LEADING = (16, 32)
SLACK = 1e-9
ROWS_AT_ONCE = 256


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def basis(classes: DataFrame, d: int) -> np.ndarray:
    """Columns: the principal directions of a sample, the largest variance first."""
    got = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    x = unit(matrix(got, d))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """The basis of each length that vectors have."""
    lengths = sorted(r.d for r in classes.select(F.size("embedding").alias("d")).distinct().collect())
    return {d: basis(classes.filter(F.size("embedding") == d), d) for d in lengths}


def tiled(classes: DataFrame, turns: dict[int, np.ndarray]) -> DataFrame:
    """classes in the order of length and first component, with the tile and the leading components (lead)."""
    ship()
    kind = classes.schema["embedding"].dataType.simpleString()

    @F.arrow_udf("array<double>")
    def lectio_lead(column: pa.Array) -> pa.Array:
        length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        out = np.zeros((len(column), BOX))
        for d in np.unique(length).tolist():
            rows = np.flatnonzero(length == d)
            y = unit(matrix(column.take(pa.array(rows)), d)) @ turns[d][:, :BOX]
            out[rows, : y.shape[1]] = y
        return pa.array(list(out), pa.list_(pa.float64()))

    led = classes.withColumn("lead", lectio_lead("embedding")).withColumns({"first": F.col("lead")[0], "d": F.size("embedding")})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            d, place = batch.column("d").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for x in np.unique(d).tolist():
                place[d == x] = seen[x] + np.arange((d == x).sum())
                seen[x] += int((d == x).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part)), pa.array(place), *(batch.column(c) for c in names[2:])], names)

    names = ["part", "place", "d", "node", "n", "embedding", "lead"]
    ranged = led.repartitionByRange("d", "first", "node").sortWithinPartitions("d", "first", "node")
    found = ranged.select(*names[2:]).mapInArrow(number, f"part bigint, place bigint, d int, node bigint, n bigint, embedding {kind}, lead array<double>")
    found = written(found, "placed")
    totals = found.groupBy("d", "part").agg(F.count("*").alias("rows"))  # a row a partition and length
    starts = totals.select("d", "part", (F.sum("rows").over(W.partitionBy("d").orderBy("part")) - F.col("rows")).alias("before"))
    tile = F.shiftleft(F.col("d").cast("long"), 40) + F.floor((F.col("before") + F.col("place")) / TILE)
    return found.join(starts, ["d", "part"]).select(tile.alias("tile"), "d", "node", "n", "embedding", "lead")


def paired(tiles: DataFrame, threshold: float) -> DataFrame:
    """p, q and a row of tiles for each pair of tiles near enough that the row belongs to."""
    box = [F.array(*(f(F.col("lead")[k]) for k in range(BOX))).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = tiles.groupBy("tile", "d").agg(*box)
    reach = math.sqrt(2 * (1 - threshold)) + SLACK  # how far apart linked unit vectors are at most
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / reach).cast("int"), F.floor(high / reach).cast("int"))).alias("cell")
    a = boxes.select("*", cells(F.col("low")[0] - reach, F.col("high")[0] + reach)).alias("a")
    b = boxes.select("*", cells(F.col("low")[0], F.col("high")[0])).alias("b")
    gap = lambda k: F.greatest(F.lit(0.0), F.col("b.low")[k] - F.col("a.high")[k], F.col("a.low")[k] - F.col("b.high")[k])
    near = sum((gap(k) * gap(k) for k in range(BOX)), F.lit(0.0)) <= reach * reach
    meet = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.tile") <= F.col("b.tile")) & near)
    pairs = meet.select(F.col("a.tile").alias("p"), F.col("b.tile").alias("q")).distinct()
    pairs = written(pairs, "pairs")
    of = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("tile"))
    return tiles.select("tile", "d", "node", "n", "embedding").join(of, "tile")


def near(p: np.ndarray, q: np.ndarray, yp: np.ndarray, yq: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row by row blocks of which rows of q the rows of p reach: p, q unit vectors as given, yp, yq turned."""
    d = p.shape[1]
    cuts = [0, *(c for c in LEADING if c < d), d]
    rest = [[np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in cuts[1:-1]] for y in (yp, yq)]
    for k in range(0, len(p), ROWS_AT_ONCE):
        rows = slice(k, k + ROWS_AT_ONCE)
        if len(cuts) == 2:
            yield k, p[rows] @ q.T >= threshold
            continue
        first = yp[rows, : cuts[1]] @ yq[:, : cuts[1]].T
        i, j = np.nonzero(first + np.multiply.outer(rest[0][0][rows], rest[1][0]) >= threshold - SLACK)
        hit = np.zeros(first.shape, bool)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            total = first[a, b]
            for step, (low, high) in enumerate(zip(cuts[1:-1], cuts[2:]), 1):
                total = total + np.einsum("ij,ij->i", yp[a + k, low:high], yq[b, low:high])
                if high < d:
                    go = total + rest[0][step][a + k] * rest[1][step][b] >= threshold - SLACK
                    a, b, total = a[go], b[go], total[go]
            go = total >= threshold - SLACK
            a, b = a[go], b[go]
            go = np.einsum("ij,ij->i", p[a + k], q[b]) >= threshold
            hit[a[go], b[go]] = True
        yield k, hit


def forest(linked: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """Edges (row, column) that connect what the matrix connects."""
    rows_left, columns_left = np.ones(len(linked), bool), np.ones(linked.shape[1], bool)
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if not rows_left[start]:
            continue
        rows_left[start] = False
        if same:
            columns_left[start] = False
        todo = [(start, True)]
        while todo:
            at, is_row = todo.pop()
            if is_row:
                new = np.flatnonzero(linked[at] & columns_left)
                columns_left[new] = False
                if same:
                    rows_left[new] = False
                yield from ((at, c) for c in new.tolist())
                todo += [(c, same) for c in new.tolist()]
            else:
                new = np.flatnonzero(linked[:, at] & rows_left)
                rows_left[new] = False
                yield from ((r, at) for r in new.tolist())
                todo += [(r, True) for r in new.tolist()]


def links(tiles: DataFrame, turns: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """u, v, n: where v is null, n other vectors that u links with in one pair of tiles; else a link."""
    ship()

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        p, q, d = key[0].as_py(), key[1].as_py(), rows.column("d")[0].as_py()
        tile = rows.column("tile").to_numpy()
        order = np.argsort(rows.column("node").to_numpy(), kind="stable")
        tile, rows = tile[order], rows.take(pa.array(order))
        node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        x = unit(matrix(rows.column("embedding").combine_chunks(), d))
        y = x @ turns[d]
        a, b = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
        linked = np.zeros((len(a), len(b)), bool)
        for k, hit in near(x[a], x[b], y[a], y[b], threshold):
            linked[k : k + len(hit)] = hit
        if p == q:
            linked |= linked.T  # rounding may differ by the order
            np.fill_diagonal(linked, False)
        edges = np.array(list(forest(linked, p == q)), np.int64).reshape(-1, 2)
        counts = [(node[a], linked @ n[b])] + ([] if p == q else [(node[b], linked.T @ n[a])])
        u = np.concatenate([node[a][edges[:, 0]], *(i[c > 0] for i, c in counts)])
        v = pa.concat_arrays([pa.array(node[b][edges[:, 1]], pa.int64()), pa.nulls(len(u) - len(edges), pa.int64())])
        m = np.concatenate([np.zeros(len(edges), np.int64), *(c[c > 0] for _, c in counts)])
        return pa.table({"u": pa.array(u, pa.int64()), "v": v, "n": pa.array(m, pa.int64())})

    return paired(tiles, threshold).groupBy("p", "q").applyInArrow(compare, "u bigint, v bigint, n bigint")


def grouped(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links and component_id, a row for each row of vectors."""
    rows = vectors.select("vec_id", "embedding")
    numbered = valid(vectors).groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    classes = written(numbered, "classes")  # numbers are settled by being written
    turns = bases(classes)
    if not turns:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = written(links(written(tiled(classes, turns), "tiles"), turns, threshold), "links")
    known = F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node")
    of = written(rows.join(classes.select("embedding", "node"), "embedding", "left").select("vec_id", known), "rows")
    # classes with a vec_id in common are one component
    shared = of.filter("node IS NOT NULL").distinct()
    first = shared.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u <> v")
    twice = shared.join(first.select("vec_id", "u"), "vec_id").filter("node <> u").select("u", F.col("node").alias("v"))
    reached = written(components(found.filter("v IS NOT NULL").select("u", "v").unionByName(twice)), "reached")
    least = classes.select("node", "least").join(reached, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    reached = reached.join(least, "component").select("node", "component_id")
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    named = classes.select("node", "n", "least").join(counts, "node", "left").join(reached, "node", "left")
    named = named.select("node", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    named = written(named, "named")  # so that both sides of the last join come from a shuffle of their own, which can be split where a class is large
    has = F.col("vec_id").isNotNull()
    joined = of.join(named, "node", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(has, F.coalesce("component_id", "vec_id")).alias("component_id"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same rows from all pairs; for small tables.
ORACLE = f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS MATERIALIZED (SELECT * FROM r WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT r, count(*) AS n_links FROM p GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM r LEFT JOIN n USING (r) LEFT JOIN least ON vec_id = a
"""

"""Packing by concatenate and cut.

First pass: each partition encodes its documents, notes where in the partition each one starts, and is written. The
partitions' totals, one row each, give by a prefix sum where each partition starts in the whole. Second pass: from its
global offset each document is cut at the windows' edges, without a shuffle. A window that lies across documents or
partitions is the sum of its boundary records, the pieces with that sequence_id. Only the last window has padding.

Defined results. A null or empty text is a document of the end id alone. Rows that repeat a doc_id are documents of
their own. No rows give no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.llm.common import ship, table, written
from lectio.llm.tokens import default_path, encoder, slices

LENGTH, END = 2048, 1
#: So many partitions' starts, 16 bytes each, are sent to all executors; with more of them the join is a shuffle.
BROADCAST_PARTITIONS = 1_000_000


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """part, start (in the partition), doc_id, n, ids (little-endian, as wide as the vocabulary needs), width."""
    ship()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, total = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = e.encode(batch.column("text"), end)
                data, w = ids.tobytes(), e.dtype.itemsize
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int64)), pa.array(at[:-1] + total), batch.column("doc_id"), pa.array(np.diff(at)),
                        pa.array([data[a * w : b * w] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()), pa.array(np.full(n, w, np.int32)),
                    ],
                    ["part", "start", "doc_id", "n", "ids", "width"],
                )
                total += int(at[-1])

    return docs.select("doc_id", "text").mapInArrow(encode, f"part bigint, start bigint, doc_id {kind}, n bigint, ids binary, width int")


def placed(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """encoded() with `at`, the document's place in the concatenation of all documents."""
    first = written(encoded(docs, path, end), "tokens")
    totals = first.groupBy("part").agg(F.sum("n").alias("total"))
    starts = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("part_at"))  # a row a partition
    starts = written(starts, "starts")
    few = starts.limit(BROADCAST_PARTITIONS + 1).count() <= BROADCAST_PARTITIONS
    return first.join(F.broadcast(starts) if few else starts, "part").withColumn("at", F.col("part_at") + F.col("start"))


def cut(found: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for."""
    ship()
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            window = at // length
            many = (at + n - 1) // length - window + 1
            row = np.repeat(np.arange(len(n)), many)
            sequence = window[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            low = np.maximum(sequence * length, at[row])
            size = np.minimum((sequence + 1) * length, (at + n)[row]) - low
            start = low - at[row]
            crc, out, last = [], [], -1
            for r, a, b in zip(row.tolist(), start.tolist(), (start + size).tolist()):
                if r != last:
                    ids, last = np.frombuffer(batch.column("ids")[r].as_buffer(), f"<u{batch.column('width')[r].as_py()}").astype("<u4"), r
                crc.append(zlib.crc32(ids[a:b]))
                if with_ids:
                    out.append(ids[a:b].tobytes())
            columns = [batch.column("doc_id").take(pa.array(row)), start, size, crc, n[row], sequence, low - sequence * length] + [out] * with_ids
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.binary() if c is out else pa.int64()) for c in columns], names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return found.select("doc_id", "at", "n", "ids", "width").mapInArrow(pieces, schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of docs, a row each."""
    return cut(placed(docs, path or default_path(), end), length)


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, pad: int = 0) -> DataFrame:
    """sequence_id and ids (array of long, padded to length): windows put together from their boundary records."""
    parts = cut(placed(docs, path or default_path(), end), length, with_ids=True)
    joined = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    @F.arrow_udf("array<bigint>")
    def lectio_window(parts: pa.Array) -> pa.Array:
        rows = []
        for row in parts.to_pylist():
            ids = np.frombuffer(b"".join(p["ids"] for p in row), "<u4")
            rows.append(np.concatenate([ids, np.full(length - len(ids), pad)]).astype(np.int64))
        return pa.array(rows, pa.list_(pa.int64()))

    return joined.select("sequence_id", lectio_window("parts").alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

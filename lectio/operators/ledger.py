"""A ledger of requests to a model: what has an answer is not asked again, by a rerun, by another job or by a task that is retried.

A request is known by a hash of its prompt and of the name of the model. Before a call the open requests are what an anti-join
with the ledger leaves, each different one once, written, so that a partition holds the same requests whenever it runs. A task
notes each answer in the shared folder as it comes; if Spark runs the task again, it reads its notes first. When the job is done
its answers are appended to the ledger and the notes go. Failures are kept as rows with an error and are asked again next time.

Notes are written by Arrow's file systems (local and network folders, HDFS, object stores); where Arrow has none for the
folder's scheme, a retried task asks its own requests once more, and nothing else changes.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.functions.deploy import ship
from lectio.functions.files import Files
from lectio.functions.tables import written

#: How warm a first and a second try are
TEMPERATURES = (0.7, 0.2)
SCHEMA = "request string, answer string, error string, tries int, seconds double, answered_at timestamp"
COLUMNS = ["request", "answer", "error", "tries", "seconds", "answered_at"]


def request_id(prompt: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(model), prompt), 256)


def within(seconds: float | None, call: Callable[[], str]) -> str:
    """call(), or TimeoutError. What takes too long goes on in a thread of its own, which ends with the worker."""
    if seconds is None:
        return call()
    box: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            box.put((call(), None))
        except BaseException as e:  # noqa: BLE001  handed on to whoever waits
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        answer, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if error is not None:
        raise error
    return answer


def tried(call: Callable[[str, float], str], prompt: str, accept: Callable[[str], bool], timeout: float | None, errors: tuple[type[Exception], ...]) -> tuple[str | None, str | None, int, float]:
    """answer, error, tries and seconds: a try for each of TEMPERATURES, until an answer is accepted. An answer that isn't
    is kept if there is no better one, with the error that says so."""
    began, answer, error, n = time.monotonic(), None, None, 0
    for n, warmth in enumerate(TEMPERATURES, 1):
        try:
            found = within(timeout, lambda: call(prompt, warmth))
            if accept(found):
                return found, None, n, time.monotonic() - began
            answer, error = found, "not accepted"
        except errors as e:
            error = f"{type(e).__name__}: {e}"[:300]
    return answer, error, n, time.monotonic() - began


class Notes:
    """The answers of one partition so far, a small file each time some have come."""

    def __init__(self, folder: str, part: int):
        try:
            from pyarrow import fs

            self.fs, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            self.folder = f"{path}/part={part}"
            self.fs.create_dir(self.folder, recursive=True)
        except (pa.ArrowException, OSError, ValueError):
            self.fs = None

    def read(self) -> dict[str, list]:
        if self.fs is None:
            return {}
        from pyarrow import fs

        out = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            if info.base_name.endswith(".json"):
                with self.fs.open_input_file(info.path) as f:
                    out |= {r[0]: r for r in json.loads(f.read())}
        return out

    def add(self, rows: list[list]) -> None:
        if self.fs is not None:
            name = f"{self.folder}/{uuid.uuid4().hex}"
            with self.fs.open_output_stream(name) as f:
                f.write(json.dumps(rows).encode())
            self.fs.move(name, f"{name}.json")  # whole or not at all


class Ledger:
    """The answers of one model in a folder."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path, model

    def rows(self) -> DataFrame:
        """The last row of each request."""
        if not Files(self.spark).names(f"{self.path}/answers"):
            return self.spark.createDataFrame([], SCHEMA)
        every = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/answers")
        good = F.struct(F.col("error").isNull(), "answered_at")
        return every.groupBy("request").agg(F.max_by(F.struct(*COLUMNS), good).alias("r")).select("r.*")

    def answered(
        self, rows: DataFrame, prompt: Column, call: Callable[[str, float], str], accept: Callable[[str], bool] = bool, timeout: float | None = None,
        at_once: int = 8, errors: tuple[type[Exception], ...] = (OSError, ValueError), partitions: int | None = None,
    ) -> DataFrame:
        """rows with answer, error, tries and seconds. A null prompt isn't asked and has none of these. at_once: requests of a task
        that are out together. Errors other than `errors` are bugs and end the task."""
        ship()
        asked = written(rows.withColumn("lectio_prompt", prompt).withColumn("request", F.when(F.col("lectio_prompt").isNotNull(), request_id(F.col("lectio_prompt"), self.model))), "requests")
        done = self.rows().filter("error IS NULL").select("request")
        open_ones = asked.filter("request IS NOT NULL").select("request", F.col("lectio_prompt").alias("prompt")).distinct().join(done, "request", "left_anti")
        open_ones = written(open_ones.repartition(partitions, "request") if partitions else open_ones.repartition("request"), "open")
        folder = f"{self.path}/notes/{uuid.uuid4().hex}"

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            notes, known = None, {}
            for batch in batches:
                if notes is None:
                    notes = Notes(folder, TaskContext.get().partitionId())
                    known = notes.read()
                todo = list(zip(batch.column("request").to_pylist(), batch.column("prompt").to_pylist()))
                for k in range(0, len(todo), at_once):
                    some = todo[k : k + at_once]
                    fresh = answers_of([x for x in some if x[0] not in known], notes)
                    yield rows_of([known.get(r) or fresh[r] for r, _ in some])

        def answers_of(requests: list[tuple[str, str]], notes: Notes) -> dict[str, list]:
            out: queue.Queue = queue.Queue()

            def one(request: str, text: str) -> None:
                try:
                    out.put((request, [request, *tried(call, text, accept, timeout, errors)], None))
                except BaseException as e:  # noqa: BLE001  raised again below
                    out.put((request, None, e))

            for x in requests:
                threading.Thread(target=one, args=x, daemon=True).start()
            found, bug = {}, None
            for _ in requests:  # each is noted when it comes, also beside one that ends the task
                request, row, error = out.get()
                if error is None:
                    found[request] = row
                    notes.add([row])
                else:
                    bug = error
            if bug is not None:
                raise bug
            return found

        def rows_of(found: list[list]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], COLUMNS[:5])

        fresh = open_ones.mapInArrow(ask, "request string, answer string, error string, tries int, seconds double").withColumn("answered_at", F.current_timestamp())
        fresh.write.mode("append").parquet(f"{self.path}/answers")
        Files(self.spark).delete(folder)
        return asked.join(self.rows().drop("answered_at"), "request", "left").drop("request", "lectio_prompt")

    def waits(self) -> DataFrame:
        """n, failed, seconds and tries of all requests, for a look at what a model costs."""
        return self.rows().agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.sum("seconds").alias("seconds"), F.sum("tries").alias("tries"))


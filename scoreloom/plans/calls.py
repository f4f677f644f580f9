"""Calls of clients for the rows of a table: exact values both ways, several at a time, each prompt once.

A client is a plain callable that gets a record (a dict of the row's values) and runs on the executors. Rows go to it
as Arrow holds them, so an id is the same number whatever else is null beside it, and the row's own columns come back
untouched. With a ledger each answer is written as soon as it is there: a task that is run again reads what its
earlier attempts have written, and a later run asks only what no run has answered."""

from __future__ import annotations

import json
import posixpath
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows whose replies are held at a time, for each call in flight.
HELD = 16
KEY = "call_key"


@dataclass(frozen=True)
class Limits:
    """in_flight: calls at a time in each task. per_second: calls begun a second in each task (None: any number).
    until: the time (seconds since 1970) from which on no call is begun; rows left then fail with a TimeoutError."""

    in_flight: int = 1
    per_second: float | None = None
    until: float | None = None


class _Pace:
    """Lets calls begin no faster than the limits say."""

    def __init__(self, limits: Limits):
        self.limits, self.lock, self.next = limits, threading.Lock(), 0.0

    def wait(self) -> None:
        if self.limits.per_second:
            with self.lock:
                mine = max(self.next, time.monotonic())
                self.next = mine + 1 / self.limits.per_second
            time.sleep(max(0.0, mine - time.monotonic()))
        if self.limits.until is not None and time.time() >= self.limits.until:
            raise TimeoutError("the deadline has passed")


def _fitted(value, kind: pa.DataType):
    """A reply's value as the column's type wants it: whole numbers given as 5.0 or "5" are 5."""
    if value is None:
        return None
    if pa.types.is_integer(kind) and not isinstance(value, bool):
        return int(value)
    if pa.types.is_floating(kind):
        return float(value)
    if pa.types.is_string(kind) and not isinstance(value, str):
        return json.dumps(value, default=str)
    return value


def _columns(replies: list[dict], made: pa.Schema) -> list[pa.Array]:
    return [pa.array([_fitted(r.get(f.name), f.type) for r in replies], f.type) for f in made]


def _replies(ask: Callable, limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Slices of the batches with the replies to their rows, in order, with in_flight calls at a time."""
    pace = _Pace(limits)
    with ThreadPoolExecutor(limits.in_flight) as pool:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD * limits.in_flight):
                part = batch.slice(at, HELD * limits.in_flight)
                yield part, list(pool.map(lambda record: ask(record, pace.wait), part.to_pylist()))


def answered(df: DataFrame, ask: Callable[[dict, Callable[[], None]], dict], made: str, limits: Limits = Limits()) -> DataFrame:
    """df with the columns `made` (a DDL) from ask(record, begin), a dict of them for each row.

    ask calls begin() before each call of the client, which waits its turn or raises when the deadline has passed; it
    turns failures into values itself."""
    fields = StructType.fromDDL(made)
    schema = StructType(df.schema.fields + fields.fields)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, replies in _replies(ask, limits, batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *_columns(replies, arrow)], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def ledger_rows(spark: SparkSession, folder: str, made: str) -> DataFrame:
    """(call_key, reply, ok): the last good reply of each key in the ledger, else its last failure. What a task had not
    written to its end is left out."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    rows = spark.read.schema(f"{KEY} string, ok boolean, at double, reply struct<{_struct(made)}>").option("recursiveFileLookup", True).json(folder)
    whole = rows.filter(F.col(KEY).isNotNull() & F.col("ok").isNotNull())
    return whole.groupBy(KEY).agg(F.max_by(F.struct("reply", "ok"), F.struct("ok", "at", F.to_json("reply"))).alias("r")).select(KEY, "r.reply", "r.ok")


def _struct(made: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(made))


class _Journal:
    """The file in which one attempt of a task keeps its replies; others of the same part of the same run are read."""

    def __init__(self, folder: str, per_file: int):
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.base, self.per_file, self.held, self.lock = base, per_file, [], threading.Lock()
        self.fs.create_dir(base, recursive=True)
        self.known: dict[str, dict] = {}
        for info in self.fs.get_file_info(fs.FileSelector(base)):
            with self.fs.open_input_stream(info.path) as file:
                for line in file.read().decode("utf-8", "replace").splitlines():
                    try:
                        row = json.loads(line)
                        self.known[row[KEY]] = row["reply"]
                    except (ValueError, KeyError):  # cut off when its task was lost
                        continue

    def add(self, key: str, reply: dict, ok: bool) -> None:
        with self.lock:
            self.held.append(json.dumps({KEY: key, "ok": ok, "at": time.time(), "reply": reply}, default=str))
            if len(self.held) >= self.per_file:
                self.flush()

    def flush(self) -> None:
        if self.held:
            with self.fs.open_output_stream(posixpath.join(self.base, f"{uuid.uuid4().hex}.json")) as out:
                out.write(("\n".join(self.held) + "\n").encode())
            self.held = []


def answered_once(
    df: DataFrame, ask: Callable[[dict, Callable[[], None]], dict], made: str, ledger: str, ok: Callable[[dict], bool], limits: Limits = Limits(), per_file: int = 1
) -> DataFrame:
    """answered(), where rows that are equal in all columns are asked once, and those with a good reply in the ledger
    (a folder) not at all. Failures stay in the ledger too; the next run asks them again.

    The calls are made when this is called, and each reply is written when it comes (per_file: replies a file), so a
    run that is ended keeps its answers. A task's second attempt asks only what the first had no reply to; two attempts
    at the same time (speculation) may both ask."""
    spark = df.sparkSession
    fields = StructType.fromDDL(made)
    seen = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.withColumn(KEY, F.sha2(F.to_json(F.struct(*seen), {"ignoreNullFields": "false"}), 256))
    done = ledger_rows(spark, ledger, made).filter("ok").select(KEY)
    todo = keyed.dropDuplicates([KEY]).join(done, KEY, "left_anti")
    todo = todo.select(*df.columns, KEY)
    run = f"{ledger.rstrip('/')}/{uuid.uuid4().hex}"

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        journal = _Journal(f"{run}/{TaskContext.get().partitionId()}", per_file)

        def once(record: dict, begin: Callable[[], None]) -> dict:
            key = record.pop(KEY)
            if key not in journal.known:
                reply = ask(record, begin)
                journal.add(key, reply, ok(reply))
            return {KEY: key}

        for part, _ in _replies(once, limits, batches):
            journal.flush()
            yield part.select([KEY])

    todo.mapInArrow(call, f"{KEY} string").write.format("noop").mode("overwrite").save()
    replies = ledger_rows(spark, ledger, made).select(KEY, "reply")
    out = keyed.join(replies, KEY)
    return out.select(*df.columns, *[F.col(f"reply.`{f.name}`").alias(f.name) for f in fields])

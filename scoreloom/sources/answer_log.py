"""A log of answers that a streaming query feeds batch by batch: what is committed is there once, whatever is run again.

Each task of a micro-batch writes a file of JSON lines; the commit names these files in a small document of the batch,
which is moved to its place when it is whole. A batch that is run again replaces its document, so its earlier files
count no more. Readers take the lines of the files that are named, and no others."""

from __future__ import annotations

import hashlib
import json
import posixpath
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

# The planner's and the executors' Python processes get the data source's code with its class.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Lines(WriterCommitMessage):
    name: str
    rows: int


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path, self.run, self.truncate = options["path"].rstrip("/"), options.get("run", "run"), options.get("truncate", "false").lower() == "true"

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Lines:
        system, base = self._opened()
        system.create_dir(f"{base}/data", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.json", 0
        with system.open_output_stream(f"{base}/data/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write((json.dumps(row, default=str, ensure_ascii=False) + "\n").encode("utf-8", "surrogatepass"))
                rows += batch.num_rows
        return Lines(name, rows)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803  the interface's name
        from pyarrow import fs

        system, base = self._opened()
        folder = f"{base}/commits/{self.run}"
        if self.truncate and batchId == 0 and system.get_file_info(f"{base}/commits").type == fs.FileType.Directory:
            for info in system.get_file_info(fs.FileSelector(f"{base}/commits")):
                if info.base_name != self.run:
                    system.delete_dir(info.path)
        system.create_dir(folder, recursive=True)
        made, place = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{batchId:012d}.json"
        with system.open_output_stream(made) as out:
            out.write(json.dumps({"batch": batchId, "files": [m.name for m in messages if m and m.rows]}).encode())
        if system.get_file_info(place).type == fs.FileType.File:
            system.delete_file(place)
        system.move(made, place)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        system, base = self._opened()
        for message in messages:
            if message:
                system.delete_file(f"{base}/data/{message.name}")


class AnswerLog(DataSource):
    """Format "answer_log", for streams only. path: a folder on a store that Arrow opens. run: what tells the batches of
    different checkpoints apart. truncate: the first batch of a run takes the place of all other runs."""

    @classmethod
    def name(cls) -> str:
        return "answer_log"

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:  # noqa: N802  the interface's name
        return LogWriter(self.options)


def log_answers(answers: DataFrame, path: str, checkpoint: str, truncate: bool = False) -> StreamingQuery:
    """Starts the query that appends a stream of answers to the log at path until its source has no more. A query with
    the same checkpoint goes on behind its last commit."""
    answers.sparkSession.dataSource.register(AnswerLog)
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    writer = answers.writeStream.format("answer_log").option("run", run).option("truncate", truncate).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def logged_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows of a log; none where nothing is committed yet."""
    data, commits = posixpath.join(path, "data"), posixpath.join(path, "commits")
    for folder in (data, commits):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    rows = spark.read.schema(schema).json(data).withColumn("__file", F.col("_metadata.file_name"))
    named = spark.read.schema("batch long, files array<string>").option("recursiveFileLookup", True).json(commits).select(F.explode("files").alias("__file"))
    return rows.join(named, "__file", "left_semi").drop("__file")


def prompt_stream(prompts: DataFrame, folder: str, files: int, per_batch: int = 1) -> DataFrame:
    """prompts as a stream: written to folder as so many files, of which each micro-batch takes per_batch. Prompts that
    are there already are kept as they are, for a run that goes on."""
    spark = prompts.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        prompts.repartition(files).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def feed(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str, files: int = 100, per_batch: int = 1) -> None:
    """Asks prompts batch by batch and logs each batch's answers before the next is asked: folder/log has the answers,
    folder/prompts and folder/checkpoint what a second call needs to go on. ask: from prompts to answers, a step
    without shuffles such as called() or asked()."""
    stream = ask(prompt_stream(prompts, f"{folder}/prompts", files, per_batch))
    log_answers(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()

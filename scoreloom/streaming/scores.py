"""Scores of answers as they arrive: an extension, the evaluation itself is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import extract_count, inline_thinking, section_flags, supporting_ids

KEYS = ["arm", "model_name", "question_number"]


def parsed(answers: DataFrame, *more: str) -> DataFrame:
    """Stateless part of the scores, and the columns named in more; for batch and streaming DataFrames alike."""
    r = F.col("response")
    return answers.select(*KEYS, "status", extract_count(r).alias("predicted_count"), section_flags(r)["format_core_ok"].alias("format_core_ok"), supporting_ids(r).alias("cited"), inline_thinking(r).alias("inline_thinking_leak"), *more)


def keep_scores(stream: DataFrame, target: str, checkpoint: str, ts: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends each answer's parsed scores to Parquet once: a key that came before is left out, null keys too.

    The keys are the query's state, in the checkpoint, so that no batch reads the target; the file sink commits each
    batch once, whatever is run again. A target belongs to one checkpoint. ts: the column of the time of an answer;
    with it a key is kept for `late` only, as long as the same answer may arrive again, and the state stays bounded."""
    if ts:
        once = parsed(stream.withWatermark(ts, late), ts).dropDuplicatesWithinWatermark(KEYS)
    else:
        once = parsed(stream).dropDuplicates(KEYS)
    return once.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean value by event type and window, late events up to `late`; an extension too."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))

"""A sink of events as JSON lines: one folder an epoch, so that an epoch that is written again takes its own place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fields of an event, and those that must be there.
FIELDS = ("v", "ts", "reason_code", "op", "outcome", "taxon", "detail", "hint_codes")
REQUIRED = ("v", "ts", "reason_code", "op", "outcome")


def valid(events: DataFrame) -> Column:
    """Whether an event may be written: what must be there is there, the version is 1, and the outcome is fail or skip."""
    there = F.lit(True)
    for name in REQUIRED:
        there = there & F.col(name).isNotNull()
    return F.coalesce(there & (F.col("v") == 1) & F.col("outcome").isin("fail", "skip"), F.lit(False))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines: a null taxon and an empty list of hints are left out, a null detail is empty; fields that an event doesn't have are dropped."""
    hints = F.when(F.size("hint_codes") > 0, F.col("hint_codes"))
    own = events.filter(valid(events)).select(*REQUIRED, "taxon", F.coalesce("detail", F.lit("")).alias("detail"), hints.alias("hint_codes"))
    return own.select(F.to_json(F.struct(*FIELDS)).alias("value"))


def write_epoch(events: DataFrame, path: str, epoch: int) -> None:
    """Commit an epoch: its folder appears whole, as Spark's writer moves task output into place, and replaces what an earlier try has left."""
    event_lines(events).write.mode("overwrite").text(f"{path}/epoch={epoch:012d}")


def write_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of events into the sink; a batch that is run again after a failure writes the same epoch anew, so no line is there twice."""
    return events.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, path, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all epochs, with their epoch; output of a try that hasn't been committed isn't among them."""
    lines = spark.read.text(f"{path}/epoch=*")
    return lines.select(F.regexp_extract(F.input_file_name(), "epoch=([0-9]+)", 1).cast("long").alias("epoch"), "value")

"""Streams: masked lines, running event counts, the latest revision of documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievekit.functions.rules import Rule
from sievekit.operators.mask import filter_lines
from sievekit.operators.metrics import EVENT_SCHEMA


def masked_lines(lines: DataFrame, rules: list[Rule], placeholder: str = "<REDACTED>", line_col: str = "value") -> DataFrame:
    """A stream (or table) of lines with all matches masked: no state, each line on its own."""
    return filter_lines(lines, rules, placeholder, line_col)


def running_counts(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Events of a stream of JSON lines by reason; for update or complete mode."""
    event = F.from_json(line_col, EVENT_SCHEMA)
    return lines.select(event.alias("e")).filter("e.reason_code is not null").groupBy(F.col("e.reason_code").alias("reason_code")).agg(F.count("*").alias("n"))


def weekly_counts(events: DataFrame, ts_col: str = "ts", late: str = "2 days") -> DataFrame:
    """Events by seven-day window and reason; what comes later than `late` behind the newest is dropped."""
    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, "7 days"), "reason_code").agg(F.count("*").alias("n"))


def latest_revision(edits: DataFrame, key: str, revision: str) -> DataFrame:
    """Of each document the edit with the highest revision; older ones are stale."""
    value = F.struct(*[c for c in edits.columns if c != key])
    return edits.groupBy(key).agg(F.max_by(value, F.col(revision)).alias("__row")).select(key, "__row.*")


class _Newest(StatefulProcessor):
    """State of a key: its row of the highest revision."""

    def __init__(self, fields: list[str], ddl: str, revision: str) -> None:
        self.fields, self.ddl, self.revision = fields, ddl, revision

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", self.ddl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = self.fields.index(self.revision)
        known = self.now.get() if self.now.exists() else None
        best = max((tuple(r[c] for c in self.fields) for r in rows if r[self.revision] is not None), key=lambda r: r[at], default=None)
        if best is not None and (known is None or best[at] > known[at]):
            self.now.update(best)
            yield Row(**dict(zip(self.fields, best)))

    def close(self) -> None:
        pass


def newest_revisions(edits: DataFrame, key: str, revision: str) -> DataFrame:
    """A stream of edits as a stream of the rows that are their key's newest when they come, in update mode: the last one of each key is latest_revision's.

    State is one row a key; nothing that was written before is read or written again.
    """
    fields = [key, *(c for c in edits.columns if c != key)]
    own = edits.select(*fields)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.groupBy(key).transformWithState(_Newest(fields, ddl, revision), own.schema, "Update", "None")

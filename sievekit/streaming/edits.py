"""Streams of edits: texts held in state and changed by ranges, results only for revisions that have settled, and bounded caches of runs.

Each has a form over a table that gives what the stream has given when it has seen all rows; both use the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievekit.operators import ordinals

_RANGE = ("start_line", "start_char", "end_line", "end_char")
EDIT_SCHEMA = "doc string, version long, start_line int, start_char int, end_line int, end_char int, text string"
TEXT_SCHEMA = "doc string, version long, text string, waiting int, errors array<string>"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Bounds of a cache of runs.
MOST_RUNS, MOST_BYTES, TTL_SECONDS = 20, 100_000_000, 1800


# ---- Edits of texts ------------------------------------------------------------------------------


def place(text: str, line: int, units: int) -> int | None:
    """Where a line and a number of UTF-16 units in it lie in a text; None if there is no such place.  An end of line may be \\r\\n and is no place itself."""
    start = 0
    for _ in range(line):
        start = text.find("\n", start) + 1
        if not start:
            return None
    stop = text.find("\n", start)
    if stop < 0:
        stop = len(text)
    elif stop > start and text[stop - 1] == "\r":
        stop -= 1
    if text[start:stop].isascii():
        return start + units if 0 <= units <= stop - start else None
    at = start
    while units > 0 and at < stop:
        units -= 1 + (ord(text[at]) > 0xFFFF)
        at += 1
    return at if units == 0 else None


def apply_edit(text: str, edit: tuple) -> tuple[str, str | None]:
    """The text after an edit (start_line, start_char, end_line, end_char, text), and what is wrong with it; a wrong edit changes nothing.

    Without a range (all four null) the text is replaced; null counts as empty.
    """
    *bounds, fresh = edit
    fresh = fresh or ""
    if all(b is None for b in bounds):
        return fresh, None
    if any(b is None or b < 0 for b in bounds):
        return text, "incomplete range"
    start, stop = place(text, *bounds[:2]), place(text, *bounds[2:])
    if start is None or stop is None or start > stop:
        return text, "invalid range"
    return text[:start] + fresh + text[stop:], None


def _advance(text: str, version: int, pending: dict[int, tuple]) -> tuple[str, int, list[str]]:
    """Apply the pending edits that follow on without a gap, and take them out."""
    errors = []
    while version + 1 in pending:
        version += 1
        text, wrong = apply_edit(text, pending.pop(version))
        if wrong:
            errors.append(f"{version}: {wrong}")
    return text, version, errors


def _edit(row) -> tuple:
    whole = lambda v: None if v is None or v != v else int(v)
    return (*(whole(row[c]) for c in _RANGE), row["text"])


class _Texts(StatefulProcessor):
    """State of a text: itself with its version, and edits that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "text string, version long")
        self.pending = handle.getMapState("pending", "version long", "start_line int, start_char int, end_line int, end_char int, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        text, version = self.now.get() if self.now.exists() else ("", -1)
        waiting = {k[0]: tuple(v) for k, v in self.pending.iterator()}
        held, errors = set(waiting), []
        for row in rows:
            if row["version"] is None or row["version"] <= version:
                errors.append(f"{row['version']}: stale")
            else:
                mine = _edit(row)
                waiting[row["version"]] = min(waiting.get(row["version"], mine), mine, key=repr)
        text, version, wrong = _advance(text, version, waiting)
        self.now.update((text, version))
        for gone in held - set(waiting):
            self.pending.removeKey((gone,))
        for k, v in waiting.items():
            self.pending.updateValue((k,), v)
        yield Row(doc=key[0], version=version, text=text, waiting=len(waiting), errors=errors + wrong)

    def close(self) -> None:
        pass


def edited_stream(edits: DataFrame) -> DataFrame:
    """A stream of edits (EDIT_SCHEMA) as a stream of the texts that they make (TEXT_SCHEMA), in update mode.

    Versions count from 0 for each document.  An edit that comes early waits in state for the ones before it; one whose version is already past is named as stale;
    of several of one version in a batch one counts.  The session needs the settings STATE_STORE.
    """
    return edits.groupBy("doc").transformWithState(_Texts(), TEXT_SCHEMA, "Update", "None")


def edited_texts(edits: DataFrame) -> DataFrame:
    """The texts that all edits of a table make: what the stream's last row of each document says, but for stale edits, which a table doesn't have.

    A document's edits are one group, as they are of one text that one task must hold anyway.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        pending: dict[int, tuple] = {}
        for row in rows.to_dict("records"):
            if row["version"] == row["version"]:
                mine = _edit(row)
                version = int(row["version"])
                pending[version] = min(pending.get(version, mine), mine, key=repr)
        text, version, errors = _advance("", -1, pending)
        return pd.DataFrame({"doc": [rows["doc"].iloc[0]], "version": [version], "text": [text], "waiting": [len(pending)], "errors": [errors]})

    return edits.select(*[f.split()[0] for f in EDIT_SCHEMA.split(", ")]).groupBy("doc").applyInPandas(fold, TEXT_SCHEMA)


# ---- Revisions that settle -----------------------------------------------------------------------


class _Settled(StatefulProcessor):
    """State of a key: its newest revision, with a timer at the end of its quiet time."""

    def __init__(self, fields: list[str], ddl: str, revision: str, ts: str, quiet_ms: int) -> None:
        self.fields, self.ddl, self.revision, self.ts, self.quiet = fields, ddl, revision, ts, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"{self.ddl}, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.now.get() if self.now.exists() else None
        at = self.fields.index(self.revision)
        fresh = sorted((r for r in rows if r[self.revision] is not None), key=lambda r: (r[self.revision], repr(tuple(r))))
        for row in fresh:
            if known is not None and row[self.revision] <= known[at]:
                continue
            due = int(row[self.ts].timestamp() * 1000) + self.quiet
            if known is not None:
                if known[-1] < due - self.quiet:  # it had settled before this one came, within one batch
                    yield Row(**dict(zip(self.fields, known[: len(self.fields)])))
                self.handle.deleteTimer(known[-1])
            known = (*(row[c] for c in self.fields), due)
            self.handle.registerTimer(due)
        if known is not None:
            self.now.update(known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.now.exists() and (known := self.now.get())[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            yield Row(**dict(zip(self.fields, known[: len(self.fields)])))
            self.now.update((*known[:-1], 1 << 62))  # said once; the revision stays known, so that older ones count as stale

    def close(self) -> None:
        pass


def settled_stream(edits: DataFrame, key: str, revision: str, ts: str, quiet: str = "200 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Of a stream of revisions those after which no newer one came within the quiet time, each as soon as the watermark says so.

    A key has one row and one timer in state, whatever its number of revisions.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    fields = [key, *(c for c in edits.columns if c != key)]
    own = edits.select(*fields)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.withWatermark(ts, late).groupBy(key).transformWithState(_Settled(fields, ddl, revision, ts, quiet_ms), own.schema, "Append", "EventTime")


def settled(edits: DataFrame, key: str, revision: str, ts: str, quiet: str = "200 milliseconds") -> DataFrame:
    """The same of a table: revisions whose next one is more than the quiet time later, and each key's last."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(revision))
    return edits.filter(F.col(revision).isNotNull()).withColumn("__next", nxt).filter(F.col("__next").isNull() | (F.col("__next") > F.col(ts) + F.expr(f"INTERVAL {quiet}"))).drop("__next")


# ---- Caches of runs ------------------------------------------------------------------------------


class _Runs(StatefulProcessor):
    """State of an owner: the newest runs, as many as fit the bounds."""

    def __init__(self, most_runs: int, most_bytes: int, ttl: int) -> None:
        self.most_runs, self.most_bytes, self.ttl = most_runs, most_bytes, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "run string, at long, size long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        fresh = [(r["run"], round(r["at"].timestamp() * 1_000_000), r["size"]) for r in rows if r["at"] is not None and r["size"] is not None and r["size"] <= self.most_bytes]
        every = sorted({*kept, *fresh}, key=lambda r: (r[1], r[0]))
        newest, size = [], 0
        for run in reversed(every):
            size += run[2]
            if len(newest) == self.most_runs or size > self.most_bytes or every[-1][1] - run[1] > self.ttl * 1_000_000:
                break
            newest.append(run)
        self.runs.put(list(reversed(newest)))
        yield Row(owner=key[0], runs=[r[0] for r in newest], size=sum(r[2] for r in newest))

    def close(self) -> None:
        pass


def retained_stream(runs: DataFrame, most_runs: int = MOST_RUNS, most_bytes: int = MOST_BYTES, ttl: int = TTL_SECONDS) -> DataFrame:
    """A stream of runs (owner, run, at, size) as a stream of what each owner's cache holds, newest first, in update mode.

    A run over the bound in bytes is refused; else the oldest go until the number, the bytes and the age (behind the newest) fit.  State is bounded by most_runs an owner.
    """
    return runs.groupBy("owner").transformWithState(_Runs(most_runs, most_bytes, ttl), "owner string, runs array<string>, size long", "Update", "None")


def retained(runs: DataFrame, at: str, size: str, most_runs: int = MOST_RUNS, most_bytes: int = MOST_BYTES, ttl: int = TTL_SECONDS, owner: str | None = None, run: str | None = None) -> DataFrame:
    """The same of a table.  As the oldest go first, what is left is the longest run of newest rows within all bounds.

    Without an owner the whole table is one cache: its rows are numbered and summed from the newest on by ranges, so no task sees all of them.
    """
    able = runs.filter(F.col(at).isNotNull() & (F.col(size) <= most_bytes))
    order = [F.desc(at), *([F.desc(run)] if run else [])]
    if owner:
        newest = Window.partitionBy(owner).orderBy(*order)
        ranked = able.withColumn("__k", F.row_number().over(newest) - 1).withColumn("__b", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).withColumn("__last", F.max(at).over(Window.partitionBy(owner)))
    else:
        ranked = ordinals.numbered(ordinals.running_sum(able, order, size, "__b"), order, "__k")
        last = able.agg(F.max(at).alias("__last"))
        ranked = ranked.join(F.broadcast(last))  # one row
    fits = (F.col("__k") < most_runs) & (F.col("__b") + F.col(size) <= most_bytes) & (F.col("__last") - F.col(at) <= F.expr(f"INTERVAL {ttl} SECONDS"))
    return ranked.filter(fits).drop("__k", "__b", "__last")

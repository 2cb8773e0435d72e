"""Streams with state against the forms over tables, which are checked against Python."""

import datetime as dt
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from sievekit.streaming import edits as E
from sievekit.streaming import sink, streams

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def stateful(spark):
    for key, value in E.STATE_STORE.items():
        spark.conf.set(key, value)
    yield spark
    for key in E.STATE_STORE:
        spark.conf.unset(key)


def stream_of(spark, tmp_path, rows, schema, files=3):
    """Rows as a stream of some files, in their order."""
    folder = str(tmp_path / "in")
    for k in range(files):
        spark.createDataFrame(rows[k::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(stream, tmp_path, mode="update"):
    """All rows that a stream gives, with the number of their batch."""
    out = str(tmp_path / "out")

    def write(batch, number):
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("__batch", "long")).parquet(f"{out}/*").collect()


def naive(edits):
    """The text that edits (in order) make, by UTF-16 code units."""
    text, errors = "", []
    for version, edit in enumerate(edits):
        *bounds, fresh = edit
        if bounds[0] is None:
            text = fresh
            continue
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        at = []
        for line, units in (bounds[:2], bounds[2:]):
            if line >= len(starts):
                break
            own = text[starts[line] :].split("\n")[0]
            own = own[:-1] if own.endswith("\r") and starts[line] + len(own) < len(text) else own
            raw = own.encode("utf-16-le")
            if units * 2 > len(raw):
                break
            try:
                at.append(starts[line] + len(raw[: units * 2].decode("utf-16-le")))
            except UnicodeDecodeError:
                break
        if len(at) < 2 or at[0] > at[1]:
            errors.append(f"{version}: invalid range")
            continue
        text = text[: at[0]] + fresh + text[at[1] :]
    return text, errors


def random_edits(seed):
    r = random.Random(seed)
    out = [(None, None, None, None, "héllo 🙂 wörld\r\nsecond\n\nlast")]
    for _ in range(r.randrange(1, 9)):
        a, b = sorted([(r.randrange(4), r.randrange(9)), (r.randrange(4), r.randrange(9))])
        out.append((*a, *b, r.choice(["", "x", "🙂", "\n", "a\r\nb"])))
    return out


def test_places():
    assert [E.place("a🙂b\r\nc", 0, k) for k in range(6)] == [0, 1, None, 2, 3, None]
    assert E.place("a\n", 1, 0) == 2 and E.place("a\n", 2, 0) is None and E.place("", 0, 0) == 0
    assert E.apply_edit("abc", (0, 1, None, 2, "x")) == ("abc", "incomplete range") and E.apply_edit("abc", (None,) * 4 + (None,)) == ("", None)


@pytest.mark.parametrize("files", [1, 4])
def test_edits(stateful, tmp_path, files):
    rows, expected = [], {}
    for seed in range(12):
        edits = random_edits(seed)
        expected[f"d{seed}"] = naive(edits)
        rows += [(f"d{seed}", v, *e) for v, e in enumerate(edits)]
    random.Random(1).shuffle(rows)  # early edits wait for those before them
    got = run(E.edited_stream(stream_of(stateful, tmp_path, rows, E.EDIT_SCHEMA, files)), tmp_path)
    last = {}
    for r in sorted(got, key=lambda r: r["__batch"]):
        said = last.get(r["doc"], (None, []))[1]
        last[r["doc"]] = (r["text"], said + r["errors"], r["waiting"])
    batch = {r["doc"]: (r["text"], r["errors"], r["waiting"]) for r in E.edited_texts(stateful.createDataFrame(rows, E.EDIT_SCHEMA)).collect()}
    assert last == batch == {d: (text, errors, 0) for d, (text, errors) in expected.items()}


def test_gaps_and_repeats(stateful):
    rows = [("a", 0, None, None, None, None, "x"), ("a", 0, None, None, None, None, "x"), ("a", 2, None, None, None, None, "z"), ("b", 1, 0, 0, 0, 0, "y"), ("c", None, 0, 0, 0, 0, "y"), ("d", 0, 0, 0, 0, 0, None)]
    got = {r["doc"]: tuple(r)[1:] for r in E.edited_texts(stateful.createDataFrame(rows, E.EDIT_SCHEMA)).collect()}
    assert got == {"a": (0, "x", 1, []), "b": (-1, "", 1, []), "c": (-1, "", 0, []), "d": (0, "", 0, [])}
    assert E.edited_texts(stateful.createDataFrame([], E.EDIT_SCHEMA)).collect() == []


def test_stale_edits_are_named(stateful, tmp_path):
    schema = E.EDIT_SCHEMA
    folder = str(tmp_path / "in")
    for k, rows in enumerate([[("a", 0, None, None, None, None, "x")], [("a", 0, None, None, None, None, "y"), ("a", 1, 0, 1, 0, 1, "!")]]):
        stateful.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{k}")
    stream = stateful.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = sorted(run(E.edited_stream(stream), tmp_path), key=lambda r: r["__batch"])
    assert [(r["text"], r["errors"]) for r in got] == [("x", []), ("x!", ["0: stale"])]


@pytest.mark.parametrize("files", [1, 3])
def test_settled(stateful, tmp_path, files):
    r = random.Random(5)
    schema, rows, at = "uri string, revision long, ts timestamp, text string", [], T0
    for v in range(60):
        at += dt.timedelta(milliseconds=r.choice([50, 150, 250, 900]))
        rows.append((f"u{v % 3}", v, at, f"t{v}"))
    expected = []
    for u in range(3):
        own = [x for x in rows if x[0] == f"u{u}"]
        expected += [a for a, b in zip(own, own[1:] + [None]) if b is None or b[2] - a[2] > dt.timedelta(milliseconds=200)]
    table = E.settled(stateful.createDataFrame(rows, schema), "uri", "revision", "ts")
    assert sorted(tuple(x) for x in table.collect()) == sorted(expected)
    rows.append(("end", 0, at + dt.timedelta(hours=2), ""))  # lets the watermark pass all others
    size = -(-len(rows) // files)
    folder = str(tmp_path / "in")
    for k in range(files):
        stateful.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/f{k}")
    stream = stateful.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = run(E.settled_stream(stream, "uri", "revision", "ts"), tmp_path, "append")
    assert sorted(tuple(x)[:4] for x in got if x["uri"] != "end") == sorted(expected)


def brute_cache(runs, most_runs, most_bytes, ttl):
    kept = []
    for run_, at, size in sorted(runs, key=lambda r: (r[1], r[0])):
        kept = [k for k in kept if (at - k[1]).total_seconds() <= ttl]
        if size > most_bytes:
            continue
        while len(kept) >= most_runs or sum(k[2] for k in kept) + size > most_bytes:
            kept.pop(0)
        kept.append((run_, at, size))
    return [k[0] for k in reversed(kept)]


def test_retained(stateful, tmp_path):
    r = random.Random(7)
    schema = "owner string, run string, at timestamp, size long"
    rows = [(f"o{k % 4}", f"r{k:03}", T0 + dt.timedelta(seconds=40 * k), r.choice([1, 20, 60, 120])) for k in range(120)]
    bounds = dict(most_runs=6, most_bytes=100, ttl=900)
    able = [x for x in rows if x[3] <= 100]
    expected = {f"o{u}": brute_cache([x[1:] for x in able if x[0] == f"o{u}"], 6, 100, 900) for u in range(4)}
    frame = stateful.createDataFrame(rows, schema)
    got = {}
    for x in sorted(E.retained(frame, "at", "size", owner="owner", run="run", **bounds).collect(), key=lambda x: x["at"], reverse=True):
        got.setdefault(x["owner"], []).append(x["run"])
    assert got == expected
    whole = sorted(E.retained(frame.drop("owner"), "at", "size", run="run", **bounds).collect(), key=lambda x: x["at"], reverse=True)
    assert [x["run"] for x in whole] == brute_cache([x[1:] for x in able], 6, 100, 900)
    assert "SinglePartition" not in E.retained(frame, "at", "size", owner="owner")._jdf.queryExecution().toString()
    last = {}
    for x in sorted(run(E.retained_stream(stream_of(stateful, tmp_path, rows, schema), **bounds), tmp_path), key=lambda x: x["__batch"]):
        last[x["owner"]] = x["runs"]
    assert last == expected


def test_newest_revisions(stateful, tmp_path):
    rows = [(f"u{k % 5}", (k * 7) % 40, f"t{k}") for k in range(40)]
    schema = "uri string, revision long, text string"
    last = {}
    for x in sorted(run(streams.newest_revisions(stream_of(stateful, tmp_path, rows, schema), "uri", "revision"), tmp_path), key=lambda x: x["__batch"]):
        last[x["uri"]] = (x["revision"], x["text"])
    assert last == {x["uri"]: (x["revision"], x["text"]) for x in streams.latest_revision(stateful.createDataFrame(rows, schema), "uri", "revision").collect()}


EVENTS = "v int, ts string, reason_code string, op string, outcome string, taxon string, detail string, hint_codes array<string>, extra string"


def test_an_epoch_that_is_replayed_leaves_no_line_twice(stateful, tmp_path):
    rows = [(1, f"2024-01-01T00:00:{k:02}Z", "timeout", "scan", "fail", "domain.x=1" if k % 2 else None, None, ["retry"] if k % 3 else [], "dropped") for k in range(30)]
    rows += [(2, "t", "x", "o", "fail", None, "", None, ""), (1, None, "x", "o", "fail", None, "", None, ""), (1, "t", "x", "o", "done", None, "", None, ""), (None,) * 9]
    events = stream_of(stateful, tmp_path, rows, EVENTS)
    out, check = str(tmp_path / "sink"), str(tmp_path / "ck")
    sink.write_events(events, out, check).awaitTermination()
    first = sorted((r["epoch"], r["value"]) for r in sink.read_events(stateful, out).collect())
    assert len(first) == 30 and len({e for e, _ in first}) == 3
    said = [json.loads(v) for _, v in first]
    assert all(("taxon" in x) == bool(int(x["ts"][-3:-1]) % 2) and ("hint_codes" in x) == bool(int(x["ts"][-3:-1]) % 3) and x["detail"] == "" and "extra" not in x for x in said)
    for name in ("2", ".2.crc"):  # the last epoch was written, and its end wasn't noted
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    sink.write_events(events, out, check).awaitTermination()
    assert sorted((r["epoch"], r["value"]) for r in sink.read_events(stateful, out).collect()) == first
    shutil.rmtree(out)

"""The clustered layout against brute force, its tree against numpy, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import layout
from sievekit.llm.kdtree import Tree


@pytest.mark.parametrize("seed", range(4))
def test_tree(seed):
    random = np.random.default_rng(seed)
    points, weights = random.integers(0, 16, (seed * 150, 4)), random.integers(1, 5, seed * 150)
    low = random.integers(-2, 16, (100, 4))
    high = low + random.integers(-1, 9, (100, 4))
    fits = ((points[None] >= low[:, None]) & (points[None] <= high[:, None])).all(axis=2)
    tree = Tree(points, weights)
    assert (tree.count(low, high) == fits @ weights).all()
    assert sorted(zip(*(x.tolist() for x in tree.inside(low, high)))) == sorted(zip(*(x.tolist() for x in np.nonzero(fits))))


def brute(rows, per_file):
    """(doc_id, z, position, file, touched, matching, bounds) of (doc_id, text, lang, source) rows."""
    crc = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 365
    text = lambda s: (0, b"") if s is None else (1, s.encode())
    values = [(text(s), text(g), -1 if t is None else len(t.encode()), crc(i)) for i, t, g, s in rows]
    coords = [tuple(16 * sum(w[k] < v[k] for w in values) // len(values) for k in range(4)) for v in values]
    z = [int("".join(format(c, "04b")[b] for b in range(4) for c in cs), 2) for cs in coords]
    order = sorted(range(len(rows)), key=lambda r: (z[r], rows[r][0] is not None, rows[r][0] or 0))
    file = {r: p // per_file for p, r in enumerate(order)}
    held, bounds = {}, {}
    for r, f in file.items():
        held.setdefault(f, []).append(coords[r])
    for f, cs in held.items():
        bounds[f] = [(min(c[k] for c in cs), max(c[k] for c in cs)) for k in range(4)]
    out = []
    for p, r in enumerate(order):
        box = [(c - d, c + d) for c, d in zip(coords[r], (0, 0, 2, 2))]
        touched = sum(all(lo <= b and hi >= a for (lo, hi), (a, b) in zip(bounds[f], box)) for f in held)
        matching = sum(any(all(a <= x <= b for x, (a, b) in zip(c, box)) for c in held[f]) for f in held)
        out.append((rows[r][0], z[r], p, file[r], touched, matching, ",".join(f"{lo},{hi}" for lo, hi in bounds[file[r]])))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[2])


@pytest.mark.parametrize("per_file", [7, 40])
def test_against_brute_force(spark, per_file):
    random = np.random.default_rng(5)
    rows = [(int(i) * 7 - 100, None if i % 13 == 0 else "é" * int(random.integers(0, 60)), [None, "de", "en", "fr"][random.integers(0, 4)], ["", "a", "b", "ü", "hot"][min(4, random.integers(0, 9))]) for i in range(300)]
    frame = spark.createDataFrame([(i, t, g, s) for i, t, g, s in rows], "doc_id long, text string, lang string, source string").repartition(5)
    assert ordered(layout.document_layout(frame, per_file).collect()) == brute(rows, per_file)


def test_odd_rows(odd, odd_rows, none):
    rows = [r[:4] for r in odd_rows]
    got = ordered(layout.document_layout(odd, 4).collect())
    expected = brute(rows, 4)
    assert [r[1:] for r in got] == [r[1:] for r in expected]  # null ids have equal keys
    assert sorted(map(str, (r[0] for r in got))) == sorted(map(str, (r[0] for r in expected)))
    assert layout.document_layout(none).collect() == []


def test_a_cell_with_many_files_is_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(layout, "_FILES", 3)
    frame = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 150, "s").otherwise("t").alias("source"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame.collect()]
    assert ordered(layout.document_layout(frame, 4).collect()) == brute(rows, 4)


def test_nothing_that_grows_is_broadcast(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
        plan = layout.document_layout(frame, 4)._jdf.queryExecution().toString()
        assert "BroadcastExchange" not in plan and "SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

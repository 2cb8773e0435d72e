"""Whitening against numpy, and odd rows."""

import numpy as np
import pytest

from sievekit.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, d string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "taken", "taken", "taken") for i, v in rows], SCHEMA)


def brute(rows):
    """{length: (fit list, n, S, eigenvalues, eigenvectors, trace)} of usable vectors."""
    out = {}
    for d in {len(v) for _, v in rows}:
        fit = np.array(sorted({tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for _, v in rows if len(v) == d}), np.int64)
        c = fit - fit.mean(axis=0)
        values, vectors = np.linalg.eigh(c.T @ c / len(fit))
        out[d] = (len(fit), fit.sum(axis=0), values[::-1], vectors[:, ::-1])
    return out


def compare(got, rows, components=16):
    known = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert {i: len(v) for i, v in by.items()} == {i: min(components, len(v)) * sum(j == i for j, _ in rows) for i, v in rows}
    signs = {}
    for i, v in rows:
        n, total, values, vectors = known[len(v)]
        x = np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000
        deviation = sum(int(n * a - s) ** 2 for a, s in zip(x.tolist(), total.tolist()))
        for r in by[i]:
            k = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            w = (x - total / n) @ vectors[:, k] / np.sqrt(values[k])
            assert abs(r["whitened"]) == pytest.approx(abs(w), abs=1e-6)
            if abs(w) > 1e-3:
                assert signs.setdefault((len(v), k), np.sign(w) * np.sign(r["whitened"])) == np.sign(w) * np.sign(r["whitened"])


def test_against_numpy(spark):
    random = np.random.default_rng(1)
    mix = random.standard_normal((20, 20))
    rows = [(i, [float(np.float32(c)) for c in random.standard_normal(20) @ mix]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a third of the rows are one vector
    compare(whitening.whiten(frame(spark, rows).repartition(3)).collect(), rows)


def test_triangle_in_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "EXPRESSIONS", 7)
    random = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in random.standard_normal(5) * [1, 2, 3, 4, 5]]) for i in range(60)]
    compare(whitening.whiten(frame(spark, rows), 3).collect(), rows, 3)


def test_lengths_are_whitened_apart(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in random.standard_normal(3 + i % 2) * [1, 2, 3, 4][: 3 + i % 2]]) for i in range(80)]
    compare(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == sorted((str(i), c, 1, 0, None, None, None) for i in (None, 7, 7) for c in (1, 2))
    assert whitening.whiten(frame(spark, rows).limit(0)).collect() == []
    flat = [(i, [float(i), 5.0]) for i in range(4)]  # the second dimension doesn't vary
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, flat)).collect()}
    assert all(got[i, 2]["whitened"] is None for i in range(4)) and got[0, 1]["explained"] == pytest.approx(1) and got[0, 1]["identity_error"] < 1e-12


def test_long_vectors_and_large_components(spark):
    random = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in random.standard_normal(120)]) for i in range(150)]
    got = whitening.whiten(frame(spark, rows), 2).collect()
    assert len(got) == 300 and all(r["identity_error"] < 1e-9 for r in got)
    with pytest.raises(Exception, match="64 bits|too large"):
        whitening.whiten(frame(spark, [(1, [1e15, 1.0]), (2, [0.0, 1.0])])).collect()

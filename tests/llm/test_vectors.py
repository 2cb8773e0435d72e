"""Operators on vectors against brute force, and on odd rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievekit.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block string, rep string"


def table(spark, n=400, d=16, seed=1):
    random = np.random.default_rng(seed)
    base = random.standard_normal((40, d))
    rows = []
    for i in range(n):
        x = base[i % 40] * (1 + i % 3) + random.standard_normal(d) * random.choice([0.0, 0.05, 0.3, 1.0])
        rows.append((i, [float(np.float32(a)) for a in x], i % 3, "taken", "taken", "taken"))
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * d, 0), (n + 3, [nan] * d, 0), (n + 4, [inf] + [1.0] * (d - 1), 0), (n + 5, [None] + [1.0] * (d - 1), 0), (n + 6, rows[0][1], None), (None, rows[0][1], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [2.0, 4.0], 0)]
    return spark.createDataFrame([(*r, "taken", "taken", "taken")[:6] for r in rows], SCHEMA), rows


def usable(v):
    return v and all(x is not None and np.isfinite(x) for x in v)


def test_links_match_brute_force(spark):
    frame, rows = table(spark)
    out = {r["vec_id"]: r for r in embed_dedup.link_vectors(frame, block=64).collect()}
    ids = [r[0] for r in rows if r[0] is not None]
    links, parent = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(r[0], np.array(r[1]), r[2]) for r in rows if r[0] is not None and usable(r[1]) and any(r[1]) and r[2] is not None]
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[i + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert {i: out[i]["n_links"] for i in ids} == links
    assert {i: out[i]["component_id"] for i in ids} == {i: find(i) for i in ids}
    assert len(out) == len(rows) and all(out[i]["kept"] == (find(i) == i) for i in ids)


def test_estimates_are_unbiased_and_bounded():
    """Over many rotations the mean estimate is the inner product, and few fall short by more than their deviations say."""
    random = np.random.default_rng(3)
    x = random.standard_normal((1, 32))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    other = random.standard_normal((1, 32))
    other -= (other @ x.T) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * other / np.sqrt((other * other).sum())
    got, short, bits = [], 0, 0
    for seed in range(600):
        turn = embed_dedup.rotation(32, seed)
        a, b = embed_dedup.Codes(x, turn), embed_dedup.Codes(y, turn)
        value = embed_dedup.estimate(a.turned @ b.signs(b.packed, 32).T, b.factor)[0, 0]
        got.append(value)
        short += value < 0.93 - embed_dedup.slack(b.factor, 32, 0.93, 2.0)[0]
        bits += int(np.bitwise_count(a.packed ^ b.packed).sum()) > embed_dedup.most_differing(32, 0.93, 2.0)
    assert abs(np.mean(got) - 0.93) < 0.01
    assert short < 0.06 * 600 and bits < 0.06 * 600


def test_bounds_prune_and_lose_no_link():
    """In 64 dimensions few pairs are computed exactly, and all links at the threshold and above are among them."""
    random = np.random.default_rng(8)
    base = random.standard_normal((300, 64))
    near = base + random.standard_normal((300, 64)) * random.uniform(0.1, 0.6, (300, 1))
    vectors = np.concatenate([base, near, random.standard_normal((1400, 64))])
    norm = np.sqrt((vectors**2).sum(axis=1))
    codes = embed_dedup.Codes(vectors / norm[:, None], embed_dedup.rotation(64))
    side = {"rep": np.arange(2000), "copies": np.ones(2000, np.int64), "vectors": vectors, "codes": codes.packed, "factor": codes.factor, "norm": norm, "units": vectors / norm[:, None]}
    seen: list = []
    links, _, _ = embed_dedup._compare(side, side, True, 0.93, seen)
    cosine = (vectors @ vectors.T) / norm[:, None] / norm[None, :]
    np.fill_diagonal(cosine, 0)
    assert links.tolist() == (cosine >= 0.93).sum(axis=1).tolist() and links.sum() > 100
    pairs, near_in_bits, computed = (sum(s[k] for s in seen) for k in range(3))
    assert pairs == 2000 * 1999 // 2 and near_in_bits < 0.05 * pairs and computed < 2 * links.sum()


def test_double_vectors_stay_double(spark):
    """Cosines that differ only beyond single precision, and components whose squares leave the range."""
    angle = np.arccos(0.93)
    rows = [(1, [1.0, 0.0], 0), (2, [np.cos(angle - 1e-12), np.sin(angle - 1e-12)], 0), (3, [np.cos(angle + 1e-12), -np.sin(angle + 1e-12)], 0), (4, [1e200, 1e200], 1), (5, [2e-200, 2e-200], 1)]
    frame = spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.link_vectors(frame).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_top_products_match_brute_force(spark):
    frame, rows = table(spark)
    out = topk.top_products(frame, F.col("vec_id") % 50 == 0).toPandas()
    good = [(r[0], np.floor(256 * np.array(r[1], np.float64)).astype(np.int64)) for r in rows if r[0] is not None and usable(r[1])]
    expected = []
    for a, x in good:
        if a % 50 == 0:
            scored = sorted((-int(x @ y), b) for b, y in good if b != a and len(x) == len(y))[:5]
            expected += [(a, k + 1, b, -s) for k, (s, b) in enumerate(scored)]
    assert sorted(map(tuple, out[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(expected)


def test_search_prunes_without_loss():
    """Long lengths, ties and equal vectors, against all products."""
    random = np.random.default_rng(5)
    vectors = np.floor(random.standard_normal((3000, 8)) * random.lognormal(3, 1.5, (3000, 1)))
    vectors[100:200] = vectors[100]
    ids = random.permutation(3000)
    best = topk.search(ids[:60], vectors[:60], ids, vectors, 5)
    for q in range(60):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:5]
        assert best.id[q].tolist() == ids[order].tolist() and best.score[q].tolist() == score[order].tolist()


@pytest.mark.parametrize("kind", ["length", "direction"])
def test_thresholds_prune(kind):
    """Over several groups a threshold that passes on leaves a small share of all products, by length or by coordinate."""
    random = np.random.default_rng(6)
    if kind == "length":
        vectors = np.floor(random.standard_normal((8000, 16)) * random.lognormal(3, 1.5, (8000, 1)))
    else:  # a few tight bundles of directions, each around an axis
        vectors = np.floor(3000 * (np.eye(64)[random.integers(0, 64, 8000)] + 0.02 * random.standard_normal((8000, 64))))
    order = np.argsort(-(vectors**2).sum(axis=1), kind="stable")
    ids, vectors = np.arange(8000)[order], vectors[order]
    floors, seen, best = np.full(100, -np.inf), [], topk.Best(100, 5)
    for lo in range(0, 8000, 1000):
        got = topk.search(ids[:8000:80], vectors[:8000:80], ids[lo : lo + 1000], vectors[lo : lo + 1000], 5, floors, seen)
        i, j = np.nonzero(np.isfinite(got.score))
        if len(i):
            best.add(i, got.id[i, j], got.score[i, j])
        floors = best.score[:, -1]
    for q in range(100):
        score = vectors @ vectors[80 * q]
        expected = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[80 * q]][:5]
        assert best.id[q].tolist() == ids[expected].tolist()
    by_length, by_side = (sum(s[k] for s in seen) for k in (0, 1))
    assert by_length + by_side < 0.5 * 8000 * 100
    assert by_side > 0 if kind == "direction" else by_length > 0


def test_groups_and_repeated_queries(spark):
    """Many groups and packs against all products; a query row that stands twice asks twice."""
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in random.standard_normal(6) * random.lognormal(0, 1)]) for i in range(600)]
    rows += [rows[50], rows[7], (None, rows[0][1]), (100, [float(x) for x in random.standard_normal(6)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_products(frame, F.col("vec_id") % 50 == 0, candidates=64, queries=4)
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None]
    expected = []
    for a, x in good:
        if a % 50 == 0:
            scored = sorted((-int(x @ y), b) for b, y in good if b != a)[:5]
            expected += [(a, k + 1, b, -s) for k, (s, b) in enumerate(scored)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embed_dedup.link_vectors(none).count() == 0 and topk.top_products(none, F.lit(True)).count() == 0


def test_wide_scores_are_exact(spark):
    rows = spark.createDataFrame([(0, [1e15, 1.0]), (1, [3e14, 7.0]), (2, [3e14, 5.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_products(rows, F.col("vec_id") == 0, scale=1).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)] and pd.notna(got[0][3])

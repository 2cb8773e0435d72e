"""Traces against a breadth-first search, and the SQL surface on odd texts."""

import random

import pytest

from sievekit.functions import rules as R
from sievekit.operators import detect, graph, surface


def brute(edges, targets, members):
    """{target: path from the nearest, smallest member down}, through the smallest node of each step."""
    parents = {}
    for p, c in edges:
        if p is not None and c is not None:
            parents.setdefault(c, set()).add(p)
    out = {}
    for target in targets:
        level, through = {target}, {target: None}
        while level:
            if hits := level & members:
                path, at = [], min(hits)
                while at is not None:
                    path.append(at)
                    at = through[at]
                out[target] = path
                break
            fresh = {}
            for node in sorted(level):
                for p in parents.get(node, ()):
                    if p not in through:
                        fresh.setdefault(p, node)
            through.update(fresh)
            level = set(fresh)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_traces(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)] + [(None, "n1"), ("n1", None), ("n2", "n2"), ("n3", "n4"), ("n3", "n4")]
    targets, members = [f"n{k}" for k in range(0, 60, 4)] + ["alone"], {"n7", "n8", "n30", "n59"}
    got = graph.traces(spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([(t,) for t in targets + ["n0", None]], "node string"), spark.createDataFrame([(m,) for m in members], "node string")).collect()
    assert {x["target"]: x["path"] for x in got} == brute(edges, targets, members) and len(got) == len({x["target"] for x in got})
    assert all(x["depth"] == len(x["path"]) - 1 and x["member"] == x["path"][0] for x in got)


def test_no_edges_and_no_targets(spark):
    none = spark.createDataFrame([], "parent string, child string")
    some = spark.createDataFrame([("a",)], "node string")
    assert [tuple(r) for r in graph.traces(none, some, some).collect()] == [("a", "a", 0, ["a"])]
    assert graph.traces(none, some.limit(0), some).collect() == [] and graph.traces(none, some, some.limit(0)).collect() == []


def test_table_function(spark):
    rules = [*R.builtin("pii"), *R.builtin("creds")]
    rows = [(1, "a@b.org test\nmail c@d.org 🙂 e@f.org production"), (2, None), (3, ""), (3, "x\r\nマイナンバー １２３４－５６７８－９０１２"), (None, "10.0.0.1")]
    docs = spark.createDataFrame(rows, "id long, text string")
    surface.register(spark, rules, "scan_rows")
    columns = ["id", *(c.split()[0] for c in surface.COLUMNS.split(", "))]
    got = spark.sql("SELECT id, f.* FROM {docs}, LATERAL scan_rows(text) AS f", docs=docs).select(*columns).collect()
    expected = detect.scan_texts(docs, rules).select(*columns).collect()
    assert len(got) == 6 and sorted(map(repr, got)) == sorted(map(repr, expected))


def test_table_function_reads_batches(spark):
    """Python gets texts by Arrow batches, once each, and not one a call."""
    surface.register(spark, R.builtin("creds"), "scan_batches")
    docs = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS text")
    plan = spark.sql("SELECT id, f.* FROM {docs}, LATERAL scan_batches(text) AS f", docs=docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "UDTF" not in plan
    assert spark.sql("SELECT f.* FROM {docs}, LATERAL scan_batches(text) AS f", docs=docs).count() == 0

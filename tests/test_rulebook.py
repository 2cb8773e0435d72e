"""Rules as tables, retries and paths, on rows with nulls, repeats and gaps."""

from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.operators import deps, mask, rulebook
from sievekit.sources import readers

SCHEMA = "id string, pattern string, severity string, score int, category string, variant string, enabled boolean"
ROWS = [
    ("a", "x+", "High", 70, "c1", "v1", True), ("b", "(x+)+", "Low", 10, "c1", None, False), ("c", "y", "Critical", 90, None, "v2", None),
    ("d", "z", "odd", 50, "c2", "v1", True), ("e", "w", None, None, "c2", "v2", True),
]


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_lists_and_filters(spark):
    rules = spark.createDataFrame(ROWS, SCHEMA)
    assert ids(rulebook.listed(rules, "High")) == ["a", "c"] and ids(rulebook.listed(rules)) == ["a", "b", "c"]
    assert ids(rulebook.enabled(rules)) == ["a", "d", "e"]
    assert ids(rulebook.chosen(rules)) == ["a", "b", "c", "d", "e"]
    assert ids(rulebook.chosen(rules, categories=["c1"], variants=["v1"])) == ["a"]
    assert ids(rulebook.chosen(rules, severities=["High", "Low"], scores=(10, 69))) == ["b"]
    assert ids(rules.filter(rulebook.risky(F.col("pattern")))) == ["b"] == [r[0] for r in ROWS if R.risky(r[1])]
    assert ids(rulebook.repeated(rules.union(rules.filter("id in ('a', 'd')")))) == ["a", "d"]
    asked = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "id string")
    assert sorted(((r["id"], r["known"]) for r in rulebook.explained(rules, asked).collect()), key=str) == [("a", True), ("zz", False), (None, False)]
    assert sorted(map(str, (r["id"] for r in rulebook.missing(asked, rules).collect()))) == ["None", "zz"]


def test_counts_keep_nulls_of_the_table(spark):
    got = {(r["facet"], r["value"]): r["n"] for r in rulebook.counts(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {
        ("category", "c1"): 2, ("category", "c2"): 2, ("category", None): 1, ("variant", "v1"): 2, ("variant", "v2"): 2, ("variant", None): 1,
        ("severity", "High"): 1, ("severity", "Low"): 1, ("severity", "Critical"): 1, ("severity", "odd"): 1, ("severity", None): 1,
    }
    assert rulebook.counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overrides_agree_with_those_of_packs(spark):
    pack = [r for r in R.builtin("pii") if r.id in ("pii.net.email", "pii.net.ipv4", "pii.device.mac")]
    config = {"pii.net.email": {"severity": "critical"}, "pii.net.ipv4": {"severity": "unheard", "score": 7}, "pii.device.mac": {"pattern": "m+"}, "own.rule": {"pattern": "x+", "category": "mine"}, "nobody": {"score": 3}}
    said = spark.createDataFrame([(i, c.get("pattern"), c.get("severity"), c.get("score"), c.get("category")) for i, c in config.items()], "id string, pattern string, severity string, score int, category string")
    got = {tuple(r) for r in rulebook.overridden(R.to_frame(spark, pack), said).collect()}
    assert got == {(r.id, r.pattern, r.severity, r.score, r.category) for r in R.override(pack, config=config)}


def test_severities_with_short_names(spark):
    words = [("CRIT",), (" med",), ("low",), ("odd",), (None,), ("",)]
    got = spark.createDataFrame(words, "w string").select(rulebook.severity(F.col("w")).alias("a"), rulebook.severity(F.col("w"), aliases=False).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Critical", None), ("Medium", None), ("Low", "Low"), (None, None), (None, None), (None, None)]


def test_retries_begin_anew_after_a_success(spark):
    calls = spark.createDataFrame([("k", i, bad) for i, bad in enumerate([True, True, False, True, True, True, True, True])] + [("l", 0, True)], "key string, at int, bad boolean")
    got = sorted((r["key"], r["at"], r["attempt"], r["delay_ms"]) for r in deps.retry_delays(calls, "key", ["at"], F.col("bad")).collect())
    assert got == [("k", 0, 1, 200), ("k", 1, 2, 400), ("k", 3, 1, 200), ("k", 4, 2, 400), ("k", 5, 3, 800), ("k", 6, 4, 1600), ("k", 7, 5, 2000), ("l", 0, 1, 200)]


def test_winner_of_equal_spans_is_fixed(spark):
    rows = spark.createDataFrame([(1, 0, 3, 5, "a"), (1, 0, 3, 5, "b"), (1, 3, 6, 5, "z")], "id int, start int, stop int, priority int, placeholder string")
    assert [tuple(r) for r in mask.winners(rows, ["id"]).select("start", "stop", "placeholder").collect()] == [(0, 6, "b")]


def test_paths_that_leave_the_root(spark):
    rows = [("a/b", False), ("../b", True), ("/a", True), ("a/..", True), ("a..b/c..", False), ("", False)]
    got = spark.createDataFrame(rows, "p string, want boolean").select(readers.unsafe(F.col("p")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)

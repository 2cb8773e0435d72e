"""Accounts, configurations, evidence, lockfiles, advisories, and detection on texts and lines of any length."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sievekit.functions import config
from sievekit.functions import rules as R
from sievekit.operators import deps, detect, evidence, mask, report, scan
from sievekit.sources import lockfiles, readers

EMAIL = [r for r in R.builtin() if r.id == "pii.net.email"]


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "path long, text string")


def test_many_short_lines(spark):
    """A text of 160,000 lines: each row has its own few lines, not the text."""
    text = "\n".join(f"line {i}" if i % 1000 else f"mail a{i}@example.com" for i in range(160_000))
    began = time.time()
    got = detect.scan_texts(texts(spark, text), EMAIL).agg(F.count("*").alias("n"), F.max(F.size("context_before")).alias("most")).first()
    assert got["n"] == 160 and got["most"] <= 5 and time.time() - began < 60


def test_context_of_wanted_lines(spark):
    rows = texts(spark, "a\nb\nc\nx@y.org\nd\nz@y.org", "x@y.org\nb")
    got = {(r["path"], r["line_number"]): r["context_before"] for r in detect.numbered_lines(rows, context=2, keep=detect.wanted(EMAIL)).collect()}
    assert got == {(0, 4): ["b", "c"], (0, 6): ["x@y.org", "d"], (1, 1): []}


def test_many_matches_of_a_line(spark):
    """Places of thousands of matches are running sums."""
    line = " ".join(f"a{i}@example.com" for i in range(5000))
    began = time.time()
    row = texts(spark, line).select(detect.matches(F.col("text"), EMAIL).alias("m")).first()
    assert len(row["m"]) == 5000 and all(line[m["start"] : m["stop"]] == m["hit"] for m in row["m"]) and time.time() - began < 20


def test_wide_characters_are_wanted(spark):
    rules = [r for r in R.builtin() if r.id.startswith("pii.jp.")]
    rows = texts(spark, "個人番号：１２３４－５６７８－９０１２", "none", "1234-5678-9012", None)
    plain = {(r["path"], r["rule_id"]) for r in detect.findings(detect.numbered_lines(rows), rules).collect()}
    assert plain and plain == {(r["path"], r["rule_id"]) for r in detect.scan_texts(rows, rules).collect()}


def test_whole_pack_masks_whole_texts(spark):
    """Rules with functions too, inside the row: a card that fails its check stays."""
    good, bad = "4539" + "1488" + "0343" + "6467", "4539" + "1488" + "0343" + "6468"
    out = {r["path"]: r["text"] for r in mask.mask_text(texts(spark, f"card {good}\nmail a@b.org", f"card {bad}", None, ""), list(R.builtin())).collect()}
    assert good not in out[0] and "a@b.org" not in out[0] and out[0].count("\n") == 1
    assert bad in out[1] and out[2] is None and out[3] == ""


def test_diff_lines_trim_all_white_space(spark):
    rows = spark.createDataFrame([("a \t\r",), ("\t",), ("\u3000",), ("b\u3000",), ("c",)], "line string")
    assert sorted(r["line"] for r in readers.diff_lines(rows).collect()) == ["a", "b", "c"]


def test_configurations():
    low = {"core": {"ignore": ["x"], "max_file_size": 5}, "rules": {"a": {"enabled": False, "base_score": 3}, "b": {"pattern": "b", "score": 1}}}
    high = {"core": {"ignore": ["y"], "max_file_size": None}, "rules": {"a": {"base_score": 9}, "b": {"pattern": "c"}}}
    assert config.merged(low, high) == {"core": {"ignore": ["x", "y"], "max_file_size": 5}, "rules": {"a": {"enabled": False, "base_score": 9}, "b": {"pattern": "c"}}}
    wrong = {"output": {"mask_mode": "plain", "max_findings": 0}, "core": {"max_file_size": 1 << 30, "max_file_count": 7}, "rules": {"a": {"pattern": "("}, "b": {"pattern": ""}, "c": {"pattern": "x" * 1025}, "d": {"severity": "odd"}}}
    assert [p.split(":")[0] for p in config.problems(wrong)] == ["output.mask_mode", "core.max_file_size", "output.max_findings", "a", "b", "c", "d"]
    assert config.problems({"rules": {"a": {"pattern": "x", "severity": "HIGH"}}}) == []


def test_shared_limit(spark):
    rows = [spark.createDataFrame([(f"{k}{i}", i) for i in range(n)], "path string, line_number long") for k, n in (("a", 3), ("b", 4), ("c", 2))]
    got = scan.shared_limit(scan.together(rows), 5).groupBy("source").agg(F.collect_set("path").alias("p")).collect()
    assert {r["source"]: sorted(r["p"]) for r in got} == {0: ["a0", "a1", "a2"], 1: ["b0", "b1"]}


def test_files_within_a_limit(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    got = readers.files(spark, str(tmp_path), limit=3)
    assert sorted(r["text"] for r in got.collect()) == ["text 0", "text 1", "text 2"]
    counts = scan.file_counts(got, limit=3).first()
    assert (counts["total_files"], counts["scanned_files"], counts["file_limit_reached"]) == (3, 3, True)


def test_json_report_is_one_document(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "r", "High", 80, "x", "new"), ("a", 2, "r", "Low", 5, 'y"', "new"), ("a", 1, "r", "Low", 5, "z", "suppressed")], "path string, line_number long, rule_id string, severity string, score int, masked_snippet string, baseline_status string")
    summary = spark.createDataFrame([(3, 2)], "total long, new long")
    report.write_json(rows, summary, str(tmp_path / "r"))
    parts = [p for folder in sorted((tmp_path / "r").iterdir()) for p in sorted(folder.glob("part-*"))]
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole["summary"] == {"total": 3, "new": 2} and [f["path"] for f in whole["findings"] if f] == ["a", "b"]


@pytest.mark.parametrize(("text", "bad"), [("see ../x", True), ("a../x", False), ("http://h/home/x", False), (" /home/x", True), ("'C:\\x", True), ("file:///x", True), ("the file:// protocol", False), ("file:/", True), ("profile:/x", False), ("\x00 /home/x", False), ("", False)])
def test_evidence_text(spark, text, bad):
    assert spark.createDataFrame([(text,)], "t string").select(evidence.forbidden(F.col("t"))).first()[0] is bad


def test_schema_problems(spark):
    rows = spark.createDataFrame([(1, '{"n":1,"s":"x","o":null}'), (2, '{"n":1.5,"s":null}'), (3, "[]"), (4, "broken"), (5, '{"z":1}'), (6, None)], "i int, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", evidence.schema_problems(F.col("t"), {"n": "count", "s": "string"}, {"o": "object"}).alias("p")).collect()}
    assert got == {1: [], 2: ["bad n", "bad s"], 3: ["no object"], 4: ["no object"], 5: ["missing n", "missing s", "unknown z"], 6: ["no object"]}


def test_lockfiles_as_tables(spark):
    rows = spark.createDataFrame([("x/Cargo.lock", '[[package]]\nname = "a"\nversion = "1.0.0"\n'), ("x/other.txt", "?"), ("y/yarn.lock", None)], "path string, content string")
    assert [tuple(r) for r in lockfiles.packages(rows).collect()] == [("Rust", "a", "1.0.0", "x/Cargo.lock")]


def test_version_order(spark):
    names = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1-a", "1.0.1"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "v string")
    assert [r["v"] for r in rows.orderBy(deps.version_parts(F.col("v"))).collect()] == names

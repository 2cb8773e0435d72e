"""Presets, offered edits, advisory records, pages and evidence packs, on rows with nulls, gaps and damage."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from sievekit.functions import presets
from sievekit.functions import rules as R
from sievekit.functions import scalars as S
from sievekit.operators import actions, advisories, detect, findings, mask, metrics, report
from sievekit.sources import packs, readers, writers


def test_presets_are_sound_and_lie_below_configurations():
    assert sorted(presets.builtin()) == ["fintech-jp", "gov-jp", "logs-jp", "si-vendor-jp", "standard-jp"]
    assert not any(presets.problems(p) for p in presets.builtin().values())
    assert presets.problems({}) == ["no rules"] and presets.problems({"a": {"x": 1}}) == ["a: unknown x", "a: says nothing"]
    rules = [*R.builtin("pii"), *R.builtin("creds")]
    for name in presets.builtin():
        pack = list(R.builtin("log")) if name == "logs-jp" else rules
        by_id = {r.id: r for r in presets.applied(pack, name)}
        assert len(by_id) == len(pack) and all(by_id[i].base == said["base_score"] and by_id[i].enabled for i, said in presets.builtin()[name].items())
    over = {r.id: r for r in presets.applied(rules, "gov-jp", {"pii.person.name.keyword": {"base_score": 3}, "pii.jp.mynumber.keyword": {"enabled": False}})}
    assert over["pii.person.name.keyword"].base == 3 and over["pii.jp.mynumber.keyword"].base == 92 and not over["pii.jp.mynumber.keyword"].enabled


def test_presets_that_can_not_be():
    with pytest.raises(R.RuleError, match="no preset"):
        presets.applied(list(R.builtin("pii")), "minimal")
    with pytest.raises(R.RuleError, match="needs the rules log"):
        presets.applied(list(R.builtin("pii")), "logs-jp")


@pytest.mark.parametrize(
    ("files", "preset"),
    [
        ([("logs/a", "x")], "logs-jp"), ([("a.ndjson", None), ("kyc/a", None)], "logs-jp"), ([("src/a.log", None), ("logs", None)], None), ([(".log", None)], None),
        ([("kyc/a", None), ("README.md", "かな")], "fintech-jp"), ([("src/kyc/a", None)], None), ([("README.md", "ｶﾅ")], "standard-jp"),
        ([("README.md", "漢字 only")], None), ([("doc/README.md", "かな")], None), ([("README.md", None), (None, "かな")], None),
    ],
)
def test_preset_of_a_listing(spark, files, preset):
    table = spark.createDataFrame([("r", p, t) for p, t in files], "root string, path string, text string")
    assert [tuple(r) for r in presets.inferred(table).collect()] == [("r", preset)]


def test_no_files_no_roots(spark):
    assert presets.inferred(spark.createDataFrame([], "root string, path string, text string")).count() == 0


def test_offered_edits(spark):
    text = "😀 mail ann@example.org now"
    rows = [("a/x.py", text), ("b.json", text), ("c.html", text), ("d.rs", "mail ann@example.org # sieve:ignore=other"), (".py", text)]
    found = detect.scan_texts(spark.createDataFrame(rows, "path string, text string"), [r for r in R.builtin("pii") if r.id == "pii.net.email"])
    got = sorted((r["path"], r["title"], r["line"], r["start"], r["end"], r["new_text"], r["preferred"]) for r in actions.code_actions(found).collect())
    mask = lambda p, at=8: [(p, "Mask value", 0, at, at + 15, "<REDACTED>", True), (p, "Partial mask", 0, at, at + 15, "****.org", False)]
    ignore = lambda p, t: [(p, "Add inline ignore", 0, 27, 27, t, False)]
    want = mask(".py") + mask("b.json") + mask("d.rs", 5) + mask("a/x.py") + mask("c.html") + ignore("a/x.py", " # sieve:ignore=pii.net.email") + ignore("c.html", " <!-- sieve:ignore=pii.net.email -->")
    assert got == sorted(want)


def test_a_language_counts_before_the_ending(spark):
    rows = spark.createDataFrame([("x.py", "sql"), ("x.py", "odd"), ("x.json", "jsonc"), ("x", "yaml"), ("X.cc", None)], "path string, language string")
    assert [r[0] for r in rows.select(actions.comment(F.col("path"), F.col("language"))).collect()] == ["--", "#", None, "#", "//"]


def test_advice_from_records(spark):
    def record(*fixed, **more):
        return json.dumps({"affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": f}]}]} for f in fixed], **more})

    rows = [
        (1, "1.2.0", record("1.10.0", "1.3.0", "1.1.0"), "Upgrade to >= 1.3.0"), (2, "1.2.0", record("1.1.0", "soon", "2"), advisories.NO_FIX), (3, "main", record("3.0.0", "2.0.0"), "Upgrade to >= 2.0.0"),
        (4, "1.0.0", record("1.0.0", "1.0.1-rc.2", "1.0.1-rc.10"), "Upgrade to >= 1.0.1-rc.2"), (5, "1.0.0-rc.1", record("1.0.0"), "Upgrade to >= 1.0.0"), (6, "1.0.0", "{broken", advisories.NO_FIX), (7, "1.0.0", None, advisories.NO_FIX),
        (8, None, record("1.0.0"), "Upgrade to >= 1.0.0"), (9, "1.0.0", '{"affected":[{"ranges":null},{"ranges":[{"events":[{}]}]},null]}', advisories.NO_FIX),
    ]
    got = {r["id"]: r for r in advisories.described(spark.createDataFrame([r[:3] for r in rows], "id int, version string, details string")).collect()}
    assert {k: r["advice"] for k, r in got.items()} == {r[0]: r[3] for r in rows}
    assert {(r["severity"], r["cvss"], tuple(r["urls"])) for r in got.values()} == {("Unknown", None, ())}
    more = record("1.0.0", database_specific={"severity": "moderate"}, severity=[{"type": "CVSS_V3", "score": "9.1"}], references=[{"url": u} for u in "dbacb"] + [{"type": "WEB"}])
    one = advisories.described(spark.createDataFrame([("0.1.0", more)], "version string, details string")).first()
    assert (one["severity"], one["cvss"], one["urls"]) == ("Medium", "9.1", ["a", "b", "c"])


FINDING = "path string, line_number int, rule_id string, severity string, score int, masked_snippet string, baseline_status string"


def read(folder):
    return "".join(open(os.path.join(folder, part, f)).read() for part in sorted(os.listdir(folder)) for f in sorted(os.listdir(os.path.join(folder, part))) if f.endswith(".txt"))


def test_pages_are_whole_and_in_order(spark, tmp_path):
    rows = [(f"f{k % 7}", k, "r<1>" if k % 3 else "r2", "High", 20 * (k % 6), "a|<b>", "new" if k % 2 else "suppressed") for k in range(60)]
    found = spark.createDataFrame(rows, FINDING)
    report.write_page(found, str(tmp_path / "h"))
    page = read(tmp_path / "h")
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</body></html>") and page.count("<tr><td>") == 60 and "<b>" not in page
    assert "<p>60 findings: CRITICAL: 10 / HIGH: 10 / MEDIUM: 20 / LOW: 20</p><ul><li>r&lt;1&gt; (40)</li><li>r2 (20)</li></ul>" in page
    at = [line.split("</td><td>")[3] for line in page.splitlines() if line.startswith("<tr><td>")]
    assert at == sorted(at)
    report.write_page(found, str(tmp_path / "m"), "markdown")
    page = read(tmp_path / "m")
    assert "**Findings**: 60 total, 30 new\n\n- r<1> (40)\n- r2 (20)\n\n## Findings" in page and page.count("a\\|<b>") == 60
    assert [tuple(r) for r in report.markdown_page(found).groupBy("section").count().orderBy("section").collect()] == [(0, 1), (1, 60), (2, 1)]


def test_pages_without_findings(spark):
    nothing = spark.createDataFrame([], FINDING)
    assert report.markdown_head(nothing).first()[0].endswith("**Findings**: 0 total, 0 new\n\nNo sensitive data found.")
    assert [r["section"] for r in report.html_page(nothing).orderBy("section").collect()] == [0, 2] and "0 findings: CRITICAL: 0" in report.html_head(nothing).first()[0]


def problems(spark, folder):
    return sorted((str(r["path"]).split("/")[0], r["problem"]) for r in packs.verify(spark, folder).collect())


def test_packs_and_damage(spark, tmp_path):
    folder = str(tmp_path / "pack")
    assert problems(spark, folder) == [("None", "unfinished")]
    rows = spark.range(50, numPartitions=4).select(F.concat(F.lit("line "), F.col("id")).alias("text"))
    packs.write(folder, {"findings": rows, "meta": rows.limit(1), "none": rows.limit(0)})
    assert problems(spark, folder) == []
    assert sorted((r["part"], r["n"]) for r in packs.lines(spark, folder).collect()) == [("findings", 50), ("meta", 1)]
    files = sorted(p for p in (tmp_path / "pack/parts/findings").iterdir() if p.name.startswith("part-"))
    for sums in (tmp_path / "pack").rglob(".*.crc"):  # a pack that came from elsewhere has none
        sums.unlink()
    files[0].write_text("line 0 #token=x\n")
    files[1].write_text("see /home/ann\n")
    files[2].unlink()
    (tmp_path / "pack/parts/more").mkdir()
    (tmp_path / "pack/parts/more/x.txt").write_text("x\n")
    assert problems(spark, folder) == [("findings", "changed"), ("findings", "changed"), ("findings", "forbidden place"), ("findings", "leak"), ("findings", "missing"), ("more", "extra")]
    (tmp_path / "pack/manifest").rename(tmp_path / "pack/gone")
    assert problems(spark, folder) == [("None", "unfinished")]
    with pytest.raises(ValueError, match="part"):
        packs.write(folder, {"../x": rows})


def test_configurations_without_secrets(spark):
    config = {"core": {"Api_Key": "x", "tokens": ["a", 7, ["b"]], "n": 1, "token_limit": 5}, "urls": ["https://h/?TOKEN=1", "https://h/"], "h": " Bearer x", "i": "see bearer x", "j": True}
    assert writers.redacted(config) == {"core": {"Api_Key": "<REDACTED>", "tokens": ["<REDACTED>", 7, ["<REDACTED>"]], "n": 1, "token_limit": 5}, "urls": ["<REDACTED>", "https://h/"], "h": "<REDACTED>", "i": "see bearer x", "j": True}
    rows = [("Api_Key", "x"), ("a", "x?token=1"), (None, "x"), (None, "\tbearer x"), ("secret", None), ("a", "")]
    got = spark.createDataFrame(rows, "k string, v string").select(writers.redacted_text(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in got] == ["<REDACTED>", "<REDACTED>", "x", "<REDACTED>", None, ""]


def test_ledger_agrees_with_a_fold(spark):
    first = datetime.date(2023, 11, 6)
    weeks = {"a": [0, 1, 2], "b": [0, 4, 8, 12], "c": [0, 1, 3, 20], "d": list(range(0, 40, 2)), "e": [5, 5, 5], None: [0, 1, 2]}
    rows = [("k", cause, first + datetime.timedelta(weeks=w)) for cause, own in weeks.items() for w in own] + [("k", "f", None)]
    got = {r["cause"]: r for r in metrics.ledger(spark.createDataFrame(rows, "category string, cause string, monday date")).collect()}
    assert got.keys() == weeks.keys()
    for cause, own in weeks.items():
        distinct = sorted(set(own))
        active = any(sum(w - 3 <= x <= w for x in distinct) >= 3 for w in distinct)
        recent = [first + datetime.timedelta(weeks=w) for w in distinct][-8:]
        r = got[cause]
        assert (r["status"], r["hit_count"], r["recent_weeks"]) == ("active" if active else "inactive", len(own), recent)
        assert (r["first_seen"], r["last_seen"]) == (first + datetime.timedelta(weeks=distinct[0]), recent[-1])


def test_texts_with_markers(spark):
    rows = [("a.py", "one\ntwo\r\nthree\n"), ("b.rs", "x # sieve:ignore\ny"), ("c.txt", "x"), ("d.py", None), ("e.go", "x"), ("f.sh", "")]
    hits = [("a.py", 2), ("a.py", 2), ("a.py", 3), ("a.py", 99), ("b.rs", 1), ("c.txt", 1), ("d.py", 1), ("zz.py", 1), ("f.sh", 1)]
    out = mask.fixed_texts(spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame(hits, "path string, line_number int"), "sieve:ignore")
    assert sorted(tuple(r) for r in out.collect()) == [("a.py", "one\ntwo # sieve:ignore\nthree # sieve:ignore\n", 2), ("f.sh", " # sieve:ignore", 1)]


def test_keys_and_registries(spark, tmp_path):
    keys = ["ok-1._X", "a b", "a_b", "", "x" * 128, "x" * 129, "é", None]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(S.safe_key(F.col("k"))).collect()]
    assert got[0] == "ok-1._X" and got[1].startswith("a_b-") and len(got[1]) == 20 and got[2:5] == ["a_b", "", "x" * 128] and got[5].startswith("x" * 64 + "-") and len(got[5]) == 81 and got[6].startswith("_-") and got[7] is None
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    registry = spark.createDataFrame([*enumerate(at), (3, None)], "id int, expires_at timestamp_ntz")
    assert sorted(r["id"] for r in findings.cleaned_exceptions(registry, F.lit("2024-01-02").cast("timestamp_ntz")).collect()) == [2, 3]
    names = ("base.json", "old.json")
    assert readers.baseline_of(spark, str(tmp_path), names) is None
    entry = {"fingerprint": "f", "rule_id": "r", "path": "p", "line": 1, "severity": "High"}
    (tmp_path / "old.json").write_text(json.dumps({"schema": "baseline.v1", "entries": [entry]}))
    assert readers.baseline_of(spark, str(tmp_path), names).first().asDict() == entry
    (tmp_path / "base.json").write_text(json.dumps({"schema": "other", "entries": []}))
    with pytest.raises(ValueError, match="schema"):
        readers.baseline_of(spark, str(tmp_path), names)


def test_summary_names_the_severest_new_findings(spark):
    """Against Python, with ties, suppressed findings, both limits, and nothing new."""
    from sievekit.functions.rules import SEVERITIES
    from sievekit.operators import report

    rows = [(f"p{i % 4}é", i // 3, i % 5, f"rule{i % 2}", SEVERITIES[i % 4], i % 7, f"f{i}", "new" if i % 3 else "suppressed") for i in range(60)]
    found = spark.createDataFrame(rows, "path string, line_number long, byte_start long, rule_id string, severity string, score int, fingerprint string, baseline_status string")
    new = sorted((r for r in rows if r[7] == "new"), key=lambda r: (-SEVERITIES.index(r[4]), -r[5], r[0].encode(), r[1], r[2], r[3]))
    for most, budget in ((5, 10_000), (50, 200), (50, 0), (1000, 10_000)):
        expected, total = [], 0
        for place, r in enumerate(new[:most], 1):
            total += sum(len(t.encode()) for t in (r[6], r[3], r[4], r[0], str(r[1])))
            if total <= budget:
                expected.append((place, r[6], r[3], r[4], r[0], r[1], total))
        got = report.top_new(found, most, budget).collect()
        assert sorted(tuple(r)[:7] for r in got) == expected and {r["truncated"] for r in got} <= {len(expected) < len(new)}
    assert report.top_new(found.filter("baseline_status <> 'new'")).count() == 0
    counts = {(r["rule_id"], r["severity"]): (r["total"], r["new"]) for r in report.rule_breakdown(found).collect()}
    assert counts == {k: (sum(r[3:5] == k for r in rows), sum(r[3:5] == k for r in new)) for k in {r[3:5] for r in rows}}

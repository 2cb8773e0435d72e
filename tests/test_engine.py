"""Detection, masking, validators, packs, sources, sinks and streams against small expectations."""

import json
import re

import pytest
from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.functions import scalars as S
from sievekit.functions import validators as V
from sievekit.operators import deps, detect, findings, mask
from sievekit.sources import baselines, readers, writers
from sievekit.streaming import streams

CARD = "4539" + "1488" + "0343" + "6467"  # passes Luhn's check, no published test card


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "path string, text string".replace("path string", "path long"))


def test_lines(spark):
    rows = texts(spark, "a\nb", "a\r\nb\n", "", "\n", "x\n\ny", None)
    got = {r["path"]: r["n"] for r in detect.numbered_lines(rows).groupBy("path").agg(F.collect_list("line").alias("n")).collect()}
    assert got == {0: ["a", "b"], 1: ["a", "b"], 3: [""], 4: ["x", "", "y"]}


def test_spans_in_bytes_and_utf16(spark):
    row = detect.scan_texts(texts(spark, "é🙂 contact test@example.com"), [r for r in R.builtin() if r.id == "pii.net.email"]).first()
    assert (row["byte_start"], row["utf16_start"], row["utf16_end"], row["matched_content"]) == (15, 12, 28, "test@example.com")
    assert row["masked_snippet"] == "é🙂 contact <REDACTED>"


@pytest.mark.parametrize(("text", "valid"), [(CARD, True), (f"card {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]}", True), ("4111111111111111", False), (CARD[:-1] + "0", False), (CARD + "1234", False), ("no digits", False), (f"12 {CARD}", True), (f"1234 {CARD}", True)])
def test_luhn(text, valid):
    assert V.luhn(text) is valid


@pytest.mark.parametrize(("text", "valid"), [("氏名：山田 太郎", True), ("Name: John Smith", True), ("name: x", False), ("名前を入力", False), ("Name: Test User", False), ("nobody", False)])
def test_person_name(text, valid):
    assert V.person_name(text) is valid


@pytest.mark.parametrize(("text", "valid"), [("東京都千代田区丸の内1丁目", True), ("大阪府大阪市北区梅田１－２", True), ("東京都千代田区", False), ("千代田区1-2", False)])
def test_address(text, valid):
    assert V.address(text) is valid


def test_whole_pack_uses_validators(spark):
    rows = texts(spark, f"card {CARD}", "card 4111111111111111", "個人番号：１２３４－５６７８－９０１２", "090-1234-5678")
    got = {(r["path"], r["rule_id"]) for r in detect.scan_texts(rows, list(R.builtin())).collect()}
    assert (0, "pii.fin.credit_card.keyword") in got and (1, "pii.fin.credit_card.keyword") not in got
    assert (2, "pii.jp.mynumber.keyword") in got and (3, "pii.jp.phone.mobile") in got


def test_masks(spark):
    rows = spark.createDataFrame([("abcdefghij", [(1, 3), (3, 5), (8, 9)]), ("abc", []), ("abcdef", [(0, 6), (1, 2)])], "t string, s array<struct<start:int,stop:int>>")
    assert [r[0] for r in rows.select(mask.masked(F.col("t"), F.col("s"), "redact", "#")).collect()] == ["a#fgh#j", "abc", "#"]
    assert [r[0] for r in rows.select(mask.masked(F.col("t"), F.col("s"), "partial")).collect()] == ["a****fgh****j", "abc", "****cdef"]
    assert [r[0] for r in rows.select(mask.masked(F.col("t"), F.col("s"), "plain")).collect()] == ["abcdefghij", "abc", "abcdef"]


def test_log_filter_prefers_the_higher_priority(spark):
    out = mask.filter_lines(spark.createDataFrame([("mail a@b.org from 10.0.0.1",)], "line string"), list(R.builtin("log"))).first()
    assert out["line"] == "mail <REDACTED:PII> from <REDACTED:PII>"


def test_score_and_grade(spark):
    rows = spark.createDataFrame([(60, ["critical"], "a test"), (60, [], "my key"), (95, ["critical"], "x"), (5, ["low_risk"], "x")], "b int, t array<string>, n string")
    assert [r[0] for r in rows.select(S.score(F.col("b"), F.col("t"), F.col("n"))).collect()] == [70, 70, 100, 0]


def test_baseline_and_gate(spark, tmp_path):
    found = findings.with_fingerprint(detect.scan_texts(texts(spark, "a@b.org", "c@d.org"), [r for r in R.builtin() if r.id == "pii.net.email"]))
    baselines.write(found.filter("path = 0"), str(tmp_path / "b"))
    stored = baselines.read(spark, str(tmp_path / "b"))
    assert [r["path"] for r in findings.new_findings(found, stored).collect()] == [1]


def test_packs(tmp_path):
    rules = [R.Rule("own.a", "a+"), R.Rule("own.b", "b+", severity="High", tags=("x",))]
    digest = writers.write_pack(rules, tmp_path / "p", "own")
    assert len(digest) == 64 and R.load_pack(tmp_path / "p") == rules
    (tmp_path / "p" / "own.b.toml").unlink()
    with pytest.raises(R.RuleError):
        R.load_pack(tmp_path / "p")
    assert R.load_pack(tmp_path / "p", strict=False) == rules[:1]
    with pytest.raises(R.RuleError):
        R.unique([rules[0], rules[0]])


def test_override():
    out = {r.id: r for r in R.override(list(R.builtin()), config={"pii.net.email": {"severity": "critical", "context_lines_before": 9}, "x": {"pattern": "x"}})}
    assert out["pii.net.email"].severity == "Critical" and out["pii.net.email"].context_lines_before == 1
    assert (out["x"].category, out["x"].context_lines_before, out["x"].severity) == ("custom", 2, "Medium")


def test_files(spark, tmp_path):
    for name, content in (("a.txt", b"a@b.org\n"), ("node_modules/b.txt", b"x"), ("bin.dat", b"\x00\x01"), ("bad.txt", b"\xff\xfe"), ("big.txt", b"x" * 50)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r["skipped"] for r in readers.files(spark, str(tmp_path), size_limit=40).collect()}
    assert got == {"a.txt": None, "bin.dat": "BINARY_FILE", "bad.txt": "READ_ERROR", "big.txt": "MAX_FILE_SIZE"}


def test_events_and_registry(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"v":1,"reason_code":"timeout","op":"a.b","outcome":"fail","hint_codes":["retry_later"]}\n\nbroken\n')
    assert readers.events(spark, str(tmp_path / "e.jsonl")).count() == 1
    (tmp_path / "r.toml").write_text('version = 1\n[[exceptions]]\nid = "x"\nreason = "r"\nexpires_at = 2030-01-01T00:00:00Z\n')
    assert readers.registry(spark, str(tmp_path / "r.toml")).first()["expires_at"].year == 2030


def test_lockfiles():
    assert readers.npm_v1(json.dumps({"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0"}, "c": {"version": "file:x"}}}}})) == [("a", "1.0.0"), ("b", "2.0.0")]
    assert readers.pnpm_lock("packages:\n  /a/1.0.0:\n    x: 1\n  '@s/b@2.0.0(peer@1)':\n    x: 1\n  link:x:\n") == [("@s/b", "2.0.0"), ("a", "1.0.0")]
    assert readers.yarn_lock('a@^1.0.0, a@^1.1.0:\n  version "1.2.0"\n\n"@s/b@npm:^2":\n  version: 2.0.1\n') == [("@s/b", "2.0.1"), ("a", "1.2.0")]


def test_versions(spark):
    rows = spark.createDataFrame([("1.2.3", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("0.2.5", "^0.2.1", True), ("0.3.0", "^0.2.1", False), ("1.2.9", "~1.2.0", True), ("1.3.0", "~1.2.0", False), ("1.10.0", ">= 1.9, < 2", True)], "v string, r string, e boolean")
    assert rows.filter(deps.satisfies(F.col("v"), F.col("r")) != F.col("e")).count() == 0


def test_evidence(tmp_path):
    writers.write_evidence(tmp_path / "e.zip", {"report.json": b"{}", "report.html": b"<p>"})
    assert writers.verify_evidence(tmp_path / "e.zip") == []
    writers.write_evidence(tmp_path / "l.zip", {"report.json": b"http://x/#token=abc"})
    assert writers.verify_evidence(tmp_path / "l.zip") == ["leak: report.json"]
    assert writers.redacted({"a": {"api_key": "x", "b": 1}, "c": "Bearer x"}) == {"a": {"api_key": "<REDACTED>", "b": 1}, "c": "<REDACTED>"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("mail a@b.org\nclean\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    run = streams.masked_lines(lines, list(R.builtin("log"))).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r[0] for r in spark.sql("SELECT value FROM masked").collect()} == {"mail <REDACTED:PII>", "clean"}


def test_mask_queries_cover_all_lines(spark, tmp_path):
    """Lines with several matches and texts with carriage returns are masked too."""
    import __spark_entry__

    rows = [(1, "to ann@example.com"), (2, "ann@example.com, bob@example.org and c@example.net\nnone"), (3, "a ann@example.com\r\nb\rc bob@example.org ann@example.com\r\n"), (4, "none"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pattern = re.compile(next(r for r in R.builtin() if r.id == "pii.net.email").pattern)
    queries = __spark_entry__.queries()

    def brute_lines(text):
        parts = re.split("\r?\n", text)
        return parts[:-1] if parts[-1] == "" else parts

    expected = {(str(i), k, pattern.sub(lambda m: "****" + m[0][-4:], line)) for i, text in rows for k, line in enumerate(brute_lines(text), 1) if pattern.search(line)}
    assert len(expected) == 4
    got = queries["mask_partial_whole"](spark, str(tmp_path)).select("path", "line_number", "masked").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    whole = {r["path"]: r["text"] for r in queries["mask_file"](spark, str(tmp_path)).collect()}
    assert whole == {str(i): "\n".join(pattern.sub("<REDACTED>", line) for line in brute_lines(text)) for i, text in rows}


def test_pages_that_share_a_url_and_numbers_that_occur_twice(spark, tmp_path):
    """Each page is masked by itself, and a number is valid by its digits, however often it occurs."""
    from sievekit.plans import catalog

    spark.createDataFrame([(1, "u", "mail a@b.org x"), (2, "u", "plain"), (3, "u", "more and c@d.org")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [r["line"] for r in catalog.QUERIES["filter_log"](spark, str(tmp_path)).collect()]
    assert len(got) == 3 and "plain" in got and not any("@" in t for t in got) and any(t.startswith("mail ") and t.endswith(" x") for t in got) and any(t.startswith("more and ") for t in got)
    text = "9807915762804490 and 9807915762804490, 4111111111111111"
    spark.createDataFrame([(45, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["d"]: r["valid"] for r in catalog.QUERIES["validator_luhn_digits"](spark, str(tmp_path)).collect()}
    assert got == {"9807915762804490": False, "4111111111111111": True}


def test_mask_file_masks_all_rules(spark, tmp_path):
    """Cards, numbers and keys go as well as addresses; every text stays, those with carriage returns, repeated, empty and missing ones too."""
    duckdb = pytest.importorskip("duckdb")
    from sievekit.plans import catalog

    good, bad, key = "4539" + "1488" + "0343" + "6467", "4539" + "1488" + "0343" + "6468", "AKIA" + "Q3EXMPLK7RT2WZ9B"
    rows = [
        (1, f"card {good}\r\nmail ann@example.com, {key}\rend\r\n\r\nlast"), (2, f"card {bad}\n"), (3, "個人番号：１２３４－５６７８－９０１２"), (4, None), (5, ""), (6, "\n"), (7, "a\r"),
        (8, f"{key} # sieve:ignore\n{key}"), (8, "one"), (8, f"two\n{key}"), (9, "host 10.1.2.3 and bob@example.org\n\n"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    order = lambda found: sorted(map(tuple, found), key=repr)
    got = order(catalog.QUERIES["mask_file"](spark, str(tmp_path)).select("path", "text").collect())
    gone = "<REDACTED>"
    expected = [
        ("1", f"{gone}\nmail {gone}, {gone}\rend\n\nlast"), ("2", f"card {bad}"), ("3", gone), ("4", None), ("5", ""), ("6", ""), ("7", "a\r"),
        ("8", f"{key} # sieve:ignore\n{gone}"), ("8", "one"), ("8", f"two\n{gone}"), ("9", f"host {gone} and {gone}\n"),
    ]
    assert got == order(expected)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert order(con.sql(catalog.ORACLE_SQL["mask_file"]).fetchall()) == got

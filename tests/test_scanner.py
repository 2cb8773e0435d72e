"""The one-pass scanner against the expression form, long lines, and what patterns need."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievekit.functions import patterns, scalars, validators
from sievekit.functions import rules as R
from sievekit.operators import detect, mask, scanner

RULES = [*R.builtin("pii"), *R.builtin("creds"), *R.builtin("log")]
COLUMNS = ("id", "line_number", "rule_id", "byte_start", "byte_end", "utf16_start", "utf16_end", "matched_content", "masked_snippet", "score", "grade", "severity", "context_before")


def samples():
    """Lines that rules match or nearly match, in odd surroundings."""
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    good = [
        "mail a.b@example.com, c@d.org", "x" * 50 + "@y.co_z@q.net", "10.0.0.1 and 256.1.1.1", "マイナンバー １２３４－５６７８－９０１２", f"個人番号:{digits(12)}", f"order 1234-5678-9012 {digits(12)}", "〒123-4567 version 123-4567",
        "rev：1234567 build-123-4567", "電話 03-1234-5678 TEL 0312345678", "090-1234-5678 ０９０１２３４５６７８", "東京都千代田区丸の内1-2-3", "クレジットカード 4012888888881881", "card 4111111111111111 VISA5555555555554444", "氏名: 山田太郎", "Name: John Smith name = test",
        "年齢 42歳 age: 7", "性別：男 gender female", f"token: {hexes(40)} wallet 0x{hexes(40)}", f"txid {hexes(64)} hash={hexes(64)}", "aa:bb:cc:dd:ee:ff 00-11-22-33-44-55", "fe80:1:2:3::1 1:2:3:4", "35.6895, 139.6917", "品川 500 あ 12-34", "生年月日 1990年1月2日 誕生日 昭和60年1月2日",
        "AKIA" + "A1B2C3D4" * 2, "ghp_" + "aB3" * 12, "-----BEGIN RSA PRIVATE KEY-----", "aws_secret_access_key = '" + "Ab1/" * 10 + "'", "xoxb-1234567890-1234567890-" + "a1" * 12, "ID: ABCDEFGH12345 customer_id=abcd1234 🙂 employee id e1234", "会社名：株式会社テスト", "postal code 123-4567 PHONE 03-123-4567",
        "a@b.co # sieve:ignore", "a@b.co // sieve:ignore=pii.net.email 1.2.3.4", "１２３－４５６７　（test）", "poſtal code: 123-4567", "²a@b.co", "é10.0.0.1", "", "plain words only", "key=́" + "Z9" * 20,
    ]
    out = []
    for i in range(150):
        lines = [r.choice(good) + r.choice(["", " ", "。", "　", "_", "é", " production key", " sample"]) for _ in range(r.randrange(0, 6))]
        out.append((i, r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n", "\r"])))
    return out + [(900, None), (901, ""), (902, "\n\n"), (903, "\r\n"), (904, "\n".join(good)), (904, "\n".join(good)), (None, good[0])]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(samples(), "id long, text string").withColumn("found", F.lit("taken")).withColumn("m", F.lit(1)).repartition(3).cache()


def test_equals_the_expression_form(spark, texts):
    got = detect.scan_texts(texts.select("id", "text"), RULES).select(*COLUMNS).collect()
    expected = detect.findings(detect.numbered_lines(texts.select("id", "text")), RULES).select(*COLUMNS).collect()
    assert len(got) > 400 and sorted(map(repr, got)) == sorted(map(repr, expected))
    assert len({r["rule_id"] for r in got}) > 35


def test_every_match_holds_what_its_pattern_needs():
    import regex

    lines = [line for _, text in samples() if text for line in text.split("\n")]
    for rule in RULES:
        needs = patterns.needs(rule.pattern)
        for m in (m for line in lines for m in regex.finditer(patterns.python_pattern(rule.pattern), line)):
            assert not needs.words or any(t in (m[0] if exact else m[0].lower()) or not exact and re.search("[ſK]", m[0]) for t, exact in needs.words), (rule.id, m[0])
            for kind, count in zip(patterns.KINDS, needs.counts):
                assert sum(ord(c) > 127 if kind is None else c in kind for c in m[0]) >= count, (rule.id, m[0], kind)


@pytest.mark.parametrize("pattern", [r.pattern for r in RULES if patterns.leading_run(r.pattern)])
def test_runs_up_to_a_sign_match_as_the_pattern_does(pattern):
    import regex

    r = random.Random(3)
    finder, whole = scanner.Finder(pattern), regex.compile(patterns.python_pattern(pattern))
    for _ in range(3000):
        line = "".join(r.choice("aA1.@@_-% éK") for _ in range(r.randrange(1, 30)))
        assert list(finder(line)) == [m.span() for m in whole.finditer(line)], line


def test_long_lines_take_time_in_proportion():
    """A megabyte of matches in one line, and a megabyte of almost matches."""
    one = scanner.Scanner(RULES, detect.MARKER)
    for line in ("user.name@example.com 10.0.0.1 090-1234-5678 é " * 22_000, "a" * 1_000_000 + " x@", "1.a-" * 250_000 + "@", "名前" * 170_000, "0" * 1_000_000, "ab:" * 340_000):
        import numpy as np

        data = line.encode()
        began = time.perf_counter()
        found, _ = one.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        for f in found:
            scanner.places(f.text, f.spans)
            scanner.masked(f.text, f.spans, scanner.hiding("redact", "<X>"))
        assert time.perf_counter() - began < 30, line[:20]
    assert not found or found[0].text == line


def test_validators_agree_with_their_expressions(spark):
    r = random.Random(8)
    some = ["".join(r.choice("0123456789０１２ -－ー—　x\\") for _ in range(r.randrange(1, 24))) for _ in range(400)] + ["0901234567８", "1234 5678 9012", "1234\\5678\\9012"]
    rows = spark.createDataFrame([(t,) for t in some], "t string").select("t", scalars.mynumber_length(F.col("t")).alias("a"), scalars.mobile_number(F.col("t")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(validators.mynumber(r["t"]), validators.mobile(r["t"])) for r in rows]


@pytest.mark.parametrize("mode", ["redact", "partial", "plain"])
def test_masked_texts(spark, texts, mode):
    """Whole texts against the matches of the expression form, masked line by line."""
    hide = scanner.hiding(mode, "<REDACTED>")
    lines = detect.numbered_lines(texts.select(F.monotonically_increasing_id().alias("id"), "text").filter("text is not null"))
    rows = detect.with_matches(lines, RULES).select("id", "line_number", "line", "__found").collect()
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["line_number"])):
        spans = [(m["start"], m["stop"], m["rule"]) for m in r["__found"]]
        by.setdefault(r["id"], []).append(scanner.masked(r["line"], spans, hide) if spans else r["line"])
    got = mask.mask_text(texts, RULES, mode=mode)
    assert got.columns == texts.columns
    present = [r["text"] for r in got.collect() if r["text"] is not None]
    assert sorted(present) == sorted(["\n".join(v) for v in by.values()] + [""] * (len(present) - len(by)))
    assert got.filter("text is null").count() == texts.filter("text is null").count()


def test_log_lines(spark, texts):
    """The island's winner: by priority, then length, then the earlier start."""
    lines = detect.numbered_lines(texts.select("id", "text")).select("id", "line")
    logs = list(R.builtin("log"))
    got = mask.filter_lines(lines, logs).collect()
    expected = []
    for r in detect.with_matches(lines, logs, narrow=False, markers=False).collect():
        def word(_, own):
            best = max(own, key=lambda s: (logs[s[2]].score + 5, s[1] - s[0], -s[0], logs[s[2]].placeholder or "<REDACTED>"))
            return logs[best[2]].placeholder or "<REDACTED>"

        expected.append((r["id"], scanner.masked(r["line"], [(m["start"], m["stop"], m["rule"]) for m in r["__found"]], word)))
    assert sorted(map(repr, ((r["id"], r["line"]) for r in got))) == sorted(map(repr, expected))


def test_empty_table_and_no_rules(spark, texts):
    assert detect.scan_texts(texts.select("id", "text").limit(0), RULES).collect() == []
    assert detect.scan_texts(texts.select("id", "text"), []).collect() == []


def test_no_rule_stands_in_the_plan(spark, texts):
    plan = detect.scan_texts(texts.select("id", "text"), RULES).groupBy("severity").count()._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("mapinarrow") == 1 and "rlike" not in plan and "regexp" not in plan


def test_masked_texts_go_out_by_chunks(spark, monkeypatch):
    """A worker holds a chunk's texts, however many the batch has; nulls, ends of lines and order stay."""
    monkeypatch.setattr(scanner, "CHUNK_BYTES", 4000)
    rows = [(k, None if k % 7 == 0 else f"a{k}@b.org {'x' * (k % 50)}\r\nline {k}\n" if k % 2 else f"plain {k}\n") for k in range(2000)]
    kept = []

    class Rows:
        schema, sparkSession = None, spark

        def mapInArrow(self, run, _):
            kept.append(run)

    rule = [r for r in R.builtin("pii") if r.id == "pii.net.email"]
    scanner.rewrite(Rows(), rule, detect.MARKER, "text", scanner.hiding("redact", "<REDACTED>"))
    batch = pa.record_batch({"id": [k for k, _ in rows], "text": [t for _, t in rows]}).slice(3)
    out = list(kept[0](iter([batch])))
    expected = [(k, None if t is None else t.replace(f"a{k}@b.org", "<REDACTED>").replace("\r\n", "\n")[:-1]) for k, t in rows[3:]]
    assert [(r["id"], r["text"]) for b in out for r in b.to_pylist()] == expected
    assert max(b.nbytes for b in out) < 8000 and len(out) > 5

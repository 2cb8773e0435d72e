"""Ignore files, histories, baselines and version ranges against brute force."""

import itertools
import random
import re
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from sievekit.operators import versions
from sievekit.sources import baselines, history, ignore

RULES = [
    ("", 1, "# note"), ("", 2, "*.log"), ("", 3, "!keep.log"), ("", 4, "build/"), ("", 5, "/top.txt"), ("", 6, "docs/*.md"), ("", 7, "**/cache/**"), ("", 8, "a?c.[ch]"), ("", 9, "trail   "), ("", 10, ""), ("", 11, "\\#real"), ("", 12, "x/**/y"), ("", 13, "[!z]1"), ("", 14, "\\!bang"),
    ("src", 1, "!*.log"), ("src", 2, "gen"), ("src", 3, "/only.c"), ("src/deep", 1, "*.log"), ("src/deep", 2, "!top.txt"), ("other", 1, "*"), ("other", 2, "!back/"), ("other", 3, "!seen.txt\r"),
]
NAMES = ["a.log", "keep.log", "build", "top.txt", "docs", "r.md", "cache", "abc.c", "trail", "#real", "x", "y", "a1", "z1", "!bang", "src", "gen", "only.c", "deep", "other", "back", "seen.txt", "plain"]


def paths():
    r = random.Random(2)
    out = set()
    for _ in range(700):
        out.add("/".join(r.choice(NAMES) for _ in range(r.randrange(1, 5))))
    files = {p for p in out if not any(q.startswith(p + "/") for q in out)}
    return sorted(files)


def test_ignore_files_as_git_has_them(spark, tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git here")
    every = paths()
    for p in every:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    lines: dict = {}
    for folder, _, line in RULES:
        lines.setdefault(folder, []).append(line)
    for folder, own in lines.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / ".gitignore").write_text("\n".join(own))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    told = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.quotePath=false", "ls-files", "--others", "--ignored", "--exclude-standard"], capture_output=True, text=True, check=True).stdout.splitlines()
    got = {r["path"] for r in ignore.left_out(spark.createDataFrame([(p,) for p in every], "path string"), spark.createDataFrame(RULES, "folder string, line_number int, line string"), hidden=False).collect()}
    assert got == set(told) & set(every) and 50 < len(got) < len(every)


def test_hidden_names_and_odd_paths(spark):
    rules = spark.createDataFrame([("", 1, "!.github/"), ("", 2, None)], "folder string, line_number int, line string")
    frame = spark.createDataFrame([(p, k) for k, p in enumerate([".env", ".github/x.yml", "a/.cache/b", "a/b", "a/b", None, ""])], "path string, k int")
    assert {r["path"] for r in ignore.left_out(frame, rules).collect()} == {".env", "a/.cache/b"}
    assert sorted(r["k"] for r in ignore.walked(frame, rules).collect()) == [1, 3, 4, 5, 6]
    assert ignore.left_out(frame, rules.limit(0)).count() == 3 and ignore.left_out(frame.limit(0), rules).count() == 0


# ---- Histories -----------------------------------------------------------------------------------


def test_history(spark):
    r = random.Random(3)
    commits, trees, by = [(0, None, 0)], {0: {"a": "1", "b": "2"}}, {0: None}
    for k in range(1, 70):
        parent = r.choice([k - 1, k - 1, max(0, k - 3)])
        tree = dict(trees[parent])
        for _ in range(r.randrange(0, 3)):
            name = r.choice("abcdef")
            if r.random() < 0.3:
                tree.pop(name, None)
            else:
                tree[name] = str(r.randrange(9))
        commits.append((k, parent, k * 10))
        trees[k], by[k] = tree, parent
    frame = spark.createDataFrame(commits + [(69, by[69], 690)], "sha long, parent long, time long")
    blobs = spark.createDataFrame([(s, p, b) for s, t in trees.items() for p, b in t.items()], "sha long, path string, blob string")
    heads = spark.createDataFrame([(69,), (40,), (None,), (999,)], "head long")

    def chain(head):
        out = []
        while head is not None:
            out.append(head)
            head = by[head]
        return out

    got = {(x["head"], x["sha"]): x["distance"] for x in history.chains(frame, heads).collect()}
    assert got == {(h, s): d for h in (69, 40) for d, s in enumerate(chain(h))}

    def diff(a, b):
        return {(p, "A" if p not in a else "D" if p not in b else "M", b.get(p, a.get(p))) for p in a.keys() | b.keys() if a.get(p) != b.get(p)}

    expected = {(s, *x) for s in (5, 17, 60) for x in diff(trees[by[s]], trees[s])}
    chosen = spark.createDataFrame([(5,), (17,), (60,), (0,), (12345,)], "sha long")
    assert {tuple(x) for x in history.commit_changes(frame, blobs, chosen).collect()} == expected
    recent = {s for h in (69, 40) for s in chain(h) if s * 10 >= 300 and by[s] is not None}
    assert {tuple(x) for x in history.since_changes(frame, blobs, heads, 300).collect()} == {(s, *x) for s in recent for x in diff(trees[by[s]], trees[s])}
    index = spark.createDataFrame([("a", "new"), ("z", "0")], "path string, blob string")
    assert {tuple(x) for x in history.staged_changes(blobs, index, 69).collect()} == diff(trees[69], {"a": "new", "z": "0"})
    assert {tuple(x) for x in history.staged_changes(blobs, index, None).collect()} == {("a", "A", "new"), ("z", "A", "0")}
    contents = spark.createDataFrame([("new", b"x"), ("0", b"y"), ("1", b"z")], "blob string, content binary")
    assert {x["path"] for x in history.scannable(history.staged_changes(blobs, index, 69), contents).collect()} == {"a", "z"}


# ---- Baselines -----------------------------------------------------------------------------------


def test_baselines(spark, tmp_path):
    path = str(tmp_path / "base")
    schema = "fingerprint string, rule_id string, path string, line_number long, severity string, other int"
    good = [(f"sha256:{k % 40:064x}", "r", f"p{k:02}", k + 1, "High", 1) for k in range(50)]
    bad = [(None, "r", "p", 1, "High", 1), ("sha256:xyz", "r", "p", 1, "High", 1), (good[0][0], "", "p", 1, "Low", 1), (good[0][0], "r", None, 1, "Low", 1), (good[0][0], "r", "p", 0, "Low", 1), (good[0][0], "r", "p", None, "Low", 1)]
    assert baselines.read(spark, path).count() == 0
    assert baselines.write(spark.createDataFrame(good + bad, schema).repartition(4), path) == 1
    first = {r["fingerprint"]: (r["path"], r["line"]) for r in baselines.read(spark, path).collect()}
    assert first == {f"sha256:{k:064x}": (f"p{k:02}", k + 1) for k in range(40)}
    assert sorted(r["problem"] for r in baselines.quarantined(spark, path).collect()) == sorted(["no fingerprint", "broken fingerprint", "no rule", "no path", "no line", "no line"])
    with pytest.raises(baselines.IncompleteScan):
        baselines.write(spark.createDataFrame(good, schema), path, complete=False)
    broken = spark.createDataFrame(good, schema).withColumn("rule_id", F.when(F.col("line_number") < 30, F.col("rule_id")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        baselines.write(broken, path)
    assert {r["fingerprint"] for r in baselines.read(spark, path).collect()} == first.keys()  # the write that broke off left no manifest
    assert baselines.write(spark.createDataFrame(good[:3], schema), path) == 2
    assert baselines.read(spark, path).count() == 3 and baselines.read(spark, path, 1).count() == 40
    with pytest.raises(ValueError, match="generation 7"):
        baselines.read(spark, path, 7)
    manifest = baselines.manifests(spark, path)
    assert [(m["generation"], m["entries"], m["quarantined"]) for m in manifest] == [(2, 3, 0), (1, 40, 6)]


# ---- Versions ------------------------------------------------------------------------------------


def parsed(v):
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+.*)?", v)
    tail = m[4] and tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in m[4].split("."))
    return (int(m[1]), int(m[2] or 0), int(m[3] or 0)), tail, sum(m[k] is not None for k in (1, 2, 3))


def order(v):
    numbers, tail, _ = parsed(v)
    return numbers, tail is None, tail or ()


def meets(version, text):
    numbers, tail, _ = parsed(version)
    named = tail is None

    def one(c):
        nonlocal named
        c = c.strip()
        if c == "*":
            return True
        op, bound = re.fullmatch(r"([<>=^~]*)\s*(.*)", c).groups()
        own, pre, n = parsed(bound)
        named = named or pre is not None and own == numbers
        if n < 3:  # what a short version stands for, from .. below
            low, high = own, ((own[0] + 1, 0, 0) if n == 1 else (own[0], own[1] + 1, 0))
            at = numbers
            caret = (own[0] + 1, 0, 0) if n == 1 or own[0] else (0, own[1] + 1, 0)
            return {"<": at < low, "<=": at < high, ">": at >= high, ">=": at >= low, "=": low <= at < high, "~": low <= at < high}.get(op, low <= at < caret)
        a, b = order(version), order(bound)
        caret = (own[0] + 1, 0, 0) if own[0] else (0, own[1] + 1, 0) if own[1] else (0, 0, own[2] + 1)
        tilde = (own[0], own[1] + 1, 0)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b, "~": a >= b and numbers < tilde}.get(op, a >= b and numbers < caret)

    fits = all([one(c) for c in text.split(",")])
    return fits and named


VERSIONS = ["0.0.3", "0.2.1", "0.2.9", "0.3.0", "1.0.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.2.0", "1.2.0-rc.1", "1.2.3+build.5", "1.10.0", "2.0.0-pre", "2.0.0", "2.1.3", "10.0.0", "1.2"]
REQUIREMENTS = ["^1.0.0", "^0.2.1", "^0.0.3", "~1.2.0", "~1.2", "~1", ">= 1.0.0-beta.2, < 1.2.0", "< 1.2.0-rc.2", "=1.2", "1.2", "^0", "^0.0", "*", "> 1.2", "<= 1.2", ">=1.9, <2", "=1.0.0-alpha", ">1.0.0-alpha", "< 2.0.0", "^1.2.0-rc.1"]


def test_versions_are_ordered_as_semantic_versioning_says(spark):
    rows = spark.createDataFrame([(v,) for v in VERSIONS + ["nonsense", "", None, "1.2.3.4"]], "v string").withColumn("k", versions.key(F.col("v"))).collect()
    assert all((r["k"] is None) == (r["v"] not in VERSIONS) for r in rows)
    known = [(r["v"], r["k"].encode()) for r in rows if r["k"] is not None]
    for (a, x), (b, y) in itertools.product(known, known):
        assert (x < y) == (order(a) < order(b)) and (x == y) == (order(a) == order(b)), (a, b)


def test_requirements(spark):
    rows = spark.createDataFrame(list(itertools.product(VERSIONS, REQUIREMENTS)), "v string, r string").withColumn("fits", versions.satisfies(F.col("v"), F.col("r"))).collect()
    wrong = [(r["v"], r["r"], r["fits"]) for r in rows if r["fits"] != meets(r["v"], r["r"])]
    assert not wrong
    odd = spark.createDataFrame([("1.0.0", "garbage"), ("x", "*"), (None, "*"), ("1.0.0", None), ("1.0.0", ">= 1, what")], "v string, r string")
    assert not any(r["f"] for r in odd.select(versions.satisfies(F.col("v"), F.col("r")).alias("f")).collect())


def test_advisories_by_range(spark):
    r = random.Random(9)
    packages = [(r.choice(["hot"] * 5 + ["a", "b", None]), r.choice(VERSIONS + ["junk"]), f"lock{k % 7}") for k in range(300)]
    advisories = [(f"X-{k}", r.choice(["hot", "hot", "a", "none"]), r.choice(REQUIREMENTS + ["bad one"])) for k in range(40)]
    got = versions.vulnerable(spark.createDataFrame(packages, "name string, version string, location string"), spark.createDataFrame(advisories, "id string, crate_name string, vulnerable_versions string")).collect()
    expected = [(n, v, at, i) for n, v, at in packages if v != "junk" for i, c, q in advisories if c == n and q != "bad one" and meets(v, q)]
    assert sorted((x["name"], x["version"], x["location"], x["id"]) for x in got) == sorted(expected) and len(expected) > 500
    fixed = spark.createDataFrame([("a", "1.2.0-rc.1", ["1.0.0", "1.2.0", "2.0.0"]), ("b", "1.2.0", ["1.2.0-rc.1", "1.2.0"]), ("c", "0.1.0", ["0.2.0-alpha", "0.2.0"])], "name string, version string, fixed array<string>")
    assert {(x["name"], x["fixed"]) for x in versions.least_fixed(fixed).collect()} == {("a", "1.2.0"), ("c", "0.2.0-alpha")}


def test_a_requirement_is_read_once_and_a_version_has_few_patterns(spark):
    packages = spark.createDataFrame([("a", "1.0.0", "x"), ("a", "1.0.0", "x"), ("a", "1.0.0-rc.1", "y"), ("a", None, "y"), ("a", "junk", "z")], "name string, version string, location string")
    advisories = spark.createDataFrame([("X-1", "a", "< 2"), ("X-1", "a", "< 2"), ("X-2", "a", None), ("X-3", "a", ">= 1.0.0-beta, < 1.0.0"), ("X-4", "a", "*")], "id string, crate_name string, vulnerable_versions string")
    found = versions.vulnerable(packages, advisories)
    got = sorted((r["version"], r["location"], r["id"]) for r in found.collect())
    assert got == sorted([("1.0.0", "x", "X-1")] * 4 + [("1.0.0", "x", "X-4")] * 2 + [("1.0.0-rc.1", "y", "X-3")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("regexp_") < 60
    reading = [line for line in plan.splitlines() if "split(__text" in line or "Aggregate [vulnerable_versions" in line]
    assert "split(__text" in reading[0] and "Aggregate" in reading[-1]  # read above the grouping
    assert "split(vulnerable_versions" not in plan


def test_packages_are_read_once_and_dealt_by_stretch(spark, tmp_path):
    majors = [0, 1, 2, 3, 4, 7, 8, 15, 16, 63, 64, 1023, 1024, 2024, 10**12]
    packages = [("hot", f"{m}.{k}.0{end}", "at") for m in majors for k in (0, 5) for end in ("", "-rc.1")] + [("hot", "a\x01b\x01c\x01d", "at"), ("hot", "", "at"), ("hot", None, "at")]
    texts = ["*", "< 4.5.0", ">= 7", ">= 8.0.0, < 64.0.0", "< 2, > 3", ">= 64.0.0-rc.1", "<= 2024.5", "^1023.1", f"< {10**12}.1.0", "=3.5.0-rc.1"]
    spark.createDataFrame(packages, "name string, version string, location string").write.parquet(str(tmp_path / "p"))
    advisories = spark.createDataFrame([(f"X-{k}", "hot", t) for k, t in enumerate(texts)], "id string, crate_name string, vulnerable_versions string")
    found = versions.vulnerable(spark.read.parquet(str(tmp_path / "p")), advisories)
    expected = [(v, f"X-{k}") for _, v, _ in packages if v and v[0] != "a" for k, t in enumerate(texts) if meets(v, t)]
    assert sorted((r["version"], r["id"]) for r in found.collect()) == sorted(expected) and len(expected) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1  # no second pass over the packages


def test_versions_cut_at_dots_are_those_of_the_pattern(spark):
    odd = ["1..2", ".1.2", "1.2.", "..", "...", "1.2.3.4", "1.2.3\n", " 1.2.3 ", "v1.2.3", "\u0663.1.2", "1.2.3-", "1.2.3-rc.1", "1.2.3+b.1", "01.002.0003", "9" * 25 + ".0.1", "1.2.x", "1. 2.3", "", None, "..-1"]
    rows = spark.createDataFrame([(v,) for v in VERSIONS + odd], "v string").select("v", versions._fields(F.col("v")).alias("a"), versions._fields_of_many(F.col("v")).alias("b")).collect()
    assert not [r for r in rows if r["a"] != r["b"]] and sum(r["a"] is None for r in rows) > 8

"""Sources: files, blobs, diff lines, tables, logs of events, baselines, registries, lockfiles, manifests."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators.metrics import EVENT_SCHEMA

# Folders that are never walked into.
PRUNED = (
    "node_modules", "target", "dist", "build", "vendor", ".git", ".direnv", ".venv", "venv", "__pycache__", ".cache", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", "coverage", ".nyc_output", ".next", ".nuxt", ".svelte-kit", ".terraform", ".terragrunt-cache",
)
FILE_LIMIT, SIZE_LIMIT = 1_000_000, 1_000_000
BASELINE_SCHEMA = "schema string, generated_at string, tool string, entries array<struct<fingerprint:string,rule_id:string,path:string,line:bigint,severity:string>>"
MANIFEST_SCHEMA = "path string, id string, concept string, slug string, variant string, category string, severity string, score int, terms string"


def pruned(path: Column) -> Column:
    """Whether a path, relative to the root, goes through a folder that is never walked into."""
    names = "|".join(re.escape(n) for n in PRUNED)
    return path.rlike(f"(^|/)({names})/")


def unsafe(path: Column) -> Column:
    """Whether a path leaves its root: it begins at the top, or one of its parts is `..`."""
    return path.rlike(r"(^/|(^|/)\.\.(/|$))")


def skip_reason(content: Column, size: Column, size_limit: int = SIZE_LIMIT, bad_text: str = "READ_ERROR") -> Column:
    """BINARY_FILE (a zero byte near the start), then MAX_FILE_SIZE, then bad_text for what is no UTF-8; else null."""
    binary = F.locate("\x00", F.substring(content, 1, 8192).cast("string")) > 0
    return F.when(binary, "BINARY_FILE").when(size > size_limit, "MAX_FILE_SIZE").when(~F.is_valid_utf8(content.cast("string")), bad_text)


def files(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), limit: int = FILE_LIMIT, size_limit: int = SIZE_LIMIT) -> DataFrame:
    """path, size, skipped, text of all files below a folder; text is null where a file is skipped.

    Folders of PRUNED go, and paths that hold a string of `ignore`.  At most `limit` files, by path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring_index("path", root.rstrip("/") + "/", -1)
    kept = raw.filter(~pruned(relative))
    for word in ignore:
        kept = kept.filter(~F.contains("path", F.lit(word)))
    # paths alone are sorted, not contents
    kept = kept.join(kept.select("path").orderBy("path").limit(limit), "path", "left_semi")
    skipped = skip_reason(F.col("content"), F.col("length"), size_limit)
    return kept.select("path", F.col("length").alias("size"), skipped.alias("skipped"), F.when(skipped.isNull(), F.col("content").cast("string")).alias("text"))


def blobs(table: DataFrame, commit: str | None = None, since=None) -> DataFrame:
    """Added and modified blobs of a table (commit, committed_at, path, status, content), of a commit or since a time."""
    out = table.filter(F.col("status").isin("A", "M"))
    if commit is not None:
        out = out.filter(F.col("commit") == commit)
    if since is not None:
        out = out.filter(F.col("committed_at") >= since)
    skipped = skip_reason(F.col("content"), F.octet_length("content"), bad_text="BINARY_FILE")
    return out.withColumn("skipped", skipped).withColumn("text", F.when(F.col("skipped").isNull(), F.col("content").cast("string")))


def diff_lines(table: DataFrame) -> DataFrame:
    """Added lines of a diff, each on its own: no context, line number 1, white space of any kind at the end gone, empty ones left out."""
    trimmed = table.withColumn("line", F.regexp_replace("line", r"(?U)\s+$", "")).filter("line <> ''")
    return trimmed.withColumn("line_number", F.lit(1).cast("long")).withColumn("context_before", F.array().cast("array<string>"))


def table_texts(table: DataFrame, path: Column, text_col: str) -> DataFrame:
    """Any string column of a table as documents."""
    return table.select(path.alias("path"), F.col(text_col).alias("text"))


def since_time(text: str) -> Column:
    return F.coalesce(F.try_to_timestamp(F.lit(text)), F.try_to_timestamp(F.lit(text), F.lit("yyyy-MM-dd")))


def events(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; lines that don't parse or lack a code go."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENT_SCHEMA).alias("e")).select("e.*").filter("reason_code is not null and op is not null")


def baseline(spark: SparkSession, path: str, schema: str = "baseline.v1") -> DataFrame:
    """The entries of a baseline file; another schema is an error."""
    raw = spark.read.schema(BASELINE_SCHEMA).option("multiLine", True).json(path)
    found = [r["schema"] for r in raw.select("schema").limit(2).collect()]
    if found != [schema]:
        raise ValueError(f"the baseline has the schema {found}")
    return raw.select(F.explode("entries").alias("e")).select("e.*")


def baseline_of(spark: SparkSession, folder: str, names: tuple[str, ...], schema: str = "baseline.v1") -> DataFrame | None:
    """The baseline of a folder under the first of some names that is there; None without any.  One that is there but wrong is an error, not passed over."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return baseline(spark, f"{folder}/{name}", schema)
    return None


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The exceptions of a TOML registry of version 1: id, reason, created_by, expires_at."""
    raw = tomllib.loads(Path(path).read_text("utf-8"))
    if raw.get("version", 1) != 1:
        raise ValueError("only registries of version 1 are read")
    rows = [(e["id"], e.get("reason"), e.get("created_by"), str(e["expires_at"]) if e.get("expires_at") else None) for e in raw.get("exceptions", [])]
    return spark.createDataFrame(rows, "id string, reason string, created_by string, expires_at string").withColumn("expires_at", F.try_to_timestamp("expires_at"))


def rules_table(table: DataFrame) -> DataFrame:
    return table.filter("enabled").select("id", "pattern", "description", "severity")


def rules_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, pattern string, severity string, score int, category string").option("multiLine", True).json(path)


def template_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def cargo_lock(spark: SparkSession, path: str) -> DataFrame:
    packages = tomllib.loads(Path(path).read_text("utf-8")).get("package", [])
    return spark.createDataFrame([("Rust", p["name"], p["version"], path) for p in packages], "ecosystem string, name string, version string, location string")


def npm_v1(content: str) -> list[tuple[str, str]]:
    """Names and versions of the nested dependencies of a version 1 lockfile."""
    out: set[tuple[str, str]] = set()
    open_ = [json.loads(content).get("dependencies") or {}]
    while open_:
        for name, entry in open_.pop().items():
            version = str(entry.get("version", ""))
            if version[:1].isdigit():
                out.add((name, version))
            if entry.get("dependencies"):
                open_.append(entry["dependencies"])
    return sorted(out)


def pnpm_lock(content: str) -> list[tuple[str, str]]:
    """Names and versions from the keys of a pnpm lockfile's packages and snapshots."""
    out, section = set(), None
    for line in content.splitlines():
        if top := re.match(r"([A-Za-z]+):\s*$", line):
            section = top[1]
        elif section in ("packages", "snapshots") and (key := re.match(r"  ['\"]?([^\s'\"].*?)['\"]?:(\s*\{.*\})?\s*$", line)):
            name = key[1].split("(")[0]
            if re.match(r"(file|link|workspace):", name):
                continue
            if old := re.match(r"/(@[^/]+/[^/]+|[^/@]+)/([0-9][^_/]*)", name):
                out.add((old[1], old[2]))
            elif new := re.match(r"/?(@?[^@]+)@([0-9][^_]*)$", name):
                out.add((new[1], new[2]))
    return sorted(out)


def yarn_lock(content: str) -> list[tuple[str, str]]:
    """Names and versions of a yarn lockfile: stanzas of selectors, each with a version, in either of its two forms."""
    out, names = set(), []
    for line in content.splitlines():
        if line and not line[0].isspace() and not line.startswith("#") and line.rstrip().endswith(":"):
            selectors = re.findall(r'"([^"]+)"|([^\s,":][^,":]*)', line.rstrip()[:-1])
            flat = [s.strip() for pair in selectors for part in pair if part for s in part.split(",")]
            names = [m[1] for s in flat if (m := re.match(r"(@?[^@]+)@", s)) and not re.search(r"@(file|link|workspace|portal|patch):", s)]
        elif version := re.match(r'\s+version:?\s+"?([0-9][^"\s]*)"?', line):
            out |= {(n, version[1]) for n in names if n != "__metadata"}
            names = []
    return sorted(out)

"""Ignore files as tables: which paths a walk leaves out.

Rules are lines of the ignore files of folders.  Each folder or file on the way to a path is judged once, by the rules of all folders above it: the deepest
folder's file decides, in it the last line that fits.  A path goes if it or any folder on the way to it is ignored, so nothing below an ignored folder comes back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@cache
def glob_regex(pattern: str) -> re.Pattern:
    """An ignore line without its ! and its last slash, over a path below the line's folder: a slash at its head or inside binds it to that folder."""
    bound = "/" in pattern
    pattern = pattern.removeprefix("/")
    out, at = "" if bound else "(?:.*/)?", 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at) and (at == 0 or pattern[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("/**", at) and at + 3 == len(pattern):
            out, at = out + "/.+", at + 3
        elif c == "*":
            stars = len(pattern) - at - len(pattern[at:].lstrip("*"))
            out, at = out + "[^/]*", at + stars
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c == "[" and (end := pattern.find("]", at + 2)) > 0:
            inside = pattern[at + 1 : end].replace("\\", "\\\\")
            inside = "^/" + inside[1:] if inside[0] in "!^" else inside
            out, at = out + f"(?!/)[{inside}]", end + 1
        elif c == "\\" and at + 1 < len(pattern):
            out, at = out + re.escape(pattern[at + 1]), at + 2
        else:
            out, at = out + re.escape(c), at + 1
    try:
        return re.compile(out + r"\Z", re.DOTALL)
    except re.error:
        return re.compile(r"(?!)")  # a broken class fits nothing


def parsed(rules: DataFrame) -> DataFrame:
    """folder, line_number, pattern, back (whether it brings back), folders_only of lines (folder, line_number, line); blank lines and comments go."""
    line = F.regexp_replace(F.regexp_replace("line", "\r$", ""), r"(?<!\\)[ ]+$", "")
    back = line.startswith("!")
    body = F.when(back, F.substring(line, 2, 1 << 30)).otherwise(line)
    own = rules.filter(line.isNotNull() & (line != "") & ~line.startswith("#"))
    return own.select("folder", "line_number", F.regexp_replace(body, "/+$", "").alias("pattern"), back.alias("back"), body.endswith("/").alias("folders_only")).filter("pattern <> ''")


def _up_to(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, 1, n), "/")


def judged(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """entry, ignored for each entry (entry, is_folder) that some rule fits."""
    parts = F.split("entry", "/")
    above = entries.select("entry", "is_folder", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"))
    seen = above.select("*", _up_to(parts, F.col("depth")).alias("folder"), F.array_join(F.slice(parts, F.col("depth") + 1, F.size(parts)), "/").alias("rest"))
    pairs = seen.join(parsed(rules), "folder").filter(F.col("is_folder") | ~F.col("folders_only")).select("entry", "depth", "line_number", "back", "rest", "pattern")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, pattern = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            yield batch.filter(pa.array([glob_regex(p).match(r) is not None for r, p in zip(rest, pattern)], pa.bool_()))

    last = pairs.mapInArrow(fits, pairs.schema).groupBy("entry").agg(F.max_by("back", F.struct("depth", "line_number")).alias("back"))
    return last.select("entry", (~F.col("back")).alias("ignored"))


def left_out(paths: DataFrame, rules: DataFrame, hidden: bool = True) -> DataFrame:
    """The distinct paths (of a column path, with slashes, below the root) that ignore files leave out.

    rules: folder ("" for the root), line_number, line.  hidden: names that begin with a dot go too, unless a rule brings them back.  Null and empty paths count for nothing.
    """
    files = paths.filter(F.length("path") > 0).select("path").distinct()
    parts = F.split("path", "/")
    way = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).select("path", _up_to(parts, F.col("n")).alias("entry"), (F.col("n") < F.size(parts)).alias("is_folder"))
    entries = way.select("entry", "is_folder").distinct()
    verdicts = entries.join(judged(entries, rules), "entry", "left")
    dotted = F.substring_index("entry", "/", -1).startswith(".") if hidden else F.lit(False)
    gone = verdicts.filter(F.coalesce("ignored", dotted)).select("entry").distinct()
    return way.join(gone, "entry", "left_semi").select("path").distinct()


def walked(paths: DataFrame, rules: DataFrame, hidden: bool = True) -> DataFrame:
    """The rows whose paths stay."""
    return paths.join(left_out(paths, rules, hidden), "path", "left_anti")

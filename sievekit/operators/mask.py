"""Masking: spans of a line merge into islands, and each island gives way to a placeholder or to its last characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions import scalars
from sievekit.functions.rules import Rule

_ISLANDS = "array<struct<start:int,stop:int>>"


def islands(spans: Column) -> Column:
    """Spans merged where they overlap or touch, by start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"))))

    def step(acc, s):
        last = F.element_at(acc, -1)
        joint = (F.size(acc) > 0) & (s["start"] <= F.when(F.size(acc) > 0, last["stop"]))
        merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(joint, merged).otherwise(F.concat(acc, F.array(s))).cast(_ISLANDS)

    return F.aggregate(ordered, F.array().cast(_ISLANDS), step)


def masked(line: Column, spans: Column, mode: str = "redact", placeholder: str = "<REDACTED>") -> Column:
    """The line with each island replaced: redact puts the placeholder, partial keeps the last four characters, plain keeps all."""
    if mode == "plain":
        return line
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        hidden = F.lit(placeholder) if mode == "redact" else scalars.partial_mask(F.substring(line, s["start"] + 1, s["stop"] - s["start"]))
        return F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(line, acc["at"] + 1, s["start"] - acc["at"]), hidden).alias("out"))

    return F.aggregate(islands(spans), state, step, lambda acc: F.concat(acc["out"], F.substring(line, acc["at"] + 1, F.length(line))))


def winners(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per island: its bounds and the placeholder of its winner (priority, then length, then the earlier start, then the later placeholder).

    spans: keys, start, stop, priority, placeholder.  Islands by a running maximum: the relational form of the merge.
    """
    ordered = Window.partitionBy(*keys).orderBy("start", "stop", "priority", "placeholder")
    before = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct("priority", F.col("stop") - F.col("start"), -F.col("start"), "placeholder")
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max_by("placeholder", best).alias("placeholder"))


def filter_lines(lines: DataFrame, rules: list[Rule], placeholder: str = "<REDACTED>", line_col: str = "line") -> DataFrame:
    """Each line with every match replaced by its island's winning placeholder; works alike on a stream.

    Neither full-width characters nor markers count here.  A rule's priority is its score, five more for log rules.
    """
    from sievekit.operators import scanner

    def word(_: str, own: list) -> str:
        best = max(own, key=lambda s: (rules[s[2]].score + (5 if rules[s[2]].id.startswith("log.") else 0), s[1] - s[0], -s[0], rules[s[2]].placeholder or placeholder))
        return rules[best[2]].placeholder or placeholder

    return scanner.rewrite(lines, rules, "", line_col, word, None, narrow=False, markers=False)


def mask_text(docs: DataFrame, rules: list[Rule], text_col: str = "text", mode: str = "redact", placeholder: str = "<REDACTED>") -> DataFrame:
    """Whole texts with masked lines, joined by \\n (an end behind the last line goes); a null text stays null.

    All happens inside a row, so nothing is shuffled and a retry gives the same rows.
    """
    from sievekit.operators import detect, scanner

    return scanner.rewrite(docs, rules, detect.MARKER, text_col, scanner.hiding(mode, placeholder))


def add_markers(lines: DataFrame, hits: DataFrame, keys: list[str], extension: str, marker: str) -> DataFrame:
    """Lines with a hit get an ignore marker as a comment of their kind of file, unless they have one."""
    prefix = "//" if extension in ("rs", "go", "js", "ts", "tsx", "jsx", "java", "c", "cpp", "h", "swift", "kt", "scala") else "#"
    flagged = hits.select(*keys, "line_number").distinct().withColumn("__hit", F.lit(True))
    joined = lines.join(flagged, [*keys, "line_number"], "left")
    fresh = F.col("__hit") & ~F.contains("line", F.lit(marker))
    return joined.withColumn("line", F.when(fresh, F.concat("line", F.lit(f" {prefix} {marker}"))).otherwise(F.col("line"))).drop("__hit")


# How a line of a file is marked, by the ending of the file's name.
FIX_ENDINGS = {"//": ("rs", "js", "ts", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp"), "#": ("py", "rb", "sh", "yaml", "yml", "toml")}


def fixed_texts(docs: DataFrame, hits: DataFrame, marker: str, text_col: str = "text") -> DataFrame:
    """path, text, changed: the texts (path once each, text) of which some line was hit (path, line_number from 1) and got its marker.

    A line that has a marker already keeps it; files of other endings stay out, and a text in which nothing changes isn't returned.
    Ends of lines become \\n, and an end behind the last line stays.  Only paths and line numbers are grouped; a path has no more of them than lines.
    """
    ending = F.regexp_extract("path", r"[^/.][^/]*\.([^./]+)$", 1)
    sign = F.coalesce(*(F.when(ending.isin(*own), F.lit(s)) for s, own in FIX_ENDINGS.items()))

    @F.pandas_udf("text string, changed int")
    def fix(texts: pd.Series, numbers: pd.Series, signs: pd.Series) -> pd.DataFrame:
        out = []
        for text, at, own in zip(texts, numbers, signs, strict=True):
            lines, changed = [x.removesuffix("\r") for x in text.split("\n")], 0
            for n in at:
                if n <= len(lines) and marker not in lines[n - 1]:
                    lines[n - 1] += f" {own} {marker}"
                    changed += 1
            out.append(("\n".join(lines), changed))
        return pd.DataFrame(out, columns=["text", "changed"])

    numbers = hits.groupBy("path").agg(F.collect_set("line_number").alias("__numbers"))
    known = docs.select("path", F.col(text_col).alias("__text"), sign.alias("__sign")).filter("__sign is not null and __text is not null")
    return known.join(numbers, "path").select("path", fix("__text", "__numbers", "__sign").alias("f")).select("path", "f.text", "f.changed").filter("changed > 0")

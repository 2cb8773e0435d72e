"""Edits that an editor offers for findings: mask the value, mask a part of it, or mark the line as looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions import scalars
from sievekit.operators.detect import MARKER

# How comments are written, by language and by ending; formats without comments aren't listed.
LANGUAGES = {
    "//": ("rust", "go", "javascript", "javascriptreact", "typescript", "typescriptreact", "java", "c", "cpp", "objective-c", "objective-cpp"),
    "#": ("python", "ruby", "shellscript", "yaml", "toml"),
    "<!--": ("html", "xml"),
    "--": ("sql",),
}
ENDINGS = {
    "//": ("rs", "go", "js", "jsx", "ts", "tsx", "java", "c", "cc", "cpp", "cxx", "h", "hpp", "m", "mm"),
    "#": ("py", "rb", "sh", "bash", "zsh", "yml", "yaml", "toml"),
    "<!--": ("html", "htm", "xml", "svg"),
    "--": ("sql",),
}
_CLOSE = {"<!--": " -->"}


def comment(path: Column, language: Column | None = None) -> Column:
    """What begins a comment in a file: by its language, else by the ending of its name; null where there is none."""
    ending = F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)
    by_ending = F.coalesce(*(F.when(ending.isin(*own), F.lit(sign)) for sign, own in ENDINGS.items()))
    if language is None:
        return by_ending
    return F.coalesce(*(F.when(language.isin(*own), F.lit(sign)) for sign, own in LANGUAGES.items()), by_ending)


def ignore_text(sign: Column, rule_id: Column, marker: str = MARKER) -> Column:
    """The comment that takes a line out of a rule, as it goes to the line's end; null without a sign."""
    close = F.lit("")
    for open_, end in _CLOSE.items():
        close = F.when(sign == open_, end).otherwise(close)
    return F.concat(F.lit(" "), sign, F.lit(f" {marker}="), rule_id, close)


def code_actions(findings: DataFrame, language: str | None = None, placeholder: str = "<REDACTED>", marker: str = MARKER) -> DataFrame:
    """path, rule_id, line (from 0), start, end (UTF-16 units), title, new_text, preferred: up to three rows a finding.

    A value that is the placeholder already or empty isn't masked; a line that holds the marker, or a file without comments, gets no comment.
    The comment goes to the end of the line, which is taken without its line break.  `line` is the finding's whole line.
    """
    value, open_ = F.col("matched_content"), (F.col("matched_content") != "") & (F.col("matched_content") != placeholder)
    part = scalars.partial_mask(value)
    text = ignore_text(comment(F.col("path"), F.col(language) if language else None), F.col("rule_id"), marker)
    end = scalars.utf16_before(F.col("line"), F.length("line"))
    edit = lambda title, start, stop, new, preferred: F.struct(F.lit(title).alias("title"), start.cast("long").alias("start"), stop.cast("long").alias("end"), new.alias("new_text"), F.lit(preferred).alias("preferred"))
    offered = F.array(
        F.when(open_, edit("Mask value", F.col("utf16_start"), F.col("utf16_end"), F.lit(placeholder), True)),
        F.when(open_ & (part != value), edit("Partial mask", F.col("utf16_start"), F.col("utf16_end"), part, False)),
        F.when(text.isNotNull() & ~F.contains("line", F.lit(marker)), edit("Add inline ignore", end, end, text, False)),
    )
    each = findings.select("path", "rule_id", (F.col("line_number") - 1).alias("at"), F.explode(F.array_compact(offered)).alias("e"))
    return each.select("path", "rule_id", F.col("at").alias("line"), "e.start", "e.end", "e.title", "e.new_text", "e.preferred")

"""Detection: lines against rules, as one unrolled expression per rule over a single scan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions import scalars, validators
from sievekit.functions.rules import Rule, required_words, spark_pattern

#: Text in a line that keeps it from being reported: "# marker", "// marker", or "marker=<rule id>" for one rule.
MARKER = "sieve:ignore"

_WIDE = "[" + scalars.WIDE + "]"
_FOUND = "array<struct<rule:int,start:int,stop:int,hit:string>>"
# Words that show that digits are something else.
_MYNUMBER_WORDS = r"注文番号|受付番号|伝票番号|(?i:order|order_id|receipt|ticket)"
_VERSION_WORDS = r"(バージョン|(?<![0-9A-Za-z_])(?i:version|build|release|rev|commit))[\s:=\-：＝]*$"


def ignored(line: Column, rule_id: str, marker: str = MARKER) -> Column:
    """Whether the line opts out of the rule.  An id also opts out of every id that begins it, as the test is a substring's."""
    generic = (F.contains(line, F.lit(f"# {marker}")) | F.contains(line, F.lit(f"// {marker}"))) & ~F.contains(line, F.lit(f"{marker}="))
    return F.contains(line, F.lit(marker)) & (F.contains(line, F.lit(f"{marker}={rule_id}")) | generic)


def suppressed(rule_id: str, text: Column, start: Column, stop: Column) -> Column | None:
    """Whether what surrounds a match shows that it is something else; None where the rule has no such test."""
    if rule_id == "pii.jp.mynumber.unlabeled":
        from_ = F.greatest(F.lit(0), start - 24)
        return F.substring(text, from_ + 1, stop + 16 - from_).rlike(_MYNUMBER_WORDS)
    if rule_id == "pii.jp.postal_code":
        return F.left(text, start).rlike(_VERSION_WORDS)
    return None


_BY_FUNCTION = {"luhn": validators.luhn, "jp_address_prefecture_city_block": validators.address, "jp_person_name_keyword": validators.person_name}


def _likely(rule: Rule, text: Column) -> Column:
    """Whether the rule's pattern is in a text: first its literals, then the pattern."""
    found = text.rlike(spark_pattern(rule.pattern))
    words = required_words(rule.pattern)
    return scalars.contains_any(text, words) & found if len(words) > 1 else F.contains(text, F.lit(words[0])) & found if words else found


def wanted(rules: list[Rule], narrow: bool = True) -> Callable[[Column], Column]:
    """A test of lines: whether the pattern of any enabled rule is in a line, narrowed where the rule reads it so."""
    chosen = [r for r in rules if r.enabled]
    wide = [r for r in chosen if narrow and r.normalises]

    def test(line: Column) -> Column:
        out = F.lit(False)
        for rule in chosen:
            out = out | _likely(rule, line)
        if wide:
            narrowed = scalars.normalise(line)
            more = F.lit(False)
            for rule in wide:
                more = more | _likely(rule, narrowed)
            out = out | (line.rlike(_WIDE) & more)
        return out

    return test


def _matches(rule: Rule, k: int, text: Column) -> Column:
    """The rule's matches in a text that pass its context test and its validator, if SQL expresses that."""
    found = F.when(_likely(rule, text), scalars.spans(text, spark_pattern(rule.pattern))).otherwise(F.array().cast("array<struct<start:int,stop:int,hit:string>>"))
    if suppressed(rule.id, text, F.lit(0), F.lit(0)) is not None:
        found = F.filter(found, lambda s: ~suppressed(rule.id, text, s["start"], s["stop"]))
    if rule.validator and rule.validator not in _BY_FUNCTION:
        found = F.filter(found, lambda s: validators.valid(rule.validator, s["hit"]))
    return F.transform(found, lambda s: F.struct(F.lit(k).alias("rule"), s["start"].alias("start"), s["stop"].alias("stop"), s["hit"].alias("hit"))).cast(_FOUND)


def _beyond(more: Column, known: Column) -> Column:
    """Spans that are not among the known ones."""
    return F.filter(more, lambda m: ~F.exists(known, lambda s: (s["start"] == m["start"]) & (s["stop"] == m["stop"])))


def matches(line: Column, rules: list[Rule], marker: str = MARKER, narrow: bool = True, markers: bool = True) -> Column:
    """array<struct<rule, start, stop, hit>>: all matches of all enabled rules in a line; rule is the place in the list.

    Rules of Japanese data also read the line with full-width characters narrowed; as that keeps the number of characters,
    places stay; a span that both find counts once.  Validators that SQL can't express are left to with_matches.
    """
    parts = []
    narrowed = scalars.normalise(line)
    for k, rule in enumerate(rules):
        if not rule.enabled:
            continue
        found = _matches(rule, k, line)
        if narrow and rule.normalises:
            more = F.when(line != narrowed, _matches(rule, k, narrowed)).otherwise(F.array().cast(_FOUND))
            found = F.concat(found, _beyond(more, found))
        if markers:
            found = F.when(ignored(line, rule.id, marker), F.array().cast(_FOUND)).otherwise(found)
        parts.append(found)
    return F.concat(*parts) if parts else F.array().cast(_FOUND)


def with_matches(lines: DataFrame, rules: list[Rule], column: str = "__found", line_col: str = "line", **options) -> DataFrame:
    """The lines with a column of their matches.

    Matches whose validator is a function go through it in one Arrow-batched call for each line that has any, after all else.
    """
    out = lines.withColumn(column, matches(F.col(line_col), rules, **options))
    checks = {k: _BY_FUNCTION[r.validator] for k, r in enumerate(rules) if r.enabled and r.validator in _BY_FUNCTION}
    if not checks:
        return out

    @F.pandas_udf("array<boolean>")
    def fits(found: pd.Series) -> pd.Series:
        return found.map(lambda row: [m["rule"] not in checks or checks[m["rule"]](m["hit"]) for m in row])

    fits = fits.asNondeterministic()  # so that it is not copied into the expressions that use it
    # only lines with such a match go to Python: the rest keep their matches
    asks = F.exists(column, lambda m: m["rule"].isin(*checks))
    out = out.withColumn("__asked", F.when(asks, F.col(column)).otherwise(F.array().cast(_FOUND))).withColumn("__fits", fits("__asked"))
    kept = F.transform(F.filter(F.arrays_zip(column, "__fits"), lambda z: z["__fits"]), lambda z: z[column])
    return out.withColumn(column, F.when(asks, kept).otherwise(F.col(column))).drop("__asked", "__fits")


def fitting(rows: DataFrame, rules: list[Rule], column: str) -> DataFrame:
    """The rows with an array of lines' matches, without those that their rule's function rejects."""
    checks = {k: _BY_FUNCTION[r.validator] for k, r in enumerate(rules) if r.enabled and r.validator in _BY_FUNCTION}
    if not checks:
        return rows

    @F.pandas_udf("array<array<boolean>>")
    def fits(found: pd.Series) -> pd.Series:
        return found.map(lambda lines: lines if lines is None else [[m["rule"] not in checks or checks[m["rule"]](m["hit"]) for m in line] for line in lines])

    fits = fits.asNondeterministic()
    both = F.zip_with(column, "__fits", lambda line, ok: F.transform(F.filter(F.arrays_zip(line.alias("m"), ok.alias("ok")), lambda z: z["ok"]), lambda z: z["m"]))
    return rows.withColumn("__fits", fits(column)).withColumn(column, both).drop("__fits")


def numbered_lines(docs: DataFrame, text_col: str = "text", context: int = 5, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows once for each line, with line_number from 1, line, and context_before: up to `context` lines before it.

    keep: which lines are wanted (all, if None); the others never become rows.  Each line gets its own few lines of context before
    it becomes a row, so no row carries a text's whole array, and nothing is shuffled.
    """
    rest = [c for c in docs.columns if c != text_col]
    split = docs.select(*rest, scalars.lines(F.col(text_col)).alias("__lines"))
    each = F.transform("__lines", lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    if keep is not None:
        each = F.filter(each, lambda r: keep(r["line"]))
    none = F.array().cast("array<string>")

    def whole(r):
        before = F.slice("__lines", F.greatest(F.lit(1), r["pos"] - context + 1), F.least(F.lit(context), r["pos"]))
        return F.struct(r["pos"].alias("pos"), r["line"].alias("line"), F.when(r["pos"] > 0, before).otherwise(none).alias("before") if context else none.alias("before"))

    rows = split.select(*rest, F.explode(F.transform(each, whole)).alias("__row"))
    return rows.select(*rest, (F.col("__row.pos") + 1).cast("long").alias("line_number"), F.col("__row.line").alias("line"), F.col("__row.before").alias("context_before"))


def _of_rule(rules: list[Rule], value, kind: str) -> Column:
    """A literal array with a value for each rule, looked up by place."""
    return F.element_at(F.array(*(F.lit(value(r)).cast(kind) for r in rules)).cast(f"array<{kind}>"), F.col("m.rule") + 1)


def findings(lines: DataFrame, rules: list[Rule], mode: str = "redact", placeholder: str = "<REDACTED>", marker: str = MARKER) -> DataFrame:
    """A row for each match: the line's columns, and rule_id, places, matched text, masked line, severity, score, grade.

    All matches of a line are masked in its snippet.  lines: any columns, line_number, line, context_before.
    """
    from sievekit.operators.mask import masked

    hit = with_matches(lines, rules, marker=marker).filter(F.size("__found") > 0)
    hit = hit.withColumn("masked_snippet", masked(F.col("line"), F.col("__found"), mode, placeholder))
    placed = F.transform("__found", lambda m: F.struct(m["rule"].alias("rule"), scalars.bytes_before(F.col("line"), m["start"]).alias("byte_start"), scalars.bytes_before(F.col("line"), m["stop"]).alias("byte_end"), scalars.utf16_before(F.col("line"), m["start"]).alias("utf16_start"), scalars.utf16_before(F.col("line"), m["stop"]).alias("utf16_end"), F.substring("line", m["start"] + 1, m["stop"] - m["start"]).alias("hit")))
    return described(hit.withColumn("found", placed).drop("__found"), rules)


def described(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each match of lines with their matches (scanner.scan_lines), with what its rule and its surroundings say.

    What is near a line is looked at once for each number of lines of context that a rule asks for; then matches become rows, with only
    the columns that are asked for.
    """
    wide = sorted({r.context_lines_before for r in rules})

    def before(n: int) -> Column:
        return F.slice("context_before", F.greatest(F.lit(1), F.size("context_before") - n + 1), n) if n else F.array().cast("array<string>")

    contexts = F.array(*map(before, wide)) if wide else F.array(F.array().cast("array<string>"))
    near = F.transform(contexts, lambda c: scalars.nearby(F.concat_ws("\n", F.col("line"), F.concat_ws("\n", c), F.lit(""))))
    each = lines.withColumn("__contexts", contexts).withColumn("__near", near)
    each = each.select(*[c for c in each.columns if c != "found"], F.explode("found").alias("m"))
    which = _of_rule(rules, lambda r: wide.index(r.context_lines_before) + 1, "int")
    tags = F.element_at(F.array(*(F.array(*(F.lit(t) for t in r.tags)).cast("array<string>") for r in rules)).cast("array<array<string>>"), F.col("m.rule") + 1)
    weighted = _of_rule(rules, lambda r: r.base + sum(scalars.TAG_WEIGHTS.get(t, 0) for t in set(r.tags)), "int")
    out = each.withColumn("context_before", F.element_at("__contexts", which))
    return out.select(
        *[c for c in out.columns if c not in ("m", "__contexts", "__near")],
        _of_rule(rules, lambda r: r.id, "string").alias("rule_id"),
        F.col("m.hit").alias("matched_content"),
        *(F.col(f"m.{c}").alias(c) for c in ("byte_start", "byte_end", "utf16_start", "utf16_end")),
        _of_rule(rules, lambda r: r.severity, "string").alias("severity"),
        F.greatest(F.lit(0), F.least(F.lit(100), weighted + F.element_at("__near", which))).cast("int").alias("score"),
        _of_rule(rules, lambda r: r.category, "string").alias("category"),
        tags.alias("tags"),
    ).withColumn("grade", scalars.grade(F.col("score")))


def scan_texts(docs: DataFrame, rules: list[Rule], text_col: str = "text", mode: str = "redact", placeholder: str = "<REDACTED>", marker: str = MARKER, **options) -> DataFrame:
    """Findings of whole texts, by all rules in one pass (scanner).  Rules without any match cost what searching for their words costs."""
    from sievekit.operators import scanner

    return described(scanner.scan_lines(docs, rules, marker, text_col, mode=mode, placeholder=placeholder, **options), rules)

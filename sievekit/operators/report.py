"""Summaries, gates and printed forms of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.rules import SEVERITIES, severity_rank
from sievekit.functions.scalars import SCORE_FLOORS, html_escape


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, k: int = 3) -> DataFrame:
    return rule_counts(findings).orderBy(F.desc("n"), "rule_id").limit(k)


def score_label(score: Column) -> Column:
    return F.when(score >= 90, "Critical").when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")


def score_buckets(findings: DataFrame) -> DataFrame:
    return findings.groupBy(score_label(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


def evidence_summary(findings: DataFrame) -> DataFrame:
    """One row: totals, suppressed and effective ones, each by severity with zeros."""
    sides = {"total": F.lit(True), "suppressed": F.col("baseline_status") == "suppressed", "effective": F.col("baseline_status") != "suppressed"}
    out = []
    for name, chosen in sides.items():
        out.append(F.count_if(chosen).alias(name))
        out += [F.count_if(chosen & (F.col("severity") == s)).alias(f"{name}_{s.lower()}") for s in SEVERITIES]
    return findings.agg(*out)


def breakdown(findings: DataFrame, prefix: Column) -> DataFrame:
    return findings.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("total"), F.count_if(F.col("baseline_status") == "new").alias("new"))


def rule_breakdown(findings: DataFrame) -> DataFrame:
    """How many findings each rule has, and how many of them the baseline doesn't know."""
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("total"), F.count_if(F.col("baseline_status") == "new").alias("new"))


def top_new(findings: DataFrame, most: int = 50, budget: int = 16_384) -> DataFrame:
    """The new findings that a summary names: the severest first, at most `most`, for as long as their sizes stay within `budget` bytes.

    place counts from 1, bytes are those of all so far, and truncated says whether new findings are left out.  Ties go by score, path, place and rule, so what is named is
    fixed.  Only the first `most` rows meet in one task, whatever the number of findings; `most` is a bound of the report.
    """
    new = findings.filter("baseline_status = 'new'")
    order = (F.desc(severity_rank(F.col("severity"))), F.desc("score"), "path", "line_number", "byte_start", "rule_id")
    size = F.octet_length(F.concat("fingerprint", "rule_id", "severity", "path")) + F.length(F.col("line_number").cast("string"))
    first = new.orderBy(*order).limit(most)
    ordered = Window.orderBy(*order)  # over the first rows alone
    placed = first.withColumn("place", F.row_number().over(ordered)).withColumn("bytes", F.sum(size.cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    kept = placed.filter(F.col("bytes") <= budget)
    every = new.agg(F.count("*").alias("__new"))
    named = F.count("*").over(Window.partitionBy(F.lit(0)))
    return kept.withColumn("__named", named).join(F.broadcast(every)).select("place", "fingerprint", "rule_id", "severity", "path", F.col("line_number").alias("line_start"), "bytes", (F.col("__named") < F.col("__new")).alias("truncated"))  # every is one row


def policy(findings: DataFrame, max_new: int | None = None, severity: str | None = None, min_score: int | None = None) -> DataFrame:
    """One row: how many, the highest score, and whether a given threshold is reached (without one: whether there is any).

    A severity is a floor on the score, not a match of the label.
    """
    facts = findings.agg(F.count("*").alias("n"), F.coalesce(F.max("score"), F.lit(0)).alias("max_score"))
    tests = [F.col("n") >= max_new] if max_new is not None else []
    tests += [F.col("max_score") >= floor for floor in ([SCORE_FLOORS[severity]] if severity else []) + ([min_score] if min_score is not None else [])]
    broken = F.lit(False)
    for test in tests:
        broken = broken | test
    return facts.withColumn("violated", broken if tests else F.col("n") > 0)


def exit_status(incomplete: Column, violated: Column) -> Column:
    return F.when(incomplete, 2).when(violated, 1).otherwise(0)


def limit_reasons(flags: dict[str, Column]) -> Column:
    """The names of the flags that are set, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))))


def lines_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(F.array_sort(F.collect_set("line_number")).alias("lines"))


def text_lines(findings: DataFrame) -> DataFrame:
    """[GRADE] [severity] (score) [rule] path:line snippet"""
    return findings.select(F.format_string("[%s] [%s] (%d) [%s] %s:%d %s", F.upper("grade"), "severity", "score", "rule_id", "path", "line_number", "masked_snippet").alias("text"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    cells = [F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")) for c in ("severity", "score", "rule_id", "path", "line_number", "masked_snippet")]
    return findings.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def html_rows(findings: DataFrame) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), html_escape(F.col(c).cast("string")), F.lit("</td>")) for c in ("severity", "score", "rule_id", "path", "line_number", "masked_snippet")]
    return findings.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Places in UTF-16 units from line 0, severity 1 (error) to 3, and nothing unmasked."""
    level = F.when(F.col("severity").isin("Critical", "High"), 1).when(F.col("severity") == "Medium", 2).otherwise(3)
    return findings.select("path", (F.col("line_number") - 1).alias("line"), "utf16_start", "utf16_end", level.alias("severity"), F.col("rule_id").alias("code"))


def first_bytes(findings: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """The first rows whose sizes stay within a budget, in a fixed order of each path."""
    running = F.sum(size).over(Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return findings.withColumn("__running", running).filter(F.col("__running") <= budget).drop("__running")


def consistent(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each number of a stored summary that the findings don't bear out."""
    names = [c for c in summary.columns]
    again = evidence_summary(findings).select(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("long") for c in names))).alias("now"))
    said = summary.select(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("long") for c in names))).alias("said"))
    both = again.join(F.broadcast(said))  # one row on either side
    return both.select(F.explode(F.array(*map(F.lit, names))).alias("name"), "now", "said").filter(F.col("now")[F.col("name")] != F.col("said")[F.col("name")]).select("name")


def json_rows(findings: DataFrame, columns: tuple[str, ...] = ("path", "line_number", "rule_id", "severity", "score", "masked_snippet")) -> DataFrame:
    """A JSON object for each finding, as the report's list holds them; only new findings are reported."""
    return findings.filter("baseline_status = 'new'").select(F.to_json(F.struct(*columns)).alias("json"))


def json_head(summary: DataFrame, schema: str = "sieve-v1") -> DataFrame:
    """What stands before the list: the schema's version and the summary, from a table of one row."""
    return summary.select(F.concat(F.lit('{"schemaVersion":"' + schema + '","summary":'), F.to_json(F.struct(*summary.columns)), F.lit(',"findings":[')).alias("json"))


def write_json(findings: DataFrame, summary: DataFrame, path: str) -> None:
    """A folder whose files, by name, are one JSON document: the head, findings in a fixed order with commas between, the end.

    Findings are sorted over many files; no task and no driver holds them all.
    """
    order = [c for c in ("path", "line_number", "rule_id", "masked_snippet") if c in findings.columns]
    rows = findings.filter("baseline_status = 'new'").orderBy(*order).select(F.concat(F.to_json(F.struct("path", "line_number", "rule_id", "severity", "score", "masked_snippet")), F.lit(",")).alias("json"))
    json_head(summary).coalesce(1).write.text(f"{path}/0-head")
    rows.write.text(f"{path}/1-findings")
    summary.select(F.lit("null]}").alias("json")).coalesce(1).write.text(f"{path}/2-end")


def _head_facts(findings: DataFrame, k: int = 3) -> DataFrame:
    """One row: n, new, how many of each bucket by score, and the k rules with most findings, as an array."""
    labels = ("Critical", "High", "Medium", "Low")
    counts = findings.agg(F.count("*").alias("n"), F.count_if(F.col("baseline_status") == "new").alias("new"), *(F.count_if(score_label(F.col("score")) == s).alias(s) for s in labels))
    top = top_rules(findings, k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("__by"), "rule_id", "n"))).alias("top"))
    return counts.join(F.broadcast(top))  # one row on either side


HTML_END = "</tbody></table></body></html>"


def _one(findings: DataFrame, text: str) -> DataFrame:
    return findings.sparkSession.range(1).select(F.lit(text).alias("text"))


def _page(head: DataFrame, rows: DataFrame, end: DataFrame) -> DataFrame:
    """section (0: head, 1: findings, 2: end) and text."""
    parts = [part.select(F.lit(k).alias("section"), F.col(part.columns[0]).alias("text")) for k, part in enumerate((head, rows, end))]
    return parts[0].union(parts[1]).union(parts[2])


def markdown_head(findings: DataFrame, title: str = "Sensitive data report") -> DataFrame:
    """What stands above the rows: title, numbers, rules with most findings, the table's header; without findings a sentence that says so."""
    top = F.array_join(F.transform("top", lambda r: F.concat(F.lit("- "), F.replace(r["rule_id"], F.lit("|"), F.lit("\\|")), F.lit(" ("), r["n"].cast("string"), F.lit(")\n"))), "")
    said = F.concat(F.lit(f"# {title}\n\n## Summary\n\n**Findings**: "), F.col("n").cast("string"), F.lit(" total, "), F.col("new").cast("string"), F.lit(" new\n"))
    table = F.concat(F.lit("\n"), top, F.lit("\n## Findings\n\n| Severity | Score | Rule ID | File | Line | Match |\n|---|---|---|---|---|---|"))
    return _head_facts(findings).select(F.concat(said, F.when(F.col("n") == 0, "\nNo sensitive data found.").otherwise(table)).alias("text"))


def markdown_page(findings: DataFrame) -> DataFrame:
    """A whole page as rows; write_page writes them in order."""
    return _page(markdown_head(findings), markdown_rows(findings), _one(findings, ""))


def html_head(findings: DataFrame, title: str = "Sensitive data report") -> DataFrame:
    """The page up to its rows: buckets by score, and the three rules with most findings."""
    buckets = F.concat_ws(" / ", *(F.concat(F.lit(f"{s.upper()}: "), F.col(s).cast("string")) for s in ("Critical", "High", "Medium", "Low")))
    top = F.array_join(F.transform("top", lambda r: F.concat(F.lit("<li>"), html_escape(r["rule_id"]), F.lit(" ("), r["n"].cast("string"), F.lit(")</li>"))), "")
    cells = "".join(f"<th>{c}</th>" for c in ("Severity", "Score", "Rule", "File", "Line", "Match"))
    opening = F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p>')
    return _head_facts(findings).select(F.concat(opening, F.col("n").cast("string"), F.lit(" findings: "), buckets, F.lit("</p><ul>"), top, F.lit(f"</ul><table><thead><tr>{cells}</tr></thead><tbody>")).alias("text"))


def html_page(findings: DataFrame) -> DataFrame:
    """A whole page as rows, suppressed findings among them."""
    return _page(html_head(findings), html_rows(findings), _one(findings, HTML_END))


def write_page(findings: DataFrame, path: str, form: str = "html") -> None:
    """A folder whose files, by name, are one page: the head, the findings in a fixed order over many files, the end."""
    head, rows = (html_head, html_rows) if form == "html" else (markdown_head, markdown_rows)
    order = [c for c in ("path", "line_number", "rule_id", "masked_snippet") if c in findings.columns]
    head(findings).coalesce(1).write.text(f"{path}/0-head")
    rows(findings.orderBy(*order)).write.text(f"{path}/1-findings")
    _one(findings, HTML_END if form == "html" else "").coalesce(1).write.text(f"{path}/2-end")


def table_rows(findings: DataFrame) -> DataFrame:
    """Columns of fixed width, with the masked line and never the match."""
    wide = lambda c, n: F.rpad(F.col(c).cast("string"), n, " ")
    return findings.select(F.concat_ws(" ", wide("severity", 8), F.lpad(F.col("score").cast("string"), 3, " "), wide("rule_id", 30), F.concat_ws(":", "path", "line_number"), "masked_snippet").alias("row"))


def shown(findings: DataFrame, severities: tuple[str, ...], search: str) -> DataFrame:
    """What a reader of the page filters for: severities by score, and a part of rule and path in any case."""
    return findings.filter(score_label(F.col("score")).isin(*severities) & F.contains(F.lower(F.concat_ws(" ", "rule_id", "path")), F.lit(search.lower())))

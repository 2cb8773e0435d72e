"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.functions import scalars as S
from sievekit.functions.rules import Rule
from sievekit.operators import deps, detect, findings, mask, metrics, report
from sievekit.plans import sql
from sievekit.sources import readers, shared
from sievekit.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The packs with which detection runs, and the rules that have a query of their own over documents and pages.
RULES = [*R.builtin("pii"), *R.builtin("creds")]
LOG_RULES = list(R.builtin("log"))
_SINGLE = ("pii.net.email", "pii.net.ipv4", "pii.jp.postal_code", "pii.pay.token.keyword", "pii.device.mac", "pii.crypto.eth_address.keyword", "creds.aws.access_key_id", "creds.github.pat.ghp")


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries have the name {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table_texts(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table_texts(table(spark, sf_dir, "pages"), F.col("url"), "html")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.with_fingerprint(detect.scan_texts(documents(spark, sf_dir), RULES))


_IDENTITY = ("path", "line_number", "byte_start", "byte_end", "rule_id", "severity", "score", "masked_snippet", "fingerprint")


def with_baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All findings, written once, and those of even documents as a baseline for all."""
    every = shared.save(found(spark, sf_dir).select(*_IDENTITY), "findings")
    return every, findings.baseline_entries(every.filter(F.col("path").cast("long") % 2 == 0))


FOUND = sql.findings(RULES)
STATUS = FOUND + ", known AS (SELECT DISTINCT fingerprint FROM graded WHERE CAST(path AS BIGINT) % 2 = 0), stated AS (SELECT graded.*, CASE WHEN known.fingerprint IS NULL THEN 'new' ELSE 'suppressed' END AS baseline_status FROM graded LEFT JOIN known USING (fingerprint))"

# ---- Lines and spans ---------------------------------------------------------------------------


@query("lines_explode", "WITH " + sql.lines() + " SELECT path, CAST(line_number AS BIGINT) AS line_number, line FROM lines")
def _(spark, sf_dir):
    return detect.numbered_lines(documents(spark, sf_dir)).select("path", "line_number", "line")


@query("size_class", "SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN 'BINARY_FILE' WHEN strlen(text) > 5000 THEN 'MAX_FILE_SIZE' END AS skipped FROM documents")
def _(spark, sf_dir):
    content = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", readers.skip_reason(content, F.octet_length(content), 5000).alias("skipped"))


@query("blob_classes", "SELECT doc_id, strlen(text) AS size FROM documents WHERE doc_id % 3 <> 0 AND strlen(text) <= 1000000")
def _(spark, sf_dir):
    state = F.when(F.col("doc_id") % 3 == 0, "D").when(F.col("doc_id") % 3 == 1, "A").otherwise("M")
    commits = table(spark, sf_dir, "documents").select("doc_id", state.alias("status"), F.col("text").cast("binary").alias("content"))
    return readers.blobs(commits).filter("skipped is null").select("doc_id", F.octet_length("text").cast("long").alias("size"))


_TAILS = "(SELECT path, line || CASE line_number % 4 WHEN 0 THEN chr(9) WHEN 1 THEN chr(32) || chr(13) WHEN 2 THEN chr(12288) ELSE '' END AS line FROM lines UNION ALL SELECT path, chr(9) AS line FROM lines WHERE line_number = 1)"


@query("diff_lines", "WITH " + sql.lines() + f" SELECT path, regexp_replace(line, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+$', '') AS line, CAST(1 AS BIGINT) AS line_number FROM {_TAILS} WHERE regexp_replace(line, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+$', '') <> ''")
def _(spark, sf_dir):
    """Lines of documents with white space of several kinds behind them, and lines of a tab alone."""
    lines = detect.numbered_lines(documents(spark, sf_dir))
    tail = F.when(F.col("line_number") % 4 == 0, "\t").when(F.col("line_number") % 4 == 1, " \r").when(F.col("line_number") % 4 == 2, "\u3000").otherwise("")
    tails = lines.withColumn("line", F.concat("line", tail)).union(lines.filter("line_number = 1").withColumn("line", F.lit("\t")))
    return readers.diff_lines(tails).select("path", "line", "line_number")


def _rule_hits(rule: Rule, source: str) -> None:
    columns = ("documents", "CAST(doc_id AS VARCHAR)", "text") if source == "documents" else ("pages", "url", "html")
    name = f"rule_hits_{rule.id.split('.', 1)[1].replace('.', '_')}_{source}"

    @query(name, sql.findings([rule], *columns) + " SELECT path, line_number, matched_content FROM graded")
    def _(spark, sf_dir):
        docs = documents(spark, sf_dir) if source == "documents" else pages(spark, sf_dir)
        return detect.scan_texts(docs, [rule]).select("path", "line_number", "matched_content")


for _one in (r for r in RULES if r.id in _SINGLE):
    for _source in ("documents", "pages"):
        _rule_hits(_one, _source)


@query("spans_byte_offsets", FOUND + " SELECT path, line_number, rule_id, byte_start, byte_end FROM graded")
def _(spark, sf_dir):
    return found(spark, sf_dir).select("path", "line_number", "rule_id", "byte_start", "byte_end")


@query("utf16_ranges", FOUND + " SELECT path, line_number, rule_id, utf16_start, utf16_end FROM graded")
def _(spark, sf_dir):
    return found(spark, sf_dir).select("path", "line_number", "rule_id", "utf16_start", "utf16_end")


_WIDE_ROWS = "(1, '個人番号：１２３４－５６７８－９０１２'), (2, '１２３４－５６７８ー９０１２'), (3, 'ＡＢＣ　（ｘ）'), (4, 'plain')"


@query("jp_normalize", f"SELECT id, translate(t, {sql.quoted(S.WIDE)}, {sql.quoted(S.NARROW)}) AS narrowed, t <> translate(t, {sql.quoted(S.WIDE)}, {sql.quoted(S.NARROW)}) AS changed FROM (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT -i, t FROM (VALUES {_WIDE_ROWS}) v(i, t))")
def _(spark, sf_dir):
    more = spark.sql(f"SELECT CAST(-i AS BIGINT) AS id, t FROM VALUES {_WIDE_ROWS} AS v(i, t)")
    every = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).union(more)
    return every.select("id", S.normalise(F.col("t")).alias("narrowed"), (F.col("t") != S.normalise(F.col("t"))).alias("changed"))


_DIGITS = "regexp_extract_all(text, '[0-9]{13,19}')"


@query("validator_luhn_digits", f"""WITH runs AS (SELECT doc_id, unnest({_DIGITS}) AS d FROM documents), digits AS (SELECT doc_id, d, unnest(range(1, len(string_split(reverse(d), '')) + 1)) AS i, CAST(unnest(string_split(reverse(d), '')) AS INT) AS x FROM runs)
SELECT doc_id, d, sum(CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END) % 10 = 0 AS valid FROM digits GROUP BY doc_id, d""")
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("d")).distinct()
    return runs.select("doc_id", "d", S.luhn_digits(F.col("d")).alias("valid"))


@query("context_before_window", "WITH " + sql.lines() + " SELECT path, CAST(line_number AS BIGINT) AS line_number, array_to_string(ls[greatest(1, line_number - 5):line_number - 1], '|') AS context FROM lines")
def _(spark, sf_dir):
    return detect.numbered_lines(documents(spark, sf_dir)).select("path", "line_number", F.array_join("context_before", "|").alias("context"))


# ---- Findings ------------------------------------------------------------------------------------


@query("findings", FOUND + " SELECT path, line_number, rule_id, matched_content, masked_snippet, severity, score, grade, fingerprint FROM graded")
def _(spark, sf_dir):
    return found(spark, sf_dir).select("path", "line_number", "rule_id", "matched_content", "masked_snippet", "severity", "score", "grade", "fingerprint")


@query("findings_whole_pack", sql.findings([*RULES, *LOG_RULES]) + " SELECT path, line_number, rule_id, masked_snippet, severity, score, grade FROM graded")
def _(spark, sf_dir):
    return detect.scan_texts(documents(spark, sf_dir), [*RULES, *LOG_RULES]).select("path", "line_number", "rule_id", "masked_snippet", "severity", "score", "grade")


@query("score_grade", FOUND + " SELECT rule_id, score, grade, count(*) AS n FROM graded GROUP BY ALL")
def _(spark, sf_dir):
    return found(spark, sf_dir).groupBy("rule_id", "score", "grade").agg(F.count("*").alias("n"))


@query("strict_grade", "SELECT doc_id, CASE WHEN n_chars % 101 < 10 THEN 'Safe' WHEN n_chars % 101 < 40 THEN 'Low' WHEN n_chars % 101 < 70 THEN 'Medium' WHEN n_chars % 101 < 90 THEN 'High' ELSE 'Critical' END AS grade FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.strict_grade(F.col("n_chars") % 101).alias("grade"))


@query("mask_redact", FOUND + " SELECT DISTINCT path, line_number, masked_snippet FROM graded")
def _(spark, sf_dir):
    return found(spark, sf_dir).select("path", "line_number", "masked_snippet").distinct()


_EMAIL = next(r for r in RULES if r.id == "pii.net.email")


@query("mask_partial", sql.findings([_EMAIL]) + ", one AS (SELECT path, line_number FROM graded GROUP BY ALL HAVING count(*) = 1) SELECT path, line_number, substr(line, 1, strpos(line, matched_content) - 1) || CASE WHEN length(matched_content) <= 4 THEN '****' ELSE '****' || right(matched_content, 4) END || substr(line, strpos(line, matched_content) + length(matched_content)) AS masked FROM graded JOIN one USING (path, line_number)")
def _(spark, sf_dir):
    hit = detect.numbered_lines(documents(spark, sf_dir)).withColumn("m", detect.matches(F.col("line"), [_EMAIL])).filter(F.size("m") == 1)
    return hit.select("path", "line_number", mask.masked(F.col("line"), F.col("m"), "partial").alias("masked"))


@query("mask_partial_whole")
def _(spark, sf_dir):
    """All lines with matches, however many; the SQL of mask_partial covers those with one."""
    hit = detect.numbered_lines(documents(spark, sf_dir)).withColumn("m", detect.matches(F.col("line"), [_EMAIL])).filter(F.size("m") > 0)
    return hit.select("path", "line_number", mask.masked(F.col("line"), F.col("m"), "partial").alias("masked"))


@query("filter_log", sql.filtered(LOG_RULES, "pages", "url", "html") + " SELECT * FROM filtered")
def _(spark, sf_dir):
    return mask.filter_lines(detect.numbered_lines(pages(spark, sf_dir)), LOG_RULES).select("path", "line_number", "line")


@query("mask_file", sql.rewritten(RULES) + " SELECT path, text FROM rewritten")
def _(spark, sf_dir):
    return mask.mask_text(documents(spark, sf_dir), RULES)


@query("fix_markers", sql.findings([_EMAIL]) + ", hits AS (SELECT DISTINCT path, line_number FROM graded) SELECT lines.path, CAST(lines.line_number AS BIGINT) AS line_number, line || CASE WHEN hits.path IS NULL OR contains(line, 'sieve:ignore') THEN '' ELSE ' # sieve:ignore' END AS line FROM lines LEFT JOIN hits USING (path, line_number)")
def _(spark, sf_dir):
    lines = detect.numbered_lines(documents(spark, sf_dir))
    hits = detect.findings(lines, [_EMAIL])
    return mask.add_markers(lines, hits, ["path"], "txt", detect.MARKER).select("path", "line_number", "line")


@query("fingerprint", FOUND + " SELECT fingerprint, count(*) AS n FROM graded GROUP BY fingerprint")
def _(spark, sf_dir):
    return found(spark, sf_dir).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("baseline_new", STATUS + " SELECT path, line_number, rule_id FROM stated WHERE baseline_status = 'new'")
def _(spark, sf_dir):
    return findings.new_findings(*with_baseline(spark, sf_dir)).select("path", "line_number", "rule_id")


@query("baseline_suppressed", STATUS + " SELECT path, line_number, rule_id FROM stated WHERE baseline_status = 'suppressed'")
def _(spark, sf_dir):
    return findings.suppressed_findings(*with_baseline(spark, sf_dir)).select("path", "line_number", "rule_id")


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.with_status(*with_baseline(spark, sf_dir))


@query("baseline_status", STATUS + " SELECT baseline_status, severity, count(*) AS n FROM stated GROUP BY ALL")
def _(spark, sf_dir):
    return stated(spark, sf_dir).groupBy("baseline_status", "severity").agg(F.count("*").alias("n"))


@query("baseline_proof", STATUS + " SELECT DISTINCT fingerprint FROM stated WHERE baseline_status = 'suppressed' AND rule_id = 'pii.net.ipv4'")
def _(spark, sf_dir):
    """Suppressed findings without a proof: the baseline has lost one rule's entries since."""
    every, known = with_baseline(spark, sf_dir)
    said = findings.with_status(every, known).filter("baseline_status = 'suppressed'")
    return findings.new_findings(said, known.filter("rule_id <> 'pii.net.ipv4'")).select("fingerprint").distinct()


@query("safe_view", FOUND + " SELECT path, line_number, rule_id, masked_snippet, category FROM graded")
def _(spark, sf_dir):
    return findings.safe_view(found(spark, sf_dir), R.to_frame(spark, RULES)).select("path", "line_number", "rule_id", "masked_snippet", "category")


@query("severity_counts", FOUND + " SELECT severity, count(*) AS n FROM graded GROUP BY severity")
def _(spark, sf_dir):
    return report.severity_counts(found(spark, sf_dir))


@query("rule_counts", FOUND + " SELECT rule_id, count(*) AS n FROM graded GROUP BY rule_id")
def _(spark, sf_dir):
    return report.rule_counts(found(spark, sf_dir))


@query("top3_rules", FOUND + " SELECT rule_id, count(*) AS n FROM graded GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 3")
def _(spark, sf_dir):
    return report.top_rules(found(spark, sf_dir))


@query("score_buckets", FOUND + " SELECT grade AS bucket, count(*) AS n FROM graded GROUP BY grade")
def _(spark, sf_dir):
    return report.score_buckets(found(spark, sf_dir))


_SIDES = {"total": "TRUE", "suppressed": "baseline_status = 'suppressed'", "effective": "baseline_status <> 'suppressed'"}
_SUMMARY = ", ".join(f"count(*) FILTER ({c}) AS {n}, " + ", ".join(f"count(*) FILTER ({c} AND severity = '{s}') AS {n}_{s.lower()}" for s in R.SEVERITIES) for n, c in _SIDES.items())


@query("evidence_summary", STATUS + f" SELECT {_SUMMARY} FROM stated")
def _(spark, sf_dir):
    return report.evidence_summary(stated(spark, sf_dir))


_CHANGED = ("total", "total_high", "effective", "effective_high")


@query("summary_consistency", STATUS + " SELECT name FROM (SELECT unnest(['total', 'total_high', 'effective', 'effective_high']) AS name, unnest([count(*), count(*) FILTER (severity = 'High'), count(*) FILTER (baseline_status <> 'suppressed'), count(*) FILTER (baseline_status <> 'suppressed' AND severity = 'High')]) AS n FROM stated) WHERE n <> n + 1")
def _(spark, sf_dir):
    """A stored summary in which one more new finding of high severity is claimed."""
    rows = shared.save(stated(spark, sf_dir), "stated")
    said = report.evidence_summary(rows)
    for name in _CHANGED:
        said = said.withColumn(name, F.col(name) + 1)
    return report.consistent(rows, said)


_PAGES = sql.findings(RULES, "pages", "url", "html")


@query("breakdown_path_prefix", _PAGES + " SELECT regexp_extract(path, '^[a-z]+://([^/]+)', 1) AS prefix, count(*) AS total, count(*) AS new FROM graded GROUP BY 1")
def _(spark, sf_dir):
    rows = detect.scan_texts(pages(spark, sf_dir), RULES).withColumn("baseline_status", F.lit("new"))
    return report.breakdown(rows, F.regexp_extract("path", "^[a-z]+://([^/]+)", 1))


@query("policy_gate", STATUS + " SELECT count(*) AS n, coalesce(max(score), 0) AS max_score, count(*) >= 10 OR coalesce(max(score), 0) >= 90 AS violated FROM stated WHERE baseline_status = 'new'")
def _(spark, sf_dir):
    return report.policy(findings.new_findings(*with_baseline(spark, sf_dir)), max_new=10, severity="Critical")


@query("exit_status", FOUND + " SELECT CASE WHEN (SELECT count(*) FROM documents WHERE strlen(text) > 1000000) > 0 THEN 2 WHEN count(*) > 0 THEN 1 ELSE 0 END AS status FROM graded")
def _(spark, sf_dir):
    facts = report.policy(found(spark, sf_dir)).withColumn("k", F.lit(1))
    large = table(spark, sf_dir, "documents").agg((F.count_if(F.octet_length("text") > readers.SIZE_LIMIT) > 0).alias("incomplete"), F.lit(1).alias("k"))
    return facts.join(large, "k").select(report.exit_status(F.col("incomplete"), F.col("violated")).alias("status"))


@query("limit_reasons", "SELECT doc_id, array_to_string(list_sort(list_filter(['file_limit', 'max_file_size', 'result_limit'], lambda x: (x = 'file_limit' AND doc_id % 2 = 0) OR (x = 'max_file_size' AND n_chars > 2000) OR (x = 'result_limit' AND doc_id % 3 = 0))), ',') AS reasons FROM documents")
def _(spark, sf_dir):
    flags = {"result_limit": F.col("doc_id") % 3 == 0, "max_file_size": F.col("n_chars") > 2000, "file_limit": F.col("doc_id") % 2 == 0}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(report.limit_reasons(flags), ",").alias("reasons"))


@query("limit_topn", FOUND + " SELECT path, line_number, rule_id, byte_start FROM graded ORDER BY path, line_number, byte_start, byte_end, rule_id LIMIT 20")
def _(spark, sf_dir):
    return findings.limited(found(spark, sf_dir), 20).select("path", "line_number", "rule_id", "byte_start")


@query("triage_order", FOUND + " SELECT path, line_number, rule_id, severity, row_number() OVER (PARTITION BY path ORDER BY CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END DESC, line_number, byte_start, rule_id) AS place FROM graded")
def _(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy(R.severity_rank(F.col("severity")).desc(), "line_number", "byte_start", "rule_id")
    return found(spark, sf_dir).select("path", "line_number", "rule_id", "severity", F.row_number().over(order).cast("long").alias("place"))


@query("ordinal", FOUND + " SELECT path, line_number, rule_id, byte_start, row_number() OVER (PARTITION BY path ORDER BY line_number, byte_start, byte_end, rule_id) - 1 AS ordinal FROM graded")
def _(spark, sf_dir):
    return findings.with_ordinal(found(spark, sf_dir)).select("path", "line_number", "rule_id", "byte_start", F.col("ordinal").cast("long").alias("ordinal"))


@query("lines_by_file", FOUND + " SELECT path, array_to_string(list_sort(list(DISTINCT line_number)), ',') AS lines FROM graded GROUP BY path")
def _(spark, sf_dir):
    return report.lines_by_file(found(spark, sf_dir)).select("path", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("report_text", FOUND + " SELECT '[' || upper(grade) || '] [' || severity || '] (' || score || ') [' || rule_id || '] ' || path || ':' || line_number || ' ' || masked_snippet AS text FROM graded")
def _(spark, sf_dir):
    return report.text_lines(found(spark, sf_dir))


@query("report_markdown", FOUND + " SELECT '| ' || concat_ws(' | ', severity, score, rule_id, replace(path, '|', '\\|'), line_number, replace(masked_snippet, '|', '\\|')) || ' |' AS row FROM graded")
def _(spark, sf_dir):
    return report.markdown_rows(found(spark, sf_dir))


@query("report_html", FOUND + " SELECT '<tr><td>' || concat_ws('</td><td>', severity, score, rule_id, path, line_number, replace(replace(replace(replace(replace(masked_snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) || '</td></tr>' AS row FROM graded")
def _(spark, sf_dir):
    return report.html_rows(found(spark, sf_dir))


@query("diagnostics", FOUND + " SELECT path, line_number - 1 AS line, utf16_start, utf16_end, CASE WHEN severity IN ('Critical', 'High') THEN 1 WHEN severity = 'Medium' THEN 2 ELSE 3 END AS severity, rule_id AS code FROM graded")
def _(spark, sf_dir):
    return report.diagnostics(found(spark, sf_dir))


@query("first_bytes", FOUND + ", r AS (SELECT *, sum(strlen(masked_snippet)) OVER (PARTITION BY path ORDER BY line_number, byte_start, rule_id ROWS UNBOUNDED PRECEDING) AS b FROM graded) SELECT path, line_number, rule_id FROM r WHERE b <= 200")
def _(spark, sf_dir):
    return report.first_bytes(found(spark, sf_dir), ["line_number", "byte_start", "rule_id"], F.octet_length("masked_snippet"), 200).select("path", "line_number", "rule_id")


# ---- Weekly metrics ------------------------------------------------------------------------------

_HINTS = {"error": ["retry_later", "check_network"], "click": ["clear_cache"], "view": ["nonsense"]}


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as reason events: the type is the reason, the operation and hints follow from it."""
    kind = F.col("event_type")
    hints = F.when(kind == "error", F.array(F.lit("retry_later"), F.lit("check_network"))).when(kind == "click", F.array(F.lit("clear_cache"))).when(kind == "view", F.array(F.lit("nonsense"))).otherwise(F.array().cast("array<string>"))
    op = F.when(kind == "signup", "dogfood.run").otherwise(F.concat(F.lit("app."), kind))
    return table(spark, sf_dir, "events").select("event_id", S.tokyo_week(F.col("ts")).alias("week"), S.week_monday(F.col("ts")).alias("monday"), kind.alias("reason_code"), op.alias("op"), F.when(F.col("value") > 20, "fail").otherwise("pass").alias("outcome"), hints.alias("hint_codes"), "props")


_WEEKLY = """WITH weekly AS (SELECT event_id, strftime(ts + INTERVAL 9 HOURS, '%G-W%V') AS week, CAST(date_trunc('week', ts + INTERVAL 9 HOURS) AS DATE) AS monday, event_type AS reason_code, CASE WHEN event_type = 'signup' THEN 'dogfood.run' ELSE 'app.' || event_type END AS op, CASE WHEN value > 20 THEN 'fail' ELSE 'pass' END AS outcome,
CASE event_type WHEN 'error' THEN ['retry_later', 'check_network'] WHEN 'click' THEN ['clear_cache'] WHEN 'view' THEN ['nonsense'] ELSE [] END AS hint_codes FROM events)"""
_HINT_COUNTS = _WEEKLY + ", hints AS (SELECT week, CASE WHEN hint = 'nonsense' THEN 'unknown' ELSE hint END AS hint, count(*) AS n FROM (SELECT week, unnest(hint_codes) AS hint FROM weekly WHERE NOT starts_with(op, 'dogfood.')) GROUP BY ALL)"


@query("iso_week_tokyo", _WEEKLY + " SELECT event_id, week FROM weekly")
def _(spark, sf_dir):
    return weekly(spark, sf_dir).select("event_id", "week")


@query("week_monday", _WEEKLY + " SELECT week, monday, count(*) AS n FROM weekly GROUP BY ALL")
def _(spark, sf_dir):
    return weekly(spark, sf_dir).groupBy("week", "monday").agg(F.count("*").alias("n"))


@query("reason_counts", _WEEKLY + " SELECT week, reason_code, count(*) AS n FROM weekly GROUP BY ALL")
def _(spark, sf_dir):
    return metrics.reason_counts(weekly(spark, sf_dir), "week")


@query("hint_counts", _HINT_COUNTS + " SELECT * FROM hints")
def _(spark, sf_dir):
    return metrics.hint_counts(weekly(spark, sf_dir), "week")


@query("failure_delta", _WEEKLY + " SELECT week, n, n - coalesce(lag(n) OVER (ORDER BY week), 0) AS delta FROM (SELECT week, count(*) AS n FROM weekly WHERE outcome = 'fail' GROUP BY week)")
def _(spark, sf_dir):
    return metrics.failure_delta(metrics.reason_counts(weekly(spark, sf_dir).filter("outcome = 'fail'"), "week"))


_ACTION = "CASE hint " + " ".join(f"WHEN '{h}' THEN '{a}'" for h, a in metrics.ACTIONS.items()) + f" ELSE '{metrics.UNMAPPED}' END"


@query("worklist_rank", _HINT_COUNTS + f""", weeks AS (SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT DISTINCT week FROM hints)),
both_ AS (SELECT h.week, h.hint, h.n, coalesce(p.n, 0) AS previous FROM hints h JOIN weeks w ON h.week = w.week LEFT JOIN hints p ON p.week = w.before AND p.hint = h.hint),
scored AS (SELECT *, n - previous AS delta, 10 * n + 25 * greatest(n - previous, 0) AS score, {_ACTION} AS action_id FROM both_)
SELECT week, hint, n, delta, score, action_id, CAST(row_number() OVER (PARTITION BY week ORDER BY score DESC, n DESC, action_id, hint) AS INT) AS rank FROM scored""")
def _(spark, sf_dir):
    return metrics.worklist(metrics.hint_counts(weekly(spark, sf_dir), "week")).select("week", "hint", "n", "delta", "score", "action_id", "rank")


_SIGNALS = _WEEKLY + ", signals AS (SELECT week, CASE WHEN starts_with(op, 'dogfood') THEN 'Dogfood' ELSE 'App' END AS category, reason_code AS cause, CASE WHEN bool_or(outcome = 'fail') THEN 'warn' ELSE 'info' END AS severity FROM weekly GROUP BY ALL)"


@query("signal_normalize", _SIGNALS + " SELECT * FROM signals")
def _(spark, sf_dir):
    return metrics.signals(weekly(spark, sf_dir), "week")


@query("recurrence_3of4", """WITH daily AS (SELECT event_type AS cause, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS week_no, count(*) AS n FROM events WHERE value > 60 AND event_type <> 'view' GROUP BY ALL),
hits AS (SELECT *, sum(n) OVER (PARTITION BY cause ORDER BY week_no ROWS UNBOUNDED PRECEDING) AS hit_count, count(*) OVER (PARTITION BY cause ORDER BY week_no RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) >= 3 AS now FROM daily)
SELECT 'App' AS category, cause, week_no, CAST(hit_count AS BIGINT) AS hit_count, bool_or(now) OVER (PARTITION BY cause ORDER BY week_no ROWS UNBOUNDED PRECEDING) AS active FROM hits""")
def _(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = table(spark, sf_dir, "events").filter("value > 60 and event_type <> 'view'").select(F.lit("App").alias("category"), F.col("event_type").alias("cause"), day.alias("week_no"))
    return metrics.recurrence(rows)


@query("noop_streak", _SIGNALS + """, sets AS (SELECT week, array_to_string(list_sort(list(category || cause || severity)), ',') AS items FROM signals GROUP BY week),
marked AS (SELECT week, coalesce(items = lag(items) OVER (ORDER BY week), FALSE) AS same FROM sets), isl AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT week, CASE WHEN same THEN 'NOOP' ELSE 'CHANGED' END AS result, row_number() OVER (PARTITION BY island ORDER BY week) - 1 AS streak FROM isl""")
def _(spark, sf_dir):
    return metrics.noop_streak(metrics.signals(weekly(spark, sf_dir), "week"))


@query("retention_topn", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k > 3")
def _(spark, sf_dir):
    return metrics.newest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 3, "o_orderkey").select("o_custkey", "o_orderkey")


# ---- Predicates, dates, registries ---------------------------------------------------------------


_LEAK = r"(?i)(#token=|\?token=|Authorization:\s*Bearer\s+[A-Za-z0-9._~-]{16,})"
_LEAKY = "html || CASE page_id % 7 WHEN 1 THEN ' /x#TOKEN=1' WHEN 2 THEN ' authorization: bearer ' || sha256(url) WHEN 3 THEN ' Authorization: Bearer short' WHEN 4 THEN ' /x?token=1' WHEN 5 THEN ' /x?mytoken=1' ELSE '' END"


@query("leakage_check", f"SELECT page_id FROM (SELECT page_id, {_LEAKY} AS t FROM pages) WHERE regexp_matches(t, '{_LEAK}')")
def _(spark, sf_dir):
    """Pages with one of five tails or none, of which three tell a token."""
    text = F.expr(_LEAKY.replace("sha256(url)", "sha2(url, 256)"))
    return table(spark, sf_dir, "pages").filter(text.rlike(_LEAK)).select("page_id")


@query("cache_freshness", "SELECT event_id, CASE WHEN value * 10000 <= 86400 THEN 'fresh' WHEN value * 10000 <= 691200 THEN 'stale' ELSE 'expired' END AS state FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.freshness(F.col("value") * 10000).alias("state"))


@query("json_extract_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("artifact_check", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    declared = docs.select("doc_id", F.sha2("text", 256).alias("said"))
    actual = docs.filter("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("now"))
    joined = declared.join(actual, "doc_id", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("said").isNull(), "extra").when(F.col("said") != F.col("now"), "changed")
    return joined.select("doc_id", problem.alias("problem")).filter("problem is not null")


@query("latest_revision", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    return streams.latest_revision(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


@query("names_and_escapes", "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '[\",\\r\\n]') THEN '\"' || replace(o_orderpriority, '\"', '\"\"') || '\"' ELSE o_orderpriority END AS cell, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.csv_cell(F.col("o_orderpriority")).alias("cell"), S.slug(F.col("o_orderpriority")).alias("slug"))

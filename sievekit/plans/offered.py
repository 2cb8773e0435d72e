"""Queries of presets, offered edits, advisory records, whole pages and evidence packs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import presets
from sievekit.functions import scalars as S
from sievekit.operators import actions, advisories, detect, findings, mask, metrics, report
from sievekit.plans import sql
from sievekit.plans.catalog import FOUND, LOG_RULES, RULES, STATUS, found, query, stated, table
from sievekit.plans.derived import _case, made, made_sql
from sievekit.sources import packs, readers, shared, writers

# ---- Presets -------------------------------------------------------------------------------------

_FILES = (
    "o_custkey AS root",
    _case("o_orderkey", "'src/a.rs'", "'README.md'", "'doc/README.md'", "'logs.txt'", "'src/x.log'", "'kyc.md'", "'src/billing/a.ts'") + " AS path",
    "CASE WHEN o_custkey % 3 = 0 THEN '説明ノート' WHEN o_custkey % 3 = 1 THEN '説明' ELSE 'plain' END AS text",
)
_RARE = ("o_custkey AS root", _case("o_custkey", "'logs/x'", "'payments/x'", "'run.jsonl'", "'account/y'", "'x.md'", "CAST(NULL AS STRING)") + " AS path", "CAST(NULL AS STRING) AS text")
_LISTING = f"(SELECT * FROM {made_sql('orders', _FILES)} UNION ALL SELECT * FROM {made_sql('(SELECT * FROM orders WHERE o_orderkey % 16 = 0)', _RARE)})"


@query("preset_inference", f"""SELECT root, CASE WHEN coalesce(bool_or(path LIKE 'logs/%' OR path IN ('run.jsonl')), FALSE) THEN 'logs-jp' WHEN coalesce(bool_or(string_split(path, '/')[1] IN ('payments', 'billing', 'kyc', 'account')), FALSE) THEN 'fintech-jp'
WHEN coalesce(bool_or(path = 'README.md' AND regexp_matches(text, '[ぁ-んァ-ヶ]')), FALSE) THEN 'standard-jp' END AS preset FROM {_LISTING} GROUP BY root""")
def _(spark, sf_dir):
    """The preset of each customer by paths that are made of all orders."""
    rare = table(spark, sf_dir, "orders").filter("o_orderkey % 16 = 0").selectExpr(*_RARE)
    return presets.inferred(made(spark, sf_dir, "orders", _FILES).union(rare))


_GOV = presets.applied(RULES, "gov-jp", {"pii.net.email": {"base_score": 11}})


@query("preset_findings", sql.findings(_GOV) + " SELECT path, line_number, rule_id, score, grade FROM graded")
def _(spark, sf_dir):
    """All documents by all rules under a preset, with one rule that a configuration scores anew."""
    docs = readers.table_texts(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), "text")
    return detect.scan_texts(docs, _GOV).select("path", "line_number", "rule_id", "score", "grade")


_LOGS = presets.applied(LOG_RULES, "logs-jp")


@query("preset_log_findings", sql.findings(_LOGS, "pages", "url", "html") + " SELECT path, line_number, rule_id, score, grade FROM graded")
def _(spark, sf_dir):
    return detect.scan_texts(readers.table_texts(table(spark, sf_dir, "pages"), F.col("url"), "html"), _LOGS).select("path", "line_number", "rule_id", "score", "grade")


# ---- Offered edits -------------------------------------------------------------------------------

_PATH = "doc_id || " + _case("doc_id", "'.py'", "'.rs'", "'.html'", "'.sql'", "'.json'", "'/.py'", "'.d/x'")
_SIGN = "CASE CAST(split_part(split_part(path, '/', 1), '.', 1) AS BIGINT) % 7 WHEN 0 THEN '#' WHEN 1 THEN '//' WHEN 2 THEN '<!--' WHEN 3 THEN '--' END"
_UNITS = "CAST(length(line) + length(regexp_replace(line, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) AS BIGINT)"


@query("code_actions", sql.findings(RULES, "documents", _PATH, "text") + f""", f AS (SELECT *, {_SIGN} AS sign, {_UNITS} AS units FROM graded)
SELECT path, rule_id, line_number - 1 AS line, utf16_start AS start, utf16_end AS "end", 'Mask value' AS title, '<REDACTED>' AS new_text, TRUE AS preferred FROM f WHERE matched_content NOT IN ('', '<REDACTED>')
UNION ALL SELECT path, rule_id, line_number - 1, utf16_start, utf16_end, 'Partial mask', CASE WHEN length(matched_content) <= 4 THEN '****' ELSE '****' || right(matched_content, 4) END, FALSE FROM f WHERE matched_content NOT IN ('', '<REDACTED>', '****')
UNION ALL SELECT path, rule_id, line_number - 1, units, units, 'Add inline ignore', ' ' || sign || ' sieve:ignore=' || rule_id || CASE WHEN sign = '<!--' THEN ' -->' ELSE '' END, FALSE FROM f WHERE sign IS NOT NULL AND NOT contains(line, 'sieve:ignore')""")
def _(spark, sf_dir):
    """What an editor offers for each finding of all documents, as files of seven kinds."""
    docs = readers.table_texts(table(spark, sf_dir, "documents"), F.expr(_PATH), "text")
    return actions.code_actions(detect.scan_texts(docs, RULES))


# ---- Advisory records ----------------------------------------------------------------------------

_EVENT = '{"introduced":"0"},{"fixed":"'
_RECORDS = (
    "p_partkey",
    _case("p_partkey", "p_partkey % 4 || '.' || p_size || '.1'", "'main'", "'1.' || p_size || '.0'") + " AS version",
    f"""'{{"affected":[{{"ranges":[{{"events":[{_EVENT}' || p_partkey % 5 || '.' || p_size % 9 || '.0"}}]}},{{"events":[{_EVENT}2.' || (p_size + 9) || '.' || p_size || '"}},{{"fixed":"soon"}}]}}]}},{{"package":"x"}}],"database_specific":{{"severity":"' || """
    + _case("p_size", "'HIGH'", "'moderate'", "'Odd'", "'CRITICAL'", "'low'")
    + """ || '"},"severity":[{"type":"CVSS_V3","score":"' || p_size || '.5"}],"references":[{"url":"https://b/' || p_size || '"},{"url":"https://a/' || p_size || '"}]}' AS whole""",
)
_DETAILS = "CASE WHEN p_partkey % 7 = 0 THEN '{\"affected\":null}' WHEN p_partkey % 7 = 1 THEN 'no json' WHEN p_partkey % 7 = 2 THEN NULL ELSE whole END"


def _numbers(version: str) -> str:
    return "(" + ", ".join(f"CAST(split_part({version}, '.', {k}) AS INT)" for k in (1, 2, 3)) + ")"


@query("advisory_records", f"""WITH r AS (SELECT p_partkey, version, {_DETAILS} AS details FROM {made_sql('part', _RECORDS)}), j AS (SELECT p_partkey, version, CASE WHEN json_valid(details) THEN CAST(details AS JSON) END AS j FROM r),
fixes AS (SELECT p_partkey, version, unnest(json_extract_string(j, '$.affected[*].ranges[*].events[*].fixed')) AS fixed FROM j),
above AS (SELECT p_partkey, first(fixed ORDER BY {_numbers('fixed')}) AS fixed FROM fixes WHERE fixed <> 'soon' AND CASE WHEN version = 'main' THEN TRUE ELSE {_numbers('fixed')} > {_numbers('version')} END GROUP BY p_partkey)
SELECT j.p_partkey, CASE lower(json_extract_string(j, '$.database_specific.severity')) WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'moderate' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Unknown' END AS severity,
json_extract_string(j, '$.severity[0].score') AS cvss, coalesce(array_to_string(list_sort(json_extract_string(j, '$.references[*].url')), ','), '') AS urls, coalesce('Upgrade to >= ' || fixed, '{advisories.NO_FIX}') AS advice FROM j LEFT JOIN above USING (p_partkey)""")
def _(spark, sf_dir):
    """A record for each part, some of them without ranges, broken or null, and what it advises."""
    found = made(spark, sf_dir, "part", _RECORDS).select("p_partkey", "version", F.expr(_DETAILS).alias("details"))
    return advisories.described(found).select("p_partkey", "severity", "cvss", F.array_join("urls", ",").alias("urls"), "advice")


# ---- Whole pages and packs -----------------------------------------------------------------------

_TOP = "top AS (SELECT rule_id, count(*) AS k FROM stated GROUP BY rule_id ORDER BY k DESC, rule_id LIMIT 3)"
_BUCKETS = " || ' / ' || ".join(f"'{s.upper()}: ' || count(*) FILTER (grade = '{s}')" for s in ("Critical", "High", "Medium", "Low"))
_TITLE = "Sensitive data report"


@query("page_markdown", STATUS + f""", {_TOP} SELECT 0 AS section, '# {_TITLE}' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '**Findings**: ' || count(*) || ' total, ' || count(*) FILTER (baseline_status = 'new') || ' new' || chr(10) || chr(10)
|| (SELECT string_agg('- ' || rule_id || ' (' || k || ')' || chr(10), '' ORDER BY k DESC, rule_id) FROM top) || chr(10) || '## Findings' || chr(10) || chr(10) || '| Severity | Score | Rule ID | File | Line | Match |' || chr(10) || '|---|---|---|---|---|---|' AS text FROM stated
UNION ALL SELECT 1, '| ' || concat_ws(' | ', severity, score, rule_id, replace(path, '|', '\\|'), line_number, replace(masked_snippet, '|', '\\|')) || ' |' FROM stated UNION ALL SELECT 2, ''""")
def _(spark, sf_dir):
    return report.markdown_page(stated(spark, sf_dir))


@query("page_html", STATUS + f""", {_TOP} SELECT 0 AS section, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{_TITLE}</title></head><body><h1>{_TITLE}</h1><p>' || count(*) || ' findings: ' || {_BUCKETS} || '</p><ul>'
|| (SELECT string_agg('<li>' || rule_id || ' (' || k || ')</li>', '' ORDER BY k DESC, rule_id) FROM top) || '</ul><table><thead><tr>{''.join(f'<th>{c}</th>' for c in ('Severity', 'Score', 'Rule', 'File', 'Line', 'Match'))}</tr></thead><tbody>' AS text FROM stated
UNION ALL SELECT 1, '<tr><td>' || concat_ws('</td><td>', severity, score, rule_id, path, line_number, replace(replace(replace(replace(replace(masked_snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) || '</td></tr>' FROM stated
UNION ALL SELECT 2, '</tbody></table></body></html>'""")
def _(spark, sf_dir):
    return report.html_page(stated(spark, sf_dir))


@query("evidence_pack", FOUND + " SELECT 'findings' AS part, count(*) AS n FROM graded UNION ALL SELECT 'summary', count(DISTINCT rule_id) FROM graded")
def _(spark, sf_dir):
    """A pack of findings and their summary is written and read back: lines of its parts, and a row for each file that isn't as the manifest says (none).

    What its lines say isn't judged here, as documents may hold anything.
    """
    every = shared.save(found(spark, sf_dir).select("path", "line_number", "rule_id", "severity", "score", "masked_snippet"), "evidence-findings")
    folder = f"{shared.shared_dir(spark)}/evidence-{spark._jvm.java.util.UUID.randomUUID()}"
    packs.write(folder, {"findings": every.select(F.to_json(F.struct(*every.columns)).alias("text")), "summary": report.rule_counts(every).select(F.to_json(F.struct("rule_id", "n")).alias("text"))})
    wrong = packs.verify(spark, folder).filter("problem <> 'forbidden place' and problem <> 'leak'")
    return packs.lines(spark, folder).union(wrong.select(F.concat_ws(": ", "path", "problem"), F.lit(-1).cast("long")))


# ---- Ledgers, registries, configurations ---------------------------------------------------------

_SEEN = ("'Error' AS category", "'client ' || client_id AS cause", "ts")


@query("recurrence_ledger", f"""WITH w AS (SELECT category, cause, CAST(date_trunc('week', ts + INTERVAL 9 HOURS) AS DATE) AS monday, count(*) AS n FROM {made_sql("(SELECT * FROM clicks WHERE kind = 'error')", _SEEN)} WHERE ts IS NOT NULL GROUP BY ALL),
j AS (SELECT *, (SELECT count(*) FROM w o WHERE o.cause IS NOT DISTINCT FROM w.cause AND o.monday BETWEEN w.monday - INTERVAL 21 DAYS AND w.monday) >= 3 AS now FROM w)
SELECT category, cause, CASE WHEN bool_or(now) THEN 'active' ELSE 'inactive' END AS status, min(monday) AS first_seen, max(monday) AS last_seen, CAST(sum(n) AS BIGINT) AS hit_count, array_to_string(list_sort(list(CAST(monday AS VARCHAR)))[-8:], ',') AS recent_weeks FROM j GROUP BY category, cause""")
def _(spark, sf_dir):
    """Which clients' errors come back: weeks of Tokyo, over all clicks."""
    seen = table(spark, sf_dir, "clicks").filter("kind = 'error'").selectExpr(*_SEEN).withColumn("monday", S.week_monday(F.col("ts")))
    return metrics.ledger(seen).withColumn("recent_weeks", F.array_join(F.col("recent_weeks").cast("array<string>"), ","))


@query("exceptions_cleanup", "SELECT client_id, source FROM clients WHERE client_id % 4 = 0 OR updated_at IS NULL OR updated_at > TIMESTAMP '2024-03-01 06:00:00'")
def _(spark, sf_dir):
    """Exceptions of clients that end at given times, some of them at the very moment, some never."""
    registry = table(spark, sf_dir, "clients").select("client_id", "source", F.when(F.col("client_id") % 4 != 0, F.col("updated_at")).alias("expires_at"))
    return findings.cleaned_exceptions(registry, F.lit("2024-03-01 06:00:00").cast("timestamp_ntz")).select("client_id", "source")


_SETTINGS = (
    "client_id", "source", _case("client_id", "'API_Key_' || client_id", "'name'", "'sessionTokens'", "CAST(NULL AS STRING)", "'city'") + " AS k",
    _case("client_id", "city", "' Bearer ' || name", "email", "'https://h/?a=1&TOKEN=' || client_id", "'see bearer ' || name", "'Password=' || city", "name") + " AS v",
)


@query("config_redact", f"""SELECT client_id, source, k, CASE WHEN regexp_matches(coalesce(k, ''), '(?i)password|secret|token|api_?key|authorization|private_key|access_key') OR regexp_matches(v, '(?i)[?&#]token=|access_token=|api_?key=|secret=|password=|authorization: bearer |^\\s*bearer ') THEN CASE WHEN v IS NOT NULL THEN '<REDACTED>' END ELSE v END AS v FROM {made_sql('clients', _SETTINGS)}""")
def _(spark, sf_dir):
    rows = made(spark, sf_dir, "clients", _SETTINGS)
    return rows.select("client_id", "source", "k", writers.redacted_text(F.col("k"), F.col("v")).alias("v"))


_KEYS = ("client_id", "source", _case("client_id", "name", "email", "source || '-' || client_id", "repeat(source, 40)", "city") + " AS k")


@query("safe_keys", f"""SELECT client_id, source, CASE WHEN s <> k OR length(s) > 128 THEN left(s, 64) || '-' || left(sha256(k), 16) ELSE s END AS safe FROM (SELECT *, regexp_replace(k, '[^A-Za-z0-9._-]', '_', 'g') AS s FROM {made_sql('clients', _KEYS)})""")
def _(spark, sf_dir):
    return made(spark, sf_dir, "clients", _KEYS).select("client_id", "source", S.safe_key(F.col("k")).alias("safe"))


_FIX_PATH = "doc_id || " + _case("doc_id", "'.py'", "'.ts'", "'.txt'", "'/x.hpp'")
_FIXED = "list_transform(string_split(text, chr(10)), lambda x, i: regexp_replace(x, '\\r$', '') || CASE WHEN list_contains(ns, i) AND NOT contains(x, 'sieve:ignore') THEN ' ' || sign || ' sieve:ignore' ELSE '' END)"
_EMAIL = [r for r in RULES if r.id == "pii.net.email"]


@query("fix_texts", sql.findings(_EMAIL, "documents", _FIX_PATH, "text") + f""", h AS (SELECT path, list(DISTINCT line_number) AS ns FROM graded GROUP BY path), d AS (SELECT {_FIX_PATH} AS path, text, CASE doc_id % 4 WHEN 0 THEN '#' WHEN 2 THEN NULL ELSE '//' END AS sign FROM documents)
SELECT path, array_to_string({_FIXED}, chr(10)) AS text, CAST(len(ns) AS INT) AS changed FROM d JOIN h USING (path) WHERE sign IS NOT NULL""")
def _(spark, sf_dir):
    """All documents as files of four kinds: lines with addresses get a marker where the kind has comments."""
    docs = readers.table_texts(table(spark, sf_dir, "documents"), F.expr(_FIX_PATH), "text")
    return mask.fixed_texts(docs, detect.scan_texts(docs, _EMAIL).select("path", "line_number"), detect.MARKER)

# ---- What a summary breaks down --------------------------------------------------------------------

_RANK = "list_position(['Low', 'Medium', 'High', 'Critical'], severity)"
_TOP = f"ORDER BY {_RANK} DESC, score DESC, path, line_number, byte_start, rule_id"


@query("breakdown_by_rule", STATUS + " SELECT rule_id, severity, count(*) AS total, count(*) FILTER (baseline_status = 'new') AS new FROM stated GROUP BY ALL")
def _(spark, sf_dir):
    return report.rule_breakdown(stated(spark, sf_dir))


def _top_sql(most: int, budget: int) -> str:
    return STATUS + f""", fresh AS (SELECT * FROM stated WHERE baseline_status = 'new'), numbered AS (SELECT *, row_number() OVER ({_TOP}) AS place FROM fresh),
    summed AS (SELECT *, CAST(sum(strlen(fingerprint) + strlen(rule_id) + strlen(severity) + strlen(path) + length(CAST(line_number AS VARCHAR))) OVER (ORDER BY place) AS BIGINT) AS bytes FROM numbered),
    kept AS (SELECT * FROM summed WHERE place <= {most} AND bytes <= {budget})
    SELECT CAST(place AS INT) AS place, fingerprint, rule_id, severity, path, CAST(line_number AS BIGINT) AS line_start, bytes, (SELECT count(*) FROM kept) < (SELECT count(*) FROM fresh) AS truncated FROM kept"""


@query("top_new_findings", _top_sql(100, 6000))
def _(spark, sf_dir):
    """The summary's new findings: a report of at most 100, cut at 6,000 bytes."""
    return report.top_new(stated(spark, sf_dir), 100, 6000)

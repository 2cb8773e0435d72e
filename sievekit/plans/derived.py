"""Queries of rules, registries, logs, lockfiles and paths over inputs that are made of the tables' rows.

An input is a list of expressions that Spark and DuckDB read alike (`made`, `made_sql`); what is done with it is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.functions import scalars as S
from sievekit.operators import deps, detect, findings, mask, metrics, rulebook
from sievekit.plans import sql
from sievekit.plans.catalog import documents, query, table
from sievekit.sources import readers


def made(spark: SparkSession, sf_dir: str, source: str, columns: tuple[str, ...]) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*columns)


def made_sql(source: str, columns: tuple[str, ...]) -> str:
    return f"(SELECT {', '.join(columns)} FROM {source})"


def _case(number: str, *values: str) -> str:
    """One of some expressions by a number's remainder."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


# ---- Lines ---------------------------------------------------------------------------------------

_MARKS = ("''", "' // sieve:ignore'", "' # sieve:ignore=pii.net.email'", "' # sieve:ignore=pii.net.ipv4'", "' sieve:ignore'")
_MARKED = f"line || {_case('line_number', *_MARKS)}"


@query("inline_ignore", "WITH " + sql.lines() + f" SELECT path, CAST(line_number AS BIGINT) AS line_number FROM (SELECT path, line_number, {_MARKED} AS t FROM lines) WHERE NOT (contains(t, 'sieve:ignore=pii.net.email') OR ((contains(t, '# sieve:ignore') OR contains(t, '// sieve:ignore')) AND NOT contains(t, 'sieve:ignore=')))")
def _(spark, sf_dir):
    """All lines of documents with one of five markers behind them or none."""
    lines = detect.numbered_lines(documents(spark, sf_dir)).select("path", "line_number", F.expr(_MARKED).alias("t"))
    return lines.filter(~detect.ignored(F.col("t"), "pii.net.email")).select("path", "line_number")


_FOUR = "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')"
_POSTAL = (
    "o_orderkey",
    "o_custkey || ' ' || " + _case("o_orderkey", f"'rev 123' || {_FOUR}", f"'build-123-' || {_FOUR}", f"'zip 123-' || {_FOUR}", f"'バージョン：123' || {_FOUR}", f"'prebuild 123-' || {_FOUR}", f"'注文番号 1234-5678-' || {_FOUR}", f"'id 1234-5678-' || {_FOUR} || ' ok'") + " AS line",
)
_NEAR_RULES = [r for r in R.builtin("pii") if r.id in ("pii.jp.postal_code", "pii.jp.mynumber.unlabeled")]


@query("suppress_context", sql.findings(_NEAR_RULES, made_sql("orders", _POSTAL), "CAST(o_orderkey AS VARCHAR)", "line") + " SELECT path, rule_id, matched_content FROM graded")
def _(spark, sf_dir):
    """A line for each order in which digits are a post code, a number of a person, or by the words before or about them neither."""
    lines = made(spark, sf_dir, "orders", _POSTAL)
    return detect.scan_texts(readers.table_texts(lines, F.col("o_orderkey").cast("string"), "line"), _NEAR_RULES).select("path", "rule_id", "matched_content")


_WIDE = f"translate('1234-5678-' || {_FOUR}, '0123456789-', '０１２３４５６７８９－')"
_NUMBERS = ("o_orderkey", _case("o_orderkey", f"'1234-5678-' || {_FOUR}", _WIDE, f"'12345678' || {_FOUR} || ' 3'", f"'090-1234-' || {_FOUR}", f"translate('0801234' || {_FOUR}, '0123456789', '０１２３４５６７８９')", f"'090123' || {_FOUR}", f"'tel 060 1234 ' || {_FOUR}", "CAST(NULL AS STRING)") + " AS t")
_NARROWED = "translate(t, '０１２３４５６７８９', '0123456789')"


@query("validator_mynumber", f"SELECT o_orderkey, len(list_filter(regexp_extract_all(regexp_replace({_NARROWED}, '([0-9])[ \\t　\\-－―‐‑–—ー]+([0-9])', '\\1\\2', 'g'), '[0-9]+'), lambda x: length(x) = 12)) > 0 AS valid FROM {made_sql('orders', _NUMBERS)}")
def _(spark, sf_dir):
    return made(spark, sf_dir, "orders", _NUMBERS).select("o_orderkey", S.mynumber_length(F.col("t")).alias("valid"))


@query("validator_phone", f"SELECT o_orderkey, length(d) = 11 AND d[1:3] IN ('070', '080', '090') AS valid FROM (SELECT o_orderkey, regexp_replace({_NARROWED}, '[^0-9]', '', 'g') AS d FROM {made_sql('orders', _NUMBERS)})")
def _(spark, sf_dir):
    return made(spark, sf_dir, "orders", _NUMBERS).select("o_orderkey", S.mobile_number(F.col("t")).alias("valid"))


_SPANS = ("l_orderkey AS id", "l_linenumber * 4 + l_suppkey % 3 AS start", "l_linenumber * 4 + l_suppkey % 3 + 1 + l_partkey % 5 AS stop", "CAST(l_quantity AS INT) % 7 AS priority", "'p' || l_partkey AS placeholder")
_IN_ORDER = "PARTITION BY id ORDER BY start, stop, priority, placeholder ROWS"


@query("mask_priority", f"""WITH marked AS (SELECT *, CASE WHEN start <= max(stop) OVER ({_IN_ORDER} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first_ FROM {made_sql('lineitem', _SPANS)}),
numbered AS (SELECT *, sum(first_) OVER ({_IN_ORDER} UNBOUNDED PRECEDING) AS island FROM marked)
SELECT id, min(start) AS start, max(stop) AS stop, first(placeholder ORDER BY priority DESC, stop - start DESC, start, placeholder DESC) AS placeholder FROM numbered GROUP BY id, island""")
def _(spark, sf_dir):
    """A span for each line of an order; spans that meet are one, under the word of the one that counts most."""
    return mask.winners(made(spark, sf_dir, "lineitem", _SPANS), ["id"]).select("id", "start", "stop", "placeholder")


# ---- Rules as tables -----------------------------------------------------------------------------

_RULES = (
    "'shop.' || item_id AS id", _case("item_id", "'a+b'", "'(a+)+b'", "'(a*)*'", "'[0-9]{2,}x'", "'(x*y)+'") + " || item_id AS pattern",
    _case("size", "'Low'", "'Medium'", "'High'", "'Critical'") + " AS severity", "size * 2 AS score", "brand AS category", "kind AS variant", "item_id % 7 <> 0 AS enabled", "name AS description",
)
_RULES_SQL = made_sql("items", _RULES)


def _rules(spark, sf_dir):
    return made(spark, sf_dir, "items", _RULES)


@query("rules_list", f"SELECT id, severity, score FROM {_RULES_SQL} WHERE severity IN ('High', 'Critical')")
def _(spark, sf_dir):
    return rulebook.listed(_rules(spark, sf_dir), "High").select("id", "severity", "score")


@query("rules_enabled", f"SELECT id, pattern, description, severity FROM {_RULES_SQL} WHERE enabled")
def _(spark, sf_dir):
    return readers.rules_table(_rules(spark, sf_dir))


_ASKED = ("'shop.' || l_partkey AS id",)


@query("rules_explain", f"SELECT a.id, r.id IS NOT NULL AS known, severity, score, category FROM (SELECT DISTINCT id FROM {made_sql('lineitem', _ASKED)}) a LEFT JOIN {_RULES_SQL} r ON a.id = r.id")
def _(spark, sf_dir):
    return rulebook.explained(_rules(spark, sf_dir), made(spark, sf_dir, "lineitem", _ASKED)).select("id", "known", "severity", "score", "category")


_SAID = ("'shop.' || p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN 'x+' END AS pattern", _case("p_partkey", "'critical'", "' LOW '", "'odd'", "CAST(NULL AS STRING)") + " AS severity", "CASE WHEN p_size % 2 = 0 THEN p_size END AS score", "CASE WHEN p_size % 5 = 0 THEN p_type END AS category")
_WORD = "CASE lower(trim(c.severity)) WHEN 'critical' THEN 'Critical' WHEN 'low' THEN 'Low' WHEN 'odd' THEN 'Medium' END"


@query("rules_override", f"""SELECT r.id, coalesce({_WORD}, r.severity) AS severity, coalesce(c.score, r.score) AS score, coalesce(c.category, r.category) AS category FROM {_RULES_SQL} r LEFT JOIN {made_sql('part', _SAID)} c ON r.id = c.id WHERE c.pattern IS NULL
UNION ALL SELECT c.id, coalesce({_WORD}, 'Medium'), coalesce(c.score, 50), coalesce(c.category, 'custom') FROM {made_sql('part', _SAID)} c WHERE c.pattern IS NOT NULL""")
def _(spark, sf_dir):
    """Rules of items with what parts say of them: a third with patterns, the others with changes or nothing."""
    return rulebook.overridden(_rules(spark, sf_dir), made(spark, sf_dir, "part", _SAID)).select("id", "severity", "score", "category")


@query("rules_required", f"SELECT DISTINCT id FROM {made_sql('lineitem', _ASKED)} EXCEPT SELECT id FROM {_RULES_SQL}")
def _(spark, sf_dir):
    return rulebook.missing(made(spark, sf_dir, "lineitem", _ASKED), _rules(spark, sf_dir))


@query("template_filter", f"SELECT id FROM {_RULES_SQL} WHERE severity IN ('Medium', 'High') AND score BETWEEN 20 AND 85 AND variant IN ('home', 'office')")
def _(spark, sf_dir):
    return rulebook.chosen(_rules(spark, sf_dir), (), ("home", "office"), ("Medium", "High"), (20, 85)).select("id")


@query("template_counts", " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM {_RULES_SQL} GROUP BY {c}" for c in ("category", "variant", "severity")))
def _(spark, sf_dir):
    return rulebook.counts(_rules(spark, sf_dir))


@query("rules_risky", f"SELECT id FROM {_RULES_SQL} WHERE regexp_matches(pattern, '[+*]\\)[+*]')")
def _(spark, sf_dir):
    return _rules(spark, sf_dir).filter(rulebook.risky(F.col("pattern"))).select("id")


# ---- Logs, weeks, dates --------------------------------------------------------------------------

_LOG = ("CASE WHEN click_id % 11 = 3 THEN NULL WHEN click_id % 5 = 1 THEN '  ' WHEN click_id % 5 = 2 THEN 'broken {' || click_id WHEN kind IS NULL THEN '{\"v\":1,\"op\":\"net.get\"}' ELSE '{\"v\":1,\"ts\":\"t\",\"reason_code\":\"' || kind || '\",\"op\":\"net.get\",\"outcome\":\"fail\"}' END AS value",)


@query("parse_stats", f"""SELECT count(*) AS total_lines, count(*) FILTER (ok) AS valid_events, count(*) FILTER (NOT ok AND trim(value) <> '') AS parse_errors
FROM (SELECT value, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.reason_code') IS NOT NULL AND json_extract_string(value, '$.op') IS NOT NULL ELSE FALSE END AS ok FROM {made_sql('clicks', _LOG)})""")
def _(spark, sf_dir):
    """A log line for each click: events, events without a reason, broken and blank lines, and nulls."""
    return metrics.parse_stats(made(spark, sf_dir, "clicks", _LOG))


_WEEKS = ("sale_id", _case("sale_id", "'2024-W' || lpad(CAST(priority * 13 AS STRING), 2, '0')", "'2024-W' || lpad(CAST(sale_id % 60 AS STRING), 2, '0')", "'24-W' || lpad(CAST(sale_id % 60 AS STRING), 2, '0')", "'2024-W' || sale_id % 60") + " AS w")


@query("week_valid", f"SELECT sale_id, w, regexp_full_match(w, '[0-9]{{4}}-W[0-9]{{2}}') AND coalesce(TRY_CAST(substr(w, 7) AS INT) BETWEEN 1 AND 53, FALSE) AS valid FROM {made_sql('sales', _WEEKS)}")
def _(spark, sf_dir):
    return made(spark, sf_dir, "sales", _WEEKS).select("sale_id", "w", S.valid_week(F.col("w")).alias("valid"))


_TERMS = ("sale_id", "sale_id % 400 || " + _case("sale_id", "'d'", "'w'", "'y'", "'h'", "'m'", "'s'", "' d'", "''") + " AS t")


@query("expiry_parse", f"SELECT sale_id, CAST(CASE right(t, 1) WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 WHEN 'y' THEN 31536000 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 END * CASE WHEN NOT contains(t, ' ') THEN TRY_CAST(left(t, length(t) - 1) AS BIGINT) END AS BIGINT) AS seconds FROM {made_sql('sales', _TERMS)}")
def _(spark, sf_dir):
    return made(spark, sf_dir, "sales", _TERMS).select("sale_id", S.expiry_seconds(F.col("t")).alias("seconds"))


@query("backoff", """WITH marked AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS good FROM events),
tried AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, good ORDER BY ts, event_id) AS attempt FROM marked WHERE failed)
SELECT event_id, CAST(attempt AS INT) AS attempt, CAST(CASE WHEN attempt > 4 THEN 2000 ELSE 100 << attempt END AS BIGINT) AS delay_ms FROM tried""")
def _(spark, sf_dir):
    """What each failure of a user has to wait for, by how many went before it in a row."""
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return deps.retry_delays(calls, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "attempt", "delay_ms")


# ---- Dependencies --------------------------------------------------------------------------------

_PACKAGES = ("CASE WHEN l_partkey % 2 = 0 THEN 'Rust' ELSE 'Npm' END AS ecosystem", "'part-' || l_partkey AS name", "(l_suppkey % 4) || '.' || l_linenumber || '.' || CAST(l_quantity AS INT) AS version", "(l_orderkey % 100) || '/lock' AS location")
_ADVISORIES = ("'X-' || p_partkey AS id", "'part-' || p_partkey AS crate_name", _case("p_size", "'< 1.5.0'", "'>= 1.2.0, < 2.3.0'", "'>= 3.1.10'", "'odd'") + " AS vulnerable_versions")
_TRIPLE = "(CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT))"
_VULNERABLE = f"""WITH p AS (SELECT DISTINCT * FROM {made_sql('lineitem', _PACKAGES)}), v AS (SELECT p.*, id FROM p JOIN {made_sql('part', _ADVISORIES)} a ON a.crate_name = p.name
WHERE CASE vulnerable_versions WHEN '< 1.5.0' THEN {_TRIPLE} < (1, 5, 0) WHEN '>= 3.1.10' THEN {_TRIPLE} >= (3, 1, 10) WHEN 'odd' THEN FALSE ELSE {_TRIPLE} >= (1, 2, 0) AND {_TRIPLE} < (2, 3, 0) END)"""


def _vulnerable(spark, sf_dir, packages):
    return deps.vulnerable(packages, made(spark, sf_dir, "part", _ADVISORIES))


@query("advisory_match", _VULNERABLE + " SELECT ecosystem, name, version, location, id FROM v")
def _(spark, sf_dir):
    """Packages of lines of orders against an advisory for each part, a quarter of which can't be read."""
    return _vulnerable(spark, sf_dir, made(spark, sf_dir, "lineitem", _PACKAGES).distinct()).select("ecosystem", "name", "version", "location", "id")


@query("vuln_group", _VULNERABLE + " SELECT ecosystem, name, version, array_to_string(list_sort(list(DISTINCT location)), ',') AS locations, array_to_string(list_sort(list(DISTINCT id)), ',') AS advisories FROM v GROUP BY ALL")
def _(spark, sf_dir):
    """As advisory_match, but for a row for each package; its sets drop what is repeated, so rows aren't made distinct before."""
    return deps.grouped(_vulnerable(spark, sf_dir, made(spark, sf_dir, "lineitem", _PACKAGES))).select("ecosystem", "name", "version", F.array_join("locations", ",").alias("locations"), F.array_join("advisories", ",").alias("advisories"))


_FIXES = ("'part-' || p_partkey AS name", "p_partkey % 4 || '.' || p_size || '.0' AS version", "p_partkey % 3 || '.' || (p_size - 1) || '.9' AS f1", "(p_partkey + 1) % 5 || '.' || p_size % 7 || '.0' AS f2", "p_partkey % 4 || '.' || (p_size + 10) || '.2' AS f3")


@query("min_fix", f"""WITH f AS (SELECT name, version, unnest([f1, f2, f3]) AS fixed FROM {made_sql('part', _FIXES)}), k AS (SELECT *, {_TRIPLE} AS old, {_TRIPLE.replace('version', 'fixed')} AS new FROM f)
SELECT name, version, first(fixed ORDER BY new) AS fixed FROM k WHERE new > old GROUP BY name, version""")
def _(spark, sf_dir):
    rows = made(spark, sf_dir, "part", _FIXES).select("name", "version", F.array("f1", "f2", "f3").alias("fixed"))
    return deps.least_fixed(rows)


_LOCK = (
    "'{\"packages\":{\"\":{\"version\":\"9.9.9\"},\"node_modules/part-' || p_partkey || '\":{\"version\":\"1.' || p_size || '.0\"},\"node_modules/part-' || p_partkey || '/node_modules/@s/size-' || p_size || '\":{\"version\":\"2.1.0\"},\"node_modules/link\":{\"link\":true},\"node_modules/odd\":{\"version\":\"file:x\"}}}' AS content",
)


@query("lockfile_npm", "SELECT DISTINCT 'part-' || p_partkey AS name, '1.' || p_size || '.0' AS version FROM part UNION ALL SELECT DISTINCT '@s/size-' || p_size, '2.1.0' FROM part")
def _(spark, sf_dir):
    """A lockfile for each part, with a package, one within it, a root, a link and a file."""
    return deps.npm_packages(made(spark, sf_dir, "part", _LOCK))


_NAMED = ("p_partkey", _case("p_partkey", "'node_modules/a/node_modules/'", "'node_modules/@s/'", "'node_modules/@s/b/node_modules/@t/'") + " || 'part-' || p_partkey AS p", _case("p_partkey", "'@s/part-' || p_partkey || '@^1'", "'part-' || p_partkey || '@npm:1'") + " AS s")


@query("package_names", f"SELECT p_partkey, string_split(p, 'node_modules/')[-1] AS of_path, left(s, length(s) - strpos(reverse(s), '@')) AS of_selector FROM {made_sql('part', _NAMED)}")
def _(spark, sf_dir):
    return made(spark, sf_dir, "part", _NAMED).select("p_partkey", S.package_of_path(F.col("p")).alias("of_path"), S.package_of_selector(F.col("s")).alias("of_selector"))


# ---- Paths and registries ------------------------------------------------------------------------

_PATHS = ("o_orderkey", _case("o_orderkey", "'a/'", "'../'", "'/etc/'", "'a/../'", "'a..b/'", "'src/node_modules/'", "'build/'", "'rebuild/'", "'a/b..'") + " || 'x' || o_custkey || " + _case("o_custkey", "'.js'", "'/..'", "'/dist'") + " AS p")
_PARTS = "string_split(p, '/')"


@query("path_safety", f"SELECT o_orderkey, starts_with(p, '/') OR list_contains({_PARTS}, '..') AS unsafe, list_has_any({_PARTS}[:-2], ['node_modules', 'build', 'dist']) AS pruned FROM {made_sql('orders', _PATHS)}")
def _(spark, sf_dir):
    return made(spark, sf_dir, "orders", _PATHS).select("o_orderkey", readers.unsafe(F.col("p")).alias("unsafe"), readers.pruned(F.col("p")).alias("pruned"))


_EXCEPTIONS = (
    "'e' || CASE WHEN sale_id % 9 = 1 THEN sale_id - 1 ELSE sale_id END AS id", "CASE WHEN sale_id % 13 = 0 THEN ' ' ELSE status END AS rule",
    _case("sale_id", "'path:a'", "'fingerprint:b'", "'file:a'", "'path:c'", "CAST(NULL AS STRING)") + " AS scope", "'why' AS reason", "CASE WHEN client_id IS NULL THEN '' ELSE 'o' || client_id END AS owner", "'2024-01-01' AS created_at",
    _case("sale_id", "CAST(CAST(sold_at AS DATE) AS STRING)", "CAST(NULL AS STRING)", "'2024-13-01'", "''", "'2024-03-07'", "'soon'") + " AS expires_at",
)
_DATED = f"(SELECT *, TRY_CAST(expires_at AS DATE) AS d FROM {made_sql('sales', _EXCEPTIONS)})"
_TODAY = "DATE '2024-03-01'"
_BLANK = "coalesce(trim({c}) = '', TRUE)"


def _exceptions(spark, sf_dir):
    return made(spark, sf_dir, "sales", _EXCEPTIONS)


@query("exception_validate", f"WITH e AS (SELECT *, count(*) OVER (PARTITION BY id) AS many FROM {_DATED}) " + " UNION ALL ".join(
    [f"SELECT id, 'missing {c}' AS problem FROM e WHERE {_BLANK.format(c=c)}" for c in ("id", "rule", "scope", "reason", "owner", "created_at")]
    + ["SELECT id, 'duplicate id' FROM e WHERE many > 1", "SELECT id, 'bad scope' FROM e WHERE trim(scope) <> '' AND NOT (starts_with(scope, 'path:') OR starts_with(scope, 'fingerprint:'))"]
    + ["SELECT id, 'bad date' FROM e WHERE trim(expires_at) <> '' AND d IS NULL", f"SELECT id, 'expired' FROM e WHERE d < {_TODAY}"]))
def _(spark, sf_dir):
    """A registry with an exception for each sale: repeated ids, blank fields, odd scopes and dates."""
    return findings.validate_exceptions(_exceptions(spark, sf_dir), F.lit("2024-03-01").cast("date"))


@query("expiry_status", f"SELECT id, CASE WHEN d < {_TODAY} THEN 'expired' WHEN d - {_TODAY} <= 7 THEN 'expiring_soon' ELSE 'active' END AS status FROM {_DATED}")
def _(spark, sf_dir):
    return _exceptions(spark, sf_dir).select("id", findings.expiry_status(F.col("expires_at"), F.lit("2024-03-01").cast("date")).alias("status"))


_KNOWN = ("client_id", "CASE WHEN client_id % 5 <> 0 THEN updated_at END AS until")


@query("exception_check", f"""WITH k AS (SELECT client_id AS id, max(until) AS u FROM {made_sql('clients', _KNOWN)} WHERE client_id % 3 <> 0 GROUP BY 1), i AS (SELECT DISTINCT client_id AS id FROM sales)
SELECT i.id, CASE WHEN k.id IS NULL THEN 'NotExcepted' WHEN u < TIMESTAMP '2024-03-01' THEN 'Expired' ELSE 'Active' END AS status FROM i LEFT JOIN k ON i.id = k.id""")
def _(spark, sf_dir):
    """The clients of sales against a registry of two thirds of all clients, some without an end."""
    known = made(spark, sf_dir, "clients", _KNOWN).filter("client_id % 3 <> 0").groupBy(F.col("client_id").alias("id")).agg(F.max("until").alias("expires_at"))
    ids = table(spark, sf_dir, "sales").select(F.col("client_id").alias("id")).distinct()
    return findings.check_exceptions(ids, known, F.lit("2024-03-01").cast("timestamp_ntz")).select("id", "status")

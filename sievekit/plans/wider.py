"""Queries of accounts, configurations, evidence, lockfiles and advisories, with the SQL that checks them.

Inputs that the tables lack (paths, lockfiles, JSON records) are made of the tables' rows, so each query runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import config
from sievekit.functions import scalars as S
from sievekit.operators import deps, evidence, findings, metrics, report, scan
from sievekit.plans.catalog import FOUND, STATUS, _SIGNALS, documents, found, query, stated, table, weekly
from sievekit.sources import lockfiles, readers

# ---- Accounts of a scan ----------------------------------------------------------------------------

_FOLDERS = ("src", "target", "lib", "node_modules", "a", "dist", "doc")
_PICK = "['src', 'target', 'lib', 'node_modules', 'a', 'dist', 'doc'][o_custkey % 7 + 1]"


def _paths(spark, sf_dir):
    """A path for each order, in folders of which some are never walked into."""
    pick = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("o_custkey") % 7 + 1).cast("int"))
    more = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(pick, F.lit("/"), more, F.lit("/x"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("path"))


@query("file_counts", "WITH f AS (SELECT CASE WHEN contains(text, chr(0)) THEN 'BINARY_FILE' WHEN strlen(text) > 5000 THEN 'MAX_FILE_SIZE' END AS skipped FROM documents) SELECT count(*) AS total_files, count(*) FILTER (skipped IS NULL) AS scanned_files, count(*) FILTER (skipped IS NOT NULL) AS skipped_files, count(*) = 1000 AS file_limit_reached, coalesce(bool_or(skipped = 'MAX_FILE_SIZE'), FALSE) AS max_file_size_reached, FALSE AS read_error_reached FROM f")
def _(spark, sf_dir):
    content = F.col("text").cast("binary")
    return scan.file_counts(table(spark, sf_dir, "documents").select(readers.skip_reason(content, F.octet_length(content), 5000).alias("skipped")), limit=1000)


@query("pruned_names", f"WITH p AS (SELECT {_PICK} AS a, ['src', 'target', 'lib', 'node_modules', 'a', 'dist', 'doc'][o_orderkey % 7 + 1] AS b FROM orders) SELECT DISTINCT CASE WHEN a IN ('target', 'node_modules', 'dist') THEN a ELSE b END AS name FROM p WHERE a IN ('target', 'node_modules', 'dist') OR b IN ('target', 'node_modules', 'dist')")
def _(spark, sf_dir):
    return scan.pruned_names(_paths(spark, sf_dir))


@query("shared_limit", FOUND + ", roots AS (SELECT *, CAST(path AS BIGINT) % 3 AS source FROM graded), left_ AS (SELECT source, greatest(0, 150 - coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS allowed FROM (SELECT source, count(*) AS n FROM roots GROUP BY source)), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path, line_number, byte_start, byte_end, rule_id) AS k FROM roots) SELECT CAST(source AS INT) AS source, path, line_number, rule_id, byte_start FROM placed JOIN left_ USING (source) WHERE k <= allowed")
def _(spark, sf_dir):
    every = found(spark, sf_dir)
    roots = scan.together([every.filter(F.col("path").cast("long") % 3 == k) for k in range(3)])
    return scan.shared_limit(roots, 150).select("source", "path", "line_number", "rule_id", "byte_start")


@query("finding_ids", FOUND + " SELECT path, line_number, rule_id, byte_start, 'fx_' || sha256(concat_ws(chr(10), rule_id, path, line_number, byte_start, byte_end, sha256(trim(matched_content)))) AS id FROM graded")
def _(spark, sf_dir):
    id_ = scan.finding_id(F.col("rule_id"), F.col("path"), F.col("line_number"), F.col("byte_start"), F.col("byte_end"), F.col("matched_content"))
    return found(spark, sf_dir).select("path", "line_number", "rule_id", "byte_start", id_.alias("id"))


# ---- Reports ---------------------------------------------------------------------------------------


@query("report_json", STATUS + """ SELECT '{"path":"' || path || '","line_number":' || line_number || ',"rule_id":"' || rule_id || '","severity":"' || severity || '","score":' || score || '}' AS json FROM stated WHERE baseline_status = 'new'""")
def _(spark, sf_dir):
    return report.json_rows(stated(spark, sf_dir), ("path", "line_number", "rule_id", "severity", "score"))


@query("report_table", FOUND + " SELECT concat_ws(' ', rpad(severity, 8, ' '), lpad(CAST(score AS VARCHAR), 3, ' '), rpad(rule_id, 30, ' '), path || ':' || line_number, masked_snippet) AS row FROM graded")
def _(spark, sf_dir):
    return report.table_rows(found(spark, sf_dir))


@query("report_filter", FOUND + " SELECT path, line_number, rule_id, score FROM graded WHERE grade IN ('High', 'Medium') AND contains(lower(rule_id || ' ' || path), 'net.')")
def _(spark, sf_dir):
    return report.shown(found(spark, sf_dir), ("High", "Medium"), "NET.").select("path", "line_number", "rule_id", "score")


# ---- Configurations ----------------------------------------------------------------------------------


@query("config_layers", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'repo' WHEN p_partkey % 3 = 0 THEN 'user' WHEN p_partkey % 2 = 0 THEN 'preset' END AS severity, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 WHEN p_partkey % 2 = 0 THEN p_size END AS score FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def _(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("size"))
    layer = lambda n, name, score: parts.filter(F.col("id") % n == 0).select("id", F.lit(name).alias("severity"), score.cast("int").alias("score"))
    return config.layered([layer(2, "preset", F.col("size")), layer(3, "user", F.col("size") + 1), layer(5, "repo", F.lit(None))], "id")


# ---- Evidence ------------------------------------------------------------------------------------------

_TAINT = "text || CASE doc_id % 9 WHEN 0 THEN ' see /home/x' WHEN 1 THEN ' ''C:\\x' WHEN 2 THEN ' file:///x' WHEN 3 THEN ' the file:// protocol' WHEN 4 THEN chr(10) || '../x' WHEN 5 THEN ' a../x https://h/home/x' WHEN 6 THEN chr(0) ELSE '' END"


@query("evidence_forbidden", f"SELECT doc_id FROM (SELECT doc_id, {_TAINT} AS t FROM documents) WHERE NOT contains(substr(t, 1, 512), chr(0)) AND regexp_matches(t, '(^|[ \\t\\n\\r\"''`])(\\.\\./|[A-Za-z]:[\\\\/]|/(Users|home|etc|var|private|Volumes|mnt)/|(?i:file):[/\\\\]+([^ \\t\\n\\r/\\\\]|\\z))')")
def _(spark, sf_dir):
    tails = {0: " see /home/x", 1: " 'C:\\x", 2: " file:///x", 3: " the file:// protocol", 4: "\n../x", 5: " a../x https://h/home/x", 6: "\x00"}
    tail = F.lit("")
    for k, text in tails.items():
        tail = F.when(F.col("doc_id") % 9 == k, text).otherwise(tail)
    return table(spark, sf_dir, "documents").filter(evidence.forbidden(F.concat("text", tail))).select("doc_id")


@query("verify_schema", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'missing name' WHEN 2 THEN 'unknown more' WHEN 3 THEN 'bad n' WHEN 4 THEN 'bad name' WHEN 5 THEN 'no object' END AS problems FROM events WHERE event_id % 6 <> 0")
def _(spark, sf_dir):
    """Records of events with one fault or none."""
    k = F.col("event_id") % 6
    number = F.when(k == 3, F.lit("-1")).otherwise(F.col("event_id").cast("string"))
    name = F.when(k == 1, F.lit("")).when(k == 4, F.lit(',"name":7')).otherwise(F.concat(F.lit(',"name":"'), F.col("event_type"), F.lit('"')))
    text = F.concat(F.lit('{"n":'), number, name, F.when(k == 2, F.lit(',"more":[]')).otherwise(F.lit(',"note":null')), F.lit("}"))
    text = F.when(k == 5, F.concat(F.lit("["), number, F.lit("]"))).otherwise(text)
    wrong = evidence.schema_problems(text, {"n": "count", "name": "string"}, {"note": "string"})
    return table(spark, sf_dir, "events").select("event_id", F.array_join(wrong, ", ").alias("problems")).filter("problems <> ''")


@query("artifact_manifest", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 1 THEN 'extra' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 1 OR doc_id % 5 = 0 EXCEPT SELECT CAST(doc_id AS VARCHAR), 'missing' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 = 1")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = lambda rows, text: rows.select("path", F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("size"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return evidence.artifact_problems(facts(docs.filter("doc_id % 11 <> 1"), F.col("text")), facts(docs.filter("doc_id % 7 <> 0"), changed))


# ---- Lockfiles and advisories ----------------------------------------------------------------------------

_VERSION = "(p_partkey % 4) || '.' || p_size || '.0'"


@query("lockfiles", f"SELECT CASE p_partkey % 5 WHEN 0 THEN 'Rust' ELSE 'Npm' END AS ecosystem, CASE p_partkey % 5 WHEN 3 THEN '@s/' ELSE '' END || 'part-' || p_partkey AS name, {_VERSION} AS version, p_partkey || ['/Cargo.lock', '/package-lock.json', '/package-lock.json', '/pnpm-lock.yaml', '/yarn.lock'][p_partkey % 5 + 1] AS location FROM part")
def _(spark, sf_dir):
    """A lockfile of one package for each part, of five forms in turn."""
    name = F.concat(F.when(F.col("p_partkey") % 5 == 3, "@s/").otherwise(""), F.lit("part-"), F.col("p_partkey").cast("string"))
    version = F.concat_ws(".", (F.col("p_partkey") % 4).cast("string"), F.col("p_size").cast("int").cast("string"), F.lit("0"))
    forms = (
        ("Cargo.lock", F.concat(F.lit('version = 3\n[[package]]\nname = "'), name, F.lit('"\nversion = "'), version, F.lit('"\n'))),
        ("package-lock.json", F.concat(F.lit('{"packages":{"":{"version":"9.9.9"},"node_modules/x/node_modules/'), name, F.lit('":{"version":"'), version, F.lit('"},"node_modules/l":{"link":true}}}'))),
        ("package-lock.json", F.concat(F.lit('{"dependencies":{"'), name, F.lit('":{"version":"'), version, F.lit('"},"f":{"version":"file:x"}}}'))),
        ("pnpm-lock.yaml", F.concat(F.lit("packages:\n  '"), name, F.lit("@"), version, F.lit("(peer@1)':\n    x: 1\n  link:x:\n"))),
        ("yarn.lock", F.concat(F.lit('"'), name, F.lit('@npm:^1", "'), name, F.lit('@npm:^2":\n  version: '), version, F.lit("\n"))),
    )
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (file, text) in enumerate(forms):
        path, content = F.when(F.col("p_partkey") % 5 == k, file).otherwise(path), F.when(F.col("p_partkey") % 5 == k, text).otherwise(content)
    return lockfiles.packages(table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), path).alias("path"), content.alias("content")))


_LABEL = "CASE WHEN state = 'fresh' THEN 'Hit (Fresh)' WHEN offline AND state = 'stale' THEN 'Hit (Stale) [Offline Fallback]' WHEN offline THEN 'Miss (No Cache)' WHEN network = 'fetched' THEN 'Fetched' WHEN network = 'error' THEN CASE WHEN state = 'stale' THEN 'Hit (Stale) [Fallback]' ELSE 'Miss (No Cache)' END WHEN state IS NULL THEN 'Miss (No Cache)' ELSE 'Hit (Fresh) [304]' END"
_FETCHES = f"WITH f AS (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL WHEN value * 10000 <= 86400 THEN 'fresh' WHEN value * 10000 <= 691200 THEN 'stale' ELSE 'expired' END AS state, event_id % 4 = 0 AS offline, ['fetched', 'not_modified', 'error'][event_id % 3 + 1] AS network FROM events), labelled AS (SELECT event_id, {_LABEL} AS cache_status FROM f)"


def _fetches(spark, sf_dir):
    state = F.when(F.col("event_id") % 10 != 9, S.freshness(F.col("value") * 10000))
    network = F.element_at(F.array(F.lit("fetched"), F.lit("not_modified"), F.lit("error")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", deps.fetch_outcome(state, F.col("event_id") % 4 == 0, network).alias("cache_status"))


@query("fetch_outcome", _FETCHES + " SELECT * FROM labelled")
def _(spark, sf_dir):
    return _fetches(spark, sf_dir)


@query("cache_counts", _FETCHES + " SELECT count(*) FILTER (cache_status LIKE '%Fresh%') AS fresh, count(*) FILTER (cache_status LIKE '%Stale%') AS stale, count(*) FILTER (cache_status = 'Fetched') AS network, CAST(0 AS BIGINT) AS offline, CAST(0 AS BIGINT) AS error FROM labelled")
def _(spark, sf_dir):
    return deps.cache_counts(_fetches(spark, sf_dir))


@query("advisory_positions", "SELECT p_partkey AS ordinal, 'part-' || p_partkey AS name, unnest(['X-' || p_size, 'Y-' || p_size]) AS id FROM part WHERE p_size % 2 = 0")
def _(spark, sf_dir):
    """Packages, and answers in the same order, of which some hold no advisory."""
    parts, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    packages = parts.select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"))
    ids = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("X-"), size), F.concat(F.lit("Y-"), size))).otherwise(F.array().cast("array<string>"))
    return deps.positional(packages, parts.select(F.col("p_partkey").alias("ordinal"), ids.alias("ids"))).select("ordinal", "name", "id")


@query("advisory_order", "WITH a AS (SELECT 'part-' || l_partkey AS name, 'X-' || l_orderkey || '-' || l_linenumber AS id, ['Critical', 'High', 'Medium', 'Low', 'Odd'][l_suppkey % 5 + 1] AS severity FROM lineitem) SELECT name, id, severity, CAST(row_number() OVER (PARTITION BY name ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END, id) AS INT) AS place, 'a,b,c' AS urls FROM a")
def _(spark, sf_dir):
    severity = F.element_at(F.array(*map(F.lit, ("Critical", "High", "Medium", "Low", "Odd"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    key = F.concat(F.lit("X-"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.lit("Npm").alias("ecosystem"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"), F.lit("1.0.0").alias("version"), key.alias("id"), severity.alias("severity"), F.array(*map(F.lit, "dbca")).alias("urls"))
    return deps.in_order(rows).select("name", "id", "severity", "place", F.array_join("urls", ",").alias("urls"))


@query("advisory_ranges", "SELECT p_partkey, p_size >= 10 AND p_size < 30 AS hit FROM part")
def _(spark, sf_dir):
    version = F.concat(F.lit("1."), F.col("p_size").cast("int").cast("string"), F.lit(".3"))
    return table(spark, sf_dir, "part").select("p_partkey", deps.satisfies(version, F.lit(">= 1.10.0, < 1.30.0")).alias("hit"))


@query("version_order", "SELECT p_partkey, p_size % 2 = 0 AS before FROM part")
def _(spark, sf_dir):
    """Pre-releases stand before their release, and numbers of a pre-release compare as numbers."""
    size = F.col("p_size").cast("int").cast("string")
    left = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1.2."), size, F.lit("-rc.9"))).otherwise(F.concat(F.lit("1.2."), size))
    return table(spark, sf_dir, "part").select("p_partkey", (deps.version_parts(left) < deps.version_parts(F.concat(F.lit("1.2."), size, F.lit("-rc.10")))).alias("before"))


# ---- Weekly reports ----------------------------------------------------------------------------------------


@query("first_actions", _SIGNALS + " SELECT week, cause, severity, CAST(row_number() OVER (PARTITION BY week ORDER BY CASE severity WHEN 'warn' THEN 10 ELSE 1 END DESC, cause, category) AS INT) AS place FROM signals QUALIFY place <= 5")
def _(spark, sf_dir):
    return metrics.first_actions(metrics.signals(weekly(spark, sf_dir), "week"), "cause", "category").select("week", "cause", "severity", "place")


@query("highest_severity", _SIGNALS + " SELECT week, CASE WHEN bool_or(severity = 'warn') THEN 'warn' ELSE 'info' END AS highest FROM signals GROUP BY week")
def _(spark, sf_dir):
    return metrics.highest_severity(metrics.signals(weekly(spark, sf_dir), "week"))


_FLAGS = {"ignores": 2, "clean": 3, "checks": 5, "hooks": 7, "readme": 11, "licence": 13}
_POINTS = "CASE WHEN o_orderkey % 2 <> 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 THEN 40 ELSE 0 END + CASE WHEN o_orderkey % 5 <> 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 7 <> 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN 10 WHEN o_orderkey % 11 <> 0 OR o_orderkey % 13 <> 0 THEN 5 ELSE 0 END"


@query("health_score", f"SELECT o_orderkey, points, CASE WHEN points >= 90 THEN 'A' WHEN points >= 70 THEN 'B' WHEN points >= 50 THEN 'C' ELSE 'F' END AS grade FROM (SELECT o_orderkey, {_POINTS} AS points FROM orders)")
def _(spark, sf_dir):
    return metrics.health(table(spark, sf_dir, "orders").select("o_orderkey", *((F.col("o_orderkey") % n != 0).alias(name) for name, n in _FLAGS.items()))).select("o_orderkey", "points", "grade")


@query("taxon_tags", "SELECT 'event.type=' || event_type AS tag, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(metrics.taxon(F.lit("event"), F.lit("type"), F.col("event_type")).alias("tag")).agg(F.count("*").alias("n"))


@query("scorecard", "SELECT event_id, CAST(floor((event_id % 100) / 10.0 * 10 + 0.5) AS BIGINT) AS points FROM events")
def _(spark, sf_dir):
    number = F.format_string("%.1f", (F.col("event_id") % 100) / 10)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"score":'), number, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"aggregateScore":'), number, F.lit("}"))).otherwise(F.concat(F.lit('{"aggregateScore":{"score":'), number, F.lit("}}")))
    return table(spark, sf_dir, "events").select("event_id", metrics.scorecard(text).alias("points"))


@query("count_maps", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def _(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    whole = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return whole.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("exceptions_order", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS INT) AS place FROM orders")
def _(spark, sf_dir):
    """Entries of a registry by id and then by where they stood, within each registry."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("id"))
    return findings.in_order(rows, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "place")

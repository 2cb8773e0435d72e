"""Queries over the whole tables for what keeps state, walks graphs, numbers rows and speaks SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievekit.operators import findings, graph, ordinals, surface, versions
from sievekit.plans.catalog import FOUND, RULES, found, query, table
from sievekit.sources import baselines, history, ignore, shared
from sievekit.streaming import edits

# ---- Detection in SQL ----------------------------------------------------------------------------


@query("scan_text_sql", FOUND + " SELECT path, line_number, rule_id, byte_start, byte_end, utf16_start, utf16_end, matched_content, masked_snippet, severity, score, grade, category FROM graded")
def _(spark, sf_dir):
    surface.register(spark, RULES)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return spark.sql("SELECT path, found.* FROM {docs}, LATERAL scan_text(text) AS found", docs=docs)


# ---- Edits ---------------------------------------------------------------------------------------


def _edits(turns):
    """Turns of conversations as edits: the first is the text, the others go in at its top; each third turn puts its text between the first two characters."""
    number = F.col("turn").cast("long")
    middle = F.when(number > 0, F.when(number % 3 == 0, 1).otherwise(0)).cast("int")
    line = F.when(number > 0, 0).cast("int")
    text = F.when(number % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    return turns.select(F.col("conv_id").cast("string").alias("doc"), number.alias("version"), line.alias("start_line"), middle.alias("start_char"), line.alias("end_line"), middle.alias("end_char"), F.when(number == 0, F.col("text")).otherwise(text).alias("text"))


_TURNS = """
WITH RECURSIVE turns AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
folded(conv_id, version, text) AS (SELECT conv_id, turn, text FROM turns WHERE turn = 0 UNION ALL
  SELECT f.conv_id, t.turn, CASE WHEN t.turn % 3 <> 0 THEN t.text || chr(10) || f.text WHEN length(f.text) = 0 OR f.text[1] = chr(10) OR f.text[1:2] = chr(13) || chr(10) OR unicode(f.text[1]) > 65535 THEN f.text ELSE f.text[1] || t.text || f.text[2:] END
  FROM folded f JOIN turns t ON t.conv_id = f.conv_id AND t.turn = f.version + 1)
SELECT CAST(conv_id AS VARCHAR) AS doc, max(version) AS version, arg_max(text, version) AS text FROM folded GROUP BY conv_id"""


@query("edited_texts", _TURNS)
def _(spark, sf_dir):
    return edits.edited_texts(_edits(table(spark, sf_dir, "conversations").filter("text is not null"))).filter("version >= 0").select("doc", "version", "text")


@query("edited_texts_stream", _TURNS)
def _(spark, sf_dir):
    """The same as a stream, file by file, with the texts in its state; each document's last row counts."""
    path = f"{sf_dir}/conversations.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[t]")  # a pattern may name a file or a folder
    out = f"{shared.shared_dir(spark)}/edited-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    before = {key: spark.conf.get(key, None) for key in edits.STATE_STORE}
    for key, value in edits.STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        texts = edits.edited_stream(_edits(stream.filter("text is not null")))
        run = texts.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/{number}"))
        run.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    rows = spark.read.schema(texts.schema.add("batch", "long")).parquet(f"{out}/rows/*")
    return rows.groupBy("doc").agg(F.max_by(F.struct("version", "text"), "batch").alias("last")).filter("last.version >= 0").select("doc", "last.*")


@query("settled_revisions", "SELECT user_id, event_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events WHERE event_id IS NOT NULL) WHERE nxt IS NULL OR nxt > ts + INTERVAL 6 HOURS")
def _(spark, sf_dir):
    return edits.settled(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "6 hours").select("user_id", "event_id", "ts")


@query("retained_runs", """
WITH able AS (SELECT event_id, ts, CAST(floor(value * 100) AS BIGINT) AS size FROM events WHERE ts IS NOT NULL AND floor(value * 100) <= 50000),
ranked AS (SELECT *, row_number() OVER w AS k, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS b, max(ts) OVER () AS newest FROM able WINDOW w AS (ORDER BY ts DESC, event_id DESC))
SELECT event_id, size FROM ranked WHERE k <= 500 AND b <= 500000 AND newest - ts <= INTERVAL 12 HOURS""")
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("size"))
    # the bounds of one run and of all are one number in a cache; here single runs are bounded lower
    able = runs.filter("size <= 50000")
    return edits.retained(able, "ts", "size", 500, 500_000, 12 * 3600, run="event_id").select("event_id", "size")


# ---- Numbers at scale ----------------------------------------------------------------------------

_PACKAGES = "WITH packages AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem), numbered AS (SELECT *, row_number() OVER (ORDER BY part, supplier) - 1 AS ordinal FROM packages)"


@query("package_ordinals", _PACKAGES + " SELECT part, supplier, ordinal, ordinal // 1000 AS chunk FROM numbered")
def _(spark, sf_dir):
    """Distinct packages in their order, numbered and dealt into requests of 1,000."""
    packages = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct()
    return ordinals.chunks(packages, ["part", "supplier"], 1000)


@query("line_ordinals", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS ordinal FROM lineitem")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return ordinals.numbered(lines, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).drop("l_shipdate")


# ---- Graphs --------------------------------------------------------------------------------------


@query("dependency_trace", """
WITH RECURSIVE edges AS (SELECT DISTINCT a.l_partkey AS parent, b.l_partkey AS child FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
targets AS (SELECT p_partkey AS node FROM part WHERE p_size = 50), members AS (SELECT p_partkey AS node FROM part WHERE p_size = 1),
walk(target, node, depth) AS (SELECT node, node, 0 FROM targets UNION SELECT w.target, e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.node WHERE w.depth < 8 AND w.node NOT IN (SELECT node FROM members)),
dist AS (SELECT target, node, min(depth) AS depth FROM walk GROUP BY ALL),
nearest AS (SELECT target, min(depth) AS depth FROM dist WHERE node IN (SELECT node FROM members) GROUP BY target),
met AS (SELECT target, min(node) AS member, depth FROM dist JOIN nearest USING (target, depth) WHERE node IN (SELECT node FROM members) GROUP BY ALL),
down(target, member, depth, here, step, path) AS (SELECT target, member, depth, member, depth, CAST(member AS VARCHAR) FROM met UNION ALL
  SELECT d.target, d.member, d.depth, (SELECT min(e.child) FROM edges e JOIN dist x ON x.node = e.child WHERE e.parent = d.here AND x.target = d.target AND x.depth = d.step - 1), d.step - 1,
    d.path || '>' || (SELECT min(e.child) FROM edges e JOIN dist x ON x.node = e.child WHERE e.parent = d.here AND x.target = d.target AND x.depth = d.step - 1) FROM down d WHERE d.step > 0)
SELECT target, member, CAST(depth AS INT) AS depth, path FROM down WHERE step = 0""")
def _(spark, sf_dir):
    """Parts of the second line of an order depend on those of the first; from each part of size 50 up to the nearest of size 1."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    edges = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("parent")).join(lines.filter("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("child")), "l_orderkey").select("parent", "child")
    part = table(spark, sf_dir, "part")
    node = F.col("p_partkey").alias("node")
    found = graph.traces(edges, part.filter("p_size = 50").select(node), part.filter("p_size = 1").select(node), 8)
    return found.select("target", "member", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


# ---- Version ranges ------------------------------------------------------------------------------

_PACKAGE = "SELECT p_name AS name, (p_size % 4) || '.' || (p_partkey % 12) || '.' || (p_size % 5) || CASE WHEN p_partkey % 7 = 0 THEN '-rc.' || (p_size % 3) ELSE '' END AS version, p_brand AS location FROM part"
_WEIGHT = "((p_size % 4) * 1000000 + (p_partkey % 12) * 1000 + p_size % 5)"


@query("advisory_join", f"""
WITH packages AS (SELECT p_name AS name, p_size % 4 AS a, p_partkey % 12 AS b, p_size % 5 AS c, p_partkey % 7 = 0 AS pre, p_size % 3 AS rc, version, location FROM (SELECT *, {_PACKAGE.removeprefix("SELECT ").removesuffix(" FROM part")} FROM part)),
advisories AS (SELECT p_type || '-' || k AS id, name, k FROM (SELECT DISTINCT p_type, p_name AS name FROM part), range(3) t(k))
SELECT DISTINCT id, name, version, location FROM packages JOIN advisories USING (name) WHERE
  k = 0 AND a = 1 AND NOT pre AND (b, c) >= (2, 0)
  OR k = 1 AND ((a, b, c) >= (0, 3, 2) AND (a, b, c) < (2, 1, 0) AND NOT pre)
  OR k = 2 AND ((a, b, c) = (2, 5, 1) AND pre AND rc >= 1 OR (a, b, c) = (2, 5, 1) AND NOT pre OR NOT pre AND a = 2 AND b = 5 AND c > 1)""")
def _(spark, sf_dir):
    """Parts by name with versions made of their numbers, pre-releases among them, against three ranges a name and type."""
    packages = table(spark, sf_dir, "part").selectExpr(*_PACKAGE.removeprefix("SELECT ").removesuffix(" FROM part").split(", "))
    ranges = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(("^1.2.0", ">= 0.3.2, < 2.1.0", "~2.5.1-rc.1"))))
    names = table(spark, sf_dir, "part").select("p_type", F.col("p_name").alias("crate_name")).distinct().withColumn("r", F.explode(ranges))
    advisories = names.select(F.concat_ws("-", "p_type", F.col("r.k").cast("string")).alias("id"), "crate_name", F.col("r.v").alias("vulnerable_versions"))
    return versions.vulnerable(packages, advisories).select("id", "name", "version", "location").distinct()


# ---- Walks and histories -------------------------------------------------------------------------

_PATHS = "SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages WHERE url IS NOT NULL"


@query("ignored_paths", f"""
WITH paths AS ({_PATHS}), parts AS (SELECT path, string_split(path, '/') AS p FROM paths WHERE path <> '')
SELECT path FROM parts WHERE p[1] LIKE 'm.%' OR len(p) > 1 AND p[1] LIKE '%spam%' AND (len(p) > 2 OR p[2] <> 'en') OR len(p) > 2 AND p[2] = 'es' AND p[1] NOT LIKE '%spam%'
  OR len(p) > 1 AND p[1] NOT LIKE '%spam%' AND p[-1] LIKE '%.html' AND p[-1] NOT LIKE '%5.html'""")
def _(spark, sf_dir):
    """Pages as files below their hosts; one ignore file at the root, one in each host with spam in its name."""
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/+$", "")
    paths = table(spark, sf_dir, "pages").select(url.alias("path"))
    lines = lambda texts: F.explode(F.array(*(F.struct(F.lit(k).alias("line_number"), F.lit(t).alias("line")) for k, t in enumerate(texts, 1))))
    root = paths.limit(1).select(F.lit("").alias("folder"), lines(["# pages", "*.html", "!*5.html", "es/", "/m.*"]).alias("r"))
    spam = paths.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).distinct().filter("folder LIKE '%spam%'").select("folder", lines(["*", "!en/"]).alias("r"))
    rules = root.union(spam).select("folder", "r.line_number", "r.line")
    return ignore.left_out(paths, rules)


_HISTORY = """
WITH commits AS (SELECT o_orderkey AS sha, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, o_orderdate AS time, o_orderstatus AS status FROM orders),
trees AS (SELECT l_orderkey AS sha, l_linenumber AS path, min(l_partkey) AS blob FROM lineitem GROUP BY ALL),
pairs AS (SELECT sha, parent, status, time FROM commits WHERE parent IS NOT NULL),
after AS (SELECT pairs.sha, path, blob FROM pairs JOIN trees USING (sha)), before AS (SELECT pairs.sha, path, blob FROM pairs JOIN trees ON trees.sha = parent),
changes AS (SELECT sha, path, CASE WHEN before.blob IS NULL THEN 'A' WHEN after.blob IS NULL THEN 'D' ELSE 'M' END AS status, coalesce(after.blob, before.blob) AS blob FROM before FULL JOIN after USING (sha, path) WHERE before.blob IS DISTINCT FROM after.blob)"""


def _history(spark, sf_dir):
    """Each customer's orders as a chain of commits, their lines as trees."""
    orders = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    commits = orders.select(F.col("o_orderkey").alias("sha"), F.lag("o_orderkey").over(order).alias("parent"), F.col("o_orderdate").alias("time"), "o_custkey", F.col("o_orderstatus").alias("status"))
    trees = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("path")).agg(F.min("l_partkey").alias("blob"))
    return commits, trees


@query("commit_changes", _HISTORY + " SELECT changes.sha, path, changes.status, blob FROM changes JOIN commits USING (sha) WHERE commits.status = 'F'")
def _(spark, sf_dir):
    commits, trees = _history(spark, sf_dir)
    return history.commit_changes(commits, trees, commits.filter("status = 'F'"))


@query("since_changes", _HISTORY + " SELECT changes.sha, path, changes.status, blob FROM changes JOIN commits USING (sha) WHERE commits.time >= (SELECT max(time) - INTERVAL 400 DAYS FROM commits)")
def _(spark, sf_dir):
    """From each customer's last order back, no further than 400 days before the newest of all."""
    commits, trees = _history(spark, sf_dir)
    heads = commits.groupBy("o_custkey").agg(F.max_by("sha", F.struct("time", "sha")).alias("head")).select("head")
    since = commits.agg(F.max("time")).first()[0]
    return history.since_changes(commits, trees, heads, F.lit(since) - F.expr("INTERVAL 400 DAYS"))


@query("baseline_table", FOUND + ", firsts AS (SELECT fingerprint, min((path, line_number, rule_id)) AS f FROM graded WHERE severity <> 'Low' GROUP BY fingerprint) SELECT path, line_number, rule_id FROM graded WHERE fingerprint NOT IN (SELECT fingerprint FROM firsts)")
def _(spark, sf_dir):
    """Findings that a committed baseline of all but the lowest severity doesn't hold."""
    every = shared.save(found(spark, sf_dir).select("path", "line_number", "rule_id", "severity", "fingerprint"), "findings")
    path = f"{shared.shared_dir(spark)}/baseline-{spark._jvm.java.util.UUID.randomUUID()}"
    baselines.write(every.filter("severity <> 'Low'"), path)
    return findings.new_findings(every, baselines.read(spark, path)).select("path", "line_number", "rule_id")

"""Weekly metrics: event counts, worklists, signals, recurrence and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What to do about a hint.
ACTIONS = {
    "retry_later": "A-WAIT-001",
    "check_network": "A-NET-001",
    "check_dns": "A-NET-002",
    "check_tls_clock": "A-SEC-001",
    "clear_cache": "A-DISK-001",
    "upgrade_tool": "A-UPG-001",
    "reduce_parallelism": "A-PERF-001",
    "check_token_permissions": "A-IAM-001",
}
UNMAPPED = "Z-UNMAPPED"
EVENT_SCHEMA = "v int, ts string, reason_code string, op string, outcome string, taxon string, detail string, hint_codes array<string>"


def reason_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys, "reason_code").agg(F.count("*").alias("n"))


def hint_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Hints of all events but those of the measuring itself; an unknown hint counts as unknown."""
    own = events.filter(~F.coalesce(F.col("op").startswith("dogfood."), F.lit(False)))
    hint = F.explode("hint_codes").alias("hint")
    return own.select(*keys, hint).withColumn("hint", F.when(F.col("hint").isin(*ACTIONS), F.col("hint")).otherwise("unknown")).groupBy(*keys, "hint").agg(F.count("*").alias("n"))


def parse_stats(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines, events and errors of a log of JSON lines; blank lines count as lines alone."""
    kept = F.trim(F.col(value)) != ""
    event = F.from_json(value, EVENT_SCHEMA)
    valid = kept & event["reason_code"].isNotNull() & event["op"].isNotNull()
    return lines.agg(F.count("*").alias("total_lines"), F.count_if(valid).alias("valid_events"), F.count_if(kept & ~valid).alias("parse_errors"))


def action_of(hint: Column) -> Column:
    out = F.lit(UNMAPPED)
    for name, action in ACTIONS.items():
        out = F.when(hint == name, action).otherwise(out)
    return out


def with_previous(counts: DataFrame, week: str, key: str) -> DataFrame:
    """Each week's count beside that of the last week before it that has any counts (0 where the key has none there)."""
    weeks = counts.select(week).distinct().withColumn("__before", F.lag(week).over(Window.orderBy(week)))
    last = counts.select(F.col(week).alias("__before"), F.col(key), F.col("n").alias("previous"))
    return counts.join(weeks, week).join(last, ["__before", key], "left").withColumn("previous", F.coalesce("previous", F.lit(0))).drop("__before")


def worklist(counts: DataFrame, week: str = "week", key: str = "hint") -> DataFrame:
    """Ranked actions of each week: ten for each event, 25 for each more than the week before."""
    both = with_previous(counts, week, key).withColumn("delta", F.col("n") - F.col("previous"))
    scored = both.withColumn("score", 10 * F.col("n") + 25 * F.greatest(F.col("delta"), F.lit(0))).withColumn("action_id", action_of(F.col(key)))
    rank = F.row_number().over(Window.partitionBy(week).orderBy(F.desc("score"), F.desc("n"), "action_id", key))
    return scored.withColumn("rank", rank)


def failure_delta(counts: DataFrame, week: str = "week") -> DataFrame:
    total = counts.groupBy(week).agg(F.sum("n").alias("n"))
    return total.withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(Window.orderBy(week)), F.lit(0)))


def signals(events: DataFrame, *keys: str) -> DataFrame:
    """Events by category and cause; warn if any failed.  The unexpected is filed under its operation."""
    odd = F.col("reason_code") == "unexpected"
    category = F.when(odd, "Unexpected").otherwise(F.initcap(F.split_part("op", F.lit("."), F.lit(1))))
    cause = F.when(odd, F.col("op")).otherwise(F.col("reason_code"))
    return events.groupBy(*keys, category.alias("category"), cause.alias("cause")).agg(F.when(F.bool_or(F.col("outcome") == "fail"), "warn").otherwise("info").alias("severity"))


def recurrence(found: DataFrame, ordinal: str = "week_no") -> DataFrame:
    """Per category and cause and week: hits so far, and whether three of some four weeks up to now had it (once so, always so)."""
    by_key = Window.partitionBy("category", "cause").orderBy(ordinal)
    weekly = found.groupBy("category", "cause", ordinal).agg(F.count("*").alias("rows_in_week"))
    recent = F.count("*").over(by_key.rangeBetween(-3, 0))
    hits = weekly.withColumn("hit_count", F.sum("rows_in_week").over(by_key.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__now", (recent >= 3).cast("int"))
    return hits.withColumn("active", F.max("__now").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__now", "rows_in_week")


def ledger(found: DataFrame, monday: str = "monday", keep: int = 8) -> DataFrame:
    """A row for each category and cause: status, first_seen and last_seen (Mondays), hit_count (rows) and its last weeks, oldest first.

    Active is what was there in three of some four weeks in a row, once.  Rows become weeks before anything else, so windows and arrays hold a key's weeks, never its rows.
    """
    weekly = found.groupBy("category", "cause", F.col(monday).alias("__monday")).agg(F.count("*").alias("__n")).filter("__monday is not null")
    number = F.floor(F.datediff("__monday", F.lit("1970-01-05").cast("date")) / 7)
    near = Window.partitionBy("category", "cause").orderBy("__number").rangeBetween(-3, 0)
    judged = weekly.withColumn("__number", number).withColumn("__now", F.count("*").over(near) >= 3)
    whole = judged.groupBy("category", "cause").agg(F.bool_or("__now").alias("__active"), F.min("__monday").alias("first_seen"), F.max("__monday").alias("last_seen"), F.sum("__n").alias("hit_count"), F.array_sort(F.collect_list("__monday")).alias("__weeks"))
    recent = F.slice("__weeks", F.greatest(F.lit(1), F.size("__weeks") - (keep - 1)), keep)
    return whole.select("category", "cause", F.when(F.col("__active"), "active").otherwise("inactive").alias("status"), "first_seen", "last_seen", "hit_count", recent.alias("recent_weeks"))


def noop_streak(found: DataFrame, week: str = "week") -> DataFrame:
    """Per week: whether its set of (category, cause, severity) is the week before's, and for how many weeks in a row."""
    sets = found.groupBy(week).agg(F.array_sort(F.collect_set(F.struct("category", "cause", "severity"))).alias("items"))
    order = Window.orderBy(week)
    marked = sets.withColumn("__same", F.coalesce(F.col("items") == F.lag("items").over(order), F.lit(False)))
    grouped = marked.withColumn("__island", F.sum((~F.col("__same")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy("__island").orderBy(week)) - 1
    return grouped.select(week, F.when(F.col("__same"), "NOOP").otherwise("CHANGED").alias("result"), streak.cast("long").alias("streak"))


def newest(rows: DataFrame, group: str, time: str, keep: int, *ties: str) -> DataFrame:
    """The rows beyond the newest `keep` of each group: candidates for removal."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(time), *ties))).filter(F.col("__k") > keep).drop("__k")


# What a severity of signals weighs.
WEIGHTS = {"critical": 100, "high": 30, "warn": 10, "info": 1}


def weight_of(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in WEIGHTS.items():
        out = F.when(F.lower(severity) == name, weight).otherwise(out)
    return out


def first_actions(found: DataFrame, *ties: str, week: str = "week", most: int = 5) -> DataFrame:
    """The signals of each week that weigh most, with their place."""
    place = F.row_number().over(Window.partitionBy(week).orderBy(weight_of(F.col("severity")).desc(), *ties))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def highest_severity(found: DataFrame, week: str = "week") -> DataFrame:
    return found.groupBy(week).agg(F.max_by("severity", weight_of(F.col("severity"))).alias("highest"))


def health(flags: DataFrame) -> DataFrame:
    """Points and grade of projects by what they have: ignores, no findings, checks, hooks, readme, licence (booleans)."""
    have = lambda name, points: F.when(F.col(name), points).otherwise(0)
    docs = F.when(F.col("readme") & F.col("licence"), 10).when(F.col("readme") | F.col("licence"), 5).otherwise(0)
    points = have("ignores", 20) + have("clean", 40) + have("checks", 20) + have("hooks", 10) + docs
    return flags.withColumn("points", points).withColumn("grade", F.when(F.col("points") >= 90, "A").when(F.col("points") >= 70, "B").when(F.col("points") >= 50, "C").otherwise("F"))


def taxon(domain: Column, key: Column, value: Column) -> Column:
    return F.format_string("%s.%s=%s", domain, key, value)


def scorecard(text: Column) -> Column:
    """Points of 100 from a scorecard's JSON: its score, or its aggregateScore, as a number or as an object with a score."""
    number = lambda path: F.get_json_object(text, path).try_cast("double")
    return F.floor(F.coalesce(number("$.score"), number("$.aggregateScore"), number("$.aggregateScore.score")) * 10 + 0.5)

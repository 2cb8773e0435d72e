"""What happens to findings: identities, baselines, exceptions, limits, safe views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions import scalars
from sievekit.functions.rules import severity_rank

ORDER = ("path", "line_number", "byte_start", "byte_end", "rule_id")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """Two matches of one rule in one line share a fingerprint, as it is made of the masked line."""
    return findings.withColumn("fingerprint", scalars.fingerprint(F.col("rule_id"), F.col("path"), F.col("line_number"), F.col("masked_snippet")))


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def suppressed_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi")


def with_status(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """baseline_status: none without a baseline, else suppressed or new."""
    if baseline is None:
        return findings.withColumn("baseline_status", F.lit("none"))
    known = baseline.select("fingerprint").distinct().withColumn("__known", F.lit(True))
    return findings.join(known, "fingerprint", "left").withColumn("baseline_status", F.when(F.col("__known"), "suppressed").otherwise("new")).drop("__known")


def baseline_entries(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint", "rule_id", "path", F.col("line_number").alias("line"), "severity")


def check_exceptions(ids: DataFrame, registry: DataFrame, now) -> DataFrame:
    """status of each id: Active, Expired (expires_at before now) or NotExcepted."""
    joined = ids.join(registry.select("id", "expires_at", F.lit(True).alias("__is")), "id", "left")
    status = F.when(F.col("__is").isNull(), "NotExcepted").when(F.col("expires_at") < now, "Expired").otherwise("Active")
    return joined.withColumn("status", status).drop("__is")


def cleaned_exceptions(registry: DataFrame, now) -> DataFrame:
    """What a registry keeps: one that ends at this very moment goes (though check_exceptions still takes it as active), one without an end stays."""
    return registry.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def validate_exceptions(registry: DataFrame, today) -> DataFrame:
    """One row for each problem of an exceptions table (id, rule, scope, reason, owner, created_at, expires_at), by id."""
    many = F.count("*").over(Window.partitionBy("id"))
    date = F.to_date(F.try_to_timestamp("expires_at", F.lit("yyyy-MM-dd")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problems = F.array_compact(F.array(
        *(F.when(blank(c), F.lit(f"missing {c}")) for c in ("id", "rule", "scope", "reason", "owner", "created_at")),
        F.when(many > 1, F.lit("duplicate id")),
        F.when(~blank("scope") & ~F.col("scope").rlike("^(path|fingerprint):"), F.lit("bad scope")),
        F.when(~blank("expires_at") & date.isNull(), F.lit("bad date")),
        F.when(date < today, F.lit("expired")),
    ))
    return registry.select("id", problems.alias("problems")).select("id", F.explode("problems").alias("problem"))


def expiry_status(expires_at, today, soon_days: int = 7):
    """expired after its day, expiring_soon within the days before, else active; blank or unreadable is active."""
    date = F.to_date(F.try_to_timestamp(expires_at, F.lit("yyyy-MM-dd")))
    return F.when(date < today, "expired").when(F.datediff(date, today) <= soon_days, "expiring_soon").otherwise("active")


def limited(findings: DataFrame, limit: int) -> DataFrame:
    """The first findings in a fixed order; 0 is no limit."""
    return findings.orderBy(*[c for c in ORDER if c in findings.columns]).limit(limit) if limit else findings


def triaged(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "path", "line_number")


def safe_view(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """What may leave the engine: the masked line and never the match; category and tags from the rules."""
    known = rules.select(F.col("id").alias("rule_id"), F.col("category").alias("__category"), F.col("tags").alias("__tags"))
    joined = findings.drop("category", "tags").join(known, "rule_id", "left")
    return joined.select("path", "line_number", "rule_id", "severity", "score", "grade", "masked_snippet", "fingerprint", F.coalesce("__category", F.lit("uncategorized")).alias("category"), F.coalesce("__tags", F.array().cast("array<string>")).alias("tags"))


def with_ordinal(findings: DataFrame) -> DataFrame:
    """A number from 0 within each path, in the fixed order."""
    return findings.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("line_number", "byte_start", "byte_end", "rule_id")) - 1)


def in_order(registry: DataFrame, group: str, position: str) -> DataFrame:
    """Exceptions numbered within their registry, by id and then by where they stood."""
    return registry.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("id", position)))

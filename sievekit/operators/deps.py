"""Dependencies: packages against advisories by version range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.scalars import backoff_ms
from sievekit.operators.versions import least_fixed, satisfies, vulnerable  # noqa: F401  (part of what is said about dependencies)


def version_key(version: Column) -> Column:
    """Major, minor and patch as an array of numbers, which compares as versions do; what follows - or + is left out."""
    parts = F.split(F.regexp_replace(version, "[-+].*$", ""), "\\.")
    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.coalesce(F.try_element_at(parts, i).try_cast("bigint"), F.lit(0)))


def grouped(found: DataFrame) -> DataFrame:
    """One row for each package: where it is and which advisories hold, both sorted and distinct."""
    return found.groupBy("ecosystem", "name", "version").agg(F.array_sort(F.collect_set("location")).alias("locations"), F.array_sort(F.collect_set("id")).alias("advisories"))


def npm_packages(lockfiles: DataFrame, content: str = "content") -> DataFrame:
    """Packages of the packages map of version 2 and 3 lockfiles: no root, no links, versions that begin with a digit."""
    entry = "map<string,struct<version:string,link:boolean>>"
    each = lockfiles.select(F.explode(F.from_json(content, f"packages {entry}")["packages"]).alias("path", "entry"))
    named = each.filter((F.col("path") != "") & ~F.coalesce(F.col("entry.link"), F.lit(False)) & F.col("entry.version").rlike("^[0-9]"))
    return named.select(F.regexp_replace("path", "^.*node_modules/", "").alias("name"), F.col("entry.version").alias("version")).distinct()


# Labels of how a record was come by.
OUTCOMES = {
    "fresh": "Hit (Fresh)", "stale_fallback": "Hit (Stale) [Fallback]", "stale_offline": "Hit (Stale) [Offline Fallback]",
    "fetched": "Fetched", "not_modified": "Hit (Fresh) [304]", "none": "Miss (No Cache)",
}


def fetch_outcome(freshness: Column, offline: Column, network: Column) -> Column:
    """How a record was come by: freshness of the cache (fresh, stale, expired, or null for none), whether offline, and what the network said
    (fetched, not_modified, error).

    A fresh entry is used as it is, a stale one where the network can't be asked or fails; not_modified needs an entry.
    """
    label = {k: F.lit(v) for k, v in OUTCOMES.items()}
    asked = F.when(network == "fetched", label["fetched"]).when((network == "not_modified") & freshness.isNotNull(), label["not_modified"])
    return (
        F.when(freshness == "fresh", label["fresh"]).when(offline & (freshness == "stale"), label["stale_offline"]).when(offline, label["none"])
        .when((network == "error") & (freshness == "stale"), label["stale_fallback"]).otherwise(F.coalesce(asked, label["none"]))
    )


def cache_counts(advisories: DataFrame, status: str = "cache_status") -> DataFrame:
    """One row: how many records came from a fresh or stale cache, the network, offline, or an error; the first that fits counts."""
    s = F.col(status)
    kind = F.when(s.isin("Network", "Fetched"), "network").when(F.contains(s, F.lit("Fresh")), "fresh").when(F.contains(s, F.lit("Stale")), "stale").when(s.startswith("Error"), "error").when(s == "Offline", "offline")
    return advisories.agg(*(F.count_if(kind == k).alias(k) for k in ("fresh", "stale", "network", "offline", "error")))


def retry_delays(calls: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Each failed call with its attempt and delay: the attempt is the number of failures of its key since the last call that went well."""
    ordered = Window.partitionBy(key).orderBy(*order)
    streak = F.sum(F.when(failed, 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    attempt = F.row_number().over(Window.partitionBy(key, "__streak", failed).orderBy(*order))
    return calls.withColumn("__streak", streak).withColumn("attempt", attempt).filter(failed).drop("__streak").withColumn("delay_ms", backoff_ms(F.col("attempt")))


def positional(packages: DataFrame, answers: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Packages (ordinal, ...) with their answers (ordinal, ids: array of advisories), a row for each advisory."""
    return packages.join(answers, ordinal).withColumn("id", F.explode("ids")).drop("ids")


def in_order(advisories: DataFrame) -> DataFrame:
    """Each package's advisories numbered, the severest first and then by id, with their first three links by name."""
    weight = F.lit(4)
    for k, name in enumerate(("Critical", "High", "Medium", "Low")):
        weight = F.when(F.col("severity") == name, k).otherwise(weight)
    place = F.row_number().over(Window.partitionBy("ecosystem", "name", "version").orderBy(weight, "id"))
    return advisories.withColumn("place", place).withColumn("urls", F.slice(F.array_sort("urls"), 1, 3))


def version_parts(version: Column) -> Column:
    """What versions are compared by: numbers, whether it is a release, and the parts of a pre-release (numbers below words)."""
    tail = F.regexp_extract(version, r"^[0-9.]+-([0-9A-Za-z.-]+)", 1)
    part = lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("word"), F.when(p.rlike("^[0-9]+$"), p.try_cast("bigint")).otherwise(F.lit(0)).alias("number"), F.when(p.rlike("^[0-9]+$"), F.lit("")).otherwise(p).alias("text"))
    return F.struct(version_key(version).alias("key"), (tail == "").alias("release"), F.transform(F.when(tail == "", F.array().cast("array<string>")).otherwise(F.split(tail, "\\.")), part).alias("tail"))

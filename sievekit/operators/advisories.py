"""What the JSON record of an advisory says: fixed versions, severity, scores and links, and the advice that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators import versions

SCHEMA = (
    "affected array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>, database_specific struct<severity:string>, "
    "severity array<struct<type:string,score:string>>, references array<struct<type:string,url:string>>"
)
# Severities of records, by the words that stand for them.
SEVERITIES = {"CRITICAL": "Critical", "HIGH": "High", "MODERATE": "Medium", "MEDIUM": "Medium", "LOW": "Low"}
NO_FIX = "No fixed version available (mitigation required)"
_FULL = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"


def parsed(advisories: DataFrame, details: str = "details") -> DataFrame:
    """The table with `record`, the parts of the JSON that are used; what is no JSON, or of another form, is null there."""
    return advisories.withColumn("record", F.from_json(details, SCHEMA))


def fixed_versions(record: Column) -> Column:
    """All fixed versions of all ranges that are full versions, distinct, from the smallest on; an empty array where there are none."""
    flat = lambda a, f: F.flatten(F.transform(F.coalesce(a, F.array()), lambda x: F.coalesce(f(x), F.array())))
    events = flat(flat(record["affected"], lambda a: a["ranges"]), lambda r: r["events"])
    full = F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: F.coalesce(v.rlike(_FULL), F.lit(False)))
    ordered = F.array_sort(F.array_distinct(F.transform(full, lambda v: F.struct(versions.key(v).alias("key"), v.alias("version")))))
    return F.transform(ordered, lambda s: s["version"])


def severity(record: Column) -> Column:
    word = F.upper(record["database_specific"]["severity"])
    return F.coalesce(*(F.when(word == k, F.lit(v)) for k, v in SEVERITIES.items()), F.lit("Unknown"))


def links(record: Column, n: int = 3) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(record["references"], F.array()), lambda r: r["url"]), lambda u: u.isNotNull()))), 1, n)


def advice(version: Column, record: Column) -> Column:
    """The smallest fixed version above the one in use; of a version that can't be read, the smallest of all."""
    known = F.coalesce(version.rlike(_FULL), F.lit(False))
    fit = F.filter(fixed_versions(record), lambda v: ~known | F.coalesce(versions.key(v) > versions.key(version), F.lit(False)))
    return F.coalesce(F.concat(F.lit("Upgrade to >= "), F.try_element_at(fit, F.lit(1))), F.lit(NO_FIX))


def described(found: DataFrame, details: str = "details") -> DataFrame:
    """found (version, details and more) with severity, cvss (as written), urls and advice; nothing moves."""
    record = F.col("record")
    out = parsed(found, details)
    return out.select(*found.columns, severity(record).alias("severity"), F.try_element_at(record["severity"], F.lit(1))["score"].alias("cvss"), links(record).alias("urls"), advice(F.col("version"), record).alias("advice"))

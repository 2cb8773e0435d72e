"""Baselines as tables: generations of entries, of which the newest that was committed counts.

Entries are written first, by as many tasks as there are, then a manifest of one row names them; so a write that breaks off leaves the
baseline of before.  Rows that can't be entries go to a folder of their own with the reason.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "baseline.v1"
_MANIFEST = "schema string, tool string, generation bigint, name string, entries bigint, quarantined bigint, generated_at string"
_COLUMNS = "fingerprint string, rule_id string, path string, line bigint, severity string"


class IncompleteScan(ValueError):
    """A scan that hit a limit makes no baseline, as it would hide what it missed."""


def problem(rows: DataFrame) -> Column:
    """Why a row can't be an entry; null if it can."""
    return (
        F.when(F.col("fingerprint").isNull(), "no fingerprint").when(~F.col("fingerprint").rlike("^sha256:[0-9a-f]{64}$"), "broken fingerprint")
        .when(F.coalesce(F.col("rule_id"), F.lit("")) == "", "no rule").when(F.coalesce(F.col("path"), F.lit("")) == "", "no path").when(F.coalesce(F.col("line"), F.lit(0)) < 1, "no line")
    )


def manifests(spark: SparkSession, path: str) -> list:
    """All manifests, newest first; none where there is no baseline yet.  There is one row a generation, and old ones can be dropped."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests/*").orderBy(F.desc("generation"), F.desc("name")).limit(100).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def write(findings: DataFrame, path: str, complete: bool = True, tool: str = "sievekit") -> int:
    """Commit the findings (fingerprint, rule_id, path, line_number, severity) as a new generation, and return its number.  A fingerprint is one entry, that of its first place."""
    if not complete:
        raise IncompleteScan("an incomplete scan makes no baseline")
    spark = findings.sparkSession
    said = manifests(spark, path)
    generation, name = (said[0]["generation"] + 1 if said else 1), uuid.uuid4().hex
    rows = findings.select("fingerprint", "rule_id", F.col("path").cast("string").alias("path"), F.col("line_number").cast("long").alias("line"), "severity")
    rows = rows.withColumn("problem", problem(rows))
    rows.filter("problem is not null").write.parquet(f"{path}/quarantine/{name}")
    first = F.min(F.struct("path", "line", "rule_id", "severity")).alias("e")
    rows.filter("problem is null").groupBy("fingerprint").agg(first).select("fingerprint", "e.rule_id", "e.path", "e.line", "e.severity").write.parquet(f"{path}/entries/{name}")
    counts = [spark.read.parquet(f"{path}/{kind}/{name}").count() for kind in ("entries", "quarantine")]
    manifest = spark.range(1).select(F.lit(SCHEMA).alias("schema"), F.lit(tool).alias("tool"), F.lit(generation).cast("long").alias("generation"), F.lit(name).alias("name"), F.lit(counts[0]).cast("long").alias("entries"), F.lit(counts[1]).cast("long").alias("quarantined"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"))
    manifest.coalesce(1).write.json(f"{path}/manifests/{name}")
    return generation


def read(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The entries of a generation, the newest if none is named; without any baseline, none."""
    said = [m for m in manifests(spark, path) if generation in (None, m["generation"])]
    if not said:
        if generation is not None:
            raise ValueError(f"no generation {generation}")
        return spark.createDataFrame([], _COLUMNS)
    if said[0]["schema"] != SCHEMA:
        raise ValueError(f"unknown schema {said[0]['schema']}")
    return spark.read.schema(_COLUMNS).parquet(f"{path}/entries/{said[0]['name']}")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation's rows that couldn't be entries, with why."""
    said = manifests(spark, path)
    return spark.read.parquet(f"{path}/quarantine/{said[0]['name']}") if said else spark.createDataFrame([], _COLUMNS + ", problem string")

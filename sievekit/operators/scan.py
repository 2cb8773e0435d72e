"""Accounts of a scan: files, folders that were passed over, limits shared by several roots, identities of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.operators.findings import ORDER
from sievekit.sources.readers import FILE_LIMIT, PRUNED


def file_counts(files: DataFrame, limit: int = FILE_LIMIT) -> DataFrame:
    """One row: files in all, scanned and skipped ones, and which limits the scan met.  files: skipped (null where scanned).

    A scan that found as many files as it may counts as cut short.
    """
    why = lambda reason: F.coalesce(F.bool_or(F.col("skipped") == reason), F.lit(False))
    return files.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("skipped").isNull()).alias("scanned_files"), F.count_if(F.col("skipped").isNotNull()).alias("skipped_files"),
        (F.count("*") == limit).alias("file_limit_reached"), why("MAX_FILE_SIZE").alias("max_file_size_reached"), why("READ_ERROR").alias("read_error_reached"),
    )


def pruned_names(paths: DataFrame, path: str = "path") -> DataFrame:
    """name: the folders that were not walked into, of each path the first."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    first = F.try_element_at(F.filter(folders, lambda f: f.isin(*PRUNED)), F.lit(1))
    return paths.select(first.alias("name")).filter("name is not null").distinct()


def together(scans: list[DataFrame]) -> DataFrame:
    """The findings of several roots or commits, with the number of each in `source`."""
    return reduce(DataFrame.unionByName, (scan.withColumn("source", F.lit(k)) for k, scan in enumerate(scans)))


def shared_limit(findings: DataFrame, budget: int, source: str = "source") -> DataFrame:
    """The findings that one budget leaves to several roots, in the order of their numbers: each has what those before it left.

    Within a root the first ones in the fixed order stay.  Only one row for each root is counted without a partition.
    """
    counts = findings.groupBy(source).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = counts.select(source, F.greatest(F.lit(0), F.lit(budget) - before).alias("__left"))
    place = F.row_number().over(Window.partitionBy(source).orderBy(*[c for c in ORDER if c in findings.columns]))
    return findings.join(left, source).withColumn("__place", place).filter(F.col("__place") <= F.col("__left")).drop("__place", "__left")


def finding_id(rule: Column, path: Column, line: Column, start: Column, stop: Column, capture: Column) -> Column:
    """fx_ and SHA-256, in hex, over rule, path, place and the digest of the trimmed match: equal findings have equal ids, and none shows its match."""
    inner = F.sha2(F.regexp_replace(capture, r"(?U)^\s+|\s+$", ""), 256)
    return F.concat(F.lit("fx_"), F.sha2(F.concat_ws("\n", rule, path, line.cast("string"), start.cast("string"), stop.cast("string"), inner), 256))

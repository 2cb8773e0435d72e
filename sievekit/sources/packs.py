"""Evidence packs as folders: parts that Spark writes, a manifest of all their files behind them, and what is wrong with a pack."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import evidence
from sievekit.sources import readers

MANIFEST_SCHEMA = "path string, sha256 string, size bigint"
#: What gives a token away.
LEAK = r"(?i)(#token=|\?token=|Authorization:\s*Bearer\s+[A-Za-z0-9._~-]{16,})"
#: Lines of a file, so that no file is too large to be read in one row.
LINES = 1_000_000


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path (within the parts), sha256, size and content of each file of a pack."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/parts")
    return raw.select(F.substring_index("path", "/parts/", -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), F.decode("content", "UTF-8").alias("text"))


def write(folder: str, parts: dict[str, DataFrame]) -> None:
    """A pack of parts (name -> one column of text): a folder each, then the manifest.  A pack without one isn't finished.

    Each part is written by its own tasks and hashed where its files are read again; nothing passes through the driver.
    """
    spark = next(iter(parts.values())).sparkSession
    for name, lines in parts.items():
        if not name.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"{name!r} can't be the name of a part")
        lines.write.option("maxRecordsPerFile", LINES).text(f"{folder}/parts/{name}")
    _files(spark, folder).select("path", "sha256", "size").write.json(f"{folder}/manifest")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """path, problem: an unfinished pack (one row), unsafe names, missing, extra and changed files, leaked tokens, places of the machine."""
    try:
        declared = spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/manifest")
        files = _files(spark, folder)
    except AnalysisException:  # one of the two folders isn't there
        return spark.createDataFrame([(None, "unfinished")], "path string, problem string")
    bad = F.array_compact(F.array(F.when(F.col("text").rlike(LEAK), F.lit("leak")), F.when(evidence.forbidden(F.col("text")), F.lit("forbidden place"))))
    held = files.select("path", F.explode(bad).alias("problem"))
    unsafe = declared.filter(readers.unsafe(F.col("path"))).select("path", F.lit("unsafe path").alias("problem"))
    return evidence.artifact_problems(declared, files).union(held).union(unsafe)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """part, n: how many lines each part of a pack has."""
    rows = spark.read.option("recursiveFileLookup", True).text(f"{folder}/parts")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "/parts/([^/]+)/", 1).alias("part")).groupBy("part").agg(F.count("*").alias("n"))

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sievekit-shared-")
    return _own[app]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that save() wrote and that nothing reads any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch where the session leaves the default of 10,000: texts and lists of ids are long.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Keep the batches between JVM and Python at a few MB, as the memory beside the heap is small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)

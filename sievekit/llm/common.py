"""What the operators share: plain inputs, tables in the shared folder, packed binaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.sources.shared import BATCH_ROWS, forget, save, shared_dir, small_batches  # noqa: F401  (operators take them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator needs, so other columns of any name do no harm."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pack(*arrays: np.ndarray) -> tuple[int, bytes]:
    """Bytes of arrays, one after another, compressed; with the size before compression."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw), pa.compress(raw, "zstd", asbytes=True) if raw else b""


def unpack(size: int, packed: bytes) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True) if size else b""


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the ranges start .. start + length, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: Keys that may be hot, at most; rows of a key that burden no task.
HOT_KEYS, HOT_LEAST = 10_000, 100


def join_spread(rows: DataFrame, found: DataFrame, counts: DataFrame, on: list[str], spread: list[str], total: int) -> DataFrame:
    """rows joined with `found`, which has one row a key, so that no task gets all rows of a frequent key.

    counts: the keys, and __n, how many of the `total` rows have each.  A key with over total / HOT_KEYS rows is hot, so fewer than HOT_KEYS keys
    are, and only these are broadcast.  A hot key's rows are dealt by their columns `spread` to as many parts as they
    are multiples of that bound, and its row of `found` is copied to each part: 2 * HOT_KEYS copies at most.
    """
    least = max(HOT_LEAST, total // HOT_KEYS)
    hot = F.broadcast(counts.filter(F.col("__n") > least).select(*on, F.ceil(F.col("__n") / least).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("__parts")
    right = found.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*on, "__part"]).drop("__part")

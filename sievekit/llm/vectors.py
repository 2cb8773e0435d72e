"""Vectors in blocks: what the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and has only finite ones."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocked(rows: DataFrame, group: list[str], key: str, size: int, name: str = "block") -> DataFrame:
    """The rows with a block number within their group, so that blocks have about `size` rows, and the group's number of blocks.

    Rows are dealt by the hash of `key`; so a block doesn't grow with its group.
    """
    counts = rows.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))
    return rows.join(counts, group).withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int"))

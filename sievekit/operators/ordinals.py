"""Global numbers and running sums in an order, without a task that sees all rows.

The rows are dealt by ranges of the order, so a row's number is how many rows the earlier ranges have, plus its place within its own.
The ranges' counts are summed up by levels of `fan` at a time, so no task reads more of them than that, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.sources.shared import save

#: Counts that one task sums up.
FAN = 1024


def prefix_sums(counts: DataFrame, key: str, value: str, keys: int, fan: int = FAN) -> DataFrame:
    """(key, before): for each of the keys, numbers from 0 to under `keys`, the sum of the values of all smaller ones; a missing key counts as 0."""
    earlier = Window.partitionBy("__group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select(key, value, F.expr(f"{key} div {fan}").alias("__group")).withColumn("__within", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    if keys <= fan:
        return within.select(key, F.col("__within").cast("long").alias("before"))
    totals = within.groupBy(F.col("__group").alias("__above")).agg(F.sum(value).alias("__total"))
    above = prefix_sums(totals, "__above", "__total", -(-keys // fan), fan).withColumnRenamed("__above", "__group")
    return within.join(above, "__group").select(key, (F.col("before") + F.col("__within")).cast("long").alias("before"))


def _dealt(rows: DataFrame, by: Sequence[str | Column], tasks: int | None) -> tuple[DataFrame, int]:
    """The rows in ranges of the order, written, with __task and __place.  Equal rows may be parted, so that no key fills a task."""
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(tasks, *by, "__tie").sortWithinPartitions(*by, "__tie").drop("__tie")
    kept = save(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered")  # ranges are drawn from a sample, so they are fixed by writing
    return kept.withColumn("__task", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at"), tasks


def numbered(rows: DataFrame, by: Sequence[str | Column], name: str = "ordinal", tasks: int | None = None, fan: int = FAN) -> DataFrame:
    """The rows with their number from 0 in the order of `by` (ties in any order, nulls first).

    An empty table stays empty; repeated rows have numbers of their own.
    """
    dealt, tasks = _dealt(rows, by, tasks)
    counts = dealt.groupBy("__task").agg(F.count("*").alias("__n"))
    before = prefix_sums(counts, "__task", "__n", tasks, fan)
    return dealt.join(before.hint("merge"), "__task").select(*rows.columns, (F.col("before") + F.col("__place")).alias(name))


def running_sum(rows: DataFrame, by: Sequence[str | Column], value: str, name: str = "before", tasks: int | None = None, fan: int = FAN) -> DataFrame:
    """The rows with the sum of `value` over all rows before them in the order of `by`."""
    dealt, tasks = _dealt(rows, by, tasks)
    earlier = Window.partitionBy("__task").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    counts = dealt.groupBy("__task").agg(F.sum(value).alias("__n"))
    sums = prefix_sums(counts, "__task", "__n", tasks, fan).select("__task", F.col("before").alias("__before"))
    return own.join(sums.hint("merge"), "__task").select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))


def chunks(rows: DataFrame, by: Sequence[str | Column], size: int = 1000, **options) -> DataFrame:
    """The rows with their ordinal and the number of their chunk: `size` rows a chunk but for the last."""
    return numbered(rows, by, **options).withColumn("chunk", F.expr(f"ordinal div {size}"))

"""Global numbers and running sums against Python."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators import ordinals


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(None if i % 11 == 0 else (i * 37) % 50, i, "x") for i in range(500)], "k int, v long, __n string")


@pytest.mark.parametrize("fan", [2, 1024])
def test_numbers_follow_the_order(spark, rows, fan):
    out = ordinals.numbered(rows, ["k", "v"], tasks=13, fan=fan).collect()
    expected = sorted(((r["k"] if r["k"] is not None else -1, r["v"]) for r in rows.collect()))
    assert [(r["k"] if r["k"] is not None else -1, r["v"]) for r in sorted(out, key=lambda r: r["ordinal"])] == expected
    assert sorted(r["ordinal"] for r in out) == list(range(500))


def test_one_key_is_dealt_to_many_tasks(spark):
    same = spark.range(1000).select(F.lit(1).alias("k"))
    dealt, _ = ordinals._dealt(same, ["k"], 8)
    assert max(r["count"] for r in dealt.groupBy("__task").count().collect()) < 500
    assert {r["ordinal"] for r in ordinals.numbered(same, ["k"]).collect()} == set(range(1000))


def test_running_sums_and_chunks(spark, rows):
    out = {r["v"]: r["before"] for r in ordinals.running_sum(rows.select("v"), ["v"], "v", tasks=7, fan=2).collect()}
    assert out == {v: v * (v - 1) // 2 for v in range(500)}
    sizes = {r["chunk"]: r["count"] for r in ordinals.chunks(rows.select("v"), [F.col("v").desc()], 60).groupBy("chunk").count().collect()}
    assert sizes == {k: 60 for k in range(8)} | {8: 20}


def test_empty(spark, rows):
    assert ordinals.numbered(rows.limit(0), ["k"]).collect() == [] and ordinals.running_sum(rows.limit(0), ["k"], "v").collect() == []


def test_no_window_without_partition(spark, rows):
    plan = ordinals.numbered(rows, ["k", "v"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan

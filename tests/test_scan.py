"""Running totals and last values by ranges, against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mapperlake.operators import scan


@pytest.fixture(scope="module")
def lines(spark):
    r = random.Random(3)
    rows = [(g, n, r.choice([None, None, None, n * 10]), r.randint(-5, 5)) for g in ["a", "b", None, "c"] for n in range({"a": 900, "b": 3, "c": 1}.get(g, 40))]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "g string, n int, own int, v long").cache()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_last_in_group_is_the_windows(lines, parts):
    w = Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    want = lines.withColumn("owner", F.last("own", ignorenulls=True).over(w))
    got = scan.last_in_group(lines, "g", ["n"], F.col("own"), parts=parts)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_sums_and_numbers(lines):
    got = scan.running(lines.where("g = 'a'"), ["n"], sums={"total": F.col("v")}, parts=9).orderBy("n").collect()
    total = 0
    for row in got:
        total += row["v"]
        assert row["total"] == total
    assert [x["k"] for x in scan.numbered(lines, ["g", "n"], "k", parts=5).orderBy(F.col("g").asc_nulls_first(), "n").collect()] == list(range(1, lines.count() + 1))


def test_empty(lines):
    assert scan.last_in_group(lines.limit(0), "g", ["n"], F.col("own")).collect() == []


def test_a_long_group_is_spread(spark):
    """One group of 400,000 lines: no range holds more than a few times its share."""
    df = spark.range(400_000).select(F.lit("f").alias("g"), F.col("id").alias("n"), F.when(F.col("id") % 1000 == 7, F.col("id")).alias("own"))
    got = scan.last_in_group(df, "g", ["n"], F.col("own"), parts=16)
    assert got.where("owner IS DISTINCT FROM CASE WHEN n >= 7 THEN n - (n - 7) % 1000 END").count() == 0
    per = [x[0] for x in df.repartitionByRange(16, "g", "n").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(per) == 16 and max(per) < 3 * 400_000 / 16


@pytest.mark.parametrize("parts", [1, 8])
def test_enclosing_is_a_stack(spark, parts):
    from mapperlake.operators import nesting

    r, rows, want = random.Random(7), [], {}
    for g in [*"abcdef", None]:
        stack = []
        for k in range(r.choice([0, 5, 300])):
            step = r.choice([1, 1, -1, 0, 0]) if stack else r.choice([1, 0])
            if step == 1:
                stack.append(k)
            elif step == -1:
                stack.pop()
            rows.append((g, k, step))
            want[g, k] = stack[-1] if stack else None
    df = spark.createDataFrame(rows, "g string, k int, step int").repartition(5)
    got = nesting.enclosing(df, "g", "k", F.col("step"), F.col("k"), parts=parts)
    assert got.columns == ["g", "k", "step", "block"] and {(x["g"], x["k"]): x["block"] for x in got.collect()} == want

"""Running totals and last values over a total order of all rows, without a window over a whole group.

Rows are dealt out by ranges of the order, written, and reduced to one row for each range; what a range gets from
those before it is carried over these few rows; then each range fills in its own. A group of any length is thus
spread over as many tasks as the ranges it touches, and neither a group nor the whole table meets in one task.
The order must be unique (rows that tie on it stay together, and their order is open).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import cut

#: Bytes of a range, as they are written.
RANGE_BYTES = 16 << 20


def ranges(written: DataFrame) -> int:
    """How many ranges a written table is dealt to: the session's shuffle partitions, or more where they would be large. Spark's estimate is the size of its files; that of a plan with joins would be a product, far from what comes out."""
    known = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, least, -(-known // RANGE_BYTES))


def running(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """df with a column for each name: the total of a value (null counts as 0), or the last non-null value, of all rows up to and with this one.

    Only one row for each range passes through one task; these rows are as many as tasks, and are broadcast.
    """
    sums, lasts = sums or {}, lasts or {}
    names = {**{k: f"__sum_{k}" for k in sums}, **{k: f"__last_{k}" for k in lasts}}
    asked = df.withColumns({names[k]: c for k, c in (sums | lasts).items()})
    asked = cut(asked)  # its size is known, and sampling the ranges' bounds doesn't compute it again
    dealt = asked.repartitionByRange(parts or ranges(asked), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = cut(dealt).withColumn("__range", F.shiftright("__at", 33))
    totals = [F.sum(names[k]).alias(k) for k in sums] + [F.max(F.when(F.col(names[k]).isNotNull(), F.struct("__at", F.col(names[k]).alias("v")))).alias(k) for k in lasts]
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("__range").agg(*totals)
    carried = carried.select("__range", *[F.sum(k).over(before).alias(f"__before_{k}") for k in sums], *[F.last(k, ignorenulls=True).over(before).alias(f"__before_{k}") for k in lasts])
    own = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.join(F.broadcast(carried), "__range")
    filled = filled.withColumns(
        {k: F.coalesce(F.sum(names[k]).over(own), F.lit(0)) + F.coalesce(f"__before_{k}", F.lit(0)) for k in sums}
        | {k: F.coalesce(F.last(names[k], ignorenulls=True).over(own), F.col(f"__before_{k}")["v"]) for k in lasts}
    )
    return filled.select(*[c for c in df.columns if c not in names], *names)


def numbered(df: DataFrame, order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """df with each row's place in the order, from 1."""
    return running(df, order, sums={name: F.lit(1).cast("long")}, parts=parts)


def last_in_group(df: DataFrame, group: str, order: list[str], value: Column, name: str = "owner", parts: int | None = None) -> DataFrame:
    """df with the last non-null value at or before each row of its group, in the order of `order` within it (an as-of join of a group with itself).

    The last value of all rows before is the group's own only if it carries the group's key; where it doesn't, the
    group has none yet. A null group is a group of its own.
    """
    held = F.when(value.isNotNull(), F.struct(F.col(group).alias("g"), value.alias("v")))
    found = running(df, [group, *order], lasts={"__found": held}, parts=parts)
    return found.withColumn(name, F.when(F.col("__found.g").eqNullSafe(F.col(group)), F.col("__found.v"))).drop("__found")

"""Nesting by order alone: how deep each event stands, and the block that encloses it.

Events come in an order within a group (a file, a page, a statement): some open a block, some close one, others stand within. The depth is
a running total, and the block around an event is the last one opened to the event's own depth: when that one had been closed, another must have been opened
to get there again. So a stack becomes running totals and last values over ranges, for groups of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import last_in_group, running


def with_depth(events: DataFrame, group: str, order: str, step: Column, name: str = "depth", parts: int | None = None) -> DataFrame:
    """events with the sum of step (1 opens, -1 closes, 0 else) up to and with each event of its group; whatever other groups leave open doesn't count. order: numbers that are unique in a group."""
    total = running(events.withColumn("__step", step.cast("long")), [group, order], sums={"__total": F.col("__step")}, parts=parts)
    firsts = total.groupBy(group).agg(F.min_by(F.col("__total") - F.col("__step"), order).alias("__base")).withColumnRenamed(group, "__group")
    placed = total.join(firsts, F.col(group).eqNullSafe(F.col("__group")))
    return placed.withColumn(name, F.col("__total") - F.col("__base")).drop("__step", "__total", "__base", "__group")


def enclosing(events: DataFrame, group: str, order: str, step: Column, about: Column, name: str = "block", parts: int | None = None) -> DataFrame:
    """events with what `about` says of the nearest block that is open around each: of an event that opens one its own, null where none is open. A close without an open counts as one level down."""
    deep = with_depth(events.withColumn("__open", step == 1), group, order, step, "__depth", parts).withColumn("__level", F.struct(F.col(group).alias("g"), F.col("__depth").alias("d")))
    found = last_in_group(deep, "__level", [order], F.when(F.col("__open"), F.struct(about.alias("a"))), "__held", parts)
    return found.withColumn(name, F.when(F.col("__depth") > 0, F.col("__held.a"))).drop("__open", "__depth", "__level", "__held")

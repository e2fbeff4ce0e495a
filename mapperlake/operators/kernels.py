"""Relational kernels of reference resolution, on any table.

The engine applies them to mapper metadata, the query catalogue to large tables. Ties are broken by every
column of the given order, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. As a min of structs it is pre-aggregated before its one shuffle, so a frequent key costs no more than others."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return best.select(*key, *[F.col("__first")[c].alias(c) for c in df.columns if c not in key]).select(df.columns)


def conflicts(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.least(F.size(a), F.size(b))
    first_miss = F.array_position(F.slice(same, F.lit(1), F.greatest(n, F.lit(1))), False)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).when(first_miss > 0, (first_miss - 1).cast("int")).otherwise(n)


def folders(path: Column) -> Column:
    """A path's folders."""
    parts = F.split(path, r"[/\\]")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def nearest(candidates: DataFrame, ref: list[str], score: str) -> DataFrame:
    """Rows of the highest score of each ref, where only one row has it; ties give none. Two aggregations, no ordering of a whole group."""
    best = candidates.groupBy(*ref).agg(F.max_by(F.struct(*[c for c in candidates.columns if c not in ref]), F.col(score)).alias("__best"), F.max(score).alias("__top"))
    ties = candidates.groupBy(*ref, score).agg(F.count("*").alias("__ties")).withColumnRenamed(score, "__top")
    one = best.join(ties.where("__ties = 1"), [*ref, "__top"])
    return one.select(*ref, *[F.col("__best")[c].alias(c) for c in candidates.columns if c not in ref])


def nearest_by_folder(refs: DataFrame, candidates: DataFrame, name: str, parts: str, cand: str, cand_parts: str) -> DataFrame:
    """refs (name, parts; distinct) with the candidate (distinct within a name) of the name that shares most leading parts, at least one, where only one does.

    The candidates of a name are counted once for each of their prefixes; a ref reads the counts of its own prefixes, of which the
    longest that any candidate has tells how many are nearest. Rows are those of refs and candidates times their parts, never their pairs.
    """
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(c)), lambda k: F.slice(c, 1, k)))
    met = candidates.where(F.size(cand_parts) > 0).select(name, cand, prefixes(cand_parts).alias("__prefix")).groupBy(name, "__prefix").agg(F.count("*").alias("__n"), F.min(cand).alias(cand))
    held = refs.where(F.size(parts) > 0).select(name, parts, prefixes(parts).alias("__prefix")).join(met, [name, "__prefix"])
    best = held.groupBy(name, parts).agg(F.max(F.struct(F.size("__prefix").alias("shared"), F.col("__n").alias("n"), F.col(cand).alias("cand"))).alias("__x"))
    return best.where("__x.n = 1").select(name, parts, F.col("__x.cand").alias(cand))


def nearest_by_prefix(df: DataFrame, node: str, parts: str) -> DataFrame:
    """ref, cand, shared: for each node (distinct) the other one that shares most leading parts with it, where only one does.

    Nodes meet at prefixes, not in pairs: a node's longest prefix that others have too tells how much it shares, and with
    how many. Two aggregations and an equi-join, so a first part that most nodes have costs a row for each.
    """
    held = df.select(node, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, 1, k))).alias("prefix"))
    met = held.groupBy("prefix").agg(F.count("*").alias("n"), F.min(node).alias("low"), F.max(node).alias("high")).where("n > 1")
    top = held.join(met, "prefix").groupBy(node).agg(F.max(F.struct(F.size("prefix").alias("shared"), "n", "low", "high")).alias("x"))
    other = F.when(F.col("x.low") == F.col(node), F.col("x.high")).otherwise(F.col("x.low"))
    return top.where("x.n = 2").select(F.col(node).alias("ref"), other.alias("cand"), F.col("x.shared").alias("shared"))


def closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, target, depth (the least) of what each source reaches over edges (src, dst), cycles included once.

    A frontier join a round: only what the last round found is joined on, and what is known is dropped
    before it travels. Rounds end with the longest path, however long it is. Each round is written to the shared folder.
    """
    step = cut(edges.select("src", "dst").distinct())
    frontier = sources.select(F.col("node").alias("source")).distinct().join(step, F.col("source") == F.col("src")).select("source", F.col("dst").alias("target"), F.lit(1).alias("depth")).distinct()
    known = frontier = cut(frontier)
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        more = frontier.join(step, frontier["target"] == step["src"]).select("source", F.col("dst").alias("target")).distinct()
        frontier = more.join(known, ["source", "target"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(frontier)
        known = known.unionByName(frontier)
        if depth % 16 == 0:  # or the plan of all rounds' union grows without end
            known = cut(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, its lineage ends there, and a lost executor loses nothing."""
    path = cut_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df kept in memory (or on disk) and computed now, so that whatever is planned after it goes by its true size.

    Until then Spark goes by the table that df was derived from: a text made by a function counts 20 bytes, and the rows that an
    array unfolds to count once, so millions of rows look small enough to be broadcast by way of the driver.
    """
    df.persist().count()
    return df


def cut_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{_shared_dir(spark)}/mapperlake/{name}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext, path))
    return path


_written: list[tuple] = []
_own: list[str] = []


def _shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset (tests) a folder of this machine."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    if not _own:
        warnings.warn("spark.checkpoint.dir isn't set: intermediate tables go to a folder of this machine", stacklevel=2)
        _own.append("file://" + tempfile.mkdtemp(prefix="mapperlake-"))
    return _own[0]


@atexit.register
def _sweep() -> None:
    for context, path in _written:
        try:
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder's owner clears it
            pass


def near_misses(refs: DataFrame, names: DataFrame, ref: str = "ref", name: str = "name", most: int = 3) -> DataFrame:
    """ref, hints: up to `most` names (least first) that equal a ref but for case, or end with '.' and it."""
    whole = names.select(F.lower(name).alias("k"), F.col(name).alias("hint"))
    last = names.where(F.col(name).contains(".")).select(F.lower(F.regexp_extract(name, r"([^.]+)$", 1)).alias("k"), F.col(name).alias("hint"))
    hits = refs.select(F.col(ref).alias("ref"), F.lower(ref).alias("k")).join(whole.union(last).distinct(), "k").where("ref <> hint")
    return hits.groupBy("ref").agg(F.slice(F.sort_array(F.collect_set("hint")), 1, most).alias("hints"))


def search_owner(lines: DataFrame, group: str, line: str, owner: Column) -> DataFrame:
    """lines with `owner`: the last owner at or before each line of its group (an as-of join by window)."""
    w = Window.partitionBy(group).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("owner", F.last(owner, ignorenulls=True).over(w))

"""A closure that is kept up to date while edges come and go.

State is a folder: a version of the edges and of the pairs (source, target: target is reached over one edge or more) for each
batch, and one small marker file for each finished version. A batch is the net change of its rows. Removed edges: every pair that a way
over a removed edge could have made is taken out, then those that still hold are derived again from what is left (delete and
rederive). Added edges: only pairs that contain a new one are derived, from both sides, so rounds grow with the logarithm of
the new edges on a way. Pairs, edges and changes meet by shuffles alone: a batch joins some dozens of times, and broadcasts, each small enough for
Spark, would come to more than a driver takes. A version counts once its marker is there; a batch number that has been applied is
skipped, so a stream that starts again, or a batch that failed half-way, leaves what one run would have left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.operators.kernels import cut

PAIRS, EDGES = "source string, target string", "src string, dst string"


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sends neither side to the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


class MaintainedClosure:
    """A closure over string nodes in a folder that all executors share. kind: another type of the nodes."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string"):
        self.spark, self.path = spark, path.rstrip("/")
        self.pair_schema, self.edge_schema = PAIRS.replace("string", kind), EDGES.replace("string", kind)

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> tuple[int, int]:
        """(batch, version) of the last finished batch; (-1, -1) before the first."""
        fs = self._fs()
        if not fs.exists(self._file("done")):
            return -1, -1
        names = [f.getPath().getName() for f in fs.listStatus(self._file("done"))]
        done = [tuple(map(int, n.split("-"))) for n in names if not n.startswith(("_", "."))]
        return max(((b, v) for v, b in done), key=lambda x: x[1], default=(-1, -1))

    def _read(self, what: str, schema: str, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}-{version}")

    def edges(self) -> DataFrame:
        return self._read("edges", self.edge_schema, self.version()[1])

    def pairs(self) -> DataFrame:
        return self._read("pairs", self.pair_schema, self.version()[1])

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Apply changes (src, dst, added boolean, at: what orders the changes of one edge); False if the batch was applied before. Null ends are ignored; adding an edge that is there, or removing one that isn't, changes nothing."""
        last, version = self.version()
        if batch <= last:
            return False
        edges, pairs = self.edges(), self.pairs()
        net = changes.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.max_by("added", "at").alias("added"))
        net = cut(met(net, edges.withColumn("there", F.lit(True)), ["src", "dst"], "left").withColumn("there", F.coalesce("there", F.lit(False))))
        removed, added = net.where("there AND NOT added").select("src", "dst"), net.where("NOT there AND added").select("src", "dst")
        if not removed.isEmpty():
            edges = cut(met(edges, removed, ["src", "dst"], "left_anti"))
            pairs = self._without(pairs, edges, removed)
        if not added.isEmpty():
            edges = edges.unionByName(added)
            pairs = self._with(pairs, added)
        edges.write.mode("overwrite").parquet(f"{self.path}/edges-{version + 1}")
        pairs.write.mode("overwrite").parquet(f"{self.path}/pairs-{version + 1}")
        self._fs().create(self._file(f"done/{version + 1}-{batch}"), True).close()
        for what in ("edges", "pairs"):
            if version > 0:  # the one before stays, for readers that are still at it
                self._fs().delete(self._file(f"{what}-{version - 1}"), True)
        return True

    @staticmethod
    def _without(pairs: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
        """pairs that hold without the removed edges; edges are those that are left."""
        heads, tails = removed.select(F.col("src").alias("u"), F.col("dst").alias("v")), pairs.withColumnsRenamed({"source": "v", "target": "y"})
        before = pairs.select(F.col("source").alias("x"), F.col("target").alias("u")).unionByName(removed.select(F.col("src").alias("x"), F.col("src").alias("u")).distinct()).distinct()
        after = tails.select("v", "y").unionByName(removed.select(F.col("dst").alias("v"), F.col("dst").alias("y")).distinct()).distinct()
        doubtful = cut(met(met(heads, before, "u").select("x", "v").distinct(), after, "v").select(F.col("x").alias("source"), F.col("y").alias("target")).distinct())
        sure = cut(met(pairs, doubtful, ["source", "target"], "left_anti"))
        step = edges.select(F.col("src").alias("source"), F.col("dst").alias("mid"))
        direct = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))
        over_sure = met(step, sure.select(F.col("source").alias("mid"), "target"), "mid").select("source", "target")
        new = cut(met(direct.unionByName(over_sure).distinct(), doubtful, ["source", "target"], "left_semi"))
        while not new.isEmpty():
            sure, doubtful = cut(sure.unionByName(new)), cut(met(doubtful, new, ["source", "target"], "left_anti"))
            more = met(step, new.select(F.col("source").alias("mid"), "target"), "mid").select("source", "target").distinct()
            new = cut(met(more, doubtful, ["source", "target"], "left_semi"))
        return sure

    @staticmethod
    def _with(pairs: DataFrame, added: DataFrame) -> DataFrame:
        """pairs and what the added edges make of them."""
        known = pairs
        new = cut(met(added.select(F.col("src").alias("source"), F.col("dst").alias("target")), known, ["source", "target"], "left_anti"))
        while not new.isEmpty():
            known = cut(known.unionByName(new))
            ahead = met(new, known.select(F.col("source").alias("target"), F.col("target").alias("far")), "target").select("source", F.col("far").alias("target"))
            back = met(known.select(F.col("target").alias("source"), F.col("source").alias("far")), new, "source").select(F.col("far").alias("source"), "target")
            new = cut(met(ahead.unionByName(back).distinct(), known, ["source", "target"], "left_anti"))
        return known

    def follow(self, changes: DataFrame, checkpoint: str):
        """Keep the closure up to date with a streaming DataFrame of changes; returns the running query, which ends when all that is there has been applied."""
        return changes.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_of(rows: DataFrame, src: str | Column, dst: str | Column, added: Column, at: Column) -> DataFrame:
    """rows as changes of edges."""
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in ((src, "src"), (dst, "dst"))], added.alias("added"), at.alias("at"))

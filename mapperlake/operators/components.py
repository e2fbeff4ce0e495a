"""Strongly connected components of a directed graph, and what its nodes reach.

Components: nodes without a way in or out go first (each is a component by itself). Chains of nodes with one edge in and one out
are followed from both sides by doubling pointers, in rounds of the logarithm of their length, and become one edge; a ring of such
nodes is a component at once. When neither removes anything, colours do the rest: each node takes the largest node that
reaches it, over edges and over the colour's own colour, and the component of a colour's node is what gets back to it
within the colour. Chain nodes are then in their ends' component, if both ends share one.

Reach: bitmaps over node numbers, BUCKET bits a row, merged along the condensed graph from its sinks up; there are rows
for components and buckets, never for pairs of nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import cut, cut_path
from .scan import numbered

#: Bits of one row's bitmap: the size that Spark's bitmap functions have.
BUCKET = 8 * 4096
#: So few nodes in chains aren't worth rounds of their own: the colours pass them step by step.
SHORT = 16


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges whose source has a way in and whose target has a way out, again and again."""
    n = edges.count()
    while n:
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(node, before, after) of each node within a chain with the ends of it; (node, root) of nodes in rings; how many there are of both."""
    one_in = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("before")).where("n = 1").select(F.col("dst").alias("node"), "before")
    one_out = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("after")).where("n = 1").select(F.col("src").alias("node"), "after")
    held = cut(one_in.join(one_out, "node").withColumn("root", F.col("node")))
    n = held.count()
    for _ in range(n.bit_length()):
        # open: the end is itself within a chain, so it can be followed further
        back = held.select(F.col("node").alias("before"), F.col("before").alias("before2"))
        on = held.select(F.col("node").alias("after"), F.col("after").alias("after2"), F.col("root").alias("root2"))
        further = held.join(back, "before", "left").join(on, "after", "left")
        held = cut(further.select("node", F.coalesce("before2", "before").alias("before"), F.coalesce("after2", "after").alias("after"), F.least("root", F.coalesce("root2", "root")).alias("root"), F.col("after2").isNotNull().alias("open")))
        if held.where("open").isEmpty():
            break
    if "open" not in held.columns:
        held = held.withColumn("open", F.lit(False))
    inside = held.select(F.col("node").alias("after")).distinct()
    ring = held.join(inside, "after", "left_semi")  # whoever still has an end inside after so many doublings goes round
    chain = held.join(inside, "after", "left_anti")
    return chain.select("node", "before", "after"), ring.select("node", "root"), n


def _coloured(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of edges, by forward colours and backward search within them."""
    found = []
    while not edges.isEmpty():
        colour = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node")))
        while True:
            pushed = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("root").alias("pushed"))
            jumped = colour.select(F.col("node").alias("root"), F.col("root").alias("far"))
            new = colour.join(pushed, "node", "left").join(jumped, "root", "left").select("node", F.greatest("root", "pushed", "far").alias("root"), (F.greatest("root", "pushed", "far") > F.col("root")).alias("moved"))
            new = cut(new)
            colour = new.select("node", "root")
            if new.where("moved").isEmpty():
                break
        own = edges.join(colour.select(F.col("node").alias("src"), F.col("root").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst")
        within = cut(own.where("a = b").select("src", "dst", F.col("a").alias("root")))
        members = frontier = cut(colour.where("node = root").select("node", "root"))
        while True:
            back = within.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "root").distinct()
            frontier = cut(back.join(members.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            members = members.unionByName(frontier)
        members = cut(members)
        found.append(members)
        gone = members.select("node")
        edges = _trimmed(cut(within.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")))
    return reduce(DataFrame.unionByName, found) if found else edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component of every node of edges (src, dst; null ends are ignored): the least node of those that reach it and that it reaches."""
    edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    active, levels, rings = _trimmed(edges.where("src <> dst")), [], []
    while not active.isEmpty():
        chain, ring, n = _chains(active)
        if n <= SHORT:
            break
        chain, ring = cut(chain), cut(ring)
        levels.append(chain)
        rings.append(ring)
        inner = chain.select("node").unionByName(ring.select("node"))
        kept = active.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
        short = chain.select(F.col("before").alias("src"), F.col("after").alias("dst")).where("src <> dst")
        active = _trimmed(cut(kept.unionByName(short).distinct()))
    found = reduce(DataFrame.unionByName, [_coloured(active).select("node", "root"), *rings])
    for chain in reversed(levels):  # ends are resolved before what lies between them
        a, b = (found.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")) for c in ("before", "after"))
        ends = chain.join(a, "before", "left").join(b, "after", "left").select("node", F.coalesce("r_before", "before").alias("x"), F.coalesce("r_after", "after").alias("y"))
        found = cut(found.unionByName(ends.where("x = y").select("node", F.col("x").alias("root"))))
        # an end that is alone is still its own root, so that a chain back to it is found
        found = cut(found.unionByName(ends.where("x = y").select(F.col("x").alias("root")).distinct().join(found.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), "root")))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    named = found.join(least, "root").select("node", "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class Reach:
    """What the nodes of a graph reach over one edge or more, as bitmaps of its condensed graph.

    numbers: node, component, number (from 0); bits: component, bucket, bitmap.
    """

    def __init__(self, edges: DataFrame):
        edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
        parts = cut(strong_components(edges))
        self.numbers = cut(numbered(parts, ["component", "node"], "number").withColumn("number", F.col("number") - 1))
        a, b = (parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("src", "dst"))
        across = cut(edges.join(a, "src").join(b, "dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct())
        members = self.numbers.groupBy("component", F.bitmap_bucket_number(F.col("number") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("number") + 1)).alias("bitmap"))
        members = cut(members)
        steps = cut(across.where("src <> dst"))
        settled, spark = cut_path(edges.sparkSession, "reach"), edges.sparkSession  # what a component reaches, and its members: level by level from the sinks
        open_, waiting, below = steps, parts.select("component").distinct(), None
        while True:
            ready = waiting.join(open_.select(F.col("src").alias("component")).distinct(), "component", "left_anti")
            own = members.join(ready, "component", "left_semi")
            if below is not None:
                own = own.unionByName(below.join(ready, "component", "left_semi").join(spark.read.parquet(settled).withColumnRenamed("component", "dst"), "dst").select("component", "bucket", "bitmap"))
            own.groupBy("component", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).write.mode("append").parquet(settled)
            if open_.isEmpty():
                break
            below = steps.withColumnRenamed("src", "component")
            waiting = open_.select(F.col("src").alias("component")).distinct()
            open_ = cut(open_.join(waiting.withColumnRenamed("component", "dst"), "dst", "left_semi").select("src", "dst"))
        whole = spark.read.parquet(settled)
        cyclic = across.where("src = dst").select(F.col("src").alias("component"))  # a component with an edge within reaches itself
        over = steps.join(whole.withColumnRenamed("component", "dst"), "dst").select(F.col("src").alias("component"), "bucket", "bitmap")
        self.bits = cut(over.unionByName(members.join(cyclic, "component", "left_semi")).groupBy("component", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")))

    def counts(self) -> DataFrame:
        """node, n_reached of every node, 0 included."""
        n = self.bits.groupBy("component").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
        return self.numbers.join(n, "component", "left").select("node", F.coalesce("n", F.lit(0)).alias("n_reached"))

    @staticmethod
    def _bit(bitmap: Column, at: Column) -> Column:
        """The bit at a place from 0 of a bitmap."""
        byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1

    def reaches(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with `reaches`: whether a reaches b. Nodes that the graph hasn't reach nothing."""
        of = self.numbers.select(F.col("node").alias("a"), "component")
        to = self.numbers.select(F.col("node").alias("b"), F.bitmap_bucket_number(F.col("number") + 1).alias("bucket"), F.bitmap_bit_position(F.col("number") + 1).alias("at"))
        held = pairs.join(of, "a", "left").join(to, "b", "left").join(self.bits, ["component", "bucket"], "left")
        return held.select(*pairs.columns, F.coalesce(self._bit(F.col("bitmap"), F.col("at")), F.lit(False)).alias("reaches"))

    def members(self, nodes: DataFrame) -> DataFrame:
        """source, target: what each of these nodes (column node) reaches, from the bitmaps of their components."""
        asked = self.numbers.join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("source"), "component").join(self.bits, "component")
        bytes_ = asked.select("source", "bucket", F.posexplode(F.split(F.hex("bitmap"), "(?<=\\G..)")).alias("k", "h")).where("h NOT IN ('00', '')")
        bits = bytes_.select("source", "bucket", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(F.getbit(F.conv("h", 16, 10).cast("long"), j) == 1, F.col("k") * 8 + j)), lambda x: x.isNotNull())).alias("at"))
        placed = bits.withColumn("number", (F.col("bucket") - 1) * BUCKET + F.col("at"))
        return placed.join(self.numbers.select("number", F.col("node").alias("target")), "number").select("source", "target")

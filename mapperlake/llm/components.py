"""Connected components of links, in rounds of joins; nothing but two counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def components(links: DataFrame) -> DataFrame:
    """doc, label: the smallest id that each id of `links` (a, b) reaches. Ids without links aren't in the result.

    Each round gives every id the least label of its neighbours, then the label of its label; the number of
    rounds grows with the logarithm of a component's diameter in practice. Labels are pre-aggregated before each
    shuffle, and the joins are of written tables, which adaptive execution can split where one id has many links.
    """
    both = links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = stage(both.distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["doc"]).groupBy("a").agg(F.min("label").alias("m"))
        pulled = stage(labels.join(near, labels["doc"] == near["a"]).select("doc", "label", F.least("label", "m").alias("new")), "pulled")
        up = pulled.select(F.col("doc").alias("up"), F.col("new").alias("up_label"))
        jumped = stage(pulled.join(up, pulled["new"] == up["up"], "left").select("doc", "label", F.least("new", "up_label").alias("new")), "jumped")
        changed = jumped.where("label <> new").limit(1).count()
        drop_stage(labels)
        drop_stage(pulled)
        labels = jumped.select("doc", F.col("new").alias("label"))
        if not changed:
            drop_stage(both)
            return labels

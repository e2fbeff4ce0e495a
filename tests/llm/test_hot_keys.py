"""Keys that many rows share, each in another task: blocks follow their true number, with all constants as they are."""

from pyspark.sql import functions as F

from mapperlake.llm import jaccard, line_dedup

N = 10_000


def test_a_line_key_that_every_step_has_once_is_split(spark):
    """A task that saw the key made it known; the others had it once each."""
    distinct = spark.range(N).select(
        F.col("id").alias("line"), F.struct(F.col("id").alias("doc"), F.lit(0).alias("place")).alias("first"),
        F.array(F.lit(77), F.col("id") + 1000, F.col("id") + 1_000_000).cast("array<long>").alias("keys"), F.lit(0).cast("long").alias("parity"),
    )
    hot = spark.createDataFrame([(77, 3)], "key long, n long")
    met = line_dedup.meetings(distinct, hot).where("key = 77")
    parts = met.groupBy("part").count().collect()
    blocks = -(-N // line_dedup.BLOCK)
    assert len(parts) == blocks * (blocks + 1) // 2 and max(r["count"] for r in parts) < 2.2 * line_dedup.BLOCK
    assert met.groupBy("line").agg(F.countDistinct("part").alias("n")).where(f"n = {blocks}").count() == N
    pairs = met.select("part", "line").where("line IN (1, 2, 3, 5000, 9999)").alias("a").join(met.select("part", F.col("line").alias("other")).where("other IN (1, 2, 3, 5000, 9999)"), "part").select("line", "other").distinct()
    assert pairs.count() == 25, "any two lines of the key meet"


def test_a_line_key_that_no_step_found_frequent_is_split_too(spark):
    distinct = spark.range(N).select(F.col("id").alias("line"), F.struct(F.col("id").alias("doc"), F.lit(0).alias("place")).alias("first"), F.array(F.lit(77), F.col("id") + 1000, F.col("id") + 1_000_000).cast("array<long>").alias("keys"), F.lit(0).cast("long").alias("parity"))
    met = line_dedup.meetings(distinct, spark.createDataFrame([], "key long, n long")).where("key = 77")
    assert max(r["count"] for r in met.groupBy("part").count().collect()) < 2.2 * line_dedup.BLOCK


def test_a_tile_is_dealt_out_by_its_true_number(spark):
    """Tasks told two blocks for a shingle that 10,000 documents have."""
    signed = spark.range(N).select(F.col("id").alias("doc_id"), F.lit(50).cast("long").alias("n"), F.lit(b"\x01" * 32).alias("bits"), F.array().cast("array<long>").alias("postings"), F.array(F.lit(9 << 12)).cast("array<long>").alias("hot"), F.array(F.lit(2)).cast("array<long>").alias("blocks"))
    parts = jaccard.tiles(signed).groupBy("shingle", "part").count().collect()
    assert max(r["count"] for r in parts) < 2.2 * jaccard.BLOCK
    blocks = -(-N // jaccard.BLOCK)
    assert len(parts) == 2 * blocks * (blocks + 1) // 2

"""Token ids in Parquet: list columns, row groups and pages of a set size, page indexes, selective reads.

A file holds a contiguous range of doc_id, in ascending order. Ids stay below 65,536 and repeat, so their
column is dictionary-coded; doc_id, segment, place and counts are delta-coded (version 2 pages). `place` is a
document's row in its file, which tells the order of rows that share a doc_id. The writer is Spark's, so any store it reaches will do and a lost task leaves nothing behind.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_path, tasks, texts_of
from .tokens import encoder, slices

SCHEMA = "segment int, place long, doc_id long, n_tokens long, ids array<int>"


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """segment, place, doc_id, n_tokens, ids: every whole text's ids (null: none) and end_id. Repeated rows stay apart."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        enc, end, place = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 2_000_000):
                ids = [x + end for x in enc.encode(texts[a:b])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("segment").slice(a, b - a), pa.array(np.arange(place, place + b - a)), batch.column("doc_id").slice(a, b - a), pa.array(n), lists], ["segment", "place", "doc_id", "n_tokens", "ids"])
                place += b - a

    return docs.select("segment", "doc_id", "text").mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, row_group: int = 32 << 20, page: int = 256 << 10) -> None:
    """Write the token files of `docs` (doc_id, text, ...) below `path`, a file per range of doc_id.

    Null doc_ids come first; rows that share a doc_id follow each other in the order of their texts' hashes. An empty table
    gives files without rows. Other columns of docs aren't written.
    """
    n = tasks(docs)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("segment", F.spark_partition_id())
    (
        encode_documents(ordered, vocabulary, end_id)
        .write.option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false").option("parquet.enable.dictionary#place", "false")
        .option("parquet.page.row.count.limit", 2_000).option("compression", "zstd").parquet(path)
    )


def with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows (segment, place, n_tokens, ...) with start: the ids of all documents before each.

    Segment totals (one row each) are summed in order first, so that no task orders all documents.
    """
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("segment").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("segment", F.coalesce(F.sum("total").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("segment").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return running.join(F.broadcast(before), "segment").withColumn("start", F.col("before") + F.col("own")).drop("before", "own")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """segment, place, doc_id, n_tokens, start: where each document's ids begin among all ids, from the count columns alone."""
    return with_start(spark, path, spark.read.schema(SCHEMA).parquet(path).select("segment", "place", "doc_id", "n_tokens"))


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id, place, ids of documents from `first` to `last`: row groups and pages of other ranges are passed over by their statistics and page indexes."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "place", "ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what the files hold, each computed where the ids are read."""

    def check(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            col = batch.column("ids")
            flat, at = np.ascontiguousarray(col.values.to_numpy(), "<u4"), col.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("segment", "place", "doc_id")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["segment", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path).select("segment", "place", "doc_id", "ids").mapInArrow(check, "segment int, place long, doc_id long, n_tokens long, ids_crc32 long")
    return with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """read_tokens of the files that write_tokens makes of docs, in the shared folder."""
    path = stage_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path, end_id)
    return read_tokens(docs.sparkSession, path)

"""From documents to packed sequences: quality rules, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and read
again in between; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.llm import jaccard, line_dedup, packing, quality
from mapperlake.llm.common import documents, lean, stage
from mapperlake.session import ship


#: Distinct chunks that a worker keeps while packing: half of what the operator does by itself, for workers of all stages share an executor's memory.
STORE = 300_000


def _ready(spark: SparkSession) -> None:
    ship(spark)
    lean(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; of the others, their host's frequent lines go, and n_chars follows."""
    _ready(spark)
    cut = quality.clean(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Duplicate lines go, n_chars follows; a document of whose lines none is left goes."""
    _ready(spark)
    names = docs.columns
    cut = line_dedup.dedup(docs).where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(names)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays."""
    _ready(spark)
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence of at most 4096 tokens and its offset there."""
    _ready(spark)
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), store=STORE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard", dedup_near), ("packing", pack)]

#: The tokenizer, the edit join and the genetic algorithm aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of what the stages keep of documents."""
    docs = documents(spark, sf_dir)
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

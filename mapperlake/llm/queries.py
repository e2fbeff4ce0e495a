"""Queries op1 to op13 over the whole documents, pages and embeddings tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, jaccard, line_dedup, lm, mixing, packing, quality, search, sharding, token_files, vector_codes, warc
from .common import documents, lean

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


SHARDS = [f"shard-{k:02d}" for k in range(32)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by a permutation-filled table of 32 shards. Null ids have a place too; columns slot and shard of the input are replaced; an empty table gives no rows."""
    return sharding.place(documents(spark, sf_dir), SHARDS, "doc_id").select("doc_id", "slot", "shard")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; see packing.pieces and packing.pack for nulls, ties and empty tables."""
    return packing.pack_documents(documents(spark, sf_dir), WORDS).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests; see bpe.round_trip."""
    return bpe.round_trip(documents(spark, sf_dir), BYTES, public_tokenizers.PATTERN)


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness; see fingerprint.compare_edits."""
    return fingerprint.compare_edits(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; hosts are the source column; see quality.judge."""
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document over links of 80 percent or more common 5-word shingles; see jaccard.join."""
    return jaccard.join(documents(spark, sf_dir))[0]


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to Parquet in the shared folder and read back; see token_files."""
    return token_files.write_and_read(documents(spark, sf_dir), WORDS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document has and loses, and the digest of what is left; see line_dedup.dedup."""
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole text, learnt from the documents that aren't held out; see lm.score."""
    return lm.score(documents(spark, sf_dir))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, written to WARC files in the shared folder and read back; see warc.read_files."""
    lean(spark)
    return warc.write_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item; see search.search."""
    return search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks learnt from all of them; see vector_codes.compress."""
    lean(spark)
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Weights of sources in their order, repeating.
MIX = [5, 2, 1]


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of one and a half times all words takes, sources weighing 5, 2, 1; see mixing.mix."""
    return mixing.mix(documents(spark, sf_dir), MIX).drop("expected")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def sharding_sql() -> str:
    """The table filled turn by turn: a step claims the next free slot in the order of the shard whose turn it is."""
    size = sharding.next_prime(sharding.SLOTS_PER_SHARD * len(SHARDS))
    number = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE shards AS (
  SELECT s, {number.format("'offset:' || n")} % {size} AS o, {number.format("'skip:' || n")} % {size - 1} + 1 AS k
  FROM (SELECT s, 'shard-' || lpad(s::VARCHAR, 2, '0') AS n FROM range({len(SHARDS)}) r(s))
), fill(step, slot, taken, nexts) AS (
  SELECT 0, -1, list_transform(range({size}), lambda x: false), list_transform(range({len(SHARDS)}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT step + 1, (o + k * j) % {size}, taken[:((o + k * j) % {size})] || [true] || taken[((o + k * j) % {size}) + 2:], nexts[:s] || [j + 1] || nexts[s + 2:]
  FROM (
    SELECT f.*, h.*, list_filter(range(f.nexts[h.s + 1], {size}), lambda j: NOT f.taken[((h.o + h.k * j) % {size}) + 1])[1] AS j
    FROM fill f JOIN shards h ON h.s = f.step % {len(SHARDS)} WHERE f.step < {size}
  )
)
SELECT d.doc_id, f.slot::INTEGER AS slot, 'shard-' || lpad(((f.step - 1) % {len(SHARDS)})::VARCHAR, 2, '0') AS shard
FROM documents d JOIN fill f ON f.step > 0 AND f.slot = {number.format("'=' || d.doc_id")} % {size}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding_sql(), "op5_quality_rules": quality.ORACLE, "op11_lexical_search": search.ORACLE, "op12_vector_codes": vector_codes.oracle(), "op13_mixing": mixing.oracle(MIX)}

"""An inverted index of three-character pieces over the lines of texts, in Parquet.

Blocks: at most LINES neighbouring lines of a text each, in the order of their numbers. Postings: a row for each piece and each
range of RANGE block numbers, with the sorted numbers of the blocks that hold the piece, so that no piece, however
frequent, makes one large row. Rows are sorted by piece; Parquet codes the numbers as differences, row groups are small and
pages have an index, so a search reads little more than the rows it asks for.

A search looks up the pieces of its needles, takes each needle's RAREST ones, intersects their block numbers range by
range, reads the blocks that are left, and checks every line exactly. Case is folded by lower(). Needles of under three characters have
no piece: they scan all blocks.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import cut_path

LINES, RAREST = 16, 4
#: Bits of a block's number within its range.
RANGE_BITS = 16
#: Pairs of piece and block that a task sorts together; each group of them leaves it as one row, not pair by pair.
PAIRS = 4_000_000
#: Candidates (needle and block) whose blocks are asked for by number, so that other row groups aren't read; more are joined.
NEAR = 2000
#: Fixed values of the Parquet writer: delta coding (format v2 without dictionaries), small row groups and pages.
POSTINGS_FORMAT = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.block.size": str(256 << 10), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "100", "compression": "zstd"}
BLOCKS_FORMAT = {"parquet.block.size": str(1 << 20), "parquet.page.row.count.limit": "50", "compression": "zstd"}


def pieces(text: str) -> np.ndarray:
    """The distinct pieces of three characters of a lower-cased text, overlapping, as numbers of 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    found = np.sort(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    return found[np.diff(found, prepend=-1) != 0]


def spelled(numbers: np.ndarray) -> list[str]:
    """Numbers of pieces as texts."""
    parts = np.stack([numbers >> 42, numbers >> 21 & (1 << 21) - 1, numbers & (1 << 21) - 1], axis=1)
    whole = parts.astype("<u4").tobytes().decode("utf-32-le")
    return [whole[k : k + 3] for k in range(0, len(whole), 3)]


def listed(batches):
    """piece, range, blocks of a task's blocks (block, text lower-cased): of at most PAIRS pairs of piece and block, those of one piece and range are a row."""
    import pyarrow as pa

    def rows():
        piece, block = np.concatenate(held), np.repeat(np.array(numbers, np.int64), [len(x) for x in held])
        order = np.lexsort((block, piece))
        piece, block = piece[order], block[order]
        of = block >> RANGE_BITS
        first = np.flatnonzero((np.diff(piece, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        low = pa.array((block & (1 << RANGE_BITS) - 1).astype(np.int32))
        blocks = pa.ListArray.from_arrays(pa.array(np.append(first, len(piece)).astype(np.int32)), low)
        return pa.RecordBatch.from_arrays([pa.array(spelled(piece[first]), pa.string()), pa.array(of[first]), blocks], ["piece", "range", "blocks"])

    held, numbers, n = [], [], 0
    for batch in batches:
        for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.append(pieces(text))
            numbers.append(block)
            n += len(held[-1])
            if n >= PAIRS:
                yield rows()
                held, numbers, n = [], [], 0
    if n:
        yield rows()


def any_of(tests: list[Column]) -> Column:
    """Their disjunction as a balanced tree, each of which the Parquet reader can use to skip row groups."""
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def ranges(numbers: set[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1] = out[-1][0], n
        else:
            out.append((n, n))
    return out


@contextmanager
def pushed(spark: SparkSession, values: int):
    """Within it the Parquet reader skips row groups and pages by lists of so many values; the setting is put back."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(values, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class TextIndex:
    """An index in a folder; build it once, then search as often as wanted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, texts: DataFrame, key: str, text: str, path: str | None = None) -> "TextIndex":
        """Index texts (key, text; null texts have no lines) into a folder, by default a new one of the shared folder."""
        self = cls(texts.sparkSession, path or cut_path(texts.sparkSession, "text-index"))
        lines = F.split(text, "\n", -1)
        starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(LINES))
        blocks = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), lines.alias("lines"))
        blocks = blocks.select("key", F.explode(F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("lines", s + 1, F.lit(LINES)).alias("lines")))).alias("b"))
        blocks.select(F.monotonically_increasing_id().alias("block"), "key", "b.first", "b.lines").write.options(**BLOCKS_FORMAT).parquet(f"{self.path}/blocks")
        held = self.blocks.select("block", F.lower(F.concat_ws("\n", "lines")).alias("text")).mapInArrow(listed, "piece string, range long, blocks array<int>")
        postings = held.groupBy("piece", "range").agg(F.sort_array(F.flatten(F.collect_list("blocks"))).alias("blocks")).withColumn("n", F.size("blocks"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        postings.repartitionByRange(parts, "piece", "range").sortWithinPartitions("piece", "range").write.options(**POSTINGS_FORMAT).parquet(f"{self.path}/postings")
        return self

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def chosen(self, needles: list[str]) -> dict[str, list[str]]:
        """The RAREST pieces of each needle, none for a needle that has no piece; needles with a piece that no block holds are left out."""
        asked = self.spark.createDataFrame([(n,) for n in needles], "needle string").select("needle", F.lower("needle").alias("text"))
        of = {r["needle"]: spelled(pieces(r["text"])) for r in asked.collect()}
        every = sorted({p for ps in of.values() for p in ps})
        with pushed(self.spark, len(every)):
            held = self.postings.where(F.col("piece").isin(every)).groupBy("piece").agg(F.sum("n").alias("n")).collect() if every else []
        count = {r["piece"]: r["n"] for r in held}
        return {n: sorted(ps, key=lambda p: (count[p], p))[:RAREST] for n, ps in of.items() if all(p in count for p in ps)}

    def candidates(self, chosen: dict[str, list[str]]) -> DataFrame:
        """needle, block: the blocks that hold all pieces of a needle. At most RAREST lists of one range meet in a group."""
        rows = [(n, p, len(ps)) for n, ps in chosen.items() for p in ps]
        if not rows:
            return self.spark.createDataFrame([], "needle string, block long")
        asked = self.spark.createDataFrame(rows, "needle string, piece string, wanted int")
        lists = self.postings.where(F.col("piece").isin(sorted({p for _, p, _ in rows}))).join(F.broadcast(asked), "piece")
        met = lists.groupBy("needle", "range", "wanted").agg(F.collect_list("blocks").alias("ls")).where(F.size("ls") == F.col("wanted"))
        common = F.aggregate(F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))), F.element_at("ls", 1), F.array_intersect)
        return met.select("needle", F.explode(common).alias("low"), "range").select("needle", F.shiftleft("range", RANGE_BITS).bitwiseOR(F.col("low").cast("long")).alias("block"))

    def lines(self, blocks: DataFrame) -> DataFrame:
        """key, line (from 0), text and the other columns of each line of blocks."""
        rest = [c for c in blocks.columns if c not in ("key", "block", "first", "lines")]
        return blocks.select("key", "first", *rest, F.posexplode("lines").alias("n", "text")).select("key", (F.col("first") + F.col("n")).alias("line"), "text", *rest)

    def search(self, needles: list[str]) -> DataFrame:
        """needle, key, line, text of every line that holds a needle, in any case. Needles (a list of the caller's) may be of any length; an empty one is in every line."""
        needles = sorted(set(needles))
        chosen = self.chosen(needles)
        found = self.candidates({n: ps for n, ps in chosen.items() if ps})
        with pushed(self.spark, RAREST * len(needles)):
            pairs = found.limit(NEAR + 1).collect()
        if len(pairs) <= NEAR:  # few: other row groups are skipped, and the pairs go with the plan
            blocks = self.blocks.where(any_of([(F.col("block") >= a) & (F.col("block") <= b) for a, b in ranges({r["block"] for r in pairs})]))
            rows = blocks.join(F.broadcast(self.spark.createDataFrame([(r["needle"], r["block"]) for r in pairs], "needle string, block long")), "block")
        else:
            rows = self.blocks.join(found, "block")
        hits = self.lines(rows)
        short = [n for n, ps in chosen.items() if not ps]
        if short:
            every = F.explode(F.filter(F.array(*[F.lit(n) for n in short]), lambda n: F.contains(F.lower(F.concat_ws("\n", "lines")), F.lower(n))))
            hits = hits.unionByName(self.lines(self.blocks.withColumn("needle", every)))
        return hits.where(F.contains(F.lower("text"), F.lower("needle"))).select("needle", "key", "line", "text")

"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in order of their code points (null last) weigh the given weights, repeating; they share a part of
all words by weight, none gets more than MOST times its own words, and what is above is shared again by weight. That
is a level: a source's target is the least of its limit and level x weight.

Documents: a source's target is given as expected copies, one document's at most MOST. They are proportional to a
measure of the document (the query: the square root of its words, in steps of a quarter octave), again up to a level,
so that the expected words are the target. The whole part of a document's expected copies is certain. The rest is an
inclusion probability p below 1, and documents are ranked by

    (U / (1 - U)) / (p / (1 - p)),    U uniform by a hash of id and text:

Pareto order sampling, fixed-size and with unequal probabilities. The size is fixed in words: documents are taken
in rank order until the source's target is full; of the last one only the words that still fit are taken.

Where the cut lies is found by histograms of the ranks, twelve bits at a time, so neither a source nor the corpus
is ever sorted or gathered in one task: a window orders only the rows of the one bin that holds the cut, at most
BIN rows a source unless their ranks are equal to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapperlake.operators.scan import numbered, running

from .common import small, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a document at most, and times its own words that a source gets at most.
MOST = 2
#: Steps of the measure in an octave.
STEPS = 4
#: Bits of a rank, bits that a histogram resolves, and rows of a source that are put in order at last.
RANK_BITS, STEP_BITS, BIN = 60, 12, 10_000


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, u (uniform in (0, 1)), tie and row of every document, written: a row keeps its number when a task is run again."""
    key = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in (F.col("doc_id").cast("string"), F.col("source"), F.col("text"))]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *key))
    rows = docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))).alias("u"),
        F.conv(F.substring(digest, 14, 15), 16, 10).cast("long").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(rows, "mix-rows")


def source_targets(sizes: DataFrame, weights: list[int], share: float) -> DataFrame:
    """sizes (source, source_size) with target double: what each source gives to the mix.

    A source is at its limit if the level at which it gets there, applied to all, needs no more than there is; sources
    are ordered by that level, and one running total over ranges of them tells. There may be any number of sources.
    """
    ranked = numbered(sizes.withColumn("__null", F.col("source").isNull().cast("int")), ["__null", "source"], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "place", w.alias("w"), (F.col("source_size").cast("double") * MOST).alias("most"))
    filled = running(ranked.withColumn("at", F.col("most") / F.col("w")), ["at", "place"], sums={"below": F.col("most"), "light": F.col("w")})
    filled = stage(filled, "mix-sources")
    words, every = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    due = share * words
    full = F.col("below") + F.col("at") * (F.lit(every) - F.col("light")) <= due
    held, light = filled.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
    level = (due - held) / light if light else 0.0
    return filled.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.least(F.col("most"), F.lit(level) * F.col("w"))).alias("target"))


def step_of(measure: Column) -> Column:
    """A measure's step, STEPS to an octave; what is no positive number counts as 1. (A hair more, so that whole powers of two are above their step's edge whatever the logarithm's last bit.)"""
    return F.coalesce(F.floor(F.log2(F.when((measure > 0) & (measure < F.lit(float("inf"))), measure.cast("double"))) * STEPS + 1e-9), F.lit(0)).cast("int")


def expected_copies(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """source, step, source_size, target, expected, certain (words of whole copies in the source): expected copies of a document of each source and step, with target = sum of expected x size.

    steps: source, step, words. A step is at MOST if the level at which it gets there gives the source no more than its target.
    """
    m = F.pow(F.lit(2.0), F.col("step") / STEPS)
    held = targets.withColumnRenamed("source", "__source")
    t = steps.join(small(held), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("m", m).withColumn("mw", m * F.col("words"))
    of, down = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.desc("step"))
    t = t.withColumns({"above": F.sum("words").over(down), "m_above": F.sum("mw").over(down)}).withColumn("m_all", F.max("m_above").over(of))
    t = t.withColumn("full", MOST * F.col("above") + MOST / F.col("m") * (F.col("m_all") - F.col("m_above")) <= F.col("target"))
    t = t.withColumns({"held": F.coalesce(F.sum(F.when(F.col("full"), MOST * F.col("words"))).over(of), F.lit(0)), "m_held": F.coalesce(F.max(F.when(F.col("full"), F.col("m_above"))).over(of), F.lit(0.0))})
    level = (F.col("target") - F.col("held")) / (F.col("m_all") - F.col("m_held"))
    t = t.withColumn("expected", F.when(F.col("full"), float(MOST)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), level * F.col("m")))))
    t = t.withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    return t.select("source", "step", "source_size", "target", "expected", F.sum(F.floor("expected") * F.col("words")).over(of).alias("certain"))


def rank(u: Column, p: Column, tie: Column) -> Column:
    """RANK_BITS bits that order documents by their odds over their inclusion odds, lowest first; the last eight break ties."""
    q = u * (1 - p) / ((1 - u) * p)
    return F.shiftleft(F.least(F.floor(q / (1 + q) * float(1 << 52)), F.lit((1 << 52) - 1)), 8).bitwiseOR(tie.bitwiseAND(F.lit(255)))


def cuts(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, cut (struct of rank, tie, row), part: the row of each source in which its wanted words end, and how many of that row's words are within.

    ranked: source, size, rank, tie, row; wanted: source, words (above 0). A source of fewer words has no cut.
    """
    spark, low = ranked.sparkSession, RANK_BITS
    at = wanted.select(F.col("source").alias("__source"), F.col("words").alias("left"), F.lit(0).cast("long").alias("bin"))
    while True:
        same = F.col("source").eqNullSafe(F.col("__source")) & (F.shiftright("rank", low) == F.col("bin"))
        rows = ranked.join(small(at), same)
        if low < RANK_BITS and (low == 0 or at.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= BIN):
            break
        low -= STEP_BITS
        filled = rows.groupBy("source", F.shiftright("rank", low).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left"))
        filled = filled.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        filled = filled.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
        at = stage(filled.select(F.col("source").alias("__source"), (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "bin", "n"), "mix-cut")
    place = F.struct("rank", "tie", "row")
    rows = rows.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("rank", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left")))
    return rows.select("source", place.alias("cut"), (F.col("left") - F.col("upto") + F.col("size")).alias("part"))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, measure: Column | None = None, seed: int = 13) -> DataFrame:
    """doc_id, source, size, source_size, target, expected (copies), copies (whole ones that are certain), taken (words, repeats counted) of every document.

    measure: any positive column of size; the larger it is, the more copies a document may expect. The words taken of
    a source are its target, rounded, wherever it has a document to cut. A null text has no words and gives none; a
    null source is a source, a null id an id; equal rows each take part, ties are told apart by a hash of the text and
    then by place, so a rerun returns the same rows. Other columns aren't looked at. An empty table gives no rows.
    """
    if not weights or min(weights) <= 0 or not 0 <= share <= MOST:
        raise ValueError("weights must be positive, and a mix has at most MOST times all words")
    rows = sized(docs, seed).withColumn("step", step_of(F.sqrt("size") if measure is None else measure))
    steps = stage(rows.groupBy("source", "step").agg(F.sum("size").alias("words")), "mix-steps")
    targets = source_targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share)
    plan = stage(expected_copies(steps, targets), "mix-plan").withColumn("p", F.col("expected") - F.floor("expected"))
    named = plan.withColumnsRenamed({"source": "__source", "step": "__step"})
    joined = rows.join(small(named), F.col("source").eqNullSafe(F.col("__source")) & (F.col("step") == F.col("__step"))).drop("__source", "__step")
    joined = joined.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), rank(F.col("u"), F.col("p"), F.col("tie"))))
    wanted = plan.groupBy("source").agg((F.floor(F.max("target") + 0.5) - F.max("certain")).alias("words")).where("words > 0")
    cut = stage(cuts(joined.where("rank IS NOT NULL").select("source", "size", "rank", "tie", "row"), wanted), "mix-cuts")
    ends = wanted.join(cut.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").select(F.col("source").alias("__source"), "cut", "part", F.lit(True).alias("any"))
    done = joined.join(small(stage(ends, "mix-ends")), F.col("source").eqNullSafe(F.col("__source")), "left")
    place = F.struct("rank", "tie", "row")
    more = F.when(F.col("rank").isNull() | F.col("any").isNull(), 0).when(F.col("cut").isNull() | (place < F.col("cut")), F.col("size")).when(place == F.col("cut"), F.col("part")).otherwise(0)
    copies = F.floor("expected").cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("size") + more).cast("long").alias("taken"))


def oracle(weights: list[int], share: float = 1.5, seed: int = 13) -> str:
    """The same by windows over whole sources."""
    key = " || '|' || ".join(f"coalesce('=' || {c}, 'null')" for c in ("doc_id::VARCHAR", "source", "text"))
    return rf"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{seed}|' || {key}) AS h FROM documents
), d AS (
  SELECT *, (CAST('0x' || substr(h, 1, 13) AS BIGINT)::DOUBLE + 0.5) / pow(2.0, 52) AS u, CAST('0x' || substr(h, 14, 15) AS BIGINT) AS tie,
    CASE WHEN size > 0 THEN floor(log2(sqrt(size::DOUBLE)) * {STEPS} + 1e-9)::INTEGER ELSE 0 END AS step FROM rows
), s AS (
  SELECT source, source_size, place, ([{", ".join(f"{float(w)}" for w in weights)}])[((place - 1) % {len(weights)} + 1)::INTEGER] AS w, {MOST}.0::DOUBLE * source_size AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source)
), f AS (
  SELECT *, sum(most) OVER (ORDER BY most / w, place) + most / w * (sum(w) OVER () - sum(w) OVER (ORDER BY most / w, place)) <= {share}::DOUBLE * sum(source_size) OVER () AS filled FROM s
), l AS (
  SELECT ({share}::DOUBLE * sum(source_size) - coalesce(sum(most) FILTER (filled), 0.0)) / nullif(sum(w) FILTER (NOT filled), 0.0) AS level FROM f
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN most ELSE least(most, level * w) END AS target FROM f, l
), c AS (
  SELECT source, step, sum(size)::DOUBLE AS words, pow(2.0, step / {STEPS}.0::DOUBLE) AS m FROM d GROUP BY source, step
), c2 AS (
  SELECT c.*, t.source_size, t.target, sum(words) OVER v AS above, sum(m * words) OVER v AS m_above, sum(m * words) OVER (PARTITION BY c.source) AS m_all
  FROM c JOIN t ON t.source IS NOT DISTINCT FROM c.source WINDOW v AS (PARTITION BY c.source ORDER BY step DESC)
), c3 AS (
  SELECT *, {MOST} * above + {MOST} / m * greatest(0.0, m_all - m_above - 1e-9 * m_all) <= target AS filled FROM c2
), c4 AS (
  SELECT *, coalesce(sum({MOST} * words) FILTER (filled) OVER (PARTITION BY source), 0.0) AS held, coalesce(sum(m * words) FILTER (NOT filled) OVER (PARTITION BY source), 0.0) AS open_m FROM c3
), c5 AS (
  SELECT source, step, source_size, target, CASE WHEN filled THEN {MOST}.0 WHEN open_m > 0 THEN least({MOST}.0, (target - held) / open_m * m) ELSE 0.0 END AS expected, words FROM c4
), c6 AS (
  SELECT *, sum(floor(expected) * words) OVER (PARTITION BY source) AS certain, expected - floor(expected) AS p FROM c5
), r AS (
  SELECT d.doc_id, d.source, size, source_size, target, floor(expected) AS copies, floor(target + 0.5) - certain AS wanted, p > 0 AND size > 0 AS drawn,
    u * (1 - p) / ((1 - u) * nullif(p, 0)) AS q, tie, h FROM d JOIN c6 ON c6.source IS NOT DISTINCT FROM d.source AND c6.step = d.step
), x AS (
  SELECT *, sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY NOT drawn, q / (1 + q), tie, h ROWS UNBOUNDED PRECEDING) AS upto FROM r
)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, copies::INTEGER AS copies,
  (copies * size + CASE WHEN drawn THEN greatest(0, least(size, wanted - upto + size)) ELSE 0 END)::BIGINT AS taken FROM x
"""

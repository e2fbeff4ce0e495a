"""Quality rules: per-document counts, then cross-document line frequency.

Lines are normalised (words joined by one blank, A-Z lowered, digits as 0) and hashed. For every host the
distinct documents (distinct texts, so that exact copies count once) that hold a line are counted. A line in
LEAST or more of a host's documents and in PERCENT percent of them or more is boilerplate there and is removed from all
of them but the first; a document that loses more than DEPLETED percent of its words, or is left with fewer than
the FEWEST that the base rule asks of any document, is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, texts_of, trim
from .tokens import slices

LEAST, PERCENT, DEPLETED, FEWEST = 10, 2, 50, 50
SYMBOLS = "#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")

#: A column of docs with this name has the row's number.
ROW = "__row"

COUNTED = "row_id long, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def normal(line_words: list[bytes]) -> bytes:
    return b" ".join(line_words).lower().translate(_DIGITS)


def signed(b: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(b)
    return h - (h >> 63 << 64)


def without(text: str, lines: list[int]) -> str:
    """The text without the lines whose normalised hashes are given."""
    gone = set(lines)
    parts = text.encode("utf-8", "surrogatepass").split(b"\n")
    return b"\n".join(x for x in parts if not (w := x.split()) or signed(normal(w)) not in gone).decode("utf-8", "surrogatepass")


def repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    twice = set()
    for x in windows:
        if x in seen:
            twice.add(x)
        seen[x] = None
    n = end = 0
    for k, x in enumerate(windows):
        if x in twice:
            n += k + 3 - max(k, end)
            end = k + 3
    return n


def count(docs: DataFrame, host: str = "source") -> DataFrame:
    """COUNTED for every row of docs (doc_id, text, host): counts of the whole text, and its distinct normalised lines as hashes with the words each has in all. Null text: none of each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                out = []
                for t in texts[a:b]:
                    raw = t.encode("utf-8", "surrogatepass")
                    words = raw.split()
                    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
                    own: dict[bytes, int] = {}
                    for x in lines:
                        w = x.split()
                        x = normal(w)
                        own[x] = own.get(x, 0) + len(w)
                    blanks = sum(map(t.count, " \t\n\v\f\r"))
                    out.append((signed(raw), len(words), len(t) - blanks, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), [signed(x) for x in own], list(own.values())))
                columns = zip(*out, strict=True)
                types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in ("row_id", "doc_id", "host")] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in COUNTED.split(", ")])
        trim()

    number = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    return rows.mapInArrow(run, COUNTED)


def frequent_lines(counted: DataFrame, least: int = LEAST, percent: float = PERCENT) -> DataFrame:
    """host, line, n_docs, first (its doc_id and row_id) of lines in `least` or more and in `percent` percent or more of a host's distinct texts."""
    lines = counted.select("host", "text_hash", "doc_id", "row_id", F.explode("lines").alias("line"))
    once = lines.groupBy("host", "line", "text_hash").agg(F.min(F.struct("doc_id", "row_id")).alias("first"))
    often = once.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= least)
    hosts = counted.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("n_texts"))
    return often.join(hosts, "host").where(100 * F.col("n_docs") >= percent * F.col("n_texts")).drop("n_texts")


def lines_to_remove(docs: DataFrame, host: str, least: int, percent: float) -> tuple[DataFrame, DataFrame]:
    """The counted rows, and row_id, line, n (its words) of frequent lines in all rows but their first."""
    counted = stage(count(docs, host), "quality")
    frequent = stage(frequent_lines(counted, least, percent), "lines")
    held = counted.select("row_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row_id", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    return counted, held.join(small(frequent), ["host", "line"]).where(F.col("row_id") != F.col("first.row_id"))


def judge(docs: DataFrame, host: str = "source", least: int = LEAST, percent: float = PERCENT, depleted: int = DEPLETED) -> DataFrame:
    """A row per row of docs: doc_id, the counts, removed_words, base_failed, kept.

    Null or empty texts fail the base rule; a null host is a host of its own; repeated rows are judged apart
    but count as one text. A text of any length is one row and is read whole; an empty table gives no rows. Other columns
    of docs don't matter, but for ROW.
    """
    return judged_rows(*lines_to_remove(docs, host, least, percent), depleted)


def judged_rows(counted: DataFrame, lines: DataFrame, depleted: int) -> DataFrame:
    removed = lines.groupBy("row_id").agg(F.sum("n").alias("removed_words"))
    judged = counted.drop("lines", "line_words").join(removed, "row_id", "left").fillna(0, ["removed_words"])
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    drained = (100 * F.col("removed_words") > depleted * F.col("n_words")) | (F.col("n_words") - F.col("removed_words") < FEWEST)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~drained)


def keep(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that aren't rejected, with docs' columns. Rows that share a doc_id (or have none) stay if any of them is kept."""
    bad = stage(judge(docs, host).groupBy("doc_id").agg(F.max("kept").alias("any")).where(~F.col("any")).select(F.col("doc_id").alias("__doc")), "rejected")
    return docs.join(small(bad), docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")), "left_anti")


def clean(docs: DataFrame, host: str = "source", least: int = LEAST, percent: float = PERCENT, depleted: int = DEPLETED) -> DataFrame:
    """keep(docs) with texts without their host's frequent lines (only texts that lose some pass through Python); only a line's first row (the smallest doc_id, rejected or not) has it still."""
    rows = stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    counted, lines = lines_to_remove(rows, host, least, percent)
    gone = stage(lines.groupBy("row_id").agg(F.collect_set("line").alias("__gone")).withColumnRenamed("row_id", "__at"), "gone")
    bad = stage(judged_rows(counted, lines, depleted).groupBy("doc_id").agg(F.max("kept").alias("any")).where(~F.col("any")).select(F.col("doc_id").alias("__doc")), "rejected")
    kept = rows.join(small(bad), rows["doc_id"].cast("long").eqNullSafe(F.col("__doc")), "left_anti")
    gone = small(gone)
    untouched = kept.join(gone, F.col(ROW) == F.col("__at"), "left_anti").select(docs.columns)
    kept = kept.join(gone, F.col(ROW) == F.col("__at")).select(*docs.columns, "__gone")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, lines = batch.column("text").to_pylist(), batch.column("__gone").to_pylist()
            texts = [without(t, x) for t, x in zip(texts, lines, strict=True)]
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type)).drop_columns(["__gone"])
        trim()

    return untouched.unionByName(kept.mapInArrow(run, docs.schema))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), ln AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
tri AS (
  SELECT doc_id, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c >= 2
), cov AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
norm AS (
  SELECT doc_id, host, text, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS line, len(lw) AS n FROM lw
), freq AS (
  SELECT host, line, min(doc_id) AS first_doc FROM norm JOIN (SELECT host, count(DISTINCT text) AS n_texts FROM d GROUP BY host) USING (host)
  GROUP BY host, line, n_texts HAVING count(DISTINCT text) >= {LEAST} AND 100 * count(DISTINCT text) >= {PERCENT} * n_texts
), rem AS (
  SELECT n.doc_id, sum(n.n) AS n FROM norm n JOIN freq f ON n.host = f.host AND n.line = f.line WHERE n.doc_id <> f.first_doc GROUP BY n.doc_id
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rem USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * removed_words > {DEPLETED} * n_words AND n_words - removed_words >= {FEWEST} AS kept
FROM base
"""

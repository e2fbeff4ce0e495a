"""Product quantisation of vectors with codebooks of integers; nearest entries by partial-distance search.

A vector's components become integers, floor(SCALE x component), and it is cut into PARTS equal consecutive parts.
Each part position's codebook starts with that part of the ENTRIES smallest ids and is refined in rounds: every part
goes to its nearest entry, and an entry becomes the componentwise floored mean of its parts.

The nearest entry is found by partial distances: dimensions are taken in descending order of their variance over the
codebook. After the first few, the entry that leads is measured completely, which gives each part a complete distance to beat;
from then on an entry is dropped for a part as soon as its accumulated distance strictly exceeds that best, and only the
(part, entry) pairs that are left go on to further dimensions. All numbers are integers, nothing is
dropped that could still win or tie, ties go to the lower index: results equal a full search.

Rounds read the vectors where they are; a task sends one sum for each entry (ENTRIES x PARTS rows, whatever it has read),
so only the codebooks, whose size is fixed, ever pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, trim

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Dimensions that all entries are measured in before the first complete distance, and between two later selections.
FIRST, STEP = 4, 2
#: Parts that are searched at once.
BLOCK = 2048
#: Components are floored to integers below this; larger ones would overflow the sums, and count as not finite.
LARGEST = 1 << 26


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is there, with all its components present, finite and below LARGEST / SCALE, as `q` array<int>. Empty vectors go too; those of another length than the smallest id's are left out by train and encode."""
    fine = F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST / SCALE), F.lit(False)))
    return vectors.where(fine & (F.size(column) > 0)).withColumn("q", F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


class Codebook:
    """entries: (PARTS, n, width) integers. Keeps each part's dimensions in descending order of variance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.order = np.argsort(-self.entries.var(axis=1), axis=1, kind="stable")
        self.sorted = [np.ascontiguousarray(e[:, o].T) for e, o in zip(self.entries, self.order)]  # (width, n)
        self.measured = self.full = 0

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry and its squared distance, for each row of x (rows, width)."""
        best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            rows = slice(at, at + BLOCK)
            best[0][rows], best[1][rows] = self._block(part, x[rows])
        return best

    def _block(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, x = self.sorted[part], x[:, self.order[part]].astype(np.int64)
        (width, n), rows = e.shape, len(x)
        first = min(FIRST, width)
        known = np.zeros((rows, n), np.int64)
        for d in range(first):
            known += (x[:, d, None] - e[d]) ** 2
        lead = known.argmin(axis=1)
        bound = known[np.arange(rows), lead] + ((x[:, first:] - e[first:, lead].T) ** 2).sum(axis=1)
        row, entry = np.nonzero(known <= bound[:, None])
        known = known[row, entry]
        self.full += rows * n * width
        self.measured += rows * (n * first + width - first)
        for d in range(first, width, STEP):
            for k in range(d, min(d + STEP, width)):
                known += (x[row, k] - e[k, entry]) ** 2
            self.measured += len(row) * min(STEP, width - d)
            left = known <= bound[row]
            row, entry, known = row[left], entry[left], known[left]
        order = np.lexsort((entry, known, row))
        firsts = order[np.unique(row[order], return_index=True)[1]]
        return entry[firsts], known[firsts]

    def text(self) -> str:
        return ",".join(map(str, self.entries.reshape(-1).tolist()))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def first_codebook(vectors: DataFrame, width: int) -> np.ndarray:
    """The parts of the ENTRIES rows of smallest id (null last; equal ids by their vectors)."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    return np.array([r[0] for r in rows], np.int64).reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2)


def refined(vectors: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after one round of assigning and averaging."""
    parts, n, width = book.shape

    def run(batches):
        import pyarrow as pa

        own = Codebook(book)
        sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            for p in range(parts):
                piece = x[:, p * width : (p + 1) * width]
                found, _ = own.nearest(p, piece)
                order = np.argsort(found, kind="stable")
                held, at = np.unique(found[order], return_index=True)
                sums[p][held] += np.add.reduceat(piece[order].astype(np.int64), at, axis=0)
                counts[p] += np.bincount(found, minlength=n)
        p, k = np.nonzero(counts)
        if len(p):
            columns = [pa.array(p * n + k), pa.array(counts[p, k]), *(pa.array(sums[p, k, d]) for d in range(width))]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "n", *(f"s{d}" for d in range(width))])
        trim()

    names = ["n", *(f"s{d}" for d in range(width))]
    totals = vectors.select("q").mapInArrow(run, "entry long, " + ", ".join(f"{c} long" for c in names))
    rows = totals.groupBy("entry").agg(*[F.sum(c).alias(c) for c in names]).collect()  # one for each used entry: PARTS x ENTRIES at most
    new = book.copy()
    for r in rows:
        new[r["entry"] // n, r["entry"] % n] = [r[f"s{d}"] // r["n"] for d in range(width)]
    return new


def train(vectors: DataFrame) -> np.ndarray:
    """The codebooks (PARTS, entries, width of a part) after ROUNDS rounds over all vectors with `q`; without vectors, none of width 0."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").select(F.size("q")).first()
    if first is None:
        return np.zeros((PARTS, 0, 0), np.int64)
    if first[0] % PARTS:
        raise ValueError(f"vectors of {first[0]} components can't be cut into {PARTS} equal parts")
    book = first_codebook(vectors.where(F.size("q") == first[0]), first[0])
    for _ in range(ROUNDS):
        book = refined(vectors.where(F.size("q") == first[0]), book)
    return book


def encode(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """vectors (with `q`) with code string (two hex digits for each part) and error long (squared distances summed over parts) instead of q; rows of another length are left out."""
    parts, _, width = book.shape
    others = [c for c in vectors.columns if c not in ("q", "code", "error")]

    def run(batches):
        import pyarrow as pa

        own = Codebook(book)
        for batch in batches:
            x, error, code = matrix(batch.column("q")), 0, np.zeros((batch.num_rows, parts), np.uint8)
            for p in range(parts):
                found, distance = own.nearest(p, x[:, p * width : (p + 1) * width])
                code[:, p], error = found, error + distance
            digits = code.tobytes().hex()
            codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(codes, pa.string()), pa.array(error, pa.int64())], [*others, "code", "error"])
        trim()

    schema = vectors.select(*others).schema.add("code", "string").add("error", "long")
    return vectors.where(F.size("q") == parts * width).select(*others, "q").mapInArrow(run, schema)


def decode(codes: DataFrame, book: np.ndarray, column: str = "code") -> DataFrame:
    """codes with `approximate` array<double>: the vector that each code stands for. The codebooks, of fixed size, go with the plan."""
    entries = F.lit([[[float(v) / SCALE for v in e] for e in part] for part in book.tolist()])
    at = [F.conv(F.substring(column, 2 * p + 1, 2), 16, 10).cast("int") for p in range(book.shape[0])]
    return codes.withColumn("approximate", F.concat(*[F.get(F.get(entries, F.lit(p)), at[p]) for p in range(book.shape[0])]))


def compress(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept (see kept); no rows for an empty table.

    label_error is the errors' sum over the rows of equal labels, nulls together: summed before it is joined, and
    the joined side broadcast up to its bound, so a label with a third of all rows stays spread. Equal ids are rows of their
    own; a null id counts as the largest. Other columns, whatever their names, aren't looked at.
    """
    rows = kept(vectors.select("vec_id", F.col(column).alias("embedding"), "label")).select("vec_id", "label", "q")
    book = train(rows)
    if not book.size:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stage(encode(rows, book), "vector-codes")
    labels = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(small(stage(labels, "label-errors")), F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(Codebook(book).text().encode()).hexdigest()).alias("codebooks_sha256"))


def oracle() -> str:
    """The same by full search in SQL: the rounds one after another, distances over unnested components."""
    steps = [f"""
v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, i // w AS part, i % w AS pos, q[i + 1] AS x FROM (SELECT r, q, len(q) // {PARTS} AS w, unnest(range(len(q))) AS i FROM v)),
c0 AS (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= {ENTRIES})"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'e': entry}}) AS best FROM (SELECT x.r, x.part, c.entry, sum((x.x - c.c) ** 2)::BIGINT AS d FROM x JOIN c{k} c ON c.part = x.part AND c.pos = x.pos GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        if k < ROUNDS:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT part, best.e AS entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM x JOIN a{k} USING (r, part) GROUP BY 1, 2, 3) USING (part, entry, pos))""")
    last = f"a{ROUNDS}"
    steps.append(f"""
f AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM {last} GROUP BY r)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256 FROM f JOIN v USING (r)"""

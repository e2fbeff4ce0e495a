"""Ranked lexical search: an index of shards, and MaxScore within each.

Index: a task cuts its documents into shards of about SHARD terms and writes one row for each term of a shard: its
postings (document numbers within the shard as differences, and occurrences), and its frontier, the postings that no
other exceeds in occurrences while being in a shorter document. One more row of a shard, with a null term, has its
documents' ids and lengths. Nothing is shuffled to build it, and all terms of whole texts are in it.

Search: the items' terms are looked up in the index, for document frequencies and then for postings; shards are dealt
out whole. In a shard an item's terms have exact upper bounds: an impact grows with occurrences and falls with
the document's length, so the frontier's largest is the list's largest. Terms are ordered by their bounds. Those whose
bounds add up to less than the TOP-th best score so far are non-essential: a document with only such terms can't
qualify. Essential lists are read from the largest bound down, and the TOP-th largest partial score raises the bar on the
way (the final scores aren't smaller), so that more lists become non-essential. Documents of the essential lists are
candidates; then non-essential lists are probed, each only for the candidates that could still qualify with what the
remaining bounds allow. A task keeps its bar from shard to shard. Scores are integers and a candidate goes only if it is strictly below the bar, so ties stay.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, stage_path, tasks, texts_of, trim
from .tokens import slices

#: Terms that a shard has at least, if its task has them; the last document of a shard may exceed it.
SHARD = 4_000_000
#: Documents for an item, and pairs of item and term that are searched for in one pass.
TOP, PAIRS = 10, 200_000
#: Rows of an index batch.
ROWS = 20_000
#: ASCII that is no letter or digit separates terms; A-Z are lowered.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "shard long, term binary, n_docs long, n_terms long, docs binary, counts binary, best_count array<int>, best_length array<int>, ids array<long>"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text: maximal runs of ASCII letters, digits and all else beyond ASCII, with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def frontier(term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the postings, among those of the same term, that no posting in a document as short or shorter exceeds or equals in occurrences."""
    order = np.lexsort((-count, length, term))
    seen = np.maximum.accumulate(term[order].astype(np.int64) << 32 | count[order])  # terms ascend: within a term the largest count so far
    return order[np.r_[True, seen[1:] > seen[:-1]]] if len(order) else order


def shard_rows(shard: int, docs: list[tuple], vocabulary: dict, flat: list[np.ndarray]):
    """Record batches of one shard: docs are (id, number of terms), flat their term numbers."""
    import pyarrow as pa

    lengths = np.array([n for _, n in docs], np.int64)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("best_count", pa.list_(pa.int32())), ("best_length", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "counts": lengths.astype("<u4").tobytes(), "ids": [i for i, _ in docs]}], schema)
    names = list(vocabulary)
    if not names:
        return
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    number = place[np.concatenate(flat)] << 32 | np.repeat(np.arange(len(docs)), lengths)
    number.sort()
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    term, doc, count = number[first] >> 32, number[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(number)])
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    ends = np.r_[starts[1:], len(term)]
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    best = frontier(term, count, lengths[doc])
    best_ends = np.searchsorted(term[best], np.arange(len(names)), side="right")
    docs_bytes, count_bytes = gap.astype("<u4").tobytes(), count.astype("<u4").tobytes()
    best_count, best_length = count[best].astype("i4"), lengths[doc[best]].astype("i4")
    for a in range(0, len(names), ROWS):
        b = min(len(names), a + ROWS)
        low, offsets = starts[a], pa.py_buffer((4 * np.r_[starts[a:b], ends[b - 1]] - 4 * starts[a]).astype("<i4"))
        piece = [pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(x[4 * low : 4 * ends[b - 1]])]) for x in (docs_bytes, count_bytes)]
        at = np.r_[best_ends[a - 1] if a else 0, best_ends[a:b]]
        edges = pa.array((at - at[0]).astype("i4"))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x[at[0] : at[-1]])) for x in (best_count, best_length)]
        total = np.add.reduceat(count, starts)[a:b]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard)), pa.array([names[k] for k in order[a:b]], pa.binary()), pa.array(ends[a:b] - starts[a:b]), pa.array(total), *piece, *lists, pa.nulls(b - a, pa.list_(pa.int64()))], schema=schema)


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index of all documents (see INDEX), written to the shared folder. A null text has no terms; equal ids are documents of their own."""

    def run(batches):
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId() << 32, 0
        vocabulary: dict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        rows: list[tuple] = []
        flat: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = texts_of(batch, text_column)
            for i, t in zip(ids, texts):
                terms = terms_of(t)
                flat.append(np.fromiter(map(vocabulary.__getitem__, terms), np.int64, len(terms)))
                rows.append((i, len(terms)))
                held += len(terms)
                if held >= SHARD:
                    yield from shard_rows(shard, rows, vocabulary, flat)
                    rows, flat, held, shard = [], [], 0, shard + 1
                    vocabulary.clear()
        if rows:
            yield from shard_rows(shard, rows, vocabulary, flat)
        trim()

    path = stage_path(docs.sparkSession, "search-index")
    picked = docs.select(F.col(id_column).cast("long").alias(id_column), text_column)
    picked.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item. Rows of one id are one item, a null id too."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(texts_of(batch, text_column)):
                ids = batch.column(0).slice(part[0], part[1] - part[0]).to_pylist()
                pairs = [(i, t) for i, text in zip(ids, texts_of(batch.slice(part[0], part[1] - part[0]), text_column)) for t in set(terms_of(text))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.binary())], ["item_id", "term"])

    return items.select(F.col(id_column).cast("long").alias("item_id"), text_column).mapInArrow(run, "item_id long, term binary").distinct()


class Best:
    """An item's TOP best (score, document id) so far: higher scores first, then lower ids, null last."""

    def __init__(self):
        self.rows: list[tuple[int, bool, int]] = []

    @property
    def bar(self) -> int:
        """What a further document must reach at least: the lowest score that is held, or 1."""
        return max(1, -self.rows[-1][0]) if len(self.rows) == TOP else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows = sorted(self.rows + [(-int(s), i is None, i or 0) for s, i in zip(scores, ids)])[:TOP]


class Shard:
    """A shard's documents, and the postings of the terms that are asked for."""

    def __init__(self, ids, lengths: np.ndarray, n: int, total: int):
        self.ids, self.norm = ids, 8 * (10 + (90 * lengths.astype(np.int64) * n) // max(total, 1))
        self.lists: dict[bytes, tuple] = {}
        self.n, self.total = n, total

    def put(self, term: bytes, docs: bytes, counts: bytes, best_count: np.ndarray, best_length: np.ndarray) -> None:
        count = best_count.astype(np.int64)
        top = int((1_000_000_000 * count // (1000 * count + 8 * (10 + 90 * best_length.astype(np.int64) * self.n // max(self.total, 1)))).max())
        self.lists[term] = np.cumsum(np.frombuffer(docs, "<u4"), dtype=np.int64), np.frombuffer(counts, "<u4"), top

    def impact(self, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        count = counts.astype(np.int64)
        return 1_000_000_000 * count // (1000 * count + self.norm[docs])

    def search(self, weights: dict[bytes, int], best: Best, seen: list[int] | None = None) -> None:
        """Add this shard's best documents for an item with these terms' weights. seen: gets the number of postings that were scored."""
        found = sorted((w * self.lists[t][2], t, w) for t, w in weights.items() if t in self.lists and w > 0)
        bounds = np.cumsum([b for b, _, _ in found])  # of a document that has only terms up to here
        if not found or bounds[-1] < (bar := best.bar):
            return
        known, k = np.zeros(len(self.norm), np.int64), len(found)
        while k and bounds[k - 1] >= bar:  # the lists from k on are essential; those before it can't lift a document to the bar
            k -= 1
            _, t, w = found[k]
            own, counts, _ = self.lists[t]
            known[own] += w * self.impact(own, counts)
            if seen is not None:
                seen.append(len(own))
            rest = bounds[k - 1] if k else 0
            if len(known) > TOP and bounds[-1] - rest > max(rest, bar):  # else the bar can't get above the rest yet
                bar = max(bar, int(np.partition(known, -TOP)[-TOP]))
        docs = np.flatnonzero(known)
        score, essential = known[docs], k
        for k in range(essential, -1, -1):
            rest = bounds[k - 1] if k else 0
            if len(score) > TOP and rest:
                bar = max(bar, int(np.partition(score, -TOP)[-TOP]))
            left = score + rest >= bar
            docs, score = docs[left], score[left]
            if not k or not len(docs):
                break
            own, counts, _ = self.lists[found[k - 1][1]]
            at = np.searchsorted(own, docs)
            at[at == len(own)] = 0
            hit = own[at] == docs
            score[hit] += found[k - 1][2] * self.impact(docs[hit], counts[at[hit]])
            if seen is not None:
                seen.append(int(hit.sum()))
        if len(score) > TOP:  # ties at the bar stay, ids tell
            cut = np.partition(score, -TOP)[-TOP]
            docs, score = docs[score >= cut], score[score >= cut]
        best.add(score, self.ids.take(docs).to_pylist())


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: each item's TOP highest-scoring documents with a score above 0, equal scores by ascending id (null last).

    Items are searched for in passes of PAIRS pairs of item and term; a pass's pairs are broadcast. An item whose terms
    are in no document has no rows; an empty index or item table gives none.
    """
    spark = index.sparkSession
    pairs = stage(item_terms(items), "search-items")
    n, total = index.where("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = small(stage(pairs.select("term").distinct(), "search-terms"))
    df = stage(index.where("term IS NOT NULL").select("term", "n_docs").join(asked, "term").groupBy("term").agg(F.sum("n_docs").alias("df")), "search-df")
    passes = max(1, -(-pairs.count() // PAIRS))
    known = pairs.join(df, "term").withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    known = stage(known, "search-pairs")
    out = [one_pass(index, known.where(F.col("pass") == k), n, total) for k in range(passes)]
    best = stage(out[0], "search-best")
    for k, more in enumerate(out[1:]):
        best = best.unionByName(stage(more, f"search-best-{k}"))
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)")).where(F.col("rank") <= TOP)
    return ranked.select("item_id", "rank", "doc_id", "score")


def one_pass(index: DataFrame, known: DataFrame, n: int, total: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task, for a pass's pairs."""
    spark = index.sparkSession
    rows = known.select("item_id", "term", "df").collect()  # PAIRS on the mean
    sent = spark.sparkContext.broadcast([(r["item_id"], bytes(r["term"]), weight(n, r["df"])) for r in rows])
    terms = small(known.select("term").distinct())
    lists = index.where("term IS NOT NULL").join(terms, "term", "left_semi").unionByName(index.where("term IS NULL"))
    dealt = lists.repartition(tasks(index), "shard").sortWithinPartitions(F.asc("shard"), F.asc_nulls_first("term"))

    def run(batches):
        import pyarrow as pa

        items: dict = defaultdict(dict)
        for i, t, w in sent.value:
            items[i][t] = w
        best = {i: Best() for i in items}
        held: Shard | None = None
        for batch in chain(batches, [None]):
            for k in range(batch.num_rows if batch else 1):
                if batch is None or not batch.column("term")[k].is_valid:
                    if held and held.lists:
                        for i, weights in items.items():
                            held.search(weights, best[i])
                    if batch is None:
                        break
                    lengths = np.frombuffer(batch.column("counts")[k].as_py(), "<u4")
                    held = Shard(batch.column("ids")[k].values, lengths, n, total)
                else:
                    column = lambda c, k=k: batch.column(c)[k]
                    held.put(column("term").as_py(), column("docs").as_py(), column("counts").as_py(), column("best_count").values.to_numpy(), column("best_length").values.to_numpy())
        found = [(i, None if null else d, -s) for i, b in best.items() for s, null, d in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["item_id", "doc_id", "score"])
        trim()

    return dealt.mapInArrow(run, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """search over an index of docs. Clashing and further columns of either table aren't looked at."""
    return search(build(docs), items)


#: The same by counting every term of every document.
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, t, len(any_value(ts)) AS m, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, s.n),
x AS (SELECT i.item_id, p.r, p.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * m * s.n) // s.l))))::BIGINT AS score FROM i JOIN p USING (t) JOIN w USING (t), s GROUP BY i.item_id, p.r, p.doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0) WHERE rank <= {TOP}
"""

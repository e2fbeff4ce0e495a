"""Exact n-gram Jaccard self-join by size-banded tiles with hashed bitmap signatures.

1. Texts with equal shingle sets form a class; its smallest doc_id stands for it from then on.
2. Shingles that are frequent within tasks are summed up; the most frequent (at most HOT) are ordered after all
   others, so that a passage shared by many documents doesn't make them candidates. Any common order gives whole
   results: two sets with Jaccard of 0.8 or more share one of the first n - ceil(0.8 n) + 1 shingles of each.
3. Documents that share such a shingle form its tile. A tile is ordered by set size, and a document meets only
   those of its size band (up to 1.25 times its size). Tiles of hot shingles with many documents are dealt out
   by size band and pairs of blocks. Within a tile, signatures of hashed bits bound the overlap: of A's n
   elements, those that set a bit that B lacks can't be shared.
4. Pairs within the bound face it again with signatures as wide as their sets need, and those left are
   intersected exactly, as sorted arrays. First each document is checked against a few
   neighbours of its tiles and the document in the middle of each; the links give components; then every remaining pair of a tile whose components
   differ is checked. Pairs inside a component need no check, so a large group of near copies costs what its links
   cost, not its pairs; and no link between components is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, largest, release, small, stage, tasks, texts_of, trim
from .components import components
from .shingles import shingle_sets
from .tokens import slices

#: Characters of texts that are hashed at once: a step holds some forty bytes for each.
STEP = 500_000
#: Shingles ordered last and dealt out on their own, and how often one occurs in a step of a task to be counted.
HOT, LOCAL = 1 << 16, 3
#: Documents of a hot shingle's block, and rows of tiles handled at once.
BLOCK, ROWS = 4096, 50_000
#: A posting's low bits hold the shingle's place (or the last one they can), in lieu of the hash's: documents may meet needlessly, never miss each other.
_LOW, _PLACES = np.uint64(12), np.uint64(4095)
#: Bits of the smallest signature; a signature has half as many bits as its set has elements, if that is more.
BITS = 1024
#: Documents from which on a tile's middle one is checked against all of its others.
MIDDLE = 8
#: Pairs whose bound is computed at once.
PAIRS = 100_000


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n, set (16-byte digest of the shingle set; null if empty), and shingles that several sets of a step share, with their number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, STEP):
                sets = shingle_sets(texts[a:b])
                keys = [_digest(x) if len(x) else None for x in sets]
                own = {k: x for k, x in zip(keys, sets, strict=True) if k}
                found, n = np.unique(np.concatenate([*own.values(), np.empty(0, np.uint64)]), return_counts=True)
                many = n >= LOCAL
                shared = [(_signed(found[many]).tolist(), n[many].tolist())] + [([], [])] * (len(sets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([s[0] for s in shared], pa.list_(pa.int64())), pa.array([s[1] for s in shared], pa.list_(pa.int64()))],
                    ["doc_id", "n", "set", "shared", "shared_n"],
                )
        trim()

    return _rows(docs).mapInArrow(run, "doc_id long, n long, set binary, shared array<long>, shared_n array<long>")


def signature(x: np.ndarray) -> bytes:
    """A set's signature. If the set has more elements than the signature bits, only every second hash sets one: fewer bits set tell more apart."""
    size = max(BITS, 1 << (max(1, len(x) - 1) // 2).bit_length())
    x = x if len(x) <= size else x[(x >> np.uint64(40)) & np.uint64(1) == 0]
    bits = np.zeros(size, bool)
    bits[(x & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def signatures(docs: DataFrame, hot: np.ndarray, hot_n: np.ndarray) -> DataFrame:
    """doc_id, n, bits, postings, hot: a document's signature and its first shingles, those whose tile is dealt out in blocks apart, with their place and the number of blocks."""
    order = np.argsort(hot)
    hot, blocks_of = hot[order], np.maximum(1, -(-hot_n[order] // BLOCK))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, STEP):
                out = []
                for x in shingle_sets(texts[a:b]):
                    n = len(x)
                    first = n + 1 - -(-4 * n // 5) if n else 0
                    at = np.minimum(np.searchsorted(hot, x), max(0, len(hot) - 1))
                    is_hot = hot[at] == x if len(hot) else np.zeros(n, bool)
                    chosen = np.r_[np.flatnonzero(~is_hot)[:first], np.flatnonzero(is_hot)][:first]
                    pos = np.minimum(np.arange(first, dtype=np.uint64), _PLACES)
                    blocks = np.where(is_hot[chosen], blocks_of[at[chosen]], 1) if len(hot) else np.ones(first, np.int64)
                    posting = x[chosen] >> _LOW << _LOW | pos
                    out.append((n, signature(x), _signed(posting[blocks == 1]), _signed(posting[blocks > 1]), blocks[blocks > 1]))
                types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", "n", "bits", "postings", "hot", "blocks"])
        trim()

    return _rows(docs).mapInArrow(run, "doc_id long, n long, bits binary, postings array<long>, hot array<long>, blocks array<long>")


def tile_collector(block: int, rows_held: int):
    """For mapInArrow: shingle, chunk, members, docs, pos: the tiles of postings in order, if they have several documents; each in chunks of `block` documents. members: a digest of the documents of a tile of one chunk."""

    def step(v: np.ndarray, d: np.ndarray, before: int, more: bool):
        """The tiles of postings v of documents d; the first one has `before` chunks already, the last one goes on if there is `more`."""
        import pyarrow as pa

        s = v >> _LOW
        edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        n = np.diff(np.r_[edge, len(s)])
        tile = np.repeat(np.arange(len(edge)), n)
        order = np.lexsort((d, tile))
        d, p = d[order], (v[order] & _PLACES).astype(np.int32)
        # the starts of chunks: where a tile starts, and every `block` rows from there on
        within = np.arange(len(s)) - np.repeat(edge, n)
        start = np.flatnonzero(within % block == 0)
        length = np.diff(np.r_[start, len(s)])
        chunk = within[start] // block + np.where(tile[start] == 0, before, 0)
        lone = (n[tile[start]] <= block) & (chunk == 0)
        if more:
            lone[tile[start] == len(edge) - 1] = False
        keep = np.flatnonzero((length > 1) | (chunk > 0) | ~lone)
        x = d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        digest = np.stack([np.add.reduceat(x, start), np.add.reduceat(y ^ (y >> np.uint64(31)), start)], 1)
        row = np.zeros(len(start), bool)
        row[keep] = True
        rows = np.repeat(row, length)
        offsets = pa.array(np.r_[0, np.cumsum(length[keep])].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(s[start[keep]].astype(np.int64)), pa.array(chunk[keep].astype(np.int32)),
                pa.array([digest[k].tobytes() if lone[k] else None for k in keep.tolist()], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(d[rows])), pa.ListArray.from_arrays(offsets, pa.array(p[rows])),
            ],
            ["shingle", "chunk", "members", "docs", "pos"],
        )

    def run(batches):
        v, d, before = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in batches:
            v, d = np.r_[v, batch.column("posting").to_numpy().view(np.uint64)], np.r_[d, batch.column("doc_id").to_numpy()]
            while len(v) >= rows_held:
                last = int(np.searchsorted(v, v[-1] >> _LOW << _LOW))  # unsigned order: the last tile may go on
                cut = last or len(v) // block * block
                yield step(v[:cut], d[:cut], before, not last)
                before = 0 if last else before + cut // block
                v, d = v[cut:], d[cut:]
        if len(v):
            yield step(v, d, before, False)
        trim()

    return run


def tiles(signed: DataFrame) -> DataFrame:
    """shingle, part, doc_id, pos (the shingle's place in the document's order), n, bits: the documents of each tile.

    Of tiles with the same documents only the first in the order of shingles stays: it is where each pair of them
    first meets, and near copies share hundreds. Tiles of more than BLOCK documents are dealt out by size band and pairs
    of blocks, as many as their true count asks: those that tasks found frequent before without passing one task, any other in chunks.
    """
    # flipped, signed order is the unsigned one
    flip = F.lit(-(1 << 63)).cast("long")
    postings = signed.select("doc_id", F.explode("postings").alias("posting"))
    ordered = postings.repartition(tasks(signed), F.shiftrightunsigned("posting", 12)).sortWithinPartitions(F.col("posting").bitwiseXOR(flip)).select("posting", "doc_id")
    found = stage(ordered.mapInArrow(tile_collector(BLOCK, ROWS), "shingle long, chunk int, members binary, docs array<long>, pos array<int>"), "found")
    rep = found.where("members IS NOT NULL").groupBy("members").agg(F.min(F.struct("pos", "docs", "shingle")).alias("x"))
    pairs_of = lambda c: F.explode(F.arrays_zip(F.col(f"{c}docs").alias("docs"), F.col(f"{c}pos").alias("pos"))).alias("y")
    about = signed.select("doc_id", "n", "bits")
    alone = rep.select(F.col("x.shingle").alias("shingle"), pairs_of("x.")).select("shingle", F.lit(0).cast("long").alias("part"), F.col("y.docs").alias("doc_id"), F.col("y.pos").alias("pos")).join(about, "doc_id")

    large = found.where("members IS NULL")
    blocks = stage(large.groupBy("shingle").agg((F.max("chunk") + 1).cast("long").alias("blocks")), "large")
    large = large.join(small(blocks), "shingle").select("shingle", F.col("chunk").cast("long").alias("own"), "blocks", pairs_of("")).select("shingle", "own", "blocks", F.col("y.docs").alias("doc_id"), F.col("y.pos").alias("pos")).join(about, "doc_id")
    hot = signed.where(F.size("hot") > 0).select("doc_id", "n", "bits", F.explode("hot").alias("x")).withColumn("shingle", F.shiftrightunsigned("x", 12))
    true = stage(hot.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "hot-blocks")  # of all documents, whatever their tasks saw
    hot = hot.join(small(true), "shingle").select("shingle", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("own"), "blocks", "doc_id", F.col("x").bitwiseAND(4095).cast("int").alias("pos"), "n", "bits")
    dealt = large.select(*hot.columns).unionByName(hot)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("long")
    pair = lambda x: F.least(x, F.col("own")) * F.col("blocks") + F.greatest(x, F.col("own"))
    split = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.array(pair(x) * 1024 + band + 1, pair(x) * 1024 + band + 2)))
    dealt = dealt.withColumn("part", F.explode(split))
    return alone.select("shingle", "part", "doc_id", "pos", "n", "bits").unionByName(dealt.select("shingle", "part", "doc_id", "pos", "n", "bits"))


class Signatures:
    """Signatures of different lengths, and bounds on pairs of them. A longer one is folded to a shorter one's length."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n, self.words = n, np.array([len(b) // 8 for b in bits], np.int64)
        self.half = n > 64 * self.words
        self.place, self.table = np.empty(len(n), np.int64), {}
        for w in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == w)
            self.place[rows] = np.arange(len(rows))
            self.table[w] = np.frombuffer(b"".join([bits[k] for k in rows.tolist()]), "<u8").reshape(-1, w)

    def _of(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        x = self.table[words][self.place[rows]]
        return x if words == to else np.bitwise_or.reduce(x.reshape(len(rows), words // to, to), axis=1)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of i and j can have a Jaccard of 0.8: 9 * overlap >= 4 * (n + m). An element that sets a bit in one signature isn't shared if the other lacks the bit and would have it."""
        out = np.empty(len(i), bool)
        kinds = self.words[i] * 65536 + self.words[j]
        for kind in np.unique(kinds).tolist():
            a, b = divmod(kind, 65536)
            chosen, to = np.flatnonzero(kinds == kind), min(a, b)
            step = max(1, 1_600_000 // max(a, b))
            for k in range(0, len(chosen), step):
                at = chosen[k : k + step]
                p, q = i[at], j[at]
                x, y = self._of(p, a, to), self._of(q, b, to)
                most = np.minimum(self.n[p], self.n[q])
                left = self.n[p] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
                right = self.n[q] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
                most = np.where(self.half[p] | ~self.half[q], np.minimum(most, left), most)
                most = np.where(self.half[q] | ~self.half[p], np.minimum(most, right), most)
                out[at] = 9 * most >= 4 * (self.n[p] + self.n[q])
        return out

    def middle(self, rows: np.ndarray) -> int:
        """The row whose signature, folded to the shortest length, is nearest to the majority of all."""
        to = int(self.words[rows].min())
        folded = np.concatenate([self._of(rows[self.words[rows] == w], int(w), to) for w in np.unique(self.words[rows])])
        order = np.concatenate([rows[self.words[rows] == w] for w in np.unique(self.words[rows])])
        set_bits = np.zeros(to * 64, np.int64)
        for k in range(0, len(folded), 4096):
            set_bits += np.unpackbits(folded[k : k + 4096].view(np.uint8).reshape(-1, to * 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        majority = np.packbits(2 * set_bits > len(folded), bitorder="little").view("<u8")
        return int(order[np.argmin(np.bitwise_count(folded ^ majority).sum(1, dtype=np.int64))])


def tile_pairs(tile: np.ndarray, doc: np.ndarray, n: np.ndarray, bits: list[bytes], label: np.ndarray | None, near: int, pos: np.ndarray | None = None) -> np.ndarray:
    """Pairs (a, b), a < b, of rows sorted by tile and n that the bounds allow: with labels all of different labels; without, each row's with the `near` next ones and with the middle of a large tile.

    With pos, a pair is left to the tile of its first common shingle: what it can share from here on must be enough.
    """
    held = Signatures(n, bits)
    edge = np.r_[True, tile[1:] != tile[:-1]]
    number = np.cumsum(edge) - 1
    key = (number << 32) + n
    high = np.searchsorted(key, (number << 32) + n * 5 // 4, "right")
    at = np.arange(len(tile))
    if label is None:
        low, high, mine = at + 1, np.minimum(high, at + 1 + near), at
    else:
        first = np.flatnonzero(edge)
        order = np.lexsort((label, number))
        runs = np.flatnonzero(np.r_[True, (number[order][1:] != number[order][:-1]) | (label[order][1:] != label[order][:-1])])
        length = np.diff(np.r_[runs, len(order)])
        best = np.zeros(len(first), np.int64)
        main = np.zeros(len(first), np.int64)
        by = np.argsort(length, kind="stable")
        best[number[order][runs[by]]] = length[by]
        main[number[order][runs[by]]] = label[order][runs[by]]
        mine = np.flatnonzero(label != main[number])  # each pair of different labels has a row that isn't of its tile's most common label
        low = np.searchsorted(key, (number << 32) + -(-n * 4 // 5), "left")
    low, high = low[mine], high[mine]
    count = np.maximum(high - low, 0)
    ends = np.cumsum(count)
    out = [np.empty((0, 2), np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        ok = doc[i] != doc[j]
        if label is not None:
            ok &= label[i] != label[j]
        if pos is not None:
            ok &= 9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])
        i, j = i[ok], j[ok]
        ok = held.may_link(i, j)
        a, b = doc[i[ok]], doc[j[ok]]
        if len(a):
            out.append(np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)], axis=0))

    if label is None:
        starts = np.flatnonzero(edge)
        for start, length in zip(starts.tolist(), np.diff(np.r_[starts, len(tile)]).tolist(), strict=True):
            if length >= MIDDLE:
                rows = np.arange(start, start + length)
                add(rows, np.full(length, held.middle(rows)))
    k = 0
    while k < len(mine):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        c = count[k:stop]
        i = np.repeat(mine[k:stop], c)
        j = np.repeat(low[k:stop], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        add(i, j)
        k = stop
    found = np.concatenate(out)
    return np.unique(found, axis=0) if len(out) > 2 else found


def candidates(tiled: DataFrame, labels: DataFrame | None = None, near: int = 2) -> DataFrame:
    """Distinct pairs a, b of tiles (see tile_pairs)."""
    labelled = labels is not None

    def run(batches):
        import pyarrow as pa

        def step(part: pa.Table):
            doc, n = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
            bits = part.column("bits").to_pylist()
            label = part.column("label").to_numpy() if labelled else None
            pos = part.column("pos").to_numpy().astype(np.int64) if labelled else None
            found = tile_pairs(number(part), doc, n, bits, label, near, pos)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        def number(part: pa.Table) -> np.ndarray:
            s, p = part.column("shingle").to_numpy(), part.column("part").to_numpy()
            return np.cumsum(np.r_[False, (s[1:] != s[:-1]) | (p[1:] != p[:-1])])

        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]).combine_chunks() if held is not None else more
            if held.num_rows >= ROWS:  # whole tiles only: the last may go on
                cut = int(np.searchsorted(t := number(held), t[-1]))
                if cut:
                    yield step(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield step(held)
        trim()

    rows = tiled.join(labels, tiled["doc_id"] == labels["doc"], "left").withColumn("label", F.coalesce("label", "doc_id")).drop("doc") if labelled else tiled
    dealt = rows.repartition(tasks(tiled), "shingle", "part").sortWithinPartitions("shingle", "part", "n", "doc_id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _wide(x: np.ndarray) -> bytes:
    """A signature of at least four bits for each element, so that the bound of large sets is as tight as that of small ones."""
    size = np.uint64(max(64, 1 << (4 * len(x) - 1).bit_length()))
    bits = np.zeros(int(size), bool)
    bits[(x & (size - np.uint64(1))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """The bound of two wide signatures; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    shared = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 9 * shared >= 4 * (n + m)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The staged pairs whose exact Jaccard is 0.8 or more, staged: what wide signatures leave, by intersection of sorted arrays. Both are made from the whole texts again."""
    involved = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "involved")
    ids = small(involved)

    def arrays(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, STEP):
                found = shingle_sets(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(x) for x in found], pa.int64()), pa.array([_wide(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([_digest(x) for x in found], pa.binary())],
                    ["doc", "n", "wide", "shingles", "set"],
                )
        trim()

    def bound(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [_may_link(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def intersect(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= 80 * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = _rows(docs)
    sets = stage(rows.join(ids, rows["doc_id"] == ids["doc"], "left_semi").mapInArrow(arrays, "doc long, n long, wide binary, shingles binary, set binary"), "arrays")
    if sets.groupBy("doc").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():  # rows share a doc_id: each of its sets may link
        sets = stage(sets.dropDuplicates(["doc", "set"]), "arrays")
    left, right = sets.select(F.col("doc").alias("a"), "n", F.col("wide").alias("x")), sets.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y"))
    near = stage(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(bound, "a long, b long").distinct(), "near")
    left, right = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    found = stage(near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(intersect, "a long, b long").distinct(), "found")
    drop_stage(sets)
    release(docs.sparkSession)
    return found


def join(docs: DataFrame, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a table of doc_id, n_shingles, component_id for every row of docs; links a, b between class representatives).

    Links are those that the components needed: a pair whose ends are joined already isn't looked at. With every_link
    they are all pairs of classes whose Jaccard is 0.8 or more, at the cost of verifying each of a group's pairs.
    Documents without words have no links. Rows that share a doc_id are one document with several sets. Null ids
    stand alone: their component_id is null. Ties go to the smaller doc_id; an empty table gives no rows.
    """
    sets = stage(set_table(docs), "sets")
    seen = sets.where("set IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set")
    classes = stage(seen.groupBy("set").agg(F.min("doc_id").alias("class")), "classes")
    often = stage(sets.select(F.explode(F.arrays_zip("shared", "shared_n")).alias("x")).groupBy(F.col("x.shared").alias("s")).agg(F.sum("x.shared_n").alias("n")), "often")
    hot = largest(often, "n", "s", HOT).toArrow()
    hot_s, hot_n = hot.column("s").to_numpy().astype(np.int64).view(np.uint64), hot.column("n").to_numpy().astype(np.int64)

    member = stage(seen.join(classes, "set").select("doc_id", "class").distinct(), "members")
    copies = stage(member.groupBy("doc_id").agg(F.min(F.when(F.col("class") == F.col("doc_id"), 0).otherwise(1)).alias("copy")).where("copy = 1").select(F.col("doc_id").alias("doc")), "copies")
    skip = small(copies)
    rows = _rows(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = stage(signatures(rows.join(skip, rows["doc_id"] == skip["doc"], "left_anti"), hot_s, hot_n).where("n > 0"), "signed")
    tiled = stage(tiles(signed), "tiles")
    drop_stage(signed)
    release(docs.sparkSession)

    first = stage(candidates(tiled), "pairs")
    links = verified(rows, first)
    # a doc_id with several sets links their classes
    several = member.groupBy("doc_id").agg(F.min("class").alias("a")).join(member, "doc_id").where("a <> class").select("a", F.col("class").alias("b"))
    several = several.unionByName(member.groupBy("doc_id").agg(F.min("class").alias("b")).where("doc_id <> b").join(copies, F.col("doc_id") == F.col("doc"), "left_anti").select(F.col("doc_id").alias("a"), "b"))
    links = stage(links.unionByName(several), "found")
    if every_link:
        label = docs.sparkSession.createDataFrame([], "doc long, label long")
    else:
        label = components(links)
    second = stage(candidates(tiled, label).join(first, ["a", "b"], "left_anti"), "pairs")
    more = verified(rows, second)
    all_links = links.unionByName(more)
    final = components(all_links)
    of_class = classes.join(final, classes["class"] == final["doc"], "left").select("set", F.coalesce("label", "class").alias("component_id"))
    out = sets.join(of_class, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out, all_links


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that link, over any number of links, with a document of a smaller doc_id."""
    found, _ = join(docs)
    gone = stage(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__doc")).distinct(), "gone")
    return docs.join(small(gone), docs["doc_id"].cast("long") == F.col("__doc"), "left_anti")

"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt by hash to blocks of about BLOCK pieces. Every block is evolved by several islands, each a
task of its own: a solution is a grouping of pieces into bins; the first ones are built by best fit from random
orders, and one from falling lengths. Crossover injects whole well-filled bins of one parent into the other, dissolves
the bins that hold duplicates, and places displaced pieces by best fit; fewer bins are fitter, and among as many bins those
that gather the free room in few bins. Between epochs each island's elites migrate to the next island of its block;
at the end the best solution of a block's islands stays. Bins that are less than FULL then give their pieces to the
next level, where the blocks' leftovers are dealt and evolved anew, until one block holds them all: so room left over in
many blocks is used up together. No step holds more than a block, so groups of any size are dealt out evenly.
"""

from __future__ import annotations

import bisect
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, texts_of, trim
from .tokens import STORE, encoder, slices

BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 4096, 2, 2, 10, 6, 2
#: A bin that is this full is done.
FULL = 0.99


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, store: int = STORE) -> DataFrame:
    """A row per piece of each document: row_id, doc_id, piece, start, length, ids_crc32.

    A document's ids are its text's (null: none) and end_id. Documents of more than `capacity` ids are cut
    into pieces of `capacity`; others are one piece. row_id tells repeated rows apart.
    """

    def cut(batches):
        import pyarrow as pa

        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, rows, docs_ = texts_of(batch), batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                out = []
                for row, doc, ids in zip(rows[a:b], docs_[a:b], enc.encode(texts[a:b], store), strict=True):
                    ids += end
                    for k, p in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[p : p + 4 * capacity]
                        out.append((row, doc, k, k * capacity, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, order, bins: np.ndarray, room: list, capacity: int, n_bins: int) -> int:
    """Place the pieces of `order` each in the fullest bin that holds it. room: sorted (room, bin); bins is filled in; returns the number of bins."""
    for i in order:
        need = int(lengths[i])
        k = bisect.bisect_left(room, (need, -1))
        if k < len(room):
            left, b = room.pop(k)
            left -= need
        else:
            left, b, n_bins = capacity - need, n_bins, n_bins + 1
        bins[i] = b
        if left:
            bisect.insort(room, (left, b))
    return n_bins


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the mean square of their fill)."""
    fill = np.bincount(bins, lengths)
    fill = fill[fill > 0]
    return -len(fill), float(np.square(fill / capacity).mean())


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Whole well-filled bins of b go into a; a's bins that share pieces with them are dissolved, and what they still held is placed by best fit."""
    fill = np.bincount(b, lengths)
    well = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, len(well) // 5), replace=False)] = True
    injected = chosen[b]
    broken = np.zeros(a.max() + 1, bool)
    broken[a[injected]] = True
    displaced = np.flatnonzero(broken[a] & ~injected)
    child = np.where(injected, a.max() + 1 + b, a)
    child[displaced] = -1
    _, child[child >= 0] = np.unique(child[child >= 0], return_inverse=True)
    n = int(child.max()) + 1
    used = np.bincount(child[child >= 0], lengths[child >= 0], minlength=n).astype(int)
    room = sorted((capacity - u, k) for k, u in enumerate(used.tolist()) if u < capacity)
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], child, room, capacity, n)
    return child


def evolve(lengths: np.ndarray, start: list[np.ndarray], capacity: int, generations: int, seed, population: int = POPULATION) -> tuple[list[np.ndarray], int]:
    """The island's best solutions, best first, and how many generations it ran. `start` holds migrants; others are built by best fit, one in the order of falling lengths, the rest in random orders. It ends early only if no packing can be fitter: as few bins as the sum allows, all full but one."""
    rng = np.random.default_rng(seed)
    total = int(lengths.sum())
    floor = -(-total // capacity)
    perfect = (-floor, (floor - 1 + ((total - (floor - 1) * capacity) / capacity) ** 2) / floor - 1e-12)
    orders = [np.argsort(-lengths, kind="stable")] if not start else []
    held = list(start)
    while len(held) < population:
        bins = np.full(len(lengths), -1, np.int64)
        best_fit(lengths, orders.pop() if orders else rng.permutation(len(lengths)), bins, [], capacity, 0)
        held.append(bins)
    ranked = sorted(((fitness(lengths, s, capacity), k, s) for k, s in enumerate(held)), reverse=True, key=lambda x: x[:2])
    ran = 0
    while ran < generations and ranked[0][0] < perfect:
        i, j = rng.permutation(len(ranked))[:2]
        children = [crossover(lengths, ranked[x][2], ranked[y][2], capacity, rng) for x, y in ((i, j), (j, i))]
        ran += 1
        ranked += [(fitness(lengths, s, capacity), -2 * ran - k, s) for k, s in enumerate(children)]
        ranked = sorted(ranked, reverse=True, key=lambda x: x[:2])[:population]
    return [s for _, _, s in ranked], ran


def evolved(lean: DataFrame, capacity: int, seed: int) -> DataFrame:
    """The elites of all islands after the last epoch: block, island, source, place, bins, n_bins, fill, generations. `lean` has block, row_id, piece, length; it is staged."""
    lean = lean.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    shape = "block long, island int, source int, place int, bins binary, n_bins long, fill double, generations int"
    names = [c.split()[0] for c in shape.split(", ")]

    def epoch(key, pdf: pd.DataFrame, migrants: pd.DataFrame, turn: int) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id", "piece"])
        lengths = pdf["length"].to_numpy(np.int64)
        if not len(lengths):
            return pd.DataFrame([], columns=names)
        block, island = int(key[0]), int(key[1])
        start = [np.frombuffer(b, "<i4").astype(np.int64) for b in migrants.sort_values(["source", "place"])["bins"]] if len(migrants) else []
        before = int(migrants["generations"].max()) if len(migrants) else 0
        out = []
        found, ran = evolve(lengths, start, capacity, GENERATIONS, [seed, turn, block, island])
        for place, s in enumerate(found[:ELITES]):
            n, fill = fitness(lengths, s, capacity)
            for to in {island, (island + 1) % ISLANDS}:
                out.append((block, to, island, place, s.astype("<i4").tobytes(), -n, fill, before + ran))
        return pd.DataFrame(out, columns=names)

    def resumed(turn: int):
        return lambda key, pdf, migrants: epoch(key, pdf, migrants, turn)

    elites = stage(lean.groupBy("block", "island").applyInPandas(lambda key, pdf: epoch(key, pdf, pdf[:0], 0), shape), "elites")
    for turn in range(1, EPOCHS):
        elites = stage(lean.groupBy("block", "island").cogroup(elites.groupBy("block", "island")).applyInPandas(resumed(turn), shape), "elites")
    return elites


def pack_level(items: DataFrame, capacity: int, seed: int, level: int, n_blocks: int) -> DataFrame:
    """items with sequence_id, offset and filled (the sum of the sequence's lengths)."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("row_id", "piece", F.lit(level)), F.lit(n_blocks)))
    elites = evolved(dealt.select("block", "row_id", "piece", "length"), capacity, seed)
    best = elites.groupBy("block").agg(F.max_by("bins", F.struct(-F.col("n_bins"), "fill", "source", "place", "bins")).alias("bins"))
    names = [*items.columns, "sequence_id", "offset", "filled"]

    def place(pdf: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id", "piece"]).reset_index(drop=True)
        if not len(pdf):
            return pd.DataFrame([], columns=names)
        bins = np.frombuffer(won["bins"].iloc[0], "<i4")
        order = np.argsort(bins, kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, np.diff(bins[order]) != 0]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"] = (level << 54) + (pdf["block"].to_numpy(np.int64) << 14) + bins
        pdf["offset"] = offset
        pdf["filled"] = np.bincount(bins, lengths).astype(np.int64)[bins]
        return pdf[names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, filled long"
    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, schema)


def pack(items: DataFrame, capacity: int = 4096, seed: int = 7) -> DataFrame:
    """Adds sequence_id long and offset long to staged `items` (row_id, piece, length, ...).

    Every length must be 1 to `capacity`. Sequences are filled without gaps from offset 0. Ties and repeated
    rows are separate pieces; an empty table gives an empty result.
    """
    done, left, n, level = [], items, items.count(), 0
    while True:
        n_blocks = max(1, -(-n // BLOCK))
        placed = pack_level(left, capacity, seed, level, n_blocks)
        if n_blocks == 1:
            done.append(placed)
            break
        placed = stage(placed, "packed")
        full = F.col("filled") >= FULL * capacity
        done.append(placed.where(full))
        left = placed.where(~full).select(items.columns)
        before, n, level = n, left.count(), level + 1
        if not n:
            break
        if 2 * n > before:  # pieces that can't fill bins: no level would
            done.append(placed.where(~full))
            break
    return reduce(DataFrame.unionByName, done).drop("filled")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, store: int = STORE) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each. store: distinct chunks that a worker keeps; fewer take less memory and some more time."""
    return pack(stage(pieces(docs, vocabulary, capacity, end_id, store), "pieces"), capacity)

"""Line deduplication by a segment-partition edit join.

Lines are normalised (words joined by one blank, A-Z lowered, digits as 0). Of equal lines the first stays, in
the order of doc_id and place. A line of `least` or more characters also goes if an earlier distinct line (of any
length) is within EDITS edits of it. Lines without words, and those of fewer than `shortest` characters, are left alone.

1. Distinct lines, with their first places, are pre-aggregated in each task and shuffled by hash.
2. Within EDITS edits, one of EDITS + 1 segments of the shorter line stands unchanged in the longer one, in one of few
   places. Each line gives the keys (length, segment number, substring hash) of its own segments and of
   the substrings that can match segments of lines up to EDITS characters shorter. Keys of only one line are dropped
   where they meet; keys that tasks find frequent, and those whose lines turn out to be many, are dealt out by pairs of blocks.
3. Where lines meet, 64 parity bits of their characters bound the distance from below (an edit flips two at most).
   First each line is checked against a few earlier ones; only lines that none of these removes meet all others.
4. Pairs within the bound are verified by a banded bit-parallel edit distance on the whole lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import largest, small, stage, tasks, texts_of, trim
from .tokens import slices

#: Characters of texts that are hashed at once: a step holds some forty bytes for each.
STEP = 500_000
EDITS, LEAST, SHORTEST = 2, 24, 1
HOT, LOCAL, BLOCK, ROWS, PAIRS = 1 << 16, 3, 4096, 50_000, 200_000
#: A-Z lowered and digits as 0, byte by byte.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def normalise(line: str) -> bytes:
    return b" ".join(line.encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def line_hash(line: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(line)
    return h - (h >> 63 << 64)


def probes() -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift of the substring against the segment's place) of every place where a segment can stand, but for a line's own segments."""
    out = []
    for less in range(EDITS + 1):
        for i in range(EDITS + 1):
            for shift in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1):
                if less or shift:
                    out.append((less, i, shift))
    return out


PROBES = probes()


def _power(n: int, base: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) <= n:
        out = np.ones(1, np.uint64)
        while len(out) <= n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        _powers[base] = out
    return _powers[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def keys(lines: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(a row of EDITS + 1 segment keys and len(PROBES) probe keys for each line, 0 where there is none; parity bits)."""
    code = np.frombuffer(b"\n".join(lines).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    breaks = np.flatnonzero(code == 10)
    n = np.diff(np.r_[-1, breaks, len(code)]) - 1 if lines else np.empty(0, np.int64)
    value = _mix(code + np.uint64(1))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value * _power(len(code), _BASE)[: len(code)], out=sums[1:])
    down = _power(len(code), pow(_BASE, -1, 1 << 64))
    start = np.r_[0, breaks + 1]
    flag = np.where(code == 10, np.uint64(0), np.uint64(1) << (value >> np.uint64(58)))
    parity = np.bitwise_xor.reduceat(flag, start) if lines else np.empty(0, np.uint64)

    def key(length: np.ndarray, segment: int, shift: int) -> np.ndarray:
        size = (length + segment) // (EDITS + 1)
        at = sum((length + k) // (EDITS + 1) for k in range(segment)) + shift
        ok = (length >= max(EDITS + 1, least - EDITS)) & (at >= 0) & (at + size <= n)
        s = np.where(ok, start + at, 0)
        e = np.where(ok, s + size, 0)
        found = _mix(_mix((sums[e] - sums[s]) * down[s]) + length.astype(np.uint64) * np.uint64(_BASE) + np.uint64(segment))
        return np.where(ok, found | np.uint64(1), np.uint64(0))

    columns = [key(n, i, 0) for i in range(EDITS + 1)] + [key(n - less, i, shift) for less, i, shift in PROBES]
    return np.stack(columns, 1) if len(lines) else np.empty((0, EDITS + 1 + len(PROBES)), np.uint64), parity


def within(a: str, b: str, most: int = EDITS) -> bool:
    """Whether the edit distance of a and b is at most `most`: common ends are cut off, then each column keeps only the band around the diagonal, as bits (1: this distance or less can be had)."""
    if abs(len(a) - len(b)) > most:
        return False
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, end = 0, min(len(a), len(b))
    while k < end and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    # bit i of reach[d]: the first i of a and the first j of b are within d edits
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i + 1
    reach = [(1 << d + 1) - 1 for d in range(most + 1)]
    full = (1 << len(a) + 1) - 1
    for j, c in enumerate(b, 1):
        low, high = max(0, j - most), min(len(a), j + most)
        band = (1 << high + 1) - (1 << low)
        match, before = where.get(c, 0), None
        now: list[int] = []
        for d in range(most + 1):
            bits = (reach[d] << 1) & match
            if d:
                bits |= before | before << 1 | now[d - 1] | now[d - 1] << 1  # insertion, substitution; one less; deletion
            bits &= band & full
            before = reach[d]
            now.append(bits)
        reach = now
        if not reach[most]:
            return False
    return bool(reach[most] >> len(a) & 1)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _lines(text: str, shortest: int = SHORTEST) -> list[tuple[int, bytes]]:
    """Place and normalised text of the lines that can be duplicates."""
    raw = text.encode("utf-8", "surrogatepass").translate(_PLAIN).split(b"\n")
    found = [(k, x) for k, line in enumerate(raw) if line and (x := b" ".join(line.split()))]
    return found if shortest <= 1 else [(k, x) for k, x in found if len(x) >= 4 * shortest or len(x.decode("utf-8", "surrogatepass")) >= shortest]


def lines_of(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """kind 'doc': doc_id, places and hashes of its lines. kind 'line': a step's distinct lines with first place, keys and parity, and keys that are frequent in the step."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "doc_id", "places", "lines", "line", "keys", "parity", "hot", "hot_n"]

        def lists(values, n, kind):
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values, kind))

        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, STEP):
                first: dict[bytes, tuple] = {}
                number: dict[bytes, int] = {}
                n_lines, places, which = [], [], []
                for doc, t in zip(ids[a:b], texts[a:b], strict=True):
                    found = _lines(t, shortest)
                    n_lines.append(len(found))
                    for k, x in found:
                        i = number.get(x)
                        if i is None:
                            i = number[x] = len(number)
                            first[x] = (doc is not None, doc if doc is not None else 0, k)
                        elif (at := (doc is not None, doc if doc is not None else 0, k)) < first[x]:
                            first[x] = at
                        places.append(k)
                        which.append(i)
                lines = list(number)
                hashes = np.array([line_hash(x) for x in lines], np.int64)
                none = lambda n, kind: pa.nulls(n, kind)
                ints, shorts = pa.list_(pa.int64()), pa.list_(pa.int32())
                columns = [pa.array(["doc"] * (b - a)), pa.array(ids[a:b], pa.int64()), lists(places, n_lines, pa.int32()), lists(hashes[which] if which else [], n_lines, pa.int64()), none(b - a, pa.int64()), none(b - a, ints), none(b - a, pa.int64()), none(b - a, ints), none(b - a, ints)]
                yield pa.RecordBatch.from_arrays(columns, names)
                if not lines:
                    continue
                signed, parity = keys(lines, least)
                held, n = np.unique(signed[signed != 0], return_counts=True)
                many, m = n >= LOCAL, len(lines)
                counts = np.r_[int(many.sum()), np.zeros(m - 1, np.int64)]
                at = [first[x] for x in lines]
                columns = [
                    pa.array(["line"] * m), pa.array([d if there else None for there, d, _ in at], pa.int64()), lists([k for _, _, k in at], np.ones(m, np.int64), pa.int32()), none(m, ints), pa.array(hashes),
                    lists(signed.view(np.int64).ravel(), np.full(m, signed.shape[1]), pa.int64()), pa.array(parity.view(np.int64)), lists(held[many].view(np.int64), counts, pa.int64()), lists(n[many], counts, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    return _docs(docs).mapInArrow(run, "kind string, doc_id long, places array<int>, lines array<long>, line long, keys array<long>, parity long, hot array<long>, hot_n array<long>")


def meeting_collector(block: int, rows_held: int):
    """For mapInArrow: key, own, line, chunk of rows in the order of keys, but for keys that only one line has or none as its own segment; a key's rows are numbered in chunks of `block`."""

    def step(k: np.ndarray, own: np.ndarray, line: np.ndarray, before: int, more: bool):
        """The rows of keys k; the first one has `before` chunks already, the last one goes on if there is `more`."""
        import pyarrow as pa

        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        n = np.diff(np.r_[edge, len(k)])
        many = (n > 1) & (np.add.reduceat(own.astype(np.int64), edge) > 0)
        many[0] |= before > 0
        many[-1] |= more
        chunk = (np.arange(len(k)) - np.repeat(edge, n)) // block
        chunk[: n[0]] += before
        rows = np.repeat(many, n)
        return pa.RecordBatch.from_arrays([pa.array(k[rows]), pa.array(own[rows]), pa.array(line[rows]), pa.array(chunk[rows].astype(np.int32))], ["key", "own", "line", "chunk"])

    def run(batches):
        held, before = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)], 0
        for batch in batches:
            held = [np.r_[x, batch.column(c).to_numpy()] for x, c in zip(held, ("key", "own", "line"), strict=True)]
            while len(held[0]) >= rows_held:
                last = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                cut = last or len(held[0]) // block * block
                yield step(*(x[:cut] for x in held), before, not last)
                before = 0 if last else before + cut // block
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield step(*held, before, False)
        trim()

    return run


def meetings(distinct: DataFrame, hot: DataFrame) -> DataFrame:
    """key, part, own, line, doc, place, parity: the lines that meet. hot: keys that tasks found frequent (about HOT rows at most). Keys that more than BLOCK lines have are dealt out in blocks by their true number: those in hot by a count of their own, before any task has their rows together; any other in chunks of its rows."""
    rows = distinct.select("line", F.posexplode("keys").alias("i", "key")).where("key <> 0").select("key", F.when(F.col("i") <= EDITS, 1).otherwise(0).alias("own"), "line")
    known = F.broadcast(hot.select(F.col("key").alias("hot_key")))
    true = stage(rows.join(known, rows["key"] == known["hot_key"], "left_semi").groupBy(F.col("key").alias("hot_key")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "hot-blocks")
    rows = rows.join(small(true), rows["key"] == true["hot_key"], "left")
    lone = rows.where("hot_key IS NULL").select("key", "own", "line").repartition(tasks(distinct), "key").sortWithinPartitions("key")
    lone = stage(lone.mapInArrow(meeting_collector(BLOCK, ROWS), "key long, own int, line long, chunk int"), "keys")
    large = stage(lone.where("chunk > 0").groupBy("key").agg((F.max("chunk") + 1).cast("long").alias("blocks")), "large")
    pair = lambda own: F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own))
    split = lone.join(small(large), "key", "left").withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair(F.col("chunk").cast("long"))))) if large.limit(1).count() else lone.withColumn("part", F.lit(0).cast("long"))
    dealt = rows.where("hot_key IS NOT NULL").select("key", "own", "line", F.explode(pair(F.pmod(F.xxhash64("line"), F.col("blocks")))).alias("part"))
    about = distinct.select("line", "first.doc", "first.place", "parity")
    return split.select("key", "own", "line", "part").unionByName(dealt).join(about, "line")


def meeting_pairs(met: np.ndarray, own: np.ndarray, line: np.ndarray, rank: np.ndarray, parity: np.ndarray, done: np.ndarray | None) -> np.ndarray:
    """(earlier, later) of rows grouped by met that the bound allows. Without `done`, a later line meets its group's first and its nearest ones; else each line that isn't done meets all earlier ones."""
    order = np.lexsort((rank, met))
    met, own, line, rank, parity = met[order], own[order], line[order], rank[order], parity[order]
    at = np.arange(len(met))
    start = np.maximum.accumulate(np.where(np.r_[True, met[1:] != met[:-1]], at, 0))
    if done is None:
        spans = [(at, start, np.minimum(start + 2, at)), (at, np.maximum(start, at - 2), at)]
    else:
        mine = np.flatnonzero(~done[order])
        spans = [(mine, start[mine], mine)]
    out = [np.empty((0, 2), np.int64)]
    for mine, low, high in spans:
        count = np.maximum(high - low, 0)
        ends = np.cumsum(count)
        k = 0
        while k < len(mine):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
            c = count[k:stop]
            i = np.repeat(mine[k:stop], c)
            j = np.repeat(low[k:stop], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            ok = (line[i] != line[j]) & ((own[i] | own[j]) > 0) & (np.bitwise_count(parity[i] ^ parity[j]) <= 2 * EDITS)
            out.append(np.unique(np.c_[line[j[ok]], line[i[ok]]], axis=0))
            k = stop
    return np.unique(np.concatenate(out), axis=0)


def candidates(met: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Distinct pairs earlier, later of lines that meet."""
    second = done is not None

    def run(batches):
        import pyarrow as pa

        def number(t: pa.Table) -> np.ndarray:
            k, p = t.column("key").to_numpy(), t.column("part").to_numpy()
            return np.cumsum(np.r_[False, (k[1:] != k[:-1]) | (p[1:] != p[:-1])])

        def step(t: pa.Table):
            doc = t.column("doc").fill_null(-(1 << 63)).to_numpy()
            rank = np.empty(t.num_rows, np.int64)
            order = np.lexsort((t.column("line").to_numpy(), t.column("place").to_numpy(), doc))
            rank[order] = np.arange(len(order))
            got = meeting_pairs(number(t), t.column("own").to_numpy(), t.column("line").to_numpy(), rank, t.column("parity").to_numpy().view(np.uint64), t.column("done").to_numpy(zero_copy_only=False).astype(bool) if second else None)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["earlier", "later"])

        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]).combine_chunks() if held is not None else more
            if held.num_rows >= ROWS:
                cut = int(np.searchsorted(t := number(held), t[-1]))
                if cut:
                    yield step(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield step(held)
        trim()

    rows = met.join(done.withColumn("done", F.lit(True)), "line", "left").withColumn("done", F.coalesce("done", F.lit(False))) if second else met
    dealt = rows.repartition(tasks(met), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "earlier long, later long").distinct()


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """The staged pairs within EDITS edits whose later line has `least` characters, on whole lines read again from the documents that have them first."""
    wanted = stage(pairs.select(F.explode(F.array("earlier", "later")).alias("line")).distinct().join(distinct.select("line", F.col("first.doc").alias("doc")), "line"), "wanted")
    homes = small(stage(wanted.select("doc").distinct(), "homes"))
    lines = small(wanted.select(F.col("line").alias("wanted")))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, STEP):
                own = list({x for t in texts[a:b] for _, x in _lines(t)})
                yield pa.RecordBatch.from_arrays([pa.array([line_hash(x) for x in own], pa.int64()), pa.array(own, pa.binary())], ["line", "body"])
        trim()

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            both = ([v.decode("utf-8", "surrogatepass") for v in batch.column(c).to_pylist()] for c in "xy")
            near = [len(y) >= least and within(x, y) for x, y in zip(*both, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("earlier"), batch.column("later")], ["earlier", "later"]).filter(pa.array(near, pa.bool_()))

    rows = _docs(docs)
    there = rows.join(homes, rows["doc_id"].eqNullSafe(homes["doc"]), "left_semi")
    bodies = there.mapInArrow(read, "line long, body binary")
    bodies = stage(bodies.join(lines, F.col("line") == F.col("wanted"), "left_semi").dropDuplicates(["line"]), "bodies")
    x = bodies.select(F.col("line").alias("earlier"), F.col("body").alias("x"))
    y = bodies.select(F.col("line").alias("later"), F.col("body").alias("y"))
    return pairs.join(x, "earlier").join(y, "later").select("earlier", "later", "x", "y").mapInArrow(compare, "earlier long, later long")


def removals(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """doc_id, removed: array of (place, line hash) that go, for documents that lose lines."""
    found = stage(lines_of(docs, shortest, least), "lines")
    lines = found.where("kind = 'line'")
    often = stage(lines.select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).groupBy(F.col("x.hot").alias("key")).agg(F.sum("x.hot_n").alias("n")), "often")
    hot = largest(often, "n", "key", HOT)
    first = F.min(F.struct(F.col("doc_id").alias("doc"), F.col("places")[0].alias("place"))).alias("first")
    distinct = stage(lines.groupBy("line").agg(first, F.first("keys").alias("keys"), F.first("parity").alias("parity")), "distinct")
    met = stage(meetings(distinct, stage(hot, "hot")), "met")
    pairs = stage(candidates(met), "pairs")
    near = stage(verified(docs, distinct, pairs, least).select(F.col("later").alias("line")).distinct(), "near")
    rest = stage(candidates(met, near).join(pairs, ["earlier", "later"], "left_anti"), "pairs")
    near = near.unionByName(verified(docs, distinct, rest, least).select(F.col("later").alias("line"))).distinct()

    held = found.where("kind = 'doc'").select("doc_id", F.explode(F.arrays_zip("places", "lines")).alias("x")).select("doc_id", F.col("x.places").alias("place"), F.col("x.lines").alias("line"))
    often = found.where("kind = 'doc'").select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    affected = stage(often.withColumn("near", F.lit(False)).unionByName(near.withColumn("near", F.lit(True))).groupBy("line").agg(F.max("near").alias("near")).join(distinct.select("line", "first"), "line"), "affected")
    affected = small(affected)
    is_first = F.col("first.doc").eqNullSafe(F.col("doc_id")) & (F.col("first.place") == F.col("place"))
    gone = held.join(affected, "line").where(F.col("near") | ~is_first)
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("place", "line")).alias("removed"))


def dedup(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """docs with text without its duplicate lines, and n_lines, n_removed (all columns of docs stay, but for two of these names, which are replaced).

    Equal lines of `shortest` or more characters go but for the first; lines of `least` or more also if an earlier line is
    within EDITS edits, however long they are: a long line with another word in it is another line.
    A null text stays null. Rows that share a doc_id are one document: equal lines at the same place of them aren't
    duplicates of each other. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    few = small(stage(removals(docs, shortest, least), "removals"))
    key = F.col("doc_id").cast("long")
    joined = docs.join(few.select(F.col("doc_id").alias("__doc"), F.transform("removed", lambda x: x["place"]).alias("__places"), F.transform("removed", lambda x: x["line"]).alias("__hashes")), key.eqNullSafe(F.col("__doc")), "left").drop("__doc")
    names = [c for c in joined.columns if c not in ("__places", "__hashes")]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts, places, hashes = (batch.column(c).to_pylist() for c in ("text", "__places", "__hashes"))
            out, n_lines, n_removed = [], [], []
            for t, p, h in zip(texts, places, hashes, strict=True):
                lines = t.split("\n") if t is not None else []
                drop = {k for k, x in zip(p or (), h or (), strict=True) if k < len(lines) and line_hash(normalise(lines[k])) == x}
                out.append("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else t)
                n_lines.append(len(lines))
                n_removed.append(len(drop))
            columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_lines", "n_removed"])
        trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_removed long"
    return joined.mapInArrow(cut, schema)

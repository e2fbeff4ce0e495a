"""Byte-level BPE by recursive DuckDB queries, one in-memory database per Python worker.

Encoding: the pattern splits a text; a match that is itself a token gets its id; each other match is a set
of (word, position, id) rows, from its bytes on. A recursive query joins neighbours with the merge table and
contracts each word's minimum-rank pair, leftmost first and wherever it recurs without overlap (a pair that
holds a merged token always has a higher rank than the token, so no later occurrence can be overtaken),
until no pair is in the table. A query keeps the rows of all its rounds, so after ROUNDS of them the words that aren't
done go on in another query, from their last rows: very long matches take bounded memory. Each distinct match is encoded once per worker. Decoding: a query
takes each id's bytes from the vocabulary, one list, and puts them together in the order of a text's ids, without a sort.
"""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .tokens import slices

#: Distinct matches kept per worker; a full store is emptied and filled again.
STORE = 1_500_000
#: Bytes that one recursive query starts from.
START_BYTES = 1_500_000
#: Rounds of one recursive query.
ROUNDS = 32

#: Each round contracts a word's least pair (l, r). Where l and r differ, hits can't overlap. Where they are twins, every other one of a run of hits is taken.
ENCODE = """
WITH RECURSIVE t AS (
  SELECT 0 AS round, word, pos, id FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT round, word, pos, id, lead(id) OVER w AS following, lag(id) OVER w AS previous FROM t WHERE round < $rounds WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
      SELECT p.*, m.merged FROM pairs p LEFT JOIN merges m ON m.left_id = p.id AND m.right_id = p.following
    ), best AS (
      SELECT word, min(merged) AS least, arg_min(id, merged) AS l, arg_min(following, merged) AS r FROM ranked WHERE merged IS NOT NULL GROUP BY word
    ), hits AS (
      SELECT r.round, r.word, r.pos, r.id, b.least, b.l = b.r AS twin, r.id = b.l AND coalesce(r.following = b.r, false) AS hit, r.id = b.r AND coalesce(r.previous = b.l, false) AS after FROM ranked r JOIN best b ON r.word = b.word
    ), twins AS (
      SELECT *, row_number() OVER w - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
      FROM (SELECT *, row_number() OVER w AS n FROM hits WHERE twin WINDOW w AS (PARTITION BY word ORDER BY pos)) WINDOW w AS (PARTITION BY word ORDER BY pos)
    )
    SELECT round + 1, word, pos, CASE WHEN hit THEN least ELSE id END FROM hits WHERE NOT twin AND NOT after
    UNION ALL
    SELECT round + 1, word, pos, CASE WHEN hit AND k % 2 = 1 THEN least ELSE id END FROM twins WHERE k = 1 OR k % 2 = 1
  )
), last AS (SELECT word, max(round) AS round FROM t GROUP BY word)
SELECT t.word, any_value(t.round) AS round, list(t.id ORDER BY t.pos) AS ids FROM t JOIN last ON t.word = last.word AND t.round = last.round GROUP BY t.word
"""
DECODE = """
SELECT doc, coalesce(array_to_string(list_transform(ids, lambda id: CASE WHEN id >= 0 THEN all_bytes[id + 1] END), ''), '') AS bytes FROM coded, vocabulary
"""

_coders: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    """Encoder and decoder of a rank file; bytes stand in the database as the characters of the same numbers."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.findall = regex.compile(pattern).findall
        self.token_id = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        spelled = [None] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            spelled[r] = t.decode("latin-1")
        for name, kinds, columns in (("merges", {"left_id": "INTEGER", "right_id": "INTEGER", "merged": "INTEGER"}, [list(c) for c in zip(*merges, strict=True)]), ("vocabulary", {"all_bytes": "VARCHAR[]"}, [[spelled]])):
            self.db.register("incoming", pa.table(dict(zip(kinds, columns, strict=True))))
            self.db.execute(f"CREATE TABLE {name} AS SELECT {', '.join(f'CAST(incoming.{c} AS {k}) AS {c}' for c, k in kinds.items())} FROM incoming")
            self.db.unregister("incoming")
        self.store: dict[str, bytes] = {}
        said = [b"%d " % i for i in range(max(ranks.values()) + 1)]
        self.said_n = np.array([len(x) for x in said])
        self.said = np.frombuffer(b"".join(x.ljust(self.said_n.max()) for x in said), np.uint8).reshape(len(said), -1)

    def _contract(self, words: list[bytes]) -> list[list[int]]:
        """Ids of byte strings that aren't tokens."""
        import numpy as np
        import pyarrow as pa

        out: list[list[int]] = []
        at = 0
        while at < len(words):
            end, total = at, 0
            while end < len(words) and (end == at or total + len(words[end]) <= START_BYTES):
                total += len(words[end])
                end += 1
            part = words[at:end]
            found: list[list[int]] = [[]] * len(part)
            which, n = np.arange(len(part), dtype=np.int32), np.array([len(w) for w in part])
            ids = self.byte_id[np.frombuffer(b"".join(part), np.uint8)]
            while len(which):
                pos = (np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                self.db.register("start", pa.table({"word": np.repeat(which, n), "pos": pos, "id": ids}))
                got = self.db.sql(ENCODE, params={"rounds": ROUNDS}).to_arrow_table()
                self.db.unregister("start")
                again = []
                for w, r, x in zip(*(got.column(c).to_pylist() for c in ("word", "round", "ids")), strict=True):
                    if r < ROUNDS:
                        found[w] = x
                    else:
                        again.append((w, x))
                which, n = np.array([w for w, _ in again], np.int32), np.array([len(x) for _, x in again], np.int64)
                ids = np.array([i for _, x in again for i in x], np.int32)
            out += found
            at = end
        return out

    def split(self, texts: list[str]) -> list[list[str]]:
        """Each text's matches; each distinct match has its ids in store."""
        import numpy as np

        matches = [self.findall(t) for t in texts]
        seen: set[str] = set()
        for m in matches:
            seen.update(m)
        if len(self.store) + len(seen) > STORE:
            self.store.clear()
        new = list(seen.difference(self.store))
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        ids = [self.token_id.get(b) for b in raw]
        longer = [k for k, i in enumerate(ids) if i is None]
        for k, x in zip(longer, self._contract([raw[k] for k in longer]), strict=True):
            ids[k] = x
        for w, x in zip(new, ids, strict=True):
            x = [x] if isinstance(x, int) else x
            self.store[w] = struct.pack(f"<{len(x)}i", *x)
        return matches

    def numerals(self, ids) -> bytes:
        """Decimal ids joined by one blank."""
        import numpy as np

        return self.said[ids][np.arange(self.said.shape[1]) < self.said_n[ids][:, None]].tobytes()[:-1]

    def encode(self, texts: list[str]) -> list[list[int]]:
        import numpy as np

        return [np.frombuffer(b"".join(map(self.store.__getitem__, m)), "<i4").tolist() for m in self.split(texts)]

    def decode(self, coded) -> list[bytes]:
        """Bytes of each list of ids (an Arrow list array)."""
        import numpy as np
        import pyarrow as pa

        self.db.register("coded", pa.table({"doc": np.arange(len(coded), dtype=np.int32), "ids": coded}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("coded")
        out = [b""] * len(coded)
        for d, b in zip(got.column("doc").to_pylist(), got.column("bytes").to_pylist(), strict=True):
            out[d] = b.encode("latin-1")
        return out


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids of every whole text (null or empty: no ids). Repeated rows each give a row."""

    def run(batches):
        import pyarrow as pa

        bpe = coder(ranks, pattern)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 2_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(bpe.encode(texts[a:b]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, bytes of each row's ids (null ids: no bytes)."""

    def run(batches):
        import pyarrow as pa

        bpe = coder(ranks, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bpe.decode(part.column("ids")), pa.binary())], ["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of each text's ids and of what they decode to.

    A null text counts as empty; texts and matches of any length are encoded whole; each of repeated rows gives a row;
    an empty table gives none. Other columns of docs don't matter.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe, sha = coder(ranks, pattern), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 2_000_000):
                matches = bpe.split(texts[a:b])
                ids = [b"".join(map(bpe.store.__getitem__, m)) for m in matches]
                said = [bpe.numerals(np.frombuffer(x, "<i4")) for x in ids]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array([sha(s) for s in said]), pa.array([sha(s) for s in bpe.decode(lists)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

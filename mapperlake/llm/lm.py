"""LM scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Counts of every training token come first: partial counts by task, then a shuffle by word. Every word, known or
not, has a class: the most frequent words are classes of their own, any other word's class is its longest ending
among the endings (of up to ENDING bytes) that hold most of the remaining tokens, and class 0 without one. The
number of classes grows with the distinct training tokens (see class_count). The model predicts a token's class
from the two tokens before it: a context's vector is C1 r(c1) + C2 r(c2), a class scores its dot product with
the class's vector, plus a bias that starts at the log of the class's share. Within a class a token's probability
is (count + 1) / (tokens + distinct + 1 of the class), so all words are told apart by their counts.
Every partition trains on all its training tokens (minibatches, Adagrad, shared noise samples from the unigram
distribution of classes); the weights are averaged by tokens, block by block.
In scoring, batched matrix products over all classes give each context's normaliser, so probabilities sum
to one (over the known tokens and an unseen one for each class). The HEAD most frequent tokens' counts are broadcast
(a fixed bound); all other tokens of documents join the count table by a shuffle.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import largest, stage, texts_of
from .tokens import slices

DIM, NOISE, BATCH, RATE = 32, 64, 4096, 0.1
#: Classes at least, and bytes of an ending at most.
FEWEST, ENDING = 256, 3
CUTS = [slice(-n, None) for n in range(ENDING, 0, -1)]
HEAD = 1 << 19
#: Words whose class a task keeps at hand, and contexts whose normaliser it does (powers of two); both are computed again when they are missing.
WORDS_HELD, NORMS_HELD = 1 << 18, 1 << 21
#: Bytes of weights that are averaged together, and partitions whose weights are.
PIECE, FAN_IN = 8192, 256
#: Distinct tokens that a task counts before it passes its partial counts on.
FLUSH = 1_000_000
#: The end token; no word is empty.
END = b""
_tables: dict[str, tuple] = {}


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered, and the end."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def with_fold(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out: crc32 of doc_id as text leaves 2 modulo 7 (a null id as empty text)."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold == 2).alias("held_out"))


def token_counts(folded: DataFrame) -> DataFrame:
    """word binary, c long over all training documents."""

    def run(batches):
        import pyarrow as pa

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])

        counter: Counter = Counter()
        for batch in batches:
            for t in texts_of(batch):
                counter.update(words_of(t))
                if len(counter) > FLUSH:
                    yield from rows()
                    counter = Counter()
        if counter:
            yield from rows()

    return folded.where(~F.col("held_out")).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def class_count(distinct: int) -> int:
    """Classes for so many distinct training tokens: about a quarter of their square root, as a power of two, FEWEST at least. They grow with the corpus without a limit, as slowly as a square root: a million million distinct tokens have 262,144."""
    return max(FEWEST, 1 << (distinct // 16).bit_length() // 2)


def groups(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of index, the order that brings equal ones together, and where each begins in it."""
    index = index.astype(np.uint16 if index.max(initial=0) < 1 << 16 else np.int32)  # 16 bits are sorted by radix
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[first], order, first


def grouped(index: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of index and the sum of g's rows for each."""
    own, order, first = groups(index)
    return own, np.add.reduceat(g[order], first, axis=0)


def placed(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place of the index that groups() took, the row of its number."""
    turn = np.empty(len(order), np.intp)
    turn[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    return rows[turn]


class ClassOf(dict):
    """The class of every word: 1 to len(names) of these, the next ones of endings, 0 of the rest."""

    def __init__(self, names: list[bytes], endings: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(names, 1))
        self.fixed = len(self)
        self.endings = {e: k for k, e in enumerate(endings, 1 + len(names))}

    def __missing__(self, word: bytes) -> int:
        of, found = self.endings.get, 0
        for cut in CUTS:
            if found := of(word[cut], 0):
                break
        if len(self) < self.fixed + WORDS_HELD:
            self[word] = found
        return found


class Model:
    """Weights of the log-bilinear model: r (vectors of context classes, the last for what stands before a text), C1, C2, class vectors q, biases b."""

    def __init__(self, share: np.ndarray, seed: int = 5):
        rng, n = np.random.default_rng(seed), len(share)
        self.share = share
        self.w = {
            "r": rng.normal(0, 0.1, (n + 1, DIM)).astype("f4"), "C1": (np.eye(DIM) / 2).astype("f4"), "C2": (np.eye(DIM) / 2).astype("f4"),
            "q": rng.normal(0, 0.1, (n, DIM)).astype("f4"), "b": np.log(np.maximum(share, 1e-12)).astype("f4"),
        }
        self.held: tuple[np.ndarray, np.ndarray] | None = None
        self.sides: tuple[np.ndarray, np.ndarray] | None = None

    def pack(self) -> bytes:
        return b"".join(self.w[k].tobytes() for k in sorted(self.w))

    def unpack(self, data: bytes) -> "Model":
        at, flat = 0, np.frombuffer(data, "f4")
        for k in sorted(self.w):
            self.w[k] = flat[at : at + self.w[k].size].reshape(self.w[k].shape).copy()
            at += self.w[k].size
        return self

    def context(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.w["r"][w1] @ self.w["C1"] + self.w["r"][w2] @ self.w["C2"]

    def train(self, w1: np.ndarray, w2: np.ndarray, target: np.ndarray, rng, grown: dict) -> None:
        """One pass of noise-contrastive estimation over the examples."""
        w, cdf = self.w, np.cumsum(self.share)
        log_noise = np.log(NOISE * np.maximum(self.share, 1e-12)).astype("f4")

        def step(name: str, g: np.ndarray) -> None:
            grown[name] += g * g
            w[name] += RATE * g / np.sqrt(grown[name] + 1e-6)

        def step_rows(name: str, index: np.ndarray, g: np.ndarray) -> None:
            own, total = grouped(index, g)
            grown[name][own] += total * total
            w[name][own] += RATE * total / np.sqrt(grown[name][own] + 1e-6)

        for a in range(0, len(target), BATCH):
            x1, x2, t = w1[a : a + BATCH], w2[a : a + BATCH], target[a : a + BATCH]
            noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE) * cdf[-1]), len(cdf) - 1)
            # a batch has few distinct classes: what depends on a token before alone is computed once for each, and gradients are summed before they go back
            own1, order1, first1 = groups(x1)
            own2, order2, first2 = groups(x2)
            r1, r2 = w["r"][own1], w["r"][own2]
            v = placed(r1 @ w["C1"], order1, first1) + placed(r2 @ w["C2"], order2, first2)
            qt, qn = w["q"][t], w["q"][noise]
            s = np.einsum("ij,ij->i", v, qt) + (w["b"] - log_noise)[t]
            sn = v @ -qn.T  # with the sign that exp needs
            sn -= w["b"][noise] - log_noise[noise]
            up = (1 / (1 + np.exp(np.clip(s, -30, 30)))).astype("f4") / len(t)
            np.clip(sn, -30, 30, out=sn)
            np.exp(sn, out=sn)
            sn += 1
            down = np.divide(np.float32(-1 / len(t)), sn, out=sn)
            dv = up[:, None] * qt + down @ qn
            db = np.bincount(t, up, len(w["b"])).astype("f4")
            np.add.at(db, noise, down.sum(0))
            dv1, dv2 = np.add.reduceat(dv[order1], first1, axis=0), np.add.reduceat(dv[order2], first2, axis=0)
            back1, back2 = dv1 @ w["C1"].T, dv2 @ w["C2"].T
            step("C1", r1.T @ dv1)
            step("C2", r2.T @ dv2)
            step_rows("q", np.concatenate([t, noise]), np.concatenate([up[:, None] * v, down.T @ v]))
            step("b", db)
            step_rows("r", np.concatenate([own1, own2]), np.concatenate([back1, back2]))

    def normaliser(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v), "f4")
        for a in range(0, len(v), 1024):
            s = v[a : a + 1024] @ self.w["q"].T
            s += self.w["b"]
            top = s.max(1, keepdims=True)
            s -= top
            out[a : a + 1024] = np.log(np.exp(s, out=s).sum(1)) + top[:, 0]
        return out

    def log_probability(self, w1: np.ndarray, w2: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability, normalised over all classes. Normalisers of contexts are kept in a table of NORMS_HELD places."""
        n = len(self.w["r"])
        if self.held is None:
            self.held = np.full(NORMS_HELD, -1, np.int64), np.zeros(NORMS_HELD, "f4")
            self.sides = self.w["r"] @ self.w["C1"], self.w["r"] @ self.w["C2"]
        (keys, norms), (one, two) = self.held, self.sides
        out = np.empty(len(target), "f4")
        for a in range(0, len(target), 1 << 16):
            cut = slice(a, a + (1 << 16))
            x1, x2, t = w1[cut], w2[cut], target[cut]
            v = one[x1] + two[x2]
            key = x1.astype(np.int64) * n + x2
            at = (key * 0x9E3779B1 >> 7) & NORMS_HELD - 1
            norm = norms[at]
            missed = np.flatnonzero(keys[at] != key)
            if len(missed):
                own, first, turn = np.unique(key[missed], return_index=True, return_inverse=True)
                new = self.normaliser(v[missed[first]])
                norm[missed] = new[turn]
                place, last = np.unique(at[missed[first]][::-1], return_index=True)  # of contexts that share a place, one is kept, with its own value
                keys[place], norms[place] = own[::-1][last], new[::-1][last]
            out[cut] = np.einsum("ij,ij->i", v, self.w["q"][t]) + self.w["b"][t] - norm
        return out


def contexts(classes: np.ndarray, lengths: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token of texts laid end to end; `before` where a text begins."""
    start = np.cumsum(lengths) - lengths
    one, two = np.r_[before, classes[:-1]], np.r_[before, before, classes[:-2]][: len(classes)]
    one[start] = before
    two[start] = before
    second = start[lengths > 1] + 1
    two[second] = before
    return one, two


def train(folded: DataFrame, names: list[bytes], endings: list[bytes], share: np.ndarray) -> Model:
    """The average of what all partitions learn, weighted by their tokens; without training tokens the starting weights."""
    blank = Model(share)

    def learn(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        index, model, rng, n = ClassOf(names, endings), Model(share), np.random.default_rng(11), 0
        grown = {k: np.zeros_like(v) for k, v in model.w.items()}
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                found = [words_of(t) for t in texts[a:b]]
                lengths = np.array([len(x) for x in found])
                classes = np.concatenate([np.fromiter(map(index.__getitem__, x), np.int32, len(x)) for x in found])
                w1, w2 = contexts(classes, lengths, len(share))
                order = rng.permutation(len(classes))
                model.train(w1[order], w2[order], classes[order], rng, grown)
                n += len(classes)
        if n:
            data = model.pack()
            pieces = [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
            k = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([TaskContext.get().partitionId() // FAN_IN] * k, pa.int32()), pa.array([n] * k, pa.int64()), pa.array(pieces, pa.binary())], ["block", "part", "n", "weights"])

    def average(pdf):
        x = np.stack([np.frombuffer(x, "f4") for x in pdf["weights"]])
        return pdf[:1].assign(n=pdf["n"].sum(), weights=[np.average(x.astype("f8"), axis=0, weights=pdf["n"]).astype("f4").tobytes()])

    shape = "block int, part int, n long, weights binary"
    learned = folded.where(~F.col("held_out")).select("text").mapInArrow(learn, shape)
    halfway = learned.groupBy("block", "part").applyInPandas(average, shape)
    rows = halfway.groupBy("block").applyInPandas(average, shape).select("block", "weights").toArrow().sort_by("block")  # the model's size
    return blank.unpack(b"".join(rows.column("weights").to_pylist())) if rows.num_rows else blank


def class_masses(counts: DataFrame, names: list[bytes], endings: list[bytes]) -> np.ndarray:
    """Sum of count + 1 over each class's words, and 1 for an unseen one."""

    def run(batches):
        import pyarrow as pa

        index, sums = ClassOf(names, endings), np.zeros(1 + len(names) + len(endings), np.int64)
        for batch in batches:
            at = np.fromiter(map(index.__getitem__, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            np.add.at(sums, at, batch.column("c").to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["class", "mass"])

    out = np.ones(1 + len(names) + len(endings), np.int64)
    rows = counts.select("word", "c").mapInArrow(run, "class long, mass long").groupBy("class").agg(F.sum("mass").alias("mass")).toArrow()  # a row for each class
    out[rows.column("class").to_numpy()] += rows.column("mass").to_numpy()
    return out


def choose_classes(counts: DataFrame, head_words: list[bytes], distinct: int) -> tuple[list[bytes], list[bytes]]:
    """Words that are classes of their own, and the endings that hold most of the other tokens."""
    n = class_count(distinct)
    names = head_words[: n // 2]
    own = F.array(*[F.substring("word", -k, k) for k in range(1, ENDING + 1)])
    known = counts.sparkSession.createDataFrame([(w,) for w in names], "word binary")
    ends = counts.join(F.broadcast(known), "word", "left_anti").select(F.explode(F.array_distinct(own)).alias("ending"), "c").where(F.length("ending") > 0)
    ends = stage(ends.groupBy("ending").agg(F.sum("c").alias("c")), "endings")
    found = sorted(((x["c"], bytes(x["ending"])) for x in largest(ends, "c", "ending", max(8192, 2 * n)).collect()), key=lambda x: (-x[0], x[1]))
    return names, [e for _, e in found[: n - 1 - len(names)]]


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null or empty text is its end token alone; a text of any length is scored whole. Repeated rows and rows with
    null or equal doc_ids are scored apart, and each counts in training. Words that tie in frequency are ordered by
    their bytes (at the HEAD's edge, by a hash). Other columns of docs are left alone. Without training tokens base_score is that of unseen tokens;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    folded = with_fold(docs)
    counts = stage(token_counts(folded), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = sorted(((x["word"], x["c"]) for x in largest(counts, "c", "word", HEAD).toArrow().to_pylist()), key=lambda x: (-x[1], x[0]))
    head_words, head_counts = [w for w, _ in head], np.array([c for _, c in head], np.int64)
    names, endings = choose_classes(counts, head_words, distinct)
    mass = class_masses(counts, names, endings)
    share = mass / mass.sum()
    model = train(folded, names, endings, share)

    sent = spark.sparkContext.broadcast((b"\n".join(head_words), np.log10(head_counts + 1.0), model.pack(), share, np.log10(mass), names, endings))
    key, k = uuid.uuid4().hex, np.log10(total + distinct + 1.0)

    def run(batches):
        import pyarrow as pa

        if key not in _tables:
            joined, logs, weights, shares, masses, own_names, own_endings = sent.value
            index = {w: i for i, w in enumerate(joined.split(b"\n"))} if len(logs) else {}
            class_of = ClassOf(own_names, own_endings)
            classes = np.fromiter(map(class_of.__getitem__, index), np.int32, len(index))
            _tables.clear()
            _tables[key] = index, np.r_[logs, 0.0], np.r_[classes, 0], class_of, masses, len(own_names), Model(shares).unpack(weights)
        index, logs, head_class, class_of, masses, n_names, lbl = _tables[key]
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                found = [words_of(t) for t in texts[a:b]]
                lengths = np.array([len(x) for x in found])
                at = np.concatenate([np.fromiter(map(index.get, x, repeat(-1)), np.int32, len(x)) for x in found])
                start = np.cumsum(lengths) - lengths
                rare = [[x[i] for i in np.flatnonzero(at[s : s + len(x)] < 0).tolist()] for x, s in zip(found, start.tolist(), strict=True)]
                classes = head_class[at]
                other = np.flatnonzero(at < 0)
                classes[other] = np.fromiter((class_of[w] for x in rare for w in x), np.int32, len(other))
                w1, w2 = contexts(classes, lengths, len(lbl.share))
                log_c = logs[at]
                lm = lbl.log_probability(w1, w2, classes) / np.log(10)
                lm += np.where((classes > 0) & (classes <= n_names), 0, log_c - masses[classes])
                counted = [Counter(x) for x in rare]
                add = lambda x: pa.array(np.add.reduceat(x, start))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id").slice(a, b - a), batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(lengths, pa.int64()), add((at >= 0).astype(np.int64)), add(log_c), add(lm.astype("f8")), pa.array([list(r) for r in counted], pa.list_(pa.binary())), pa.array([list(r.values()) for r in counted], pa.list_(pa.int64()))],
                    ["row_id", "doc_id", "held_out", "n_tokens", "n_head", "log_head", "lm", "rare", "rare_n"],
                )

    schema = "row_id long, doc_id long, held_out boolean, n_tokens long, n_head long, log_head double, lm double, rare array<binary>, rare_n array<long>"
    scored = stage(folded.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(run, schema), "scored")
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row_id", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    tail = rare.join(counts, "word").groupBy("row_id").agg(F.sum("n").alias("n_tail"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log_tail"))
    full = scored.drop("rare", "rare_n").join(tail, "row_id", "left").fillna(0, ["n_tail", "log_tail"])
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.col("n_tail")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_head") + F.col("log_tail") - F.col("n_tokens") * F.lit(float(k))).alias("base_score"), (F.col("lm") + F.col("log_tail")).alias("score"),
    )

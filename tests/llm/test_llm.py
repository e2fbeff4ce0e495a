"""Each operator against a brute-force version, on texts with nulls, repeated rows, ties, odd characters and clashing columns."""

import base64
import gzip
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapperlake.llm import bpe, common, components, fingerprint, jaccard, line_dedup, lm, packing, quality, queries, sharding, shingles, token_files, warc
from mapperlake.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, label long, n long, key string, part int, shard string"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def make(spark, texts, ids=None, hosts=None):
    rows = [(i if ids is None else ids[i], t, "en", hosts[i] if hosts else f"h{i % 3}", len(t or ""), "x", 7, 8, "k", 1, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(r, n, words=400):
    return " ".join(f"w{r.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = [prose(r, r.randint(5, 400)) for _ in range(25)]
    near = []
    for t in base[:10]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[r.randrange(len(v))] = f"e{r.randint(0, 999)}"
            near.append(" ".join(v))
    odd = [None, "", " ", "\n\n", "one", "two words", "Ünïcode İx ﬁ\x85 a\x1cb\xa0c", "a" * 3000, ("line of text that repeats itself\n" * 30), "x " * 3000, base[0], base[0], "THE End. the end? The END!", "<|endoftext|> it's we'll", "🎉 éé́ 中文。字"]
    return base + near + odd


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 ------------------------------------------------------------------------------------------------


def test_lookup_table():
    names = [f"s{k}" for k in range(10)]
    table = sharding.lookup_table(names)
    assert len(table) == 1009 and set(table) == set(range(10)) and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], size=1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    heavy = Counter(sharding.lookup_table(["a", "b"], [1, 3]))
    assert 2.8 < heavy[1] / heavy[0] < 3.2
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_sharding(spark, texts, tmp_path):
    docs = make(spark, texts, ids=[None if i == 3 else i // 2 for i in range(len(texts))])
    names = [f"s{k}" for k in range(4)]
    table = sharding.lookup_table(names)
    for r in sharding.place(docs, names, "doc_id").collect():
        key = "null" if r["doc_id"] is None else f"={r['doc_id']}"
        assert r["slot"] == sharding.number(key) % len(table) and r["shard"] == names[table[r["slot"]]]
    assert sharding.place(empty(spark), names, "doc_id").count() == 0
    sharding.write(docs, names, str(tmp_path / "out"), "doc_id", "source")
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(texts)


# 2, 7 ---------------------------------------------------------------------------------------------


def test_chunk_encoder(texts):
    t = Tokenizer.from_file(WORDS)
    e = encoder(WORDS)
    for x in [x or "" for x in texts] + ["naïve.,x A, b. 12.", "'s's A's", "ß. É, ª º", "a.b. , .", "x\x0by\x0cz", "a <|startoftext|> b", "x<|endoftext|>.<|startoftext|><|ENDOFTEXT|> e\u0301<|endoftext|>\u0301", "<|endoftext|"]:
        assert np.frombuffer(e.encode([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_packing(spark, texts):
    docs = make(spark, texts, ids=[i // 2 for i in range(len(texts))])
    rows = packing.pack_documents(docs, WORDS, capacity=256).collect()
    t = Tokenizer.from_file(WORDS)
    want = Counter()
    total = 0
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[(i // 2, k // 256, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    lengths = np.array([r["length"] for r in rows])
    assert math.ceil(total / 256) <= len(bins) <= packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), np.full(len(rows), -1), [], 256, 0)
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


def test_genetic_steps():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300)
    a, b = np.full(300, -1), np.full(300, -1)
    packing.best_fit(lengths, np.argsort(-lengths), a, [], 100, 0)
    packing.best_fit(lengths, rng.permutation(300), b, [], 100, 0)
    child = packing.crossover(lengths, a, b, 100, rng)
    assert (child >= 0).all() and np.bincount(child, lengths).max() <= 100
    found, ran = packing.evolve(lengths, [b], 100, 8, 3)
    assert packing.fitness(lengths, found[0], 100) >= packing.fitness(lengths, b, 100) and ran == 8


def triplets(n, seed=0):
    """Lengths of n full bins of 100, three pieces each: best fit in falling order misses that packing by a tenth."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = int(r.integers(26, 34))
        b = min(49, int(r.integers(26, 75 - a)))
        out += [a, b, 100 - a - b]
    return np.array(out)


def test_evolution_beats_best_fit():
    lengths = triplets(40)
    by_fit = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), np.full(len(lengths), -1), [], 100, 0)
    found, ran = packing.evolve(lengths, [], 100, 200, 1)
    assert len(set(found[0].tolist())) <= by_fit - 2 and ran == 200 and np.bincount(found[0], lengths).max() <= 100


def test_packing_over_many_blocks(spark, monkeypatch):
    """Islands evolve each block; what blocks leave is packed together, so the blocks' own rests don't add up."""
    monkeypatch.setattr(packing, "BLOCK", 64)
    r = np.random.default_rng(5)
    lengths = np.r_[r.integers(1, 400, 2000), triplets(30) * 10].tolist()
    items = spark.createDataFrame([(k, k, 0, int(n)) for k, n in enumerate(lengths)], "row_id long, doc_id long, piece int, length long")
    rows = packing.pack(items, 1000).collect()
    bins = defaultdict(list)
    for x in rows:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    assert sorted(x["row_id"] for x in rows) == list(range(len(lengths)))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1000
    assert len(bins) <= math.ceil(sum(lengths) / 1000) + 2  # of 33 blocks
    dealt = items.withColumn("block", F.pmod("row_id", F.lit(4))).select("block", "row_id", "piece", "length")
    ran = packing.evolved(dealt, 1000, 7).groupBy("block", "source").agg(F.max("generations").alias("g"), F.max("island").alias("to"), F.countDistinct("island").alias("n")).collect()
    assert len(ran) == 8 and all(x["g"] > 0 and x["n"] == packing.ISLANDS for x in ran)


def test_token_files(spark, texts, tmp_path):
    docs = make(spark, texts)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, WORDS, path)
    rows = {r["doc_id"]: r for r in token_files.read_tokens(spark, path).collect()}
    index = {r["doc_id"]: r for r in token_files.read_index(spark, path).collect()}
    t = Tokenizer.from_file(WORDS)
    at = 0
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert index[i]["start"] == at
        at += len(ids)
    import pyarrow.parquet as pq

    metas = [pq.ParquetFile(p).metadata for p in (tmp_path / "tokens").glob("*.parquet")]
    columns = [m.row_group(0).column(c) for m in metas if m.num_rows for c in range(m.num_columns)]
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns) and any("RLE_DICTIONARY" in c.encodings or "PLAIN_DICTIONARY" in c.encodings for c in columns)
    assert all(c.has_offset_index for c in columns)
    part = token_files.read_range(spark, path, 10, 12)
    assert {x["doc_id"]: len(x["ids"]) for x in part.collect()} == {i: rows[i]["n_tokens"] for i in (10, 11, 12)}
    plan = part._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "n_tokens" not in plan.rpartition("ReadSchema")[2]
    # rows that share a doc_id, and null ids: one order, everywhere
    tied = make(spark, ["one two three four five", "one", None, "one two three", "x", "one"], ids=[1, 1, 1, None, None, 1])
    token_files.write_tokens(tied, WORDS, str(tmp_path / "tied"))
    stored = sorted((x["segment"], x["place"], x["n_tokens"]) for x in spark.read.parquet(str(tmp_path / "tied")).collect())
    starts = [sum(n for _, _, n in stored[:k]) for k in range(len(stored))]
    want = sorted(zip(starts, (n for _, _, n in stored), strict=True))
    assert sorted((x["start"], x["n_tokens"]) for x in token_files.read_tokens(spark, str(tmp_path / "tied")).collect()) == want
    assert sorted((x["start"], x["n_tokens"]) for x in token_files.read_index(spark, str(tmp_path / "tied")).collect()) == want
    assert token_files.write_and_read(empty(spark), WORDS).count() == 0


# 3 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, texts, reference):
    runs = ["a" * k for k in range(1, 40)] + ["ab" * 30 + "aa" * k for k in range(9)] + [" " * k + "x" for k in range(30)] + ["=" * 333, "\x00\x1c \x85\xa0 b"]
    every = texts + runs
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = make(spark, every)
    for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect():
        x = every[r["doc_id"]] or ""
        ids = reference.encode_ordinary(x)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), x
        assert r["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(coded, path, public_tokenizers.PATTERN).collect()} == {i: (x or "").encode() for i, x in enumerate(every)}
    assert bpe.round_trip(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_long_matches_take_several_queries(reference, monkeypatch):
    monkeypatch.setattr(bpe, "ROUNDS", 7)
    coder = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(6)
    every = ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (1, 30, 2500, 400)] + ["a" * 3000, "short words too", "abab" * 200]
    got = coder.encode(every)
    assert got == [reference.encode_ordinary(t) for t in every]


# 4 ------------------------------------------------------------------------------------------------


def pieces_of(text):
    """By steps, over bytes: the line's end; after seven bytes the next place where a character's class follows that of the one before; 64 bytes."""
    kind = lambda b: ((b & 63) * 51 + 4) % 64 // 16
    more = lambda b: 0x80 <= b < 0xC0

    def follows(own):
        """Whether the last byte's class follows that of the byte before, or of the one before the first bytes of its character."""
        for skip in range(4):
            j = len(own) - 2 - skip
            first = own[j + 1 : -1]
            if j >= 5 and own[j] < 0xC0 and (not first or first[0] >= 0xC0 and all(map(more, [*first[1:], own[-1]]))) and own[-1] < 0xC0 and kind(own[-1]) == (kind(own[j]) + 1) % 4:
                return True
        return False

    out, own, raw = [], b"", text.encode()
    for k, c in enumerate(raw):
        own += bytes([c])
        following = raw[k + 1 : k + 2]
        if c == 10:
            if following != b"\n":
                out.append(own)
                own = b""
        elif len(own) >= 64 or len(own) >= 7 and not (following and more(following[0])) and follows(own):
            out.append(own)
            own = b""
    return [x.decode("latin-1") for x in out + [own] * bool(own)]


def in_bytes(text):
    return text.encode().decode("latin-1")


def merkle(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    short = lambda found, n: "".join(x[:n] for x in found)

    def groups(digests, last):
        ends = [k + 1 for k, d in enumerate(digests) if k == len(digests) - 1 or d[0] == "0" or last(k)]
        return ends, [sha("".join(digests[a:b])) for a, b in zip([0, *ends], ends, strict=False)]

    pieces = re.findall(fingerprint.PIECES, in_bytes(text))
    if not pieces:
        return sha("") + ":::::"
    digests = [f"{xxhash.xxh64_intdigest(x.encode(), 42):016X}" for x in pieces]
    ends, paragraphs = groups(digests, lambda k: pieces[k].endswith("\n"))
    closed, sections = groups(paragraphs, lambda k: pieces[ends[k] - 1].endswith("\n\n"))
    return ":".join([sha("".join(sections) + sha(text)), short(sections, 8), ",".join(map(str, closed)), short(paragraphs, 8), ",".join(map(str, ends)), short(digests, digits(len(pieces)))])


def digits(n):
    return max(5, math.ceil(math.log2(max(n, 1)) / 4) + 2)


def test_pieces(texts):
    r = random.Random(1)
    strange = ["".join(r.choice("abcdxyz \n.e中文字ㄱéñ🎉กขค") for _ in range(r.randint(0, 300))) for _ in range(300)]
    for t in strange + [t or "" for t in texts]:
        found = re.findall(fingerprint.PIECES, in_bytes(t))
        assert "".join(found) == in_bytes(t) and all(len(x.rstrip("\n")) <= 64 for x in found)
    assert sum(re.findall(fingerprint.PIECES, in_bytes(t)) == pieces_of(t) for t in strange) > 295  # but where a line ends right behind 64 bytes


def test_fingerprints(spark, texts):
    ids = [3 * i - 40 for i in range(len(texts))]
    docs = make(spark, texts, ids=ids)
    rows = {r["doc_id"]: r for r in fingerprint.compare_edits(docs).collect()}
    for k, i in enumerate(ids):
        x, nx = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        q = len(x) // 4
        edited = x[: len(x) - q] + nx[:q]
        r = rows[i]
        assert r["n_chars"] == len(x) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == merkle(x) and r["edited_fingerprint"] == merkle(edited)
        for column, other in (("near_edited", edited), ("near_next", nx)):
            x_found, y_found = (re.findall(fingerprint.PIECES, in_bytes(t)) for t in (x, other))
            n = min(digits(len(x_found)), digits(len(y_found)))
            a, b = ({f"{xxhash.xxh64_intdigest(p.encode(), 42):016X}"[:n] for p in found} for found in (x_found, y_found))
            assert abs(r[column] - (1 if x == other else 2 * len(a & b) / (len(a) + len(b)) if a or b else 0)) < 1e-12
    assert fingerprint.compare_edits(empty(spark)).count() == 0
    one = fingerprint.compare_edits(make(spark, ["only one."])).first()
    assert one["near_next"] == 1.0
    plan = fingerprint.compare_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_likeness_of_near_texts(spark):
    """13 characters more at the end, or one more in front, at any length and for texts without blanks or points."""
    r = random.Random(12)
    long = prose(r, 4000)
    solid = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(14000))
    chinese = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(14000))
    rows = [(long[:n], long[: n + 13]) for n in (200, 400, 503, 511, 513, 700, 1500, 9000)] + [(x, "Z" + x) for x in (solid, chinese, long[:14000].replace(" ", ""), long[:14000])]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [x[0] for x in df.select(fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b")))).collect()]
    assert min(got) >= 0.8 and min(got[-4:]) > 0.97
    kept = fingerprint.compare_edits(make(spark, [long[:520], "short one", long[:641], long[2000:2700]])).orderBy("doc_id").collect()
    assert kept[0]["near_edited"] > 0.7 and kept[2]["near_edited"] > 0.6


def test_one_character_more_in_any_script(spark):
    """Behind the first of 6,000 characters: likeness stays above 0.97, whatever the letters are."""
    r = random.Random(21)
    span = lambda a, b: [chr(c) for c in range(a, b)]
    scripts = [span(0xE01, 0xE2F), span(0x3B1, 0x3CA), span(0x628, 0x64B), span(0x904, 0x93A), span(0x430, 0x450), span(0x4E00, 0x9FA0), span(0xAC00, 0xD7A0), span(0x1F600, 0x1F640), "ACGT", "acgt", "0123456789abcdf", "bcdfghjklmnpqrstvwxyz", "01", "ab"]
    texts = ["".join(r.choice(s) for _ in range(6000)) for s in scripts]
    df = spark.createDataFrame([(t, t[0] + s[1] + t[1:]) for t, s in zip(texts, scripts)], "a string, b string")
    got = [x[0] for x in df.select(fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b")))).collect()]
    assert min(got) > 0.97, got


def test_unrelated_long_texts_are_unlike(spark):
    """Two texts of 3 million characters each, and one of them against a short one."""
    df = spark.range(2).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(93_750)), lambda k: F.md5(F.concat_ws("/", "id", k)))).alias("t")).select("id", fingerprint.fingerprint(F.col("t")).alias("f"))
    both = df.where("id = 0").select(F.col("f").alias("a")).crossJoin(df.where("id = 1").select(F.col("f").alias("b")))
    short = fingerprint.fingerprint(F.lit("another text of no great length, of a few pieces only"))
    got = both.select(fingerprint.likeness(F.col("a"), F.col("b")), fingerprint.likeness(F.col("a"), short), fingerprint.likeness(F.col("a"), F.col("a"))).first()
    assert got[0] < 0.01 and got[1] < 0.001 and got[2] == 1.0


def test_differing_branches(spark):
    r = random.Random(3)
    lines = [prose(r, r.randint(8, 30), 5000) + "." for _ in range(120)]
    paragraphs = ["\n".join(lines[k : k + 3]) + "\n" for k in range(0, 120, 3)]
    text = "\n".join(paragraphs)
    gone = "\n".join(paragraphs[:20] + paragraphs[21:])
    swapped = "\n".join(paragraphs[20:] + paragraphs[:20])
    changed = text.replace(lines[50], lines[50].replace(" ", " ... ", 1))
    rows = [(text, gone), (gone, text), (text, swapped), (text, changed), (text, text), (text, ""), ("", text), (text, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprint.fingerprint(F.col("a")).alias("a"), F.when(F.col("b").isNotNull(), fingerprint.fingerprint(F.col("b"))).alias("b"))
    got = [x[0] for x in df.select(fingerprint.differing(F.col("a"), F.col("b"))).collect()]
    pieces = re.findall(fingerprint.PIECES, in_bytes(text))
    said = "".join(pieces[k] for k in got[0]["pieces_gone"])
    assert len(said) > 0.9 * len(paragraphs[20]) and not got[0]["pieces_new"]  # a deleted paragraph is found on the side that has it
    assert got[1]["pieces_new"] == got[0]["pieces_gone"] and not got[1]["pieces_gone"]
    assert got[2]["sections_moved"] and len(got[2]["pieces_new"]) < 40
    new = re.findall(fingerprint.PIECES, in_bytes(changed))
    assert 0 < len(got[3]["pieces_new"]) <= 4 and all(x in lines[50].replace(" ", " ... ", 1) + "\n" for x in (new[k].rstrip("\n") for k in got[3]["pieces_new"]))
    assert not any(got[4]) and len(got[5]["pieces_gone"]) == len(pieces) and len(got[6]["pieces_new"]) == len(pieces) and got[7] is None
    assert [x[0] for x in df.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()][4:] == [1.0, 0.0, 0.0, 0.0]


# 5 ------------------------------------------------------------------------------------------------


def test_quality_counts():
    assert quality.repeated([]) == 0 and quality.repeated(b"a b c a b c".split()) == 6 and quality.repeated(b"a b c d a b c".split()) == 6 and quality.repeated(b"a a a a".split()) == 4


def test_quality_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {r["doc_id"]: r.asDict() for r in queries.op5_quality_rules(spark, SF).collect()}
    want = db.sql(quality.ORACLE).to_arrow_table().to_pylist()
    assert len(got) == len(want) and all(got[w["doc_id"]] == w for w in want)


def test_quality_lines(spark):
    r = random.Random(1)
    common = "All rights  reserved 2024 by the site and its owners forever"
    hosts, every = [], []
    for k in range(12):
        every.append(prose(r, 80) + "\n" + common.replace("2024", str(2000 + k)).upper())  # loses a tenth
        every.append("\n".join([common] * 8 + [prose(r, 10)]) if k else "\n".join([common] * 8) + "\n" + prose(r, 60))  # mostly boilerplate
        hosts += ["a", "a"]
    every += [None, "", prose(r, 60), prose(r, 60)]
    hosts += [None, "a", "b", "b"]
    rows = quality.judge(make(spark, every, hosts=hosts)).collect()
    by = {x["doc_id"]: x for x in rows}
    assert len(rows) == len(every)
    assert all(by[2 * k]["kept"] for k in range(12)) and by[26]["kept"] and not by[24]["kept"] and not by[25]["kept"]
    assert by[0]["removed_words"] == 0 and by[2]["removed_words"] == 11  # the first document keeps the line
    left = [prose(r, n) + "\n" + common for n in (49, 50, 80)]
    few = {x["doc_id"]: x["kept"] for x in quality.judge(make(spark, [every[2 * k] for k in range(12)] + left, hosts=["a"] * 15)).collect()}
    assert (few[12], few[13], few[14]) == (False, True, True)  # 49 words of its own are too few, whatever stood beside them
    clean = quality.keep(make(spark, every, hosts=hosts))
    assert clean.columns == SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    assert quality.judge(empty(spark)).count() == 0


def test_quality_lines_of_the_real_table(spark):
    """At the production limits lines go from the real documents, in the operator and in its SQL."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lost = docs.select("doc_id", "text").join(quality.clean(docs).select("doc_id", F.col("text").alias("cut")), "doc_id").where("text <> cut").count()
    removed = {x["doc_id"]: x["removed_words"] for x in quality.judge(docs).where("removed_words > 0").collect()}
    assert lost > 500 and len(removed) > 500
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.1/documents.parquet'")
    want = {r[0] for r in db.execute(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE NOT kept AND NOT base_failed").fetchall()}
    depleted = {x["doc_id"] for x in quality.judge(docs).where("NOT kept AND NOT base_failed").collect()}
    assert depleted == want and len(depleted) >= 10, "some documents are rejected for what is left of them alone"
    assert not depleted & {x["doc_id"] for x in quality.clean(docs).where(F.col("doc_id").isin(list(depleted))).select("doc_id").collect()}
    hosts = Counter({("big", k): 1 for k in range(1000)})
    every = [f"{prose(random.Random(k), 60, 9999)}\nfooter of the site" if k < 15 or k >= 1000 else prose(random.Random(k), 60, 9999) for k in range(1015)]
    got = quality.judge(make(spark, every, hosts=["big"] * len(hosts) + ["tiny"] * 15)).where("removed_words > 0").collect()
    assert {x["doc_id"] for x in got} == set(range(1001, 1015))  # 15 of 1,000 documents are under two percent


def test_quality_removes_lines(spark):
    import corpus_pipeline as cp

    r = random.Random(3)
    every = [prose(r, 80) + "\n\nShare  this page 201" + str(k % 10) + "\n" + "".join(r.choice("abcdef ") for _ in range(40)) for k in range(104)] + [prose(r, 60) + "\nShare this page 2000", "Share this page 2000\nno", None]
    hosts = ["a"] * 104 + ["b", "a", "a"]
    want = {0: every[0], 104: every[104]} | {k: "\n".join(x for x in every[k].split("\n") if not x.startswith("Share")) for k in range(1, 104)}
    docs = make(spark, every, hosts=hosts)
    assert {x["doc_id"]: x["text"] for x in quality.clean(docs).collect()} == want
    got = cp.quality_rules(spark, docs, SF)
    assert got.columns == docs.columns and {x["doc_id"]: (x["text"], x["n_chars"]) for x in got.collect()} == {k: (t, len(t)) for k, t in want.items()}


# 6 ------------------------------------------------------------------------------------------------


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return sets, [find(i) for i in ids]


def test_shingles(texts):
    got = shingles.shingle_sets([t or "" for t in texts])
    sets, _ = brute_components(texts, list(range(len(texts))))
    assert [len(x) for x in got] == [len(s) for s in sets]
    for a in range(0, len(sets), 3):
        for b in range(0, len(sets), 5):
            assert len(np.intersect1d(got[a], got[b])) == len(sets[a] & sets[b])


def test_jaccard(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    r = random.Random(8)
    long = prose(r, 300)
    group = []
    for _ in range(30):  # near copies around the threshold
        v = long.split()
        for _ in range(r.randint(1, 9)):
            v[r.randrange(len(v))] = f"z{r.randint(0, 9999)}"
        group.append(" ".join(v))
    passage = prose(r, 60)
    shared = [passage + " " + prose(r, 200, 5000) for _ in range(10)]
    every = texts + group + shared
    ids = [5 * k for k in range(len(every))]
    sets, want = brute_components(every, ids)
    rows = {x["doc_id"]: x for x in jaccard.join(make(spark, every, ids=ids))[0].collect()}
    for k, i in enumerate(ids):
        assert (rows[i]["n_shingles"], rows[i]["component_id"]) == (len(sets[k]), want[k])
    _, links = jaccard.join(make(spark, every, ids=ids), every_link=True)
    got = {(min(a, b), max(a, b)) for a, b in ((x["a"], x["b"]) for x in links.collect())}
    first = {s: i for i, s in reversed(list(zip(ids, sets, strict=True)))}
    assert got == {(i, j) for s, i in first.items() for t, j in first.items() if i < j and s and t and 100 * len(s & t) >= 80 * len(s | t)}
    kept = jaccard.keep_one(make(spark, every, ids=ids))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({w for w in want}) and kept.columns[0] == "doc_id"
    assert jaccard.join(empty(spark))[0].count() == 0


def test_jaccard_rows_that_share_an_id(spark):
    """Each set of a doc_id links; a tile of many documents is dealt out by its own count, and no tile loses a pair."""
    r = random.Random(18)
    one, two = prose(r, 200), prose(r, 200)
    near = lambda t: t + " tail" + str(r.randint(0, 99))
    got, _ = jaccard.join(make(spark, [one, two, near(one), near(two), prose(r, 50)], ids=[7, 7, 9, 11, 3]))
    assert sorted((x["doc_id"], x["component_id"]) for x in got.collect()) == [(3, 3), (7, 7), (7, 7), (9, 7), (11, 7)]


def test_tiles_in_chunks():
    import pyarrow as pa

    r = np.random.default_rng(4)
    sizes = [1, 2, 9, 4, 5, 1, 30, 3]
    posting = np.concatenate([np.full(n, (k + 1 << 60) + 5, np.uint64) for k, n in enumerate(sizes)])
    doc = np.concatenate([r.permutation(n) for n in sizes]).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(posting[k : k + 7].view(np.int64)), pa.array(doc[k : k + 7])], ["posting", "doc_id"]) for k in range(0, len(posting), 7)]
    got = pa.Table.from_batches(list(jaccard.tile_collector(4, 11)(iter(batches)))).to_pylist()
    for k, n in enumerate(sizes):
        own = [x for x in got if x["shingle"] == (k + 1 << 60) >> 12]
        assert sorted(d for x in own for d in x["docs"]) == (list(range(n)) if n > 1 else [])
        assert sorted(x["chunk"] for x in own) == list(range(-(-n // 4) if n > 1 else 0)) and all((x["members"] is None) == (n > 4) for x in own)


def test_bounds_never_lose():
    r = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.9], r.integers(0, 2**63, r.integers(0, 40)).astype(np.uint64)])
        if len(b) and 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)):
            assert jaccard._may_link(len(a), jaccard._wide(a), len(b), jaccard._wide(b))


def test_largest(spark):
    r = random.Random(2)
    rows = [(k, 2 ** r.randint(0, 12)) for k in range(5000)]
    df = spark.createDataFrame(rows, "k long, n long")
    for limit in (100, 1000, 6000):
        got = common.largest(df, "n", "k", limit).collect()
        assert min(5000, limit) * 0.7 <= len(got) <= 1.3 * limit
        left = set(rows) - {(x["k"], x["n"]) for x in got}
        assert not left or max(n for _, n in left) <= min(x["n"] for x in got)
    assert common.largest(df.limit(0), "n", "k", 9).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r["doc"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8 ------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(r, t, n, letters):
    v = list(t)
    for _ in range(n):
        k = r.randint(0, len(v))
        op = r.randint(0, 2)
        if op == 0:
            v.insert(k, r.choice(letters))
        elif k < len(v):
            v[k : k + 1] = [] if op == 1 else [r.choice(letters)]
    return "".join(v)


def test_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        b = mutate(r, a, r.randint(0, 4), "abc")
        assert line_dedup.within(a, b) == (distance(a, b) <= line_dedup.EDITS)


def brute_lines(texts):
    first, near, order = {}, set(), []
    for d, t in enumerate(texts):
        for k, x in line_dedup._lines(t or ""):
            if x not in first:
                first[x] = (d, k)
                s = x.decode()
                if len(s) >= line_dedup.LEAST and any(abs(len(o) - len(s)) <= 2 and distance(o, s) <= 2 for o in order):
                    near.add(x)
                order.append(s)
    out = []
    for d, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        gone = {k for k, x in line_dedup._lines(t) if first[x] != (d, k) or x in near}
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    return out


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LOCAL", 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    r = random.Random(6)
    pool = ["".join(r.choice("abcdeé ") for _ in range(r.choice([r.randint(1, 70), r.randint(22, 27)]))) for _ in range(60)]
    every = [None, "", "\n\n"]
    for _ in range(50):
        every.append("\n".join(mutate(r, r.choice(pool), r.choice([0, 0, 1, 2, 3]), "abcdeé ") for _ in range(r.randint(1, 8))))
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup(make(spark, every)).collect()}
    assert [got[k] for k in range(len(every))] == brute_lines(every)
    again = line_dedup.dedup(line_dedup.dedup(make(spark, ["Same long line of words here\nB", "same  LONG LINE of words here", "Same long line of wordz here", "Same long line of words here 77"])))
    assert [x["text"] for x in again.orderBy("doc_id").collect()] == ["Same long line of words here\nB", "", "", "Same long line of words here 77"]
    assert line_dedup.dedup(empty(spark)).count() == 0
    # borders: characters are counted, not bytes; an earlier line may be shorter than `least`
    base = "éà" * 11
    got = line_dedup.dedup(make(spark, ["中文字\nok\n" + base, "中文字\nok\nnot", base + "xy", base + "x"]), shortest=3, least=24)
    assert [x["text"] for x in got.orderBy("doc_id").collect()] == ["中文字\nok\n" + base, "ok\nnot", "", base + "x"]


def test_meetings_in_chunks():
    import pyarrow as pa

    r = np.random.default_rng(4)
    sizes = [1, 2, 9, 4, 5, 1, 30, 3]
    key, line = np.repeat(np.arange(8) - 4, sizes), np.arange(sum(sizes))
    own = np.concatenate([[1, *([0] * (n - 1))] if n != 3 else [0] * 3 for n in sizes]).astype(np.int32)
    order = np.lexsort((r.random(len(key)), key))
    columns = [key[order], own[order], line[order]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 7]) for c in columns], ["key", "own", "line"]) for k in range(0, len(key), 7)]
    got = pa.Table.from_batches(list(line_dedup.meeting_collector(4, 11)(iter(batches)))).to_pylist()
    assert sorted((x["key"], x["line"], x["own"]) for x in got) == [(k, n, o) for k, n, o in zip(key.tolist(), line.tolist(), own.tolist(), strict=True) if sizes[k + 4] not in (1, 3)]
    for k, n in enumerate(sizes):
        found = Counter(x["chunk"] for x in got if x["key"] == k - 4)
        assert n in (1, 3) or sorted(found) == list(range(-(-n // 4))) and max(found.values()) <= 4


def test_small_by_bytes(spark):
    df = spark.createDataFrame([(k, [k] * 10, "x" * 20) for k in range(100)], "a long, b array<long>, c string")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().toString()
    assert hinted(common.small(df, 20_000)) and not hinted(common.small(df, 10_000)) and hinted(common.small(df.limit(0), 0))


# 9 ------------------------------------------------------------------------------------------------


def test_lm(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 60)
    monkeypatch.setattr(lm, "FEWEST", 16)
    rows = {r["doc_id"]: r for r in lm.score(make(spark, texts)).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*words(t), ""])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w, r = [*words(t), ""], rows[i]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in c for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert lm.score(empty(spark)).count() == 0


def test_lm_probabilities_sum_to_one_and_learn():
    share = np.array([5, 4, 3, 2, 1], float)
    model = lm.Model(share / share.sum())
    n = len(share)
    for w1 in range(n + 1):
        p = np.exp(model.log_probability(np.full(n, w1), np.full(n, (w1 + 1) % (n + 1)), np.arange(n)))
        assert abs(p.sum() - 1) < 1e-4
    rng = np.random.default_rng(0)
    seq = np.tile([0, 1, 2, 3, 4], 4000)
    w1, w2 = lm.contexts(seq, np.array([len(seq)]), n)
    grown = {k: np.zeros_like(x) for k, x in model.w.items()}
    before = model.log_probability(w1[5:100], w2[5:100], seq[5:100]).mean()
    order = rng.permutation(len(seq))
    for _ in range(6):
        model.train(w1[order], w2[order], seq[order], rng, grown)
    model.held = None
    assert model.log_probability(w1[5:100], w2[5:100], seq[5:100]).mean() > before + 0.5
    a, b = lm.contexts(np.array([1, 2, 3, 9, 4]), np.array([3, 1, 1]), 99)
    assert a.tolist() == [99, 1, 2, 99, 99] and b.tolist() == [99, 99, 1, 99, 99]
    packed = lm.Model(share / share.sum()).unpack(model.pack())
    assert all((packed.w[k] == model.w[k]).all() for k in model.w)


def test_lm_step_is_that_of_every_example_alone():
    """One batch: weights after a step whose gradients are summed by distinct class are those of sums over all examples."""
    n, rng = 7, np.random.default_rng(4)
    share = np.arange(1, n + 1) / 28
    w1, w2, t = rng.integers(0, n + 1, 500), rng.integers(0, n + 1, 500), rng.integers(0, n, 500)
    own, order, first = lm.groups(w1)
    assert own.dtype == np.uint16 and lm.groups(w1 + 70_000)[0].tolist() == [x + 70_000 for x in own.tolist()]
    assert (lm.placed(own, order, first) == w1).all()
    model = lm.Model(share)
    old = {k: x.astype("f8") for k, x in model.w.items()}
    model.train(w1, w2, t, np.random.default_rng(9), {k: np.zeros_like(x) for k, x in model.w.items()})
    noise = np.minimum(np.searchsorted(np.cumsum(share), np.random.default_rng(9).random(lm.NOISE) * share.sum()), n - 1)
    g = {k: np.zeros_like(x) for k, x in old.items()}
    for a, b, c in zip(w1, w2, t, strict=True):
        v = old["r"][a] @ old["C1"] + old["r"][b] @ old["C2"]
        dv = np.zeros(lm.DIM)
        for k, real in [(c, True), *((k, False) for k in noise)]:
            x = v @ old["q"][k] + old["b"][k] - np.log(lm.NOISE * share[k])
            up = (1 / (1 + np.exp(x)) if real else -1 / (1 + np.exp(-x))) / len(t)
            dv += up * old["q"][k]
            g["q"][k] += up * v
            g["b"][k] += up
        for name, at in (("C1", a), ("C2", b)):
            g["r"][at] += old[name] @ dv
            g[name] += np.outer(old["r"][at], dv)
    for k in old:
        assert np.allclose(model.w[k], old[k] + lm.RATE * g[k] / np.sqrt(g[k] ** 2 + 1e-6), atol=2e-4), k


def test_lm_classes():
    assert [lm.class_count(n) for n in (0, 10**4, 10**6, 5 * 10**6, 10**8, 10**12)] == [256, 256, 256, 512, 2048, 1 << 18]  # no limit
    index = lm.ClassOf([b"the", b""], [b"ing", b"g", b"le"])
    assert [index[w] for w in (b"the", b"", b"sing", b"ing", b"dog", b"able", b"g", b"zz")] == [1, 2, 3, 3, 4, 5, 4, 0]


def test_lm_score_against_plain_softmax(spark, texts, monkeypatch):
    """score from the weights of a fixed model, by loops: the class's softmax probability times the word's share of its class."""
    monkeypatch.setattr(lm, "FEWEST", 16)
    monkeypatch.setattr(lm, "HEAD", 40)
    made = []

    def fixed(folded, names, endings, share):
        model = lm.Model(share)
        rng = np.random.default_rng(3)
        model.w["r"] = rng.normal(0, 1, model.w["r"].shape).astype("f4")
        model.w["q"] = rng.normal(0, 1, model.w["q"].shape).astype("f4")
        made.append((names, endings, model.w))
        return model

    monkeypatch.setattr(lm, "train", fixed)
    ids = [i if i % 9 else None for i in range(len(texts))]
    rows = [r["score"] for r in lm.score(make(spark, texts, ids=ids).coalesce(1)).collect()]
    names, endings, w = made[0]
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2 for i in ids]
    c = Counter(x.encode() for t, h in zip(texts, held, strict=True) if not h for x in [*words(t), ""])
    ranked = sorted(c, key=lambda x: (-c[x], x))
    assert names == ranked[:8] and len(endings) == 7

    def class_of(x):
        if x in names:
            return 1 + names.index(x)
        return next((9 + endings.index(x[-k:]) for k in (3, 2, 1) if len(x) >= k and x[-k:] in endings), 0)

    mass = Counter({k: 1 for k in range(16)})
    for x, n in c.items():
        mass[class_of(x)] += n + 1
    want = []
    for t in texts:
        total, before = 0.0, [16, 16]
        for x in [*(y.encode() for y in words(t)), b""]:
            k = class_of(x)
            v = w["r"][before[-1]] @ w["C1"] + w["r"][before[-2]] @ w["C2"]
            s = w["q"] @ v + w["b"]
            p = math.exp(s[k]) / sum(math.exp(y) for y in s)
            total += math.log10(p) + (0 if 1 <= k <= 8 else math.log10((c[x] + 1) / mass[k]))
            before.append(k)
        want.append(total)
    assert sorted(rows) == pytest.approx(sorted(want), rel=1e-4)


def test_lm_beats_counts_on_held_out_text(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2


# 10 -----------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "<html><head><title>A &amp; B</title><script>no</script></head><body><p>One <b>two</b></p><!-- c --><a href='/q?a=1&amp;b'>link</a><br>é</body></html>", "e"), (2, None, None, "e"), (3, "http://a/\r\nInjected: x", "", "e"), (1, "http://a/x", "plain < text", "e")], "page_id long, url string, html string, record string")
    sources = warc.responses(pages)
    done = warc.derivatives(sources).collect()
    assert len(done) == 4
    for s, d in zip(sources.collect(), done, strict=True):
        headers, block = warc.parse(bytes(s["record"]))
        of = dict(headers)
        assert "Injected" not in of and int(of["Content-Length"]) == len(block) and of["WARC-Block-Digest"] == warc.digest(block)
        body = block.partition(b"\r\n\r\n")[2]
        for kind in ("metadata", "conversion"):
            own, content = warc.parse(bytes(d[kind]))
            own = dict(own)
            assert own["WARC-Type"] == kind and own["WARC-Refers-To"] == of["WARC-Record-ID"] == d["response_id"] and own["WARC-Record-ID"] == d[f"{kind}_id"]
            assert own["WARC-Block-Digest"] == warc.digest(content) == d[f"{kind}_digest"] and len(content) == d[f"{kind}_length"] and own["WARC-Target-URI"] == of["WARC-Target-URI"]
            assert own["WARC-Source-Payload-Digest"] == warc.digest(body) == d["source_digest"]
        about = json.loads(warc.parse(bytes(d["metadata"]))[1])
        assert about["envelope"]["warc"] == [list(h) for h in headers] and about["envelope"]["http"][0] == ["Content-Type", "text/html; charset=utf-8"] and d["digest_matches"]
    assert warc.parse(bytes(done[0]["conversion"]))[1].decode() == "A & B\nOne two\nlink\né" and done[0]["title"] == "A & B" and done[0]["n_links"] == 1
    assert json.loads(warc.parse(bytes(done[0]["metadata"]))[1])["links"] == ["/q?a=1&b"]
    files = warc.write(warc.derivatives(sources), "conversion", str(tmp_path / "w")).collect()
    data = b"".join(gzip.open(f["file"]).read() for f in files if f["records"])
    assert sum(f["records"] for f in files) == 4 and data.count(b"WARC/1.1\r\n") == 4
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    columns = [c.split()[0] for c in warc.READ.split(", ")]
    got = sorted((tuple(x[c] for c in columns) for x in warc.write_and_read(pages).collect()), key=str)
    assert got == sorted((tuple(x[c] for c in columns) for x in done), key=str) and all(x["digest_matches"] for x in done)
    assert warc.write_and_read(pages.limit(0)).count() == 0
    whole = b"".join(gzip.open(f).read() for f in (tmp_path / "g").glob("*.gz")) if warc.write_files(warc.derivatives(sources), str(tmp_path / "g")) is None else b""
    assert whole.count(b"WARC/1.1\r\n") >= 8 and whole.endswith(b"\r\n\r\n")


def test_warc_files_are_read_by_length(spark, tmp_path):
    """Contents with blank lines and WARC headers in them, cut anywhere, come back whole; a changed content is told."""
    pairs = []
    for k, text in enumerate(["a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "", "\r\n", "\r\n\r\n", "x" * 100_000, "é\r\n"]):
        d = warc.derive(warc.response(str(k), f"http://h/{k}", "<p>x</p>", "2020-01-01T00:00:00Z"), k)
        content = text.encode()
        base = [("WARC-Type", "conversion"), ("WARC-Record-ID", d["conversion_id"]), ("WARC-Refers-To", d["response_id"]), ("WARC-Source-Payload-Digest", d["source_digest"]), ("WARC-Block-Digest", warc.digest(content if k else b"other"))]
        pairs.append((bytearray(d["metadata"]), bytearray(warc.record(base, content))))
    warc.write_files(spark.createDataFrame(pairs, "metadata binary, conversion binary").coalesce(1), str(tmp_path / "files"))
    got = {x["page_id"]: x for x in warc.read_files(spark, str(tmp_path / "files")).collect()}
    assert [got[k]["conversion_length"] for k in range(6)] == [len(b"a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), 0, 2, 4, 100_000, 4]
    assert [got[k]["digest_matches"] for k in range(6)] == [False] + [True] * 5


def slow_plain(html):
    """Texts and links by Python's own parser of HTML."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.links, self.skip = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "template", "noscript")
            if tag in warc._BLOCKS and not self.skip:
                self.parts.append("\n")
            if tag == "a" and not self.skip:
                self.links += [v or "" for k, v in attrs if k == "href"]

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "template", "noscript")
            if tag in warc._BLOCKS and not self.skip:
                self.parts.append("\n")

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data.replace("\n", " "))

    p = P()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return [w for x in lines for w in x.split()], p.links


def test_plain_text_against_another_parser(spark):
    for row in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect():
        text, _, links = warc.plain(row["html"] or "")
        assert (text.split(), links) == slow_plain(row["html"] or "")


def test_plain_text_is_linear():
    import time

    for piece in ("<!--", "<script>", '<a "', "<a ", "<title>", "<a '\"", "<![CDATA[", "</x ", "<a " + "b" * 40, "&#" + "9" * 60, "<a href='", "<style", "<a '>\"", '<p "<i \'', "</script   ", "<"):
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        warc.plain(page)
        warc.plain(page + ">")
        assert time.process_time() - began < 10, piece
    assert warc.plain("<a title='x > y' href=\"/1\">one</a> 1 < 2 <b class='<'>b</b> <a 'open") == ("one 1 < 2 b <a 'open", "", ["/1"])


# pipeline -----------------------------------------------------------------------------------------


def test_sharding_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, queries.op1_sharding(spark, SF).collect()))
    assert got == sorted(db.sql(queries.sharding_sql()).fetchall())


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = docs.columns
    held = docs
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    held = cp.STAGES[0][1](spark, held, SF)
    assert held.columns == names and {r["doc_id"] for r in held.collect()} == kept
    order = sorted(kept)
    cleaned = dict(zip(order, brute_lines([table[i] for i in order]), strict=True))
    cleaned = {i: t for i, t in cleaned.items() if t == table[i] or words(t)}
    held = cp.STAGES[1][1](spark, held, SF)
    assert held.columns == names and held.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in held.collect()} == {i: (t, len(t)) for i, t in cleaned.items()}
    ids = sorted(cleaned)
    _, want = brute_components([cleaned[i] for i in ids], ids)
    held = cp.STAGES[2][1](spark, held, SF)
    assert held.columns == names and {r["doc_id"] for r in held.collect()} == set(want)
    rows = cp.STAGES[3][1](spark, held, SF).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    per = defaultdict(int)
    for r in rows:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 4096 and len(per) <= math.ceil(sum(per.values()) / 4096) + 1
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in cp.run(spark, SF).collect()} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows}


def test_signatures_never_lose():
    r = np.random.default_rng(5)
    sets = []
    for size in (3, 200, 900, 1000, 1100, 1990, 2100, 2300, 4000, 4200, 4700):
        base = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        sets += [base, np.unique(np.r_[base[r.random(len(base)) < 0.93], r.integers(0, 2**63, size // 30).astype(np.uint64)])]
    held = jaccard.Signatures(np.array([len(x) for x in sets]), [jaccard.signature(x) for x in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    may = held.may_link(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    for (i, j), m in zip(pairs, may, strict=True):
        if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j])):
            assert m
    assert may.sum() < 40
    assert held.middle(np.arange(len(sets))) in range(len(sets))

"""Ranked search against scoring every document, and what MaxScore leaves out."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from mapperlake.llm import queries, search

DOCS = "doc_id long, text string, shard long, term string, rank int, score long, ids int"
ITEMS = "item_id long, text string, term string, df long, pass int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    """Every document's score for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in of.items():
        rows = []
        for d, c, m in held:
            k = 100 - 90 + (90 * m * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * k)) for t in ts if t in c)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, k, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:10], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, slices=3):
    d = spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in docs], DOCS).repartition(slices)
    q = spark.createDataFrame([(i, t, "y", 5, 6) for i, t in items], ITEMS)
    got = search.rank(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["score"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(500)] + ["Ünï", "中文", "é\x85x", "Ü"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 30, 200])))) for k in range(400)]
    docs += [(None, "w400 w401 w402"), (None, docs[3][1]), (1000, docs[3][1]), (1001, docs[3][1]), (3, docs[3][1]), (1002, None), (1003, ""), (1004, "--- ,,"), (1005, "W400,w400;W401|w402"), (1006, "w1 " * 60_000), (1007, "İx ﬁ w403_w403")]
    docs += [(2000 + k, "same text w450") for k in range(40)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 4, 40])))) for k in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere atall"), (103, "w450"), (None, "w450 w1"), (104, "w400"), (104, "w401 W401"), (105, docs[3][1]), (106, "W403 İx"), (107, " ".join(vocabulary))]
    return docs, items


def test_is_brute_force(spark, corpus):
    assert run(spark, *corpus) == brute(*corpus)


def test_small_shards_and_passes(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 60)
    docs, items = corpus
    assert run(spark, docs, items, slices=17) == brute(docs, items)


def test_shards_within_a_task(corpus):
    """Many shards one after another, with one bar: the same best, and most postings of frequent terms are never scored."""
    docs, items = corpus
    n, total = len([1 for _, t in docs if terms(t)]), sum(len(terms(t)) for _, t in docs)
    df = Counter(t for _, x in docs for t in set(search.terms_of(x or "")))
    import pyarrow as pa

    want = brute(docs, items)
    for size in (1, 7, 100, 10_000):
        shards = []
        for a in range(0, len(docs), size):
            vocabulary, flat, rows = {}, [], []
            for i, t in docs[a : a + size]:
                own = search.terms_of(t or "")
                flat.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in own], np.int64))
                rows.append((i, len(own)))
            table = pa.Table.from_batches(list(search.shard_rows(a, rows, vocabulary, flat))).to_pylist()
            shard = search.Shard(pa.array(table[0]["ids"], pa.int64()), np.frombuffer(table[0]["counts"], "<u4"), n, total)
            assert [x["term"] for x in table[1:]] == sorted(x["term"] for x in table[1:])
            for x in table[1:]:
                shard.put(x["term"], x["docs"], x["counts"], np.array(x["best_count"]), np.array(x["best_length"]))
                own, counts, top = shard.lists[x["term"]]
                assert top == shard.impact(own, counts).max(), "the frontier has the exact bound"
            shards.append(shard)
        for i in (0, 1, 2, 107):
            text = next(t for k, t in items if k == i)
            best, seen = search.Best(), []
            for shard in shards:
                shard.search({t: search.weight(n, df[t]) for t in set(search.terms_of(text)) if t in df}, best, seen)
            assert [(-s, None if null else d) for s, null, d in best.rows] == [(x[3], x[2]) for x in sorted((x for x in want if x[0] == i), key=lambda x: x[1])]
        ts, best, seen = [b"w0", b"w1", b"w2", b"w3", b"same", b"text", b"w450"], search.Best(), []
        for shard in reversed(shards):  # the documents with "same" first, so that there is a bar
            shard.search({t: search.weight(n, df[t]) for t in ts}, best, seen)
        assert size < 100 or sum(seen) < sum(df[t] for t in ts) / 3, (size, sum(seen))


def test_a_task_cuts_shards(spark, corpus, monkeypatch):
    """One task, several shards: the index has all postings, once each."""
    monkeypatch.setattr(search, "SHARD", 500)
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in docs], DOCS).coalesce(1)
    index = search.build(d)
    assert index.where("term IS NULL").count() > 5
    got = {bytes(r[0]): (r[1], r[2]) for r in index.where("term IS NOT NULL").groupBy("term").agg({"n_docs": "sum", "n_terms": "sum"}).select("term", "sum(n_docs)", "sum(n_terms)").collect()}
    held = [terms(t) for _, t in docs]
    assert got == {t.encode(): (df, tf) for t, tf in Counter(x for ts in held for x in ts).items() for df in [sum(t in set(ts) for ts in held)]}
    q = spark.createDataFrame([(i, t, "y", 5, 6) for i, t in items], ITEMS)
    assert sorted(map(tuple, search.search(index, q).collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert run(spark, [], items[:3]) == [] and run(spark, docs[:3], []) == [] and run(spark, [(1, None)], items[:3]) == []


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op11_lexical_search"]).to_arrow_table().to_pylist()
    got = [x.asDict() for x in queries.op11_lexical_search(spark, sf).collect()]
    assert len(got) > 300 and sorted(map(repr, got)) == sorted(map(repr, want))

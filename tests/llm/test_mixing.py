"""The mix against its SQL, against plain arithmetic, and over many seeds."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from mapperlake.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size long, rank int, cut int, step int, p int, row int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 1, 2, 3, 4, 5) for i, t, s in rows], SCHEMA)


def leveled(limits, measures, due):
    """Shares min(limit, level x measure) with the sum due, by bisection."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(a, mid * m) for a, m in zip(limits, measures)) < due else (low, mid)
    return [min(a, high * m) for a, m in zip(limits, measures)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    out = [(k, " ".join(["w"] * r.choice([0, 1, 3, 8, 40, 300])), f"s{min(r.randint(0, 14), 5)}") for k in range(600)]
    return out + [(None, "a b c", None), (None, "a b c", None), (7, None, "s1"), (8, "x y", "empty?"), (9, "", "none"), (10, "\x85 \x1c", "é"), (11, "same", "z"), (11, "same", "z"), (12, "w " * 40_000, "long"), (13, "a\tb\vc\x0cd\re\nf", "long")]


def test_targets_and_words(spark, rows):
    got = mixing.mix(make(spark, rows), [5, 2, 1]).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = [[5, 2, 1][k % 3] for k in range(len(names))]
    want = dict(zip(names, leveled([2 * sizes[s] for s in names], weights, 1.5 * sum(sizes.values()))))
    taken, cut = Counter(), Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]], abs=1e-6)
        assert 0 <= x["taken"] <= 2 * x["size"] and x["copies"] * x["size"] <= x["taken"]
        taken[x["source"]] += x["taken"]
        cut[x["source"]] += x["taken"] - x["copies"] * x["size"] not in (0, x["size"])
    for s in names:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6 and cut[s] <= 1


def test_expected_copies_are_a_level_of_the_measure(spark, rows):
    got = mixing.mix(make(spark, rows), [5, 2, 1]).collect()
    for s in {x["source"] for x in got}:
        own = [x for x in got if x["source"] == s and x["size"]]
        if own:
            m = [2 ** (int(math.log2(x["size"] ** 0.5) * 4 + 1e-9) / 4) for x in own]
            want = leveled([2 * x["size"] for x in own], [a * x["size"] for a, x in zip(m, own)], own[0]["target"])
            assert [x["expected"] * x["size"] for x in own] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_reruns_and_partitions_agree(spark, rows):
    a, b = (sorted(map(repr, mixing.mix(make(spark, rows).repartition(n), [5, 2, 1]).collect())) for n in (3, 11))
    assert a == b


def test_documents_are_taken_as_often_as_expected(spark):
    """Of 14,000 documents of seven sizes those of one size and source are taken as often as expected, on the mean."""
    docs = spark.range(14_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pow(F.lit(2), F.col("id") % 7) * 4).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"))
    got = mixing.mix(docs, [3, 1], share=0.8).groupBy("source", "size", "expected").agg(F.avg(F.col("taken") / F.col("size")).alias("mean"), F.count("*").alias("n")).collect()
    assert len(got) == 14 and len({round(x["expected"], 3) for x in got}) >= 12
    for x in got:
        assert x["mean"] == pytest.approx(x["expected"], abs=4 * 0.5 / x["n"] ** 0.5)


def test_bins_of_the_cut_are_resolved(spark, monkeypatch):
    """With one row to a bin all histogram levels run; equal rows tie to the last bit."""
    docs = [(k, f"t{k % 50} b c", f"s{k % 2}") for k in range(400)] + [(5, "eq ua l", "s0")] * 30
    want = sorted(map(repr, mixing.mix(make(spark, docs), [2, 1]).collect()))
    monkeypatch.setattr(mixing, "BIN", 1)
    assert sorted(map(repr, mixing.mix(make(spark, docs), [2, 1]).collect())) == want


def test_many_sources_hold_without_one_task(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("h"), (F.col("id") % 1700).cast("string")).alias("source"))
    by = {x["source"]: x for x in mixing.mix(docs, [5, 2, 1]).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert len(by) == 1700 and all(abs(x["taken"] - x["target"]) <= 0.5 for x in by.values())


def test_empty_and_wrong(spark):
    assert mixing.mix(make(spark, []), [5, 2, 1]).collect() == []
    assert [x["taken"] for x in mixing.mix(make(spark, [(1, None, "a")]), [5, 2, 1]).collect()] == [0]
    with pytest.raises(ValueError):
        mixing.mix(make(spark, []), [0])


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op13_mixing"]).to_arrow_table().to_pylist()
    got = [x.asDict() for x in queries.op13_mixing(spark, sf).collect()]
    assert sorted((x["doc_id"], x["size"], x["source_size"], x["target"], x["copies"], x["taken"]) for x in got) == sorted((x["doc_id"], x["size"], x["source_size"], x["target"], x["copies"], x["taken"]) for x in want)

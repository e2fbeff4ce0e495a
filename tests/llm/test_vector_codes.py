"""Codes and codebooks against a full search in plain Python."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from mapperlake.llm import queries, vector_codes
from mapperlake.llm.vector_codes import Codebook

SCHEMA = "vec_id long, embedding array<float>, label int, q int, code int, error string, label_error string"


def make(spark, rows, slices=3):
    return spark.createDataFrame([(i, v, k, 1, 2, "e", "f") for i, v, k in rows], SCHEMA).repartition(slices)


def brute(rows):
    """By the definition, one vector, entry and component at a time."""
    held = [(i, np.array([int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]), k) for i, v, k in rows if v and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    held.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1].tolist()))
    w = len(held[0][1]) // 4
    books = [[v[p * w : (p + 1) * w].tolist() for _, v, _ in held[:256]] for p in range(4)]

    def near(part, book):
        return min((sum((int(a) - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            groups = {}
            for _, v, _ in held:
                groups.setdefault(near(v[p * w : (p + 1) * w], books[p])[1], []).append(v[p * w : (p + 1) * w])
            books[p] = [[int(sum(int(x[d]) for x in groups[k])) // len(groups[k]) for d in range(w)] if k in groups else e for k, e in enumerate(books[p])]
    found = [(i, [near(v[p * w : (p + 1) * w], books[p]) for p in range(4)], k) for i, v, k in held]
    errors = {}
    for _, f, k in found:
        errors[k] = errors.get(k, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[k], sha) for i, f, k in found), key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(k, [r.choice([r.gauss(0, 0.3), 0.0, -0.25]) for _ in range(8)], r.choice([0, 0, 0, 1, 2, None])) for k in range(700)]
    r.shuffle(out)
    same = [0.5] * 8
    return out + [(5000 + k, same, 3) for k in range(60)] + [(None, same, None), (7, same, 1), (7, same, 1), (8000, None, 0), (8001, [], 0), (8002, [0.1] * 7 + [None], 0), (8003, [0.1] * 7 + [float("nan")], 0), (8004, [float("inf")] + [0.1] * 7, None), (8005, [-0.0001] * 8, 9), (8006, [1000.5] * 8, 9)]


def test_is_brute_force(spark, rows):
    got = vector_codes.compress(make(spark, rows))
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_few_vectors_and_none(spark, rows):
    few = [x for x in rows if x[0] is not None and x[0] < 5]
    assert sorted(map(tuple, vector_codes.compress(make(spark, few, 7)).collect()), key=repr) == brute(few)
    assert vector_codes.compress(make(spark, [])).collect() == [] and vector_codes.compress(make(spark, [(1, None, 2), (2, [float("nan")] * 8, 2)])).collect() == []


def test_other_lengths_go_and_odd_ones_are_refused(spark, rows):
    got = vector_codes.compress(make(spark, [*rows, (9000, [0.1] * 12, 0)])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    with pytest.raises(ValueError):
        vector_codes.compress(make(spark, [(1, [0.1] * 6, 0)]))


@pytest.mark.parametrize("width,n,spread", [(1, 5, 9), (3, 256, 4), (16, 256, 1000), (16, 256, 2), (40, 100, 50)])
def test_partial_distances_are_a_full_search(width, n, spread):
    """Also with many ties (a small spread), and equal entries."""
    r = np.random.default_rng(width + n)
    e = r.integers(-spread, spread + 1, (4, n, width)) * r.integers(1, 9, width)
    e[:, n // 2] = e[:, 0]
    book = Codebook(e)
    x = r.integers(-spread, spread + 1, (5000, width))
    x[:50] = e[2][r.integers(0, n, 50)]
    found, distance = book.nearest(2, x)
    full = ((x[:, None, :] - e[2][None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (found == full.argmin(axis=1)).all()
    assert book.measured < book.full or width < 4


def test_dimensions_go_by_variance_and_save_work(spark):
    """On the given vectors about half of the components are measured."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    x = np.floor(np.array([r[0] for r in rows], np.float64) * 1024).astype(np.int64)
    book = Codebook(x[:256].reshape(256, 4, 16).transpose(1, 0, 2))
    for p in range(4):
        assert (np.diff(book.entries[p].var(axis=0)[book.order[p]]) <= 1e-9).all()
        book.nearest(p, x[:, 16 * p : 16 * p + 16])
    assert book.measured < 0.55 * book.full


def test_decoding_is_within_the_error(spark, rows):
    kept = vector_codes.kept(make(spark, rows))
    book = vector_codes.train(kept)
    got = vector_codes.decode(vector_codes.encode(kept.select("vec_id", "embedding", "label", "q"), book), book).collect()
    for x in got:
        q = [int(np.floor(np.float64(v) * 1024)) for v in x["embedding"]]
        assert sum((a - round(b * 1024)) ** 2 for a, b in zip(q, x["approximate"])) == x["error"]


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op12_vector_codes"]).to_arrow_table().to_pylist()
    got = [x.asDict() for x in queries.op12_vector_codes(spark, sf).collect()]
    assert len(got) == 500 and sorted(map(repr, got)) == sorted(map(repr, want))

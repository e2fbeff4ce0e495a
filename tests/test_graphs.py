"""Components, reach, the maintained closure and the text index against plain versions."""

import glob
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mapperlake.operators import components, textindex
from mapperlake.operators.components import Reach, strong_components
from mapperlake.operators.textindex import TextIndex
from mapperlake.streaming.maintained import MaintainedClosure


def closure_of(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[n] = seen
    return reach


def components_of(edges):
    r = closure_of(edges)
    return {a: min([a, *(b for b in r[a] if a in r[b])]) for a in r}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string").repartition(3)


def name(k):
    return f"n{k:04d}"


def graphs():
    r = random.Random(5)
    yield "sparse", [(name(r.randint(0, 60)), name(r.randint(0, 60))) for _ in range(70)]
    yield "dense", [(name(r.randint(0, 25)), name(r.randint(0, 25))) for _ in range(120)]
    ring = [(name(k), name((k + 1) % 40)) for k in range(40)]
    yield "ring with a tail, a loop and a two-ring", [*ring, ("t1", name(0)), (name(3), "t2"), ("t2", "t3"), ("l", "l"), ("x", "y"), ("y", "x")]
    yield "ears", [*ring, *[(f"e{k}", f"e{k + 1}") for k in range(18)], (name(5), "e0"), ("e18", name(20)), *[(f"f{k}", f"f{k + 1}") for k in range(18)], (name(6), "f0"), ("f18", "g")]
    hub = [("hub", f"a{k}") for k in range(30)] + [(f"a{k}", f"b{k}") for k in range(30)] + [(f"b{k}", "hub") for k in range(29)]
    yield "hub", hub
    yield "chain", [(name(k), name(k + 1)) for k in range(50)]


@pytest.mark.parametrize("kind,edges", list(graphs()), ids=[k for k, _ in graphs()])
def test_components(spark, kind, edges, monkeypatch):
    if kind in ("ears", "dense"):  # chains of any length are followed; the others as shipped
        monkeypatch.setattr(components, "SHORT", 0)
    got = {r["node"]: r["component"] for r in strong_components(frame(spark, [*edges, edges[0], (None, "z"), ("z", None)])).collect()}
    assert got == components_of(edges)


def test_a_ring_of_100000_nodes_takes_rounds_of_the_logarithm(spark, monkeypatch):
    rounds = []
    real = components.cut
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(1) or real(df))
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") * 1 + 1) % n).alias("dst"))
    got = strong_components(edges)
    assert got.where("component = 0").count() == n and len(rounds) < 40


def test_no_edges(spark):
    none = frame(spark, [])
    assert strong_components(none).collect() == [] and Reach(none).counts().collect() == []


@pytest.mark.parametrize("kind,edges", [g for g in graphs() if g[0] in ("sparse", "hub")], ids=["sparse", "hub"])
def test_reach(spark, kind, edges):
    want, reach = closure_of(edges), Reach(frame(spark, edges))
    assert {r["node"]: r["n_reached"] for r in reach.counts().collect()} == {a: len(b) for a, b in want.items()}
    nodes = sorted(want)[::7]
    got = {}
    for r in reach.members(spark.createDataFrame([(n,) for n in nodes], "node string")).collect():
        got.setdefault(r["source"], set()).add(r["target"])
    assert got == {n: want[n] for n in nodes if want[n]}
    pairs = [(a, b) for a in nodes for b in sorted(want)[::5]] + [("nobody", nodes[0])]
    for r in reach.reaches(spark.createDataFrame(pairs, "a string, b string")).collect():
        assert r["reaches"] == (r["b"] in want.get(r["a"], ())), (r["a"], r["b"])


def test_reach_holds_components_times_buckets(spark):
    """A layered graph of 400 nodes has 60,000 pairs of nodes, and one row for each component in the bitmaps."""
    edges = [(f"{k:02d}-{i}", f"{k + 1:02d}-{j}") for k in range(9) for i in range(40) for j in range(40) if (i * 7 + j) % 8 < 3]
    reach = Reach(frame(spark, edges))
    assert reach.bits.count() <= 360 and reach.counts().agg(F.sum("n_reached")).first()[0] > 50_000


# the maintained closure ------------------------------------------------------------------------------


def changes(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, added boolean, at long")


def test_closure_follows_batches_and_restarts(spark, tmp_path):
    r, live, clock = random.Random(8), set(), 0
    path = f"file://{tmp_path}/state"
    for batch in range(5):
        rows = []
        for _ in range(14 if batch else 30):
            e = (name(r.randint(0, 14)), name(r.randint(0, 14))) if not live or r.random() < 0.6 else r.choice(sorted(live))
            add, clock = e not in live if r.random() < 0.9 else e in live, clock + 1
            rows.append((*e, add, clock))
            (live.add if add else live.discard)(e)
        r.shuffle(rows)
        kept = MaintainedClosure(spark, path)  # a new one each time: all it knows is in the folder
        assert kept.apply(changes(spark, rows), batch)
        assert not kept.apply(changes(spark, rows), batch)
        want = {(a, b) for a, bs in closure_of(sorted(live)).items() for b in bs}
        assert {tuple(x) for x in kept.pairs().collect()} == want and kept.pairs().count() == len(want)
        assert {tuple(x) for x in kept.edges().collect()} == live


def test_a_version_without_its_marker_is_made_again(spark, tmp_path):
    kept = MaintainedClosure(spark, f"file://{tmp_path}/state")
    kept.apply(changes(spark, [("a", "b", True, 1)]), 0)
    (tmp_path / "state/pairs-1").mkdir()
    (tmp_path / "state/pairs-1/part-0.parquet").write_bytes(b"torn")
    kept.apply(changes(spark, [("b", "c", True, 2), (None, "c", True, 3)]), 1)
    assert sorted(map(tuple, kept.pairs().collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    kept.apply(changes(spark, [("a", "b", False, 4), ("x", "y", False, 5)]), 2)
    assert sorted(map(tuple, kept.pairs().collect())) == [("b", "c")]


def test_closure_follows_a_stream(spark, tmp_path):
    """Files arrive, the stream is stopped and started again; each file is applied once."""
    rows = [[("a", "b", True, 1), ("b", "c", True, 2)], [("c", "a", True, 3), ("b", "c", False, 4)], [("b", "c", True, 5)]]
    kept = MaintainedClosure(spark, f"file://{tmp_path}/state")
    for k, part in enumerate(rows):
        changes(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("src string, dst string, added boolean, at long").parquet(f"{tmp_path}/in")
        query = kept.follow(stream, f"{tmp_path}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None
        got = sorted("".join(x) for x in kept.pairs().collect())
        assert got == [["ab", "ac", "bc"], ["ab", "ca", "cb"], ["aa", "ab", "ac", "ba", "bb", "bc", "ca", "cb", "cc"]][k]


# the text index ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma", "İx", "straße", "naïve", "x", "a.b", "%", "😀smile", "TB_ORDERS"]
    out = [(k, "\n".join(" ".join(r.choices(words, k=r.randint(0, 6))) for _ in range(r.choice([1, 5, 60])))) for k in range(120)]
    return out + [(500, None), (501, ""), (502, "\n\n"), (503, "needle in a\nhay NEEDLE stack"), (504, "ab"), (505, "end\n"), (506, "😀😀 ab")]


NEEDLES = ["needle", "NEEDLE in", "beta", "tb_orders", "ab", "a", "", "naïve x", "zzz", "alpha\nbeta", "😀", "😀😀", "😀smile", ". ", "gamma gamma gamma"]


def test_search_is_a_scan(spark, texts, monkeypatch):
    index = TextIndex.build(spark.createDataFrame(texts, "k long, t string").repartition(3), "k", "t")
    want = {(n, k, i, line) for k, t in texts if t is not None for i, line in enumerate(t.split("\n")) for n in NEEDLES if n.lower() in line.lower()}
    for near in (textindex.NEAR, 3):  # also by a join, where too many blocks are candidates
        monkeypatch.setattr(textindex, "NEAR", near)
        got = list(map(tuple, index.search(NEEDLES).collect()))
        assert len(got) == len(set(got)) and set(got) == want
    assert index.search([]).collect() == [] and index.search(["zzz"]).collect() == []


def test_an_empty_index(spark):
    index = TextIndex.build(spark.createDataFrame([], "k long, t string"), "k", "t")
    assert index.search(["abc", "a"]).collect() == []


def test_few_row_groups_are_read(spark, tmp_path):
    """Over all documents a search for a rare needle reads at most 5 percent of the rows of postings and of blocks."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    index = TextIndex.build(docs.select("doc_id", "text"), "doc_id", "text", f"file://{tmp_path}/index")
    needle = "permission is hereby granted"
    rare = docs.select(F.explode(F.split("text", r"[^\w]+")).alias("w")).where("length(w) >= 12").groupBy("w").count().where("count = 1").orderBy("w").first()[0]
    for n in (needle, rare):
        hits = index.search([n])
        assert hits.count() == docs.select(F.explode(F.split("text", "\n")).alias("t")).where(F.contains(F.lower("t"), F.lit(n.lower()))).count()
    def read(df):
        """Rows that the scan hands on after row groups and pages have been skipped."""
        rows = len(df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value(), rows

    chosen = index.chosen([rare])[rare]
    total = index.postings.count()
    got, kept = read(index.postings.where(F.col("piece").isin(chosen)))
    assert 4 <= kept <= got <= total / 20, (kept, got, total)
    block = index.candidates({rare: chosen}).first()["block"]
    got, kept = read(index.blocks.where((F.col("block") >= block) & (F.col("block") <= block)))
    assert kept == 1 and got <= index.blocks.count() / 20
    file = pq.ParquetFile(glob.glob(f"{tmp_path}/index/postings/*.parquet")[0]).metadata.row_group(0)
    assert file.column(0).has_column_index and "DELTA_BINARY_PACKED" in file.column(2).encodings


def test_search_time_is_in_the_published_range(spark):
    """Twenty needles in one search over 100,000 lines; the published mark is 30 ms a search."""
    lines = spark.range(100_000).select(F.floor(F.col("id") / 50).alias("k"), F.concat_ws(" ", F.lit("SELECT"), F.concat(F.lit("c"), (F.col("id") % 977).cast("string")), F.lit("FROM t"), F.md5(F.col("id").cast("string"))).alias("t"), "id")
    index = TextIndex.build(lines.groupBy("k").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("id", "t"))), lambda x: x["t"])).alias("t")), "k", "t")
    needles = [r[0] for r in spark.range(20).select(F.substring(F.md5((F.col("id") * 4999).cast("string")), 5, 12)).collect()]
    index.search(needles[:2]).collect()
    began = time.perf_counter()
    assert len(index.search(needles).collect()) == 20
    took = (time.perf_counter() - began) / 20
    print(took)
    assert took < 0.25


def test_a_task_lists_its_blocks_by_piece(monkeypatch):
    """Pairs of piece and block leave a task as one row for each piece and range, with NULs, astral signs and texts too short for a piece."""
    import pyarrow as pa

    texts = {0: "abcabc", 1: "", 2: "ab", 3: "a\0\0\0", 70_000: "abc", 70_001: "x\U0001f600\U0001f601y", 7: "abc\nü"}
    want: dict = {}
    for k, t in texts.items():
        for a in range(len(t) - 2):
            want.setdefault((t[a : a + 3], k >> textindex.RANGE_BITS), set()).add(k & (1 << textindex.RANGE_BITS) - 1)
    batches = [pa.RecordBatch.from_pydict({"block": list(texts)[a : a + 4], "text": list(texts.values())[a : a + 4]}) for a in (0, 4)]
    rows = [r for b in textindex.listed(batches) for r in b.to_pylist()]
    assert {(r["piece"], r["range"]): r["blocks"] for r in rows} == {k: sorted(v) for k, v in want.items()} and len(rows) == len(want)
    monkeypatch.setattr(textindex, "PAIRS", 3)
    parts: dict = {}
    for b in textindex.listed(batches):
        for r in b.to_pylist():
            parts.setdefault((r["piece"], r["range"]), []).extend(r["blocks"])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert list(textindex.listed([])) == []

"""Steps whose rows, ranges or tasks must follow their input."""

import random
import time

from pyspark.sql import functions as F

from mapperlake.operators import nesting, resolve, scan


def test_ranges_follow_what_is_written(spark, monkeypatch):
    """A join's estimate is the product of its sides; the ranges of nested events aren't dealt by it."""
    asked, ranges = [], scan.ranges
    monkeypatch.setattr(scan, "ranges", lambda df: asked.append(ranges(df)) or asked[-1])
    events = spark.range(200_000).select((F.col("id") % 5000).alias("g"), F.col("id").alias("k"), F.lit(0).alias("step"), F.repeat(F.lit("x"), 50).alias("tag"))
    assert nesting.enclosing(events, "g", "k", F.col("step"), F.col("tag")).count() == 200_000
    assert asked == [4, 4]  # the session's shuffle partitions


def joined_rows(df):
    """The most rows that a join of df's plan, which has run, put out."""
    most, work = 0, [df._jdf.queryExecution().executedPlan()]
    while work:
        plan = work.pop()
        name = plan.getClass().getSimpleName()
        if "Join" in name or "CartesianProduct" in name:
            most = max(most, plan.metrics().get("numOutputRows").get().value())
        if name == "AdaptiveSparkPlanExec":
            work.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            work.append(plan.plan())
        work += [plan.children().apply(k) for k in range(plan.children().size())]
    return most


def test_a_name_of_many_files_is_looked_up_without_pairs(spark):
    """References and symbols of one name in nested folders: the ladder of `lookup` against a loop over all pairs, in rows that follow their numbers."""
    r = random.Random(5)
    path = lambda k: "".join(f"{r.choice('abc')}/" for _ in range(r.choice([0, 1, 2, 3, 4]))) + f"f{k}.xml"
    held = [(f"n{k}.{i}", i, path(k), k, "same" if i == "twin" else f"c{k}") for k in range(400) for i in ("many", "twin")] + [("n9.one", "one", "a/x.xml", 0, "c"), ("n8.of", "of", "a/b/x.xml", 0, "c"), ("n7.of", "of", "a/c/x.xml", 0, "d")]
    symbols = spark.createDataFrame(held, "qid string, local_id string, source_file string, ord int, signature string").withColumn("kind", F.lit("SQL_FRAGMENT"))
    refs = [(f"k{k}", i, "z", path(k)) for k in range(400) for i in ("many", "twin", "one", "of", "none")]
    got = resolve.lookup(spark.createDataFrame(refs, "key string, refid string, namespace string, from_file string").withColumn("key", F.concat("key", "refid")), symbols, symbols, "SQL_FRAGMENT")

    def shared(a, b):
        a, b = a.split("/")[:-1], b.split("/")[:-1]
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {}
    for key, refid, _, file in refs:
        found = [h for h in held if h[1] == refid]
        near = sorted((shared(file, h[2]), h[0]) for h in found)
        if len(found) == 1 or len({h[4] for h in found}) == 1:
            target, how = min(h[0] for h in found), "GLOBAL_UNIQUE" if len(found) == 1 else "DUPLICATE_SAME"
        elif found and near[-1][0] > near[-2][0]:
            target, how = near[-1][1], "NEAREST_DUPLICATE"
        else:
            target = how = None
        want[key + refid] = target, how, len(found)
    assert {x["key"]: (x["target"], x["how"], x["candidates"]) for x in got.collect()} == want
    assert {how for _, how, _ in want.values()} == {"GLOBAL_UNIQUE", "DUPLICATE_SAME", "NEAREST_DUPLICATE", None}
    assert joined_rows(got) < 8000  # pairs of equal names would be 320,000


def test_files_made_of_a_small_table_are_many_tasks(spark):
    """A table of one split, of whose rows files are made, is dealt to tasks by its rows."""
    from mapperlake.plans import derived_catalogue

    assert derived_catalogue.files(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 4  # two of 500 suppliers each, for the files and for their copies


def test_bytes_are_put_together_without_a_sort():
    """Decoding: ids that are none are left out, and CPU time stays far below that of an ordered aggregation of (text, position, bytes) rows."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from mapperlake.llm import bpe

    b = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    told = {r: t for t, r in b.token_id.items()}
    lists = [[5, None, 7, -1, -2, 10**6, 5], [], None, [9]]
    assert b.decode(pa.array(lists, pa.list_(pa.int32()))) == [b"".join(told.get(i, b"") for i in x or []) for x in lists]
    ids = np.random.default_rng(1).integers(0, len(told), 500_000).astype(np.int32)
    many = pa.ListArray.from_arrays(pa.array(np.arange(0, 500_001, 2000, np.int32)), pa.array(ids))
    b.db.register("coded", pa.table({"doc": np.arange(len(many), dtype=np.int32), "ids": many}))
    b.db.execute("CREATE TABLE spelled AS SELECT unnest(ids) AS id, unnest(ids)::VARCHAR AS bytes FROM (SELECT range(60000)::INTEGER[] AS ids)")
    at = time.process_time()
    b.db.sql("SELECT doc, string_agg(bytes, '' ORDER BY pos) AS bytes FROM (SELECT r.doc, r.pos, v.bytes FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded) r JOIN spelled v ON v.id = r.id) GROUP BY doc").to_arrow_table()
    sorted_s, at = time.process_time() - at, time.process_time()
    got = b.decode(many)
    assert time.process_time() - at < sorted_s * 0.6
    assert got == [b"".join(told[i] for i in x) for x in ids.reshape(-1, 2000).tolist()]


def test_records_of_a_page_are_made_in_one_pass(spark, tmp_path):
    """What op10 writes is the text of the records that responses and derivatives make, by one Python step and without compressing the responses on the way."""
    from mapperlake.llm import warc

    rows = [(1, "http://a/\r\nx", "<title>T &amp; t</title><p>é\n<a href='/l'>l</a><script>var a = '</p>';</script>"), (2, None, None), (3, "u", "a\r\n\r\nb<!-- c --><br/>\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = warc.page_texts(pages)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    want = [bytes(d[kind]).removesuffix(b"\r\n\r\n").decode() for d in warc.derivatives(warc.responses(pages)).orderBy("page_id").collect() for kind in ("metadata", "conversion")]
    assert sorted(x["value"] for x in told.collect()) == sorted(want)
    warc.write_texts(told, f"{tmp_path}/warc")
    assert warc.read_files(spark, f"{tmp_path}/warc").where("digest_matches").count() == 3


def test_a_maintained_closure_broadcasts_nothing(spark, monkeypatch, tmp_path):
    """A batch joins many times; what Spark would broadcast each time goes through the driver, and comes to more the more pairs there are."""
    from mapperlake.streaming import maintained

    plans, cut = [], maintained.cut
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(maintained, "cut", lambda df: plans.append(told(df)) or cut(df))
    rows = [("a", "b", True, 1), ("b", "c", True, 1), ("c", "d", True, 1)]
    changes = lambda rows: spark.createDataFrame(rows, "src string, dst string, added boolean, at int")
    kept = maintained.MaintainedClosure(spark, f"{tmp_path}/closure")
    assert kept.apply(changes(rows), 0) and kept.apply(changes([("b", "c", False, 2), ("d", "e", True, 2)]), 1)
    assert {(x["source"], x["target"]) for x in kept.pairs().collect()} == {("a", "b"), ("c", "d"), ("c", "e"), ("d", "e")}
    assert "Broadcast" in told(kept.edges().join(kept.pairs(), F.col("dst") == F.col("source")))  # Spark would
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_symbols_of_files_made_of_a_small_table_are_no_broadcast(spark):
    """What Spark derives from a small table is planned by its true size: a join with it isn't one that goes through the driver because the table is small."""
    from mapperlake.plans import derived_catalogue

    p = derived_catalogue.project(spark, "/root/testdata/sf0.01")
    p.close()
    held, before = p.registered.select("qid"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 2000)
    try:
        assert all(size(x) > 10 * 1355 for x in (held, p.mappers, p.owners, p.symbols, p._sites))
        joined = p._sites.join(held, F.col("refid") == F.col("qid"), "left")
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        assert held.count() == 1355
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

"""The query catalogue: statements of the repository's own mappers, run on tables, and kernels on large tables.

Each entry has a query of (spark, sf_dir) and, where SQL can say it, independent SQL for the same result.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.operators import kernels
from mapperlake.operators.runtime import render
from mapperlake.plans.engine import Project, run_sql
from mapperlake.sources import projects

CORPUS = Path(__file__).parent / "corpus"
#: The star schema's tables and the further ones that statements read.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

_projects: dict[str, Project] = {}
_statements: dict[str, dict[str, dict]] = {}
_sessions: dict[tuple[str, str], SparkSession] = {}


def corpus() -> dict[str, str]:
    return {p.name: p.read_text() for p in sorted(CORPUS.glob("*.xml"))}


def project(spark: SparkSession) -> Project:
    """The analysed corpus, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _projects:
        _projects.clear()
        _projects[app] = Project.upload(spark, corpus())
    return _projects[app]


def statement(spark: SparkSession, qid: str) -> dict:
    """A corpus statement's resolved tree; the corpus has a fixed number of statements, read once."""
    import json

    app = spark.sparkContext.applicationId
    if app not in _statements:
        _statements.clear()
        rows = project(spark).rendered.select("statement", "tree", "dialect").collect()
        _statements[app] = {r["statement"]: {"tree": json.loads(r["tree"]), "dialect": r["dialect"]} for r in rows}
    return _statements[app][qid]


def session(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session of its own, with the tables of a folder as views."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sessions:
        s = spark.newSession()
        s.conf.set("spark.sql.session.timeZone", "UTC")
        s.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        for t in TABLES:
            s.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        s.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0").createOrReplaceTempView("orders_archive")
        s.sql("SELECT c_nationkey AS nationkey FROM customer").createOrReplaceTempView("customer_view")
        s.sql("SELECT s_nationkey AS nationkey FROM supplier").createOrReplaceTempView("supplier_view")
        _sessions[key] = s
    return _sessions[key]


def run(spark: SparkSession, sf_dir: str, qid: str, params: Any = None) -> DataFrame:
    """Render a corpus statement with parameters and run it on a folder's tables."""
    s = statement(spark, qid)
    return run_sql(session(spark, sf_dir), *render(s["tree"], params, s["dialect"]))


#: name: (statement, parameters, independent SQL)
RENDERED: dict[str, tuple[str, Any, str]] = {
    "x_dynamic_where_iterate": ("orders.segmentTotals", {"floor": 150000.0, "statuses": ["F", "O"], "segment": "ANY"}, "SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 150000 AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2"),
    "x_dynamic_where_empty": ("orders.segmentTotals", {"statuses": [], "segment": "BUILDING"}, "SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2"),
    "x_include_chain": ("orders.lineAmounts", {"from": datetime.datetime(1996, 1, 1), "flag": "R"}, "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag = 'R'"),
    "x_choose_trim": ("reports.orders", {"floor": 200000.0, "statuses": ["F", "P"]}, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'P')"),
    "x_choose_otherwise": ("reports.orders", {}, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    "x_foreach_bind": ("reports.partsLike", {"word": "red", "sizes": [1, 5, 9, 14, 23, 36, 45]}, "SELECT p_partkey, p_size FROM part WHERE contains(p_name, 'red') AND p_size IN (1, 5, 9, 14, 23, 36, 45)"),
    "x_join_inner": ("orders.supplierNations", {"balance": 1000}, "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 1000"),
    "x_join_left": ("orders.customerOrderCounts", {"floor": 250000.0}, "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS n_orders FROM customer"),
    "x_join_right": ("orders.regionNations", {"limit": 4}, "SELECT r_name, n_name FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 4) ON n_regionkey = r_regionkey"),
    "x_join_full": ("orders.balancesByNation", {"low": -500.0, "high": 9000.0}, "SELECT nationkey, NULLIF(SUM(c), 0)::BIGINT AS n_customers, NULLIF(SUM(s), 0)::BIGINT AS n_suppliers FROM (SELECT c_nationkey AS nationkey, 1 AS c, 0 AS s FROM customer WHERE c_acctbal < -500 UNION ALL SELECT s_nationkey, 0, 1 FROM supplier WHERE s_acctbal > 9000) GROUP BY nationkey"),
    "x_join_cross": ("orders.regionPairs", None, "SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey"),
    "x_join_comma": ("orders.bigOrders", {"floor": 300000.0}, "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000"),
    "x_join_oracle_plus": ("orders.customersWithOldJoin", {"balance": 5000.0}, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000"),
    "x_join_self": ("orders.nationNeighbours", None, "SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "x_join_theta": ("orders.partsNearSuppliers", {"parts": 300, "suppliers": 60}, "SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_size < s_nationkey AND p_retailprice > s_acctbal AND p_partkey <= 300 AND s_suppkey <= 60"),
    "x_semi_in": ("orders.customersIn", {"floor": 300000.0}, "SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "x_semi_exists": ("orders.customersExisting", {"priority": "1-URGENT"}, "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'"),
    "x_anti_not_exists": ("orders.customersWithoutBigOrders", {"floor": 300000.0}, "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000"),
    "x_scalar_subquery": ("orders.customerMaxima", None, "SELECT c_custkey, MAX(o_totalprice) AS max_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "x_derived_nested": ("orders.nestedTotals", None, "SELECT segment, ROUND(AVG(total), 2) AS mean_total FROM (SELECT c_mktsegment AS segment, o_custkey, SUM(o_totalprice) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY segment"),
    "x_table_suffix": ("orders.ordersOf", {"archive": "Y", "floor": 250000.0}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice > 250000"),
    "x_table_no_suffix": ("orders.ordersOf", {"archive": "N", "floor": 250000.0}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000"),
    "x_table_alternatives": ("orders.partiesOf", {"kind": "S"}, "SELECT s_nationkey AS nationkey, COUNT(*) AS n FROM supplier GROUP BY 1"),
    "x_raw_order": ("orders.sortedBy", {"column": "p_size"}, "SELECT p_partkey, p_name FROM part"),
    "x_cte_chained": ("reports.segmentChain", {"floor": 250000.0}, "SELECT c_mktsegment, COUNT(*)::BIGINT AS n_big FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000 GROUP BY 1"),
    "x_union_all": ("reports.allParties", {"floor": 9000.0}, "SELECT c_nationkey AS nationkey, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 9000"),
    "x_union": ("reports.partyNations", {"floor": 9000.0}, "SELECT DISTINCT k AS nationkey FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)"),
    "x_intersect": ("reports.commonNations", {"floor": 9000.0}, "SELECT DISTINCT c_nationkey AS nationkey FROM customer SEMI JOIN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) s ON c_nationkey = s_nationkey WHERE c_acctbal > 9000"),
    "x_except": ("reports.customerOnlyNations", {"floor": 9000.0}, "SELECT DISTINCT c_nationkey AS nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)"),
    "x_group_having": ("reports.heavyOrders", {"quantity": 200.0}, "SELECT * FROM (SELECT l_orderkey, SUM(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey) WHERE quantity > 200"),
    "x_count_distinct": ("reports.flagCounts", None, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n_lines, COUNT(DISTINCT l_partkey) AS n_parts, COUNT(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1, 2"),
    "x_rank": ("reports.rankedOrders", None, "SELECT o_custkey, o_orderkey, (RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS place FROM orders"),
    "x_row_number": ("reports.latestOrders", {"most": 2}, "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2"),
    "x_order_limit": ("reports.cheapParts", {"n": 25}, "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 25"),
    "x_limit_offset": ("reports.partPage", {"skip": 40, "n": 20}, "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40"),
    "x_expressions": ("reports.expressions", {"high": 200000.0, "low": 100000.0, "from": 1, "to": 2000}, "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, concat(upper(o_orderstatus), '-', trim(o_orderpriority)) AS label, year(o_orderdate)::INTEGER AS order_year, trunc(o_totalprice)::BIGINT AS whole FROM orders WHERE o_orderkey BETWEEN 1 AND 2000"),
    "x_revenue_by_nation": ("reports.revenueByNation", {"flag": "R"}, "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND l_returnflag = 'R' GROUP BY n_name"),
    "x_event_types": ("reports.usersByPurpose", {"types": ["click", "view", "purchase"]}, "SELECT event_type, COUNT(*) AS n_events, COUNT(DISTINCT user_id) AS n_users FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# kernels on large tables ---------------------------------------------------------------------------


def k_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("k"), "doc_id", "lang", "source")
    return kernels.first_wins(docs, ["k"], ["doc_id"])


def k_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.conflicts(_table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("k")), ["k"])


def k_copy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages of one host the one whose path looks least like a build's copy, then the shortest, then the least."""
    path = F.regexp_replace("url", r"^[a-z]+://[^/]+/?", "")
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), path.alias("source_file"), F.lit(None).cast("string").alias("reason"))
    return projects.drop_copies(pages, "host").where("copy_of IS NULL").select("page_id", "host", "source_file")


def k_shared_prefix_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page the page of its site with most leading path parts in common, where one is nearer than all others."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_replace("url", r"^[a-z]+://", ""), "/").alias("p"))
    return kernels.nearest_by_prefix(pages, "page_id", "p")


def k_classify_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's first element, behind what may stand before it, and its kind, by the project scan's own reader."""
    from mapperlake.sources import markup

    def run(batches):
        for pdf in batches:
            names = [(markup.root_name(h or "") or "").lower() for h in pdf["html"]]
            yield pdf[["page_id"]].assign(root=names, kind=[projects.classify(h or "") for h in pdf["html"]])

    return _table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, root string, kind string")


def k_search_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a word, with the last line at or before them that starts a section (an upper-case T)."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    owned = kernels.search_owner(lines, "doc_id", "line", F.when(F.startswith("t", F.lit("T")), F.col("line")))
    return owned.where(F.contains("t", F.lit("License"))).select("doc_id", "line", "owner")


def k_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nations reach over customers and suppliers: an edge from a nation to each whose key is one or seven further, where both have parties."""
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n")).distinct()
    src = supplier.select(F.col("n").alias("src"))
    edges = src.select("src", F.explode(F.array(F.col("src") + 1, F.col("src") * 2)).alias("dst")).join(supplier.select(F.col("n").alias("dst")), "dst", "left_semi").where("src <> dst")
    return kernels.closure(edges.select("src", "dst"), supplier.select(F.col("n").alias("node"))).select("source", "target", "depth")


def k_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by their lower-case spelling, first three hints."""
    part = _table(spark, sf_dir, "part")
    refs = part.select(F.lower("p_brand").alias("ref")).distinct()
    return kernels.near_misses(refs, part.select(F.col("p_brand").alias("name")).distinct()).select("ref", F.concat_ws(",", "hints").alias("hints"))


KERNELS: dict[str, tuple[Callable, str]] = {
    "k_first_wins": (k_first_wins, "SELECT k, doc_id, lang, source FROM (SELECT sha256(text) AS k, doc_id, lang, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1"),
    "k_conflicts": (k_conflicts, "SELECT sha256(text) AS k, COUNT(*) AS n FROM documents GROUP BY text HAVING COUNT(*) > 1"),
    "k_copy_choice": (
        k_copy_choice,
        r"""SELECT page_id, host, source_file FROM (
          SELECT *, row_number() OVER (PARTITION BY host ORDER BY
            CASE WHEN regexp_matches(source_file, '^(target|build|dist|out|bin|classes)([/\\]|$)') THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(source_file, '(^|[/\\])(target|build|out|bin)[/\\](classes|resources|production|test-classes|generated)([/\\]|$)') THEN 3 ELSE 0 END
            + CASE WHEN regexp_matches(source_file, 'WEB-INF[/\\]classes') THEN 1 ELSE 0 END, length(source_file), source_file) AS n
          FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/]+/?', '') AS source_file FROM pages)) WHERE n = 1""",
    ),
    "k_shared_prefix_nearest": (
        k_shared_prefix_nearest,
        r"""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages),
        s AS (SELECT a.page_id AS ref, b.page_id AS cand, len(list_filter(range(1, least(len(a.p), len(b.p)) + 1), lambda k: a.p[1:k] = b.p[1:k]))::INTEGER AS shared FROM p a JOIN p b ON a.p[1] = b.p[1] AND a.page_id <> b.page_id)
        SELECT ref, cand, shared FROM (SELECT *, rank() OVER (PARTITION BY ref ORDER BY shared DESC) AS r, count(*) OVER (PARTITION BY ref, shared) AS c FROM s) WHERE r = 1 AND c = 1""",
    ),
    "k_classify_root": (k_classify_root, r"""SELECT page_id, root, CASE WHEN root = '' THEN 'UNREADABLE' ELSE 'OTHER' END AS kind FROM (SELECT page_id, lower(regexp_extract(html, '(?is)^(?:\s|<\?.*?\?>|<!--.*?-->|<!doctype[^>]*>)*<([a-z][-\w:.]*)', 1)) AS root FROM pages)"""),
    "k_search_owner": (
        k_search_owner,
        """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS t, unnest(range(0, len(ls)))::INTEGER AS line FROM d)
        SELECT h.doc_id, h.line, (SELECT max(o.line) FROM l o WHERE o.doc_id = h.doc_id AND o.line <= h.line AND o.t LIKE 'T%') AS owner FROM l h WHERE h.t LIKE '%License%'""",
    ),
    "k_closure": (
        k_closure,
        """WITH RECURSIVE n AS (SELECT DISTINCT s_nationkey AS n FROM supplier), e AS (SELECT a.n AS src, b.n AS dst FROM n a JOIN n b ON b.n IN (a.n + 1, a.n * 2) AND a.n <> b.n),
        c(source, target, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT source, dst, depth + 1 FROM c JOIN e ON target = src WHERE depth <= (SELECT count(*) FROM n))
        SELECT source, target, min(depth)::INTEGER AS depth FROM c GROUP BY source, target""",
    ),
    "k_near_miss": (k_near_miss, "SELECT lower(p_brand) AS ref, string_agg(DISTINCT p_brand, ',') AS hints FROM part WHERE p_brand <> lower(p_brand) GROUP BY 1"),
}


def rendered_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    qid, params, _ = RENDERED[name]
    return lambda spark, sf_dir: run(spark, sf_dir, qid, params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from mapperlake.plans import batch_catalogue, cases_catalogue, derived_catalogue, facts_catalogue, graph_catalogue

    return {k: rendered_query(k) for k in RENDERED} | {k: f for k, (f, _) in (KERNELS | graph_catalogue.QUERIES | batch_catalogue.QUERIES | derived_catalogue.QUERIES).items()} | {k: f for k, (f, _) in facts_catalogue.FACTS.items()} | cases_catalogue.queries()


def oracle_sql() -> dict[str, str]:
    from mapperlake.plans import batch_catalogue, cases_catalogue, derived_catalogue, facts_catalogue, graph_catalogue

    return {k: s for k, (_, _, s) in RENDERED.items()} | {k: s for k, (_, s) in (KERNELS | graph_catalogue.QUERIES | batch_catalogue.QUERIES | derived_catalogue.QUERIES).items()} | {k: s for k, (_, s) in facts_catalogue.FACTS.items() if s} | cases_catalogue.oracle_sql()

"""Queries of statements that are rendered and run for a parameter row of every nation or customer; each with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.plans import catalogue
from mapperlake.plans.batch import Batch
from mapperlake.plans.engine import Project

#: A statement with a key, so that its rows meet parameter rows by a hash join.
BY_KEY = """<sqlMap namespace="batch"><select id="ordersOfCustomer">SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_custkey = #custkey#
<isGreaterThan prepend="AND" property="balance" compareValue="5000">o.o_totalprice &gt;= #floor#</isGreaterThan>
<isEqual prepend="AND" property="segment" compareValue="BUILDING">o.o_orderstatus IN <iterate property="statuses" open="(" close=")" conjunction=",">#statuses[]#</iterate></isEqual></select></sqlMap>"""

_trees: dict[str, list] = {}


def by_key_tree(spark: SparkSession) -> list:
    app = spark.sparkContext.applicationId
    if app not in _trees:
        _trees.clear()
        _trees[app] = Project.upload(spark, {"batch.xml": BY_KEY}).statement("batch.ordersOfCustomer")["tree"]
    return _trees[app]


def nation_parameters(s: SparkSession) -> DataFrame:
    """A parameter row for each nation: without a floor for every fifth, with none to two statuses, with any segment for every third."""
    k = F.col("n_nationkey")
    statuses = F.when(k % 4 == 1, F.array(F.lit("F"))).when(k % 4 == 2, F.array(F.lit("F"), F.lit("O"))).when(k % 4 == 3, F.array(F.lit("P"))).otherwise(F.array().cast("array<string>"))
    return s.table("nation").select(k.alias("nation"), F.when(k % 5 != 0, 100000.0 + 5000 * k).alias("floor"), statuses.alias("statuses"), F.when(k % 3 == 0, "ANY").when(k % 3 == 1, "BUILDING").otherwise("MACHINERY").alias("segment"))


def customer_parameters(s: SparkSession) -> DataFrame:
    statuses = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("F"), F.lit("P"))).otherwise(F.array(F.lit("O")))
    return s.table("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") * 20).alias("floor"), F.col("c_mktsegment").alias("segment"), statuses.alias("statuses"))


def x_batch_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segmentTotals for a parameter row of every nation."""
    tree = catalogue.statement(spark, "orders.segmentTotals")["tree"]
    return Batch(tree, nation_parameters(catalogue.session(spark, sf_dir))).run(["nation"])


def x_batch_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of every customer that the customer's own parameters ask for."""
    return Batch(by_key_tree(spark), customer_parameters(catalogue.session(spark, sf_dir))).run(["custkey"])


def x_batch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and arguments of every customer's statement."""
    batch = Batch(by_key_tree(spark), customer_parameters(catalogue.session(spark, sf_dir)))
    return batch.rendered().select("custkey", F.regexp_replace("sql", r"\s+", " ").alias("text"), F.concat_ws("|", F.col("args")[0], F.slice("args", F.when(F.col("balance") > 5000, 3).otherwise(2), 9)).alias("given"))


QUERIES: dict[str, tuple[Callable, str]] = {
    "x_batch_render": (
        x_batch_render,
        """WITH p AS (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 5 <> 0 THEN 100000.0 + 5000 * n_nationkey END AS floor,
          CASE n_nationkey % 4 WHEN 1 THEN ['F'] WHEN 2 THEN ['F', 'O'] WHEN 3 THEN ['P'] ELSE [] END AS statuses,
          CASE n_nationkey % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS segment FROM nation)
        SELECT nation, c_mktsegment, o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM p, orders JOIN customer ON o_custkey = c_custkey
        WHERE (floor IS NULL OR o_totalprice >= floor) AND (len(statuses) = 0 OR list_contains(statuses, o_orderstatus)) AND segment IN ('ANY', c_mktsegment) GROUP BY ALL""",
    ),
    "x_batch_by_key": (
        x_batch_by_key,
        """SELECT c_custkey AS custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey
        WHERE (c_acctbal <= 5000 OR o_totalprice >= c_acctbal * 20) AND (c_mktsegment <> 'BUILDING' OR o_orderstatus IN (SELECT unnest(CASE WHEN c_custkey % 2 = 0 THEN ['F', 'P'] ELSE ['O'] END)))""",
    ),
    "x_batch_texts": (
        x_batch_texts,
        """SELECT c_custkey AS custkey, 'SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_custkey = ?' || CASE WHEN c_acctbal > 5000 THEN ' AND o.o_totalprice >= ?' ELSE '' END
          || CASE WHEN c_mktsegment <> 'BUILDING' THEN '' WHEN c_custkey % 2 = 0 THEN ' AND o.o_orderstatus IN (? , ?)' ELSE ' AND o.o_orderstatus IN (?)' END AS text,
          c_custkey::VARCHAR || CASE WHEN c_mktsegment <> 'BUILDING' THEN '' WHEN c_custkey % 2 = 0 THEN '|F|P' ELSE '|O' END AS given FROM customer""",
    ),
}

"""Lineage from the analysed plan: what it names, and that nothing else matters."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapperlake.operators.planlineage import PlanLineage, lineage
from mapperlake.operators.runtime import render
from mapperlake.plans import catalogue
from mapperlake.plans.engine import run_sql

SF = "/root/testdata/sf0.001"


def values(rows):
    return {(r["output"], f"{r['table']}.{r['column']}") for r in rows if r["kind"] == "VALUE"}


def test_names_stars_and_hops(spark):
    s = catalogue.session(spark, SF)
    rows = lineage(s.sql("WITH c AS (SELECT * FROM orders), d AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM c GROUP BY 1) SELECT n.*, t, (SELECT max(c_acctbal) FROM customer WHERE c_custkey = k) AS m FROM d JOIN nation n ON k = n_nationkey WHERE t > 5"))
    assert values(rows) == {("n_nationkey", "nation.n_nationkey"), ("n_name", "nation.n_name"), ("n_regionkey", "nation.n_regionkey"), ("t", "orders.o_totalprice"), ("m", "customer.c_acctbal"), ("m", "customer.c_custkey"), ("m", "orders.o_custkey")}
    assert {(r["table"], r["column"]) for r in rows if r["kind"] == "ROWS" and r["output"] == "n_name"} == {("orders", "o_custkey"), ("orders", "o_totalprice"), ("nation", "n_nationkey")}


def test_unions_windows_and_lists(spark):
    s = catalogue.session(spark, SF)
    rows = lineage(s.sql("SELECT c_name AS who, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS place, x FROM customer LATERAL VIEW explode(split(c_mktsegment, 'I')) v AS x UNION ALL SELECT s_name, s_suppkey, 'x' FROM supplier"))
    assert values(rows) == {("who", "customer.c_name"), ("who", "supplier.s_name"), ("place", "customer.c_nationkey"), ("place", "customer.c_acctbal"), ("place", "supplier.s_suppkey"), ("x", "customer.c_mktsegment")}
    rows = lineage(s.sql("SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT s_suppkey FROM supplier"))
    assert {f"{r['table']}.{r['column']}" for r in rows} == {"orders.o_custkey", "customer.c_custkey", "customer.c_acctbal", "supplier.s_suppkey"}


@pytest.mark.parametrize("name", sorted(catalogue.RENDERED))
def test_every_statement_has_lineage(spark, name):
    df = catalogue.rendered_query(name)(spark, SF)
    held = PlanLineage(df)
    assert [n for n, _ in held.outputs] == df.columns
    schema = {t: set(catalogue.session(spark, SF).table(t).columns) for t in catalogue.TABLES}
    for _, columns in [*held.outputs, ("", held.rows)]:
        assert all(c in schema[t] for t, c in columns), columns
    assert any(columns for _, columns in held.outputs)


@pytest.mark.parametrize("name", ["x_dynamic_where_iterate", "x_scalar_subquery", "x_derived_nested", "x_cte_chained", "x_union", "x_anti_not_exists"])
def test_other_columns_do_not_matter(spark, name):
    """With a column's values changed only those outputs change that the lineage names."""
    qid, params, _ = catalogue.RENDERED[name]
    s = catalogue.statement(spark, qid)
    sql, args = render(s["tree"], params, s["dialect"])
    own = spark.newSession()
    used = [t for t in catalogue.TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        own.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    rows = lineage(run_sql(own, sql, args))
    before = run_sql(own, sql, args).collect()
    changed = 0
    for t in used:
        base = own.read.parquet(f"{SF}/{t}.parquet")
        for f in base.schema:
            new = F.col(f.name) + 7919 if isinstance(f.dataType, T.NumericType) else F.concat(F.col(f.name), F.lit("~")) if isinstance(f.dataType, T.StringType) else F.date_add(f.name, 9999).cast(f.dataType)
            base.withColumn(f.name, new).createOrReplaceTempView(t)
            after = run_sql(own, sql, args).collect()
            named = {r["output"] for r in rows if (r["table"], r["column"]) == (t, f.name)}
            for k, column in enumerate(before[0].__fields__ if before else []):
                if Counter(repr(r[k]) for r in before) != Counter(repr(r[k]) for r in after):
                    assert column in named, (t, f.name, column)
                    changed += 1
        base.createOrReplaceTempView(t)
    assert changed

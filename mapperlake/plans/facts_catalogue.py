"""Queries about the corpus itself: its metadata by the engine, against values counted by hand from the XML files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.operators import assemble, migrate, resolve
from mapperlake.operators.runtime import render
from mapperlake.plans import catalogue, migration, reports
from mapperlake.plans.engine import run_sql
from mapperlake.sources import mapping

_renamed: dict[str, DataFrame] = {}


def _legacy() -> dict:
    return json.loads((catalogue.CORPUS / "legacy.json").read_text())


def _events(spark: SparkSession) -> DataFrame:
    app = spark.sparkContext.applicationId
    if app not in _renamed:
        _renamed.clear()
        _renamed[app] = migration.renamed(catalogue.project(spark), _legacy())[1].persist()
    return _renamed[app]


def m_statement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).owners.where("kind = 'STATEMENT'").groupBy("namespace", "type").agg(F.count("*").alias("n"))


def m_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).registered.where("kind <> 'STATEMENT'").select("qid", "kind")


def m_include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.include_closure(catalogue.project(spark).include_tree)


def m_include_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.include_usage(catalogue.project(spark).include_tree)


def m_extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.extends_chains(catalogue.project(spark).map_references)


def m_result_map_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.result_map_users(catalogue.project(spark))


def m_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).facts("tables").where("operation <> 'READ'").select("statement", "table", "operation")


def m_join_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_graph(catalogue.project(spark)).select("left_table", "right_table", F.size("statements").alias("n"))


def m_join_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).facts("joins").where("statement LIKE 'orders.%'").groupBy("type").agg(F.count("*").alias("n"))


def m_column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).facts("lineage").where("hops > 0").select("statement", "output", "table", "column", "hops")


def m_select_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).facts("selects").where("role <> 'MAIN'").select("statement", "select_id", "role", "origin")


def m_table_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).rendered.where(F.size("variants") > 1).select("statement", F.explode("variants").alias("v")).select("statement", F.col("v.choices")[0]["kind"].alias("kind"), F.regexp_extract("v.sql", r"FROM (\w+)", 1).alias("table"))


def m_write_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalogue.project(spark)
    kinds = p.rendered.where("type <> 'SELECT'").select("statement")
    return assemble.parameter_usages(p.rendered).join(kinds, "statement").select("statement", "name", "binding", "used_in", "jdbc_type", "null_value")


def m_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.dynamic_conditions(catalogue.project(spark).rendered).where("statement = 'orders.segmentTotals'").select("ord", "kind", "condition", "property", "depth")


def m_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.project(spark).problems.groupBy("severity", "code").agg(F.count("*").alias("n"))


def m_rename_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark).groupBy("code", "grade").agg(F.count("*").alias("n"))


def m_rename_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.migration_total(_events(spark)).drop("all")


def m_mapping_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalogue.project(spark)
    return migrate.usage(p.rendered.where("namespace = 'legacy'"), p.analysed.where("statement LIKE 'legacy.%'"), _legacy())


def m_conversion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, events = migration.converted(catalogue.project(spark))
    return events.where("code IN ('DYNAMIC_TO_WHERE', 'DYNAMIC_TO_SET', 'ITERATE_TO_FOREACH', 'SELECT_KEY_CONVERTED', 'PROCEDURE_TO_CALLABLE', 'UNSUPPORTED_NULL_VALUE', 'RAW_SQL_SUBSTITUTION', 'RESULT_MAP_CONVERTED', 'PROPERTY_AVAILABLE_APPROXIMATED', 'ALREADY_MYBATIS', 'REFERENCE_QUALIFIED')").groupBy("code", "grade").agg(F.count("*").alias("n"))


def x_rename_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement of old names, renamed, on today's tables."""
    s = catalogue.statement(spark, "legacy.custTotals")
    sql, args = render(s["tree"], {"floor": 100000.0}, s["dialect"])
    text, _ = migrate.convert_sql(sql, mapping.Mapping(_legacy()))
    return run_sql(catalogue.session(spark, sf_dir), text, args)


def x_convert_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement of the older dialect, converted and rendered by the newer one's rules."""
    from mapperlake.operators.convert import convert_tree

    s = catalogue.statement(spark, "orders.segmentTotals")
    return run_sql(catalogue.session(spark, sf_dir), *render(convert_tree(s["tree"]), catalogue.RENDERED["x_dynamic_where_iterate"][1], "mybatis"))


def _values(columns: str, *rows: tuple) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    names = [c.strip() for c in columns.split(",")]  # a count's name ends with !
    picked = ", ".join(f"{n[:-1]}::BIGINT AS {n[:-1]}" if n.endswith("!") else n for n in names)
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({', '.join(n.rstrip('!') for n in names)})"


FACTS: dict[str, tuple[Callable, str]] = {
    "m_statement_types": (m_statement_types, _values("namespace, type, n!", ("orders", "SELECT", 19), ("orders", "INSERT", 1), ("orders", "UPDATE", 1), ("orders", "DELETE", 1), ("orders", "PROCEDURE", 1), ("reports", "SELECT", 16), ("legacy", "SELECT", 2))),
    "m_symbols": (m_symbols, _values("qid, kind", ("orders.segmentTotal", "RESULT_MAP"), ("orders.segmentMoney", "RESULT_MAP"), ("orders.priceFloor", "SQL_FRAGMENT"), ("common.amount", "SQL_FRAGMENT"), ("common.lineColumns", "SQL_FRAGMENT"), ("common.shippedAfter", "SQL_FRAGMENT"), ("reports.orderRow", "RESULT_MAP"), ("reports.orderColumns", "SQL_FRAGMENT"), ("legacy.live", "SQL_FRAGMENT"))),
    "m_include_closure": (m_include_closure, _values("root, fragment", ("orders.segmentTotals", "orders.priceFloor"), ("orders.lineAmounts", "common.lineColumns"), ("orders.lineAmounts", "common.amount"), ("orders.lineAmounts", "common.shippedAfter"), ("reports.orders", "reports.orderColumns"))),
    "m_include_usage": (m_include_usage, _values("fragment, n_statements!", ("orders.priceFloor", 1), ("common.lineColumns", 1), ("common.amount", 1), ("common.shippedAfter", 1), ("reports.orderColumns", 1))),
    "m_extends": (m_extends, _values("source, target, depth", ("orders.segmentMoney", "orders.segmentTotal", 1))),
    "m_result_map_users": (m_result_map_users, _values("result_map, statement", ("orders.segmentMoney", "orders.segmentTotals"), ("orders.segmentTotal", "orders.segmentTotals"), ("reports.orderRow", "reports.orders"))),
    "m_writes": (m_writes, _values('statement, "table", operation', ("orders.addOrder", "orders", "CREATE"), ("orders.changeOrder", "orders", "UPDATE"), ("orders.dropOrder", "orders", "DELETE"))),
    "m_join_graph": (m_join_graph, _values("left_table, right_table, n", ("customer", "orders", 4), ("orders", "customer", 2), ("customer", "nation", 2), ("supplier", "nation", 1), ("nation", "region", 1), ("region", "region", 1), ("nation", "nation", 1), ("part", "supplier", 1), ("lineitem", "orders", 1), ("TB_CUST_M", "TB_ORD_H", 1))),
    "m_join_types": (m_join_types, _values("type, n!", ("IMPLICIT_JOIN", 3), ("INNER_JOIN", 1), ("LEFT_JOIN", 2), ("RIGHT_JOIN", 1), ("FULL_JOIN", 1), ("CROSS_JOIN", 1), ("JOIN", 3))),
    "m_column_lineage": (
        m_column_lineage,
        _values(
            'statement, output, "table", "column", hops',
            ("orders.nestedTotals", "segment", "customer", "c_mktsegment", 2), ("orders.nestedTotals", "mean_total", "orders", "o_totalprice", 2), ("orders.customerMaxima", "max_price", "orders", "o_totalprice", 1),
            ("reports.latestOrders", "o_custkey", "orders", "o_custkey", 1), ("reports.latestOrders", "o_orderkey", "orders", "o_orderkey", 1), ("legacy.stillOld", "NO", "TB_CUST_M", "CUST_NO", 1),
        ),
    ),
    "m_select_roles": (
        m_select_roles,
        _values(
            "statement, select_id, role, origin",
            ("orders.balancesByNation", "S1", "DERIVED", "FROM"), ("orders.balancesByNation", "S2", "DERIVED", "FROM"), ("orders.customersIn", "S1", "SUBQUERY", "WHERE"), ("orders.customersExisting", "S1", "SUBQUERY", "WHERE"),
            ("orders.customersWithoutBigOrders", "S1", "SUBQUERY", "WHERE"), ("orders.customerMaxima", "S1", "SUBQUERY", "SELECT_LIST"), ("orders.nestedTotals", "S1", "DERIVED", "FROM"), ("orders.nestedTotals", "S2", "DERIVED", "FROM"),
            ("orders.addOrder", "MAIN", "WRITE", "INSERT"), ("orders.changeOrder", "MAIN", "WRITE", "UPDATE"), ("orders.dropOrder", "MAIN", "WRITE", "DELETE"), ("reports.segmentChain", "S1", "CTE", "WITH"), ("reports.segmentChain", "S2", "CTE", "WITH"),
            ("reports.allParties", "U1", "UNION", "UNION"), ("reports.partyNations", "U1", "UNION", "UNION"), ("reports.commonNations", "U1", "UNION", "UNION"), ("reports.customerOnlyNations", "U1", "UNION", "UNION"), ("reports.latestOrders", "S1", "DERIVED", "FROM"), ("legacy.stillOld", "S1", "DERIVED", "FROM"),
        ),
    ),
    "m_table_variants": (m_table_variants, _values('statement, kind, "table"', ("orders.ordersOf", "SUFFIX", "orders"), ("orders.ordersOf", "SUFFIX", "orders_archive"), ("orders.partiesOf", "ALTERNATIVES", "customer_view"), ("orders.partiesOf", "ALTERNATIVES", "supplier_view"))),
    "m_write_parameters": (
        m_write_parameters,
        _values(
            "statement, name, binding, used_in, jdbc_type, null_value",
            ("orders.addOrder", "id", "HASH", "INSERT_VALUE", None, None), ("orders.addOrder", "custkey", "HASH", "INSERT_VALUE", None, None), ("orders.addOrder", "price", "HASH", "INSERT_VALUE", "DECIMAL", "0"),
            ("orders.changeOrder", "status", "HASH", "UPDATE_SET", None, None), ("orders.changeOrder", "price", "HASH", "UPDATE_SET", None, None), ("orders.changeOrder", "id", "HASH", "WHERE", None, None), ("orders.dropOrder", "id", "HASH", "WHERE", None, None), ("orders.rebuild", "id", "HASH", "OTHER", None, None),
        ),
    ),
    "m_conditions": (
        m_conditions,
        _values("ord, kind, condition, property, depth", (0, "GROUP", None, None, 0), (1, "CONDITION", "IS_NOT_NULL", "floor", 1), (2, "CONDITION", "IS_NOT_EMPTY", "statuses", 1), (3, "ITERATE", None, "statuses", 2), (4, "CONDITION", "PROPERTY_AVAILABLE", "segment", 1), (5, "CONDITION", "EQUAL", "segment", 2), (6, "CONDITION", "NOT_EQUAL", "segment", 2)),
    ),
    "m_problems": (m_problems, _values("severity, code, n!", ("WARNING", "RAW_SQL_SUBSTITUTION", 1), ("WARNING", "SQL_PARSE_FAILED", 1))),
    "m_rename_events": (m_rename_events, _values("code, grade, n!", ("TABLE_RENAMED", "SAFE", 3), ("COLUMN_RENAMED", "SAFE", 11), ("RESULT_COLUMN_RENAMED", "WARNING", 2), ("RUNTIME_SUBSTITUTION", "WARNING", 1))),
    "m_rename_safety": (m_rename_safety, _values('"SAFE"!, "WARNING"!, "MANUAL"!, "ERROR"!', (14, 3, 0, 0))),
    "m_mapping_usage": (m_mapping_usage, _values('statement, "table", operation, verdict', ("legacy.custTotals", "TB_CUST_M", "READ", "MAPPED"), ("legacy.custTotals", "TB_ORD_H", "READ", "MAPPED"), ("legacy.stillOld", "TB_CUST_M", "READ", "MAPPED"), ("legacy.stillOld", "TB_LOG", "READ", "UNMAPPED"))),
    "m_conversion_events": (
        m_conversion_events,
        _values("code, grade, n!", ("DYNAMIC_TO_WHERE", "SAFE", 2), ("DYNAMIC_TO_SET", "SAFE", 1), ("ITERATE_TO_FOREACH", "SAFE", 1), ("SELECT_KEY_CONVERTED", "SAFE", 1), ("PROCEDURE_TO_CALLABLE", "WARNING", 1), ("UNSUPPORTED_NULL_VALUE", "MANUAL", 1), ("RAW_SQL_SUBSTITUTION", "WARNING", 1), ("RESULT_MAP_CONVERTED", "SAFE", 2), ("PROPERTY_AVAILABLE_APPROXIMATED", "WARNING", 1), ("ALREADY_MYBATIS", "SAFE", 18), ("REFERENCE_QUALIFIED", "SAFE", 1)),
    ),
    "x_rename_equivalence": (x_rename_equivalence, 'SELECT c_custkey, c_mktsegment, COUNT(*) AS "CNT", ROUND(SUM(o_totalprice), 2) AS "TOT" FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = \'F\' AND o_totalprice > 100000 GROUP BY 1, 2'),
    "x_convert_equivalence": (x_convert_equivalence, "SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 150000 AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2"),
}

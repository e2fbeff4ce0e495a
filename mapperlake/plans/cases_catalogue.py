"""Queries about a small project of cases (cases/): one for each kind of reference, fact, rename and conversion.

Each has its rows, checked by hand against the mapper files, as its SQL (cases.json, by query).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.operators import assemble, catalog, facts, migrate, resolve
from mapperlake.plans import api, migration, reports
from mapperlake.plans.engine import Project
from mapperlake.sinks import mapper_xml, sqllayout
from mapperlake.sinks import reports as report_files
from mapperlake.sources import mapping, projects

CASES = Path(__file__).parent / "cases"
_projects: dict[str, Project] = {}
_converted: dict[str, tuple[DataFrame, DataFrame]] = {}

#: File contents by name: encodings, kinds of roots, sizes.
FILES = {
    "ko.xml": "<?xml version='1.0' encoding='ks_c_5601-1987'?><sqlMap namespace='가'/>".encode("euc-kr"), "u16.xml": "﻿<mapper namespace='x'/>".encode("utf-16-le"),
    "conf.xml": b"<!DOCTYPE sqlMapConfig [<!ELEMENT a (b)>]><sqlMapConfig/>", "my.xml": b"<!-- c --><?pi x?><configuration/>", "page.xml": b"<html/>", "none.xml": b"plain text",
    "odd.xml": "<?xml version='1.0' encoding='klingon'?><sqlMap namespace='é'/>".encode(), "big.xml": None,
}
#: A text that can't be parsed, and texts that can after a recovery.
TORN = "<sqlMap namespace='torn'>\n<!-- <select id='hidden'> -->\n<sql id='part'>x</sql>\n<select id='one'>SELECT <<\n<update id=\"two\">"
LENIENT = {
    "unclosed.xml": "<sqlMap namespace='a'><select id='s'>SELECT 1 <isNull property='x'>AND 2</select></sqlMap>", "stray.xml": "<sqlMap namespace='b'><select id='s'>SELECT 1</isNull></select></sqlMap>",
    "lt.xml": "<sqlMap namespace='c'><select id='s'>SELECT a FROM t WHERE a < 5 AND b <= 3</select></sqlMap>", "trim.xml": "<sqlMap namespace='d'><select id=' s '>SELECT 1</select><sql>no id</sql></sqlMap>",
    "tag.xml": "<sqlMap><select id='s'>SELECT <strange>1</strange><include/></select></sqlMap>",
}
BAD_MAPPING = {"TB_A": {"targetTable": "A", "columns": {"X": "Y", "Z": "Y"}}, "tb_a": {"columns": {"Q": "Q"}}, "9bad": {"targetTable": "B", "extra": 1}, "TB_C": {"targetTable": "A"}, "TB_D": 5}
RENAMES = {"TB_CUST": {"targetTable": "CUSTOMER", "columns": {"CUST_NO": "CUSTOMER_ID", "USE_YN": "IS_ACTIVE"}}, "TB_ORD": {"targetTable": "ORDERS", "columns": {"ORD_NO": "ORDER_ID", "CUST_NO": "CUSTOMER_ID"}}, "S.TB_PAY": {"targetTable": "B.PAYMENT", "columns": {"AMT": "AMOUNT"}}}
OLD_SQL = [
    "SELECT CUST_NO, 'TB_CUST' FROM TB_CUST -- TB_CUST", "SELECT X.NO FROM (SELECT C.CUST_NO AS NO FROM TB_CUST C) X", "SELECT D.CUST_NO FROM (SELECT * FROM TB_CUST) D", "WITH W (N) AS (SELECT CUST_NO FROM TB_CUST) SELECT W.N FROM W",
    "SELECT A.CUST_NO, B.ORD_NO FROM TB_CUST A JOIN TB_ORD B ON A.CUST_NO = B.CUST_NO", "SELECT P.AMT FROM S.TB_PAY P", "SELECT P.AMT FROM TB_PAY P", "DELETE FROM TB_ORD WHERE ORD_NO = ?", "UPDATE TB_CUST SET USE_YN = 'N' WHERE CUST_NO = ?",
    "INSERT INTO TB_ORD (ORD_NO, CUST_NO) SELECT ?, CUST_NO FROM TB_CUST", "MERGE INTO TB_ORD O USING TB_CUST C ON (O.CUST_NO = C.CUST_NO) WHEN MATCHED THEN UPDATE SET O.ORD_NO = 1", "SELECT /*+ INDEX(TB_CUST X) */ CUST_NO FROM TB_CUST", "SELECT T.CUST_NO FROM TABLE(F(1)) T",
]
#: Forms of SQL dialects, each with a table `t1`.
FORMS = [
    "INSERT INTO t1 (a) VALUES (1) ON DUPLICATE KEY UPDATE a = VALUES(a)", "REPLACE INTO t1 (a) VALUES (1)", "SELECT a FROM t1 GROUP BY a WITH ROLLUP", "SELECT GROUP_CONCAT(DISTINCT a ORDER BY b SEPARATOR '; ') FROM t1",
    "SELECT a COLLATE utf8_bin FROM t1 ORDER BY a COLLATE utf8_bin", "SELECT a FROM t1 USE INDEX (i1) WHERE b = 1", "SELECT a FROM t1 PARTITION (p1)", "SELECT a FROM t1 WHERE MATCH (a, b) AGAINST ('x' IN BOOLEAN MODE)",
    "SELECT a FROM t1 FOR UPDATE SKIP LOCKED", "SELECT a FROM t1 WHERE b = X'0F'", "SELECT a FROM t1 START WITH b IS NULL CONNECT BY PRIOR a = b", "SELECT TOP 5 a FROM t1", "SELECT MAX(a) KEEP (DENSE_RANK FIRST ORDER BY b) FROM t1",
    "UPDATE t1 SET (a, b) = (SELECT c, d FROM t2) WHERE e = 1", "SELECT a FROM t1 WITH (NOLOCK) WHERE b = 1", "SELECT a FROM t1 QUALIFY ROW_NUMBER() OVER (ORDER BY b) = 1", "DELETE FROM t1 WHERE a = 1 LIMIT 5", "SELECT a FROM t1 LIMIT 5 FOR SHARE",
    "SELECT a FROM t1 WHERE b ILIKE 'x%' AND c IS DISTINCT FROM d", "SELECT a FROM t1 OFFSET 5 ROWS FETCH NEXT 3 ROWS ONLY",
]


def cases(spark: SparkSession) -> Project:
    app = spark.sparkContext.applicationId
    if app not in _projects:
        _projects.clear()
        _projects[app] = Project.upload(spark, {p.relative_to(CASES).as_posix(): p.read_text() for p in sorted(CASES.rglob("*.xml"))})
    return _projects[app]


def _conversion(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    app = spark.sparkContext.applicationId
    if app not in _converted:
        _converted.clear()
        _converted[app] = migration.converted(cases(spark))
    return _converted[app]


def _squeezed(text: str):
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _joined(df: DataFrame) -> DataFrame:
    """Arrays as text."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def _each(spark: SparkSession, texts: list[str], shape: str, f: Callable[[str], list[tuple]]) -> DataFrame:
    """f's rows of each text, computed by tasks."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for t in pdf["text"] for x in f(t)], columns=names)

    return spark.createDataFrame([(t,) for t in texts], "text string").mapInPandas(run, shape)


def c_include_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).include_tree.select("root", "src", "refid", "dst", "rule", "status", "depth")


def c_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).problems.select("severity", "code", "source_file", "line")


def c_map_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).map_references.select("src", "dst", "kind", "found")


def c_extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.extends_chains(cases(spark).map_references)


def c_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cases(spark)
    return resolve.qualification(p.include_tree, p.owners).select("owner", "refid", "target", "must_qualify", "conflict")


def c_dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).dependency_edges


def c_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.dependencies(cases(spark), "lib.columns")


def c_includers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cases(spark)
    return resolve.includers(p.include_tree, p.statements)


def c_include_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.include_sites(cases(spark).edges)


def c_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(catalog.namespaces(cases(spark).mappers))


def c_dependency_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dependency_tree(cases(spark), "main.byName")


def c_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).rendered.select("statement", F.posexplode("variants").alias("k", "v")).select("statement", "k", _squeezed("v.sql").alias("sql"))


def c_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.parameter_usages(cases(spark).rendered).where("statement <> 'sql.flat'").select("statement", "name", "binding", "used_in", "jdbc_type", "null_value", "condition", "condition_property", "risk")


def c_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).facts("tables").select("statement", "table", "alias", "operation", "derived", "variable")


def c_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).facts("columns")


def c_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(cases(spark).facts("joins"))


def c_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).facts("predicates")


def c_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).facts("outputs").select("statement", "select_id", "ord", "name", "expression", "aggregate", "n_refs", "source_table", "source_column", "source_select")


def c_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(cases(spark).facts("selects"))


def c_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(cases(spark).facts("lineage"))


def c_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.counts(cases(spark).analysed)


def c_mapper_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(reports.mapper_report(cases(spark)))


def c_table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(reports.table_report(cases(spark)))


def c_column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.column_report(cases(spark))


def c_project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.project_report(cases(spark))
    return r.select("table", F.array_join(F.array_sort(F.map_keys("operations")), "; ").alias("operations"), F.array_join(F.array_sort(F.map_keys("columns")), "; ").alias("columns"))


def c_table_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_details(cases(spark), "TARGET")


def c_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.index_summary(cases(spark))


def c_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search(cases(spark), "Ring")


def c_column_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.column_guide(cases(spark), "users", "name")


def c_raw_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.raw_xml(cases(spark)).where("qid IN ('lib.inner', 'nearby.copy', 'sql.drop', 'sql.dollarTable')")


def c_statement_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.statement_bundle(cases(spark), "main.far").select("qid", "line")


def c_inlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cases(spark)
    return spark.createDataFrame([(q, " ".join(api.inlined_xml(p, q).split())) for q in ("main.far", "main.ring", "main.byName")], "statement string, xml string")


def c_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, len(b) if b is not None else 30_000_000, bytearray(b) if b is not None else None, False) for n, b in FILES.items()]
    return projects.decoded(spark.createDataFrame(rows, "source_file string, size long, content binary, external boolean")).select("source_file", "encoding", "kind", "reason", "text")


def c_ignored_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["a/node_modules/x.xml", "node_modules.xml", ".git/x.xml", "a/.gradle/b/c.xml", "src/main/x.xml", "x\\.svn\\y.xml", "idea/x.xml", ".idea"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.select("path", projects.in_ignored_folder(F.col("path")).alias("ignored"), projects.copy_score(F.col("path")).alias("score"))


def c_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.definitions(spark.createDataFrame([("torn.xml", TORN)], "source_file string, text string"))


def c_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project.upload(spark, LENIENT).problems.select("source_file", "severity", "code")


def c_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.nodes(cases(spark).owners).where("owner_id IN ('newer.pick', 'newer.change', 'main.byName', 'sql.flat')")
    return found.select("owner_id", "node_id", "parent_id", "type", *[F.col("attrs")[k].alias(a) for k, a in (("condition", "condition"), ("property", "property"), ("prepend", "prepend"), ("prefix", "prefix"), ("refid", "refid"), ("test", "test"))])


def c_mapping_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.validate(BAD_MAPPING)
    return spark.createDataFrame([(k, x["path"], x["code"]) for k in ("errors", "warnings") for x in found[k]], "kind string, path string, code string")


def c_renamed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, OLD_SQL, "old string, new string", lambda t: [(t, migrate.convert_sql(t, mapping.Mapping(RENAMES))[0])])


def c_rename_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, OLD_SQL, "old string, code string, grade string", lambda t: [(t, x["code"], x["grade"]) for x in migrate.convert_sql(t, mapping.Mapping(RENAMES))[1]])


def c_sql_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(text: str) -> list[tuple]:
        a = facts.analyse([{"sql": text}])
        return [(text, a["error"] is None, "; ".join(sorted({t["table"] for t in a["tables"]})), "; ".join(sorted({c["column"] for c in a["columns"]})))]

    return _each(spark, FORMS, "sql string, read boolean, tables string, columns string", read)


def c_conversion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversion(spark)[1].select("source_file", "owner", "code", "grade")


def c_converted_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mapper_xml.documents(_conversion(spark)[0].where("source_file = 'app/orders/Main.xml'"))
    return docs.select("source_file", F.posexplode(F.split("xml", "\n")).alias("line", "text"))


def c_older_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mapper_xml.documents(cases(spark).owners.where("source_file = 'app/lib/Lib.xml'"))
    return docs.select("source_file", F.posexplode(F.split("xml", "\n")).alias("line", "text"))


def c_sql_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["select a, b from t join u on t.x=u.y where a=1 and (b=2 or c in (1, 2)) order by a", "update t set a = 'x  y', b = ? where c is null"]
    return _each(spark, texts, "sql string, ord int, line string", lambda t: [(t, k, x) for k, x in enumerate(sqllayout.pretty(t).split("\n"))])


def c_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_files.tallies(_conversion(spark)[1], cases(spark).mappers)


def c_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_files.review_list(_conversion(spark)[1])


def c_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a conversion changes."""
    before, after = mapper_xml.documents(cases(spark).owners), mapper_xml.documents(_conversion(spark)[0])
    return mapper_xml.shaped(before, after).select("source_file", F.col("after").isNotNull().alias("changed"))


def _sql(rows: dict) -> str:
    """VALUES of {columns: [[name, type], ...], rows}."""

    def one(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    names = [n for n, _ in rows["columns"]]
    picked = ", ".join(f'"{n}"::{kinds[t]} AS "{n}"' for n, t in rows["columns"])
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows['rows'])}) t({', '.join(chr(34) + n + chr(34) for n in names)})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("c_")}


def oracle_sql() -> dict[str, str]:
    return {k: _sql(v) for k, v in json.loads((CASES / "cases.json").read_text()).items()}

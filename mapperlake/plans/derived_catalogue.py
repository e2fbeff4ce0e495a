"""Metadata queries over a project that Spark derives from the supplier table: a mapper file for each supplier.

A supplier's number decides what its file defines and includes, so every operator of reference resolution, dynamic SQL,
fact extraction, reports, renames and conversion works on as many files as there are suppliers, and SQL over the supplier table tells the
rows that must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.operators import assemble, catalog, migrate, resolve
from mapperlake.plans import migration, reports
from mapperlake.plans.engine import Project
from mapperlake.sinks import mapper_xml
from mapperlake.sources import projects

#: A supplier's file. {k}: its number, {next}: the number after it, {m}<p>: the number modulo p, {ext}: the map that its own extends.
TEMPLATE = """<sqlMap namespace="s{k}">
<resultMap id="base" class="B"><result property="id" column="ID"/></resultMap>
<resultMap id="row" class="R" extends="{ext}"><result property="name" column="NAME_{m7}"/></resultMap>
<sql id="cols">a.C{m9}, a.NAME</sql>
<sql id="only{k}">a.U = {k}</sql>
<sql id="deep"><include refid="s{next}.flag"/> AND a.D = 1</sql>
<sql id="flag">a.F = 'Y'</sql>
{same}{near}<select id="list" resultMap="row">SELECT <include refid="cols"/> FROM T{m4} a, U{m3} b WHERE a.ID = b.ID AND <include refid="deep"/><isNotNull prepend="AND" property="p{m5}">a.P = #p{m5}:INTEGER#</isNotNull></select>
<select id="uses">SELECT a.ID FROM T{m4} a WHERE <include refid="only{next}"/></select>
<select id="viaSame">SELECT a.ID FROM T0 a WHERE <include refid="same"/></select>
<select id="viaNear">SELECT a.ID FROM T1 a WHERE <include refid="near"/></select>
<select id="lost" resultMap="gone{k}">SELECT a.ID FROM T2 a WHERE a.ID > 0 <include refid="nowhere{k}"/></select>
<insert id="add">INSERT INTO W{m3} (A, B) VALUES (#a:VARCHAR:NONE#, $raw$)</insert>
<select id="pick">SELECT a.X, x.M FROM V<isEqual property="old" compareValue="Y">_OLD{m2}</isEqual> a LEFT JOIN (SELECT ID, MAX(Z) AS M FROM Z{m6} GROUP BY ID) x ON a.ID = x.ID WHERE a.K IN (SELECT K FROM Y) ORDER BY a.X</select>
{bad}</sqlMap>
"""
#: A mapping whose columns stand in fragments without a table: their including statements tell.
CONTEXT = {"T0": {"targetTable": "N0", "columns": {"F": "FLAG", "U": "UNIT"}}}
MAPPING = {"T0": {"targetTable": "N0", "columns": {"ID": "KEY_ID"}}, "W1": {"targetTable": "N1", "columns": {"A": "ALPHA"}}}

#: The supplier table is small in bytes and often a single split; what is made of a row takes milliseconds.
FILES_PER_TASK = 500

_projects: dict[tuple[str, str], Project] = {}
_events: dict[tuple[str, str, str], DataFrame] = {}


def source(k: Column) -> Column:
    """A supplier's file as text."""
    text: Column = F.lit(TEMPLATE)
    fill = {f"{{m{p}}}": (k % p).cast("string") for p in range(2, 10)} | {
        "{same}": F.when(k % 10 == 0, '<sql id="same">a.S = 1</sql>\n').otherwise(""), "{near}": F.when(k % 4 == 0, F.concat(F.lit('<sql id="near">a.N = '), k, F.lit("</sql>\n"))).otherwise(""),
        "{bad}": F.when(k % 5 == 0, F.concat(F.lit('<select id="bad">SELECT FROM WHERE '), k, F.lit("</select>\n"))).otherwise(""),
        "{ext}": F.when(k % 3 == 0, "base").when(k % 3 == 1, F.concat(F.lit("s"), k + 1, F.lit(".row"))).otherwise(F.concat(F.lit("s"), k, F.lit(".base"))),
        "{next}": (k + 1).cast("string"), "{k}": k.cast("string"),
    }
    for name, value in fill.items():
        text = F.replace(text, F.lit(name), value)
    return text


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's file below folders of its nation; every seventh is there a second time, in a build folder."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    numbers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k, n)
    supplier = numbers.repartition(-(-numbers.count() // FILES_PER_TASK) or 1, k).select(source(k).alias("text"), F.concat_ws("/", F.concat(F.lit("r"), n % 5), F.concat(F.lit("n"), n), F.concat(F.lit("S"), k, F.lit(".xml"))).alias("path"), k.alias("k"))
    built = supplier.where("k % 7 = 0").withColumn("path", F.concat(F.lit("target/classes/"), "path"))
    rows = supplier.unionByName(built)
    return projects.decoded(rows.select(F.col("path").alias("source_file"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"), F.lit(False).alias("external")))


def project(spark: SparkSession, sf_dir: str) -> Project:
    """The suppliers' project, analysed once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _projects:
        for p in _projects.values():
            p.close()
        _projects.clear()
        _events.clear()
        _projects[key] = Project(files(spark, sf_dir))
    return _projects[key]


def renamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Owners and events of the project renamed by MAPPING, once."""
    return _once(spark, sf_dir, "renamed", lambda p: migration.renamed(p, MAPPING))


def converted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Owners and events of the project in the newer dialect, once."""
    return _once(spark, sf_dir, "converted", migration.converted)


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable) -> tuple[DataFrame, DataFrame]:
    p, key = project(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _events:
        _events[key] = tuple(x.persist() for x in make(p))
    return _events[key]


def _facts(name: str, *columns: str) -> Callable:
    return lambda spark, sf_dir: project(spark, sf_dir).facts(name).select("statement", *columns)


def _tree(f: Callable) -> Callable:
    return lambda spark, sf_dir: f(project(spark, sf_dir))


def in_context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Owners and events of the project renamed by CONTEXT, once."""
    return _once(spark, sf_dir, "context", lambda p: migration.renamed(p, CONTEXT))


def xml_pieces(owners: DataFrame) -> DataFrame:
    """source_file and what stands in the insert and in the start of the statement `uses` of each written mapper."""
    one = lambda pattern: F.regexp_replace(F.regexp_extract("xml", pattern, 1), r"\s+", " ")
    return mapper_xml.documents(owners).select("source_file", "dialect", F.trim(one(r"(?s)<insert id=\"add\"[^>]*>(.*?)</insert>")).alias("add_text"), F.trim(one(r"(?s)<select id=\"uses\"[^>]*>(.*?)</select>")).alias("uses_text"))


def own_text(owners: DataFrame, *ids: str) -> DataFrame:
    """qid and the text of the owners' own text nodes."""
    text = F.concat_ws("", F.transform(F.filter("nodes", lambda n: n["type"] == "Text"), lambda n: n["text"]))
    return owners.where(F.col("local_id").isin(*ids)).select("qid", text.alias("text"))


def _sql(body: str, *rows: tuple, columns: str = "") -> str:
    """SQL over s (a supplier's k, name ns, file f, line l of its first statement, more: whether there is a next one; what its bare refids same and near lead to) and, with rows, x: these rows of SQL terms for each supplier."""
    names = columns.split()
    made = ", LATERAL (SELECT unnest([" + ", ".join("{" + ", ".join(f"'{n}': {v}" for n, v in zip(names, r, strict=True)) + "}" for r in rows) + "], recursive := true)) x" if rows else ""
    return f"""WITH b AS (SELECT s_suppkey AS k, s_nationkey AS n, 's' || s_suppkey AS ns, 'r' || s_nationkey % 5 || '/n' || s_nationkey || '/S' || s_suppkey || '.xml' AS f,
      8 + (s_suppkey % 10 = 0)::INTEGER + (s_suppkey % 4 = 0)::INTEGER AS l, s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AS more FROM supplier),
    near1 AS (SELECT a.k, c.ns, CASE WHEN a.n = c.n THEN 2 WHEN a.n % 5 = c.n % 5 THEN 1 ELSE 0 END AS shared FROM b a JOIN b c ON c.k % 4 = 0 WHERE a.k % 4 <> 0),
    near2 AS (SELECT k, arg_max(ns, shared) AS best, count(*) FILTER (shared = top) AS ties FROM (SELECT *, max(shared) OVER (PARTITION BY k) AS top FROM near1) GROUP BY k),
    s AS (SELECT b.*, CASE WHEN b.k % 10 = 0 THEN ns ELSE (SELECT min(ns || '.') [:-2] FROM b d WHERE d.k % 10 = 0) END AS same_ns,
      CASE WHEN b.k % 10 = 0 THEN 'NAMESPACE' WHEN (SELECT count(*) FROM b d WHERE d.k % 10 = 0) = 1 THEN 'GLOBAL_UNIQUE' ELSE 'DUPLICATE_SAME' END AS same_rule,
      CASE WHEN b.k % 4 = 0 THEN ns WHEN ties = 1 THEN best END AS near_ns,
      CASE WHEN b.k % 4 = 0 THEN 'NAMESPACE' WHEN ties = 1 AND (SELECT count(*) FROM b d WHERE d.k % 4 = 0) = 1 THEN 'GLOBAL_UNIQUE' WHEN ties = 1 THEN 'NEAREST_DUPLICATE' ELSE 'MISSING' END AS near_rule
      FROM b LEFT JOIN near2 USING (k)),
    e AS (SELECT k, ns, f, l, ns || '.' || x.root AS root, ns || '.' || x.src AS src, x.dst, x.refid, x.rule, x.depth, x.line FROM s, LATERAL (SELECT unnest([
      {{'root': 'list', 'src': 'list', 'dst': ns || '.cols', 'refid': 'cols', 'rule': 'NAMESPACE', 'depth': 1, 'line': l}}, {{'root': 'list', 'src': 'list', 'dst': ns || '.deep', 'refid': 'deep', 'rule': 'NAMESPACE', 'depth': 1, 'line': l}},
      {{'root': 'list', 'src': 'deep', 'dst': 's' || (k + 1) || '.flag', 'refid': 's' || (k + 1) || '.flag', 'rule': CASE WHEN more THEN 'QUALIFIED' ELSE 'MISSING' END, 'depth': 2, 'line': 6}},
      {{'root': 'uses', 'src': 'uses', 'dst': CASE WHEN more THEN 's' || (k + 1) || '.' ELSE '' END || 'only' || (k + 1), 'refid': 'only' || (k + 1), 'rule': CASE WHEN more THEN 'GLOBAL_UNIQUE' ELSE 'MISSING' END, 'depth': 1, 'line': l + 1}},
      {{'root': 'viaSame', 'src': 'viaSame', 'dst': same_ns || '.same', 'refid': 'same', 'rule': same_rule, 'depth': 1, 'line': l + 2}},
      {{'root': 'viaNear', 'src': 'viaNear', 'dst': coalesce(near_ns || '.near', 'near'), 'refid': 'near', 'rule': near_rule, 'depth': 1, 'line': l + 3}},
      {{'root': 'lost', 'src': 'lost', 'dst': 'nowhere' || k, 'refid': 'nowhere' || k, 'rule': 'MISSING', 'depth': 1, 'line': l + 4}}], recursive := true)) x),
    st AS (SELECT s.*, x.* FROM s, LATERAL (SELECT unnest([{{'id': 'list', 'line': l, 'ok': more}}, {{'id': 'uses', 'line': l + 1, 'ok': more}}, {{'id': 'viaSame', 'line': l + 2, 'ok': true}}, {{'id': 'viaNear', 'line': l + 3, 'ok': near_ns IS NOT NULL}},
      {{'id': 'lost', 'line': l + 4, 'ok': true}}, {{'id': 'add', 'line': l + 5, 'ok': true}}, {{'id': 'pick', 'line': l + 6, 'ok': true}}, {{'id': 'bad', 'line': l + 7, 'ok': false}}], recursive := true)) x WHERE x.id <> 'bad' OR s.k % 5 = 0),
    r AS (SELECT s.*, ns || '.' || x.id AS statement, x.* FROM s{made or ", (SELECT NULL AS id) x"}) {body}"""


_OF = "JOIN st ON st.ns = r.ns AND st.id = r.id AND st.ok"
_TABLES = [("'list'", "'T' || k % 4", "'a'", "'READ'", "false"), ("'list'", "'U' || k % 3", "'b'", "'READ'", "false"), ("'uses'", "'T' || k % 4", "'a'", "'READ'", "false"), ("'viaSame'", "'T0'", "'a'", "'READ'", "false"), ("'viaNear'", "'T1'", "'a'", "'READ'", "false"), ("'lost'", "'T2'", "'a'", "'READ'", "false"), ("'add'", "'W' || k % 3", "NULL", "'CREATE'", "false"), ("'pick'", "'V'", "'a'", "'READ'", "false"), ("'pick'", "'V_OLD' || k % 2", "'a'", "'READ'", "false"), ("'pick'", "'Z' || k % 6", "NULL", "'READ'", "false"), ("'pick'", "'Y'", "NULL", "'READ'", "false"), ("'pick'", "'x'", "'x'", "'READ'", "true")]
_COLUMNS = [
    ("'list'", "'T' || k % 4", "'C' || k % 9", "'SELECT'"), ("'list'", "'T' || k % 4", "'NAME'", "'SELECT'"), *[("'list'", "'T' || k % 4", f"'{c}'", "'WHERE'") for c in ("ID", "F", "D", "P")], ("'list'", "'U' || k % 3", "'ID'", "'WHERE'"),
    ("'uses'", "'T' || k % 4", "'ID'", "'SELECT'"), ("'uses'", "'T' || k % 4", "'U'", "'WHERE'"), ("'viaSame'", "'T0'", "'ID'", "'SELECT'"), ("'viaSame'", "'T0'", "'S'", "'WHERE'"), ("'viaNear'", "'T1'", "'ID'", "'SELECT'"), ("'viaNear'", "'T1'", "'N'", "'WHERE'"),
    ("'lost'", "'T2'", "'ID'", "'SELECT'"), ("'lost'", "'T2'", "'ID'", "'WHERE'"), ("'add'", "'W' || k % 3", "'A'", "'INSERT'"), ("'add'", "'W' || k % 3", "'B'", "'INSERT'"), ("'pick'", "'Z' || k % 6", "'ID'", "'SELECT'"), ("'pick'", "'Z' || k % 6", "'Z'", "'SELECT'"), ("'pick'", "'Z' || k % 6", "'ID'", "'GROUP_BY'"),
    *[("'pick'", t, f"'{c}'", f"'{u}'") for t in ("'V'", "'V_OLD' || k % 2") for c, u in (("ID", "JOIN"), ("X", "SELECT"), ("K", "WHERE"), ("X", "ORDER_BY"))], ("'pick'", "'x'", "'ID'", "'JOIN'"), ("'pick'", "'x'", "'M'", "'SELECT'"), ("'pick'", "'Y'", "'K'", "'SELECT'"),
]
_PICK = "'SELECT a.X, x.M FROM V' || {} || ' a LEFT JOIN (SELECT ID, MAX(Z) AS M FROM Z' || k % 6 || ' GROUP BY ID) x ON a.ID = x.ID WHERE a.K IN (SELECT K FROM Y) ORDER BY a.X'"
_TEXTS = [
    ("'list'", "'SELECT a.C' || k % 9 || ', a.NAME FROM T' || k % 4 || ' a, U' || k % 3 || ' b WHERE a.ID = b.ID AND ' || CASE WHEN more THEN 'a.F = ''Y'' ' ELSE '' END || 'AND a.D = 1 AND a.P = ?'", "NULL"),
    ("'uses'", "'SELECT a.ID FROM T' || k % 4 || ' a WHERE' || CASE WHEN more THEN ' a.U = ' || (k + 1) ELSE '' END", "NULL"), ("'viaSame'", "'SELECT a.ID FROM T0 a WHERE a.S = 1'", "NULL"),
    ("'viaNear'", "'SELECT a.ID FROM T1 a WHERE' || coalesce(' a.N = ' || near_ns[2:], '')", "NULL"), ("'lost'", "'SELECT a.ID FROM T2 a WHERE a.ID > 0'", "NULL"), ("'add'", "'INSERT INTO W' || k % 3 || ' (A, B) VALUES (?, ?)'", "NULL"),
    ("'pick'", _PICK.format("''"), "''"), ("'pick'", _PICK.format("'_OLD' || k % 2"), "'EQUAL old Y'"), ("'bad'", "'SELECT FROM WHERE ' || k", "NULL"),
]
_MISSING = "CASE WHEN e.rule = 'MISSING' THEN 'MISSING' ELSE 'RESOLVED' END"

QUERIES: dict[str, tuple[Callable, str]] = {
    "d_copies": (lambda spark, sf_dir: project(spark, sf_dir).copies, _sql("SELECT 'target/classes/' || f AS source_file, f AS copy_of FROM s WHERE k % 7 = 0")),
    "d_symbols": (
        lambda spark, sf_dir: project(spark, sf_dir).registered.select("qid", "kind"),
        _sql("SELECT ns || '.' || id AS qid, 'STATEMENT' AS kind FROM st UNION ALL SELECT ns || '.' || x.id, x.kind FROM r x WHERE there", *[(f"'{i}'", "'RESULT_MAP'", "true") for i in ("base", "row")], *[(f"'{i}'", "'SQL_FRAGMENT'", "true") for i in ("cols", "deep", "flag")], ("'only' || k", "'SQL_FRAGMENT'", "true"), ("'same'", "'SQL_FRAGMENT'", "k % 10 = 0"), ("'near'", "'SQL_FRAGMENT'", "k % 4 = 0"), columns="id kind there"),
    ),
    "d_statements": (lambda spark, sf_dir: project(spark, sf_dir).statements.select("qid", "source_file", "type", "line"), _sql("SELECT ns || '.' || id AS qid, f AS source_file, CASE WHEN id = 'add' THEN 'INSERT' ELSE 'SELECT' END AS type, line FROM st")),
    "d_include_tree": (
        lambda spark, sf_dir: project(spark, sf_dir).include_tree.select("root", "src", "dst", "refid", "rule", "depth", "status", "source_line", "from_file"),
        _sql(f"SELECT root, src, dst, refid, rule, depth, {_MISSING} AS status, line AS source_line, f AS from_file FROM e"),
    ),
    "d_include_closure": (_tree(lambda p: resolve.include_closure(p.include_tree)), _sql("SELECT root, dst AS fragment FROM e WHERE rule <> 'MISSING'")),
    "d_include_usage": (_tree(lambda p: resolve.include_usage(p.include_tree)), _sql("SELECT dst AS fragment, count(DISTINCT root) AS n_statements FROM e WHERE rule <> 'MISSING' GROUP BY dst")),
    "d_includers": (_tree(lambda p: resolve.includers(p.include_tree, p.statements)), _sql("SELECT dst AS fragment, root AS statement, f AS source_file FROM e WHERE rule <> 'MISSING'")),
    "d_include_sites": (_tree(lambda p: resolve.include_sites(p.edges)), _sql("SELECT dst AS fragment, src AS owner, f AS source_file, line, refid FROM e WHERE rule <> 'MISSING'")),
    "d_dependency_edges": (
        _tree(lambda p: p.dependency_edges),
        _sql("""SELECT src, dst, CASE WHEN rule = 'MISSING' THEN 'INCLUDE_MISSING' ELSE 'INCLUDE' END AS kind FROM e UNION ALL SELECT ns || '.list', ns || '.row', 'RESULT_MAP' FROM s
          UNION ALL SELECT ns || '.row', CASE WHEN k % 3 = 1 THEN 's' || (k + 1) || '.row' ELSE ns || '.base' END, 'EXTENDS' FROM s WHERE k % 3 <> 1 OR more"""),
    ),
    "d_neighbours": (_tree(lambda p: resolve.neighbours(p.dependency_edges, "s1.flag").unionByName(resolve.neighbours(p.dependency_edges, "s1.list"))), _sql("SELECT 'in' AS direction, 's0.deep' AS other, 'INCLUDE' AS kind FROM s WHERE k = 0 UNION ALL SELECT 'out', x.id, x.kind FROM r x WHERE k = 1", ("'s1.cols'", "'INCLUDE'"), ("'s1.deep'", "'INCLUDE'"), ("'s1.row'", "'RESULT_MAP'"), columns="id kind")),
    "d_extends": (
        _tree(lambda p: resolve.extends_chains(p.map_references)),
        _sql("SELECT ns || '.row' AS source, ns || '.base' AS target, 1 AS depth FROM s WHERE k % 3 <> 1 UNION ALL SELECT ns || '.row', 's' || (k + 1) || x.id, x.d FROM r x WHERE k % 3 = 1 AND more", ("'.row'", "1"), ("'.base'", "2"), columns="id d"),
    ),
    "d_map_references": (
        _tree(lambda p: p.map_references.select("src", "dst", "kind", "found")),
        _sql("""SELECT ns || '.list' AS src, ns || '.row' AS dst, 'RESULT_MAP' AS kind, true AS found FROM s UNION ALL SELECT ns || '.lost', 'gone' || k, 'RESULT_MAP', false FROM s
          UNION ALL SELECT ns || '.row', CASE WHEN k % 3 = 1 THEN 's' || (k + 1) || '.row' ELSE ns || '.base' END, 'EXTENDS', k % 3 <> 1 OR more FROM s"""),
    ),
    "d_result_map_users": (
        _tree(reports.result_map_users),
        _sql("SELECT ns || '.row' AS result_map, ns || '.list' AS statement FROM s UNION ALL SELECT ns || '.base', ns || '.list' FROM s WHERE k % 3 <> 1 UNION ALL SELECT 's' || (k + 1) || x.id, ns || '.list' FROM r x WHERE k % 3 = 1 AND more", ("'.row'",), ("'.base'",), columns="id"),
    ),
    "d_qualification": (
        _tree(lambda p: resolve.qualification(p.include_tree, p.owners).select("owner", "refid", "target", "must_qualify", "conflict")),
        _sql("SELECT src AS owner, refid, dst AS target, NOT contains(refid, '.') AND dst <> ns || '.' || refid AS must_qualify, false AS conflict FROM e WHERE rule <> 'MISSING'"),
    ),
    "d_dependency_tree": (
        lambda spark, sf_dir: reports.dependency_tree(project(spark, sf_dir), "s1.list"),
        _sql("SELECT x.kind, x.id AS target, x.d AS depth, 'RESOLVED' AS status FROM r x WHERE k = 1", ("'INCLUDE'", "'s1.cols'", "1"), ("'INCLUDE'", "'s1.deep'", "1"), ("'INCLUDE'", "'s2.flag'", "2"), ("'RESULT_MAP'", "'s1.row'", "1"), ("'EXTENDS'", "'s2.row'", "2"), ("'EXTENDS'", "'s2.base'", "3"), columns="kind id d"),
    ),
    "d_problems": (
        _tree(lambda p: p.problems.groupBy("severity", "code", "source_file").agg(F.count("*").alias("n"))),
        _sql("""SELECT severity, code, f AS source_file, count(*) AS n FROM (
          SELECT 'ERROR' AS severity, 'MISSING_REFERENCE' AS code, f FROM e WHERE rule = 'MISSING' UNION ALL SELECT 'ERROR', 'MISSING_REFERENCE', f FROM s WHERE k % 3 = 1 AND NOT more
          UNION ALL SELECT 'ERROR', 'MISSING_RESULT_MAP_REFERENCE', f FROM s UNION ALL SELECT 'WARNING', 'RAW_SQL_SUBSTITUTION', f FROM s UNION ALL SELECT 'WARNING', 'SQL_PARSE_FAILED', f FROM st WHERE NOT ok
          UNION ALL SELECT 'WARNING', 'REFID_' || rule, f FROM e WHERE rule IN ('DUPLICATE_SAME', 'NEAREST_DUPLICATE')) GROUP BY ALL"""),
    ),
    "d_texts": (
        _tree(lambda p: p.rendered.select("statement", F.explode("variants").alias("v")).select("statement", "v.sql", F.get("v.choices", F.lit(0))["label"].alias("label"))),
        _sql('SELECT statement, "sql", label FROM r WHERE r.id <> \'bad\' OR k % 5 = 0', *_TEXTS, columns="id sql label"),
    ),
    "d_conditions": (
        _tree(lambda p: assemble.dynamic_conditions(p.rendered).select("statement", "kind", "condition", "property", "compare_value", "prepend", "text", "source_line")),
        _sql("SELECT statement, 'CONDITION' AS kind, condition, property, compare_value, prepend, text, line AS source_line FROM r", ("'list'", "'IS_NOT_NULL'", "'p' || k % 5", "NULL", "'AND'", "'a.P = #p' || k % 5 || ':INTEGER#'", "l"), ("'pick'", "'EQUAL'", "'old'", "'Y'", "NULL", "'_OLD' || k % 2", "l + 6"), columns="id condition property compare_value prepend text line"),
    ),
    "d_parameters": (
        _tree(lambda p: assemble.parameter_usages(p.rendered).select("statement", "name", "binding", "used_in", "jdbc_type", "null_value", "condition", "risk")),
        _sql("SELECT statement, name, binding, used_in, jdbc_type, null_value, condition, risk FROM r", ("'list'", "'p' || k % 5", "'HASH'", "'WHERE'", "'INTEGER'", "NULL", "'IS_NOT_NULL'", "NULL"), ("'add'", "'a'", "'HASH'", "'INSERT_VALUE'", "'VARCHAR'", "'NONE'", "NULL", "NULL"), ("'add'", "'raw'", "'DOLLAR'", "'INSERT_VALUE'", "NULL", "NULL", "NULL", "'SQL_INJECTION'"), columns="id name binding used_in jdbc_type null_value condition risk"),
    ),
    "d_tables": (_facts("tables", "table", "alias", "operation", "derived"), _sql(f'SELECT statement, r."table", alias, operation, derived FROM r {_OF}', *_TABLES, columns="id table alias operation derived")),
    "d_columns": (_facts("columns", "table", "column", "used_in"), _sql(f'SELECT statement, r."table", r."column", used_in FROM r {_OF}', *_COLUMNS, columns="id table column used_in")),
    "d_joins": (
        _facts("joins", "left_table", "right_table", "type", "right_derived"),
        _sql(f"SELECT statement, left_table, right_table, r.type, right_derived FROM r {_OF}", ("'list'", "'T' || k % 4", "'U' || k % 3", "'IMPLICIT_JOIN'", "false"), ("'pick'", "'V'", "'x'", "'LEFT_JOIN'", "true"), ("'pick'", "'V_OLD' || k % 2", "'x'", "'LEFT_JOIN'", "true"), columns="id left_table right_table type right_derived"),
    ),
    "d_predicates": (
        _facts("predicates", "node", "parent", "kind", "op", "left", "right", "right_kind"),
        _sql(
            f'SELECT statement, node, parent, r.kind, op, r."left", r."right", right_kind FROM r {_OF}',
            ("'list'", "0", "NULL", "'AND'", "NULL", "NULL", "NULL", "NULL"), ("'list'", "1", "0", "'COMPARISON'", "'='", "'a.ID'", "'b.ID'", "'COLUMN'"), ("'list'", "2", "0", "'COMPARISON'", "'='", "'a.F'", "'''Y'''", "'LITERAL'"), ("'list'", "3", "0", "'COMPARISON'", "'='", "'a.D'", "'1'", "'LITERAL'"), ("'list'", "4", "0", "'COMPARISON'", "'='", "'a.P'", "'?'", "'PARAMETER'"),
            ("'uses'", "0", "NULL", "'COMPARISON'", "'='", "'a.U'", "(k + 1)::VARCHAR", "'LITERAL'"), ("'viaSame'", "0", "NULL", "'COMPARISON'", "'='", "'a.S'", "'1'", "'LITERAL'"), ("'viaNear'", "0", "NULL", "'COMPARISON'", "'='", "'a.N'", "near_ns[2:]", "'LITERAL'"), ("'lost'", "0", "NULL", "'COMPARISON'", "'>'", "'a.ID'", "'0'", "'LITERAL'"), ("'pick'", "0", "NULL", "'COMPARISON'", "'IN'", "'a.K'", "'(SELECT ...)'", "'SUBQUERY'"),
            columns="id node parent kind op left right right_kind",
        ),
    ),
    "d_selects": (
        _tree(lambda p: p.facts("selects").select("statement", "select_id", "parent_id", "role", "origin", "depth", F.concat_ws(",", "group_by").alias("groups"), F.concat_ws(",", "order_by").alias("orders"))),
        _sql(
            f"SELECT statement, select_id, parent_id, role, origin, depth, groups, orders FROM r {_OF}", *[(f"'{i}'", "'MAIN'", "NULL", "'MAIN'", "'ROOT'", "0", "''", "''") for i in ("list", "uses", "viaSame", "viaNear", "lost")], ("'add'", "'MAIN'", "NULL", "'WRITE'", "'INSERT'", "0", "''", "''"),
            ("'pick'", "'MAIN'", "NULL", "'MAIN'", "'ROOT'", "0", "''", "'a.X'"), ("'pick'", "'S1'", "'MAIN'", "'DERIVED'", "'FROM'", "1", "'ID'", "''"), ("'pick'", "'S2'", "'MAIN'", "'SUBQUERY'", "'WHERE'", "1", "''", "''"), columns="id select_id parent_id role origin depth groups orders",
        ),
    ),
    "d_outputs": (
        _facts("outputs", "select_id", "ord", "name", "expression", "aggregate", "source_table", "source_select"),
        _sql(
            f"SELECT statement, select_id, ord, name, expression, aggregate, source_table, source_select FROM r {_OF}",
            ("'list'", "'MAIN'", "0", "'C' || k % 9", "'a.C' || k % 9", "false", "'T' || k % 4", "NULL"), ("'list'", "'MAIN'", "1", "'NAME'", "'a.NAME'", "false", "'T' || k % 4", "NULL"), *[(f"'{i}'", "'MAIN'", "0", "'ID'", "'a.ID'", "false", t, "NULL") for i, t in (("uses", "'T' || k % 4"), ("viaSame", "'T0'"), ("viaNear", "'T1'"), ("lost", "'T2'"))],
            ("'add'", "'MAIN'", "0", "'A'", "'?'", "false", "NULL", "NULL"), ("'add'", "'MAIN'", "1", "'B'", "'?'", "false", "NULL", "NULL"), ("'pick'", "'MAIN'", "0", "'X'", "'a.X'", "false", "'V'", "NULL"), ("'pick'", "'MAIN'", "1", "'M'", "'x.M'", "false", "'x'", "'S1'"),
            ("'pick'", "'S1'", "0", "'ID'", "'ID'", "false", "'Z' || k % 6", "NULL"), ("'pick'", "'S1'", "1", "'M'", "'MAX(Z)'", "true", "'Z' || k % 6", "NULL"), ("'pick'", "'S2'", "0", "'K'", "'K'", "false", "'Y'", "NULL"), columns="id select_id ord name expression aggregate source_table source_select",
        ),
    ),
    "d_lineage": (
        _tree(lambda p: p.facts("lineage").select("statement", "output", "table", "column", F.concat_ws(" ", "path").alias("path"), "hops")),
        _sql(
            f'SELECT statement, output, r."table", r."column", path, hops FROM r {_OF}', ("'list'", "'C' || k % 9", "'T' || k % 4", "'C' || k % 9", "'MAIN.C' || k % 9", "0"), ("'list'", "'NAME'", "'T' || k % 4", "'NAME'", "'MAIN.NAME'", "0"),
            *[(f"'{i}'", "'ID'", t, "'ID'", "'MAIN.ID'", "0") for i, t in (("uses", "'T' || k % 4"), ("viaSame", "'T0'"), ("viaNear", "'T1'"), ("lost", "'T2'"))], ("'pick'", "'X'", "'V'", "'X'", "'MAIN.X'", "0"), ("'pick'", "'M'", "'Z' || k % 6", "'Z'", "'MAIN.M S1.M'", "1"), columns="id output table column path hops",
        ),
    ),
    "d_counts": (_tree(reports.statement_counts), _sql("SELECT ns || '.' || id AS statement, CASE WHEN NOT ok THEN 0 WHEN id = 'pick' THEN 3 ELSE 1 END::INTEGER AS selects, CASE WHEN id = 'pick' THEN 2 ELSE 0 END::INTEGER AS subqueries, 0 AS unions, 0 AS ctes, CASE WHEN id = 'pick' THEN 2 WHEN id = 'list' AND ok THEN 1 ELSE 0 END::INTEGER AS joins FROM st")),
    "d_table_report": (
        _tree(lambda p: reports.table_report(p).select("table", "operation", F.concat_ws(",", "statements").alias("statements"))),
        _sql(f'SELECT r."table", operation, string_agg(DISTINCT statement, \',\' ORDER BY statement) AS statements FROM r {_OF} WHERE NOT derived GROUP BY 1, 2', *_TABLES, columns="id table alias operation derived"),
    ),
    "d_column_report": (_tree(reports.column_report), _sql(f'SELECT r."table", r."column", used_in, count(DISTINCT statement) AS n_statements FROM r {_OF} WHERE r."table" <> \'x\' GROUP BY 1, 2, 3', *_COLUMNS, columns="id table column used_in")),
    "d_table_graph": (
        _tree(lambda p: reports.table_graph(p).select("left_table", "right_table", F.concat_ws(",", "statements").alias("statements"))),
        _sql("SELECT 'T' || k % 4 AS left_table, 'U' || k % 3 AS right_table, string_agg(ns || '.list', ',' ORDER BY ns || '.list') AS statements FROM s WHERE more GROUP BY 1, 2"),
    ),
    "d_mapper_report": (
        _tree(lambda p: reports.mapper_report(p).select("source_file", "selects", "inserts", "fragments", "result_maps", F.concat_ws(",", "tables").alias("tables"), "warnings", "errors")),
        _sql(f"""SELECT f AS source_file, 6 + (k % 5 = 0)::INTEGER AS selects, 1::BIGINT AS inserts, 4 + (k % 10 = 0)::INTEGER + (k % 4 = 0)::INTEGER AS fragments, 2::BIGINT AS result_maps,
          (SELECT string_agg(DISTINCT r."table", ',' ORDER BY r."table") FROM r {_OF} WHERE r.k = s.k AND NOT derived) AS tables,
          1 + (SELECT count(*) FROM st WHERE st.k = s.k AND NOT ok) + (same_rule = 'DUPLICATE_SAME')::INTEGER + (near_rule = 'NEAREST_DUPLICATE')::INTEGER AS warnings,
          1 + (SELECT count(*) FROM e WHERE e.k = s.k AND rule = 'MISSING') + (k % 3 = 1 AND NOT more)::INTEGER AS errors FROM s""", *_TABLES, columns="id table alias operation derived"),
    ),
    "d_index_summary": (_tree(reports.index_summary), _sql("SELECT ns AS namespace, 1::BIGINT AS files, 7 + (k % 5 = 0)::INTEGER AS statements, 4 + (k % 10 = 0)::INTEGER + (k % 4 = 0)::INTEGER AS fragments, 2::BIGINT AS result_maps FROM s")),
    "d_namespaces": (_tree(lambda p: catalog.namespaces(p.owners).select("namespace", "n_files", F.concat_ws(",", "files").alias("files"))), _sql("SELECT ns AS namespace, 13 + (k % 10 = 0)::INTEGER + (k % 4 = 0)::INTEGER + (k % 5 = 0)::INTEGER AS n_files, f AS files FROM s")),
    "d_rename_events": (
        lambda spark, sf_dir: renamed(spark, sf_dir)[1].groupBy("owner", "code", "grade", "original", "replacement").agg(F.count("*").alias("n")),
        _sql("""SELECT ns || '.' || x.id AS owner, code, CASE WHEN code IN ('TABLE_RENAMED', 'COLUMN_RENAMED') THEN 'SAFE' ELSE 'WARNING' END AS grade, original, replacement, 1::BIGINT AS n FROM r x WHERE there""", ("'viaSame'", "'RESULT_COLUMN_RENAMED'", "'ID'", "'KEY_ID'", "true"), ("'uses'", "'RESULT_COLUMN_RENAMED'", "'ID'", "'KEY_ID'", "k % 4 = 0"), ("'add'", "'RUNTIME_SUBSTITUTION'", "'$raw$'", "NULL", "true"), *[(i, c, o, n, w) for i, w in (("'viaSame'", "true"), ("'uses'", "k % 4 = 0"), ("'list'", "k % 4 = 0")) for c, o, n in (("'TABLE_RENAMED'", "'T0'", "'N0'"), ("'COLUMN_RENAMED'", "'ID'", "'KEY_ID'"))], ("'add'", "'TABLE_RENAMED'", "'W1'", "'N1'", "k % 3 = 1"), ("'add'", "'COLUMN_RENAMED'", "'A'", "'ALPHA'", "k % 3 = 1"), columns="id code original replacement there"),
    ),
    "d_rename_texts": (
        lambda spark, sf_dir: own_text(renamed(spark, sf_dir)[0], "uses", "add", "viaSame"),
        _sql("SELECT ns || '.' || x.id AS qid, text FROM r x", ("'viaSame'", "'SELECT a.KEY_ID FROM N0 a WHERE '"), ("'uses'", "CASE WHEN k % 4 = 0 THEN 'SELECT a.KEY_ID FROM N0 a WHERE ' ELSE 'SELECT a.ID FROM T' || k % 4 || ' a WHERE ' END"), ("'add'", "CASE WHEN k % 3 = 1 THEN 'INSERT INTO N1 (ALPHA, B)' ELSE 'INSERT INTO W' || k % 3 || ' (A, B)' END || ' VALUES (#a:VARCHAR:NONE#, $raw$)'"), columns="id text"),
    ),
    "d_rename_safety": (
        lambda spark, sf_dir: reports.safety(renamed(spark, sf_dir)[1]),
        _sql("SELECT ns || '.' || x.id AS owner, safe::BIGINT AS \"SAFE\", warned::BIGINT AS \"WARNING\", 0::BIGINT AS \"MANUAL\", 0::BIGINT AS \"ERROR\" FROM r x WHERE safe + warned > 0", ("'viaSame'", "2", "1"), ("'uses'", "CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END", "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END"), ("'list'", "CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END", "0"), ("'add'", "CASE WHEN k % 3 = 1 THEN 2 ELSE 0 END", "1"), columns="id safe warned"),
    ),
    "d_conversion_events": (
        lambda spark, sf_dir: converted(spark, sf_dir)[1].groupBy("owner", "code", "grade").agg(F.count("*").alias("n")),
        _sql(
            "SELECT ns || '.' || x.id AS owner, x.code, x.grade, x.c::BIGINT AS n FROM r x", ("'base'", "'RESULT_MAP_CONVERTED'", "'SAFE'", "1"), ("'row'", "'RESULT_MAP_CONVERTED'", "'SAFE'", "1"), ("'deep'", "'INCLUDE_KEPT'", "'SAFE'", "1"), ("'list'", "'INCLUDE_KEPT'", "'SAFE'", "2"), ("'list'", "'CONDITIONAL_TO_IF'", "'SAFE'", "1"), ("'list'", "'HASH_PARAMETER'", "'SAFE'", "1"),
            ("'uses'", "CASE WHEN more THEN 'REFERENCE_QUALIFIED' ELSE 'INCLUDE_KEPT' END", "'SAFE'", "1"), ("'viaSame'", "CASE WHEN k % 10 = 0 THEN 'INCLUDE_KEPT' ELSE 'REFERENCE_QUALIFIED' END", "'SAFE'", "1"), ("'viaNear'", "CASE WHEN near_ns <> ns THEN 'REFERENCE_QUALIFIED' ELSE 'INCLUDE_KEPT' END", "'SAFE'", "1"), ("'lost'", "'INCLUDE_KEPT'", "'SAFE'", "1"),
            ("'add'", "'HASH_PARAMETER'", "'SAFE'", "1"), ("'add'", "'UNSUPPORTED_NULL_VALUE'", "'MANUAL'", "1"), ("'add'", "'RAW_SQL_SUBSTITUTION'", "'WARNING'", "1"), ("'pick'", "'CONDITIONAL_TO_IF'", "'SAFE'", "1"), columns="id code grade c",
        ),
    ),
    "d_fragment_contexts": (
        lambda spark, sf_dir: in_context(spark, sf_dir)[1].where("owner LIKE '%.flag' OR owner LIKE '%.only%'").select("owner", "code", "grade", "original", "replacement"),
        _sql("""SELECT ns || '.' || x.id AS owner, x.code, x.grade, x.old AS original, x.new AS replacement FROM r x WHERE (k - 1) % 4 = 0 AND k - 1 IN (SELECT s_suppkey FROM supplier) AND x.new IS NOT NULL
          OR k - 1 NOT IN (SELECT s_suppkey FROM supplier) AND x.new IS NULL""", *[(i, c, "'SAFE'", o, n) for i, o, n in (("'flag'", "'F'", "'FLAG'"), ("'only' || k", "'U'", "'UNIT'")) for c in ("'COLUMN_RENAMED'", "'FRAGMENT_CONTEXT_INFERRED'")], ("'flag'", "'UNRESOLVED_QUALIFIER'", "'WARNING'", "'a.F'", "NULL"), ("'only' || k", "'UNRESOLVED_QUALIFIER'", "'WARNING'", "'a.U'", "NULL"), columns="id code grade old new"),
    ),
    "d_migration_summary": (
        lambda spark, sf_dir: reports.migration_summary(in_context(spark, sf_dir)[1], project(spark, sf_dir).include_tree, project(spark, sf_dir).statements).where("statement LIKE '%.list' OR statement LIKE '%.uses'"),
        _sql("SELECT statement, 3::BIGINT AS \"SAFE\", 0::BIGINT AS \"WARNING\", 0::BIGINT AS \"MANUAL\", 0::BIGINT AS \"ERROR\" FROM r x WHERE k % 4 = 0 AND more UNION ALL SELECT statement, 1, 0, 0, 0 FROM r x WHERE k % 4 = 0 AND NOT more", ("'list'",), ("'uses'",), columns="id"),
    ),
    "d_usage": (
        _tree(lambda p: migrate.usage(p.rendered, p.analysed, MAPPING)),
        _sql(f'SELECT statement, r."table", operation, CASE WHEN r."table" IN (\'T0\', \'W1\') THEN \'MAPPED\' ELSE \'UNMAPPED\' END AS verdict FROM r {_OF} WHERE NOT derived', *_TABLES, columns="id table alias operation derived"),
    ),
    "d_search": (
        _tree(lambda p: reports.search(p.indexed(), "w2 (a", 1_000_000).select("source_file", "line", "owner", "kind", "text", "reason")),
        _sql("""SELECT f AS source_file, l + 5 AS line, ns || '.add' AS owner, 'STATEMENT' AS kind, '<insert id="add">INSERT INTO W2 (A, B) VALUES (#a:VARCHAR:NONE#, $raw$)</insert>' AS text, 'text' AS reason FROM s WHERE k % 3 = 2
          UNION ALL SELECT 'target/classes/' || f, l + 5, NULL, NULL, '<insert id="add">INSERT INTO W2 (A, B) VALUES (#a:VARCHAR:NONE#, $raw$)</insert>', 'text' FROM s WHERE k % 3 = 2 AND k % 7 = 0"""),
    ),
    "d_column_guide": (
        _tree(lambda p: reports.column_guide(p, "T3", "U").select("action", "statement", "owner", "source_file", "line", "detail")),
        _sql("""SELECT x.action, ns || '.uses' AS statement, x.owner, CASE WHEN x.action = 'REMOVE_FRAGMENT' THEN (SELECT n.f FROM s n WHERE n.k = x.k + 1) ELSE f END AS source_file, x.line, x.detail FROM r x WHERE k % 4 = 3 AND more""",
          ("'uses'", "'CHECK_REFERENCE'", "ns || '.uses'", "l + 1", "'WHERE'"), ("'uses'", "'REMOVE_FRAGMENT'", "'s' || (k + 1) || '.only' || (k + 1)", "5", "'1 statements'"), ("'uses'", "'REMOVE_INCLUDE'", "ns || '.uses'", "l + 1", "'only' || (k + 1)"), columns="id action owner line detail"),
    ),
    "d_older_xml": (
        lambda spark, sf_dir: xml_pieces(renamed(spark, sf_dir)[0]),
        _sql("""SELECT f AS source_file, 'ibatis' AS dialect, CASE WHEN k % 3 = 1 THEN 'INSERT INTO N1 (ALPHA, B)' ELSE 'INSERT INTO W' || k % 3 || ' (A, B)' END || ' VALUES (#a:VARCHAR:NONE#, $raw$)' AS add_text,
          CASE WHEN k % 4 = 0 THEN 'SELECT a.KEY_ID FROM N0' ELSE 'SELECT a.ID FROM T' || k % 4 END || ' a WHERE <include refid="only' || (k + 1) || '"/>' AS uses_text FROM s"""),
    ),
    "d_newer_xml": (
        lambda spark, sf_dir: xml_pieces(converted(spark, sf_dir)[0]),
        _sql("""SELECT f AS source_file, 'mybatis' AS dialect, 'INSERT INTO W' || k % 3 || ' (A, B) VALUES (#{a,jdbcType=VARCHAR}, ${raw})' AS add_text,
          'SELECT a.ID FROM T' || k % 4 || ' a WHERE <include refid="' || CASE WHEN more THEN 's' || (k + 1) || '.' ELSE '' END || 'only' || (k + 1) || '"/>' AS uses_text FROM s"""),
    ),
}

import random

import pytest

from mapperlake.operators import resolve
from mapperlake.operators.convert import convert_tree
from mapperlake.operators.migrate import apply, migrate_tree
from mapperlake.operators.runtime import render
from mapperlake.plans import migration, reports
from mapperlake.plans.engine import Project
from mapperlake.sinks import mapper_xml
from mapperlake.sources.mappers import Problems, node, read_mapper, to_rows
from mapperlake.sources.mapping import Mapping


def project(spark, **files):
    return Project.upload(spark, {k.replace("__", "/") + ".xml": v for k, v in files.items()})


def ibatis(ns, body):
    return f"<sqlMap namespace='{ns}'>{body}</sqlMap>"


@pytest.fixture(scope="module")
def torture(spark):
    """One small project with every rule of reference resolution."""
    return project(
        spark,
        a__A=ibatis("a", "<select id='s'>S <include refid='own'/><include refid='c.shared'/><include refid='lone'/><include refid='gone'/></select><sql id='own'>o</sql><sql id='inner'>from a</sql><select id='loop'><include refid='l1'/></select><sql id='l1'>x<include refid='l2'/></sql><sql id='l2'>y<include refid='l1'/></sql>"),
        a__Same1=ibatis("s1", "<sql id='same'> x  y </sql>"),
        b__Same2=ibatis("s2", "<sql id='same'>x y</sql>"),
        a__Near=ibatis("n1", "<sql id='near'>1</sql>"),
        b__Far=ibatis("n2", "<sql id='near'>2</sql>"),
        a__Use=ibatis("u", "<select id='t'><include refid='same'/><include refid='near'/></select>"),
        c__C=ibatis("c", "<sql id='shared'>[<include refid='inner'/>]</sql><sql id='inner'>from c</sql><sql id='lone'>L</sql><sql id='GONE'>g</sql><select id='dup'>1</select>"),
        d__D=ibatis("c", "<select id='dup'>2</select>"),
    )


def test_reference_rules(torture):
    got = {(r["root"], r["src"], r["refid"]): (r["dst"], r["rule"], r["status"]) for r in torture.include_tree.collect()}
    assert got["a.s", "a.s", "own"] == ("a.own", "NAMESPACE", "RESOLVED")
    assert got["a.s", "a.s", "c.shared"] == ("c.shared", "QUALIFIED", "RESOLVED")
    assert got["a.s", "a.s", "lone"] == ("c.lone", "GLOBAL_UNIQUE", "RESOLVED")
    assert got["a.s", "a.s", "gone"] == ("gone", "MISSING", "MISSING")
    assert got["a.s", "c.shared", "inner"] == ("a.inner", "RUNTIME_SHADOWED", "RESOLVED")
    assert got["u.t", "u.t", "same"] == ("s1.same", "DUPLICATE_SAME", "RESOLVED")
    assert got["u.t", "u.t", "near"] == ("n1.near", "NEAREST_DUPLICATE", "RESOLVED")
    assert got["a.loop", "a.l2", "l1"] == ("a.l1", "NAMESPACE", "CIRCULAR")


def test_reference_problems_and_tables(torture):
    told = [(r["code"], r["message"]) for r in torture.problems.collect()]
    assert {c for c, _ in told} == {"MISSING_REFERENCE", "CIRCULAR_REFERENCE", "REFID_DUPLICATE_SAME", "REFID_NEAREST_DUPLICATE", "NESTED_REFID_SHADOWED", "DUPLICATE_SYMBOL", "SQL_PARSE_FAILED"}
    assert any("near: c.GONE" in m for c, m in told if c == "MISSING_REFERENCE")
    sql = {r["statement"]: r["variants"][0]["sql"] for r in torture.rendered.collect()}
    assert sql["a.s"] == "S o[from a]L" and sql["u.t"] == "x y 1".replace(" 1", "1") or sql["a.s"].startswith("S o[from a]L")
    assert sql["c.dup"] == "1"  # the first registration
    usage = {r["fragment"]: r["n_statements"] for r in resolve.include_usage(torture.include_tree).collect()}
    assert usage["a.inner"] == 1 and usage["a.l2"] == 1


def test_empty_project(spark):
    p = project(spark, web="<web-app/>")
    assert p.rendered.count() == 0 and p.problems.count() == 0 and reports.project_report(p).count() == 0
    q = Project(p.files.limit(0))
    assert q.mappers.count() == 0 and q.include_tree.count() == 0


def test_extends_and_maps(spark):
    p = project(spark, A=ibatis("a", "<resultMap id='x' extends='y'/><resultMap id='y' extends='z'/><resultMap id='z'/><resultMap id='p' extends='q'/><resultMap id='q' extends='p'/><select id='s' resultMap='x'>SELECT 1 FROM t</select><select id='m' resultMap='none' parameterMap='gone'>SELECT 1</select>"))
    chains = {(r["source"], r["target"], r["depth"]) for r in resolve.extends_chains(p.map_references).collect()}
    assert {("a.x", "a.y", 1), ("a.x", "a.z", 2), ("a.y", "a.z", 1), ("a.p", "a.p", 2)} <= chains
    assert {r["code"] for r in p.problems.collect()} == {"MISSING_RESULT_MAP_REFERENCE", "MISSING_PARAMETER_MAP_REFERENCE", "CIRCULAR_EXTENDS"}
    assert {r["target"] for r in reports.dependency_tree(p, "a.s").collect()} == {"a.x", "a.y", "a.z"}


def test_fragment_renames_follow_their_statements(spark):
    p = project(spark, A=ibatis("a", "<sql id='w'>NO = 1</sql><sql id='two'>YN = 1</sql><select id='s'>SELECT 1 FROM TB_C WHERE <include refid='w'/></select><select id='x'>SELECT 1 FROM TB_C WHERE <include refid='two'/></select><select id='y'>SELECT 1 FROM TB_P WHERE <include refid='two'/></select>"))
    owners, events = migration.renamed(p, {"TB_C": {"targetTable": "customer", "columns": {"NO": "id", "YN": "active"}}, "TB_P": {"targetTable": "product", "columns": {"YN": "sellable"}}})
    text = mapper_xml.documents(owners).first()["xml"]
    assert "id = 1" in text and "YN = 1" in text and "FROM product" in text
    codes = {r["code"] for r in events.collect()}
    assert {"FRAGMENT_CONTEXT_INFERRED", "FRAGMENT_CONTEXT_CONFLICT"} <= codes
    with pytest.raises(ValueError):
        migration.renamed(p, {"1x": {}})


def test_written_mappers_read_back(spark):
    body = "<sql id='f'>a &lt; 1</sql><select id='s' resultClass='map'>SELECT * FROM T<isEqual property='k' compareValue='Y'>_X</isEqual> <dynamic prepend='WHERE'><isNotNull prepend='AND' property='a'>a = #a#</isNotNull><iterate property='l' prepend='AND' open='b IN (' close=')' conjunction=','>#l[]#</iterate></dynamic></select>"
    p = project(spark, A=ibatis("a", body))
    text = mapper_xml.documents(p.owners).first()["xml"]
    again = read_mapper(text, Problems())
    s = next(o for o in again["owners"] if o["id"] == "s")
    params = {"a": 1, "l": [2, 3], "k": "Y"}
    assert "".join(render(s["nodes"], params, "ibatis")[0].split()) == "".join(p.sql("a.s", params)[0].split()) and "T_X" in render(s["nodes"], params, "ibatis")[0]
    owners, _ = migration.converted(p)
    newer = read_mapper(mapper_xml.documents(owners).first()["xml"], Problems())
    s = next(o for o in newer["owners"] if o["id"] == "s")
    assert newer["dialect"] == "mybatis" and render(s["nodes"], params, "mybatis")[1] == [1, 2, 3]


def _grow(r, depth, lead):
    out = []
    for _ in range(r.randint(1, 3)):
        x = r.random()
        if depth == 0 or x < 0.35:
            out.append(node("Text", 1, text=f" c{r.randint(0, 99)} = #{r.choice(['s1', 'n1'])}# "))
        elif x < 0.75:
            kind = r.choice(["IS_NULL", "IS_NOT_NULL", "IS_EMPTY", "IS_NOT_EMPTY", "EQUAL", "NOT_EQUAL", "GREATER_THAN", "LESS_EQUAL"])
            prop = r.choice(["n1", "n2"]) if kind in ("GREATER_THAN", "LESS_EQUAL") else r.choice(["s1", "s2"]) if "EMPTY" in kind else r.choice(["s1", "s2", "n1", "n2"])
            value = (r.choice(["1", "5"]) if prop[0] == "n" else r.choice(["Y", "abc"])) if "NULL" not in kind and "EMPTY" not in kind else None
            out.append(node("Conditional", 1, _grow(r, depth - 1, r.choice([lead, "OR"])), condition=kind, property=prop, compareValue=value, prepend=lead if r.random() < 0.8 else None))
        else:
            out.append(node("Iterate", 1, [node("Text", 1, text="#l1[]#")], property="l1", open="c IN (", close=")", conjunction=",", prepend=r.choice([lead, None])))
    return out


def _params(r):
    return {k: r.choice(v) for k, v in {"s1": ["Y", "abc", "", None], "s2": ["q", "", None], "n1": [1, 5, 9, None], "n2": [0, 5, None], "l1": [[], [1], [1, 2], None]}.items()}


def test_conversion_renders_alike():
    r = random.Random(11)
    for _ in range(600):
        t = [node("Text", 1, text="SELECT 1 FROM t "), node("Dynamic", 1, _grow(r, r.randint(1, 3), "AND"), prepend="WHERE")]
        new = convert_tree(t)
        for _ in range(4):
            p = _params(r)
            a, b = render(t, p, "ibatis"), render(new, p, "mybatis")
            assert "".join(a[0].split()) == "".join(b[0].split()) and a[1] == b[1], (p, a, b)


def test_renames_commute_with_conversion():
    r = random.Random(2)
    m = Mapping({"t": {"targetTable": "new_t", "columns": {f"c{k}": f"d{k}" for k in range(0, 99, 2)}}})

    def renamed(nodes):
        rows = to_rows(nodes)
        numbered = __import__("mapperlake.sources.mappers", fromlist=["from_rows"]).from_rows(rows)
        by_node = {}
        for e in migrate_tree(numbered, "o", m)[0]:
            by_node.setdefault(e["node"], []).append(e)
        work = list(numbered)
        while work:
            n = work.pop()
            if n["node_id"] in by_node:
                n["text"] = apply(n["text"], by_node[n["node_id"]])
            work += n["children"]
        return numbered

    for _ in range(150):
        t = [node("Text", 1, text="SELECT c2, c4 FROM t "), node("Dynamic", 1, _grow(r, 2, "AND"), prepend="WHERE")]
        p = _params(r)
        a, b = render(renamed(convert_tree(t)), p, "mybatis"), render(convert_tree(renamed(t)), p, "mybatis")
        assert "".join(a[0].split()) == "".join(b[0].split()) and a[1] == b[1]


def test_stream(spark, tmp_path):
    from mapperlake.streaming.incremental import run_once

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.xml").write_text(ibatis("a", "<select id='s'>SELECT 1</select>"))
    seen = []
    run = lambda: run_once(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda df, n: seen.extend(r["namespace"] for r in df.select("namespace").collect()))
    run()
    (tmp_path / "in" / "B.xml").write_text(ibatis("b", "<select id='s'>SELECT 1</select>"))
    run()
    assert seen == ["a", "b"]


def test_torn_files_are_salvaged_and_projects_closed(spark):
    p = Project.upload(spark, {"torn.xml": "<sqlMap namespace='torn'>" + "<" * 3, "none.xml": "<sqlMap namespace='fine'><select id='a'>SELECT b FROM c</select></sqlMap>"})
    held = p.owners
    assert held.count() == 1 and held.is_cached
    assert {r["source_file"] for r in p.salvaged.collect()} <= {"torn.xml"}
    p.close()
    assert not held.is_cached and p.owners.count() == 1


def test_search_tells_that_it_was_cut(spark):
    p = Project.upload(spark, {"a.xml": "<sqlMap namespace='m'>" + "".join(f"<sql id='word{k}'>word</sql>\n" for k in range(9)) + "</sqlMap>"})
    rows = reports.search(p, "word", 5).collect()
    assert len(rows) == 5 and all(r["truncated"] for r in rows)
    assert not any(r["truncated"] for r in reports.search(p, "word3").collect())


def test_long_chains_and_many_paths(spark):
    """A closure and includes deeper than any fixed limit; fragments that include the next one twice are read once each."""
    from mapperlake.operators import kernels

    chain = spark.createDataFrame([(k, k + 1) for k in range(70)], "src int, dst int")
    got = kernels.closure(chain, spark.createDataFrame([(0,)], "node int"))
    assert got.count() == 70 and got.agg({"depth": "max"}).first()[0] == 70
    parts = [f"<sql id='f{k}'>x{k} <include refid='f{k + 1}'/> <include refid='f{k + 1}'/></sql>" for k in range(12)]
    p = Project.upload(spark, {"a.xml": "<sqlMap namespace='m'>" + "".join(parts) + "<sql id='f12'>end</sql><select id='s'>SELECT <include refid='f0'/></select></sqlMap>"})
    tree = p.include_tree.collect()
    assert len(tree) == 25 and {r["status"] for r in tree} == {"RESOLVED"} and max(r["depth"] for r in tree) == 13


def test_documents_are_written_in_one_pass_of_a_partition(spark):
    """Not a group of pandas for each file; a file whose owners come in several batches is one document."""
    files = {f"f{k}.xml": f'<sqlMap namespace="n{k}">' + "".join(f'<select id="s{i}">SELECT {i} FROM t{k}</select>' for i in range(k)) + "</sqlMap>" for k in range(1, 12)}
    p = Project.upload(spark, files)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        docs = mapper_xml.documents(p.owners.coalesce(1))
        plan = docs._jdf.queryExecution().toString()
        got = {r["source_file"]: r["xml"] for r in docs.collect()}
    finally:
        spark.conf.set(name, before)
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted(got) == sorted(files) and docs.count() == len(files)
    for k in range(1, 12):
        at = [got[f"f{k}.xml"].index(f"SELECT {i} FROM t{k}") for i in range(k)]
        assert at == sorted(at) and got[f"f{k}.xml"].count("<select ") == k and f'namespace="n{k}"' in got[f"f{k}.xml"]

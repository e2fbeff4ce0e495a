"""Statements that unfold far: nothing is lost without a word, and none takes the others with it."""

import itertools
import time

import pytest

from mapperlake.operators import assemble, facts, flatten
from mapperlake.plans import reports
from mapperlake.plans.engine import Project


def text(t):
    return {"type": "Text", "text": t, "attrs": {}, "children": [], "line": 1}


def cond(body, prop):
    return {"type": "Conditional", "text": None, "attrs": {"condition": "IS_NOT_NULL", "property": prop}, "children": [text(body)], "line": 1}


def points(n, join="JOIN"):
    """A statement with n places where one of two tables stands."""
    out = [text("SELECT 1 FROM base b ")]
    for k in range(n):
        out += [text(f" {join} "), cond(f"a{k} x{k} ", "p"), cond(f"b{k} x{k} ", "q"), text(f" ON x{k}.id = b.id ")]
    return out


@pytest.mark.parametrize("sizes", [[2] * 6, [2] * 40, [3] * 7, [5, 2, 3, 4, 2], [20], [2], []])
def test_every_two_choices_meet(sizes):
    rows = list(flatten.combinations(sizes))
    assert len(rows) == len(set(rows)) and all(0 <= k < n for row in rows for k, n in zip(row, sizes))
    for i, j in itertools.combinations(range(len(sizes)), 2):
        assert {(r[i], r[j]) for r in rows} == set(itertools.product(range(sizes[i]), range(sizes[j])))
    assert all({r[i] for r in rows} == set(range(n)) for i, n in enumerate(sizes))


def test_no_table_of_six_points_is_lost():
    done = facts.analyse(flatten.variants(points(6)))
    assert done["error"] is None and {t["table"] for t in done["tables"]} == {"base"} | {f"{x}{k}" for x in "ab" for k in range(6)}
    tables = {(j["left_table"], j["right_table"]) for j in done["joins"]}
    assert {(f"{x}{k}", f"{y}{k + 1}") for x in "ab" for y in "ab" for k in range(5)} <= tables


def test_forty_points_take_under_a_second():
    began = time.perf_counter()
    done = facts.analyse(flatten.variants(points(40)))
    assert time.perf_counter() - began < 2 and len(done["tables"]) == 81


def test_equal_texts_of_many_points_end():
    nodes = [text("SELECT 1 FROM ")] + [y for k in range(35) for y in (cond("t ", "p"), cond("t ", "q"), text(", "), text(" u JOIN "))] + [text("v")]
    assert len(flatten.variants(nodes)) >= 1


def test_facts_of_a_long_chain_take_linear_time():
    sql = "SELECT 1 FROM t WHERE " + " AND ".join(f"c{k} = ?" for k in range(20_000))
    began = time.perf_counter()
    assert len(facts.analyse([{"sql": sql}])["columns"]) == 20_000 and time.perf_counter() - began < 10


def test_a_statement_that_unfolds_too_far_is_a_problem_of_its_own(spark):
    doubling = "".join(f'<sql id="d{k}"><include refid="d{k + 1}"/> <include refid="d{k + 1}"/></sql>' for k in range(18)) + '<sql id="d18">1</sql>'
    n = assemble.MOST_DEPTH + 20
    chain = "".join(f'<sql id="c{k}">,{k} <include refid="c{k + 1}"/></sql>' for k in range(12)) + '<sql id="c12">, x FROM t</sql>'
    deep = "<isNotNull property='p'>" * n + "AND a = 1" + "</isNotNull>" * n
    xml = f"<sqlMap namespace='m'>{doubling}{chain}<select id='wide'>SELECT <include refid='d0'/> FROM t</select><select id='chain'>SELECT 0 <include refid='c0'/></select><select id='deep'>SELECT 1 FROM u WHERE 1 = 1 {deep}</select><select id='fine'>SELECT a FROM v</select></sqlMap>"
    p = Project.upload(spark, {"m.xml": xml})
    assert sorted(r["table"] for r in p.facts("tables").where("statement IN ('m.fine', 'm.chain')").collect()) == ["t", "v"]
    bad = sorted(r["code"] for r in p.problems.where("code IN ('STATEMENT_TOO_LARGE', 'NESTED_TOO_DEEPLY') AND source_file = 'm.xml'").collect())
    assert bad in (["NESTED_TOO_DEEPLY", "STATEMENT_TOO_LARGE"], ["STATEMENT_TOO_LARGE", "STATEMENT_TOO_LARGE"])


def test_search_by_the_index_is_the_scan(spark):
    files = {f"m{k}.xml": f"<sqlMap namespace='n{k}'>\n<sql id='f'>\nword{k % 3} = 1\n</sql>\n<select id='s'>\nSELECT 1 FROM t WHERE\n<include refid='f'/>\nAND Word{k} = 2\n</select>\n</sqlMap>" for k in range(6)}
    p = Project.upload(spark, files)
    scanned = {n: sorted(map(repr, reports.search(p, n).collect())) for n in ("WORD1", "select", "n3", "zz", "<")}
    p.indexed()
    for n, want in scanned.items():
        assert sorted(map(repr, reports.search(p, n).collect())) == want, n
    p.close()
    assert p.text_index is None

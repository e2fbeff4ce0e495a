"""Rendering by sets against single calls, row by row."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from mapperlake.operators.runtime import render
from mapperlake.plans import batch_catalogue, catalogue
from mapperlake.plans.batch import Batch, CannotCompile
from mapperlake.plans.engine import Project

SF = "/root/testdata/sf0.001"
MAPPER = """<sqlMap namespace="b">
<sql id="tail"><isNotNull prepend="AND" property="z">z = #z:INTEGER:-1#</isNotNull></sql>
<select id="s">SELECT x FROM t_$suffix$ <dynamic prepend="WHERE">
<isEqual prepend="AND" property="a" compareValue="10">a = 10</isEqual>
<isNotEqual prepend="AND" property="a" compareProperty="z">a &lt;&gt; #z#</isNotEqual>
<isGreaterThan prepend="AND" property="a" compareValue="9">a &gt; #a# <isEmpty property="name">OR name IS NULL</isEmpty></isGreaterThan>
<isLessEqual prepend="OR" property="name" compareValue="m">name &lt;= #name#</isLessEqual>
<isNotEmpty prepend="AND" property="items">i IN <iterate property="items" open="(" close=")" conjunction=",">#items[]#</iterate></isNotEmpty>
<isNull prepend="AND" property="inner.k">k IS NULL</isNull><isNotNull prepend="AND" property="inner.k">k = #inner.k#</isNotNull>
<isPropertyAvailable prepend="AND" property="day">d = #day#</isPropertyAvailable><isNotPropertyAvailable prepend="AND" property="missing">1 = 1</isNotPropertyAvailable>
<isNull property="gone">AND g = #gone#</isNull><isParameterPresent prepend="AND">p = 1</isParameterPresent><include refid="tail"/>
</dynamic></select>
<select id="nested">SELECT 1 FROM t WHERE <iterate property="items" conjunction="OR">x = 1 <isNotNull property="a">AND y = 2</isNotNull></iterate></select></sqlMap>"""
SCHEMA = "a int, z int, name string, items array<int>, inner struct<k: string>, day date, suffix string, id int"


@pytest.fixture(scope="module")
def project(spark):
    return Project.upload(spark, {"b.xml": MAPPER})


@pytest.fixture(scope="module")
def parameters(spark):
    values = itertools.product([None, 10, 9, 100], [None, -1, 10], [None, "", "a", "z"], [None, [], [1], [1, 2, 3]], [None, {"k": None}, {"k": "v"}])
    rows = [(a, z, n, i, k, datetime.date(2024, 1, 1 + j % 3), ["x", "", None][j % 3], j) for j, (a, z, n, i, k) in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_row_is_rendered_as_by_a_call(project, parameters):
    s = project.statement("b.s")
    batch = Batch(s["tree"], parameters)
    got = {r["id"]: r for r in batch.rendered().collect()}
    rows = {r["id"]: r.asDict(recursive=True) for r in parameters.collect()}
    assert len(got) == len(rows) == 576 and len(batch.texts) > 50
    for k, row in rows.items():
        sql, args = render(s["tree"], row, "ibatis")
        assert (got[k]["sql"], got[k]["args"]) == (sql, [None if x is None else str(x) for x in args]), row
    plan = batch.rendered()._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1].replace("PythonRDD", "").replace("ScanExistingRDD", "")


def test_what_cannot_be_compiled_says_so(project, parameters):
    with pytest.raises(CannotCompile):
        Batch(project.statement("b.nested")["tree"], parameters)
    with pytest.raises(CannotCompile):
        Batch([], parameters, "mybatis")


def test_a_run_has_a_plan_for_each_shape_and_no_python(spark):
    s = catalogue.session(spark, SF)
    batch = Batch(catalogue.statement(spark, "orders.segmentTotals")["tree"], batch_catalogue.nation_parameters(s))
    assert 4 < len(batch.texts) < 25
    df = batch.run(["nation"])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    one = batch_catalogue.nation_parameters(s).where("nation = 7").first().asDict()
    want = catalogue.run(spark, SF, "orders.segmentTotals", one)
    assert sorted(map(tuple, df.where("nation = 7").drop("nation").collect())) == sorted(map(tuple, want.collect()))
    key = Batch(batch_catalogue.by_key_tree(spark), batch_catalogue.customer_parameters(s)).run(["custkey"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in key and "Cartesian" not in key


def test_no_parameter_rows(project, parameters):
    batch = Batch(project.statement("b.s")["tree"], parameters.limit(0))
    assert batch.rendered().collect() == []
    with pytest.raises(ValueError):
        batch.run(["id"])

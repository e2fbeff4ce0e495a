import pytest

from mapperlake.functions.expressions import evaluate
from mapperlake.functions.inline import inline_parts, parameters
from mapperlake.operators import flatten
from mapperlake.operators.runtime import render
from mapperlake.sources.mappers import Problems, read_mapper


def tree(body, dialect="ibatis"):
    root = "sqlMap" if dialect == "ibatis" else "mapper"
    return read_mapper(f"<{root} namespace='n'><select id='a'>{body}</select></{root}>", Problems())["owners"][0]["nodes"]


def flat(body, dialect="ibatis"):
    return flatten.placeholders(flatten.superset(tree(body, dialect)))


def test_inline_parameters():
    assert inline_parts("a.b:DECIMAL:x:y") == {"property": "a.b", "jdbcType": "DECIMAL", "nullValue": "x:y"}
    assert [(p["name"], p["binding"], p["jdbcType"]) for p in parameters("#a# $b$ #{c,jdbcType=DATE} ${d} #e[].f#")] == [("a", "HASH", None), ("b", "DOLLAR", None), ("c", "HASH", "DATE"), ("d", "DOLLAR", None), ("e.f", "HASH", None)]


def test_superset_drops_the_first_prepend_inside_tags_only():
    assert flat("S <dynamic prepend='WHERE'><isNull prepend='AND' property='a'>x</isNull><isNull prepend='AND' property='b'>y</isNull></dynamic>") == "S WHERE x AND y"
    assert flat("S <isNull prepend='AND' property='a'>x</isNull>") == "S AND x"
    assert flat("S <dynamic prepend='WHERE'><isPropertyAvailable property='a'><isNull prepend='AND' property='a'>x</isNull></isPropertyAvailable><isNull prepend='AND' property='b'>y</isNull></dynamic>") == "S WHERE x AND y"
    assert flat("S <dynamic prepend='WHERE'> </dynamic>") == "S"
    assert flat("S IN <iterate property='l' open='(' close=')' conjunction=','>#l[]#</iterate>") == "S IN (?)"
    assert flat("S <selectKey>SELECT 1</selectKey>") == "S"


def test_superset_of_the_newer_dialect():
    assert flat("S <where><if test='a'>AND x</if><if test='b'>OR y</if></where>", "mybatis") == "S WHERE x OR y"
    assert flat("S <choose><when test='a'> </when><when test='b'>x</when><otherwise>y</otherwise></choose>", "mybatis") == "S x"
    assert flat("U <set><if test='a'>a = #{a},</if></set>", "mybatis") == "U SET a = ?"
    assert flat("S <trim prefix='(' suffix=')' prefixOverrides='AND |OR '>ORDERS</trim>", "mybatis") == "S ( ORDERS )"


def test_variants():
    v = flatten.variants(tree("SELECT * FROM T<isEqual property='a' compareValue='1'>_OLD</isEqual> WHERE x = 1"))
    assert [x["sql"] for x in v] == ["SELECT * FROM T WHERE x = 1", "SELECT * FROM T _OLD WHERE x = 1"] or [x["sql"] for x in v] == ["SELECT * FROM T WHERE x = 1", "SELECT * FROM T_OLD WHERE x = 1"]
    v = flatten.variants(tree("SELECT * FROM <isNull property='a'>A</isNull> <isNotNull property='a'>B</isNotNull> x"))
    assert [x["sql"] for x in v] == ["SELECT * FROM A x", "SELECT * FROM B x"] and v[0]["choices"][0]["kind"] == "ALTERNATIVES"
    many = "".join(f"JOIN <isNull property='a'>A{k}</isNull><isNotNull property='a'>B{k}</isNotNull> ON 1 = 1 " for k in range(6))
    texts = [x["sql"] for x in flatten.variants(tree(f"SELECT * FROM T {many}"))]  # no table is lost, and every two choices meet
    assert all(any(f" {x}{i} " in t and f" {y}{j} " in t for t in texts) for i in range(6) for j in range(6) if i != j for x in "AB" for y in "AB") and len(texts) < 16
    assert flatten.placeholders("SELECT * FROM TB_$ym$ WHERE a = #a#") == "SELECT * FROM `TB_$ym$` WHERE a = ?"


def test_parameter_clauses():
    body = "SELECT #a# FROM t JOIN u ON u.x = #b# <dynamic prepend='WHERE'><isNotNull property='c' prepend='AND'>c = #c#</isNotNull></dynamic> GROUP BY $d$ HAVING COUNT(*) > #e# ORDER BY $f$"
    found = flatten.parameter_usages(tree(body))
    assert [(p["name"], p["used_in"]) for p in found] == [("a", "SELECT"), ("b", "JOIN"), ("c", "WHERE"), ("d", "GROUP_BY"), ("e", "HAVING"), ("f", "ORDER_BY")]
    assert found[2]["condition"] == "IS_NOT_NULL" and found[3]["risk"] == "SQL_INJECTION" and found[0]["risk"] is None


def test_older_runtime():
    body = "S <dynamic prepend='WHERE'><isNotNull prepend='AND' property='a'>a = #a#</isNotNull><isNotEmpty prepend='AND' property='l'>b IN <iterate property='l' open='(' close=')' conjunction=','>#l[]#</iterate></isNotEmpty></dynamic>"
    t = tree(body)
    clean = lambda r: (" ".join(r[0].split()), r[1])
    assert clean(render(t, {"a": 1, "l": [2, 3]}, "ibatis")) == ("S WHERE a = ? AND b IN (? , ?)", [1, 2, 3])
    assert clean(render(t, {"a": None, "l": [2]}, "ibatis")) == ("S WHERE b IN (?)", [2])
    assert clean(render(t, {}, "ibatis")) == ("S", [])
    assert clean(render(t, None, "ibatis")) == ("S", [])
    nested = tree("<iterate property='g' conjunction='OR'>(x = #g[].x# AND y IN <iterate property='g[].sub' open='(' close=')' conjunction=','>#g[].sub[]#</iterate>)</iterate>")
    assert render(nested, {"g": [{"x": 1, "sub": [2, 3]}, {"x": 4, "sub": [5]}]}, "ibatis")[1] == [1, 2, 3, 4, 5]
    null = tree("<isEqual property='a' compareValue='1'>x</isEqual><isNotEqual property='a' compareValue='1'>y</isNotEqual><isGreaterThan property='a' compareValue='0'>z</isGreaterThan><isEqual property='a' compareProperty='b'>w</isEqual>")
    assert render(null, {}, "ibatis")[0].split() == ["y", "w"] or render(null, {}, "ibatis")[0].replace(" ", "") == "yw"


@pytest.mark.parametrize(
    ("text", "scope", "value"),
    [
        ("a != null and a.size() > 0", {"a": [1]}, True), ("a != null and a.size() > 0", {}, False), ("a == 'Y'", {"a": "Y"}, False), ("a == 'Y'.toString()", {"a": "Y"}, True), ("a == \"Y\"", {"a": "Y"}, True),
        ("a == 'abc'", {"a": "abc"}, True), ("n > 3 or n == null", {}, True), ("n >= 0", {}, True), ("!(n lt 3)", {"n": 5}, True), ("a.b[1].c == 2", {"a": {"b": [{}, {"c": 2}]}}, True), ("'%' + w + '%'", {"w": "x"}, "%x%"), ("a.isEmpty()", {"a": ""}, True), ("1 + 2 * 3 == 7", {}, True),
    ],
)
def test_expressions(text, scope, value):
    assert evaluate(text, scope) == value


def test_newer_runtime():
    t = tree("<bind name='p' value=\"w + '%'\"/>S <where><if test='w != null'>a LIKE #{p}</if><foreach collection='l' item='x' open='AND b IN (' separator=',' close=')'>#{x.k}</foreach></where>", "mybatis")
    sql, args = render(t, {"w": "q", "l": [{"k": 1}, {"k": 2}]}, "mybatis")
    assert sql.split() == "S WHERE a LIKE ? AND b IN ( ? , ? )".split() and args == ["q%", 1, 2]
    sql, args = render(t, {"l": []}, "mybatis")
    assert sql.split() == ["S"] and args == []

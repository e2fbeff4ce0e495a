import random

import pytest

from mapperlake.functions import sqltree
from mapperlake.functions.sqlrewrite import outer_joins
from mapperlake.functions.sqltokens import tokenize
from mapperlake.operators import facts, migrate
from mapperlake.sinks.sqllayout import layout, pretty
from mapperlake.sources.mapping import Mapping


def of(sql):
    return facts.analyse([{"sql": sql}])


def test_tokens_are_lossless_and_nothing_fails():
    r = random.Random(3)
    bits = ["SELECT", " ", "'it''s'", '"q', "--x\n", "/*+ h */", "/* c", "#a#", "${b}", "$c$", "(", ")", ",", ".", "t1", "1.5e3", "`", "[x]", "\n", "(+)", "UNION", "FROM", "WITH a AS (", "é", "||", "*"]
    m = Mapping({"t1": {"targetTable": "t2", "columns": {"a": "b"}}})
    for _ in range(400):
        sql = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert "".join(t.text for t in tokenize(sql)) == sql
        migrate.convert_sql(sql, m)
        facts.analyse([{"sql": sql}])


def test_joins_and_tables():
    r = of("SELECT a.x FROM t a LEFT OUTER JOIN u b ON a.i = b.i AND b.k > ?, v WHERE v.j = a.j AND v.m = a.m")
    assert [(j["left_table"], j["right_table"], j["type"], j["conditions"]) for j in r["joins"]] == [("t", "u", "LEFT_JOIN", ["a.i = b.i", "b.k > ?"]), ("v", "t", "IMPLICIT_JOIN", ["v.j = a.j"])]
    kinds = ["JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT OUTER JOIN", "FULL OUTER JOIN", "CROSS JOIN", "OUTER JOIN"]
    assert [of(f"SELECT 1 FROM a {k} b")["joins"][0]["type"] for k in kinds] == ["JOIN", "INNER_JOIN", "LEFT_JOIN", "RIGHT_JOIN", "FULL_JOIN", "CROSS_JOIN", "OUTER_JOIN"]
    assert outer_joins("SELECT 1 FROM a, b WHERE a.i = b.i(+) AND a.k = 1 ORDER BY 1").split() == "SELECT 1 FROM a LEFT JOIN b ON a.i = b.i WHERE a.k = 1 ORDER BY 1".split()
    ops = {q: of(q)["tables"][0]["operation"] for q in ("INSERT INTO t (a) VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t WHERE a = 1", "DELETE t WHERE a = 1", "SELECT 1 FROM t", "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN UPDATE SET t.b = 1")}
    assert list(ops.values()) == ["CREATE", "UPDATE", "DELETE", "DELETE", "READ", "UPDATE"]
    both = {(t["table"], t["operation"]) for t in of("INSERT INTO t SELECT * FROM t")["tables"]}
    assert both == {("t", "CREATE"), ("t", "READ")}


def test_scopes_keep_aliases_apart():
    r = of("SELECT a.x FROM t a WHERE EXISTS (SELECT 1 FROM u a WHERE a.y = 1)")
    assert {(c["table"], c["column"]) for c in r["columns"]} == {("t", "x"), ("u", "y")}
    r = of("SELECT x FROM t, u")
    assert r["columns"][0]["table"] == "UNKNOWN" and r["columns"][0]["resolution"] == "UNRESOLVED"


def test_lineage_and_hierarchy():
    r = of("WITH w AS (SELECT a AS x FROM t) SELECT q.x, (SELECT MAX(m) FROM u) mm FROM (SELECT x FROM w UNION ALL SELECT k FROM v) q")
    assert {(o["output"], o["table"], o["column"]) for o in r["lineage"]} == {("x", "t", "a"), ("x", "v", "k"), ("mm", "u", "m")}
    assert [(s["select_id"], s["role"]) for s in r["selects"]] == [("MAIN", "MAIN"), ("S1", "CTE"), ("S2", "DERIVED"), ("U1", "UNION"), ("S3", "SUBQUERY")]
    r = of("SELECT COUNT(*) n, SUM(a) OVER (PARTITION BY b) w, MAX(a) + 1 z FROM t")
    assert [o["aggregate"] for o in r["outputs"]] == [True, False, False]


def test_errors_of_single_variants_stay():
    r = facts.analyse([{"sql": "SELECT a FROM t"}, {"sql": "SELECT b FROM u WHERE )"}])
    assert r["error"].startswith("variant 1") and [x["table"] for x in r["tables"]] == ["t"]


def test_predicates_and_failures():
    r = of("SELECT 1 FROM t WHERE a = ? AND (b IN (1, 2) OR c NOT LIKE 'x') AND d BETWEEN 1 AND 2 AND e IS NOT NULL")
    assert [p["kind"] for p in r["predicates"]] == ["AND", "COMPARISON", "OR", "COMPARISON", "COMPARISON", "COMPARISON", "COMPARISON"]
    assert [p["op"] for p in r["predicates"] if p["op"]] == ["=", "BETWEEN", "IS NOT", "IN", "NOT LIKE"]
    for bad in ("SELECT a FROM t PIVOT (MAX(b) FOR c IN (1))", "{ call p(?) }", "SELECT a FROM t ORDER BY ? ?", "SELECT FROM", "", "SELECT a FROM x o y o"):
        assert of(bad)["error"] and not of(bad)["tables"], bad
    assert len(of("SELECT a FROM t WHERE " + " AND ".join(["x = 1"] * 20_000))["predicates"]) == 20_001
    assert sqltree.text(sqltree.parse("SELECT CASE WHEN a = 1 THEN 'x' ELSE CAST(b AS NUMBER(3)) END FROM t")["branches"][0]["items"][0]["expr"]) == "CASE WHEN a = 1 THEN 'x' ELSE CAST(b AS NUMBER(3)) END"


M = Mapping({"TB_C": {"targetTable": "customer", "columns": {"NO": "id", "YN": "active"}}, "TB_O": {"targetTable": "orders", "columns": {"NO": "customer_id", "AMT": "total"}}, "TB_P": {"targetTable": "product", "columns": {"YN": "sellable"}}, "L.TB_Y": {"targetTable": "B.PAY", "columns": {"Y": "Z"}}, "TB_O_OLD": {"targetTable": "orders_OLD"}})


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ("SELECT C.NO, 'NO' /* NO */ FROM TB_C C, TB_O O WHERE O.NO = C.NO", "SELECT C.id, 'NO' /* NO */ FROM customer C, orders O WHERE O.customer_id = C.id"),
        ("SELECT X.NO FROM (SELECT NO FROM TB_C) X", "SELECT X.id FROM (SELECT id FROM customer) X"),
        ("SELECT X.K FROM (SELECT NO AS K FROM TB_C) X", "SELECT X.K FROM (SELECT id AS K FROM customer) X"),
        ("WITH W(NO) AS (SELECT NO FROM TB_C) SELECT NO FROM W", "WITH W(NO) AS (SELECT id FROM customer) SELECT NO FROM W"),
        ("INSERT INTO TB_O (NO, AMT) SELECT NO, 1 FROM TB_C WHERE YN = 'Y'", "INSERT INTO orders (customer_id, total) SELECT id, 1 FROM customer WHERE active = 'Y'"),
        ("UPDATE TB_O SET AMT = AMT + 1 WHERE NO = ?", "UPDATE orders SET total = total + 1 WHERE customer_id = ?"),
        ("SELECT TB_C.NO FROM TB_C", "SELECT customer.id FROM customer"),
        ("SELECT Y FROM L.TB_Y", "SELECT Z FROM B.PAY"),
        ('SELECT "NO" FROM "TB_C"', 'SELECT "id" FROM "customer"'),
        ("SELECT NVL(SUM(AMT), 0) AMT FROM TB_O ORDER BY AMT", "SELECT NVL(SUM(total), 0) AMT FROM orders ORDER BY AMT"),
        ("SELECT YN FROM TB_C, TB_P", "SELECT YN FROM customer, product"),
        ("DELETE FROM TB_O WHERE NO IN (SELECT NO FROM TB_C)", "DELETE FROM orders WHERE customer_id IN (SELECT id FROM customer)"),
    ],
)
def test_renames(old, new):
    assert migrate.convert_sql(old, M)[0] == new


def test_rename_events():
    code = lambda sql, **k: [e["code"] for e in migrate.convert_sql(sql, M, **k)[1]]
    assert "COLUMN_AMBIGUOUS" in code("SELECT YN FROM TB_C, TB_P")
    assert "COLUMN_ASSUMED" in code("SELECT YN FROM TB_C, OTHER")
    assert code("NO = 1") == ["NO_TABLE_CONTEXT"]
    assert "UNRESOLVED_QUALIFIER" in code("SELECT Q.NO FROM TB_O H")
    assert "HINT_NOT_MIGRATED" in code("SELECT /*+ INDEX(TB_O) */ 1 FROM TB_O")
    assert code("SELECT * FROM TB_O_$ym$") == ["DYNAMIC_IDENTIFIER"] and "RUNTIME_SUBSTITUTION" in code("SELECT 1 FROM X ORDER BY $c$")
    assert migrate.convert_sql("SELECT NO FROM TB_C", M, keep_labels=True)[0] == "SELECT id AS NO FROM customer"
    assert migrate.convert_sql("YN = 1", M, context=["TB_P"])[0] == "sellable = 1"


def test_layout():
    assert layout("\n    SELECT 'a\n  b'\n      FROM t\n", "  ") == "  SELECT 'a\n  b'\n    FROM t"
    sql = "SELECT a, COUNT(*) FROM t JOIN u ON t.i = u.i WHERE x BETWEEN 1 AND 2 AND y IN (SELECT z FROM v) ORDER BY a -- end"
    out = pretty(sql)
    assert "".join(out.split()) == "".join(sql.split()) and out.splitlines()[0].startswith("SELECT a")
    assert pretty(pretty(sql)) == out

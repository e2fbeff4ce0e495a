import json

import pytest

from mapperlake.plans import api, catalogue, migration
from mapperlake.sinks import reports as report_files


def test_views(spark):
    p = catalogue.project(spark)
    assert api.statements(p).count() == 41
    one = api.statement(p, "orders.lineAmounts")
    assert one["statement"].count() == 1 and {r["target"] for r in one["dependencies"].collect()} == {"common.lineColumns", "common.amount", "common.shippedAfter"}
    assert api.namespaces(p).first()["files"] == 1
    assert {(r["direction"], r["other"]) for r in api.dependencies(p, "common.lineColumns").collect()} == {("out", "common.amount"), ("in", "orders.lineAmounts")}
    assert [r["owner"] for r in api.include_sites(p, "common.amount").collect()] == ["common.lineColumns"]
    bundle = {r["qid"]: r["xml"] for r in api.statement_bundle(p, "orders.lineAmounts").collect()}
    assert set(bundle) == {"orders.lineAmounts", "common.lineColumns", "common.amount", "common.shippedAfter"}
    assert bundle["common.amount"].startswith('<sql id="amount">') and bundle["common.amount"].endswith("</sql>")
    text = api.inlined_xml(p, "orders.lineAmounts")
    assert "<include" not in text and "l.l_discount" in text and "&gt;= #from#" in text


def test_previews_and_summary(spark):
    p = catalogue.project(spark)
    row = api.conversion_preview(p, "Common.xml").first()
    assert "#from#" in row["before"] and "#{from}" in row["after"]
    definition = json.loads((catalogue.CORPUS / "legacy.json").read_text())
    by_statement, total = api.schema_summary(p, definition)
    assert {r["statement"]: r["SAFE"] for r in by_statement.collect()}["legacy.custTotals"] == 11
    assert total.first()["SAFE"] == 14
    assert api.schema_tables(p, definition).where("verdict = 'MAPPED'").count() == 3


def test_datasets(tmp_path):
    d = api.Datasets(str(tmp_path))
    assert d.put("a", {"T": {"targetTable": "U"}})["errors"] == [] and d.list() == ["a"] and d.get("a")["mapping"] == {"T": {"targetTable": "U"}}
    assert d.put("b", {"1": 2})["errors"] and d.list() == ["a"]
    d.delete("a")
    assert d.list() == []
    with pytest.raises(ValueError):
        d.get("../x")


def test_report_tree(spark, tmp_path):
    p = catalogue.project(spark)
    owners, events = migration.converted(p)
    from mapperlake.sinks import mapper_xml

    report = report_files.write_tree(mapper_xml.documents(owners), report_files.tallies(events, p.mappers), report_files.review_list(events), str(tmp_path))
    assert report["files"] == 4 and (tmp_path / "mybatis" / "Orders.xml").exists() and json.loads((tmp_path / "report.json").read_text())["grades"]["MANUAL"] == 1
    assert (tmp_path / "report.md").read_text().startswith("| file |")
    with pytest.raises(ValueError):
        report_files.inside(tmp_path, "../x")

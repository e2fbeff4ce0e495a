import pytest

from mapperlake.plans.engine import Project
from mapperlake.sources import mapping, markup, projects
from mapperlake.sources.mappers import Problems, from_rows, read_mapper, to_rows


def codes(source):
    return [p[1] for p in markup.parse(source)[1]]


def test_markup_keeps_lines_and_recovers():
    root, problems = markup.parse("<?xml version='1.0'?>\n<!DOCTYPE a [<!ENTITY x '>'>]>\n<a>\n <b id=' q '>1 < 2 &amp; &#65;<![CDATA[<c>]]>\n</a>")
    assert root["tag"] == "a" and root["line"] == 3
    b = root["children"][1]
    assert b["attrs"] == {"id": "q"} and b["line"] == 4 and b["children"][0]["text"] == "1 < 2 & A<c>\n"
    assert [p[1] for p in problems] == ["XML_ATTRIBUTE_TRIMMED", "XML_LENIENT_LT", "XML_RECOVERED_UNCLOSED"]
    assert codes("<a></b></a>") == ["XML_RECOVERED_STRAY_CLOSE"]
    assert codes("<a><b>") == ["XML_RECOVERED_UNCLOSED"] * 2
    assert markup.parse("no element") == (None, [("ERROR", "XML_PARSE_ERROR", "no element found", 1)])
    assert markup.parse("")[0] is None


def test_encoding_and_kind():
    korean = '<?xml version="1.0" encoding="MS949"?><sqlMap namespace="가"/>'.encode("cp949")
    assert projects.decode(korean) == ('<?xml version="1.0" encoding="MS949"?><sqlMap namespace="가"/>', "euc-kr")
    assert projects.decode("﻿<a/>".encode("utf-16-le"))[1] == "utf-16le"
    assert projects.detect_encoding(b'<?xml version="1.0" encoding="nonsense"?>') == "utf-8"
    kinds = {"<!-- <mapper> --><sqlMap/>": "IBATIS_MAPPER", "<configuration/>": "MYBATIS_CONFIG", "<mapper/>": "MYBATIS_MAPPER", "<sqlMapConfig/>": "IBATIS_CONFIG", "<web-app/>": "OTHER", "": "UNREADABLE"}
    assert {k: projects.classify(k) for k in kinds} == kinds
    assert projects.classify_head(b"<!-- " + b"x" * 9000) is None


def test_mapper_reading_and_rows():
    problems = Problems()
    m = read_mapper("<sqlMap><select id='a'>x<foo>y</foo><include/><isNull>z</isNull></select><sql>q</sql><typeAlias alias='t'/></sqlMap>", problems)
    assert m["dialect"] == "ibatis" and [o["id"] for o in m["owners"]] == ["a"]
    assert [p[1] for p in problems] == ["MISSING_NAMESPACE", "UNSUPPORTED_TAG", "MISSING_REFID_ATTR", "MISSING_PROPERTY_ATTR", "MISSING_ID_ATTR"]
    nodes = read_mapper("<mapper namespace='n'><select id='a'>x<if test='a'>y<where>z</where></if></select></mapper>", Problems())["owners"][0]["nodes"]
    rows = to_rows(nodes)
    assert [(r["node_id"], r["parent_id"], r["depth"], r["type"]) for r in rows] == [(0, -1, 0, "Text"), (1, -1, 0, "Conditional"), (2, 1, 1, "Text"), (3, 1, 1, "Dynamic"), (4, 3, 2, "Text")]
    assert to_rows(from_rows(rows)) == rows


def test_upload_and_copies(spark):
    text = "<sqlMap namespace='n'><select id='a'>SELECT 1</select></sqlMap>"
    p = Project.upload(spark, {"src/A.xml": text, "target/classes/A.xml": text, "web.xml": "<web-app/>", "B.xml": "<mapper namespace='m'><sql id='f'>x</sql></mapper>", "empty.xml": ""})
    assert {r["source_file"] for r in p.mappers.collect()} == {"src/A.xml", "B.xml"}
    assert {(r["source_file"], r["reason"]) for r in p.skipped.collect()} == {("target/classes/A.xml", "BUILD_COPY"), ("web.xml", "OTHER"), ("empty.xml", "UNREADABLE")}
    with pytest.raises(ValueError):
        projects.upload(spark, [("a.xml", ""), ("a.xml", "")])


def test_folder_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.xml").write_text("<mapper namespace='x'/>")
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "M.XML").write_text("<sqlMap namespace='n'><select id='s'>SELECT 1</select></sqlMap>")
    (tmp_path / "big.xml").write_text("<mapper namespace='big'/>" + " " * 300)
    found = {r["source_file"]: r["reason"] for r in projects.scan(spark, str(tmp_path), max_bytes=200).collect()}
    assert found == {"a/b/M.XML": None, "big.xml": "TOO_LARGE"} or found == {"a/b/M.XML": None, "big.xml": "UNREADABLE"}


def test_salvage_and_discovery(spark):
    text = "<!-- <sql id='no'/> -->\n<sqlMap namespace='n'>\n<sql id='f'>\n<select id='s'"
    assert projects.salvage(text) == [{"kind": "NAMESPACE", "id": "n", "line": 2}, {"kind": "SQL_FRAGMENT", "id": "f", "line": 3}, {"kind": "STATEMENT", "id": "s", "line": 4}]
    outside = projects.upload(spark, {"o/Common.xml": "<sqlMap namespace='common'><sql id='page'><include refid='base.one'/></sql></sqlMap>", "o/Base.xml": "<sqlMap namespace='base'><sql id='one'>1</sql></sqlMap>", "o/Other.xml": "<sqlMap namespace='other'><sql id='zzz'>1</sql></sqlMap>"})
    missing = spark.createDataFrame([("common", "page")], "namespace string, id string")
    assert {r["source_file"] for r in projects.discover_references(missing, outside).collect()} == {"o/Common.xml", "o/Base.xml"}


def test_mapping_validation():
    good = mapping.validate({"name": "x", "mapping": {"A": {"targetTable": "B", "columns": {"C": "D"}}}})
    assert good == {"errors": [], "warnings": [], "summary": {"tables": 1, "columns": 1, "renamed_tables": 1}}
    bad = mapping.validate({"A": {"targetTable": "1x", "columns": {"C": "D", "c": "E", "F": "D"}}, "a": {}, "B": {"targetTable": "b"}, "S": 3})
    assert {e["code"] for e in bad["errors"]} == {"DUPLICATE_TABLE", "BAD_TARGET_NAME", "DUPLICATE_COLUMN", "TARGET_COLLISION", "NOT_AN_OBJECT"}
    assert {w["code"] for w in bad["warnings"]} == {"EMPTY_ENTRY", "SELF_MAPPING"}
    m = mapping.Mapping({"T": {"targetTable": "X"}, "S.T": {"targetTable": "Y"}, "C": {"columns": {"a": "b"}}})
    assert m.table("t")[0] == "X" and m.table("s.t")[0] == "Y" and m.table("z.t")[0] == "X" and m.table("c") == (None, {"A": "b"}) and m.table("q") is None


def test_mapping_table(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "n", "mapping": {"S.A": {"targetTable": "B", "columns": {"C": "D"}}}}')
    rows = [r.asDict() for r in mapping.read_table(spark, str(tmp_path / "m.json")).collect()]
    assert rows == [{"source_schema": "S", "source_table": "A", "target_table": "B", "columns": {"C": "D"}}]

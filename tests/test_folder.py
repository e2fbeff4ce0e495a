"""The folder source: what is listed, in which order, what is read, and what is refused."""

import os
import time

import pytest

from mapperlake.plans.engine import Project
from mapperlake.sources import folder, projects

MAPPER = '<sqlMap namespace="{}"><select id="s">SELECT a FROM t</select></sqlMap>'


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "root"
    for name, text in {"b/B.xml": MAPPER.format("b"), "a/A.XML": MAPPER.format("a"), "a/deep/C.xml": MAPPER.format("c"), "conf.xml": "<configuration/>", "none.xml": "no mark-up", "a/note.txt": "x", ".git/X.xml": MAPPER.format("x"), "Late.xml": "<!-- " + "x" * 9000 + " -->" + MAPPER.format("late")}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside/O.xml").write_text(MAPPER.format("o"))
    os.symlink("..", root / "a/loop")  # back to the root
    os.symlink(tmp_path / "outside", root / "linked")
    os.symlink(tmp_path / "outside", root / "linked2")
    os.symlink(root / "nowhere", root / "gone.xml")  # can't be read
    with open(root / "huge.xml", "wb") as f:
        f.truncate(30 << 20)
    return root


def test_rows(spark, tree):
    got = {r["source_file"]: r for r in folder.files(spark, str(tree)).collect()}
    assert sorted(got) == ["Late.xml", "a/A.XML", "a/deep/C.xml", "b/B.xml", "conf.xml", "gone.xml", "huge.xml", "linked/O.xml", "none.xml"]
    assert {k: r["reason"] for k, r in got.items() if r["reason"]} == {"conf.xml": "MYBATIS_CONFIG", "gone.xml": "UNREADABLE", "huge.xml": "TOO_LARGE", "none.xml": "UNREADABLE"}
    assert got["Late.xml"]["kind"] == "IBATIS_MAPPER" and got["huge.xml"]["size"] == 30 << 20 and got["conf.xml"]["text"] is None


def test_listing_is_ordered_and_each_folder_once(tree):
    names = [f.path for f in folder.walk(str(tree))]
    assert names == sorted(names) and len(names) == len(set(names)) == 9


def test_same_files_as_the_scan(spark, tree):
    """What both read is the same row; the scan knows no links and no unreadable files."""
    os.remove(tree / "gone.xml")
    mine = {r["source_file"]: (r["size"], r["kind"], r["text"], r["reason"]) for r in folder.files(spark, str(tree)).where("NOT source_file LIKE 'linked%'").collect()}
    os.remove(tree / "a/loop")
    os.remove(tree / "linked")
    os.remove(tree / "linked2")
    scan = {r["source_file"]: (r["size"], r["kind"], r["text"], r["reason"]) for r in projects.scan(spark, f"file://{tree}").collect()}
    assert mine == scan


def test_heads_come_before_bodies(tree, monkeypatch):
    """Of a file that its head decides against, nothing else is read."""
    (tree / "big.xml").write_text("<configuration>" + "x" * 2_000_000)
    read = []
    real = open

    def counted(*a, **b):
        f = real(*a, **b)
        inner = f.read
        f = type("F", (), {"read": lambda self, n=-1: (lambda d: (read.append(len(d)), d)[1])(inner(n)), "__enter__": lambda self: self, "__exit__": lambda self, *x: None})()
        return f

    monkeypatch.setattr("builtins.open", counted)
    row = folder.read_one(str(tree), folder.Found("big.xml", 2_000_015, 1))
    assert row[3] == "MYBATIS_CONFIG" and sum(read) == projects.HEAD_BYTES


@pytest.mark.parametrize("path", ["../outside/O.xml", "/etc/passwd", "a/../../outside/O.xml", "c:/x.xml", "a\\..\\..\\x.xml"])
def test_paths_are_guarded(tree, path):
    with pytest.raises(ValueError):
        folder.guarded(str(tree), path)


def test_partitions_follow_bytes():
    files = [folder.Found(f"{k}.xml", s, 1) for k, s in enumerate([10, 60, 50, 200, 1, 1])]
    parts = folder.by_bytes(files, 8192 + 100)
    assert [f.path for p in parts for f in p.files] == [f.path for f in files] and len(parts) > 1
    assert folder.by_bytes([]) == []


def test_a_project_of_the_source(spark, tree):
    p = Project(folder.files(spark, str(tree)))
    assert sorted(r["statement"] for r in p.rendered.select("statement").collect()) == ["a.s", "b.s", "c.s", "late.s", "o.s"]


def test_stream_goes_on_with_new_files(spark, tree, tmp_path):
    def run():
        query = folder.stream(spark, str(tree)).select("source_file").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert "b/B.xml" in first and "New.xml" not in first
    time.sleep(0.05)
    (tree / "New.xml").write_text(MAPPER.format("new"))
    assert run() == sorted([*first, "New.xml"])

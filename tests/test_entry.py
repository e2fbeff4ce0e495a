"""The driver's contract: what is registered, and that the library stands without the training-data subpackage."""

import importlib.util
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
THERE = importlib.util.find_spec("mapperlake.llm") is not None


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values()) and all(s.strip() for s in sql.values())
    for kind, least in (("x_", 40), ("k_", 15), ("d_", 40)):
        assert sum(k.startswith(kind) and k in sql for k in queries) >= least, kind


@pytest.mark.skipif(not THERE, reason="without the subpackage")
def test_every_training_operator_has_one_query():
    numbers = sorted(int(m[1]) for k in entry.queries() if (m := re.match(r"op(\d+)_", k)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_mktsegment", "o_orderstatus", "n_orders", "total"] and df.count() > 0


def _names(root: Path) -> list[str]:
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); e.oracle_sql()"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(root), "PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr[-2000:]
    return run.stdout.split("NAMES ")[1].split()


@pytest.fixture()
def copy(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "mapperlake", tmp_path / "mapperlake", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    return tmp_path


def test_without_the_subpackage(copy):
    names = _names(copy)
    assert not [n for n in names if n.startswith("op") or n == "pipeline"] and "x_join_left" in names and "d_problems" in names


def test_another_missing_module_is_an_error(copy):
    (copy / "corpus_pipeline.py").write_text("import a_module_that_is_nowhere\n")
    with pytest.raises(AssertionError, match="a_module_that_is_nowhere"):
        _names(copy)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "mapperlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "mapperlake").parts:
            assert not re.search(r"mapperlake\.llm|from \.+llm|import llm", path.read_text()), path

"""Rename mappings: reading, checking and looking up old names."""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][\w$#]*$")


def unwrap(definition: dict) -> dict:
    return definition["mapping"] if isinstance(definition.get("mapping"), dict) and "targetTable" not in definition else definition


def read(path: str | Path) -> dict:
    """A mapping from a JSON file of the driver's, wrapped in {name, mapping} or bare."""
    return unwrap(json.loads(Path(path).read_text()))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """source_schema, source_table, target_table, columns of a mapping in any store that Spark reads."""
    kind = "map<string, struct<targetTable: string, columns: map<string, string>>>"
    raw = spark.read.text(path, wholetext=True)
    whole = raw.select(F.coalesce(F.from_json(F.get_json_object("value", "$.mapping"), kind), F.from_json("value", kind)).alias("m"))
    rows = whole.select(F.explode("m").alias("key", "v"))
    return rows.select(F.when(F.col("key").contains("."), F.substring_index("key", ".", 1)).alias("source_schema"), F.substring_index("key", ".", -1).alias("source_table"), F.col("v.targetTable").alias("target_table"), F.col("v.columns").alias("columns"))


def validate(definition: dict) -> dict:
    """errors and warnings as {path, code, message}, and a summary. Names compare without case."""
    errors: list[dict] = []
    warnings: list[dict] = []
    tell = lambda to, path, code, message: to.append({"path": path, "code": code, "message": message})
    if not isinstance(definition, dict):
        tell(errors, "$", "NOT_AN_OBJECT", "a mapping is an object of tables")
        return {"errors": errors, "warnings": warnings, "summary": {"tables": 0, "columns": 0, "renamed_tables": 0}}
    tables = unwrap(definition)
    for name, n in Counter(k.upper() for k in tables).items():
        if n > 1:
            tell(errors, f"$.{name}", "DUPLICATE_TABLE", f"{name} is mapped {n} times")
    columns = renamed = 0
    targets: Counter = Counter()
    for key, entry in tables.items():
        path = f"$.{key}"
        if not 1 <= len(key.split(".")) <= 2 or not all(_NAME.match(p) for p in key.split(".")):
            tell(errors, path, "BAD_TABLE_NAME", f"{key} is no table name")
        if not isinstance(entry, dict):
            tell(errors, path, "NOT_AN_OBJECT", "a table's entry is an object")
            continue
        for k in entry:
            if k not in ("targetTable", "columns"):
                tell(warnings, f"{path}.{k}", "UNKNOWN_KEY", f"{k} is ignored")
        target = entry.get("targetTable")
        if target is not None:
            if not isinstance(target, str) or not all(_NAME.match(p) for p in target.split(".")):
                tell(errors, f"{path}.targetTable", "BAD_TARGET_NAME", f"{target} is no table name")
            else:
                renamed += target.upper() != key.upper()
                targets[target.upper()] += 1
                if target.upper() == key.upper():
                    tell(warnings, f"{path}.targetTable", "SELF_MAPPING", f"{key} keeps its name")
        own = entry.get("columns") or {}
        if not isinstance(own, dict):
            tell(errors, f"{path}.columns", "NOT_AN_OBJECT", "columns are an object of names")
            continue
        for name, n in Counter(c.upper() for c in own).items():
            if n > 1:
                tell(errors, f"{path}.columns.{name}", "DUPLICATE_COLUMN", f"{name} is mapped {n} times")
        for old, new in own.items():
            columns += 1
            if not _NAME.match(old) or not isinstance(new, str) or not _NAME.match(new):
                tell(errors, f"{path}.columns.{old}", "BAD_COLUMN_NAME", f"{old} to {new} isn't a pair of names")
            elif old.upper() == new.upper():
                tell(warnings, f"{path}.columns.{old}", "SELF_MAPPING", f"{old} keeps its name")
        for new, n in Counter(str(c).upper() for c in own.values()).items():
            if n > 1:
                tell(errors, f"{path}.columns", "TARGET_COLLISION", f"{n} columns become {new}")
        if target is None and not own:
            tell(warnings, path, "EMPTY_ENTRY", f"{key} maps nothing")
    for t, n in targets.items():
        if n > 1:
            tell(warnings, "$", "SHARED_TARGET", f"{n} tables become {t}")
    return {"errors": errors, "warnings": warnings, "summary": {"tables": len(tables), "columns": columns, "renamed_tables": renamed}}


class Mapping:
    """Look-ups without case; a key with a schema beats the bare one; without a target only columns are renamed."""

    def __init__(self, definition: dict):
        self.tables = {k.upper(): (v.get("targetTable"), {c.upper(): n for c, n in (v.get("columns") or {}).items()}) for k, v in unwrap(definition).items()}
        self.legacy = {c for _, columns in self.tables.values() for c in columns}

    def table(self, name: str) -> tuple[str | None, dict[str, str]] | None:
        name = name.upper()
        found = self.tables.get(name)
        return found if found is not None else self.tables.get(name.rpartition(".")[2]) if "." in name else None

"""What a service over a project offers, as functions that return DataFrames (or small dicts of one statement)."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapperlake.operators import assemble, migrate, resolve
from mapperlake.plans import migration, reports
from mapperlake.plans.engine import Project
from mapperlake.sinks import mapper_xml
from mapperlake.sources import mapping as mappings


def statements(p: Project) -> DataFrame:
    """All statements, by namespace and id."""
    return p.statements.select("qid", "namespace", "local_id", "type", "source_file", "line", "dialect").orderBy("namespace", "local_id")


def statement(p: Project, qid: str) -> dict[str, DataFrame]:
    """One statement's facts, conditions, parameters and problems."""
    mine = lambda df, c="statement": df.where(F.col(c) == qid)
    return {
        "statement": mine(p.statements, "qid"), "variants": mine(p.rendered).select(F.explode("variants").alias("v")).select("v.*"), "parameters": mine(assemble.parameter_usages(p.rendered)), "conditions": mine(assemble.dynamic_conditions(p.rendered)),
        **{k: mine(p.facts(k)) for k in ("tables", "columns", "joins", "predicates", "selects", "outputs", "lineage")}, "dependencies": reports.dependency_tree(p, qid),
    }


def namespaces(p: Project) -> DataFrame:
    return reports.index_summary(p).orderBy(F.desc("files"), "namespace")


def dependencies(p: Project, node: str) -> DataFrame:
    return resolve.neighbours(p.dependency_edges, node)


def include_sites(p: Project, fragment: str) -> DataFrame:
    return resolve.include_sites(p.edges).where(F.col("fragment") == fragment)


def raw_xml(p: Project) -> DataFrame:
    """qid, source_file, line, xml: the source text of every owner, from its line to the next owner's."""
    w = Window.partitionBy("source_file").orderBy("line", "ord")
    spans = p.owners.select("qid", "source_file", "line", "ord", "tag").withColumn("end", F.lead("line").over(w))
    texts = p.files.where("text IS NOT NULL").select("source_file", F.split("text", "\n").alias("lines"))
    cut = spans.join(texts, "source_file").withColumn("xml", F.concat_ws("\n", F.slice("lines", F.col("line"), F.coalesce(F.col("end"), F.size("lines") + 1) - F.col("line"))))
    closed = F.regexp_extract("xml", r"(?s)^(.*?</(?:select|insert|update|delete|procedure|statement|sql|resultMap|parameterMap|cacheModel)\s*>|.*?/>)", 1)
    return cut.select("qid", "source_file", "line", F.trim(F.when(closed != "", closed).otherwise(F.col("xml"))).alias("xml"))


def statement_bundle(p: Project, qid: str) -> DataFrame:
    """The source texts of a statement and of all that it depends on."""
    needed = reports.dependency_tree(p, qid).where("status = 'RESOLVED'").select(F.col("target").alias("qid")).union(p.spark.createDataFrame([(qid,)], "qid string")).distinct()
    return raw_xml(p).join(needed, "qid", "left_semi")


def inlined_xml(p: Project, qid: str) -> str:
    """A statement with its includes in place; those that are missing or circular stay as they are."""
    s = p.statement(qid)

    def inline(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes:
            inner = inline(n["children"])
            out += inner if n["type"] == "Include" and n.get("status") == "RESOLVED" else [{**n, "children": inner if n["type"] != "Include" else []}]
        return out

    return mapper_xml.write_nodes(inline(s["tree"]), s["dialect"], 1)


def conversion_preview(p: Project, source_file: str) -> DataFrame:
    """before, after of a file in the newer dialect."""
    owners, _ = migration.converted(p)
    return mapper_xml.shaped(mapper_xml.documents(p.owners.where(F.col("source_file") == source_file)), mapper_xml.documents(owners.where(F.col("source_file") == source_file)))


def schema_summary(p: Project, definition: dict) -> tuple[DataFrame, DataFrame]:
    """(grades by statement, the project's total) of a rename."""
    _, events = migration.renamed(p, definition)
    return reports.migration_summary(events, p.include_tree, p.statements), reports.migration_total(events)


def schema_tables(p: Project, definition: dict) -> DataFrame:
    return migrate.usage(p.rendered, p.analysed, mappings.unwrap(definition))


class Datasets:
    """Named rename mappings as JSON files of one folder, each replaced as a whole."""

    _ID = re.compile(r"^[\w-]{1,64}$")

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        if not self._ID.match(name):
            raise ValueError(f"{name!r} is no name of a dataset")
        return self.folder / f"{name}.json"

    def list(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def get(self, name: str) -> dict:
        return json.loads(self._path(name).read_text())

    def put(self, name: str, definition: dict) -> dict:
        found = mappings.validate(definition)
        if not found["errors"]:
            path = self._path(name)
            self.folder.mkdir(parents=True, exist_ok=True)
            part = path.with_suffix(".part")
            part.write_text(json.dumps({"name": name, "mapping": mappings.unwrap(definition)}, indent=1))
            os.replace(part, path)
        return found

    def delete(self, name: str) -> None:
        self._path(name).unlink(missing_ok=True)

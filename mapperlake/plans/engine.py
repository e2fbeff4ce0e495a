"""A project from files to tables, and statements from parameters to DataFrames."""

from __future__ import annotations

import json
import re
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.functions.sqltokens import tokenize
from mapperlake.operators import assemble, catalog, facts, kernels, resolve
from mapperlake.operators.runtime import render
from mapperlake.operators.textindex import TextIndex
from mapperlake.sources import projects


class Project:
    """The tables of a project. Each is built when first asked for; those that several others read are kept in memory and spill to disk; those that references are resolved by are computed at once (see kernels.held)."""

    text_index: TextIndex | None = None

    def __init__(self, files: DataFrame, drop_copies: bool = True):
        self.spark, self.files, self._drop = files.sparkSession, files, drop_copies

    @classmethod
    def open(cls, spark: SparkSession, root: str, references: str | None = None) -> "Project":
        files = projects.scan(spark, root)
        return cls(projects.with_references(files, projects.scan(spark, references, external=True)) if references else files)

    @classmethod
    def upload(cls, spark: SparkSession, files: dict[str, str]) -> "Project":
        return cls(projects.upload(spark, files))

    def indexed(self) -> "Project":
        """This project with an index of its texts, which every search then uses."""
        if self.text_index is None:
            self.text_index = TextIndex.build(self.files.select("source_file", "text"), "source_file", "text")
        return self

    @cached_property
    def _parsed(self) -> tuple[DataFrame, DataFrame]:
        parsed = kernels.held(catalog.parse(self.files))
        return catalog.without_copies(parsed) if self._drop else (parsed, parsed.select("source_file", F.lit(None).cast("string").alias("copy_of")).limit(0))

    @property
    def mappers(self) -> DataFrame:
        return self._parsed[0]

    @property
    def copies(self) -> DataFrame:
        return self._parsed[1]

    @property
    def skipped(self) -> DataFrame:
        """Files that aren't analysed, and why."""
        return self.files.where("reason IS NOT NULL").select("source_file", "size", "reason").unionByName(self.copies.select("source_file", F.lit(None).cast("long").alias("size"), F.lit("BUILD_COPY").alias("reason")))

    @property
    def salvaged(self) -> DataFrame:
        """source_file, namespace, kind, id, line of what mapper files that can't be parsed define, by their text."""
        torn = self._parsed[0].where("dialect IS NULL").select("source_file")
        return projects.definitions(self.files.join(torn, "source_file", "left_semi"))

    def close(self) -> None:
        """Give back the memory of all tables that are kept; they are built anew when asked for."""
        for name, held in list(self.__dict__.items()):
            if name in ("spark", "files", "_drop"):
                continue
            for df in held if isinstance(held, tuple) else (held,):
                if isinstance(df, DataFrame):
                    df.unpersist()
            del self.__dict__[name]

    @cached_property
    def owners(self) -> DataFrame:
        return kernels.held(catalog.owners(self.mappers))

    @property
    def statements(self) -> DataFrame:
        return self.owners.where("kind = 'STATEMENT'").drop("nodes")

    @cached_property
    def symbols(self) -> DataFrame:
        return kernels.held(catalog.symbols(self.owners))

    @cached_property
    def registered(self) -> DataFrame:
        return kernels.held(catalog.registered(self.symbols))

    @cached_property
    def _sites(self) -> DataFrame:
        return kernels.held(catalog.includes(self.owners))

    @cached_property
    def include_tree(self) -> DataFrame:
        roots = self.owners.where("kind = 'STATEMENT'").select(F.col("qid").alias("root"), F.col("namespace").alias("root_ns")).distinct()
        return resolve.expand(roots, self._sites, self.symbols, self.registered)

    @cached_property
    def edges(self) -> DataFrame:
        return resolve.include_edges(self.include_tree, self._sites, self.symbols, self.registered).persist()

    @cached_property
    def map_references(self) -> DataFrame:
        return resolve.map_references(self.owners, self.symbols, self.registered).persist()

    @cached_property
    def rendered(self) -> DataFrame:
        return assemble.rendered(self.owners, self.include_tree).persist()

    @cached_property
    def analysed(self) -> DataFrame:
        """Facts of every statement; see facts.SHAPES."""
        return facts.analysed(self.rendered).persist()

    def facts(self, name: str) -> DataFrame:
        return facts.table(self.analysed, name)

    @cached_property
    def dependency_edges(self) -> DataFrame:
        """src, dst, kind: includes, missing includes, result maps, parameter maps, extends."""
        return self.edges.select("src", "dst", "kind").unionByName(self.map_references.where("found").select("src", "dst", "kind")).distinct()

    @property
    def problems(self) -> DataFrame:
        """severity, code, message, source_file, line over all stages."""
        shape = ["severity", "code", "message", "source_file", "line"]
        dialects = self.mappers.select(F.col("source_file").alias("from_file"), "dialect")
        tree = self.include_tree.join(dialects, "from_file", "left")
        names = self.symbols.where("kind = 'SQL_FRAGMENT'").select(F.col("qid").alias("name"))
        parts = [
            catalog.problems(self.mappers).select(shape),
            catalog.duplicate_symbols(self.symbols).withColumn("source_file", F.lit(None).cast("string")).withColumn("line", F.lit(None).cast("int")).select(shape),
            resolve.include_problems(tree, names).select(shape),
            resolve.map_problems(self.map_references, resolve.extends_chains(self.map_references)).select(shape),
            assemble.raw_substitutions(self.rendered).select(shape),
            assemble.oversized(self.rendered).select(shape),
            facts.parse_problems(self.analysed).join(self.rendered.select("statement", "source_file", "line"), "statement").select(shape),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # statements at work ---------------------------------------------------------------------------

    def statement(self, qid: str) -> dict:
        """One statement's resolved tree and dialect; a bare id is enough if one statement has it."""
        rows = self.rendered.where((F.col("statement") == qid) | F.endswith(F.col("statement"), F.lit(f".{qid}"))).select("statement", "tree", "dialect", "type").limit(2).collect()
        if len(rows) != 1:
            raise KeyError(f"{qid}: {len(rows)} statements")
        return {**rows[0].asDict(), "tree": json.loads(rows[0]["tree"])}

    def sql(self, qid: str, params: Any = None) -> tuple[str, list]:
        s = self.statement(qid)
        return render(s["tree"], params, s["dialect"])

    def run(self, qid: str, params: Any = None) -> DataFrame:
        return run_sql(self.spark, *self.sql(qid, params))


def run_sql(spark: SparkSession, sql: str, args: list, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A rendered statement on Spark's tables, after the rewrites that Spark's grammar needs."""
    sql, args = for_spark(sql, args)
    return spark.sql(named(sql), args={f"p{k}": v for k, v in enumerate(args)}, **(tables or {}))


def named(sql: str) -> str:
    """? as :p0, :p1, ... in order, so that no operator binds its arguments before another's."""
    out, n = [], 0
    for t in tokenize(sql):
        out.append(f":p{n}" if t.text == "?" else t.text)
        n += t.text == "?"
    return "".join(out)


def for_spark(sql: str, args: list) -> tuple[str, list]:
    """Spark's grammar: `(+)` joins become LEFT JOIN, `LIMIT ?, ?` becomes LIMIT and OFFSET with their arguments swapped."""
    from mapperlake.functions.sqlrewrite import outer_joins

    m = re.search(r"\bLIMIT\s+\?\s*,\s*\?\s*$", sql, re.I)
    if m:
        args = [*args[:-2], args[-1], args[-2]]
        sql = sql[: m.start()] + "LIMIT ? OFFSET ?"
    return (outer_joins(sql), args) if "(+)" in sql else (sql, args)

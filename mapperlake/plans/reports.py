"""Reports over a project: per mapper, per table, safety, summaries, search, guides. All are aggregates or joins of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapperlake.operators import facts, kernels, resolve
from mapperlake.plans.engine import Project

GRADES = ["SAFE", "WARNING", "MANUAL", "ERROR"]
TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE", "PROCEDURE"]


def mapper_report(p: Project) -> DataFrame:
    """source_file, statements by type, fragments, result_maps, parameter_maps, tables, warnings, errors."""
    kinds = p.owners.groupBy("source_file").agg(
        *[F.sum(F.when(F.col("type") == t, 1).otherwise(0)).alias(t.lower() + "s") for t in TYPES],
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(n) for k, n in (("SQL_FRAGMENT", "fragments"), ("RESULT_MAP", "result_maps"), ("PARAMETER_MAP", "parameter_maps"))],
    )
    used = p.facts("tables").where("NOT derived").join(p.rendered.select("statement", "source_file"), "statement").groupBy("source_file").agg(F.sort_array(F.collect_set("table")).alias("tables"))
    told = p.problems.groupBy("source_file").agg(F.sum(F.when(F.col("severity") == "WARNING", 1).otherwise(0)).alias("warnings"), F.sum(F.when(F.col("severity") == "ERROR", 1).otherwise(0)).alias("errors"))
    return kinds.join(used, "source_file", "left").join(told, "source_file", "left").fillna(0, ["warnings", "errors"])


def table_report(p: Project) -> DataFrame:
    """table, operation, statements."""
    return p.facts("tables").where("NOT derived AND table <> 'UNKNOWN'").groupBy("table", "operation").agg(F.sort_array(F.collect_set("statement")).alias("statements"))


def column_report(p: Project) -> DataFrame:
    """table, column, used_in, n_statements."""
    return p.facts("columns").where("NOT derived AND table <> 'UNKNOWN'").groupBy("table", "column", "used_in").agg(F.countDistinct("statement").alias("n_statements"))


def project_report(p: Project) -> DataFrame:
    """table, operations (map to statements), columns (map of column to clause counts)."""
    ops = table_report(p).groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct("operation", "statements"))).alias("operations"))
    cols = column_report(p).groupBy("table", "column").agg(F.map_from_entries(F.collect_list(F.struct("used_in", "n_statements"))).alias("uses"))
    return ops.join(cols.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct("column", "uses"))).alias("columns")), "table", "left")


def table_graph(p: Project) -> DataFrame:
    return resolve.table_graph(p.facts("joins"))


def table_details(p: Project, table: str) -> DataFrame:
    """statement, operation, alias of the statements that touch a table, in any case."""
    return p.facts("tables").where(F.upper("table") == table.upper()).select("statement", "operation", "alias")


def safety(events: DataFrame, owner: str = "owner") -> DataFrame:
    """Events by grade for each owner, all four grades."""
    return events.groupBy(owner).agg(*[F.sum(F.when(F.col("grade") == g, 1).otherwise(0)).alias(g) for g in GRADES])


def migration_summary(events: DataFrame, tree: DataFrame, statements: DataFrame) -> DataFrame:
    """Each statement's events: its own and those of the fragments that it includes."""
    reach = resolve.include_closure(tree).select(F.col("root").alias("statement"), F.col("fragment").alias("owner")).unionByName(statements.select(F.col("qid").alias("statement"), F.col("qid").alias("owner"))).distinct()
    return safety(reach.join(events, "owner"), "statement")


def migration_total(events: DataFrame) -> DataFrame:
    """Events of the whole project, each once."""
    return safety(events.dropDuplicates(["owner", "code", "token", "grade", "original"]).withColumn("all", F.lit("project")), "all")


def index_summary(p: Project) -> DataFrame:
    """namespace, files, statements, fragments, result maps."""
    return p.owners.groupBy("namespace").agg(F.countDistinct("source_file").alias("files"), *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(n) for k, n in (("STATEMENT", "statements"), ("SQL_FRAGMENT", "fragments"), ("RESULT_MAP", "result_maps"))])


def totals(p: Project) -> DataFrame:
    s = index_summary(p)
    return s.agg(F.count("*").alias("namespaces"), *[F.sum(c).alias(c) for c in ("files", "statements", "fragments", "result_maps")])


def statement_counts(p: Project) -> DataFrame:
    return facts.counts(p.analysed)


def dependency_tree(p: Project, statement: str) -> DataFrame:
    """kind, target, depth, status: what a statement depends on: includes, its result map and what that extends, its parameter map."""
    tree = p.include_tree.where(F.col("root") == statement).select(F.lit("INCLUDE").alias("kind"), F.col("dst").alias("target"), "depth", "status")
    refs = p.map_references.where(F.col("src") == statement)
    direct = refs.select("kind", F.col("dst").alias("target"), F.lit(1).alias("depth"), F.when(F.col("found"), "RESOLVED").otherwise("MISSING").alias("status"))
    chain = resolve.extends_chains(p.map_references).join(refs.where("kind = 'RESULT_MAP'").select(F.col("dst").alias("source")), "source").select(F.lit("EXTENDS").alias("kind"), "target", (F.col("depth") + 1).alias("depth"), F.lit("RESOLVED").alias("status"))
    return tree.unionByName(direct).unionByName(chain).distinct()


def result_map_users(p: Project) -> DataFrame:
    """result_map, statement: direct users and users of maps that extend it."""
    direct = p.map_references.where("kind = 'RESULT_MAP' AND found").select(F.col("dst").alias("result_map"), F.col("src").alias("statement"))
    below = resolve.extends_chains(p.map_references).select(F.col("target").alias("base"), F.col("source").alias("result_map"))
    return direct.unionByName(direct.join(below, "result_map").select(F.col("base").alias("result_map"), "statement")).distinct()


def search(p: Project, needle: str, most: int = 2000) -> DataFrame:
    """source_file, line, owner, kind, text, reason of lines, paths, namespaces and ids that hold a text, in any case; a fragment's hit also names the statements that include it. At most `most` rows (a report's limit); truncated says whether there are more. A project that is indexed (see Project.indexed) isn't scanned."""
    low = needle.lower()
    starts = p.owners.select("source_file", "line", F.struct("qid", "kind").alias("own"))
    if p.text_index is None:
        lines = p.files.where("text IS NOT NULL").select("source_file", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("line", F.col("n") + 1)
        lines = lines.join(starts, ["source_file", "line"], "left")
    else:  # only the lines that hold the text, and the places where owners start
        found = p.text_index.search([needle]).select(F.col("key").alias("source_file"), (F.col("line") + 1).alias("line"), "text")
        lines = found.join(starts, ["source_file", "line"], "full")
    owned = kernels.search_owner(lines, "source_file", "line", F.col("own"))
    hits = owned.where(F.lower("text").contains(low)).select("source_file", "line", F.col("owner.qid").alias("owner"), F.col("owner.kind").alias("kind"), F.trim("text").alias("text"), F.lit("text").alias("reason"))
    ids = p.owners.where(F.lower("qid").contains(low)).select("source_file", "line", F.col("qid").alias("owner"), "kind", F.lit("").alias("text"), F.lit("id").alias("reason"))
    paths = p.mappers.where(F.lower("source_file").contains(low) | F.lower("namespace").contains(low)).select("source_file", F.lit(1).alias("line"), F.lit(None).cast("string").alias("owner"), F.lit("MAPPER").alias("kind"), F.col("namespace").alias("text"), F.lit("path").alias("reason"))
    inside = hits.unionByName(ids).where("kind = 'SQL_FRAGMENT'").select(F.col("owner").alias("fragment")).distinct()
    reach = resolve.includers(p.include_tree, p.statements).join(inside, "fragment").select("source_file", F.lit(None).cast("int").alias("line"), F.col("statement").alias("owner"), F.lit("STATEMENT").alias("kind"), F.lit("").alias("text"), F.concat(F.lit("refid:"), "fragment").alias("reason"))
    found = hits.unionByName(ids).unionByName(paths).unionByName(reach).orderBy("source_file", "line", "owner", "reason").limit(most + 1)
    ranked = found.withColumn("n", F.row_number().over(Window.orderBy("source_file", "line", "owner", "reason"))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)  # of most + 1 rows
    return ranked.where(F.col("n") <= most).drop("n")


#: Words of conditions that are no columns.
_CONDITION_WORDS = "AND OR NOT NULL IS IN LIKE BETWEEN EXISTS AS TRUE FALSE".split()


def _names(text: Column) -> Column:
    """Upper-case names in a piece of SQL, without qualifiers, functions, strings, comments and parameters."""
    plain = F.regexp_replace(F.upper(text), r"'[^']*'|/\*.*?\*/|--[^\n]*|[#$]\{[^}]*\}|#[^#\s]+#|\$[^$\s]+\$", " ")
    found = F.regexp_extract_all(plain, F.lit(r"([A-Z_][\w$]*)(?!\w|\s*[.(])"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(_CONDITION_WORDS))


def column_guide(p: Project, table: str, column: str) -> DataFrame:
    """Steps to take when a column goes: action, statement, level, owner, source_file, line, detail.

    REMOVE_SELECT_ITEM where an output comes from it (level result in the main select, inner below);
    SHARED_FRAGMENT where a fragment of several statements writes it; in a fragment of one statement REMOVE_FRAGMENT, and
    REMOVE_INCLUDE for each of its include sites, if it names no other column, else REMOVE_SELECT_ITEM; REMOVE_RESULT_MAPPING
    or SHARED_RESULT_MAP for the mappings of such outputs; REMOVE_DYNAMIC_TAG for conditional tags that name it alone;
    CHECK_REFERENCE for its other uses; CHECK_JAVA for the mapped property. Names are looked for in the texts without their
    strings, comments and parameters.
    """
    t, c = table.upper(), column.upper()
    lineage = p.facts("lineage").where((F.upper("table") == t) & (F.upper("column") == c))
    where = p.rendered.select("statement", "source_file", "line")
    steps = lineage.join(where, "statement").select(F.lit("REMOVE_SELECT_ITEM").alias("action"), "statement", F.when(F.col("hops") == 0, "result").otherwise("inner").alias("level"), F.col("statement").alias("owner"), "source_file", "line", F.concat_ws(" <- ", "path").alias("detail"))
    uses = p.facts("columns").where((F.upper("table") == t) & (F.upper("column") == c) & (F.col("used_in") != "SELECT")).join(where, "statement")
    steps = steps.unionByName(uses.select(F.lit("CHECK_REFERENCE").alias("action"), "statement", F.lit("inner").alias("level"), F.col("statement").alias("owner"), "source_file", "line", F.col("used_in").alias("detail")))
    touched = p.facts("columns").where((F.upper("table") == t) & (F.upper("column") == c)).select("statement").distinct()
    text = F.concat_ws(" ", F.transform(F.filter("nodes", lambda n: n["type"] == "Text"), lambda n: n["text"]))
    named = p.owners.where(F.col("kind") == "SQL_FRAGMENT").select(F.col("qid").alias("fragment"), "source_file", "line", _names(text).alias("names"), F.exists("nodes", lambda n: n["type"] == "Include").alias("more"))
    named = named.where(F.array_contains("names", c)).withColumn("alone", ~F.col("more") & F.forall("names", lambda x: x == c))
    usage = resolve.include_usage(p.include_tree)
    reach = resolve.include_closure(p.include_tree).select("fragment", F.col("root").alias("statement"))
    hit = named.join(reach, "fragment").join(touched, "statement").join(usage, "fragment")
    action = F.when(F.col("n_statements") > 1, "SHARED_FRAGMENT").when(F.col("alone"), "REMOVE_FRAGMENT").otherwise("REMOVE_SELECT_ITEM")
    steps = steps.unionByName(hit.select(action.alias("action"), "statement", F.lit("inner").alias("level"), F.col("fragment").alias("owner"), "source_file", "line", F.concat(F.col("n_statements").cast("string"), F.lit(" statements")).alias("detail")))
    sites = resolve.include_sites(p.edges).join(hit.where("alone AND n_statements = 1").select("fragment", "statement").distinct(), "fragment")
    steps = steps.unionByName(sites.select(F.lit("REMOVE_INCLUDE").alias("action"), "statement", F.lit("inner").alias("level"), "owner", "source_file", "line", F.col("refid").alias("detail")))
    outputs = lineage.select("statement", F.upper("output").alias("label")).distinct()
    users = result_map_users(p)
    shared = users.groupBy("result_map").agg(F.count("*").alias("n"))
    maps = p.owners.where("kind = 'RESULT_MAP'").select(F.col("qid").alias("result_map"), "source_file", F.explode("nodes").alias("n")).where("n.attrs['column'] IS NOT NULL").select("result_map", "source_file", F.upper(F.col("n.attrs")["column"]).alias("label"), F.col("n.attrs")["property"].alias("property"), F.col("n.source_line").alias("line"))
    mapped = maps.join(users, "result_map").join(outputs, ["statement", "label"]).join(shared, "result_map")
    steps = steps.unionByName(mapped.select(F.when(F.col("n") > 1, "SHARED_RESULT_MAP").otherwise("REMOVE_RESULT_MAPPING").alias("action"), "statement", F.lit("result").alias("level"), F.col("result_map").alias("owner"), "source_file", "line", F.col("label").alias("detail")))
    steps = steps.unionByName(mapped.select(F.lit("CHECK_JAVA").alias("action"), "statement", F.lit("result").alias("level"), F.col("result_map").alias("owner"), "source_file", "line", F.col("property").alias("detail")))
    tags = p.owners.select("qid", "source_file", F.explode("nodes").alias("n")).where(F.col("n.type") == "Conditional").join(touched, F.col("qid") == F.col("statement"))
    kids = p.owners.select("qid", F.explode("nodes").alias("k")).where(F.col("k.type") == "Text").select("qid", F.col("k.parent_id").alias("parent"), F.col("k.text").alias("t"))
    inside = tags.join(kids, "qid").where(F.col("n.node_id") == F.col("parent")).groupBy("qid", "source_file", "statement", F.col("n.source_line").alias("line"), "parent").agg(F.concat_ws(" ", F.sort_array(F.collect_list("t"))).alias("t"))
    alone = inside.withColumn("names", _names(F.col("t"))).where(F.array_contains("names", c) & F.forall("names", lambda x: x == c))
    steps = steps.unionByName(alone.select(F.lit("REMOVE_DYNAMIC_TAG").alias("action"), "statement", F.lit("inner").alias("level"), F.col("qid").alias("owner"), "source_file", "line", F.trim("t").alias("detail")))
    return steps.distinct().orderBy("action", "source_file", "line")

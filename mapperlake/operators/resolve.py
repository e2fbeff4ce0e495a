"""References between mappers: lookups with tie-breaks, include closures, chains, trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.operators import kernels

FRAGMENT = "SQL_FRAGMENT"


def lookup(refs: DataFrame, all_symbols: DataFrame, registered: DataFrame, kind: str) -> DataFrame:
    """refs (key, refid, namespace, from_file) with target, how (QUALIFIED, NAMESPACE, GLOBAL_UNIQUE, DUPLICATE_SAME, NEAREST_DUPLICATE) and the number of candidates.

    As written; then in the namespace; then the one symbol of the wanted kind with that local id; of several,
    any if their contents are equal, else the one that shares most leading folders with the file, if only one does.
    Each step is an equi-join; references and symbols of one name never meet in pairs, but at their folders.
    """
    known = registered.select(F.col("qid").alias("__qid"))
    whole = refs.join(known, F.col("refid") == F.col("__qid"), "left").withColumn("t1", F.col("__qid")).drop("__qid")
    scoped = F.when(F.col("namespace") != "", F.concat_ws(".", "namespace", "refid"))
    spaced = whole.join(known, scoped == F.col("__qid"), "left").withColumn("t2", F.col("__qid")).drop("__qid")
    how = F.when(F.col("t1").isNotNull(), "QUALIFIED").when(F.col("t2").isNotNull(), "NAMESPACE")
    spaced = kernels.cut(spaced)
    if spaced.where("t1 IS NULL AND t2 IS NULL").isEmpty():
        return spaced.select(*refs.columns, F.coalesce("t1", "t2").alias("target"), how.alias("how"), F.lit(0).cast("long").alias("candidates"))
    wanted = kernels.first_wins(all_symbols.where(F.col("kind") == kind), ["qid"], ["source_file", "ord"]).select(F.col("local_id").alias("refid"), F.col("qid").alias("cand"), F.col("source_file").alias("cand_file"), "signature")
    spaced = spaced.withColumn("__in", F.when(F.col("t1").isNull() & F.col("t2").isNull(), kernels.folders(F.col("from_file"))))
    asked = spaced.where("__in IS NOT NULL").select("refid", "__in").distinct()
    wanted = wanted.join(asked.select("refid").distinct(), "refid", "left_semi")
    counted = wanted.groupBy("refid").agg(F.count("*").alias("n"), (F.min("signature") == F.max("signature")).alias("same"), F.min("cand").alias("least"))
    near = kernels.nearest_by_folder(asked, wanted.join(counted.where("n > 1 AND NOT same").select("refid"), "refid", "left_semi").select("refid", "cand", kernels.folders(F.col("cand_file")).alias("__of")), "refid", "__in", "cand", "__of")
    chosen = asked.join(counted, "refid").join(near.withColumnRenamed("cand", "near"), ["refid", "__in"], "left").select(
        "refid", "__in", "n",
        F.when((F.col("n") == 1) | F.col("same"), F.col("least")).otherwise(F.col("near")).alias("t3"),
        F.when(F.col("n") == 1, "GLOBAL_UNIQUE").when(F.col("same"), "DUPLICATE_SAME").when(F.col("near").isNotNull(), "NEAREST_DUPLICATE").alias("rule3"),
    )
    out = spaced.join(chosen, ["refid", "__in"], "left")
    out = out.withColumn("target", F.coalesce("t1", "t2", "t3")).withColumn("how", how.otherwise(F.col("rule3"))).withColumn("candidates", F.coalesce("n", F.lit(0).cast("long")))
    return out.select(*refs.columns, "target", "how", "candidates")


def include_targets(asked: DataFrame, all_symbols: DataFrame, registered: DataFrame) -> DataFrame:
    """asked (refid, namespace where it is written, source_file, root_ns of the statement), distinct, with target, rule, written, runtime, candidates.

    A bare refid in a fragment is looked up in the statement's namespace by the runtime and in the fragment's own by
    its author; rules are those of `lookup` and RUNTIME_SHADOWED, AUTHOR_NAMESPACE, MISSING.
    """
    key = lambda *c: F.sha2(F.concat_ws("\x1f", *c), 256)
    pairs = asked.select("refid", "namespace", "source_file").distinct()
    written = lookup(pairs.select(key("refid", "namespace", "source_file").alias("key"), "refid", "namespace", F.col("source_file").alias("from_file")), all_symbols, registered, FRAGMENT)
    written = written.select("refid", "namespace", F.col("from_file").alias("source_file"), F.col("target").alias("written"), F.col("how").alias("written_how"), "candidates")
    foreign = asked.where(~F.col("refid").contains(".") & (F.col("namespace") != F.col("root_ns")))
    run = lookup(foreign.select(key("refid", "root_ns", "source_file", "namespace").alias("key"), "refid", F.col("root_ns").alias("namespace"), F.col("source_file").alias("from_file"), F.col("namespace").alias("written_ns")), all_symbols, registered, FRAGMENT)
    run = run.select("refid", F.col("written_ns").alias("namespace"), F.col("from_file").alias("source_file"), F.col("namespace").alias("root_ns"), F.col("target").alias("runtime"), F.col("how").alias("runtime_how"))
    both = asked.join(written, ["refid", "namespace", "source_file"]).join(run, ["refid", "namespace", "source_file", "root_ns"], "left")
    own = F.col("refid").contains(".") | (F.col("namespace") == F.col("root_ns"))
    w, r = F.col("written"), F.col("runtime")
    author = w == F.concat_ws(".", "namespace", "refid")
    rule = (
        F.when(own, F.coalesce("written_how", F.lit("MISSING")))
        .when(r.isNotNull() & w.isNotNull() & (r != w), "RUNTIME_SHADOWED")
        .when(r.isNull() & w.isNotNull(), F.when(author, "AUTHOR_NAMESPACE").otherwise(F.col("written_how")))
        .when(r.isNotNull() & w.isNull(), F.col("runtime_how"))
        .otherwise(F.coalesce("written_how", F.lit("MISSING")))
    )
    return both.select("refid", "namespace", "source_file", "root_ns", F.when(own, w).otherwise(F.coalesce(r, w)).alias("target"), rule.alias("rule"), "written", "runtime", "candidates")


def expand(roots: DataFrame, sites: DataFrame, all_symbols: DataFrame, registered: DataFrame) -> DataFrame:
    """The includes that every root reaches, each site once: root, root_ns, depth (the least number of owners down to src), src, dst, refid, rule, status RESOLVED, MISSING or CIRCULAR.

    roots: root, root_ns. What a site means in its own namespace is looked up for all sites at once. A round joins the
    frontier to the sites below it; only bare refids that are met from another namespace are looked up there. It goes
    on with owners that the root hasn't reached before, so rounds end with the longest chain, and a fragment that is
    reached on many paths is read once.
    """
    place = ["refid", "namespace", "source_file"]
    pairs = sites.select(*place).distinct().withColumn("key", F.sha2(F.concat_ws("\x1f", *place), 256)).withColumnRenamed("source_file", "from_file")
    own = lookup(pairs, all_symbols, registered, FRAGMENT).select("refid", "namespace", F.col("from_file").alias("source_file"), "target", F.coalesce("how", F.lit("MISSING")).alias("rule"))
    below = kernels.cut(sites.select("owner_id", "owner_kind", *place, "node_id", "source_line").join(own, place))
    bare = ~F.col("refid").contains(".")
    may_differ = not below.where(bare & (F.col("owner_kind") == FRAGMENT)).isEmpty()
    start = frontier = roots.select("root", "root_ns", F.col("root").alias("at"))
    out = None
    depth = 0
    while True:
        depth += 1
        hits = frontier.join(below, F.col("at") == F.col("owner_id")).drop("owner_id", "owner_kind")
        foreign = hits.where(bare & (F.col("namespace") != F.col("root_ns")))
        if may_differ and not foreign.isEmpty():
            asked = foreign.select(*place, "root_ns").distinct()
            told = foreign.drop("target", "rule").join(include_targets(asked, all_symbols, registered).select(*place, "root_ns", "target", "rule"), [*place, "root_ns"])
            hits = hits.where(~(bare & (F.col("namespace") != F.col("root_ns")))).unionByName(told)
        more = hits.select("root", "root_ns", F.lit(depth).alias("depth"), F.col("at").alias("src"), F.coalesce("target", "refid").alias("dst"), "node_id", "refid", "rule", "source_line", F.col("source_file").alias("from_file"), F.col("namespace").alias("written_ns"), F.when(F.col("target").isNull(), "MISSING").otherwise("RESOLVED").alias("status"))
        more = kernels.cut(more)
        reached = more.where("status = 'RESOLVED'").select("root", "root_ns", F.col("dst").alias("at")).distinct()
        known = start if out is None else start.unionByName(out.where("status = 'RESOLVED'").select("root", "root_ns", F.col("dst").alias("at")))
        out = more if out is None else out.unionByName(more)
        frontier = reached.join(known, ["root", "root_ns", "at"], "left_anti")
        if frontier.isEmpty():
            return with_circles(out)
        if depth % 16 == 0:  # or the plan of all rounds' union grows without end
            out = kernels.cut(out)


def with_circles(tree: DataFrame) -> DataFrame:
    """tree with the status CIRCULAR where an include leads back: to an owner that is no further from the root than its own, and from which the include is reached again."""
    depths = tree.groupBy("root", "root_ns", F.col("src").alias("dst")).agg(F.min("depth").alias("dst_depth"))
    marked = tree.join(depths, ["root", "root_ns", "dst"], "left")
    back = kernels.cut(marked.where("status = 'RESOLVED' AND dst_depth <= depth").select("root_ns", "src", "dst").distinct())
    if back.isEmpty():
        return tree
    key = lambda c: F.concat_ws("\x1f", "root_ns", c)
    edges = tree.where("status = 'RESOLVED'").select(key("src").alias("src"), key("dst").alias("dst")).distinct()
    reach = kernels.closure(edges, back.select(key("dst").alias("node"))).select(F.col("source").alias("__d"), F.col("target").alias("__s"))
    circles = back.where("src = dst").unionByName(back.where("src <> dst").withColumns({"__d": key("dst"), "__s": key("src")}).join(reach, ["__d", "__s"], "left_semi").drop("__d", "__s")).withColumn("__circle", F.lit(True))
    told = marked.join(circles, ["root_ns", "src", "dst"], "left")
    status = F.when(F.col("__circle") & (F.col("dst_depth") <= F.col("depth")), "CIRCULAR").otherwise(F.col("status"))
    return told.withColumn("status", status).select(tree.columns)


def include_edges(tree: DataFrame, sites: DataFrame, all_symbols: DataFrame, registered: DataFrame) -> DataFrame:
    """src, dst, kind (INCLUDE or INCLUDE_MISSING), refid, rule, root_ns, from_file, source_line: what each owner includes, as the statements that reach it resolve it; in fragments that none reaches, as their own namespace does."""
    reached = tree.select("root_ns", "src", "dst", F.when(F.col("status") == "MISSING", "INCLUDE_MISSING").otherwise("INCLUDE").alias("kind"), "refid", "rule", "node_id", "from_file", "source_line").distinct()
    alone = sites.join(tree.select(F.col("src").alias("owner_id")).distinct(), "owner_id", "left_anti").withColumn("root_ns", F.col("namespace"))
    found = include_targets(alone.select("refid", "namespace", "source_file", "root_ns").distinct(), all_symbols, registered)
    rest = alone.join(found, ["refid", "namespace", "source_file", "root_ns"]).select("root_ns", F.col("owner_id").alias("src"), F.coalesce("target", "refid").alias("dst"), F.when(F.col("target").isNull(), "INCLUDE_MISSING").otherwise("INCLUDE").alias("kind"), "refid", "rule", "node_id", F.col("source_file").alias("from_file"), "source_line")
    return reached.unionByName(rest)


def include_problems(tree: DataFrame, misses: DataFrame) -> DataFrame:
    """Problems of includes, each told once: MISSING_REFERENCE (with hints), CIRCULAR_REFERENCE, REFID_DUPLICATE_SAME, REFID_NEAREST_DUPLICATE, MYBATIS_BARE_REFID, NESTED_REFID_SHADOWED, NESTED_REFID_NAMESPACE."""
    hints = kernels.near_misses(tree.where("status = 'MISSING'").select(F.col("refid").alias("ref")).distinct(), misses)
    told = tree.join(hints, F.col("refid") == F.col("ref"), "left")
    code = (
        F.when(F.col("status") == "MISSING", "MISSING_REFERENCE").when(F.col("status") == "CIRCULAR", "CIRCULAR_REFERENCE")
        .when(F.col("rule") == "DUPLICATE_SAME", "REFID_DUPLICATE_SAME").when(F.col("rule") == "NEAREST_DUPLICATE", "REFID_NEAREST_DUPLICATE")
        .when((F.col("rule") == "GLOBAL_UNIQUE") & (F.col("dialect") == "mybatis"), "MYBATIS_BARE_REFID")
        .when(F.col("rule") == "RUNTIME_SHADOWED", "NESTED_REFID_SHADOWED").when(F.col("rule") == "AUTHOR_NAMESPACE", "NESTED_REFID_NAMESPACE")
    )
    severity = F.when(F.col("status").isin("MISSING", "CIRCULAR"), "ERROR").otherwise("WARNING")
    message = F.concat_ws(" ", F.format_string("include of %s in %s", "refid", "src"), F.when(F.col("status") == "RESOLVED", F.format_string("is %s", "dst")), F.when(F.size("hints") > 0, F.concat(F.lit("near: "), F.concat_ws(", ", "hints"))))
    found = told.select(severity.alias("severity"), code.alias("code"), message.alias("message"), F.col("from_file").alias("source_file"), F.col("source_line").alias("line"), "refid", "root_ns")
    return found.where("code IS NOT NULL").dropDuplicates(["code", "source_file", "line", "refid"]).drop("root_ns")


def map_references(owned: DataFrame, all_symbols: DataFrame, registered: DataFrame) -> DataFrame:
    """src, dst, kind (RESULT_MAP, PARAMETER_MAP, EXTENDS), found, source_file, line of statements' and result maps' references."""
    parts = []
    for column, owner_kind, wanted, kind in (("resultMap", "STATEMENT", "RESULT_MAP", "RESULT_MAP"), ("parameterMap", "STATEMENT", "PARAMETER_MAP", "PARAMETER_MAP"), ("extends", "RESULT_MAP", "RESULT_MAP", "EXTENDS")):
        refs = owned.where((F.col("kind") == owner_kind) & F.col("attrs")[column].isNotNull()).select(F.concat_ws("\x1f", "qid", "source_file", "ord").alias("key"), F.trim(F.col("attrs")[column]).alias("refid"), "namespace", F.col("source_file").alias("from_file"), "qid", "line")
        hit = lookup(refs, all_symbols, registered, wanted)
        parts.append(hit.select(F.col("qid").alias("src"), F.coalesce("target", "refid").alias("dst"), F.lit(kind).alias("kind"), F.col("target").isNotNull().alias("found"), F.col("from_file").alias("source_file"), "line"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def map_problems(refs: DataFrame, chains: DataFrame) -> DataFrame:
    """MISSING_RESULT_MAP_REFERENCE, MISSING_PARAMETER_MAP_REFERENCE, MISSING_REFERENCE (extends), CIRCULAR_EXTENDS."""
    code = F.when(F.col("kind") == "RESULT_MAP", "MISSING_RESULT_MAP_REFERENCE").when(F.col("kind") == "PARAMETER_MAP", "MISSING_PARAMETER_MAP_REFERENCE").otherwise("MISSING_REFERENCE")
    lost = refs.where(~F.col("found")).select(F.lit("ERROR").alias("severity"), code.alias("code"), F.format_string("%s names %s, which isn't defined", "src", "dst").alias("message"), "source_file", "line", F.col("dst").alias("refid"))
    loops = chains.where("source = target").join(refs.where("kind = 'EXTENDS'"), F.col("source") == F.col("src")).select(F.lit("ERROR").alias("severity"), F.lit("CIRCULAR_EXTENDS").alias("code"), F.format_string("%s extends itself", "source").alias("message"), "source_file", "line", F.col("dst").alias("refid"))
    return lost.unionByName(loops.dropDuplicates(["message"]))


def extends_chains(refs: DataFrame) -> DataFrame:
    """source, target, depth: a result map's ancestors, nearest first."""
    edges = refs.where("kind = 'EXTENDS' AND found").select("src", "dst")
    return kernels.closure(edges, edges.select(F.col("src").alias("node")))


# graph views -----------------------------------------------------------------------------------


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Direct dependencies (out) and dependents (in) of a node."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "kind")
    return out.unionByName(edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "kind")).distinct()


def include_closure(tree: DataFrame) -> DataFrame:
    """root, fragment: all fragments that a statement includes, over any depth."""
    return tree.where("status <> 'MISSING'").select("root", F.col("dst").alias("fragment")).distinct()


def includers(tree: DataFrame, statements: DataFrame) -> DataFrame:
    """fragment, statement, source_file of the statements that include a fragment, over any depth."""
    return include_closure(tree).join(statements.select(F.col("qid").alias("root"), "source_file"), "root").select("fragment", F.col("root").alias("statement"), "source_file")


def include_usage(tree: DataFrame) -> DataFrame:
    """fragment, n_statements."""
    return include_closure(tree).groupBy("fragment").agg(F.countDistinct("root").alias("n_statements"))


def include_sites(edges: DataFrame) -> DataFrame:
    """fragment, owner, source_file, line, refid of direct includes."""
    return edges.where("kind = 'INCLUDE'").select(F.col("dst").alias("fragment"), F.col("src").alias("owner"), F.col("from_file").alias("source_file"), F.col("source_line").alias("line"), "refid").distinct()


def qualification(tree: DataFrame, owned: DataFrame) -> DataFrame:
    """refid sites and whether a converter must write them qualified: owner, refid, source_file, target, must_qualify, conflict (statements resolve it apart).

    A bare refid must be qualified if it leads to another namespace than its own, or if statements of other namespaces
    reach it; where one of these has a fragment of that name itself, it stays as it is, for the runtime takes that one.
    """
    g = tree.where("rule IS NOT NULL AND status <> 'MISSING'").groupBy("src", "refid", "from_file", "written_ns").agg(F.min("dst").alias("target"), F.countDistinct("dst").alias("n"), F.collect_set("root_ns").alias("roots"), F.max(F.col("rule") == "RUNTIME_SHADOWED").alias("shadowed"))
    own = F.when(F.col("written_ns") == "", F.col("refid")).otherwise(F.concat_ws(".", "written_ns", "refid"))
    reached = F.size(F.array_except("roots", F.array("written_ns"))) > 0
    must = ~F.col("shadowed") & ~F.col("refid").contains(".") & (reached | (F.col("target") != own))
    return g.select(F.col("src").alias("owner"), "refid", F.col("from_file").alias("source_file"), "target", must.alias("must_qualify"), (F.col("n") > 1).alias("conflict"))


def table_graph(joins: DataFrame) -> DataFrame:
    """left_table, right_table, statements: tables that statements join, derived ones left out."""
    real = joins.where("NOT left_derived AND NOT right_derived AND left_table IS NOT NULL AND right_table IS NOT NULL")
    return real.groupBy("left_table", "right_table").agg(F.sort_array(F.collect_set("statement")).alias("statements"))

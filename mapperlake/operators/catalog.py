"""Parsed mappers as tables: owners, symbols, nodes, includes, conflicts, namespaces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.operators import kernels
from mapperlake.sources.mappers import Problems, read_mapper, to_rows
from mapperlake.sources.projects import drop_copies

NODE = "struct<node_id: int, parent_id: int, ord: int, depth: int, type: string, attrs: map<string, string>, text: string, source_line: int>"
OWNER = f"struct<kind: string, id: string, type: string, tag: string, line: int, attrs: map<string, string>, nodes: array<{NODE}>>"
PARSED = f"source_file string, external boolean, dialect string, namespace string, signature string, owners array<{OWNER}>, problems array<struct<severity: string, code: string, message: string, line: int>>"


def parse(files: DataFrame) -> DataFrame:
    """PARSED of each mapper file; one that can't be parsed has only problems. External files keep fragments and result maps alone."""

    def run(batches):
        for pdf in batches:
            out = []
            for f, external, text in zip(pdf["source_file"], pdf["external"], pdf["text"], strict=True):
                problems = Problems()
                m = read_mapper(text, problems)
                told = [dict(zip(("severity", "code", "message", "line"), p, strict=True)) for p in problems]
                if m is None:
                    out.append((f, external, None, None, None, [], told))
                    continue
                owners = [{**{k: o[k] for k in ("kind", "id", "type", "tag", "line", "attrs")}, "nodes": to_rows(o["nodes"])} for o in m["owners"] if not external or o["kind"] != "STATEMENT"]
                ids = {k: sorted(o["id"] for o in owners if o["kind"] == k) for k in ("STATEMENT", "SQL_FRAGMENT", "RESULT_MAP")}
                signature = "|".join([m["dialect"], m["namespace"], *(",".join(x) for x in ids.values())])
                out.append((f, external, m["dialect"], m["namespace"], signature if any(ids.values()) else None, owners, told))
            yield pd.DataFrame(out, columns=["source_file", "external", "dialect", "namespace", "signature", "owners", "problems"])

    return files.where("text IS NOT NULL").select("source_file", "external", "text").mapInPandas(run, PARSED)


def without_copies(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed without build copies, the copies as source_file, copy_of)."""
    marked = drop_copies(parsed.withColumn("reason", F.lit(None).cast("string")))
    return marked.where("copy_of IS NULL").drop("copy_of", "reason"), marked.where("copy_of IS NOT NULL").select("source_file", "copy_of")


def owners(parsed: DataFrame) -> DataFrame:
    """A row per owner: source_file, dialect, namespace, kind, local_id, qid, type, tag, line, attrs, nodes, ord, signature of its content."""
    rows = parsed.select("source_file", "external", "dialect", "namespace", F.posexplode("owners").alias("ord", "o"))
    qid = F.when(F.col("namespace") == "", F.col("o.id")).otherwise(F.concat_ws(".", "namespace", "o.id"))
    squeezed = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    content = F.concat_ws("\x1e", F.transform("o.nodes", lambda n: F.concat_ws("\x1f", n["type"], n["depth"].cast("string"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(n["attrs"])))), squeezed(n["text"]))))
    return rows.select("source_file", "external", "dialect", "namespace", F.col("o.kind").alias("kind"), F.col("o.id").alias("local_id"), qid.alias("qid"), F.col("o.type").alias("type"), F.col("o.tag").alias("tag"), F.col("o.line").alias("line"), F.col("o.attrs").alias("attrs"), F.col("o.nodes").alias("nodes"), "ord", F.sha2(content, 256).alias("signature"))


def symbols(owned: DataFrame) -> DataFrame:
    """All registrations of the five kinds of symbols, without their trees."""
    return owned.select("qid", "local_id", "kind", "namespace", "source_file", "line", "ord", "signature", "dialect")


def registered(all_symbols: DataFrame) -> DataFrame:
    """The registration that counts for each qualified id, across kinds: the first by file and place."""
    return kernels.first_wins(all_symbols, ["qid"], ["source_file", "ord"])


def duplicate_symbols(all_symbols: DataFrame) -> DataFrame:
    """DUPLICATE_SYMBOL problems."""
    return kernels.conflicts(all_symbols, ["qid"]).select(F.lit("WARNING").alias("severity"), F.lit("DUPLICATE_SYMBOL").alias("code"), F.format_string("%s is defined %d times", "qid", "n").alias("message"), "qid")


def nodes(owned: DataFrame) -> DataFrame:
    """All nodes: owner_id, source_file, namespace, kind and the node's columns."""
    return owned.select(F.col("qid").alias("owner_id"), "source_file", "namespace", "dialect", F.col("kind").alias("owner_kind"), F.explode("nodes").alias("n")).select("owner_id", "source_file", "namespace", "dialect", "owner_kind", "n.*")


def includes(owned: DataFrame) -> DataFrame:
    """Include sites: owner_id, owner_kind, source_file, namespace, node_id, refid, source_line."""
    return nodes(owned).where("type = 'Include'").select("owner_id", "owner_kind", "source_file", "namespace", "dialect", "node_id", F.col("attrs")["refid"].alias("refid"), "source_line")


def namespaces(parsed: DataFrame) -> DataFrame:
    """Namespaces with their files, most files first."""
    return parsed.where("namespace IS NOT NULL").groupBy("namespace").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_set("source_file")).alias("files")).orderBy(F.desc("n_files"), "namespace")


def problems(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_file", F.explode("problems").alias("p")).select("source_file", "p.*")

"""Statements with their includes in place: one grouped step for each statement, from relational parts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.operators import flatten
from mapperlake.sources.mappers import from_rows

_CHOICE = "struct<group: int, kind: string, label: string>"
RENDERED = (
    "statement string, source_file string, namespace string, dialect string, type string, line int, attrs map<string, string>, tree string, "
    f"variants array<struct<sql: string, choices: array<{_CHOICE}>>>, "
    "parameters array<struct<name: string, expression: string, binding: string, used_in: string, jdbc_type: string, null_value: string, condition: string, condition_property: string, fragment: string, source_line: int, risk: string>>, "
    "conditions array<struct<kind: string, condition: string, property: string, compare_property: string, compare_value: string, test: string, prepend: string, text: string, depth: int, source_line: int>>"
)
#: Nodes of a statement's whole tree, and includes within each other; a statement beyond either is a problem of its own (see oversized).
MOST_NODES, MOST_DEPTH = 200_000, 500
_PART = "root string, part string, owner string, payload string"


class TooLarge(Exception):
    """A statement's includes unfold to more than can be analysed."""


def splice(root: str, own: list[dict], fragments: dict[str, list[dict]], targets: dict[tuple[str, str], str | None]) -> list[dict]:
    """The tree of a statement with every include's target in place. targets: (owner, refid) to the fragment, None where there is none."""

    placed = 0

    def place(nodes: list[dict], owner: str, path: tuple[str, ...]) -> list[dict]:
        nonlocal placed
        out = []
        placed += len(nodes)
        if placed > MOST_NODES or len(path) > MOST_DEPTH:
            raise TooLarge
        for n in nodes:
            n = {**n, "children": place(n["children"], owner, path)}
            if n["type"] == "Include":
                target = targets.get((owner, n["attrs"]["refid"]))
                n["target"] = target
                n["status"] = "MISSING" if target is None or target not in fragments else "CIRCULAR" if target in path else "RESOLVED"
                if n["status"] == "RESOLVED":
                    n["children"] = place(fragments[target], target, (*path, target))
            out.append(n)
        return out

    return place(own, root, (root,))


def rendered(owned: DataFrame, tree: DataFrame) -> DataFrame:
    """RENDERED of every statement.

    A statement's own tree and those of the fragments that it reaches meet in one group; a fragment's tree is sent
    once for each statement that reaches it, never for each place.
    """
    statements = owned.where("kind = 'STATEMENT'")
    nodes = F.to_json("nodes")
    about = F.to_json(F.struct("source_file", "namespace", "dialect", "type", "line", "attrs", F.col("nodes").alias("nodes")))
    own = statements.select(F.col("qid").alias("root"), F.lit("own").alias("part"), F.concat_ws("\x1f", "source_file", "ord").alias("owner"), about.alias("payload"))
    first = owned.where("kind = 'SQL_FRAGMENT'").groupBy("qid").agg(F.min(F.struct("source_file", "ord", nodes.alias("nodes"))).alias("f")).select("qid", F.col("f.nodes").alias("nodes"))
    reached = tree.where("status <> 'MISSING'").select("root", F.col("dst").alias("qid")).distinct()
    parts = reached.join(first, "qid").select("root", F.lit("fragment").alias("part"), F.col("qid").alias("owner"), F.col("nodes").alias("payload"))
    links = tree.select("root", F.lit("target").alias("part"), F.col("src").alias("owner"), F.to_json(F.struct("refid", F.when(F.col("status") != "MISSING", F.col("dst")).alias("target"))).alias("payload")).distinct()

    parsed: dict[str, list[dict]] = {}

    def tree_of(payload: str) -> list[dict]:
        """A fragment's tree; statements of a task share it, and splicing copies what it changes."""
        if payload not in parsed:
            if len(parsed) > 2_000:
                parsed.clear()
            parsed[payload] = from_rows(_rows(json.loads(payload)))
        return parsed[payload]

    def build(root: str, rows: list[tuple]) -> dict | None:
        mine = min(((o, p) for part, o, p in rows if part == "own"), default=None)  # the first registration counts
        if mine is None:
            return None
        fragments = {o: tree_of(p) for part, o, p in rows if part == "fragment"}
        targets = {}
        for part, o, p in rows:
            if part == "target":
                p = json.loads(p)
                targets[o, p["refid"]] = p.get("target")
        s = json.loads(mine[1])
        about = {"statement": root, **{k: s.get(k) for k in ("source_file", "namespace", "dialect", "type", "line")}, "attrs": s.get("attrs") or {}}
        try:
            whole = splice(root, from_rows(_rows(s.get("nodes") or [])), fragments, targets)
            return {**about, "tree": json.dumps(whole), "variants": flatten.variants(whole), "parameters": flatten.parameter_usages(whole), "conditions": flatten.conditions(whole)}
        except (TooLarge, RecursionError):  # this statement alone has no facts, and a problem
            return {**about, "tree": "[]", "variants": [], "parameters": [], "conditions": []}

    def run(batches):
        """Rows come sorted by statement; one statement's rows are held at a time."""
        names = ["statement", "source_file", "namespace", "dialect", "type", "line", "attrs", "tree", "variants", "parameters", "conditions"]
        done: list[dict] = []
        at, rows = None, []
        for pdf in batches:
            for root, *row in zip(pdf["root"], pdf["part"], pdf["owner"], pdf["payload"], strict=True):
                if root != at and rows:
                    done.append(build(at, rows))
                    rows = []
                at = root
                rows.append(tuple(row))
            if len(done) >= 500:
                yield pd.DataFrame([d for d in done if d], columns=names)
                done = []
        if rows:
            done.append(build(at, rows))
        yield pd.DataFrame([d for d in done if d], columns=names)

    whole = own.unionByName(parts).unionByName(links)
    return whole.repartition("root").sortWithinPartitions("root").mapInPandas(run, RENDERED)


def _rows(nodes: list[dict]) -> list[dict]:
    return [{"attrs": {}, "text": None, **n} for n in nodes]


def dynamic_conditions(done: DataFrame) -> DataFrame:
    return done.select("statement", F.posexplode("conditions").alias("ord", "c")).select("statement", "ord", "c.*")


def parameter_usages(done: DataFrame) -> DataFrame:
    return done.select("statement", "source_file", F.posexplode("parameters").alias("ord", "p")).select("statement", "source_file", "ord", "p.*")


def raw_substitutions(done: DataFrame) -> DataFrame:
    """RAW_SQL_SUBSTITUTION problems with the risk that each carries."""
    found = parameter_usages(done).where("binding = 'DOLLAR'")
    return found.select(F.lit("WARNING").alias("severity"), F.lit("RAW_SQL_SUBSTITUTION").alias("code"), F.format_string("$%s$ is put into the text", "name").alias("message"), "statement", "source_file", F.col("source_line").alias("line"), "risk")


def oversized(done: DataFrame) -> DataFrame:
    """STATEMENT_TOO_LARGE problems: statements whose includes or tags unfold beyond MOST_NODES or MOST_DEPTH, which have no text and no facts."""
    return done.where(F.size("variants") == 0).select(F.lit("ERROR").alias("severity"), F.lit("STATEMENT_TOO_LARGE").alias("code"), F.lit("its includes or tags unfold to more than can be analysed").alias("message"), "statement", "source_file", "line")

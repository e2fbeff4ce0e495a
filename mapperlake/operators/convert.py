"""The older dialect's trees as the newer one's, with a graded event for every decision.

Connectors: a tag whose first content drops its prepend becomes a trim that cuts the connectors its contents start
with; a WHERE over AND and OR becomes <where>, a SET over commas <set>. Conditions become expressions with the same
truth for nulls. Includes keep their refid, qualified where statements of other namespaces reach it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.functions.inline import parameters
from mapperlake.sources.mappers import from_rows, node, to_rows

#: The codes of events and their grades.
GRADES = {
    "HASH_PARAMETER": "SAFE", "RAW_SQL_SUBSTITUTION": "WARNING", "UNSUPPORTED_NULL_VALUE": "MANUAL", "CONDITIONAL_TO_IF": "SAFE", "PROPERTY_AVAILABLE_APPROXIMATED": "WARNING", "UNKNOWN_CONDITION": "MANUAL",
    "DYNAMIC_TO_WHERE": "SAFE", "DYNAMIC_TO_SET": "SAFE", "DYNAMIC_TRIM_INFERENCE": "WARNING", "DYNAMIC_OPEN_CLOSE_TO_TRIM": "SAFE", "ITERATE_TO_FOREACH": "SAFE", "REMOVE_FIRST_PREPEND": "WARNING",
    "INCLUDE_KEPT": "SAFE", "REFERENCE_QUALIFIED": "SAFE", "REFID_DEPENDS_ON_INCLUDER": "MANUAL", "SELECT_KEY_CONVERTED": "SAFE", "RESULT_MAP_CONVERTED": "SAFE", "GROUP_BY_TO_ID": "WARNING", "NESTED_RESULT_MAP": "WARNING",
    "NESTED_SELECT": "WARNING", "PROCEDURE_TO_CALLABLE": "WARNING", "CACHE_MODEL_DROPPED": "MANUAL", "PARAMETER_MAP_STATEMENT": "MANUAL", "ALREADY_MYBATIS": "SAFE",
}


class Converter:
    """Conversion of one owner."""

    def __init__(self, owner: str, qualified: dict[str, dict] | None = None):
        self.owner, self.qualified = owner, qualified or {}
        self.events: list[dict] = []
        self.collections: set[str] = set()
        self.items: list[tuple[str, str]] = []  # (iterated property, item's name), innermost last
        self.used = 0

    def event(self, code: str, line: int, detail: str = "", grade: str | None = None) -> None:
        self.events.append({"owner": self.owner, "code": code, "grade": grade or GRADES[code], "detail": detail, "line": line})

    # texts --------------------------------------------------------------------------------------
    def text(self, n: dict) -> dict:
        out, at, t = [], 0, n["text"]
        for p in parameters(t):
            out.append(t[at : p["start"]])
            name = self.path(p["property"])
            if p["binding"] == "DOLLAR":
                out.append("${" + name + "}")
                self.event("RAW_SQL_SUBSTITUTION", n["line"], p["raw"])
            else:
                out.append("#{" + name + (f",jdbcType={p['jdbcType']}" if p["jdbcType"] else "") + "}")
                self.event("HASH_PARAMETER", n["line"], p["raw"])
                if p["nullValue"] is not None:
                    self.event("UNSUPPORTED_NULL_VALUE", n["line"], p["raw"])
            at = p["end"]
        return node("Text", n["line"], text="".join(out) + t[at:], spaced="true")

    def path(self, name: str) -> str:
        """A property below the items that stand for its iterated parts."""
        for prop, item in reversed(self.items):
            mark = prop + "[]" if prop else "[]"
            if name == mark or name.startswith(mark):
                rest = name[len(mark) :]
                return item + rest
        return name

    # conditions ---------------------------------------------------------------------------------
    def test(self, n: dict) -> str:
        a = n["attrs"]
        kind, name = a["condition"], self.path(a.get("property") or "")
        listed = (a.get("property") or "") in self.collections
        guard = "".join(f"{'.'.join(name.split('.')[:k])} != null and " for k in range(1, len(name.split(".")))) if "[" not in name else ""
        if kind == "PARAMETER_PRESENT":
            return "_parameter != null"
        if kind == "NOT_PARAMETER_PRESENT":
            return "_parameter == null"
        if kind in ("PROPERTY_AVAILABLE", "NOT_PROPERTY_AVAILABLE"):
            self.event("PROPERTY_AVAILABLE_APPROXIMATED", n["line"], name)
            return f"{name} {'!=' if kind == 'PROPERTY_AVAILABLE' else '=='} null"
        if kind == "IS_NULL":
            return " or ".join([*(f"{'.'.join(name.split('.')[:k])} == null" for k in range(1, len(name.split('.')))), f"{name} == null"])
        if kind == "IS_NOT_NULL":
            return f"{guard}{name} != null"
        if kind == "IS_EMPTY":
            return f"{name} == null or {name}.size() == 0" if listed else f'{name} == null or {name} == ""'
        if kind == "IS_NOT_EMPTY":
            return f"{guard}{name} != null and {name}.size() > 0" if listed else f'{guard}{name} != null and {name} != ""'
        ops = {"EQUAL": "==", "NOT_EQUAL": "!=", "GREATER_THAN": ">", "GREATER_EQUAL": ">=", "LESS_THAN": "<", "LESS_EQUAL": "<="}
        if kind not in ops:
            self.event("UNKNOWN_CONDITION", n["line"], kind)
            return "true"
        op = ops[kind]
        if a.get("compareProperty"):
            other = self.path(a["compareProperty"])
            if kind in ("EQUAL", "NOT_EQUAL"):
                return f"{guard}{name} {op} {other}"
            both = f"{name} != null and {other} != null and {name} {op} {other}"
            return f"{both} or {name} == null and {other} == null" if "=" in op else both
        value = a.get("compareValue") or ""
        literal = value if re.fullmatch(r"-?\d+(\.\d+)?", value) else '"' + value.replace('"', '\\"') + '"'
        if kind == "NOT_EQUAL":
            return f"{name} == null or {name} != {literal}"
        return f"{guard}{name} != null and {name} {op} {literal}"

    # tags ---------------------------------------------------------------------------------------
    def connectors(self, nodes: list[dict]) -> list[str]:
        """What the contents of a tag can start with: prepends of its conditional contents, in order of appearance."""
        out: list[str] = []
        for c in nodes:
            lead = (c["attrs"].get("prepend") or "").strip()
            if lead and lead not in out:
                out.append(lead)
            if c["type"] == "Conditional" and not lead or c["type"] == "Include":
                out += [x for x in self.connectors(c["children"]) if x not in out]
        return out

    def children(self, nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes:
            out += self.tag(n)
        return out

    def wrap(self, n: dict, inner: list[dict], scoped: bool = True) -> list[dict]:
        """What a tag's prepend, open and close, and the rule for its first content, add around its contents."""
        a, line = n["attrs"], n["line"]
        lead, before, after = (a.get("prepend") or "").strip(), a.get("open") or "", a.get("close") or ""
        found = self.connectors(n["children"]) if scoped else []
        if scoped and not lead and n["type"] == "Conditional":
            found = []
        if lead.upper() == "WHERE" and not before and not after and found and {x.upper() for x in found} <= {"AND", "OR"}:
            self.event("DYNAMIC_TO_WHERE", line)
            return [node("Dynamic", line, inner, trim="true", tag="where", prefix="WHERE", prefixOverrides="AND|OR")]
        if lead.upper() == "SET" and not before and not after and set(found) <= {","} and found:
            self.event("DYNAMIC_TO_SET", line)
            return [node("Dynamic", line, inner, trim="true", tag="set", prefix="SET", prefixOverrides=",", suffixOverrides=",")]
        certain = any(c["type"] == "Text" and c["text"].strip() for c in n["children"])  # else the contents may be blank, and the connector with them
        if found or before or after or lead and (n["type"] != "Conditional" or not certain):
            self.event("DYNAMIC_OPEN_CLOSE_TO_TRIM" if before or after else "DYNAMIC_TRIM_INFERENCE", line, lead, "SAFE" if len(found) < 2 else None)
            return [node("Dynamic", line, inner, trim="true", tag="trim", prefix=f"{lead} {before}".strip() or None, suffix=after.strip() or None, prefixOverrides="|".join(x + (" " if x.isalpha() else "") for x in found) or None)]
        return [node("Text", line, text=f"{lead} ", spaced="true"), *inner] if lead else inner

    def tag(self, n: dict) -> list[dict]:
        a, line, kind = n["attrs"], n["line"], n["type"]
        if kind == "Text":
            return [self.text(n)]
        if kind == "Include":
            q = self.qualified.get(a["refid"])
            refid = a["refid"]
            if q and q.get("conflict"):
                self.event("REFID_DEPENDS_ON_INCLUDER", line, refid)
            elif q and q.get("must_qualify") and q["target"] != refid:
                self.event("REFERENCE_QUALIFIED", line, f"{refid} -> {q['target']}")
                refid = q["target"]
            else:
                self.event("INCLUDE_KEPT", line, refid)
            return [node("Include", line, refid=refid)]
        if kind == "SelectKey":
            order = a.get("order") or ("BEFORE" if a.get("type") == "pre" else "AFTER" if a.get("type") == "post" else None)
            self.event("SELECT_KEY_CONVERTED", line, order or "")
            return [node("SelectKey", line, self.children(n["children"]), keyProperty=a.get("keyProperty"), resultType=a.get("resultClass") or a.get("resultType"), order=order or "BEFORE", keyColumn=a.get("keyColumn"))]
        if kind == "Iterate":
            self.event("ITERATE_TO_FOREACH", line, a.get("property") or "")
            prop = a.get("property") or ""
            self.used += 1
            item = f"item{self.used if self.used > 1 else ''}"
            collection = self.path(prop) if prop else "list"
            self.items.append((prop, item))
            inner = self.children(n["children"])
            self.items.pop()
            if a.get("removeFirstPrepend") in ("true", "iterate"):
                self.event("REMOVE_FIRST_PREPEND", line, a["removeFirstPrepend"])
                found = self.connectors(n["children"])
                inner = [node("Dynamic", line, inner, trim="true", tag="trim", prefixOverrides="|".join(x + " " for x in found) or None)] if found else inner
            each = [node("Iterate", line, inner, property=collection, item=item, conjunction=a.get("conjunction"))]
            lead, before, after = (a.get("prepend") or "").strip(), a.get("open") or "", a.get("close") or ""
            if not lead:
                each[0]["attrs"] |= {k: v for k, v in (("open", before), ("close", after)) if v}
                return each
            return [node("Dynamic", line, each, trim="true", tag="trim", prefix=f"{lead} {before}".strip(), suffix=after.strip() or None)]
        if kind == "Dynamic":
            return self.wrap(n, self.children(n["children"]))
        if kind == "Conditional":
            self.event("CONDITIONAL_TO_IF", line, a["condition"])
            test = self.test(n)
            if a.get("removeFirstPrepend") in ("true", "iterate"):
                self.event("REMOVE_FIRST_PREPEND", line)
            return [node("Conditional", line, self.wrap(n, self.children(n["children"])), condition="TEST", test=test)]
        return [n]

    def results(self, nodes: list[dict], group_by: set[str]) -> list[dict]:
        """Result rows: grouped properties are ids; nested maps and selects are associations, or collections where the type is a list."""
        out = []
        for n in nodes:
            a = dict(n["attrs"])
            tag, many = "result", bool(re.search(r"(?i)(list|set|collection|\[\])$", a.get("javaType") or ""))
            if a.get("resultMap"):
                tag = "collection" if many or "." not in a["resultMap"] and a.get("javaType") is None else "association"
                self.event("NESTED_RESULT_MAP", n["line"], a["resultMap"])
            elif a.get("select"):
                tag = "collection" if many else "association"
                self.event("NESTED_SELECT", n["line"], a["select"])
            elif a.get("property") in group_by:
                tag = "id"
                self.event("GROUP_BY_TO_ID", n["line"], a["property"])
            if a.pop("nullValue", None) is not None:
                self.event("UNSUPPORTED_NULL_VALUE", n["line"], a.get("property") or "")
            a.pop("columnIndex", None)
            a.pop("tag", None)
            out.append(node("Result", n["line"], tag=tag, **a))
        order = {"id": 0, "result": 1, "association": 2, "collection": 3}
        return sorted(out, key=lambda x: order[x["attrs"]["tag"]])

    def owner_tree(self, kind: str, type_: str | None, attrs: dict, nodes: list[dict], line: int, refs: dict[str, str] | None = None) -> tuple[str, dict, list[dict]]:
        """(tag, attributes, nodes) of an owner in the newer dialect. refs: qualified names of its maps."""
        refs = refs or {}
        if kind == "RESULT_MAP":
            self.event("RESULT_MAP_CONVERTED", line)
            groups = {x.strip() for x in (attrs.get("groupBy") or "").split(",") if x.strip()}
            kept = {"type": attrs.get("class") or attrs.get("type"), "extends": refs.get("extends", attrs.get("extends"))}
            return "resultMap", {k: v for k, v in kept.items() if v}, self.results(nodes, groups)
        if kind == "CACHE_MODEL":
            self.event("CACHE_MODEL_DROPPED", line)
            return "", {}, []
        work = list(nodes)
        while work:
            n = work.pop()
            if n["type"] == "Iterate" and n["attrs"].get("property"):
                self.collections.add(n["attrs"]["property"])
            work += n["children"]
        new = {"parameterType": attrs.get("parameterClass") or attrs.get("parameterType"), "resultMap": refs.get("resultMap", attrs.get("resultMap")), "resultType": attrs.get("resultClass") or attrs.get("resultType")}
        for k in ("timeout", "fetchSize", "resultSetType"):
            new[k] = attrs.get(k)
        if attrs.get("parameterMap"):
            self.event("PARAMETER_MAP_STATEMENT", line, attrs["parameterMap"])
            new["parameterMap"] = refs.get("parameterMap", attrs["parameterMap"])
        tag = "sql" if kind == "SQL_FRAGMENT" else (type_ or "SELECT").lower()
        if type_ == "PROCEDURE":
            self.event("PROCEDURE_TO_CALLABLE", line)
            tag = "select" if new["resultMap"] or new["resultType"] else "update"
            new["statementType"] = "CALLABLE"
        return tag, {} if kind == "SQL_FRAGMENT" else {k: v for k, v in new.items() if v}, self.children(nodes)


def convert_tree(nodes: list[dict]) -> list[dict]:
    """A resolved older tree as a newer one; includes stay in place with their converted contents."""
    c = Converter("")
    work = list(nodes)
    while work:
        n = work.pop()
        if n["type"] == "Iterate" and n["attrs"].get("property"):
            c.collections.add(n["attrs"]["property"])
        work += n["children"]

    def lift(siblings: list[dict]) -> list[dict]:
        out = []
        for n in siblings:
            out += lift(n["children"]) if n["type"] == "Include" else [{**n, "children": lift(n["children"])}]
        return out

    return c.children(lift(nodes))


_EVENT = "struct<owner: string, code: string, grade: string, detail: string, line: int>"


def converted(owned: DataFrame, qualification: DataFrame, map_references: DataFrame) -> DataFrame:
    """owners in the newer dialect (tag, attrs, nodes replaced) with `events`; owners that are there already pass with one event."""
    q = qualification.groupBy(F.col("owner").alias("__o"), F.col("source_file").alias("__f")).agg(F.to_json(F.collect_list(F.struct("refid", "target", "must_qualify", "conflict"))).alias("__q"))
    r = map_references.where("found").groupBy(F.col("src").alias("__s")).agg(F.to_json(F.collect_list(F.struct("kind", "dst"))).alias("__r"))
    joined = owned.join(q, (owned["qid"] == q["__o"]) & (owned["source_file"] == q["__f"]), "left").drop("__o", "__f").join(r, F.col("qid") == F.col("__s"), "left").drop("__s")
    names = owned.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in owned.schema) + f", events array<{_EVENT}>"

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                owner = {k: row[k] for k in names}
                if owner["dialect"] != "ibatis":
                    out.append({**owner, "attrs": dict(owner["attrs"] or {}), "nodes": [{**dict(n), "attrs": dict(n["attrs"] or {})} for n in owner["nodes"]], "events": [{"owner": owner["qid"], "code": "ALREADY_MYBATIS", "grade": "SAFE", "detail": "", "line": owner["line"]}]})
                    continue
                q_of = {x["refid"]: x for x in json.loads(row["__q"])} if isinstance(row["__q"], str) else {}
                found = {x["kind"]: x["dst"] for x in json.loads(row["__r"])} if isinstance(row["__r"], str) else {}
                ns = owner["namespace"] + "."
                refs = {a: found[k].removeprefix(ns) if found[k].startswith(ns) else found[k] for k, a in (("RESULT_MAP", "resultMap"), ("PARAMETER_MAP", "parameterMap"), ("EXTENDS", "extends")) if k in found}
                c = Converter(owner["qid"], q_of)
                tag, attrs, nodes = c.owner_tree(owner["kind"], owner["type"], dict(owner["attrs"] or {}), from_rows([{**dict(n)} for n in owner["nodes"]]), owner["line"], refs)
                out.append({**owner, "tag": tag, "attrs": attrs, "nodes": to_rows(nodes), "dialect": "mybatis", "events": c.events})
            yield pd.DataFrame(out, columns=[*names, "events"])

    return joined.mapInPandas(run, schema)


def events(done: DataFrame) -> DataFrame:
    return done.select("source_file", F.explode("events").alias("e")).select("source_file", "e.*")

"""Mapper tags of both dialects to owners and node trees, and node trees to pre-order rows and back.

A node is a dict: type, attrs (strings), text, line, children. Types: Text, Dynamic, Conditional, Iterate, Include,
SelectKey, Bind, Result. Both dialects give the same types, so that all later operators see one model.
"""

from __future__ import annotations

from mapperlake.sources import markup

#: Condition names by tag.
CONDITIONS = {
    "isNull": "IS_NULL",
    "isNotNull": "IS_NOT_NULL",
    "isEmpty": "IS_EMPTY",
    "isNotEmpty": "IS_NOT_EMPTY",
    "isEqual": "EQUAL",
    "isNotEqual": "NOT_EQUAL",
    "isGreaterThan": "GREATER_THAN",
    "isGreaterEqual": "GREATER_EQUAL",
    "isLessThan": "LESS_THAN",
    "isLessEqual": "LESS_EQUAL",
    "isPropertyAvailable": "PROPERTY_AVAILABLE",
    "isNotPropertyAvailable": "NOT_PROPERTY_AVAILABLE",
    "isParameterPresent": "PARAMETER_PRESENT",
    "isNotParameterPresent": "NOT_PARAMETER_PRESENT",
}
STATEMENTS = {"select": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "procedure": "PROCEDURE", "statement": "SELECT"}
_RESULTS = ("result", "id", "association", "collection", "constructor", "discriminator")
_IGNORED = {"typeAlias", "cache", "cache-ref", "parameterMap#mybatis", "typeHandler"}


class Problems(list):
    def add(self, severity: str, code: str, message: str, line: int) -> None:
        self.append((severity, code, message, line))


def node(kind: str, line: int, children: list | None = None, text: str | None = None, **attrs) -> dict:
    return {"type": kind, "attrs": {k: v for k, v in attrs.items() if v is not None}, "text": text, "line": line, "children": children or []}


def _needs(e: dict, attr: str, code: str, problems: Problems) -> bool:
    if e["attrs"].get(attr):
        return True
    problems.add("ERROR", code, f"<{e['tag']}> has no {attr}", e["line"])
    return False


def _children(e: dict, dialect: str, problems: Problems) -> list[dict]:
    out = []
    for c in e["children"]:
        if "tag" not in c:
            out.append(node("Text", c["line"], text=c["text"], spaced="true" if dialect == "mybatis" else None))
        else:
            out += _tag(c, dialect, problems)
    return out


def _tag(e: dict, dialect: str, problems: Problems) -> list[dict]:
    """An inline tag's nodes; an unknown tag is transparent."""
    tag, a, line = e["tag"], e["attrs"], e["line"]
    inside = lambda: _children(e, dialect, problems)
    if tag == "include":
        if any(c.get("tag") == "property" for c in e["children"]):
            problems.add("WARNING", "UNSUPPORTED_TAG", "<property> of <include> is ignored", line)
        return [node("Include", line, refid=a["refid"])] if _needs(e, "refid", "MISSING_REFID_ATTR", problems) else []
    if tag == "selectKey":
        return [node("SelectKey", line, inside(), **{k: a.get(k) for k in ("keyProperty", "resultClass", "resultType", "type", "order", "keyColumn")})]
    if dialect == "ibatis":
        if tag == "dynamic":
            return [node("Dynamic", line, inside(), prepend=a.get("prepend"), open=a.get("open"), close=a.get("close"))]
        if tag == "iterate":
            return [node("Iterate", line, inside(), **{k: a.get(k) for k in ("property", "prepend", "open", "close", "conjunction", "removeFirstPrepend")})]
        if tag in CONDITIONS:
            if "Parameter" not in tag and not _needs(e, "property", "MISSING_PROPERTY_ATTR", problems):
                return []
            return [node("Conditional", line, inside(), condition=CONDITIONS[tag], **{k: a.get(k) for k in ("property", "prepend", "open", "close", "compareProperty", "compareValue", "removeFirstPrepend")})]
    else:
        if tag in ("if", "when"):
            return [node("Conditional", line, inside(), condition="TEST" if tag == "if" else "WHEN", test=a.get("test", ""))]
        if tag == "otherwise":
            return [node("Conditional", line, inside(), condition="OTHERWISE")]
        if tag == "choose":
            return [node("Conditional", line, [c for c in inside() if c["type"] == "Conditional"], condition="CHOOSE")]
        if tag == "where":
            return [node("Dynamic", line, inside(), trim="true", prefix="WHERE", prefixOverrides="AND|OR")]
        if tag == "set":
            return [node("Dynamic", line, inside(), trim="true", prefix="SET", prefixOverrides=",", suffixOverrides=",")]
        if tag == "trim":
            return [node("Dynamic", line, inside(), trim="true", **{k: a.get(k) for k in ("prefix", "suffix", "prefixOverrides", "suffixOverrides")})]
        if tag == "foreach":
            return [node("Iterate", line, inside(), property=a.get("collection"), conjunction=a.get("separator"), **{k: a.get(k) for k in ("open", "close", "item", "index")})]
        if tag == "bind":
            return [node("Bind", line, name=a.get("name"), value=a.get("value"))]
    problems.add("WARNING", "UNSUPPORTED_TAG", f"<{tag}> is read as its contents", line)
    return inside()


def _result_nodes(e: dict, problems: Problems) -> list[dict]:
    out = []
    for c in e["children"]:
        if c.get("tag") in _RESULTS:
            out.append(node("Result", c["line"], _result_nodes(c, problems), tag=c["tag"], **c["attrs"]))
        elif "tag" in c:
            problems.add("WARNING", "UNSUPPORTED_TAG", f"<{c['tag']}> in a result map is left out", c["line"])
    return out


def read_mapper(source: str, problems: Problems) -> dict | None:
    """dialect, namespace and owners (kind, id, type, line, attrs, nodes) of a mapper file; None if it isn't one."""
    root, found = markup.parse(source)
    problems += found
    if root is None or root["tag"] not in ("sqlMap", "mapper"):
        return None
    dialect = "ibatis" if root["tag"] == "sqlMap" else "mybatis"
    namespace = root["attrs"].get("namespace", "")
    if not namespace:
        problems.add("WARNING", "MISSING_NAMESPACE", f"<{root['tag']}> has no namespace", root["line"])
    owners = []
    for e in (c for c in root["children"] if "tag" in c):
        tag = e["tag"]
        if tag in _IGNORED or f"{tag}#{dialect}" in _IGNORED:
            continue
        kind = "STATEMENT" if tag in STATEMENTS else {"sql": "SQL_FRAGMENT", "resultMap": "RESULT_MAP", "parameterMap": "PARAMETER_MAP", "cacheModel": "CACHE_MODEL"}.get(tag)
        if kind is None:
            problems.add("WARNING", "UNSUPPORTED_TAG", f"<{tag}> is left out", e["line"])
            continue
        if not _needs(e, "id", "MISSING_ID_ATTR", problems):
            continue
        if kind in ("STATEMENT", "SQL_FRAGMENT"):
            try:
                nodes = _children(e, dialect, problems)
            except RecursionError:  # this owner alone has no content
                nodes = []
                problems.add("ERROR", "NESTED_TOO_DEEPLY", f"tags of {e['attrs']['id']} are nested too deeply to be read", e["line"])
        elif kind == "RESULT_MAP":
            nodes = _result_nodes(e, problems)
        else:
            nodes = [node("Result", c["line"], tag=c["tag"], **c["attrs"]) for c in e["children"] if "tag" in c]
        owners.append({"kind": kind, "id": e["attrs"]["id"], "type": STATEMENTS.get(tag), "tag": tag, "line": e["line"], "attrs": {k: v for k, v in e["attrs"].items() if k != "id"}, "nodes": nodes})
    return {"dialect": dialect, "namespace": namespace, "owners": owners}


def to_rows(nodes: list[dict]) -> list[dict]:
    """Pre-order rows: node_id, parent_id (-1 at the top), ord, depth, type, attrs, text, source_line."""
    out: list[dict] = []
    work = [(n, -1, k, 0) for k, n in reversed(list(enumerate(nodes)))]
    while work:
        n, parent, k, depth = work.pop()
        number = len(out)
        out.append({"node_id": number, "parent_id": parent, "ord": k, "depth": depth, "type": n["type"], "attrs": n["attrs"], "text": n["text"], "source_line": n["line"]})
        work += [(c, number, i, depth + 1) for i, c in reversed(list(enumerate(n["children"])))]
    return out


def from_rows(rows) -> list[dict]:
    """The node trees of pre-order rows (dicts or Rows)."""
    made: dict[int, dict] = {}
    top = []
    for r in sorted(rows, key=lambda x: x["node_id"]):
        made[r["node_id"]] = n = {"type": r["type"], "attrs": dict(r["attrs"] or {}), "text": r["text"], "line": r["source_line"], "children": [], "node_id": r["node_id"]}
        (made[r["parent_id"]]["children"] if r["parent_id"] >= 0 else top).append(n)
    return top

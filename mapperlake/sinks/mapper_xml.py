"""Mapper XML of owners, one document for each file, in either dialect."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.sinks.sqllayout import layout, pretty
from mapperlake.sources.mappers import CONDITIONS, from_rows

STEP = "  "
_TAG_OF = {v: k for k, v in CONDITIONS.items()}
#: The document types of both formats.
_DOCTYPES = {
    "mybatis": '<!DOCTYPE mapper PUBLIC "-//mybatis.org//DTD Mapper 3.0//EN" "http://mybatis.org/dtd/mybatis-3-mapper.dtd">',
    "ibatis": '<!DOCTYPE sqlMap PUBLIC "-//ibatis.apache.org//DTD SQL Map 2.0//EN" "http://ibatis.apache.org/dtd/sql-map-2.dtd">',
}
_ORDER = {"CACHE_MODEL": 0, "SQL_FRAGMENT": 1, "PARAMETER_MAP": 2, "RESULT_MAP": 3, "STATEMENT": 4}


def attribute_text(value: str) -> str:
    return escape(value, {'"': "&quot;", "\n": "&#10;", "\t": "&#9;"})


def attributes(attrs: dict) -> str:
    return "".join(f' {k}="{attribute_text(str(v))}"' for k, v in attrs.items() if v is not None)


def tag_of(n: dict, dialect: str) -> tuple[str, dict]:
    """A node's tag and attributes."""
    a, kind = n["attrs"], n["type"]
    pick = lambda *names: {k: a.get(k) for k in names}
    if kind == "Include":
        return "include", pick("refid")
    if kind == "SelectKey":
        return "selectKey", pick("keyProperty", "keyColumn", "resultType", "resultClass", "order", "type")
    if kind == "Bind":
        return "bind", pick("name", "value")
    if dialect == "ibatis":
        if kind == "Dynamic":
            return "dynamic", pick("prepend", "open", "close")
        if kind == "Iterate":
            return "iterate", pick("property", "prepend", "open", "close", "conjunction", "removeFirstPrepend")
        return _TAG_OF[a["condition"]], pick("property", "compareProperty", "compareValue", "prepend", "open", "close", "removeFirstPrepend")
    if kind == "Dynamic":
        tag = a.get("tag") or ("where" if a.get("prefix") == "WHERE" and a.get("prefixOverrides") == "AND|OR" else "set" if a.get("prefix") == "SET" else "trim")
        return tag, {} if tag in ("where", "set") else pick("prefix", "prefixOverrides", "suffix", "suffixOverrides")
    if kind == "Iterate":
        return "foreach", {"collection": a.get("property"), "item": a.get("item"), "index": a.get("index"), "open": a.get("open"), "separator": a.get("conjunction"), "close": a.get("close")}
    tag = {"TEST": "if", "WHEN": "when", "OTHERWISE": "otherwise", "CHOOSE": "choose"}[a["condition"]]
    return tag, pick("test") if tag in ("if", "when") else {}


def is_glued(siblings: list[dict], k: int) -> bool:
    """A tag of one text without white space, right behind a word: a line break would cut a name in two."""
    n = siblings[k]
    body = n["children"]
    lone = len(body) == 1 and body[0]["type"] == "Text" and body[0]["text"] and not any(c.isspace() for c in body[0]["text"])
    before = siblings[k - 1]["text"] if k and siblings[k - 1]["type"] == "Text" else ""
    return bool(lone and before and not before[-1:].isspace())


def write_nodes(nodes: list[dict], dialect: str, depth: int, formatted: bool = False) -> str:
    out: list[str] = []
    pad = STEP * depth
    for k, n in enumerate(nodes):
        if n["type"] == "Text":
            text = pretty(n["text"]) if formatted and n["text"].strip() else n["text"]
            if text.strip():
                after_glue = k and nodes[k - 1]["type"] != "Text" and is_glued(nodes, k - 1)
                laid = layout(text, pad)
                out.append(escape(laid.lstrip() if after_glue and not text[:1].isspace() else laid))
                if k + 1 < len(nodes) and nodes[k + 1]["type"] != "Text" and is_glued(nodes, k + 1):
                    continue
                out.append("\n")
            continue
        tag, attrs = tag_of(n, dialect)
        if n["type"] != "Text" and is_glued(nodes, k):
            following = nodes[k + 1]["text"] if k + 1 < len(nodes) and nodes[k + 1]["type"] == "Text" else "\n"
            out.append(f"<{tag}{attributes(attrs)}>{escape(n['children'][0]['text'])}</{tag}>" + (" " if following.strip() else "\n"))
        elif n["children"]:
            out.append(f"{pad}<{tag}{attributes(attrs)}>\n{write_nodes(n['children'], dialect, depth + 1, formatted)}{pad}</{tag}>\n")
        else:
            out.append(f"{pad}<{tag}{attributes(attrs)}/>\n")
    return "".join(out)


def write_results(nodes: list[dict], depth: int) -> str:
    """Result rows in the order that the newer dialect's grammar asks for."""
    order = {"constructor": 0, "id": 1, "result": 2, "association": 3, "collection": 4, "discriminator": 5}
    out = []
    for n in sorted(nodes, key=lambda n: order.get(n["attrs"].get("tag", "result"), 2)):
        a = {k: v for k, v in n["attrs"].items() if k != "tag"}
        tag, pad = n["attrs"].get("tag", "result"), STEP * depth
        out.append(f"{pad}<{tag}{attributes(a)}>\n{write_results(n['children'], depth + 1)}{pad}</{tag}>\n" if n["children"] else f"{pad}<{tag}{attributes(a)}/>\n")
    return "".join(out)


def write_owner(owner: dict, dialect: str, formatted: bool = False) -> str:
    tag = owner["tag"]
    if not tag:
        return ""
    nodes = from_rows([{**dict(n)} for n in owner["nodes"]])
    body = write_results(nodes, 2) if owner["kind"] in ("RESULT_MAP", "PARAMETER_MAP", "CACHE_MODEL") else write_nodes(nodes, dialect, 2, formatted)
    head = f"{STEP}<{tag}{attributes({'id': owner['local_id'], **dict(owner['attrs'] or {})})}"
    return f"{head}>\n{body}{STEP}</{tag}>\n" if body else f"{head}/>\n"


def write_mapper(namespace: str, dialect: str, owners: list[dict], formatted: bool = False) -> str:
    """A whole file: fragments, maps, statements, each in their order."""
    root = "sqlMap" if dialect == "ibatis" else "mapper"
    parts = [write_owner(o, dialect, formatted) for o in sorted(owners, key=lambda o: (_ORDER[o["kind"]], o["ord"]))]
    return f'<?xml version="1.0" encoding="UTF-8"?>\n{_DOCTYPES[dialect]}\n<{root} namespace="{attribute_text(namespace)}">\n' + "\n".join(p for p in parts if p) + f"</{root}>\n"


def documents(owned: DataFrame, formatted: bool = False) -> DataFrame:
    """source_file, dialect, xml: a document for each file. Rows come sorted by file; one file's owners are held at a time."""
    names = ["source_file", "dialect", "xml"]

    def whole(rows: list[dict]) -> tuple:
        first = rows[0]
        return first["source_file"], first["dialect"], write_mapper(first["namespace"], first["dialect"], rows, formatted)

    def run(batches):
        rows: list[dict] = []
        for pdf in batches:
            done = []
            for row in pdf.to_dict("records"):
                if rows and row["source_file"] != rows[0]["source_file"]:
                    done.append(whole(rows))
                    rows = []
                rows.append(row)
            yield pd.DataFrame(done, columns=names)
        if rows:
            yield pd.DataFrame([whole(rows)], columns=names)

    keep = owned.select("source_file", "namespace", "dialect", "kind", "local_id", "tag", "attrs", "nodes", "ord")
    return keep.repartition("source_file").sortWithinPartitions("source_file").mapInPandas(run, "source_file string, dialect string, xml string")


def save(docs: DataFrame, path: str) -> None:
    """Documents as text files, a folder for each source file below path, by any store that Spark writes."""
    docs.select("source_file", F.col("xml").alias("value")).write.mode("overwrite").partitionBy("source_file").text(path)


def shaped(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_file, before, after (null where nothing changed)."""
    b, a = before.select("source_file", F.col("xml").alias("before")), after.select("source_file", F.col("xml").alias("after"))
    return b.join(a, "source_file", "left").select("source_file", "before", F.when(F.col("before") != F.col("after"), F.col("after")).alias("after"))

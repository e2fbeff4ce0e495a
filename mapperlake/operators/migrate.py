"""Renaming tables and columns in SQL without touching anything else.

One token stream runs through a statement's tags and the fragments in its place. A scanner assigns each name to its
scope; decisions are made from the innermost query outwards, so that renamed outputs of derived tables and CTEs are
followed by those who read them. The result is a list of edits (owner, node, place, old, new) and graded events.
Across statements the edits of a fragment are aggregated: they apply where all statements agree.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.functions.sqltokens import Token, bare, tokenize
from mapperlake.sources.mapping import Mapping

#: Words that are never columns, tables or aliases. Key words of SQL.
_WORDS = frozenset(
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET FETCH FIRST NEXT ONLY UNION INTERSECT EXCEPT MINUS ALL DISTINCT ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL APPLY LATERAL STRAIGHT_JOIN AND OR NOT IN IS NULL LIKE BETWEEN EXISTS CASE WHEN THEN ELSE END AS SET VALUES INTO WITH RECURSIVE INSERT UPDATE DELETE MERGE MATCHED ASC DESC NULLS LAST OVER PARTITION ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW WINDOW WITHIN KEEP INTERVAL CAST EXTRACT YEAR MONTH DAY TRUE FALSE SIBLINGS CONNECT START PRIOR FOR ESCAPE QUALIFY PIVOT UNPIVOT MODEL TOP SYSDATE ROWNUM DUAL LEADING TRAILING BOTH ANY SOME".split()
)
_SETS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
#: The codes of events and their grades.
GRADE = {
    "TABLE_RENAMED": "SAFE", "COLUMN_RENAMED": "SAFE", "COLUMN_ASSUMED": "WARNING", "COLUMN_AMBIGUOUS": "MANUAL", "RESULT_COLUMN_RENAMED": "WARNING", "RESULT_COLUMN_ALIASED": "SAFE",
    "UNRESOLVED_QUALIFIER": "WARNING", "NO_TABLE_CONTEXT": "MANUAL", "RUNTIME_SUBSTITUTION": "WARNING", "DYNAMIC_IDENTIFIER": "WARNING", "CONDITIONAL_TABLE_SUFFIX": "SAFE", "HINT_NOT_MIGRATED": "WARNING",
    "FRAGMENT_CONTEXT_INFERRED": "SAFE", "FRAGMENT_CONTEXT_CONFLICT": "MANUAL",
}


@dataclass
class Piece:
    """A token and where it is written."""

    token: Token
    owner: str
    node: int
    edge: bool = False  # it begins a tag's text: what stands before it is in another tag

    @property
    def upper(self) -> str:
        return self.token.upper


@dataclass
class Ref:
    """A table, derived table or CTE in a scope."""

    name: str
    alias: str | None
    at: int
    derived: "Scope | None" = None
    is_cte: bool = False


@dataclass
class Scope:
    parent: "Scope | None"
    depth: int
    refs: list[Ref] = field(default_factory=list)
    columns: list[tuple] = field(default_factory=list)  # (index, qualifier index or None, clause)
    items: list[list[int]] = field(default_factory=list)  # indexes of each select item
    labels: set[str] = field(default_factory=set)
    ctes: dict[str, "Scope | None"] = field(default_factory=dict)
    fixed: list[str] = field(default_factory=list)  # a column list gives the outputs their names
    sibling: "Scope | None" = None
    top: bool = False
    exposed: dict[str, str] = field(default_factory=dict)


class Scanner:
    """Scopes of a token stream. It never fails: what it can't place is left as it is."""

    def __init__(self, pieces: list[Piece], context: list[str] | None = None):
        self.all = pieces
        self.p = [p for p in pieces if p.token.kind not in ("space", "comment", "hint")]
        self._place = {id(x): k for k, x in enumerate(pieces)}
        self.scopes: list[Scope] = []
        self.skip: set[int] = set()
        root = self._scope(None)
        root.top = True
        for name in context or []:
            root.refs.append(Ref(name, None, -1))
        self._run(0, root, "other", None)

    def _scope(self, parent: Scope | None) -> Scope:
        s = Scope(parent, parent.depth + 1 if parent else 0, ctes=dict(parent.ctes) if parent else {})
        self.scopes.append(s)
        return s

    def _is(self, k: int, *words: str) -> bool:
        return 0 <= k < len(self.p) and self.p[k].token.kind in ("word", "sign") and self.p[k].upper in words

    def _named(self, k: int) -> bool:
        return 0 <= k < len(self.p) and (self.p[k].token.kind == "quoted" or self.p[k].token.kind == "word" and self.p[k].upper not in _WORDS)

    def _glued(self, k: int) -> bool:
        """Whether a solid token touches the one before."""
        a, b = self.p[k - 1].token, self.p[k].token
        return self.p[k - 1].owner == self.p[k].owner and self.p[k - 1].node == self.p[k].node and a.at + len(a.text) == b.at

    def _tag_suffix(self, k: int) -> bool:
        """Whether a word starts a tag and touches the token before it."""
        if not (0 < k < len(self.p) and self.p[k].edge and self.p[k].token.kind == "word" and self.p[k].upper not in _WORDS):
            return False
        at = self._place[id(self.p[k])]
        return at > 0 and self.all[at - 1] is self.p[k - 1]

    def _alias(self, k: int) -> tuple[str | None, int]:
        if self._is(k, "AS"):
            k += 1
        if self._named(k) and not self._is(k + 1, "."):
            self.skip.add(k)
            return bare(self.p[k].token.text), k + 1
        return None, k

    def _run(self, k: int, scope: Scope, clause: str, until: str | None) -> int:
        """Scan from k to the bracket that ends this level."""
        expect = False  # a table may stand here
        item: list[int] = []
        first = scope
        while k < len(self.p):
            p = self.p[k]
            u = p.upper
            if p.token.kind == "sign" and u == ")":
                if clause == "select" and item:
                    scope.items.append(item)
                return k
            if p.token.kind == "sign" and u == "(":
                inner_query = self._is(k + 1, "SELECT", "WITH", "(") and self._starts_query(k + 1)
                if inner_query:
                    child = self._scope(scope)
                    end = self._run(k + 1, child, "other", ")")
                    if expect and clause == "from":
                        at = k
                        alias, end2 = self._alias(end + 1)
                        if self._is(end2, "(") and alias:
                            end3 = self._names(end2, child)
                            end2 = end3
                        scope.refs.append(Ref(alias or "", alias, at, derived=child))
                        k, expect = end2, False
                        continue
                    k = end + 1
                    if clause == "select":
                        item.append(end)
                    continue
                if clause == "into":
                    k = self._insert_list(k, scope)
                    clause = "other"
                    continue
                inside = "from" if expect and clause == "from" else clause if clause != "select" else "expression"
                if inside == "from":
                    k += 1
                    continue
                if clause == "select":
                    item.append(k)
                end = self._run(k + 1, scope, inside, ")")
                k = end + 1
                if clause == "select":
                    item.append(end)
                continue
            if p.token.kind == "word" and u in _WORDS:
                if u == "WITH" and not self._is(k - 1, "IS"):
                    k = self._with(k + 1, scope)
                    continue
                if u == "SELECT":
                    if scope.refs and not scope.items and clause in ("other", "into"):  # what an INSERT selects is a scope of its own
                        outer, scope = scope, self._scope(scope.parent)
                        scope.ctes, scope.depth = dict(outer.ctes), outer.depth + 1
                    clause, item, expect = "select", [], False
                    k += 1
                    if self._is(k, "DISTINCT", "ALL"):
                        k += 1
                    continue
                if clause == "select" and u in ("FROM", "INTO", *_SETS) or clause == "select" and u in ("WHERE", "ORDER", "LIMIT"):
                    if item:
                        scope.items.append(item)
                    item = []
                if u in _SETS:
                    nxt = self._scope(scope.parent)
                    nxt.ctes, nxt.top, nxt.sibling, nxt.depth = dict(scope.ctes), scope.top, first, scope.depth
                    scope, clause, expect = nxt, "other", False
                    k += 1
                    if self._is(k, "ALL", "DISTINCT"):
                        k += 1
                    continue
                if u in ("FROM", "USING") and clause != "expression":
                    clause, expect = "from", True
                elif u in ("JOIN", "APPLY", "STRAIGHT_JOIN"):
                    clause, expect = "from", True
                elif u == "UPDATE" and not self._is(k - 1, "THEN", "FOR"):
                    clause, expect = "from", True
                elif u == "INTO":
                    clause, expect = "into", True
                elif u == "DELETE" and not self._is(k - 1, "THEN") and not self._is(k + 1, "FROM"):
                    clause, expect = "from", True
                elif u in ("ON", "WHERE", "HAVING", "SET", "VALUES"):
                    clause, expect = u.lower(), False
                elif u == "GROUP":
                    clause, expect = "group", False
                elif u == "ORDER":
                    clause = clause if clause in ("expression",) else "order"
                    expect = False
                elif u == "INSERT" and self._is(k - 1, "THEN") and self._is(k + 1, "("):
                    k = self._insert_list(k + 1, scope)
                    continue
                elif u == "AS" and clause == "select" and self._named(k + 1):
                    scope.labels.add(bare(self.p[k + 1].token.text).upper())
                    self.skip.add(k + 1)
                    item.append(k + 1)
                    k += 2
                    continue
                if clause == "select":
                    item.append(k)
                k += 1
                continue
            if p.token.kind == "sign" and u == ",":
                if clause == "select":
                    scope.items.append(item)
                    item = []
                elif clause == "from":
                    expect = True
                k += 1
                continue
            if self._named(k):
                end = k
                while self._is(end + 1, ".") and (self._named(end + 2) or end + 2 < len(self.p) and self.p[end + 2].token.kind in ("word", "quoted")):
                    end += 2
                if expect and clause in ("from", "into"):
                    if self._is(end + 1, "(") and clause == "from":
                        close = self._run(end + 2, scope, "expression", ")")  # a table function
                        alias, nxt = self._alias(close + 1)
                        scope.refs.append(Ref(alias or "", alias, k, derived=self._scope(scope)))
                        k, expect = nxt, False
                        continue
                    name = ".".join(bare(self.p[i].token.text) for i in range(k, end + 1, 2))
                    if name.upper() != "DUAL":
                        after = end + 1
                        while self._tag_suffix(after):  # words of the next tags that are glued to the name are no alias
                            self.skip.add(after)
                            after += 1
                        alias, nxt = self._alias(after)
                        cte = name.upper() in scope.ctes
                        scope.refs.append(Ref(name, alias, end, derived=scope.ctes.get(name.upper()) if cte else None, is_cte=cte))
                        k = nxt
                    else:
                        k = end + 1
                    expect = False
                    continue
                if self._is(end + 1, "(") and not self._is(end + 1, "."):
                    if clause == "select":
                        item.append(end)
                    k = end + 1  # a function's name
                    continue
                previous = self.p[k - 1].token if k else None
                follows = previous is not None and (previous.kind in ("number", "string", "parameter") or previous.text == ")" or previous.upper == "END" or self._named(k - 1)) and clause == "select" and item
                if follows and end == k and not self.p[k].edge or follows and end == k and self.p[k - 1].token.kind != "sign" and not self._glued(k):
                    scope.labels.add(bare(p.token.text).upper())  # an alias without AS
                    self.skip.add(k)
                    item.append(k)
                    k += 1
                    continue
                if self._is(end + 1, ".") and self._is(end + 2, "*"):
                    scope.columns.append((None, end, clause))
                    if clause == "select":
                        item += [end, end + 2]
                    k = end + 3
                    continue
                scope.columns.append((end, end - 2 if end > k else None, clause))
                if clause == "select":
                    item.append(end)
                k = end + 1
                continue
            if clause == "select":
                item.append(k)
            k += 1
        if clause == "select" and item:
            scope.items.append(item)
        return k

    def _starts_query(self, k: int) -> bool:
        while self._is(k, "("):
            k += 1
        return self._is(k, "SELECT", "WITH")

    def _names(self, k: int, scope: Scope) -> int:
        """A column list in brackets: names that are given, not read."""
        k += 1
        while k < len(self.p) and not self._is(k, ")"):
            if self._named(k):
                scope.fixed.append(bare(self.p[k].token.text).upper())
                self.skip.add(k)
            k += 1
        return k + 1

    def _insert_list(self, k: int, scope: Scope) -> int:
        if self._is(k + 1, "SELECT", "WITH"):
            return k + 1
        k += 1
        while k < len(self.p) and not self._is(k, ")"):
            if self._named(k):
                scope.columns.append((k, None, "insert"))
            k += 1
        return k + 1

    def _with(self, k: int, scope: Scope) -> int:
        recursive = self._is(k, "RECURSIVE")
        k += recursive
        while self._named(k):
            name = bare(self.p[k].token.text).upper()
            child = self._scope(scope)
            self.skip.add(k)
            k += 1
            if recursive:
                child.ctes[name] = child
            if self._is(k, "("):
                k = self._names(k, child)
            if not self._is(k, "AS") or not self._is(k + 1, "("):
                return k
            k = self._run(k + 2, child, "other", ")") + 1
            scope.ctes[name] = child
            if not self._is(k, ","):
                return k
            k += 1
        return k


class Renamer:
    """Decisions over a scanned stream: edits {piece index: new text} and events."""

    def __init__(self, scanner: Scanner, mapping: Mapping, keep_labels: bool = False):
        self.s, self.m, self.keep = scanner, mapping, keep_labels
        self.edits: dict[int, str] = {}
        self.events: list[dict] = []
        for scope in scanner.scopes:
            for ref in scope.refs:
                if ref.derived is None and not ref.is_cte and ref.at >= 0:
                    self._rename_table(ref)
        for scope in sorted(scanner.scopes, key=lambda s: -s.depth):
            for index, qualifier, clause in scope.columns:
                self._column(scope, index, qualifier, clause)
            self._expose(scope)
        self._marks()

    def event(self, code: str, at: int, original: str, replacement: str | None = None, table: str | None = None, grade: str | None = None) -> None:
        p = self.s.p[at]
        self.events.append({"code": code, "grade": grade or GRADE[code], "owner": p.owner, "node": p.node, "token": p.token.at, "original": original, "replacement": replacement, "table": table})

    def _quote(self, at: int, new: str) -> str:
        old = self.s.p[at].token.text
        return {'"': f'"{new}"', "`": f"`{new}`", "[": f"[{new}]"}.get(old[0], new)

    def _rename_table(self, ref: Ref) -> None:
        found, at = self.m.table(ref.name), ref.at
        suffix = self._suffix(at)
        if found is None or found[0] is None:
            return
        target = found[0]
        if suffix is not None:
            other = self.m.table(ref.name + suffix)
            safe = other is not None and other[0] is not None and other[0].upper() == (target + suffix).upper()
            self.event("CONDITIONAL_TABLE_SUFFIX", at, ref.name + suffix, target + suffix, ref.name, "SAFE" if safe else "MANUAL")
        schema, _, table = target.rpartition(".")
        before = at - 2 if self.s._is(at - 1, ".") else None
        if schema and before is not None:
            self.edits[before] = self._quote(before, schema)
            new = table
        else:
            new = target if schema else table
        if self.s.p[at].token.text != self._quote(at, new):
            self.edits[at] = self._quote(at, new)
            self.event("TABLE_RENAMED", at, ref.name, target, ref.name)

    def _suffix(self, at: int) -> str | None:
        """A word glued to a table's name in the next tag."""
        if at + 1 >= len(self.s.p):
            return None
        a, b = self.s.p[at], self.s.p[at + 1]
        whole = self.s.all
        k = next(i for i, x in enumerate(whole) if x is a)
        return b.token.text if k + 1 < len(whole) and whole[k + 1] is b and b.edge and b.token.kind == "word" and b.upper not in _WORDS else None

    def _visible(self, scope: Scope | None):
        while scope is not None:
            yield scope
            scope = scope.parent

    def _columns_of(self, ref: Ref) -> dict[str, str]:
        if ref.derived is not None:
            return ref.derived.exposed
        if ref.is_cte:
            return {}
        found = self.m.table(ref.name)
        return found[1] if found else {}

    def _column(self, scope: Scope, index: int | None, qualifier: int | None, clause: str) -> None:
        p = self.s.p
        if qualifier is not None:
            q = bare(p[qualifier].token.text)
            ref = None
            for s in self._visible(scope):
                ref = next((r for r in s.refs if r.alias and r.alias.upper() == q.upper()), None) or next((r for r in s.refs if not r.alias and r.name.rpartition(".")[2].upper() == q.upper()), None)
                if ref:
                    break
            if ref is None:
                if index is not None and bare(p[index].token.text).upper() in self.m.legacy:
                    self.event("UNRESOLVED_QUALIFIER", index, f"{q}.{bare(p[index].token.text)}")
                return
            if not ref.alias and ref.derived is None and ref.at in self.edits:
                self.edits[qualifier] = self._quote(qualifier, bare(self.edits[ref.at]).rpartition(".")[2])
            if index is not None:
                new = self._columns_of(ref).get(bare(p[index].token.text).upper())
                if new:
                    self._rename(index, new, "COLUMN_RENAMED", ref.name or q)
            return
        if index is None or index in self.s.skip:
            return
        name = bare(p[index].token.text)
        if clause == "order" and name.upper() in scope.labels:
            return
        any_table = False
        for s in self._visible(scope):
            if not s.refs:
                continue
            any_table = True
            refs = s.refs[:1] if clause in ("insert",) else s.refs
            hits = [(r, new) for r in refs if (new := self._columns_of(r).get(name.upper()))]
            targets = {n.upper() for _, n in hits}
            if len(targets) > 1:
                self.event("COLUMN_AMBIGUOUS", index, name, "/".join(sorted(n for _, n in hits)))
                return
            if hits:
                unsure = any(r.derived is None and self.m.table(r.name) is None or r.derived is not None and r not in [h for h, _ in hits] for r in refs)
                self._rename(index, hits[0][1], "COLUMN_ASSUMED" if unsure else "COLUMN_RENAMED", hits[0][0].name)
                return
        if not any_table and name.upper() in self.m.legacy:
            self.event("NO_TABLE_CONTEXT", index, name)

    def _rename(self, index: int, new: str, code: str, table: str) -> None:
        old = bare(self.s.p[index].token.text)
        if old != new:
            self.edits[index] = self._quote(index, new)
            self.event(code, index, old, new, table)

    def _expose(self, scope: Scope) -> None:
        """What a query's outputs are called now, where that changed."""
        out: dict[str, str] = {}
        for item in scope.items:
            item = [i for i in item if i < len(self.s.p)]  # a bracket that never closes ends behind the last token
            if not item:
                continue
            last = self.s.p[item[-1]]
            if last.token.text == "*":
                star = [r for r in scope.refs if len(item) == 1 or (r.alias or r.name).upper() == bare(self.s.p[item[0]].token.text).upper()]
                for r in star:
                    out |= self._columns_of(r)
            elif len(item) == 1 and item[0] in self.edits and item[0] not in self.s.skip:
                old, new = bare(last.token.text), bare(self.edits[item[0]])
                if scope.top and not scope.sibling:
                    if self.keep:
                        self.edits[item[0]] += f" AS {old}"
                        self.event("RESULT_COLUMN_ALIASED", item[0], old, new)
                    else:
                        self.event("RESULT_COLUMN_RENAMED", item[0], old, new)
                out[old.upper()] = new
        if not scope.fixed:
            scope.exposed.update(out)

    def _marks(self) -> None:
        """Hints and substitutions, which aren't rewritten."""
        renamed = {bare(self.s.p[k].token.text).upper() for k in self.edits}
        spots = {id(p): k for k, p in enumerate(self.s.p)}
        for k, p in enumerate(self.s.all):
            if p.token.kind == "hint" and any(re.search(rf"(?i)\b{re.escape(n)}\b", p.token.text) for n in renamed):
                self.events.append({"code": "HINT_NOT_MIGRATED", "grade": "WARNING", "owner": p.owner, "node": p.node, "token": p.token.at, "original": p.token.text, "replacement": None, "table": None})
            if p.token.kind == "parameter" and p.token.text.startswith("$"):
                before = self.s.all[k - 1] if k else None
                after = self.s.all[k + 1] if k + 1 < len(self.s.all) else None
                glued = [x for x in (before, after) if x is not None and x.token.kind in ("word", "quoted") and x.node == p.node]
                at = spots[id(p)]
                if glued:
                    base = bare(glued[0].token.text).rstrip("_").upper()
                    known = self.m.table(base) is not None
                    self.event("DYNAMIC_IDENTIFIER", at, glued[0].token.text + p.token.text, grade="MANUAL" if known else "WARNING")
                else:
                    self.event("RUNTIME_SUBSTITUTION", at, p.token.text)


def stream(nodes: list[dict], owner: str) -> list[Piece]:
    """The tokens of a resolved tree in order: texts of tags, connectors of tags (not to be edited: node -1), fragments under their own names."""
    out: list[Piece] = []

    def connector(text: str | None) -> None:
        if text:
            out.extend(Piece(t, owner_of[-1], -1) for t in tokenize(f" {text} "))

    owner_of = [owner]

    def walk(siblings: list[dict]) -> None:
        for n in siblings:
            a = n["attrs"]
            if n["type"] == "Text":
                for i, t in enumerate(tokenize(n["text"])):
                    out.append(Piece(t, owner_of[-1], n["node_id"], edge=i == 0))
            elif n["type"] == "Include":
                if n.get("status") == "RESOLVED":
                    owner_of.append(n["target"])
                    walk(n["children"])
                    owner_of.pop()
            elif n["type"] in ("Bind", "SelectKey", "Result"):
                continue
            else:
                connector(a.get("prepend") or a.get("prefix"))
                connector(a.get("open"))
                walk(n["children"])
                connector(a.get("close"))

    walk(nodes)
    return out


def migrate_tree(nodes: list[dict], owner: str, mapping: Mapping, keep_labels: bool = False, context: list[str] | None = None) -> tuple[list[dict], list[dict]]:
    """(edits, events) of a resolved tree; a selectKey's statement is a stream of its own."""
    edits, events = [], []
    streams = [stream(nodes, owner)]
    work = list(nodes)
    while work:
        n = work.pop()
        if n["type"] == "SelectKey":
            streams.append(stream(n["children"], owner))
        work += n["children"] if n["type"] != "Include" else []
    for k, pieces in enumerate(streams):
        r = Renamer(Scanner(pieces, context), mapping, keep_labels and k == 0)
        events += r.events
        edits += [{"owner": p.owner, "node": p.node, "at": p.token.at, "old": p.token.text, "new": new} for i, new in r.edits.items() if (p := r.s.p[i]).node >= 0]
    return edits, events


def convert_sql(sql: str, mapping: Mapping, keep_labels: bool = False, context: list[str] | None = None) -> tuple[str, list[dict]]:
    """A bare text with its names replaced, and events. context: tables of a text without FROM."""
    edits, events = migrate_tree([{"type": "Text", "attrs": {}, "text": sql, "children": [], "node_id": 0}], "", mapping, keep_labels, context)
    return apply(sql, edits), events


def apply(text: str, edits: list[dict]) -> str:
    for e in sorted(edits, key=lambda e: -e["at"]):
        if text[e["at"] : e["at"] + len(e["old"])] == e["old"]:
            text = text[: e["at"]] + e["new"] + text[e["at"] + len(e["old"]) :]
    return text


_EDIT = "struct<owner: string, node: int, at: int, old: string, new: string>"
_EVENT = "struct<code: string, grade: string, owner: string, node: int, token: int, original: string, replacement: string, table: string>"
MIGRATED = f"statement string, edits array<{_EDIT}>, events array<{_EVENT}>"


def scanned(rendered: DataFrame, mapping: dict, keep_labels: bool = False) -> DataFrame:
    """MIGRATED of every statement. The mapping is checked by its number of names and goes along with the code."""

    def run(batches):
        m = Mapping(mapping)
        for pdf in batches:
            rows = [(s, *migrate_tree(json.loads(t), s, m, keep_labels)) for s, t in zip(pdf["statement"], pdf["tree"], strict=True)]
            yield pd.DataFrame(rows, columns=["statement", "edits", "events"])

    return rendered.select("statement", "tree").mapInPandas(run, MIGRATED)


def standalone(owned: DataFrame, tree: DataFrame, mapping: dict) -> DataFrame:
    """MIGRATED of fragments that no statement includes."""
    reached = tree.where("status <> 'MISSING'").select(F.col("dst").alias("qid")).distinct()
    lone = owned.where("kind = 'SQL_FRAGMENT'").join(reached, "qid", "left_anti").select("qid", F.to_json("nodes").alias("nodes"))

    def run(batches):
        from mapperlake.sources.mappers import from_rows

        m = Mapping(mapping)
        for pdf in batches:
            rows = [(q, *migrate_tree(from_rows([{"attrs": {}, "text": None, **x} for x in json.loads(n)]), q, m)) for q, n in zip(pdf["qid"], pdf["nodes"], strict=True)]
            yield pd.DataFrame(rows, columns=["statement", "edits", "events"])

    return lone.mapInPandas(run, MIGRATED)


def edits(done: DataFrame) -> DataFrame:
    """owner, node, at, old, new of edits that apply: those of a statement's own text, and those of fragments on whose new name all statements that reach the place agree."""
    rows = done.select("statement", F.explode("edits").alias("e")).select("statement", "e.*")
    g = rows.groupBy("owner", "node", "at", "old").agg(F.countDistinct("new").alias("n"), F.min("new").alias("new"))
    return g.where("n = 1").drop("n")


def events(done: DataFrame) -> DataFrame:
    """owner, code, grade, node, token, original, replacement, table, each once, and FRAGMENT_CONTEXT_INFERRED or _CONFLICT for what fragments took from their statements."""
    rows = done.select("statement", F.explode("events").alias("e")).select("statement", "e.*").dropDuplicates(["owner", "code", "node", "token", "replacement"])
    own = rows.drop("statement")
    part = done.select("statement", F.explode("edits").alias("e")).where("e.owner <> statement").groupBy("e.owner", "e.node", "e.at", "e.old").agg(F.countDistinct("e.new").alias("n"), F.min("e.new").alias("new"))
    told = part.select(
        F.when(F.col("n") > 1, "FRAGMENT_CONTEXT_CONFLICT").otherwise("FRAGMENT_CONTEXT_INFERRED").alias("code"), F.when(F.col("n") > 1, "MANUAL").otherwise("SAFE").alias("grade"),
        "owner", "node", F.col("at").alias("token"), F.col("old").alias("original"), F.when(F.col("n") == 1, F.col("new")).alias("replacement"), F.lit(None).cast("string").alias("table"),
    )
    return own.unionByName(told)


def migrated_owners(owned: DataFrame, applied: DataFrame) -> DataFrame:
    """owners with the edits in their texts."""
    by_owner = applied.groupBy(F.col("owner").alias("__owner")).agg(F.to_json(F.collect_list(F.struct("node", "at", "old", "new"))).alias("__edits"))
    joined = owned.join(by_owner, owned["qid"] == by_owner["__owner"], "left").drop("__owner")
    names, shape = [c for c in joined.columns if c != "__edits"], owned.schema

    def run(batches):
        for pdf in batches:
            out = []
            for nodes, found in zip(pdf["nodes"], pdf["__edits"], strict=True):
                by_node: dict[int, list[dict]] = {}
                for e in json.loads(found) if isinstance(found, str) else []:
                    by_node.setdefault(e["node"], []).append(e)
                out.append([{**dict(n), "attrs": dict(n["attrs"] or {}), "text": apply(n["text"], by_node[n["node_id"]]) if n["node_id"] in by_node and n["text"] is not None else n["text"]} for n in nodes])
            pdf["nodes"] = out
            yield pdf[names]

    return joined.mapInPandas(run, shape)


def usage(rendered: DataFrame, analysed: DataFrame, mapping: dict) -> DataFrame:
    """statement, table, operation, verdict: MAPPED, COLUMNS_ONLY or UNMAPPED; DUAL is left out."""
    spark = rendered.sparkSession
    rows = [(k.upper(), "MAPPED" if t else "COLUMNS_ONLY") for k, (t, _) in Mapping(mapping).tables.items()]
    known = spark.createDataFrame(rows or [("", "")], "key string, verdict string")
    used = analysed.select("statement", F.explode("tables").alias("t")).where("NOT t.derived AND upper(t.table) <> 'DUAL'").select("statement", F.col("t.table").alias("table"), F.col("t.operation").alias("operation"))
    whole = used.join(known.withColumnRenamed("verdict", "v1"), F.upper("table") == F.col("key"), "left").drop("key")
    both = whole.join(known.withColumnRenamed("verdict", "v2"), F.upper(F.substring_index("table", ".", -1)) == F.col("key"), "left").drop("key")
    return both.select("statement", "table", "operation", F.coalesce("v1", "v2", F.lit("UNMAPPED")).alias("verdict"))

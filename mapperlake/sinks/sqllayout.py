"""SQL text on the page: dedented to a tag's depth, or laid out clause by clause. Literals and comments stay as they are."""

from __future__ import annotations

from mapperlake.functions.sqltokens import Token, tokenize

_LINE = frozenset("SELECT FROM WHERE GROUP HAVING ORDER UNION INTERSECT EXCEPT MINUS LIMIT VALUES SET INSERT UPDATE DELETE MERGE WITH WHEN".split())
_JOIN = frozenset("JOIN LEFT RIGHT FULL INNER CROSS NATURAL".split())


def layout(text: str, pad: str) -> str:
    """The text with its common indentation replaced by pad; lines inside literals and comments keep theirs."""
    frozen: set[int] = set()
    line = 0
    for t in tokenize(text):
        n = t.text.count("\n")
        if t.kind in ("string", "quoted", "comment", "hint"):
            frozen.update(range(line + 1, line + n + 1))
        line += n
    lines = text.split("\n")
    free = [x for k, x in enumerate(lines) if k not in frozen and x.strip()]
    if lines[0].strip() and len(free) > 1:
        free = free[1:]  # what stands behind a tag has lost its indentation
    common = min((len(x) - len(x.lstrip()) for x in free), default=0)
    out = []
    for k, x in enumerate(lines):
        if k in frozen:
            out.append(x)
        elif not x.strip():
            out.append("")
        else:
            own = len(x) - len(x.lstrip())
            cut = min(common, own) if k else own
            out.append(pad + (x[cut:] if k + 1 in frozen else x[cut:].rstrip()))
    return "\n".join(out).strip("\n")


def pretty(sql: str, step: str = "  ") -> str:
    """A clause to a line, list items and conditions below it, subqueries one step in. Joined without blanks it is the input without blanks."""
    out: list[str] = []
    depth, broken, glue = 0, [], True
    tokens = [t for t in tokenize(sql) if t.kind != "space"]

    def line(extra: int = 0) -> None:
        while out and out[-1] == " ":
            out.pop()
        if out:
            out.append("\n" + step * (depth + extra))

    def previous() -> Token | None:
        return tokens[k - 1] if k else None

    between = 0
    for k, t in enumerate(tokens):
        u, before = t.upper, previous()
        if t.kind == "word" and u in _LINE and not (u == "SET" and before and before.upper == "ON") and not (u in ("UPDATE", "DELETE", "INSERT") and before and before.upper in ("FOR", "THEN")):
            line()
        elif t.kind == "word" and u in _JOIN and not (before and before.upper in (*_JOIN, "OUTER")) and not (k + 1 < len(tokens) and tokens[k + 1].text == "("):
            line(1)
        elif t.kind == "word" and u in ("AND", "OR") and not broken[-1:] == [False]:
            if u == "AND" and between:
                between -= 1
            else:
                line(1)
        if u == "BETWEEN":
            between += 1
        if u == ")" and broken:
            if broken.pop():
                depth -= 1
                line()
        touching = glue or u in (",", ")", ".", ";") or before is not None and before.text in ("(", ".") or (u == "(" and before is not None and before.kind == "word" and before.upper not in _LINE and before.upper not in ("IN", "AND", "OR", "ON", "AS", "EXISTS", "VALUES", "OVER", "BY", "NOT", "USING", "JOIN", "FROM") and before.at + len(before.text) == t.at)
        joined = before is not None and before.at + len(before.text) == t.at and (t.kind == "parameter" or before.kind == "parameter")
        if not touching and not joined and out and not out[-1].startswith("\n"):
            out.append(" ")
        out.append(t.text)
        glue = u == "."
        if u == "(":
            query = k + 1 < len(tokens) and tokens[k + 1].upper in ("SELECT", "WITH")
            broken.append(query)
            depth += query
        if u == "," and (not broken or broken[-1]) and k + 1 < len(tokens):
            line(1)
        if t.kind == "comment" and t.text.startswith("--"):
            line()
    return "".join(out).strip()

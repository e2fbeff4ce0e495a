"""Rewrites of SQL text that let a stricter grammar read it; strings, comments and names are never touched."""

from __future__ import annotations

from mapperlake.functions.sqltokens import Token, bare, tokenize

_ENDS = frozenset(("GROUP", "ORDER", "HAVING", "UNION", "INTERSECT", "EXCEPT", "MINUS", "LIMIT", "CONNECT", "START", "FETCH", "OFFSET", "FOR"))


def _span(tokens: list[Token], start: int, stop) -> int:
    """The first token from start, outside of brackets, for which stop holds."""
    depth = 0
    for k in range(start, len(tokens)):
        t = tokens[k]
        if depth == 0 and stop(t):
            return k
        depth += (t.text == "(") - (t.text == ")")
        if depth < 0:
            return k
    return len(tokens)


def _split(tokens: list[Token], sign: str) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    depth = between = 0
    for t in tokens:
        if depth == 0 and t.upper == sign and not (sign == "AND" and between):
            out.append([])
            continue
        if depth == 0 and sign == "AND":
            between = 1 if t.upper == "BETWEEN" else 0 if t.upper == "AND" else between
        depth += (t.text == "(") - (t.text == ")")
        out[-1].append(t)
    return out


def _text(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens).strip()


def _alias(item: list[Token]) -> str:
    words = [t for t in item if t.kind in ("word", "quoted") and t.upper != "AS"]
    return bare(words[-1].text).upper() if words else ""


def outer_joins(sql: str) -> str:
    """Comma joins marked with (+) as LEFT JOINs: the unmarked side is preserved; plain conditions stay in WHERE."""
    tokens = tokenize(sql)
    out: list[str] = []
    k = 0
    while k < len(tokens):
        if tokens[k].upper != "FROM":
            if tokens[k].text == "(":
                end = _span(tokens, k + 1, lambda t: False)
                out.append("(" + outer_joins(_text_raw(tokens[k + 1 : end])))
                k = end
                continue
            out.append(tokens[k].text)
            k += 1
            continue
        where = _span(tokens, k + 1, lambda t: t.upper == "WHERE" or t.upper in _ENDS)
        if where >= len(tokens) or tokens[where].upper != "WHERE":
            out.append("".join(t.text for t in tokens[k:where]))
            k = where
            continue
        end = _span(tokens, where + 1, lambda t: t.upper in _ENDS)
        items, terms = _split(tokens[k + 1 : where], ","), _split(tokens[where + 1 : end], "AND")
        marked = [x for x in terms if any(t.text == "(+)" for t in x)]
        if not marked:
            out.append("".join(t.text for t in tokens[k:end]))
            k = end
            continue
        on: dict[str, list[str]] = {}
        for x in marked:
            at = next(i for i, t in enumerate(x) if t.text == "(+)")
            names = [t for t in x[:at] if t.kind in ("word", "quoted")]
            owner = bare(names[-2].text).upper() if len(names) > 1 else _alias(items[-1])
            on.setdefault(owner, []).append(_text([t for t in x if t.text != "(+)"]))
        kept = [i for i in items if _alias(i) not in on]
        joined = [i for i in items if _alias(i) in on]
        text = " FROM " + " CROSS JOIN ".join(_text(i) for i in kept)
        text += "".join(f" LEFT JOIN {_text(i)} ON {' AND '.join(on[_alias(i)])}" for i in joined)
        rest = [_text(x) for x in terms if x not in marked]
        out.append(text + (" WHERE " + " AND ".join(rest) if rest else "") + " ")
        k = end
    return "".join(out)


def _text_raw(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def marks_outer_join(sql: str) -> bool:
    return any(t.text == "(+)" for t in tokenize(sql))

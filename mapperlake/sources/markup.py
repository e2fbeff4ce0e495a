"""Lenient XML with line numbers: it recovers from what hand-edited mapper files get wrong and says so.

Elements are dicts (tag, attrs, line, children); texts are dicts (text, line). Problems are (severity, code,
message, line) tuples; a file without any element gives None and one XML_PARSE_ERROR.
"""

from __future__ import annotations

import bisect
import re

_NAME = r"[A-Za-z_:][-\w:.]*"
_ATTR = re.compile(rf"\s*({_NAME})\s*=\s*(\"[^\"]*\"|'[^']*')")
_OPEN = re.compile(rf"<({_NAME})((?:\s+{_NAME}\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
_CLOSE = re.compile(rf"</({_NAME})\s*>")
_ENTITY = re.compile(r"&(#x[0-9a-fA-F]+|#\d+|\w+);")
#: The entities that XML names.
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
#: Attributes that name things; blanks around their values are cut off.
_NAMING = frozenset(("id", "refid", "namespace", "resultMap", "parameterMap", "extends"))


def decode_entities(text: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#":
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(code) if 0 < code < 0x110000 else m[0]
        return _NAMED.get(name, m[0])

    return _ENTITY.sub(one, text) if "&" in text else text


def _doctype_end(source: str, at: int) -> int:
    """The place behind a DOCTYPE, its internal subset and quoted strings included."""
    depth, quote = 0, ""
    for k in range(at, len(source)):
        c = source[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
        elif c == ">" and depth <= 0:
            return k + 1
    return len(source)


def root_name(source: str) -> str | None:
    """The first element's name, behind prolog, comments, instructions and DOCTYPE; None if there is none yet."""
    at = source.find("<")
    while at >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at)
            at = source.find("<", end + 3) if end >= 0 else -1
        elif source.startswith("<?", at):
            end = source.find("?>", at)
            at = source.find("<", end + 2) if end >= 0 else -1
        elif source.startswith("<!", at):
            end = _doctype_end(source, at)
            at = source.find("<", end) if end < len(source) else -1
        elif m := re.compile(rf"<({_NAME})").match(source, at):
            return m[1]
        else:
            at = source.find("<", at + 1)
    return None


def parse(source: str) -> tuple[dict | None, list[tuple[str, str, str, int]]]:
    """The root element and the problems found."""
    breaks = [k for k, c in enumerate(source) if c == "\n"]
    line_of = lambda at: bisect.bisect_left(breaks, at) + 1
    problems: list[tuple[str, str, str, int]] = []
    top: dict = {"tag": "", "attrs": {}, "line": 1, "children": []}
    stack, at, start, held = [top], 0, 0, []

    def flush() -> None:
        text = "".join(t for t, _ in held)
        if text and len(stack) > 1:
            stack[-1]["children"].append({"text": text, "line": held[0][1]})
        held.clear()

    def keep(text: str, where: int) -> None:
        if text:
            held.append((text, line_of(where)))

    while at < len(source):
        at = source.find("<", start)
        if at < 0:
            at = len(source)
        if at > start:
            keep(decode_entities(source[start:at]), start)
        if at == len(source):
            break
        start = at
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            start = end + 3 if end >= 0 else len(source)
        elif source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            keep(source[at + 9 : end if end >= 0 else len(source)], at + 9)
            start = end + 3 if end >= 0 else len(source)
        elif source.startswith("<?", at):
            end = source.find("?>", at)
            start = end + 2 if end >= 0 else len(source)
        elif source.startswith("<!", at) and len(stack) == 1:
            start = _doctype_end(source, at)
        elif m := _CLOSE.match(source, at):
            names = [e["tag"] for e in stack[1:]]
            if m[1] in names:
                flush()
                while (e := stack.pop())["tag"] != m[1]:
                    problems.append(("WARNING", "XML_RECOVERED_UNCLOSED", f"<{e['tag']}> is not closed; closed by </{m[1]}>", e["line"]))
            else:
                problems.append(("WARNING", "XML_RECOVERED_STRAY_CLOSE", f"</{m[1]}> closes nothing", line_of(at)))
            start = m.end()
        elif m := _OPEN.match(source, at):
            flush()
            attrs = {}
            for k, v in _ATTR.findall(m[2]):
                value = decode_entities(v[1:-1])
                if k in _NAMING and value != value.strip():
                    problems.append(("WARNING", "XML_ATTRIBUTE_TRIMMED", f"{k} of <{m[1]}> has blanks around it", line_of(at)))
                    value = value.strip()
                attrs[k] = value
            element = {"tag": m[1], "attrs": attrs, "line": line_of(at), "children": []}
            stack[-1]["children"].append(element)
            if not m[3]:
                stack.append(element)
            start = m.end()
        else:
            problems.append(("WARNING", "XML_LENIENT_LT", "'<' is taken as text", line_of(at)))
            keep("<", at)
            start = at + 1
    flush()
    for e in reversed(stack[1:]):
        problems.append(("WARNING", "XML_RECOVERED_UNCLOSED", f"<{e['tag']}> is not closed; closed by the end of the file", e["line"]))
    roots = [c for c in top["children"] if "tag" in c]
    if not roots:
        return None, [("ERROR", "XML_PARSE_ERROR", "no element found", 1)]
    return roots[0], problems

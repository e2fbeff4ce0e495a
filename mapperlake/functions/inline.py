"""Inline parameters in SQL text: #x#, $x$, #{x,...}, ${x}."""

from __future__ import annotations

import re

#: One parameter in text: braces of the newer dialect, or a pair of signs of the older.
PARAMETER = re.compile(r"#\{([^}]*)\}|\$\{([^}]*)\}|#([^#\s{}][^#\n{}]*)#|\$([^$\s{}][^$\n{}]*)\$")


def inline_parts(expression: str) -> dict:
    """property, jdbcType and nullValue of `property[:jdbcType[:nullValue]]`; later colons belong to nullValue."""
    parts = [*expression.split(":", 2), None, None][:3]
    return {"property": parts[0].strip(), "jdbcType": parts[1].strip() if parts[1] else None, "nullValue": parts[2]}


def brace_parts(expression: str) -> dict:
    """property and jdbcType of `property[,key=value...]`."""
    head, *rest = expression.split(",")
    options = dict(x.strip().split("=", 1) for x in rest if "=" in x)
    return {"property": head.strip(), "jdbcType": options.get("jdbcType"), "nullValue": None}


def parameters(text: str) -> list[dict]:
    """Parameters of a text in order: start, end, raw, binding (HASH or DOLLAR), style, property, name, jdbcType, nullValue."""
    out = []
    for m in PARAMETER.finditer(text):
        k = next(i for i in range(1, 5) if m[i] is not None)
        parts = brace_parts(m[k]) if k <= 2 else inline_parts(m[k])
        out.append({"start": m.start(), "end": m.end(), "raw": m[0], "expression": m[k], "binding": "HASH" if k in (1, 3) else "DOLLAR", "braces": k <= 2, **parts, "name": parts["property"].replace("[]", "")})
    return out

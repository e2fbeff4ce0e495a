"""Lossless SQL tokens: their texts joined are the input, whatever it is.

Kinds: space, comment, hint, string, quoted, number, word, parameter, sign. A parameter is #x#, $x$, #{x}, ${x}, :x, ?.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<hint>/\*\+.*?(?:\*/|\Z)|--\+[^\n]*)|(?P<comment>/\*.*?(?:\*/|\Z)|--[^\n]*)|(?P<string>[nN]?'(?:[^']|'')*(?:'|\Z))"
    r"|(?P<parameter>#\{[^}]*\}|\$\{[^}]*\}|#[^#\s{}]+#|\$[^$\s{}]+\$|\?|:[A-Za-z_]\w*)"
    r"|(?P<quoted>\"(?:[^\"]|\"\")*(?:\"|\Z)|`[^`]*(?:`|\Z)|\[[A-Za-z_][^\]\n]*\])|(?P<number>\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+)"
    r"|(?P<word>[^\W\d]\w*(?:\$(?!\{|[\w.\[\]]+\$)\w*|#(?!\{)(?=\w*(?:[\s,.()=]|$))\w*)*)|(?P<sign>\(\+\)|<=>|<>|!=|<=|>=|\|\||:=|::|->>|->|\*\*|.)",
    re.S,
)


class Token(NamedTuple):
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Token]:
    out = [Token(m.lastgroup or "sign", m[0], m.start()) for m in _TOKEN.finditer(sql)]
    return out


def bare(text: str) -> str:
    """A name without its quotes."""
    return text[1:-1] if len(text) > 1 and text[0] in "\"`[" else text


def solid(tokens: list[Token]) -> list[Token]:
    """Tokens that mean something to a parser."""
    return [t for t in tokens if t.kind not in ("space", "comment", "hint")]

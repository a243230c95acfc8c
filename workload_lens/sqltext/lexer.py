"""Tokens of PostgreSQL SQL."""

from __future__ import annotations

import re
from typing import NamedTuple


class SqlError(ValueError):
    """The text is not SQL this package can read."""


class Token(NamedTuple):
    kind: str  # name, quoted, number, string, param, op, punct, end
    value: str
    at: int
    text: str  # as written


_SCANNER = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
  | (?P<dollar>\$(?P<tag>(?:[^\W\d]\w*)?)\$)
  | (?P<param>\$\d+)
  | (?P<string>(?:[eE]|[bB]|[xX]|[nN]|[uU]&)?')
  | (?P<quoted>(?:[uU]&)?"(?:[^"]|"")*")
  | (?P<number>0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)
  | (?P<name>[^\W\d][\w$]*)
  | (?P<cast>::)
  | (?P<assign>:=|\.\.|=>)
  | (?P<op>[-+*/<>=~!@\#%^&|`?]+)
  | (?P<punct>[()\[\],;:.])""",
    re.VERBOSE,
)


def tokens(sql: str) -> list[Token]:
    out: list[Token] = []
    at, n = 0, len(sql)
    while at < n:
        if sql.startswith("/*", at):
            at = _comment(sql, at)
            continue
        m = _SCANNER.match(sql, at)
        if m is None:
            raise SqlError(f"unexpected character at {at}")
        kind, text, end = m.lastgroup, m.group(), m.end()
        if kind == "tag":
            kind = "dollar"
        if kind == "space":
            at = end
            continue
        if kind == "dollar":
            close = sql.find(text, end)
            if close < 0:
                raise SqlError("unterminated dollar-quoted string")
            body, end = sql[end:close], close + len(text)
            out.append(Token("string", "'" + body.replace("'", "''") + "'", at, sql[at:end]))
        elif kind == "string":
            end = _string(sql, end, text[:1] in "eE")
            out.append(Token("string", sql[at:end], at, sql[at:end]))
        elif kind == "quoted":
            value = text[text.index('"') + 1 : -1].replace('""', '"')
            if not value:
                raise SqlError("zero-length identifier")
            out.append(Token("quoted", value, at, text))
        elif kind == "name":
            out.append(Token("name", text.lower(), at, text))
        elif kind == "op":
            text = _operator(text)
            end = at + len(text)
            out.append(Token("op", "<>" if text == "!=" else text, at, text))
        elif kind in ("cast", "assign"):
            out.append(Token("punct", text, at, text))
        else:
            if kind == "number" and re.match(r"[^\W\d]", sql[end : end + 1]):
                raise SqlError(f"trailing junk after number at {at}")
            out.append(Token(kind, text, at, text))
        at = end
    out.append(Token("end", "", n, ""))
    return out


def _operator(text: str) -> str:
    """The longest operator: comments end one, and a long one ends in + or - only with a special sign."""
    for stop in ("--", "/*"):
        cut = text.find(stop)
        if cut > 0:
            text = text[:cut]
    while len(text) > 1 and text[-1] in "+-" and not any(c in "~!@#%^&|`?" for c in text):
        text = text[:-1]
    return text


def _string(sql: str, at: int, escapes: bool) -> int:
    """The end of a string whose first quote is just before ``at``."""
    while True:
        quote = sql.find("'", at)
        if quote < 0:
            raise SqlError("unterminated string")
        if escapes:
            slash = sql.find("\\", at)
            if 0 <= slash < quote:
                at = slash + 2
                continue
        if sql.startswith("''", quote):
            at = quote + 2
            continue
        return quote + 1


def _comment(sql: str, at: int) -> int:
    depth, begin = 0, at
    for m in re.compile(r"/\*|\*/").finditer(sql, begin):
        if m.start() < at:
            continue
        depth += 1 if m.group() == "/*" else -1
        at = m.end()
        if not depth:
            return at
    raise SqlError("unterminated comment")

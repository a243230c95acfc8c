"""What the package does with one SQL text."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from . import deparse, reshape
from .casts import Caster, Lookup
from .lexer import SqlError, Token
from .nodes import Node, replace
from .parser import parse

PREFIX = "sha1:"


class Canonical(NamedTuple):
    canonical: str
    shape: str


# -- shapes ------------------------------------------------------------------


def _constant(node: Node) -> bool:
    if node.kind == "cast":
        return _constant(node["arg"])
    if node.kind == "row":
        return all(map(_constant, node["items"]))
    return node.kind == "mask"


def _mask(node: Node) -> Node:
    """Literals and parameters as ``?``; lists of constants and repeated rows as one."""
    if node.kind in ("const", "param"):
        return Node("mask")
    if node.kind == "command":
        return Node("command", tokens=tuple(Token("mask", "?", t.at, "?") if t.kind in ("string", "number", "param") else t for t in node["tokens"]))
    replace(node, _mask)
    if node.kind == "in" and all(map(_constant, node["items"])):
        node["items"] = node["items"][:1]
    if node.kind == "select" and node["values"]:
        node["values"] = list({deparse.expr(x): x for x in node["values"]}.values())
    if node.kind in ("select", "update", "delete"):
        reshape.order_ands(node["where"])
        reshape.order_ands(node["having"])
    return node


def analyze(sql: str) -> Canonical:
    """Canonical text and shape; raises SqlError."""
    try:
        trees = reshape.canonical(parse(sql))
        text = deparse.deparse(trees)
        return Canonical(text, deparse.deparse([_mask(x) for x in trees]))
    except RecursionError as e:
        raise SqlError("nested too deeply") from e


def normalize(sql: str) -> str:
    """The canonical text, literals kept."""
    return analyze(sql).canonical


def shape(sql: str) -> str:
    """The canonical text without literals and parameter numbers."""
    return analyze(sql).shape


def fingerprint_of_shape(text: str) -> str:
    return PREFIX + hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def fingerprint(sql: str) -> str:
    return fingerprint_of_shape(shape(sql))


# -- parameters --------------------------------------------------------------


def cast_params(canonical: str, lookup: Lookup) -> str:
    """``canonical`` with casts; unchanged where there is nothing to cast or it can't be read."""
    try:
        trees = [reshape.settle(x) for x in parse(canonical)]
        caster = Caster(lookup)
        for x in trees:
            caster.visit(x)
        return deparse.deparse(trees) if caster.changed else canonical
    except (SqlError, RecursionError):
        return canonical


_STRING = re.compile(r"'[^']*(?:''[^']*)*'?")


def max_param_number(sql: str) -> int:
    """The highest ``$N`` outside single-quoted strings; 0 without any."""
    return max((int(x) for x in re.findall(r"\$(\d+)", _STRING.sub(" ", sql))), default=0)

"""Canonical form of syntax trees: decorative aliases, AND order, parameters.

Queries are rewritten from the inside out, each in a scope of its own. An alias
goes when its table occurs once in the scope; with one relation in the scope the
qualifier goes too, otherwise it becomes the table's name. Every part of a query
is walked, windows, locks and samples included, and an inner name that equals an
outer alias is left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from . import deparse
from .nodes import Node, children, replace, walk

QUERIES = ("select", "update", "delete", "insert")


def settle(node: Node) -> Node:
    """Drop the parentheses that parsing noted around ANDs, but on the right of an AND."""
    replace(node, settle)
    if node.kind == "bool" and node["op"] == "and":
        first = node["args"][0]
        if first.kind == "bool" and first["op"] == "and":  # a AND b, in parentheses, goes on
            node["args"] = first["args"] + node["args"][1:]
        node["args"] = [Node("paren", arg=x) if x.kind == "bool" and x["op"] == "and" else x for x in node["args"]]
    return node["arg"] if node.kind == "paren" else node


# -- scopes ------------------------------------------------------------------


def _entries(items: list[Node]) -> Iterator[Node]:
    """What FROM brings into scope, joins opened."""
    for x in items:
        if x.kind == "join":
            yield from _entries([x["left"], x["right"]])
        elif x.kind == "paren_join":
            yield x
            yield from _entries([x["join"]])
        elif x.kind == "sample":
            yield from _entries([x["item"]])
        else:
            yield x


def _own(query: Node) -> list[Node]:
    entries = list(_entries(query["from"] or []))
    return [query["relation"], *entries] if query.kind in ("update", "delete") else entries


def _names(query: Node) -> set[str]:
    """Names that columns may be qualified with, by the query's own FROM."""
    return {x["alias"] or (x["parts"][-1] if x.kind == "relation" else "") for x in _own(query)}


def _decorative(entries: list[Node]) -> dict[str, tuple[str, bool]]:
    """{alias: (table name, whether it qualifies columns)}; clears those aliases."""
    times = Counter(x["parts"][-1] for x in entries if x.kind == "relation")
    found: dict[str, tuple[str, bool]] = {}
    for x in entries:
        if x.kind == "relation" and x["alias"] and not x["columns"] and times[x["parts"][-1]] == 1:
            found[x["alias"]] = x["parts"][-1], len(entries) > 1
            x["alias"] = None
    return found


def _requalify(node: Node, names: dict[str, tuple[str, bool]]) -> None:
    """Rewrite qualified columns below ``node``, but for names an inner query has itself."""
    if node.kind == "column" and len(node["parts"]) > 1 and node["parts"][0] in names:
        table, qualifies = names[node["parts"][0]]
        node["parts"] = [table] * qualifies + node["parts"][1:]
    if node.kind == "locking":
        for x in node["of"] or ():
            if x["parts"][0] in names:
                x["parts"] = [names[x["parts"][0]][0]]
        return
    for x in children(node):
        if x.kind in QUERIES:
            hidden = _names(x)
            _requalify(x, {k: v for k, v in names.items() if k not in hidden})
        else:
            _requalify(x, names)


# -- AND order ---------------------------------------------------------------

_RANK = ("op", "in", "is", "between", "array_op", "sublink", "bool", "column", "param", "const")
_SIDES = {"op": ("left", "right"), "array_op": ("left", "right"), "between": ("arg", "low", "high"), "in": ("arg", "items"), "paren": ("arg",), "bool": ("args",)}


def _key(node: Node) -> tuple[int, int, str]:
    rank = _RANK.index(node.kind) if node.kind in _RANK else len(_RANK)
    return node.kind == "paren", rank, deparse.expr(node)


def order_ands(node: Node | None) -> None:
    """Sort the conjuncts of every AND reached through operators and connectives."""
    if node is None or node.kind not in _SIDES:
        return
    for side in _SIDES[node.kind]:
        for x in node[side] if isinstance(node[side], list) else [node[side]]:
            order_ands(x)
    if node.kind == "bool" and node["op"] == "and":
        node["args"] = sorted(node["args"], key=_key)


# -- statements --------------------------------------------------------------


def _inner_queries(node: Node) -> Iterator[Node]:
    for x in children(node):
        if x.kind in QUERIES:
            yield x
        else:
            yield from _inner_queries(x)


def reshape(query: Node) -> None:
    """Queries, updates and deletes; an INSERT and what it selects stay as they are."""
    if query.kind not in ("select", "update", "delete"):
        return
    for x in _inner_queries(query):
        reshape(x)
    names = _decorative(_own(query))
    if names:
        with_, query.f["with"] = query["with"], None  # WITH can't see this scope
        _requalify(query, names)
        query.f["with"] = with_
    order_ands(query["where"])
    order_ands(query["having"])


def fix_extract(statement: Node) -> None:
    for x in walk(statement):
        if x.kind == "extract":
            field = x["field"]
            if field.kind == "param":
                x["field"] = Node("field_name", name="epoch")
            elif field.kind == "const":
                x["field"] = Node("field_name", name=field["value"].strip("'").lower())


def renumber(statement: Node) -> None:
    """Close the gaps between parameter numbers, in the whole statement."""
    params = [x for x in walk(statement) if x.kind == "param"]
    rank = {n: i for i, n in enumerate(sorted({x["n"] for x in params}), 1)}
    for x in params:
        x["n"] = rank[x["n"]]


def canonical(statements: list[Node]) -> list[Node]:
    out = [settle(x) for x in statements]
    for x in out:
        reshape(x)
        fix_extract(x)
        renumber(x)
    return out

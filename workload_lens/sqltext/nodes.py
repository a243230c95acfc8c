"""Syntax tree: nodes of a kind with named fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class Node:
    """One node. Fields hold nodes, lists of nodes, or plain values."""

    __slots__ = ("kind", "f")

    def __init__(self, kind: str, **fields) -> None:
        self.kind, self.f = kind, fields

    def __getitem__(self, name: str):
        return self.f.get(name)

    def __setitem__(self, name: str, value) -> None:
        self.f[name] = value

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.f.items() if v)})"


def _nodes(value) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _nodes(x)


def children(node: Node) -> Iterator[Node]:
    for value in node.f.values():
        yield from _nodes(value)


def walk(node: Node) -> Iterator[Node]:
    """The node and all below it, parents first."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(list(children(x))))


def replace(node: Node, change: Callable[[Node], Node]) -> None:
    """Replace each child of ``node`` by ``change(child)``."""

    def new(value):
        if isinstance(value, Node):
            return change(value)
        return [new(x) for x in value] if isinstance(value, list) else value

    for k, v in node.f.items():
        node.f[k] = new(v)

"""Type casts for parameters whose type the server could not infer alone."""

from __future__ import annotations

from collections.abc import Callable

from .nodes import Node, children

#: (schema or "", function, number of arguments) -> argument types, or None.
Lookup = Callable[[str, str, int], "list[str] | None"]
_JSON_BUILDERS = ("json_build_object", "jsonb_build_object")


def _cast(node: Node, type_: str) -> Node:
    return Node("cast", arg=node, type=Node("type", parts=type_.split("."), mods=None, zone="", arrays="", setof=False))


class Caster:
    def __init__(self, lookup: Lookup) -> None:
        self.lookup, self.changed = lookup, False

    def field(self, node: Node, name: str, type_: str) -> None:
        """Cast a field that is a bare parameter."""
        if node[name] is not None and node[name].kind == "param":
            node[name] = _cast(node[name], type_)
            self.changed = True

    def items(self, node: Node, name: str, types: list[str | None]) -> None:
        """Cast the bare parameters of a list, where a type is given."""
        for i, (x, type_) in enumerate(zip(node[name], types)):
            if x.kind == "param" and type_:
                node[name][i] = _cast(x, type_)
                self.changed = True

    def call(self, node: Node) -> None:
        args, parts = node["args"], node["name"]
        if parts[-1] in _JSON_BUILDERS and (len(parts) == 1 or parts[:-1] == ["pg_catalog"]):
            self.items(node, "args", ["text" if i % 2 == 0 else None for i in range(len(args))])
        if len(parts) <= 2 and any(x.kind == "param" for x in args):
            types = self.lookup(parts[0] if len(parts) == 2 else "", parts[-1], len(args))
            if types is not None and len(types) == len(args):
                self.items(node, "args", types)

    def visit(self, node: Node) -> None:
        kind = node.kind
        if kind == "call":
            self.call(node)
        elif kind == "bool":
            self.items(node, "args", ["bool"] * len(node["args"]))
        elif kind in ("select", "update", "delete"):
            self.field(node, "where", "bool")
            self.field(node, "having", "bool")
        elif kind == "join":
            self.field(node, "on", "bool")
        elif kind == "case" and node["arg"] is None:
            for x in node["whens"]:
                self.field(x, "condition", "bool")
        elif kind == "sublink" and node["type"] == "EXISTS":
            for x in node["query"]["targets"] or ():
                self.field(x, "value", "int4")
        for x in children(node):
            self.visit(x)

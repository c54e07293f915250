"""The typed tree: names are resolved, includes are inlined, conditions have types.

Two back ends read it: ``lower`` makes a Spark column, ``interp`` renders one Python record."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from .types import VarType


@dataclass(frozen=True)
class Node:
    pass


# Values: each has a type.


@dataclass(frozen=True)
class Const(Node):
    value: Any
    type: VarType

    def __hash__(self):
        return hash((repr(self.value), self.type))


@dataclass(frozen=True)
class Param(Node):
    name: str
    type: VarType


@dataclass(frozen=True)
class Item(Node):
    """The element of a loop, by the loop's number."""

    loop: int
    type: VarType


@dataclass(frozen=True)
class Index(Node):
    loop: int
    type: VarType


@dataclass(frozen=True)
class Member(Node):
    base: Node
    name: str
    column: str
    type: VarType


@dataclass(frozen=True)
class Apply(Node):
    """upper, lower, trim, fixed (fast or exact), join, limit, add, sub, len, kind, text (display)."""

    op: str
    base: Node
    arg: Any
    type: VarType


@dataclass(frozen=True)
class Join(Node):
    """Texts one after the other."""

    parts: tuple[Node, ...]
    type: VarType


# Conditions.


@dataclass(frozen=True)
class Test(Node):
    """const, and, or, not, truth, has, eq, less, le, contains, subset, within, all_within, is."""

    op: str
    args: tuple


# Texts.


@dataclass(frozen=True)
class Choice(Node):
    branches: tuple[tuple[Node, Node], ...]
    other: Node


@dataclass(frozen=True)
class Switch(Node):
    """The case that a text names, or the other one; cases are many, so back ends search for the name."""

    key: Node
    cases: tuple[tuple[str, Node], ...]
    other: Node

    def __hash__(self):
        return hash((self.key, tuple(n for n, _ in self.cases)))


@dataclass(frozen=True)
class Loop(Node):
    number: int
    over: Node
    body: Node
    other: Node | None


@dataclass(frozen=True)
class Stop(Node):
    """Rendering ends with an error: a panic, or another kind."""

    message: Node
    kind: str


def walk(node: Node):
    """The tree's nodes as written out."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        for v in vars(x).values():
            todo += _inside(v)


def children(node: Node) -> list[Node]:
    """The nodes right below, in the order of their fields."""
    return [n for v in vars(node).values() for n in _inside(v)]


def _inside(v) -> list[Node]:
    if isinstance(v, Node):
        return [v]
    if isinstance(v, tuple):
        return [n for x in v for n in _inside(x)]
    return []


def size(node: Node) -> int:
    return sum(1 for _ in walk(node))


def params_of(node: Node) -> set[str]:
    """Names of the parameters the tree reads."""
    return {x.name for x in walk(node) if isinstance(x, Param)}


def pruned(node: Node, keep) -> Node:
    """The tree with only the cases of each switch that ``keep`` (from the switch to names, or None for all) names."""
    def inside(v):
        if isinstance(v, Node):
            return pruned(v, keep)
        return tuple(map(inside, v)) if isinstance(v, tuple) else v

    if isinstance(node, Switch):
        names = keep(node)
        if names is not None:
            node = replace(node, cases=tuple(c for c in node.cases if c[0] in names))
    if not any(isinstance(x, Switch) for x in walk(node)):
        return node
    return replace(node, **{k: inside(v) for k, v in vars(node).items()})

"""The syntax tree of a path expression; nodes are frozen, so compiled expressions can be cached and shared."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    kind: str  # empty boolean integer decimal string date datetime time quantity
    value: Any = None


@dataclass(frozen=True)
class Variable(Node):
    """%name"""

    name: str


@dataclass(frozen=True)
class Special(Node):
    """$this, $index, $total"""

    name: str


@dataclass(frozen=True)
class Member(Node):
    name: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Dot(Node):
    base: Node
    step: Node


@dataclass(frozen=True)
class Index(Node):
    base: Node
    at: Node


@dataclass(frozen=True)
class Sign(Node):
    op: str
    of: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class TypeTest(Node):
    op: str  # is, as
    of: Node
    type_name: str


def type_name_of(node: Node) -> str:
    """The type that an argument such as FHIR.Patient names."""
    if isinstance(node, Member):
        return node.name
    if isinstance(node, Dot) and isinstance(node.step, Member):
        return f"{type_name_of(node.base)}.{node.step.name}"
    if isinstance(node, Literal) and node.kind == "string":
        return node.value
    return ""

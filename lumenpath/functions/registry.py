"""The functions of path expressions. Each compiles a call to columns; users may add their own.

A builder gets (compiler, input, argument nodes) and returns a collection. Names registered later replace earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int
    build: Callable


_FUNCTIONS: dict[str, Function] = {}


def function(name: str, least: int = 0, most: int | None = None) -> Callable:
    def add(build: Callable) -> Callable:
        _FUNCTIONS[name] = Function(name, least, least if most is None else most, build)
        return build

    return add


def register(name: str, least: int, most: int, build: Callable) -> None:
    """Adds build(input, *argument collections) -> collection as a function of expressions."""
    function(name, least, most)(lambda c, this, args: build(this, *[c.argument(a, this) for a in args]))


def get(name: str) -> Function | None:
    return _FUNCTIONS.get(name)


def has(name: str) -> bool:
    return name in _FUNCTIONS


def names() -> list[str]:
    return sorted(_FUNCTIONS)

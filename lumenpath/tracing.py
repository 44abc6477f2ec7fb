"""What trace() tells, and to whom."""

from __future__ import annotations

import logging
from collections.abc import Callable

Listener = Callable[[str, list], None]


def to_log(name: str, items: list) -> None:
    logging.getLogger("lumenpath.trace").info("trace %s: %s", name, items)


def to_nobody(name: str, items: list) -> None:
    pass


_listener: Listener = to_log


def set_listener(listener: Listener) -> None:
    """listener(name, items) is called for each trace() of the evaluator without a schema, in the process that evaluates."""
    global _listener
    _listener = listener


def listener() -> Listener:
    return _listener

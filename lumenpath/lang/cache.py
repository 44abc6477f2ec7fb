"""A cache of what is made from texts, such as trees of expressions: the most recently used ones stay."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock


@dataclass(frozen=True)
class Stats:
    size: int
    limit: int
    hits: int
    misses: int

    @property
    def hit_rate(self) -> float:
        """Per cent."""
        return 100 * self.hits / max(1, self.hits + self.misses)


class Cache:
    """make(text), made once as long as the text stays among the `limit` used last; without a positive limit all stay."""

    def __init__(self, make: Callable[[str], object], limit: int = 1000):
        self.make, self.limit = make, limit
        self._made: OrderedDict[str, object] = OrderedDict()
        self._hits = self._misses = 0
        self._lock = Lock()

    def get(self, text: str):
        with self._lock:
            if text in self._made:
                self._made.move_to_end(text)
                self._hits += 1
                return self._made[text]
        made = self.make(text)  # what can't be made raises, and is not kept
        with self._lock:
            self._misses += 1
            self._made[text] = made
            while 0 < self.limit < len(self._made):
                self._made.popitem(last=False)
        return made

    def clear(self) -> None:
        with self._lock:
            self._made.clear()
            self._hits = self._misses = 0

    def __len__(self) -> int:
        return len(self._made)

    def stats(self) -> Stats:
        return Stats(len(self._made), self.limit, self._hits, self._misses)

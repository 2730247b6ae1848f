"""What a Python worker keeps between the batches and tasks it runs: one tool at a time, with memories bounded by bytes."""

from collections.abc import Callable
from sys import getsizeof
from typing import Any

#: Bytes that one entry of a memory takes besides its key and value.
ENTRY = 100
_held: dict[tuple, Any] = {}


def held(make: Callable, *given):
    """``make(*given)``, made once per worker and kept until the worker needs another tool.

    Workers are used again by later tasks and stages; what an earlier operator remembered goes as soon as another one begins.
    """
    key = (make, *given)
    if key not in _held:
        _held.clear()
        _held[key] = make(*given)
    return _held[key]


def forget() -> None:
    """For an operator that keeps nothing itself: what an earlier one left in this worker goes."""
    _held.clear()


class Memory(dict):
    """Results of a function, ``limit`` bytes at most: half of them new; a full half becomes the old one, and what is used again comes back.

    A key longer than ``longest`` is computed each time.  Of a key that is a tuple, the parts are taken to be kept elsewhere.
    """

    def __init__(self, function: Callable, limit: int, longest: int | None = None):
        self.function, self.limit, self.longest = function, limit // 2, longest
        self.old: dict = {}
        self.used = 0

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.function(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.function(key)
        size = ENTRY + getsizeof(key) + getsizeof(value)
        if type(value) is tuple:
            size += sum(map(getsizeof, value))
        if self.used + size > self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self.used += size
        self[key] = value
        return value

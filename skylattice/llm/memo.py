"""A bounded memo for tasks: what was asked for lately stays, in two generations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Memo(dict):
    """memo[key] is make(key); at most 2 x most results are held, and frequent keys survive. Strings of over `longest` characters aren't held."""

    def __init__(self, make: Callable[[Any], Any], most: int = 250_000, longest: int = 100) -> None:
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: Any) -> Any:
        if isinstance(key, str) and len(key) > self.longest:
            return self.make(key)
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

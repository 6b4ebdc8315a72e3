"""A small cache of answers on the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable


class TtlCache:
    """Values by key for `ttl` seconds; a full cache drops what has expired, then its oldest half."""

    def __init__(self, ttl: float = 600.0, most: int = 100, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self._held: dict[Hashable, tuple[float, object]] = {}

    def get(self, key: Hashable, default=None):
        held = self._held.get(key)
        return default if held is None or self.clock() - held[0] >= self.ttl else held[1]

    def put(self, key: Hashable, value) -> None:
        now = self.clock()
        if key not in self._held and len(self._held) >= self.most:
            self._held = {k: v for k, v in self._held.items() if now - v[0] < self.ttl}
            if len(self._held) >= self.most:
                by_age = sorted(self._held, key=lambda k: self._held[k][0])
                for k in by_age[: max(1, len(by_age) // 2)]:
                    del self._held[k]
        self._held[key] = (now, value)

    def __len__(self) -> int:
        return len(self._held)

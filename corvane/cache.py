"""Driver-side caches: least recently used with a time limit, and responses that bypass it when they are random."""

from __future__ import annotations

import functools
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from corvane.sources.files import canonical_json


class LruCache:
    """At most ``size`` entries; an entry lives ``ttl`` seconds (None: for ever). Overwriting never evicts another entry."""

    def __init__(self, size: int = 1000, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0
        self.lock = threading.Lock()

    def get(self, key: str, default: Any = None) -> Any:
        with self.lock:
            found = self.entries.get(key)
            if found is not None and (self.ttl is None or self.clock() - found[0] <= self.ttl):
                self.entries.move_to_end(key)
                self.hits += 1
                return found[1]
            self.entries.pop(key, None)
            self.misses += 1
            return default

    def put(self, key: str, value: Any) -> None:
        with self.lock:
            if key not in self.entries and len(self.entries) >= self.size:
                self.entries.popitem(last=False)
            self.entries[key] = self.clock(), value
            self.entries.move_to_end(key)

    def stats(self) -> dict[str, float]:
        total = self.hits + self.misses
        return {"size": len(self.entries), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0}

    def clear(self) -> None:
        with self.lock:
            self.entries.clear()
            self.hits = self.misses = 0


class ResponseCache(LruCache):
    """Answers by prompt and model; those made at a temperature over 0.3 are neither stored nor found."""

    def key(self, prompt: str, model: str) -> str:
        return canonical_json({"prompt": prompt, "model": model})

    def response(self, prompt: str, model: str, temperature: float, make: Callable[[], str]) -> str:
        if temperature > 0.3:
            return make()
        missing = object()
        got = self.get(self.key(prompt, model), missing)
        if got is missing:
            got = make()
            self.put(self.key(prompt, model), got)
        return got


def cached(cache: LruCache) -> Callable:
    """Decorator: results by the function's arguments, which must be plain JSON."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*a, **kw):
            missing = object()
            k = canonical_json({"f": f.__qualname__, "a": a, "kw": kw})
            got = cache.get(k, missing)
            if got is missing:
                got = f(*a, **kw)
                cache.put(k, got)
            return got

        return run

    return wrap

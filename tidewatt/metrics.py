"""Counters and timings of what a process did, by name and labels."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

_lock = threading.Lock()
_counts: Counter[tuple] = Counter()


def count(name: str, amount: float = 1, **labels: str) -> None:
    with _lock:
        _counts[name, *sorted(labels.items())] += amount


@contextmanager
def timed(name: str, **labels: str) -> Iterator[None]:
    """Seconds and calls of a block, those that fail too."""
    began = time.perf_counter()
    try:
        yield
    finally:
        count(f"{name}_seconds", time.perf_counter() - began, **labels)
        count(f"{name}_calls", **labels)


def snapshot() -> dict[str, float]:
    """All counters so far, as ``name{label=value}``."""
    with _lock:
        return {name + (f"{{{', '.join(f'{k}={v}' for k, v in labels)}}}" if labels else ""): value for (name, *labels), value in sorted(_counts.items())}

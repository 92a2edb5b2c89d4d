"""Order of work that depends on other work."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable


def in_order[T: Hashable](nodes: Iterable[T], edges: Iterable[tuple[T, T]]) -> list[T]:
    """The nodes, each after all that have an edge to it; of those that are free, the first given comes first."""
    waits: dict[T, int] = dict.fromkeys(nodes, 0)
    after: dict[T, list[T]] = {n: [] for n in waits}
    for a, b in edges:
        if a not in waits or b not in waits:
            raise KeyError(a if a not in waits else b)
        after[a].append(b)
        waits[b] += 1
    free, out = deque(n for n, k in waits.items() if not k), []
    while free:
        node = free.popleft()
        out.append(node)
        for b in after[node]:
            waits[b] -= 1
            if not waits[b]:
                free.append(b)
    if len(out) < len(waits):
        raise ValueError("there is a circle of dependencies")
    return out

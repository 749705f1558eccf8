"""Causal diagrams of a dozen edges: paths, d-separation, adjustment sets. Plain Python on the driver."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

Edge = tuple[str, str]


def descendants(edges: tuple[Edge, ...], node: str) -> set[str]:
    found, front = set(), {node}
    while front:
        front = {b for a, b in edges if a in front} - found
        found |= front
    return found - {node}


def backdoor_paths(edges: tuple[Edge, ...], x: str, y: str) -> list[list[str]]:
    """Simple paths from x to y, whatever the arrows' directions, whose first arrow points at x."""
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, stack = [], [[x, a] for a, b in edges if b == x]
    while stack:
        path = stack.pop()
        if path[-1] == y:
            if len(path) > 2:
                out.append(path)
            continue
        stack += [[*path, n] for n in sorted(near.get(path[-1], ())) if n not in path]
    return sorted(out)


def blocked(edges: tuple[Edge, ...], path: list[str], given: frozenset[str]) -> bool:
    """Is the path closed, given a set? A collider is open only if it or a descendant is given."""
    have = set(edges)
    for a, m, b in zip(path, path[1:], path[2:]):
        if (a, m) in have and (b, m) in have:
            if m not in given and not descendants(edges, m) & given:
                return True
        elif m in given:
            return True
    return False


@lru_cache(maxsize=64)
def adjustment_set(edges: tuple[Edge, ...], x: str, y: str) -> tuple[str, ...] | None:
    """The smallest set that closes all backdoor paths, the first in the order of combinations; None if there is none."""
    banned = descendants(edges, x) | {x, y}
    nodes = list(dict.fromkeys(n for e in edges for n in e))
    paths, able = backdoor_paths(edges, x, y), [n for n in nodes if n not in banned]
    for k in range(len(able) + 1):
        for chosen in combinations(able, k):
            if all(blocked(edges, p, frozenset(chosen)) for p in paths):
                return chosen
    return None


def model_check(edges: tuple[Edge, ...], x: str, y: str, used: list[str]) -> dict:
    needed = set(adjustment_set(edges, x, y) or ())
    mediators = descendants(edges, x) & {n for n in {a for e in edges for a in e} if y in descendants(edges, n)}
    wrong = sorted(set(used) & mediators)
    missing, extra = sorted(needed - set(used)), sorted(set(used) - needed - mediators)
    return {"mediators": wrong, "missing": missing, "extra": extra, "ok": not wrong and not missing}


def roles(edges: tuple[Edge, ...], x: str, y: str) -> dict[str, str]:
    needed, out = set(adjustment_set(edges, x, y) or ()), {}
    for n in dict.fromkeys(n for e in edges for n in e):
        out[n] = "exposure" if n == x else "outcome" if n == y else "adjust" if n in needed else "mediator" if n in descendants(edges, x) and y in descendants(edges, n) else "other"
    return out

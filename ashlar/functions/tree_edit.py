"""Minimum-cost edit scripts between two schemas seen as unordered labelled trees."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

DELETE, INSERT, RETYPE, MOVE = 1.0, 1.0, 0.25, 1.0
NEVER = 1e9


@dataclass
class Node:
    """A field: its name, the JSON types of its values, the fields inside (``[]`` is the element of a list)."""

    name: str
    types: frozenset = frozenset()
    children: dict[str, Node] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())

    def shape(self) -> tuple:
        return self.types, tuple(sorted((n, c.shape()) for n, c in self.children.items()))


def escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def unescaped(step: str) -> str:
    return step.replace("~1", "/").replace("~0", "~")


def build(items: list[tuple[str, str]]) -> Node:
    """The tree of (path, type) pairs; path steps are joined by ``/`` (in names ``~1`` is ``/``, ``~0`` is ``~``)."""
    root = Node("")
    for path, kind in items:
        at = root
        for step in path.split("/"):
            name = unescaped(step)
            at = at.children.setdefault(name, Node(name))
        if kind:
            at.types |= {kind}
    return root


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in a cheapest assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j] = True
            row, step, following = match[j], float("inf"), 0
            for k in range(1, n + 1):
                if not used[k]:
                    d = cost[row - 1][k - 1] - u[row] - v[k]
                    if d < least[k]:
                        least[k], way[k] = d, j
                    if least[k] < step:
                        step, following = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[match[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = following
            if not match[j]:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = [0] * n
    for k in range(1, n + 1):
        out[match[k] - 1] = k - 1
    return out


Price = Callable[[tuple, str, str, Node, Node], float]
Candidates = Callable[[tuple, dict[str, Node], dict[str, Node]], Iterable[tuple[str, str]]]


def every_pair(at: tuple, gone: dict[str, Node], came: dict[str, Node]) -> Iterator[tuple[str, str]]:
    return ((x, y) for x in gone for y in came)


def groups(pairs: Iterable[tuple[str, str]]) -> list[tuple[list[str], list[str]]]:
    """The connected groups of the pairs' old and new names; names without a pair are in none."""
    of: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        while of.setdefault(x, x) != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for old, new in pairs:
        a, b = root((0, old)), root((1, new))
        of[max(a, b)] = min(a, b)
    groups: dict[tuple, tuple[list, list]] = {}
    for x in sorted(of):
        groups.setdefault(root(x), ([], []))[x[0]].append(x[1])
    return list(groups.values())


def _edits(a: Node, b: Node, at: tuple, rename: Price, candidates: Candidates) -> tuple[float, list[tuple]]:
    """Cost and edits that turn the children of ``a`` into those of ``b``; a field keeps its identity by its name, the
    others are paired by a cheapest assignment of renaming against deleting and inserting, in each group of names that
    candidates connect; names without a candidate can only go or come."""
    total, edits = 0.0, []
    for name in sorted(a.children.keys() & b.children.keys()):
        x, y = a.children[name], b.children[name]
        if x.types != y.types:
            total += RETYPE
            edits.append(("retype", at + (name,), at + (name,), x, y))
        cost, inner = _edits(x, y, at + (name,), rename, candidates)
        total += cost
        edits += inner
    gone = {n: a.children[n] for n in sorted(a.children.keys() - b.children.keys())}
    came = {n: b.children[n] for n in sorted(b.children.keys() - a.children.keys())}
    prices, inside = {}, {}
    for old, new in candidates(at, gone, came) if gone and came else ():
        x, y = gone[old], came[new]
        price = rename(at, old, new, x, y)
        if price < NEVER:
            cost, inside[old, new] = _edits(x, y, at + (new,), rename, candidates)
            prices[old, new] = price + cost + (RETYPE if x.types != y.types else 0)
    paired = {}
    for olds, news in groups(prices):
        n, m = len(olds), len(news)
        matrix = [[prices.get((old, new), NEVER) for new in news] + [DELETE * gone[old].size() if k == i else NEVER for k in range(n)] for i, old in enumerate(olds)]
        matrix += [[INSERT * came[new].size() if k == j else NEVER for j, new in enumerate(news)] + [0.0] * n for k in range(m)]
        paired |= {olds[i]: news[j] for i, j in enumerate(assign(matrix)[:n]) if j < m}
    for old, x in gone.items():
        if old in paired:
            new = paired[old]
            total += prices[old, new]
            edits.append(("rename", at + (old,), at + (new,), x, came[new]))
            if x.types != came[new].types:
                edits.append(("retype", at + (new,), at + (new,), x, came[new]))
            edits += inside[old, new]
        else:
            total += DELETE * x.size()
            edits.append(("delete", at + (old,), (), x, None))
    for new in came.keys() - set(paired.values()):
        total += INSERT * came[new].size()
        edits.append(("add", (), at + (new,), None, came[new]))
    return total, edits


def script(a: Node, b: Node, rename: Price, candidates: Candidates = every_pair) -> tuple[float, list[tuple]]:
    """The cost and the edits ``(op, old path, new path, old node, new node)`` of a cheapest script.

    ``rename(parent path, old, new, node, node)`` prices a rename, ``NEVER`` forbids it; ``candidates(parent path, gone,
    came)`` gives the pairs of names to ask it for. Of edits inside a renamed field, the old path begins with its new
    name. A deleted subtree that is inserted elsewhere with the same name and shape becomes one ``move`` where that
    costs less.
    """
    total, edits = _edits(a, b, (), rename, candidates)
    added: dict[tuple, list[tuple]] = {}
    for e in edits:
        if e[0] == "add":
            added.setdefault((e[2][-1], e[4].shape()), []).append(e)
    for d in [e for e in edits if e[0] == "delete"]:
        same = added.get((d[1][-1], d[3].shape()), [])
        e = next((x for x in same if x[2][:-1] != d[1][:-1]), None)
        if e is not None and (DELETE + INSERT) * d[3].size() > MOVE:
            same.remove(e)
            edits = [x for x in edits if x is not d and x is not e] + [("move", d[1], e[2], d[3], e[4])]
            total += MOVE - (DELETE + INSERT) * d[3].size()
    return total, edits


def followed(path: tuple, edits: dict[tuple, tuple]) -> tuple:
    """Where the renames and moves of a script (old path to new path) take a field."""
    at: tuple = ()
    for name in path:
        at = edits.get(at + (name,), at + (name,))
    return at


def walked(node: Node, at: tuple = ()) -> Iterator[tuple[tuple, Node]]:
    """All fields by their paths, each after the one that holds it."""
    for name, child in node.children.items():
        yield at + (name,), child
        yield from walked(child, at + (name,))


def typed(node: Node) -> Iterator[tuple[tuple, tuple[str, str]]]:
    """The path of each field that has one type, with the type and, of an object with one field, that field's name."""
    for path, child in walked(node):
        if len(child.types) == 1:
            yield path, (next(iter(child.types)), next(iter(child.children)) if len(child.children) == 1 else "")

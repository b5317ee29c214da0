"""Query patterns: small graphs on the driver, their symmetries, and orders to match them in."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, permutations


@dataclass(frozen=True)
class Pattern:
    """n vertices from 0, edges (a < b), and labels of the vertices, if any."""

    n: int
    edges: frozenset[tuple[int, int]] = field(default_factory=frozenset)
    labels: tuple[int, ...] | None = None

    @staticmethod
    def of(edges, labels=None, n: int | None = None) -> Pattern:
        """From pairs of vertices."""
        es = frozenset((min(a, b), max(a, b)) for a, b in edges)
        if any(a == b for a, b in es):
            raise ValueError("a pattern has no loops")
        size = n if n is not None else max((b for _, b in es), default=0) + 1
        if labels is not None and len(labels) != size:
            raise ValueError("a label for each vertex is needed")
        return Pattern(size, es, tuple(labels) if labels is not None else None)

    @staticmethod
    def parse(text: str) -> Pattern:
        """From lines 'a b', or 'a la b lb' with labels."""
        edges, labels = [], {}
        for line in text.splitlines():
            parts = [int(x) for x in line.split()]
            if not parts:
                continue
            if len(parts) == 2:
                edges.append((parts[0], parts[1]))
            elif len(parts) == 4:
                a, la, b, lb = parts
                if labels.setdefault(a, la) != la or labels.setdefault(b, lb) != lb:
                    raise ValueError(f"vertex with two labels in {line!r}")
                edges.append((a, b))
            else:
                raise ValueError(f"2 or 4 numbers are expected in {line!r}")
        n = max((max(e) for e in edges), default=-1) + 1
        return Pattern.of(edges, [labels[i] for i in range(n)] if labels else None, n)

    def text(self) -> str:
        """The lines that parse() reads."""
        if self.labels:
            return "".join(f"{a} {self.labels[a]} {b} {self.labels[b]}\n" for a, b in sorted(self.edges))
        return "".join(f"{a} {b}\n" for a, b in sorted(self.edges))

    def has(self, a: int, b: int) -> bool:
        return (min(a, b), max(a, b)) in self.edges

    def neighbours(self, a: int) -> list[int]:
        return [b for b in range(self.n) if b != a and self.has(a, b)]

    def degree(self, a: int) -> int:
        return len(self.neighbours(a))

    def connected(self) -> bool:
        seen, todo = {0}, [0]
        while todo:
            for b in self.neighbours(todo.pop()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return len(seen) == self.n

    def automorphisms(self) -> list[tuple[int, ...]]:
        """All permutations of the vertices that keep edges and labels."""
        same = lambda p: self.labels is None or all(self.labels[i] == self.labels[p[i]] for i in range(self.n))
        return [p for p in permutations(range(self.n)) if same(p) and all(self.has(p[a], p[b]) for a, b in self.edges)]

    def canonical(self) -> tuple:
        """Equal for isomorphic patterns alone: the least (labels, edges) over all orders of the vertices."""
        best = None
        for p in permutations(range(self.n)):
            labels = tuple(self.labels[p.index(i)] for i in range(self.n)) if self.labels else ()
            edges = tuple(sorted((min(p[a], p[b]), max(p[a], p[b])) for a, b in self.edges))
            best = min(best, (labels, edges)) if best else (labels, edges)
        return best

    def matching_order(self, cost: dict[int, int] | None = None) -> list[int]:
        """A connected order with many edges back early; ties by cost (the number of candidates), degree, and number."""
        cost = cost or {}
        first = min(range(self.n), key=lambda v: (cost.get(v, 0), -self.degree(v), v))
        order = [first]
        while len(order) < self.n:
            rest = [v for v in range(self.n) if v not in order]
            order.append(min(rest, key=lambda v: (-sum(self.has(v, w) for w in order), cost.get(v, 0), -self.degree(v), v)))
        return order

    def symmetry_bounds(self, order: list[int]) -> list[tuple[int, int]]:
        """Pairs (a, b) with the demand v_a < v_b that leave one of each set of automorphic matches."""
        group, out = self.automorphisms(), []
        for a in order:
            orbit = {p[a] for p in group}
            out += [(a, b) for b in sorted(orbit) if b != a]
            group = [p for p in group if p[a] == a]
        return out


def clique(k: int) -> Pattern:
    """All pairs of k vertices."""
    return Pattern.of(combinations(range(k), 2))


def path(k: int) -> Pattern:
    """k vertices in a row."""
    return Pattern.of([(i, i + 1) for i in range(k - 1)])


def cycle(k: int) -> Pattern:
    """k vertices in a ring."""
    return Pattern.of([(i, (i + 1) % k) for i in range(k)])


def star(k: int) -> Pattern:
    """A hub with k leaves."""
    return Pattern.of([(0, i + 1) for i in range(k)])


def _graph(text: str) -> Pattern:
    return Pattern.of([(int(e[0]), int(e[1])) for e in text.split()])


#: Named shapes; fixed definitions.
NAMED = {
    "wedge": path(3), "triangle": clique(3), "3star": star(3), "4path": path(4), "rectangle": cycle(4), "tailedtriangle": _graph("01 02 12 03"), "diamond": _graph("01 02 12 03 13"),
    "4clique": clique(4), "5path": path(5), "pentagon": cycle(5), "house": _graph("01 12 23 30 04 14"), "semihouse": _graph("01 02 12 03 23 14 24"), "closedhouse": _graph("01 03 04 13 14 34 20 21"),
    "hourglass": _graph("01 02 12 03 04 34"), "taileddiamond": _graph("01 02 12 03 13 24"), "taileddiamond2": _graph("01 02 12 03 13 04"), "6path": path(6), "dumbbell": _graph("01 02 12 03 34 35 45"),
    "4star": star(4), "fork": _graph("01 02 03 34"), "cricket": _graph("01 02 12 03 04"), "banner": _graph("01 12 23 30 04"), "K2,3": _graph("02 03 04 12 13 14"), "K1,1,3": _graph("01 02 03 04 12 13 14"),
    "bull": _graph("01 02 12 03 14"), "lollipop": _graph("01 02 12 03 34"), "tailed4clique": _graph("01 02 03 12 13 23 04"), "co-P2P3": _graph("01 02 03 12 13 24 34"), "4wheel": _graph("01 12 23 30 04 14 24 34"),
    "K5-e": _graph("01 02 03 04 12 13 14 23 24"), "5clique": clique(5),
}
#: Motifs of each size by their number.
MOTIFS = {
    3: ["wedge", "triangle"],
    4: ["3star", "4path", "tailedtriangle", "rectangle", "diamond", "4clique"],
    5: [
        "4star", "fork", "cricket", "banner", "taileddiamond2", "K2,3", "K1,1,3", "bull", "5path", "lollipop", "taileddiamond",
        "pentagon", "house", "semihouse", "hourglass", "tailed4clique", "co-P2P3", "closedhouse", "4wheel", "K5-e", "5clique",
    ],
}


def shapes_of_edges(k: int) -> list[Pattern]:
    """The connected unlabelled patterns of k edges, once each."""
    found = {path(2).canonical(): path(2)}
    for _ in range(k - 1):
        grown = {}
        for p in found.values():
            for a in range(p.n):
                new = [Pattern.of([*p.edges, (a, p.n)])]
                new += [Pattern.of([*p.edges, (a, b)], n=p.n) for b in range(a + 1, p.n) if not p.has(a, b)]
                for q in new:
                    grown.setdefault(q.canonical(), q)
        found = grown
    return [found[c] for c in sorted(found)]

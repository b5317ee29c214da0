"""Slow and plain versions to compare with."""

from collections import defaultdict
from itertools import combinations, permutations


def neighbours(half):
    adj = defaultdict(set)
    for u, v in half:
        adj[u].add(v)
        adj[v].add(u)
    return adj


def maps(half, pattern, labels=None, induced=False):
    """All injective maps of the pattern, as tuples."""
    adj = neighbours(half)
    out = []

    def grow(found):
        i = len(found)
        if i == pattern.n:
            out.append(tuple(found))
            return
        for v in adj:
            if v in found or (labels is not None and pattern.labels and labels[v] != pattern.labels[i]):
                continue
            if all((v in adj[found[j]]) if pattern.has(i, j) else (not induced or v not in adj[found[j]]) for j in range(i)):
                grow([*found, v])

    grow([])
    return out


def count(half, pattern, induced=False):
    return len(maps(half, pattern, induced=induced)) // len(pattern.automorphisms())


def cores(half):
    adj = {v: set(n) for v, n in neighbours(half).items()}
    core, k = {}, 0
    while adj:
        v = min(adj, key=lambda x: len(adj[x]))
        k = max(k, len(adj[v]))
        core[v] = k
        for w in adj.pop(v):
            adj[w].discard(v)
    return core


def connected(vertices, adj):
    vertices = set(vertices)
    seen, todo = set(), [next(iter(vertices))]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [w for w in adj[v] if w in vertices]
    return seen == vertices


def keyword_sets(half, labels, keywords, k):
    adj = neighbours(half)
    out = set()
    for s in combinations(sorted(adj), k):
        if not connected(s, adj):
            continue
        held = [labels.get(v) for v in s if labels.get(v) in keywords]
        if sorted(held) != sorted(keywords):
            continue
        others = [v for v in s if labels.get(v) not in keywords]
        if not any(connected([w for w in s if w != v], adj) for v in others):
            out.add(s)
    return out


def mni(half, labels, shape):
    """Labelling (least of those that symmetry makes the same) -> least number of distinct images."""
    images = defaultdict(lambda: [set() for _ in range(shape.n)])
    for m in maps(half, shape):
        key = tuple(labels[v] for v in m)
        for i, v in enumerate(m):
            images[key][i].add(v)
    least = {}
    for key, sets in images.items():
        form = min(tuple(key[p[i]] for i in range(shape.n)) for p in shape.automorphisms())
        if form == key:
            least[key] = min(map(len, sets))
    return least


def isomorphic(p, q):
    return p.n == q.n and any({(min(s[a], s[b]), max(s[a], s[b])) for a, b in p.edges} == set(q.edges) for s in permutations(range(p.n)))

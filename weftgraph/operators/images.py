"""Images of the vertices of all labelled patterns of up to three edges, without maps.

Whether a vertex is an image is told by counts of walks: for vertex v, its neighbours by label;
for those of a label, their neighbours by label, without v; and so on by one more step. Walks that
come back to a vertex they have are those of triangles on v, whose number is taken off. So the
counts that a vertex sends along each of its edges are of a fixed size, in three rounds, and
triangles are the only parts of maps that become rows: found by paths opened from the vertex of
least (degree, id), which bounds them whatever the hubs.

A round deals messages as packed columns to parts of the vertices; a part is whole in one task.
"""

from __future__ import annotations

import pickle
from collections import Counter
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import blocks, graph
from weftgraph.plans.pattern import Pattern, shapes_of_edges

#: Labels are from 0 to less than this (pairs of them are bits of a word).
LABELS = 8
#: Entries of lists of a part, rows dealt together, and messages made and paths opened together.
PART_ENTRIES, DEALT, OPENED = 500_000, 2_000_000, 1 << 20

_BLOB = "part int, data binary"
#: What a vertex of some label is in a pattern, and the labels of its others in a code: EDGE: the other; MIDDLE: both ends;
#: TIP: middle, other end; CENTRE: three leaves; LEAF: centre, two leaves; INNER (of a path of three edges): its end, the other
#: middle, the other end; END: the rest of the path; CORNER: two others. CLASH: a vertex of two labels.
EDGE, MIDDLE, TIP, CENTRE, LEAF, INNER, END, CORNER, CLASH = range(9)
#: Kinds of messages.
ALONG, STATE, OPEN, COUNTS = range(4)


def _code(kind: int, own: int, *others: int) -> int:
    x = kind * LABELS + own
    for i in (*others, 0, 0, 0)[:3]:
        x = x * LABELS + i
    return x


def _squeeze(a: np.ndarray) -> bytes:
    """Integers from 0, by planes of bytes of the least width, compressed."""
    most = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view("u1").reshape(len(a), width).T)
    return width.to_bytes(1, "little") + len(a).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _full(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(b[9:], n * width), "u1").reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])


def _deal(parts: int, kind: int, ids: list, values: list):
    """Rows packed for the parts of their first ids."""
    if not len(ids[0]):
        return
    part = blocks._part(ids[0], parts).astype(np.int32)
    order = np.lexsort((*ids[::-1], part))
    ids, values = [x[order] for x in ids], [x[order] for x in values]
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cuts)):
        some = slice(cuts[p], cuts[p + 1])
        rows.append((int(p), pickle.dumps((kind, [blocks.encode(x[some]) for x in ids], [_squeeze(x[some]) for x in values]))))
    yield _batch(rows)


def _joined(some: list) -> tuple[list, list]:
    """Messages of a kind as one (ids, values)."""
    return tuple([np.concatenate(c) for c in zip(*(s[i] for s in some))] for i in range(2))


def _opened(some: list):
    """Packed messages, about OPENED of them at a time; there can be more of them than edges."""
    held, n = [], 0
    for ids, values in some:
        held.append(([blocks.decode(x).astype(np.int64) for x in ids], [_full(x) for x in values]))
        n += len(held[-1][0][0])
        if n >= OPENED:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _round(dealt: DataFrame, parts: int, work) -> DataFrame:
    """work(got, counts) of each part, whose messages are dealt; counts made before are kept with the part."""

    def run(batches):
        part, held = None, []

        def out():
            got, counts, opened = {}, Counter(), []
            for kind, ids, values in map(pickle.loads, held):
                if kind == COUNTS:
                    counts.update(ids)
                elif kind == OPEN:
                    opened.append((ids, values))
                else:
                    got.setdefault(kind, []).append(([blocks.decode(x).astype(np.int64) for x in ids], [_full(x) for x in values]))
            held.clear()
            joined = {kind: _joined(some) for kind, some in got.items()} | {OPEN: _opened(opened)}
            got.clear()
            for message in work(joined, counts):
                yield from _deal(parts, *message)
            if counts:
                yield _batch([(part, pickle.dumps((COUNTS, dict(counts), None)))])

        for batch in batches:
            for p, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held and p != part:
                    yield from out()
                part = p
                held.append(data)
        if held:
            yield from out()

    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, _BLOB)


def _dealt(rows: DataFrame, parts: int, messages) -> DataFrame:
    """Rows of numbers as messages: messages(columns) of DEALT rows at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(batch.num_columns)])
            n += batch.num_rows
            if n >= DEALT:
                yield from _deal(parts, *messages([np.concatenate(c) for c in zip(*held)]))
                held, n = [], 0
        if n:
            yield from _deal(parts, *messages([np.concatenate(c) for c in zip(*held)]))

    return rows.mapInArrow(run, _BLOB)


def _slices(n: int):
    """A vertex can have any number of neighbours; messages to them are made OPENED at a time."""
    for a in range(0, n, OPENED):
        yield slice(a, a + OPENED)


def _tally(counts: Counter, kind: int, labels: np.ndarray, has: np.ndarray, *others: int) -> None:
    """Counts the vertices that have something by their labels."""
    for own, n in enumerate(np.bincount(labels[has], minlength=LABELS).tolist()):
        if n:
            counts[_code(kind, own, *others)] += n


def _split(ids: list, values: list):
    """(own ids, ascending, their values, where each other row's vertex is, the sender, its values) of messages along edges; a vertex's own is from itself."""
    to, sender = ids
    own = np.flatnonzero(to == sender)
    own = own[np.argsort(to[own])]
    at = blocks.Places(to[own]).of(to).astype(np.int64)
    rest = np.flatnonzero((to != sender) & (at >= 0))
    return to[own], [x[own] for x in values], at[rest], sender[rest], [x[rest] for x in values]


def _label(got, counts):
    """Vertices send their labels along edges; edges of unlabelled ones are dropped."""
    if STATE not in got:
        return
    (v,), (labels,) = got[STATE]
    ids, first, back = np.unique(v, return_index=True, return_inverse=True)
    if (labels != (own := labels[first])[back]).any():
        counts[_code(CLASH, 0)] += 1
    if ALONG not in got:
        return
    src, dst = got[ALONG][0]
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    at = blocks.Places(ids).of(src)
    keep = (at >= 0) & (src != dst)
    keep[1:] &= (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, at = src[keep], dst[keep], at[keep]
    yield ALONG, [dst, src], [own[at]]
    there = np.unique(at)
    yield ALONG, [ids[there], ids[there]], [own[there]]


def _near(size, got, counts):
    """Vertices send how many neighbours of each label they have."""
    if ALONG not in got:
        return
    ids, (own,), at, nbr, (label,) = _split(*got[ALONG])
    n = np.bincount(at * size + label, minlength=len(ids) * size).reshape(-1, size)
    for i in _slices(len(at)):
        yield ALONG, [nbr[i], ids[at[i]]], [own[at[i]], *n[at[i]].T]
    yield ALONG, [ids, ids], [own, *n.T]


def _paths(size, got, counts):
    """Vertices send what paths of two edges go on from them, by labels, and paths that may close to triangles."""
    if ALONG not in got:
        return
    ids, (own, *n), at, nbr, (label, *further) = _split(*got[ALONG])
    n, label = np.stack(n, 1).astype(np.int64).reshape(-1, size), label.astype(np.int64)
    less = np.stack(further, 1).astype(np.int64).reshape(-1, size)
    degree = less.sum(1)
    less[np.arange(len(at)), own[at]] -= 1  # a neighbour's neighbours without the vertex
    spots = at * size + label

    def some(good):
        return np.bincount(spots[good], minlength=len(ids) * size).reshape(-1, size) > 0

    labels = range(size)
    for x in labels:
        _tally(counts, EDGE, own, n[:, x] > 0, x)
        tips = some(less[:, x] > 0)
        for c in labels:
            _tally(counts, TIP, own, tips[:, c], c, x)
    for k, kind in ((2, MIDDLE), (3, CENTRE)):
        for xs in combinations_with_replacement(labels, k):
            has = np.ones(len(ids), bool)
            for x in set(xs):
                has &= n[:, x] >= xs.count(x)
            _tally(counts, kind, own, has, *xs)
    for x, y in combinations_with_replacement(labels, 2):
        leaves = some((less[:, x] >= 1 + (x == y)) & (less[:, y] >= 1))
        for c in labels:
            _tally(counts, LEAF, own, leaves[:, c], c, x, y)
    # paths of two edges from a vertex by the labels of their middle and end
    two = np.stack([np.bincount(spots, weights=less[:, d], minlength=len(ids) * size).astype(np.int64).reshape(-1, size) for d in labels], 2)
    back = np.zeros((len(ids), size, size), np.int64)  # paths of three edges with the vertex inside, whose ends have one label and may be one vertex
    for a, c, d in product(labels, repeat=3):
        if a == d:
            back[:, a, c] = (n[:, a] - (a == c)) * two[:, c, a]
        else:
            _tally(counts, INNER, own, (n[:, a] > (a == c)) & (two[:, c, d] > 0), a, c, d)
    # for a neighbour: paths of two edges that go on without it; where the end has its label, it can be the end, so they are counted
    for i in _slices(len(at)):
        of, to, sub = at[i], label[i], less[i]
        mask, again, rows = np.zeros(len(of), np.uint64), two[of, :, to], np.arange(len(of))
        again[rows, to] -= sub[rows, to]
        for c, d in product(labels, repeat=2):
            on = two[of, c, d] - np.where(to == c, sub[:, d], 0)
            mask |= ((on > 0) & (to != d)).astype(np.uint64) << np.uint64(c * LABELS + d)
        yield ALONG, [nbr[i], ids[of]], [own[of], mask, *again.T]
    yield STATE, [ids], [own, *back.reshape(len(ids), -1).T]
    # pairs of neighbours above a vertex by (degree, id), sent to the lower one
    above = np.flatnonzero(blocks._above(degree, nbr, n.sum(1)[at], ids[at]))
    above = above[np.lexsort((nbr[above], degree[above], at[above]))]
    size_of = np.bincount(at[above], minlength=len(ids))
    later = np.cumsum(size_of)[at[above]] - np.arange(len(above)) - 1
    for a, b in blocks._together(later, OPENED):
        low = np.repeat(above[a:b], later[a:b])
        high = above[blocks._spans(np.arange(a, b) + 1, later[a:b])]
        yield OPEN, [nbr[low], ids[at[low]], nbr[high]], [own[at[low]], label[high]]


def _close(size, got, counts):
    """Triangles are found and sent to their corners; ends of paths of three edges are counted where they can't be met again."""
    if STATE not in got:
        return
    (v,), (own, *back) = got.pop(STATE)
    order = np.argsort(v)
    ids, own, back = v[order], own[order].astype(np.int64), [x[order] for x in back]
    places = blocks.Places(ids)
    walks = [np.zeros(len(ids) * size, np.int64)] * size
    if ALONG in got:
        (to, nbr), (label, mask, *again) = got.pop(ALONG)
        at = places.of(to).astype(np.int64)
        spots = at * size + label
        walks = [np.bincount(spots, weights=x, minlength=len(ids) * size).astype(np.int64) for x in again]
        order = np.argsort(spots, kind="stable")
        first = np.flatnonzero(np.diff(spots[order], prepend=-1))
        masks = np.bitwise_or.reduceat(mask[order].astype(np.uint64), first)
        spots = spots[order][first]
        kinds = own[spots // size] * size + spots % size
        for c, d in product(range(size), repeat=2):
            for k, n in enumerate(np.bincount(kinds[(masks >> np.uint64(c * LABELS + d)) & np.uint64(1) != 0], minlength=size * size).tolist()):
                if n:
                    counts[_code(END, k // size, k % size, c, d)] += n
        codes = blocks.Places(np.unique(nbr))
        edges = np.sort(at * len(codes.ids) + codes.of(nbr))
        for (low, v, high), (label, other) in got[OPEN]:
            at, code = places.of(low).astype(np.int64), codes.of(high).astype(np.int64)
            key = at * len(codes.ids) + code
            met = (code >= 0) & (edges[np.minimum(np.searchsorted(edges, key), len(edges) - 1)] == key)
            low, v, high, label, other, mid = low[met], v[met], high[met], label[met].astype(np.int64), other[met].astype(np.int64), own[at[met]]
            to = np.concatenate([low, v, high])
            pair = np.concatenate([np.minimum(x, y) * size + np.maximum(x, y) for x, y in ((label, other), (mid, other), (label, mid))])
            order = np.lexsort((pair, to))
            to, pair = to[order], pair[order]
            new = np.ones(len(to), bool)
            new[1:] = (to[1:] != to[:-1]) | (pair[1:] != pair[:-1])
            first = np.flatnonzero(new)
            yield ALONG, [to[first]], [pair[first], np.diff(first, append=len(to))]
    yield STATE, [ids], [own, *back, *np.stack(walks, 1).reshape(len(ids), -1).T]


def _corners(size, got, counts):
    """Paths of three edges whose ends are one vertex are those of triangles on it."""
    if STATE not in got:
        return
    (v,), (own, *values) = got[STATE]
    ids, order = np.sort(v), np.argsort(v)
    own, values = own[order], [x[order] for x in values]
    found = np.zeros((len(ids), size, size), np.int64)
    if ALONG in got:
        (to,), (pair, n) = got[ALONG]
        at = blocks.Places(ids).of(to).astype(np.int64)
        found = np.bincount(at * size * size + pair, weights=n, minlength=len(ids) * size * size).astype(np.int64).reshape(-1, size, size)
    for x, y in combinations_with_replacement(range(size), 2):
        _tally(counts, CORNER, own, found[:, x, y] > 0, x, y)
    ordered = found + found.transpose(0, 2, 1)
    for x, y in product(range(size), repeat=2):
        _tally(counts, INNER, own, values[x * size + y] > ordered[:, x, y], x, y, x)
        ends = values[size * size + x * size + y] > ordered[:, x, y]
        for z in range(size):
            _tally(counts, END, own, ends & (own == z), x, y, z)
    return
    yield


def _spot(shape: Pattern, i: int, labels: tuple) -> int:
    """The code of what vertex i is in a labelled pattern."""
    near = shape.neighbours(i)
    others = [x for x in range(shape.n) if x != i]
    name = lambda xs: sorted(labels[x] for x in xs)
    if shape.n == 2:
        return _code(EDGE, labels[i], *name(near))
    if len(near) == len(others):
        kind = CENTRE if shape.n == 4 else CORNER if len(shape.edges) == 3 else MIDDLE
        return _code(kind, labels[i], *name(near))
    if len(near) == 1:
        (b,) = near
        rest = [x for x in shape.neighbours(b) if x != i]
        if shape.n == 3:
            return _code(TIP, labels[i], labels[b], *name(rest))
        if len(rest) == 2:
            return _code(LEAF, labels[i], labels[b], *name(rest))
        (c,) = rest
        (d,) = (x for x in shape.neighbours(c) if x != b)
        return _code(END, labels[i], labels[b], labels[c], labels[d])
    a, c = sorted(near, key=shape.degree)
    (d,) = (x for x in shape.neighbours(c) if x != i)
    return _code(INNER, labels[i], labels[a], labels[c], labels[d])


def images(edges: DataFrame, vertices: DataFrame, size: int) -> dict[int, int] | None:
    """How many vertices of a label are what in which pattern, by code; labels are from 0 to less than size. None if a vertex has two labels."""
    half = graph.half(edges)  # without nulls, as they are compared
    parts = max(1, -(-2 * half.count() // PART_ENTRIES))
    both = lambda c: (ALONG, [np.concatenate(c), np.concatenate(c[::-1])], [])
    own = lambda c: (STATE, [c[0]], [c[1]])
    rows = _dealt(half, parts, both).union(_dealt(vertices.where("id IS NOT NULL").select(F.col("id").cast("long"), "vlabel"), parts, own))
    rows = _round(rows, parts, _label)
    for work in (_near, _paths, _close, _corners):
        rows = _round(rows, parts, lambda got, counts, work=work: work(size, got, counts))

    def last(batches):
        for batch in batches:
            for data in batch.column(1).to_pylist():
                kind, found, _ = pickle.loads(data)
                yield pa.RecordBatch.from_pydict({"code": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    counted = {r["code"]: r["n"] for r in rows.mapInArrow(last, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    return None if _code(CLASH, 0) in counted else counted


def supports(counted: dict[int, int], labels: list[int], max_edges: int):
    """(shape, labelling, support) of patterns that have maps; of the labellings that symmetry makes the same, the least."""
    for k in range(1, max_edges + 1):
        for shape in shapes_of_edges(k):
            symmetries = shape.automorphisms()
            for labelling in product(labels, repeat=shape.n):
                if all(labelling <= tuple(labelling[i] for i in p) for p in symmetries):
                    n = min(counted.get(_spot(shape, i, labelling), 0) for i in range(shape.n))
                    if n:
                        yield shape, labelling, n

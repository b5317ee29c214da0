"""Compiling a pattern to a DataFrame plan.

The vertices are bound in the pattern's matching order. A vertex's candidates are the
intersection of the neighbour arrays of those it is adjacent to, under the bounds of
symmetry, and, for induced matches, without the neighbours of the others. Arrays are
joined when a later vertex needs them and dropped after. A count never opens the last
vertex's candidates: it sums their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import adjacency
from weftgraph.plans.pattern import Pattern


def match(edges: DataFrame, pattern: Pattern, induced: bool = False, symmetric: bool = True, counting: bool = False) -> DataFrame:
    """Matches v0 .. v(n-1) of a connected pattern in edges; with counting, one row, cnt.

    symmetric=True gives each subgraph once, False each injective map. Labels of the
    pattern are not looked at (see query).
    """
    if not pattern.connected():
        raise ValueError("a connected pattern is needed")
    order = pattern.matching_order()
    bounds = pattern.symmetry_bounds(order) if symmetric else []
    place = {v: i for i, v in enumerate(order)}
    adj = adjacency(edges)
    # the last step at which the neighbours of a vertex are asked for
    until = {v: max([i for i, w in enumerate(order) if i > place[v] and (induced or pattern.has(v, w))], default=-1) for v in order}
    rows = adj.select(F.col("id").alias(f"v{order[0]}"), F.col("nbrs").alias(f"n{order[0]}"))
    for i, v in enumerate(order[1:], 1):
        before = order[:i]
        last = i == pattern.n - 1
        cand = None
        for w in before:
            if pattern.has(v, w):
                cand = F.col(f"n{w}") if cand is None else F.array_intersect(cand, F.col(f"n{w}"))
        if induced:
            for w in before:
                if not pattern.has(v, w):
                    cand = F.array_except(cand, F.col(f"n{w}"))

        def fits(x):
            test = F.lit(True)
            for w in before:  # called at once, by F.filter below
                if (w, v) in bounds:
                    test = test & (x > F.col(f"v{w}"))
                elif (v, w) in bounds:
                    test = test & (x < F.col(f"v{w}"))
                elif not pattern.has(v, w):
                    test = test & (x != F.col(f"v{w}"))
            return test

        cand = F.filter(cand, fits)
        bound = [f"v{w}" for w in before]
        if last and counting:
            return rows.agg(F.coalesce(F.sum(F.size(cand).cast("long")), F.lit(0).cast("long")).alias("cnt"))
        arrays = [f"n{w}" for w in before if until[w] > i]
        rows = rows.select(*bound, *arrays, F.explode(cand).alias(f"v{v}"))
        if until[v] > i:
            rows = rows.join(adj.select(F.col("id").alias(f"v{v}"), F.col("nbrs").alias(f"n{v}")), f"v{v}")
    if pattern.n == 1 and counting:
        return rows.agg(F.count("*").alias("cnt"))
    return rows.select(*[f"v{j}" for j in range(pattern.n)])


def listing(edges: DataFrame, pattern: Pattern, induced: bool = False) -> DataFrame:
    """Each subgraph once."""
    return match(edges, pattern, induced)


def counting(edges: DataFrame, pattern: Pattern, induced: bool = False) -> DataFrame:
    """One row, cnt: the number of subgraphs."""
    return match(edges, pattern, induced, counting=True)

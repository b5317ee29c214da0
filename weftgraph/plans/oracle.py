"""DuckDB SQL for patterns: all injective maps by joins, over the number of symmetries.

Shares nothing with the planner but the pattern.
"""

from __future__ import annotations

from weftgraph.plans.pattern import Pattern
from weftgraph.sources.graphs import with_graph_sql


def maps_sql(pattern: Pattern, bounds=(), labelled: bool = False, induced: bool = False) -> str:
    """FROM and WHERE of all injective maps into n; vertex i is x{i}."""
    order = pattern.matching_order()
    source: dict[int, str] = {}
    joins, tests, k = [], [], 0
    for i, v in enumerate(order):
        back = [w for w in order[:i] if pattern.has(v, w)]
        if i == 0:
            w = next(w for w in order[1:] if pattern.has(v, w))
            joins.append(f"n t{k}")
            source[v] = f"t{k}.u"
            source[w] = f"t{k}.v"
            k += 1
            continue
        if v not in source:
            joins.append(f"JOIN n t{k} ON t{k}.u = {source[back[0]]}")
            source[v] = f"t{k}.v"
            k += 1
            back = back[1:]
        else:
            back = [w for w in back if w != order[0]]
        for w in back:
            joins.append(f"JOIN n t{k} ON t{k}.u = {source[w]} AND t{k}.v = {source[v]}")
            k += 1
        tests += [f"{source[w]} <> {source[v]}" for w in order[:i] if not pattern.has(v, w)]
        if induced:
            tests += [f"NOT EXISTS (SELECT 1 FROM n z WHERE z.u = {source[w]} AND z.v = {source[v]})" for w in order[:i] if not pattern.has(v, w)]
    tests += [f"{source[a]} < {source[b]}" for a, b in bounds]
    if labelled:
        for v in range(pattern.n):
            joins.append(f"JOIN vl l{v} ON l{v}.id = {source[v]} AND l{v}.l = {pattern.labels[v]}")
    names = ", ".join(f"{source[v]} AS v{v}" for v in range(pattern.n))
    return f"SELECT {names} FROM {' '.join(joins)}" + (f" WHERE {' AND '.join(tests)}" if tests else "")


def count_sql(pattern: Pattern, graph: str = "trail", labelled: bool = False, column: str = "cnt") -> str:
    """One row: the number of subgraphs, or of maps with labels."""
    over = 1 if labelled else len(pattern.automorphisms())
    return with_graph_sql(f"SELECT (count(*) // {over})::BIGINT AS {column} FROM ({maps_sql(pattern, labelled=labelled)})", graph)


def list_sql(pattern: Pattern, graph: str = "trail", labelled: bool = False) -> str:
    """The subgraphs by the bounds of symmetry, or all maps with labels."""
    bounds = () if labelled else pattern.symmetry_bounds(pattern.matching_order())
    return with_graph_sql(maps_sql(pattern, bounds, labelled), graph)


def cliques_sql(k: int, graph: str = "trail", listed: bool = False) -> str:
    """k-cliques, counted or listed with ascending vertices, level by level on edges from low to high degree."""
    steps = ["c2 AS (SELECT u AS x0, v AS x1 FROM dag)"]
    for n in range(3, k + 1):
        old = ", ".join(f"c.x{i}" for i in range(n - 1))
        tests = " ".join(f"SEMI JOIN dag d{i} ON d{i}.u = x{i} AND d{i}.v = x{n - 1}" for i in range(n - 2))
        steps.append(f"c{n} AS MATERIALIZED (SELECT * FROM (SELECT {old}, dag.v AS x{n - 1} FROM c{n - 1} c JOIN dag ON dag.u = c.x{n - 2}) {tests})")
    found = f"SELECT count(*)::BIGINT AS cnt FROM c{k}"
    if listed:
        found = f"SELECT {', '.join(f's[{i + 1}] AS v{i}' for i in range(k))} FROM (SELECT list_sort([{', '.join(f'x{i}' for i in range(k))}]) AS s FROM c{k})"
    return with_graph_sql(f", {', '.join(steps)} {found}", graph)


def support_sql(shape: Pattern, least: int) -> str:
    """Frequent labellings (pattern, n_edges, support) of a shape over n and vl, from all its maps; the least of those that symmetry makes the same."""
    k = shape.n
    labels = ", ".join(f"l{i}.l AS c{i}" for i in range(k))
    maps = f"SELECT m.*, {labels} FROM ({maps_sql(shape)}) m " + " ".join(f"JOIN vl l{i} ON l{i}.id = m.v{i}" for i in range(k))
    own = "[" + ", ".join(f"c{i}" for i in range(k)) + "]"
    images = ["[" + ", ".join(f"c{p[i]}" for i in range(k)) + "]" for p in shape.automorphisms()]
    text = " || ' ' || ".join(f"c{i}" for i in range(k)) + f" || ' | {' '.join(f'{a}-{b}' for a, b in sorted(shape.edges))}'"
    counts = ", ".join(f"count(DISTINCT v{i})" for i in range(k))
    return f"SELECT {text} AS pattern, {len(shape.edges)}::INTEGER AS n_edges, least({counts})::BIGINT AS support FROM ({maps}) WHERE {' AND '.join(f'{own} <= {x}' for x in images)} GROUP BY {', '.join(f'c{i}' for i in range(k))} HAVING support >= {least}"

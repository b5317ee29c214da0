"""Labelled subgraph queries: all injective maps that keep labels and edges.

Candidates of each query vertex are those with its label, enough neighbours, and at least
as many neighbours of each label; they are narrowed by semi-joins along a spanning tree,
up and down. Each query edge then has a table of the edges between its ends' candidates,
and the tables are joined in an order of few candidates.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.operators.graph import degrees, neighbour_labels
from weftgraph.plans.pattern import Pattern


def _local(edges: DataFrame, vertices: DataFrame, pattern: Pattern) -> DataFrame:
    """(qv, v): label, degree and neighbour labels fit."""
    spark = edges.sparkSession
    wanted = [(q, pattern.labels[q], pattern.degree(q), len({pattern.labels[w] for w in pattern.neighbours(q)})) for q in range(pattern.n)]
    needs = [(q, label, n) for q in range(pattern.n) for label, n in Counter(pattern.labels[w] for w in pattern.neighbours(q)).items()]
    q = F.broadcast(spark.createDataFrame(wanted, "qv int, vlabel int, least int, kinds int"))  # a row for each query vertex
    need = F.broadcast(spark.createDataFrame(needs, "qv int, nl int, need int"))
    fit = vertices.join(q, "vlabel").join(degrees(edges), "id").where("degree >= least").select("qv", F.col("id").alias("v"), "kinds")
    around = neighbour_labels(edges, vertices).select(F.col("id").alias("v"), F.col("vlabel").alias("nl"), "n")
    enough = fit.join(around, "v").join(need, ["qv", "nl"]).where("n >= need").groupBy("qv", "v", "kinds").agg(F.count("*").alias("met"))
    return enough.where("met = kinds").select("qv", "v")


def candidates(edges: DataFrame, vertices: DataFrame, pattern: Pattern, refine: bool = True) -> DataFrame:
    """(qv, v): candidates of each query vertex; with refine, narrowed along a spanning tree."""
    if not pattern.labels:
        raise ValueError("a pattern with labels is needed")
    local = storage.materialize(_local(edges, vertices, pattern), "candidates")
    if not refine:
        return local
    cand = {q: local.where(F.col("qv") == q).select("v") for q in range(pattern.n)}
    order, parent = [0], {}
    for v in order:
        for w in pattern.neighbours(v):
            if w not in order:
                parent[w] = v
                order.append(w)

    def beside(q: int, other: int) -> DataFrame:
        near = edges.join(cand[other].withColumnRenamed("v", "dst"), "dst", "left_semi").select(F.col("src").alias("v")).distinct()
        return storage.materialize(cand[q].join(near, "v", "left_semi"), "candidates")

    for w in reversed(order[1:]):
        cand[parent[w]] = beside(parent[w], w)
    for w in order[1:]:
        cand[w] = beside(w, parent[w])
    out = None
    for q, df in cand.items():
        rows = df.select(F.lit(q).alias("qv"), "v")
        out = rows if out is None else out.union(rows)
    return out


def matched_candidates(edges: DataFrame, vertices: DataFrame, pattern: Pattern, rounds: int = 2) -> DataFrame:
    """(qv, v): local candidates whose neighbours can be dealt out to the query vertex's neighbours, each to a different one.

    By Hall's theorem that is so if any set of those neighbours has at least as many
    candidates around v; neighbours of v are counted by the set of query vertices they may be.
    """
    cand = storage.materialize(_local(edges, vertices, pattern), "candidates")
    for _ in range(rounds):
        may = cand.groupBy(F.col("v").alias("dst")).agg(F.expr("bit_or(shiftleft(1, qv))").alias("mask"))
        around = storage.materialize(edges.join(may, "dst").groupBy(F.col("src").alias("v"), "mask").agg(F.count("*").alias("n")), "around")
        kept = None
        for q in range(pattern.n):
            near = pattern.neighbours(q)
            sets = [[w for i, w in enumerate(near) if pick >> i & 1] for pick in range(1, 1 << len(near))]
            enough = [F.sum(F.when(F.col("mask").bitwiseAND(sum(1 << w for w in some)) != 0, F.col("n")).otherwise(0)) >= len(some) for some in sets]
            test = enough[0]
            for t in enough[1:]:
                test = test & t
            fit = around.groupBy("v").agg(test.alias("fit")).where("fit").select("v")
            rows = cand.where(F.col("qv") == q).join(fit, "v", "left_semi").select("qv", "v")
            kept = rows if kept is None else kept.union(rows)
        cand = storage.materialize(kept, "candidates")
    return cand


def coloured_matches(edges: DataFrame, vertices: DataFrame, pattern: Pattern) -> DataFrame:
    """v0 .. v(n-1) of every map of a pattern whose labels all differ, by joins of labelled edges alone, without candidates."""
    if not pattern.labels or len(set(pattern.labels)) != pattern.n:
        raise ValueError("labels that all differ are needed")
    at_src = edges.join(vertices.select(F.col("id").alias("src"), F.col("vlabel").alias("ls")), "src")
    both = storage.materialize(at_src.join(vertices.select(F.col("id").alias("dst"), F.col("vlabel").alias("ld")), "dst").where(F.col("ls").isin(list(pattern.labels)) & F.col("ld").isin(list(pattern.labels))), "coloured")
    between = lambda a, b: both.where((F.col("ls") == pattern.labels[a]) & (F.col("ld") == pattern.labels[b])).select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"))
    order = pattern.matching_order()
    rows = None
    for i, q in enumerate(order[1:], 1):
        back = [w for w in order[:i] if pattern.has(q, w)]
        rows = between(back[0], q) if rows is None else rows.join(between(back[0], q), f"v{back[0]}")
        for w in back[1:]:
            rows = rows.join(between(w, q), [f"v{w}", f"v{q}"], "left_semi")
    return rows.select(*[f"v{j}" for j in range(pattern.n)])


def labelled_matches(edges: DataFrame, vertices: DataFrame, pattern: Pattern, limit: int | None = None) -> DataFrame:
    """v0 .. v(n-1) of every map; at most limit of them, if given."""
    cand = storage.materialize(candidates(edges, vertices, pattern), "candidates")
    sizes = {r["qv"]: r["n"] for r in cand.groupBy("qv").agg(F.count("*").alias("n")).collect()}  # a row for each query vertex
    order = pattern.matching_order({q: sizes.get(q, 0) for q in range(pattern.n)})

    def between(a: int, b: int) -> DataFrame:
        left = cand.where(F.col("qv") == a).select(F.col("v").alias("src"))
        right = cand.where(F.col("qv") == b).select(F.col("v").alias("dst"))
        rows = edges.join(left, "src", "left_semi").join(right, "dst", "left_semi")
        return rows.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"))

    rows = cand.where(F.col("qv") == order[0]).select(F.col("v").alias(f"v{order[0]}"))
    for i, q in enumerate(order[1:], 1):
        back = [w for w in order[:i] if pattern.has(q, w)]
        rows = rows.join(between(back[0], q), f"v{back[0]}")
        for w in order[:i]:
            if pattern.labels[w] == pattern.labels[q]:
                rows = rows.where(F.col(f"v{w}") != F.col(f"v{q}"))
        for w in back[1:]:
            rows = rows.join(between(w, q), [f"v{w}", f"v{q}"], "left_semi")
    out = rows.select(*[f"v{j}" for j in range(pattern.n)])
    return out.limit(limit) if limit is not None else out


def labelled_count(edges: DataFrame, vertices: DataFrame, pattern: Pattern) -> DataFrame:
    """One row, cnt."""
    return labelled_matches(edges, vertices, pattern).agg(F.count("*").alias("cnt"))


def candidate_stats(edges: DataFrame, vertices: DataFrame, pattern: Pattern) -> DataFrame:
    """(qv, local, refined, used): candidates before and after refinement, and those that some match uses."""
    one = candidates(edges, vertices, pattern, refine=False).groupBy("qv").agg(F.count("*").alias("local"))
    two = candidates(edges, vertices, pattern).groupBy("qv").agg(F.count("*").alias("refined"))
    m = labelled_matches(edges, vertices, pattern)
    used = m.select(F.explode(F.array(*[F.struct(F.lit(q).alias("qv"), F.col(f"v{q}").alias("v")) for q in range(pattern.n)])).alias("x")).select("x.qv", "x.v").distinct()
    used = used.groupBy("qv").agg(F.count("*").alias("used"))
    every = edges.sparkSession.createDataFrame([(q,) for q in range(pattern.n)], "qv int")
    out = every.join(one, "qv", "left").join(two, "qv", "left").join(used, "qv", "left")
    return out.select("qv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("local", "refined", "used")])

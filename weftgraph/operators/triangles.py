"""Triangles and cliques on the degree orientation, with neighbour arrays.

A level joins the arrays of the vertices found last and intersects; the last level is a
sum of sizes, so cliques are never listed to be counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.operators import blocks
from weftgraph.operators.graph import adjacency, orient


#: Oriented edges up to which all neighbour arrays are broadcast (8 bytes an edge); beyond it they are dealt out by their vertex.
BROADCAST_EDGES = 4_000_000


def _levels(edges: DataFrame, k: int) -> DataFrame:
    """(v0 .. v(k-2), cand): partial cliques with the array of vertices that complete them."""
    packed = _packed(edges)
    if packed:
        return _levels_by_blocks(packed, k)
    dag = storage.materialize(orient(edges), "dag")
    first = adj = adjacency(dag)
    if dag.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:  # all arrays together, so their size is bounded
        arrays = storage.materialize(adj, "adjacency")
        adj = F.broadcast(arrays)
        first = arrays.repartition(4 * edges.sparkSession.sparkContext.defaultParallelism)  # a small table would be read by few tasks
    out = first.select(F.col("id").alias("v0"), F.col("nbrs").alias("cand")).where(F.size("cand") >= k - 1)
    return _opened(out, adj, 1, k)


def _opened(out: DataFrame, adj: DataFrame, at: int, k: int) -> DataFrame:
    """Partial cliques from those of at vertices, a vertex more at a time."""
    for i in range(at, k - 1):
        nexts = adj.select(F.col("id").alias(f"v{i}"), "nbrs")
        opened = out.select(*[f"v{j}" for j in range(i)], "cand", F.explode("cand").alias(f"v{i}"))
        met = opened.join(nexts, f"v{i}").withColumn("cand", F.array_intersect("cand", "nbrs"))
        out = met.where(F.size("cand") >= k - 1 - i).select(*[f"v{j}" for j in range(i + 1)], "cand")
    return out


def _packed(edges: DataFrame) -> blocks.Packed | None:
    """The lists, packed, of a dense graph whose arrays are too many to be broadcast."""
    packed = blocks.Packed(edges)
    large = packed.entries // 2 > BROADCAST_EDGES and packed.vertices <= blocks.HELD_VERTICES
    return packed if large and packed.mean >= blocks.DENSE else None


def _levels_by_blocks(packed: blocks.Packed, k: int) -> DataFrame:
    """_levels with the arrays of edges met by blocks; only those that have enough in common are rows, and only vertices in these send their arrays."""
    out = packed.common(k - 2)
    if k == 3:
        return out
    needed = storage.materialize(out.select(F.explode("cand").alias("id")).distinct(), "needed")
    adj = storage.materialize(packed.adjacency().join(storage.maybe_broadcast(needed), "id", "left_semi"), "adjacency")
    return _opened(out, adj, 2, k)


def clique_count(edges: DataFrame, k: int) -> DataFrame:
    """One row, cnt: the number of k-cliques (k >= 3)."""
    if k == 3 and (packed := _packed(edges)):
        return edges.sparkSession.createDataFrame([(packed.triangles(),)], "cnt long")
    return _levels(edges, k).agg(F.coalesce(F.sum(F.size("cand").cast("long")), F.lit(0).cast("long")).alias("cnt"))


def clique_list(edges: DataFrame, k: int) -> DataFrame:
    """Every k-clique once, its vertices ascending in v0 .. v(k-1)."""
    rows = _levels(edges, k).select(*[f"v{j}" for j in range(k - 1)], F.explode("cand").alias(f"v{k - 1}"))
    ids = rows.select(F.array_sort(F.array(*[f"v{j}" for j in range(k)])).alias("s"))
    return ids.select(*[F.col("s")[j].alias(f"v{j}") for j in range(k)])


def triangle_count(edges: DataFrame) -> DataFrame:
    """One row, cnt."""
    return clique_count(edges, 3)


def triangle_list(edges: DataFrame) -> DataFrame:
    """Every triangle once, v0 < v1 < v2."""
    return clique_list(edges, 3)


def triangle_count_by_joins(edges: DataFrame) -> DataFrame:
    """triangle_count as three joins of oriented edges; the other physical form."""
    dag = orient(edges)
    a, b, c = (dag.select(F.col("src").alias(x), F.col("dst").alias(y)) for x, y in (("x", "y"), ("y", "z"), ("x", "z")))
    return a.join(b, "y").join(c, ["x", "z"]).agg(F.count("*").alias("cnt"))

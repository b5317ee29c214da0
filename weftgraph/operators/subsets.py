"""Connected vertex sets, each once, grown vertex by vertex.

A set is grown from its least vertex. A row keeps the candidates that may still be added
and the vertices seen so far; a new vertex brings in only neighbours that weren't seen,
so no set is made twice and nothing has to be deduplicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import adjacency


def connected_sets(edges: DataFrame, k: int, with_bits: bool = False, keep=None) -> DataFrame:
    """Connected sets of k >= 2 vertices: s (array, in the order of growth), and bits with with_bits.

    bits has a bit for each pair (i, j), i < j, of positions that are adjacent, at
    j * (j - 1) / 2 + i. keep(s) may drop sets of any size below k early (a column
    function that is never true again once false).
    """
    adj = adjacency(edges)
    v = F.col("id")
    rows = adj.select(F.array("id").alias("s"), F.filter("nbrs", lambda x: x > v).alias("ext"), F.concat(F.array("id"), F.col("nbrs")).alias("seen"), F.lit(0).alias("bits"))
    for i in range(1, k):
        last = i == k - 1
        opened = rows.select("s", "ext", "seen", "bits", F.posexplode("ext").alias("p", "w"))
        if last and not with_bits:
            rows = opened.select(F.concat("s", F.array("w")).alias("s"))
            return rows.where(keep(F.col("s"))) if keep else rows
        met = opened.join(adj.select(F.col("id").alias("w"), "nbrs"), "w")
        bits = F.col("bits")
        for j in range(i):
            bits = bits + F.when(F.array_contains("nbrs", F.col("s")[j]), 1 << (i * (i - 1) // 2 + j)).otherwise(0)
        grown = F.concat("s", F.array("w"))
        if last:
            rows = met.select(grown.alias("s"), bits.alias("bits"))
        else:
            fresh = F.filter(F.array_except("nbrs", "seen"), lambda x: x > F.col("s")[0])
            rest = F.slice("ext", F.col("p") + 2, F.size("ext"))
            rows = met.select(grown.alias("s"), F.concat(rest, fresh).alias("ext"), F.array_union("seen", "nbrs").alias("seen"), bits.alias("bits"))
        if keep:
            rows = rows.where(keep(F.col("s")))
    return rows


def extend_vertices(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Every connected set (s, any order) with each neighbour that isn't in it; sorted, each once."""
    opened = sets.select("s", F.explode("s").alias("src")).join(edges, "src").where(~F.array_contains("s", F.col("dst")))
    return opened.select(F.array_sort(F.concat("s", F.array("dst"))).alias("s")).distinct()


def extend_edges(embeddings: DataFrame, edges: DataFrame) -> DataFrame:
    """Every connected edge set (e: array of struct u < v) with each edge that touches it; sorted, each once."""
    ends = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["u"], x["v"]))))
    new = F.struct(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    opened = embeddings.select("e", F.explode(ends).alias("src")).join(edges, "src").withColumn("new", new)
    return opened.where(~F.array_contains("e", F.col("new"))).select(F.array_sort(F.concat("e", F.array("new"))).alias("e")).distinct()

"""Keyword search: small connected sets that hold each keyword's label once and nothing that could go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.subsets import connected_sets


#: Keywords and none, in the number of a vertex.
KINDS = 16


def keyword_search(edges: DataFrame, vertices: DataFrame, keywords: list[int], k: int) -> DataFrame:
    """v0 < .. < v(k-1): connected sets with every keyword label exactly once, from which no other vertex can be removed without the rest falling apart."""
    if len(set(keywords)) != len(keywords) or len(keywords) > min(k, KINDS - 1):
        raise ValueError("distinct keywords, at most k of them, are needed")
    # a vertex is its id and its keyword (0 for none) in one number, so that sets are pruned as they grow
    kind = F.lit(0)
    for i, w in enumerate(keywords, 1):
        kind = F.when(F.col("vlabel") == w, i).otherwise(kind)
    coded = vertices.select("id", (F.col("id") * KINDS + kind).alias("code"))
    at_src = edges.join(coded.select(F.col("id").alias("src"), F.col("code").alias("s_")), "src", "left")
    both = at_src.join(coded.select(F.col("id").alias("dst"), F.col("code").alias("d_")), "dst", "left")
    both = both.select(F.coalesce("s_", F.col("src") * KINDS).alias("src"), F.coalesce("d_", F.col("dst") * KINDS).alias("dst"))
    if len(keywords) == k:
        both = both.where((F.col("src") % KINDS > 0) & (F.col("dst") % KINDS > 0))

    def held(s):
        return F.filter(F.transform(s, lambda x: x % KINDS), lambda x: x > 0)

    def keep(s):
        """No keyword twice, and room for those that are missing."""
        return (F.size(held(s)) == F.size(F.array_distinct(held(s)))) & (len(keywords) - F.size(held(s)) <= k - F.size(s))

    sets = connected_sets(both, k, with_bits=True, keep=keep)
    others = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0), lambda acc, i: acc + F.when(F.col("s")[i] % KINDS == 0, F.element_at(F.array(*[F.lit(1 << j) for j in range(k)]), i + 1)).otherwise(0))
    fit = sets.select(F.array_sort(F.transform("s", lambda x: F.floor(x / KINDS).cast("long"))).alias("key"), "bits", others.alias("others"))
    # a set whose rest stays connected without one of its other vertices isn't least
    removable = [(bits, 1 << gone) for bits in range(1 << (k * (k - 1) // 2)) for gone in range(k) if _connected(bits, [i for i in range(k) if i != gone])]
    table = {}
    for bits, gone in removable:
        table[bits] = table.get(bits, 0) | gone
    free = edges.sparkSession.createDataFrame(list(table.items()), "bits int, free int")  # at most 2^(k choose 2) rows, for k up to 5
    least = fit.join(F.broadcast(free), "bits", "left").where(F.coalesce(F.col("free"), F.lit(0)).bitwiseAND(F.col("others")) == 0)
    return least.select(*[F.col("key")[i].alias(f"v{i}") for i in range(k)])


def _connected(bits: int, among: list[int]) -> bool:
    if not among:
        return False
    seen, todo = {among[0]}, [among[0]]
    while todo:
        a = todo.pop()
        for b in among:
            i, j = min(a, b), max(a, b)
            if b not in seen and i != j and bits >> (j * (j - 1) // 2 + i) & 1:
                seen.add(b)
                todo.append(b)
    return len(seen) == len(among)

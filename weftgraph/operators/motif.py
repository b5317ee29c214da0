"""Vertex-induced censuses of all connected shapes of 3, 4 or 5 vertices; shapes without a match are listed with 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.counting import Counter
from weftgraph.operators.subsets import connected_sets
from weftgraph.plans.pattern import MOTIFS, NAMED, Pattern

_SCHEMA = "k int, pattern string, cnt long"


def _rows(spark: SparkSession, k: int, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(k, name, counts.get(name, 0)) for name in MOTIFS[k]], _SCHEMA)


def motif3(edges: DataFrame) -> DataFrame:
    """The census of 3 vertices, from counts of edges and triangles."""
    c = Counter(edges)
    return _rows(edges.sparkSession, 3, {"wedge": c.wedges - 3 * c.triangles, "triangle": c.triangles})


def motif4(edges: DataFrame) -> DataFrame:
    """The census of 4 vertices: edge-induced counts, less those inside denser shapes."""
    c = Counter(edges)
    full = c.clique4
    diamond = c.diamond - 6 * full
    ring = c.rectangle - diamond - 3 * full
    tailed = c.tailedtriangle - 4 * diamond - 12 * full
    path = c.path4 - 2 * tailed - 4 * ring - 6 * diamond - 12 * full
    star = c.star3 - tailed - 2 * diamond - 4 * full
    return _rows(edges.sparkSession, 4, {"3star": star, "4path": path, "tailedtriangle": tailed, "rectangle": ring, "diamond": diamond, "4clique": full})


def shape_names(k: int) -> list[tuple[int, str]]:
    """(bits, name) of every connected graph on k numbered vertices; see connected_sets."""
    by_form = {NAMED[n].canonical(): n for n in MOTIFS[k]}
    out = []
    pairs = [(i, j) for j in range(1, k) for i in range(j)]
    for bits in range(1 << len(pairs)):
        p = Pattern.of([e for b, e in enumerate(pairs) if bits >> b & 1], n=k)
        if len(p.edges) >= k - 1 and p.connected():
            out.append((bits, by_form[p.canonical()]))
    return out


def motif_census(edges: DataFrame, k: int) -> DataFrame:
    """The census of k vertices (3, 4 or 5) by enumeration of connected sets."""
    spark = edges.sparkSession
    names = spark.createDataFrame(shape_names(k), "bits int, pattern string")  # at most 728 rows
    counted = connected_sets(edges, k, with_bits=True).groupBy("bits").agg(F.count("*").alias("n"))
    found = counted.join(F.broadcast(names), "bits").groupBy("pattern").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([(k, n) for n in MOTIFS[k]], "k int, pattern string")
    return every.join(found, "pattern", "left").select("k", "pattern", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))

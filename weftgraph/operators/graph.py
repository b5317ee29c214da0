"""Preparing graphs: degrees, orientation, labels, cores, subgraphs and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import storage


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of vertices with an edge."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges (undirected), max_degree (long)."""
    return degrees(edges).agg(F.count("*").alias("vertices"), F.coalesce(F.expr("sum(degree) div 2"), F.lit(0).cast("long")).alias("edges"), F.coalesce(F.max("degree"), F.lit(0).cast("long")).alias("max_degree"))


def reverse(edges: DataFrame) -> DataFrame:
    """The transpose."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def half(edges: DataFrame, ascending: bool = True) -> DataFrame:
    """Each undirected edge once, (u, v) with u < v, or u > v."""
    keep = "src < dst" if ascending else "src > dst"
    return edges.where(keep).select(F.col("src").alias("u"), F.col("dst").alias("v"))


def orient(edges: DataFrame) -> DataFrame:
    """The acyclic orientation (src, dst) from lower to higher degree, ties from lower to higher id."""
    d = degrees(edges)
    at_src = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src")
    both = at_src.join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    return both.where("dd > ds OR (dd = ds AND dst > src)").select("src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, nbrs): sorted neighbour arrays of edges without repeats."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def labelled_adjacency(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, nbrs): sorted arrays of struct(id, vlabel) of neighbours."""
    labelled = edges.join(vertices.select(F.col("id").alias("dst"), "vlabel"), "dst")
    return labelled.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("id"), "vlabel"))).alias("nbrs"))


def has_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (u, v) that are edges."""
    return pairs.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_semi")


def is_connected(edges: DataFrame) -> bool:
    """Whether all vertices with an edge are connected; a graph without edges is."""
    from weftgraph.operators.components import connected_components

    return connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select("component").distinct().limit(2).count() <= 1


def label_frequency(vertices: DataFrame) -> DataFrame:
    """(vlabel, freq)."""
    return vertices.groupBy("vlabel").agg(F.count("*").alias("freq"))


def frequent_labels(vertices: DataFrame, least: int) -> DataFrame:
    """The labels of at least so many vertices."""
    return label_frequency(vertices).where(F.col("freq") >= least)


def frequent_vertices(vertices: DataFrame, least: int) -> DataFrame:
    """The vertices whose label is frequent."""
    return vertices.join(frequent_labels(vertices, least), "vlabel", "left_semi").select("id", "vlabel")


def by_label(vertices: DataFrame) -> DataFrame:
    """(vlabel, ids): the reverse label index."""
    return vertices.groupBy("vlabel").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def neighbour_labels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, vlabel, n): how many neighbours of each label a vertex has."""
    labelled = edges.join(vertices.select(F.col("id").alias("dst"), "vlabel"), "dst")
    return labelled.groupBy(F.col("src").alias("id"), "vlabel").agg(F.count("*").alias("n"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges between given vertices (id)."""
    one = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return one.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, core): a vertex's value becomes the h-index of its neighbours' values until nothing changes.

    The lists are packed and values held where vertices are not too many; else neighbours'
    values are joined, counted by value first, so a hub's rows are as many as its values.
    """
    from weftgraph.operators import blocks

    packed = blocks.Packed(edges)
    if packed.vertices <= blocks.HELD_VERTICES:
        return packed.cores()
    now = storage.materialize(degrees(edges).withColumnRenamed("degree", "core"), "cores")
    while True:  # values only fall, so this ends
        seen = edges.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "core").agg(F.count("*").alias("n"))
        above = Window.partitionBy("id").orderBy(F.desc("core"))
        fits = seen.withColumn("at_least", F.sum("n").over(above)).groupBy("id").agg(F.max(F.least("core", "at_least")).alias("core"))
        new = storage.materialize(fits, "cores")
        if new.join(now.withColumnRenamed("core", "was"), "id").where("core <> was").isEmpty():
            return new
        now = new


def two_core_size(edges: DataFrame) -> DataFrame:
    """One row: the number of vertices (n) whose core number is over 1."""
    return core_numbers(edges).where("core > 1").agg(F.count("*").alias("n"))


def halo_partition(edges: DataFrame, parts: int, size: int) -> DataFrame:
    """(part, src, dst): id ranges of a size with the vertices one step away, and all edges among them."""
    owner = F.least(F.floor(F.col("id") / size), F.lit(parts - 1)).cast("int")
    own = degrees(edges).select("id", owner.alias("part"))
    near = own.join(edges, own["id"] == edges["src"]).select(F.col("dst").alias("id"), "part").union(own).distinct()
    inside = edges.join(near.select(F.col("id").alias("src"), "part"), "src")
    return inside.join(near.select(F.col("id").alias("dst"), F.col("part").alias("p2")), "dst").where("part = p2").select("part", "src", "dst")


def range_segments(edges: DataFrame, size: int) -> DataFrame:
    """edges with segment: the range of ids that dst lies in."""
    return edges.withColumn("segment", F.floor(F.col("dst") / size).cast("int"))


def grid_blocks(edges: DataFrame, size: int) -> DataFrame:
    """edges with (row, col): the ranges of ids of src and dst."""
    return edges.select(F.floor(F.col("src") / size).cast("int").alias("row"), F.floor(F.col("dst") / size).cast("int").alias("col"), "src", "dst")


def write_grid(edges: DataFrame, size: int, path: str) -> None:
    """Writes the blocks as parquet in the order of (row, col): a file has a range of blocks, and a large block some files.

    So there are as many files as the edges need, however many blocks they lie in.
    """
    blocks = grid_blocks(edges, size).repartitionByRange("row", "col", "src", "dst").sortWithinPartitions("row", "col", "src", "dst")
    blocks.write.option("parquet.block.size", 8 << 20).parquet(path)


def fetch_blocks(spark: SparkSession, path: str, rows: list[int], cols: list[int] | None = None) -> DataFrame:
    """edges of the blocks in given rows (and columns); row groups of other blocks are skipped by their bounds."""
    found = spark.read.schema("row int, col int, src long, dst long").parquet(path).where(F.col("row").isin(rows))
    return (found if cols is None else found.where(F.col("col").isin(cols))).select("src", "dst")


def edge_label_frequency(edges: DataFrame) -> DataFrame:
    """(elabel, freq) of undirected edges (src, dst, elabel)."""
    return edges.where("src < dst").groupBy("elabel").agg(F.count("*").alias("freq"))


def row_offsets(edges: DataFrame) -> DataFrame:
    """(id, offset, degree): where a vertex's neighbours start in an edge list by ascending src; an exclusive prefix sum.

    Sums of id ranges come first, so that no task reads all vertices in order.
    """
    d = degrees(edges).withColumn("block", F.floor(F.col("id") / 4096).cast("long"))
    blocks = d.groupBy("block").agg(F.sum("degree").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    within = d.withColumn("within", F.coalesce(F.sum("degree").over(inside), F.lit(0)))
    return within.join(bases, "block").select("id", (F.col("base") + F.col("within")).alias("offset"), "degree")

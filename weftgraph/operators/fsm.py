"""Frequent subgraph mining with minimum-image support.

Patterns are labelled and have at most k edges (five vertices at most). Level by level,
all maps of each unlabelled shape are grown from the maps of a smaller one and grouped by
their labels; a pattern's support is the least number of distinct images of its vertices,
over all its maps, so images by symmetry count. Only maps whose smaller pattern is
frequent are grown further (support never rises with an edge). Patterns of one and two edges
alone are counted without maps, from the labels that a vertex's neighbours have, as bits. Patterns
of up to three edges are so by counts of walks (images.py) where labels are from 0 to 7, as ranks of few
names are; else their maps are grown.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.operators import images
from weftgraph.operators.graph import frequent_vertices
from weftgraph.plans.pattern import Pattern, path, shapes_of_edges


#: Labels that are bits of a long.
BITS = 62


def _bit(x):
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))


def _labels(n: int):
    return [F.col(f"l{i}") for i in range(n)]


def support(maps: DataFrame, shape: Pattern) -> DataFrame:
    """(l0 .. l(n-1), support) for each labelling of the shape that its symmetries make least.

    Images are made distinct by vertex and position before they are counted.
    """
    n = shape.n
    labels = [f"l{i}" for i in range(n)]
    # of the labellings that symmetry makes the same, the least
    images = [F.struct(*[F.col(f"l{p[i]}").alias(f"k{i}") for i in range(n)]) for p in shape.automorphisms()]
    least = F.least(*images) if len(images) > 1 else images[0]
    own = F.struct(*[F.col(f"l{i}").alias(f"k{i}") for i in range(n)])
    # the last label is a bit, so that a vertex has a row for those of many labellings
    last, word = F.col(labels[-1]), F.floor(F.col(labels[-1]) / BITS).cast("int").alias("word")
    mask = _bit(F.pmod(last, F.lit(BITS))).alias("mask")
    spots = maps.where(own == least).select(*labels[:-1], word, mask, F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"v{i}").alias("v")) for i in range(n)])).alias("x"))
    key = [*labels[:-1], "word", "at"]
    masks = spots.select(*labels[:-1], "word", "mask", "x.at", "x.v").groupBy(*key, "v").agg(F.bit_or("mask").alias("mask")).groupBy(*key, "mask").agg(F.count("*").alias("n"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("mask").bitwiseAND(_bit(i)) != 0)
    counted = masks.withColumn("bit", F.explode(bits)).withColumn(labels[-1], F.col("word") * BITS + F.col("bit")).groupBy(*labels, "at").agg(F.sum("n").alias("n"))
    return counted.groupBy(*labels).agg(F.min("n").alias("support"))


def _grow(maps: DataFrame, smaller: Pattern, larger: Pattern, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Maps of a shape with one edge more, from those of the smaller one."""
    for p in permutations(range(larger.n), smaller.n):
        moved = {(min(p[a], p[b]), max(p[a], p[b])) for a, b in smaller.edges}
        if moved <= larger.edges:
            (a, b), = larger.edges - moved
            break
    else:
        raise ValueError("the shapes differ by more than an edge")
    rows = maps.select(*[F.col(f"{c}{i}").alias(f"{c}{p[i]}") for i in range(smaller.n) for c in "vl"])
    if larger.n == smaller.n:
        return rows.join(edges.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}")), [f"v{a}", f"v{b}"], "left_semi")
    (new,) = set(range(larger.n)) - set(p)
    old = a if b == new else b
    steps = edges.join(vertices.select(F.col("id").alias("dst"), F.col("vlabel").alias(f"l{new}")), "dst")
    grown = rows.join(steps.select(F.col("src").alias(f"v{old}"), F.col("dst").alias(f"v{new}"), f"l{new}"), f"v{old}")
    for i in p:
        if i != old:
            grown = grown.where(F.col(f"v{i}") != F.col(f"v{new}"))
    return grown


def _all_labellings(frequent: DataFrame, shape: Pattern) -> DataFrame:
    """Frequent labellings with those that symmetry makes the same."""
    n = shape.n
    images = F.array_distinct(F.array(*[F.struct(*[F.col(f"l{p[i]}").alias(f"l{i}") for i in range(n)]) for p in shape.automorphisms()]))
    return frequent.select(F.explode(images).alias("x")).select("x.*")


def _both(masks: DataFrame, name: str, codes: DataFrame) -> DataFrame:
    """Rows of masks once for each label (code b) whose bit is set in a mask."""
    return masks.join(F.broadcast(codes), (F.col(name).bitwiseAND(_bit(F.col("b")))) != 0)


def small_supports(edges: DataFrame, vertices: DataFrame, labels: list[int]) -> tuple[DataFrame, DataFrame]:
    """(a, b, support), a <= b, of edges, and (a, c, b, support), a <= b, of paths of two edges with middle c.

    labels: all labels of vertices, BITS at most. one and two are the labels of at least one and two neighbours.
    """
    spark = edges.sparkSession
    codes = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "b int, label int")
    coded = vertices.join(F.broadcast(codes), F.col("vlabel") == F.col("label")).select("id", F.col("b").alias("l"))
    sent = edges.join(coded.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.struct("l", F.col("src").alias("v")).alias("x"))
    near = sent.groupBy("id").agg(F.collect_list("x").alias("nbrs")).join(coded, "id").select("l", "nbrs")

    def seen(acc, x):
        bit = _bit(x["l"])
        return F.struct(acc["one"].bitwiseOR(bit).alias("one"), acc["two"].bitwiseOR(acc["one"].bitwiseAND(bit)).alias("two"))

    none = F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"))
    near = storage.materialize(near.select(F.col("l").alias("c"), F.aggregate("nbrs", none, seen).alias("s"), "nbrs").select("c", "s.one", "s.two", "nbrs"), "near")
    storage.release(spark)
    kinds = storage.materialize(near.groupBy("c", "one", "two").agg(F.count("*").alias("n")), "kinds")
    # vertices of label a that have a neighbour of label b
    images = _both(kinds, "one", codes).groupBy(F.col("c").alias("a"), "b").agg(F.sum("n").alias("n"))
    ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edge = images.groupBy(ends.alias("p")).agg(F.min("n").alias("support")).select("p.a", "p.b", "support")
    # middles by the labels of two ends
    first = _both(kinds, "one", codes).withColumnRenamed("b", "a").drop("label")
    pair = _both(first, "one", codes).where("a < b OR (a = b AND (two & shiftleft(1L, a)) <> 0)")
    middle = pair.groupBy("a", "c", "b").agg(F.sum("n").alias("n"))
    # ends of label a by the labels of the middle and of another neighbour of it
    x, bit = F.col("x"), _bit(F.col("a"))
    others = near.select("c", "one", "two", F.explode("nbrs").alias("x")).select(x["v"].alias("v"), x["l"].alias("a"), "c", "one", "two")
    others = others.select("v", "a", "c", F.col("one").bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.col("two").bitwiseAND(bit)).alias("mask"))
    tips = others.groupBy("v", "a", "c").agg(F.bit_or("mask").alias("mask")).groupBy("a", "c", "mask").agg(F.count("*").alias("n"))
    end = _both(tips, "mask", codes).groupBy("a", "c", "b").agg(F.sum("n").alias("n"))
    end = end.select(F.least("a", "b").alias("a"), "c", F.greatest("a", "b").alias("b"), "n")
    wedge = middle.union(end).groupBy("a", "c", "b").agg(F.min("n").alias("support"))
    name = lambda c: F.element_at(F.array(*map(F.lit, labels)), F.col(c) + 1)
    return edge.select(name("a").alias("a"), name("b").alias("b"), "support"), wedge.select(name("a").alias("a"), name("c").alias("c"), name("b").alias("b"), "support")


def _mine_small(edges: DataFrame, kept: DataFrame, minsup: int, max_edges: int, labels: list[int]) -> DataFrame:
    """mine for one and two edges."""
    out = None
    for k, found in list(enumerate(small_supports(edges, kept, labels), 1))[:max_edges]:
        (shape,) = shapes_of_edges(k)
        if k == 1:
            spots = {0: "a", 1: "b"}
        else:
            middle = next(i for i in range(3) if shape.degree(i) == 2)
            low, high = (i for i in range(3) if i != middle)
            spots = {low: "a", middle: "c", high: "b"}
        found = storage.materialize(found.where(F.col("support") >= minsup), "supports")
        rows = _shown(found.select(*[F.col(spots[i]).alias(f"l{i}") for i in range(shape.n)], "support"), shape)
        out = rows if out is None else out.union(rows)
    return out


def _mine_counted(edges: DataFrame, kept: DataFrame, minsup: int, max_edges: int, labels: list[int]) -> DataFrame | None:
    """mine for up to three edges; None if a vertex has two labels."""
    counted = images.images(edges, kept, max(labels) + 1)
    storage.release(edges.sparkSession)
    if counted is None:
        return None
    found = [(f"{' '.join(map(str, of))} | {' '.join(f'{a}-{b}' for a, b in sorted(shape.edges))}", len(shape.edges), n) for shape, of, n in images.supports(counted, labels, max_edges) if n >= minsup]
    return edges.sparkSession.createDataFrame(found, "pattern string, n_edges int, support long")


def _shown(found: DataFrame, shape: Pattern) -> DataFrame:
    """(pattern, n_edges, support) of labellings (l0 .. l(n-1), support) of a shape."""
    shown = F.concat(F.array_join(F.array(*[x.cast("string") for x in _labels(shape.n)]), " "), F.lit(" | " + " ".join(f"{a}-{b}" for a, b in sorted(shape.edges))))
    return found.select(shown.alias("pattern"), F.lit(len(shape.edges)).alias("n_edges"), "support")


def mine(edges: DataFrame, vertices: DataFrame, minsup: int, max_edges: int = 3) -> DataFrame:
    """(pattern, n_edges, support) of every frequent pattern of up to max_edges edges.

    pattern reads 'labels | edges', such as '1 2 2 | 0-1 0-2', and is the least of those of
    isomorphic patterns.
    """
    spark = edges.sparkSession
    if max_edges < 1 or max_edges > 4:
        raise ValueError("1 to 4 edges (five vertices at most)")
    kept = storage.materialize(frequent_vertices(vertices, minsup), "frequent")
    labels = [r[0] for r in kept.select("vlabel").distinct().limit(BITS + 1).collect()] if max_edges < 4 else []
    if max_edges < 3 and 0 < len(labels) <= BITS:
        return _mine_small(edges, kept, minsup, max_edges, sorted(labels))
    # null order keys make loops, which maps (and SQL) take as edges
    if labels and all(isinstance(x, int) and 0 <= x < images.LABELS for x in labels) and edges.where("src = dst").isEmpty():
        found = _mine_counted(edges, kept, minsup, max_edges, sorted(labels))
        if found is not None:
            return found
    inner = edges.join(kept.select(F.col("id").alias("src"), F.col("vlabel").alias("l0")), "src").join(kept.select(F.col("id").alias("dst"), F.col("vlabel").alias("l1")), "dst")
    level = {path(2): inner.select(F.col("src").alias("v0"), F.col("dst").alias("v1"), "l0", "l1")}
    out = spark.createDataFrame([], "pattern string, n_edges int, support long")
    step = inner.select("src", "dst")
    for k in range(1, max_edges + 1):
        frequent = {}
        for shape, maps in level.items():
            if k < max_edges:
                maps = storage.materialize(maps, "maps")  # for the support, the filter and every larger shape
            found = storage.materialize(support(maps, shape).where(F.col("support") >= minsup), "supports")
            storage.release(spark)
            out = out.union(_shown(found, shape))
            if k == max_edges:  # maps of the last level are counted as they are made
                continue
            frequent[shape] = maps.join(F.broadcast(_all_labellings(found, shape)) if found.limit(10_001).count() <= 10_000 else _all_labellings(found, shape), [f"l{i}" for i in range(shape.n)], "left_semi")
        if k == max_edges:
            break
        if k == 1:
            step = frequent[path(2)].select(F.col("v0").alias("src"), F.col("v1").alias("dst"))
            step = storage.materialize(step, "frequent-edges")
        grown = {}
        for larger in shapes_of_edges(k + 1):
            smaller = next((s for s in level if any({(min(p[a], p[b]), max(p[a], p[b])) for a, b in s.edges} <= larger.edges for p in permutations(range(larger.n), s.n))), None)
            if smaller is not None:
                grown[larger] = _grow(frequent[smaller], smaller, larger, step, kept)
        level = grown
    return out


def frequent_edges(edges: DataFrame, vertices: DataFrame, minsup: int) -> DataFrame:
    """(l0, l1, support), l0 <= l1, of frequent single edges."""
    rows = edges.join(vertices.select(F.col("id").alias("src"), F.col("vlabel").alias("l0")), "src").join(vertices.select(F.col("id").alias("dst"), F.col("vlabel").alias("l1")), "dst")
    return support(rows.select(F.col("src").alias("v0"), F.col("dst").alias("v1"), "l0", "l1"), path(2)).where(F.col("support") >= minsup)


def frequent_wedges(edges: DataFrame, vertices: DataFrame, minsup: int) -> DataFrame:
    """(centre, a, b, support), a <= b, of frequent paths of two edges by the labels of their middle and ends."""
    lab = vertices.select("id", "vlabel")
    one = edges.join(lab.select(F.col("id").alias("src"), F.col("vlabel").alias("l1")), "src").join(lab.select(F.col("id").alias("dst"), F.col("vlabel").alias("l0")), "dst")
    a = one.select(F.col("src").alias("v1"), "l1", F.col("dst").alias("v0"), "l0")
    b = one.select(F.col("src").alias("v1"), F.col("dst").alias("v2"), F.col("l0").alias("l2"))
    found = support(a.join(b, "v1").where("v0 <> v2"), path(3)).where(F.col("support") >= minsup)
    return found.select(F.col("l1").alias("centre"), F.least("l0", "l2").alias("a"), F.greatest("l0", "l2").alias("b"), "support")

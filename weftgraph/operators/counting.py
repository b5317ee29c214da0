"""Edge-induced counts of small shapes in closed form.

Everything comes from four intermediates: degrees, t (triangles on an edge), the list of
triangles with the t of their edges, and codegrees (paths of two edges by their ends).
Rectangles are counted from paths of two edges below their highest vertex by degree, so that
hubs' pairs aren't listed. No shape of over three vertices is listed, but for 4-cliques
and, for 6path, paths of four vertices, where they must be corrected for. Sums are long.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.operators import blocks, graph, triangles


def below_highest(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """(x, y, w): paths of two edges from x to y whose other two vertices rank below x, by (degree, id).

    Each rectangle is two of the paths of one pair, that of its highest vertex and the one
    across. A path's middle ranks below an end, so a hub's pairs are made for still larger hubs alone.
    """
    rank = F.struct(F.col("d"), F.col("id"))
    ranked = edges.join(degree.select(F.col("id").alias("src"), rank.alias("rs")), "src").join(degree.select(F.col("id").alias("dst"), rank.alias("rd")), "dst")
    down = ranked.where("rd < rs").select(F.col("src").alias("x"), F.col("rs").alias("rx"), F.col("dst").alias("m"))
    on = ranked.select(F.col("src").alias("m"), F.col("dst").alias("y"), F.col("rd").alias("ry"))
    return down.join(on, "m").where("ry < rx").groupBy("x", "y").agg(F.count("*").alias("w"))


class Counter:
    """Closed-form counts on edges; intermediates are made when first needed, and once."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    def _sum(self, df: DataFrame, x: str) -> int:
        return int(df.agg(F.sum(F.expr(x).cast("long"))).first()[0] or 0)

    @cached_property
    def degree(self) -> DataFrame:
        return storage.materialize(graph.degrees(self.edges).select("id", F.col("degree").alias("d")), "degree")

    @cached_property
    def packed(self) -> blocks.Packed | None:
        """The lists, packed, of a dense graph."""
        packed = blocks.Packed(self.edges)
        return packed if packed.mean >= blocks.DENSE else None

    @cached_property
    def listed(self) -> DataFrame:
        """Triangles x < y < z."""
        rows = triangles.triangle_list(self.edges)
        return storage.materialize(rows.select(F.col("v0").alias("x"), F.col("v1").alias("y"), F.col("v2").alias("z")), "triangles")

    @cached_property
    def on_edge(self) -> DataFrame:
        """(u, v, t), u < v, of edges in a triangle."""
        sides = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ("xy", "xz", "yz")]))
        return storage.materialize(self.listed.select(sides.alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("t")), "on-edge")

    @cached_property
    def at_vertex(self) -> DataFrame:
        """(id, d, t): triangles at each vertex, 0 included."""
        t = self.listed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
        return storage.materialize(self.degree.join(t, "id", "left").select("id", "d", F.coalesce("t", F.lit(0)).alias("t")), "at-vertex")

    @cached_property
    def edge_rows(self) -> DataFrame:
        """(u, v, t, du, dv, tu, tv), u < v, of every edge."""
        rows = graph.half(self.edges).join(self.on_edge, ["u", "v"], "left")
        for c in "uv":
            rows = rows.join(self.at_vertex.select(F.col("id").alias(c), F.col("d").alias(f"d{c}"), F.col("t").alias(f"t{c}")), c)
        return storage.materialize(rows.withColumn("t", F.coalesce("t", F.lit(0))), "edge-rows")

    @cached_property
    def sides(self) -> DataFrame:
        """Triangles with the t of their edges (txy, txz, tyz) and degrees (dx, dy, dz)."""
        rows = self.listed
        for a, b in ("xy", "xz", "yz"):
            rows = rows.join(self.on_edge.select(F.col("u").alias(a), F.col("v").alias(b), F.col("t").alias(f"t{a}{b}")), [a, b])
        for a in "xyz":
            rows = rows.join(self.degree.select(F.col("id").alias(a), F.col("d").alias(f"d{a}")), a)
        return storage.materialize(rows, "sides")

    @cached_property
    def codegree(self) -> DataFrame:
        """(x, y, w), x < y: paths of two edges between x and y."""
        a = self.edges.select(F.col("src").alias("m"), F.col("dst").alias("x"))
        b = self.edges.select(F.col("src").alias("m"), F.col("dst").alias("y"))
        return storage.materialize(a.join(b, "m").where("x < y").groupBy("x", "y").agg(F.count("*").alias("w")), "codegree")

    @cached_property
    def triangles(self) -> int:
        return self.listed.count()

    @cached_property
    def clique4(self) -> int:
        return int(triangles.clique_count(self.edges, 4).first()[0])

    @cached_property
    def wedges(self) -> int:
        return self._sum(self.degree, "d * (d - 1) div 2")

    @cached_property
    def star3(self) -> int:
        return self._sum(self.degree, "cast(d as decimal(20,0)) * (d - 1) * (d - 2) / 6")

    @cached_property
    def path4(self) -> int:
        return self._sum(self.edge_rows, "(du - 1) * (dv - 1)") - 3 * self.triangles

    @cached_property
    def rectangle(self) -> int:
        if self.packed and self.packed.vertices <= blocks.HELD_VERTICES:
            return self.packed.rectangles()
        return self._sum(below_highest(self.edges, self.degree), "w * (w - 1) div 2")

    @cached_property
    def tailedtriangle(self) -> int:
        return self._sum(self.at_vertex, "t * (d - 2)")

    @cached_property
    def diamond(self) -> int:
        if "on_edge" not in self.__dict__ and self.packed:
            return self.packed.diamonds()
        return self._sum(self.on_edge, "t * (t - 1) div 2")

    @cached_property
    def path5(self) -> int:
        """By the middle vertex: pairs of two-edge arms, less the ends that meet."""
        arms = self.edges.join(self.degree.select(F.col("id").alias("dst"), (F.col("d") - 1).alias("r")), "dst")
        sums = arms.groupBy("src").agg(F.sum("r").alias("a"), F.sum(F.col("r") * F.col("r")).alias("b"))
        return self._sum(sums, "(a * a - b) div 2") - 2 * self._sum(self.at_vertex, "t * d") + 9 * self.triangles - 4 * self.rectangle

    @cached_property
    def pentagon(self) -> int:
        """From closed walks of five edges, less those that go round a triangle."""
        n = self.codegree
        full = n.select("x", "y", "w").union(n.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")).union(self.degree.select(F.col("id").alias("x"), F.col("id").alias("y"), F.col("d").alias("w")))
        step = full.join(self.edges.select(F.col("src").alias("y"), F.col("dst").alias("z")), "y").groupBy("x", "z").agg(F.sum("w").alias("w3"))
        walks = step.join(full.select("x", F.col("y").alias("z"), "w"), ["x", "z"])
        return (self._sum(walks, "w3 * w") - 30 * self.triangles - 10 * self._sum(self.at_vertex, "(d - 2) * t")) // 10

    @cached_property
    def house(self) -> int:
        """Triangles on an edge times 4-cycles on it, less those that share a further vertex."""
        u_side = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("y"))
        t = self.on_edge.select("u", "v", "t").union(self.on_edge.select(F.col("v").alias("u"), F.col("u").alias("v"), "t"))
        n = self.codegree
        full = n.select(F.col("x").alias("y"), F.col("y").alias("v"), "w").union(n.select("y", F.col("x").alias("v"), "w"))
        # of each edge with triangles once, as u < v
        rows = t.where("u < v").join(u_side, "u").where("y <> v").join(full, ["y", "v"])
        return self._sum(rows, "t * (w - 1)") - 2 * self._sum(self.on_edge, "t * t") + 6 * self.triangles

    @cached_property
    def _fans(self) -> int:
        return self._sum(self.sides, "(txy-1)*(txz-1) + (txy-1)*(tyz-1) + (txz-1)*(tyz-1)")

    @cached_property
    def semihouse(self) -> int:
        return self._fans - 12 * self.clique4

    @cached_property
    def closedhouse(self) -> int:
        """Each edge of a 4-clique with a further triangle on it."""
        four = triangles.clique_list(self.edges, 4)
        pair = [F.struct(F.col(f"v{i}").alias("u"), F.col(f"v{j}").alias("v")) for i in range(4) for j in range(i + 1, 4)]
        inside = four.select(F.explode(F.array(*pair)).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("k"))
        return self._sum(inside.join(self.on_edge, ["u", "v"]), "k * (t - 2)")

    @cached_property
    def hourglass(self) -> int:
        return self._sum(self.at_vertex, "t * (t - 1) div 2") - 2 * self.diamond

    @cached_property
    def taileddiamond(self) -> int:
        return self._sum(self.sides, "(dx-2)*(tyz-1) + (dy-2)*(txz-1) + (dz-2)*(txy-1)") - 12 * self.clique4

    @cached_property
    def taileddiamond2(self) -> int:
        return self._sum(self.edge_rows, "(t * (t - 1) div 2) * (du + dv - 6)")

    @cached_property
    def dumbbell(self) -> int:
        return self._sum(self.edge_rows, "(tu - t) * (tv - t)") - self._fans + 6 * self.clique4

    @cached_property
    def path6(self) -> int:
        """By the middle edge: pairs of two-edge arms, less the arms that meet."""
        e = self.edges.join(self.degree.select(F.col("id").alias("dst"), (F.col("d") - 1).alias("r")), "dst")
        reach = e.groupBy(F.col("src").alias("id")).agg(F.sum("r").alias("a"))
        rows = self.edge_rows.join(reach.select(F.col("id").alias("u"), F.col("a").alias("au")), "u").join(reach.select(F.col("id").alias("v"), F.col("a").alias("av")), "v")
        # arms from u: over its neighbours but v, to anything but u and v
        product = self._sum(rows, "(au - (dv - 1) - t) * (av - (du - 1) - t)")
        same_middle = self._sum(self.sides, "(dx-2)*(dx-2) + (dy-2)*(dy-2) + (dz-2)*(dz-2)")
        both_same = self._sum(self.sides, "dx + dy + dz - 6")
        cycles = 4 * self.rectangle
        # a 4-cycle u v b a on an edge: arm a, a' with a' = b, or b, b' with b' = a; chords are what a or b can't go on by
        d4 = self._cycle_degrees
        one_end = 2 * (d4 - cycles - self._cycle_chords)
        # ends that meet: a and b adjacent to u and v, with a common neighbour beyond
        meet = self._meeting_ends + both_same
        return product - same_middle - one_end - meet + both_same + cycles

    @cached_property
    def _spread(self) -> DataFrame:
        """Paths a u v b of three edges with a <> b, u < v (a, u, v, b, w): w is the codegree of a and b."""
        left = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("a"))
        right = self.edges.select(F.col("src").alias("v"), F.col("dst").alias("b"))
        middle = graph.half(self.edges).join(left, "u").where("a <> v").join(right, "v").where("b <> u AND a <> b")
        n = self.codegree.select(F.col("x").alias("p"), F.col("y").alias("q"), "w")
        return middle.withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")}).join(n, ["p", "q"], "left").select("a", "u", "v", "b", F.coalesce("w", F.lit(0)).alias("w"))

    @cached_property
    def _meeting_ends(self) -> int:
        """Over paths a u v b: common neighbours of a and b other than u and v."""
        e = self.edges
        to_u = e.select(F.col("src").alias("b"), F.col("dst").alias("u"), F.lit(1).alias("bu"))
        to_v = e.select(F.col("src").alias("a"), F.col("dst").alias("v"), F.lit(1).alias("av"))
        rows = self._spread.join(to_u, ["b", "u"], "left").join(to_v, ["a", "v"], "left")
        return self._sum(rows, "w - coalesce(bu, 0) - coalesce(av, 0)")

    @cached_property
    def _cycle_degrees(self) -> int:
        """Over edges and 4-cycles on them: the degree of one fixed vertex across; each vertex of a cycle is it twice in four."""
        n = self.codegree
        return self._sum(n.join(self.degree.select(F.col("id").alias("x"), F.col("d").alias("dx")), "x").join(self.degree.select(F.col("id").alias("y"), F.col("d").alias("dy")), "y"), "(w * (w - 1) div 2) * (dx + dy)")

    @cached_property
    def _cycle_chords(self) -> int:
        """Over edges and 4-cycles on them: whether one fixed vertex across is adjacent to the opposite one."""
        return 2 * self._sum(self.codegree.join(self.on_edge.select(F.col("u").alias("x"), F.col("v").alias("y"), "t"), ["x", "y"]), "w * (w - 1) div 2")


#: Shape -> the property of Counter that counts it.
SHAPES = {
    "3star": "star3", "4path": "path4", "rectangle": "rectangle", "tailedtriangle": "tailedtriangle", "diamond": "diamond", "5path": "path5", "pentagon": "pentagon", "house": "house",
    "semihouse": "semihouse", "closedhouse": "closedhouse", "hourglass": "hourglass", "taileddiamond": "taileddiamond", "taileddiamond2": "taileddiamond2", "6path": "path6", "dumbbell": "dumbbell",
}


def count(edges: DataFrame, shape: str) -> int:
    """How many subgraphs of edges have the shape."""
    return getattr(Counter(edges), SHAPES[shape])

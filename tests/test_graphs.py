import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from weftgraph.functions import sets
from weftgraph.operators import counting, fsm, graph, images, keyword, matcher, motif, query, subsets, triangles
from weftgraph.operators.components import connected_components
from weftgraph.plans import catalog
from weftgraph.plans.pattern import MOTIFS, NAMED, Pattern, clique, cycle, path, shapes_of_edges, star
from weftgraph.sources import csr, graphs


def random_half(n, p, seed):
    rng = random.Random(seed)
    return [(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < p]


def edges_of(spark, half):
    return graphs.symmetric(spark.createDataFrame(half or [], "u long, v long")).cache()


HALF = random_half(9, 0.5, 3)
LABELS = {v: v % 3 + 1 for v in range(9)}


@pytest.fixture(scope="module")
def edges(spark):
    return edges_of(spark, HALF)


@pytest.fixture(scope="module")
def vertices(spark):
    return spark.createDataFrame(list(LABELS.items()), "id long, vlabel int").cache()


def value(df):
    return df.first()[0]


@pytest.mark.parametrize("shape", list(counting.SHAPES))
def test_closed_forms(edges, shape):
    assert counting.count(edges, shape) == brute.count(HALF, NAMED[shape])


@pytest.mark.parametrize("shape", ["rectangle", "house", "closedhouse", "dumbbell", "6path", "K2,3", "4wheel"])
def test_matcher(edges, shape):
    assert value(matcher.counting(edges, NAMED[shape])) == brute.count(HALF, NAMED[shape])
    found = {tuple(r) for r in matcher.listing(edges, NAMED[shape]).collect()}
    assert len(found) == brute.count(HALF, NAMED[shape])
    assert found <= set(brute.maps(HALF, NAMED[shape]))


@pytest.mark.parametrize("shape", ["rectangle", "diamond", "pentagon", "3star"])
def test_induced(edges, shape):
    assert value(matcher.counting(edges, NAMED[shape], induced=True)) == brute.count(HALF, NAMED[shape], induced=True)


def test_all_maps(edges):
    got = {tuple(r) for r in matcher.match(edges, NAMED["diamond"], symmetric=False).collect()}
    assert got == set(brute.maps(HALF, NAMED["diamond"]))


@pytest.mark.parametrize("k", [3, 4, 5])
def test_motifs(edges, k):
    want = {n: brute.count(HALF, NAMED[n], induced=True) for n in MOTIFS[k]}
    assert {r["pattern"]: r["cnt"] for r in motif.motif_census(edges, k).collect()} == want
    if k < 5:
        assert {r["pattern"]: r["cnt"] for r in (motif.motif3 if k == 3 else motif.motif4)(edges).collect()} == want


@pytest.mark.parametrize("k", [3, 4, 5, 6])
def test_cliques(edges, k):
    assert value(triangles.clique_count(edges, k)) == brute.count(HALF, clique(k))
    rows = [tuple(r) for r in triangles.clique_list(edges, k).collect()]
    assert len(rows) == len(set(rows)) == brute.count(HALF, clique(k)) and all(list(r) == sorted(r) for r in rows)


def test_hand_sized(spark):
    for half, tri, rect, dia in [(list(clique(5).edges), 10, 15, 30), (list(cycle(4).edges), 0, 1, 0), (list(cycle(5).edges), 0, 0, 0), (list(star(4).edges), 0, 0, 0), ([], 0, 0, 0)]:
        c = counting.Counter(edges_of(spark, half))
        assert (c.triangles, c.rectangle, c.diamond) == (tri, rect, dia)
        assert value(triangles.triangle_count_by_joins(edges_of(spark, half))) == tri


def test_relabelling(spark, edges):
    moved = edges_of(spark, [(min(3 * (8 - u) + 1, 3 * (8 - v) + 1), max(3 * (8 - u) + 1, 3 * (8 - v) + 1)) for u, v in HALF])
    for shape in ("house", "pentagon", "taileddiamond"):
        assert counting.count(moved, shape) == counting.count(edges, shape)


def test_preparation(spark, edges, vertices):
    adj = brute.neighbours(HALF)
    assert {r["id"]: r["degree"] for r in graph.degrees(edges).collect()} == {v: len(n) for v, n in adj.items()}
    s = graph.stats(edges).first()
    assert (s["vertices"], s["edges"], s["max_degree"]) == (len(adj), len(HALF), max(map(len, adj.values())))
    dag = {tuple(r) for r in graph.orient(edges).collect()}
    assert len(dag) == len(HALF) and all((len(adj[v]), v) > (len(adj[u]), u) for u, v in dag)
    assert {r["id"]: r["core"] for r in graph.core_numbers(edges).collect()} == brute.cores(HALF)
    assert value(graph.two_core_size(edges)) == sum(c > 1 for c in brute.cores(HALF).values())
    offsets = {r["id"]: r["offset"] for r in graph.row_offsets(edges).collect()}
    assert offsets == {v: sum(len(adj[w]) for w in adj if w < v) for v in adj}
    near = {(r["id"], r["vlabel"]): r["n"] for r in graph.neighbour_labels(edges, vertices).collect()}
    assert near == {(v, x): sum(LABELS[w] == x for w in adj[v]) for v in adj for x in (1, 2, 3) if any(LABELS[w] == x for w in adj[v])}
    assert graph.is_connected(edges)
    assert not graph.is_connected(edges_of(spark, [(0, 1), (2, 3)]))


def test_components(spark):
    half = [(1, 2), (2, 3), (5, 6), (9, 9), (6, 7), (3, 1), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(half, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 9: 9} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_normalise(spark):
    raw = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 4)], "src long, dst long")
    assert sorted(map(tuple, graphs.normalise(raw).collect())) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("pattern", [Pattern.of([(0, 1), (1, 2), (0, 2)], (1, 2, 3)), Pattern.of([(0, 1), (1, 2), (2, 3), (0, 3)], (1, 2, 1, 2)), Pattern.of([(0, 1), (0, 2), (0, 3)], (1, 2, 2, 3))])
def test_labelled(edges, vertices, pattern):
    want = set(brute.maps(HALF, pattern, LABELS))
    assert {tuple(r) for r in query.labelled_matches(edges, vertices, pattern).collect()} == want
    cand = {(r["qv"], r["v"]) for r in query.candidates(edges, vertices, pattern).collect()}
    assert {(q, m[q]) for m in want for q in range(pattern.n)} <= cand
    stats = {r["qv"]: r for r in query.candidate_stats(edges, vertices, pattern).collect()}
    assert all(stats[q]["used"] == len({m[q] for m in want}) <= stats[q]["refined"] <= stats[q]["local"] for q in range(pattern.n))
    assert query.labelled_matches(edges, vertices, pattern, limit=1).count() == min(1, len(want))


@pytest.mark.parametrize("minsup", [2, 3])
def test_mining(edges, vertices, minsup):
    want = {}
    for k in (1, 2, 3):
        for shape in shapes_of_edges(k):
            for labels, s in brute.mni(HALF, LABELS, shape).items():
                if s >= minsup:
                    want[" ".join(map(str, labels)) + " | " + " ".join(f"{a}-{b}" for a, b in sorted(shape.edges))] = (k, s)
    got = {r["pattern"]: (r["n_edges"], r["support"]) for r in fsm.mine(edges, vertices, minsup, 3).collect()}
    assert got == want


@pytest.mark.parametrize("k", [3, 4])
def test_keywords(spark, k):
    half = random_half(10, 0.3, 5)
    labels = {v: (v * 7) % 5 + 1 for v in range(10)}
    vertices = spark.createDataFrame(list(labels.items()), "id long, vlabel int")
    got = [tuple(r) for r in keyword.keyword_search(edges_of(spark, half), vertices, [1, 2, 3], k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.keyword_sets(half, labels, [1, 2, 3], k)


def test_subsets(edges):
    from itertools import combinations

    adj = brute.neighbours(HALF)
    want = {s for s in combinations(sorted(adj), 4) if brute.connected(s, adj)}
    got = [tuple(sorted(r["s"])) for r in subsets.connected_sets(edges, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    three = subsets.connected_sets(edges, 3).select(F.array_sort("s").alias("s"))
    assert {tuple(r["s"]) for r in subsets.extend_vertices(three, edges).collect()} == want


def test_patterns():
    assert {p: len(NAMED[p].automorphisms()) for p in ("rectangle", "house", "pentagon", "dumbbell", "closedhouse")} == {"rectangle": 8, "house": 2, "pentagon": 10, "dumbbell": 8, "closedhouse": 4}
    assert [len(MOTIFS[k]) for k in (3, 4, 5)] == [2, 6, 21]
    assert len({NAMED[n].canonical() for n in MOTIFS[5]}) == 21
    assert [len(shapes_of_edges(k)) for k in (1, 2, 3, 4)] == [1, 1, 3, 5]
    assert Pattern.parse("0 1 1 2\n1 2 2 1\n").labels == (1, 2, 1)
    p = Pattern.of([(0, 1), (1, 2)], (3, 1, 2))
    assert Pattern.parse(p.text()) == p and path(3) == NAMED["wedge"]
    with pytest.raises(ValueError):
        Pattern.parse("0 1 1 2\n0 2 2 1\n")
    with pytest.raises(ValueError):
        Pattern.of([(1, 1)])


def test_files(spark, edges, vertices, tmp_path):
    prefix = f"{tmp_path}/g/graph"
    meta = csr.write_csr(edges, prefix, 9, vertices)
    assert (meta.vertices, meta.edges, meta.vclasses) == (9, 2 * len(HALF), 3)
    assert sorted(map(tuple, csr.read_csr(spark, prefix, chunk=5).collect())) == sorted(map(tuple, edges.collect()))
    assert {r["id"]: r["vlabel"] for r in csr.read_vertex_labels(spark, prefix, chunk=4).collect()} == LABELS
    with pytest.raises(FileNotFoundError):
        csr.read_vertex_labels(spark, f"{tmp_path}/none")
    csr.write_edge_list(edges, f"{tmp_path}/text")
    assert sorted(map(tuple, csr.read_edge_list(spark, f"{tmp_path}/text").collect())) == sorted(map(tuple, edges.collect()))
    (tmp_path / "e.txt").write_text("# comment\n1\t2\n 2   3 \n% other\n\n3 3\n")
    assert sorted(map(tuple, csr.read_edge_list(spark, f"{tmp_path}/e.txt", directed=True).collect())) == [(1, 2), (2, 3)]


def test_adjacency_by_shuffle(edges, monkeypatch):
    monkeypatch.setattr(triangles, "BROADCAST_EDGES", 0)
    assert value(triangles.clique_count(edges, 4)) == brute.count(HALF, clique(4))


def test_labelled_sets(edges, vertices):
    adj = brute.neighbours(HALF)
    rows = graph.labelled_adjacency(edges, vertices).select(F.col("id").alias("u"), F.col("nbrs").alias("a")).crossJoin(graph.adjacency(edges).select(F.col("id").alias("v"), F.col("nbrs").alias("b")))
    v = F.col("v")
    got = rows.select("u", "v", sets.labelled_intersection("a", "b", 2).alias("i"), sets.labelled_intersection("a", "b", 2, v, [F.lit(4)]).alias("j"), sets.labelled_difference("a", 2, v).alias("r"), sets.labelled_difference("a", 2, v, "b", F.lit(7)).alias("d"))
    for r in got.collect():
        a, b = {x for x in adj[r["u"]] if LABELS[x] == 2}, adj[r["v"]]
        assert (r["i"], r["j"]) == (sorted(a & b), sorted(x for x in a & b if x < r["v"] and x != 4))
        assert (r["r"], r["d"]) == (sorted(a - {r["v"]}), sorted(x for x in a - b - {r["v"]} if x < 7))


def test_matched_candidates(edges, vertices):
    for pattern in (Pattern.of([(0, 1), (1, 2), (2, 3), (0, 3)], (1, 2, 1, 2)), Pattern.of([(0, 1), (0, 2), (0, 3)], (1, 2, 2, 3))):
        used = {(q, m[q]) for m in brute.maps(HALF, pattern, LABELS) for q in range(pattern.n)}
        local = {tuple(r) for r in query.candidates(edges, vertices, pattern, refine=False).collect()}
        got = {tuple(r) for r in query.matched_candidates(edges, vertices, pattern).collect()}
        assert used <= got <= local
    # two neighbours are needed and only one vertex can be both
    half, labels = [(0, 1), (0, 2), (2, 3)], [(0, 1), (1, 2), (2, 2), (3, 3)]
    chain = Pattern.of([(0, 1), (0, 2), (1, 3), (2, 4)], (1, 2, 2, 3, 3))
    assert query.matched_candidates(edges_of(edges.sparkSession, half), edges.sparkSession.createDataFrame(labels, "id long, vlabel int"), chain, 3).count() == 0


def test_coloured(edges, vertices):
    pattern = Pattern.of([(0, 1), (1, 2), (0, 2)], (1, 2, 3))
    assert {tuple(r) for r in query.coloured_matches(edges, vertices, pattern).collect()} == set(brute.maps(HALF, pattern, LABELS))
    with pytest.raises(ValueError):
        query.coloured_matches(edges, vertices, Pattern.of([(0, 1)], (1, 1)))


def test_grid(spark, edges, tmp_path):
    graph.write_grid(edges, 4, f"{tmp_path}/grid")
    every = sorted(map(tuple, edges.collect()))
    assert sorted(map(tuple, graph.fetch_blocks(spark, f"{tmp_path}/grid", [0, 1, 2]).collect())) == every
    assert sorted(map(tuple, graph.fetch_blocks(spark, f"{tmp_path}/grid", [1], [0, 2]).collect())) == [(u, v) for u, v in every if u // 4 == 1 and v // 4 in (0, 2)]


def test_edge_labels(spark, edges, tmp_path):
    prefix = f"{tmp_path}/graph"
    csr.write_csr(edges, prefix, 9)
    rows = sorted(map(tuple, edges.collect()))
    np.array([(u + v) % 3 for u, v in rows], "<u2").tofile(f"{prefix}.elabel.bin")
    got = csr.read_csr(spark, prefix, edge_labels=True, chunk=7)
    assert sorted(map(tuple, got.collect())) == [(u, v, (u + v) % 3) for u, v in rows]
    assert {r["elabel"]: r["freq"] for r in graph.edge_label_frequency(got).collect()} == {x: n for x in range(3) if (n := sum((u + v) % 3 == x for u, v in HALF))}


def test_whole_graph_queries(spark, tmp_path):
    """Queries read whole tables: a co-purchase graph of parts, and a trail of orders and customers."""
    orders = [(o, p) for o, (u, v) in enumerate(HALF) for p in (u, v)]
    spark.createDataFrame(orders, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, 50 if p % 2 else 1, f"t{LABELS[p]}") for p in range(9)], "p_partkey long, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    rng = random.Random(4)
    made = [(o, rng.randrange(4), f"1998-{rng.randint(1, 9):02d}-01", f"p{rng.randrange(3)}") for o in range(30)]
    spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, f"s{c % 3}") for c in range(4)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    trail = set()
    for o, c, day, kind in made:
        later = sorted((d, p, k) for p, q, d, k in made if q == c and (d, p) > (day, o))
        for x in [2 * c + 1] + [2 * p for _, p, _ in later[:1]] + [2 * p for _, p, k in later if k == kind][:1]:
            trail.add((min(2 * o, x), max(2 * o, x)))
    labels = {2 * o: int(k[1]) + 1 for o, _, _, k in made} | {2 * c + 1: c % 3 + 1 for c in range(4)}
    adj = brute.neighbours(trail)
    assert {(r["u"], r["v"]) for r in graphs.trail_half(spark, str(tmp_path)).collect()} == trail
    assert {r["id"]: r["vlabel"] for r in graphs.trail_labels(spark, str(tmp_path)).collect()} == labels
    assert {r["id"]: r["core"] for r in run("kcore").collect()} == brute.cores(trail)
    assert {r["id"]: r["core"] for r in run("kcore_co").collect()} == brute.cores(HALF)
    assert value(run("two_core_size")) == sum(c > 1 for c in brute.cores(trail).values())
    used = brute.maps(trail, catalog.SQUARE, labels)
    assert {r["qv"]: r["used"] for r in run("query_candidate_stats").collect()} == {q: len({m[q] for m in used}) for q in range(4)}
    assert sorted(tuple(r) for r in run("query_labeled_square").collect()) == sorted(used)
    assert len(run("connected_components").collect()) == len(adj) and run("range_segments").count() == 2 * len(trail)
    assert value(run("clique4_count")) == brute.count(HALF, clique(4)) and value(run("co_rectangle")) == brute.count(HALF, NAMED["rectangle"])
    assert value(run("sub_house")) == brute.count(trail, NAMED["house"])
    assert {r["pattern"]: r["cnt"] for r in run("motif4").collect()} == {n: brute.count(trail, NAMED[n], induced=True) for n in MOTIFS[4]}


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks and batches of a few entries."""
    from weftgraph.operators import blocks

    for name, n in (("BLOCK_ENTRIES", 8), ("PART_ENTRIES", 4), ("BLOB_ENTRIES", 5), ("PACK_EDGES", 3), ("OPENED", 7), ("MARKS", 20)):
        monkeypatch.setattr(blocks, name, n)
    return blocks


def blocky(spark, move=0):
    half = [*HALF, *[(20, v) for v in range(9)], *[(30, v) for v in range(40, 60)]]
    return half, edges_of(spark, [(min(u, v) + move, max(u, v) + move) for u, v in half])


@pytest.mark.parametrize("direct", [1 << 25, 4])
@pytest.mark.parametrize("move", [0, 5_000_000_000, -3])
def test_rectangles_by_blocks(spark, small_blocks, monkeypatch, move, direct):
    monkeypatch.setattr(small_blocks, "DIRECT_IDS", direct)
    half, moved = blocky(spark, move)
    assert small_blocks.Packed(moved).rectangles() == brute.count(half, NAMED["rectangle"])
    assert small_blocks.Packed(edges_of(spark, [])).rectangles() == 0


def test_dense_rectangles_write_no_paths(spark, monkeypatch):
    """paths of two edges of a dense graph were shuffled."""
    monkeypatch.setattr(counting, "below_highest", None)
    assert counting.count(edges_of(spark, list(clique(40).edges)), "rectangle") == 3 * 91390


@pytest.mark.parametrize("direct", [1 << 25, 4])
@pytest.mark.parametrize("move", [0, 5_000_000_000, -3])
def test_diamonds_by_blocks(spark, small_blocks, monkeypatch, move, direct):
    monkeypatch.setattr(small_blocks, "DIRECT_IDS", direct)
    half, moved = blocky(spark, move)
    assert small_blocks.Packed(moved).diamonds() == brute.count(half, NAMED["diamond"])
    assert small_blocks.Packed(edges_of(spark, [])).diamonds() == 0


def test_dense_diamonds_write_no_triangles(spark, monkeypatch):
    """triangles of a dense graph and their edges were written."""
    monkeypatch.setattr(counting.Counter, "on_edge", None)
    monkeypatch.setattr(counting.Counter, "listed", None)
    assert counting.count(edges_of(spark, list(clique(40).edges)), "diamond") == 6 * 91390


def test_grid_of_many_blocks(spark, tmp_path):
    """a file was written for each block."""
    half = [(i, 1000 - i) for i in range(400)]
    graph.write_grid(edges_of(spark, half), 2, f"{tmp_path}/grid")
    assert len(list((tmp_path / "grid").rglob("*.parquet"))) <= 8
    assert sorted(map(tuple, graph.fetch_blocks(spark, f"{tmp_path}/grid", [3], [497]).collect())) == [(6, 994)]


@pytest.mark.parametrize("k", [3, 4, 5])
@pytest.mark.parametrize("move", [0, -3])
def test_cliques_by_blocks(spark, small_blocks, monkeypatch, k, move):
    """all arrays were shuffled with every edge."""
    monkeypatch.setattr(triangles, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(triangles, "orient", None)
    monkeypatch.setattr(small_blocks, "DENSE", 0)
    half, moved = blocky(spark, move)
    assert value(triangles.clique_count(moved, k)) == brute.count(half, clique(k))
    rows = [tuple(r) for r in triangles.clique_list(moved, k).collect()]
    assert len(rows) == len(set(rows)) == brute.count(half, clique(k)) and all(list(r) == sorted(r) for r in rows)


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_cores_by_blocks(spark, small_blocks, monkeypatch, held):
    """each round joined and shuffled all edges."""
    monkeypatch.setattr(small_blocks, "HELD_VERTICES", held)
    written = []
    monkeypatch.setattr(graph.storage, "materialize", lambda df, tag, f=graph.storage.materialize: written.append(tag) or f(df, tag))
    for move in (0, 5_000_000_000, -3):
        half, moved = blocky(spark, move)
        assert {r["id"] - move: r["core"] for r in graph.core_numbers(moved).collect()} == brute.cores(half)
        assert held == 0 or "cores" not in written
    assert graph.core_numbers(edges_of(spark, [])).count() == 0


@pytest.mark.parametrize("minsup", [1, 2, 3])
def test_small_patterns_make_no_maps(edges, vertices, monkeypatch, minsup):
    """all maps of paths of two edges were written."""
    monkeypatch.setattr(fsm, "support", None)
    for k in (1, 2):
        want = {}
        for n in range(1, k + 1):
            for shape in shapes_of_edges(n):
                for labels, s in brute.mni(HALF, LABELS, shape).items():
                    if s >= minsup:
                        want[" ".join(map(str, labels)) + " | " + " ".join(f"{a}-{b}" for a, b in sorted(shape.edges))] = (n, s)
        rows = fsm.mine(edges, vertices, minsup, k).collect()
        assert len(rows) == len(want) and {r["pattern"]: (r["n_edges"], r["support"]) for r in rows} == want


def test_maps_of_the_last_level_are_not_written(spark, edges, monkeypatch):
    """all maps of patterns of three edges were written; labels beyond a mask's bits, and below 0, count too."""
    written = []
    monkeypatch.setattr(fsm.storage, "materialize", lambda df, tag, f=fsm.storage.materialize: written.append(tag) or f(df, tag))
    labels = {v: (v % 3 - 1) * 70 for v in range(9)}
    vertices = spark.createDataFrame(list(labels.items()), "id long, vlabel int")
    want = {}
    for k in (1, 2, 3):
        for shape in shapes_of_edges(k):
            for found, s in brute.mni(HALF, labels, shape).items():
                if s >= 2:
                    want[" ".join(map(str, found)) + " | " + " ".join(f"{a}-{b}" for a, b in sorted(shape.edges))] = (k, s)
    assert {r["pattern"]: (r["n_edges"], r["support"]) for r in fsm.mine(edges, vertices, 2, 3).collect()} == want
    assert written.count("maps") == 2


@pytest.mark.parametrize("move, minsup, seed", [(0, 1, 4), (5_000_000_000, 2, 5), (-3, 3, 6)])
def test_patterns_of_three_edges_make_no_maps(spark, monkeypatch, move, minsup, seed):
    """all maps of two edges were written and those of three made; the driver ran out of memory at 1 GB."""
    monkeypatch.setattr(fsm, "support", None)
    monkeypatch.setattr(images, "PART_ENTRIES", 9)
    monkeypatch.setattr(images, "DEALT", 5)
    half = [(u + move, v + move) for u, v in random_half(11, 0.4, seed)]
    labels = {v + move: (v * v) % 4 * 2 + (v == 7) for v in range(10)}  # one vertex has no label
    rows = [*labels.items(), (move, labels[move]), (None, 2), (move + 10, None)]  # one is there twice
    often = {x for x in labels.values() if sum(x == y for _, y in rows) >= minsup}
    kept = {v: x for v, x in labels.items() if x in often}
    want = {}
    for k in (1, 2, 3):
        for shape in shapes_of_edges(k):
            for found, s in brute.mni([e for e in half if set(e) <= set(kept)], kept, shape).items():
                if s >= minsup:
                    want[" ".join(map(str, found)) + " | " + " ".join(f"{a}-{b}" for a, b in sorted(shape.edges))] = (k, s)
    edges = edges_of(spark, half)
    rows = fsm.mine(edges.union(edges), spark.createDataFrame(rows, "id long, vlabel int"), minsup, 3).collect()
    assert len(rows) == len(want) and {r["pattern"]: (r["n_edges"], r["support"]) for r in rows} == want


def test_mining_where_a_vertex_has_two_labels(spark, edges):
    """such a vertex is an image by each of them, as in SQL; no edges give no patterns."""
    rows = [*LABELS.items(), (0, 2)]
    found = []
    for add in (0, 100):  # maps are grown for labels from 100
        vertices = spark.createDataFrame([(v, x + add) for v, x in rows], "id long, vlabel int")
        got = fsm.mine(edges, vertices, 2, 3).collect()
        found.append({(" ".join(str(int(x) - add) for x in r["pattern"].split(" | ")[0].split()), r["pattern"].split(" | ")[1], r["support"]) for r in got})
    assert found[0] == found[1] and found[0]
    assert fsm.mine(edges_of(spark, []), spark.createDataFrame(rows, "id long, vlabel int"), 2, 3).count() == 0


def test_mining_with_loops_is_by_maps(spark, edges, vertices, monkeypatch):
    """SQL takes a loop, which a null key makes, as an edge; walks don't."""
    monkeypatch.setattr(images, "images", None)
    loop = spark.createDataFrame([(0, 0)], "src long, dst long")
    rows = fsm.mine(edges.union(loop), vertices, 1, 3)
    assert "1 1 | 0-1" in {r["pattern"] for r in rows.where("n_edges = 1").collect()}

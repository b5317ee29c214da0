"""All queries of the library and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.functions import sets
from weftgraph.operators import counting, fsm, graph, keyword, matcher, motif, query, subsets, triangles
from weftgraph.operators.components import connected_components
from weftgraph.plans import oracle
from weftgraph.plans.pattern import MOTIFS, NAMED, Pattern, shapes_of_edges
from weftgraph.sources import graphs
from weftgraph.sources.graphs import with_graph_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Label triangle, square and path of the labelled queries, and the supports of mining.
TRIANGLE, SQUARE = Pattern.of([(0, 1), (1, 2), (0, 2)], (1, 2, 3)), Pattern.of([(0, 1), (1, 2), (2, 3), (0, 3)], (1, 2, 1, 2))
PATH, DIAMOND = Pattern.of([(0, 1), (1, 2), (2, 3)], (1, 2, 3, 4)), Pattern.of([(0, 1), (0, 2), (1, 2), (0, 3), (1, 3)], (1, 2, 3, 4))
MINSUP = 150
KEYWORDS = [1, 2, 3]


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _one(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(n,)], "cnt long")


# graphs
_add("graph_degree", lambda s, d: graph.degrees(graphs.co_purchase(s, d)), with_graph_sql("SELECT id, d::BIGINT AS degree FROM g", "co"))
_add("graph_stats", lambda s, d: graph.stats(graphs.co_purchase(s, d)), with_graph_sql("SELECT count(*)::BIGINT AS vertices, (sum(d) // 2)::BIGINT AS edges, max(d)::BIGINT AS max_degree FROM g", "co"))
_add("graph_reverse", lambda s, d, g=graphs.trail: graph.reverse(graph.orient(g(s, d))), with_graph_sql("SELECT CASE WHEN dv > du OR (dv = du AND v > u) THEN v ELSE u END AS src, CASE WHEN dv > du OR (dv = du AND v > u) THEN u ELSE v END AS dst FROM (SELECT u, v, a.d AS du, b.d AS dv FROM e JOIN g a ON a.id = u JOIN g b ON b.id = v)"))
_add("graph_half_edges", lambda s, d: graph.half(graphs.co_purchase(s, d)), with_graph_sql("SELECT u, v FROM e", "co"))
_add("graph_orient", lambda s, d: graph.orient(graphs.co_purchase(s, d)), with_graph_sql("SELECT n.u AS src, n.v AS dst FROM n JOIN g a ON a.id = n.u JOIN g b ON b.id = n.v WHERE b.d > a.d OR (b.d = a.d AND n.v > n.u)", "co"))
_add("graph_adjacency", lambda s, d, g=graphs.trail: graph.adjacency(g(s, d)).select("id", F.array_join("nbrs", ",").alias("nbrs")), with_graph_sql("SELECT u AS id, string_agg(v::VARCHAR, ',' ORDER BY v) AS nbrs FROM n GROUP BY u"))
_add("graph_row_offsets", lambda s, d: graph.row_offsets(graphs.co_purchase(s, d)), with_graph_sql("SELECT id, coalesce(sum(d) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", d::BIGINT AS degree FROM g", "co"))
_add("graph_has_edges", lambda s, d: graph.has_edges(s.range(0, 200).select(F.col("id").alias("u"), (F.col("id") * 7 % 200).alias("v")), graphs.co_purchase(s, d)), with_graph_sql("SELECT u, v FROM n WHERE u < 200 AND v = u * 7 % 200", "co"))
_add("label_frequency", lambda s, d: graph.label_frequency(graphs.trail_labels(s, d)), with_graph_sql("SELECT l AS vlabel, count(*)::BIGINT AS freq FROM vl GROUP BY l"))
_add("frequent_labels", lambda s, d: graph.frequent_labels(graphs.trail_labels(s, d), 3305), with_graph_sql("SELECT l AS vlabel, count(*)::BIGINT AS freq FROM vl GROUP BY l HAVING count(*) >= 3305"))
_add("frequent_vertices", lambda s, d: graph.frequent_vertices(graphs.trail_labels(s, d), 3305), with_graph_sql("SELECT id, l AS vlabel FROM vl WHERE l IN (SELECT l FROM vl GROUP BY l HAVING count(*) >= 3305)"))
_add("label_index", lambda s, d: graph.by_label(graphs.trail_labels(s, d)).select("vlabel", F.array_join("ids", ",").alias("ids")), with_graph_sql("SELECT l AS vlabel, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM vl GROUP BY l"))
_add("nlf", lambda s, d: graph.neighbour_labels(graphs.co_purchase(s, d), graphs.part_labels(s, d)), with_graph_sql("SELECT u AS id, l AS vlabel, count(*)::BIGINT AS n FROM n JOIN vl ON vl.id = n.v GROUP BY ALL", "co"))
_add("induced_subgraph", lambda s, d: graph.induced(graphs.co_purchase(s, d), storage.table(s, d, "part").where("p_size <= 5").select(F.col("p_partkey").cast("long").alias("id"))), with_graph_sql("SELECT u AS src, v AS dst FROM n WHERE u IN (SELECT p_partkey FROM part WHERE p_size <= 5) AND v IN (SELECT p_partkey FROM part WHERE p_size <= 5)", "co"))
# what is left when vertices of too few neighbours go, again and again; a vertex of the last round of k has a core number of k at least
_CORE_SQL = """, r AS (SELECT 1 AS k, id, true AS settled FROM g UNION ALL
SELECT CASE WHEN t.whole THEN t.k + 1 ELSE t.k END, t.id, t.whole FROM (SELECT k, id, d, min(d) OVER () >= k AS whole FROM (SELECT a.k, a.id, (SELECT count(*) FROM n JOIN r b ON b.id = n.v WHERE n.u = a.id) AS d FROM r a)) t WHERE t.d >= t.k),
core AS (SELECT id, (max(k) - 1)::BIGINT AS core FROM r WHERE settled GROUP BY id)"""
_add("kcore", lambda s, d, g=graphs.trail: graph.core_numbers(g(s, d)), with_graph_sql(f"{_CORE_SQL} SELECT id, core FROM core"))
_add("two_core_size", lambda s, d, g=graphs.trail: graph.two_core_size(g(s, d)), with_graph_sql(f"{_CORE_SQL} SELECT count(*)::BIGINT AS n FROM core WHERE core > 1"))
_add("kcore_co", lambda s, d: graph.core_numbers(graphs.co_purchase(s, d)))
_add("connected_components", lambda s, d, g=graphs.trail: connected_components(graph.half(g(s, d))), with_graph_sql(", r AS (SELECT id, id AS other FROM g UNION SELECT r.id, n.v FROM r JOIN n ON n.u = r.other) SELECT id, min(other) AS component FROM r GROUP BY id"))
_add("halo_partition", lambda s, d, g=graphs.trail: graph.halo_partition(g(s, d), 4, 5000), with_graph_sql(", o AS (SELECT id, least(id // 5000, 3)::INTEGER AS part FROM g), h AS (SELECT id, part FROM o UNION SELECT n.v, part FROM o JOIN n ON n.u = o.id) SELECT a.part, n.u AS src, n.v AS dst FROM n JOIN h a ON a.id = n.u JOIN h b ON b.id = n.v AND b.part = a.part"))
_add("range_segments", lambda s, d, g=graphs.trail: graph.range_segments(g(s, d), 256), with_graph_sql("SELECT u AS src, v AS dst, (v // 256)::INTEGER AS segment FROM n"))
_add("grid_blocks", lambda s, d, g=graphs.trail: graph.grid_blocks(g(s, d), 256), with_graph_sql("SELECT (u // 256)::INTEGER AS row, (v // 256)::INTEGER AS col, u AS src, v AS dst FROM n"))


def _set_algebra(spark: SparkSession, sf_dir: str, g=graphs.trail) -> DataFrame:
    edges = g(spark, sf_dir)
    adj = graph.adjacency(edges)
    rows = graph.half(edges).join(adj.select(F.col("id").alias("u"), F.col("nbrs").alias("a")), "u").join(adj.select(F.col("id").alias("v"), F.col("nbrs").alias("b")), "v")
    u, v = F.col("u"), F.col("v")
    return rows.select(
        "u", "v", sets.size(sets.intersection("a", "b")).alias("both"), sets.size(sets.intersection("a", "b", u)).alias("both_below"),
        sets.size(sets.difference("a", "b", v)).alias("only_a"), sets.size(sets.difference("b", "a", u, v)).alias("only_b_below"),
        sets.size(sets.bounded("a", u)).alias("a_below"), sets.size(sets.intersection("a", "b", None, [F.lit(1), F.lit(2)])).alias("both_but_two"), sets.size(sets.union("a", "b")).alias("any"),
    )


_add("set_algebra", _set_algebra, with_graph_sql("""SELECT e.u, e.v, (SELECT count(*) FROM n a JOIN n b ON a.v = b.v WHERE a.u = e.u AND b.u = e.v)::BIGINT AS both,
(SELECT count(*) FROM n a JOIN n b ON a.v = b.v WHERE a.u = e.u AND b.u = e.v AND a.v < e.u)::BIGINT AS both_below,
(SELECT count(*) FROM n a WHERE a.u = e.u AND a.v <> e.v AND a.v NOT IN (SELECT b.v FROM n b WHERE b.u = e.v))::BIGINT AS only_a,
(SELECT count(*) FROM n a WHERE a.u = e.v AND a.v <> e.u AND a.v < e.v AND a.v NOT IN (SELECT b.v FROM n b WHERE b.u = e.u))::BIGINT AS only_b_below,
(SELECT count(*) FROM n a WHERE a.u = e.u AND a.v < e.u)::BIGINT AS a_below,
(SELECT count(*) FROM n a JOIN n b ON a.v = b.v WHERE a.u = e.u AND b.u = e.v AND a.v NOT IN (1, 2))::BIGINT AS both_but_two,
(SELECT count(DISTINCT a.v) FROM n a WHERE a.u = e.u OR a.u = e.v)::BIGINT AS "any" FROM e"""))



def _labelled_sets(spark: SparkSession, sf_dir: str, g=graphs.trail) -> DataFrame:
    edges = g(spark, sf_dir)
    labelled, adj = graph.labelled_adjacency(edges, graphs.trail_labels(spark, sf_dir)), graph.adjacency(edges)
    rows = graph.half(edges).join(labelled.select(F.col("id").alias("u"), F.col("nbrs").alias("a")), "u").join(adj.select(F.col("id").alias("v"), F.col("nbrs").alias("b")), "v")
    u, v = F.col("u"), F.col("v")
    return rows.select(
        "u", "v", sets.size(sets.labelled_intersection("a", "b", 1)).alias("both"), sets.size(sets.labelled_intersection("a", "b", 1, v, [F.lit(2)])).alias("both_below"),
        sets.size(sets.labelled_difference("a", 1, v)).alias("rest"), sets.size(sets.labelled_difference("a", 1, v, "b")).alias("only"), sets.size(sets.labelled_difference("a", 1, v, "b", u)).alias("only_below"),
    )


_A = "SELECT count(*) FROM n a JOIN vl ON vl.id = a.v AND l = 1 WHERE a.u = e.u"
_B = "(SELECT b.v FROM n b WHERE b.u = e.v)"
_add("labelled_sets", _labelled_sets, with_graph_sql(f"SELECT e.u, e.v, ({_A} AND a.v IN {_B})::BIGINT AS both, ({_A} AND a.v IN {_B} AND a.v < e.v AND a.v <> 2)::BIGINT AS both_below, ({_A} AND a.v <> e.v)::BIGINT AS rest, ({_A} AND a.v <> e.v AND a.v NOT IN {_B})::BIGINT AS only, ({_A} AND a.v <> e.v AND a.v NOT IN {_B} AND a.v < e.u)::BIGINT AS only_below FROM e"))


def _fetched(spark: SparkSession, sf_dir: str, g=graphs.trail) -> DataFrame:
    path = storage.new_path(spark, "grid")
    graph.write_grid(g(spark, sf_dir), 4096, path)
    return graph.fetch_blocks(spark, path, [0, 2], [1, 2, 3])


_add("grid_fetch", _fetched, with_graph_sql("SELECT u AS src, v AS dst FROM n WHERE u // 4096 IN (0, 2) AND v // 4096 IN (1, 2, 3)"))

# triangles and cliques
_TRIANGLE_SQL = "FROM e a JOIN e b ON a.v = b.u JOIN e c ON c.u = a.u AND c.v = b.v"
_add("triangle_count", lambda s, d: triangles.triangle_count(graphs.co_purchase(s, d)), with_graph_sql(f"SELECT count(*)::BIGINT AS cnt {_TRIANGLE_SQL}", "co"))
_add("triangle_count_joins", lambda s, d, g=graphs.trail: triangles.triangle_count_by_joins(g(s, d)), with_graph_sql(f"SELECT count(*)::BIGINT AS cnt {_TRIANGLE_SQL}"))
_add("triangle_list", lambda s, d: triangles.triangle_list(graphs.co_purchase(s, d)), oracle.cliques_sql(3, "co", listed=True))
_add("triangle_list_trail", lambda s, d, g=graphs.trail: triangles.triangle_list(g(s, d)), oracle.cliques_sql(3, listed=True))
for _k in (3, 4, 5, 6, 7, 8):
    _add(f"clique{_k}_count", lambda s, d, k=_k: triangles.clique_count(graphs.co_purchase(s, d), k), oracle.cliques_sql(_k, "co"))
_add("clique4_count_trail", lambda s, d, g=graphs.trail: triangles.clique_count(g(s, d), 4), oracle.cliques_sql(4))
_add("clique4_list", lambda s, d, g=graphs.trail: triangles.clique_list(g(s, d), 4), oracle.cliques_sql(4, listed=True))

# counts in closed form, and listings by the matcher
for _name in counting.SHAPES:
    _add(f"sub_{_name}", lambda s, d, n=_name, g=graphs.trail: _one(s, counting.count(g(s, d), n)), oracle.count_sql(NAMED[_name]))
    if _name not in ("5path", "6path"):
        _add(f"list_{_name}", lambda s, d, n=_name, g=graphs.trail: matcher.listing(g(s, d), NAMED[n]), oracle.list_sql(NAMED[_name]))


def _path_ends(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(id, n): of the listing, which is long, how many paths end at each vertex."""
    p = NAMED[name]
    ends = F.array(*[F.col(f"v{i}") for i in range(p.n) if p.degree(i) == 1])
    return matcher.listing(graphs.trail(spark, sf_dir), p).select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


for _name in ("5path", "6path"):
    _p = NAMED[_name]
    _sql = " UNION ALL ".join(f"SELECT v{i} AS id FROM m" for i in range(_p.n) if _p.degree(i) == 1)
    _bounds = _p.symmetry_bounds(_p.matching_order())
    _add(f"list_{_name}_ends", lambda s, d, n=_name: _path_ends(s, d, n), with_graph_sql(f", m AS MATERIALIZED ({oracle.maps_sql(_p, _bounds)}) SELECT id, count(*)::BIGINT AS n FROM ({_sql}) GROUP BY id"))
for _name in ("5path", "6path", "dumbbell", "pentagon", "house"):
    _add(f"match_count_{_name}", lambda s, d, n=_name, g=graphs.trail: matcher.counting(g(s, d), NAMED[n]), oracle.count_sql(NAMED[_name]))
for _name in ("rectangle", "diamond", "pentagon", "house"):
    _p = NAMED[_name]
    _add(f"induced_{_name}", lambda s, d, n=_name, g=graphs.trail: matcher.counting(g(s, d), NAMED[n], induced=True), with_graph_sql(f"SELECT (count(*) // {len(_p.automorphisms())})::BIGINT AS cnt FROM ({oracle.maps_sql(_p, induced=True)})"))
_PAIRS = "SELECT a.v AS x, b.v AS y, count(*) AS w FROM n a JOIN n b ON a.u = b.u AND a.v < b.v GROUP BY ALL"
_add("co_diamond", lambda s, d: _one(s, counting.count(graphs.co_purchase(s, d), "diamond")), with_graph_sql(f"SELECT sum(w * (w - 1) // 2)::BIGINT AS cnt FROM ({_PAIRS}) JOIN e ON e.u = x AND e.v = y", "co"))
_add("co_rectangle", lambda s, d: _one(s, counting.count(graphs.co_purchase(s, d), "rectangle")), with_graph_sql(f"SELECT (sum(w * (w - 1) // 2) // 2)::BIGINT AS cnt FROM ({_PAIRS})", "co"))


def _bipartite_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of the customer-part graph; odd numbers are customers."""
    bought = storage.table(spark, sf_dir, "orders").join(storage.table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    half = bought.select((F.col("l_partkey").cast("long") * 2).alias("u"), (F.col("o_custkey").cast("long") * 2 + 1).alias("v")).distinct()
    return _one(spark, counting.Counter(storage.materialize(graphs.symmetric(half), "bipartite")).rectangle)


_add("bipartite_rectangle", _bipartite_rectangles, "WITH b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey), w AS (SELECT x.c AS c1, y.c AS c2, count(*) AS n FROM b x JOIN b y ON x.p = y.p AND x.c < y.c GROUP BY ALL) SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS cnt FROM w")

# motifs
_INDUCED = {n: f"(SELECT (count(*) // {len(NAMED[n].automorphisms())})::BIGINT FROM ({oracle.maps_sql(NAMED[n], induced=True)}))" for k in (3, 4, 5) for n in MOTIFS[k]}
for _k, _f in ((3, motif.motif3), (4, motif.motif4)):
    _sql = with_graph_sql(" UNION ALL ".join(f"SELECT {_k} AS k, '{n}' AS pattern, {_INDUCED[n]} AS cnt" for n in MOTIFS[_k]))
    _add(f"motif{_k}", lambda s, d, f=_f, g=graphs.trail: f(g(s, d)), _sql)
    _add(f"motif{_k}_census", lambda s, d, k=_k, g=graphs.trail: motif.motif_census(g(s, d), k), _sql)
_add("motif5", lambda s, d, g=graphs.trail: motif.motif_census(g(s, d), 5), with_graph_sql(" UNION ALL ".join(f"SELECT 5 AS k, '{n}' AS pattern, {_INDUCED[n]} AS cnt" for n in MOTIFS[5])))

# labelled queries
for _name, _p in (("triangle", TRIANGLE), ("square", SQUARE), ("path", PATH), ("diamond", DIAMOND)):
    _add(f"query_labeled_{_name}", lambda s, d, p=_p, g=graphs.trail: query.labelled_matches(g(s, d), graphs.trail_labels(s, d), p), oracle.list_sql(_p, labelled=True))
_add("query_generic", lambda s, d: query.labelled_count(graphs.co_purchase(s, d), graphs.part_labels(s, d), TRIANGLE), oracle.count_sql(TRIANGLE, "co", labelled=True))


def _candidates_body(p: Pattern) -> str:
    parts = []
    for q in range(p.n):
        near = [p.labels[w] for w in p.neighbours(q)]
        tests = " AND ".join(f"(SELECT count(*) FROM n JOIN vl ON vl.id = n.v WHERE n.u = c.id AND l = {x}) >= {near.count(x)}" for x in sorted(set(near)))
        parts.append(f"SELECT {q} AS qv, c.id AS v FROM vl c JOIN g ON g.id = c.id WHERE l = {p.labels[q]} AND d >= {p.degree(q)} AND {tests}")
    return " UNION ALL ".join(parts)


_add("query_candidates", lambda s, d, g=graphs.trail: query.candidates(g(s, d), graphs.trail_labels(s, d), SQUARE, refine=False), with_graph_sql(_candidates_body(SQUARE)))


def _stats_sql(p: Pattern) -> str:
    """Counts of candidates before and after semi-joins up and down a tree from vertex 0, and of those in maps."""
    order, parent = [0], {}
    for v in order:
        for w in p.neighbours(v):
            if w not in order:
                parent[w] = v
                order.append(w)
    now, steps = {q: f"(SELECT v FROM c WHERE qv = {q})" for q in range(p.n)}, []
    for a, b in [(parent[w], w) for w in reversed(order[1:])] + [(w, parent[w]) for w in order[1:]]:
        steps.append(f"s{len(steps)} AS MATERIALIZED (SELECT v FROM {now[a]} WHERE v IN (SELECT n.u FROM n JOIN {now[b]} x ON x.v = n.v))")
        now[a] = f"s{len(steps) - 1}"
    used = " UNION ALL ".join(f"SELECT {q} AS qv, count(DISTINCT v{q}) AS n FROM m" for q in range(p.n))
    body = _candidates_body(p)
    rows = " UNION ALL ".join(f"SELECT {q}::INTEGER AS qv, (SELECT count(*) FROM c WHERE qv = {q})::BIGINT AS \"local\", (SELECT count(*) FROM {now[q]})::BIGINT AS refined, (SELECT n FROM used WHERE qv = {q})::BIGINT AS used" for q in range(p.n))
    return with_graph_sql(f", c AS MATERIALIZED ({body}), {', '.join(steps)}, m AS MATERIALIZED ({oracle.maps_sql(p, labelled=True)}), used AS ({used}) {rows}")


def _matched_sql(p: Pattern, rounds: int = 2) -> str:
    """Candidates of which any set of query neighbours finds as many, after some rounds."""
    steps = [f"c0 AS MATERIALIZED ({_candidates_body(p)})"]
    for r in range(rounds):
        parts = []
        for q in range(p.n):
            near = p.neighbours(q)
            sets = [[w for i, w in enumerate(near) if pick >> i & 1] for pick in range(1, 1 << len(near))]
            tests = " AND ".join(f"(SELECT count(DISTINCT n.v) FROM n JOIN c{r} x ON x.v = n.v AND x.qv IN ({', '.join(map(str, some))}) WHERE n.u = a.v) >= {len(some)}" for some in sets)
            parts.append(f"SELECT qv, v FROM c{r} a WHERE qv = {q} AND {tests}")
        steps.append(f"c{r + 1} AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    return with_graph_sql(f", {', '.join(steps)} SELECT qv, v FROM c{rounds}")


_add("query_candidate_stats", lambda s, d, g=graphs.trail: query.candidate_stats(g(s, d), graphs.trail_labels(s, d), SQUARE), _stats_sql(SQUARE))
_add("query_matched_candidates", lambda s, d, g=graphs.trail: query.matched_candidates(g(s, d), graphs.trail_labels(s, d), SQUARE), _matched_sql(SQUARE))
COLOURS = Pattern.of([(0, 1), (1, 2), (2, 3), (0, 3)], (1, 2, 3, 4))
for _name, _p in (("triangle", TRIANGLE), ("square", COLOURS)):
    _add(f"query_coloured_{_name}", lambda s, d, p=_p, g=graphs.trail: query.coloured_matches(g(s, d), graphs.trail_labels(s, d), p), oracle.list_sql(_p, labelled=True))

# frequent subgraphs
_add("fsm_edges", lambda s, d, g=graphs.trail: fsm.frequent_edges(g(s, d), graphs.trail_labels(s, d), MINSUP), with_graph_sql(f"SELECT a.l AS l0, b.l AS l1, least(count(DISTINCT n.u), count(DISTINCT n.v))::BIGINT AS support FROM n JOIN vl a ON a.id = n.u JOIN vl b ON b.id = n.v WHERE a.l <= b.l GROUP BY ALL HAVING support >= {MINSUP}"))
_add("fsm_wedges", lambda s, d, g=graphs.trail: fsm.frequent_wedges(g(s, d), graphs.trail_labels(s, d), MINSUP), with_graph_sql(f"SELECT c.l AS centre, a.l AS a, b.l AS b, least(count(DISTINCT x.u), count(DISTINCT x.v), count(DISTINCT y.v))::BIGINT AS support FROM n x JOIN n y ON x.u = y.u AND x.v <> y.v JOIN vl c ON c.id = x.u JOIN vl a ON a.id = x.v JOIN vl b ON b.id = y.v WHERE a.l <= b.l GROUP BY ALL HAVING support >= {MINSUP}"))
_add("fsm_k3", lambda s, d, g=graphs.trail: fsm.mine(g(s, d), graphs.trail_labels(s, d), MINSUP, 3), with_graph_sql(" UNION ALL ".join(oracle.support_sql(p, MINSUP) for k in (1, 2, 3) for p in shapes_of_edges(k))))
_add("fsm_count", lambda s, d, g=graphs.trail: fsm.mine(g(s, d), graphs.trail_labels(s, d), MINSUP, 2).agg(F.count("*").alias("cnt")), with_graph_sql(f"SELECT ((SELECT count(*) FROM (SELECT 1 FROM n JOIN vl a ON a.id = n.u JOIN vl b ON b.id = n.v WHERE a.l <= b.l GROUP BY a.l, b.l HAVING least(count(DISTINCT n.u), count(DISTINCT n.v)) >= {MINSUP})) + (SELECT count(*) FROM (SELECT 1 FROM n x JOIN n y ON x.u = y.u AND x.v <> y.v JOIN vl c ON c.id = x.u JOIN vl a ON a.id = x.v JOIN vl b ON b.id = y.v WHERE a.l <= b.l GROUP BY c.l, a.l, b.l HAVING least(count(DISTINCT x.u), count(DISTINCT x.v), count(DISTINCT y.v)) >= {MINSUP})))::BIGINT AS cnt"))

# keyword search
_add("keyword_search_k3", lambda s, d, g=graphs.trail: keyword.keyword_search(g(s, d), graphs.trail_labels(s, d), KEYWORDS, 3), with_graph_sql("SELECT DISTINCT list_sort([x.u, x.v, y.v])[1] AS v0, list_sort([x.u, x.v, y.v])[2] AS v1, list_sort([x.u, x.v, y.v])[3] AS v2 FROM n x JOIN n y ON x.u = y.u AND x.v < y.v JOIN vl a ON a.id = x.u JOIN vl b ON b.id = x.v JOIN vl c ON c.id = y.v WHERE list_sort([a.l, b.l, c.l]) = [1, 2, 3]"))
_add("keyword_search_k4", lambda s, d, g=graphs.trail: keyword.keyword_search(g(s, d), graphs.trail_labels(s, d), KEYWORDS, 4), with_graph_sql(""", k AS (SELECT id, l FROM vl WHERE l IN (1, 2, 3)),
c AS (SELECT x.id AS a, y.id AS b, z.id AS c, o.id AS o FROM (SELECT vl.id FROM vl JOIN g ON g.id = vl.id WHERE l > 3) o JOIN n p ON p.u = o.id JOIN k x ON x.id = p.v AND x.l = 1 JOIN n q ON q.u = o.id JOIN k y ON y.id = q.v AND y.l = 2 JOIN n r ON r.u = o.id JOIN k z ON z.id = r.v AND z.l = 3
UNION SELECT x.id, y.id, z.id, o.id FROM (SELECT vl.id FROM vl JOIN g ON g.id = vl.id WHERE l > 3) o JOIN n p ON p.u = o.id JOIN k s ON s.id = p.v JOIN n q ON q.u = o.id JOIN k t ON t.id = q.v AND t.l <> s.l JOIN n r ON (r.u = s.id) JOIN k w ON w.id = r.v AND w.l <> s.l AND w.l <> t.l,
 LATERAL (SELECT CASE 1 WHEN s.l THEN s.id WHEN t.l THEN t.id ELSE w.id END AS id) x, LATERAL (SELECT CASE 2 WHEN s.l THEN s.id WHEN t.l THEN t.id ELSE w.id END AS id) y, LATERAL (SELECT CASE 3 WHEN s.l THEN s.id WHEN t.l THEN t.id ELSE w.id END AS id) z)
SELECT list_sort([a, b, c, o])[1] AS v0, list_sort([a, b, c, o])[2] AS v1, list_sort([a, b, c, o])[3] AS v2, list_sort([a, b, c, o])[4] AS v3 FROM c
WHERE (EXISTS (SELECT 1 FROM n WHERE u = a AND v = b))::INT + (EXISTS (SELECT 1 FROM n WHERE u = a AND v = c))::INT + (EXISTS (SELECT 1 FROM n WHERE u = b AND v = c))::INT < 2"""))

# the miner's steps
_add("extend_vertices", lambda s, d, g=graphs.trail: subsets.extend_vertices(graph.half(g(s, d)).select(F.array("u", "v").alias("s")), g(s, d)).select(*[F.col("s")[i].alias(f"v{i}") for i in range(3)]), with_graph_sql("SELECT DISTINCT list_sort([x.u, x.v, y.v])[1] AS v0, list_sort([x.u, x.v, y.v])[2] AS v1, list_sort([x.u, x.v, y.v])[3] AS v2 FROM n x JOIN n y ON x.u = y.u AND x.v < y.v"))
_add("extend_edges", lambda s, d, g=graphs.trail: subsets.extend_edges(graph.half(g(s, d)).select(F.array(F.struct("u", "v")).alias("e")), g(s, d)).select(*[F.col("e")[i][c].alias(f"{c}{i}") for i in range(2) for c in "uv"]), with_graph_sql("SELECT a.u AS u0, a.v AS v0, b.u AS u1, b.v AS v1 FROM e a JOIN e b ON (a.u = b.u OR a.u = b.v OR a.v = b.u OR a.v = b.v) AND (a.u < b.u OR (a.u = b.u AND a.v < b.v))"))

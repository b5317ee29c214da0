"""Near-duplicates by MinHash with tensored banding.

Two collections of BANDS bands of ROWS minhashes are made for each distinct shingle set.
A table's key is a pair of one band from each collection, so 2 x BANDS x ROWS minhashes
serve BANDS x BANDS tables of 2 x ROWS rows each, where plain banding would need
2 x ROWS x BANDS x BANDS of them. A pair of similarity s meets in some table with
probability (1 - (1 - s^ROWS)^BANDS)^2, over 0.9999 at 0.75.

Rows with equal sets are one class from the start. Two passes link classes:

1. The diagonal tables (band i of both collections) join each class to its bucket's hub,
   the member that shares most buckets. Verified links give first components, which hold
   nearly every group of copies, so that no group's pairs are ever listed.
2. All BANDS x BANDS tables. Bands whose classes lie in one component are dropped before
   the pairs of bands are formed, and so are tables. Each class that is left is compared
   with the hub that most of those it shares tables with are near to; then all pairs of
   different components that share a table are verified, but for those that can't be
   similar by what is known of the hub.

Around one hub, that second pass leaves out what can't be similar. Of two sets x and y,
the common part lies in the hub or in both their additions to it. The first is at most
min(|x & hub|, |y & hub|), both of which are known; if that is too little, the additions
must share a shingle, and such pairs come from a join on additions, rarest first, cut to
the prefix that must hold a shared one. So a thousand copies of one original whose own
changes keep them apart cost their changes, and not their pairs.

Every candidate is verified on the full shingle sets. A class is a node under its least
doc_id, so rows that share a doc_id are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import joins, memory, names, shingles
from weftgraph.operators.components import connected_components

#: Percent of similarity from which a hub's part in a set is told apart from the rest.
NEAR_HUB = 30
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 20, 3
#: Pairs of one hub that are compared in one group.
GROUP = 32
_SEEDS = shingles.mix(np.arange(1, 1 + 4 * BANDS * ROWS, dtype=np.uint64)).astype(np.uint32)
_FLIP, _MULT = _SEEDS[: 2 * BANDS * ROWS, None], _SEEDS[2 * BANDS * ROWS :, None] | np.uint32(1)


def bands(full: np.ndarray, block: int = 2048) -> np.ndarray:
    """The keys of both collections' bands for a shingle set that isn't empty."""
    h = (full >> np.uint64(32)).astype(np.uint32)
    least = np.full(2 * BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), block):
        least = np.minimum(least, ((h[None, lo : lo + block] ^ _FLIP) * _MULT).min(axis=1))
    rows = least.astype(np.uint64).reshape(2 * BANDS, ROWS)
    key = np.arange(2 * BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = shingles.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j] + np.uint64(1))
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, fp_hi, fp_lo (the set's fingerprint), a, b (band keys; empty for an empty set)."""

    @memory.lean
    def make(batches):
        for batch in batches:
            at = 0
            for texts in shingles.slices(batch.column(1), 4_000_000):
                yield sketch(batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)

    def sketch(ids, texts):
        sets = shingles.shingle_sets(texts)
        prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        keys = [bands(s) for s in sets if len(s)]
        flat = np.concatenate(keys).reshape(-1, 2 * BANDS) if keys else np.zeros((0, 2 * BANDS), np.int64)
        ends = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])]).astype(np.int32)
        halves = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[:, c * BANDS : (c + 1) * BANDS].ravel())) for c in (0, 1)]
        hi, lo = (np.array([p >> 64 for p in prints], np.uint64), np.array([p & (1 << 64) - 1 for p in prints], np.uint64))
        sizes = pa.array([len(s) for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([ids, sizes, pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), *halves], ["doc_id", "n_shingles", "fp_hi", "fp_lo", "a", "b"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(make, "doc_id long, n_shingles long, fp_hi long, fp_lo long, a array<long>, b array<long>")


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of doc_ids with both (common shingles), nu, nv (their shingles), and what u adds to v.

    adds is empty below a similarity of NEAR_HUB percent. The pairs of one v are dealt in
    groups of about GROUP; a group gets v's text once, ahead of the texts of its u.
    """

    @memory.lean
    def check(batches):
        at, own = None, []
        for batch in batches:
            done = 0
            for texts in shingles.slices(batch.column(3), 2_000_000):
                n, rows = len(texts), []
                keys = zip(*(batch.column(c).slice(done, n).to_pylist() for c in range(3)))
                for (v, group, u), s in zip(keys, shingles.shingle_sets(texts)):
                    if (v, group) != at:
                        at, own = (v, group), []
                    if u is None:
                        own.append(s)
                        continue
                    for other in own:  # more than one only where an id has several texts
                        adds = np.setdiff1d(s, other, assume_unique=True)
                        both = len(s) - len(adds)
                        near = both and 100 * both >= NEAR_HUB * (len(s) + len(other) - both)
                        rows.append((u, v, both, len(s), len(other), adds.view(np.int64) if near else adds[:0].view(np.int64)))
                done += n
                if rows:
                    u, v, both, nu, nv, adds = map(list, zip(*rows))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (u, v, both, nu, nv)), pa.array(adds, pa.list_(pa.int64()))], ["u", "v", "both", "nu", "nv", "adds"])

    pairs = storage.materialize(pairs, "pairs")
    ids = storage.materialize(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "doc_id"), "pair-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(storage.maybe_broadcast(ids), "doc_id", "left_semi").distinct()
    texts = storage.materialize(texts, "pair-texts")
    many = storage.materialize(pairs.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select(F.col("v").alias("hub"), (F.col("c") / GROUP).cast("long").alias("more")), "many-pairs")
    group = F.when(F.col("more").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("u"), F.col("more") + 1)).cast("int")
    grouped = storage.materialize(pairs.join(storage.maybe_broadcast(many), F.col("v") == F.col("hub"), "left").select("u", "v", group.alias("group")), "grouped")
    ends = grouped.join(texts.withColumnRenamed("doc_id", "u"), "u").select("v", "group", "u", "text")
    hubs = grouped.select("v", "group").distinct().join(texts.withColumnRenamed("doc_id", "v"), "v").select("v", "group", F.lit(None).cast("long").alias("u"), "text")
    laid = ends.union(hubs).repartition("v", "group").sortWithinPartitions("v", "group", F.col("u").asc_nulls_first())
    return laid.mapInArrow(check, "u long, v long, both long, nu long, nv long, adds array<long>")


def _similar(percent: int = PERCENT):
    """Whether compared sets are linked."""
    return (F.col("both") > 0) & (100 * F.col("both") >= percent * (F.col("nu") + F.col("nv") - F.col("both")))


def _links(rows: DataFrame) -> DataFrame:
    return rows.where(_similar()).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _close(n: str, m: str, percent: int = PERCENT):
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _through_hubs(sets: DataFrame) -> DataFrame:
    """Candidate pairs (u, v): each class u with the hub v of each of its diagonal buckets."""
    keys = F.transform(F.arrays_zip("a", "b"), lambda x: F.xxhash64(x["a"], x["b"]))
    rows = sets.select("rep", "n", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    rows = storage.materialize(rows.join(shared, "key"), "diagonal")
    degree = rows.groupBy("rep").agg(F.sum("c").alias("degree"))
    hub = rows.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", -F.col("rep"), "n")).alias("h"))
    hub = hub.select("key", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"))
    met = rows.join(hub, "key").where((F.col("rep") != F.col("hub")) & _close("n", "hub_n"))
    return met.select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()


def _main_hubs(tried: DataFrame) -> DataFrame:
    """(rep, main, i, adds): each compared class's hub, the one with most comparisons, what it has of it, and what it adds; hubs are near themselves.

    Counts of a hub are summed before they are dealt out, and join its rows by broadcast or in salted parts.
    """
    popular = storage.materialize(tried.groupBy("v").agg(F.count("*").alias("popular")).withColumnRenamed("v", "main"), "popular")
    once = tried.groupBy("u", "v").agg(F.count("*").alias("c")).where("c = 1").select("u", "v")  # an id with two texts has no hub
    near = tried.join(once, ["u", "v"], "left_semi").where(100 * F.col("both") >= NEAR_HUB * (F.col("nu") + F.col("nv") - F.col("both")))
    near = near.select(F.col("u").alias("rep"), F.col("v").alias("main"), F.col("both").alias("i"), "adds")
    own = tried.groupBy("v").agg(F.max("nv").alias("i"), F.min("nv").alias("j")).where("i = j").select(F.col("v").alias("rep"), F.col("v").alias("main"), "i", F.array().cast("array<long>").alias("adds"))
    every = joins.beside(near.union(own), popular, "main", "rep")
    best = every.groupBy("rep").agg(F.max(F.struct("popular", -F.col("main"))).alias("b")).select("rep", (-F.col("b.col2")).alias("main"))
    return every.join(best, ["rep", "main"], "left_semi").select("rep", "main", "i", "adds")


def _sharing_additions(placed: DataFrame, mains: DataFrame) -> DataFrame:
    """Candidate pairs of classes with one main hub that share one of the rarest shingles they add to it."""
    rows = placed.select("rep", "n", "comp").join(mains, "rep").where(F.size("adds") > 0)
    rows = storage.materialize(rows, "with-additions")
    open_ = rows.groupBy("main").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("main")
    rows = joins.beside(rows, storage.materialize(open_, "open"), "main", "rep", "left_semi")
    # a similar set shares at least so many additions: PERCENT of the set lie in the other, and i at most in the hub
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * PERCENT / 100) - F.col("i"))
    spread = rows.select("main", "rep", "n", "comp", (F.size("adds") - needed + 1).alias("prefix"), F.explode("adds").alias("key")).where("prefix > 0")
    count = spread.groupBy("main", "key").agg(F.count("*").alias("c"))
    rank = Window.partitionBy("main", "rep").orderBy("c", "key")  # one class's additions
    first = spread.join(count, ["main", "key"]).withColumn("at", F.row_number().over(rank)).where("at <= prefix AND c > 1").select("main", "key", "rep", "n", "comp")
    first = storage.materialize(first, "additions")
    other = first.select("main", "key", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    met = first.join(other, ["main", "key"]).where((F.col("comp") < F.col("comp2")) & _close("n", "n2"))
    return met.select(F.least("rep", "rep2").alias("u"), F.greatest("rep", "rep2").alias("v")).distinct()


def _tables(sets: DataFrame) -> DataFrame:
    """(key, rep) of all tables, for sets (rep, comp, a, b); bands, and then tables, whose sets lie in one component are left out."""

    def crossing(rows: DataFrame) -> DataFrame:
        spans = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return rows.join(spans, "key", "left_semi")

    one = crossing(sets.select("rep", "comp", F.explode("a").alias("key"))).withColumnRenamed("key", "ka")
    two = crossing(sets.select("rep", F.explode("b").alias("key"), "comp")).select("rep", F.col("key").alias("kb"))
    tables = one.join(two, "rep").select("rep", "comp", F.xxhash64("ka", "kb").alias("key"))
    return storage.materialize(crossing(storage.materialize(tables, "bands")).select("key", "rep"), "tables")


def _to_common_hubs(tables: DataFrame, mains: DataFrame) -> DataFrame:
    """Candidate pairs (u, v): each class u with v, the main hub of most classes among those it shares tables with."""
    sizes = storage.materialize(mains.groupBy("main").agg(F.count("*").alias("size")), "main-sizes")
    led = tables.join(joins.beside(mains.select("rep", "main"), sizes, "main", "rep"), "rep")
    lead = led.groupBy("key").agg(F.max(F.struct("size", -F.col("main"))).alias("h"))
    best = tables.join(lead, "key").groupBy("rep").agg(F.max("h").alias("h")).select(F.col("rep").alias("u"), (-F.col("h.col2")).alias("v"))
    return best.where("u <> v")


def _across(tables: DataFrame, placed: DataFrame) -> DataFrame:
    """Candidate pairs (u, v), u < v, of sets (rep, n, comp, main, i) that meet in some table and lie in different components.

    Of one main hub only pairs that may be similar by their parts of the hub alone; see _sharing_additions for the others.
    """
    rows = tables.join(placed.select("rep", "n", "comp", "main", "i"), "rep")
    spans = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rows = storage.materialize(rows.join(spans, "key", "left_semi"), "placed-tables")
    other = rows.select("key", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "comp", "main", "i")])
    apart = ~F.coalesce(F.col("main") == F.col("main2"), F.lit(False))
    within = (100 + PERCENT) * F.least("i", "i2") >= PERCENT * (F.col("n") + F.col("n2"))
    met = rows.join(other, "key").where((F.col("comp") < F.col("comp2")) & _close("n", "n2") & (apart | within))
    return met.select(F.least("rep", "rep2").alias("u"), F.greatest("rep", "rep2").alias("v")).distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): the sketched rows (doc_id, n_shingles, fp_hi, fp_lo), and for each set its component (fp_hi, fp_lo, component_id)."""
    made = storage.materialize(sketches(docs), "sketches")
    full = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = storage.materialize(full.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("rep")), "classes")
    same = full.join(reps.withColumnsRenamed({"fp_hi": "hi_", "fp_lo": "lo_"}), (F.col("fp_hi") == F.col("hi_")) & (F.col("fp_lo") == F.col("lo_")) & (F.col("doc_id") == F.col("rep")), "inner")
    sets = storage.materialize(same.dropDuplicates(["rep", "fp_hi", "fp_lo"]).select("rep", F.col("n_shingles").alias("n"), "a", "b"), "sets")
    tried = storage.materialize(compared(_through_hubs(sets), docs), "tried")

    def place(links: DataFrame) -> DataFrame:
        comps = connected_components(links).select(F.col("id").alias("rep"), "component")
        return storage.materialize(sets.join(comps, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"), "placed")

    tables = _tables(place(_links(tried)))
    new = _to_common_hubs(tables, storage.materialize(_main_hubs(tried), "mains")).join(tried, ["u", "v"], "left_anti")
    tried = storage.materialize(tried.union(compared(new, docs)), "tried")
    links = storage.materialize(_links(tried), "links")
    mains = storage.materialize(_main_hubs(tried), "mains")
    placed = storage.materialize(place(links).drop("a", "b").join(mains.select("rep", "main", "i"), "rep", "left"), "placed")
    rest = storage.materialize(_across(tables, placed).union(_sharing_additions(placed, mains)).distinct(), "rest")
    done = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    more = storage.materialize(_links(compared(rest.join(done, ["u", "v"], "left_anti"), docs)), "more-links")
    comps = connected_components(links.union(more)).select(F.col("id").alias("rep"), "component")
    nodes = reps.join(comps, "rep", "left").select("fp_hi", "fp_lo", F.coalesce("component", "rep").alias("component_id"))
    return made.select("doc_id", "n_shingles", "fp_hi", "fp_lo"), storage.materialize(nodes, "nodes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of five-word shingles (lower case A-Z; all words as
    one shingle if there are fewer) have a Jaccard similarity of at least 0.75;
    component_id is the least doc_id reachable, kept says that it is the document's own.
    Documents without words or text are linked with nothing, and rows without a doc_id keep
    a null component_id and are kept. Repeated rows get equal results.
    """
    rows, nodes = classes(docs)
    out = rows.join(nodes, ["fp_hi", "fp_lo"], "left")
    alone = F.col("n_shingles").isNull() | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    comp = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    return near_duplicates(storage.table(spark, sf_dir, "documents"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the least doc_id.

    A document is a doc_id with its text: unlike texts under one id, and rows without an id,
    are documents of their own, which go if their group has an id of one row alone (which
    of them stays else is settled by a hash), and of rows that repeat only one stays. Rows
    without words all stay.
    """
    node, other = names.free("node_", docs.columns), names.free("gone_", docs.columns)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    unclear = docs.select(doc_id.alias(other)).groupBy(other).agg(F.count("*").alias("c")).where(f"c > 1 OR {other} IS NULL").select(other)
    unclear = storage.materialize(unclear, "unclear-ids")
    plain = unclear.isEmpty()
    if plain:
        marked = docs.withColumn(node, doc_id)
    else:
        # a number over all usual ids, for a doc_id with its text
        own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(doc_id, text), 2)
        met = docs.join(storage.maybe_broadcast(unclear), doc_id.eqNullSafe(F.col(other)), "left_semi").withColumn(node, own)
        single = docs.join(storage.maybe_broadcast(unclear), doc_id.eqNullSafe(F.col(other)), "left_anti").withColumn(node, doc_id)
        marked = single.union(met)
    verdicts = near_duplicates(marked.select(F.col(node).alias("doc_id"), text.alias("text")))
    gone = storage.maybe_broadcast(storage.materialize(verdicts.where("NOT kept").select(F.col("doc_id").alias(other)).distinct(), "copies"))
    if plain:
        return docs.join(gone, doc_id == F.col(other), "left_anti")
    once = met.where(text.rlike(r"[^\x20\x09-\x0D]")).dropDuplicates([node])
    rest = met.where(~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return single.union(once).union(rest).join(gone, F.col(node) == F.col(other), "left_anti").drop(node)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS id, doc_id AS other FROM n UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, min(other) = n.doc_id AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""

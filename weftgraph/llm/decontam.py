"""Benchmark decontamination by a prefix-filtered set join, by DataFrame functions alone.

A window of an item is ten consecutive words (the whole item, if it has fewer). Its
tokens are its shingles of five words, in order (of all its words, if it has fewer). The
join runs in these steps.

1. One pass over the documents keeps the places where a shingle of some window occurs.
2. The windows' tokens are ordered by rarity, the number of places they occur at. A window
   lies in a document only if all of its tokens do, so its rarest token, the necessary
   prefix, is enough to find candidates; windows that have a token without any place are
   dropped (they can't be contained).
3. The prefix joins the places; its position in the window gives the candidate's start,
   and starts before the first word are dropped (positional bound), as are those that end
   behind the document's last word (length bound).
4. A candidate is verified word for word: the shingles at its first and its last place
   cover the window, and both must be at their positions.

Rows with one doc_id and one text are repeats of one document and get the same result;
rows with one doc_id and different texts are told apart by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import names

WINDOW = 10
SHINGLE = 5
#: Distinct window shingles up to which they are broadcast; beyond it a filter of 2^FILTER_BITS bits is (a million words at
#: most), and the places that pass it are found by a shuffle. Results are the same.
BROADCAST_SHINGLES, FILTER_BITS = 1_000_000, 26
#: Stands for a row among the hashes of its shingles; a shingle with this hash does no harm.
_ROW = 1
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _GAP, -1), "")


def _runs(w: Column, n: Column, size: int) -> Column:
    """The hash of every run of so many words; an empty array if there is none."""
    hashed = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(F.lit(size), *[w[i + j] for j in range(size)]))
    return F.when(n >= size, hashed).otherwise(F.array().cast("array<long>"))


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of items (item_id, text), and which items have them.

    windows: window (text), size, tokens (array of struct(token, at)); owners: window, item_id (string).
    """
    w, n = F.col("w_"), F.size("w_")
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w_"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.slice(w, i + 1, WINDOW))
    owners = split.where(n > 0).select("item_id", F.explode(cut).alias("w_")).select("item_id", F.array_join("w_", " ").alias("window"), "w_")
    tokens = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.struct(F.array_join(F.slice(w, i + 1, SHINGLE), " ").alias("token"), i.alias("at")))
    windows = owners.dropDuplicates(["window"]).select("window", n.alias("size"), tokens.alias("tokens"))
    return windows, owners.select("window", "item_id").distinct()


def places(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Where the shingles (token, words, hash) occur in docs (doc_id, text).

    Columns: doc_id, key (hash of the text), n_words, at (the first word's position),
    token. A row without a token stands for each row of docs.
    """
    sizes = [r[0] for r in shingles.select("words").distinct().orderBy("words").collect()]  # SHINGLE of them at most
    few = shingles.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    row = docs.sparkSession.range(1).select(F.lit(_ROW).alias("h_"))
    wanted = shingles.select(F.col("hash").alias("h_")).union(row).distinct()
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), words(F.col("text")).alias("w_"))
    w, n = F.col("w_"), F.size("w_")
    # one array of bare longs a document: its first entry stands for the row, then come the runs of each size
    hashed = split.select("doc_id", "key", "w_", n.alias("n_words"), F.concat(F.array(F.lit(_ROW)), *[_runs(w, n, k) for k in sizes]).alias("hs_"))
    # never empty; the outer form keeps Spark from filtering on its size first, which would make it twice
    each = hashed.select("doc_id", "key", "w_", "n_words", F.posexplode_outer("hs_").alias("i_", "h_"))
    at, size, gone = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for k in sizes:
        runs = F.greatest(F.col("n_words") - (k - 1), F.lit(0))
        here = (F.col("i_") > gone) & (F.col("i_") <= gone + runs)
        at, size, gone = F.when(here, F.col("i_") - 1 - gone).otherwise(at), F.when(here, F.lit(k)).otherwise(size), gone + runs
    found = ("doc_id", "key", "n_words", at.alias("at"), F.when(F.col("i_") > 0, F.array_join(F.slice("w_", at + 1, size), " ")).alias("token"))
    if few:
        return each.join(F.broadcast(wanted), "h_", "left_semi").select(*found)
    # a filter of 64-bit words, of a fixed size whatever the benchmark's: texts are made, and dealt out, of what passes alone
    spot = F.pmod("h_", F.lit(1 << FILTER_BITS))
    bits = storage.materialize(wanted.groupBy(F.shiftright(spot, 6).alias("word_")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(h_, {1 << FILTER_BITS}L) & 63))")).alias("bits_")), "filter")
    passed = each.join(F.broadcast(bits), F.shiftright(spot, 6) == F.col("word_")).where(F.expr(f"bit_get(bits_, int(pmod(h_, {1 << FILTER_BITS}L) & 63)) = 1"))
    return passed.select(*found, "h_").join(wanted, "h_", "left_semi").drop("h_")


def contained(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set join: (documents, hits).

    documents: doc_id, key, n_words, copies (rows of docs). hits: doc_id, key, start, size,
    window, each occurrence of each window.
    """
    windows, owners = (storage.materialize(x, tag) for x, tag in zip(item_windows(items), ("windows", "owners")))
    tokens = windows.select("window", "size", F.explode("tokens").alias("t")).select("window", "size", "t.token", "t.at")
    words_in = F.least(F.col("size"), F.lit(SHINGLE))
    as_words = F.split("token", " ")
    hashed = F.coalesce(*[F.when(F.col("words") == k, F.xxhash64(F.lit(k), *[as_words[j] for j in range(k)])) for k in range(1, SHINGLE + 1)])
    shingles = storage.materialize(tokens.select("token", words_in.alias("words")).distinct().withColumn("hash", hashed), "shingles")
    at = storage.materialize(places(docs, shingles), "places")
    documents = at.where("token IS NULL").groupBy("doc_id", "key", "n_words").agg(F.count("*").alias("copies"))
    # the places of each document once, whatever its copies
    spots = at.where("token IS NOT NULL").select("doc_id", "key", "n_words", "at", "token").distinct()
    spots = storage.materialize(spots, "spots")
    rarity = spots.groupBy("token").agg(F.count("*").alias("places"))
    ranked = tokens.join(rarity, "token", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("places", F.lit(0).cast("long")).alias("places"), F.col("at"), F.col("token"))).alias("p"))
    ends = windows.select("window", F.element_at("tokens", 1)["token"].alias("first_"), F.element_at("tokens", -1)["token"].alias("last_"), F.element_at("tokens", -1)["at"].alias("gap_"))
    prefixes = storage.materialize(ranked.where("p.places > 0").join(ends, "window").select("window", "size", F.col("p.token").alias("token"), F.col("p.at").alias("in_window"), "first_", "last_", "gap_"), "prefixes")
    candidates = spots.join(storage.maybe_broadcast(prefixes), "token").withColumn("start", F.col("at") - F.col("in_window")).where("start >= 0 AND start + size <= n_words")
    candidates = candidates.select("doc_id", "key", "window", "size", "start", "first_", "last_", "gap_")

    def has(left: DataFrame, position: Column, token: str) -> DataFrame:
        there = spots.select(F.col("doc_id").alias("d_"), F.col("key").alias("k_"), F.col("at").alias("a_"), F.col("token").alias("t_"))
        return left.join(there, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("key") == F.col("k_")) & (position == F.col("a_")) & (F.col(token) == F.col("t_")), "left_semi")

    hits = has(has(candidates, F.col("start"), "first_"), F.col("start") + F.col("gap_"), "last_")
    return documents, hits.select("doc_id", "key", "start", "size", "window")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, key, n_words, n_hit, n_items (long), items_sha256, contaminated.

    n_hit counts the words inside any occurrence of any window; n_items the items with an
    occurring window; items_sha256 is the hash of their ids, sorted as strings and joined by
    commas (of the empty string, if there are none). Null texts have no words; an item
    without words or text has no window; one without an item_id counts for n_hit and
    contaminated, but is in neither n_items nor the ids. Repeated items and rows
    are fine; with no items nothing is contaminated.
    """
    documents, hits = contained(docs, items)
    hits = storage.materialize(hits, "hits")
    spans = hits.groupBy("doc_id", "key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.withColumn("n", F.greatest(fresh, F.lit(0))).groupBy("doc_id", "key").agg(F.sum("n").alias("n_hit"))
    owners = item_windows(items)[1]
    per_item = hits.select("doc_id", "key", "window").distinct().join(owners, "window").select("doc_id", "key", "item_id").distinct()
    listed = per_item.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))  # at most the benchmark's items
    ids = listed.select("doc_id", "key", F.size("items").alias("n_items"), F.array_join("items", ",").alias("ids"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        # null-safe on doc_id: a row without an id is a document as well
        right = right.withColumnsRenamed({"doc_id": "d_", "key": "k_"})
        return left.join(right, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("key") == F.col("k_")), "left").drop("d_", "k_")

    out = beside(beside(documents, covered), ids).select(
        "doc_id", "key", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), "copies",
    )
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy_")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    out = decontaminate(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "benchmark"))
    return out.drop("key")


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any benchmark passage, with all their columns."""
    _, hits = contained(docs, storage.table(spark, sf_dir, "benchmark"))
    d, h = (names.free(x, docs.columns) for x in ("d_", "h_"))
    hit = hits.select(F.col("doc_id").alias(d), F.col("key").alias(h)).distinct()
    hit = storage.maybe_broadcast(storage.materialize(hit, "contaminated"))
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[p:p + 9], ' ') AS s FROM iw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(p) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (SELECT doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(ws) - size + 2)) AS r(p) WHERE len(ws) >= size),
hit AS (SELECT doc_id, p, spot.size, item_id FROM spot JOIN win ON win.s = spot.s AND win.size = spot.size),
pos AS (SELECT DISTINCT doc_id, p + unnest(range(0, size)) AS q FROM hit),
c AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN c ON c.doc_id = dw.doc_id LEFT JOIN i ON i.doc_id = dw.doc_id
"""

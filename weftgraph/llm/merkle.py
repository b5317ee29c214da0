"""Merkle fixity audit of archives: find damaged records by comparing two replicas' trees.

A replica is a table of archive records: file, offset (of the record's first byte in its
file) and hash (of its bytes). A file is cut into ranges of RANGE_BYTES offsets; a range's
hash covers its records' offsets and hashes, in the order of the offsets; a file's hash
covers its ranges', and each level above groups FAN nodes, up to one root. The audit
compares the roots and goes down only where two nodes differ, so equal replicas cost one
comparison, and ranges whose ancestors agree are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import storage

RANGE_BYTES, FAN = 1 << 17, 16
#: Ids of a file, and the first file of pages without an id.
FILE_IDS, NO_ID = 1000, 1 << 40


def warc_records(pages: DataFrame, body: Column | None = None) -> DataFrame:
    """Pages as archive records (file, offset, page_id, hash): FILE_IDS ids to a file, in ascending order.

    A record is a header with the url and the length, an empty line, and the html; body
    replaces its text, if given, by one of the same length. A null url or html counts as
    empty; pages without an id go to files of their own, by hash; ties are in the order of
    their hashes, so repeated rows have their own offsets. An empty table has no records.
    """
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), record(pages).alias("body"))
    rows = made.select("page_id", F.octet_length("body").cast("long").alias("bytes"), F.sha2(F.col("body") if body is None else body, 256).alias("hash"))
    missing = F.lit(NO_ID) + F.pmod(F.xxhash64("hash"), F.lit(1 << 10))
    sized = rows.select(F.coalesce(F.floor(F.col("page_id") / FILE_IDS), missing).cast("long").alias("file"), "page_id", "bytes", "hash")
    before = Window.partitionBy("file").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("file", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long").alias("offset"), "page_id", "hash")


def record(pages: DataFrame) -> Column:
    """A page's record as text."""
    html, url = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("html", "url"))
    end = "\r\n\r\n"
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(end), html, F.lit(end))


def ranges(records: DataFrame) -> DataFrame:
    """The lowest nodes (file, node, hash, first, n, leaves); a range holds as many records as start in RANGE_BYTES."""
    cut = records.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node"))
    listed = cut.agg(F.sort_array(F.collect_list(F.struct("offset", "hash"))).alias("leaves"))
    joined = F.transform("leaves", lambda x: F.concat(x["offset"].cast("string"), F.lit(":"), x["hash"], F.lit("\n")))
    return listed.select("file", "node", _digest(joined).alias("hash"), F.element_at("leaves", 1)["offset"].alias("first"), F.size("leaves").cast("long").alias("n"), "leaves")


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def levels(low: DataFrame) -> list[DataFrame]:
    """The levels above the ranges, from the files to the root: (node, hash, parent); each is written once."""

    def above(nodes: DataFrame, key: str) -> DataFrame:
        listed = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("l"))  # a file's ranges, or FAN nodes
        named = F.transform("l", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"], F.lit("\n")))
        made = listed.select(F.col(key).alias("node"), _digest(named).alias("hash"))
        return storage.materialize(made.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")), "nodes")

    out = [above(low, "file")]
    while out[-1].limit(2).count() > 1:
        out.append(above(out[-1], "parent"))
    return out


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """The ranges of the replicas one and two: file, node, first, n (of one, else of two), status, offsets.

    status is ok or corrupt; offsets lists, as a string, the offsets of records that differ
    or that one replica lacks. Only ranges below differing nodes are compared record by
    record; all others are ok by their ancestors' equal hashes.
    """
    a, b = storage.materialize(ranges(one), "ranges"), storage.materialize(ranges(two), "ranges")
    up_a, up_b = levels(a), levels(b)

    def differing(x: DataFrame, y: DataFrame, within: DataFrame | None) -> DataFrame:
        if within is not None:
            x, y = (z.join(storage.maybe_broadcast(within), F.col("parent") == F.col("suspect"), "left_semi") for z in (x, y))
        both = x.select("node", "hash").join(y.select("node", F.col("hash").alias("other")), "node", "full")
        return storage.materialize(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select(F.col("node").alias("suspect")), "suspects")

    suspects = None
    if len(up_a) != len(up_b):  # of trees of different heights only the files can be compared
        up_a, up_b = up_a[:1], up_b[:1]
    for x, y in zip(reversed(up_a), reversed(up_b)):
        suspects = differing(x, y, suspects)
    bad = storage.maybe_broadcast(suspects)
    parts = [x.join(bad, F.col("file") == F.col("suspect"), "left_semi").select("file", "node", F.col("hash").alias(f"h{i}"), F.col("leaves").alias(f"l{i}")) for i, x in enumerate((a, b))]
    met = parts[0].join(parts[1], ["file", "node"], "full").where(~F.col("h0").eqNullSafe(F.col("h1")))
    none = F.array().cast("array<struct<offset:bigint,hash:string>>")
    l0, l1 = F.coalesce("l0", none), F.coalesce("l1", none)
    changed = F.array_sort(F.array_distinct(F.transform(F.concat(F.array_except(l0, l1), F.array_except(l1, l0)), lambda x: x["offset"])))
    found = met.select("file", "node", F.array_join(F.transform(changed, lambda x: x.cast("string")), ",").alias("offsets"))
    every = a.select("file", "node", "first", "n").join(b.select("file", "node", F.col("first").alias("f2"), F.col("n").alias("n2")), ["file", "node"], "full")
    every = every.select("file", "node", F.coalesce("first", "f2").alias("first"), F.coalesce("n", "n2").alias("n"))
    return every.join(found, ["file", "node"], "left").withColumn("status", F.when(F.col("offsets").isNull(), "ok").otherwise("corrupt"))


def op4_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """All pages as an archive, against a replica that is damaged by rule: every range, and what is wrong in it.

    In the replica a byte is changed in records whose page_id leaves 5 by 997, and those that leave 500 are lost.
    """
    pages = storage.table(spark, sf_dir, "pages")
    changed = F.when(F.pmod("page_id", F.lit(997)) == 5, F.overlay("body", F.lit("~"), F.lit(3))).otherwise(F.col("body"))
    replica = warc_records(pages, changed).where(F.coalesce(F.pmod("page_id", F.lit(997)) != 500, F.lit(True)))
    found = audit(warc_records(pages), replica)
    return found.select("file", F.col("node").alias("range_id"), F.col("first").alias("first_offset"), F.col("n").alias("n_records"), "status", F.coalesce("offsets", F.lit("")).alias("bad_offsets"))


ORACLE = rf"""
WITH b AS (SELECT page_id, page_id // {FILE_IDS} AS file, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS body FROM pages),
r AS (SELECT file, page_id, CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM b),
one AS (SELECT *, off // {RANGE_BYTES} AS node FROM r),
two AS (SELECT * FROM one WHERE page_id % 997 <> 500),
o AS (SELECT file, node, min(off) AS f, count(*) AS n FROM one GROUP BY ALL),
t AS (SELECT file, node, min(off) AS f, count(*) AS n FROM two GROUP BY ALL),
d AS (SELECT coalesce(one.file, two.file) AS file, coalesce(one.node, two.node) AS node, coalesce(one.off, two.off) AS off FROM one FULL JOIN two ON one.file = two.file AND one.node = two.node AND one.off = two.off WHERE one.off IS NULL OR two.off IS NULL OR one.page_id % 997 = 5),
g AS (SELECT file, node, string_agg(CAST(off AS VARCHAR), ',' ORDER BY off) AS offs FROM (SELECT DISTINCT * FROM d) GROUP BY ALL)
SELECT coalesce(o.file, t.file)::BIGINT AS file, coalesce(o.node, t.node)::BIGINT AS range_id, coalesce(o.f, t.f) AS first_offset, coalesce(o.n, t.n)::BIGINT AS n_records,
  CASE WHEN g.offs IS NULL THEN 'ok' ELSE 'corrupt' END AS status, coalesce(g.offs, '') AS bad_offsets
FROM o FULL JOIN t ON o.file = t.file AND o.node = t.node LEFT JOIN g ON g.file = coalesce(o.file, t.file) AND g.node = coalesce(o.node, t.node)
"""

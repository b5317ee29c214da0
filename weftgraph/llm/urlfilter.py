"""URL filters by a temporal list join, by DataFrame functions alone.

A list is a history of changes: an entry (a domain; it covers its subdomains) is added or
removed on a date. Changes become validity intervals, and a capture is blocked if an
entry that covers its host was on the list when it was fetched: an as-of join on the
interval that began last. Captures are reduced to distinct (host, date) pairs before the
join, so a host with a third of all captures costs what its dates do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import joins


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def validity(changes: DataFrame) -> DataFrame:
    """Changes (entry, day, action 'add' or 'remove') as intervals (entry, since, until): listed from since on, before until (null: still).

    Repeated changes don't count. Of changes on one day the removal comes first, so an entry
    that is removed and added stays listed. Changes with a null are left out.
    """
    order = Window.partitionBy("entry").orderBy("day", F.desc("action"))
    rows = changes.select("entry", "day", "action").where("entry IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").distinct()
    turns = rows.withColumn("was_", F.lag("action").over(order)).where("NOT action <=> was_")
    spans = turns.withColumn("until", F.lead("day").over(order)).where("action = 'add'")
    return spans.select("entry", F.col("day").alias("since"), "until").where("until IS NULL OR until > since")


def blocked(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """A row for each row of captures (page_id, url, fetched): these, host, blocked, entry and since.

    entry is the longest listed domain that covers the host, since when it had been listed;
    both are null where nothing is. A url without a host, or a null date, is not blocked.
    Repeated rows are each judged; other columns are not read.

    Suffixes are taken of distinct hosts, and only those that are entries go on. Distinct
    (entry, day) pairs meet the entry's intervals in one order by day, where the last
    interval that began is the one to look at: a task holds an entry's days, and not its
    captures.
    """
    intervals = storage.materialize(validity(changes), "intervals")
    rows = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"))
    pairs = rows.select("host", "fetched").where("host IS NOT NULL AND fetched IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = pairs.select("host").distinct().select("host", F.explode(suffixes).alias("entry"))
    entries = storage.materialize(intervals.select("entry").distinct(), "entries")
    covered = storage.materialize(joins.beside(below, entries, "entry", "host", "left_semi"), "covered")
    keyed = storage.materialize(pairs.join(covered, "host"), "keyed")
    asked = keyed.select("entry", F.col("fetched").alias("day")).distinct()
    none = F.lit(None).cast("date")
    line = intervals.select("entry", F.col("since").alias("day"), F.lit(0).alias("kind"), F.struct("since", "until").alias("span")).union(asked.select("entry", "day", F.lit(1), F.when(F.lit(False), F.struct(none.alias("since"), none.alias("until")))))
    so_far = Window.partitionBy("entry").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("last", F.last("span", ignorenulls=True).over(so_far)).where("kind = 1 AND last IS NOT NULL AND (last.until IS NULL OR day < last.until)")
    active = storage.materialize(found.select("entry", F.col("day").alias("fetched"), F.col("last.since").alias("since")), "active")
    met = keyed.join(storage.maybe_broadcast(active), ["entry", "fetched"])
    best = met.groupBy("host", "fetched").agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "since")).alias("b"))
    best = storage.materialize(best.select("host", "fetched", F.col("b.entry").alias("entry"), F.col("b.since").alias("since")), "blocked")
    return rows.join(storage.maybe_broadcast(best), ["host", "fetched"], "left").withColumn("blocked", F.col("entry").isNotNull())


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def page_history(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures, changes) made from pages by rule, as the tables have neither dates nor lists.

    A page is fetched on day page_id mod 366 of 2024. By a hash of its name, a third of the
    sites (hosts without a leading www. or m.) are listed once, a third of those are removed
    later, and half of these listed again.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), day(F.pmod("page_id", F.lit(366))).alias("fetched"))
    sites = captures.select(F.regexp_replace(host_of(F.col("url")), r"^(www|m)\.", "").alias("entry")).where("entry IS NOT NULL").distinct()
    h = F.col("h_")
    listed = sites.withColumn("h_", _number(F.col("entry"))).where(h % 3 == 0)
    added = listed.select("entry", day(h % 150).alias("day"), F.lit("add").alias("action"))
    removed = listed.where(h % 9 == 0).select("entry", day(150 + h % 100).alias("day"), F.lit("remove").alias("action"))
    again = listed.where(h % 18 == 0).select("entry", day(260 + h % 90).alias("day"), F.lit("add").alias("action"))
    return captures, added.union(removed).union(again)


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's capture against the list as it stood that day."""
    out = blocked(*page_history(storage.table(spark, sf_dir, "pages")))
    return out.select("page_id", "url", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", "entry", F.col("since").cast("string").alias("since"))


ORACLE = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
  nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host FROM pages),
l AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT regexp_replace(host, '^(www|m)\.', '') AS entry FROM c WHERE host IS NOT NULL)),
i AS (SELECT entry, DATE '2024-01-01' + CAST(h % 150 AS INTEGER) AS since, CASE WHEN h % 9 = 0 THEN DATE '2024-01-01' + CAST(150 + h % 100 AS INTEGER) END AS until FROM l WHERE h % 3 = 0
  UNION ALL SELECT entry, DATE '2024-01-01' + CAST(260 + h % 90 AS INTEGER), NULL FROM l WHERE h % 18 = 0),
m AS (SELECT page_id, entry, since, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC) AS k FROM c JOIN i
  ON (host = entry OR ends_with(host, '.' || entry)) AND since <= fetched AND (until IS NULL OR fetched < until))
SELECT c.page_id, url, host, CAST(fetched AS VARCHAR) AS fetched, m.entry IS NOT NULL AS blocked, m.entry, CAST(m.since AS VARCHAR) AS since
FROM c LEFT JOIN m ON m.page_id = c.page_id AND k = 1
"""

"""Graphs as DataFrames, derived from tables.

edges: src, dst (long), both directions, no loops, no repeats. vertices: id, vlabel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import storage


def normalise(pairs: DataFrame) -> DataFrame:
    """edges of any pairs (src, dst): both directions, without loops, nulls and repeats."""
    pairs = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    once = pairs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return symmetric(once)


def symmetric(half: DataFrame) -> DataFrame:
    """edges of undirected ones (u, v), each of which is there once; no shuffle."""
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return half.select(both.alias("e")).select("e.src", "e.dst")


def co_purchase_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order, once each (u < v)."""
    items = storage.table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    parts = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_partkey").cast("long"))).alias("parts"))
    later = parts.select("parts", F.posexplode("parts").alias("i", "u")).select("u", F.explode(F.expr("slice(parts, i + 2, size(parts))")).alias("v"))
    return later.distinct()


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part co-purchase graph; each edge is written once."""
    half = storage.materialize(co_purchase_half(spark, sf_dir), "co")
    storage.release(spark)
    return symmetric(half)


def trail_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers (u < v): an order with its customer, with that customer's next order, and with the next of its priority.

    An order's vertex is twice its key, a customer's is one more than twice its own.
    """
    order, customer = F.col("o_orderkey").cast("long") * 2, F.col("o_custkey").cast("long") * 2 + 1
    rows = storage.table(spark, sf_dir, "orders").select(order.alias("o"), customer.alias("c"), "o_orderdate", "o_orderkey", "o_orderpriority")
    by_time = lambda *keys: Window.partitionBy(*keys).orderBy("o_orderdate", "o_orderkey")
    ends = rows.select("o", F.array("c", F.lead("o").over(by_time("c")), F.lead("o").over(by_time("c", "o_orderpriority"))).alias("ends"))
    pairs = ends.select("o", F.explode(F.array_distinct(F.array_compact("ends"))).alias("x"))
    return pairs.select(F.least("o", "x").alias("u"), F.greatest("o", "x").alias("v"))


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of orders and customers."""
    edges = storage.materialize(symmetric(trail_half(spark, sf_dir)), "trail")
    storage.release(spark)
    return edges


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """(id, vlabel): the rank of a name, from 1, among the distinct names, which are few."""
    kinds = rows.select(name).distinct().withColumn("vlabel", F.dense_rank().over(Window.orderBy(name)).cast("int"))
    return rows.join(kinds, name).select("id", "vlabel")


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertices: parts labelled by the rank of their type."""
    return _ranked(storage.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_type"), "p_type")


def trail_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertices: orders labelled by the rank of their priority, customers by that of their segment."""
    orders = storage.table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("long") * 2).alias("id"), "o_orderpriority")
    customers = storage.table(spark, sf_dir, "customer").select((F.col("c_custkey").cast("long") * 2 + 1).alias("id"), "c_mktsegment")
    return _ranked(orders, "o_orderpriority").union(_ranked(customers, "c_mktsegment"))


CO_HALF_SQL = """SELECT DISTINCT least(a.l_partkey, b.l_partkey)::BIGINT AS u, greatest(a.l_partkey, b.l_partkey)::BIGINT AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey"""
TRAIL_HALF_SQL = """SELECT DISTINCT least(o, x) AS u, greatest(o, x) AS v FROM (SELECT 2 * o_orderkey::BIGINT AS o,
unnest([2 * o_custkey::BIGINT + 1, lead(2 * o_orderkey::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), lead(2 * o_orderkey::BIGINT) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)]) AS x FROM orders) WHERE x IS NOT NULL"""
_LABELS_SQL = {
    "co": "SELECT p_partkey::BIGINT AS id, dense_rank() OVER (ORDER BY p_type)::INTEGER AS l FROM part",
    "trail": "SELECT 2 * o_orderkey::BIGINT AS id, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER AS l FROM orders UNION ALL SELECT 2 * c_custkey::BIGINT + 1, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER FROM customer",
}


def with_graph_sql(body: str, graph: str = "trail") -> str:
    """body over e (u < v), n (both directions, u and v), g (degrees: id, d), dag (from low to high degree) and vl (labels: id, l)."""
    half = TRAIL_HALF_SQL if graph == "trail" else CO_HALF_SQL
    return f"""WITH RECURSIVE e AS MATERIALIZED ({half}), n AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), g AS MATERIALIZED (SELECT u AS id, count(*) AS d FROM n GROUP BY u),
dag AS MATERIALIZED (SELECT n.u, n.v FROM n JOIN g a ON a.id = n.u JOIN g b ON b.id = n.v WHERE b.d > a.d OR (b.d = a.d AND n.v > n.u)), vl AS ({_LABELS_SQL[graph]}) {body}"""

"""Graphs from streams of edges with Structured Streaming.

The batch operators work on any DataFrame; these keep an edge table and degrees up to date
as edges arrive, so that they can be run on it at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.sources.graphs import normalise


def edge_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (src, dst) from a folder of parquet files."""
    reader = spark.readStream.schema("src long, dst long")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed_degrees(stream: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """(window, id, degree): edges at each vertex by window of event time; rows later than late are dropped."""
    ends = F.explode(F.array("src", "dst")).alias("id")
    rows = stream.where("src <> dst").withWatermark(time, late).select(time, ends)
    return rows.groupBy(F.window(time, length), "id").agg(F.count("*").alias("degree"))


def append_edges(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's edges that the table hasn't got yet, both directions; a batch that runs again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = normalise(batch)
        try:
            old = spark.read.schema("src long, dst long").parquet(table)
            new = new.join(old, ["src", "dst"], "left_anti")
        except Exception as e:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

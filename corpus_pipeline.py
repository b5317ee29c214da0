"""A training corpus from documents, in stages: quality rules, near-duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph import storage
from weftgraph.llm.decontam import decontaminate_stage
from weftgraph.llm.neardup import dedup_stage
from weftgraph.llm.packing import pack_stage
from weftgraph.llm.quality import quality_stage

#: (name, function of the session, the stage's documents and the folder of tables); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: Near-duplicates by MinHash and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table of documents; each result is written as parquet and read again."""
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.materialize(stage(spark, docs, sf_dir), name)
    return docs

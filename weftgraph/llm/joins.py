"""A join on a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage

#: Parts of one key's rows in a join that is not a broadcast.
SALTS = 64


def beside(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with few (materialized, narrow) on key; how is inner or left_semi.

    few is broadcast behind a check of its rows; beyond it the rows of one key are dealt in
    SALTS parts by a hash of the column by, and each row of few is repeated for every part.
    """
    if few.limit(storage.BROADCAST_ROWS + 1).count() <= storage.BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key, how)
    spread = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "salt_"], how).drop("salt_")

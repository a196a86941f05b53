"""Leaving out repeated rows without moving the rows that have no repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are broadcast, each of up to ``WIDTH`` bytes.
BROADCAST_KEYS, WIDTH = 200_000, 64


def distinct_by(df: DataFrame, key: str, limit: int = BROADCAST_KEYS, by: list[str] | None = None) -> DataFrame:
    """One row of ``df`` for each key, of repeats any; rows with a null key are left out.

    With ``by`` rows are repeats only if they agree in these columns, null being
    equal to null; ``key`` is then a hash of them or one of them.

    The repeated keys are counted first, over the key column alone. Up to ``limit``
    of them are broadcast: rows of other keys then stay where they are. With more,
    all rows are aggregated by key, partly before the shuffle, so that one key with
    very many repeats doesn't burden one task.
    """
    by = by or [key]
    df = df.where(F.col(key).isNotNull())
    repeated = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_k"))
    found = [r[0] for r in repeated.where(F.length(F.col("_k").cast("string")) <= WIDTH).limit(limit + 1).collect()]
    if not found:
        return df if repeated.isEmpty() else df.dropDuplicates(by)
    if len(found) > limit or not repeated.where(F.length(F.col("_k").cast("string")) > WIDTH).isEmpty():
        return df.dropDuplicates(by)
    few = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in found], repeated.schema))
    rest = df.join(few, F.col(key) == F.col("_k"), "left_anti")
    return rest.unionByName(df.join(few, F.col(key) == F.col("_k"), "left_semi").dropDuplicates(by))

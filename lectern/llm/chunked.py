"""Cutting very long texts into overlapping chunk rows, so that one text is worked on by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_rows(df: DataFrame, key: str, text: str, size: int, margin: int) -> DataFrame:
    """Rows ``(k, no, lo, hi, base, part)`` for the texts longer than ``size`` characters.

    Chunk ``no`` is responsible for the code points ``lo`` to ``hi`` of the text;
    ``part`` holds these and up to ``margin`` more on either side and begins at
    ``base``. The rows are spread by key and number, so that a single huge text
    doesn't stay in one task.
    """
    n = F.length("t")
    long = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(n > size)
    rows = long.select("k", "t", n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("no"))
    lo, hi = F.col("no") * size, F.least((F.col("no") + 1) * size, F.col("n"))
    base = F.greatest(lo - margin, F.lit(0))
    return rows.select("k", "no", lo.alias("lo"), hi.alias("hi"), base.alias("base"), F.expr("substring(t, greatest(no * {s} - {m}, 0) + 1, least((no + 1) * {s}, n) + {m} - greatest(no * {s} - {m}, 0))".format(s=size, m=margin)).alias("part")).repartition("k", "no")

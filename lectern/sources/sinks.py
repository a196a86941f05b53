"""Writers: papers by month, passages as JSON lines or Parquet, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_papers(df: DataFrame, path: str, as_json: bool = False, mode: str = "append") -> None:
    w = df.write.mode(mode).partitionBy("month_stratum")
    w.json(path) if as_json else w.parquet(path)


def write_passages(df: DataFrame, path: str, as_json: bool = True, mode: str = "overwrite", ordered: bool = False) -> None:
    """JSON lines leave out null fields, so that ``oversized`` is there only if it is true; ``ordered`` files are in the order of paper and passage."""
    df = df.orderBy("arxiv_id", "passage_id") if ordered else df
    df.write.mode(mode).json(path) if as_json else df.write.mode(mode).parquet(path)


def corpus_statistics(papers: DataFrame) -> DataFrame:
    """One row: papers, mean and median of their words."""
    return papers.agg(F.count("*").alias("papers"), F.bround(F.avg("total_words"), 1).alias("mean_words"), F.median("total_words").alias("median_words"))


def block_totals(papers: DataFrame) -> DataFrame:
    """``(type, blocks)`` over all papers."""
    return papers.select(F.explode("block_counts").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("blocks"))


def manifest(papers: DataFrame, skipped: DataFrame, shortfalls: list[tuple[str, int, int]], limit: int, spine: DataFrame | None = None) -> DataFrame:
    """One nested row: when and for how many papers; statistics with the totals of blocks, the months with their targets and
    those that weren't met; what fell short. Papers and skips stay tables of their own, which grow with the corpus.

    ``spine`` has months with quotas, a row each; without one the months are left empty.
    """
    spark = papers.sparkSession
    counted = papers if "block_counts" in papers.columns else papers.withColumn("block_counts", F.lit(None).cast("map<string,int>"))
    blocks = block_totals(counted).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "blocks")))).alias("blocks"))  # a few types
    s = corpus_statistics(papers).crossJoin(skipped.agg(F.count("*").alias("skipped"))).crossJoin(blocks)  # one row each
    kind = "array<struct<month:string,target:int,achieved:bigint,skipped:bigint,status:string>>"
    if spine is None:
        months = spark.createDataFrame([([],)], f"months {kind}")
    else:
        from ..operators.sampling import breakdown

        months = breakdown(spine, papers, skipped).agg(F.array_sort(F.collect_list(F.struct("month", "target", "achieved", "skipped", "status"))).alias("months"))
    log = spark.createDataFrame([Row(shortfalls=[Row(month=m, target=t, total=n) for m, t, n in shortfalls])], "shortfalls array<struct<month:string,target:int,total:int>>")
    unmet = F.filter("months", lambda m: m["achieved"] < m["target"])
    stats = F.struct("papers", "mean_words", "median_words", "skipped", "blocks", "months", unmet.alias("unmet_months"))
    return s.crossJoin(months).crossJoin(log).select(F.struct(F.current_timestamp().alias("created_at"), F.lit(limit).alias("limit")).alias("metadata"), stats.alias("stats"), "shortfalls")

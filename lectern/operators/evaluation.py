"""Comparing rankings: overlap, self-retrieval, variants, fusion and measures against judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame, query: str = "query_id", item: str = "passage_id") -> DataFrame:
    """``(query_id, common, jaccard)`` of two results: shared items, and their share of all; 0 where both are empty."""
    rows = a.select(query, item, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(query, item, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = rows.groupBy(query, item).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.groupBy(query).agg(F.sum(F.col("a") * F.col("b")).alias("common"), F.bround(F.sum(F.col("a") * F.col("b")) / F.count("*"), 6).alias("jaccard"))


def overlap_means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.bround(F.avg("common"), 4).alias("mean_common"), F.bround(F.avg("jaccard"), 4).alias("mean_jaccard"))


def compare_top(a: DataFrame, b: DataFrame, query: str = "query_id") -> DataFrame:
    """``(query_id, a, b, same)``: the first hits of two variants."""
    x = a.where("rank = 1").select(query, F.col("passage_id").alias("a"))
    y = b.where("rank = 1").select(query, F.col("passage_id").alias("b"))
    return x.join(y, query).withColumn("same", F.col("a") == F.col("b"))


def self_retrieval(results: DataFrame, n: int, query: str = "query_id", item: str = "passage_id") -> DataFrame:
    """One row: the shares of ``n`` queries, named by the passages they come from, whose passage is first, and among the first five."""
    hit = results.where(F.col(query) == F.col(item))
    return hit.agg(F.lit(n).alias("queries"), F.bround(F.count_if(F.col("rank") == 1) / F.lit(n), 4).alias("hit1"), F.bround(F.count_if(F.col("rank") <= 5) / F.lit(n), 4).alias("hit5"))


def type_histogram(results: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """``(type, hits)`` among the first ``k`` results of all queries."""
    return results.where(F.col("rank") <= k).join(passages.select("passage_id", "type"), "passage_id").groupBy("type").agg(F.count("*").alias("hits"))


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, c: int = 60, query: str = "query_id", item: str = "passage_id") -> DataFrame:
    """An extension: ``(query_id, passage_id, score)``, the sum of ``1 / (c + rank)`` over two results."""
    rows = a.select(query, item, "rank").unionByName(b.select(query, item, "rank"))
    return rows.groupBy(query, item).agg(F.bround(F.sum(1.0 / (c + F.col("rank"))), 8).alias("score"))


def measures(results: DataFrame, relevant: DataFrame, k: int = 10, query: str = "query_id", item: str = "passage_id") -> DataFrame:
    """An extension: one row with recall@k, MRR and nDCG@k over the queries that have relevant items."""
    rel = relevant.select(query, item).distinct()
    total = rel.groupBy(query).agg(F.count("*").alias("total"))
    hit = results.where(F.col("rank") <= k).join(rel, [query, item], "left_semi").groupBy(query).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k))).cast("array<double>"), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    rows = total.join(hit, query, "left").select((F.coalesce("hits", F.lit(0)) / F.col("total")).alias("r"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("m"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("g"))
    return rows.agg(F.count("*").alias("queries"), F.bround(F.avg("r"), 6).alias("recall"), F.bround(F.avg("m"), 6).alias("mrr"), F.bround(F.avg("g"), 6).alias("ndcg"))

"""Fingerprints, version gates, and indexes on disk."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RULES_VERSION
from .bm25 import Bm25Config, corpus_stats, indexed_text, postings


def row_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: number of rows, and an order-independent hash of the columns."""
    cols = columns or tuple(df.columns)
    h = F.xxhash64(*[F.col(c) for c in cols])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def text_fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, sha256)`` of each text; null for null."""
    return df.select(key, F.sha2(F.col(text), 256).alias("sha256"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of files of up to 2 GB; larger data have :func:`row_fingerprint`."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


class StaleIndex(ValueError):
    """The index was made by other rules or from other data."""


def check_index(meta: dict, fingerprint: str | None, strict: bool = True) -> None:
    """Refuse an index of another rules version; for another fingerprint refuse it if strict, else warn. What is absent passes."""
    if meta.get("rules_version") not in (None, RULES_VERSION):
        raise StaleIndex(f"the index has rules {meta['rules_version']}, not {RULES_VERSION}")
    if fingerprint is not None and meta.get("fingerprint") not in (None, fingerprint):
        if strict:
            raise StaleIndex("the passages changed since the index was made")
        warnings.warn("the passages changed since the index was made", stacklevel=2)


def passage_fingerprint(passages: DataFrame) -> str:
    r = row_fingerprint(passages, "passage_id", "content", "contextual_content").first()
    return f"{r['rows']}:{r['hash']}"


def save_bm25(passages: DataFrame, path: str, config: Bm25Config = Bm25Config()) -> None:
    """Write docs, statistics and postings, the latter sorted by term so that a query's terms prune row groups, and metadata."""
    spark = passages.sparkSession
    indexed = indexed_text(passages, config)
    indexed.select("passage_id", "length").write.mode("overwrite").parquet(f"{path}/docs")
    corpus_stats(indexed).write.mode("overwrite").parquet(f"{path}/stats")
    postings(indexed, config).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    meta = {"rules_version": RULES_VERSION, "fingerprint": passage_fingerprint(passages), "field": config.field, "types": list(config.types), "min_words": config.min_words, "k1": config.k1, "b": config.b, "tokenizer": config.tokenizer.to_dict()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_bm25(spark: SparkSession, path: str, passages: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """``(postings, docs, metadata)`` of a saved index, checked against the passages if they are given."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    check_index(meta, passage_fingerprint(passages) if passages is not None else None, strict)
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), meta


def save_vectors(vectors: DataFrame, path: str, model: str, revision: str = "", field: str = "content", fingerprint: str | None = None, prefix: str = "") -> None:
    """Write vectors, with the tokens of their texts if they are there, and metadata; ``prefix`` is what goes before queries."""
    vectors.select("passage_id", "embedding", *[c for c in ("n_tokens", "truncated") if c in vectors.columns]).write.mode("overwrite").parquet(f"{path}/vectors")
    meta = {"rules_version": RULES_VERSION, "fingerprint": fingerprint, "model": model, "revision": revision, "field": field, "prefix": prefix}
    vectors.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_vectors(spark: SparkSession, path: str, passages: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """``(vectors, metadata)``; null or repeated keys, another version or other passages are refused."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    check_index(meta, passage_fingerprint(passages) if passages is not None else None, strict=True)
    v = spark.read.parquet(f"{path}/vectors")
    bad = v.where("passage_id is null or embedding is null").select(F.lit(1)).union(v.groupBy("passage_id").count().where("count > 1").select(F.lit(1)))
    if not bad.isEmpty():
        raise StaleIndex("keys and vectors don't belong together")
    return v, meta


def to_encode(passages: DataFrame, done: DataFrame, model: str, field: str = "content") -> DataFrame:
    """Passages whose vectors must still be made: without a row in ``done`` of the same text, model, field and rules."""
    p = passages.select("passage_id", F.col(field).alias("text")).withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = done.where((F.col("model") == model) & (F.col("field") == field) & (F.col("rules_version") == RULES_VERSION)).select("passage_id", "text_hash")
    return p.join(same, ["passage_id", "text_hash"], "left_anti")

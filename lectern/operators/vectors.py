"""Vectors of a collection of passages: made in parts that are kept, resumed after a stop, put together in the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import RULES_VERSION
from . import dense, integrity

#: Tokens beyond which a model doesn't read a text, and the special tokens that count among them.
MOST_TOKENS, SPECIALS = 512, 2

CHECKPOINT = "passage_id string, text_hash string, model string, field string, rules_version string, n_tokens int, truncated boolean, embedding array<float>"


def word_counter() -> Callable[[list[str]], list[int]]:
    """Counts words, where no model's tokenizer is at hand."""
    return lambda texts: [len(t.split()) for t in texts]


def checkpoints(spark, path: str) -> DataFrame:
    """The rows of all parts that were written; none if there is no folder yet."""
    try:
        return spark.read.schema(CHECKPOINT).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CHECKPOINT)


def build(passages: DataFrame, path: str, make: Callable[[], dense.Encoder] = dense.hashing_encoder, model: str = "hashing", field: str = "content", limit: int | None = None, parts: int = 16, counter: Callable[[], Callable[[list[str]], list[int]]] = word_counter, most: int = MOST_TOKENS, revision: str = "", prefix: str = "") -> DataFrame:
    """Make and save the vectors of all passages, and give them.

    Passages are encoded in ``parts`` parts by the hash of their ids, each appended
    to ``path/checkpoints`` as a whole, so that a run that was stopped goes on with
    what is left: passages without a row of the same text, model, field and rules.
    In the end the rows that belong to the passages as they are now become the
    index ``path/vectors``. ``limit`` takes only the first passages by id, for
    trials. Texts are cleaned as for the lexical index; for each the model's tokens,
    special ones included, are counted. One row for each ``passage_id``; null ones
    are left out.
    """
    spark = passages.sparkSession
    p = passages.where("passage_id is not null").withColumn("_text", T.clean_latex(F.col(field)))
    if limit is not None:
        p = p.orderBy("passage_id").limit(limit)  # the feature
    rows = p.select("passage_id", F.col("_text").alias(field))
    store = f"{path}/checkpoints"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter()
        for b in batches:
            n = np.array(tokens([t or "" for t in b.column("text").to_pylist()]), np.int32) + SPECIALS
            yield pa.RecordBatch.from_arrays([b.column("passage_id"), b.column("text_hash"), pa.array(n, pa.int32()), b.column("text")], names=["passage_id", "text_hash", "n_tokens", "text"])

    for i in range(parts):
        own = rows.where(F.pmod(F.xxhash64("passage_id"), F.lit(parts)) == i)
        todo = integrity.to_encode(own, checkpoints(spark, store), model, field)
        if todo.isEmpty():
            continue
        counted = todo.mapInArrow(count, "passage_id string, text_hash string, n_tokens int, text string")
        made = dense.encode(counted.withColumn("k", F.struct("passage_id", "text_hash", "n_tokens")), "k", "text", make, name=model)
        made = made.select("k.passage_id", "k.text_hash", F.lit(model).alias("model"), F.lit(field).alias("field"), F.lit(RULES_VERSION).alias("rules_version"), "k.n_tokens", (F.col("k.n_tokens") > most).alias("truncated"), "embedding")
        made.write.mode("append").parquet(store)
    stacked = stack(rows, checkpoints(spark, store), model, field)
    integrity.save_vectors(stacked, path, model, revision, field, None if limit is not None else integrity.passage_fingerprint(passages), prefix=prefix)
    vectors, _ = integrity.load_vectors(spark, path)
    missing = rows.select("passage_id").distinct().join(vectors, "passage_id", "left_anti")
    if not missing.isEmpty():
        raise integrity.StaleIndex("passages without vectors")
    return vectors


def stack(rows: DataFrame, done: DataFrame, model: str, field: str = "content") -> DataFrame:
    """``(passage_id, embedding, n_tokens, truncated)``: of all parts the vectors that belong to the texts ``rows`` as they are now."""
    now = rows.select("passage_id", F.sha2(F.coalesce(F.col(field), F.lit("")), 256).alias("text_hash"))
    fits = done.where((F.col("model") == model) & (F.col("field") == field) & (F.col("rules_version") == RULES_VERSION))
    return fits.join(now, ["passage_id", "text_hash"], "left_semi").groupBy("passage_id").agg(*[F.any_value(c).alias(c) for c in ("embedding", "n_tokens", "truncated")])


def truncation(vectors: DataFrame, passages: DataFrame) -> DataFrame:
    """``(type, total, truncated, percent)`` of passages over the model's limit; the three usual types are there even without passages."""
    usual = passages.sparkSession.createDataFrame([("text",), ("table",), ("figure",)], "type string")
    rows = vectors.join(passages.select("passage_id", "type"), "passage_id").groupBy("type").agg(F.count("*").alias("total"), F.count_if("truncated").alias("truncated"))
    rows = rows.join(usual, "type", "full").select("type", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("truncated", F.lit(0)).alias("truncated"))
    return rows.withColumn("percent", F.bround(F.coalesce(F.try_divide(F.col("truncated") * F.lit(100.0), "total"), F.lit(0.0)), 2))

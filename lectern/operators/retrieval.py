"""One interface of all searches: a batch of query texts to ranked results with metadata."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bm25, dense, integrity


class Retriever(Protocol):
    """Whatever answers ``(query_id, query)`` with ``(query_id, passage_id, score, rank, metadata)``, the best ``k`` of each query."""

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


class Bm25Retriever:
    """Lexical search; a query without a known term, as a blank one, has no results."""

    def __init__(self, passages: DataFrame, config: bm25.Bm25Config = bm25.Bm25Config()):
        self.passages, self.config = passages, config
        self.indexed = bm25.indexed_text(passages, config)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return bm25.with_metadata(bm25.search(self.indexed, queries, k, self.config), self.passages)


class DenseRetriever:
    """Search by the vectors of query texts, which the encoder of the passages makes, after ``prefix``.

    The encoder is made in the workers when the first query is encoded. Blank
    queries are encoded as they are; ``k`` is at least 1.
    """

    def __init__(self, vectors: DataFrame, passages: DataFrame, make: Callable[[], dense.Encoder] = dense.hashing_encoder, name: str = "hashing", prefix: str = ""):
        self.vectors, self.passages, self.make, self.name, self.prefix = vectors, passages, make, name, prefix

    @classmethod
    def load(cls, path: str, passages: DataFrame, make: Callable[[], dense.Encoder] = dense.hashing_encoder) -> DenseRetriever:
        """A saved index, which must have been made from these passages."""
        vectors, meta = integrity.load_vectors(passages.sparkSession, path, passages)
        return cls(vectors, passages, make, meta["model"], meta.get("prefix") or "")

    def encode(self, queries: DataFrame) -> DataFrame:
        return dense.encode(queries, "query_id", "query", self.make, self.prefix, name=self.name)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        if self.vectors.isEmpty():
            raise ValueError("the index is empty")
        return bm25.with_metadata(dense.search(self.vectors, self.encode(queries), k), self.passages)

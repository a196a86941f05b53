"""Exact search by inner product over normalised vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Queries that are compared with all vectors at a time; each block is broadcast.
QUERY_BLOCK = 4096


class Encoder(Protocol):
    """What turns texts into vectors; made lazily, once in each worker."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


_MADE: dict[str, Encoder] = {}


def hashing_encoder(d: int = 64) -> Encoder:
    """A deterministic encoder without a model: signed hashes of words."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), d), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % d] += 1 if h >> 16 & 1 else -1
        return out

    return encode


def encode(df: DataFrame, key: str, text: str, make: Callable[[], Encoder] = hashing_encoder, prefix: str = "", batch: int = 32, name: str = "hashing") -> DataFrame:
    """``(<key>, embedding)``: normalised vectors of all texts, null ones as empty; a text without content has the zero vector.

    Batches are sorted by length before the encoder sees them, which spares padding.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MADE:
            _MADE[name] = make()
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(1).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            rows: list[np.ndarray | None] = [None] * len(texts)
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                x = _MADE[name]([texts[i] for i in part])
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                for i, r in zip(part, x):
                    rows[i] = r.astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "passage_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, passage_id, score, rank)``: the ``k`` vectors with the largest inner products, ``k`` at least 1.

    The queries are the query set, taken in blocks of QUERY_BLOCK rows. Each task
    multiplies a block with batches of vectors and keeps the best ``k`` of its own,
    so that only these are shuffled. Null vectors and those of another length than
    the queries' are left out; ties go to the smaller id.
    """
    k = max(1, k)
    spark = vectors.sparkSession
    kd, qd = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    schema = f"`{query_key}` {qd}, `{key}` {kd}, score double"
    qa, ka = to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(vectors.schema[key].dataType)
    found = None
    rows = queries.where(F.col(vector).isNotNull()).select(query_key, vector).toLocalIterator()
    while block := [r for _, r in zip(range(QUERY_BLOCK), rows)]:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], np.float64)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            ids_of = [np.empty(0, object)] * len(q)
            scores_of = [np.empty(0)] * len(q)
            for b in batches:
                v = b.column(1)
                fits = np.array([x is not None and len(x) == q.shape[1] for x in v.to_pylist()], bool) if v.null_count or b.num_rows and len(v.flatten()) != b.num_rows * q.shape[1] else np.ones(b.num_rows, bool)
                if not fits.any():
                    continue
                ids = np.array(b.column(0).to_pylist(), object)[fits]
                x = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                s = q @ x.T
                for i in range(len(q)):
                    row = s[i]
                    if len(row) > 4 * k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        at = np.flatnonzero(row >= least - 1e-9)
                    else:
                        at = np.arange(len(row))
                    a, c = np.concatenate([ids_of[i], ids[at]]), np.concatenate([scores_of[i], row[at]])
                    order = sorted(range(len(a)), key=lambda j: (-round(c[j], 9), a[j]))[:k]
                    ids_of[i], scores_of[i] = a[order], c[order]
            n = [len(a) for a in ids_of]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, m in zip(names, n) for _ in range(m)], qa), pa.array([x for a in ids_of for x in a], ka), pa.array(np.concatenate(scores_of) if scores_of else [], pa.float64())], names=[query_key, key, "score"])

        part = vectors.select(key, vector).mapInArrow(best, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

"""BM25 (Lucene's variant): statistics, weighted postings and batches of queries.

An index is three tables: ``docs`` (passage_id, length), ``stats`` (n, avgdl) and
``postings`` (term, passage_id, tf, df, weight). A search needs the postings of its
own terms only, so that without an index they are the only ones computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.stem import stem_tokens
from ..functions.text import TokenizerConfig, clean_latex, tokens

#: Distinct terms of all queries up to which they are broadcast.
BROADCAST_TERMS = 200_000
#: Passages and queries that are multiplied at a time.
BLOCK_ROWS, BLOCK_QUERIES = 1000, 256


@dataclass(frozen=True)
class Bm25Config:
    field: str = "content"
    types: tuple[str, ...] = ("text", "table", "figure")
    min_words: int = 0
    k1: float = 1.5
    b: float = 0.75
    tokenizer: TokenizerConfig = TokenizerConfig()
    #: Return the best document of a query none of whose terms occurs, with score 0.
    emit_zero_top1: bool = False


def indexed_text(passages: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """``(passage_id, tokens, length)`` of the passages that are indexed.

    Filtered by type and words, cleaned and tokenised; passages without tokens are
    left out before any statistic. An empty list of types means the three usual ones.
    """
    types = config.types or Bm25Config.types
    kept = passages.where(F.col("type").isin(*types) & (F.coalesce("word_count", F.lit(0)) >= config.min_words))
    cleaned = clean_latex(F.col(config.field))
    # a filter on the tokens would make Spark tokenise twice; a text has some if it has a letter or digit
    kept = kept.where(cleaned.rlike(r"[\p{L}\p{N}]"))
    rows = kept.select("passage_id", tokens(cleaned, config.tokenizer).alias("tokens"))
    if config.tokenizer.stemming:
        rows = stem_tokens(rows)
    if config.tokenizer.remove_stopwords:
        rows = rows.where(F.size("tokens") > 0)
    return rows.withColumn("length", F.size("tokens"))


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """One row: number of passages and their mean length."""
    return indexed.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))


def term_frequencies(indexed: DataFrame) -> DataFrame:
    """``(term, passage_id, length, tf)``."""
    return indexed.select("passage_id", "length", F.explode("tokens").alias("term")).groupBy("term", "passage_id", "length").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def weight(tf: Column, df: Column, length: Column, n: Column, avgdl: Column, config: Bm25Config = Bm25Config()) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + config.k1 * (1 - config.b + config.b * length / avgdl))


def postings(indexed: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """``(term, passage_id, tf, df, weight)`` of all terms."""
    tf = term_frequencies(indexed)
    rows = tf.join(document_frequencies(tf), "term").crossJoin(F.broadcast(corpus_stats(indexed)))  # statistics: one row
    return rows.select("term", "passage_id", "tf", "df", weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("avgdl"), config).alias("weight"))


def query_terms(queries: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """``(query_id, term, qtf)``; queries without terms have no rows. Queries are not cleaned."""
    rows = queries.select("query_id", tokens(F.col("query"), config.tokenizer).alias("tokens"))
    if config.tokenizer.stemming:
        rows = stem_tokens(rows)
    return rows.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is large in comparison with its input, which adaptive plans would gather in a few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ranked(scores: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """The ``k`` best of each query; ties go to the smaller id. Scores within 1e-6 count as ties."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "passage_id")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "passage_id", F.bround("score", digits).alias("score"), "rank")


def search(indexed: DataFrame, queries: DataFrame, k: int = 10, config: Bm25Config = Bm25Config()) -> DataFrame:
    """``(query_id, passage_id, score, rank)`` of a batch of queries ``(query_id, query)``.

    The terms of the queries are counted. If they are few (BROADCAST_TERMS rows of
    query and term) they go to all tasks, each of which multiplies blocks of
    passages with blocks of queries and keeps the best ``k``: passages aren't
    shuffled at all. Otherwise terms and passages are joined with a shuffle. Scores
    sum over query terms with their multiplicity; only positive scores come out,
    except with ``emit_zero_top1``. Passages must have one row each.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = query_terms(queries, config)
    few = asked.count()
    found = _block_scores(indexed, asked, k, config) if few <= BROADCAST_TERMS else _joined_scores(indexed, asked, config)
    return ranked(_with_zero(found, indexed, queries, config), k)


def _joined_scores(indexed: DataFrame, asked: DataFrame, config: Bm25Config) -> DataFrame:
    """All positive scores, by joins."""
    hits = indexed.select("passage_id", "length", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    # one shuffle: frequencies and scores keep a passage's rows together
    tf = hits.repartition(_tasks(indexed), "passage_id").groupBy("passage_id", "length", "term").agg(F.count("*").alias("tf"))
    rows = tf.join(document_frequencies(tf), "term").crossJoin(F.broadcast(corpus_stats(indexed)))  # statistics: one row
    return _scored(rows.select("term", "passage_id", weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("avgdl"), config).alias("weight")), asked)


def _block_scores(indexed: DataFrame, asked: DataFrame, k: int, config: Bm25Config) -> DataFrame:
    """The best ``k`` positive scores of each task for each query: no more than tasks times queries times ``k`` rows."""
    spark = indexed.sparkSession
    rows = asked.collect()  # at most BROADCAST_TERMS
    terms = sorted({r["term"] for r in rows})
    names = sorted({r["query_id"] for r in rows})
    qt, pt = asked.schema["query_id"].dataType, indexed.schema["passage_id"].dataType
    schema = f"query_id {qt.simpleString()}, passage_id {pt.simpleString()}, score double"
    if not rows:
        return spark.createDataFrame([], schema)
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in [*terms, ""]], "term string"))
    # frequencies and, with the empty term, the statistics of all passages in one pass
    each = indexed.select("length", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("term")).join(wanted, "term", "left_semi")
    counts = {r["term"]: (r["c"], r["l"]) for r in each.groupBy("term").agg(F.count("*").alias("c"), F.sum("length").alias("l")).collect()}
    if "" not in counts:
        return spark.createDataFrame([], schema)
    n, avgdl = counts[""][0], counts[""][1] / counts[""][0]
    place, number = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(names)}
    idf = [math.log(1 + (n - counts.get(t, (0, 0))[0] + 0.5) / (counts.get(t, (0, 0))[0] + 0.5)) for t in terms]
    entries = sorted((number[r["query_id"]], place[r["term"]], r["qtf"] * idf[place[r["term"]]]) for r in rows)
    shared = spark.sparkContext.broadcast((terms, names, np.array([e[0] for e in entries]), np.array([e[1] for e in entries]), np.array([e[2] for e in entries])))
    qa, ka = to_arrow_type(qt), to_arrow_type(pt)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, names, eq, et, ew = shared.value
        vocabulary = pa.array(terms)
        # of each query the best so far, and the score that others must reach
        held: list[list[tuple[float, object, float]]] = [[] for _ in names]
        floor = np.zeros(len(names))
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(lo, BLOCK_ROWS)
                ids = b.column(0).to_pylist()
                length = b.column(2).to_numpy().astype(np.float64)
                sizes = pc.list_value_length(b.column(1)).to_numpy().astype(np.int64)
                term = pc.fill_null(pc.index_in(b.column(1).flatten(), value_set=vocabulary), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(ids)), sizes)[term >= 0]
                term = term[term >= 0]
                cells, tf = np.unique(row * len(terms) + term, return_counts=True)
                row, term = np.divmod(cells, len(terms))
                used, col = np.unique(term, return_inverse=True)
                w = np.zeros((len(ids), len(used)))
                w[row, col] = tf / (tf + config.k1 * (1 - config.b + config.b * length[row] / avgdl))
                local = np.full(len(terms), -1)
                local[used] = np.arange(len(used))
                for q0 in range(0, len(names), BLOCK_QUERIES):
                    part = slice(*np.searchsorted(eq, [q0, q0 + BLOCK_QUERIES]))
                    there = local[et[part]] >= 0
                    m = np.zeros((len(used), min(BLOCK_QUERIES, len(names) - q0)))
                    m[local[et[part]][there], eq[part][there] - q0] = ew[part][there]
                    s = (w @ m).T
                    rounded = np.round(s, 6)
                    if s.shape[1] > k:
                        # nothing below the block's own k-th score either
                        least = np.maximum(floor[q0 : q0 + len(s)], np.partition(rounded, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                    else:
                        least = floor[q0 : q0 + len(s)]
                    j, i = np.nonzero((rounded >= least[:, None]) & (s > 0))
                    edges = np.searchsorted(j, np.arange(len(s) + 1))
                    for q in np.unique(j).tolist():
                        at = i[edges[q] : edges[q + 1]]
                        mine = held[q0 + q] + [(-rounded[q, x], ids[x], s[q, x]) for x in at.tolist()]
                        held[q0 + q] = mine = sorted(mine, key=lambda e: e[:2])[:k]
                        if len(mine) == k:
                            floor[q0 + q] = -mine[-1][0]
        n = [len(h) for h in held]
        rows_ = [e for h in held for e in h]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, m in zip(names, n) for _ in range(m)], qa), pa.array([e[1] for e in rows_], ka), pa.array([e[2] for e in rows_], pa.float64())], names=["query_id", "passage_id", "score"])

    return indexed.select("passage_id", "tokens", "length").mapInArrow(score, schema)


def search_index(postings_df: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, config: Bm25Config = Bm25Config()) -> DataFrame:
    """The same from a saved index."""
    asked = query_terms(queries, config)
    return ranked(_with_zero(_scored(postings_df, _small(asked, asked.count(), BROADCAST_TERMS)), docs, queries, config), k)


def _scored(weighted: DataFrame, asked: DataFrame) -> DataFrame:
    return weighted.join(asked, "term").groupBy("query_id", "passage_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score")).where(F.col("score") > 0)


def _with_zero(scores: DataFrame, docs: DataFrame, queries: DataFrame, config: Bm25Config) -> DataFrame:
    if not config.emit_zero_top1:
        return scores
    first = docs.agg(F.min("passage_id").alias("passage_id"))
    none = query_terms(queries, config).select("query_id").distinct().join(scores.select("query_id").distinct(), "query_id", "left_anti")
    return scores.unionByName(none.crossJoin(F.broadcast(first)).select("query_id", "passage_id", F.lit(0.0).alias("score")))  # one row


def with_metadata(results: DataFrame, passages: DataFrame) -> DataFrame:
    """Results with the metadata of their passages, joined after the top k."""
    meta = passages.select("passage_id", F.struct("arxiv_id", "title", "section_id", "section_path", "type", "word_count", F.substring("content", 1, 250).alias("content_snippet")).alias("metadata"))
    return results.join(meta, "passage_id", "left").select("query_id", "passage_id", "score", "rank", "metadata")

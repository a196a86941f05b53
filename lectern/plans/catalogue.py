"""All queries of the core over the test tables, and the SQL they are checked against."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import htmlparse, stem
from ..functions import text as T
from ..operators import bm25, chunking, dense, evaluation, integrity, quality, sampling
from ..operators.distinct import distinct_by
from ..sources import readers, sinks
from ..sources.tables import table
from ..streaming import incremental
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}

#: The sample of passages that ask for themselves, and its seed.
SELF_QUERIES, SEED = 200, 42
LIMIT = 300
NO_COMPOUND = T.TokenizerConfig(preserve_compound=False)
STOPPED = T.TokenizerConfig(remove_stopwords=True)


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def passages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Passages, each once."""
    p = table(spark, d, "passages", heavy=True)
    return distinct_by(p.select("passage_id", *columns) if columns else p, "passage_id")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return distinct_by(table(spark, d, "parsed_papers", heavy=True), "arxiv_id")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _indexed(spark: SparkSession, d: str, config: bm25.Bm25Config = bm25.Bm25Config()) -> DataFrame:
    return bm25.indexed_text(passages(spark, d, "type", "word_count", config.field), config)


CONTEXT = bm25.Bm25Config(field="contextual_content")


# text functions


@query
def clean_latex(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d, "content").select("passage_id", T.clean_latex(F.col("content")).alias("cleaned"))


@query
def clean_latex_strict(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d, "content").select("passage_id", T.clean_latex_strict(F.col("content")).alias("cleaned"))


def _tokens(spark: SparkSession, d: str, config: T.TokenizerConfig) -> DataFrame:
    return table(spark, d, "documents", heavy=True).select("doc_id", F.array_join(T.tokens(F.col("text"), config), " ").alias("tokens"))


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, T.TokenizerConfig())


@query
def tokenize_no_compound(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, NO_COMPOUND)


@query
def tokenize_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, STOPPED)


@query
def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    return stem.stemmed_terms(_indexed(spark, d).select(F.explode("tokens").alias("term")))


@query
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d, "content").select("passage_id", F.posexplode(T.sentences(F.col("content"))).alias("pos", "sentence"))


@query
def ngram8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", heavy=True).select("doc_id", F.explode(T.ngrams(T.words(F.lower("text")))).alias("gram")).groupBy("doc_id").agg(F.count("*").alias("grams"), F.countDistinct("gram").alias("different"))


@query
def snippets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return passages(spark, d, "content").select("passage_id", T.middle(c).alias("middle"), T.preview(c, 120).alias("preview"), T.first_words(c).alias("first"), T.word_count(c).alias("words"))


# lexical search


@query
def index_filter_project(spark: SparkSession, d: str) -> DataFrame:
    p = passages(spark, d, "type", "word_count", "content").where(F.col("type").isin("text", "figure") & (F.coalesce("word_count", F.lit(0)) >= 60))
    return p.select("passage_id", "type", F.coalesce("word_count", F.lit(0)).alias("words"), F.substring("content", 1, 250).alias("content_snippet"))


@query
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_stats(_indexed(spark, d)).select("n", F.bround("avgdl", 6).alias("avgdl"))


@query
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return bm25.document_frequencies(bm25.term_frequencies(_indexed(spark, d)))


@query
def bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings(_indexed(spark, d)).select("term", "passage_id", "tf", "df", F.round("weight", 6).alias("weight"))


@query
def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(_indexed(spark, d), items(spark, d), 10)


@query
def bm25_contextual_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(_indexed(spark, d, CONTEXT), items(spark, d), 10, CONTEXT)


@query
def bm25_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    found = bm25.with_metadata(bm25.search(_indexed(spark, d), items(spark, d), 5), passages(spark, d))
    return found.select("query_id", "passage_id", "rank", F.col("metadata.title").alias("title"), F.col("metadata.section_path").alias("section_path"), F.col("metadata.content_snippet").alias("content_snippet"))


@query
def bm25_variant_compare(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.compare_top(bm25_batch_topk(spark, d), bm25_contextual_topk(spark, d))


@query
def bm25_top5_type_hist(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.type_histogram(bm25_batch_topk(spark, d), passages(spark, d, "type"))


@query
def retriever_overlap(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overlap(bm25_batch_topk(spark, d), bm25_contextual_topk(spark, d))


@query
def retriever_overlap_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overlap_means(retriever_overlap(spark, d))


@query
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.reciprocal_rank_fusion(bm25_batch_topk(spark, d), bm25_contextual_topk(spark, d))


def _own_queries(spark: SparkSession, d: str) -> DataFrame:
    """The first words of a seeded sample of long enough text passages (the sample is the feature)."""
    long = passages(spark, d, "type", "content").where((F.col("type") == "text") & (T.word_count(F.col("content")) >= 15))
    return sampling.seeded_rows(long, SELF_QUERIES, "passage_id", SEED).select(F.col("passage_id").alias("query_id"), T.first_words(F.col("content")).alias("query"))


@query
def self_retrieval(spark: SparkSession, d: str) -> DataFrame:
    found = bm25.search(_indexed(spark, d), _own_queries(spark, d), 5)
    return evaluation.self_retrieval(found, SELF_QUERIES)


@query
def self_retrieval_measures(spark: SparkSession, d: str) -> DataFrame:
    q = _own_queries(spark, d)
    return evaluation.measures(bm25.search(_indexed(spark, d), q, 10), q.select("query_id", F.col("query_id").alias("passage_id")))


# dense search


@query
def dense_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("passage_id"), "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the query set
    return dense.search(v, q, 5).select("query_id", "passage_id", F.round("score", 6).alias("score"), "rank")


@query
def dense_self_retrieval(spark: SparkSession, d: str) -> DataFrame:
    hits = dense_batch_topk(spark, d).where("query_id = passage_id")
    return hits.agg(F.count("*").alias("queries"), F.count_if(F.col("rank") == 1).alias("first"))


@query
def encode_passages(spark: SparkSession, d: str) -> DataFrame:
    e = dense.encode(passages(spark, d, "content"), "passage_id", "content")
    return e.select("passage_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm2"))


# sections and passages


@query
def section_path(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_paths(parsed(spark, d))


@query
def pack_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack_plain(table(spark, d, "documents", heavy=True), "doc_id", "text")


@query
def chunk_papers(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_papers(parsed(spark, d))


@query
def chunk_papers_errors(spark: SparkSession, d: str) -> DataFrame:
    p = parsed(spark, d)
    return chunking.isolation_errors(chunking.chunk_papers(p), p)


@query
def table_markdown_split(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.chunk_papers(parsed(spark, d)).where("type = 'table'")
    return made.groupBy("arxiv_id").agg(F.count("*").alias("pieces"), F.max("word_count").alias("most"))


@query
def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    return chunking.report(passages(spark, d, "type", "word_count"))


@query
def chunk_isolation(spark: SparkSession, d: str) -> DataFrame:
    return chunking.isolation_errors(passages(spark, d, "arxiv_id", "section_id", "block_range"), parsed(spark, d))


@query
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    p = passages(spark, d, "title", "section_path", "content", "arxiv_id", "section_id")
    return p.select("passage_id", F.concat(F.lit("Document: "), "title", F.lit("\nSection: "), "section_path", F.lit("\n\n"), "content").alias("contextual"), F.concat(F.lit("https://arxiv.org/html/"), "arxiv_id", F.lit("#"), "section_id").alias("url"))


@query
def equation_threshold(spark: SparkSession, d: str) -> DataFrame:
    b = quality.blocks(parsed(spark, d)).where("type = 'equation'")
    return b.select("arxiv_id", "s", "b", F.when(F.length("content") - 4 > htmlparse.EQUATION_LIMIT, htmlparse.MARKER).otherwise(F.col("content")).alias("shown"))


@query
def parse_rendered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Papers rendered as pages and parsed again: blocks by type."""
    cell = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = lambda b: F.when(b["type"] == "figure", F.concat(F.lit("<figure class='ltx_figure'><figcaption>"), cell(b["content"]), F.lit("</figcaption></figure>"))).otherwise(F.concat(F.lit("<p>"), cell(b["content"]), F.lit("</p>")))
    section = lambda s: F.concat(F.lit("<section id='"), F.coalesce(s["section_id"], F.lit("")), F.lit("'><h2>"), cell(F.coalesce(s["heading"], F.lit(""))), F.lit("</h2>"), F.array_join(F.transform(s["blocks"], block), ""), F.lit("</section>"))
    pages = parsed(spark, d).select("arxiv_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("sections", section), ""), F.lit("</body></html>")).alias("html"))
    p = htmlparse.parse_pages(pages)
    return p.select("arxiv_id", F.size("sections").alias("sections"), "total_words", *[F.element_at("block_counts", F.lit(k)).alias(k) for k in ("text", "figure", "table", "equation")])


# reports


@query
def dup_ids(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_ids(table(spark, d, "papers"))


@query
def dup_titles(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_titles(parsed(spark, d))


@query
def short_papers(spark: SparkSession, d: str) -> DataFrame:
    return quality.short_papers(parsed(spark, d))


@query
def empty_blocks(spark: SparkSession, d: str) -> DataFrame:
    return quality.empty_blocks(parsed(spark, d))


@query
def residual_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", heavy=True).select("doc_id", F.array_join(T.residual_tags(F.col("text")), ",").alias("tags")).where("tags <> ''")


@query
def residual_markup(spark: SparkSession, d: str) -> DataFrame:
    return quality.residual_markup(parsed(spark, d))


@query
def table_outliers(spark: SparkSession, d: str) -> DataFrame:
    return quality.table_outliers(parsed(spark, d), least=1, factor=1.0)


@query
def ngram8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.gram_coverage(parsed(spark, d), passages(spark, d, "arxiv_id", "section_id", "type", "content"))


@query
def ngram8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return quality.gram_leaks(parsed(spark, d), passages(spark, d, "arxiv_id", "section_id", "type", "content"))


@query
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return quality.size_buckets(passages(spark, d, "word_count"))


def _noise(spark: SparkSession, d: str) -> DataFrame:
    return quality.latex_noise(passages(spark, d, "type", "content"))


@query
def latex_noise(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d)


@query
def latex_noise_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.noise_summary(_noise(spark, d))


@query
def latex_noise_groups(spark: SparkSession, d: str) -> DataFrame:
    return quality.noise_groups(_noise(spark, d))


@query
def latex_noise_papers(spark: SparkSession, d: str) -> DataFrame:
    return quality.top_papers(_noise(spark, d))


@query
def truncation_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.truncation(passages(spark, d, "type", "content"))


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return sinks.corpus_statistics(parsed(spark, d))


@query
def block_totals(spark: SparkSession, d: str) -> DataFrame:
    return sinks.block_totals(parsed(spark, d))


# planning


@query
def month_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_rows(sampling.month_spine(spark), LIMIT)


@query
def month_quotas_small(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_rows(sampling.month_spine(spark), 7)


@query
def monthly_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return sampling.breakdown(month_quotas(spark, d), parsed(spark, d), table(spark, d, "skipped_papers"))


@query
def monthly_search(spark: SparkSession, d: str) -> DataFrame:
    """One month of the tables' own categories (the month and the phrase are the feature)."""
    return table(spark, d, "papers").where(sampling.monthly_predicate(2024, 5, ("xx.RET", "xx.TXT"), "retriev")).select("arxiv_id", "published").distinct()


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where("arxiv_id is not null").groupBy("arxiv_id").agg(F.min("month_stratum").alias("month_stratum"))


@query
def stratified_take(spark: SparkSession, d: str) -> DataFrame:
    taken, _ = sampling.stratified_take(_candidates(spark, d), sampling.quotas(LIMIT, sampling.months()), LIMIT)
    return taken.select("arxiv_id", "month_stratum", "rank_in_month")


@query
def shortfalls(spark: SparkSession, d: str) -> DataFrame:
    _, p = sampling.stratified_take(_candidates(spark, d), sampling.quotas(LIMIT, sampling.months()), LIMIT)
    return spark.createDataFrame(p.shortfalls, "month string, target int, total int")


@query
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return readers.unprocessed(table(spark, d, "papers").select("arxiv_id"), table(spark, d, "parsed_papers"))


@query
def processed_months(spark: SparkSession, d: str) -> DataFrame:
    return readers.processed_months(table(spark, d, "parsed_papers"))


@query
def text_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return integrity.text_fingerprints(table(spark, d, "documents", heavy=True), "doc_id", "text")


@query
def entry_columns(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "papers").select(F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id").alias("id"), "title", "summary", "published", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"), F.transform("categories", lambda c: F.struct(c.alias("_term"))).alias("category"))
    return readers.entry_columns(raw).select("arxiv_id", "clean_id", "title", "month_stratum", F.size("authors").alias("authors"), F.array_join("categories", " ").alias("categories")).distinct()


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = incremental.late_counts(table(spark, d, "events"))
    return e.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return oracle.queries()

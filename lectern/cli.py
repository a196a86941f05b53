"""Command line: ``python -m lectern.cli COMMAND``; exit code 1 if a check fails."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from .functions.htmlparse import parse_pages
from .operators import bm25, chunking, dense, evaluation, integrity, quality, retrieval, sampling, vectors
from .operators.distinct import distinct_by
from .session import session
from .sources import readers, sinks


def _papers(spark, path: str):
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else readers.papers(spark, path, drop_bad=True)
    return distinct_by(df, "arxiv_id")


def _passages(spark, path: str):
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else readers.passages(spark, path)
    return distinct_by(df, "passage_id")


def ingest(spark, a) -> int:
    """Plan a stratified sample of landed entries and parse their landed pages."""
    entries = readers.entries(spark, a.entries)
    quota = sampling.quotas(a.limit, sampling.months())
    taken, plan = sampling.stratified_take(entries, quota, a.limit, order=[F.col("published"), F.col("arxiv_id")])
    parsed = parse_pages(readers.pages(spark, a.pages), flat=a.flat)
    papers = taken.drop("rank_in_month", "summary").join(parsed, "arxiv_id")
    sinks.write_papers(papers, f"{a.data_dir}/papers", as_json=a.json, mode="overwrite")
    lost = taken.join(parsed.select("arxiv_id"), "arxiv_id", "left_anti").select("arxiv_id", "title", "month_stratum", F.lit("no page").alias("reason"))
    spine = sampling.quota_rows(sampling.month_spine(spark), a.limit)
    sinks.manifest(papers, lost, plan.shortfalls, a.limit, spine).write.mode("overwrite").json(f"{a.data_dir}/manifest")
    lost.write.mode("overwrite").json(f"{a.data_dir}/skipped")
    sampling.breakdown(spine, papers, lost).orderBy("month").show(24, truncate=False)
    return 0


def chunk(spark, a) -> int:
    papers = _papers(spark, a.processed_dir)
    config = chunking.ChunkConfig(a.target_words, a.max_words, a.min_words, a.overlap)
    sinks.write_passages(chunking.chunk_papers(papers, config), a.output, as_json=not a.output.endswith(".parquet"), ordered=True)
    made = _passages(spark, a.output)
    chunking.report(made, config).show(truncate=False)
    errors = chunking.isolation_errors(made, papers).agg(F.coalesce(F.sum("errors"), F.lit(0))).first()[0]
    print(f"isolation errors: {errors}")
    return int(errors > 0)


def check_chunks(spark, a) -> int:
    papers, passages = _papers(spark, a.processed_dir), _passages(spark, a.passages)
    c = quality.gram_coverage(papers, passages).first()
    leaks = quality.gram_leaks(papers, passages).agg(F.coalesce(F.sum("leaks"), F.lit(0))).first()[0]
    bad = chunking.isolation_errors(passages, papers).count()
    quality.size_buckets(passages).show()
    print(f"8-grams covered: {c['percent']} %; leaks: {leaks}; bad ranges: {bad}")
    return int((c["percent"] or 0) < 100 or leaks > 0 or bad > 0)


def check_corpus(spark, a) -> int:
    papers = readers.papers(spark, a.processed_dir) if not a.processed_dir.endswith(".parquet") else spark.read.parquet(a.processed_dir)
    for name, f in (("repeated ids", quality.duplicate_ids), ("repeated titles", quality.duplicate_titles), ("short papers", quality.short_papers), ("markup left", quality.residual_markup), ("empty sections or blocks", quality.empty_blocks), ("papers with many tables", quality.table_outliers)):
        rows = f(papers)
        print(f"{name}: {rows.count()}")
        (rows.orderBy(F.desc("tables"), "arxiv_id") if "tables" in rows.columns else rows).show(5)
    return 0


def latex_noise(spark, a) -> int:
    noise = quality.latex_noise(_passages(spark, a.passages))
    quality.noise_summary(noise).show()
    quality.noise_groups(noise).show()
    quality.top_papers(noise).show()
    return 0


def index(spark, a) -> int:
    integrity.save_bm25(_passages(spark, a.passages), a.output, bm25.Bm25Config(field=a.field, min_words=a.min_words))
    return 0


def search(spark, a) -> int:
    postings, docs, _ = integrity.load_bm25(spark, a.index)
    bm25.search_index(postings, docs, spark.createDataFrame(list(enumerate(a.query)), "query_id int, query string"), a.k).orderBy("query_id", "rank").show(a.k * len(a.query), truncate=False)
    return 0


def _queries(spark, texts: list[str]):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def dense_build(spark, a) -> int:
    """Make the vectors, going on where an earlier run stopped; the encoder is the one that needs no model."""
    began = time.perf_counter()
    passages = _passages(spark, a.passages)
    made = vectors.build(passages, a.output, field=a.field, limit=a.limit or None, parts=a.parts, prefix=a.prefix, revision=a.revision)
    vectors.truncation(made, passages).orderBy("type").show()
    print(f"{made.count()} vectors in {time.perf_counter() - began:.1f} s")
    return 0


def dense_search(spark, a) -> int:
    """The results of queries by vectors, and what they have in common with those by terms."""
    passages = _passages(spark, a.passages)
    q = _queries(spark, a.query)
    found = retrieval.DenseRetriever.load(a.index, passages).search(q, a.k)
    found.orderBy("query_id", "rank").select("query_id", "rank", "score", "passage_id", "metadata.title", "metadata.section_path").show(a.k * len(a.query), truncate=60)
    evaluation.overlap(found, retrieval.Bm25Retriever(passages).search(q, a.k)).orderBy("query_id").show()
    return 0


def encode_benchmark(spark, a) -> int:
    """Passages a second by batches of some sizes, over a seeded sample."""
    rows = sampling.seeded_rows(_passages(spark, a.passages).select("passage_id", a.field), a.sample, "passage_id").cache()
    n = rows.count()
    for batch in (8, 32, 128):
        began = time.perf_counter()
        dense.encode(rows, "passage_id", a.field, batch=batch).write.format("noop").mode("overwrite").save()
        print(f"batch {batch}: {n / (time.perf_counter() - began):.0f} passages a second")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lectern")
    s = p.add_subparsers(required=True)

    def command(f, **options):
        c = s.add_parser(f.__name__.replace("_", "-"))
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            if isinstance(v, type):
                c.add_argument(flag, type=v, required=True)
            elif isinstance(v, bool):
                c.add_argument(flag, action="store_true")
            elif isinstance(v, list):
                c.add_argument(flag, nargs="+", required=True)
            else:
                c.add_argument(flag, type=type(v), default=v)
        c.set_defaults(run=f)

    command(ingest, entries=str, pages=str, limit=5, data_dir="data", flat="body", json=False)
    command(chunk, processed_dir=str, output=str, target_words=250, max_words=350, min_words=60, overlap=40)
    command(check_chunks, processed_dir=str, passages=str)
    command(check_corpus, processed_dir=str)
    command(latex_noise, passages=str)
    command(index, passages=str, output=str, field="content", min_words=0)
    command(search, index=str, query=[], k=5)
    command(dense_build, passages=str, output=str, field="content", limit=0, parts=16, prefix="", revision="")
    command(dense_search, index=str, passages=str, query=[], k=5)
    command(encode_benchmark, passages=str, field="content", sample=200)
    a = p.parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())

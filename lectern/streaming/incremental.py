"""Incremental runs: landed pages or papers to passages, each once, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.htmlparse import parse_pages
from ..operators.chunking import ChunkConfig, chunk_papers


def chunk_batch(papers: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    return chunk_papers(papers.dropDuplicates(["arxiv_id"]), config)


def chunk_stream(spark: SparkSession, source: str, target: str, checkpoint: str, config: ChunkConfig = ChunkConfig(), files: int = 1000):
    """Passages of the papers (Parquet) that arrived in ``source`` since the last run, written to ``target`` by batch.

    The checkpoint remembers what was read. Each batch has a folder of its own,
    which a repeated batch overwrites, so that nothing is written twice after a
    failure. The ids of all papers read, with or without passages, are kept beside
    them in ``<target>_done``, by which papers of earlier batches are left out.
    """
    done = f"{target.rstrip('/')}_done"
    stream = spark.readStream.schema(schemas.PAPER).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.dropDuplicates(["arxiv_id"])
        if number:
            earlier = session.read.schema("arxiv_id string, batch bigint").parquet(done).where(F.col("batch") < number).select("arxiv_id")
            fresh = fresh.join(earlier, "arxiv_id", "left_anti")
        chunk_papers(fresh, config).write.mode("overwrite").parquet(f"{target}/batch={number}")
        fresh.select("arxiv_id").write.mode("overwrite").parquet(f"{done}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Sections of the pages ``(arxiv_id, html)`` (Parquet) that arrived since the last run, appended to ``target``."""
    pages = spark.readStream.schema("arxiv_id string, html string").parquet(source)
    return parse_pages(pages).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and time window, of a stream or a table; in a stream, what comes later than ``delay`` is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")

"""Readers with fixed schemas, and fetching with a landing folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def papers(spark: SparkSession, path: str, drop_bad: bool = False) -> DataFrame:
    """Parsed papers from a folder of JSON files, one a paper; ``drop_bad`` leaves out malformed ones, else they are null rows."""
    mode = "DROPMALFORMED" if drop_bad else "PERMISSIVE"
    return spark.read.schema(schemas.PAPER).option("multiLine", True).option("mode", mode).json(path)


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages from JSON lines; blank lines are passed over, absent fields are null."""
    return spark.read.schema(schemas.PASSAGE).json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """``(arxiv_id, html)`` from a folder of HTML files named by id."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.html?$", 1)
    return spark.read.option("wholetext", True).text(path).select(F.url_decode(name).alias("arxiv_id"), F.col("value").alias("html"))


def entries(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """API entries from Atom XML files, with the row's ``month`` as stratum if given, else the month of publication."""
    author = "array<struct<name:string>>"
    category = "array<struct<_term:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(f"id string, title string, summary string, published string, author {author}, category {category}").load(path)
    return entry_columns(raw, month)


#: What an entry of a feed has.
_ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>"


def search_pages(spark: SparkSession, queries: list[str], get: Callable[[str, int, int], str], page: int = 50, most: int = 1000, tries: int = 3, pause: float = 3.0, wait: float = 5.0) -> DataFrame:
    """``(query, start, body)``: the pages of the results of each query, asked for one after another.

    ``get`` gives the feed of a query from ``start`` on, ``page`` entries of it. It
    is asked again after an exception, after ``wait`` seconds times the number of
    failures; after ``tries`` failures the query has no further pages. A page with
    fewer entries is the last one; ``most`` entries are asked for. One task keeps
    ``pause`` seconds between requests, as the server wants it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        last = 0.0
        for b in batches:
            for q in b.column(0).to_pylist():
                for start in range(0, most, page):
                    body = None
                    for attempt in range(tries):
                        time.sleep(max(0.0, last + pause - time.time()))
                        last = time.time()
                        try:
                            body = get(q, start, min(page, most - start))
                            break
                        except Exception:  # noqa: BLE001 - a failed request is asked again
                            if attempt + 1 < tries:
                                time.sleep(wait * (attempt + 1))
                    if body is None:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([start], pa.int32()), pa.array([body])], names=["query", "start", "body"])
                    if body.count("<entry") < page:
                        break

    return spark.createDataFrame([(q,) for q in queries], "query string").coalesce(1).mapInArrow(run, "query string, start int, body string")


def searched(pages_: DataFrame, month: str | None = None) -> DataFrame:
    """The entries of :func:`search_pages`, each once, in the schema of papers; a page that isn't XML has none."""
    schema = f"entry array<struct<{_ENTRY.replace(' string', ':string').replace(' array', ':array')}>>"
    found = pages_.select(F.explode(F.from_xml("body", schema)["entry"]).alias("x")).select("x.*").where("id is not null")
    return entry_columns(found, month).dropDuplicates(["arxiv_id"])


def entry_columns(raw: DataFrame, month: str | None = None) -> DataFrame:
    """Entries in the schema of papers; a missing title is ``Untitled``, a missing publication the stratum ``unknown``."""

    def tidy(c: str):
        return F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " "))

    aid = F.element_at(F.split("id", "/abs/"), -1)
    stratum = F.lit(month) if month else F.when(F.length(F.coalesce("published", F.lit(""))) >= 7, F.substring("published", 1, 7)).otherwise("unknown")
    return raw.select(
        aid.alias("arxiv_id"), F.substring_index(aid, "v", 1).alias("clean_id"), F.coalesce(F.nullif(tidy("title"), F.lit("")), F.lit("Untitled")).alias("title"), F.col("published"),
        F.coalesce(F.transform("author", lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"), F.coalesce(F.transform("category", lambda c: c["_term"]), F.array().cast("array<string>")).alias("categories"),
        F.coalesce(tidy("summary"), F.lit("")).alias("summary"), F.concat(F.lit("https://arxiv.org/html/"), aid).alias("html_url"), stratum.alias("month_stratum"),
    )


def skipped(spark: SparkSession, path: str, manifest: str | None = None) -> DataFrame:
    """The log of skipped papers, or the manifest's list if the log can't be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.SKIPPED).option("multiLine", True).json(path)
    except AnalysisException:
        if manifest is None:
            raise
        m = spark.read.schema(f"skipped_papers array<struct<{schemas.SKIPPED.replace(' string', ':string')}>>").option("multiLine", True).json(manifest)
        return m.select(F.explode("skipped_papers").alias("x")).select("x.*")


def unprocessed(candidates: DataFrame, done: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Candidates that aren't done, each once."""
    return candidates.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def fetch(candidates: DataFrame, landed: DataFrame, get: Callable[[str], tuple[int, str]], key: str = "arxiv_id", url: str = "html_url", tries: int = 2, pause: float = 3.0, lanes: int = 1) -> DataFrame:
    """``(arxiv_id, html, status)`` of the candidates that haven't landed yet.

    ``get`` is asked again after an exception, not after another status; only
    pages with status 200 that look like HTML have a text. ``lanes`` tasks, each
    with a pause between requests, bound the load on the server.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        last = 0.0
        for b in batches:
            html, status = [], []
            for u in b.column(1).to_pylist():
                code, body = 0, ""
                for _ in range(tries):
                    time.sleep(max(0.0, last + pause - time.time()))
                    last = time.time()
                    try:
                        code, body = get(u)
                        break
                    except Exception:  # noqa: BLE001 - a failed request is asked again
                        code = -1
                fine = code == 200 and "<html" in body.lower()
                html.append(body if fine else None)
                status.append("ok" if fine else f"failed {code}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(html, pa.string()), pa.array(status)], names=["arxiv_id", "html", "status"])

    todo = unprocessed(candidates.select(F.col(key).alias("arxiv_id"), url), landed.select(F.col(key).alias("arxiv_id")))
    return todo.repartition(lanes).mapInArrow(run, "arxiv_id string, html string, status string")


def processed_months(done: DataFrame, month: str = "month_stratum") -> DataFrame:
    """``(month, papers)`` already there, for a resumed run."""
    return done.groupBy(F.col(month).alias("month")).agg(F.countDistinct("arxiv_id").alias("papers"))

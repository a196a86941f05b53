"""Reports on a corpus and on its passages: duplicates, leftovers, coverage, leaks, noise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

SHORT_PAPER = 1500


def duplicate_ids(papers: DataFrame) -> DataFrame:
    """``(arxiv_id, repeats)`` of ids with more than one row; each row after the first is a repeat."""
    return papers.groupBy("arxiv_id").agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def duplicate_titles(papers: DataFrame) -> DataFrame:
    """``(title, papers)``: normalised titles of more than one row, with their number. Null titles are left out."""
    return papers.where("title is not null").select(T.plain_title(F.col("title")).alias("title")).groupBy("title").agg(F.count("*").alias("papers")).where("papers > 1")


def short_papers(papers: DataFrame, least: int = SHORT_PAPER) -> DataFrame:
    return papers.where(F.coalesce("total_words", F.lit(0)) < least).select("arxiv_id", F.trim("title").alias("title"), F.coalesce("total_words", F.lit(0)).alias("words"))


def blocks(papers: DataFrame) -> DataFrame:
    """``(arxiv_id, s, section_id, heading, b, type, content)``; sections without blocks have a null ``b``."""
    s = papers.select("arxiv_id", F.posexplode("sections").alias("s", "x"))
    b = s.select("arxiv_id", "s", F.col("x.section_id").alias("section_id"), F.col("x.heading").alias("heading"), F.posexplode_outer("x.blocks").alias("b", "y"))
    return b.select("arxiv_id", "s", "section_id", "heading", "b", F.col("y.type").alias("type"), F.col("y.content").alias("content"))


def empty_blocks(papers: DataFrame) -> DataFrame:
    """Sections without blocks (``b`` null) and blocks without content."""
    return blocks(papers).where(F.col("b").isNull() | ~F.coalesce("content", F.lit("")).rlike(r"(?U)\S")).select("arxiv_id", "s", "section_id", "b")


def residual_markup(papers: DataFrame) -> DataFrame:
    """Blocks in which markup tags are left, with the tags and the beginning of the block."""
    b = blocks(papers).where(F.contains("content", F.lit("<")))
    return b.withColumn("tags", F.array_join(T.residual_tags(F.trim("content")), ",")).where("tags <> ''").select("arxiv_id", "s", "b", "tags", F.substring(F.trim("content"), 1, 120).alias("snippet"))


def table_outliers(papers: DataFrame, least: int = 20, factor: float = 2.5) -> DataFrame:
    """Papers with unusually many tables: at least ``max(least, int(q3 + factor * (q3 - q1)))``, quartiles by the exclusive method.

    The distinct counts are few, so quartiles come from a histogram. With fewer
    than two papers there are none.
    """
    rows = papers.select("arxiv_id", F.coalesce(F.try_element_at("block_counts", F.lit("table")), F.lit(0)).alias("tables"))
    hist = rows.groupBy("tables").agg(F.count("*").alias("c"))
    run = hist.withColumn("upto", F.sum("c").over(Window.orderBy("tables"))).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(1))))  # a row for each count of tables

    def place(i: int):
        return F.least(F.greatest(F.floor(i * (F.col("n") + 1) / 4), F.lit(1)), F.col("n") - 1)

    def value(at):
        return F.min(F.when(F.col("upto") >= at, F.col("tables")))

    q = run.where("n >= 2").agg(F.max("n").alias("n"), *[value(place(i) + o).alias(f"x{i}{o}") for i in (1, 3) for o in (0, 1)])
    quart = {i: (F.col(f"x{i}0") * (4 - (i * (F.col("n") + 1) - 4 * place(i))) + F.col(f"x{i}1") * (i * (F.col("n") + 1) - 4 * place(i))) / 4 for i in (1, 3)}
    limit = q.select(F.greatest(F.lit(least), (quart[3] + factor * (quart[3] - quart[1])).cast("int")).alias("threshold"))
    return rows.crossJoin(F.broadcast(limit)).where("tables >= threshold")  # one row


#: What stands for a formula in a text.
_MARKER = "[EQUATION]"


def _sid() -> Column:
    """The key of a section: its id after a mark, so that null is a key too."""
    return F.coalesce(F.concat(F.lit("="), F.col("section_id")), F.lit(""))


def _unmarked(content: Column) -> Column:
    return F.replace(F.coalesce(content, F.lit("")), F.lit(_MARKER), F.lit(""))


def block_grams(papers: DataFrame) -> DataFrame:
    """``(arxiv_id, sid, s, b, grams)``: hashes of the 8-grams of the text blocks without formula marks, as they are written."""
    return blocks(papers).where("type = 'text'").select("arxiv_id", _sid().alias("sid"), "s", "b", T.ngram_hashes(T.words(_unmarked(F.col("content")))).alias("grams"))


def section_texts(papers: DataFrame) -> DataFrame:
    """``(arxiv_id, sid, s, text)``: each section's text and equation blocks, joined, without formula marks."""
    own = papers.select("arxiv_id", F.posexplode("sections").alias("s", "x")).select("arxiv_id", "s", F.col("x.section_id").alias("section_id"), F.filter("x.blocks", lambda b: b["type"].isin("text", "equation")).alias("blocks"))
    return own.select("arxiv_id", _sid().alias("sid"), "s", F.array_join(F.transform("blocks", lambda b: _unmarked(b["content"])), " ").alias("text"))


def passage_grams(passages: DataFrame) -> DataFrame:
    p = passages.where("type = 'text'")
    return p.select("passage_id", "arxiv_id", _sid().alias("sid"), T.ngram_hashes(T.words(F.coalesce("content", F.lit("")))).alias("grams"))


def gram_coverage(papers: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: 8-grams of the source's text blocks, those found in the text passages of their section, and the percentage.

    Grams count with their multiplicity, each block against the whole section;
    marks of formulas are taken out of the blocks, letters keep their case. Grams
    travel as hashes. Blocks of sections without id are compared with the passages
    without id. Null if there are none.
    """
    src = block_grams(papers).select("arxiv_id", "sid", "s", "b", F.explode("grams").alias("h")).groupBy("arxiv_id", "sid", "s", "b", "h").agg(F.count("*").alias("c"))
    got = passage_grams(passages).select("arxiv_id", "sid", F.explode("grams").alias("h")).groupBy("arxiv_id", "sid", "h").agg(F.count("*").alias("d"))
    j = src.join(got, ["arxiv_id", "sid", "h"], "left")
    return j.agg(F.sum("c").alias("source"), F.sum(F.least("c", F.coalesce("d", F.lit(0)))).alias("covered")).withColumn("percent", F.bround(F.try_divide(F.col("covered") * 100.0, "source"), 4))


#: Text passages of one paper that go to one task; a paper with more is examined in parts.
PART = 20_000


def _among(grams: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the grams are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(grams), bool)
    return ordered[np.minimum(np.searchsorted(ordered, grams), len(ordered) - 1)] == grams


def _leaking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaks of passages. Rows come by paper, its sections in order before its passages; one paper's sections are kept."""
    now, sections, ordered, every = None, {}, {}, None
    for batch in batches:
        at, grams = (getattr(batch.column("grams"), k).to_numpy() for k in ("offsets", "values"))
        places, leaks = [], []
        for i, (paper, part, sid, s) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("arxiv_id", "part", "sid", "s")), strict=True)):
            if (paper, part) != now:
                now, sections, ordered, every = (paper, part), {}, {}, None
            own = grams[at[i] : at[i + 1]]
            if s is not None:
                sections[sid] = own  # of repeated sections the last
                continue
            if not len(own) or sid not in sections:
                continue
            if sid not in ordered:
                ordered[sid] = np.unique(sections[sid])
            foreign = own[~_among(own, ordered[sid])]
            if len(foreign) and len(sections) > 1:
                every = np.unique(np.concatenate(list(sections.values()))) if every is None else every
                if n := int(_among(foreign, every).sum()):
                    places.append(i)
                    leaks.append(n)
        if places:
            yield pa.RecordBatch.from_arrays([batch.column("passage_id").take(pa.array(places)), pa.array(leaks, pa.int64())], ["passage_id", "leaks"])


def gram_leaks(papers: DataFrame, passages: DataFrame, part: int = PART) -> DataFrame:
    """``(passage_id, leaks)``: 8-grams of a text passage, each time they occur, that its own section lacks and another section of its paper has.

    A section's grams are those of its text and equation blocks joined to one text,
    without marks of formulas; of repeated sections the last counts. Passages of
    sections that the paper lacks aren't examined.

    Texts are moved once, to the task of their paper, and grams are made there, as
    hashes; they are never shuffled. Papers with more than ``part`` text passages
    are counted first: their passages are dealt out to several tasks, each of which
    gets the sections.
    """
    texts = passages.where("type = 'text' and arxiv_id is not null").select("arxiv_id", "passage_id", _sid().alias("sid"), F.coalesce("content", F.lit("")).alias("text"))
    sections = section_texts(papers.where("arxiv_id is not null"))
    large = texts.groupBy("arxiv_id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    if found := large.collect():  # at most a row for so many passages
        few = F.broadcast(papers.sparkSession.createDataFrame(found, large.schema))
        parts = F.coalesce("parts", F.lit(1))
        texts = texts.join(few, "arxiv_id", "left").withColumn("part", F.pmod(F.xxhash64("passage_id", "text"), parts).cast("int"))
        sections = sections.join(few, "arxiv_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        texts, sections = texts.withColumn("part", F.lit(0)), sections.withColumn("part", F.lit(0))
    kind = passages.schema["passage_id"].dataType.simpleString()
    columns = ["arxiv_id", "part", "passage_id", "sid", "s", "text"]
    rows = sections.withColumn("passage_id", F.lit(None).cast(kind)).select(columns).union(texts.withColumn("s", F.lit(None).cast("int")).select(columns))
    near = rows.repartition("arxiv_id", "part").sortWithinPartitions("arxiv_id", "part", F.asc_nulls_last("s"))
    examined = near.select(*columns[:-1], T.ngram_hashes(T.words(F.col("text"))).alias("grams")).mapInArrow(_leaking, f"passage_id {kind}, leaks bigint")
    return examined.groupBy("passage_id").agg(F.sum("leaks").alias("leaks"))


def size_buckets(passages: DataFrame, small: int = 60, tiny: int = 20, large: int = 350) -> DataFrame:
    """One row: passages, and those below and above the sizes."""
    w = F.coalesce("word_count", F.lit(0))
    return passages.agg(F.count("*").alias("passages"), F.count_if(w < small).alias("small"), F.count_if(w < tiny).alias("tiny"), F.count_if(w > large).alias("large"))


def latex_noise(passages: DataFrame, field: str = "content", counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each text passage the typesetting commands, terms before and after cleaning, and words.

    ``counter`` gives a model's number of tokens of a text; without one, terms are
    counted.
    """
    p = passages.where("type = 'text' and content is not null")
    c = F.col(field)
    counter = counter or (lambda x: F.size(T.tokens(x)))
    return p.select("passage_id", F.regexp_count(c, F.lit(T.COMMAND)).alias("commands"), counter(c).alias("terms"), counter(T.clean_latex_strict(c)).alias("terms_clean"), F.size(T.words(c)).alias("words"))


#: Commands of a noisy and of a very noisy passage, and terms of a long one.
NOISY, VERY_NOISY, LONG = 20, 50, 512


def noise_summary(noise: DataFrame, noisy: int = NOISY, very: int = VERY_NOISY, long: int = LONG) -> DataFrame:
    """One row: median, 90th and 99th percentile of the commands; passages with at least ``noisy`` and ``very`` commands and
    their percentages; passages with more than ``long`` terms before and after cleaning, and those that are noisy too; most terms."""

    def percent(x: Column) -> Column:
        return F.bround(F.try_divide(F.count_if(x) * F.lit(100.0), F.count("*")), 2)

    c, over = F.col("commands"), F.col("terms") > long
    return noise.agg(
        F.count("*").alias("passages"), F.median("commands").alias("p50"), F.percentile("commands", 0.9).alias("p90"), F.percentile("commands", 0.99).alias("p99"),
        F.count_if(c >= noisy).alias("noisy"), percent(c >= noisy).alias("noisy_percent"), F.count_if(c >= very).alias("very_noisy"), percent(c >= very).alias("very_noisy_percent"),
        F.count_if(over).alias("long"), F.count_if(over & (c >= noisy)).alias("long_noisy"), F.count_if(F.col("terms_clean") > long).alias("long_clean"), F.max("terms").alias("most"), F.max("terms_clean").alias("most_clean"),
    )


def noise_groups(noise: DataFrame, least: int = NOISY) -> DataFrame:
    """Medians of terms to words, and means and medians of terms, of passages with at least ``least`` commands and with fewer."""
    ratio = F.col("terms") / F.greatest("words", F.lit(1))
    return noise.groupBy((F.col("commands") >= least).alias("noisy")).agg(F.count("*").alias("passages"), F.bround(F.median(ratio), 6).alias("ratio"), F.bround(F.avg("terms"), 4).alias("mean_terms"), F.median("terms").alias("median_terms"))


def top_papers(noise: DataFrame, k: int = 10, least: int = NOISY) -> DataFrame:
    """The ``k`` papers with the most passages of at least ``least`` commands; ties go to the smaller id."""
    return noise.where(F.col("commands") >= least).groupBy(F.substring_index("passage_id", "_", 1).alias("paper")).agg(F.count("*").alias("passages")).orderBy(F.desc("passages"), "paper").limit(k)


def truncation(passages: DataFrame, field: str = "content", limit: int = 512) -> DataFrame:
    """For each type: passages, those with more terms than the limit, and their percentage."""
    n = F.size(T.tokens(T.clean_latex(F.col(field))))
    return passages.groupBy("type").agg(F.count("*").alias("total"), F.count_if(n > limit).alias("truncated")).withColumn("percent", F.bround(F.col("truncated") * 100.0 / F.col("total"), 2))

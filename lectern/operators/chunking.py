"""From parsed papers to passages: section paths, packing of sentences, tables by rows, ids and reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bound, sentences

MARKER = "[EQUATION]"
#: Fixed value: passages of more words are flagged, whatever the packing's limits.
OVERSIZED_WORDS = 350
SITE = "https://arxiv.org/html"


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 250
    max_words: int = 350
    min_words: int = 60
    overlap: int = 40
    site: str = SITE


def section_paths(papers: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """``(key, s, section_id, section_path, missing)`` of every section, ``s`` its 0-based position.

    The path has the headings of the dotted prefixes of the id and of the section
    itself; ids with ``abstract`` are ``Abstract``. ``missing`` tells of prefixes
    without a heading, which are skipped; the section's own heading falls back to
    its id. Equal neighbours are collapsed. Of sections that repeat an id the last
    gives the heading. A null id has no ancestors.
    """
    rows = papers.select(F.col(key), heads_of("sections").alias("heads"), F.posexplode(heads_of("sections")).alias("s", "own"))
    sid, path, missing = path_of(F.col("heads"), F.col("own"))
    return rows.select(F.col(key), "s", sid.alias("section_id"), path.alias("section_path"), missing.alias("missing"))


def heads_of(sections: str) -> Column:
    """The id ``i`` and heading ``h`` of each section."""
    return F.transform(sections, lambda s: F.struct(s["section_id"].alias("i"), F.trim(s["heading"]).alias("h")))


def path_of(heads: Column, own: Column) -> tuple[Column, Column, Column]:
    """The id, path and lack of ancestors of the section ``own`` among ``heads``."""
    sid = F.coalesce(own["i"], F.lit(""))
    parts = F.split(sid, r"\.")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))
    named = F.transform(prefixes, lambda p: F.try_element_at(F.filter(heads, lambda x: x["i"] == p), F.lit(-1))["h"])
    real = F.filter(named, lambda h: h.isNotNull() & (h != ""))
    last = F.when(own["i"].isNull(), own["h"]).otherwise(F.try_element_at(F.filter(heads, lambda x: x["i"] == sid), F.lit(-1))["h"])
    chain = F.concat(real, F.array(F.when(F.coalesce(last, F.lit("")) == "", sid).otherwise(last)))
    slim = bound(chain, lambda c: F.filter(c, lambda x, i: (i == 0) | (x != F.get(c, i - 1))))
    abstract = F.lower(sid).contains("abstract")
    return sid, F.when(abstract, "Abstract").otherwise(F.array_join(slim, " > ")), ~abstract & (F.size(real) < F.size(prefixes))


def split_table(text: str, max_words: int = OVERSIZED_WORDS) -> list[str]:
    """A Markdown table in pieces of rows under the limit, each with caption, header and separator.

    A table that fits, or without data rows, stays as it is; a row over the limit
    is a piece by itself.
    """
    lines = [x for x in (raw.strip() for raw in text.split("\n")) if x]
    first = next((i for i, x in enumerate(lines) if x.startswith("|")), None)
    if first is None or len(text.split()) <= max_words:
        return [text]
    captions = [x for x in lines[:first] if x.startswith("[") or "table" in x.lower()]
    rows = [x for x in lines[first:] if x.startswith("|")]
    header, rest = rows[0], rows[1:]
    if rest and "---" in rest[0]:
        rule, rest = rest[0], rest[1:]
    else:
        rule = "| " + " | ".join(["---"] * header.count("|")) + " |"
    if not rest:
        return [text]
    head = captions[-1:] + [header, rule]
    fixed = sum(len(x.split()) for x in head)
    pieces, own, used = [], [], 0
    for row in rest:
        n = len(row.split())
        if own and fixed + used + n > max_words:
            pieces.append("\n".join(head + own))
            own, used = [], 0
        own.append(row)
        used += n
    return [*pieces, "\n".join(head + own)]


Unit = tuple[int, str, int]  # block, text, words


def pack(units: list[Unit], c: ChunkConfig = ChunkConfig()) -> list[list[Unit]]:
    """Units in order as chunks of about the target size, with overlap, and the last chunk not too short."""
    chunks: list[list[Unit]] = []
    i = 0
    while i < len(units):
        chunk, size = [], 0
        while i < len(units) and size < c.target and not (size > 0 and size + units[i][2] > c.max_words):
            chunk.append(units[i])
            size += units[i][2]
            i += 1
        chunks.append(chunk)
        if i < len(units) and c.overlap > 0:
            back, seen = 1, chunk[-1][2]
            while back < len(chunk) and seen + chunk[-1 - back][2] <= c.overlap:
                seen += chunk[-1 - back][2]
                back += 1
            if back < len(chunk):
                i -= back
    if len(chunks) > 1 and sum(u[2] for u in chunks[-1]) < c.min_words:
        before, last = chunks[-2], chunks[-1]
        fresh = [u for u in last if u not in before]
        if sum(u[2] for u in before + fresh) <= c.max_words:
            chunks[-2:] = [before + fresh]
        else:
            while before and sum(u[2] for u in last) < c.min_words:
                last.insert(0, before.pop())
    return [x for x in chunks if x]


@dataclass
class Piece:
    kind: str
    content: str
    first: int
    last: int

    @property
    def words(self) -> int:
        return len(self.content.split())


def merge_short(pieces: list[Piece], c: ChunkConfig = ChunkConfig()) -> list[Piece]:
    """Short text passages joined with the text passage before them, else after them, as long as the sum is within the limit."""
    changed = True
    while changed:
        changed = False
        texts = [p for p in pieces if p.kind == "text"]
        for k, p in enumerate(texts):
            if p.words >= c.min_words:
                continue
            for other, pair in (((texts[k - 1], (texts[k - 1], p)) if k else (None, None)), ((texts[k + 1], (p, texts[k + 1])) if k + 1 < len(texts) else (None, None))):
                if other is not None and p.words + other.words <= c.max_words:
                    other.content = "\n\n".join(x.content for x in pair)
                    other.first, other.last = min(p.first, other.first), max(p.last, other.last)
                    pieces = [x for x in pieces if x is not p]
                    changed = True
                    break
            if changed:
                break
    return pieces


def section_pieces(blocks: list[tuple[str | None, str | None, list[str] | None]], c: ChunkConfig = ChunkConfig()) -> list[Piece]:
    """The passages of one section from its blocks ``(type, content, sentences)``.

    Text and equations gather as sentences until a table or figure comes; other
    types are dropped, and so are null contents.
    """
    pieces: list[Piece] = []
    units: list[Unit] = []

    def flush() -> None:
        for chunk in pack(units, c):
            pieces.append(Piece("text", " ".join(u[1] for u in chunk), min(u[0] for u in chunk), max(u[0] for u in chunk)))
        units.clear()

    for i, (kind, content, said) in enumerate(blocks):
        if content is None:
            continue
        if kind in ("table", "figure"):
            flush()
            parts = [content] if kind == "figure" else split_table(content, c.max_words) if content.strip() else []
            pieces += [Piece(kind, x, i, i) for x in parts]
        elif kind in ("text", "equation") and content.strip() != MARKER:
            units += [(i, s, len(s.split())) for s in said or [] if s.strip()]
    flush()
    return merge_short(pieces, c)


_PIECES = "array<struct<section_id:string, section_path:string, no:int, type:string, content:string, first:int, last:int>>"


def chunk_papers(papers: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Passages of parsed papers, with the columns of the passage schema.

    A paper is one row with all its sections, so that it is cut and its passages are
    numbered where it lies: nothing is joined or shuffled. Sections never share a
    passage. Rows that repeat an ``arxiv_id`` should be left out before. Null
    sections and papers without blocks give nothing. Ids go on over the sections
    of a paper, from 1.
    """

    def said(content: Column) -> Column:
        plain = F.when(F.contains(content, F.lit(MARKER)), F.trim(F.regexp_replace(F.replace(content, F.lit(MARKER), F.lit("")), r"(?U)\s+", " "))).otherwise(content)
        return sentences(plain)

    def section(s: Column, head: Column) -> Column:
        sid, path, _ = path_of(F.col("heads"), head)
        blocks = F.transform(F.coalesce(s["blocks"], F.array().cast("array<struct<section_id:string,type:string,content:string>>")), lambda b: F.struct(b["type"].alias("type"), b["content"].alias("content"), F.when(b["type"].isin("text", "equation"), said(b["content"])).alias("said")))
        return F.struct(sid.alias("section_id"), path.alias("section_path"), blocks.alias("blocks"))

    clean = F.coalesce("clean_id", F.substring_index("arxiv_id", "v", 1))
    rows = papers.select("arxiv_id", clean.alias("clean_id"), "title", F.coalesce("month_stratum", F.substring("published", 1, 7)).alias("month_stratum"), "sections", heads_of("sections").alias("heads"))
    rows = rows.select("arxiv_id", "clean_id", "title", "month_stratum", F.zip_with("sections", "heads", section).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int32() if c in ("no", "first", "last") else pa.string()) for c in ("section_id", "section_path", "no", "type", "content", "first", "last")]))
        for b in batches:
            out = []
            for sections in b.column("sections").to_pylist():
                own = []
                for x in sections or []:
                    for p in section_pieces([(y["type"], y["content"], y["said"]) for y in x["blocks"]], config):
                        own.append({"section_id": x["section_id"], "section_path": x["section_path"], "no": len(own) + 1, "type": p.kind, "content": p.content, "first": p.first, "last": p.last})
                out.append(own)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("arxiv_id", "clean_id", "title", "month_stratum")), pa.array(out, kind)], names=["arxiv_id", "clean_id", "title", "month_stratum", "pieces"])

    cut = rows.mapInArrow(run, f"arxiv_id string, clean_id string, title string, month_stratum string, pieces {_PIECES}")
    flat = cut.select("arxiv_id", "clean_id", "title", "month_stratum", F.explode("pieces").alias("p")).select("arxiv_id", "clean_id", "title", "month_stratum", "p.*")
    content = F.col("content")
    count = F.size(F.filter(F.split(content, r"(?U)\s+"), lambda x: x != ""))
    return flat.select(
        "arxiv_id", "clean_id", "title", "month_stratum", "section_id", "section_path", F.array("first", "last").alias("block_range"), "type",
        count.alias("word_count"), F.length(content).alias("char_count"), F.concat(F.lit(config.site + "/"), "arxiv_id", F.lit("#"), "section_id").alias("section_url"), content,
        F.concat(F.lit("Document: "), F.coalesce("title", F.lit("")), F.lit("\nSection: "), "section_path", F.lit("\n\n"), content).alias("contextual_content"),
        F.when(count > OVERSIZED_WORDS, True).alias("oversized"), F.format_string("%s_p%04d", "clean_id", "no").alias("passage_id"),
    )


def isolation_errors(passages: DataFrame, papers: DataFrame) -> DataFrame:
    """``(passage_id, errors)`` of passages with a section (1) that their paper lacks, or a block range (1) that its section lacks.

    An empty or null section, or one that is written as a path, is an error too.
    The range is checked only if the paper has the section, of repeated ones the
    first; it must have two numbers in order. A section id of null is found by
    null.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("section_id")), F.lit(""))
    sec = papers.select("arxiv_id", F.posexplode("sections").alias("s", "x")).select("arxiv_id", "s", F.col("x.section_id").alias("section_id"), F.greatest(F.size("x.blocks"), F.lit(0)).alias("n"))
    sec = sec.groupBy("arxiv_id", key.alias("sid")).agg(F.min_by("n", "s").alias("blocks"))
    j = passages.select("passage_id", "arxiv_id", "section_id", "block_range", key.alias("sid")).join(sec, ["arxiv_id", "sid"], "left")
    a, b = F.get("block_range", F.lit(0)), F.get("block_range", F.lit(1))
    bad_section = F.col("blocks").isNull() | (F.coalesce("section_id", F.lit("")) == "") | F.contains("section_id", F.lit(" > "))
    bad_range = F.col("blocks").isNotNull() & ~F.coalesce((F.size("block_range") == 2) & (a >= 0) & (a <= b) & (b < F.col("blocks")), F.lit(False))
    return j.select("passage_id", (bad_section.cast("int") + bad_range.cast("int")).alias("errors")).where("errors > 0")


def report(passages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """For each type: passages, short and oversized ones, least, mean, median and largest word counts, and three quantiles by rank."""
    n = Window.partitionBy("type")
    # the rank is per type; only a few types exist, so counts of words are counted first
    counts = passages.where("word_count is not null").groupBy("type", "word_count").agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(n.orderBy("word_count"))).withColumn("n", F.sum("c").over(n))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") > (F.col("n") * q).cast("bigint"), F.col("word_count")))

    lower, upper = F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col("word_count"))), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("word_count")))
    return run.groupBy("type").agg(
        F.sum("c").alias("passages"), F.sum(F.when(F.col("word_count") < config.min_words, F.col("c")).otherwise(0)).alias("short"), F.sum(F.when(F.col("word_count") > config.max_words, F.col("c")).otherwise(0)).alias("long"),
        F.min("word_count").alias("least"), F.max("word_count").alias("most"), F.bround(F.sum(F.col("c") * F.col("word_count")) / F.sum("c"), 1).alias("mean"), ((lower + upper) / 2).alias("median"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(0.95).alias("p95"),
    )


def pack_plain(df: DataFrame, key: str, text: str, target: int = 250, max_words: int = 350) -> DataFrame:
    """``(key, no, words, chunk)``: sentences packed without overlap, as a fold in the JVM."""
    unit = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("t"), F.size(F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")).alias("w")))
    start = F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).alias("w"), F.array().cast("array<struct<c:string,w:int>>").alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(F.struct(F.array_join(acc["cur"], " ").alias("c"), acc["w"].alias("w"))))).otherwise(acc["out"])

    def step(acc: Column, u: Column) -> Column:
        new = (acc["w"] >= target) | ((acc["w"] > 0) & (acc["w"] + u["w"] > max_words))
        return F.when(new, F.struct(F.array(u["t"]).alias("cur"), u["w"].alias("w"), closed(acc).alias("out"))).otherwise(F.struct(F.concat(acc["cur"], F.array(u["t"])).alias("cur"), (acc["w"] + u["w"]).alias("w"), acc["out"].alias("out")))

    folded = F.aggregate(unit, start, step, closed)
    return df.select(F.col(key), F.posexplode(folded).alias("no", "x")).select(key, "no", F.col("x.w").alias("words"), F.col("x.c").alias("chunk"))

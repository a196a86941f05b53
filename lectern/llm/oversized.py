"""Splitting items over a size limit at natural boundaries, with overlapping pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sentences import sentence_ends

MAX_WORDS, MAX_CHARS, OVERLAP = 350, 3000, 40
#: Characters of a word of the overlap at most, on average, where texts have no spaces.
OVERLAP_WORD = 12
MARKER = "[EQUATION]"
#: Fixed value: the code points with the property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
_TOKEN = re.compile(f"[^{SPACE}]+")
_LINE = re.compile("\r\n?|\n")
_BLANK = re.compile(f"(?:\r\n?|\n)[ \t\xa0]*(?:\r\n?|\n)[{SPACE}]*")


def tidy_column(text: Column) -> Column:
    """The text without markers, with single spaces between words and none around them."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(MARKER), F.lit("")), r"(?U)\s+", " "))


def over_limit(tidy: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a tidied text has more words or code points than the limit."""
    spaces = F.length(tidy) - F.length(F.replace(tidy, F.lit(" "), F.lit("")))
    return (F.length(tidy) > max_chars) | (spaces + 1 > max_words)


def pieces(content: str, table: bool, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> tuple[bool, list[tuple[int, int, int, str]]]:
    """Whether a cut inside a sentence or row can't be avoided, and the pieces ``(first word, end word, first paragraph, last paragraph, text)``.

    Prefix sums of the words' lengths give the size of any run of words. The ends
    of paragraphs, sentences and rows are a sorted array of word numbers; a piece
    goes to the last of them under the limit, found by binary search, or is cut
    hard. The next piece begins about ``overlap`` words before, at a boundary if
    there is one near, but always after the beginning of this one; of texts without
    spaces it repeats up to ``overlap * OVERLAP_WORD`` characters.
    """
    text = content.replace(MARKER, "")
    ends = [m.end() for m in _LINE.finditer(text)] + [len(text)] if table else sentence_ends(text)
    # words are cut, without a space between, at the ends of sentences in them and if they are very long
    part, spans, k = max(1, min(max_chars // 4, overlap * OVERLAP_WORD // 2)), [], 0
    for m in _TOKEN.finditer(text):
        at, stop = m.span()
        while at < stop:
            while k < len(ends) and ends[k] <= at:
                k += 1
            to = min(stop, at + part, ends[k] if k < len(ends) else stop)
            spans.append((at, to))
            at = to
    n = len(spans)
    starts = np.array([s for s, _ in spans], dtype=int)
    stops = np.array([e for _, e in spans], dtype=int)
    gaps = np.concatenate([(starts[1:] > stops[:-1]).astype(int), [1]]) if n else np.zeros(0, int)
    # the words i..j-1 and the spaces between them have upto[j] - sums[i] characters
    sums = np.concatenate([[0], np.cumsum(stops - starts + gaps)])
    upto = sums - np.concatenate([[0], gaps])
    paragraphs = [m.end() for m in _BLANK.finditer(text)]
    unit_ends = np.unique(np.concatenate([np.searchsorted(starts, ends), [n]]).astype(int))
    bounds = np.unique(np.concatenate([unit_ends, np.searchsorted(starts, paragraphs).astype(int)]))
    bounds = bounds[bounds > 0]
    first = np.concatenate([[0], bounds[:-1]]).astype(int)
    forced = bool(np.any((bounds - first > max_words) | (upto[bounds] - sums[first] > max_chars)))
    breaks = np.searchsorted(starts, paragraphs)
    out, at, done = [], 0, 0
    while at < n:
        most = min(n, at + max_words, int(np.searchsorted(upto, sums[at] + max_chars, "right")) - 1)
        most = max(most, at + 1, done + 1)
        k = int(np.searchsorted(bounds, most, "right")) - 1
        end = int(bounds[k]) if k >= 0 and bounds[k] > done else most
        said = "".join(text[s:e] + " " * int(g) for (s, e), g in zip(spans[at:end], gaps[at:end])).rstrip(" ")
        out.append((at, end, int(np.searchsorted(breaks, at, "right")), int(np.searchsorted(breaks, end - 1, "right")), said))
        if end >= n:
            break
        # where words are as long as sentences, fewer of them are repeated
        back = max(end - min(overlap, (end - at) // 2), int(np.searchsorted(sums, sums[end] - overlap * OVERLAP_WORD, "left")))
        lo, hi = np.searchsorted(bounds, [max(at + 1, back - overlap // 2), end - (end - back) // 2])
        near = bounds[lo:hi]
        at, done = int(near[np.argmin(np.abs(near - back))]) if len(near) else back, end
        # the words repeated must leave room for at least one more
        while at < done and (done + 1 - at > max_words or upto[done + 1] - sums[at] > max_chars):
            at += 1
    return forced, out


def block_items(papers: DataFrame) -> DataFrame:
    """``(item_kind, item_key, type, block_range, content)`` of every block, with 0-based positions in its key."""
    s = papers.select("arxiv_id", F.posexplode("sections").alias("s", "sec"))
    b = s.select("arxiv_id", "s", F.posexplode("sec.blocks").alias("b", "blk"))
    return b.select(F.lit("block").alias("item_kind"), F.concat_ws("#", "arxiv_id", "s", "b").alias("item_key"), F.col("blk.type").alias("type"), F.array("b", "b").alias("block_range"), F.col("blk.content").alias("content"))


def passage_items(passages: DataFrame) -> DataFrame:
    """The same columns of passages; a block range that isn't two numbers in order is null."""
    r = F.col("block_range")
    fine = (F.size(r) == 2) & (F.get(r, F.lit(0)) >= 0) & (F.get(r, F.lit(0)) <= F.get(r, F.lit(1)))
    return passages.select(F.lit("passage").alias("item_kind"), F.col("passage_id").alias("item_key"), "type", F.when(fine, r).alias("block_range"), "content")


SCHEMA = "item_kind string, item_key string, cut string, piece_no int, words int, chars int, first_word int, block_range array<int>, content string"


def split_oversized(items: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the items over the limit, numbered from 0.

    ``items`` has ``item_kind, item_key, type, block_range, content``; others of its
    columns are ignored. ``cut`` is ``forced`` for the items of which one sentence
    (one line, for type ``table``) is over the limit by itself, else ``natural``. A
    piece of an item whose paragraphs are as many as its blocks has the range of
    the blocks it touches, else the item's. Items within the limit, null and empty
    ones give no rows; rows that repeat kind and key are taken as repeats of one;
    a null type is text. No piece repeats more than half of the one before, and words
    longer than a quarter of the limit are cut.
    """
    long = items.where((F.length("content") > 2 * max_words) | (F.length("content") > max_chars))
    over = long.where(over_limit(tidy_column(F.col("content")), max_words, max_chars)).select("item_kind", "item_key", "type", "block_range", "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_kind", pa.string()), ("item_key", pa.string()), ("cut", pa.string()), ("piece_no", pa.int32()), ("words", pa.int32()), ("chars", pa.int32()), ("first_word", pa.int32()), ("block_range", pa.list_(pa.int32())), ("content", pa.string())])
        for b in batches:
            rows = []
            for r in b.to_pylist():
                forced, parts = pieces(r["content"], r["type"] == "table", max_words, max_chars, overlap)
                span = r["block_range"]
                each = span is not None and parts and parts[-1][3] == span[1] - span[0]
                for i, (a, e, p, q, text) in enumerate(parts):
                    rows.append({"item_kind": r["item_kind"], "item_key": r["item_key"], "cut": "forced" if forced else "natural", "piece_no": i, "words": e - a, "chars": len(text), "first_word": a, "block_range": [span[0] + p, span[0] + q] if each else span, "content": text})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return over.dropDuplicates(["item_kind", "item_key"]).mapInArrow(cut, SCHEMA)


def oversized_items(pieces_df: DataFrame) -> DataFrame:
    """``(item_kind, item_key, cut)``: the items that were split, from their first pieces."""
    return pieces_df.where("piece_no = 0").select("item_kind", "item_key", "cut")

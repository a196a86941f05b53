"""Held-out test texts inside training documents, by Wu-Manber search for the items' word sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words of a stretch, and the share of an item's words that must lie in stretches.
STRETCH, SHARE = 8, 0.5
#: Items whose patterns are searched at a time; the size of a block's patterns is bounded by it and by BLOCK_WORDS.
BLOCK_ITEMS, BLOCK_WORDS = 5_000, 1_000_000

#: A word: a Han or kana character, or a run of other letters and digits.
_CJK = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ々〇\U00020000-\U0003ffff"
WORD = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Letters and digits in lower case; each Han or kana character is a word."""
    return WORD.findall(text.lower())


class Patterns:
    """Wu-Manber tables over word numbers for all runs of ``m`` words of some items.

    A block is two words. ``shift`` has, for a block's hash, how far the window may
    move on: the least distance of such a block from the end of a pattern, or the
    pattern's length less one if there is none. Where it is 0 the hash of the
    window's words selects a bucket of patterns, and their words are compared.
    """

    def __init__(self, items: list[tuple[int, str]], m: int = STRETCH, bits: int = 18):
        self.m, self.bits = m, bits
        self.number: dict[str, int] = {}
        self.ids, self.length = [], []
        runs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (item, text) in enumerate(items):
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text or "")]
            self.ids.append(item)
            self.length.append(len(w))
            for i in range(len(w) - m + 1):
                runs.setdefault(tuple(w[i : i + m]), []).append((k, i))
        self.where = list(runs.values())
        self.runs = np.array(list(runs), np.int64).reshape(-1, m)
        self.shift = np.full(1 << bits, m - 1, np.int8)
        for j in range(1, m):
            h = self.block(self.runs[:, j - 1], self.runs[:, j])
            np.minimum.at(self.shift, h, np.int8(m - 1 - j))
        keys = self.key(self.runs)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((a.astype(np.uint64) * _MIX) ^ b.astype(np.uint64)) * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def key(self, windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), np.uint64)
        for j in range(windows.shape[1]):
            h = (h ^ windows[:, j].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def search(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``flat`` at which a pattern begins, and the patterns' numbers; text ``i`` is ``flat[starts[i]:ends[i]]``.

        The windows of all texts move at once, each by its own shift.
        """
        at = starts + self.m - 1  # the last word of each window
        live = np.flatnonzero(at < ends)
        at, end = at[live], ends[live]
        hits, found = [], []
        unknown = flat == 0
        offsets = np.arange(self.m)
        while len(at):
            s = self.shift[self.block(flat[at - 1], flat[at])].astype(np.int64)
            s[unknown[at]] = self.m - 1  # no pattern has this word
            zero = s == 0
            if zero.any():
                begin = at[zero] - self.m + 1
                win = flat[begin[:, None] + offsets]
                key = self.key(win)
                lo = np.searchsorted(self.keys, key)
                near = lo < len(self.keys)
                near[near] = self.keys[lo[near]] == key[near]
                for begin_at, w, i in zip(begin[near], win[near], lo[near]):
                    k = self.keys[i]
                    while i < len(self.keys) and self.keys[i] == k:
                        if np.array_equal(self.runs[self.order[i]], w):
                            hits.append(begin_at)
                            found.append(self.order[i])
                            break
                        i += 1
                s[zero] = 1
            at = at + s
            keep = at < end
            at, end = at[keep], end[keep]
        return np.array(hits, np.int64), np.array(found, np.int64)

    def covered(self, texts: list[str | None], share: float = SHARE) -> list[list[tuple[int, float]]]:
        """For each text, the items of which at least ``share`` of the words lie in stretches that it holds, with that share."""
        number = self.number.get
        parts = [np.fromiter((number(w, 0) for w in words(t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        if not len(self.runs) or not len(texts):
            return out
        flat = np.concatenate(parts) if len(parts) else np.empty(0, np.int64)
        hits, found = self.search(flat, starts, ends)
        doc = np.searchsorted(ends, hits, "right")
        per: dict[tuple[int, int], set[int]] = {}
        for d, p in zip(doc.tolist(), found.tolist()):
            for item, i in self.where[p]:
                per.setdefault((d, item), set()).add(i)
        for (d, item), at in per.items():
            have = len({j for i in at for j in range(i, i + self.m)})
            if have >= share * self.length[item]:
                out[d].append((item, have / self.length[item]))
        return out


def item_blocks(items: DataFrame, key: str, text: str, most: int = BLOCK_ITEMS, most_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of bounded size, one after another on the driver."""
    block, size = [], 0
    for r in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).distinct().toLocalIterator():
        n = len(r[1])
        if block and (len(block) >= most or size + n > most_words * 6):
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", stretch: int = STRETCH, share: float = SHARE, most: int = BLOCK_ITEMS) -> DataFrame:
    """``(<doc_key>, <item_key>, share)``: the items that each document holds in whole or in part.

    A case is an item of which at least ``share`` of the words lie in stretches of
    ``stretch`` or more consecutive words that also stand consecutively in the
    document. The items are the query set: they are taken in blocks of bounded
    size, each of which is broadcast and searched for in all documents, without a
    shuffle of documents. Null and empty documents hold nothing; items with fewer
    than ``stretch`` words are never found; repeated document rows give one row for
    a pair; items that repeat a key with other texts count as one item, with the
    highest share; other columns are ignored.
    """
    spark = docs.sparkSession
    dk, ik = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {dk}, `{item_key}` {ik}, share double"
    arrow = to_arrow_type(items.schema[item_key].dataType)
    done = None
    for block in item_blocks(items, item_key, item_text, most):
        shared = spark.sparkContext.broadcast(Patterns(block, stretch))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for b in batches:
                keys, items_, shares = [], [], []
                for k, found in zip(b.column(0).to_pylist(), p.covered(b.column(1).to_pylist(), share)):
                    for item, part in found:
                        keys.append(k), items_.append(p.ids[item]), shares.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(items_, arrow), pa.array(shares, pa.float64())], names=[doc_key, item_key, "share"])

        part = docs.select(doc_key, F.col(doc_text).alias("_t")).where(F.col("_t").isNotNull()).mapInArrow(search, schema)
        done = part if done is None else done.unionByName(part)
    if done is None:
        return spark.createDataFrame([], schema)
    return done.groupBy(doc_key, item_key).agg(F.max("share").alias("share"))

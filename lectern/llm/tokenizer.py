"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by overlapping chunks.

Every text is cut into chunks. Where a chunk ends, the next characters belong to
both chunks, and the cut is moved to the first place in them at which two scans for
pre-tokens are in step wherever they began: the pre-tokens left and right of it don't
depend on each other. The pieces between such cuts are encoded on their own. Where
the overlap has no such place, the chunks stay joined.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenisation pattern of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest vocabulary file that is broadcast.
VOCAB_LIMIT = 64 << 20
#: Characters of a chunk and of its overlap with the next one; chunks of one text that a task works on before others take over.
CHUNK, OVERLAP, CHUNKS = 1 << 10, 1 << 8, 64

#: A place that no pre-token goes on across: before white space; between letters and digits; between these and other
#: signs, but for an apostrophe before letters. A scan has a boundary here wherever it began.
IN_STEP = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")

_ENCODERS: dict[int, object] = {}


def vocabulary(path: str = VOCAB) -> bytes:
    """The bytes of a vocabulary file, whose size is checked, as it is broadcast."""
    with open(path, "rb") as f:
        data = f.read(VOCAB_LIMIT + 1)
    if len(data) > VOCAB_LIMIT:
        raise ValueError(f"{path} is larger than {VOCAB_LIMIT} bytes")
    return data


def encoder(data: bytes):
    """The encoder of a vocabulary, made once per worker."""
    key = hash(data)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of one piece; null and empty text have none. Special tokens' strings are ordinary text."""
    return enc.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


def decode(data: bytes, ids) -> str:
    """The text of a list of ids, by joining their raw bytes."""
    return b"".join(encoder(data).decode_tokens_bytes([int(i) for i in ids])).decode("utf-8", "replace")


def cut_near(text: str, at: int, overlap: int) -> int | None:
    """The first place from ``at`` on, within the overlap, at which all scans are in step; both ends of a text are such places."""
    if at <= 0 or at >= len(text):
        return at
    m = IN_STEP.search(text, at, min(len(text), at + overlap))
    return m.start() if m else None


def cuts(text: str, lo: int, hi: int, chunk: int, overlap: int) -> list[int]:
    """The cuts of the chunks that end after ``lo`` and before ``hi``."""
    found = []
    for at in range(lo + chunk, hi, chunk):
        c = cut_near(text, at, overlap)
        # an overlap longer than a chunk may give a cut twice
        if c is not None and (not found or c > found[-1]):
            found.append(c)
    return found


def encode_stretch(enc, text: str, lo: int, hi: int, first: bool, last: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[str | None, np.ndarray | None, str | None]:
    """``(head, ids, tail)`` of the chunks of ``text`` between ``lo`` and ``hi``, multiples of ``chunk`` but for the end.

    ``text`` also has a character before ``lo`` and the overlap after ``hi``, where
    there are any. ``head`` is the text before the first cut if that belongs to what
    is before ``lo``, ``tail`` the one after the last cut if it goes on after ``hi``;
    else they are none. Without a cut there are no ids, and all of the text is in
    ``head``.
    """
    begin = lo if first else cut_near(text, lo, overlap)
    end = hi if last else cut_near(text, hi, overlap)
    at = [c for c in cuts(text, lo, hi, chunk, overlap) if (begin is None or c > begin) and (end is None or c < end)]
    if begin is not None:
        at.insert(0, begin)
    if end is not None and (not at or end > at[-1]):
        at.append(end)
    if not at:
        return text[lo:hi], None, None
    ids = [encode(enc, text[a:b]) for a, b in zip(at, at[1:])]
    head = text[lo : at[0]] if begin is None else None
    tail = text[at[-1] : hi] if end is None else None
    return head, np.concatenate(ids) if ids else np.empty(0, np.uint32), tail


def stitch(enc, parts: list[tuple[str | None, np.ndarray | None, str | None]]) -> np.ndarray:
    """The ids of a text from its stretches in order: open ends that meet are encoded together."""
    out, open_ = [], []
    for head, ids, tail in parts:
        if head is not None:
            open_.append(head)
        if ids is None:
            continue
        out.append(encode(enc, "".join(open_)))
        out.append(np.asarray(ids, np.uint32))
        open_ = [] if tail is None else [tail]
    out.append(encode(enc, "".join(open_)))
    return np.concatenate(out)


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([0 if p is None else len(p) for p in parts], out=offsets[1:])
    given = [p for p in parts if p is not None]
    values = np.concatenate(given).astype(np.int32) if given else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([p is None for p in parts]))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB, chunk: int = CHUNK, overlap: int = OVERLAP, chunks: int = CHUNKS) -> DataFrame:
    """``(<key>, ids)``: one row for every row of ``df``.

    All texts are encoded by overlapping chunks of ``chunk`` characters. A text of
    up to ``chunks`` of them is one stretch, which is worked on where it lies. Longer
    ones are several stretches that are dealt out to tasks; their ids are gathered
    and stitched by key and whole text, so that repeated and null keys, and repeated
    rows, keep a row each at every length. Null and empty texts give the empty
    list, blank ones are encoded; an empty table gives no rows; other columns are
    ignored.
    """
    if chunk < 1 or overlap < 1 or chunks < 1:
        raise ValueError("chunk, overlap and chunks are at least 1")
    data = df.sparkSession.sparkContext.broadcast(vocabulary(vocab))
    kind = df.schema[key].dataType.simpleString()
    size = chunk * chunks
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    n = F.length("t")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        for b in batches:
            d = b.select(["no", "total", "base", "t"]).to_pydict()
            done = []
            for no, total, base, t in zip(d["no"], d["total"], d["base"], d["t"]):
                t = t or ""
                lo = no * size - base
                done.append(encode_stretch(enc, t, lo, len(t) if no == total - 1 else lo + size, no == 0, no == total - 1, chunk, overlap))
            columns = [pa.array([p[0] for p in done], pa.string()), _lists([p[1] for p in done]), pa.array([p[2] for p in done], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("copies"), b.column("total"), b.column("h"), b.column("no"), *columns], names=["k", "copies", "total", "h", "no", "head", "ids", "tail"])

    schema = f"k {kind}, copies bigint, total int, h string, no int, head string, ids array<int>, tail string"
    one = rows.where(F.col("t").isNull() | (n <= size)).select("k", F.lit(1).cast("bigint").alias("copies"), F.lit(1).alias("total"), F.lit("").alias("h"), F.lit(0).alias("no"), F.lit(0).alias("base"), "t")
    short = one.mapInArrow(stretches, schema).select(F.col("k").alias(key), "ids")
    # equal rows are encoded once; a key may have several texts, and texts several keys
    many = rows.where(n > size).groupBy("k", "t").agg(F.count("*").alias("copies")).withColumn("total", F.ceil(n / size).cast("int"))
    many = many.select("k", "t", "copies", "total", F.concat_ws("-", F.md5("t"), n).alias("h"), F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("no"))
    base = F.greatest(F.col("no") * size - 1, F.lit(0))
    part = F.substring("t", base + 1, F.lit(size + overlap + 2))
    parts = many.select("k", "copies", "total", "h", "no", base.alias("base"), part.alias("t")).repartition("h", "no").mapInArrow(stretches, schema)
    gathered = parts.groupBy("k", "h", "copies").agg(F.array_sort(F.collect_list(F.struct("no", "head", "ids", "tail"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        for b in batches:
            ids = [stitch(enc, [(p["head"], p["ids"], p["tail"]) for p in parts]) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("copies"), _lists(ids)], names=["k", "copies", "ids"])

    long = gathered.select("k", "copies", "parts").mapInArrow(join, f"k {kind}, copies bigint, ids array<int>")
    long = long.select(F.col("k").alias(key), "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(key, "ids")
    return short.unionByName(long)

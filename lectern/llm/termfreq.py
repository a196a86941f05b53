"""Occurrences and passages of every term, aggregated out of core by partitions of the terms' hash bits."""

from __future__ import annotations

import os
import re
import shutil
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sharedfs import shared_dir, written
from ..operators.distinct import distinct_by

RARE, COMMON = 3, 0.25
#: Rows of partial counts in a partition before it is split further, and terms kept by a task before they are passed on.
PARTITION_ROWS, HELD = 150_000, 400_000
#: Bits of the first partitioning and of each further one, partitions at most, and the memory of each aggregation.
BITS, MORE_BITS, PARTITIONS, MEMORY = 10, 6, 50_000, "300MB"

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[str]:
    """The longest runs of letters, marks and digits, after NFC and lower-casing."""
    if text.isascii():
        return text.encode().translate(_PLAIN).decode().split()
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


def partial_counts(df: DataFrame, fields: list[str], held: int = HELD) -> DataFrame:
    """``(field, term, occurrences, passages)`` of parts of the rows; a null term counts the rows whose field isn't null."""
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ, rows, seen = [Counter() for _ in names], [Counter() for _ in names], [0] * len(names)

        def out() -> Iterator[pa.RecordBatch]:
            for i, name in enumerate(names):
                if seen[i] or occ[i]:
                    keys = [*occ[i], None]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys, pa.string()), pa.array([*occ[i].values(), seen[i]], pa.int64()), pa.array([*map(rows[i].__getitem__, occ[i]), seen[i]], pa.int64())], names=["field", "term", "occurrences", "passages"])
                    occ[i].clear(), rows[i].clear()
                    seen[i] = 0

        for b in batches:
            for i in range(len(names)):
                for text in b.column(i).to_pylist():
                    if text is not None:
                        seen[i] += 1
                        found = terms(text)
                        occ[i].update(found)
                        rows[i].update(set(found))
                    if len(occ[i]) > held:
                        yield from out()
        yield from out()

    return df.select(*[F.col(f) for f in names]).mapInArrow(count, "field string, term string, occurrences bigint, passages bigint")


def radix_ranges(count: Callable[[int, list[int] | None, int], dict[int, int]], most: int, bits: int = BITS, more: int = MORE_BITS) -> list[int]:
    """The first hash of each partition, in order, as unsigned 64-bit numbers.

    ``count(bits, prefixes, parent)`` gives the rows by their hash's first ``bits``
    bits, of all or of those whose first ``parent`` bits are among ``prefixes``.
    Prefixes with more than ``most`` rows are counted by ``more`` further bits, and
    so on until none is too large or a single hash is left; neighbouring small ones
    are put together.
    """
    sizes = [(p << (64 - bits), n) for p, n in count(bits, None, 0).items() if n <= most]
    large, at = [p for p, n in count(bits, None, 0).items() if n > most], bits
    while large:
        deeper = min(64, at + more)
        found = count(deeper, large, at)
        large, at = [p for p, n in found.items() if n > most and deeper < 64], deeper
        sizes += [(p << (64 - deeper), n) for p, n in found.items() if n <= most or deeper == 64]
    starts, used = [0], 0
    for first, n in sorted(sizes):
        if used and used + n > most:
            starts.append(first)
            used = 0
        used += n
    return starts


def scratch(folder: str) -> str:
    """Where a task's DuckDB may spill: the shared folder if that is a path, else one of the folders to which Spark itself spills.

    What is spilled is of use to the same task only and is removed by it.
    """
    if folder.startswith(("file://", "/")):
        return folder.removeprefix("file://")
    for name in ("LOCAL_DIRS", "SPARK_EXECUTOR_DIRS", "SPARK_LOCAL_DIRS"):
        if given := os.environ.get(name):
            return re.split(f"[,{os.pathsep}]", given)[0]
    return os.getcwd()


def radix_sum(partial: DataFrame, most: int = PARTITION_ROWS, bits: int = BITS, memory: str = MEMORY) -> DataFrame:
    """Sums of ``partial`` by field and term, each partition of hash bits by DuckDB in bounded memory.

    Only the hashes ``h`` of the terms are read to count the partitions, first all
    by ``bits`` bits, then again and again those with more than ``most`` rows by
    further bits. Each partition goes to disk with Spark's shuffle, is one task, and
    DuckDB spills what exceeds its memory.
    """
    spark = partial.sparkSession
    keyed = partial.where(F.col("term").isNotNull())
    seen: dict[int, int] = {}

    def count(n: int, prefixes: list[int] | None, parent: int) -> dict[int, int]:
        if prefixes is None and seen:
            return seen
        h = F.col("h")
        rows = keyed.select("h")
        if prefixes is not None:
            wanted = F.broadcast(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prefixes], "p bigint"))  # at most PARTITIONS
            rows = rows.join(wanted, F.shiftrightunsigned(h, 64 - parent) == F.col("p"), "left_semi") if parent < 64 else rows.join(wanted, h == F.col("p"), "left_semi")
        prefix = F.shiftrightunsigned(h, 64 - n) if n < 64 else h
        found = {r[0] % (1 << 64): r[1] for r in rows.groupBy(prefix.alias("p")).count().collect()}  # 2**bits rows, or 2**MORE_BITS for each prefix
        if prefixes is None:
            seen.update(found)
        return found

    most = max(most, sum(count(bits, None, 0).values()) // PARTITIONS)
    starts = np.array(radix_ranges(count, most, bits), np.uint64)
    folder = shared_dir(spark)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = np.searchsorted(starts, b.column("h").to_numpy().view(np.uint64), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), *(b.column(c) for c in ("field", "term", "occurrences", "passages"))], names=["unit", "field", "term", "occurrences", "passages"])

    parts = keyed.mapInArrow(route, "unit int, field string, term string, occurrences bigint, passages bigint").repartitionById(len(starts), "unit").drop("unit")

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return

        def stream() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        spill = f"{scratch(folder)}/duckdb-{uuid.uuid4().hex}"
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            incoming = pa.RecordBatchReader.from_batches(first.schema, stream())
            con.register("incoming", incoming)
            done = con.sql("select field, term, sum(occurrences)::bigint occurrences, sum(passages)::bigint passages from incoming group by field, term").to_arrow_reader(50_000)
            for b in done:
                if b.num_rows:
                    yield b
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return parts.mapInArrow(aggregate, "field string, term string, occurrences bigint, passages bigint")


def term_statistics(df: DataFrame, key: str = "passage_id", fields: tuple[str, ...] = ("content", "contextual_content"), rare: int = RARE, common: float = COMMON, most: int = PARTITION_ROWS, bits: int = BITS) -> DataFrame:
    """``(field, term, occurrences, passages, mark)`` of every term of every field.

    Rows that repeat a key count once, rows with a null key not at all. ``mark`` is
    ``rare`` for terms in fewer than ``rare`` rows, ``common`` for those in more
    than the share ``common`` of the rows whose field isn't null, ``rare`` if both
    hold, else null. Null and empty texts have no terms; an empty table gives no
    rows; other columns are ignored.
    """
    partial = written(partial_counts(distinct_by(df.select(key, *fields), key), list(fields)).withColumn("h", F.xxhash64("term")), "terms")
    n = {r[0]: r[1] for r in partial.where("term is null").groupBy("field").agg(F.sum("passages")).collect()}
    limit = F.lit(None).cast("double")
    for f in fields:
        limit = F.when(F.col("field") == f, F.lit(float(n.get(f, 0)) * common)).otherwise(limit)
    mark = F.when(F.col("passages") < rare, "rare").when(F.col("passages") > limit, "common")
    return radix_sum(partial, most, bits).withColumn("mark", mark)

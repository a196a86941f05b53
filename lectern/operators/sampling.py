"""Planning a sample of papers over months: quotas, stratified take with deficits carried on, catch-up."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST, LAST = "2024-01", "2025-12"
# What the monthly query asks for.
CATEGORIES = ("cs.CL", "cs.IR")
PHRASE = "retrieval-augmented generation"


def months(first: str = FIRST, last: str = LAST) -> list[str]:
    y, m = map(int, first.split("-"))
    out = []
    while (here := f"{y:04d}-{m:02d}") <= last:
        out.append(here)
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def month_spine(spark: SparkSession, first: str = FIRST, last: str = LAST) -> DataFrame:
    """``(idx, month)``, one row a month."""
    days = f"sequence(date'{first}-01', date'{last}-01', interval 1 month)"
    return spark.range(1).select(F.posexplode(F.expr(f"transform({days}, d -> date_format(d, 'yyyy-MM'))")).alias("idx", "month"))


def quotas(limit: int, spine: list[str]) -> dict[str, int]:
    """Papers wanted of each month: evenly spread months with one each if there are no more papers than months, else equal shares, the first months one more."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    n = len(spine)
    if limit == 0:
        return dict.fromkeys(spine, 0)
    if limit <= n:
        chosen = {int(i * (n / limit)) for i in range(limit)}
        return {m: int(i in chosen) for i, m in enumerate(spine)}
    return {m: limit // n + (i < limit % n) for i, m in enumerate(spine)}


def quota_rows(spine: DataFrame, limit: int) -> DataFrame:
    """``(idx, month, quota)`` for a spine DataFrame."""
    rows = spine.collect()  # one row a month
    q = quotas(limit, [r["month"] for r in sorted(rows, key=lambda r: r["idx"])])
    return spine.select("idx", "month", F.element_at(F.create_map(*[F.lit(x) for kv in q.items() for x in kv]), F.col("month")).alias("quota"))


def monthly_predicate(year: int, month: int, categories: tuple[str, ...] = tuple(CATEGORIES), phrase: str = PHRASE) -> Column:
    """The monthly search as a filter on entries: a category, the phrase in title or summary, and the month."""
    start = f"{year:04d}-{month:02d}-01"
    day = F.try_to_date(F.substring("published", 1, 10), "yyyy-MM-dd")
    topic = F.arrays_overlap("categories", F.array(*map(F.lit, categories)))
    said = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(phrase)) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lit(phrase))
    return topic & said & (day >= F.lit(start).cast("date")) & (day <= F.last_day(F.lit(start).cast("date")))


@dataclass
class Plan:
    take: dict[str, int]
    shortfalls: list[tuple[str, int, int]]
    catch_up: dict[str, int]


def plan(available: dict[str, int], have: dict[str, int], quota: dict[str, int], limit: int, page: int = 50) -> Plan:
    """How many new papers to take of each month.

    Months are visited in order. What a month lacks is carried to the next; its
    surplus isn't subtracted. A month whose total stays below its target is logged
    ``(month, target, total)``. If papers are still missing at the end, months are
    visited in reverse, each for up to a further page of its candidates.
    """
    total = sum(have.get(m, 0) for m in quota)
    carry, take, log = 0, dict.fromkeys(quota, 0), []
    for m, q in quota.items():
        if total >= limit:
            break
        target, carry = q + carry, 0
        own = have.get(m, 0)
        if target <= 0 or own >= target:
            continue
        n = min(target - own, available.get(m, 0), limit - total)
        take[m] = n
        total += n
        if own + n < target:
            carry = target - own - n
            log.append((m, target, own + n))
    more = dict.fromkeys(quota, 0)
    for m in reversed(list(quota)):
        n = min(max(0, min(available.get(m, 0), page * 2) - max(take[m], page)), limit - total)
        if n > 0:
            more[m] = n
            total += n
    return Plan(take, log, more)


def stratified_take(candidates: DataFrame, quota: dict[str, int], limit: int, have: DataFrame | None = None, key: str = "arxiv_id", month: str = "month_stratum", order: list[Column] | None = None) -> tuple[DataFrame, Plan]:
    """The planned candidates, ranked in each month by ``order``; those already there are left out.

    Only one count a month comes to the driver.
    """
    fresh = candidates if have is None else candidates.join(have.select(key).distinct(), key, "left_anti")
    spine = list(quota)
    available = {r[0]: r[1] for r in fresh.where(F.col(month).isin(spine)).groupBy(month).count().collect()}
    there = {r[0]: r[1] for r in have.where(F.col(month).isin(spine)).groupBy(month).count().collect()} if have is not None else {}
    p = plan(available, there, quota, limit)
    last = {m: (p.take[m], p.catch_up[m]) for m in spine}
    rank = F.row_number().over(Window.partitionBy(month).orderBy(*(order or [F.col(key)])))
    wanted = F.lit(False)
    for m, (n, more) in last.items():
        if n or more:
            r = F.col("rank_in_month")
            wanted = wanted | ((F.col(month) == m) & ((r <= n) | ((r > max(n, 50)) & (r <= max(n, 50) + more))))
    return fresh.where(F.col(month).isin(spine)).withColumn("rank_in_month", rank).where(wanted), p


def breakdown(spine: DataFrame, papers: DataFrame, skipped: DataFrame, month: str = "month_stratum") -> DataFrame:
    """``(month, target, achieved, skipped, status)`` for a spine with quotas; months without papers count 0."""
    got = papers.groupBy(F.col(month).alias("month")).agg(F.count("*").alias("achieved"))
    lost = skipped.groupBy(F.col(month).alias("month")).agg(F.count("*").alias("skipped"))
    rows = spine.join(got, "month", "left").join(lost, "month", "left")
    a = F.coalesce("achieved", F.lit(0))
    return rows.select("month", F.col("quota").alias("target"), a.alias("achieved"), F.coalesce("skipped", F.lit(0)).alias("skipped"), F.when(a >= F.col("quota"), "reached").otherwise(F.concat(F.lit("short by "), (F.col("quota") - a).cast("string"))).alias("status"))


def seeded_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows without replacement, by their places in the order of the key.

    The places are Python's ``random.Random(seed).sample``; the row numbers are
    made without gathering the rows in one task.
    """
    ordered = df.select(key).distinct()
    total = ordered.count()
    places = sorted(random.Random(seed).sample(range(total), min(n, total)))
    buckets = ordered.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    from ..sharedfs import written

    buckets = written(buckets, "places")
    sizes = sorted((r[0], r[1]) for r in buckets.groupBy("_p").count().collect())  # one row a partition
    base, before = {}, 0
    for p, c in sizes:
        base[p] = before
        before += c
    if not places:
        return df.limit(0)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("_p"))
    place = offset + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    chosen = df.sparkSession.createDataFrame([(i,) for i in places], "place int")
    keys = buckets.withColumn("place", place.cast("int")).join(F.broadcast(chosen), "place", "left_semi").select(key)  # n rows
    return df.join(keys, key, "left_semi")

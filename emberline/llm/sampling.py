"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """About ``n`` rows, all if there are no more, and never above 2 n.

    Rows are drawn by a hash of ``key`` (of their position where it is null)
    in one filter, so nothing is sorted or exchanged.
    """
    total = rows.count()
    if total <= n:
        return rows
    place = F.xxhash64(F.monotonically_increasing_id())
    mark = F.when(key.isNull(), place).otherwise(F.xxhash64(key.cast("string"), F.lit("sample")))
    return rows.filter(F.pmod(mark, F.lit(1 << 30)) < int((1 << 30) * 0.97 * n / total)).limit(2 * n)


def sample_by_group(rows: DataFrame, key: Column, group: Column, n: int, least: int) -> DataFrame:
    """About ``n`` rows, and of each ``group`` at least ``least`` or all it has.

    Groups are counted over all rows.  A group that ``n`` would leave with less
    than 2 ``least`` rows gets the rate for that many, so a sample is never
    above twice ``n`` + 2 ``least`` for each group.  Rows are drawn by a hash as
    in :func:`bounded_sample`; ``group`` is a string and not null.
    """
    sizes = {r["g"]: r["n"] for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}  # a row a group
    total = sum(sizes.values())
    if total <= n:
        return rows
    rates = {g: min(1.0, max(0.97 * n / total, 2 * least / size)) for g, size in sizes.items()}
    rate = F.element_at(F.create_map(*[F.lit(x) for g, r in rates.items() for x in (g, int((1 << 30) * r))]), group)
    place = F.xxhash64(F.monotonically_increasing_id())
    mark = F.when(key.isNull(), place).otherwise(F.xxhash64(key.cast("string"), F.lit("sample")))
    expected = sum(sizes[g] * r for g, r in rates.items())
    return rows.filter(F.pmod(mark, F.lit(1 << 30)) < rate).limit(int(2 * expected))

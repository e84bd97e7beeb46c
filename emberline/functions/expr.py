"""Column helpers shared by all operators.  Everything here stays in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, places: int) -> Column:
    """Round half up by ``floor(x * 10^k + 0.5) / 10^k``.

    The steps are plain IEEE operations, so other engines reproduce them bit
    for bit.  It differs from half-even rounding only on exact ties.
    """
    p = float(10**places)
    return F.floor(as_col(c) * F.lit(p) + F.lit(0.5)) / F.lit(p)


def trunc_int(c: Column) -> Column:
    return F.floor(c).cast("int")


def clamp(c: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        c = F.greatest(F.lit(low), c)
    if high is not None:
        c = F.least(F.lit(high), c)
    return c


def flag(cond: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def hash_uniform(salt: str, key: Column | str) -> Column:
    """Uniform draw in [0, 1) that depends only on (salt, key).

    Being stateless, it gives the same value whatever the partitioning and
    however often a lost task is run again.  One salt per draw.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), as_col(key).cast("string")))
    # through long: reading a text as a double costs Spark several times as much
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def uniform_between(low: float | Column, high: float | Column, u: Column) -> Column:
    if isinstance(low, Column) or isinstance(high, Column):
        return low + (high - low) * u
    return F.lit(float(low)) + F.lit(round(float(high) - float(low), 10)) * u


def lookup(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Small fixed mapping as ``CASE WHEN``: no join, no shuffle."""
    c = as_col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def by_month(month: Column | str, values: Iterable) -> Column:
    """Value of a twelve-entry table; null outside 1..12."""
    return F.get(F.array(*[F.lit(v) for v in values]), as_col(month) - 1)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when ``text`` holds any word as a plain substring."""
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def fixed_sum(c: Column | str, places: int) -> Column:
    """Sum of a column known to ``places`` decimals, as fixed-point longs.

    Integer addition is associative, so the total does not depend on how rows
    were partitioned, and it stays in a primitive aggregation buffer.
    """
    p = float(10**places)
    return F.sum(F.floor(as_col(c) * F.lit(p) + F.lit(0.5))) / F.lit(p)


def fixed_avg(c: Column | str, places: int) -> Column:
    return F.try_divide(fixed_sum(c, places), F.count(as_col(c)))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0)).cast("long")

"""Data quality: request validation, table checks, leakage audit."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import fixed_values as fv
from emberline.functions.expr import rnd
from emberline.session import ship_package
from emberline.sources.staging import stage


def request_reasons(ranges: Mapping[str, tuple] = fv.REQUEST_RANGES) -> Column:
    """Array of the rules a request breaks; empty when it is acceptable."""
    checks = [
        F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(f"{c} out of range"))
        for c, (low, high) in ranges.items()
    ]
    size_ok = F.coalesce(F.col("business_size").isin(*fv.BUSINESS_SIZES), F.lit(False))
    checks.append(F.when(~size_ok, F.lit("business_size unknown")))
    if_dated = F.when(F.col("event_date").isNull(), F.lit("event_date missing"))
    return F.filter(F.array(*checks, if_dated), lambda r: r.isNotNull())


def validate_requests(df: DataFrame) -> DataFrame:
    """Adds ``reasons`` and ``accepted``."""
    checked = df.withColumn("reasons", request_reasons())
    return checked.withColumn("accepted", F.size("reasons") == 0)


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_requests(df)
    return (
        checked.filter("accepted").drop("reasons", "accepted"),
        checked.filter("not accepted").drop("accepted"),
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Groups of equal rows with their count.

    First pass: counts per 64-bit row hash (8 bytes per row shuffled, copies
    merged map side).  Only rows whose hash repeats are compared in full; a
    row with many copies is merged map side.
    """
    hashed = df.select(*columns).withColumn("_h", F.xxhash64(*columns))
    repeated = stage(
        hashed.groupBy("_h").count().filter("count > 1").select("_h"), "repeated-hashes"
    )
    suspects = hashed.join(repeated, "_h", "left_semi")
    return suspects.groupBy(*columns).agg(F.count("*").alias("n_copies")).filter("n_copies > 1")


def dataset_checks(
    df: DataFrame, columns: Sequence[str], scaled: Sequence[str], tolerance: float = 0.001
) -> DataFrame:
    """One row: rows, nulls, duplicate rows, scaled minimum and maximum, verdict."""
    nulls = None
    for c in columns:
        n = F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0))
        nulls = n if nulls is None else nulls + n
    # an aggregate without keys always yields exactly one row
    dup = duplicate_rows(df, columns).agg(
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("n")
    )
    base = df.agg(
        F.count("*").alias("n_rows"),
        nulls.alias("n_nulls"),
        F.array_min(F.array(*[F.min(c) for c in scaled])).alias("min_scaled"),
        F.array_max(F.array(*[F.max(c) for c in scaled])).alias("max_scaled"),
    ).withColumn("n_duplicates", dup.scalar())
    return base.withColumn(
        "passed",
        (F.col("n_nulls") == 0)
        & (F.col("n_duplicates") == 0)
        & (F.col("min_scaled") >= F.lit(-tolerance))
        & (F.col("max_scaled") <= F.lit(1.0 + tolerance)),
    )


PAIR = "left string, right string, n long, mx double, my double, xx double, yy double, xy double"


def _cross_sums(left: Sequence[str], right: Sequence[str]):
    """Per task and pair of columns: rows with both values, means, and sums of products around the means."""
    k = len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            there = np.isfinite(columns)
            columns = np.where(there, columns, 0.0)
            x, y = columns[:k], columns[k:]
            mx, my = there[:k].astype(np.float64), there[k:].astype(np.float64)
            n = mx @ my.T
            some = np.maximum(n, 1)
            # sums around a value near the middle of each column lose no digits
            cx, cy = (c.sum(1) / np.maximum(m.sum(1), 1) for c, m in ((x, mx), (y, my)))
            x, y = (x - cx[:, None]) * mx, (y - cy[:, None]) * my
            sx, sy = x @ my.T, mx @ y.T
            part = [
                n, cx[:, None] + sx / some, cy[None, :] + sy / some, (x * x) @ my.T - sx * sx / some,
                mx @ (y * y).T - sy * sy / some, x @ y.T - sx * sy / some,
            ]
            total = part if total is None else _merged(total, part)
        if total is not None:
            names = [[a for a in left for _ in right], [b for _ in left for b in right]]
            columns = [*map(pa.array, names), pa.array(total[0].ravel().astype(np.int64))] + [pa.array(v.ravel()) for v in total[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PAIR.split(", ")])

    return run


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy, share = b[1] - a[1], b[2] - a[2], a[0] * b[0] / some
    return [
        n, a[1] + dx * b[0] / some, a[2] + dy * b[0] / some,
        a[3] + b[3] + dx * dx * share, a[4] + b[4] + dy * dy * share, a[5] + b[5] + dx * dy * share,
    ]


def cross_products(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(left, right, n, mx, my, xx, yy, xy) of every pair of columns, over the rows that have both.

    One pass: each task multiplies whole blocks of columns and emits one row a
    pair, with means and sums of squares and products around them.  Those rows
    (pairs times tasks) are merged around the common means.  Values that are
    null or not finite count as missing; pairs without a common row have n 0.
    """
    ship_package(df.sparkSession)
    columns = [F.col(f"`{c}`").cast("double").alias(f"{s}{i}") for s, cs in (("l", left), ("r", right)) for i, c in enumerate(cs)]
    parts = stage(df.select(*columns).mapInArrow(_cross_sums(left, right), PAIR), "cross-products")
    n = F.sum("n")
    mean = lambda m: F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("n")), n), F.lit(0.0))
    whole = parts.groupBy("left", "right").agg(n.alias("n"), mean("mx").alias("_x"), mean("my").alias("_y"))
    dx, dy = F.col("mx") - F.col("_x"), F.col("my") - F.col("_y")
    both = parts.join(whole.drop("n"), ["left", "right"])
    return both.groupBy("left", "right").agg(
        F.sum("n").alias("n"), F.first("_x").alias("mx"), F.first("_y").alias("my"),
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"),
    )


def correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with the target: (feature, correlation).

    Each feature is correlated over the rows that have both values; a constant
    column, or one without such rows, has no correlation (null).
    """
    return all_correlations(df, features, [target]).drop("target")


def all_correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(target, feature, correlation) of every feature with every target, from one pass."""
    pairs = cross_products(df, features, targets)
    # what is left of a constant by rounding is no spread
    spread = lambda s, m: F.when(F.col(s) > F.col("n") * (F.lit(1e-24) + F.col(m) * F.col(m) * F.lit(1e-28)), F.col(s))
    r = F.try_divide(F.col("xy"), F.sqrt(spread("xx", "mx")) * F.sqrt(spread("yy", "my")))
    found = pairs.select(F.col("right").alias("target"), F.col("left").alias("feature"), rnd(r, 6).alias("correlation"))
    asked = df.sparkSession.createDataFrame([(t, f) for t in targets for f in features], "target string, feature string")
    return asked.join(found, ["target", "feature"], "left")


def dependent_features(
    df: DataFrame, features: Sequence[str], target: str, given: Sequence[str], least: float = 0.9995
) -> DataFrame:
    """(feature, explained, follows): from which features the target can be worked out, with what is known beforehand.

    For each feature the logarithm of the target is regressed on that of the
    feature and of the ``given`` columns (such as headcount and burners); the
    sums come from one pass of :func:`cross_products`.  ``explained`` is the
    share of the target's spread that it accounts for; from ``least`` on the
    target follows, as a product or quotient does.  Only positive values take
    part; a feature without them explains what ``given`` does without it.
    """
    names = [*dict.fromkeys([*features, *given, target])]
    logs = df.select(*[F.when(F.col(f"`{c}`").cast("double") > 0, F.log(F.col(f"`{c}`").cast("double"))).alias(c) for c in names])
    # a matrix of fixed size: columns times columns
    cells = {(r["left"], r["right"]): r for r in cross_products(logs, names, names).collect()}
    cov = lambda a, b: cells[a, b]["xy"] / cells[a, b]["n"] if cells[a, b]["n"] > 1 else 0.0

    def explained(known: Sequence[str]) -> float:
        known = [c for c in dict.fromkeys(known) if c != target and cov(c, c) > 1e-12 and cells[c, target]["n"] > 1]
        if not known or cov(target, target) <= 0:
            return 0.0
        matrix = np.array([[cov(a, b) for b in known] for a in known])
        right = np.array([cov(a, target) for a in known])
        return float(right @ np.linalg.lstsq(matrix, right, rcond=1e-10)[0] / cov(target, target))

    rows = [(f, min(1.0, max(0.0, explained([f, *given])))) for f in features if f != target]
    out = df.sparkSession.createDataFrame(rows, "feature string, explained double")
    return out.withColumn("follows", F.col("explained") >= F.lit(least))


def leakage_audit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    given: Sequence[str] = ("headcount", "num_burners", "duration_hrs"),
    label_inputs: Sequence[str] = fv.LABEL_INPUTS,
) -> DataFrame:
    """Correlation of every feature with the target, and where it comes from.

    Features from which the target can be worked out together with ``given``
    are found in the data (see :func:`dependent_features`); what went into the
    label is stated by ``label_inputs``.
    """
    found = dependent_features(df, features, target, given).select("feature", "follows")
    lineage = (
        F.when(F.col("follows"), "derived_from_target")
        .when(F.col("feature").isin(*label_inputs), "label_input")
        .otherwise("independent")
    )
    return correlations(df, features, target).join(found, "feature").select(
        "feature",
        "correlation",
        F.abs("correlation").alias("abs_correlation"),
        lineage.alias("lineage"),
        (~F.col("follows")).alias("in_leak_free_set"),
    )

"""Order statistics over groups of any size.

A plain ranking window puts a whole group in one task.  The functions here
split a group into cells of bounded size, add up the cells, and rank only
inside a cell, so one group may hold a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.expr import as_col
from emberline.sources.staging import stage

CELL_ROWS = 1 << 20  # rows of a cell, as far as that takes at most MOST_BINS bins
MOST_BINS = 10_000


def id_bins(df: DataFrame, id_col: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``_cell``: ascending bins of ``id_col`` with about equal row counts, whatever the ids.

    A mergeable sketch of the whole table gives the cuts, so sparse and
    clustered ids fill bins as evenly as dense ones.
    """
    n = df.select(F.count("*").alias("n")).first()["n"]
    bins = min(MOST_BINS, -(-n // cell_rows))
    if bins < 2:
        return df.withColumn("_cell", F.lit(0.0))
    probs = [i / bins for i in range(1, bins)]
    at = F.col(id_col).cast("double")
    cuts = df.select(F.percentile_approx(at, probs, 10 * bins).alias("q")).first()["q"]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    return Bucketizer(splits=splits, inputCol="_at", outputCol="_cell").transform(df.withColumn("_at", at)).drop("_at")


def ordered_position(
    df: DataFrame,
    keys: Sequence[str],
    level: Column,
    id_col: str,
    weight: Column | None = None,
    cell_width: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Adds ``prefix`` and ``group_total`` for the order (level, id) in a group.

    ``prefix`` is the sum of ``weight`` (1 by default) over the rows of the
    group that come before this row; ``group_total`` the sum over the group.
    ``level`` is an integer of low cardinality (such as a risk in tenths of a
    percent) and ``id_col`` a unique integer.

    A cell is (keys, level, bin of ids).  Bins hold about ``cell_rows`` rows of
    the whole table each (see :func:`id_bins`), so no cell is larger, however
    the ids lie; with ``cell_width`` bins are id ranges of that width instead.
    Cells are pre-aggregated map side; the running totals over levels and over
    cells touch one row per cell.  The cell table is staged, so the join back
    broadcasts it only when its known size allows, and otherwise joins on the
    cell key, which no single group can skew.
    """
    w = F.lit(1) if weight is None else weight
    if cell_width is None:
        binned = id_bins(df, id_col, cell_rows)
    else:
        binned = df.withColumn("_cell", F.floor(F.col(id_col) / F.lit(cell_width)))
    tagged = binned.withColumns({"_level": level, "_w": w.cast("long")})
    cells = tagged.groupBy(*keys, "_level", "_cell").agg(F.sum("_w").alias("_cell_w"))
    before_cell = (
        Window.partitionBy(*keys, "_level")
        .orderBy("_cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = stage(
        cells.withColumn(
            "_in_level", F.coalesce(F.sum("_cell_w").over(before_cell), F.lit(0))
        ),
        "cells",
    )
    levels = cells.groupBy(*keys, "_level").agg(F.sum("_cell_w").alias("_level_w"))
    by_level = Window.partitionBy(*keys).orderBy("_level")
    levels = levels.select(
        *keys,
        "_level",
        F.coalesce(
            F.sum("_level_w").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before_level"),
        F.sum("_level_w").over(Window.partitionBy(*keys)).alias("group_total"),
    )
    offsets = stage(
        cells.join(levels, [*keys, "_level"]).select(
            *keys,
            "_level",
            "_cell",
            (F.col("_before_level") + F.col("_in_level")).alias("_offset"),
            "group_total",
        ),
        "offsets",
    )
    in_cell = (
        Window.partitionBy(*keys, "_level", "_cell")
        .orderBy(id_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        tagged.join(offsets, [*keys, "_level", "_cell"])
        .withColumn(
            "prefix", F.col("_offset") + F.coalesce(F.sum("_w").over(in_cell), F.lit(0))
        )
        .drop("_level", "_cell", "_w", "_offset")
    )


MIDDLE_VALUES = 2_000  # distinct values of a column left between the brackets


def median_table(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Exact medians as rows (column_name, median) at any table size, all columns together.

    A pass brackets the middle of each column with a mergeable quantile sketch
    and counts the rows below the bracket and the distinct values inside.
    Columns whose bracket still holds more than MIDDLE_VALUES distinct values
    are narrowed by a sketch of the bracket alone in the next pass.  Then the
    few values left are counted and the middle is read off.  No window is used
    and no task holds a column.  Columns without a value have no row.
    """
    name = {c: F.col(f"`{c}`").cast("double") for c in columns}
    n = df.agg(*[F.count(v).alias(c) for c, v in name.items()]).first().asDict() if columns else {}
    wanted = {c: ((k + 1) // 2, k // 2 + 1) for c, k in n.items() if k}
    low = {c: float("-inf") for c in wanted}
    high = {c: float("inf") for c in wanted}
    below = dict.fromkeys(wanted, 0)
    inside = {c: n[c] for c in wanted}
    eps = 2.0 / accuracy
    open_ = list(wanted)
    while open_:
        # the sketch of what lies between the brackets
        between = {c: F.when((name[c] >= low[c]) & (name[c] <= high[c]), name[c]) for c in open_}
        asked = {}
        for c in open_:
            first, last = ((p - below[c]) / inside[c] for p in wanted[c])
            asked[c] = [min(1.0, max(0.0, first - eps)), min(1.0, max(0.0, last + eps))]
        q = df.agg(*[F.percentile_approx(v, asked[c], accuracy).alias(c) for c, v in between.items()]).first()
        ends = {c: (float(q[c][0]), float(q[c][1])) for c in open_}
        counts = df.agg(
            *[F.count_if(name[c] < ends[c][0]).alias(f"b {c}") for c in open_],
            *[F.count_if((name[c] >= ends[c][0]) & (name[c] <= ends[c][1])).alias(f"i {c}") for c in open_],
            *[F.approx_count_distinct(F.when((name[c] >= ends[c][0]) & (name[c] <= ends[c][1]), name[c])).alias(f"d {c}") for c in open_],
        ).first()
        again, sharper = [], False
        for c in open_:
            under, held = counts[f"b {c}"], counts[f"i {c}"]
            hit = under < wanted[c][0] and wanted[c][1] <= under + held
            narrower = hit and held < inside[c]
            if hit:
                (low[c], high[c]), below[c], inside[c] = ends[c], under, held
            if counts[f"d {c}"] > MIDDLE_VALUES or not hit:
                again.append(c)
                sharper |= not narrower  # a coarse sketch, or ties at both ends: the next one is finer
        open_ = again
        if sharper and accuracy < 1 << 24:
            accuracy *= 8
            eps = 2.0 / accuracy
        elif sharper:
            raise ValueError(f"the middle of {open_} cannot be narrowed")
    parts = [
        F.struct(F.lit(c).alias("column_name"), F.when((name[c] >= low[c]) & (name[c] <= high[c]), name[c]).alias("v"))
        for c in wanted
    ]
    found: dict[str, list[tuple[float, int]]] = {c: [] for c in wanted}
    if parts:
        left = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").filter("v is not null")
        for r in left.groupBy("column_name", "v").count().collect():  # the middle values alone
            found[r["column_name"]].append((r["v"], r["count"]))
    rows = []
    for c, (first, last) in wanted.items():
        upto, middle = below[c], []
        for v, k in sorted(found[c]):
            middle += [v] * ((upto < first <= upto + k) + (upto < last <= upto + k))
            upto += k
        rows.append((c, sum(middle) / 2.0))
    return df.sparkSession.createDataFrame(rows, "column_name string, median double")


def cumulative_by_value(
    df: DataFrame, value: str, sums: Sequence[str], n_bins: int = 1000
) -> DataFrame:
    """Running totals of ``sums`` in order of a distinct double ``value``.

    ``df`` has one row per distinct value (pre-aggregated).  Values are put in
    ``n_bins`` bins of about equal row count, bins are added up, and the
    window runs inside a bin.  Adds ``<sum>_before`` (exclusive) per column.
    """
    qs = [i / n_bins for i in range(1, n_bins)]
    cuts = df.select(F.percentile_approx(as_col(value), qs, 10 * n_bins).alias("q")).first()["q"]
    splits = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    binned = Bucketizer(splits=splits, inputCol=value, outputCol="_bin").transform(df)
    per_bin = binned.groupBy("_bin").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # one row per bin: at most n_bins + 1 rows
    over_bins = (
        Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bin.select(
        "_bin",
        *[F.coalesce(F.sum(f"_t_{s}").over(over_bins), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    in_bin = (
        Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = binned.join(offsets, "_bin")
    return joined.withColumns(
        {
            f"{s}_before": F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(in_bin), F.lit(0))
            for s in sums
        }
    ).drop("_bin", *[f"_o_{s}" for s in sums])

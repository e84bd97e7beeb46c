"""Cleaning, feature columns, encoding, imputation, scaling, column selection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import fixed_values as fv
from emberline.functions.expr import as_col, clamp, count_if, flag, lookup, rnd
from emberline.operators.joins import dimension_join
from emberline.operators.ordered import median_table
from emberline.sources.staging import stage


# ---- cleaning ------------------------------------------------------------


def _rules(ranges: Mapping[str, tuple]) -> dict[str, Column]:
    out = {}
    for c, (low, high) in ranges.items():
        v = F.col(c)
        cond = v >= F.lit(low)
        if high is not None:
            cond = cond & (v <= F.lit(high))
        out[c] = F.coalesce(cond, F.lit(False))
    return out


def clean_events(df: DataFrame, ranges: Mapping[str, tuple] = fv.EVENT_RANGES) -> DataFrame:
    """Rows within every range; a null value fails its range."""
    keep = F.lit(True)
    for cond in _rules(ranges).values():
        keep = keep & cond
    return df.filter(keep)


def clean_report(df: DataFrame, ranges: Mapping[str, tuple] = fv.EVENT_RANGES) -> DataFrame:
    """Rows in, rows kept and rows failing each rule, from one aggregate pass."""
    rules = _rules(ranges)
    keep = F.lit(True)
    for cond in rules.values():
        keep = keep & cond
    return df.agg(
        F.count("*").alias("rows_in"),
        count_if(keep).alias("rows_kept"),
        *[count_if(~cond).alias(f"bad_{c}") for c, cond in rules.items()],
    )


# ---- feature columns -----------------------------------------------------


def rate_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "kg_per_guest": rnd(F.col("consumption_kg") / F.col("headcount"), 4),
            "kg_per_burner_hr": rnd(
                F.col("consumption_kg") / (F.col("num_burners") * F.col("duration_hrs")), 4
            ),
        }
    )


def size_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "log_headcount": rnd(F.log1p("headcount"), 4),
            "event_scale": rnd(F.col("headcount") * F.col("duration_hrs") / F.lit(100.0), 3),
            "dish_load": rnd(F.col("num_dishes") * F.col("gas_intensity_per_serving"), 5),
        }
    )


def month_cycle(df: DataFrame, month: str = "month") -> DataFrame:
    angle = F.lit(2 * math.pi) * F.col(month) / F.lit(12.0)
    return df.withColumns({"month_sin": rnd(F.sin(angle), 4), "month_cos": rnd(F.cos(angle), 4)})


def season_intensity(wedding: Column, festival: Column, multiplier: Column) -> Column:
    return rnd(
        wedding * F.lit(0.4) + festival * F.lit(0.3) + (multiplier - F.lit(1.0)) * F.lit(0.3), 4
    )


def condition_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "heat_stress": flag(F.col("temp_mean_c") > 32),
            "price_surge_flag": flag(F.col("price_mom_change_inr") > 100),
            "is_monsoon": flag(F.col("month").isin(*fv.MONSOON_MONTHS)),
            "novice_peak_season": flag(
                (F.col("experience_yrs") <= 3) & (F.col("wedding_season") == 1)
            ),
        }
    )


def price_index(price: Column | str) -> Column:
    return rnd(as_col(price) / F.lit(fv.PRICE_INDEX_BASE), 4)


def experience_tier(years: Column | str, tiers: Sequence[tuple] = fv.EXPERIENCE_TIERS) -> Column:
    """Right-closed bins (0,2] (2,5] (5,10] (10,30]; null outside."""
    y = as_col(years)
    out = F.when(y <= 0, F.lit(None).cast("string"))
    for upper, name in tiers:
        out = out.when(y <= upper, F.lit(name))
    return out


def add_features(df: DataFrame) -> DataFrame:
    """The thirteen engineered columns of the modelling table."""
    df = condition_flags(month_cycle(size_features(rate_features(df))))
    return df.withColumns(
        {
            "season_intensity": season_intensity(
                F.col("wedding_season"), F.col("festival_flag"), F.col("demand_multiplier")
            ),
            "price_index": price_index("commercial_price_inr"),
            "experience_tier": experience_tier("experience_yrs"),
        }
    )


# ---- encoding ------------------------------------------------------------


def fit_label_classes(
    df: DataFrame, columns: Sequence[str] = fv.ENCODED, max_classes: int = 1000
) -> dict[str, list[str]]:
    """Sorted classes seen in each column.

    The combinations of category values are pre-aggregated first, so what is
    gathered is the vocabulary; a column with more than ``max_classes``
    classes is no category and is refused.
    """
    combos = df.groupBy(*columns).count()
    pairs = combos.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v"))
                    for c in columns
                ]
            )
        ).alias("s")
    ).select("s.*").distinct()
    limit = max_classes * len(columns) + 1
    rows = pairs.limit(limit).collect()
    classes = {c: sorted(r["v"] for r in rows if r["c"] == c) for c in columns}
    for c, values in classes.items():
        if len(values) > max_classes or len(rows) == limit:
            raise ValueError(f"{c} has too many classes for label encoding")
    return classes


def fit_vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, code): codes 0, 1, ... of the sorted distinct values, of any number.

    Distinct values are sorted into ranges and written; a value's code is its
    place in its range plus the values of the column before that range.  Only
    one count for each range and column is summed, and nothing is gathered.  A
    missing value counts as the text ``nan``.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias("value")) for c in columns]
    )
    values = stage(df.select(F.explode(pairs).alias("s")).select("s.*").distinct(), "values")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = values.repartitionByRange(parts, "column_name", "value").sortWithinPartitions("column_name", "value")
    lines = stage(sorted_.withColumn("line", F.monotonically_increasing_id()), "value-lines")
    part = F.shiftright("line", 33)
    counts = lines.groupBy("column_name", part.alias("part")).agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    shifts = counts.select(F.col("column_name").alias("_c"), F.col("part").alias("_p"), shift)
    joined = lines.join(shifts, (F.col("column_name") == F.col("_c")) & (part == F.col("_p")))
    return joined.select("column_name", "value", (F.col("line") + F.col("shift")).cast("int").alias("code"))


def encode_by_vocabulary(df: DataFrame, vocabulary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<col>_enc`` by joining each column's values; a value that was not fitted is UNKNOWN_CLASS.

    Common values are salted, so one class may hold any share of the rows.
    """
    for c in columns:
        side = vocabulary.filter(F.col("column_name") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = dimension_join(
            df.withColumn("_value", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))), side, ["_value"]
        ).withColumn(f"{c}_enc", F.coalesce("_code", F.lit(UNKNOWN_CLASS))).drop("_value", "_code")
    return df


def label_encode(df: DataFrame, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds ``<col>_enc``: position of the value among the sorted classes."""
    return df.withColumns(
        {
            f"{c}_enc": lookup(
                F.coalesce(F.col(c).cast("string"), F.lit("nan")),
                {v: i for i, v in enumerate(values)},
            )
            for c, values in classes.items()
        }
    )


def one_hot(
    df: DataFrame, column: str = "event_type", vocabulary: Sequence[str] = fv.EVENT_TYPES,
    prefix: str = "etype",
) -> DataFrame:
    """One 0/1 column per word of a fixed vocabulary, none dropped."""
    return df.withColumns({f"{prefix}_{v}": flag(F.col(column) == v) for v in vocabulary})


# ---- imputation and scaling ----------------------------------------------


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {r["column_name"]: r["median"] for r in median_table(df, columns).collect()}


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold a null, from one aggregate of counts."""
    row = df.agg(
        F.count("*").alias("n"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if row[f"n_{i}"] < row["n"]]


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    )


def fit_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Min and max of each column: two scalars per column from one aggregate."""
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}


def scale(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Columns mapped to [0, 1]; a constant column becomes 0."""
    cols = {}
    for c, (low, high) in ranges.items():
        v = F.col(c).cast("double")
        if low is None or high is None:
            continue
        if high == low:
            cols[c] = F.when(v.isNotNull(), F.lit(0.0))
        else:
            cols[c] = (v - F.lit(low)) / F.lit(high - low)
    return df.withColumns(cols)


def inverse_scale_clip(
    pred: Column | str, low: float, high: float, limits: tuple = fv.CONSUMPTION_LIMITS
) -> Column:
    """Scaled prediction back to kg, clipped, 2 decimals."""
    return rnd(clamp(as_col(pred) * F.lit(float(high - low)) + F.lit(float(low)), *limits), 2)


# ---- column selection ----------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_names(
    df: DataFrame, exclude: Sequence[str] = fv.NOT_FEATURES, also: Sequence[str] = (),
    ids: Sequence[str] = ("event_id", "caterer_id"),
) -> list[str]:
    gone = {*exclude, *also, *ids}
    return [c for c in numeric_columns(df) if c not in gone]


def select_features(
    df: DataFrame, exclude: Sequence[str] = fv.NOT_FEATURES, also: Sequence[str] = (),
    keep: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Numeric columns that are neither targets, leaks nor identifiers."""
    return df.select(*keep, *feature_names(df, exclude, also))


def scaled_columns(df: DataFrame) -> list[str]:
    gone = {*fv.UNSCALED, "event_id", "caterer_id"}
    return [
        c
        for c in numeric_columns(df)
        if c not in gone and not c.startswith("etype_") and not c.endswith("_enc")
    ]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to double; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


UNKNOWN_CLASS = -1


def encode(features: DataFrame, classes: Mapping[str, Sequence[str]], carry: str | None = None) -> DataFrame:
    """Encoded columns beside the numeric ones, with ``event_id`` and ``carry``; a class not fitted is UNKNOWN_CLASS."""
    enc = one_hot(label_encode(features, classes))
    enc = enc.withColumns({f"{c}_enc": F.coalesce(f"{c}_enc", F.lit(UNKNOWN_CLASS)) for c in classes})
    numeric = numeric_columns(enc)
    return enc.select(
        "event_id",
        *([carry] if carry else []),
        *[c for c in numeric if c not in ("event_id", "caterer_id", "shock_factor", "typical_dishes")],
    )


def fit_preparation(
    features: DataFrame, classes: Mapping[str, Sequence[str]] | None = None
) -> dict:
    """Classes, medians, ranges and column lists of a feature table.

    Medians are exact for all columns: where values are missing, and where a
    later table may have gaps.
    """
    classes = classes or fit_label_classes(features)
    enc = encode(features, classes)
    scaled = scaled_columns(enc)
    wanted = [*scaled, *[t for t in fv.TARGETS if t in enc.columns]]
    gaps = columns_with_nulls(enc, wanted)
    every = fit_medians(enc, wanted)
    medians = {c: every[c] for c in gaps if c in every}
    spare = {c: m for c, m in every.items() if c not in medians}
    ranges = fit_ranges(impute(enc, medians), wanted)
    return {
        "classes": {c: list(v) for c, v in classes.items()}, "medians": medians, "spare_medians": spare,
        "ranges": ranges, "scaled": scaled, "columns": enc.columns,
    }


def apply_preparation(features: DataFrame, fitted: Mapping, carry: str | None = None) -> DataFrame:
    """Any feature table as the fitted one was prepared: same classes, medians and ranges.

    Columns the table lacks (such as the targets of a new request) are left
    out; a missing value takes the fitted median.  The column ``carry`` stays.
    """
    enc = encode(features, fitted["classes"], carry)
    medians = {**fitted["spare_medians"], **fitted["medians"]}
    here = [c for c in fitted["columns"] if c in enc.columns] + ([carry] if carry else [])
    filled = impute(enc.select(*here), {c: m for c, m in medians.items() if c in here})
    return scale(filled, {c: tuple(r) for c, r in fitted["ranges"].items() if c in here})


def normalise(
    features: DataFrame,
    classes: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, dict]:
    """Feature table to the encoded, imputed and scaled modelling table.

    Returns the table (with ``event_id``) and the fitted parameters.
    """
    fitted = fit_preparation(features, classes)
    return apply_preparation(features, fitted), fitted

"""Training, scoring, evaluation and published versions of the five models.

The modelling table is encoded, imputed and scaled by ``features.normalise``.
Only fitted models, sums of fixed size, scalar parameters and one value per
feature reach the driver.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import fixed_values as fv
from emberline.functions.expr import count_if, flag, hash_uniform, rnd
from emberline.operators import features as ft
from emberline.operators import metrics
from emberline.operators.boosting import BoostedTrees, fit_edges, fit_trees
from emberline.operators.network import Network, NetworkSettings, fit_network
from emberline.sources.staging import stage

LABEL = "ran_out_of_gas"
COPY_BLOCK = 1000  # copies of a row made by one task at a time


@dataclass(frozen=True)
class TreeSettings:
    """Boosting settings; the defaults are the documented ones."""

    trees: int = 400
    regressor_depth: int = 5
    classifier_depth: int = 4
    rate: float = 0.05
    subsample: float = 0.8
    validation_share: float = 0.1
    patience: int = 20
    seed: int = 42


# ---- split and oversampling ------------------------------------------------


def add_split(df: DataFrame, key: str = "event_id", seed: str = "42", share: float = 0.8):
    """0/1 ``is_train`` by a hash of the key: the same rows however partitioned."""
    return df.withColumn("is_train", flag(hash_uniform(f"{seed}split", key) < share))


def add_validation(df: DataFrame, key: str = "event_id", seed: str = "42", share: float = 0.1):
    return df.withColumn("is_validation", hash_uniform(f"{seed}val", key) < share)


def _normal(salt: str, key: Column) -> Column:
    """Standard normal draw of (salt, key) by Box-Muller."""
    u1 = hash_uniform(f"{salt}a", key)
    u2 = hash_uniform(f"{salt}b", key)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def oversample(
    train: DataFrame,
    columns: Sequence[str],
    label: str = LABEL,
    key: str = "event_id",
    sigma: float = 0.015,
    clip: str = "observed",
    noisy: Sequence[str] | None = None,
    seed: str = "42",
) -> DataFrame:
    """Noisy copies of positive rows, up to half the number of negatives.

    Each positive row gets floor(r) copies and one more with probability
    frac(r), where r = rows to add / positives, so no global row index is
    needed.  ``clip`` ``observed`` keeps every column in its own range and adds
    noise to ``noisy`` columns only; ``unit`` adds noise to all columns and
    clips to [0, 1].  Returns the copies only; see :func:`append_rows`.
    """
    if clip not in ("observed", "unit"):
        raise ValueError("clip must be 'observed' or 'unit'")
    noisy = list(columns if clip == "unit" or noisy is None else noisy)
    n = train.agg(
        count_if(F.col(label) == 0).alias("neg"), count_if(F.col(label) == 1).alias("pos")
    ).first()
    to_add = max(0, n["neg"] // 2 - n["pos"])
    ratio = to_add / n["pos"] if n["pos"] else 0.0
    limits = (
        ft.fit_ranges(train, noisy) if clip == "observed" else {c: (0.0, 1.0) for c in noisy}
    )
    copies = F.lit(int(ratio)) + flag(
        hash_uniform(f"{seed}more", key) < F.lit(ratio - int(ratio))
    )
    rows = (
        train.filter(F.col(label) == 1)
        .withColumn("_n", copies)
        .filter("_n > 0")
        # blocks of copies are dealt out before they are multiplied
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPY_BLOCK))))
        .repartition(key, "_b")
        .withColumn("_last", F.least(F.col("_n").cast("long"), (F.col("_b") + 1) * COPY_BLOCK))
        .withColumn("copy_no", F.explode(F.sequence((F.col("_b") * COPY_BLOCK + 1).cast("int"), F.col("_last").cast("int"))))
        .drop("_n", "_b", "_last")
    )
    draw_key = F.concat_ws(":", F.col(key).cast("string"), F.col("copy_no").cast("string"))
    return rows.withColumns(
        {
            c: F.greatest(
                F.lit(lo),
                F.least(F.lit(hi), F.col(c) + F.lit(sigma) * _normal(f"{seed}z{c}", draw_key)),
            )
            for c, (lo, hi) in limits.items()
        }
    )


def append_rows(train: DataFrame, extra: DataFrame) -> DataFrame:
    """UNION ALL by name; copies carry no column the training rows lack."""
    return train.unionByName(extra.select(*train.columns))


# ---- models ----------------------------------------------------------------


def _assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error")


def boosted_regressor(columns: Sequence[str], label: str, pred: str, s: TreeSettings) -> Pipeline:
    gbt = GBTRegressor(
        labelCol=label, predictionCol=pred, maxIter=s.trees, maxDepth=s.regressor_depth,
        stepSize=s.rate, subsamplingRate=s.subsample, seed=s.seed,
    )
    return Pipeline(stages=[_assembler(columns), gbt])


def stop_after(errors: Sequence[float], patience: int) -> int:
    """Number of trees up to the best error before ``patience`` trees in a row bring none better."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_boosted_regressor(
    table: DataFrame, columns: Sequence[str], label: str, pred: str, s: TreeSettings
) -> PipelineModel:
    """Boosting that stops after ``s.patience`` trees without a better validation error.

    ``table`` has the boolean ``is_validation``; its rows are not trained on.
    All trees are grown first; if a shorter ensemble is better, it is grown
    anew, with the same seed.
    """
    train = table.filter(~F.col("is_validation"))
    model = boosted_regressor(columns, label, pred, s).fit(train)
    if s.trees <= s.patience:
        return model
    held = model.stages[0].transform(table.filter("is_validation"))
    if held.isEmpty():
        return model
    n = stop_after(model.stages[1].evaluateEachIteration(held, "squared"), s.patience)
    return model if n == s.trees else boosted_regressor(columns, label, pred, replace(s, trees=n)).fit(train)


@dataclass
class Models:
    """Fitted models with the parameters that scoring needs."""

    fitted: dict[str, BoostedTrees | Network]
    features: list[str]
    stockout_features: list[str]
    ranges: dict[str, tuple[float, float]]
    preparation: dict | None = None

    def parameters(self) -> dict:
        return {
            "preparation": self.preparation,
            "features": self.features,
            "stockout_features": self.stockout_features,
            "ranges": {k: list(v) for k, v in self.ranges.items()},
        }


def feature_sets(table: DataFrame, which: str = "reference") -> tuple[list[str], list[str]]:
    """(regression, stockout) feature names; ``leak_free`` drops target-derived ones."""
    if which not in ("reference", "leak_free"):
        raise ValueError("feature set must be 'reference' or 'leak_free'")
    gone = fv.TARGET_DERIVED if which == "leak_free" else ()
    skip = ("is_train", "copy_no")
    return (
        ft.feature_names(table, also=(*gone, *skip)),
        ft.feature_names(table, also=(*gone, *skip, *fv.LABEL_INPUTS)),
    )


def train_models(
    table: DataFrame,
    ranges: Mapping[str, tuple[float, float]],
    scaled: Sequence[str],
    settings: TreeSettings = TreeSettings(),
    feature_set: str = "reference",
    network: NetworkSettings = NetworkSettings(),
    preparation: dict | None = None,
) -> tuple[Models, DataFrame]:
    """Fits all five models; returns them and the held-out rows.

    ``table`` is the scaled modelling table with ``event_id``; ``preparation``
    what it was prepared with, which the models carry for new rows.
    """
    regression, stockout = feature_sets(table, feature_set)
    marked = stage(
        add_validation(add_split(table), share=settings.validation_share), "training-rows"
    )
    train, held_out = marked.filter("is_train = 1"), marked.filter("is_train = 0")
    fitted = fit_five(train, regression, stockout, settings, network, scaled)
    wanted = {c: tuple(ranges[c]) for c in ("consumption_kg", "cylinders_needed")}
    return Models(fitted, regression, stockout, wanted, preparation), held_out


def fit_five(
    train: DataFrame,
    regression: Sequence[str],
    stockout: Sequence[str],
    settings: TreeSettings = TreeSettings(),
    network: NetworkSettings = NetworkSettings(),
    scaled: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
) -> dict:
    """Boosted trees and a network for both quantities, boosted trees for the stockout; or those in ``names``.

    ``train`` holds ``event_id``, the features, both quantities, the label and
    the boolean ``is_validation``.  The regressors stop by the validation rows;
    the classifier grows all its trees on the balanced rows.
    """
    columns = [c for c in regression if c != "is_validation"]
    label_columns = [c for c in stockout if c != "is_validation"]
    noisy = [c for c in label_columns if scaled is None or c in scaled]
    balanced = train
    if names is None or "gbt_stockout" in names:
        balanced = stage(append_rows(train, oversample(train, label_columns, noisy=noisy)), "balanced-rows")
    held = F.col("is_validation")
    row = F.col("event_id")
    trees = dict(trees=settings.trees, rate=settings.rate, share=settings.subsample, seed=settings.seed)

    def boosted(target, output):
        return fit_trees(
            train, columns, target, output, row, depth=settings.regressor_depth, patience=settings.patience, held=held,
            edges=edges.result(), **trees,
        )

    def layered(target, output):
        return fit_network(train, columns, target, output, row, held, network)

    jobs = {
        "gbt_consumption": lambda: boosted("consumption_kg", "kg_gbt"),
        "mlp_consumption": lambda: layered("consumption_kg", "kg_mlp"),
        "gbt_cylinders": lambda: boosted("cylinders_needed", "cyl_gbt"),
        "mlp_cylinders": lambda: layered("cylinders_needed", "cyl_mlp"),
        "gbt_stockout": lambda: fit_trees(
            balanced, label_columns, LABEL, "stockout_score", F.xxhash64("event_id", *label_columns), depth=settings.classifier_depth, patience=None,
            loss="logistic", **trees,
        ),
    }
    jobs = {name: job for name, job in jobs.items() if names is None or name in names}
    # the fits do not depend on each other; their jobs share the cluster
    with ThreadPoolExecutor(len(jobs) + 1) as pool:
        if {"gbt_consumption", "gbt_cylinders"} & set(jobs):
            edges = pool.submit(fit_edges, train, columns)  # both regressors cut the same columns
        running = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}


def apply_model(df: DataFrame, model, keep: Sequence[str]) -> DataFrame:
    """Adds the model's output and drops what else its transformation adds."""
    return model.transform(df).select(*df.columns, *keep)


def predict_all(df: DataFrame, models: Models) -> DataFrame:
    """All model outputs side by side: scaled quantities, stockout score and 0/1 prediction."""
    for model in models.fitted.values():
        df = apply_model(df, model, [model.output])
    if "gbt_stockout" in models.fitted:
        df = df.withColumn("stockout", flag(F.col("stockout_score") >= 0.5))
    return df


def score_events(df: DataFrame, models: Models, keep: Sequence[str] = ()) -> DataFrame:
    """Fuel prediction in kg and stockout probability in % (1 decimal) per event.

    ``df`` has passed the same preparation as the training rows; see
    :func:`score_requests` for one that has not.  Columns in ``keep`` stay.  A
    missing model gives a null column.
    """
    kg = F.lit(None).cast("double")
    risk = F.lit(None).cast("double")
    out = df
    if "gbt_consumption" in models.fitted:
        out = apply_model(out, models.fitted["gbt_consumption"], ["kg_gbt"])
        kg = ft.inverse_scale_clip("kg_gbt", *models.ranges["consumption_kg"])
    if "gbt_stockout" in models.fitted:
        out = apply_model(out, models.fitted["gbt_stockout"], ["stockout_score"])
        risk = rnd(F.col("stockout_score") * F.lit(100.0), 1)
    return out.select(
        "event_id", *keep, kg.alias("ml_consumption_kg"), risk.alias("ml_stockout_risk_pct")
    )


def score_requests(features: DataFrame, models: Models, carry: str | None = None) -> DataFrame:
    """Scores of new feature rows, prepared with what was fitted in training.

    ``carry`` names a column (a struct of what else a row holds) that stays.
    """
    if models.preparation is None:
        raise ValueError("these models carry no preparation")
    return score_events(ft.apply_preparation(features, models.preparation, carry), models, [carry] if carry else [])


# ---- evaluation ------------------------------------------------------------

COMPARED = (
    ("consumption_kg", "gbt", "kg_gbt"),
    ("consumption_kg", "mlp", "kg_mlp"),
    ("cylinders_needed", "gbt", "cyl_gbt"),
    ("cylinders_needed", "mlp", "cyl_mlp"),
)


def regression_report(predicted: DataFrame, models: Models) -> DataFrame:
    """R2 and MAE (original units) per target and model."""
    rows = None
    for target, name, col in COMPARED:
        low, high = models.ranges[target]
        m = metrics.regression_metrics(predicted, target, col, high - low, 4).select(
            F.lit(target).alias("target"), F.lit(name).alias("model"), "n_rows", "r2", "mae"
        )
        rows = m if rows is None else rows.unionByName(m)
    return rows


def compare_models(report: DataFrame) -> DataFrame:
    """One row per target: both R2 values and the winner."""
    return report.groupBy("target").agg(
        F.max(F.when(F.col("model") == "gbt", F.col("r2"))).alias("gbt_r2"),
        F.max(F.when(F.col("model") == "mlp", F.col("r2"))).alias("mlp_r2"),
        F.max_by("model", "r2").alias("winner"),
    )


def classifier_report(predicted: DataFrame) -> DataFrame:
    """Accuracy, F1 of the stockout class, AUC and the confusion matrix, one row."""
    p = predicted.select(
        F.col(LABEL).alias("label"),
        F.col("stockout").alias("prediction"),
        F.col("stockout_score").alias("score"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    auc = metrics.roc_auc(p).select("auc").scalar()
    return metrics.confusion_matrix(p).select(
        rnd((tn + tp) / (tn + fp + fn + tp), 4).alias("accuracy"),
        F.coalesce(rnd(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), 4), F.lit(0.0)).alias("f1"),
        rnd(auc, 4).alias("auc"),
        "tn", "fp", "fn", "tp",
    )


def trees_used(spark: SparkSession, models: Models) -> DataFrame:
    """(model, trees, stopped_early, errors_seen) of the boosted models: how far each grew."""
    rows = [
        (name, len(m.trees), int(len(m.errors) > len(m.trees) + 1), len(m.errors))
        for name, m in models.fitted.items() if isinstance(m, BoostedTrees)
    ]
    return spark.createDataFrame(rows, "model string, trees int, stopped_early int, errors_seen int")


def importance_table(spark: SparkSession, model: BoostedTrees, columns, value: str) -> DataFrame:
    """(feature, importance): one value per feature from the fitted trees."""
    weights = [float(w) for w in model.importances]
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField(value, T.DoubleType())]
    )
    return spark.createDataFrame(list(zip(columns, weights)), schema)


def merge_importance(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the feature name; features the right side lacks get 0."""
    return left.join(right, "feature", "left").fillna(0.0)


def importances(spark: SparkSession, models: Models) -> DataFrame:
    """Importance of every feature for consumption, cylinders and stockout."""
    kg = importance_table(spark, models.fitted["gbt_consumption"], models.features, "consumption")
    cyl = importance_table(spark, models.fitted["gbt_cylinders"], models.features, "cylinders")
    stk = importance_table(
        spark, models.fitted["gbt_stockout"], models.stockout_features, "stockout"
    )
    return merge_importance(kg.join(cyl, "feature"), stk)


def training_report(
    table: DataFrame, models: Models, regression: DataFrame, classifier: DataFrame
) -> DataFrame:
    """(section, metric, value) rows: data set, feature counts, model quality."""
    data = table.agg(
        F.count("*").cast("double").alias("rows"),
        rnd(F.try_divide(F.sum(LABEL), F.count("*")) * F.lit(100.0), 1).alias("stockout_rate_pct"),
    ).withColumns(
        {
            "features": F.lit(float(len(models.features))),
            "stockout_features": F.lit(float(len(models.stockout_features))),
        }
    )

    def long(df, section):
        cols = df.columns
        pairs = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]
        )
        return df.select(F.explode(pairs).alias("p")).select(section.alias("section"), "p.*")

    reg = regression.select(
        F.concat_ws(".", "target", "model").alias("section"),
        F.explode(
            F.array(
                F.struct(F.lit("r2").alias("metric"), F.col("r2").alias("value")),
                F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")),
            )
        ).alias("p"),
    ).select("section", "p.*")
    return (
        long(data, F.lit("dataset")).unionByName(reg).unionByName(long(classifier, F.lit(LABEL)))
    )


# ---- saving and loading ------------------------------------------------------

MODEL_NAMES = (
    "gbt_consumption", "mlp_consumption", "gbt_cylinders", "mlp_cylinders", "gbt_stockout",
)
KINDS = {"trees": BoostedTrees, "network": Network}
SAVED = "name string, kind string, body binary"


def save_models(spark: SparkSession, models: Models, path: str) -> None:
    """One table under ``path``: a row a model and one of parameters, written in a single job."""
    rows = [("parameters", "json", bytearray(json.dumps(models.parameters(), sort_keys=True).encode()))]
    for name, model in models.fitted.items():
        kind = next(k for k, c in KINDS.items() if isinstance(model, c))
        rows.append((name, kind, bytearray(model.to_bytes())))
    spark.createDataFrame(rows, SAVED).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str, names: Sequence[str] = MODEL_NAMES) -> Models:
    """Loads what is there; a missing model is left out, not an error."""
    wanted = ["parameters", *names]
    saved = {r["name"]: r for r in spark.read.schema(SAVED).parquet(path).filter(F.col("name").isin(wanted)).collect()}
    doc = json.loads(bytes(saved["parameters"]["body"]).decode())
    fitted = {n: KINDS[saved[n]["kind"]].from_bytes(bytes(saved[n]["body"])) for n in names if n in saved}
    return Models(
        fitted, doc["features"], doc["stockout_features"],
        {k: tuple(v) for k, v in doc["ranges"].items()}, doc.get("preparation"),
    )


def storage(spark: SparkSession, path: str):
    """(file system, path) of the session's own storage."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(sc._jsc.hadoopConfiguration()), folder


def published_versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions below ``root``, oldest first."""
    fs, folder = storage(spark, f"{root}/published")
    if not fs.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(folder))


def publish_models(spark: SparkSession, models: Models, root: str) -> str:
    """Write the models as a new version and make it the current one; returns its name.

    The version's table is complete before its name appears: an empty file of
    that name in ``published`` is created in one step of the file system, so a
    crash before it leaves the old version current, and readers never see a
    part.  Versions are never changed; of two writers at the same time both
    versions are published, and the later name is current.
    """
    if models.preparation is None:
        raise ValueError("models without a preparation cannot score new requests")
    before = published_versions(spark, root)
    number = int(before[-1].split("-")[0]) + 1 if before else 1
    name = f"{number:08d}-{uuid.uuid4().hex[:12]}"
    save_models(spark, models, f"{root}/versions/{name}")
    fs, mark = storage(spark, f"{root}/published/{name}")
    fs.create(mark, False).close()
    return name


def current_version(spark: SparkSession, root: str) -> str:
    """Name of the newest published version."""
    names = published_versions(spark, root)
    if not names:
        raise ValueError(f"no published models below {root}")
    return names[-1]


def load_version(spark: SparkSession, root: str, version: str | None = None) -> Models:
    """Models of a pinned version, or of the current one."""
    return load_models(spark, f"{root}/versions/{version or current_version(spark, root)}")

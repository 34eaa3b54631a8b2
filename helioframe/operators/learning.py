"""Training sets, distributed fitting and feature importance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions.classify import sample_weight
from helioframe.operators.scoring import NOW, Head, LinearModel, feature_vector, fit_scaler, standardize
from helioframe.schema import FEATURES, HORIZONS, READABLE_NAMES
from helioframe.session import persist_table

L2 = 1e-4
CLASSES = 4


def label_columns(horizons: Sequence[str] = tuple(HORIZONS)) -> dict[str, str]:
    return {NOW: "PredictedClass"} | {h: f"TargetClass_{h}" for h in horizons}


def training_set(features: DataFrame, keys: Sequence[str], horizons: Sequence[str] = tuple(HORIZONS)) -> DataFrame:
    """Long form: one row per input row and look-ahead with label, weight and feature array."""
    wide = feature_vector(features)
    entries = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col(c).cast("int"), F.lit(0)).alias("label"))
        for h, c in label_columns(horizons).items()
    ])
    rows = wide.select(*keys, "features", F.inline(entries))
    return rows.withColumn("weight", sample_weight(F.col("label")))


def fit_models(features: DataFrame, max_iter: int = 100, horizons: Sequence[str] = tuple(HORIZONS)) -> LinearModel:
    """Six weighted one-vs-rest logistic models with L2, fitted to convergence.

    Features and labels are written once in the shared folder; the scaler and every fit read them from there. The
    heads are independent of each other and fitted side by side.
    """
    labels = label_columns(horizons)
    stored = persist_table(features.select(*FEATURES, *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y_{h}") for h, c in labels.items()]), "training")
    scaler = fit_scaler(stored)
    table = standardize(stored, scaler).select(array_to_vector(F.array(*[F.col(f"z_{f}") for f in FEATURES])).alias("features"), *[f"y_{h}" for h in labels])

    def fitted(h: str) -> Head:
        rows = table.select("features", F.col(f"y_{h}").cast("double").alias("label"))
        return _one_vs_rest(rows.withColumn("weight", sample_weight(F.col("label").cast("int"))), max_iter)

    with ThreadPoolExecutor(max_workers=len(labels)) as pool:
        heads = dict(zip(labels, pool.map(fitted, labels), strict=True))
    return LinearModel(scaler, heads)


def _one_vs_rest(rows: DataFrame, max_iter: int) -> Head:
    """A class the data never shows gets the flat weight of an empty classifier (score near 0)."""
    present = {int(r["label"]) for r in rows.select("label").distinct().collect()}   # at most 4
    coef, intercept = [], []
    base = LogisticRegression(
        featuresCol="features", labelCol="target", weightCol="weight",
        regParam=L2, elasticNetParam=0.0, standardization=False, maxIter=max_iter,
    )
    for c in range(CLASSES):
        if c not in present:
            coef.append((0.0,) * len(FEATURES))
            intercept.append(-50.0)
            continue
        fitted = base.fit(rows.withColumn("target", F.when(F.col("label") == c, 1.0).otherwise(0.0)))
        coef.append(tuple(float(v) for v in fitted.coefficients))
        # with a single class MLlib reports an infinite intercept
        b = float(fitted.intercept)
        intercept.append(math.copysign(50.0, b) if math.isinf(b) else b)
    return Head(tuple(coef), tuple(intercept))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (4 * n_class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}   # at most 4 classes
    total = sum(counts.values())
    out = None
    for c, n in counts.items():
        w = F.lit(total / (CLASSES * n))
        out = F.when(F.col(label) == c, w) if out is None else out.when(F.col(label) == c, w)
    return df.withColumn("weight", out)


def boosted_trees(rounds: int = 50, seed: int = 42) -> OneVsRest:
    """Boosted trees per class for ``(features vector, label, weight)`` rows."""
    trees = GBTClassifier(maxIter=rounds, stepSize=0.1, maxDepth=5, seed=seed)
    return OneVsRest(classifier=trees, featuresCol="features", labelCol="label", weightCol="weight")


def feature_importance(coefs: DataFrame) -> DataFrame:
    """Mean absolute weight over the classes, from ``(class, feature, weight)`` rows."""
    return coefs.groupBy("feature").agg(F.avg(F.abs("weight")).alias("weight"))


def importance_topk(importance: DataFrame, k: int = 13) -> DataFrame:
    """Readable names, heaviest first."""
    names = F.create_map(*[F.lit(v) for pair in READABLE_NAMES.items() for v in pair])
    named = importance.select(F.coalesce(names[F.col("feature")], "feature").alias("name"), "weight")
    return named.orderBy(F.desc("weight"), "name").limit(k)

"""Standardising, linear scoring, probability repair and decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions.classify import decide, risk_label
from helioframe.functions.numeric import finite, logistic, normalised
from helioframe.schema import FEATURES, HORIZONS

NOW = "now"
HEADS = (NOW, *HORIZONS)


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature keeps its scale."""

    mean: dict[str, float]
    std: dict[str, float]


@dataclass(frozen=True)
class Head:
    """One-vs-rest logistic weights of one look-ahead: a row per class."""

    coef: tuple[tuple[float, ...], ...]
    intercept: tuple[float, ...]


@dataclass(frozen=True)
class LinearModel:
    """A few hundred numbers: they travel as literals in the plan, not as a joined table."""

    scaler: Scaler
    heads: dict[str, Head]
    features: tuple[str, ...] = FEATURES


def feature_vector(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Features as doubles in model order, missing values 0, in one array column."""
    return df.withColumn("features", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))


def scaler_stats(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``(feature, mean, std)``: all moments in one pass, then turned into rows."""
    value = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    moments = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(value.values())],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(value.values())],
    )
    rows = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("std"),
        )
        for i, f in enumerate(features)
    ])
    return moments.select(F.inline(rows))


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURES) -> Scaler:
    rows = scaler_stats(df, features).collect()   # one line per feature
    return Scaler({r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["std"] for r in rows})


def standardize(df: DataFrame, scaler: Scaler, features: Sequence[str] = FEATURES, prefix: str = "z_") -> DataFrame:
    return df.withColumns({
        f"{prefix}{f}": (finite(F.col(f).cast("double")) - F.lit(scaler.mean[f])) / F.lit(scaler.std[f])
        for f in features
    })


def margins(model: LinearModel, head: Head, prefix: str = "z_") -> list[Column]:
    """One weighted sum per class, as generated code over literals."""
    return [
        F.expr(" + ".join([f"`{prefix}{f}` * ({float(w)!r}D)" for f, w in zip(model.features, weights, strict=True)] + [f"({float(bias)!r}D)"]))
        for weights, bias in zip(head.coef, head.intercept, strict=True)
    ]


def linear_scores(df: DataFrame, model: LinearModel) -> DataFrame:
    """``s_<head>_<class>``: logistic of every margin, before repair."""
    ready = standardize(df, model.scaler, model.features)
    scores = {
        f"s_{name}_{c}": logistic(m)
        for name, head in model.heads.items() for c, m in enumerate(margins(model, head))
    }
    return ready.withColumns(scores).drop(*[f"z_{f}" for f in model.features])


def probabilities(df: DataFrame, heads: Sequence[str] = HEADS) -> DataFrame:
    """``p_<head>_<class>`` from the raw scores."""
    clean = {f"s_{h}_{c}": finite(F.col(f"s_{h}_{c}"), nan=0.0, high=1.0, low=0.0) for h in heads for c in range(4)}
    total = {f"t_{h}": sum((F.col(f"s_{h}_{c}") for c in (1, 2, 3)), F.col(f"s_{h}_0")) for h in heads}
    share = {f"p_{h}_{c}": normalised(F.col(f"s_{h}_{c}"), F.col(f"t_{h}"), 4) for h in heads for c in range(4)}
    return df.withColumns(clean).withColumns(total).withColumns(share).drop(*clean, *total)


def _head_decision(name: str) -> Column:
    return decide(*[F.col(f"p_{name}_{c}") for c in (1, 2, 3)])


def score(df: DataFrame, model: LinearModel, digits: int = 4) -> DataFrame:
    """Adds ``probs``, ``pred_class`` and ``horizons`` (an array of structs in look-ahead order)."""
    scored = probabilities(linear_scores(df, model), tuple(model.heads))
    ahead = [h for h in model.heads if h != NOW]
    entries = []
    for h in ahead:
        c, m, x = (F.col(f"p_{h}_{k}") for k in (1, 2, 3))
        code = _head_decision(h)
        entries.append(F.struct(
            F.lit(h).alias("horizon"),
            code.alias("pred_class"),
            risk_label(code).alias("risk_label"),
            F.round(c + m + x, digits).alias("flare_prob"),
            F.round(c, digits).alias("c_prob"),
            F.round(m, digits).alias("m_prob"),
            F.round(x, digits).alias("x_prob"),
        ))
    out = scored.withColumns({
        "probs": F.array(*[F.col(f"p_{NOW}_{c}") for c in range(4)]),
        "pred_class": _head_decision(NOW),
        "horizons": F.array(*entries),
    })
    return out.drop(*[f"p_{h}_{c}" for h in model.heads for c in range(4)])


def horizon_forecast(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per input row and look-ahead."""
    # outer: the array is never empty, and no filter on its size is derived and pushed down the plan
    return scored.select(*keys, F.inline_outer("horizons"))


def horizon_map(scored: DataFrame) -> DataFrame:
    """``horizons`` as a map from name to struct, for nested output."""
    return scored.withColumn("horizons", F.map_from_entries(F.transform(
        "horizons", lambda e: F.struct(e["horizon"], e.dropFields("horizon")))))

"""The way from a raw table to predictions as one saved ``PipelineModel``."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from helioframe.operators.scoring import Head, LinearModel, Scaler, score
from helioframe.plans.telemetry import features_from_table


class FeatureStep(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Feature table of a raw table: ``by`` names the series, ``order`` its order, time first."""

    by = Param(Params._dummy(), "by", "series key", TypeConverters.toListString)
    order = Param(Params._dummy(), "order", "order of the rows, time first", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, by: Sequence[str] = ("series",), order: Sequence[str] = ("timestamp", "event_id")):
        super().__init__()
        self._set(by=list(by), order=list(order))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features_from_table(dataset, self.getOrDefault(self.by), self.getOrDefault(self.order))


class ScoreStep(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Scores of a feature table. The model, a few hundred numbers, is a parameter and so part of the metadata."""

    model = Param(Params._dummy(), "model", "scaler and heads as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "{}"):
        super().__init__()
        self._set(model=model)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return score(dataset, from_json(self.getOrDefault(self.model)))


def to_json(model: LinearModel) -> str:
    """Doubles as their shortest text that reads back to the same value."""
    return json.dumps({
        "features": model.features, "mean": model.scaler.mean, "std": model.scaler.std,
        "heads": {name: {"coef": h.coef, "intercept": h.intercept} for name, h in model.heads.items()}})


def from_json(text: str) -> LinearModel:
    spec = json.loads(text)
    heads = {n: Head(tuple(tuple(row) for row in h["coef"]), tuple(h["intercept"])) for n, h in spec["heads"].items()}
    return LinearModel(Scaler(spec["mean"], spec["std"]), heads, tuple(spec["features"]))


def prediction_pipeline(model: LinearModel, by: Sequence[str] = ("series",), order: Sequence[str] = ("timestamp", "event_id")) -> PipelineModel:
    return PipelineModel([FeatureStep(by=list(by), order=list(order)), ScoreStep(model=to_json(model))])

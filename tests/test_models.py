import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import bindings as b
from helioframe.operators import evaluation, learning, scoring
from helioframe.operators.timeline import build_timeline
from helioframe.plans import holdout
from helioframe.plans.telemetry import build_telemetry, feature_table
from helioframe.schema import FEATURES, LONG
from helioframe.session import persist_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    return persist_table(feature_table(build_telemetry(b.feed(spark, SF), b.BY, "event_id"), ["event_id"]), "features")


@pytest.fixture(scope="module")
def model(features):
    return learning.fit_models(features, max_iter=40)


def test_fit_skill_and_shapes(features, model):
    assert set(model.heads) == set(scoring.HEADS)
    scored = scoring.score(features, model)
    rows = scored.select("probs", "pred_class", "PredictedClass", "horizons").collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in rows)
    assert all([h["horizon"] for h in r["horizons"]] == ["15m", "30m", "1h", "2h", "4h"] for r in rows)
    # the present class is a function of one feature, so any fair fit finds the dangerous ones
    severe = [r for r in rows if r["PredictedClass"] >= 2]
    assert sum(r["pred_class"] >= 2 for r in severe) / len(severe) > 0.9


def test_fit_matches_weighted_objective(features, model):
    """The fitted T+0 head scores a better weighted loss than itself perturbed."""
    z = scoring.standardize(features, model.scaler)
    y = (F.col("PredictedClass") == 3).cast("double")
    w = F.when(F.col("PredictedClass") == 3, 20.0).when(F.col("PredictedClass") == 2, 8.0).when(F.col("PredictedClass") == 1, 1.0).otherwise(0.5)
    head = model.heads[scoring.NOW]

    def loss(scale):
        moved = scoring.Head(tuple(tuple(v * scale for v in r) for r in head.coef), head.intercept)
        m = scoring.margins(model, moved)[3]
        total = F.sum(w * (F.ln(1 + F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - y * m)) / F.sum(w)
        l2 = 0.5e-4 * sum((v * scale) ** 2 for v in head.coef[3])
        return z.agg(total.alias("l")).first()["l"] + l2

    assert loss(1.0) < loss(0.8) and loss(1.0) < loss(1.2) + 1e-3


def test_scaler_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0), (None, 3.0)], "a double, b double")
    s = scoring.fit_scaler(df, ["a", "b"])
    assert s.mean["a"] == pytest.approx(4 / 3) and s.std["b"] == 1.0
    assert s.std["a"] == pytest.approx(((16 / 9 + 25 / 9 + 1 / 9) / 3) ** 0.5)


def test_training_set_is_long(features):
    rows = learning.training_set(features, ["event_id"])
    assert rows.count() == 6 * features.count()
    assert {tuple(r) for r in rows.select("label", "weight").distinct().collect()} <= {(0, .5), (1, 1.), (2, 8.), (3, 20.)}


def test_importance(spark, model):
    from helioframe.sources.models import coefficient_table
    coefs = coefficient_table(spark, model).filter("head = 'now' AND feature <> '(bias)'")
    top = learning.importance_topk(learning.feature_importance(coefs), 2).collect()
    mean = {f: sum(abs(r[i]) for r in model.heads["now"].coef) / 4 for i, f in enumerate(FEATURES)}
    assert [r["weight"] for r in top] == pytest.approx(sorted(mean.values(), reverse=True)[:2])


def test_boosted_trees_on_chronological_split(spark, features):
    tl = evaluation.chrono_split(build_timeline(features, ["series"], ["timestamp", "event_id"]))
    rows = tl.df.select(
        "is_train", F.col("PredictedClass").cast("double").alias("label"), F.col(LONG),
        array_to_vector(F.array(*[F.col(f) * (1e6 if "flux" in f.lower() else 1.0) for f in FEATURES])).alias("features"))
    train = learning.balanced_weights(rows.filter("is_train"))
    shares = train.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert max(r["w"] for r in shares) == pytest.approx(min(r["w"] for r in shares))
    fitted = learning.boosted_trees(rounds=3).fit(train)
    test = fitted.transform(rows.filter("NOT is_train")).select(
        F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), F.lit("now").alias("horizon"))
    assert all(r["tss"] > 0.5 for r in evaluation.tss_by_class(test, ["horizon"]).collect())


def test_missing_class_gets_no_score(spark, features):
    quiet = features.filter("PredictedClass < 3")
    fitted = learning.fit_models(quiet, max_iter=5, horizons=())
    assert scoring.score(quiet, fitted).agg(F.max(F.col("probs")[3])).first()[0] < 1e-6


def test_holdout_skill_of_a_fitted_model(features):
    """The fit sees the first four fifths of every series only, and finds severe flares in the rest."""
    seen = []

    def fit(train):
        seen.append(train)
        return learning.fit_models(train, max_iter=30, horizons=("15m",))

    skill = {(r["horizon"], r["class"]): r for r in holdout.holdout_skill(features, fit, b.BY, classes=(1, 2, 3)).collect()}
    assert set(skill) == {(h, c) for h in ("now", "15m") for c in (1, 2, 3)}
    held = features.join(seen[0].select("event_id"), "event_id", "left_anti")
    assert seen[0].count() + held.count() == features.count()
    ends, starts = seen[0].groupBy("series").agg(F.max("rn").alias("last")), held.groupBy("series").agg(F.min("rn").alias("first"))
    assert ends.join(starts, "series").filter("first != last + 1").count() == 0
    assert skill["now", 3]["pos"] + skill["now", 3]["neg"] == held.count()
    assert skill["now", 3]["tss"] > 0.5

import random

import pytest
from pyspark.sql import functions as F

from harbinger.operators import learn as L
from harbinger.operators.metrics import full_metrics
from harbinger.operators.quality import SchemaDrift
from harbinger.plans import experiments as X

FEATURES = ["a", "b", "c"]
GROUPS = {"SIGNAL": ["a"], "NOISE": ["b", "c"]}
FOLDS = [
    ("v", "2019-01-01", "2021-12-31", "2022-01-01", "2022-12-31", "validation"),
    ("t", "2019-01-01", "2022-12-31", "2023-01-01", "2023-12-31", "test"),
]


@pytest.fixture(scope="module")
def long(spark):
    """Label driven by ``a``; ``b`` and ``c`` are noise, some values missing."""
    r = random.Random(9)
    data = []
    for e in range(6):
        for i in range(60):
            for h in (1, 2):
                a = r.gauss(0, 1)
                label = int(a + r.gauss(0, 0.5) > 0.4) if i < 58 else None
                data.append((f"e{e}", f"{2019 + i // 12}-{i % 12 + 1:02d}-01", h, label, a,
                             r.gauss(0, 1) if i % 9 else None, r.gauss(0, 1), 3.0 if a > 0.4 else 2.0, i % 12 + 1))
    df = spark.createDataFrame(
        data, "county_name string, observation_date string, horizon_months int, target_phase3plus int, a double, b double, "
        "c double, previous_ipc_phase double, month int")
    d = F.col("observation_date").cast("date")
    return L.settle(df.withColumns({"observation_date": d, "target_date": F.add_months(d, F.col("horizon_months"))}))


def fold(long, role):
    known = long.where("horizon_months = 1 and target_phase3plus is not null")
    return known.where("observation_date < '2022-01-01'" if role == "train" else "observation_date >= '2022-01-01'")


def test_balanced_weights_sum_to_the_rows(long):
    w = L.with_balanced_weight(fold(long, "train"))
    sums = {r[0]: r[1] for r in w.groupBy("target_phase3plus").agg(F.sum("_weight")).collect()}
    assert sums[0] == pytest.approx(sums[1])


@pytest.mark.parametrize("name,impute", [("logistic_regression", "median"), ("random_forest", "zero"), ("boosting", "median")])
def test_models_find_the_signal(long, name, impute):
    model = L.fit_classifier(fold(long, "train"), name, FEATURES, impute=impute, max_iter=5)
    held = L.score(model, fold(long, "eval"), FEATURES, impute).withColumn("y", F.col("target_phase3plus"))
    m = full_metrics(held).first()
    assert m["roc_auc"] > 0.85 and m["n"] == fold(long, "eval").count()
    assert held.where("p < 0 or p > 1").count() == 0


def test_unknown_model(long):
    with pytest.raises(ValueError, match="unknown model"):
        L.fit_classifier(fold(long, "train"), "oracle", FEATURES)


def test_platt_is_monotone_and_optional(spark, long):
    raw = L.score(L.fit_classifier(fold(long, "train"), "random_forest", FEATURES), fold(long, "eval"), FEATURES)
    curve = L.fit_platt(raw)
    out = L.apply_platt(curve, raw, out="q").orderBy("p").collect()
    assert all(x["q"] <= y["q"] + 1e-12 for x, y in zip(out, out[1:]))
    assert L.apply_platt(None, raw) is raw


def test_forecaster_round_trip(long, tmp_path):
    f = L.fit_horizon(1, fold(long, "train"), fold(long, "eval"), "logistic_regression", FEATURES)
    assert 0.1 <= f.threshold <= 0.9 and f.threshold_row["recall"] >= 0.8 and f.calibrator is not None
    path = str(tmp_path / "bundle")
    f.save(path)
    again = L.HorizonForecaster.load(str(tmp_path / "absent"), path)
    a = f.predict(fold(long, "eval")).agg(F.sum("p"), F.count_if("alert")).first()
    b = again.predict(fold(long, "eval")).agg(F.sum("p"), F.count_if("alert")).first()
    assert a[0] == pytest.approx(b[0]) and a[1] == b[1] and again.features == FEATURES
    with pytest.raises(SchemaDrift, match="'c'"):
        L.predict_checked(f, fold(long, "eval").drop("c"))
    with pytest.raises(FileNotFoundError):
        L.HorizonForecaster.load(str(tmp_path / "absent"))


def test_backtest_and_grid(long):
    metrics, curves, chosen = X.horizon_backtest(long, FOLDS, ("logistic_regression", "random_forest"), FEATURES, horizons=(1,))
    got = metrics.collect()
    assert [r["split"] for r in got] == ["v", "v", "t"] and got[2]["model"] in {"logistic_regression", "random_forest"}
    assert set(chosen) == {1} and curves.count() >= 1
    rows = X.registry_rows(X.model_predictions(long, FOLDS, (*X.BASELINES, "random_forest"), FEATURES, horizons=(1, 2))).collect()
    assert len(rows) == 16 and {r["model_name"] for r in rows} == {*X.BASELINES, "random_forest"}
    forest = [r for r in rows if r["model_name"] == "random_forest"]
    assert min(r["roc_auc"] for r in forest) > 0.85


def test_ensemble_is_the_blend(long):
    models = L.fit_ensemble(fold(long, "train"), FEATURES, max_iter=3)
    out = L.score_ensemble(models, fold(long, "eval"), FEATURES)
    gap = F.abs(F.col("p") - (0.2 * F.col("p_logistic_regression") + 0.4 * F.col("p_random_forest") + 0.4 * F.col("p_boosting")))
    assert out.agg(F.max(gap)).first()[0] < 1e-12


def test_importance_and_ablation(long):
    model = L.fit_classifier(fold(long, "train"), "random_forest", FEATURES)
    table = X.forest_importance(model, fold(long, "eval"), FEATURES, repeats=3).collect()
    assert table[0]["feature"] == "a" and table[0]["permutation_importance_mean"] > 0.2
    assert all(abs(r["permutation_importance_mean"]) < 0.1 for r in table[1:])
    assert sum(r["native_tree_importance"] for r in table) == pytest.approx(1.0)
    cut = {r["ablation_set"]: r for r in X.group_ablation(fold(long, "train"), fold(long, "eval"), GROUPS).collect()}
    assert cut["all_features"]["feature_count"] == 3 and cut["minus_signal"]["feature_count"] == 2
    assert cut["all_features"]["roc_auc"] > cut["minus_signal"]["roc_auc"] + 0.2


def test_permutation_keeps_every_value(long):
    """Each repeat only moves values between rows: the column's values stay the same."""
    seen = []

    def spy(df):
        seen.append(df)
        return df.withColumn("p", F.lit(0.5))

    from harbinger.operators.importance import permutation_importance

    held = fold(long, "eval").fillna(0.0, subset=["b"])
    permutation_importance(spy, held, FEATURES, ["county_name", "observation_date", "horizon_months"], repeats=2)
    mixed = seen[0].where("feature = 'a'").select("_repeat", F.get("_mixed", F.lit(0)).alias("v"), F.get("_own", F.lit(0)).alias("o"))
    want = sorted(r["a"] for r in held.collect())
    for rep in (1, 2):
        rows = mixed.where(F.col("_repeat") == rep).collect()
        assert sorted(r["v"] for r in rows) == want and sum(r["v"] != r["o"] for r in rows) > len(want) * 0.9

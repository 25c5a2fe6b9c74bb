"""Published results of the four real feeds, when a folder with them is given.

Set ``HARBINGER_FEEDS`` to a folder with ``climate``, ``vegetation``, ``market`` and
``ipc`` sub-folders. The expected numbers are fixed values.
"""

import os

import pytest
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.operators import baselines as B
from harbinger.operators import learn as L
from harbinger.operators.horizon import build_long_table
from harbinger.operators.metrics import full_metrics
from harbinger.operators.neighbours import effective_edges, sites_from_dimension
from harbinger.operators.panel import build_panel
from harbinger.operators.quality import leakage_check, neighbour_check, validate_panel
from harbinger.operators.splits import rolling_origin, split_by_year
from harbinger.plans import experiments as X
from harbinger.sources.feeds import load_feed, monthly_assessments

FOLDER = os.environ.get("HARBINGER_FEEDS", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="HARBINGER_FEEDS is not set")

# Contiguity among the pilot entities
TOUCHING = [("Turkana", "Marsabit"), ("Marsabit", "Turkana"), ("Marsabit", "Mandera"), ("Mandera", "Marsabit")]

# Fixed values: (horizon, fold) -> train rows, test rows
SAMPLES = {
    (1, 1): (240, 60), (1, 2): (300, 55), (2, 1): (240, 60), (2, 2): (300, 50), (3, 1): (240, 60), (3, 2): (300, 45),
}
# Fixed values: (model, horizon, fold) -> recall, precision, F1, ROC, average precision, Brier
PUBLISHED = {
    ("persistence", 1, 1): (1.0, 0.9388, 0.9684, 0.8929, 0.9388, 0.05),
    ("historical_frequency", 1, 1): (0.0, 0.0, 0.0, 0.5, 0.7667, 0.2689),
    ("seasonal_baseline", 1, 1): (0.0435, 0.4, 0.0784, 0.4146, 0.7507, 0.2842),
    ("persistence", 1, 2): (1.0, 0.625, 0.7692, 0.9333, 0.625, 0.1091),
    ("historical_frequency", 1, 2): (1.0, 0.1818, 0.3077, 0.5, 0.1818, 0.2677),
    ("seasonal_baseline", 1, 2): (1.0, 0.1818, 0.3077, 0.5, 0.1818, 0.2631),
    ("persistence", 2, 1): (1.0, 0.898, 0.9462, 0.8438, 0.898, 0.0833),
    ("historical_frequency", 2, 1): (0.0, 0.0, 0.0, 0.5, 0.7333, 0.2581),
    ("seasonal_baseline", 2, 1): (0.0909, 0.4, 0.1481, 0.358, 0.703, 0.2858),
    ("persistence", 2, 2): (1.0, 0.5, 0.6667, 0.9048, 0.5, 0.16),
    ("historical_frequency", 2, 2): (1.0, 0.16, 0.2759, 0.5, 0.16, 0.2738),
    ("seasonal_baseline", 2, 2): (1.0, 0.16, 0.2759, 0.5, 0.16, 0.264),
    ("persistence", 3, 1): (1.0, 0.8571, 0.9231, 0.8056, 0.8571, 0.1167),
    ("historical_frequency", 3, 1): (1.0, 0.7, 0.8235, 0.5, 0.7, 0.25),
    ("seasonal_baseline", 3, 1): (0.1429, 0.4, 0.2105, 0.3214, 0.6571, 0.2875),
    ("persistence", 3, 2): (1.0, 0.375, 0.5455, 0.8718, 0.375, 0.2222),
    ("historical_frequency", 3, 2): (1.0, 0.1333, 0.2353, 0.5, 0.1333, 0.2809),
    ("seasonal_baseline", 3, 2): (1.0, 0.1333, 0.2353, 0.5, 0.1333, 0.2651),
}
FOLD_NO = {"fold1_drought_peak": 1, "fold2_recovery_transition": 2}


@pytest.fixture(scope="module")
def feeds(spark, dim):
    folder = {"rainfall": "climate", "vegetation": "vegetation", "market": "market", "assessments": "ipc"}
    return {f: load_feed(spark, f"{FOLDER}/{d}", f, dim) for f, d in folder.items()}


@pytest.fixture(scope="module")
def panel(feeds):
    return L.settle(
        build_panel(feeds["rainfall"], feeds["vegetation"], feeds["market"], monthly_assessments(feeds["assessments"]))
    )


@pytest.fixture(scope="module")
def long(spark, panel, dim):
    touch = spark.createDataFrame(TOUCHING, "src string, dst string")
    edges = effective_edges(panel, touch, sites_from_dimension(dim), k=2)
    return L.settle(build_long_table(panel, dim, edges))


def test_sizes(feeds, panel, long):
    assert monthly_assessments(feeds["assessments"]).count() == 360
    assert panel.count() == 360 and long.count() == 1080
    got = {r["split"]: r["count"] for r in split_by_year(panel).groupBy("split").count().collect()}
    assert got == {"train": 225, "val": 60, "test": 60}


def test_tables_are_clean(panel, long, dim):
    assert all(r["n_bad"] == 0 for r in validate_panel(panel, dim).collect())
    assert all(r["not_after"] == r["wrong_offset"] == 0 for r in leakage_check(long).collect())
    # lags of the first months are absent everywhere, so neighbours then default
    assert all(r["n_bad"] == 0 for r in neighbour_check(long).collect())


def test_published_rows(long):
    at = {
        (r["county_name"], r["observation_period"]): r
        for r in long.where("horizon_months = 1 and observation_period >= '2024-01'").collect()
    }
    t = at["Turkana", "2024-05"]
    assert (t["rainfall_anomaly_lag1"], t["ndvi_anomaly_lag1"], t["previous_ipc_phase"]) == (64.9, 57.1, 3)
    assert t["maize_price_zscore"] == pytest.approx(0.3774099219630856, abs=1e-9)
    assert t["neighbour_mean_rainfall_anomaly"] == 30.9 and t["number_of_high_risk_neighbours"] == 1
    assert at["Marsabit", "2024-02"]["neighbour_mean_rainfall_anomaly"] == 62.9
    assert at["Mandera", "2024-01"]["neighbour_mean_rainfall_anomaly"] == 92.5
    assert at["Marsabit", "2024-06"]["neighbour_mean_rainfall_anomaly"] == 40.65
    assert at["Turkana", "2024-06"]["neighbour_mean_rainfall_anomaly"] == -13.9
    assert at["Garissa", "2024-01"]["neighbour_mean_rainfall_anomaly"] == 98.3


def test_baselines_agree_with_the_published_registry(long):
    predictions = X.model_predictions(long, V.EXPERIMENT_FOLDS, X.BASELINES, key_columns=False)
    got = {}
    for r in X.registry_rows(predictions).collect():
        fold = FOLD_NO[r["fold_name"]]
        got[r["model_name"], r["forecast_horizon"], fold] = tuple(
            r[c] for c in ("recall", "precision", "f1_score", "roc_auc", "pr_auc", "brier_score"))
        assert r["test_samples"] == SAMPLES[r["forecast_horizon"], fold][1]
    assert got == PUBLISHED


def test_training_sizes(long):
    rows = rolling_origin(long, V.EXPERIMENT_FOLDS).where("role = 'train'").groupBy("horizon_months", "fold_name").count()
    got = {(r["horizon_months"], FOLD_NO[r["fold_name"]]): r["count"] for r in rows.collect()}
    assert got == {k: v[0] for k, v in SAMPLES.items()}


def test_learned_models_are_in_the_published_range(long):
    predictions = X.model_predictions(
        long, V.EXPERIMENT_FOLDS[1:], ("logistic_regression", "random_forest"), horizons=(1,)
    )
    got = {r["model_name"]: r for r in X.registry_rows(predictions).collect()}
    forest, logistic = got["random_forest"], got["logistic_regression"]
    assert forest["roc_auc"] == pytest.approx(0.9156, abs=0.06) and forest["recall"] >= 0.7
    assert logistic["roc_auc"] == pytest.approx(0.82, abs=0.08)
    assert forest["brier_score"] < 0.15


def test_same_month_models_are_in_the_published_range(panel):
    metrics, _ = X.baseline_job(panel)
    got = {(r["model_name"], r["split"]): r for r in metrics.collect()}
    forest = got["random_forest", "test"]
    assert forest["n"] == 60 and forest["roc_auc"] == pytest.approx(0.9575, abs=0.05) and forest["recall"] >= 0.8


def test_persistence_alone(long):
    held = rolling_origin(long, V.EXPERIMENT_FOLDS, 1).where("role = 'eval' and fold_name = 'fold2_recovery_transition'")
    m = full_metrics(B.persistence(held).withColumn("y", F.col("target_phase3plus"))).first()
    assert (m["recall"], m["precision"], m["roc_auc"], m["pr_auc"], m["brier_score"]) == (1.0, 0.625, 0.9333, 0.625, 0.1091)

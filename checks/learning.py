"""Learned models over the stand-in panel; no SQL can state their result."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.catalog import query
from harbinger import fixed_values as V
from harbinger.operators import learn as L
from harbinger.operators.splits import rolling_origin
from harbinger.plans import early_warning as E
from harbinger.plans import experiments as X

KEYS = ["county_name", "observation_date", "horizon_months"]


def _fold(spark, sf, horizon=1):
    long = L.settle(rolling_origin(S.long_table(spark, sf, True), S.FOLDS, horizon))
    test = long.where(F.col("fold_name") == "test_2000")
    return test.where(F.col("role") == "train"), test.where(F.col("role") == "eval")


def _scores(spark, sf, model):
    train, held = _fold(spark, sf)
    fitted = L.fit_classifier(train, model, V.LONG_FEATURES, impute="median")
    return L.score(fitted, held, V.LONG_FEATURES, "median").select(*KEYS, L.LABEL, "p")


@query("forest_scores")
def forest(spark, sf):
    return _scores(spark, sf, "random_forest")


@query("boosting_scores")
def boosting(spark, sf):
    return _scores(spark, sf, "boosting")


@query("ensemble_scores")
def ensemble(spark, sf):
    train, held = _fold(spark, sf)
    models = L.fit_ensemble(train, V.LONG_FEATURES)
    out = L.score_ensemble(models, held, V.LONG_FEATURES)
    return out.select(*KEYS, L.LABEL, *[f"p_{m}" for m in L.CANDIDATES], "p")


@query("logistic_platt_scores")
def logistic(spark, sf):
    long = L.settle(rolling_origin(S.long_table(spark, sf, True), S.FOLDS, 1))

    def part(fold, role):
        return long.where((F.col("fold_name") == fold) & (F.col("role") == role))

    fitted = L.fit_horizon(1, part("val_1999", "train"), part("val_1999", "eval"), "logistic_regression")
    return fitted.predict(part("test_2000", "eval")).select(*KEYS, L.LABEL, "p", "decision_threshold", "alert")


@query("horizon_backtest")
def backtest(spark, sf):
    long = S.long_table(spark, sf, True)
    metrics, _, _ = X.horizon_backtest(long, S.FOLDS)
    return metrics


@query("forecast_records")
def records(spark, sf):
    """Early-warning matrix from fitted forests, one model per horizon."""
    long = L.settle(S.long_table(spark, sf, True))
    known = rolling_origin(long, S.FOLDS)
    parts = []
    for h in (1, 2, 3):
        rows = known.where((F.col("fold_name") == "val_1999") & (F.col("horizon_months") == h))
        fit = L.fit_horizon(h, rows.where(F.col("role") == "train"), rows.where(F.col("role") == "eval"))
        parts.append(fit.predict(long.where(F.col("horizon_months") == h)))
    scored = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("p", "risk_probability")
    return E.early_warning_matrix(scored, "2000-06")


@query("scored_panel")
def scored_panel(spark, sf):
    panel = L.settle(S.panel(spark, sf))
    train = panel.where(F.col("year") <= 1998)
    forest = L.fit_classifier(train, "random_forest", V.PANEL_FEATURES)
    logistic = L.fit_classifier(train, "logistic_regression", V.PANEL_FEATURES)
    out = L.score_panel(panel, forest, logistic)
    return out.select("county_name", "period", "model_risk_prob", "model_risk_prob_lr", "risk_band")


@query("baseline_job")
def baseline(spark, sf):
    metrics, _ = X.baseline_job(S.panel(spark, sf), **S.YEARS)
    return metrics.drop("confusion_matrix")


@query("model_grid")
def grid(spark, sf):
    return X.registry_rows(X.model_predictions(L.settle(S.long_table(spark, sf, True)), S.FOLDS))


@query("permutation_importance")
def importance(spark, sf):
    train, held = _fold(spark, sf)
    fitted = L.fit_classifier(train, "random_forest", V.LONG_FEATURES)
    return X.forest_importance(fitted, held, V.LONG_FEATURES)


@query("importance_stability")
def stability(spark, sf):
    long = S.long_table(spark, sf, True)
    _, out = X.importance_stability(long, "1999-12-31", "2000-01-01")
    return out


@query("group_ablation")
def ablation(spark, sf):
    return X.group_ablation(*_fold(spark, sf))

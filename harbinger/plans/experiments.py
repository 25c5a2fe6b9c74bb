"""Training and comparison jobs.

The rows of every horizon and fold are imputed and assembled once; the fits over them are
submitted side by side by a bounded pool of threads. All models score a held-out row in one
pass, and all metric rows are one grouped pass over the predictions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import ImputerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.operators import baselines as B
from harbinger.operators import learn as L
from harbinger.functions.scalars import blend
from harbinger.operators.importance import feature_stability, permutation_importance
from harbinger.operators.metrics import full_metrics, reliability_curve
from harbinger.operators.splits import rolling_origin, split_by_year
from harbinger.plans.views import select_model
from harbinger.sources.storage import replace_report

LABEL = L.LABEL
BASELINES = ("persistence", "historical_frequency", "seasonal_baseline")
GRID_MODELS = (*BASELINES, *L.CANDIDATES, "calibrated_ensemble")


def _fold_rows(assigned: DataFrame, fold: str, horizon: int, role: str) -> DataFrame:
    return assigned.where(
        (F.col("fold_name") == fold) & (F.col("horizon_months") == horizon) & (F.col("role") == role)
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _context(df: DataFrame) -> list[str]:
    """What an error audit wants to see beside a prediction, as far as the table has it."""
    return [c for c in V.PREDICTION_CONTEXT if c in df.columns]


def _predictions(scored: DataFrame, **tags) -> DataFrame:
    return scored.select(
        *[F.lit(v).alias(k) for k, v in tags.items()],
        "county_name", "observation_date", F.col(LABEL).cast("int").alias("y"), "p", *_context(scored),
    )


def model_predictions(
    long: DataFrame, folds: Sequence[tuple] = tuple(V.EXPERIMENT_FOLDS),
    models: Sequence[str] = GRID_MODELS, features: Sequence[str] = tuple(V.LONG_FEATURES),
    horizons: Sequence[int] = (1, 2, 3), seed: int = 42, max_iter: int = 100,
    key_columns: bool = True,
) -> DataFrame:
    """Held-out predictions of every model, fold and horizon.

    ``key_columns=False`` fits the two rate baselines without the entity, so they
    fall back to overall and month rates.
    """
    assigned = L.settle(rolling_origin(long, folds))
    spark = long.sparkSession
    cells = [(h, name) for h in horizons for name, *_ in folds]
    sizes = assigned.where(F.col("role") == "train").groupBy("horizon_months", "fold_name").count()
    train_rows = {(r["horizon_months"], r["fold_name"]): r["count"] for r in sizes.collect()}
    train = {c: _fold_rows(assigned, c[1], c[0], "train") for c in cells}
    held = {c: _fold_rows(assigned, c[1], c[0], "eval") for c in cells}
    # boosting is the longest chain of jobs, so it starts first
    learned = [m for m in reversed(L.CANDIDATES) if m in models or "calibrated_ensemble" in models]
    ready = {}
    if learned:
        frames = L.concurrently(spark, [lambda c=c: L.prepare(train[c], features, LABEL, "median") for c in cells])
        ready = dict(zip(cells, frames, strict=True))
    fits = [(m, c) for m in learned for c in cells]
    models_of = dict(zip(
        fits, L.concurrently(spark, [lambda m=m, c=c: L.fit_prepared(ready[c], m, seed, max_iter) for m, c in fits]), strict=True,
    ))

    def predict(c: tuple[int, str]) -> DataFrame:
        tags = {"horizon": c[0], "fold_name": c[1], "train_samples": train_rows.get(c, 0), "num_features": len(features)}
        frames = []
        if learned:
            scored = L.score_all({m: models_of[m, c] for m in learned}, held[c], features)
            columns = {m: F.col(f"p_{m}") for m in learned if m in models}
            if "calibrated_ensemble" in models:
                columns["calibrated_ensemble"] = blend(*[F.col(f"p_{n}") for n in L.CANDIDATES])
            frames.append(_stacked(scored, columns, tags))
        rates = {
            "persistence": lambda: B.persistence(held[c]),
            "historical_frequency": lambda: B.historical_frequency(train[c], held[c], LABEL, key_columns),
            "seasonal_baseline": lambda: B.seasonal_rate(train[c], held[c], LABEL, key_columns),
        }
        frames += [_predictions(rate(), model_name=m, **tags) for m, rate in rates.items() if m in models]
        return L.settle(_union(frames))

    return _union(L.concurrently(spark, [lambda c=c: predict(c) for c in cells]))


def _stacked(scored: DataFrame, columns: dict, tags: dict) -> DataFrame:
    """One row per model from a row with the probabilities of all."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), p.alias("p")) for m, p in columns.items()]))
    context = _context(scored)
    rows = scored.select(
        "county_name", "observation_date", F.col(LABEL).cast("int").alias("y"), *context, each.alias("_m")
    )
    return rows.select(
        F.col("_m.model_name").alias("model_name"), *[F.lit(v).alias(k) for k, v in tags.items()],
        "county_name", "observation_date", "y", F.col("_m.p").alias("p"), *context,
    )


SIZES = ["train_samples", "num_features"]


def registry_rows(predictions: DataFrame, decimals: int = 4, feature_set: str = "all_features") -> DataFrame:
    """Metric row per model, fold and horizon; areas default to 0.5 and 0 for one class."""
    keys = ["horizon", "fold_name", "model_name"]
    # the sizes are the same in all rows of a key
    out = full_metrics(predictions, [*keys, *SIZES], 0.5, decimals=decimals)
    return out.select(
        F.concat_ws("_", F.lit("exp"), F.concat("horizon", F.lit("m")), "fold_name", "model_name").alias("experiment_id"),
        F.col("horizon").alias("forecast_horizon"),
        "fold_name",
        "model_name",
        F.lit(feature_set).alias("feature_set"),
        *[F.col(c).cast("long").alias(c) for c in reversed(SIZES)],
        F.col("n").alias("test_samples"),
        "recall", "precision", "f1_score",
        F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"),
        F.coalesce("pr_auc", F.lit(0.0)).alias("pr_auc"),
        "brier_score",
        F.round(1 - F.col("recall"), decimals).alias("false_negative_rate"),
    )


def ablation_registry(ablation: DataFrame, fold: str, horizon: int, train_samples: int, test_samples: int) -> DataFrame:
    """Rows of :func:`group_ablation` in the columns of the registry."""
    return ablation.select(
        F.concat(F.lit(f"ablation_h{horizon}_"), "ablation_set").alias("experiment_id"),
        F.lit(horizon).alias("forecast_horizon"), F.lit(fold).alias("fold_name"),
        F.lit("random_forest_ablation").alias("model_name"), F.col("ablation_set").alias("feature_set"),
        F.col("feature_count").cast("long").alias("num_features"), F.lit(train_samples).cast("long").alias("train_samples"),
        F.lit(test_samples).cast("long").alias("test_samples"), "recall", "precision", "f1_score",
        F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"), F.coalesce("pr_auc", F.lit(0.0)).alias("pr_auc"),
        "brier_score", F.round(1 - F.col("recall"), 4).alias("false_negative_rate"),
    )


class ExperimentStore:
    """Predictions with their context and registry rows, each experiment under its id.

    Storing an experiment again replaces it; the others are not touched.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, predictions: DataFrame | None, registry: DataFrame, at: str) -> None:
        """Store registry rows, stamped with the time, and the predictions they come from."""
        replace_report(registry.withColumn("timestamp", F.lit(at)), f"{self.folder}/registry")
        if predictions is not None:
            name = F.concat_ws("_", F.lit("exp"), F.concat("horizon", F.lit("m")), "fold_name", "model_name")
            replace_report(predictions.withColumn("experiment_id", name), f"{self.folder}/predictions")

    def registry(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/registry")

    def predictions(self, experiment: str | None = None) -> DataFrame:
        """Stored predictions; those of one experiment are one partition."""
        rows = self.spark.read.parquet(f"{self.folder}/predictions")
        return rows if experiment is None else rows.where(F.col("experiment_id") == experiment)


def run_experiments(
    long: DataFrame, folder: str, at: str, folds: Sequence[tuple] = tuple(V.EXPERIMENT_FOLDS),
    ablation_fold: str | None = None, **options,
) -> ExperimentStore:
    """Fit the grid, store predictions and registry rows, and the ablation of one fold at horizon 1."""
    store = ExperimentStore(long.sparkSession, folder)
    predictions = L.settle(model_predictions(long, folds, **options))
    store.add(predictions, registry_rows(predictions), at)
    if ablation_fold is not None:
        assigned = L.settle(rolling_origin(long, folds))
        train, held = (_fold_rows(assigned, ablation_fold, 1, role) for role in ("train", "eval"))
        rows = ablation_registry(group_ablation(train, held), ablation_fold, 1, train.count(), held.count())
        store.add(None, rows, at)
    return store


def group_ablation(
    train: DataFrame, held: DataFrame, groups: dict[str, list[str]] | None = None,
    model: str = "random_forest", seed: int = 42,
) -> DataFrame:
    """Metrics with all features and without each feature group."""
    groups = groups or V.FEATURE_GROUPS
    every = [f for g in groups.values() for f in g if f in train.columns]
    sets = {"all_features": every}
    for g, members in groups.items():
        sets[f"minus_{g.lower()}"] = [f for f in every if f not in members]
    train, held = L.settle(train), L.settle(held)
    fits = [lambda f=f: L.fit_classifier(train, model, f, LABEL, "median", seed) for f in sets.values()]
    fitted = L.concurrently(train.sparkSession, fits)
    frames = []
    for (name, features), one in zip(sets.items(), fitted, strict=True):
        scored = L.score(one, held, features, "median")
        frames.append(
            _predictions(scored, ablation_set=name, feature_count=len(features)).select("ablation_set", "feature_count", "y", "p")
        )
    return full_metrics(_union(frames), ["ablation_set", "feature_count"]).select(
        "ablation_set", "feature_count", "recall", "precision", "f1_score", "roc_auc", "pr_auc", "brier_score"
    )


def horizon_backtest(
    long: DataFrame, folds: Sequence[tuple] = tuple(V.ROLLING_FOLDS),
    candidates: Sequence[str] = L.CANDIDATES, features: Sequence[str] = tuple(V.LONG_FEATURES),
    horizons: Sequence[int] = (1, 2, 3), tune_on: str = "raw", final_fit: str = "disjoint",
    seed: int = 42, max_iter: int = 100,
) -> tuple[DataFrame, DataFrame, dict[int, L.HorizonForecaster]]:
    """Compare on validation, select, refit, test: (metrics, reliability, forecasters).

    ``final_fit="disjoint"`` keeps the validation rows for cut-off and calibration
    only; ``"through_validation"`` also trains on them, so both are in-sample.
    """
    validation, test = folds[0][0], folds[1][0]
    assigned, spark = L.settle(rolling_origin(long, folds)), long.sparkSession
    train = {h: _fold_rows(assigned, validation, h, "train") for h in horizons}
    held = {h: _fold_rows(assigned, validation, h, "eval") for h in horizons}
    ready = dict(zip(horizons, L.concurrently(spark, [lambda h=h: L.prepare(train[h], features) for h in horizons]), strict=True))

    def metrics(fitted: L.HorizonForecaster, rows: DataFrame, position: int, split: str) -> DataFrame:
        scored = fitted.predict(rows).withColumn("y", F.col(LABEL).cast("int"))
        return full_metrics(scored, threshold=fitted.threshold).drop("confusion_matrix").select(
            F.lit(fitted.horizon).alias("horizon"), F.lit(fitted.model_name).alias("model"),
            F.lit(position).alias("position"), F.lit(split).alias("split"), "*",
        )

    def compare(h: int, position: int, name: str) -> DataFrame:
        fitted = L.fit_horizon(h, ready[h], held[h], name, features, LABEL, tune_on, seed, max_iter)
        return L.settle(metrics(fitted, held[h], position, validation))

    # boosting is the longest chain of jobs, so the last candidates start first
    tries = [(h, i, m) for i, m in reversed(list(enumerate(candidates))) for h in horizons]
    compared = _union(L.concurrently(spark, [lambda t=t: compare(*t) for t in tries]))
    chosen = {}
    for h in horizons:
        chosen[h] = select_model(compared.where(F.col("horizon") == h)).first()["model"]

    def finish(h: int) -> tuple[L.HorizonForecaster, DataFrame, DataFrame]:
        rows = ready[h] if final_fit == "disjoint" else _fold_rows(assigned, test, h, "train")
        best = L.fit_horizon(h, rows, held[h], chosen[h], features, LABEL, tune_on, seed, max_iter)
        tested = _fold_rows(assigned, test, h, "eval")
        final = best.predict(tested).withColumn("y", F.col(LABEL).cast("int"))
        curve = reliability_curve(final).select(F.lit(h).alias("horizon"), F.lit(best.model_name).alias("model"), "*")
        return best, metrics(best, tested, -1, test), curve

    finals = L.concurrently(spark, [lambda h=h: finish(h) for h in horizons])
    metric_frames = [compared, *[m for _, m, _ in finals]]
    return (
        _union(metric_frames).drop("position"), _union([c for _, _, c in finals]),
        {h: best for h, (best, _, _) in zip(horizons, finals, strict=True)},
    )


def baseline_job(
    panel: DataFrame, features: Sequence[str] = tuple(V.PANEL_FEATURES), seed: int = 42, **years
) -> tuple[DataFrame, dict]:
    """Same-month models on the year split: metric rows and the fitted pipelines."""
    rows = L.settle(split_by_year(panel, features=features, **years))
    train = rows.where(F.col("split") == "train")
    models = {m: L.fit_classifier(train, m, features, seed=seed) for m in ("logistic_regression", "random_forest")}
    held = rows.where(F.col("split") != "train")
    frames = [
        L.score(fit, held, features).select(
            F.lit(name).alias("model_name"), "split", F.col(LABEL).cast("int").alias("y"), "p"
        )
        for name, fit in models.items()
    ]
    return full_metrics(_union(frames), ["model_name", "split"]), models


def importance_stability(
    long: DataFrame, train_end: str, test_start: str, features: Sequence[str] = tuple(V.LONG_FEATURES),
    horizons: Sequence[int] = (1, 2, 3), repeats: int = 10, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Permutation importance per horizon and its stability over them."""
    known = L.settle(long.where(F.col(LABEL).isNotNull()))
    frames = []
    for h in horizons:
        rows = known.where(F.col("horizon_months") == h)
        train = rows.where(F.col("observation_date") <= F.lit(train_end).cast("date"))
        held = rows.where(F.col("observation_date") >= F.lit(test_start).cast("date"))
        fitted = L.fit_classifier(train, "random_forest", features, LABEL, "median", seed)
        frames.append(
            forest_importance(fitted, held, features, repeats, seed).withColumn("horizon", F.lit(h))
        )
    table = L.settle(_union(frames))
    return table, feature_stability(table, "permutation_importance_mean")


def forest_importance(fitted, held: DataFrame, features: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """Permutation and in-tree importance of one fitted forest, best first.

    Gaps are filled as the forest's own pipeline fills them.
    """
    tree = fitted.stages[-1]
    imputers = [s for s in fitted.stages if isinstance(s, ImputerModel)]
    filled = L.numeric(held, features, "median" if imputers else "zero")
    for imputer in imputers:
        made = dict(zip(imputer.getInputCols(), imputer.getOutputCols(), strict=True))
        filled = imputer.transform(filled).withColumns({c: F.col(m) for c, m in made.items()}).drop(*made.values())

    def score(df: DataFrame) -> DataFrame:
        return tree.transform(df).withColumn("p", L.probability())

    shuffled = permutation_importance(
        score, filled, features,
        ["county_name", "observation_date", "horizon_months"], LABEL, repeats, seed,
    )
    native = L.tree_importance(fitted, features).withColumnRenamed("importance", "native_tree_importance")
    return shuffled.join(native, "feature").orderBy(F.desc("permutation_importance_mean"), "feature")

"""Learned forecasts with Spark ML: pipelines, calibration, thresholds, storage."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.scalars import blend
from harbinger.operators.keys import fill_back_then_forward
from harbinger.operators.metrics import best_threshold, threshold_grid
from harbinger.operators.quality import SchemaDrift, missing_columns
from harbinger.sources.shared import settle
from harbinger.sources.storage import first_existing

LABEL = "target_phase3plus"
CANDIDATES = ("logistic_regression", "random_forest", "boosting")


def with_balanced_weight(df: DataFrame, label: str = LABEL, out: str = "_weight") -> DataFrame:
    """Weight n / (2 * class size), so both classes weigh the same in a fit."""
    sizes = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        ).alias("s")
    ).scalar()
    mine = F.when(F.col(label) == 1, F.col("_s.pos")).otherwise(F.col("_s.neg"))
    return df.withColumn("_s", sizes).withColumn(out, F.col("_s.n") / (2 * mine)).drop("_s")


FIT_THREADS = 8
ROWS_PER_PARTITION = 50_000


def concurrently(spark: SparkSession, tasks: Sequence[Callable], threads: int = FIT_THREADS) -> list:
    """Results of the tasks, in order; a bounded pool of driver threads submits their jobs.

    A fit is a chain of small jobs that leaves a cluster idle between them. Every task has
    a scheduler pool of its own, so with ``spark.scheduler.mode`` FAIR they share executors
    evenly. The first failure is raised.
    """
    context = spark.sparkContext

    def in_pool(task: Callable, name: str):
        context.setLocalProperty("spark.scheduler.pool", name)
        return task()

    with ThreadPoolExecutor(max(1, min(threads, len(tasks)))) as pool:
        target = inheritable_thread_target(spark)
        futures = [pool.submit(target(in_pool), task, f"fit-{i % threads}") for i, task in enumerate(tasks)]
        return [f.result() for f in futures]


@dataclass
class Prepared:
    """Imputed, assembled and weighted training rows, stored once for several fits."""

    rows: DataFrame
    inputs: list
    n_rows: int
    label: str


def prepare(train: DataFrame, features: Sequence[str], label: str = "target_phase3plus", impute: str = "zero") -> Prepared:
    """Fill, assemble and weigh the rows of a fold.

    Tree bagging draws by row position, and a shuffle delivers rows in any order, so the
    rows of each partition are put in an order that depends on their values only. Rows are
    dealt to as many partitions as their number asks for.
    """
    features, inputs = list(features), []
    rows = settle(numeric(train, features, impute).select(*features, F.col(label).cast("double").alias(label)))
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = sum(sizes.values())
    columns = features
    if impute == "median":
        columns = [f"_f_{c}" for c in features]
        inputs.append(Imputer(strategy="median", inputCols=features, outputCols=columns).fit(rows))
    inputs.append(VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error"))
    filled = PipelineModel(inputs).transform(rows)
    weight = F.when(F.col(label) == 1, n_rows / (2 * max(1, sizes.get(1.0, 0)))).otherwise(n_rows / (2 * max(1, sizes.get(0.0, 0))))
    parts = max(1, -(-n_rows // ROWS_PER_PARTITION))
    dealt = filled.select(*features, label, "features", weight.alias("_weight")).repartition(parts, F.xxhash64(*features, label))
    ordered = dealt.sortWithinPartitions(F.xxhash64(*features, label), *features)
    return Prepared(settle(ordered.select("features", label, "_weight")), inputs, n_rows, label)


def fit_prepared(prepared: Prepared, name: str, seed: int = 42, max_iter: int = 100) -> PipelineModel:
    """One candidate over prepared rows, as a pipeline that starts from the raw columns."""
    stages, rows = list(prepared.inputs), prepared.rows
    estimator = classifier(name, prepared.n_rows, prepared.label, seed, max_iter)
    if name == "logistic_regression":
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_scaled").fit(rows)
        stages.append(scaler)
        rows = scaler.transform(rows)
        estimator.setFeaturesCol("_scaled")
    return PipelineModel([*stages, estimator.fit(rows)])


def classifier(name: str, n_rows: int, label: str = LABEL, seed: int = 42, max_iter: int = 100):
    """One of the candidate estimators; all weigh the classes equally.

    The logistic penalty is 1/n, which is a unit penalty on the summed loss.
    """
    common = {"labelCol": label, "featuresCol": "features", "weightCol": "_weight"}
    if name == "logistic_regression":
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_rows, 1), standardization=False, **common)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=100, maxDepth=5, seed=seed, **common)
    if name == "boosting":
        return GBTClassifier(maxIter=max_iter, maxDepth=4, stepSize=0.1, seed=seed, **common)
    raise ValueError(f"unknown model '{name}'; choose from {', '.join(CANDIDATES)}")


def numeric(df: DataFrame, features: Sequence[str], impute: str) -> DataFrame:
    """Feature columns as doubles; ``zero`` imputation happens here."""
    typed = df.withColumns({c: F.col(c).cast("double") for c in features})
    return typed.fillna(0.0, subset=list(features)) if impute == "zero" else typed


def fit_classifier(
    train: DataFrame, name: str, features: Sequence[str], label: str = LABEL, impute: str = "zero",
    seed: int = 42, max_iter: int = 100,
) -> PipelineModel:
    """Fit one candidate."""
    if name not in CANDIDATES:
        raise ValueError(f"unknown model '{name}'; choose from {', '.join(CANDIDATES)}")
    return fit_prepared(prepare(train, features, label, impute), name, seed, max_iter)


def probability(column: str = "probability") -> Column:
    return F.get(vector_to_array(column), F.lit(1))


def score(
    model: Model, df: DataFrame, features: Sequence[str], impute: str = "zero", out: str = "p"
) -> DataFrame:
    """``df`` with the event probability of each row."""
    scored = model.transform(numeric(df, features, impute)).withColumn(out, probability())
    return scored.select(*[c for c in df.columns if c != out], out)


# -- calibration and per-horizon forecaster ------------------------------------------


def fit_platt(scored: DataFrame, prob: str = "p", label: str = LABEL) -> LogisticRegressionModel:
    """Logistic curve over the raw probability, unit penalty."""
    vector = VectorAssembler(inputCols=[prob], outputCol="_p")
    rows = vector.transform(scored).select("_p", F.col(label).cast("double").alias("_y"))
    n = max(rows.count(), 1)
    lr = LogisticRegression(
        featuresCol="_p", labelCol="_y", regParam=1.0 / n, standardization=False, maxIter=100
    )
    return lr.fit(rows)


def apply_platt(
    calibrator: LogisticRegressionModel | None, scored: DataFrame, prob: str = "p", out: str = "p"
) -> DataFrame:
    """Calibrated probability; the raw one passes through without a calibrator.

    The curve is two numbers, so it is applied as an expression.
    """
    if calibrator is None:
        return scored if out == prob else scored.withColumn(out, F.col(prob))
    slope, shift = float(calibrator.coefficients[0]), float(calibrator.intercept)
    return scored.withColumn(out, 1.0 / (1.0 + F.exp(-(F.col(prob) * slope + shift))))


@dataclass
class HorizonForecaster:
    """Fitted model, cut-off and calibration of one horizon."""

    horizon: int
    model_name: str
    features: list[str]
    pipeline: PipelineModel
    threshold: float = 0.50
    calibrator: LogisticRegressionModel | None = None
    threshold_row: dict = field(default_factory=dict)
    impute: str = "zero"

    def predict(self, df: DataFrame, calibrated: bool = True) -> DataFrame:
        raw = score(self.pipeline, df, self.features, self.impute, "p")
        out = apply_platt(self.calibrator if calibrated else None, raw)
        return out.withColumns(
            {"decision_threshold": F.lit(self.threshold), "alert": F.col("p") >= self.threshold}
        )

    def save(self, path: str) -> None:
        """Pipeline, calibrator and a JSON side table under one folder."""
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/model")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        meta = {
            "horizon": self.horizon, "model_name": self.model_name, "features": self.features,
            "threshold": self.threshold, "calibrated": self.calibrator is not None, "impute": self.impute,
        }
        row = spark.createDataFrame([(json.dumps(meta),)], "meta string")
        row.coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str, *fallbacks: str) -> HorizonForecaster:
        """Bundle at the first folder that exists."""
        spark = SparkSession.active()
        at = first_existing(spark, path, *fallbacks)
        meta = json.loads(spark.read.text(f"{at}/meta").first()[0])
        calibrator = LogisticRegressionModel.load(f"{at}/calibrator") if meta["calibrated"] else None
        return cls(
            meta["horizon"], meta["model_name"], meta["features"], PipelineModel.load(f"{at}/model"),
            meta["threshold"], calibrator, impute=meta["impute"],
        )


def fit_horizon(
    horizon: int, train: DataFrame | Prepared, validation: DataFrame | None, name: str = "random_forest",
    features: Sequence[str] = tuple(V.LONG_FEATURES), label: str = LABEL, tune_on: str = "raw",
    seed: int = 42, max_iter: int = 100,
) -> HorizonForecaster:
    """Fit, then choose the cut-off and calibrate on the validation rows.

    ``tune_on="raw"`` chooses the cut-off on uncalibrated probabilities although it
    is applied to calibrated ones; ``"calibrated"`` uses the same scale for both.
    ``train`` may be prepared already, for several candidates over the same rows.
    """
    features = list(features)
    prepared = train if isinstance(train, Prepared) else prepare(train, features, label)
    pipeline = fit_prepared(prepared, name, seed, max_iter)
    out = HorizonForecaster(horizon, name, features, pipeline)
    if validation is None:
        return out
    raw = score(pipeline, validation, features).withColumn("y", F.col(label).cast("int"))
    raw = settle(raw.select("y", label, "p"))
    out.calibrator = fit_platt(raw, "p", label)
    tuned = raw if tune_on == "raw" else apply_platt(out.calibrator, raw)
    row = best_threshold(threshold_grid(tuned)).first()
    if row is not None:
        out.threshold, out.threshold_row = float(row["threshold"]), row.asDict()
    return out


# -- schema-checked scoring -----------------------------------------------------------


def check_features(df: DataFrame, features: Sequence[str]) -> None:
    absent = missing_columns(df.columns, features)
    if absent:
        raise SchemaDrift(f"columns of the model schema are absent: {absent}")


def predict_checked(forecaster: HorizonForecaster, df: DataFrame) -> DataFrame:
    check_features(df, forecaster.features)
    return forecaster.predict(df)


def score_panel(
    panel: DataFrame, forest: PipelineModel, logistic: PipelineModel,
    features: Sequence[str] = tuple(V.PANEL_FEATURES), fill=fill_back_then_forward,
) -> DataFrame:
    """Panel with both model probabilities and the band of the forest's.

    Gaps are filled backward then forward by default, which borrows later months;
    pass :func:`harbinger.operators.keys.fill_forward` for a leak-free score.
    """
    from harbinger.functions.scalars import risk_band
    from harbinger.plans.views import with_period

    filled = with_period(fill(panel, list(features)))
    both = score(logistic, score(forest, filled, features, out="model_risk_prob"), features, out="model_risk_prob_lr")
    return both.withColumn("risk_band", risk_band(F.col("model_risk_prob")))


def fit_ensemble(
    train: DataFrame | Prepared, features: Sequence[str], label: str = LABEL, seed: int = 42, max_iter: int = 100
) -> dict[str, PipelineModel]:
    """Logistic, forest and boosting models over median-imputed features, fitted side by side."""
    prepared = train if isinstance(train, Prepared) else prepare(train, features, label, "median")
    spark = prepared.rows.sparkSession
    fits = [lambda n=name: fit_prepared(prepared, n, seed, max_iter) for name in CANDIDATES]
    return dict(zip(CANDIDATES, concurrently(spark, fits), strict=True))


def score_all(models: dict[str, PipelineModel], df: DataFrame, features: Sequence[str], impute: str = "median") -> DataFrame:
    """One probability column ``p_<model>`` per model."""
    out = df
    for name, model in models.items():
        out = score(model, out, features, impute, f"p_{name}")
    return out


def score_ensemble(models: dict[str, PipelineModel], df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One probability column per model and their weighted mean ``p``."""
    return score_all(models, df, features).withColumn("p", blend(*[F.col(f"p_{n}") for n in CANDIDATES]))


def tree_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance of each feature in the fitted trees (one row per feature)."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")

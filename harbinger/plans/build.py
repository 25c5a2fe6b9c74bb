"""The batch build: ingest the feeds, store panel and long table, train, report.

The feeds are joined once, what changed is landed in the stored panel, and the long table
starts from there. Training reads the stored long table and stores the fitted models beside
it, where the forecasts read them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.operators.horizon import HORIZONS, build_long_table
from harbinger.operators.keys import years_between
from harbinger.operators.learn import HorizonForecaster, predict_checked, score_panel
from harbinger.operators.panel import join_feeds
from harbinger.operators.quality import SchemaDrift, source_quality, validate_panel
from harbinger.operators.splits import rolling_origin, split_by_year
from harbinger.plans.experiments import baseline_job, horizon_backtest
from harbinger.plans.stored_panel import StoredPanel
from harbinger.sources.feeds import monthly_assessments
from harbinger.sources.manifest import (
    FEED_OF_SOURCE, MANIFEST_COLUMNS, append_manifest, failed_record, ingest, latest_assets, read_manifest, source_registry,
)
from harbinger.sources.shared import settle
from harbinger.sources.storage import path_exists, replace_report, write_report, write_table

STEPS = ("all", "ingest", "validate", "features", "train")


@dataclass
class Ingested:
    """Normalised feeds, manifest records, unmatched names and failures per source."""

    feeds: dict[str, DataFrame] = field(default_factory=dict)
    records: dict[str, DataFrame] = field(default_factory=dict)
    unmatched: dict[str, int] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)


def ingest_sources(
    spark: SparkSession, folders: Mapping[str, str], dim: DataFrame, as_of: str, retrieved_at: str,
    manifest: str | None = None,
) -> Ingested:
    """Ingest each source; one that fails is noted and does not stop the others."""
    out = Ingested()
    for key, folder in folders.items():
        try:
            data, record, coverage = ingest(spark, key, folder, dim, as_of, retrieved_at)
            unmatched = coverage.first()["unmatched_count"]
            if manifest is not None:
                append_manifest(record, manifest)
        except (FileNotFoundError, SchemaDrift, PySparkException) as err:
            out.failures[key] = str(err).splitlines()[0]
            if manifest is not None:
                append_manifest(failed_record(spark, key, out.failures[key], retrieved_at, folder), manifest)
            continue
        out.feeds[FEED_OF_SOURCE[key]] = data
        out.records[key] = record
        if unmatched:
            out.unmatched[key] = unmatched
    return out


def build_tables(
    feeds: Mapping[str, DataFrame], dim: DataFrame, edges: DataFrame | None, out: str,
    from_date: str | None = None, to_date: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store panel and long table; returns (panel, long table, panel rule counts)."""
    joined = join_feeds(
        feeds["rainfall"], feeds["vegetation"], feeds["market"], monthly_assessments(feeds["assessments"])
    )
    store = StoredPanel(joined.sparkSession, f"{out}/panel")
    store.replace(joined)
    panel = years_between(store.panel(), from_date, to_date)
    long = write_table(build_long_table(panel, dim, edges), f"{out}/long")
    return panel, long, validate_panel(panel, dim)


def train_models(
    spark: SparkSession, out: str, folds: Sequence[tuple] = tuple(V.ROLLING_FOLDS), experiment: str = "backtest",
    **options,
) -> bool:
    """Compare, choose, fit and store one forecaster per horizon from the stored long table.

    Metrics and calibration bins are stored under ``experiment``; training again replaces
    them. False, and nothing stored, where a fold has no labelled rows of both roles.
    """
    long = settle(spark.read.parquet(f"{out}/long"))
    parts = rolling_origin(long, folds).groupBy("fold_name", "horizon_months").agg(
        (F.count_if(F.col("role") == "train") > 0) & (F.count_if(F.col("role") == "eval") > 0)
    )
    horizons = tuple(options.get("horizons", HORIZONS))
    full = [r for r in parts.collect() if r[2] and r["horizon_months"] in horizons]
    if len(full) < len(horizons) * len(folds):
        return False
    options.setdefault("features", [c for c in V.LONG_FEATURES if c in long.columns])  # no neighbours without edges
    metrics, curves, chosen = horizon_backtest(long, folds, **options)
    for horizon, forecaster in chosen.items():
        forecaster.save(f"{out}/models/horizon_{horizon}")
    for frame, name in ((metrics, "metrics"), (curves, "calibration")):
        replace_report(frame.withColumn("experiment_id", F.lit(experiment)), f"{out}/{name}")
    panel = StoredPanel(spark, f"{out}/panel").panel()
    if not split_by_year(panel).where("split = 'train'").isEmpty():
        scores, pipelines = baseline_job(panel)
        replace_report(scores.withColumn("experiment_id", F.lit(experiment)), f"{out}/panel_metrics")
        for name, pipeline in pipelines.items():
            pipeline.write().overwrite().save(f"{out}/models/panel_{name}")
    return True


def stored_scores(spark: SparkSession, out: str) -> DataFrame:
    """The stored panel scored by the stored same-month models."""
    models = (PipelineModel.load(f"{out}/models/panel_{m}") for m in ("random_forest", "logistic_regression"))
    return score_panel(StoredPanel(spark, f"{out}/panel").panel(), *models)


def stored_forecasts(spark: SparkSession, out: str, period: str | None = None) -> DataFrame:
    """Rows of the stored long table at a period (its newest by default), scored by the stored forecasters."""
    long = spark.read.parquet(f"{out}/long")
    if period is None:
        newest = long.agg(F.max("observation_period").alias("p")).scalar()
        rows = long.where(F.col("observation_period") == newest)
    else:
        rows = long.where(F.col("observation_period") == period)
    parts = [
        predict_checked(HorizonForecaster.load(f"{out}/models/horizon_{h}"), rows.where(F.col("horizon_months") == h))
        for h in HORIZONS
    ]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("p", "risk_probability")


def quality_report(spark: SparkSession, ingested: Ingested, manifest: DataFrame) -> DataFrame:
    keyed = {key: ingested.feeds[feed] for key, feed in FEED_OF_SOURCE.items() if feed in ingested.feeds}
    return source_quality(keyed, source_registry(spark), latest_assets(manifest))


def run_build(
    spark: SparkSession, folders: Mapping[str, str], out: str, dim: DataFrame, as_of: str, retrieved_at: str,
    edges: DataFrame | None = None, step: str = "all", dry_run: bool = False,
    from_date: str | None = None, to_date: str | None = None, sources: Sequence[str] = (),
    folds: Sequence[tuple] = tuple(V.ROLLING_FOLDS), **training,
) -> DataFrame:
    """Run the chosen step and append one row to the run log, which is returned.

    ``dry_run`` ingests and checks without storing tables. ``train`` starts from the stored
    long table; as part of ``all`` it is left out where the folds have no rows, and the log
    says so.
    """
    if step not in STEPS:
        raise ValueError(f"unknown step '{step}'; choose from {', '.join(STEPS)}")
    wanted = {k: v for k, v in folders.items() if not sources or k in sources}
    manifest_path = f"{out}/manifest"
    got = Ingested()
    if step == "train":
        wanted = {}
    else:
        got = ingest_sources(
            spark, wanted, dim, as_of, retrieved_at, None if step == "features" else manifest_path
        )
    panel_rows = long_rows = broken = trained = None
    if step in ("all", "features") and not dry_run and len(got.feeds) == len(FEED_OF_SOURCE):
        panel, long, rules = build_tables(got.feeds, dim, edges, out, from_date, to_date)
        panel_rows, long_rows = panel.count(), long.count()
        broken = rules.agg(F.count_if(F.col("n_bad") > 0)).first()[0]
    if step in ("all", "validate") and got.feeds:
        report = quality_report(spark, got, read_manifest(spark, manifest_path).select(*MANIFEST_COLUMNS))
        write_report(report, f"{out}/quality", mode="overwrite")
    if step in ("all", "train") and not dry_run and path_exists(spark, f"{out}/long"):
        trained = train_models(spark, out, folds, **training)
    status = "success" if not got.failures else "partial_failure"
    row = (
        retrieved_at, step, dry_run, sorted(wanted), sorted(set(wanted) - set(got.failures)),
        sorted(f"{k}: {v}" for k, v in got.failures.items()),
        sorted(f"{k}: {v}" for k, v in got.unmatched.items()), panel_rows, long_rows, broken, trained, status,
    )
    log = spark.createDataFrame(
        [row],
        "started string, step string, dry_run boolean, attempted array<string>, succeeded array<string>, "
        "failed array<string>, unmatched array<string>, panel_rows bigint, long_rows bigint, broken_rules bigint, models_trained boolean, status string",
    )
    write_report(log, f"{out}/runs")
    return log

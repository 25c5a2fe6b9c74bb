"""Splits, baselines, metrics, curves, bootstrap, rank stability."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import oracle_tables as O
from checks import standins as S
from checks.catalog import query, r6
from harbinger import fixed_values as V
from harbinger.functions.scalars import blend, ensemble_spread
from harbinger.operators import baselines as B
from harbinger.operators import metrics as M
from harbinger.operators import splits as P
from harbinger.operators.bootstrap import block_bootstrap
from harbinger.operators.importance import feature_stability, permutation_importance
from harbinger.plans import experiments as X
from harbinger.plans.views import best_registry_row, registry_slice, select_model, top_features
from harbinger.sources.shared import settle, shared_folder

FEATURES_NOT_NULL = " AND ".join(
    f"{c} IS NOT NULL"
    for c in [
        "rainfall_anomaly_1m", "rainfall_anomaly_3m", "rainfall_rolling_3m", "consecutive_dry_months",
        "ndvi_anomaly_1m", "ndvi_anomaly_3m", "ndvi_trend_3m", "maize_price_change_1m",
        "maize_price_change_3m", "maize_price_zscore", "previous_ipc_phase", "target_phase3plus",
    ]
)


@query(
    "time_split",
    f"""WITH {O.PANEL} SELECT county_name, year, month, target_phase3plus,
    CASE WHEN year BETWEEN 1995 AND 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split
    FROM panel WHERE year BETWEEN 1995 AND 2001 AND {FEATURES_NOT_NULL}""",
)
def split_query(spark, sf):
    out = P.split_by_year(S.panel(spark, sf), **S.YEARS)
    return out.select("county_name", "year", "month", "target_phase3plus", "split")


FOLDS = """
folds(fold_name, split_type, b0, b1, e0, e1) AS (VALUES
  ('val_1999', 'validation', DATE '1995-07-01', DATE '1998-12-31', DATE '1999-01-01', DATE '1999-12-31'),
  ('test_2000', 'test', DATE '1995-07-01', DATE '1999-12-31', DATE '2000-01-01', DATE '2000-12-31')),
roles AS (
  SELECT long.*, fold_name, split_type, role FROM long, folds, (VALUES ('train'), ('eval')) AS r(role)
  WHERE label IS NOT NULL AND CASE role WHEN 'train' THEN observation_date BETWEEN b0 AND b1
    ELSE observation_date BETWEEN e0 AND e1 END
)"""


@query(
    "rolling_origin",
    f"""WITH {O.LONG}, {FOLDS} SELECT county_name, observation_date, horizon_months, label AS target_phase3plus,
    fold_name, split_type, role FROM roles""",
)
def rolling_query(spark, sf):
    out = P.rolling_origin(S.long_table(spark, sf), S.FOLDS)
    return out.select(
        "county_name", "observation_date", "horizon_months", "target_phase3plus", "fold_name", "split_type", "role"
    )


@query(
    "rolling_origin_purged",
    f"""WITH {O.LONG}, {FOLDS} SELECT fold_name, horizon_months, role, count(*) AS n FROM roles JOIN folds USING (fold_name)
    WHERE role = 'eval' OR target_date < e0 GROUP BY 1, 2, 3""",
)
def purged_query(spark, sf):
    out = P.rolling_origin(S.long_table(spark, sf), S.FOLDS, purge=True)
    return out.groupBy("fold_name", "horizon_months", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fold_counts",
    f"""WITH {O.LONG}, {FOLDS} SELECT fold_name, split_type, horizon_months,
      count(*) FILTER (role = 'train') AS train_count, count(*) FILTER (role = 'eval') AS eval_count
    FROM roles GROUP BY 1, 2, 3""",
)
def fold_counts_query(spark, sf):
    return P.fold_counts(P.rolling_origin(S.long_table(spark, sf), S.FOLDS))


@query(
    "persistence",
    f"""WITH {O.LONG} SELECT county_name, observation_date, horizon_months,
    CASE WHEN previous_ipc_phase >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM long""",
)
def persistence_query(spark, sf):
    out = B.persistence(S.long_table(spark, sf))
    return out.select("county_name", "observation_date", "horizon_months", "p")


def _fold(spark, sf):
    """Training and evaluation rows of the 2000 fold, horizon 1, from one scan of the panel."""
    long = S.long_table(spark, sf).where(
        (F.col("horizon_months") == 1) & F.col("target_phase3plus").isNotNull()
    )
    train = long.where(F.col("observation_date") <= F.lit("1999-12-31").cast("date"))
    held = long.where(F.col("observation_date").between("2000-01-01", "2000-12-31"))
    return train, held


FOLD = f"""{O.LONG},
tr AS (SELECT * FROM long WHERE horizon_months = 1 AND label IS NOT NULL AND observation_date <= DATE '1999-12-31'),
ev AS (SELECT * FROM long WHERE horizon_months = 1 AND label IS NOT NULL
       AND observation_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'),
g AS (SELECT avg(label) AS rate FROM tr),
e AS (SELECT county_name, avg(label) AS rate FROM tr GROUP BY 1),
m AS (SELECT month, avg(label) AS rate FROM tr GROUP BY 1),
em AS (SELECT county_name, month, avg(label) AS rate FROM tr GROUP BY 1, 2)"""


def _clip_sql(x):
    return f"round(greatest(0.001, least(0.999, {x})), 6)"


@query(
    "historical_frequency",
    f"""WITH {FOLD} SELECT ev.county_name, ev.observation_date,
    {_clip_sql("coalesce(e.rate, (SELECT rate FROM g))")} AS p
    FROM ev LEFT JOIN e ON e.county_name = ev.county_name""",
)
def frequency_query(spark, sf):
    out = B.historical_frequency(*_fold(spark, sf))
    return r6(out.select("county_name", "observation_date", "p"))


@query(
    "seasonal_prior",
    f"""WITH {FOLD} SELECT ev.county_name, ev.observation_date,
    {_clip_sql("coalesce(em.rate, m.rate, (SELECT rate FROM g))")} AS p
    FROM ev LEFT JOIN em ON em.county_name = ev.county_name AND em.month = ev.month
    LEFT JOIN m ON m.month = ev.month""",
)
def seasonal_query(spark, sf):
    out = B.seasonal_rate(*_fold(spark, sf))
    return r6(out.select("county_name", "observation_date", "p"))


@query(
    "event_rates",
    f"""WITH {FOLD} SELECT county_name, CAST(month AS INTEGER) AS month, level, round(rate, 6) AS rate, n FROM (
      SELECT county_name, month, 'entity_month' AS level, avg(label) AS rate, count(*) AS n FROM tr GROUP BY 1, 2
      UNION ALL SELECT county_name, NULL, 'entity', avg(label), count(*) FROM tr GROUP BY 1
      UNION ALL SELECT NULL, month, 'month', avg(label), count(*) FROM tr GROUP BY 2
      UNION ALL SELECT NULL, NULL, 'all', avg(label), count(*) FROM tr)""",
)
def rates_query(spark, sf):
    return r6(B.event_rates(_fold(spark, sf)[0]))


CONFUSION = """
  count(*) AS n, count(*) FILTER (y = 1 AND p >= {t}) AS tp, count(*) FILTER (y = 0 AND p >= {t}) AS fp,
  count(*) FILTER (y = 1 AND p < {t}) AS fn, count(*) FILTER (y = 0 AND p < {t}) AS tn,
  avg((p - y) * (p - y)) AS brier"""
RATES = """
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
  round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS false_negative_rate"""


def areas(keys: str, source: str) -> str:
    """Exact areas per group of a ``(keys, p, pos, neg)`` table."""
    by = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""(SELECT {lead}
      CASE WHEN max(pt) > 0 AND max(nt) > 0 THEN sum(pos * (nt - na + neg / 2.0)) / (max(pt) * CAST(max(nt) AS DOUBLE)) END AS roc_auc,
      CASE WHEN max(pt) > 0 AND max(nt) > 0 THEN sum(pos * (pa / (pa + na))) / max(pt) END AS pr_auc
    FROM (SELECT {lead}pos, neg, CAST(sum(pos) OVER ({by}ORDER BY p DESC) AS DOUBLE) AS pa,
      CAST(sum(neg) OVER ({by}ORDER BY p DESC) AS DOUBLE) AS na,
      CAST(sum(pos) OVER ({by or ""}) AS DOUBLE) AS pt, CAST(sum(neg) OVER ({by or ""}) AS DOUBLE) AS nt FROM {source}) {group})"""


COUNTS = "counts AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY 1)"


@query(
    "metrics_at_threshold",
    f"""WITH {O.SCORED}, {COUNTS}, c AS (SELECT {CONFUSION.format(t="0.35::DOUBLE")} FROM scored)
    SELECT 0.35::DOUBLE AS threshold, n, {RATES.replace(", 6)", ", 9)")}, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS false_positive_rate,
      round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc, round(brier, 9) AS brier_score,
      tp AS true_positives, fn AS false_negatives, tn AS true_negatives, fp AS false_positives,
      'Recall is ' || printf('%.1f', tp / (tp + fn) * 100) || '%. Out of ' || (tp + fn) || ' true Crisis periods, '
        || 'the model correctly flagged ' || tp || ' and missed ' || fn || ' (False Negative Rate: '
        || printf('%.1f', fn / (tp + fn) * 100) || '%).' AS commentary
    FROM c, {areas("", "counts")}""",
)
def metrics_query(spark, sf):
    out = M.recall_sentence(M.full_metrics(S.scored_orders(spark, sf), threshold=0.35, decimals=9))
    return out.drop("confusion_matrix")


GAPPY = """gappy AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE y END AS y,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE p END AS p FROM scored),
known AS (SELECT * FROM gappy WHERE y IS NOT NULL AND p IS NOT NULL)"""


@query(
    "metrics_with_missing",
    f"""WITH {O.SCORED}, {GAPPY},
    counts AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM known GROUP BY 1),
    c AS (SELECT {CONFUSION.format(t="0.35::DOUBLE")} FROM known)
    SELECT source, c.n, tp, fp, fn, tn, round(brier, 9) AS brier_score,
      CASE WHEN source = 'full_metrics' THEN round(roc_auc, 9) END AS roc_auc
    FROM c, {areas("", "counts")}, (VALUES ('confusion'), ('full_metrics')) AS v(source)""",
)
def missing_metrics_query(spark, sf):
    """Missing labels and scores are left out alike by the plain counts and the full row."""
    gappy = S.scored_orders(spark, sf).withColumns(
        {"y": F.when(F.col("o_orderkey") % 11 != 0, F.col("y")), "p": F.when(F.col("o_orderkey") % 13 != 0, F.col("p"))}
    )
    plain = M.confusion(gappy, threshold=0.35).withColumn("roc_auc", F.lit(None).cast("double"))
    full = M.full_metrics(gappy, threshold=0.35, decimals=9).withColumnsRenamed(
        {"true_positives": "tp", "false_positives": "fp", "false_negatives": "fn", "true_negatives": "tn"}
    )
    columns = ["n", "tp", "fp", "fn", "tn", F.round("brier_score", 9).alias("brier_score"), "roc_auc"]
    return plain.select(F.lit("confusion").alias("source"), *columns).union(
        full.select(F.lit("full_metrics").alias("source"), *columns)
    )


@query(
    "metrics_by_group",
    f"""WITH {O.SCORED_BY_ENTITY},
    counts AS (SELECT county_name, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM by_entity GROUP BY 1, 2),
    c AS (SELECT county_name, {CONFUSION.format(t="0.5")} FROM by_entity GROUP BY 1)
    SELECT c.county_name, n, {RATES.replace(", 6)", ", 9)")}, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc,
      round(brier, 9) AS brier_score
    FROM c JOIN {areas("county_name", "counts")} a ON a.county_name = c.county_name""",
)
def grouped_metrics_query(spark, sf):
    out = M.full_metrics(S.scored_by_entity(spark, sf), ["county_name"], decimals=9)
    return out.select(
        "county_name", "n", "precision", "recall", "f1_score", "false_negative_rate", "roc_auc", "pr_auc",
        "brier_score",
    )


GRID = f"""grid AS (
  SELECT t, threshold, fn, {{rates}} FROM (
    SELECT i, t, round(t, 2) AS threshold, {CONFUSION.format(t="t")} FROM scored,
      (SELECT i, CASE WHEN i = 16 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE + i * 0.05::DOUBLE END AS t FROM range(17) AS r(i))
    GROUP BY 1, 2)
)"""


@query(
    "threshold_grid",
    f"""WITH {O.SCORED}, {GRID.format(rates=RATES)}
    SELECT threshold, precision, recall, f1_score, false_negative_rate, fn AS false_negatives FROM grid""",
)
def grid_query(spark, sf):
    return M.threshold_grid(S.scored_orders(spark, sf), decimals=6)


@query(
    "best_threshold",
    f"""WITH {O.SCORED}, {GRID.format(rates=RATES.replace(", 6)", ", 4)"))}
    SELECT threshold, precision, recall, f1_score, false_negative_rate, fn AS false_negatives FROM grid
    ORDER BY recall >= 0.8 DESC, CASE WHEN recall >= 0.8 THEN f1_score ELSE recall END DESC, threshold LIMIT 1""",
)
def best_threshold_query(spark, sf):
    return M.best_threshold(M.threshold_grid(S.scored_orders(spark, sf)))


@query(
    "reliability_curve",
    f"""WITH {O.SCORED} SELECT CAST((p > 1 * 0.2::DOUBLE)::INT + (p > 2 * 0.2::DOUBLE)::INT
      + (p > 3 * 0.2::DOUBLE)::INT + (p > 4 * 0.2::DOUBLE)::INT AS INTEGER) AS bin, count(*) AS n,
      round(avg(y), 9) AS prob_true, round(avg(p), 9) AS prob_pred FROM scored GROUP BY 1""",
)
def reliability_query(spark, sf):
    return r6(M.reliability_curve(S.scored_orders(spark, sf)), 9)


@query("roc_auc", f"WITH {O.SCORED}, {COUNTS} SELECT round(roc_auc, 8) AS roc_auc FROM {areas('', 'counts')}")
def roc_query(spark, sf):
    counts = M.score_counts(S.scored_orders(spark, sf))
    return r6(M.ranking_areas(counts).select("roc_auc"), 8)


@query("average_precision", f"WITH {O.SCORED}, {COUNTS} SELECT round(pr_auc, 8) AS pr_auc FROM {areas('', 'counts')}")
def precision_query(spark, sf):
    counts = M.score_counts(S.scored_orders(spark, sf))
    return r6(M.ranking_areas(counts).select("pr_auc"), 8)


@query("brier", f"WITH {O.SCORED} SELECT count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier_score FROM scored")
def brier_query(spark, sf):
    return r6(M.confusion(S.scored_orders(spark, sf)).select("n", "brier_score"), 9)


@query(
    "distinct_score_curve",
    f"""WITH {O.SCORED}, {COUNTS} SELECT p, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
      CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS pos_at,
      CAST(sum(neg) OVER (ORDER BY p DESC) AS BIGINT) AS neg_at FROM counts""",
)
def curve_query(spark, sf):
    out = M.running_counts(M.score_counts(S.scored_orders(spark, sf)))
    return out.select("p", "pos", "neg", "pos_at", "neg_at")


@query(
    "entity_performance",
    f"""WITH {O.SCORED_BY_ENTITY}, c AS (SELECT county_name, avg(p) AS mp, {CONFUSION.format(t="0.5")} FROM by_entity GROUP BY 1)
    SELECT county_name, n AS test_observations, tp + fn AS positive_events,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
      round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_score, round(brier, 9) AS brier_score,
      round(1 - coalesce(tp / nullif(tp + fn, 0), 0), 9) AS false_negative_rate,
      round(mp, 9) AS mean_predicted_probability FROM c""",
)
def entity_query(spark, sf):
    return M.entity_performance(S.scored_by_entity(spark, sf), decimals=9)


@query(
    "error_extracts",
    f"""WITH {O.SCORED} SELECT o_orderkey, y, p, CASE WHEN y = 1 THEN 'false_negative' ELSE 'false_positive' END AS error
    FROM scored WHERE (y = 1 AND p < 0.5) OR (y = 0 AND p >= 0.5)""",
)
def errors_query(spark, sf):
    scored = S.scored_orders(spark, sf).select("o_orderkey", "y", "p")
    missed = M.error_rows(scored, missed=True).withColumn("error", F.lit("false_negative"))
    alarms = M.error_rows(scored, missed=False).withColumn("error", F.lit("false_positive"))
    return missed.unionByName(alarms)


BOOT_N, BOOT_SEED = 300, 42


@query(
    "block_bootstrap",
    f"""WITH {O.SCORED},
    cells AS (SELECT block, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY 1, 2),
    blocks AS (SELECT block, row_number() OVER (ORDER BY block) AS no FROM (SELECT DISTINCT block FROM scored)),
    k AS (SELECT count(*) AS k FROM blocks),
    draws AS (SELECT r AS replicate,
        ('0x' || substr(md5('{BOOT_SEED}-' || r || '-' || s), 1, 8))::UBIGINT % (SELECT k FROM k) + 1 AS no
      FROM range(1, {BOOT_N + 1}) AS a(r), range(1, (SELECT k FROM k) + 1) AS b(s)),
    times AS (SELECT replicate, block, count(*) AS t FROM draws JOIN blocks USING (no) GROUP BY 1, 2
      UNION ALL SELECT 0, block, 1 FROM blocks),
    counts AS (SELECT replicate, p, sum(t * pos) AS pos, sum(t * neg) AS neg
      FROM cells JOIN times USING (block) GROUP BY 1, 2),
    tab AS (SELECT replicate, sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) AS fp,
      sum(CASE WHEN p < 0.5 THEN pos ELSE 0 END) AS fn, sum(CASE WHEN p < 0.5 THEN neg ELSE 0 END) AS tn,
      sum(pos * (p - 1) * (p - 1) + neg * p * p) / sum(pos + neg) AS brier_score FROM counts GROUP BY 1),
    ms AS (SELECT tab.replicate, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
      coalesce(roc_auc, 0.5) AS roc_auc, coalesce(pr_auc, 0) AS pr_auc, brier_score,
      1 - coalesce(tp / nullif(tp + fn, 0), 0) AS false_negative_rate
      FROM tab JOIN {areas("replicate", "counts")} a ON a.replicate = tab.replicate),
    l AS (UNPIVOT ms ON recall, precision, f1, roc_auc, pr_auc, brier_score, false_negative_rate INTO NAME metric VALUE v)
    SELECT metric, round(max(v) FILTER (replicate = 0), 9) AS estimate,
      round(quantile_cont(v, 0.025::DOUBLE) FILTER (replicate > 0), 9) AS ci_lower,
      round(quantile_cont(v, 0.975::DOUBLE) FILTER (replicate > 0), 9) AS ci_upper,
      round(stddev_pop(v) FILTER (replicate > 0), 9) AS std FROM l GROUP BY 1""",
)
def bootstrap_query(spark, sf):
    return block_bootstrap(S.scored_orders(spark, sf), "block", BOOT_N, BOOT_SEED, decimals=9)


@query(
    "label_distribution",
    """SELECT o_orderstatus AS label, count(*) AS n,
    round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS share FROM orders GROUP BY 1""",
)
def labels_query(spark, sf):
    orders = S.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "label")
    return r6(M.label_distribution(orders, "label"))


def _bin_sql(bins):
    """Edges that are not above the score, written out as the doubles they are."""
    return " + ".join(f"CAST(p >= '{i * (1.0 / bins)!r}'::DOUBLE AS INTEGER)" for i in range(1, bins))


@query(
    "prob_histogram",
    f"""WITH {O.SCORED} SELECT y AS label, {_bin_sql(10)} AS bin, count(*) AS n
    FROM scored GROUP BY 1, 2""",
)
def histogram_query(spark, sf):
    return M.probability_histogram(S.scored_orders(spark, sf))


@query(
    "prob_histogram_20",
    f"""WITH {O.SCORED} SELECT y AS label, {_bin_sql(20)} AS bin, count(*) AS n
    FROM scored GROUP BY 1, 2""",
)
def histogram20_query(spark, sf):
    return M.probability_histogram(S.scored_orders(spark, sf), bins=20)


PARTS = """
imp AS (SELECT p_partkey % 3 + 1 AS horizon, p_brand AS feature,
  round(CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT) % 1000) AS DOUBLE) / count(*) / 1000, 6) AS importance
  FROM part GROUP BY 1, 2)"""


def importance_by_horizon(spark, sf):
    cents = F.pmod(F.round(F.col("p_retailprice") * 100).cast("bigint"), F.lit(1000))
    return (
        S.table(spark, sf, "part")
        .groupBy((F.pmod("p_partkey", F.lit(3)) + 1).cast("int").alias("horizon"), F.col("p_brand").alias("feature"))
        .agg(F.round(F.sum(cents) / F.count(F.lit(1)) / 1000, 6).alias("importance"))
    )


@query(
    "rank_stability",
    f"""WITH {PARTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY importance DESC, feature) AS rank FROM imp),
    f AS (SELECT DISTINCT feature FROM imp), hs AS (SELECT DISTINCT horizon FROM imp),
    g AS (SELECT f.feature, hs.horizon, coalesce(rank, 99) AS rank, coalesce(importance, 0) AS score FROM f, hs
      LEFT JOIN ranked ON ranked.feature = f.feature AND ranked.horizon = hs.horizon),
    s AS (SELECT feature, avg(score) AS ms, avg(rank) AS mr, stddev_pop(rank) AS sr,
      CAST(max(rank) FILTER (horizon = 1) AS INTEGER) AS rank_h1, CAST(max(rank) FILTER (horizon = 2) AS INTEGER) AS rank_h2,
      CAST(max(rank) FILTER (horizon = 3) AS INTEGER) AS rank_h3 FROM g GROUP BY 1)
    SELECT feature, round(ms, 5) AS mean_importance_score, round(mr, 1) AS mean_rank, round(sr, 2) AS rank_std,
      rank_h1, rank_h2, rank_h3, CASE WHEN mr <= 5 AND sr <= 2 THEN 'Consistently Important'
        WHEN mr <= 10 THEN 'Moderately Stable' WHEN sr > 3 THEN 'Horizon-Dependent' ELSE 'Low Contribution' END
      AS stability_category FROM s""",
)
def stability_query(spark, sf):
    return feature_stability(importance_by_horizon(spark, sf))


@query(
    "top_features",
    f"""WITH {PARTS} SELECT feature, importance FROM imp WHERE horizon = 1 ORDER BY importance DESC, feature LIMIT 10""",
)
def top_features_query(spark, sf):
    rows = importance_by_horizon(spark, sf).where(F.col("horizon") == 1)
    return top_features(rows.select("feature", "importance"))


@query(
    "ensemble_spread",
    """WITH m AS (SELECT o_orderkey, ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE AS a,
      ((o_orderkey * 53) % 997) / 997.0::DOUBLE AS b, ((o_orderkey * 71) % 991) / 991.0::DOUBLE AS c FROM orders),
    s AS (SELECT *, (a + b + c) / 3 AS mu, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2)
      + pow(c - (a + b + c) / 3, 2)) / 3) AS sd FROM m),
    e AS (SELECT *, least(greatest(0, least(1, mu - 1.645 * sd)), a, b, c) AS lo,
      greatest(greatest(0, least(1, mu + 1.645 * sd)), a, b, c) AS hi FROM s)
    SELECT o_orderkey, round(mu, 6) AS risk_probability, round(lo, 6) AS lower_uncertainty_bound,
      round(hi, 6) AS upper_uncertainty_bound, round(hi - lo, 6) AS uncertainty_spread,
      round(sd, 6) AS model_agreement_std, round(a * 0.2 + b * 0.4 + c * 0.4, 6) AS blended FROM e""",
)
def spread_query(spark, sf):
    k = F.col("o_orderkey")
    probs = [
        (F.pmod(k * m, F.lit(n)) / float(n)).alias(a)
        for m, n, a in ((37, 1000, "a"), (53, 997, "b"), (71, 991, "c"))
    ]
    models = S.table(spark, sf, "orders").select("o_orderkey", *probs)
    cols = [F.col(c) for c in ("a", "b", "c")]
    spread = ensemble_spread(*cols)
    return r6(
        models.select("o_orderkey", *[e.alias(n) for n, e in spread.items()], blend(*cols).alias("blended"))
    )


REGISTRY = f"""
reg AS (
  SELECT CAST(c_nationkey % 3 + 1 AS INTEGER) AS horizon, c_mktsegment AS model,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS position,
    round(2 * tp / (2 * tp + fp + fn), 2) AS f1_score, round(tp / (tp + fn), 2) AS recall
  FROM (SELECT c_nationkey % 3 AS c_nationkey, c_mktsegment, {CONFUSION.format(t="0.15")} FROM scored JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
)"""


def registry(spark, sf):
    """Customer segments read as candidate models per horizon."""
    c = S.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = S.scored_orders(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey"))
    keyed = joined.select(
        (F.pmod("c_nationkey", F.lit(3)) + 1).cast("int").alias("horizon"), F.col("c_mktsegment").alias("model"), "y", "p"
    )
    r = M.rates()
    order = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    place = F.coalesce(*[F.when(F.col("model") == m, i) for i, m in enumerate(order)], F.lit(4))
    return M.confusion(keyed, ["horizon", "model"], 0.15).select(
        "horizon", "model", place.alias("position"),
        F.round(r["f1_score"], 2).alias("f1_score"), F.round(r["recall"], 2).alias("recall"),
    )


@query(
    "select_model",
    f"""WITH {O.SCORED}, {REGISTRY}, top AS (SELECT horizon, max(f1_score) AS f FROM reg GROUP BY 1),
    tied AS (SELECT reg.* FROM reg JOIN top ON reg.horizon = top.horizon AND reg.f1_score = top.f),
    q AS (SELECT *, recall >= 0.8 AS good FROM tied)
    SELECT horizon, model, f1_score, recall FROM (SELECT *, row_number() OVER (PARTITION BY horizon
      ORDER BY good DESC, CASE WHEN good THEN -position ELSE position END) AS rn FROM q) WHERE rn = 1""",
)
def select_model_query(spark, sf):
    return select_model(registry(spark, sf))


@query(
    "registry_best",
    f"""WITH {O.SCORED}, {REGISTRY} SELECT model AS model_name, f1_score, recall FROM reg WHERE horizon = 1
    ORDER BY f1_score DESC, model LIMIT 1""",
)
def registry_best_query(spark, sf):
    rows = registry(spark, sf).select(
        F.col("horizon").alias("forecast_horizon"), F.lit("fold2").alias("fold_name"),
        F.lit("all_features").alias("feature_set"), F.col("model").alias("model_name"), "f1_score", "recall",
    )
    best = best_registry_row(registry_slice(rows, 1, "fold2"))
    return best.select("model_name", "f1_score", "recall")


def _registry_sql(model: str, p: str) -> str:
    return f"SELECT h, fold_name, '{model}' AS model_name, train_samples, label AS y, {p} AS p FROM ev"


REGISTRY = f"""{O.LONG}, {FOLDS},
lines AS (SELECT horizon_months AS h, fold_name, role, county_name, month, label, previous_ipc_phase FROM roles),
g AS (SELECT h, fold_name, avg(label) AS rate, count(*) AS train_samples FROM lines WHERE role = 'train' GROUP BY 1, 2),
e AS (SELECT h, fold_name, county_name, avg(label) AS rate FROM lines WHERE role = 'train' GROUP BY 1, 2, 3),
m AS (SELECT h, fold_name, month, avg(label) AS rate FROM lines WHERE role = 'train' GROUP BY 1, 2, 3),
em AS (SELECT h, fold_name, county_name, month, avg(label) AS rate FROM lines WHERE role = 'train' GROUP BY 1, 2, 3, 4),
ev AS (SELECT l.*, g.rate AS g, e.rate AS e, m.rate AS m, em.rate AS em, train_samples FROM lines l
  JOIN g USING (h, fold_name) LEFT JOIN e USING (h, fold_name, county_name) LEFT JOIN m USING (h, fold_name, month)
  LEFT JOIN em USING (h, fold_name, county_name, month) WHERE role = 'eval'),
predicted AS ({_registry_sql("persistence", "CASE WHEN previous_ipc_phase >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")}
  UNION ALL {_registry_sql("historical_frequency", "greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(e, g)))")}
  UNION ALL {_registry_sql("seasonal_baseline", "greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(em, m, g)))")}),
counts AS (SELECT h, fold_name, model_name, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
  FROM predicted GROUP BY ALL),
c AS (SELECT h, fold_name, model_name, any_value(train_samples) AS train_samples, {CONFUSION.format(t="0.5")}
  FROM predicted GROUP BY 1, 2, 3)"""


@query(
    "registry_append",
    f"""WITH {REGISTRY} SELECT 'exp_' || c.h || 'm_' || c.fold_name || '_' || c.model_name AS experiment_id,
      CAST(c.h AS INTEGER) AS forecast_horizon, c.fold_name, c.model_name, 'all_features' AS feature_set,
      {len(V.LONG_FEATURES)}::BIGINT AS num_features, train_samples, n AS test_samples,
      {RATES.replace(", 6)", ", 9)")}, round(coalesce(roc_auc, 0.5), 9) AS roc_auc,
      round(coalesce(pr_auc, 0), 9) AS pr_auc, round(brier, 9) AS brier_score, '2001-01-02' AS timestamp
    FROM c JOIN {areas("h, fold_name, model_name", "counts")} a
      ON a.h = c.h AND a.fold_name = c.fold_name AND a.model_name = c.model_name""",
)
def registry_append_query(spark, sf):
    """The experiment store after a first run of one horizon and a second run of all."""
    long = settle(S.long_table(spark, sf, True))
    store = X.ExperimentStore(spark, f"{shared_folder(spark)}/experiments-{uuid.uuid4().hex}")
    for at, horizons in (("2001-01-01", (2,)), ("2001-01-02", (1, 2, 3))):
        predictions = X.model_predictions(long, S.FOLDS, X.BASELINES, horizons=horizons)
        store.add(predictions, X.registry_rows(predictions, 9), at)
    return store.registry().withColumn("timestamp", F.col("timestamp").cast("string"))


@query(
    "stored_entity_performance",
    f"""WITH {REGISTRY}, one AS (SELECT roles.county_name, label AS y,
      CASE WHEN previous_ipc_phase >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM roles
      WHERE role = 'eval' AND fold_name = 'test_2000' AND horizon_months = 1),
    k AS (SELECT county_name, {CONFUSION.format(t="0.5")}, avg(p) AS mean_p, sum(y)::BIGINT AS events FROM one GROUP BY 1)
    SELECT county_name, n AS test_observations, events AS positive_events, {RATES.replace(", 6)", ", 9)")},
      round(brier, 9) AS brier_score, round(mean_p, 9) AS mean_predicted_probability FROM k""",
)
def stored_performance_query(spark, sf):
    """Performance by entity from the stored predictions of one experiment."""
    long = S.long_table(spark, sf, True)
    folder = f"{shared_folder(spark)}/experiments-{uuid.uuid4().hex}"
    store = X.run_experiments(long, folder, "2001-01-02", S.FOLDS, models=("persistence",), horizons=(1,))
    return M.entity_performance(store.predictions("exp_1m_test_2000_persistence"), decimals=9)


RULE = ["previous_ipc_phase", "consecutive_dry_months"]
SHUFFLES, SHUFFLE_SEED = 3, 7


@query(
    "permutation_rule",
    f"""WITH {O.PANEL}, base AS (SELECT county_name || '-' || year || '-' || month AS id, target_phase3plus AS y,
      CAST(previous_ipc_phase AS DOUBLE) AS a, CAST(consecutive_dry_months AS DOUBLE) AS b FROM panel
      WHERE previous_ipc_phase IS NOT NULL AND target_phase3plus IS NOT NULL),
    shuffled AS (SELECT r, y, a, b, coalesce(lead(a) OVER w, first_value(a) OVER w) AS oa,
      coalesce(lead(b) OVER w, first_value(b) OVER w) AS ob FROM base, range(1, {SHUFFLES + 1}) AS t(r)
      WINDOW w AS (PARTITION BY r ORDER BY md5('{SHUFFLE_SEED}-' || r || '-' || id))),
    variants AS (SELECT '{RULE[0]}' AS feature, r, y, (oa * 10 + b) / 100 AS p FROM shuffled
      UNION ALL SELECT '{RULE[1]}', r, y, (a * 10 + ob) / 100 FROM shuffled
      UNION ALL SELECT 'none', 0, y, (a * 10 + b) / 100 FROM base),
    counts AS (SELECT feature, r, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM variants GROUP BY ALL),
    lost AS (SELECT feature, (SELECT roc_auc FROM {areas("feature, r", "counts")} WHERE feature = 'none') - roc_auc AS d
      FROM {areas("feature, r", "counts")} WHERE feature <> 'none')
    SELECT feature, round(avg(d), 9) AS permutation_importance_mean, round(stddev_pop(d), 9) AS permutation_importance_std
    FROM lost GROUP BY 1""",
)
def permutation_rule_query(spark, sf):
    """Permutation importance under a rule score, with every shuffle stated."""
    rows = S.panel(spark, sf).where("previous_ipc_phase IS NOT NULL AND target_phase3plus IS NOT NULL")
    part = vector_to_array("features")

    def score(df):
        return df.withColumn("p", (part[0] * 10 + part[1]) / 100)

    return permutation_importance(
        score, rows, RULE, ["county_name", "year", "month"], repeats=SHUFFLES, seed=SHUFFLE_SEED, decimals=9
    )

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.operators import baselines as B
from harbinger.operators import metrics as M
from harbinger.operators.bootstrap import METRICS, block_bootstrap, block_multiplicity
from harbinger.operators.importance import feature_stability, successors
from harbinger.operators.ranks import numbered


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y int, p double")


def areas(y, p):
    """Pair counting and step-wise precision, straight from the definitions."""
    y, p = np.array(y), np.array(p)
    pos, neg = p[y == 1], p[y == 0]
    won = sum((a > neg).sum() + 0.5 * (a == neg).sum() for a in pos)
    ap, seen = 0.0, 0
    for s in sorted(set(p), reverse=True):
        hits = ((p >= s) & (y == 1)).sum()
        ap += (hits - seen) / len(pos) * hits / (p >= s).sum()
        seen = hits
    return won / (len(pos) * len(neg)), ap


def shapes():
    r = random.Random(11)
    yield "ties", [(r.random() < 0.3, round(r.random(), 1)) for _ in range(400)]
    yield "third at one score", [(r.random() < 0.5, 0.5 if i % 3 == 0 else r.random()) for i in range(600)]
    yield "clustered", [(r.random() < 0.2, 0.4 + r.random() * 1e-9 if i % 2 else r.random()) for i in range(600)]
    yield "all distinct", [(r.random() < 0.6, r.random()) for _ in range(900)]
    yield "one score", [(i % 2, 0.3) for i in range(50)]


@pytest.mark.parametrize("name,pairs", list(shapes()), ids=[n for n, _ in shapes()])
@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_areas_are_exact(spark, name, pairs, buckets):
    got = M.ranking_areas(M.score_counts(scored(spark, pairs)), buckets=buckets).first()
    want = areas([y for y, _ in pairs], [p for _, p in pairs])
    assert got["roc_auc"] == pytest.approx(want[0], abs=1e-9) and got["pr_auc"] == pytest.approx(want[1], abs=1e-9)


def test_one_class_has_no_areas(spark):
    got = M.full_metrics(scored(spark, [(0, 0.2), (0, 0.9)])).first()
    assert got["roc_auc"] is None and got["pr_auc"] is None and got["recall"] == 0.0 and got["false_positives"] == 1


def test_perfect_scores(spark):
    got = M.full_metrics(scored(spark, [(0, 0.1), (0, 0.4), (1, 0.7), (1, 0.9)])).first()
    assert (got["precision"], got["recall"], got["f1_score"], got["false_negative_rate"]) == (1.0, 1.0, 1.0, 0.0)
    assert got["brier_score"] < 0.10 and got["confusion_matrix"] == [[2, 0], [0, 2]] and got["roc_auc"] == 1.0


def test_confusion_and_sentence(spark):
    df = scored(spark, [(1, 0.9), (1, 0.8), (1, 0.2), (0, 0.1), (0, 0.2), (0, 0.3)])
    got = M.recall_sentence(M.full_metrics(df)).first()
    assert got["recall"] == 0.6667 and got["precision"] == 1.0 and got["false_negative_rate"] == 0.3333
    assert "Out of 3 true Crisis periods, the model correctly flagged 2 and missed 1" in got["commentary"]


def test_groups_equal_single_runs(spark):
    r = random.Random(5)
    data = [(g, int(r.random() < 0.4), round(r.random(), 2)) for g in "abc" for _ in range(200)]
    df = spark.createDataFrame(data, "g string, y int, p double")
    together = {r["g"]: r.asDict() for r in M.full_metrics(df, ["g"]).collect()}
    for g in "abc":
        alone = M.full_metrics(df.where(F.col("g") == g)).first().asDict()
        assert {k: together[g][k] for k in alone} == alone


def test_grid_and_best_threshold(spark):
    df = scored(spark, [(int(i >= 4), (i + 1) / 10) for i in range(8)])
    grid = M.threshold_grid(df).orderBy("threshold").collect()
    assert len(grid) == 17 and grid[0]["recall"] == 1.0 and grid[0]["false_negatives"] == 0
    best = M.best_threshold(M.threshold_grid(df)).first()
    assert best["recall"] >= 0.75 and best["threshold"] == 0.45  # the lowest of the tied cut-offs
    hopeless = scored(spark, [(1, 0.05), (1, 0.05), (1, 0.2), (0, 0.9)])
    assert M.best_threshold(M.threshold_grid(hopeless)).first()["threshold"] == 0.1


def test_grid_matches_direct_counts(spark):
    r = random.Random(2)
    pairs = [(r.random() < 0.3, round(r.random(), 2)) for _ in range(500)]
    for row, t in zip(M.threshold_grid(scored(spark, pairs)).orderBy("threshold").collect(), M.default_thresholds(), strict=True):
        tp = sum(1 for y, p in pairs if y and p >= t)
        fp = sum(1 for y, p in pairs if not y and p >= t)
        assert row["false_negatives"] == sum(1 for y, _ in pairs if y) - tp
        assert row["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0, abs=1e-4)


def test_reliability_bins_are_right_closed(spark):
    got = {r["bin"]: r["n"] for r in M.reliability_curve(scored(spark, [(0, 0.0), (1, 0.2), (0, 0.21), (1, 1.0)])).collect()}
    assert got == {0: 2, 1: 1, 4: 1}


def test_histogram_folds_one_into_the_last_bin(spark):
    got = {(r["label"], r["bin"]): r["n"] for r in M.probability_histogram(scored(spark, [(1, 1.0), (1, 0.95), (0, 0.0)])).collect()}
    assert got == {(1, 9): 2, (0, 0): 1}


def test_errors_and_entities(spark):
    df = spark.createDataFrame(
        [("A", 1, 0.9), ("A", 1, 0.1), ("A", 0, 0.7), ("B", 0, 0.2)], "county_name string, y int, p double")
    assert M.error_rows(df, True).count() == 1 and M.error_rows(df, False).count() == 1
    got = {r["county_name"]: r for r in M.entity_performance(df).collect()}
    assert got["A"]["recall"] == 0.5 and got["A"]["test_observations"] == 3 and got["B"]["recall"] == 0.0
    assert got["B"]["false_negative_rate"] == 1.0
    dist = {r["y"]: r["share"] for r in M.label_distribution(df, "y").collect()}
    assert dist == {0: 0.5, 1: 0.5}


def bootstrap_frame(spark):
    y = [1, 0, 1, 0, 0, 1, 1, 0, 0, 0, 1, 0, 1, 0, 0]
    p = [0.8, 0.2, 0.7, 0.1, 0.3, 0.9, 0.85, 0.15, 0.2, 0.1, 0.75, 0.3, 0.65, 0.2, 0.15]
    days = ["2024-01-01"] * 5 + ["2024-02-01"] * 5 + ["2024-03-01"] * 5
    return spark.createDataFrame(list(zip(days, y, p, strict=True)), "day string, y int, p double")


def test_bootstrap_bounds_hold(spark):
    noisy = bootstrap_frame(spark).withColumn("p", F.when(F.col("p") == 0.7, 0.3).otherwise(F.col("p")))
    got = {r["metric"]: r for r in block_bootstrap(noisy, "day", n=60).collect()}
    assert sorted(got) == sorted(METRICS)
    for r in got.values():
        assert r["ci_lower"] <= r["estimate"] <= r["ci_upper"] and r["std"] >= 0
    assert got["recall"]["estimate"] == pytest.approx(5 / 6, abs=1e-4) and got["recall"]["std"] > 0


def test_bootstrap_matches_a_plain_resample(spark):
    """Rebuild every replicate from the drawn blocks and compare the interval."""
    df = bootstrap_frame(spark).withColumn("p", F.when(F.col("p").isin(0.7, 0.9), 0.2).otherwise(F.col("p")))
    times = block_multiplicity(df.select("day").distinct(), "day", 40, 7).where("replicate > 0").collect()
    data = {}
    for r in df.collect():
        data.setdefault(r["day"], []).append((r["y"], r["p"]))
    values = []
    for rep in range(1, 41):
        pairs = [x for t in times if t["replicate"] == rep for x in data[t["day"]] * t["times"]]
        assert len(pairs) == 15
        values.append(areas([y for y, _ in pairs], [p for _, p in pairs])[1])
    got = {r["metric"]: r for r in block_bootstrap(df, "day", n=40, seed=7, decimals=8).collect()}["pr_auc"]
    assert got["ci_lower"] == pytest.approx(np.percentile(values, 2.5), abs=1e-6)
    assert got["ci_upper"] == pytest.approx(np.percentile(values, 97.5), abs=1e-6)
    assert got["std"] == pytest.approx(np.std(values), abs=1e-6)


def test_bootstrap_with_one_block_is_the_estimate(spark):
    one = bootstrap_frame(spark).withColumn("day", F.lit("d"))
    for r in block_bootstrap(one, "day", n=20).collect():
        assert r["ci_lower"] == r["estimate"] == r["ci_upper"] and r["std"] == 0


def test_persistence(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 2.5)], "previous_ipc_phase double")
    assert [r["p"] for r in B.persistence(df).collect()] == [0.0, 0.0, 1.0, 1.0, 0.0]
    assert B.persistence(df.withColumnRenamed("previous_ipc_phase", "z")).first()["p"] == 0.5


def priors(spark):
    data = [("Turkana", 1, 1), ("Turkana", 2, 1), ("Marsabit", 1, 1), ("Marsabit", 2, 0), ("Baringo", 1, 0), ("Baringo", 2, 0)]
    train = spark.createDataFrame(data, "county_name string, month int, target_phase3plus int")
    ask = spark.createDataFrame(
        [("Turkana", 1), ("Marsabit", 1), ("Baringo", 1), ("Oz", 1), ("Oz", 9)], "county_name string, month int")
    return train, ask


def test_entity_rates(spark):
    train, ask = priors(spark)
    got = {(r["county_name"], r["month"]): r["p"] for r in B.historical_frequency(train, ask).collect()}
    assert got["Turkana", 1] == 0.999 and got["Marsabit", 1] == 0.5 and got["Baringo", 1] == 0.001 and got["Oz", 1] == 0.5
    assert {r["p"] for r in B.historical_frequency(train, ask, use_entity=False).collect()} == {0.5}


def test_seasonal_rates_fall_back(spark):
    train, ask = priors(spark)
    got = {(r["county_name"], r["month"]): round(r["p"], 4) for r in B.seasonal_rate(train, ask).collect()}
    assert got["Marsabit", 1] == 0.999 and got["Oz", 1] == 0.6667 and got["Oz", 9] == 0.5
    month_only = {r["p"] for r in B.seasonal_rate(train, ask.where("month = 1"), use_entity=False).collect()}
    assert [round(p, 4) for p in month_only] == [0.6667]
    levels = {r["level"] for r in B.event_rates(train).collect()}
    assert levels == {"entity_month", "entity", "month", "all"}


def test_stability(spark):
    data = [(h, f, s) for h in (1, 2, 3) for f, s in (("previous_ipc_phase", 0.25), ("rain", 0.05))]
    got = feature_stability(spark.createDataFrame(data[:-1], "horizon int, feature string, importance double")).collect()
    by = {r["feature"]: r for r in got}
    assert by["previous_ipc_phase"]["mean_rank"] == 1.0
    assert by["previous_ipc_phase"]["stability_category"] == "Consistently Important"
    assert by["rain"]["rank_h3"] == 99 and by["rain"]["stability_category"] == "Horizon-Dependent"


def test_a_null_group_is_kept(spark):
    data = [(None, 1, 0.9), (None, 0, 0.1), ("g", 1, 0.2), ("g", 0, 0.6)]
    df = spark.createDataFrame(data, "g string, y int, p double")
    got = {r["g"]: r["roc_auc"] for r in M.full_metrics(df, ["g"]).collect()}
    assert got == {None: 1.0, "g": 0.0}


def test_missing_labels_and_scores_are_left_out_everywhere(spark):
    pairs = [(1, 0.9), (0, 0.2), (None, 0.3), (1, None), (1, 0.1), (0, float("nan"))]
    frame = spark.createDataFrame(pairs, "y int, p double").withColumn("county_name", F.lit("A"))
    plain, full = M.confusion(frame).first(), M.full_metrics(frame).first()
    assert (plain["n"], plain["tp"], plain["fn"], plain["tn"], plain["fp"]) == (3, 1, 1, 1, 0)
    assert full["confusion_matrix"] == [[1, 0], [1, 1]] and full["n"] == 3
    assert M.entity_performance(frame).first()["test_observations"] == 3
    assert M.reliability_curve(frame).agg(F.sum("n")).first()[0] == 3
    grid = {r["threshold"]: r["false_negatives"] for r in M.threshold_grid(frame).collect()}
    assert grid[0.5] == 1
    assert M.probability_histogram(frame).agg(F.sum("n")).first()[0] == 3


def test_numbers_follow_the_order(spark):
    draw = random.Random(4)
    values = draw.sample(range(10**6), 5000)
    frame = spark.createDataFrame([(v,) for v in values], "v long").repartition(13)
    got = {r.v: r["_no"] for r in numbered(frame, ["v"]).collect()}
    assert [got[v] for v in sorted(values)] == list(range(1, 5001))
    assert numbered(frame.limit(0), ["v"]).collect() == []


def test_a_million_blocks(spark):
    blocks = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("block"))
    times = block_multiplicity(blocks, "block", 1, 3)
    got = times.groupBy("replicate").agg(F.sum("times").alias("n"), F.count("*").alias("k")).collect()
    by = {r.replicate: (r.n, r.k) for r in got}
    assert by[0] == (1_000_000, 1_000_000) and by[1][0] == 1_000_000
    assert 0.62e6 < by[1][1] < 0.645e6  # about 1 - 1/e of the blocks are drawn


def test_shuffles_do_not_depend_on_the_buckets(spark):
    rows = [(i, [float(i)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, _own array<double>").repartition(5)

    def pairs(buckets):
        out = successors(frame, ["id"], 2, 9, buckets).collect()
        return {(r["_repeat"], r["id"]): int(r["_other"][0]) for r in out}

    one = pairs(1)
    assert one == pairs(8) == pairs(64) == pairs(1000)
    for repeat in (1, 2):  # one cycle through all rows
        seen, at = set(), 0
        while at not in seen:
            seen.add(at)
            at = one[repeat, at]
        assert len(seen) == 300
    assert one[1, 0] != one[2, 0] or one[1, 1] != one[2, 1]

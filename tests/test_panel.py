import datetime as dt
import math

import pytest
from frame_rows import rows
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.operators import horizon as H
from harbinger.operators import keys as K
from harbinger.operators import panel as P
from harbinger.operators import quality as Q
from harbinger.operators import splits as S

ANOMALIES = [-10.0, -25.0, -5.0, 15.0, -12.0, -8.0]


def feeds(spark, months=6, entity="Turkana", gap=None):
    data = []
    for i in range(months):
        if i == gap:
            continue
        data.append((entity, 2019 + i // 12, i % 12 + 1, 10.0 * (i + 1), ANOMALIES[i % 6], 0.1 * i, -1.0 * i, 100.0 + 10 * i,
                     1 + i % 4, int(1 + i % 4 >= 3)))
    return spark.createDataFrame(
        data,
        "county_name string, year int, month int, rainfall_mm double, rainfall_anomaly double, ndvi_mean double, "
        "ndvi_anomaly double, price double, ipc_phase int, target_phase3plus int",
    )


def panel(df, **kw):
    return P.build_panel(df, df, df, df, **kw).orderBy("county_name", "year", "month").collect()


def test_streak(spark):
    assert [r["consecutive_dry_months"] for r in panel(feeds(spark))] == [0, 1, 2, 3, 0, 1]


def test_missing_anomaly_breaks_the_streak(spark):
    df = feeds(spark).withColumn("rainfall_anomaly", F.when(F.col("month") != 2, F.col("rainfall_anomaly")))
    assert [r["consecutive_dry_months"] for r in panel(df)] == [0, 1, 0, 1, 0, 1]


def test_columns_lags_and_changes(spark):
    got = panel(feeds(spark))
    assert list(got[0].asDict()) == V.PANEL_COLUMNS and len(got) == 6
    assert got[0]["previous_ipc_phase"] is None and got[0]["rainfall_anomaly_1m"] is None
    assert got[4]["rainfall_anomaly_3m"] == -25.0 and got[4]["previous_ipc_phase"] == 4
    assert [round(r["rainfall_rolling_3m"], 6) for r in got[:3]] == [10.0, 15.0, 20.0]
    assert math.isclose(got[3]["maize_price_change_3m"], 30.0) and math.isclose(got[1]["maize_price_change_1m"], 10.0)
    assert math.isclose(got[3]["ndvi_trend_3m"], 0.3)
    mean = 125.0
    std = math.sqrt(sum((100.0 + 10 * i - mean) ** 2 for i in range(6)) / 5)
    assert math.isclose(got[0]["maize_price_zscore"], (100 - mean) / std)


def test_constant_price_and_single_row(spark):
    flat = feeds(spark).withColumn("price", F.lit(5.0))
    assert {r["maize_price_zscore"] for r in panel(flat)} == {0.0}
    assert panel(feeds(spark, 1))[0]["maize_price_zscore"] is None


def test_zero_price_gives_null_change(spark):
    df = feeds(spark).withColumn("price", F.when(F.col("month") == 2, 0.0).otherwise(F.col("price")))
    assert panel(df)[2]["maize_price_change_1m"] is None


def test_positional_and_calendar_lags_differ_on_a_gap(spark):
    df = feeds(spark, gap=2)
    assert panel(df)[2]["rainfall_anomaly_1m"] == -25.0
    assert panel(df, calendar=True)[2]["rainfall_anomaly_1m"] is None


def test_expanding_zscore_does_not_look_ahead(spark):
    a = panel(feeds(spark, 4), expanding_zscore=True)
    b = panel(feeds(spark, 6), expanding_zscore=True)
    assert [r["maize_price_zscore"] for r in a] == [r["maize_price_zscore"] for r in b][:4]


def test_entities_do_not_leak_into_each_other(spark):
    both = feeds(spark).unionByName(feeds(spark, entity="Marsabit"))
    got = panel(both)
    assert len(got) == 12 and got[6]["previous_ipc_phase"] is None
    assert [r["consecutive_dry_months"] for r in got[6:]] == [0, 1, 2, 3, 0, 1]


def test_long_table(spark, dim):
    p = P.build_panel(*[feeds(spark, 14)] * 4)
    long = H.build_long_table(p, dim)
    assert long.count() == 42
    r = {(x["observation_period"], x["horizon_months"]): x for x in long.collect()}
    assert r["2019-12", 2]["target_date"] == dt.date(2020, 2, 1) and r["2019-12", 2]["target_period"] == "2020-02"
    assert r["2020-02", 1]["target_phase3plus"] is None
    assert r["2019-01", 2]["target_phase3plus"] == 1
    assert r["2019-04", 1]["rainfall_anomaly_lag1"] == -25.0  # two months behind the feed
    assert r["2019-03", 1]["is_long_rains"] == 1 and r["2019-11", 1]["is_short_rains"] == 1
    assert r["2019-03", 1]["quarter"] == 1 and r["2019-03", 1]["is_arid"] == 1
    bad = Q.leakage_check(long).collect()
    assert all(x["not_after"] == 0 and x["wrong_offset"] == 0 and x["n"] == 14 for x in bad)


def test_unknown_entity_counts_as_arid(spark, dim):
    p = P.build_panel(*[feeds(spark, 6, "Oz")] * 4)
    assert {r["is_arid"] for r in H.seasonal_context(p, dim).collect()} == {1}
    p = P.build_panel(*[feeds(spark, 6, "Nairobi")] * 4)
    assert {r["is_arid"] for r in H.seasonal_context(p, dim).collect()} == {0}


def test_interval_expansion(spark):
    data = [
        ("A", dt.date(2019, 1, 1), dt.date(2019, 6, 30), 2, 1),
        ("A", dt.date(2019, 6, 1), dt.date(2019, 7, 31), 4, 2),   # later row wins June
        ("B", dt.date(2019, 1, 15), dt.date(2019, 3, 1), 3, 3),   # starts after the month start
        ("B", dt.date(2019, 5, 2), dt.date(2019, 5, 20), 3, 4),   # holds no month start
    ]
    df = spark.createDataFrame(data, "county_name string, period_start date, period_end date, ipc_phase int, seq int")
    got = rows(K.expand_to_months(df, sequence=["seq"]).select("county_name", "year", "month", "ipc_phase"))
    assert got == [("A", 2019, m, 2) for m in range(1, 6)] + [("A", 2019, 6, 4), ("A", 2019, 7, 4)] + [
        ("B", 2019, 2, 3), ("B", 2019, 3, 3)]


def test_keep_last_with_a_dominant_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    got = {r["k"]: r["v"] for r in K.keep_last(df, ["k"], ["seq"]).collect()}
    want = {}
    for i in range(3000):
        want["hot" if i % 3 == 0 else f"k{i % 500}"] = 2 * i
    assert got == want


def test_fills(spark):
    data = [("A", 2019, m, v) for m, v in enumerate([None, 2.0, None, 4.0, None], 1)] + [("B", 2019, 1, None)]
    df = spark.createDataFrame(data, "county_name string, year int, month int, x double")
    def order(out):
        return [r["x"] for r in out.orderBy("county_name", "month").collect()]

    assert order(K.fill_back_then_forward(df, ["x"])) == [2.0, 2.0, 4.0, 4.0, 4.0, 0.0]
    assert order(K.fill_forward(df, ["x"])) == [0.0, 2.0, 2.0, 4.0, 4.0, 0.0]
    assert order(K.fill_zero(df, ["x"])) == [0.0, 2.0, 0.0, 4.0, 0.0, 0.0]


def test_year_split(spark):
    p = P.build_panel(*[feeds(spark, 72)] * 4)
    got = {r["split"]: r["count"] for r in S.split_by_year(p).groupBy("split").count().collect()}
    assert got == {"train": 45, "val": 12, "test": 12}


def test_rolling_origin_is_chronological_and_expanding(spark, dim):
    long = H.build_long_table(P.build_panel(*[feeds(spark, 72)] * 4), dim)
    folds = S.rolling_origin(long, horizon=1)
    spans = {
        (r["fold_name"], r["role"]): (r["lo"], r["hi"], r["n"])
        for r in folds.groupBy("fold_name", "role").agg(
            F.min("observation_date").alias("lo"), F.max("observation_date").alias("hi"), F.count("*").alias("n")).collect()
    }
    assert spans["val_2023", "train"][1] < spans["val_2023", "eval"][0]
    assert spans["test_2024", "train"][2] > spans["val_2023", "train"][2]
    assert spans["test_2024", "eval"] == (dt.date(2024, 1, 1), dt.date(2024, 11, 1), 11)
    purged = S.rolling_origin(long, horizon=3, purge=True).where("role = 'train'")
    assert purged.where("fold_name = 'val_2023' and target_date >= '2023-01-01'").count() == 0


def test_panel_rules(spark, dim):
    good = P.build_panel(*[feeds(spark, 12)] * 4)
    assert all(r["n_bad"] == 0 for r in Q.validate_panel(good, dim).collect())
    bad = good.unionByName(good.where("month = 3")).withColumn(
        "county_name", F.when(F.col("month") == 5, "Oz").otherwise(F.col("county_name"))
    ).withColumn("month", F.when(F.col("month") == 7, 13).otherwise(F.col("month"))).withColumn(
        "target_phase3plus", F.when(F.col("month") != 9, F.col("target_phase3plus")))
    got = {r["rule"]: r["n_bad"] for r in Q.validate_panel(bad, dim).collect()}
    assert got["duplicate_key"] == 2 and got["unknown_name"] == 1 and got["invalid_month"] == 1
    assert got["missing_target"] == 1 and got["invalid_target"] == 1 and got["invalid_phase"] == 0
    with pytest.raises(ValueError, match="duplicate_key=2"):
        Q.require_valid_panel(bad, dim)


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "x", -25.0), (2, "3", 5.0)], "a int, b string, mm double")
    with pytest.raises(Q.SchemaDrift, match="missing: nope"):
        Q.require_schema(df, "feed", ["a", "nope"])
    with pytest.raises(Q.SchemaDrift, match=r"below_minimum: mm \(1\)"):
        Q.require_schema(df, "feed", ["a"], bounds={"mm": (0.0, 500.0)})
    assert rows(Q.schema_drift(df, ["a"], types={"b": "int", "a": "double"})) == [("type", "b", 1)]
    assert rows(Q.schema_drift(df.where("a > 9"), ["a"])) == [("empty", "*", 1)]
    assert Q.require_schema(df, "feed", ["a"], types={"a": "int"}) is df


def test_completeness(spark):
    p = P.build_panel(*[feeds(spark, 12)] * 4)
    r = Q.quality_metrics(p.unionByName(p.where("month = 1"))).first()
    assert (r["total_records"], r["counties_count"], r["duplicate_rows"], r["year_range"]) == (13, 1, 1, "2019 - 2019")
    miss = {r["column"]: (r["missing_pct"], r["category"]) for r in Q.missing_by_column(p).collect()}
    assert miss["rainfall_anomaly_3m"] == (25.0, "Climate") and miss["maize_price_change_1m"] == (8.3, "Market")
    assert miss["target_phase3plus"] == (0.0, "Food Security Target") and miss["year"][1] == "Metadata"


def test_dimension_rules(spark, dim):
    assert all(r["n_bad"] == 0 for r in Q.dimension_check(dim, dim).collect())
    extra = dim.limit(1).withColumn("centroid_lat", F.lit(60.0)).withColumn("asal_category", F.lit("Wet"))
    got = {r["rule"]: r["n_bad"] for r in Q.dimension_check(dim.unionByName(extra), dim).collect()}
    assert got["outside_latitude"] == 1 and got["unknown_category"] == 1 and got["repeated_code"] == 2

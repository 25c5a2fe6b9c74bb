import pytest
from frame_rows import rows
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions import signals as G
from harbinger.operators import keys as K
from harbinger.plans import early_warning as E
from harbinger.plans import risk as R
from harbinger.plans import views as W

SCHEMA = (
    "county_name string, period string, period_dt string, model_risk_prob double, risk_band string, "
    "previous_ipc_phase double, rainfall_anomaly_3m double, ndvi_anomaly_3m double, maize_price_zscore double, "
    "consecutive_dry_months int, rainfall_anomaly_1m double, ndvi_anomaly_1m double"
)


@pytest.fixture(scope="module")
def scored(spark):
    data = [
        ("Turkana", "2024-11", "2024-11-01", 0.80, "High", 3.0, -25.0, -12.0, 1.5, 3, -5.0, 1.0),
        ("Turkana", "2024-12", "2024-12-01", 0.60, "Elevated", 2.0, 25.0, -3.0, 0.2, 0, 5.0, None),
        ("Baringo", "2024-12", "2024-12-01", 0.10, "Low", 1.0, 0.0, 4.0, -1.0, 1, None, 2.0),
        ("Lamu", "2024-10", "2024-10-01", 0.30, "Moderate", None, None, None, None, None, 1.0, 2.0),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_snapshot_and_kpis(spark, scored):
    snap = W.latest_snapshot(scored)
    assert sorted(r["county_name"] for r in snap.collect()) == ["Baringo", "Turkana"]
    k = W.overview_kpis(snap).first()
    assert (k["counties_monitored"], k["elevated_or_high_count"], k["latest_period"]) == (2, 1, "2024-12")
    assert k["average_risk_prob"] == pytest.approx(0.35)
    empty = W.overview_kpis(snap.where("false")).first()
    assert empty["counties_monitored"] == 0 and empty["latest_period"] == "N/A" and empty["average_risk_prob"] == 0.0
    assert W.latest_per_entity(scored).count() == 3


def test_ranking(scored):
    table = W.ranking_table(W.latest_snapshot(scored))
    assert table.columns == [label for _, label in V.RANKING_LABELS]
    assert [r["County"] for r in table.collect()] == ["Turkana", "Baringo"]
    assert "Price Z-Score" not in W.ranking_table(scored.drop("maize_price_zscore")).columns


def test_map_covers_the_dimension(scored, dim):
    got = {r["county_name"]: r for r in W.map_table(W.latest_snapshot(scored), dim).collect()}
    assert len(got) == 47 and sum(r["is_monitored"] for r in got.values()) == 2
    assert got["Lamu"]["risk_band"] == got["Lamu"]["risk_prob_display"] == V.NOT_MONITORED
    t = got["Turkana"]
    assert (t["risk_prob_display"], t["ipc_display"], t["rain_anom_display"], t["price_z_display"]) == ("60.0%", "2", "+25.0%", "+0.20 σ")
    assert got["Lamu"]["ipc_display"] == "N/A"
    assert W.unmapped(scored, dim).count() == 0


def test_slices(scored):
    assert K.between_periods(scored, "Turkana", "2024-12", None).count() == 1
    assert K.between_periods(scored, "All Counties", None, "2024-11").count() == 2
    assert K.between_periods(scored).count() == 4
    assert K.same_entity(scored, "tURKANA").count() == 2
    assert rows(K.distinct_values(scored, "period")) == [("2024-10",), ("2024-11",), ("2024-12",)]
    got = {r["period"]: r["is_latest"] for r in W.explorer(scored, "Turkana", None, None).collect()}
    assert got == {"2024-11": False, "2024-12": True}


def test_indicator_flags(scored):
    got = {r["indicator"]: (r["value"], r["flag"]) for r in W.indicator_rows(scored, "Turkana", "2024-11").collect()}
    assert got["3M Rainfall Anomaly (%)"] == (-25.0, V.COLOUR_ALERT)
    assert got["Consecutive Dry Months"] == (3.0, V.COLOUR_WARN) and len(got) == 5
    assert W.indicator_rows(scored, "Lamu").count() == 0


def test_narrative(scored):
    got = {(r["county_name"], r["period"]): r["narrative"] for r in W.narratives(scored).collect()}
    text = got["Turkana", "2024-11"].split("\n")
    assert text[0] == "**Automated Risk Summary for Turkana (2024-11)**"
    assert text[1] == "- **Model Estimated Risk Probability:** `80.0%` (High Risk)"
    assert text[2:7] == [
        "- **Statistical Risk Correlates:**", "  * Substantial 3-month rainfall deficit (-25.0%)",
        "  * Extended dry spell streak of 3 consecutive months",
        "  * Severe vegetation vegetative stress (-12.0% NDVI anomaly)",
        "  * Marked staple food price pressure (+1.50 σ above historical baseline)"]
    assert text[7] == "" and text[8] == V.NARRATIVE_NOTE
    assert "remain within normal seasonal ranges" in got["Lamu", "2024-10"]
    named = scored.limit(1).select(G.narrative(F.col("county_name"), F.col("period"), F.col("risk_band"), F.col("model_risk_prob"), F.lit("Crisis")))
    assert "prior IPC phase: Crisis" in named.first()[0]


def test_chart_series(scored):
    got = {(r["series"], r["period"]): (r["value"], r["colour"]) for r in W.chart_series(scored, "Turkana").collect()}
    assert got["rainfall_anomaly_1m", "2024-11"] == (-5.0, V.COLOUR_DEFICIT)
    assert got["rainfall_anomaly_1m", "2024-12"] == (5.0, V.COLOUR_SURPLUS)
    assert got["risk_pct", "2024-11"] == (80.0, None) and got["ndvi_anomaly_1m", "2024-12"] == (None, None)


def long_rows(spark):
    base = dict(
        rainfall_anomaly_lag1=-30.0, rainfall_rolling_3m=5.0, ndvi_anomaly_lag1=-15.0, ndvi_trend_3m=-6.0, maize_price_zscore=1.2,
        maize_price_change_3m=20.0, consecutive_dry_months=3, previous_ipc_phase=3.0,
        neighbour_mean_rainfall_anomaly=-25.0, number_of_high_risk_neighbours=2,
    )
    calm = dict(base, rainfall_anomaly_lag1=30.0, ndvi_anomaly_lag1=20.0, ndvi_trend_3m=0.0, maize_price_zscore=0.0,
                maize_price_change_3m=0.0, consecutive_dry_months=0, previous_ipc_phase=1.0,
                neighbour_mean_rainfall_anomaly=0.0, number_of_high_risk_neighbours=0)
    data = []
    for name, facts, probs in (("Turkana", base, (0.2, 0.5, 0.9)), ("Lamu", calm, (0.5, 0.45, 0.3765))):
        for period in ("2024-10", "2024-11"):
            for h, p in enumerate(probs, 1):
                data.append((name, f"{period}-01", period, h, "2025-01", p, 0.6, *facts.values()))
    schema = ("county_name string, observation_date string, observation_period string, horizon_months int, target_period string, "
              "risk_probability double, decision_threshold double, rainfall_anomaly_lag1 double, rainfall_rolling_3m double, "
              "ndvi_anomaly_lag1 double, ndvi_trend_3m double, maize_price_zscore double, maize_price_change_3m double, "
              "consecutive_dry_months int, previous_ipc_phase double, neighbour_mean_rainfall_anomaly double, number_of_high_risk_neighbours int")
    return spark.createDataFrame(data, schema)


def test_signals(spark):
    got = {r["county"]: r["top_risk_signals"] for r in R.scored_records(long_rows(spark)).collect()}
    assert got["Turkana"] == ["Precipitation deficit (-30.0% anomaly)", "Extended dry spell (3 consecutive months)",
                              "Vegetation stress (-15.0% NDVI anomaly)"]
    assert got["Lamu"] == [V.NO_SIGNAL]


def test_attribution(spark):
    got = {r["county_name"]: r for r in R.local_attribution(long_rows(spark), k=9).collect()}
    up = got["Turkana"]["risk_elevating_factors"]
    assert len(up) == 9 and up[7] == "Cluster vulnerability (2 adjacent counties in elevated risk)"
    assert up[8] == "Prior food security stress anchor (IPC Phase 3)" and got["Turkana"]["risk_buffering_factors"] == []
    assert len(got["Lamu"]["risk_buffering_factors"]) == 3 and got["Lamu"]["risk_elevating_factors"] == []
    assert all(len(r["risk_elevating_factors"]) <= 4 for r in R.local_attribution(long_rows(spark)).collect())


def test_matrix_and_forecast(spark):
    table = E.early_warning_matrix(long_rows(spark)).collect()
    assert [r["County"] for r in table] == ["Turkana", "Lamu"]
    t = table[0]
    assert (t["1M Risk (t+1)"], t["3M Risk (t+3)"], t["Trend"], t["Early-Warning Signal"]) == ("20.0%", "90.0%", V.TREND_UP, V.ALERT_ON)
    assert t["Main Signals"] == "Precipitation deficit (-30.0% anomaly); Extended dry spell (3 consecutive months)"
    assert table[1]["Trend"] == V.TREND_DOWN and table[1]["3M Risk (t+3)"] == "37.6%" and table[1]["Early-Warning Signal"] == V.ALERT_OFF
    partial = E.early_warning_matrix(long_rows(spark).where("horizon_months = 2"), "2024-10").collect()
    assert partial[0]["1M Risk (t+1)"] == "N/A" and partial[0]["Trend"] == V.TREND_FLAT
    assert partial[0]["Main Signals"] == V.NO_SIGNAL_MATRIX
    one = E.entity_forecast(long_rows(spark), "Turkana").collect()
    assert len(one) == 3 and {r["trend"] for r in one} == {V.TREND_UP} and {r["observation_date"] for r in one} == {"2024-11"}
    assert E.trajectory(long_rows(spark), "Lamu").count() == 6


def test_latest_and_entity_risk(spark):
    latest = R.latest_risk(long_rows(spark)).collect()
    assert len(latest) == 2 and latest[0]["calibrated_probability"] == 0.3 and latest[0]["risk_band"] == "Moderate"
    assert latest[0]["confidence_interval"] == [0.18, 0.42] and latest[0]["action_trigger"] == V.ACTION_MODERATE
    assert R.latest_risk(long_rows(spark), horizon=None).count() == 6
    one = R.entity_risk(long_rows(spark), "TURKANA").collect()
    assert len(one) == 1 and one[0]["date"] == "2024-11-01"
    with pytest.raises(LookupError, match="Atlantis"):
        R.require_entity(long_rows(spark), "Atlantis")
    assert "Lamu" in [r[0] for r in R.available_entities(long_rows(spark)).collect()]


def test_model_choice(spark):
    def pick(*cands):
        data = [(1, m, i, f, r) for i, (m, f, r) in enumerate(cands)]
        return W.select_model(spark.createDataFrame(data, "horizon int, model string, position int, f1_score double, recall double")).first()["model"]

    assert pick(("a", 0.5, 0.9), ("b", 0.6, 0.1)) == "b"
    assert pick(("a", 0.5, 0.9), ("b", 0.5, 0.8)) == "b"     # a later tie with enough recall replaces
    assert pick(("a", 0.5, 0.2), ("b", 0.5, 0.7)) == "a"     # a later tie without it does not
    assert pick(("a", 0.5, 0.9), ("b", 0.5, 0.7), ("c", 0.4, 1.0)) == "a"

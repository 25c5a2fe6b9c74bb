"""Latest risk, overview, matrix, signals, narrative and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle_tables as O
from checks import standins as S
from checks.catalog import query, r6, rounded
from checks.panel_queries import PANEL_DOUBLES
from harbinger import fixed_values as V
from harbinger.functions.scalars import action_text, proxy_bounds, rainfall_proxy_score, risk_band
from harbinger.functions.signals import top_signals
from harbinger.operators import keys as K
from harbinger.plans import early_warning as E
from harbinger.plans import risk as R
from harbinger.plans import views as W
from harbinger.plans.stored_panel import with_observation
from harbinger.sources.shared import settle


def _action(p: str, base: str) -> str:
    return f"""CASE WHEN {p} >= 0.75 THEN '{V.ACTION_HIGH}' WHEN {p} >= 0.50 THEN '{V.ACTION_ELEVATED}'
      WHEN {p} >= 0.25 THEN '{V.ACTION_MODERATE}' ELSE '{base}' END"""


def _band(p: str) -> str:
    return f"CASE WHEN {p} < 0.25 THEN 'Low' WHEN {p} < 0.5 THEN 'Moderate' WHEN {p} < 0.75 THEN 'Elevated' ELSE 'High' END"


@query(
    "slice_period",
    f"""WITH {O.PROXY} SELECT county_name, period, round(model_risk_prob, 6) AS model_risk_prob, risk_band
    FROM scored WHERE period >= '1997-03' AND period <= '1999-10'""",
)
def slice_query(spark, sf):
    out = K.between_periods(S.proxy_panel(spark, sf), "All Counties", "1997-03", "1999-10")
    return r6(out.select("county_name", "period", "model_risk_prob", "risk_band"))


@query(
    "years_filter",
    f"""WITH {O.PANEL} SELECT county_name, year, month, consecutive_dry_months FROM panel WHERE year BETWEEN 1997 AND 1999""",
)
def years_query(spark, sf):
    out = K.years_between(S.panel(spark, sf), "1997-05", "1999-02")
    return out.select("county_name", "year", "month", "consecutive_dry_months")


@query(
    "category_filter",
    """SELECT p_partkey AS "Part", p_brand AS "Brand" FROM part WHERE p_type IN ('ECONOMY', 'SMALL')""",
)
def category_query(spark, sf):
    parts = S.table(spark, sf, "part")
    out = K.members(parts, "p_type", ["ECONOMY", "SMALL"], {"p_partkey": "Part", "p_brand": "Brand"})
    return out.select("Part", "Brand")


@query("distinct_entities", "SELECT DISTINCT n_name AS county_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def distinct_query(spark, sf):
    joined = S.table(spark, sf, "customer").join(
        S.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return K.distinct_values(joined.withColumnRenamed("n_name", "county_name"), "county_name")


@query("distinct_periods", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def periods_query(spark, sf):
    orders = S.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    return K.distinct_values(orders, "period")


@query(
    "latest_snapshot",
    f"""WITH {O.PROXY} SELECT county_name, period, round(model_risk_prob, 6) AS model_risk_prob, risk_band,
    round(maize_price_zscore, 6) AS maize_price_zscore FROM scored WHERE period = (SELECT max(period) FROM scored)""",
)
def snapshot_query(spark, sf):
    """From the stored panel: one partition is read, more only to fill a gap."""
    filled = S.stored_panel(spark, sf).latest_filled()
    out = W.scored_panel(filled, rainfall_proxy_score(F.col("rainfall_rolling_3m")))
    return r6(out.select("county_name", "period", "model_risk_prob", "risk_band", "maize_price_zscore"))


LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county_name ORDER BY period DESC) AS rn
  FROM scored) WHERE rn = 1)"""


@query(
    "latest_per_entity",
    f"""WITH {O.PROXY}, {LAST} SELECT county_name, period, round(model_risk_prob, 6) AS model_risk_prob FROM last""",
)
def latest_entity_query(spark, sf):
    out = W.latest_per_entity(S.proxy_panel(spark, sf))
    return r6(out.select("county_name", "period", "model_risk_prob"))


@query(
    "overview_kpis",
    f"""WITH {O.PROXY}, {LAST} SELECT count(*) AS counties_monitored,
      count(*) FILTER (risk_band IN ('High', 'Elevated')) AS elevated_or_high_count, max(period) AS latest_period,
      round(avg(model_risk_prob), 6) AS average_risk_prob, count(*) FILTER (risk_band = 'High') AS high_risk_count,
      count(*) FILTER (risk_band = 'Elevated') AS elevated_risk_count,
      count(*) FILTER (risk_band = 'Moderate') AS moderate_risk_count,
      count(*) FILTER (risk_band = 'Low') AS low_risk_count FROM last""",
)
def kpi_query(spark, sf):
    return r6(W.overview_kpis(W.latest_per_entity(S.proxy_panel(spark, sf))))


@query(
    "ranking_table",
    f"""WITH {O.PROXY}, {LAST} SELECT county_name AS "County", risk_band AS "Risk Band",
      round(model_risk_prob, 6) AS "Model Risk Prob", CAST(previous_ipc_phase AS DOUBLE) AS "Prior IPC Phase",
      round(rainfall_anomaly_3m, 6) AS "Rainfall Anom (3M)", round(ndvi_anomaly_3m, 6) AS "NDVI Anom (3M)",
      round(maize_price_zscore, 6) AS "Price Z-Score", CAST(consecutive_dry_months AS DOUBLE) AS "Dry Streak (Mo)"
    FROM last""",
)
def ranking_query(spark, sf):
    return r6(W.ranking_table(W.latest_per_entity(S.proxy_panel(spark, sf))))


@query(
    "map_left_join",
    f"""WITH {O.DIMENSION}, {O.PROXY}, snap AS (SELECT * FROM scored WHERE period = '1999-06' AND
      county_name <> 'NATION_3' AND county_name <> 'NATION_11')
    SELECT canonical_name AS county_name, snap.county_name IS NOT NULL AS is_monitored,
      coalesce(risk_band, 'Not Monitored') AS risk_band,
      coalesce(printf('%.1f', model_risk_prob * 100) || '%', 'Not Monitored') AS risk_prob_display,
      coalesce(CAST(CAST(previous_ipc_phase AS INTEGER) AS VARCHAR), 'N/A') AS ipc_display,
      coalesce(printf('%+.1f', rainfall_anomaly_3m) || '%', 'N/A') AS rain_anom_display,
      coalesce(printf('%+.1f', ndvi_anomaly_3m) || '%', 'N/A') AS ndvi_anom_display,
      coalesce(printf('%+.2f', maize_price_zscore) || ' σ', 'N/A') AS price_z_display
    FROM dim LEFT JOIN snap ON canonical_name = county_name""",
)
def map_query(spark, sf):
    snap = S.proxy_panel(spark, sf).where(
        (F.col("period") == "1999-06") & ~F.col("county_name").isin("NATION_3", "NATION_11")
    )
    return W.map_table(snap, S.entity_dimension(spark, sf))


@query(
    "risk_bands",
    f"""WITH {O.SCORED}, z AS (SELECT *, 12 * (o_orderkey % 29) / 10.0 AS rain FROM scored),
    q AS (SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.40::DOUBLE - rain / 50.0)) AS proxy FROM z)
    SELECT o_orderkey, {_band("p")} AS risk_band, {_action("p", V.ACTION_BASE_LIST)} AS action_list,
      {_action("p", V.ACTION_BASE_SINGLE)} AS action_single, round(proxy, 6) AS proxy_score,
      round(greatest(0.0, least(1.0, proxy - 0.12)), 6) AS lower, round(greatest(0.0, least(1.0, proxy + 0.12)), 6) AS upper
    FROM q""",
)
def bands_query(spark, sf):
    p = F.col("p")
    proxy = rainfall_proxy_score(F.pmod("o_orderkey", F.lit(29)) * 12 / 10.0)
    low, high = proxy_bounds(proxy)
    return r6(
        S.scored_orders(spark, sf).select(
            "o_orderkey", risk_band(p).alias("risk_band"), action_text(p, V.ACTION_BASE_LIST).alias("action_list"),
            action_text(p, V.ACTION_BASE_SINGLE).alias("action_single"), proxy.alias("proxy_score"),
            low.alias("lower"), high.alias("upper"),
        )
    )


PROXY_SCORE = "greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.40::DOUBLE - rainfall_rolling_3m / 50.0::DOUBLE))"


def _risk_sql(source: str, base: str) -> str:
    return f"""SELECT county_name AS county, observation_date AS date, CAST(1 AS INTEGER) AS horizon_months,
      round({PROXY_SCORE}, 3) AS calibrated_probability,
      round(greatest(0.0, {PROXY_SCORE} - 0.12), 2) AS lower, round(least(1.0, {PROXY_SCORE} + 0.12), 2) AS upper,
      {_band(PROXY_SCORE)} AS risk_band, {_action(PROXY_SCORE, base)} AS action_trigger FROM {source}"""


def _flat(df):
    ends = F.col("confidence_interval")
    return df.withColumns({"lower": F.get(ends, F.lit(0)), "upper": F.get(ends, F.lit(1))}).drop("confidence_interval")


@query(
    "risk_latest",
    f"""WITH {O.LONG} {_risk_sql("long", V.ACTION_BASE_LIST)}
    WHERE horizon_months = 1 AND observation_date = (SELECT max(observation_date) FROM long)""",
)
def risk_latest_query(spark, sf):
    """From the stored panel: one partition is read."""
    return _flat(R.latest_risk(with_observation(S.stored_panel(spark, sf).latest())))


@query(
    "risk_latest_from_feeds",
    f"""WITH {O.LONG} {_risk_sql("long", V.ACTION_BASE_LIST)}
    WHERE horizon_months = 1 AND observation_date = (SELECT max(observation_date) FROM long)""",
)
def risk_latest_from_feeds_query(spark, sf):
    return _flat(R.latest_risk(S.long_table(spark, sf)))


@query(
    "risk_entity",
    f"""WITH {O.LONG} {_risk_sql("long", V.ACTION_BASE_SINGLE)} WHERE county_name = 'NATION_7' AND horizon_months = 1
    AND observation_date = (SELECT max(observation_date) FROM long WHERE county_name = 'NATION_7')""",
)
def risk_entity_query(spark, sf):
    """From the stored panel: one bucket of entities is read."""
    return _flat(R.entity_risk(with_observation(S.stored_panel(spark, sf).entity("nation_7")), "nation_7"))


@query(
    "data_status",
    """SELECT 'climate' AS source, CAST(max(o_orderdate) AS DATE) AS latest_date FROM orders
    UNION ALL SELECT 'vegetation', CAST(max(l_shipdate) AS DATE) FROM lineitem
    UNION ALL SELECT 'market', CAST(max(ts) AS DATE) FROM events""",
)
def status_query(spark, sf):
    def dated(name, c):
        return S.table(spark, sf, name).select(F.col(c).cast("date").alias("observation_date"))

    return R.data_status(
        {
            "climate": dated("orders", "o_orderdate"),
            "vegetation": dated("lineitem", "l_shipdate"),
            "market": dated("events", "ts"),
        }
    )


SIGNALS = """list_filter([
  CASE WHEN rainfall_anomaly_lag1 < -20 THEN 'Precipitation deficit (' || printf('%+.1f', rainfall_anomaly_lag1) || '% anomaly)' END,
  CASE WHEN consecutive_dry_months >= 2 THEN 'Extended dry spell (' || consecutive_dry_months || ' consecutive months)' END,
  CASE WHEN ndvi_anomaly_lag1 < -10 THEN 'Vegetation stress (' || printf('%+.1f', ndvi_anomaly_lag1) || '% NDVI anomaly)' END,
  CASE WHEN ndvi_trend_3m < -5 THEN 'Deteriorating 3-month vegetation trend' END,
  CASE WHEN maize_price_zscore > 1.0 THEN 'Elevated staple food price (' || printf('%+.2f', maize_price_zscore) || ' σ)' END,
  CASE WHEN maize_price_change_3m > 15 THEN 'Sharp quarterly price inflation (' || printf('%+.1f', maize_price_change_3m) || '%)' END,
  CASE WHEN previous_ipc_phase >= 3 THEN 'Prior IPC Phase ' || previous_ipc_phase || ' vulnerability anchor' END
], lambda x: x IS NOT NULL)"""


def _default_signals(k: int) -> str:
    return f"""CASE WHEN len({SIGNALS}) = 0 THEN ['{V.NO_SIGNAL}'] ELSE ({SIGNALS})[1:{k}] END"""


@query(
    "top_signals",
    f"""WITH {O.LONG} SELECT county_name, observation_period, horizon_months,
    array_to_string({_default_signals(3)}, '|') AS top_risk_signals FROM long""",
)
def signals_query(spark, sf):
    return S.long_table(spark, sf).select(
        "county_name", "observation_period", "horizon_months",
        F.concat_ws("|", top_signals()).alias("top_risk_signals"),
    )


ELEVATING = """list_filter([
  CASE WHEN rainfall_anomaly_lag1 < -20 THEN 'Pronounced precipitation deficit (' || printf('%+.1f', rainfall_anomaly_lag1) || '% anomaly)' END,
  CASE WHEN consecutive_dry_months >= 2 THEN 'Extended dry spell (' || consecutive_dry_months || ' consecutive dry months)' END,
  CASE WHEN ndvi_anomaly_lag1 < -10 THEN 'Vegetation stress (' || printf('%+.1f', ndvi_anomaly_lag1) || '% NDVI anomaly)' END,
  CASE WHEN ndvi_trend_3m < -5 THEN 'Deteriorating 3-month vegetation trend (' || printf('%+.1f', ndvi_trend_3m) || '%)' END,
  CASE WHEN maize_price_zscore > 1.0 THEN 'Elevated staple food wholesale price (' || printf('%+.2f', maize_price_zscore) || ' σ)' END,
  CASE WHEN maize_price_change_3m > 15 THEN 'Rapid quarterly food price inflation (' || printf('%+.1f', maize_price_change_3m) || '%)' END,
  CASE WHEN near < -20 THEN 'Regional dry conditions across neighbouring counties (' || printf('%+.1f', near) || '%)' END,
  CASE WHEN number_of_high_risk_neighbours >= 2 THEN 'Cluster vulnerability (' || number_of_high_risk_neighbours || ' adjacent counties in elevated risk)' END,
  CASE WHEN previous_ipc_phase >= 3 THEN 'Prior food security stress anchor (IPC Phase ' || previous_ipc_phase || ')' END
], lambda x: x IS NOT NULL)"""
BUFFERING = """list_filter([
  CASE WHEN rainfall_anomaly_lag1 > 20 THEN 'Abundant recent rainfall (' || printf('%+.1f', rainfall_anomaly_lag1) || '% anomaly)' END,
  CASE WHEN ndvi_anomaly_lag1 > 10 THEN 'Vigorous rangeland vegetation condition (' || printf('%+.1f', ndvi_anomaly_lag1) || '% NDVI)' END,
  CASE WHEN previous_ipc_phase <= 1 THEN 'Favorable historical baseline food security status' END
], lambda x: x IS NOT NULL)"""


@query(
    "local_attribution",
    f"""WITH {O.LONG_SCORED}, q AS (SELECT *, round_even(neighbour_mean_rainfall_anomaly, 3) AS near FROM long_scored)
    SELECT county_name, observation_date, horizon_months, risk_probability AS model_risk_probability,
      array_to_string(({ELEVATING})[1:4], '|') AS risk_elevating_factors,
      array_to_string(({BUFFERING})[1:4], '|') AS risk_buffering_factors,
      '{V.ATTRIBUTION_NOTE}' AS interpretation_disclaimer FROM q""",
)
def attribution_query(spark, sf):
    out = R.local_attribution(S.long_scored(spark, sf, with_neighbours=True))
    lists = ("risk_elevating_factors", "risk_buffering_factors")
    return out.withColumns({c: F.concat_ws("|", c) for c in lists})


@query(
    "scored_records",
    f"""WITH {O.LONG_SCORED} SELECT county_name AS county, observation_period AS observation_date,
      horizon_months AS forecast_horizon_months, target_period AS target_date, risk_probability,
      {_band("risk_probability")} AS risk_band, 0.6::DOUBLE AS decision_threshold,
      risk_probability >= 0.6 AS predicted_crisis_alert, 'v1.0-random_forest-h' || horizon_months AS model_version,
      array_to_string({_default_signals(3)}, '|') AS top_risk_signals FROM long_scored""",
)
def records_query(spark, sf):
    out = R.scored_records(S.long_scored(spark, sf))
    return out.withColumn("top_risk_signals", F.concat_ws("|", "top_risk_signals"))


MATRIX = f"""
r AS (SELECT *, array_to_string(({_default_signals(3)})[1:2], '; ') AS sig FROM long_scored),
w AS (SELECT county_name, observation_period, max(risk_probability) FILTER (horizon_months = 1) AS p1,
  max(risk_probability) FILTER (horizon_months = 2) AS p2, max(risk_probability) FILTER (horizon_months = 3) AS p3,
  bool_or(risk_probability >= 0.6) AS alert, max(sig) FILTER (horizon_months = 1) AS sig FROM r GROUP BY 1, 2)"""
TREND = """CASE WHEN p3 - p1 > 0.10 THEN 'Increasing Risk (+)' WHEN p3 - p1 < -0.10 THEN 'Decreasing Risk (-)' ELSE 'Stable (=)' END"""


@query(
    "early_warning_matrix",
    f"""WITH {O.LONG_SCORED}, {MATRIX} SELECT county_name AS "County", printf('%.1f', p1 * 100) || '%' AS "1M Risk (t+1)",
      printf('%.1f', p2 * 100) || '%' AS "2M Risk (t+2)", printf('%.1f', p3 * 100) || '%' AS "3M Risk (t+3)",
      {TREND} AS "Trend", sig AS "Main Signals",
      CASE WHEN alert THEN 'Elevated Model Signal [Alert]' ELSE 'Normal Monitoring [OK]' END AS "Early-Warning Signal"
    FROM w WHERE observation_period = '1999-06'""",
)
def matrix_query(spark, sf):
    return E.early_warning_matrix(S.long_scored(spark, sf), "1999-06")


@query(
    "early_warning_latest",
    f"""WITH {O.LONG_SCORED}, {MATRIX} SELECT county_name AS "County", printf('%.1f', p1 * 100) || '%' AS "1M Risk (t+1)",
      {TREND} AS "Trend" FROM w WHERE observation_period = (SELECT max(observation_period) FROM w)""",
)
def matrix_latest_query(spark, sf):
    return E.early_warning_matrix(S.long_scored(spark, sf)).select("County", "1M Risk (t+1)", "Trend")


@query(
    "entity_forecast",
    f"""WITH {O.LONG_SCORED}, {MATRIX} SELECT l.county_name AS county, l.observation_period AS observation_date,
      horizon_months AS forecast_horizon_months, target_period AS target_date, risk_probability,
      {_band("risk_probability")} AS risk_band, risk_probability >= 0.6 AS predicted_crisis_alert, {TREND} AS trend
    FROM long_scored l JOIN w ON w.county_name = l.county_name AND w.observation_period = l.observation_period
    WHERE l.county_name = 'NATION_4' AND l.observation_period =
      (SELECT max(observation_period) FROM long_scored WHERE county_name = 'NATION_4')""",
)
def forecast_query(spark, sf):
    return E.entity_forecast(S.long_scored(spark, sf), "NATION_4").select(
        "county", "observation_date", "forecast_horizon_months", "target_date", "risk_probability", "risk_band",
        "predicted_crisis_alert", "trend",
    )


@query(
    "trajectory",
    f"""WITH {O.LONG_SCORED} SELECT horizon_months, observation_date, observation_period,
    round(risk_probability * 100, 6) AS risk_pct FROM long_scored WHERE county_name = 'NATION_9'""",
)
def trajectory_query(spark, sf):
    return r6(E.trajectory(S.long_scored(spark, sf), "NATION_9"))


FLAGS = [
    ("rainfall_anomaly_3m", "3M Rainfall Anomaly (%)", "rainfall_anomaly_3m < -20", V.COLOUR_ALERT),
    ("consecutive_dry_months", "Consecutive Dry Months", "consecutive_dry_months >= 2", V.COLOUR_WARN),
    ("ndvi_anomaly_3m", "3M NDVI Anomaly (%)", "ndvi_anomaly_3m < -10", V.COLOUR_ALERT),
    ("maize_price_zscore", "Maize Price Z-Score (σ)", "maize_price_zscore > 1.0", V.COLOUR_ALERT),
    ("previous_ipc_phase", "Prior IPC Phase", "previous_ipc_phase >= 3", V.COLOUR_ALERT),
]


def _flags_sql(source: str, where: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT county_name, period, '{label}' AS indicator, round(CAST({c} AS DOUBLE), 6) AS value,
        CASE WHEN {test} THEN '{colour}' ELSE '{V.COLOUR_OK}' END AS flag FROM {source} WHERE {c} IS NOT NULL {where}"""
        for c, label, test, colour in FLAGS
    )


@query(
    "indicator_flags",
    f"""WITH {O.PANEL}, d AS (SELECT *, strftime(make_date(year, month, 1), '%Y-%m') AS period FROM panel) {_flags_sql("d")}""",
)
def flags_query(spark, sf):
    return r6(W.indicator_rows(W.with_period(S.panel(spark, sf))))


@query(
    "driver_view",
    f"""WITH {O.PROXY} {_flags_sql("scored", "AND county_name = 'NATION_2' AND period = '1998-08'")}""",
)
def driver_query(spark, sf):
    return r6(W.indicator_rows(S.proxy_panel(spark, sf), "NATION_2", "1998-08"))


NARRATIVE = f"""
facts AS (SELECT *, list_filter([
  CASE WHEN rainfall_anomaly_3m < -20 THEN 'Substantial 3-month rainfall deficit (' || printf('%.1f', rainfall_anomaly_3m) || '%)'
       WHEN rainfall_anomaly_3m > 20 THEN 'Above-average 3-month rainfall (+' || printf('%.1f', rainfall_anomaly_3m) || '%)' END,
  CASE WHEN consecutive_dry_months >= 2 THEN 'Extended dry spell streak of ' || CAST(consecutive_dry_months AS INTEGER) || ' consecutive months' END,
  CASE WHEN ndvi_anomaly_3m < -10 THEN 'Severe vegetation vegetative stress (' || printf('%.1f', ndvi_anomaly_3m) || '% NDVI anomaly)'
       WHEN ndvi_anomaly_3m < 0 THEN 'Mild vegetation vegetative deficit (' || printf('%.1f', ndvi_anomaly_3m) || '% NDVI anomaly)' END,
  CASE WHEN maize_price_zscore > 1.0 THEN 'Marked staple food price pressure (+' || printf('%.2f', maize_price_zscore) || ' σ above historical baseline)' END
], lambda x: x IS NOT NULL) AS held FROM scored)"""


@query(
    "narrative",
    f"""WITH {O.PROXY}, {NARRATIVE} SELECT county_name, period,
      '**Automated Risk Summary for ' || county_name || ' (' || period || ')**' || chr(10)
      || '- **Model Estimated Risk Probability:** `' || printf('%.1f', model_risk_prob * 100) || '%` (' || risk_band || ' Risk)' || chr(10)
      || CASE WHEN len(held) > 0 THEN '- **Statistical Risk Correlates:**' || chr(10) || '  * ' || array_to_string(held, chr(10) || '  * ')
         ELSE '- **Statistical Risk Correlates:** Climate, vegetation, and market indicators remain within normal seasonal ranges.' END
      || chr(10) || chr(10) || '{V.NARRATIVE_NOTE}' AS narrative FROM facts""",
)
def narrative_query(spark, sf):
    return W.narratives(S.proxy_panel(spark, sf))


@query(
    "entity_explorer",
    f"""WITH {O.PROXY}, s AS (SELECT * FROM scored WHERE county_name = 'NATION_6' AND period BETWEEN '1996-01' AND '1999-12')
    SELECT county_name, period, round(model_risk_prob, 6) AS model_risk_prob, period = (SELECT max(period) FROM s) AS is_latest FROM s""",
)
def explorer_query(spark, sf):
    out = W.explorer(S.proxy_panel(spark, sf), "NATION_6", "1996-01", "1999-12")
    return r6(out.select("county_name", "period", "model_risk_prob", "is_latest"))


SERIES = [
    ("risk_pct", "model_risk_prob * 100", "NULL"),
    ("rainfall_anomaly_1m", "rainfall_anomaly_1m",
     f"CASE WHEN coalesce(rainfall_anomaly_1m, 0) < 0 THEN '{V.COLOUR_DEFICIT}' ELSE '{V.COLOUR_SURPLUS}' END"),
    ("rainfall_anomaly_3m", "rainfall_anomaly_3m", "NULL"),
    ("ndvi_anomaly_1m", "ndvi_anomaly_1m", "NULL"),
    ("ndvi_anomaly_3m", "ndvi_anomaly_3m", "NULL"),
    ("maize_price_zscore", "maize_price_zscore", "NULL"),
    ("previous_ipc_phase", "previous_ipc_phase", "NULL"),
]


@query(
    "chart_series",
    f"WITH {O.PROXY} "
    + " UNION ALL ".join(
        f"SELECT county_name, period, '{n}' AS series, round(CAST({v} AS DOUBLE), 6) AS value, CAST({c} AS VARCHAR) AS colour FROM scored"
        for n, v, c in SERIES
    ),
)
def chart_query(spark, sf):
    return r6(W.chart_series(S.proxy_panel(spark, sf)))


@query(
    "entity_timeseries",
    f"""WITH {O.PROXY} SELECT period, {rounded("rainfall_rolling_3m", "model_risk_prob")} FROM scored WHERE county_name = 'NATION_12'""",
)
def timeseries_query(spark, sf):
    """From the stored panel: one bucket of entities is read."""
    rows = S.stored_panel(spark, sf).entity("nation_12")
    out = W.scored_panel(rows, rainfall_proxy_score(F.col("rainfall_rolling_3m"))).orderBy("period_dt")
    return r6(out.select("period", "rainfall_rolling_3m", "model_risk_prob"))


STORED_SQL = f"""WITH {O.PANEL} SELECT county_name, year, month, consecutive_dry_months, previous_ipc_phase,
    target_phase3plus, {rounded(*PANEL_DOUBLES)} FROM panel"""


@query("stored_panel", STORED_SQL)
def stored_panel_query(spark, sf):
    """The whole panel as it is stored, z-scores finished on reading."""
    return r6(S.stored_panel(spark, sf).panel())


@query("stored_panel_increments", STORED_SQL)
def stored_panel_increments_query(spark, sf):
    """A panel that grew by landings: rows with wrong values, then more months, then corrections.

    Odd months of a year first land with spoilt values and are put right at the end.
    """
    rows = settle(S.joined_feeds(spark, sf))
    store = S.empty_store(spark)
    spoilt = (F.col("year") == 1995) & (F.col("month") % 2 == 1)
    early = rows.where("year < 1997")
    store.land(early.withColumns({c: F.when(spoilt, -F.col(c)).otherwise(F.col(c)) for c in ("rainfall_anomaly", "price")}))
    store.land(rows.where("year >= 1997"))
    store.land(store.changed(rows))
    return r6(store.panel())

"""The stand-in feeds as SQL common table expressions for the comparison engine."""

DIMENSION = """
dim AS (
  SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') AS county_id,
         n_name AS canonical_name,
         'land-' || n_nationkey AS alias_a,
         'territory ' || n_nationkey AS alias_b,
         CAST(-5.0 AS DOUBLE) + n_nationkey * CAST(0.4 AS DOUBLE) AS centroid_lat,
         CAST(33.5 AS DOUBLE) + ((n_nationkey * 7) % 25) * CAST(0.36 AS DOUBLE) AS centroid_lon,
         CASE n_regionkey % 3 WHEN 0 THEN 'Arid' WHEN 1 THEN 'Semi-Arid' ELSE 'Non-ASAL' END AS asal_category,
         r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

EDGES = """
edges AS (
  SELECT a.n_name AS src, b.n_name AS dst
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey
  WHERE a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey - b.n_nationkey) <= 10
)"""

RAIN = """
rain0 AS (
  SELECT n_name AS county_name, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS rainfall_mm
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3
),
rain AS (
  SELECT *, (rainfall_mm - avg(rainfall_mm) OVER m) / nullif(avg(rainfall_mm) OVER m, 0) * 100
              AS rainfall_anomaly
  FROM rain0 WINDOW m AS (PARTITION BY county_name, month)
)"""

VEGETATION = """
veg0 AS (
  SELECT n_name AS county_name, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(10.0 AS DOUBLE))
           AS ndvi_mean
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3
),
veg AS (
  SELECT *, (ndvi_mean - avg(ndvi_mean) OVER m) / nullif(avg(ndvi_mean) OVER m, 0) * 100 AS ndvi_anomaly
  FROM veg0 WINDOW m AS (PARTITION BY county_name, month)
)"""

MARKET = """
price AS (
  SELECT n_name AS county_name, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100.0 AS DOUBLE)
           / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3
)"""

ASSESSMENTS = """
assess AS (
  SELECT county_name, half AS period_start,
         CAST(half + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
         CASE WHEN share < 0.298 THEN 1 WHEN share < 0.325 THEN 2 WHEN share < 0.343 THEN 3
              WHEN share < 0.367 THEN 4 ELSE 5 END AS ipc_phase,
         n_lines AS phase3plus_population, share * 100 AS phase3plus_percent
  FROM (
    SELECT n_name AS county_name,
           make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1) AS half,
           count(*) AS n_lines,
           CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
    GROUP BY 1, 2
  )
),
assess_m AS (
  SELECT county_name, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
         CAST(ipc_phase AS INTEGER) AS ipc_phase,
         CAST(ipc_phase >= 3 AS INTEGER) AS target_phase3plus,
         phase3plus_population, phase3plus_percent
  FROM (SELECT *, unnest(generate_series(period_start, period_end, INTERVAL 1 MONTH)) AS d FROM assess)
)"""

PANEL = f"""{RAIN},{VEGETATION},{MARKET},{ASSESSMENTS},
joined AS (
  SELECT rain.county_name, rain.year, rain.month, rainfall_mm, rainfall_anomaly, ndvi_mean, ndvi_anomaly,
         price, ipc_phase, target_phase3plus,
         row_number() OVER (PARTITION BY rain.county_name ORDER BY rain.year, rain.month) AS rn
  FROM rain JOIN veg ON rain.county_name = veg.county_name AND rain.year = veg.year AND rain.month = veg.month
       JOIN price ON rain.county_name = price.county_name AND rain.year = price.year AND rain.month = price.month
       JOIN assess_m ON rain.county_name = assess_m.county_name AND rain.year = assess_m.year
            AND rain.month = assess_m.month
),
islands AS (
  SELECT *, sum(CASE WHEN rainfall_anomaly IS NULL OR rainfall_anomaly >= 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY county_name ORDER BY year, month) AS island
  FROM joined
),
streaks AS (
  SELECT *, sum(CASE WHEN rainfall_anomaly < 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY county_name, island ORDER BY year, month) AS run
  FROM islands
),
panel AS (
  SELECT county_name, year, month,
         lag(rainfall_anomaly, 1) OVER w AS rainfall_anomaly_1m,
         lag(rainfall_anomaly, 3) OVER w AS rainfall_anomaly_3m,
         avg(rainfall_mm) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rainfall_rolling_3m,
         CAST(lag(run, 1, 0) OVER w AS INTEGER) AS consecutive_dry_months,
         lag(ndvi_anomaly, 1) OVER w AS ndvi_anomaly_1m,
         lag(ndvi_anomaly, 3) OVER w AS ndvi_anomaly_3m,
         ndvi_mean - lag(ndvi_mean, 3) OVER w AS ndvi_trend_3m,
         (price - lag(price, 1) OVER w) / nullif(lag(price, 1) OVER w, 0) * 100.0::DOUBLE AS maize_price_change_1m,
         (price - lag(price, 3) OVER w) / nullif(lag(price, 3) OVER w, 0) * 100.0::DOUBLE AS maize_price_change_3m,
         (price - avg(price) OVER (PARTITION BY county_name))
           / CASE WHEN stddev_samp(price) OVER (PARTITION BY county_name) = 0 THEN 1.0::DOUBLE
                  ELSE stddev_samp(price) OVER (PARTITION BY county_name) END AS maize_price_zscore,
         lag(ipc_phase, 1) OVER w AS previous_ipc_phase,
         target_phase3plus
  FROM streaks WINDOW w AS (PARTITION BY county_name ORDER BY year, month)
)"""

WIDE = f"""{DIMENSION},{PANEL},
wide0 AS (
  SELECT panel.*,
         make_date(year, month, 1) AS observation_date,
         lag(rainfall_anomaly_1m, 1) OVER w AS rainfall_anomaly_lag1,
         lag(rainfall_anomaly_1m, 2) OVER w AS rainfall_anomaly_lag2,
         lag(rainfall_anomaly_1m, 3) OVER w AS rainfall_anomaly_lag3,
         rainfall_rolling_3m + lag(rainfall_rolling_3m, 3) OVER w AS rainfall_rolling_6m,
         lag(ndvi_anomaly_1m, 1) OVER w AS ndvi_anomaly_lag1,
         lag(ndvi_anomaly_1m, 2) OVER w AS ndvi_anomaly_lag2,
         lag(ndvi_anomaly_1m, 3) OVER w AS ndvi_anomaly_lag3,
         ndvi_anomaly_1m - lag(ndvi_anomaly_1m, 6) OVER w AS ndvi_trend_6m,
         maize_price_change_3m + lag(maize_price_change_3m, 3) OVER w AS maize_price_change_6m,
         lag(previous_ipc_phase, 1) OVER w AS ipc_phase_lag2,
         lag(previous_ipc_phase, 2) OVER w AS ipc_phase_lag3,
         CAST(quarter(make_date(year, month, 1)) AS INTEGER) AS quarter,
         CAST(month IN (3, 4, 5) AS INTEGER) AS is_long_rains,
         CAST(month IN (10, 11, 12) AS INTEGER) AS is_short_rains,
         CAST(coalesce(asal_category = 'Arid', true) AS INTEGER) AS is_arid,
         lead(target_phase3plus, 1) OVER w AS t1,
         lead(target_phase3plus, 2) OVER w AS t2,
         lead(target_phase3plus, 3) OVER w AS t3
  FROM panel LEFT JOIN dim ON county_name = canonical_name
  WINDOW w AS (PARTITION BY county_name ORDER BY year, month)
),{EDGES},
around AS (
  SELECT src, year, month, avg(rainfall_anomaly_lag1) AS n_rain, avg(ndvi_anomaly_lag1) AS n_ndvi,
         avg(maize_price_change_1m) AS n_price, avg(previous_ipc_phase) AS n_risk,
         count(*) FILTER (previous_ipc_phase >= 3) AS n_high
  FROM edges JOIN wide0 ON dst = county_name GROUP BY 1, 2, 3
),
wide AS (
  SELECT wide0.*,
         CASE WHEN linked THEN coalesce(n_rain, 0.0) ELSE rainfall_anomaly_lag1 END AS neighbour_mean_rainfall_anomaly,
         CASE WHEN linked THEN coalesce(n_ndvi, 0.0) ELSE ndvi_anomaly_lag1 END AS neighbour_mean_ndvi_anomaly,
         CASE WHEN linked THEN coalesce(n_price, 0.0) ELSE maize_price_change_1m END AS neighbour_mean_price_change,
         CASE WHEN linked THEN coalesce(n_risk, 2.0) ELSE previous_ipc_phase END AS neighbour_mean_previous_risk,
         CAST(coalesce(n_high, 0) AS INTEGER) AS number_of_high_risk_neighbours
  FROM wide0 LEFT JOIN (SELECT DISTINCT src, true AS linked FROM edges) l ON l.src = county_name
       LEFT JOIN around ON around.src = county_name AND around.year = wide0.year AND around.month = wide0.month
)"""

LONG = f"""{WIDE},
long AS (
  SELECT wide.*, strftime(observation_date, '%Y-%m') AS observation_period,
         h AS horizon_months,
         CAST(observation_date + to_months(h) AS DATE) AS target_date,
         strftime(observation_date + to_months(h), '%Y-%m') AS target_period,
         CASE h WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS label
  FROM wide, (VALUES (1), (2), (3)) AS hs(h)
)"""

PROXY = f"""{PANEL},
filled AS (
  SELECT county_name, year, month, target_phase3plus,
         strftime(make_date(year, month, 1), '%Y-%m') AS period,
         FILLS
  FROM panel
  WINDOW ahead AS (PARTITION BY county_name ORDER BY year, month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         behind AS (PARTITION BY county_name ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
scored AS (
  SELECT *, CASE WHEN model_risk_prob < 0.25 THEN 'Low' WHEN model_risk_prob < 0.5 THEN 'Moderate'
                 WHEN model_risk_prob < 0.75 THEN 'Elevated' ELSE 'High' END AS risk_band
  FROM (SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.40::DOUBLE - rainfall_rolling_3m / 50.0::DOUBLE))
               AS model_risk_prob FROM filled)
)""".replace(
    "FILLS",
    ",\n         ".join(
        f"coalesce(first_value({c} IGNORE NULLS) OVER ahead, last_value({c} IGNORE NULLS) OVER behind, 0) AS {c}"
        for c in [
            "rainfall_anomaly_1m", "rainfall_anomaly_3m", "rainfall_rolling_3m", "consecutive_dry_months",
            "ndvi_anomaly_1m", "ndvi_anomaly_3m", "ndvi_trend_3m", "maize_price_change_1m",
            "maize_price_change_3m", "maize_price_zscore", "previous_ipc_phase",
        ]
    ),
)

LONG_SCORED = f"""{LONG},
long_scored AS (
  SELECT *, round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE - coalesce(
              CASE horizon_months WHEN 1 THEN rainfall_anomaly_lag1 WHEN 2 THEN rainfall_anomaly_lag2
                   ELSE rainfall_anomaly_lag3 END, 0) / 200.0::DOUBLE)), 4) AS risk_probability
  FROM long
)"""

SCORED = """
scored AS (
  SELECT o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS block,
         CAST(o_orderstatus = 'F' AS INTEGER) AS y,
         ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE AS p
  FROM orders
)"""

SCORED_BY_ENTITY = f"""{SCORED},
by_entity AS (
  SELECT n_name AS county_name, y, p FROM scored JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""

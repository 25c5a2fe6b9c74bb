"""Scans, names, panel, lags, graph, fills, checks of data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import oracle_tables as O
from checks import standins as S
from checks.catalog import query, r6, rounded
from harbinger import fixed_values as V
from harbinger.functions.calendar import season_code
from harbinger.functions.scalars import clip, null_nan
from harbinger.functions.text import anomaly_text, currency_text, map_synonyms, percent_text, zero_pad, zscore_text
from harbinger.operators import horizon as H
from harbinger.operators import keys as K
from harbinger.operators import names as N
from harbinger.operators import neighbours as G
from harbinger.operators import quality as Q
from harbinger.operators.panel import join_feeds, panel_features
from harbinger.sources.dimension import insert_absent, list_entities
from harbinger.sources.manifest import (
    MANIFEST_COLUMNS, MANIFEST_SCHEMA, already_ingested, commit_records, latest_assets, read_manifest, source_registry,
    with_staleness,
)
from harbinger.sources.shared import settle, shared_folder
from harbinger.sources.storage import fingerprint

PANEL_DOUBLES = [
    "rainfall_anomaly_1m", "rainfall_anomaly_3m", "rainfall_rolling_3m", "ndvi_anomaly_1m",
    "ndvi_anomaly_3m", "ndvi_trend_3m", "maize_price_change_1m", "maize_price_change_3m",
    "maize_price_zscore",
]


@query(
    "panel_features",
    f"""WITH {O.PANEL} SELECT county_name, year, month, consecutive_dry_months, previous_ipc_phase,
    target_phase3plus, {rounded(*PANEL_DOUBLES)} FROM panel""",
)
def panel_features_query(spark, sf):
    return r6(S.panel(spark, sf))


@query(
    "panel_calendar_lags",
    f"""WITH {O.PANEL}, j AS (SELECT *, year * 12 + month AS m FROM joined)
    SELECT a.county_name, a.year, a.month, round(b.rainfall_anomaly, 6) AS rainfall_anomaly_1m,
      round(c.ndvi_anomaly, 6) AS ndvi_anomaly_3m,
      round((a.price - b.price) / nullif(b.price, 0) * 100.0::DOUBLE, 6) AS maize_price_change_1m,
      b.ipc_phase AS previous_ipc_phase,
      round((a.price - z.m) / CASE WHEN z.s = 0 THEN 1.0 ELSE z.s END, 6) AS maize_price_zscore
    FROM j a LEFT JOIN j b ON a.county_name = b.county_name AND b.m = a.m - 1
    LEFT JOIN j c ON a.county_name = c.county_name AND c.m = a.m - 3
    JOIN (SELECT county_name, m AS at,
            avg(price) OVER (PARTITION BY county_name ORDER BY m) AS m,
            stddev_samp(price) OVER (PARTITION BY county_name ORDER BY m) AS s FROM j) z
      ON z.county_name = a.county_name AND z.at = a.m""",
)
def panel_calendar_query(spark, sf):
    joined = join_feeds(
        S.rainfall(spark, sf), S.vegetation(spark, sf), S.market(spark, sf), S.assessments_monthly(spark, sf)
    )
    out = panel_features(joined, calendar=True, expanding_zscore=True)
    return r6(
        out.select(
            "county_name", "year", "month", "rainfall_anomaly_1m", "ndvi_anomaly_3m",
            "maize_price_change_1m", "previous_ipc_phase", "maize_price_zscore",
        )
    )


@query(
    "interval_to_months",
    f"""WITH {O.ASSESSMENTS} SELECT county_name, year, month, ipc_phase, target_phase3plus,
    CAST(phase3plus_population AS BIGINT) AS phase3plus_population,
    round(phase3plus_percent, 6) AS phase3plus_percent FROM assess_m""",
)
def interval_query(spark, sf):
    return r6(S.assessments_monthly(spark, sf))


@query(
    "period_keys",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS period_dt,
    CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
    CASE WHEN month(o_orderdate) IN (3,4,5) THEN 'MAM' WHEN month(o_orderdate) IN (10,11,12) THEN 'OND'
         WHEN month(o_orderdate) IN (1,2) THEN 'JF' ELSE 'JJAS' END AS season FROM orders""",
)
def period_query(spark, sf):
    from harbinger.functions.calendar import month_start, period_text, quarter_of

    d = F.col("o_orderdate").cast("date")
    start = month_start(F.year(d), F.month(d))
    return S.table(spark, sf, "orders").select(
        "o_orderkey",
        period_text(start).alias("period"),
        start.alias("period_dt"),
        quarter_of(F.month(d)).alias("quarter"),
        season_code(F.month(d)).alias("season"),
    )


LAG_DOUBLES = [
    "rainfall_anomaly_lag1", "rainfall_anomaly_lag2", "rainfall_anomaly_lag3", "rainfall_rolling_6m",
    "ndvi_anomaly_lag1", "ndvi_anomaly_lag2", "ndvi_anomaly_lag3", "ndvi_trend_6m",
    "maize_price_change_6m",
]


@query(
    "second_order_lags",
    f"""WITH {O.WIDE} SELECT county_name, year, month, {rounded(*LAG_DOUBLES)}, ipc_phase_lag2,
    ipc_phase_lag3 FROM wide""",
)
def lags_query(spark, sf):
    out = H.second_order_lags(S.panel(spark, sf))
    return r6(out.select("county_name", "year", "month", *LAG_DOUBLES, "ipc_phase_lag2", "ipc_phase_lag3"))


@query(
    "horizon_long",
    f"""WITH {O.LONG} SELECT county_name, observation_date, observation_period, horizon_months, target_date,
    target_period, label AS target_phase3plus, {rounded(*LAG_DOUBLES)}, ipc_phase_lag2, ipc_phase_lag3,
    month, quarter, is_long_rains, is_short_rains, is_arid,
    round(maize_price_zscore, 6) AS maize_price_zscore FROM long""",
)
def long_query(spark, sf):
    out = S.long_table(spark, sf)
    return r6(
        out.select(
            *V.LONG_KEYS, *LAG_DOUBLES, "ipc_phase_lag2", "ipc_phase_lag3", "month", "quarter",
            "is_long_rains", "is_short_rains", "is_arid", "maize_price_zscore",
        )
    )


@query(
    "neighbour_features",
    f"""WITH {O.WIDE} SELECT county_name, year, month,
    {rounded("neighbour_mean_rainfall_anomaly", "neighbour_mean_ndvi_anomaly",
             "neighbour_mean_price_change", "neighbour_mean_previous_risk")},
    number_of_high_risk_neighbours FROM wide""",
)
def neighbours_query(spark, sf):
    wide = H.second_order_lags(S.panel(spark, sf))
    out = G.neighbour_features(wide, S.edges(spark, sf), date=["year", "month"], decimals=6)
    return r6(out.select("county_name", "year", "month", *V.NEIGHBOUR_COLUMNS))


@query(
    "neighbour_check",
    f"""WITH {O.WIDE}, l AS (SELECT count(*) FILTER (neighbour_mean_rainfall_anomaly IS NULL) * 3 AS a,
      count(*) FILTER (neighbour_mean_ndvi_anomaly IS NULL) * 3 AS b,
      count(*) FILTER (neighbour_mean_price_change IS NULL) * 3 AS c,
      count(*) FILTER (neighbour_mean_previous_risk IS NULL) * 3 AS d FROM wide)
    SELECT 'neighbour_mean_rainfall_anomaly' AS "column", 'nulls' AS problem, CAST(a AS BIGINT) AS n_bad FROM l
    UNION ALL SELECT 'neighbour_mean_ndvi_anomaly', 'nulls', b FROM l
    UNION ALL SELECT 'neighbour_mean_price_change', 'nulls', c FROM l
    UNION ALL SELECT 'neighbour_mean_previous_risk', 'nulls', d FROM l
    UNION ALL SELECT 'number_of_high_risk_neighbours', 'nulls', 0 FROM l""",
)
def neighbour_check_query(spark, sf):
    return Q.neighbour_check(S.long_table(spark, sf, with_neighbours=True))


@query(
    "knn_edges",
    """WITH sites AS (SELECT c_name AS name, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x,
      CAST((c_custkey * 104729) % 9973 AS DOUBLE) AS y FROM customer),
    d AS (SELECT a.name AS src, b.name AS dst,
      sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist_km
      FROM sites a JOIN sites b ON a.name <> b.name)
    SELECT src, dst, 'knn' AS kind, round(dist_km, 6) AS dist_km, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist_km, dst) AS rank FROM d) WHERE rank <= 2""",
)
def knn_query(spark, sf):
    c = S.table(spark, sf, "customer")
    sites = c.select(
        F.col("c_name").alias("name"),
        F.pmod(F.col("c_custkey") * 7919, F.lit(10007)).cast("double").alias("x"),
        F.pmod(F.col("c_custkey") * 104729, F.lit(9973)).cast("double").alias("y"),
    )
    return r6(G.nearest_edges(sites, k=2))


@query(
    "contiguity_edges",
    """WITH cell AS (SELECT p_partkey AS k, p_partkey % 50 AS i, p_partkey // 50 AS j FROM part),
    v AS (SELECT k, i + a AS x, j + b AS y FROM cell, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b))
    SELECT DISTINCT 'p' || l.k AS src, 'p' || r.k AS dst FROM v l JOIN v r ON l.x = r.x AND l.y = r.y
    WHERE l.k <> r.k""",
)
def contiguity_query(spark, sf):
    corners = F.array(
        *[
            F.struct(
                (F.pmod("p_partkey", F.lit(50)) + a).cast("double").alias("lon"),
                (F.floor(F.col("p_partkey") / 50) + b).cast("double").alias("lat"),
            )
            for a, b in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))
        ]
    )
    vertices = S.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.inline(corners)
    )
    return G.contiguity_edges(vertices)


RECTANGLES = """rect AS (SELECT 'p' || p_partkey AS name,
  (p_partkey % 50) * 2 + (p_size % 3) * 0.5::DOUBLE AS x1, floor(p_partkey / 50) * 2 + (p_size % 2) * 0.5::DOUBLE AS y1,
  (p_partkey % 50) * 2 + (p_size % 3) * 0.5::DOUBLE + 0.5 + (p_partkey % 7) * 0.5 AS x2,
  floor(p_partkey / 50) * 2 + (p_size % 2) * 0.5::DOUBLE + 0.5 + (p_partkey % 5) * 0.5 AS y2 FROM part)"""


@query(
    "polygon_contiguity",
    f"""WITH {RECTANGLES} SELECT a.name AS src, b.name AS dst FROM rect a JOIN rect b
    ON a.name <> b.name AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2""",
)
def polygon_query(spark, sf):
    """Rectangles that share vertices or parts of edges, cross, or hold each other."""
    key, size = F.col("p_partkey"), F.col("p_size")
    x1 = (key % 50) * 2 + (size % 3) * 0.5
    y1 = F.floor(key / 50) * 2 + (size % 2) * 0.5
    x2, y2 = x1 + 0.5 + (key % 7) * 0.5, y1 + 0.5 + (key % 5) * 0.5
    corners = [F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    shapes = S.table(spark, sf, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("name"), F.array(F.array(*corners)).alias("rings")
    )
    return G.polygon_contiguity(shapes)


@query(
    "effective_edges",
    f"""WITH {O.DIMENSION}, touch AS (
      SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b
        ON a.n_regionkey = b.n_regionkey AND abs(a.n_nationkey - b.n_nationkey) = 5
        AND a.n_regionkey < 3),
    active AS (SELECT DISTINCT n_name AS name, CAST((n_nationkey * 37) % 101 AS DOUBLE) AS x,
       CAST((n_nationkey * 53) % 97 AS DOUBLE) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey),
    near AS (SELECT a.name AS src, b.name AS dst, row_number() OVER (PARTITION BY a.name
       ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.name) AS rank
       FROM active a JOIN active b ON a.name <> b.name)
    SELECT src, dst, 'contiguity' AS kind FROM touch
      WHERE src IN (SELECT name FROM active) AND dst IN (SELECT name FROM active)
    UNION ALL SELECT src, dst, 'knn' FROM near WHERE rank <= 2 AND src NOT IN
      (SELECT src FROM touch WHERE src IN (SELECT name FROM active) AND dst IN (SELECT name FROM active))""",
)
def effective_edges_query(spark, sf):
    nation = S.table(spark, sf, "nation")
    active = (
        S.table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("county_name"))
    )
    b = nation.select(
        F.col("n_nationkey").alias("k2"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("r2")
    )
    touch = (
        nation.where(F.col("n_regionkey") < 3)
        .join(b, F.col("n_regionkey") == F.col("r2"))
        .where(F.abs(F.col("k2") - F.col("n_nationkey")) == 5)
        .select(F.col("n_name").alias("src"), "dst")
    )
    sites = nation.select(
        F.col("n_name").alias("name"),
        F.pmod(F.col("n_nationkey") * 37, F.lit(101)).cast("double").alias("x"),
        F.pmod(F.col("n_nationkey") * 53, F.lit(97)).cast("double").alias("y"),
    )
    return G.effective_edges(active, touch, sites, k=2, levels=6)


@query(
    "distance_table",
    f"""WITH {O.DIMENSION}, {O.EDGES}
    SELECT src, dst, round(2 * 6371.0088 * asin(least(1.0, sqrt(
      pow(sin(radians(b.centroid_lat - a.centroid_lat) / 2), 2)
      + cos(radians(a.centroid_lat)) * cos(radians(b.centroid_lat))
      * pow(sin(radians(b.centroid_lon - a.centroid_lon) / 2), 2)))), 6) AS great_circle_km
    FROM edges JOIN dim a ON src = a.canonical_name JOIN dim b ON dst = b.canonical_name""",
)
def distance_query(spark, sf):
    dim = S.entity_dimension(spark, sf)
    a = dim.select(F.col("canonical_name").alias("src"), F.col("centroid_lat").alias("a1"), F.col("centroid_lon").alias("o1"))
    b = dim.select(F.col("canonical_name").alias("dst"), F.col("centroid_lat").alias("a2"), F.col("centroid_lon").alias("o2"))
    km = G.haversine_km(F.col("a1"), F.col("o1"), F.col("a2"), F.col("o2"))
    return r6(
        S.edges(spark, sf).join(a, "src").join(b, "dst").select("src", "dst", km.alias("great_circle_km"))
    )


A, E2 = 6378.137, (1 / 298.257223563) * (2 - 1 / 298.257223563)
EP2 = E2 / (1 - E2)
PLANAR = f"""terms AS (SELECT canonical_name AS name, radians(centroid_lat) AS phi,
    {A!r}::DOUBLE / sqrt(1 - {E2!r}::DOUBLE * pow(sin(radians(centroid_lat)), 2)) AS n,
    pow(tan(radians(centroid_lat)), 2) AS t, {EP2!r}::DOUBLE * pow(cos(radians(centroid_lat)), 2) AS c,
    cos(radians(centroid_lat)) * radians(centroid_lon - 39.0) AS d FROM dim),
  meridian AS (SELECT *, {A!r}::DOUBLE * (
    {1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256!r}::DOUBLE * phi
    - {3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024!r}::DOUBLE * sin(2 * phi)
    + {15 * E2**2 / 256 + 45 * E2**3 / 1024!r}::DOUBLE * sin(4 * phi)
    - {35 * E2**3 / 3072!r}::DOUBLE * sin(6 * phi)) AS m FROM terms),
  sites AS (SELECT name,
    0.9996::DOUBLE * n * (d + (1 - t + c) * pow(d, 3) / 6
      + (5 - 18 * t + t * t + 72 * c - 58 * {EP2!r}::DOUBLE) * pow(d, 5) / 120) AS x,
    0.9996::DOUBLE * (m + n * tan(phi) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * pow(d, 4) / 24
      + (61 - 58 * t + t * t + 600 * c - 330 * {EP2!r}::DOUBLE) * pow(d, 6) / 720)) AS y FROM meridian)"""


@query(
    "planar_distance",
    f"""WITH {O.DIMENSION}, {O.EDGES}, {PLANAR}
    SELECT src, dst, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6) AS dist_km
    FROM edges JOIN sites a ON src = a.name JOIN sites b ON dst = b.name""",
)
def planar_query(spark, sf):
    sites = G.sites_from_dimension(S.entity_dimension(spark, sf))
    return r6(G.distance_table(sites, S.edges(spark, sf).select("src", "dst")))


NATIONS = [f"NATION_{i}" for i in range(25)]


@query(
    "value_by_entity",
    f"""WITH {O.WIDE} SELECT observation_date,
    {", ".join(f"round(max(rainfall_anomaly_1m) FILTER (county_name = '{n}'), 6) AS {n}" for n in NATIONS)}
    FROM wide GROUP BY 1""",
)
def pivot_query(spark, sf):
    from harbinger.functions.calendar import month_start

    p = S.panel(spark, sf).withColumn("observation_date", month_start(F.col("year"), F.col("month")))
    return r6(G.value_by_entity(p, "rainfall_anomaly_1m", NATIONS))


FILL = [*PANEL_DOUBLES, "consecutive_dry_months", "previous_ipc_phase"]


@query(
    "fill_backward_forward",
    f"""WITH {O.PROXY} SELECT county_name, period, {rounded(*PANEL_DOUBLES)},
    CAST(consecutive_dry_months AS DOUBLE) AS consecutive_dry_months,
    CAST(previous_ipc_phase AS DOUBLE) AS previous_ipc_phase FROM scored""",
)
def fill_query(spark, sf):
    out = S.proxy_panel(spark, sf)
    return r6(out.select("county_name", "period", *FILL))


@query(
    "fill_zero",
    f"""WITH {O.PANEL} SELECT county_name, year, month,
    {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in PANEL_DOUBLES)} FROM panel""",
)
def fill_zero_query(spark, sf):
    out = K.fill_zero(S.panel(spark, sf), PANEL_DOUBLES)
    return r6(out.select("county_name", "year", "month", *PANEL_DOUBLES))


@query(
    "dedup_keep_last",
    """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1""",
)
def dedup_query(spark, sf):
    events = S.table(spark, sf, "events")
    out = K.keep_last(events, ["user_id", "event_type"], ["ts", "event_id"])
    return r6(out.select("user_id", "event_type", "event_id", "value"))


def raw_names(spark, sf):
    """Customers with a differently spelled name of their nation."""
    c = S.table(spark, sf, "customer").join(
        S.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    k, name = F.pmod("c_custkey", F.lit(9)), F.col("n_name")
    key = F.col("n_nationkey").cast("string")
    spelled = (
        F.when(k == 0, name)
        .when(k == 1, F.lower(name))
        .when(k == 2, F.concat(F.lit("  "), F.replace(name, F.lit("_"), F.lit("-")), F.lit(" ")))
        .when(k == 3, F.replace(F.lower(name), F.lit("a"), F.lit("á")))
        .when(k == 4, F.concat(F.lit("Land "), key))
        .when(k == 5, (F.col("n_nationkey") + 1).cast("string"))
        .when(k == 6, F.concat(name, F.lit(" County")))
        .when(k == 7, F.replace(name, F.lit("_"), F.lit("   ")))
        .otherwise(F.concat(F.lit("Atlantis "), key))
    )
    return c.select("c_custkey", spelled.alias("county_name"))


RAW_NAMES = """
raw AS (
  SELECT c_custkey, n_nationkey, n_name, c_custkey % 9 AS k,
    CASE c_custkey % 9 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name)
      WHEN 2 THEN '  ' || replace(n_name, '_', '-') || ' '
      WHEN 3 THEN replace(lower(n_name), 'a', 'á')
      WHEN 4 THEN 'Land ' || n_nationkey WHEN 5 THEN CAST(n_nationkey + 1 AS VARCHAR)
      WHEN 6 THEN n_name || ' County' WHEN 7 THEN replace(n_name, '_', '   ')
      ELSE 'Atlantis ' || n_nationkey END AS county_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def strict_alias_rows(spark, sf):
    n = S.table(spark, sf, "nation")
    return n.select(
        F.concat(F.lit("land "), F.col("n_nationkey").cast("string")).alias("alias"),
        F.col("n_name").alias("canonical"),
    )


STRICT = f"""WITH {O.DIMENSION}, {RAW_NAMES}, c AS (
  SELECT *, trim(regexp_replace(lower(strip_accents(county_name)), '\\s+', ' ', 'g')) AS clean FROM raw),
p AS (SELECT *, trim(regexp_replace(regexp_replace(clean, '[-_/'']', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM c),
m AS (SELECT p.*, coalesce(
    (SELECT n.n_name FROM nation n WHERE 'land ' || n.n_nationkey = clean),
    (SELECT n.n_name FROM nation n WHERE lower(n.n_name) = clean),
    (SELECT n.n_name FROM nation n WHERE 'land ' || n.n_nationkey = plain),
    (SELECT n.n_name FROM nation n WHERE replace(lower(n.n_name), '_', ' ') = plain),
    (SELECT d.canonical_name FROM dim d WHERE d.county_id =
        CASE WHEN length(clean) < 3 THEN lpad(clean, 3, '0') ELSE clean END)) AS canonical_name FROM p)"""


@query("name_canonical", f"{STRICT} SELECT c_custkey, county_name, canonical_name FROM m")
def names_query(spark, sf):
    return N.canonical_strict(raw_names(spark, sf), S.entity_dimension(spark, sf), strict_alias_rows(spark, sf))


@query(
    "name_dimension_row",
    f"""{STRICT} SELECT c_custkey, m.canonical_name, d.county_id, d.asal_category, d.region
    FROM m LEFT JOIN dim d ON m.canonical_name = d.canonical_name""",
)
def name_dimension_query(spark, sf):
    dim = S.entity_dimension(spark, sf)
    resolved = N.canonical_strict(raw_names(spark, sf), dim, strict_alias_rows(spark, sf))
    out = N.with_dimension(resolved.drop("county_name"), dim)
    return out.select("c_custkey", "canonical_name", "county_id", "asal_category", "region")


SOFT = f"""WITH {O.DIMENSION}, {RAW_NAMES}, low AS (SELECT *, lower(trim(county_name)) AS l FROM raw),
m AS (SELECT low.*,
  (SELECT d.canonical_name FROM dim d WHERE lower(d.canonical_name) = l) AS e,
  (SELECT min(d.canonical_name) FROM dim d WHERE replace(d.alias_a, '-', ' ') = replace(l, '-', ' ')
      OR d.alias_b = replace(l, '-', ' ')) AS a,
  CASE WHEN contains(l, 'county') THEN (SELECT d.canonical_name FROM dim d
      WHERE lower(d.canonical_name) = trim(replace(l, 'county', ''))) END AS b FROM low),
soft AS (SELECT c_custkey, county_name, coalesce(e, a, b) AS canonical_name,
  CASE WHEN e IS NOT NULL THEN 'exact' WHEN coalesce(a, b) IS NOT NULL THEN 'alias' ELSE 'unmatched' END
    AS match_type FROM m)"""


@query("name_soft_match", f"{SOFT} SELECT c_custkey, county_name, canonical_name, match_type FROM soft")
def soft_query(spark, sf):
    return N.canonical_soft(raw_names(spark, sf), S.entity_dimension(spark, sf))


@query(
    "coverage_audit",
    f"""{SOFT}, u AS (SELECT DISTINCT county_name, canonical_name, match_type FROM soft)
    SELECT count(*) FILTER (match_type = 'unmatched') = 0 AS is_valid,
      (SELECT count(*) FROM dim) AS total_official_counties,
      count(DISTINCT canonical_name) AS matched_count,
      string_agg(DISTINCT canonical_name, '|' ORDER BY canonical_name) AS matched_counties,
      count(*) FILTER (match_type = 'unmatched') AS unmatched_count,
      count(*) FILTER (match_type = 'alias') AS aliases_resolved,
      round(CAST(count(DISTINCT canonical_name) AS DOUBLE) / (SELECT count(*) FROM dim) * 100, 1) AS coverage_pct
    FROM u""",
)
def coverage_query(spark, sf):
    out = N.coverage_summary(raw_names(spark, sf), S.entity_dimension(spark, sf))
    return out.withColumn("matched_counties", F.concat_ws("|", "matched_counties"))


@query(
    "spatial_key_audit",
    f"""WITH {RAW_NAMES} SELECT DISTINCT county_name FROM raw
    WHERE lower(trim(county_name)) NOT IN (SELECT lower(n_name) FROM nation)""",
)
def spatial_key_query(spark, sf):
    return N.missing_from(raw_names(spark, sf), S.entity_dimension(spark, sf))


@query(
    "name_difference",
    f"""WITH {RAW_NAMES} SELECT county_name FROM raw EXCEPT SELECT n_name FROM nation""",
)
def name_difference_query(spark, sf):
    return N.name_difference(raw_names(spark, sf), S.entity_dimension(spark, sf))


@query(
    "commodity_map_filter",
    """SELECT event_id, CASE lower(trim(event_type)) WHEN 'view' THEN 'Visit' WHEN 'click' THEN 'Visit'
      WHEN 'purchase' THEN 'Sale' ELSE event_type END AS commodity, round(value, 6) AS price,
      '90kg bag' AS unit, 'KES' AS currency
    FROM events WHERE CASE lower(trim(event_type)) WHEN 'view' THEN 'Visit' WHEN 'click' THEN 'Visit'
      WHEN 'purchase' THEN 'Sale' ELSE event_type END IN ('Visit', 'Sale')""",
)
def commodity_query(spark, sf):
    mapped = map_synonyms(F.col("event_type"), {"view": "Visit", "click": "Visit", "purchase": "Sale"})
    out = S.table(spark, sf, "events").select(
        "event_id", mapped.alias("commodity"), F.col("value").alias("price"),
        F.lit(V.PRICE_UNIT).alias("unit"), F.lit(V.PRICE_CURRENCY).alias("currency"),
    )
    return r6(out.where(F.lower(F.trim("commodity")).isin("visit", "sale")))


@query(
    "clip_casts",
    """SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE round(greatest(5.0, least(100.0, value)), 6) END
      AS clipped, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CASE WHEN length(CAST(user_id AS VARCHAR)) < 3 THEN lpad(CAST(user_id AS VARCHAR), 3, '0')
           ELSE CAST(user_id AS VARCHAR) END AS code FROM events""",
)
def clip_query(spark, sf):
    return r6(
        S.table(spark, sf, "events").select(
            "event_id",
            clip(null_nan(F.col("value")), 5.0, 100.0).alias("clipped"),
            F.get_json_object("props", "$.k").try_cast("int").alias("k"),
            zero_pad(F.col("user_id").cast("string")).alias("code"),
        )
    )


@query(
    "display_formats",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      'KES ' || regexp_replace(printf('%.2f', l_extendedprice), '(\\d)(\\d{3})\\.', '\\1,\\2.') AS price_text,
      CASE WHEN l_quantity - 25.55 > 0 THEN '+' ELSE '' END || printf('%.1f', l_quantity - 25.55) || '%' AS anomaly_text,
      CASE WHEN (l_extendedprice - 40000) / 20000 > 0 THEN '+' ELSE '' END
        || printf('%.2f', (l_extendedprice - 40000) / 20000) || ' σ' AS zscore_text,
      printf('%.1f', l_discount * 100) || '%' AS percent_text
    FROM lineitem""",
)
def formats_query(spark, sf):
    price = F.col("l_extendedprice")
    return S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        currency_text(price).alias("price_text"),
        anomaly_text(F.col("l_quantity") - F.lit(25.55)).alias("anomaly_text"),
        zscore_text((price - 40000) / 20000).alias("zscore_text"),
        percent_text(F.col("l_discount")).alias("percent_text"),
    )


def faulty_panel(spark, sf):
    """Orders as panel rows with a fault of every kind on some of them."""
    o = S.table(spark, sf, "orders").join(
        S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).join(S.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")

    def every(n):
        return F.pmod(k, F.lit(n)) == 0

    return o.select(
        F.when(every(97), "").when(every(89), "Atlantis").otherwise(F.col("n_name")).alias("county_name"),
        F.when(every(83), 1900).otherwise(F.year(d)).alias("year"),
        F.when(every(79), 13).otherwise(F.month(d)).alias("month"),
        F.when(every(73), -1.0).otherwise(F.col("o_totalprice") / 1e5).alias("rainfall_rolling_3m"),
        F.when(every(71), 11.0).otherwise(0.5).alias("maize_price_zscore"),
        F.when(every(67), 7).when(every(61), F.lit(None)).otherwise(F.pmod(k, F.lit(5)) + 1).cast("int").alias("previous_ipc_phase"),
        F.when(every(59), F.lit(None)).when(every(53), 2).otherwise(F.pmod(k, F.lit(2))).cast("int").alias("target_phase3plus"),
    )


FAULTY = """
faulty AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'Atlantis' ELSE n_name END AS county_name,
    CASE WHEN o_orderkey % 83 = 0 THEN 1900 ELSE year(o_orderdate) END AS year,
    CASE WHEN o_orderkey % 79 = 0 THEN 13 ELSE month(o_orderdate) END AS month,
    CASE WHEN o_orderkey % 73 = 0 THEN -1.0 ELSE o_totalprice / 1e5 END AS rainfall_rolling_3m,
    CASE WHEN o_orderkey % 71 = 0 THEN 11.0 ELSE 0.5 END AS maize_price_zscore,
    CASE WHEN o_orderkey % 67 = 0 THEN 7 WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END AS previous_ipc_phase,
    CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 2 ELSE o_orderkey % 2 END AS target_phase3plus
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


@query(
    "validate_panel",
    f"""WITH {FAULTY}
    SELECT 'duplicate_key' AS rule, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_bad
      FROM (SELECT count(*) AS n FROM faulty GROUP BY county_name, year, month)
    UNION ALL SELECT 'invalid_month', count(*) FILTER (month NOT BETWEEN 1 AND 12) FROM faulty
    UNION ALL SELECT 'implausible_year', count(*) FILTER (year NOT BETWEEN 2000 AND 2100) FROM faulty
    UNION ALL SELECT 'empty_name', count(*) FILTER (trim(county_name) = '') FROM faulty
    UNION ALL SELECT 'invalid_phase', count(*) FILTER (previous_ipc_phase NOT BETWEEN 1 AND 5) FROM faulty
    UNION ALL SELECT 'negative_rainfall', count(*) FILTER (rainfall_rolling_3m < 0) FROM faulty
    UNION ALL SELECT 'extreme_zscore', count(*) FILTER (abs(maize_price_zscore) > 10) FROM faulty
    UNION ALL SELECT 'missing_target', count(*) FILTER (target_phase3plus IS NULL) FROM faulty
    UNION ALL SELECT 'invalid_target', count(*) FILTER (target_phase3plus IS NULL OR target_phase3plus NOT IN (0, 1)) FROM faulty
    UNION ALL SELECT 'unknown_name', count(*) FILTER (county_name NOT IN (SELECT n_name FROM nation)) FROM faulty""",
)
def validate_query(spark, sf):
    return Q.validate_panel(faulty_panel(spark, sf), S.entity_dimension(spark, sf))


@query(
    "duplicate_keys",
    f"""WITH {FAULTY} SELECT county_name, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month,
    count(*) AS n FROM faulty GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def duplicates_query(spark, sf):
    return Q.duplicate_rows(faulty_panel(spark, sf))


@query(
    "schema_drift",
    """SELECT 'type' AS "check", 'l_returnflag' AS "column", count(*) AS n_bad FROM lineitem
    UNION ALL SELECT 'below_minimum', 'l_quantity', count(*) FILTER (l_quantity < 2) FROM lineitem
    UNION ALL SELECT 'above_maximum', 'l_quantity', count(*) FILTER (l_quantity > 40) FROM lineitem
    UNION ALL SELECT 'above_maximum', 'l_discount', count(*) FILTER (l_discount > 0.09) FROM lineitem""",
)
def drift_query(spark, sf):
    return Q.schema_drift(
        S.table(spark, sf, "lineitem"),
        ["l_orderkey", "l_quantity", "l_discount"],
        types={"l_returnflag": "int", "l_quantity": "double"},
        bounds={"l_quantity": (2.0, 40.0), "l_discount": (0.0, 0.09)},
    )


@query(
    "schema_drift_missing",
    """SELECT 'missing' AS "check", 'l_colour' AS "column", CAST(1 AS BIGINT) AS n_bad
    UNION ALL SELECT 'above_maximum', 'l_tax', (SELECT count(*) FILTER (l_tax > 0.05) FROM lineitem)""",
)
def drift_missing_query(spark, sf):
    return Q.schema_drift(
        S.table(spark, sf, "lineitem"), ["l_orderkey", "l_colour"],
        types={"l_returnflag": "int"}, bounds={"l_tax": (0.0, 0.05)},
    )


@query(
    "leakage_check",
    f"""WITH {O.LONG} SELECT horizon_months, count(*) AS n,
      count(*) FILTER (target_date <= observation_date) AS not_after,
      count(*) FILTER (datediff('month', observation_date, target_date) <> horizon_months) AS wrong_offset
    FROM long GROUP BY 1""",
)
def leakage_query(spark, sf):
    return Q.leakage_check(S.long_table(spark, sf))


@query(
    "dimension_constraints",
    f"""WITH {O.DIMENSION}, d AS (SELECT CAST(s_suppkey % 40 AS VARCHAR) AS county_id, s_name AS canonical_name,
      CASE s_suppkey % 4 WHEN 0 THEN 'Arid' WHEN 1 THEN 'Semi-Arid' WHEN 2 THEN 'Non-ASAL' ELSE 'Wet' END AS asal_category,
      s_acctbal / 1000.0 AS centroid_lat, 33.0 + s_suppkey % 12 AS centroid_lon FROM supplier),
    z AS (SELECT *, CASE WHEN length(county_id) < 3 THEN lpad(county_id, 3, '0') ELSE county_id END AS code FROM d)
    SELECT 'unknown_code' AS rule, count(*) FILTER (code NOT IN (SELECT county_id FROM dim)) AS n_bad FROM z
    UNION ALL SELECT 'unknown_category', count(*) FILTER (asal_category = 'Wet') FROM z
    UNION ALL SELECT 'outside_latitude', count(*) FILTER (centroid_lat NOT BETWEEN -5.0 AND 5.5) FROM z
    UNION ALL SELECT 'outside_longitude', count(*) FILTER (centroid_lon NOT BETWEEN 33.5 AND 42.5) FROM z
    UNION ALL SELECT 'repeated_code', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT)
      FROM (SELECT count(*) AS n FROM d GROUP BY county_id)
    UNION ALL SELECT 'repeated_name', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT)
      FROM (SELECT count(*) AS n FROM d GROUP BY canonical_name)""",
)
def dimension_query(spark, sf):
    k = F.col("s_suppkey")
    category = (
        F.when(F.pmod(k, F.lit(4)) == 0, "Arid").when(F.pmod(k, F.lit(4)) == 1, "Semi-Arid")
        .when(F.pmod(k, F.lit(4)) == 2, "Non-ASAL").otherwise("Wet")
    )
    d = S.table(spark, sf, "supplier").select(
        F.pmod(k, F.lit(40)).cast("string").alias("county_id"),
        F.col("s_name").alias("canonical_name"),
        category.alias("asal_category"),
        (F.col("s_acctbal") / 1000.0).alias("centroid_lat"),
        (F.lit(33.0) + F.pmod(k, F.lit(12))).alias("centroid_lon"),
    )
    return Q.dimension_check(d, S.entity_dimension(spark, sf))


@query(
    "dimension_list",
    f"""WITH {O.DIMENSION} SELECT county_id, canonical_name, asal_category, region FROM dim
    WHERE asal_category = 'Arid'""",
)
def dimension_list_query(spark, sf):
    out = list_entities(S.entity_dimension(spark, sf), "Arid")
    return out.select("county_id", "canonical_name", "asal_category", "region")


@query(
    "seed_insert_absent",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)""",
)
def seed_query(spark, sf):
    new = S.table(spark, sf, "customer").select("c_custkey", "c_name")
    existing = S.table(spark, sf, "orders").where(F.pmod("o_orderkey", F.lit(3)) == 0)
    return insert_absent(new, existing.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


QUALITY_SQL_COLUMNS = V.PANEL_COLUMNS


def _complete(cols):
    lost = " + ".join(f"avg(CAST({c} IS NULL AS INTEGER))" for c in cols)
    return f"round((1.0 - ({lost}) / {len(cols)}) * 100, 3)"


@query(
    "quality_metrics",
    f"""WITH {O.PANEL} SELECT count(*) AS total_records, count(DISTINCT county_name) AS counties_count,
      min(year) || ' - ' || max(year) AS year_range,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT county_name, year, month FROM panel)) AS duplicate_rows,
      {_complete(V.PANEL_COLUMNS)} AS overall_completeness_pct,
      {", ".join(f"{_complete(cols)} AS {g}_completeness_pct" for g, cols in V.COMPLETENESS_GROUPS.items())}
    FROM panel""",
)
def quality_query(spark, sf):
    return Q.quality_metrics(S.panel(spark, sf), decimals=3)


@query(
    "missing_by_column",
    f"""WITH {O.PANEL}, one AS (SELECT {", ".join(
        f"round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 3) AS {c}" for c in V.PANEL_COLUMNS)} FROM panel)
    SELECT "column", missing_pct, round(100.0 - missing_pct, 3) AS present_pct,
      CASE WHEN contains("column", 'rainfall') OR contains("column", 'dry') THEN 'Climate'
           WHEN contains("column", 'ndvi') THEN 'Vegetation' WHEN contains("column", 'price') THEN 'Market'
           WHEN contains("column", 'ipc') OR contains("column", 'target') THEN 'Food Security Target'
           ELSE 'Metadata' END AS category
    FROM (UNPIVOT one ON COLUMNS(*) INTO NAME "column" VALUE missing_pct)""",
)
def missing_query(spark, sf):
    return Q.missing_by_column(S.panel(spark, sf), decimals=3)


SOURCE_KEYS = ["rainfall_chirps", "vegetation_modis", "market_prices", "ipc_food_security"]


def manifest_log(spark, sf):
    """Orders read as an ingestion log."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(
        F.col("o_orderstatus") == "O", "stale_fallback"
    ).otherwise("failed")
    end = (
        F.when(F.pmod(k, F.lit(7)) == 0, "Unknown")
        .when(F.pmod(k, F.lit(7)) < 4, F.date_format(d, "yyyy-MM"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return S.table(spark, sf, "orders").select(
        F.format_string("A%012d", k).alias("asset_id"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCE_KEYS]), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int")).alias("dataset_name"),
        F.concat(F.lit("provider "), F.col("o_orderpriority")).alias("source_provider"),
        d.alias("retrieval_timestamp"),
        F.md5(F.pmod(k, F.lit(500)).cast("string")).alias("sha256_checksum"),
        end.alias("date_coverage_end"),
        status.alias("ingestion_status"),
    )


LOG = """
log AS (
  SELECT 'A' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS asset_id,
    CASE o_custkey % 4 WHEN 0 THEN 'rainfall_chirps' WHEN 1 THEN 'vegetation_modis' WHEN 2 THEN 'market_prices'
         ELSE 'ipc_food_security' END AS dataset_name,
    'provider ' || o_orderpriority AS source_provider, o_orderdate AS retrieval_timestamp,
    md5(CAST(o_orderkey % 500 AS VARCHAR)) AS sha256_checksum,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown' WHEN o_orderkey % 7 < 4 THEN strftime(o_orderdate, '%Y-%m')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_coverage_end,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'stale_fallback' ELSE 'failed' END AS ingestion_status
  FROM orders
),
latest AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name
    ORDER BY retrieval_timestamp DESC, asset_id DESC) AS rn FROM log) WHERE rn = 1
),
stale AS (
  SELECT *, coalesce(greatest(0, datediff('day', TRY_CAST(CASE WHEN length(date_coverage_end) = 7 AND
      date_coverage_end <> 'Unknown' THEN date_coverage_end || '-01' ELSE date_coverage_end END AS DATE),
      DATE '2001-12-31')), 0) AS staleness_days FROM log
)"""
LIMITS = "CASE dataset_name WHEN 'rainfall_chirps' THEN 45 WHEN 'vegetation_modis' THEN 40 WHEN 'market_prices' THEN 60 ELSE 180 END"


@query(
    "manifest_latest",
    f"""WITH {LOG} SELECT dataset_name, asset_id, source_provider, sha256_checksum, date_coverage_end,
    ingestion_status FROM latest""",
)
def manifest_query(spark, sf):
    return latest_assets(manifest_log(spark, sf)).drop("retrieval_timestamp")


@query(
    "manifest_after_rerun",
    f"""WITH {LOG} SELECT dataset_name, sha256_checksum, ingestion_status, asset_id FROM log
    QUALIFY row_number() OVER (PARTITION BY dataset_name, sha256_checksum, ingestion_status
      ORDER BY retrieval_timestamp < TIMESTAMP '1998-01-01' DESC, retrieval_timestamp DESC, asset_id DESC) = 1""",
)
def manifest_rerun_query(spark, sf):
    """A manifest after a first landing, a landing of all records and a rerun of that.

    Records keep their first landing; the rerun adds nothing.
    """
    kinds = dict(part.strip().split(" ", 1) for part in MANIFEST_SCHEMA.split(", "))
    log = manifest_log(spark, sf)
    log = settle(log.select(*[
        (F.col(c) if c in log.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in MANIFEST_COLUMNS
    ]))
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    commit_records(log.where("retrieval_timestamp < TIMESTAMP '1998-01-01'"), path)
    commit_records(log, path)
    if commit_records(log, path):
        raise AssertionError("a rerun added records")
    return read_manifest(spark, path).select("dataset_name", "sha256_checksum", "ingestion_status", "asset_id")


@query(
    "duplicate_assets",
    f"""WITH {LOG} SELECT asset_id, dataset_name, sha256_checksum FROM log a WHERE ingestion_status <> 'success'
    AND EXISTS (SELECT 1 FROM log b WHERE b.ingestion_status = 'success' AND b.dataset_name = a.dataset_name
      AND b.sha256_checksum = a.sha256_checksum)""",
)
def duplicate_assets_query(spark, sf):
    log = manifest_log(spark, sf)
    out = already_ingested(log.where(F.col("ingestion_status") != "success"), log)
    return out.select("asset_id", "dataset_name", "sha256_checksum")


@query(
    "staleness",
    f"""WITH {LOG} SELECT asset_id, CAST(staleness_days AS INTEGER) AS staleness_days,
    staleness_days > {LIMITS} AS is_stale FROM stale""",
)
def staleness_query(spark, sf):
    log = manifest_log(spark, sf).withColumnRenamed("dataset_name", "source_key")
    out = with_staleness(log, source_registry(spark), F.lit("2001-12-31").cast("date"))
    return out.select("asset_id", F.col("staleness_days").cast("int").alias("staleness_days"), "is_stale")


def _feed_completeness(name, cols):
    lost = " + ".join(f"avg(CAST({c} IS NULL AS INTEGER))" for c in cols)
    return f"SELECT count(*) AS row_count, round((1.0 - ({lost}) / {len(cols)}) * 100, 1) AS completeness_pct FROM {name}"


@query(
    "source_quality",
    f"""WITH {O.RAIN}, {O.VEGETATION}, {O.MARKET}, {O.ASSESSMENTS}, {LOG}, feeds AS (
      SELECT 'rainfall_chirps' AS source_key, * FROM ({_feed_completeness("rain", ["county_name", "year", "month", "rainfall_mm", "rainfall_anomaly"])})
      UNION ALL SELECT 'vegetation_modis', * FROM ({_feed_completeness("veg", ["county_name", "year", "month", "ndvi_mean", "ndvi_anomaly"])})
      UNION ALL SELECT 'market_prices', * FROM ({_feed_completeness("price", ["county_name", "year", "month", "price"])})
      UNION ALL SELECT 'ipc_food_security', * FROM ({_feed_completeness("assess", ["county_name", "period_start", "period_end", "ipc_phase"])}))
    SELECT source_key, l.source_provider AS provider,
      CASE WHEN s.staleness_days > {LIMITS.replace("dataset_name", "source_key")} THEN 'Warning (Stale)'
           WHEN l.ingestion_status = 'stale_fallback' THEN 'Warning (Cached Fallback)'
           WHEN l.ingestion_status = 'failed' THEN 'Failed' ELSE 'Current' END AS status,
      CAST(s.staleness_days AS INTEGER) AS staleness_days,
      s.staleness_days > {LIMITS.replace("dataset_name", "source_key")} AS is_stale,
      row_count, completeness_pct, l.date_coverage_end, substr(l.sha256_checksum, 1, 8) AS sha256_prefix
    FROM feeds JOIN latest l ON source_key = l.dataset_name JOIN stale s ON s.asset_id = l.asset_id""",
)
def source_quality_query(spark, sf):
    registry = source_registry(spark)
    latest = latest_assets(manifest_log(spark, sf)).withColumnRenamed("dataset_name", "source_key")
    dated = with_staleness(latest, registry, F.lit("2001-12-31").cast("date"))
    feeds = {
        "rainfall_chirps": S.rainfall(spark, sf),
        "vegetation_modis": S.vegetation(spark, sf),
        "market_prices": S.market(spark, sf),
        "ipc_food_security": S.assessments(spark, sf),
    }
    out = Q.source_quality(feeds, registry, dated.withColumnRenamed("source_key", "dataset_name"))
    return out.withColumn("staleness_days", F.col("staleness_days").cast("int"))


@query("file_fingerprint")
def fingerprint_query(spark, sf):
    return fingerprint(spark, sf, "*.parquet")

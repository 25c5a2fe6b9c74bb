"""Values the results depend on, stated plainly.

Everything in this file is a fixed value: names, codes, coordinates, alias
lists, thresholds, wording and column orders that a result has to agree with.
No logic lives here.
"""

# --------------------------------------------------------------------------
# The 47 regions (code, name, aridity category, latitude, longitude)
# --------------------------------------------------------------------------
COUNTIES = [
    ("001", "Mombasa", "Non-ASAL", -4.0435, 39.6682),
    ("002", "Kwale", "Semi-Arid", -4.1744, 39.4606),
    ("003", "Kilifi", "Semi-Arid", -3.5107, 39.9093),
    ("004", "Tana River", "Arid", -1.5000, 39.8000),
    ("005", "Lamu", "Semi-Arid", -2.2717, 40.9020),
    ("006", "Taita Taveta", "Semi-Arid", -3.3161, 38.4850),
    ("007", "Garissa", "Arid", -0.4532, 39.6461),
    ("008", "Wajir", "Arid", 1.7471, 40.0573),
    ("009", "Mandera", "Arid", 3.9373, 41.8569),
    ("010", "Marsabit", "Arid", 2.3369, 37.9904),
    ("011", "Isiolo", "Arid", 0.3546, 37.5822),
    ("012", "Meru", "Semi-Arid", 0.0463, 37.6559),
    ("013", "Tharaka-Nithi", "Semi-Arid", -0.2974, 37.8686),
    ("014", "Embu", "Semi-Arid", -0.5390, 37.4586),
    ("015", "Kitui", "Arid", -1.3746, 38.0106),
    ("016", "Machakos", "Semi-Arid", -1.5177, 37.2634),
    ("017", "Makueni", "Semi-Arid", -1.8037, 37.6203),
    ("018", "Nyandarua", "Non-ASAL", -0.1804, 36.5230),
    ("019", "Nyeri", "Semi-Arid", -0.4201, 36.9476),
    ("020", "Kirinyaga", "Non-ASAL", -0.5000, 37.2800),
    ("021", "Murang'a", "Non-ASAL", -0.7167, 37.1500),
    ("022", "Kiambu", "Non-ASAL", -1.1714, 36.8356),
    ("023", "Turkana", "Arid", 3.1167, 35.6000),
    ("024", "West Pokot", "Semi-Arid", 1.4889, 35.1167),
    ("025", "Samburu", "Arid", 1.2500, 36.8000),
    ("026", "Trans Nzoia", "Non-ASAL", 1.0560, 34.9500),
    ("027", "Uasin Gishu", "Non-ASAL", 0.5143, 35.2698),
    ("028", "Elgeyo-Marakwet", "Semi-Arid", 0.8000, 35.5000),
    ("029", "Nandi", "Non-ASAL", 0.1833, 35.1000),
    ("030", "Baringo", "Arid", 0.4833, 35.9667),
    ("031", "Laikipia", "Semi-Arid", 0.3667, 36.7833),
    ("032", "Nakuru", "Semi-Arid", -0.3031, 36.0800),
    ("033", "Narok", "Semi-Arid", -1.0833, 35.8667),
    ("034", "Kajiado", "Semi-Arid", -2.0000, 36.8667),
    ("035", "Kericho", "Non-ASAL", -0.3689, 35.2863),
    ("036", "Bomet", "Non-ASAL", -0.7813, 35.3416),
    ("037", "Kakamega", "Non-ASAL", 0.2827, 34.7519),
    ("038", "Vihiga", "Non-ASAL", 0.0833, 34.7167),
    ("039", "Bungoma", "Non-ASAL", 0.5695, 34.5584),
    ("040", "Busia", "Non-ASAL", 0.4608, 34.1115),
    ("041", "Siaya", "Non-ASAL", 0.0607, 34.2882),
    ("042", "Kisumu", "Non-ASAL", -0.0917, 34.7680),
    ("043", "Homa Bay", "Semi-Arid", -0.5273, 34.4571),
    ("044", "Migori", "Semi-Arid", -1.0634, 34.4731),
    ("045", "Kisii", "Non-ASAL", -0.6817, 34.7667),
    ("046", "Nyamira", "Non-ASAL", -0.5633, 34.9358),
    ("047", "Nairobi", "Non-ASAL", -1.2921, 36.8219),
]

# Administrative region -> member names
REGIONS = {
    "Coast": ["Mombasa", "Kwale", "Kilifi", "Tana River", "Lamu", "Taita Taveta"],
    "North Eastern": ["Garissa", "Wajir", "Mandera"],
    "Eastern": [
        "Marsabit", "Isiolo", "Meru", "Tharaka-Nithi", "Embu", "Kitui",
        "Machakos", "Makueni",
    ],
    "Central": ["Nyandarua", "Nyeri", "Kirinyaga", "Murang'a", "Kiambu"],
    "Rift Valley": [
        "Turkana", "West Pokot", "Samburu", "Trans Nzoia", "Uasin Gishu",
        "Elgeyo-Marakwet", "Nandi", "Baringo", "Laikipia", "Nakuru", "Narok",
        "Kajiado", "Kericho", "Bomet",
    ],
    "Western": ["Kakamega", "Vihiga", "Bungoma", "Busia"],
    "Nyanza": ["Siaya", "Kisumu", "Homa Bay", "Migori", "Kisii", "Nyamira"],
    "Nairobi": ["Nairobi"],
}

# Alternate names kept in the dimension (soft matching)
ALTERNATE_NAMES = {
    "Elgeyo-Marakwet": [
        "elgeyo marakwet", "keiyo-marakwet", "keiyo marakwet", "marakwet",
        "e. marakwet", "elgeyo/marakwet",
    ],
    "Tharaka-Nithi": [
        "tharaka nithi", "tharaka", "tharaka-nithi county", "tharaka/nithi",
    ],
    "Murang'a": ["muranga", "murang'a county", "muranga county"],
    "Taita Taveta": ["taita-taveta", "taita taveta", "taita/taveta"],
    "Tana River": ["tana-river", "tana river", "tanariver"],
    "Trans Nzoia": ["trans-nzoia", "trans nzoia", "transnzoia"],
    "Uasin Gishu": ["uasin-gishu", "uasin gishu", "uasingishu"],
    "West Pokot": ["west-pokot", "west pokot", "pokot"],
    "Homa Bay": ["homa-bay", "homa bay", "homabay"],
}

# Spellings accepted by strict matching
STRICT_ALIASES = {
    "muranga": "Murang'a",
    "murang'a": "Murang'a",
    "tharaka nithi": "Tharaka-Nithi",
    "tharaka-nithi": "Tharaka-Nithi",
    "tharaka": "Tharaka-Nithi",
    "elgeyo marakwet": "Elgeyo-Marakwet",
    "elgeyo-marakwet": "Elgeyo-Marakwet",
    "keiyo marakwet": "Elgeyo-Marakwet",
    "keiyo-marakwet": "Elgeyo-Marakwet",
    "taita taveta": "Taita Taveta",
    "taita/taveta": "Taita Taveta",
    "taita-taveta": "Taita Taveta",
    "trans nzoia": "Trans Nzoia",
    "trans-nzoia": "Trans Nzoia",
    "uasin gishu": "Uasin Gishu",
    "uasin-gishu": "Uasin Gishu",
    "homa bay": "Homa Bay",
    "homabay": "Homa Bay",
    "west pokot": "West Pokot",
    "west-pokot": "West Pokot",
    "pokot": "West Pokot",
}

# Dimension constraints
ARIDITY_CATEGORIES = ["Arid", "Semi-Arid", "Non-ASAL"]
LATITUDE_BOX = (-5.0, 5.5)
LONGITUDE_BOX = (33.5, 42.5)

# --------------------------------------------------------------------------
# Source registry
# (key, name, provider, url, update frequency, staleness days, folder, file, columns)
# --------------------------------------------------------------------------
SOURCES = [
    ("rainfall_chirps", "CHIRPS Monthly Precipitation",
     "UCSB Climate Hazards Center / USGS FEWS NET",
     "https://data.chc.ucsb.edu/products/CHIRPS-2.0/africa_monthly/tifs/",
     "monthly", 45, "raw/climate", "monthly_rainfall.csv",
     ["county_name", "year", "month", "rainfall_mm", "rainfall_anomaly"]),
    ("vegetation_modis", "MODIS Vegetation Indices (NDVI)",
     "NASA LP DAAC / USGS",
     "https://lpdaac.usgs.gov/products/mod13a2v061/",
     "16-day", 40, "raw/vegetation", "monthly_ndvi.csv",
     ["county_name", "year", "month", "ndvi_mean", "ndvi_anomaly"]),
    ("market_prices", "Kenya Staple Food Wholesale Prices",
     "KNBS / WFP VAM / Humanitarian Data Exchange",
     "https://data.humdata.org/dataset/wfp-food-prices-for-kenya",
     "monthly", 60, "raw/market", "maize_prices.csv",
     ["county_name", "year", "month", "commodity", "price"]),
    ("ipc_food_security", "IPC Acute Food Insecurity Classifications",
     "Kenya Food Security Steering Group (KFSSG) / IPC GSU",
     "https://www.ipcinfo.org/ipc-country-analysis/details-page/en/c/kenya",
     "biannual", 180, "raw/ipc", "assessments.csv",
     ["county_name", "period_start", "period_end", "ipc_phase",
      "phase3plus_population", "phase3plus_percent"]),
    ("county_boundaries", "Kenya County Administrative Boundaries",
     "IEBC / Kenya National Bureau of Statistics",
     "https://data.humdata.org/dataset/cod-ab-ken",
     "static", 365, "raw/geospatial", "boundaries.geojson", []),
]

# Staple commodity synonyms, price unit and currency
COMMODITY_SYNONYMS = {
    "maize": "Maize", "dry maize": "Maize", "white maize": "Maize", "corn": "Maize",
}
PRICE_UNIT = "90kg bag"
PRICE_CURRENCY = "KES"

# --------------------------------------------------------------------------
# Column orders
# --------------------------------------------------------------------------
PANEL_FEATURES = [
    "rainfall_anomaly_1m", "rainfall_anomaly_3m", "rainfall_rolling_3m",
    "consecutive_dry_months", "ndvi_anomaly_1m", "ndvi_anomaly_3m",
    "ndvi_trend_3m", "maize_price_change_1m", "maize_price_change_3m",
    "maize_price_zscore", "previous_ipc_phase",
]
PANEL_COLUMNS = ["county_name", "year", "month"] + PANEL_FEATURES + ["target_phase3plus"]

# Long-table features by ablation group
FEATURE_GROUPS = {
    "CLIMATE": [
        "rainfall_anomaly_lag1", "rainfall_anomaly_lag2", "rainfall_anomaly_lag3",
        "rainfall_rolling_3m", "rainfall_rolling_6m", "consecutive_dry_months",
    ],
    "VEGETATION": [
        "ndvi_anomaly_lag1", "ndvi_anomaly_lag2", "ndvi_anomaly_lag3",
        "ndvi_trend_3m", "ndvi_trend_6m",
    ],
    "MARKET": [
        "maize_price_change_1m", "maize_price_change_3m", "maize_price_change_6m",
        "maize_price_zscore",
    ],
    "HISTORICAL_RISK": ["previous_ipc_phase", "ipc_phase_lag2", "ipc_phase_lag3"],
    "SPATIAL": [
        "neighbour_mean_rainfall_anomaly", "neighbour_mean_ndvi_anomaly",
        "neighbour_mean_price_change", "neighbour_mean_previous_risk",
        "number_of_high_risk_neighbours",
    ],
    "SEASONALITY": ["month", "quarter", "is_long_rains", "is_short_rains", "is_arid"],
}
# Long-table feature order
LONG_FEATURES = [
    "rainfall_anomaly_lag1", "rainfall_anomaly_lag2", "rainfall_anomaly_lag3",
    "rainfall_rolling_3m", "rainfall_rolling_6m", "consecutive_dry_months",
    "ndvi_anomaly_lag1", "ndvi_anomaly_lag2", "ndvi_anomaly_lag3",
    "ndvi_trend_3m", "ndvi_trend_6m",
    "maize_price_change_1m", "maize_price_change_3m", "maize_price_change_6m",
    "maize_price_zscore",
    "previous_ipc_phase", "ipc_phase_lag2", "ipc_phase_lag3",
    "month", "quarter", "is_long_rains", "is_short_rains", "is_arid",
    "neighbour_mean_rainfall_anomaly", "neighbour_mean_ndvi_anomaly",
    "neighbour_mean_price_change", "neighbour_mean_previous_risk",
    "number_of_high_risk_neighbours",
]
LONG_KEYS = [
    "county_name", "observation_date", "observation_period", "horizon_months",
    "target_date", "target_period", "target_phase3plus",
]
NEIGHBOUR_COLUMNS = FEATURE_GROUPS["SPATIAL"]

# Source column for each neighbour measure, first present wins
NEIGHBOUR_INPUTS = {
    "rainfall_anomaly": ["rainfall_anomaly_lag1", "rainfall_anomaly", "rainfall_rolling_3m"],
    "ndvi_anomaly": ["ndvi_anomaly_lag1", "ndvi_anomaly", "ndvi_trend_3m"],
    "price_change": ["maize_price_change_1m", "maize_price_change_3m", "maize_price_zscore"],
    "previous_risk": ["previous_ipc_phase", "ipc_phase"],
}
# Neighbour mean when no neighbour has a value
NEIGHBOUR_DEFAULTS = {
    "rainfall_anomaly": 0.0, "ndvi_anomaly": 0.0, "price_change": 0.0, "previous_risk": 2.0,
}

# Completeness groups of the panel
COMPLETENESS_GROUPS = {
    "climate": ["rainfall_anomaly_1m", "rainfall_anomaly_3m", "rainfall_rolling_3m"],
    "vegetation": ["ndvi_anomaly_1m", "ndvi_anomaly_3m", "ndvi_trend_3m"],
    "market": ["maize_price_change_1m", "maize_price_change_3m", "maize_price_zscore"],
    "ipc": ["previous_ipc_phase", "target_phase3plus"],
}

# --------------------------------------------------------------------------
# Folds and years
# --------------------------------------------------------------------------
TRAIN_YEARS, VALIDATION_YEARS, TEST_YEARS = (2019, 2020, 2021, 2022), (2023,), (2024,)
# (fold, train start, train end, evaluation start, evaluation end, split type)
ROLLING_FOLDS = [
    ("val_2023", "2019-07-01", "2022-12-31", "2023-01-01", "2023-12-31", "validation"),
    ("test_2024", "2019-07-01", "2023-12-31", "2024-01-01", "2024-12-31", "test"),
]
EXPERIMENT_FOLDS = [
    ("fold1_drought_peak", None, "2022-12-31", "2023-01-01", "2023-12-31", "test"),
    ("fold2_recovery_transition", None, "2023-12-31", "2024-01-01", "2024-12-31", "test"),
]

# --------------------------------------------------------------------------
# Bands, actions, wording
# --------------------------------------------------------------------------
BAND_EDGES = [(0.25, "Low"), (0.50, "Moderate"), (0.75, "Elevated")]
BAND_TOP = "High"
ACTION_HIGH = "Emergency unconditional cash transfers & livestock feed subsidy"
ACTION_ELEVATED = "Pre-authorize social protection registries & strategic contracts"
ACTION_MODERATE = "Preposition animal health supplies & inspect water infrastructure"
ACTION_BASE_LIST = "Precautionary Monitoring"
ACTION_BASE_SINGLE = "Routine seasonal monitoring"
TREND_UP, TREND_DOWN, TREND_FLAT = "Increasing Risk (+)", "Decreasing Risk (-)", "Stable (=)"
ALERT_ON, ALERT_OFF = "Elevated Model Signal [Alert]", "Normal Monitoring [OK]"
NO_SIGNAL = "Climate and market indicators within normal seasonal bounds"
NO_SIGNAL_MATRIX = "Normal seasonal bounds"
NOT_MONITORED = "Not Monitored"
STATUS_STALE, STATUS_CACHED = "Warning (Stale)", "Warning (Cached Fallback)"
STATUS_FAILED, STATUS_CURRENT = "Failed", "Current"
NARRATIVE_NOTE = (
    "> **Important Non-Causal Note:** These indicators are statistical features correlated with "
    "historical acute food insecurity classifications. Feature presence does not imply direct "
    "causality; humanitarian food insecurity arises from complex, interacting socio-ecological, "
    "market, conflict, and livelihood dynamics."
)
ATTRIBUTION_NOTE = (
    "These indicators reflect statistical association with model predictions and "
    "do not constitute proof of clinical or economic causation."
)
# Ranking table columns and their display names
RANKING_LABELS = [
    ("county_name", "County"),
    ("risk_band", "Risk Band"),
    ("model_risk_prob", "Model Risk Prob"),
    ("previous_ipc_phase", "Prior IPC Phase"),
    ("rainfall_anomaly_3m", "Rainfall Anom (3M)"),
    ("ndvi_anomaly_3m", "NDVI Anom (3M)"),
    ("maize_price_zscore", "Price Z-Score"),
    ("consecutive_dry_months", "Dry Streak (Mo)"),
]
# Indicator panel labels and flag colours
INDICATOR_LABELS = [
    ("rainfall_anomaly_3m", "3M Rainfall Anomaly (%)"),
    ("consecutive_dry_months", "Consecutive Dry Months"),
    ("ndvi_anomaly_3m", "3M NDVI Anomaly (%)"),
    ("maize_price_zscore", "Maize Price Z-Score (σ)"),
    ("previous_ipc_phase", "Prior IPC Phase"),
]
COLOUR_ALERT, COLOUR_WARN, COLOUR_OK = "#dc2626", "#ea580c", "#0284c7"
COLOUR_DEFICIT, COLOUR_SURPLUS = "#dc2626", "#2563eb"
# Blend weights of the ensemble (logistic, forest, boosting)
BLEND_WEIGHTS = (0.2, 0.4, 0.4)
# Stability classes
STABILITY_CLASSES = (
    "Consistently Important", "Moderately Stable", "Horizon-Dependent", "Low Contribution",
)

# Columns stored beside a prediction, for the audit of errors
PREDICTION_CONTEXT = [
    "rainfall_anomaly_lag1", "ndvi_anomaly_lag1", "maize_price_zscore", "previous_ipc_phase",
    "neighbour_mean_rainfall_anomaly", "number_of_high_risk_neighbours",
]

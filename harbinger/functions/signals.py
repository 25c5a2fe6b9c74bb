"""Ordered rule lists turned into text arrays and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.text import anomaly_text, fixed_text, percent_text, zscore_text


def _kept(rules: list[tuple[Column, Column | str]], k: int | None) -> Column:
    """Texts of the rules that hold, in rule order, at most ``k`` of them."""
    texts = [F.when(test, text if isinstance(text, Column) else F.lit(text)) for test, text in rules]
    held = F.array_compact(F.array(*texts))
    return held if k is None else F.slice(held, 1, k)


def _signed(before: str, c: Column, decimals: int, after: str) -> Column:
    return F.concat(F.lit(before), fixed_text(c, decimals, plus=True), F.lit(after))


def _whole(pattern: str, c: Column) -> Column:
    return F.format_string(pattern, c.cast("int"))


def top_signals(k: int = 3) -> Column:
    """First ``k`` risk-raising indicators of a long-table row, or the default text."""
    rain, ndvi = F.col("rainfall_anomaly_lag1"), F.col("ndvi_anomaly_lag1")
    price_z, price_3m = F.col("maize_price_zscore"), F.col("maize_price_change_3m")
    dry, phase = F.col("consecutive_dry_months"), F.col("previous_ipc_phase")
    held = _kept(
        [
            (rain < -20, _signed("Precipitation deficit (", rain, 1, "% anomaly)")),
            (dry >= 2, _whole("Extended dry spell (%d consecutive months)", dry)),
            (ndvi < -10, _signed("Vegetation stress (", ndvi, 1, "% NDVI anomaly)")),
            (F.col("ndvi_trend_3m") < -5, "Deteriorating 3-month vegetation trend"),
            (price_z > 1.0, _signed("Elevated staple food price (", price_z, 2, " σ)")),
            (price_3m > 15, _signed("Sharp quarterly price inflation (", price_3m, 1, "%)")),
            (phase >= 3, _whole("Prior IPC Phase %d vulnerability anchor", phase)),
        ],
        k,
    )
    return F.when(F.size(held) == 0, F.array(F.lit(V.NO_SIGNAL))).otherwise(held)


def elevating_factors(k: int = 4) -> Column:
    rain, ndvi = F.col("rainfall_anomaly_lag1"), F.col("ndvi_anomaly_lag1")
    trend, price_z = F.col("ndvi_trend_3m"), F.col("maize_price_zscore")
    price_3m, dry = F.col("maize_price_change_3m"), F.col("consecutive_dry_months")
    near_rain = F.col("neighbour_mean_rainfall_anomaly")
    near_risk, phase = F.col("number_of_high_risk_neighbours"), F.col("previous_ipc_phase")
    return _kept(
        [
            (rain < -20, _signed("Pronounced precipitation deficit (", rain, 1, "% anomaly)")),
            (dry >= 2, _whole("Extended dry spell (%d consecutive dry months)", dry)),
            (ndvi < -10, _signed("Vegetation stress (", ndvi, 1, "% NDVI anomaly)")),
            (trend < -5, _signed("Deteriorating 3-month vegetation trend (", trend, 1, "%)")),
            (price_z > 1.0, _signed("Elevated staple food wholesale price (", price_z, 2, " σ)")),
            (price_3m > 15, _signed("Rapid quarterly food price inflation (", price_3m, 1, "%)")),
            (near_rain < -20,
             _signed("Regional dry conditions across neighbouring counties (", near_rain, 1, "%)")),
            (near_risk >= 2,
             _whole("Cluster vulnerability (%d adjacent counties in elevated risk)", near_risk)),
            (phase >= 3, _whole("Prior food security stress anchor (IPC Phase %d)", phase)),
        ],
        k,
    )


def buffering_factors(k: int = 4) -> Column:
    rain, ndvi = F.col("rainfall_anomaly_lag1"), F.col("ndvi_anomaly_lag1")
    return _kept(
        [
            (rain > 20, _signed("Abundant recent rainfall (", rain, 1, "% anomaly)")),
            (ndvi > 10, _signed("Vigorous rangeland vegetation condition (", ndvi, 1, "% NDVI)")),
            (F.col("previous_ipc_phase") <= 1,
             "Favorable historical baseline food security status"),
        ],
        k,
    )


def narrative(
    entity: Column, period: Column, band: Column, prob: Column, phase_name: Column | None = None
) -> Column:
    """Markdown paragraph listing the statistical correlates of one entity-month.

    ``phase_name`` is the prior phase as a word; a numeric phase never adds a line.
    """
    rain, ndvi = F.col("rainfall_anomaly_3m"), F.col("ndvi_anomaly_3m")
    price_z, dry = F.col("maize_price_zscore"), F.col("consecutive_dry_months")
    rules = [
        (rain < -20, F.concat(F.lit("Substantial 3-month rainfall deficit ("), anomaly_text(rain), F.lit(")"))),
        (rain > 20, F.concat(F.lit("Above-average 3-month rainfall ("), anomaly_text(rain), F.lit(")"))),
        (dry >= 2, _whole("Extended dry spell streak of %d consecutive months", dry)),
        (ndvi < -10,
         F.concat(F.lit("Severe vegetation vegetative stress ("), anomaly_text(ndvi), F.lit(" NDVI anomaly)"))),
        ((ndvi >= -10) & (ndvi < 0),
         F.concat(F.lit("Mild vegetation vegetative deficit ("), anomaly_text(ndvi), F.lit(" NDVI anomaly)"))),
        (price_z > 1.0,
         F.concat(F.lit("Marked staple food price pressure ("), zscore_text(price_z),
                  F.lit(" above historical baseline)"))),
    ]
    if phase_name is not None:
        rules.append(
            (phase_name.isin("Crisis", "Emergency", "Catastrophe"),
             F.concat(F.lit("Pre-existing acute vulnerability (prior IPC phase: "), phase_name, F.lit(")")))
        )
    held = _kept(rules, None)
    listed = F.concat(
        F.array(F.lit("- **Statistical Risk Correlates:**")),
        F.transform(held, lambda t: F.concat(F.lit("  * "), t)),
    )
    none = F.array(
        F.lit("- **Statistical Risk Correlates:** Climate, vegetation, and market indicators "
              "remain within normal seasonal ranges.")
    )
    head = F.array(
        F.concat(F.lit("**Automated Risk Summary for "), entity, F.lit(" ("), period, F.lit(")**")),
        F.concat(F.lit("- **Model Estimated Risk Probability:** `"), percent_text(prob),
                 F.lit("` ("), band, F.lit(" Risk)")),
    )
    tail = F.array(F.lit(""), F.lit(V.NARRATIVE_NOTE))
    return F.concat_ws("\n", F.concat(head, F.when(F.size(held) > 0, listed).otherwise(none), tail))


def indicator_flags() -> Column:
    """Array of (label, value, flag colour) for the key indicators that are present."""
    flag = {
        "rainfall_anomaly_3m": lambda c: F.when(c < -20, V.COLOUR_ALERT),
        "consecutive_dry_months": lambda c: F.when(c >= 2, V.COLOUR_WARN),
        "ndvi_anomaly_3m": lambda c: F.when(c < -10, V.COLOUR_ALERT),
        "maize_price_zscore": lambda c: F.when(c > 1.0, V.COLOUR_ALERT),
        "previous_ipc_phase": lambda c: F.when(c >= 3, V.COLOUR_ALERT),
    }
    items = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(
                F.lit(label).alias("indicator"),
                F.col(name).cast("double").alias("value"),
                flag[name](F.col(name)).otherwise(V.COLOUR_OK).alias("flag"),
            ),
        )
        for name, label in V.INDICATOR_LABELS
    ]
    return F.array_compact(F.array(*items))

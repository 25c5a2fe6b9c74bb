"""Bounded values, bands, scores and trend labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbinger import fixed_values as V


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to bounds; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    out = c
    if high is not None:
        out = F.least(out, F.lit(high).cast("double"))
    if low is not None:
        out = F.greatest(out, F.lit(low).cast("double"))
    return F.when(c.isNotNull(), out)


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def event_label(phase: Column, threshold: int = 3) -> Column:
    return (phase >= threshold).cast("int")


def percent_change(now: Column, before: Column) -> Column:
    """NULL on a zero base instead of an infinity."""
    return F.try_divide(now - before, before) * 100.0


def ratio(num: Column, den: Column) -> Column:
    """Zero-division convention of the scoring functions: 0 when undefined."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def risk_band(p: Column) -> Column:
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for edge, label in V.BAND_EDGES:
        out = out.when(p < edge, label)
    return out.otherwise(V.BAND_TOP)


def action_text(p: Column, base: str) -> Column:
    return (
        F.when(p >= 0.75, V.ACTION_HIGH)
        .when(p >= 0.50, V.ACTION_ELEVATED)
        .when(p >= 0.25, V.ACTION_MODERATE)
        .otherwise(base)
    )


def rainfall_proxy_score(rain: Column) -> Column:
    """Risk stand-in from the rolling rainfall mean, kept inside [0.05, 0.95]."""
    return clip(F.lit(0.40) - F.coalesce(rain, F.lit(0.0)) / 50.0, 0.05, 0.95)


def proxy_bounds(p: Column, half_width: float = 0.12) -> tuple[Column, Column]:
    """Lower and upper display bound around a proxy score."""
    return clip(p - half_width, 0.0, 1.0), clip(p + half_width, 0.0, 1.0)


def trend_label(first: Column, last: Column, step: float = 0.10) -> Column:
    change = last - first
    return (
        F.when(change > step, V.TREND_UP)
        .when(change < -step, V.TREND_DOWN)
        .otherwise(V.TREND_FLAT)
    )


def source_status(is_stale: Column, ingestion_status: Column) -> Column:
    return (
        F.when(F.coalesce(is_stale, F.lit(False)), V.STATUS_STALE)
        .when(ingestion_status == "stale_fallback", V.STATUS_CACHED)
        .when(ingestion_status == "failed", V.STATUS_FAILED)
        .otherwise(V.STATUS_CURRENT)
    )


def blend(*probs: Column) -> Column:
    """Weighted mean of the logistic, forest and boosting probabilities."""
    terms = [p * w for p, w in zip(probs, V.BLEND_WEIGHTS, strict=True)]
    return sum(terms[1:], terms[0])


def ensemble_spread(*probs: Column, z: float = 1.645) -> dict[str, Column]:
    """Mean, bounds, spread and population deviation over model probabilities."""
    n = len(probs)
    mean = sum(probs[1:], probs[0]) / n
    var = sum(((p - mean) * (p - mean) for p in probs[1:]), (probs[0] - mean) * (probs[0] - mean)) / n
    std = F.sqrt(var)
    models = F.array(*probs)
    low = F.least(clip(mean - z * std, 0.0, 1.0), F.array_min(models))
    high = F.greatest(clip(mean + z * std, 0.0, 1.0), F.array_max(models))
    return {
        "risk_probability": mean,
        "lower_uncertainty_bound": low,
        "upper_uncertainty_bound": high,
        "uncertainty_spread": high - low,
        "model_agreement_std": std,
    }

"""CSV feeds: contract check, names, casts, domain guards, keep-last.

A feed is read once. In strict mode a bad row aborts the query through an
expression in the projection; otherwise :func:`split_feed` separates good rows
from rows to quarantine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.scalars import clip, event_label
from harbinger.functions.text import map_synonyms
from harbinger.operators.keys import expand_to_months, keep_last
from harbinger.operators.names import canonical_soft, canonical_strict, strict_aliases
from harbinger.operators.quality import SchemaDrift, missing_columns
from harbinger.sources.dimension import county_dimension

SEQUENCE = "_seq"

# column -> Spark type, per feed
FEED_TYPES = {
    "rainfall": {"year": "int", "month": "int", "rainfall_mm": "double", "rainfall_anomaly": "double"},
    "vegetation": {"year": "int", "month": "int", "ndvi_mean": "double", "ndvi_anomaly": "double"},
    "market": {"year": "int", "month": "int", "price": "double"},
    "assessments": {
        "period_start": "date", "period_end": "date", "ipc_phase": "int",
        "phase3plus_population": "bigint", "phase3plus_percent": "double",
    },
}
FEED_COLUMNS = {
    "rainfall": V.SOURCES[0][8],
    "vegetation": V.SOURCES[1][8],
    "market": V.SOURCES[2][8],
    "assessments": V.SOURCES[3][8],
}
FEED_KEYS = {
    "rainfall": ["county_name", "year", "month"],
    "vegetation": ["county_name", "year", "month"],
    "market": ["county_name", "year", "month", "commodity"],
    "assessments": ["county_name", "period_start", "period_end"],
}


def feed_rules(feed: str) -> dict[str, Column]:
    """Rules a typed row must satisfy, as ``name -> holds``."""
    month_ok = F.col("month").between(1, 12)
    if feed == "rainfall":
        return {"month": month_ok, "rainfall": ~F.coalesce(F.col("rainfall_mm") < 0, F.lit(False))}
    if feed == "vegetation":
        return {"month": month_ok, "ndvi": F.col("ndvi_mean").between(-0.2, 1.0)}
    if feed == "market":
        return {"month": month_ok, "price": ~F.coalesce(F.col("price") <= 0, F.lit(False))}
    return {"phase": F.col("ipc_phase").between(1, 5)}


def read_csv(spark: SparkSession, path: str | Sequence[str], required: Sequence[str]) -> DataFrame:
    """Header CSV as text columns plus a row sequence; fails on absent columns.

    The sequence is (file, split offset, position in split), which is the order of
    the rows in the files and does not depend on how splits are packed into tasks.
    """
    df = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .csv(path if isinstance(path, str) else list(path))
    )
    absent = missing_columns(df.columns, required)
    if absent:
        raise SchemaDrift(f"missing required columns: {absent}")
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(SEQUENCE),
    )


def _typed(df: DataFrame, feed: str) -> DataFrame:
    """Cast the feed's columns; whole numbers may be written as ``2019.0``."""
    casts = {}
    for c, t in FEED_TYPES[feed].items():
        value = F.col(c)
        casts[c] = value.try_cast("double").cast(t) if t in ("int", "bigint") else value.try_cast(t)
    return df.withColumns(casts)


def _uncastable(feed: str) -> dict[str, Column]:
    return {
        f"type:{c}": F.col(f"_raw_{c}").isNull() | F.col(c).isNotNull() for c in FEED_TYPES[feed]
    }


def split_feed(
    raw: DataFrame, feed: str, dim: DataFrame, aliases: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows (with the names of the broken rules)."""
    named = canonical_strict(raw, dim, aliases, "county_name", "_name")
    kept = named.withColumns({f"_raw_{c}": F.col(c) for c in FEED_TYPES[feed]})
    typed = _typed(kept, feed)
    rules = {"name": F.col("_name").isNotNull(), **_uncastable(feed), **feed_rules(feed)}
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for r, ok in rules.items()])
    )
    checked = typed.withColumn("problems", broken)
    good = checked.where(F.size("problems") == 0).withColumn("county_name", F.col("_name"))
    extra = [f"_raw_{c}" for c in FEED_TYPES[feed]] + ["_name"]
    return good.drop("problems", *extra), checked.where(F.size("problems") > 0).drop(*extra)


def _strict(raw: DataFrame, feed: str, dim: DataFrame, aliases: DataFrame) -> DataFrame:
    named = canonical_strict(raw, dim, aliases, "county_name", "county_name", strict=True)
    typed = _typed(named, feed)
    checked = typed
    for rule, ok in feed_rules(feed).items():
        column = {"month": "month", "rainfall": "rainfall_mm", "ndvi": "ndvi_mean",
                  "price": "price", "phase": "ipc_phase"}[rule]
        kind = FEED_TYPES[feed][column]
        message = F.lit(f"{feed}: rule '{rule}' broken by a row")
        checked = checked.withColumn(
            column,
            F.when(F.coalesce(ok, F.lit(False)), F.col(column)).otherwise(
                F.raise_error(message).cast(kind)
            ),
        )
    return checked


def load_feed(
    spark: SparkSession,
    path: str | Sequence[str],
    feed: str,
    dim: DataFrame | None = None,
    aliases: DataFrame | None = None,
    commodity: str | None = "Maize",
    strict: bool = True,
) -> DataFrame:
    """One validated feed, keyed by canonical name, duplicates resolved keep-last.

    ``commodity`` filters the market feed (trimmed, case-insensitive).
    """
    dim = county_dimension(spark) if dim is None else dim
    aliases = strict_aliases(spark) if aliases is None else aliases
    raw = read_csv(spark, path, FEED_COLUMNS[feed])
    if feed == "market" and commodity:
        raw = raw.where(F.lower(F.trim("commodity")) == commodity.lower())
    rows = _strict(raw, feed, dim, aliases) if strict else split_feed(raw, feed, dim, aliases)[0]
    if feed == "assessments":
        out = rows.withColumn("target_phase3plus", event_label(F.col("ipc_phase")))
        return out.select("county_name", *FEED_COLUMNS[feed][1:], "target_phase3plus", SEQUENCE)
    kept = keep_last(rows, FEED_KEYS[feed], [SEQUENCE])
    return kept.select(*FEED_COLUMNS[feed])


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def monthly_assessments(assessments: DataFrame) -> DataFrame:
    """Assessment intervals as one row per month; the later row wins an overlap."""
    order = [SEQUENCE] if SEQUENCE in assessments.columns else None
    out = expand_to_months(assessments, sequence=order)
    return out.select(
        "county_name", "year", "month", "ipc_phase", "target_phase3plus",
        "phase3plus_population", "phase3plus_percent",
    )


# -- lenient normalisation used by the ingest step ---------------------------------


def _soft_name(df: DataFrame, dim: DataFrame) -> DataFrame:
    matched = canonical_soft(df, dim, "county_name", "_name", "_kind")
    return matched.withColumn("county_name", F.coalesce("_name", "county_name")).drop("_name", "_kind")


def _twin_columns(df: DataFrame, main: str, twin: str) -> DataFrame:
    """Accept either spelling of a measure and emit both."""
    if main not in df.columns and twin not in df.columns:
        raise SchemaDrift(f"neither {main} nor {twin} is present")
    source = main if main in df.columns else twin
    return df.withColumn(main, F.col(source))


def normalise(df: DataFrame, feed: str, dim: DataFrame) -> DataFrame:
    """Clip, cast and harmonise one raw feed without rejecting rows."""
    out = _soft_name(df, dim)
    if feed == "vegetation":
        out = _twin_columns(out, "ndvi_mean", "ndvi")
    if feed == "market":
        out = _twin_columns(out, "price", "price_kes_per_90kg")
        out = out.withColumn("commodity", map_synonyms(F.col("commodity"), V.COMMODITY_SYNONYMS))
    out = _typed(out, feed)
    if feed == "rainfall":
        return out.withColumn("rainfall_mm", clip(F.col("rainfall_mm"), 0.0))
    if feed == "vegetation":
        out = out.withColumn("ndvi_mean", clip(F.col("ndvi_mean"), -1.0, 1.0))
        return out.withColumn("ndvi", F.col("ndvi_mean"))
    if feed == "market":
        out = out.withColumn("price", clip(F.col("price"), 0.0))
        return out.withColumns(
            {
                "price_kes_per_90kg": F.col("price"),
                "unit": F.lit(V.PRICE_UNIT),
                "currency": F.lit(V.PRICE_CURRENCY),
            }
        )
    out = out.withColumns(
        {
            "ipc_phase": clip(F.col("ipc_phase"), 1, 5).cast("int"),
            "phase3plus_population": F.when(
                F.col("phase3plus_population").isNotNull(),
                F.greatest(F.col("phase3plus_population"), F.lit(0).cast("bigint")),
            ),
            "phase3plus_percent": clip(F.col("phase3plus_percent"), 0.0, 100.0),
        }
    )
    return out.withColumn("target_phase3plus", event_label(F.col("ipc_phase")))


def coverage_dates(df: DataFrame) -> DataFrame:
    """First and last period of a feed as text, from real dates."""
    if "year" in df.columns and "month" in df.columns:
        month = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1))
        return df.agg(
            F.date_format(F.min(month), "yyyy-MM").alias("date_coverage_start"),
            F.date_format(F.max(month), "yyyy-MM").alias("date_coverage_end"),
        )
    if "period_start" in df.columns and "period_end" in df.columns:
        return df.agg(
            F.min("period_start").cast("string").alias("date_coverage_start"),
            F.max("period_end").cast("string").alias("date_coverage_end"),
        )
    return df.agg(
        F.lit("Unknown").alias("date_coverage_start"), F.lit("Unknown").alias("date_coverage_end")
    )

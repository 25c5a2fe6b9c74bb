"""Schema, domain and completeness checks; each is one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from harbinger import fixed_values as V
from harbinger.functions.scalars import source_status
from harbinger.functions.text import zero_pad


NUMBER_TYPES = ("int", "bigint", "double", "float")


class SchemaDrift(ValueError):
    """An input does not keep its column contract."""


def missing_columns(columns: Sequence[str], expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in columns]


def schema_drift(
    df: DataFrame,
    expected: Sequence[str],
    types: Mapping[str, str] | None = None,
    bounds: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Rows ``(check, column, n_bad)`` for every contract that is broken."""
    types, bounds = types or {}, bounds or {}
    absent = missing_columns(df.columns, expected)
    checks: list[tuple[str, str, Column]] = [("empty", "*", (F.count(F.lit(1)) == 0).cast("long"))]
    checks += [("missing", c, F.lit(1).cast("long")) for c in absent]
    if not absent:
        held = {f.name: f.dataType for f in df.schema.fields}
        for c, t in types.items():
            if isinstance(held[c], NumericType):
                continue  # a number converts; only text can fail
            text = F.col(c).cast("string")
            value = text.try_cast(t)
            if t in NUMBER_TYPES:
                # screened by pattern first: a failing cast costs far more than a match
                value = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))
            bad = text.isNotNull() & value.isNull()
            checks.append(("type", c, F.count_if(bad)))
    for c, (low, high) in bounds.items():
        if c in df.columns:
            value = F.col(c).try_cast("double")
            checks.append(("below_minimum", c, F.count_if(value < low)))
            checks.append(("above_maximum", c, F.count_if(value > high)))
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), n.alias("n_bad"))
            for k, c, n in checks
        ]
    )
    return df.agg(entries.alias("_e")).select(F.inline("_e")).where(F.col("n_bad") > 0)


def require_schema(df: DataFrame, name: str, expected: Sequence[str], **rules) -> DataFrame:
    """Return ``df`` or raise :class:`SchemaDrift` naming every broken contract."""
    issues = schema_drift(df, expected, **rules).collect()
    if issues:
        lines = [f"{r['check']}: {r['column']} ({r['n_bad']})" for r in issues]
        raise SchemaDrift(f"{name} breaks its contract: " + "; ".join(lines))
    return df


def validate_panel(panel: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Rows ``(rule, n_bad)`` for the panel's domain rules.

    Rows are first combined per key, where duplicates show as a count above one;
    nothing is expanded for a distinct count and no key is gathered in one place.
    """
    phase, target = F.col("previous_ipc_phase"), F.col("target_phase3plus")
    rules = {
        "invalid_month": ~F.coalesce(F.col("month").between(1, 12), F.lit(False)),
        "implausible_year": ~F.coalesce(F.col("year").between(2000, 2100), F.lit(False)),
        "empty_name": F.col("county_name").isNull() | (F.trim("county_name") == ""),
        "invalid_phase": phase.isNotNull() & ~phase.isin(1, 2, 3, 4, 5),
        "negative_rainfall": F.col("rainfall_rolling_3m") < 0,
        "extreme_zscore": F.abs("maize_price_zscore") > 10,
        "missing_target": target.isNull(),
        "invalid_target": ~F.coalesce(target.isin(0, 1), F.lit(False)),
    }
    source = panel
    if dim is not None:
        known = dim.select(F.col("canonical_name").alias("county_name"), F.lit(True).alias("_known"))
        source = panel.join(known, "county_name", "left")
        rules["unknown_name"] = F.col("_known").isNull()
    by_key = source.groupBy("county_name", "year", "month").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(bad).alias(r) for r, bad in rules.items()]
    )
    totals = by_key.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_key"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in rules],
    )
    return totals.unpivot([], ["duplicate_key", *rules], "rule", "n_bad")


def require_valid_panel(panel: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    bad = validate_panel(panel, dim).where(F.col("n_bad") > 0).collect()
    if bad:
        raise ValueError("panel breaks rules: " + ", ".join(f"{r['rule']}={r['n_bad']}" for r in bad))
    return panel


def duplicate_rows(panel: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        panel.groupBy("county_name", "year", "month")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def neighbour_check(df: DataFrame) -> DataFrame:
    """Rows ``(column, problem, n_bad)``: neighbour columns absent or holding NULLs."""
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit("nulls" if c in df.columns else "missing").alias("problem"),
            (F.count_if(F.col(c).isNull()) if c in df.columns else F.lit(1).cast("long")).alias("n_bad"),
        )
        for c in V.NEIGHBOUR_COLUMNS
    ]
    return df.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))


def leakage_check(long: DataFrame) -> DataFrame:
    """Rows per horizon whose target date is not exactly that many months ahead."""
    apart = F.months_between("target_date", "observation_date")
    return long.groupBy("horizon_months").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("target_date") <= F.col("observation_date")).alias("not_after"),
        F.count_if(apart != F.col("horizon_months")).alias("wrong_offset"),
    )


def dimension_check(dim: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows ``(rule, n_bad)``: code, category, coordinate box and uniqueness."""
    lat, lon = F.col("centroid_lat"), F.col("centroid_lon")
    source = dim.withColumn("_code", zero_pad(F.col("county_id")))
    code_ok = F.col("_code").isNotNull()
    if known is not None:
        codes = known.select(F.col("county_id").alias("_code"), F.lit(True).alias("_known")).distinct()
        source = source.join(codes, "_code", "left")
        code_ok = F.col("_known").isNotNull()
    rules = {
        "unknown_code": ~code_ok,
        "unknown_category": ~F.coalesce(F.col("asal_category").isin(*V.ARIDITY_CATEGORIES), F.lit(False)),
        "outside_latitude": ~F.coalesce(lat.between(*V.LATITUDE_BOX), F.lit(False)),
        "outside_longitude": ~F.coalesce(lon.between(*V.LONGITUDE_BOX), F.lit(False)),
    }
    flat = source.agg(*[F.count_if(bad).alias(r) for r, bad in rules.items()]).unpivot(
        [], list(rules), "rule", "n_bad"
    )

    def repeated(column: str, rule: str) -> DataFrame:
        return (
            dim.groupBy(column)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_bad"))
            .select(F.lit(rule).alias("rule"), "n_bad")
        )

    return flat.unionByName(repeated("county_id", "repeated_code")).unionByName(
        repeated("canonical_name", "repeated_name")
    )


def quality_metrics(
    df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None, decimals: int = 1
) -> DataFrame:
    """Size, span, duplicates and completeness in one row.

    Two map-side-combined steps (per key, then overall) give the duplicate count
    and the entity count without a distinct aggregate over the rows.
    """
    groups = {
        g: [c for c in cols if c in df.columns]
        for g, cols in (groups or V.COMPLETENESS_GROUPS).items()
    }
    nulls = {c: F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns}
    key = ["county_name", "year", "month"]
    by_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *nulls.values())
    by_entity = by_key.groupBy("county_name").agg(
        F.sum("_n").alias("_n"),
        F.count(F.lit(1)).alias("_keys"),
        F.min("year").alias("_min"),
        F.max("year").alias("_max"),
        *[F.sum(f"_null_{c}").alias(f"_null_{c}") for c in df.columns],
    )

    def complete(cols: Sequence[str]) -> Column:
        if not cols:
            return F.lit(0.0)
        lost = sum((F.sum(f"_null_{c}") / F.sum("_n") for c in cols), F.lit(0.0)) / len(cols)
        return F.round((1.0 - lost) * 100, decimals)

    return by_entity.agg(
        F.sum("_n").alias("total_records"),
        F.count("county_name").alias("counties_count"),
        F.concat_ws(" - ", F.min("_min").cast("string"), F.max("_max").cast("string")).alias("year_range"),
        (F.sum("_n") - F.sum("_keys")).alias("duplicate_rows"),
        complete(df.columns).alias("overall_completeness_pct"),
        *[complete(cols).alias(f"{g}_completeness_pct") for g, cols in groups.items()],
    )


def column_category(name: Column) -> Column:
    return (
        F.when(name.contains("rainfall") | name.contains("dry"), "Climate")
        .when(name.contains("ndvi"), "Vegetation")
        .when(name.contains("price"), "Market")
        .when(name.contains("ipc") | name.contains("target"), "Food Security Target")
        .otherwise("Metadata")
    )


def missing_by_column(df: DataFrame, decimals: int = 1) -> DataFrame:
    """Missing and present share of every column, with its category."""
    share = {c: F.round(F.avg(F.col(c).isNull().cast("double")) * 100, decimals) for c in df.columns}
    wide = df.agg(*[e.alias(c) for c, e in share.items()])
    return wide.unpivot([], list(share), "column", "missing_pct").select(
        "column",
        "missing_pct",
        F.round(100.0 - F.col("missing_pct"), decimals).alias("present_pct"),
        column_category(F.col("column")).alias("category"),
    )


def completeness_pct(df: DataFrame, decimals: int = 1) -> DataFrame:
    """Row count and mean non-null share over all columns, in one row."""
    lost = sum((F.avg(F.col(c).isNull().cast("double")) for c in df.columns), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.round((1.0 - lost / len(df.columns)) * 100, decimals), F.lit(0.0)).alias("completeness_pct"),
    )


def source_quality(
    feeds: Mapping[str, DataFrame], registry: DataFrame, manifest_latest: DataFrame
) -> DataFrame:
    """Freshness, status and completeness per source key."""
    rows = None
    for key, df in feeds.items():
        one = completeness_pct(df).withColumn("source_key", F.lit(key))
        rows = one if rows is None else rows.unionByName(one)
    latest = manifest_latest.withColumnRenamed("dataset_name", "source_key")
    return (
        registry.select("source_key")
        .join(rows, "source_key")
        .join(latest, "source_key", "left")
        .select(
            "source_key",
            F.coalesce("source_provider", F.lit("Unknown")).alias("provider"),
            source_status(F.col("is_stale"), F.col("ingestion_status")).alias("status"),
            F.coalesce("staleness_days", F.lit(0)).alias("staleness_days"),
            F.coalesce("is_stale", F.lit(False)).alias("is_stale"),
            rows["row_count"].alias("row_count"),
            "completeness_pct",
            F.coalesce("date_coverage_end", F.lit("Unknown")).alias("date_coverage_end"),
            F.substring(F.coalesce("sha256_checksum", F.lit("")), 1, 8).alias("sha256_prefix"),
        )
    )

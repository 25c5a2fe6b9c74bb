"""Matching raw place names to a dimension, and auditing the coverage.

The lookup side holds one row per spelling of a dimension member. How it is joined is
left to the optimizer: below its byte limit it is broadcast, above it the join shuffles
and adaptive execution splits a dominant name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.text import clean_key, strip_punctuation, zero_pad

def strict_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.STRICT_ALIASES.items()), "alias string, canonical string")


def _first_by(lookup: DataFrame, key: str, order: str) -> DataFrame:
    return lookup.groupBy(key).agg(F.min_by("canonical", order).alias("canonical"))


def canonical_strict(
    df: DataFrame,
    dim: DataFrame,
    aliases: DataFrame | None = None,
    raw: str = "county_name",
    out: str = "canonical_name",
    strict: bool = False,
) -> DataFrame:
    """Resolve names: alias, canonical, punctuation-free alias or canonical, code.

    ``dim`` needs ``county_id`` and ``canonical_name``. Unresolved names give NULL,
    or abort the query when ``strict`` is set.
    """
    names = dim.select(F.col("county_id").alias("code"), F.col("canonical_name").alias("canonical"))
    by_name = names.select(F.lower("canonical").alias("key"), "canonical", F.lit(2).alias("rank"))
    by_plain = names.select(
        F.trim(F.regexp_replace(F.lower("canonical"), r"[-_/']", " ")).alias("key"),
        "canonical",
        F.concat(F.lit("2"), F.col("code")).alias("rank"),
    )
    if aliases is not None:
        alias_rows = aliases.select(F.col("alias").alias("key"), "canonical")
        by_name = by_name.unionByName(alias_rows.withColumn("rank", F.lit(1)))
        by_plain = by_plain.unionByName(alias_rows.withColumn("rank", F.lit("1")))
    cleaned = clean_key(F.col(raw))
    staged = df.withColumns(
        {"_clean": cleaned, "_plain": strip_punctuation(cleaned), "_code": zero_pad(cleaned)}
    )
    for stage, lookup in (
        ("_clean", _first_by(by_name, "key", "rank")),
        ("_plain", _first_by(by_plain, "key", "rank")),
        ("_code", names.withColumnRenamed("code", "key")),
    ):
        side = lookup.select(
            F.col("key").alias(stage), F.col("canonical").alias(stage + "_hit")
        )
        staged = staged.join(side, stage, "left")
    hit = F.coalesce("_clean_hit", "_plain_hit", "_code_hit")
    if strict:
        message = F.concat(F.lit("cannot resolve place name: "), F.coalesce(F.col(raw), F.lit("NULL")))
        hit = F.coalesce(hit, F.raise_error(message).cast("string"))
    keep = [c for c in df.columns if c != out]
    return staged.select(*keep, hit.alias(out))


def canonical_soft(
    df: DataFrame,
    dim: DataFrame,
    raw: str = "county_name",
    out: str = "canonical_name",
    kind: str = "match_type",
) -> DataFrame:
    """Resolve names to ``(name, 'exact' | 'alias' | 'unmatched')`` without failing."""
    names = dim.select(
        F.lower("canonical_name").alias("key"), F.col("canonical_name").alias("canonical")
    )
    spelled = (
        dim.select(
            F.col("canonical_name").alias("canonical"), "county_id", F.explode("alternate_names").alias("alias")
        )
        .select(
            F.replace(F.lower("alias"), F.lit("-"), F.lit(" ")).alias("key"), "canonical", "county_id"
        )
    )
    low = F.lower(F.trim(F.col(raw)))
    staged = df.withColumns(
        {
            "_exact": low,
            "_alias": F.replace(low, F.lit("-"), F.lit(" ")),
            "_bare": F.when(low.contains("county"), F.trim(F.replace(low, F.lit("county"), F.lit("")))),
        }
    )
    for stage, lookup in (
        ("_exact", names),
        ("_alias", _first_by(spelled, "key", "county_id")),
        ("_bare", names),
    ):
        side = lookup.select(
            F.col("key").alias(stage), F.col("canonical").alias(stage + "_hit")
        )
        staged = staged.join(side, stage, "left")
    name = F.coalesce("_exact_hit", "_alias_hit", "_bare_hit")
    label = (
        F.when(F.col("_exact_hit").isNotNull(), "exact")
        .when(name.isNotNull(), "alias")
        .otherwise("unmatched")
    )
    keep = [c for c in df.columns if c not in (out, kind)]
    return staged.select(*keep, name.alias(out), label.alias(kind))


def with_dimension(df: DataFrame, dim: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Attach the dimension attributes of a resolved name."""
    side = dim.withColumnRenamed("canonical_name", name).drop("county_name")
    return df.join(side, name, "left")


def coverage_detail(df: DataFrame, dim: DataFrame, raw: str = "county_name") -> DataFrame:
    """One row per distinct raw name with its match."""
    return canonical_soft(df.select(raw).distinct(), dim, raw)


def coverage_summary(df: DataFrame, dim: DataFrame, raw: str = "county_name") -> DataFrame:
    """Coverage audit in one row.

    Only the matched names are gathered, and they cannot outnumber the dimension;
    unmatched names stay rows of :func:`coverage_detail`.
    """
    total = dim.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = coverage_detail(df, dim, raw).agg(
        F.count_distinct("canonical_name").alias("matched_count"),
        F.sort_array(F.collect_set("canonical_name")).alias("matched_counties"),
        F.count_if(F.col("match_type") == "unmatched").alias("unmatched_count"),
        F.count_if(F.col("match_type") == "alias").alias("aliases_resolved"),
    )
    return found.select(
        (F.col("unmatched_count") == 0).alias("is_valid"),
        total.alias("total_official_counties"),
        "matched_count",
        "matched_counties",
        "unmatched_count",
        "aliases_resolved",
        F.round(F.col("matched_count") / total * 100, 1).alias("coverage_pct"),
    )


def missing_from(df: DataFrame, geo: DataFrame, raw: str = "county_name") -> DataFrame:
    """Distinct names of ``df`` absent from ``geo``, ignoring case and outer blanks."""
    key: Column = F.lower(F.trim(F.col(raw)))
    left = df.select(raw).distinct().withColumn("_key", key)
    right = geo.select(key.alias("_key")).distinct()
    return left.join(right, "_key", "left_anti").select(raw)


def name_difference(left: DataFrame, right: DataFrame, column: str = "county_name") -> DataFrame:
    return left.select(column).subtract(right.select(column))

"""The driver's tables read as the library's feeds.

nation + region     -> the region dimension
orders              -> rainfall (order value per entity and order month)
lineitem, supplier  -> vegetation (mean discount per entity and ship month)
lineitem, orders    -> market price (value per unit, by ship month) and assessments
                       (share of returned lines, by order half-year)
orders              -> scored events (label and score per order)

Money and quantities are summed as whole numbers, so a sum does not depend on the
order in which partitions are combined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harbinger.functions.scalars import clip, event_label, rainfall_proxy_score
from harbinger.operators.horizon import build_long_table
from harbinger.operators.keys import expand_to_months
from harbinger.operators.panel import build_panel, join_feeds
from harbinger.plans.stored_panel import StoredPanel
from harbinger.plans.views import scored_panel
from harbinger.sources.shared import shared_folder


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the footer once and then declared."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def entity_dimension(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.col("n_nationkey")
    category = (
        F.when(F.pmod("n_regionkey", F.lit(3)) == 0, "Arid")
        .when(F.pmod("n_regionkey", F.lit(3)) == 1, "Semi-Arid")
        .otherwise("Non-ASAL")
    )
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lpad((key + 1).cast("string"), 3, "0").alias("county_id"),
        F.col("n_name").alias("county_name"),
        F.col("n_name").alias("canonical_name"),
        F.array(
            F.concat(F.lit("land-"), key.cast("string")),
            F.concat(F.lit("territory "), key.cast("string")),
        ).alias("alternate_names"),
        (F.lit(-5.0) + key * 0.4).alias("centroid_lat"),
        (F.lit(33.5) + F.pmod(key * 7, F.lit(25)) * 0.36).alias("centroid_lon"),
        category.alias("asal_category"),
        F.col("r_name").alias("region"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of one region, ring-wise: each nation and the next two by key."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    other = n.select(
        F.col("n_nationkey").alias("k2"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("r2")
    )
    step = F.col("k2") - F.col("n_nationkey")
    return (
        n.join(other, F.col("n_regionkey") == F.col("r2"))
        .where((step != 0) & (F.abs(step) <= 10))
        .select(F.col("n_name").alias("src"), "dst")
    )


def _orders_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the nation key of their customer."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_nationkey", "ordered", "cents"
    )


def _named(df: DataFrame, spark: SparkSession, sf: str, key: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("county_name"))
    return df.join(nation, F.col(key) == F.col("n_nationkey")).drop("n_nationkey", key)


def _month_anomaly(column: str) -> Column:
    """Percent off the entity's mean for that month of the year (a few years of rows)."""
    mean = F.avg(column).over(Window.partitionBy("county_name", "month"))
    return F.try_divide(F.col(column) - mean, mean) * 100


def rainfall(spark: SparkSession, sf: str) -> DataFrame:
    monthly = (
        _orders_by_nation(spark, sf)
        .groupBy("c_nationkey", F.year("ordered").alias("year"), F.month("ordered").alias("month"))
        .agg((F.sum("cents") / 1e8).alias("rainfall_mm"))
    )
    return _named(monthly, spark, sf, "c_nationkey").withColumn(
        "rainfall_anomaly", _month_anomaly("rainfall_mm")
    )


def vegetation(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("shipped"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("pct"),
    )
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    monthly = (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.year("shipped").alias("year"), F.month("shipped").alias("month"))
        .agg((F.sum("pct") / (F.count(F.lit(1)) * 10.0)).alias("ndvi_mean"))
    )
    return _named(monthly, spark, sf, "s_nationkey").withColumn(
        "ndvi_anomaly", _month_anomaly("ndvi_mean")
    )


def _line_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by nation, ship month and order half-year: the one pass over lineitem
    behind both the price feed and the assessments."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("shipped"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("units"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("returned"),
    )
    half = F.make_date(
        F.year("ordered"), F.when(F.month("ordered") <= 6, 1).otherwise(7), F.lit(1)
    )
    orders = _orders_by_nation(spark, sf).select("o_orderkey", "c_nationkey", half.alias("half"))
    month = F.trunc("shipped", "MM")
    cube = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_nationkey", "half", month.alias("ship_month"))
        .agg(
            F.sum("cents").alias("cents"), F.sum("units").alias("units"),
            F.sum("returned").alias("returned"), F.count(F.lit(1)).alias("lines"),
        )
    )
    return cube


def market(spark: SparkSession, sf: str) -> DataFrame:
    monthly = (
        _line_cube(spark, sf)
        .where(F.col("ship_month").isNotNull())
        .groupBy("c_nationkey", F.year("ship_month").alias("year"), F.month("ship_month").alias("month"))
        .agg((F.sum("cents") / 100.0 / F.sum("units")).alias("price"))
    )
    return _named(monthly, spark, sf, "c_nationkey")


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    by_half = _line_cube(spark, sf).groupBy("c_nationkey", "half").agg(
        F.sum("returned").alias("returned"), F.sum("lines").alias("lines")
    )
    share = F.col("returned") / F.col("lines")
    phase = (
        F.when(share < 0.298, 1).when(share < 0.325, 2).when(share < 0.343, 3)
        .when(share < 0.367, 4).otherwise(5)
    )
    named = _named(by_half, spark, sf, "c_nationkey")
    return named.select(
        "county_name",
        F.col("half").alias("period_start"),
        F.date_sub(F.add_months("half", 6), 1).alias("period_end"),
        phase.alias("ipc_phase"),
        event_label(phase).alias("target_phase3plus"),
        F.col("lines").alias("phase3plus_population"),
        (share * 100).alias("phase3plus_percent"),
    )


def assessments_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return expand_to_months(assessments(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return build_panel(
        rainfall(spark, sf), vegetation(spark, sf), market(spark, sf), assessments_monthly(spark, sf)
    )


def joined_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return join_feeds(
        rainfall(spark, sf), vegetation(spark, sf), market(spark, sf), assessments_monthly(spark, sf)
    )


def empty_store(spark: SparkSession) -> StoredPanel:
    return StoredPanel(spark, f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}")


_STORES: dict[tuple[str, str], StoredPanel] = {}


def stored_panel(spark: SparkSession, sf: str) -> StoredPanel:
    """The stored panel of the tables; the first question of an application builds it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        store = empty_store(spark)
        store.land(joined_feeds(spark, sf))
        _STORES[key] = store
    return _STORES[key]


def long_table(spark: SparkSession, sf: str, with_neighbours: bool = False) -> DataFrame:
    return build_long_table(
        panel(spark, sf),
        entity_dimension(spark, sf),
        edges(spark, sf) if with_neighbours else None,
    )


def proxy_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Gap-filled panel scored with the rainfall proxy."""
    return scored_panel(panel(spark, sf), rainfall_proxy_score(F.col("rainfall_rolling_3m")))


def long_scored(spark: SparkSession, sf: str, with_neighbours: bool = False) -> DataFrame:
    """Long table with a rule-based probability that differs per horizon."""
    lag = (
        F.when(F.col("horizon_months") == 1, F.col("rainfall_anomaly_lag1"))
        .when(F.col("horizon_months") == 2, F.col("rainfall_anomaly_lag2"))
        .otherwise(F.col("rainfall_anomaly_lag3"))
    )
    p = F.round(clip(F.lit(0.5) - F.coalesce(lag, F.lit(0.0)) / 200.0, 0.05, 0.95), 4)
    return long_table(spark, sf, with_neighbours).withColumns(
        {"risk_probability": p, "decision_threshold": F.lit(0.6)}
    )


def scored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Label and three-decimal score of every order."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("block"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.pmod(F.col("o_orderkey") * 37, F.lit(1000)) / 1000.0).alias("p"),
    )


def scored_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = scored_orders(spark, sf).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _named(joined.drop("c_custkey"), spark, sf, "c_nationkey")


# folds and years of the learning jobs, inside the driver tables' dates
FOLDS = [
    ("val_1999", "1995-07-01", "1998-12-31", "1999-01-01", "1999-12-31", "validation"),
    ("test_2000", "1995-07-01", "1999-12-31", "2000-01-01", "2000-12-31", "test"),
]
YEARS = {"train": (1995, 1996, 1997, 1998), "validation": (1999,), "test": (2000, 2001)}

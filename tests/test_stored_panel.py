"""A stored panel after any landings equals the panel of all rows, and reads few partitions."""

import random
import re

import pytest
from frame_rows import rows
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.operators.keys import at_latest, fill_back_then_forward
from harbinger.operators.panel import panel_features
from harbinger.plans.stored_panel import RAW, StoredPanel
from harbinger.sources.storage import write_partitions

SCHEMA = (
    "county_name string, year int, month int, rainfall_mm double, rainfall_anomaly double, ndvi_mean double, "
    "ndvi_anomaly double, price double, ipc_phase int, target_phase3plus int"
)


def random_rows(seed, entities=5, months=40):
    """Rows with missing months, missing values, long dry runs and an entity that starts late."""
    draw = random.Random(seed)
    out = []
    for e in range(entities):
        dry = False
        for i in range(draw.choice([0, 0, 17]), months):
            if draw.random() < 0.15:
                continue
            dry = draw.random() < 0.9 if dry else draw.random() < 0.2
            anomaly = None if draw.random() < 0.05 else (-1 if dry else 1) * draw.uniform(0, 40)
            value = [draw.uniform(0, 90), anomaly, draw.random(), draw.uniform(-9, 9), None if draw.random() < 0.1 else draw.uniform(20, 60)]
            out.append((f"Entity {e}", 2000 + i // 12, i % 12 + 1, *value, draw.randint(1, 5), draw.randint(0, 1)))
    return out


def rounded_rows(df):
    return rows(df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.select(*V.PANEL_COLUMNS).dtypes]))


def check(spark, store, held):
    full = panel_features(spark.createDataFrame(held, SCHEMA))
    expected = rounded_rows(full)
    assert rounded_rows(store.panel()) == expected
    for name in sorted({r[0] for r in held})[-2:]:
        assert rounded_rows(store.entity(name.upper())) == [r for r in expected if r[0] == name]
    filled = fill_back_then_forward(full, V.PANEL_FEATURES).withColumn("i", F.col("year") * 12 + F.col("month"))
    assert rounded_rows(store.latest_filled()) == rounded_rows(at_latest(filled, "i").drop("i"))


@pytest.mark.parametrize("seed", [1, 2])
def test_landings_equal_one_build(spark, tmp_path, seed):
    every = random_rows(seed)
    draw = random.Random(seed)
    store = StoredPanel(spark, str(tmp_path / "store"), buckets=3)
    early = [r for r in every if (r[1], r[2]) < (2002, 6)]
    store.land(spark.createDataFrame(early, SCHEMA))
    check(spark, store, early)
    store.land(spark.createDataFrame([r for r in every if r not in early], SCHEMA))
    check(spark, store, every)
    # corrections and late rows in the middle
    held = {r[:3]: r for r in every}
    some = draw.sample(sorted(held), 4) + [("Entity 1", 2001, m) for m in (3, 4)] + [("Newcomer", 2001, 9)]
    for key in some:
        held[key] = (*key, draw.uniform(0, 90), draw.choice([None, -5.0, 7.0]), 0.5, 1.0, draw.choice([None, 33.0]), 3, 1)
    landed = spark.createDataFrame([held[k] for k in set(some)], SCHEMA)
    store.land(landed)
    check(spark, store, list(held.values()))
    assert store.changed(spark.createDataFrame(list(held.values()), SCHEMA)).isEmpty()


def test_a_new_month_rewrites_itself_only(spark, tmp_path):
    every = random_rows(8)
    newest = max((r[1], r[2]) for r in every)
    store = StoredPanel(spark, str(tmp_path / "store"))
    store.land(spark.createDataFrame([r for r in every if (r[1], r[2]) < newest], SCHEMA))
    last = spark.createDataFrame([r for r in every if (r[1], r[2]) == newest], SCHEMA)
    assert store.land(last) == [newest]
    assert store.land(last) == [newest]  # a repeated landing
    check(spark, store, every)
    assert store.land(last.limit(0)) == []


def test_a_correction_rewrites_until_its_effect_ends(spark, tmp_path):
    every = [("A", 2000 + i // 12, i % 12 + 1, 1.0, -1.0 if 5 <= i < 20 else 2.0, 0.1, 0.0, 9.0, 1, 0) for i in range(36)]
    store = StoredPanel(spark, str(tmp_path / "store"))
    store.land(spark.createDataFrame(every, SCHEMA))
    fixed = (*every[10][:4], 3.0, *every[10][5:])
    months = store.land(spark.createDataFrame([fixed], SCHEMA))
    assert [y * 12 + m - 24001 for y, m in months] == list(range(10, 21))
    check(spark, store, [*every[:10], fixed, *every[11:]])


def partitions_read(df):
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_serving_reads_one_partition(spark, tmp_path):
    store = StoredPanel(spark, str(tmp_path / "store"))
    store.land(spark.createDataFrame([(*r[:7], 30.0, *r[8:]) for r in random_rows(5)], SCHEMA))
    year, month = store.newest()
    scan = partitions_read(store.latest())[0]
    assert f"= {year})" in scan and f"= {month})" in scan
    scan = partitions_read(store.entity("entity 2"))[0]
    assert "(bucket#" in scan and "= " in scan
    # the rows of a name lie in the bucket that the name is looked up in
    assert store.entity("ENTITY 2").count() == store.panel().where("county_name = 'Entity 2'").count() > 0


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    write_partitions(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int"), path, "p")
    write_partitions(spark.createDataFrame([(3, "c", 2)], "k int, v string, p int"), path, "p")
    assert rows(spark.read.parquet(path).select("k", "v", "p")) == [(1, "a", 1), (3, "c", 2)]


def test_raw_columns_are_those_of_the_feed_join():
    assert set(RAW) == {c.strip().split(" ")[0] for c in SCHEMA.split(",")} - {"county_name", "year", "month"}

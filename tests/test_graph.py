import json
import math
import random

import pytest
from frame_rows import rows
from pyspark.sql import functions as F

from harbinger.operators import neighbours as G
from harbinger.operators import quality as Q
from harbinger.sources import dimension as D

PILOT = ["Turkana", "Marsabit", "Mandera", "Garissa", "Baringo"]
TOUCHING = [("Turkana", "Marsabit"), ("Marsabit", "Turkana"), ("Marsabit", "Mandera"), ("Mandera", "Marsabit")]


def brute(points, k):
    out = []
    for name, x, y in points:
        near = sorted((math.sqrt((a - x) ** 2 + (b - y) ** 2), n) for n, a, b in points if n != name)[:k]
        out += [(name, n) for _, n in near]
    return sorted(out)


def clustered(seed):
    """A third of the sites at one spot, a tight cluster, and sparse far ones."""
    r = random.Random(seed)
    pts = [(f"h{i:03d}", 5.0, 5.0) for i in range(60)]
    pts += [(f"c{i:03d}", 100 + r.random() * 1e-3, 100 + r.random() * 1e-3) for i in range(60)]
    pts += [(f"s{i:03d}", r.uniform(-5000, 5000), r.uniform(-5000, 5000)) for i in range(60)]
    return pts


@pytest.mark.parametrize("k", [1, 2, 5])
def test_nearest_is_exact_under_skew(spark, k):
    pts = clustered(k)
    sites = spark.createDataFrame(pts, "name string, x double, y double")
    got = rows(G.nearest_edges(sites, k).select("src", "dst"))
    assert got == brute(pts, k)


def test_nearest_with_fewer_sites_than_k(spark):
    pts = [("a", 0.0, 0.0), ("b", 1.0, 0.0)]
    sites = spark.createDataFrame(pts, "name string, x double, y double")
    assert rows(G.nearest_edges(sites, 3).select("src", "dst")) == [("a", "b"), ("b", "a")]
    assert G.nearest_edges(sites.limit(1), 2).count() == 0


def test_planar_and_great_circle_order_agree(spark, dim):
    sites = G.sites_from_dimension(dim)
    pairs = dim.select(F.lit("Garissa").alias("src"), F.col("canonical_name").alias("dst")).where("dst <> 'Garissa'")
    km = {r["dst"]: r["dist_km"] for r in G.distance_table(sites, pairs).collect()}
    assert 355 < km["Marsabit"] < 370 and 410 < km["Baringo"] < 430
    a = dim.where("canonical_name = 'Garissa'").first()
    hav = dim.withColumn("d", G.haversine_km(F.lit(a["centroid_lat"]), F.lit(a["centroid_lon"]), F.col("centroid_lat"), F.col("centroid_lon")))
    for r in hav.where("canonical_name <> 'Garissa'").collect():
        assert abs(km[r["canonical_name"]] - r["d"]) / r["d"] < 0.01


def test_effective_edges_of_the_pilot(spark, dim):
    active = spark.createDataFrame([(n,) for n in PILOT], "county_name string")
    touch = spark.createDataFrame([*TOUCHING, ("Turkana", "West Pokot")], "src string, dst string")
    got = rows(G.effective_edges(active, touch, G.sites_from_dimension(dim), k=2))
    assert [r for r in got if r[2] == "contiguity"] == sorted((a, b, "contiguity") for a, b in TOUCHING)
    assert ("Garissa", "Marsabit", "knn") in got and ("Garissa", "Baringo", "knn") in got
    assert len([r for r in got if r[0] == "Garissa"]) == 2 and not [r for r in got if r[1] == "West Pokot"]


def test_contiguity_from_polygons(spark, tmp_path, dim):
    def square(x, y):
        return [[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]

    feats = [
        {"type": "Feature", "properties": {"county_name": n}, "geometry": {"type": t, "coordinates": c}}
        for n, t, c in [
            ("A", "Polygon", [square(0, 0)]), ("B", "Polygon", [square(1, 0)]), ("C", "Polygon", [square(2, 1)]),
            ("D", "MultiPolygon", [[square(10, 10)], [square(3, 2)]]),
        ]
    ]
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    shapes = D.load_boundaries(spark, str(path), dim)
    got = rows(G.contiguity_edges(D.ring_vertices(shapes)))
    assert got == [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "C")]


def test_points_stand_in_for_absent_polygons(spark, dim):
    shapes = D.load_boundaries(spark, "/nowhere/b.geojson", dim)
    assert shapes.count() == 47
    assert G.contiguity_edges(D.ring_vertices(shapes)).count() == 0


def sample(spark):
    return spark.createDataFrame(
        [
            ("Turkana", "2024-01-01", -15.0, -5.0, 12.0, 3.0), ("Marsabit", "2024-01-01", -25.0, -12.0, 8.0, 3.0),
            ("Turkana", "2024-02-01", 10.0, 2.0, 2.0, 2.0), ("Marsabit", "2024-02-01", 5.0, None, 1.0, 3.0),
            ("Lamu", "2024-02-01", 7.0, 1.0, 3.0, 4.0),
        ],
        "county_name string, observation_date string, rainfall_anomaly_lag1 double, ndvi_anomaly_lag1 double, "
        "maize_price_change_1m double, previous_ipc_phase double",
    )


def test_neighbour_means(spark):
    edges = spark.createDataFrame(
        [("Turkana", "Marsabit"), ("Marsabit", "Turkana"), ("Marsabit", "Lamu")], "src string, dst string")
    out = G.neighbour_features(sample(spark), edges)
    got = {(r["county_name"], r["observation_date"]): r for r in out.collect()}
    assert len(got) == 5
    a = got["Marsabit", "2024-02-01"]
    assert (a["neighbour_mean_rainfall_anomaly"], a["neighbour_mean_previous_risk"]) == (8.5, 3.0)
    assert a["number_of_high_risk_neighbours"] == 1
    b = got["Turkana", "2024-02-01"]   # the only neighbour has no vegetation value: default 0
    assert b["neighbour_mean_ndvi_anomaly"] == 0.0 and b["number_of_high_risk_neighbours"] == 1
    c = got["Lamu", "2024-02-01"]      # no edge: its own values, count 0
    assert (c["neighbour_mean_rainfall_anomaly"], c["neighbour_mean_previous_risk"], c["number_of_high_risk_neighbours"]) == (7.0, 4.0, 0)
    assert all(r["n_bad"] == 0 for r in Q.neighbour_check(out).collect())
    assert {r["problem"] for r in Q.neighbour_check(sample(spark)).collect()} == {"missing"}


def test_repeated_rows_count_once(spark):
    """Horizon copies of an entity-month do not change a mean."""
    edges = spark.createDataFrame([("Turkana", "Marsabit")], "src string, dst string")
    once = G.neighbour_features(sample(spark), edges)
    copies = sample(spark).withColumn("h", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("h")
    thrice = G.neighbour_features(copies, edges)
    assert set(rows(once)) == set(rows(thrice)) and thrice.count() == 15


def test_input_resolution():
    assert G.resolve_inputs(["ndvi_anomaly", "ndvi_trend_3m", "ipc_phase"]) == {
        "ndvi_anomaly": "ndvi_anomaly", "previous_risk": "ipc_phase"}


def test_pivot(spark):
    got = G.value_by_entity(sample(spark), "ndvi_anomaly_lag1", ["Turkana", "Lamu"]).orderBy("observation_date").collect()
    assert [tuple(r) for r in got] == [("2024-01-01", -5.0, None), ("2024-02-01", 2.0, 1.0)]


def test_regions_that_touch_in_any_way(spark):
    def box(name, x1, y1, x2, y2):
        return name, [[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]]

    shapes = [
        box("a", 0.0, 0.0, 2.0, 2.0),
        box("b", 2.0, 0.5, 4.0, 1.5),  # part of an edge
        box("c", 4.0, 1.5, 5.0, 3.0),  # a corner
        box("d", 1.0, 1.0, 3.0, 3.0),  # crosses a and b
        box("e", 0.25, 0.25, 0.5, 0.5),  # inside a
        box("f", 9.0, 9.0, 9.5, 9.5),
        ("g", [[(2.0, 2.0)]]),  # a point on the corner of a, inside d
        ("h", []),
        (None, [[(0.0, 0.0), (1.0, 1.0)]]),
    ]
    frame = spark.createDataFrame(shapes, "name string, rings array<array<struct<lon: double, lat: double>>>")
    want = {("a", "b"), ("b", "c"), ("a", "d"), ("b", "d"), ("a", "e"), ("a", "g"), ("d", "g")}
    got = {tuple(r) for r in G.polygon_contiguity(frame).collect()}
    assert got == want | {(q, p) for p, q in want}
    assert G.polygon_contiguity(frame.limit(0)).collect() == []


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Broadcast" in plan, plan.count("SortMergeJoin")


def test_nearest_sites_are_joined_by_key_whatever_the_estimate(spark):
    """A file of a few MB unfolds to millions of cells, which must not pass the driver."""
    sites = spark.range(50).select(
        F.concat(F.lit("s"), "id").alias("name"), F.col("id").cast("double").alias("x"), (F.col("id") * 7 % 11).cast("double").alias("y")
    )
    assert joins(G.nearest_edges(sites, 2)) == (False, 3)
    got = rows(G.nearest_edges(sites, 2).select("src", "dst"))
    assert got == brute([tuple(r) for r in sites.collect()], 2)


def test_regions_are_joined_by_key_whatever_the_estimate(spark):
    corner = [F.struct((F.col("id") + a).cast("double").alias("lon"), F.lit(b).alias("lat")) for a, b in ((0, 0.0), (1, 0.0), (1, 1.0))]
    shapes = spark.range(5).select(F.col("id").cast("string").alias("name"), F.array(F.array(*corner)).alias("rings"))
    assert joins(G.polygon_contiguity(shapes)) == (False, 3)
    assert rows(G.polygon_contiguity(shapes)) == sorted((str(i), str(j)) for i in range(5) for j in range(5) if abs(i - j) == 1)

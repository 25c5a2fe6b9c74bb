"""Region graph: contiguity, distances, nearest neighbours and neighbour means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger import fixed_values as V


def resolve_inputs(columns: Sequence[str]) -> dict[str, str]:
    """First column present for each neighbour measure."""
    found = {}
    for measure, candidates in V.NEIGHBOUR_INPUTS.items():
        present = [c for c in candidates if c in columns]
        if present:
            found[measure] = present[0]
    return found


def neighbour_features(
    df: DataFrame,
    edges: DataFrame,
    entity: str = "county_name",
    date: Sequence[str] = ("observation_date",),
    decimals: int = 3,
) -> DataFrame:
    """Per entity and date, the means over its neighbours' values at that date.

    ``edges`` is ``(src, dst)`` restricted to active entities. Values are reduced
    to one row per (entity, date) first; the edge join and the regrouping then run
    on that reduced table with map-side partial sums. An entity without any edge
    keeps its own values.
    """
    date = list(date)
    source = resolve_inputs(df.columns)
    # copies of one entity-date (one per horizon) carry equal values
    reduced = df.groupBy(entity, *date).agg(
        *[F.max(c).alias(f"_v_{m}") for m, c in source.items()]
    )
    pairs = edges.select("src", "dst").distinct()
    around = (
        pairs.join(reduced.withColumnRenamed(entity, "dst"), "dst")
        .groupBy("src", *date)
        .agg(
            *[F.avg(f"_v_{m}").alias(f"_n_{m}") for m in source],
            F.count_if(F.col("_v_previous_risk") >= 3).alias("_n_high"),
        )
        .withColumnRenamed("src", entity)
    )
    linked = pairs.select(F.col("src").alias(entity)).distinct().withColumn("_linked", F.lit(True))
    joined = df.join(linked, entity, "left").join(around, [entity, *date], "left")

    def mean(measure: str) -> Column:
        fallback = F.lit(V.NEIGHBOUR_DEFAULTS[measure])
        if measure not in source:
            return fallback
        value = F.when(
            F.col("_linked"), F.coalesce(F.col(f"_n_{measure}"), fallback)
        ).otherwise(F.col(source[measure]).cast("double"))
        return F.bround(value, decimals)

    out = joined.withColumns(
        {
            "neighbour_mean_rainfall_anomaly": mean("rainfall_anomaly"),
            "neighbour_mean_ndvi_anomaly": mean("ndvi_anomaly"),
            "neighbour_mean_price_change": mean("price_change"),
            "neighbour_mean_previous_risk": mean("previous_risk"),
            "number_of_high_risk_neighbours": F.coalesce("_n_high", F.lit(0)).cast("int"),
        }
    )
    return out.select(*df.columns, *V.NEIGHBOUR_COLUMNS)


def contiguity_edges(vertices: DataFrame, decimals: int = 6) -> DataFrame:
    """Queen contiguity from ring vertices ``(name, lon, lat)``.

    Two regions that share a vertex are neighbours: an equi-join on the vertex, so
    no region pair is compared that does not touch. Exact for vertex-aligned
    boundaries. Repeated vertices of a ring are dropped before the join.
    """
    points = vertices.select(
        "name",
        F.round("lon", decimals).alias("lon"),
        F.round("lat", decimals).alias("lat"),
    ).distinct()
    other = points.withColumnRenamed("name", "dst")
    return (
        points.withColumnRenamed("name", "src")
        .join(other, ["lon", "lat"])
        .where(F.col("src") != F.col("dst"))
        .select("src", "dst")
        .distinct()
    )


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt out by key, never sent whole to driver and tasks.

    Spark's size estimate follows the compressed file and not the rows that sequences
    and ring points unfold to, so by it a large frame may pass for one to broadcast.
    """
    return df.hint("merge")


def _cells(df: DataFrame, size: Column, *carried: str) -> DataFrame:
    """Rows with a box (x1, y1, x2, y2) entered under every grid cell the box meets."""
    def span(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))

    wide = df.withColumn("cx", F.explode(span("x1", "x2")))
    return wide.select(*carried, "x1", "y1", "x2", "y2", "cx", F.explode(span("y1", "y2")).alias("cy"))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _segments_meet(s: str, t: str) -> Column:
    """Whether two closed segments have a point in common."""
    a = [F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")]
    b = [F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")]
    boxes = (
        (F.least(a[0], a[2]) <= F.greatest(b[0], b[2])) & (F.least(b[0], b[2]) <= F.greatest(a[0], a[2]))
        & (F.least(a[1], a[3]) <= F.greatest(b[1], b[3])) & (F.least(b[1], b[3]) <= F.greatest(a[1], a[3]))
    )
    across = (_side(*a, b[0], b[1]) * _side(*a, b[2], b[3]) <= 0) & (_side(*b, a[0], a[1]) * _side(*b, a[2], a[3]) <= 0)
    return boxes & across


def polygon_contiguity(boundaries: DataFrame) -> DataFrame:
    """Contiguity of regions ``(name, rings)`` that touch or overlap in any point.

    Shared vertices, shared parts of an edge, crossings and regions inside another all
    count. Boundary segments meet through an equi-join on grid cells about two mean
    segments wide; a region without any meeting segment is tried as a whole inside
    the regions whose box covers one of its vertices, by counting crossings of a ray.
    Each unordered pair is compared once. Holes are not treated apart: a region in a
    hole counts as inside only if an odd number of rings surrounds it.
    """
    rings = boundaries.select("name", F.posexplode("rings").alias("ring", "points"))
    points = rings.where(F.size("points") > 0)
    after = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    segments = points.select(
        "name", F.inline(F.transform(F.arrays_zip("points", after.alias("after")), lambda p: F.struct(
            p["points"]["lon"].alias("x1"), p["points"]["lat"].alias("y1"),
            p["after"]["lon"].alias("x2"), p["after"]["lat"].alias("y2"),
        ))),
    ).distinct()
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    # a zero extent (points only) leaves cells of one unit
    size = segments.agg(F.coalesce(F.nullif(2 * F.avg(extent), F.lit(0.0)), F.lit(1.0)).alias("size")).scalar()

    entered = _cells(segments, size, "name")
    meet = (
        entered.alias("s").join(_dealt(entered).alias("t"), ["cx", "cy"])
        .where((F.col("s.name") < F.col("t.name")) & _segments_meet("s", "t"))
        .select(F.col("s.name").alias("a"), F.col("t.name").alias("b")).distinct()
    )
    box = segments.groupBy("name").agg(
        F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"),
        F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"),
    )
    corner = segments.groupBy("name").agg(F.min(F.struct("x1", "y1")).alias("p")).select(
        F.col("name").alias("inner"), F.col("p.x1").alias("px"), F.col("p.y1").alias("py")
    )
    spots = corner.withColumn("cx", F.floor(F.col("px") / size)).withColumn("cy", F.floor(F.col("py") / size))
    covered = (
        spots.join(_dealt(_cells(box, size, "name")), ["cx", "cy"])
        .where((F.col("inner") != F.col("name")) & F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2")))
        .select("inner", "name", "px", "py")
    )
    above = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    at = F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    inside = (
        covered.join(_dealt(segments), "name").groupBy("inner", "name")
        .agg(F.count_if(above & (F.col("px") < at)).alias("n")).where("n % 2 = 1")
        .select(F.least("inner", "name").alias("a"), F.greatest("inner", "name").alias("b"))
    )
    pairs = meet.union(inside).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def utm_km(lat: Column, lon: Column, central_meridian: float = 39.0) -> tuple[Column, Column]:
    """Transverse Mercator easting and northing in km (WGS 84, scale 0.9996).

    Snyder's series; planar distances are Euclidean in these coordinates.
    """
    a, f, k0 = 6378.137, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    d = F.cos(phi) * F.radians(lon - central_meridian)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (
        d
        + (1 - t + c) * F.pow(d, 3) / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(d, 5) / 120
    )
    north = k0 * (
        m
        + n * F.tan(phi) * (
            d * d / 2
            + (5 - t + 9 * c + 4 * c * c) * F.pow(d, 4) / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(d, 6) / 720
        )
    )
    return east, north


def sites_from_dimension(dim: DataFrame) -> DataFrame:
    """Planar site table ``(name, x, y)`` of the dimension's centroids."""
    east, north = utm_km(F.col("centroid_lat"), F.col("centroid_lon"))
    return dim.select(F.col("canonical_name").alias("name"), east.alias("x"), north.alias("y"))


def planar_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def nearest_edges(
    sites: DataFrame, k: int = 2, levels: int = 20, origins: DataFrame | None = None
) -> DataFrame:
    """The ``k`` nearest other sites of every site, exactly, by grid equi-joins.

    Space is cut into square cells, each level a quarter as wide. A site uses the finest level
    whose 3x3 block of cells around it holds more than ``k`` sites: its k-th
    neighbour is then at most ``2 * sqrt(2)`` cells away, so the 7x7 block at that
    level is sure to contain all k nearest and only those sites are compared. Level
    0 is one cell over everything, so every site finds a level; nothing is capped.

    A dense cluster settles on fine cells, so its members see each other only nearby;
    at the level a sparse site settles on, only the few sites within three cells of a
    cluster have it among their candidates. Work therefore grows with the number of
    sites, not its square. ``levels`` sets the finest cell: with 20 it is 2**-38 of the
    extent, near the resolution of the coordinates.

    Sites at the same spot are collapsed to the ``k + 1`` smallest names, which is
    all any ranking by (distance, name) can ever use, and spread out again at the
    end. ``sites`` has ``(name, x, y)``; ``origins`` limits the sources by ``name``.
    """
    box = sites.agg(
        F.struct(
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            F.greatest(
                F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)
            ).alias("size"),
        ).alias("box")
    ).scalar()
    by_name = Window.partitionBy("x", "y").orderBy("name")
    spots = (
        sites.select("name", "x", "y")
        .withColumn("_rank", F.row_number().over(by_name))
        .where(F.col("_rank") <= k + 1)
        .groupBy("x", "y")
        .agg(F.sort_array(F.collect_list("name")).alias("names"))
    )
    gridded = (
        spots.withColumn("_box", box)
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        .withColumn("_cell", F.col("_box.size") / F.pow(F.lit(4.0), F.col("level")))
        .select(
            "x", "y", "names", "level",
            F.floor((F.col("x") - F.col("_box.x")) / F.col("_cell")).alias("cx"),
            F.floor((F.col("y") - F.col("_box.y")) / F.col("_cell")).alias("cy"),
        )
    )

    def spread(df: DataFrame, reach: int) -> DataFrame:
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        return (
            df.withColumn("_dx", F.explode(steps))
            .withColumn("_dy", F.explode(steps))
            .withColumns({"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")})
            .drop("_dx", "_dy")
        )

    crowded = (
        spread(
            gridded.groupBy("level", "cx", "cy").agg(F.sum(F.size("names")).alias("n")), 1
        )
        .groupBy("level", "cx", "cy")
        .agg(F.sum("n").alias("near"))
        .where((F.col("near") > k) | (F.col("level") == 0))
        .select("level", "cx", "cy")
    )
    sources = gridded
    if origins is not None:
        wanted = sites.join(origins.select("name"), "name", "left_semi").select("x", "y").distinct()
        sources = gridded.join(_dealt(wanted), ["x", "y"], "left_semi")
    at_level = (
        sources.join(_dealt(crowded), ["level", "cx", "cy"])
        .groupBy("x", "y")
        .agg(F.max(F.struct("level", "cx", "cy")).alias("_at"))
        .select(F.col("x").alias("sx"), F.col("y").alias("sy"), "_at.*")
    )
    candidates = (
        spread(at_level, 3)
        .join(_dealt(gridded), ["level", "cx", "cy"])
        .withColumn("dist_km", planar_km(F.col("sx"), F.col("sy"), F.col("x"), F.col("y")))
        .select("sx", "sy", "dist_km", F.explode("names").alias("name"))
    )
    order = Window.partitionBy("sx", "sy").orderBy("dist_km", "name")
    listed = (
        candidates.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k + 1)
        .groupBy(F.col("sx").alias("x"), F.col("sy").alias("y"))
        .agg(F.sort_array(F.collect_list(F.struct("dist_km", "name"))).alias("listed"))
    )
    start = sites if origins is None else sites.join(origins.select("name"), "name", "left_semi")
    picked = F.slice(F.filter("listed", lambda c: c["name"] != F.col("name")), 1, k)
    return (
        start.join(_dealt(listed), ["x", "y"])
        .select(F.col("name").alias("src"), F.posexplode(picked).alias("_pos", "_to"))
        .select(
            "src",
            F.col("_to.name").alias("dst"),
            F.lit("knn").alias("kind"),
            F.col("_to.dist_km").alias("dist_km"),
            (F.col("_pos") + 1).alias("rank"),
        )
    )


def distance_table(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Planar distance of each wanted ``(src, dst)`` pair."""
    a = sites.select(F.col("name").alias("src"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    b = sites.select(F.col("name").alias("dst"), F.col("x").alias("_x2"), F.col("y").alias("_y2"))
    return (
        pairs.join(a, "src")
        .join(b, "dst")
        .select(
            "src", "dst",
            planar_km(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")).alias("dist_km"),
        )
    )


def effective_edges(
    active: DataFrame, contiguity: DataFrame, sites: DataFrame, k: int = 2, levels: int = 20
) -> DataFrame:
    """Contiguity edges among the active entities; nearest sites for those without any."""
    names = active.select(F.col("county_name").alias("name")).distinct()
    touching = (
        contiguity.select("src", "dst")
        .join(names.withColumnRenamed("name", "src"), "src", "left_semi")
        .join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
        .distinct()
    )
    alone = names.join(touching.select(F.col("src").alias("name")), "name", "left_anti")
    here = sites.join(names, "name", "left_semi")
    fallback = nearest_edges(here, k, levels, origins=alone)
    return (
        touching.select("src", "dst", F.lit("contiguity").alias("kind"))
        .unionByName(fallback.select("src", "dst", "kind"))
    )


def value_by_entity(
    df: DataFrame, value: str, entities: Sequence[str], date: str = "observation_date"
) -> DataFrame:
    """Date rows by entity columns with one known value each, for export.

    Where a date has several values of an entity the smallest is taken, so the result
    does not depend on the order of rows.
    """
    return (
        df.groupBy(date)
        .pivot("county_name", list(entities))
        .agg(F.min(value))
    )

"""District polygons: membership, overlaps, bounds, areas and grid checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.operators import proximity

POINTS = "array<array<array<array<double>>>>"


def polygons(districts: DataFrame, id_col: str = "district_id", geojson: str = "geojson") -> DataFrame:
    """(region, parts): the parts of each region as arrays of rings of [x, y]; text that is no polygon has none."""
    kind = F.get_json_object(geojson, "$.type")
    coords = F.get_json_object(geojson, "$.coordinates")
    multi = F.when(kind == "MultiPolygon", F.from_json(coords, POINTS)).when(kind == "Polygon", F.array(F.from_json(coords, "array<array<array<double>>>")))
    return districts.select(F.col(id_col).alias("region"), F.coalesce(multi, F.array().cast(POINTS)).alias("parts"))


def edges(districts: DataFrame, id_col: str = "district_id", geojson: str = "geojson") -> DataFrame:
    """(region, part, ring, ax, ay, bx, by): the edges of every ring of every part, without those of no length."""
    parts = polygons(districts, id_col, geojson).select("region", F.posexplode("parts").alias("part", "rings"))
    rings = parts.select("region", "part", F.posexplode("rings").alias("ring", "pts"))
    pairs = rings.select("region", "part", "ring", F.explode(F.arrays_zip(F.expr("slice(pts, 1, size(pts) - 1)").alias("a"), F.expr("slice(pts, 2, size(pts) - 1)").alias("b"))).alias("e"))
    return pairs.select("region", "part", "ring", F.col("e.a")[0].alias("ax"), F.col("e.a")[1].alias("ay"), F.col("e.b")[0].alias("bx"), F.col("e.b")[1].alias("by")).filter("ax <> bx or ay <> by")


def bounds(districts: DataFrame) -> DataFrame:
    """(region, x0, y0, x1, y1): the bounding box of each region."""
    return edges(districts).groupBy("region").agg(*[f(c).alias(n) for f, c, n in ((F.min, "ax", "x0"), (F.min, "ay", "y0"), (F.max, "ax", "x1"), (F.max, "ay", "y1"))])


def areas(districts: DataFrame) -> DataFrame:
    """(region, km2): shoelace area, the outer ring of every part less its openings, with degrees scaled at the mean latitude."""
    rings = edges(districts).groupBy("region", "part", "ring").agg(F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("deg2"), F.avg("ay").alias("lat"), F.max("ay").alias("top"))
    solid = F.when(ring_is_outer(), F.col("deg2")).otherwise(-F.col("deg2"))
    return rings.groupBy("region").agg(F.round(F.sum(solid * 111.32 * 111.32 * F.cos(F.radians("lat"))), 6).alias("km2"))


def ring_is_outer() -> Column:
    """The first ring of each part is outer, later ones are its openings."""
    return F.col("ring") == 0


def depth_in_regions(points: DataFrame, id_col: str, districts: DataFrame) -> DataFrame:
    """(id, region, depth_m): for each point in several regions, its distance to the nearest edge of each."""
    inside = proximity.points_in_regions(points, id_col, districts, "district_id", "geojson")
    inside = inside.join(inside.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "id", "left_semi")
    pos = proximity.positioned(points, id_col)
    e = edges(districts)
    x, y = F.col("lon"), F.col("lat")
    kx = F.lit(111320.0) * F.cos(F.radians("lat"))
    dx, dy = (F.col("bx") - F.col("ax")) * kx, (F.col("by") - F.col("ay")) * 111320.0
    px, py = (x - F.col("ax")) * kx, (y - F.col("ay")) * 111320.0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))
    far = F.hypot(px - t * dx, py - t * dy)
    return inside.join(pos, "id").join(e, "region").groupBy("id", "region").agg(F.round(F.min(far), 3).alias("depth_m"))


def best_region(points: DataFrame, id_col: str, districts: DataFrame) -> DataFrame:
    """(id, region, quality): the region a point lies in, the deepest where several hold it (ties by id).

    quality: EXACT, AMBIGUOUS, OUTSIDE, NO_COORDINATES.
    """
    inside = proximity.points_in_regions(points, id_col, districts, "district_id", "geojson")
    depth = inside.join(depth_in_regions(points, id_col, districts), ["id", "region"], "left")
    top = depth.groupBy("id").agg(F.max_by("region", F.struct("depth_m", (-F.col("region")).alias("r"))).alias("region"), F.count("*").alias("n"))
    pos = proximity.positioned(points, id_col).select("id").withColumn("placed", F.lit(True))
    all_ = points.select(F.col(id_col).cast("long").alias("id")).distinct()
    out = all_.join(pos.distinct(), "id", "left").join(top, "id", "left")
    quality = F.when(F.col("placed").isNull(), "NO_COORDINATES").when(F.col("region").isNull(), "OUTSIDE").when(F.col("n") > 1, "AMBIGUOUS").otherwise("EXACT")
    return out.select("id", "region", quality.alias("quality"))


def grid_cells(districts: DataFrame, step: float) -> DataFrame:
    """(cell_id, latitude, longitude): the corners of a grid over all regions."""
    box = bounds(districts).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    cells = box.select("x0", "y0", F.explode(F.sequence(F.lit(0), F.floor((F.col("x1") - F.col("x0")) / step).cast("int"))).alias("i"), "y1").select("x0", "y0", "i", F.explode(F.sequence(F.lit(0), F.floor((F.col("y1") - F.col("y0")) / step).cast("int"))).alias("j"))
    return cells.select((F.col("i") * 1_000_000 + F.col("j")).cast("long").alias("cell_id"), (F.col("y0") + F.col("j") * step).alias("latitude"), (F.col("x0") + F.col("i") * step).alias("longitude"))


def _claimed(districts: DataFrame, step: float) -> DataFrame:
    return proximity.points_in_regions(grid_cells(districts, step), "cell_id", districts, "district_id", "geojson")


def grid_claims(districts: DataFrame, step: float) -> DataFrame:
    """(claims, cells): how many cells of a grid over all regions lie in so many of them, by the cell's corner."""
    return _claimed(districts, step).groupBy("id").agg(F.count("*").alias("claims")).groupBy("claims").agg(F.count("*").alias("cells"))


def pair_overlaps(districts: DataFrame, step: float) -> DataFrame:
    """(region_a, region_b, cells, per_mille): the cells that two regions claim both, and their share of those that the first claims."""
    held = _claimed(districts, step)
    own = held.groupBy(F.col("region").alias("region_a")).agg(F.count("*").alias("own"))
    a, b = held.withColumnRenamed("region", "region_a"), held.withColumnRenamed("region", "region_b")
    pairs = a.join(b, "id").filter("region_a < region_b").groupBy("region_a", "region_b").agg(F.count("*").alias("cells"))
    return pairs.join(own, "region_a").select("region_a", "region_b", "cells", F.floor(1000 * F.col("cells") / F.col("own") + 0.5).alias("per_mille"))


def region_check(districts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, state): for each expected name MISSING, where no region has it; BROKEN, where its shape has no edges or no finite bounds; GOOD."""
    box = edges(districts, "district_name").groupBy("region").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("ax", "ay")])
    finite = F.lit(True)
    for c in box.columns[1:]:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e6)
    known = districts.select(F.col("district_name").alias("name"), F.lit(True).alias("known")).distinct()
    joined = names.select("name").distinct().join(known, "name", "left").join(box.withColumnRenamed("region", "name"), "name", "left")
    return joined.select("name", F.when(F.col("known").isNull(), "MISSING").when(F.coalesce(finite, F.lit(False)), "GOOD").otherwise("BROKEN").alias("state"))

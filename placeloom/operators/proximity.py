"""Points near other points, and points inside regions.

Positions are encoded as Morton (Z-order) codes of a fine grid. A disc or a region is
covered by ranges of codes; the ranges of a coarse cell meet its points, sorted by code,
between the ends of the range; what is left is tested exactly.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRES_PER_DEGREE = 111320.0
#: Bits a coordinate has in the finest grid: 360 degrees / 2**26 is about 0.6 m.
FINE_BITS = 26
#: Points of one cell that one task joins; larger cells are split by salt.
CELL_POINTS = 20_000
#: Pairs of a range and a point that a task tests at a time.
JOIN_PAIRS = 1_000_000


def usable_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> tuple[Column, Column]:
    """Latitude and longitude, swapped back where latitude lies between 36 and 39.5."""
    a, b = F.col(lat).cast("double"), F.col(lon).cast("double")
    swapped = a.between(36.0, 39.5)
    return F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)


def positioned(df: DataFrame, id_col: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(id, lat, lon) of the rows with an id and two coordinates that are neither missing, NaN nor zero."""
    y, x = usable_coordinates(df, lat, lon)
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (c != 0) & (F.abs(c) <= 180)
    return df.select(F.col(id_col).cast("long").alias("id"), y.alias("lat"), x.alias("lon")).filter(ok(F.col("lat")) & ok(F.col("lon")) & F.col("id").isNotNull())


def grid(c: Column, bits: int = FINE_BITS) -> Column:
    """The cell of a coordinate in degrees, from 0."""
    cells = 1 << bits
    return F.least(F.lit(cells - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((c + 180.0) * (cells / 360.0))))


def _spread(c: Column) -> Column:
    """A zero bit put between the bits of a number of up to 26 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column) -> Column:
    """The Z-order code of a cell. It grows with x and with y, so a box lies between the codes of its corners."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def near_pairs(df: DataFrame, id_col: str, radius_m: float, lat: str = "latitude", lon: str = "longitude", cell_points: int = CELL_POINTS) -> DataFrame:
    """(id_a, id_b, metres): each pair of rows at most ``radius_m`` apart, id_a < id_b.

    metres = hypot(dlat * 111320, dlon * 111320 * cos(lat_a)). Rows without usable coordinates
    are in no pair; rows at one position are pairs; a repeated id is no pair with itself.

    The disc around a is cut at the borders of cells of at least twice the radius, so it is one to
    four ranges of codes, each inside a cell. The points of a cell are sorted by code, and a range
    finds its points between two places of that order; then the distance is tested. Cells with more
    than ``cell_points`` rows are split: b keeps one salt of several, a is repeated for each, so a
    task holds the points of one such part only and the ranges stream past them.
    """
    pts = positioned(df, id_col, lat, lon)
    cells_lat = 360.0 * METRES_PER_DEGREE / (2 * radius_m)
    bits = max(1, min(FINE_BITS, int(math.log2(cells_lat))))
    drop = FINE_BITS - bits
    dlat = radius_m / METRES_PER_DEGREE * (1 + 1e-9) + 1e-12
    b = pts.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), grid(F.col("lon")).alias("x"), grid(F.col("lat")).alias("y"))
    b = b.withColumn("code", morton(F.col("x"), F.col("y"))).withColumn("cell", F.shiftright("code", 2 * drop)).drop("x", "y")

    dlon = F.lit(dlat) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))
    box = pts.select(
        "id",
        "lat",
        "lon",
        *[grid(F.col("lon") + s * dlon).alias(n) for s, n in ((-1, "x0"), (1, "x1"))],
        *[grid(F.col("lat") + F.lit(s * dlat)).alias(n) for s, n in ((-1, "y0"), (1, "y1"))],
    )
    cover = box.withColumn("cx", F.explode(F.sequence(F.shiftright("x0", drop), F.shiftright("x1", drop)))).withColumn("cy", F.explode(F.sequence(F.shiftright("y0", drop), F.shiftright("y1", drop))))
    side = F.lit((1 << drop) - 1)
    part = lambda c, lo, up: (F.greatest(F.col(lo), F.shiftleft(c, drop)), F.least(F.col(up), F.shiftleft(c, drop) + side))
    (xa, xb), (ya, yb) = part(F.col("cx"), "x0", "x1"), part(F.col("cy"), "y0", "y1")
    a = cover.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), morton(F.col("cx"), F.col("cy")).alias("cell"), morton(xa, ya).alias("lo"), morton(xb, yb).alias("hi"))

    hot = b.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_points).select("cell", F.ceil(F.col("n") / cell_points).cast("int").alias("salts"))
    b = b.join(hot, "cell", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id_b"), F.col("salts")).cast("int"))).drop("salts")
    a = a.join(hot, "cell", "left").withColumn("salt", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1)))).drop("salts")
    # points and ranges of a cell lie together, the points first, both in the order of their codes
    points = b.select("cell", "salt", F.lit(0).alias("kind"), F.col("code").alias("lo"), F.col("code").alias("hi"), F.col("id_b").alias("id"), F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon"))
    ranges = a.select("cell", "salt", F.lit(1).alias("kind"), "lo", "hi", F.col("id_a").alias("id"), F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon"))
    laid = points.unionByName(ranges).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "lo")
    inner = 2 * drop

    def join(batches):
        held: dict[str, np.ndarray] | None = None  # the points of the cell that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_numpy() for n in ("cell", "salt", "kind", "lo", "hi", "id", "lat", "lon")}
            if held is not None and (held["cell"][0], held["salt"][0]) == (col["cell"][0], col["salt"][0]):
                col = {n: np.concatenate((held[n], col[n])) for n in col}
            cell, salt, point = col["cell"], col["salt"], col["kind"] == 0
            group = np.concatenate(([0], np.cumsum((cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1]))))
            low = (1 << inner) - 1
            key = (group[point] << inner) | (col["lo"][point] & low)
            asked = np.flatnonzero(~point)
            first = key.searchsorted((group[asked] << inner) | (col["lo"][asked] & low), "left")
            behind = key.searchsorted((group[asked] << inner) | (col["hi"][asked] & low), "right")
            of_b = np.flatnonzero(point)
            edge = np.cumsum(behind - first)
            at = 0
            while at < len(asked):
                to = max(at + 1, int(edge.searchsorted((edge[at - 1] if at else 0) + JOIN_PAIRS, "right")))
                many = behind[at:to] - first[at:to]
                i = np.repeat(asked[at:to], many)
                j = of_b[np.arange(len(i)) + np.repeat(first[at:to] - (np.cumsum(many) - many), many)]
                m = np.hypot((col["lat"][i] - col["lat"][j]) * METRES_PER_DEGREE, (col["lon"][i] - col["lon"][j]) * METRES_PER_DEGREE * np.cos(np.radians(col["lat"][i])))
                good = (col["id"][i] < col["id"][j]) & (m <= radius_m)
                yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (col["id"][i], col["id"][j], m)], names=["id_a", "id_b", "metres"])
                at = to
            last = point & (group == group[-1])
            held = {n: v[last] for n, v in col.items()} if last.any() else None

    return laid.mapInArrow(join, "id_a bigint, id_b bigint, metres double")


def rings_of(geojson: str | None) -> list[list[tuple[float, float]]]:
    """All rings of a GeoJSON Polygon or MultiPolygon as (x, y) lists; none for anything else."""
    try:
        g = json.loads(geojson or "")
        if g.get("type") == "Feature":
            g = g["geometry"]
        polys = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[g["type"]](g["coordinates"])
        return [[(float(p[0]), float(p[1])) for p in ring] for poly in polys for ring in poly if len(ring) >= 3]
    except (ValueError, KeyError, TypeError, IndexError, AttributeError):
        return []


def edges_of(rings: list[list[tuple[float, float]]]) -> list[tuple[float, float, float, float]]:
    """The edges of closed rings, without those of no length."""
    return [(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1]) if a != b]


def _meets(e: tuple[float, float, float, float], x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether an edge may meet a box: bounding boxes meet, and the corners are not all on one side."""
    ax, ay, bx, by = e
    if max(ax, bx) < x0 or min(ax, bx) > x1 or max(ay, by) < y0 or min(ay, by) > y1:
        return False
    s = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
    return min(s) <= 0 <= max(s)


def _inside(edges: list[tuple[float, float, float, float]], x: float, y: float) -> bool:
    odd = False
    for ax, ay, bx, by in edges:
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def region_ranges(rings: list[list[tuple[float, float]]], finest: int, block: int) -> Iterator[tuple[int, int, int, bool, list]]:
    """The cover of a region: (block, lo, hi, whole, edges).

    Quarters are split down to ``finest`` bits. A quarter that no edge meets is wholly inside or
    outside; a finest one that an edge meets keeps the edges that a ray to the right from inside it
    can cross. Ranges lie inside cells of ``block`` bits; neighbouring ranges wholly inside are joined.
    """
    edges = edges_of(rings)
    if not edges:
        return
    size = 360.0 / (1 << block)
    cell = lambda v: int(math.floor((v + 180.0) / size))
    xs, ys = [v for e in edges for v in (e[0], e[2])], [v for e in edges for v in (e[1], e[3])]
    eps = 360.0 / (1 << FINE_BITS)

    def split(x: int, y: int, bits: int, own: list) -> Iterator[tuple[int, int, bool, list]]:
        w = 360.0 / (1 << bits)
        x0, y0 = x * w - 180.0, y * w - 180.0
        own = [e for e in own if _meets(e, x0 - eps, y0 - eps, x0 + w + eps, y0 + w + eps)]
        code = _code(x, y) << 2 * (FINE_BITS - bits)
        last = code + (1 << 2 * (FINE_BITS - bits)) - 1
        if not own:
            if _inside(edges, x0 + w / 2, y0 + w / 2):
                yield code, last, True, []
        elif bits >= finest:
            yield code, last, False, [e for e in edges if max(e[1], e[3]) >= y0 - eps and min(e[1], e[3]) <= y0 + w + eps and max(e[0], e[2]) >= x0 - eps]
        else:
            for dy in (0, 1):
                for dx in (0, 1):
                    yield from split(2 * x + dx, 2 * y + dy, bits + 1, own)

    for cy in range(cell(min(ys)), cell(max(ys)) + 1):
        for cx in range(cell(min(xs)), cell(max(xs)) + 1):
            held = None
            for lo, hi, whole, own in split(cx, cy, block, edges):
                if held and whole and held[2] and held[1] + 1 == lo:
                    held = (held[0], hi, True, [])
                    continue
                if held:
                    yield (_code(cx, cy), *held)
                held = (lo, hi, whole, own)
            if held:
                yield (_code(cx, cy), *held)


def _code(x: int, y: int) -> int:
    out = 0
    for i in range(FINE_BITS):
        out |= ((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1)
    return out


EDGE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("ax", "ay", "bx", "by")])
COVER = T.StructType([T.StructField("region", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("block", "lo", "hi")), T.StructField("whole", T.BooleanType()), T.StructField("edges", T.ArrayType(EDGE))])


def cover_regions(regions: DataFrame, id_col: str, geojson: str, finest: int = 17, block: int = 13) -> DataFrame:
    """(region, block, lo, hi, whole, edges): the ranges that cover each region; made by the executors, a region at a time."""

    def run(frames):
        for pdf in frames:
            for rid, g in zip(pdf["id"], pdf["g"]):
                rows = [(rid, *r) for r in region_ranges(rings_of(g), finest, block)]
                for i in range(0, len(rows), 5000):
                    out = pd.DataFrame(rows[i : i + 5000], columns=["region", "block", "lo", "hi", "whole", "edges"])
                    out["edges"] = [[dict(zip(("ax", "ay", "bx", "by"), e)) for e in es] for es in out["edges"]]
                    yield out

    return regions.select(F.col(id_col).cast("long").alias("id"), F.col(geojson).alias("g")).filter("id is not null").mapInPandas(run, COVER)


def points_in_regions(df: DataFrame, id_col: str, regions: DataFrame, region_id: str, geojson: str, lat: str = "latitude", lon: str = "longitude", finest: int = 17, block: int = 13) -> DataFrame:
    """(id, region): each row with each region that holds it, borders included.

    Openings lie outside, by even-odd crossing over all rings. Rows without usable coordinates and
    regions whose GeoJSON cannot be read give no row. A region's ranges meet the points in a join on
    the cell of ``block`` bits with the code within the range; only points in a range that an edge
    meets are tested, against the few edges beside it. Skewed cells are left to the engine's skew
    join, a cell having few ranges.
    """
    pts = positioned(df, id_col, lat, lon).withColumn("code", morton(grid(F.col("lon")), grid(F.col("lat"))))
    pts = pts.withColumn("block", F.shiftright("code", 2 * (FINE_BITS - block)))
    cover = cover_regions(regions, region_id, geojson, finest, block)
    met = pts.join(cover, (pts.block == cover.block) & F.col("code").between(F.col("lo"), F.col("hi")))
    x, y = F.col("lon"), F.col("lat")
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    odd = F.size(F.filter("edges", lambda e: F.when((e["ay"] > y) != (e["by"] > y), crosses(e)).otherwise(F.lit(False)))) % 2 == 1
    touches = F.exists(
        "edges",
        lambda e: (F.abs((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])) <= 1e-12)
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    return met.filter(F.when(F.col("whole"), F.lit(True)).otherwise(odd | touches)).select("id", "region")


def near_and_inside(places: DataFrame, districts: DataFrame, radius_m: float = 40.0) -> DataFrame:
    """(kind, id_a, id_b): 'near' pairs of places and 'inside' pairs of place and district."""
    near = near_pairs(places, "final_id", radius_m).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = points_in_regions(places, "final_id", districts, "district_id", "geojson").select(F.lit("inside").alias("kind"), F.col("id").alias("id_a"), F.col("region").alias("id_b"))
    return near.unionByName(inside)

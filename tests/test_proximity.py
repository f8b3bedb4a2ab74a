import math
import random

from placeloom.operators import geometry, proximity

SQUARE = '{"type": "Polygon", "coordinates": [[[37.0,55.0],[37.1,55.0],[37.1,55.1],[37.0,55.1],[37.0,55.0]],[[37.04,55.04],[37.06,55.04],[37.06,55.06],[37.04,55.06],[37.04,55.04]]]}'
TWO = '{"type": "MultiPolygon", "coordinates": [[[[37.2,55.0],[37.3,55.0],[37.25,55.1],[37.2,55.0]]],[[[37.4,55.0],[37.5,55.0],[37.5,55.1],[37.4,55.0]]]]}'
SCHEMA = "final_id long, latitude double, longitude double"


def brute(rows, radius):
    out = set()
    good = [(i, *((o, a) if 36 <= a <= 39.5 else (a, o))) for i, a, o in rows if a is not None and o is not None and a == a and o == o and a != 0 and o != 0]
    for i, a, o in good:
        for j, b, p in good:
            if i < j and math.hypot((a - b) * 111320, (o - p) * 111320 * math.cos(math.radians(a))) <= radius:
                out.add((i, j))
    return out


def test_near_pairs_equal_brute_force_with_hot_cells_and_odd_rows(spark, clash):
    r = random.Random(1)
    rows = [(i, 55.5 + r.gauss(0, 0.0008), 37.5 + r.gauss(0, 0.0012)) for i in range(250)]
    rows += [(250 + i, 55.51, 37.51) for i in range(30)]  # one position
    rows += [(300, None, 37.5), (301, 0.0, 0.0), (302, float("nan"), 37.5), (303, 37.51, 55.51), (304, -33.9, 18.4), (305, -33.9001, 18.4)]
    df = clash(spark.createDataFrame(rows, SCHEMA))
    for radius in (40.0, 7.5, 900.0):
        got = [(x.id_a, x.id_b) for x in proximity.near_pairs(df, "final_id", radius, cell_points=7).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, radius)


def test_near_pairs_of_empty_table(spark):
    assert proximity.near_pairs(spark.createDataFrame([], SCHEMA), "final_id", 40.0).count() == 0


def test_points_in_regions_with_openings_borders_and_bad_shapes(spark, clash):
    regions = clash(spark.createDataFrame([(1, SQUARE), (2, TWO), (3, "no json"), (4, None), (5, '{"type":"Point","coordinates":[1,2]}')], "district_id int, geojson string"))
    rows = [(1, 55.02, 37.02), (2, 55.05, 37.05), (3, 55.03, 37.25), (4, 55.03, 37.45), (5, 55.05, 37.1), (6, 54.9, 37.05), (7, 37.02, 55.02), (8, None, None)]
    got = {(x.id, x.region) for x in proximity.points_in_regions(spark.createDataFrame(rows, SCHEMA), "final_id", regions, "district_id", "geojson").collect()}
    assert got == {(1, 1), (3, 2), (5, 1), (7, 1)} | ({(4, 2)} if 37.45 <= 37.5 and 55.03 <= 55.05 else set())


def test_random_points_equal_crossing_count(spark):
    r = random.Random(2)
    rows = [(i, 54.98 + r.random() * 0.14, 36.98 + r.random() * 0.56) for i in range(500)]
    regions = spark.createDataFrame([(1, SQUARE), (2, TWO)], "district_id int, geojson string")
    want = {(i, k) for i, a, o in rows for k, g in ((1, SQUARE), (2, TWO)) if proximity._inside(proximity.edges_of(proximity.rings_of(g)), o, a)}
    for finest, block in ((17, 13), (14, 14), (19, 10)):
        got = {(x.id, x.region) for x in proximity.points_in_regions(spark.createDataFrame(rows, SCHEMA), "final_id", regions, "district_id", "geojson", finest=finest, block=block).collect()}
        assert got == want


def test_cover_ranges_do_not_overlap():
    rows = sorted(r[1:4] for r in proximity.region_ranges(proximity.rings_of(SQUARE), 17, 13))
    assert all(a[1] < b[0] for a, b in zip(rows, rows[1:]))


def test_ambiguous_region_is_resolved_by_depth(spark):
    a = '{"type":"Polygon","coordinates":[[[37.0,55.0],[37.2,55.0],[37.2,55.2],[37.0,55.2],[37.0,55.0]]]}'
    b = '{"type":"Polygon","coordinates":[[[37.09,55.0],[37.4,55.0],[37.4,55.2],[37.09,55.2],[37.09,55.0]]]}'
    regions = spark.createDataFrame([(1, a), (2, b)], "district_id int, geojson string")
    pts = spark.createDataFrame([(1, 55.1, 37.1), (2, 55.1, 37.01), (3, 50.0, 30.0), (4, None, None)], SCHEMA)
    got = {x.id: (x.region, x.quality) for x in geometry.best_region(pts, "final_id", regions).collect()}
    assert got == {1: (1, "AMBIGUOUS"), 2: (1, "EXACT"), 3: (None, "OUTSIDE"), 4: (None, "NO_COORDINATES")}


def test_grid_cells_are_claimed_once_but_for_slivers(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/districts.parquet")
    cells = {x.claims: x.cells for x in geometry.grid_claims(d, 0.01).collect()}
    assert cells[1] > 1000 and sum(v for k, v in cells.items() if k > 1) <= 2

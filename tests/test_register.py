import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import geometry, merge, quality, reconcile, report
from placeloom.operators.store import Register
from placeloom.plans import reference, register
from placeloom.sources import files
from placeloom.streaming import ingest

DATA = "/root/testdata/sf0.001"


def _canon(df):
    cell = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) or type(v).__name__.startswith("int") else str(v)
    num = lambda s: s[:-7] if s.endswith(".000000") else s
    return sorted(tuple(num(cell(v)) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


SQL = reference.oracle_sql() | register.oracle_sql()
QUERIES = reference.queries() | register.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = (x.astype(object).where(x.notna(), None) for x in (got, want))
    assert _canon(a) == _canon(b)


CAPTURE = "seq long, place_id string, phone string, title string, address string, maps_url string, website string, detail_level string, source_records string"
R = '[{"district":"А","group":"g","category":"c","query":"q1"}]'
R2 = '[{"district":"Б","group":"g","category":"c","query":"q2"},{"district":"А","group":"g","category":"c","query":"q1"}]'


def test_thin_record_is_filled_promoted_and_never_erased(spark):
    rows = [
        (1, "100", "", "Кафе", "а", "", "", "LIST", R),
        (2, "100", "+7", "Кафе 2", "а", "", "http://x", "CARD", R2),
        (3, "100", "", "", "", "", "", "LIST", "[cut"),
        (4, None, "8 1", "Б", "ул 1", "", "", "LIST", None),
        (5, "", "81", "Б", "УЛ  1", "", "", "LIST", ""),
        (6, None, None, None, None, None, None, None, None),
    ]
    df = merge.keyed(spark.createDataFrame(rows, CAPTURE))
    got = {r.key: r for r in merge.merge_records(df, ("title", "phone", "website"), "seq").collect()}
    assert set(got) == {"id:100", "phone-address:81|ул 1"}
    a = got["id:100"]
    assert (a.title, a.phone, a.website, a.detail_level, a.n_rows, a.source_queries_count, a.source_district) == ("Кафе", "+7", "http://x", "CARD", 3, 2, "А | Б")
    last = {r.key: r for r in merge.import_dedupe(df, ("title",), "seq").collect()}
    assert last["id:100"].title == ""


def test_union_of_registers_is_idempotent(spark):
    df = merge.keyed(spark.createDataFrame([(1, "1", "", "A", "x", "", "", "LIST", R), (2, "2", "", "B", "y", "", "", "CARD", R2)], CAPTURE))
    once = merge.merge_records(df, ("title",), "seq").drop("n_rows")
    twice = merge.merge_records(merge.union_registers(df, df), ("title",), "seq").drop("n_rows")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_chain_thresholds_and_extension(spark):
    rows = [(1, "8 000 000-00-00 доб. 5", "A", 55.0, 37.0), (2, "+7 (000) 000 00 00", "B", 55.0, 37.0), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "final_id long, phone string, title string, latitude double, longitude double")
    got = {r.final_id: (r.phone_ext, r.chain_size, r.chain_flag) for r in report.decorate(df).collect()}
    assert got == {1: ("5", 2, ""), 2: ("", 2, ""), 3: ("", None, "")}
    assert {r.chain_flag for r in report.decorate(df, chain_from=2).filter("final_id < 3").collect()} == {"CHAIN"}


def test_files_round_trip(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes('﻿place_id;title;rating;latitude;longitude\r\n"1";"a ""b""\r\nc";"4,5";"37,5";"55,5"\r\n;;;;\r\n2; x ;;55.6;37.6\r\n'.encode())
    df = files.raw_export(files.read_delimited(spark, str(p)))
    got = sorted(map(tuple, df.collect()), key=str)
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [("1", 4.5, 55.5, 37.5), ("2", None, 55.6, 37.6)]
    files.write_export(df.select("place_id", "rating"), str(tmp_path / "out.csv"), single_file=True)
    text = (tmp_path / "out.csv").read_bytes().decode()
    assert text.startswith("﻿place_id,rating\r\n") and '"2",""\r\n' in text and '"1","4.5"\r\n' in text
    with pytest.raises(ValueError):
        files.query_list(df)
    with pytest.raises(ValueError):
        files.require_columns(df, ["nothing"])


def test_query_list_keeps_the_first_of_equal_queries(spark):
    df = spark.createDataFrame([("A", "кафе"), ("a", " Кафе "), ("A", ""), ("B", "кафе")], "`район` string, `запрос` string")
    got = files.query_list(df).collect()
    assert sorted((r.district, r.query_text) for r in got) == [("A", "кафе"), ("B", "кафе")]
    assert files.sniff_delimiter('"a;b";c,d,e') == ","


def test_features_and_elements(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"features":[{"properties":{"name":"X"},"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4],[5,6],[1,2]]]}}]}')
    (tmp_path / "e.json").write_text('{"elements":[{"type":"way","id":5,"center":{"lat":1.0,"lon":2.0},"tags":{"name":"n"}}]}')
    assert files.read_features(spark, str(tmp_path / "f.json")).collect()[0].name == "X"
    e = files.read_elements(spark, str(tmp_path / "e.json")).collect()[0]
    assert (e.osm_id, e.lat, e.tags["name"]) == (5, 1.0, "n")


def test_greedy_entities_depend_on_order_only(spark):
    df = spark.createDataFrame([(1, "p", ["a", "b"]), (2, "p", ["b", "c"]), (3, "p", ["a", "b", "x"]), (4, "q", ["a", "b"]), (5, None, [])], "id long, block string, stems array<string>")
    got = {r.id: r.entity for r in reconcile.greedy_entities(df, "block", ["id"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_rules_are_three_valued(spark):
    rules = {"мясной магазин": (["мяс", "колбас"], ["кафе"])}
    df = spark.createDataFrame([("Мясной магазин", "Мясо"), ("мясной магазин", "кафе, мясо"), ("иное", "мясо"), ("мясной магазин", None)], "c string, r string")
    assert [x[0] for x in df.select(T.rule_match(F.col("c"), F.col("r"), rules)).collect()] == [True, False, None, None]


def test_numbers_of_rows_and_completeness_of_empty_tables(spark):
    df = spark.createDataFrame([], "final_id long, detected_district string")
    assert quality.completeness(df, ("detected_district",)).collect()[0].filled == 0


def test_stream_of_captures_equals_one_batch(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/raw_places.parquet")
    df.repartitionByRange(3, "raw_id").write.parquet(str(tmp_path / "in"))
    q = ingest.merge_stream(ingest.read_stream(spark, str(tmp_path / "in"), df), str(tmp_path / "state"), ("title", "phone"), "raw_id", str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = sorted(map(tuple, ingest.merged_state(spark, str(tmp_path / "state"), None, ("title", "phone")).collect()), key=str)
    want = merge.merge_records(merge.keyed(df), ("title", "phone"), "raw_id", records=None).select("key", "title", "phone", "n_rows")
    assert got == sorted(map(tuple, want.collect()), key=str)


def test_areas_add_parts_and_subtract_openings(spark):
    square = lambda x, y, side: f"[[{x},{y}],[{x + side},{y}],[{x + side},{y + side}],[{x},{y + side}],[{x},{y}]]"
    shapes = [(1, f'{{"type":"MultiPolygon","coordinates":[[{square(0, 0, 4)},{square(1, 1, 1)}],[{square(10, 0, 4)},{square(11, 1, 2)}]]}}'), (2, f'{{"type":"Polygon","coordinates":[{square(0, 0, 4)},{square(1, 1, 1)}]}}'), (3, f'{{"type":"MultiPolygon","coordinates":[[{square(0, 0, 4)}],[{square(10, 0, 2)}]]}}'), (4, "none")]
    got = {r.region: r.km2 for r in geometry.areas(spark.createDataFrame(shapes, "district_id int, geojson string")).collect()}
    km2 = lambda side, y: side * side * 111.32**2 * math.cos(math.radians(y + side / 2))
    want = {1: 2 * km2(4, 0) - km2(1, 1) - km2(2, 1), 2: km2(4, 0) - km2(1, 1), 3: km2(4, 0) + km2(2, 0)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 * want[k] for k in want), (got, want)


def test_nearest_misses_no_pair_at_any_latitude(spark):
    rows = [(i, lat, 30.0 + i * 0.0003) for i, lat in enumerate([0.0, 55.7, 68.9, 78.2, 84.9, -72.3])]
    other = [(100 + i, lat + 0.0004, lon + 0.0009 / math.cos(math.radians(lat))) for i, lat, lon in rows] + [(900, None, 1.0)]
    a, b = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (rows, other))
    far = lambda x, y: math.hypot((x[1] - y[1]) * 111320, (x[2] - y[2]) * 111320 * math.cos(math.radians(x[1])))
    want = {x[0]: y[0] for x in rows for y in other[:-1] if far(x, y) <= 120}
    assert len(want) == len(rows) and {r.id_a: r.id_b for r in reconcile.nearest(a, b, 120.0).collect()} == want


def test_house_numbers_in_one_writing(spark):
    rows = [("д5", "5"), ("дом 5 корпус 2 стр.1", "5к2с1"), ("5К2С1", "5к2с1"), ("вл. 12д к. 3", "12дк3"), ("5/7", "5/7"), ("№ 8", "8"), ("", "")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "h string")
    assert [r[0] for r in df.select(T.house_key(F.col("h"))).collect()] == [b for _, b in rows]


def test_districts_named_in_texts(spark):
    names = ["Ясенево", "Тёплый Стан", "Коньково"]
    rows = [("Храм в Ясеневе", "Ясенево", "Ясенево"), ("улица, тёплый стан", "", "Тёплый Стан"), ("район «Коньково»", "", "Коньково"), ("на углу", "", ""), (None, "", "")]
    df = spark.createDataFrame([(a,) for a, _, _ in rows], "t string")
    got = df.select(F.coalesce(T.district_in_name(F.col("t"), names), F.lit("")), T.district_mentioned(F.col("t"), names)).collect()
    assert [tuple(r) for r in got] == [(b, c) for _, b, c in rows]


def test_a_register_keeps_first_values_and_empties_what_depends(spark, tmp_path):
    reg = Register(spark, str(tmp_path / "reg"), ("title", "phone", "website", "categories", "opening_hours"))
    cols = "raw_id long, place_id string, phone string, phones string, title string, address string, maps_url string, website string, categories string, opening_hours string, detail_level string"
    assert [tuple(r) for r in reg.stats().collect()] == [("raw", 0, 0, 0), ("final", 0, 0, 0), ("rejected", 0, 0, 0)]
    reg.put_raw(spark.createDataFrame([(5, "1", "", None, "A", "x", "", "", "", "", "LIST"), (6, "2", "7", None, "B", "y", "", "", "", "", "LIST")], cols), "raw_id")
    reg.put_raw(spark.createDataFrame([(1, "1", "8", None, "Z", "x", "", "w", "c", "h", "CARD"), (2, None, None, None, None, None, None, None, None, None, None)], cols), "raw_id")
    got = {r.key: (r.title, r.phone, r.detail_level, r.hits) for r in reg.table("raw").collect()}
    assert got == {"id:1": ("A", "8", "CARD", 2), "id:2": ("B", "7", "LIST", 1)}
    reg.put("final", spark.createDataFrame([("id:1", "A"), (None, "B")], "key string, title string"))
    reg.put("final", spark.createDataFrame([("id:1", "C"), ("id:9", "D")], "key string, title string"))
    assert sorted(map(tuple, reg.table("final").collect())) == [("id:1", "C"), ("id:9", "D")]
    assert [tuple(r) for r in reg.stats().collect()] == [("raw", 2, 3, 1), ("final", 2, 0, 0), ("rejected", 0, 0, 0)]
    assert [r.key for r in reg.page("raw", 1, 5).collect()] == ["id:2"] and reg.get(spark.createDataFrame([("2",), ("7",)], "place_id string")).count() == 1
    reg.clear("raw")
    assert [r.n_rows for r in reg.stats().collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        reg.put("other", reg.table("final"))


def test_query_lists_and_exports_are_told_apart(spark):
    make = lambda *names: spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    for names, word in ((("maps_url", "query"), "export of places"), (("primary_source",), "sources"), (("x",), "no column")):
        with pytest.raises(ValueError, match=word):
            files.query_list(make(*names))
    with pytest.raises(ValueError):
        files.raw_export(make("query"))
    with pytest.raises(ValueError):
        report.rejected(make("phone"), "OUTSIDE")


def test_alike_names_are_all_pairs_that_share_enough(spark):
    import random

    r = random.Random(2)
    side = lambda n: [(f"n{i}", sorted(r.sample(["hot", *"abcdefgh"], r.randint(1, 5)) if r.random() < 0.5 else {"hot", r.choice("xyz")})) for i in range(n)]
    left, right = side(40), side(50)
    a, b = (spark.createDataFrame(x, "k string, stems array<string>") for x in (left, right))
    for least in (0.34, 0.5, 0.8, 1.0):
        want = {(x, y) for x, s in left for y, t in right if len(set(s) & set(t)) >= least * min(len(s), len(t)) - 1e-9}
        assert {(x.ka, x.kb) for x in reconcile.alike_names(a, b, least).collect()} == want


def test_command_line(spark, tmp_path):
    from placeloom.__main__ import main

    for what in ("report", "import", "books"):
        main([what, "--data", DATA, "--out", str(tmp_path / what)])
    assert spark.read.parquet(str(tmp_path / "import")).count() > 0 and os.path.isdir(tmp_path / "report" / "summary")

import json

import pyarrow as pa

from placeloom.operators import nesting

REC = {"district": "А", "group": "Г", "category": "К", "query": "з", "runs": [{"at": 5, "hits": [{"page": 1, "rank": 2}, {"page": 2, "rank": 3}]}, {"at": "7", "hits": []}]}
PLACE = {"id": "12345", "title": "Кафе", "coordinates": [37.1, 55.2]}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def make(spark, payloads):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads, 1)], "payload_id long, payload string")


def test_runs_of_every_form_of_records(spark, clash):
    inner = PLACE | {"id": 99999, "source_records": [REC | {"query": None, "runs": None}]}
    look = {"id": "ad-1", "title": "x", "coordinates": [1, 2], "source_records": [REC]}
    payloads = [
        [PLACE | {"source_records": [REC]}],
        {"a": {"b": PLACE | {"source_records": REC | {"runs": []}}}},
        PLACE | {"source_records": json.dumps([REC, REC | {"runs": {"at": 1}}])},
        PLACE | {"provenance": {"source_records": [REC | {"query": 5}]}, "near": {"items": [inner, look]}},
        '{"cut": [' + json.dumps(PLACE | {"source_records": [REC]}),
        None,
        "",
        "null",
        '"text"',
        PLACE | {"source_records": "[cut"},
        PLACE | {"title": " — ", "source_records": [REC]},
        PLACE | {"coordinates": [37.1], "source_records": [REC]},
        PLACE | {"id": "1234", "source_records": [REC]},
        PLACE | {"id": True, "source_records": [REC]},
    ]
    got = rows(nesting.run_rows(clash(make(spark, payloads))))
    assert got == [
        (1, "12345", 1, 1, "з"), (1, "12345", 1, 2, "з"), (2, "12345", 1, 0, "з"),
        (3, "12345", 1, 1, "з"), (3, "12345", 1, 2, "з"), (3, "12345", 2, 1, "з"),
        (4, "12345", 1, 1, "5"), (4, "12345", 1, 2, "5"), (4, "99999", 1, 0, ""),
    ]


def test_parent_and_child_tables_fit_together(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/search_payloads.parquet")
    places, records, hits = (nesting.flatten_payloads(df, t) for t in ("places", "records", "hits"))
    runs = nesting.flatten_payloads(df, "runs").filter("run_pos > 0")
    assert records.join(places, ["payload_id", "place_pos"], "left_anti").count() == 0
    assert runs.join(records, ["payload_id", "place_pos", "rec_pos"], "left_anti").count() == 0
    assert hits.join(runs, ["payload_id", "place_pos", "rec_pos", "run_pos"], "left_anti").count() == 0
    assert nesting.payload_rows(df).agg({"n_places": "sum"}).collect()[0][0] == places.count() > 0


def test_flatten_lists_with_nulls_empty_lists_and_offsets():
    kind = pa.list_(pa.struct([("v", pa.list_(pa.int64()))]))
    nested = pa.array([None, [], [{"v": [1, 2]}, {"v": None}, {"v": []}], [{"v": [3]}]], kind)
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13]), nested], names=["k", "a"]).slice(1)
    got = nesting.flatten_lists(batch, ["a", "v"], ["k"]).to_pydict()
    assert got == {"k": [12, 12, 13], "a.pos": [1, 1, 1], "v.pos": [1, 2, 1], "v": [1, 2, 3]}
    outer = nesting.flatten_lists(batch, ["a", "v"], ["k"], outer=True).to_pydict()
    assert outer["k"] == [12, 12, 12, 12, 13] and outer["v.pos"] == [1, 2, 0, 0, 1] and outer["a.pos"] == [1, 1, 2, 3, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "payload_id long, payload string")
    assert all(nesting.flatten_payloads(df, t).count() == 0 for t in nesting.TABLES)


def test_deep_and_long_payloads(spark):
    deep = "[" * 500 + json.dumps(PLACE | {"source_records": [REC]}) + "]" * 500
    wide = json.dumps([PLACE | {"id": str(10000 + i), "source_records": [REC]} for i in range(3000)])
    got = nesting.run_rows(make(spark, [deep, wide])).groupBy("payload_id").count().collect()
    assert {r.payload_id: r["count"] for r in got} == {1: 2, 2: 6000}

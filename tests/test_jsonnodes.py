"""The node table and the nesting operator against a plain walk over parsed documents."""

import json
import random
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from placeloom.operators import nesting
from placeloom.operators.jsonnodes import ARRAY, SCALAR, STRING, Nodes
from placeloom.plans import general

_ID = re.compile(r"[0-9]{5,}")
_WORD = re.compile(r"[^\W_]")


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def _whole(v) -> int | None:
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    try:
        n = int(v)
    except (ValueError, OverflowError):
        return None
    return n if -(2**63) <= n < 2**63 else None


def _number(v) -> float | None:
    if isinstance(v, bool):
        return None
    try:
        x = float(v)
    except (TypeError, ValueError, OverflowError):
        return None
    return x if abs(x) < float("inf") else None


def _place_id(v) -> str | None:
    if isinstance(v, bool) or not isinstance(v, (int, str)):
        return None
    s = str(v)
    return s if _ID.fullmatch(s) else None


def is_place(o: dict) -> bool:
    """An id of five or more digits, a title with a letter or digit, at least two coordinates."""
    if _place_id(o.get("id")) is None:
        return False
    title = o.get("title")
    if not isinstance(title, str) or not _WORD.search(title):
        return False
    c = o.get("coordinates")
    return isinstance(c, list) and sum(_number(x) is not None for x in c) >= 2


def _looks_like_entity(o: dict) -> bool:
    return "id" in o and ("title" in o or "coordinates" in o)


def _records(v) -> Iterator[dict]:
    """The source records in a value: a list, a single object, or either as JSON text."""
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            return
    for x in v if isinstance(v, list) else [v]:
        if isinstance(x, dict):
            yield x


def _own_records(place: dict) -> Iterator[dict]:
    """The records kept for a place, at whatever depth, but not inside another entity in it."""
    stack = [place]
    while stack:
        o = stack.pop()
        if isinstance(o, dict):
            if o is not place and _looks_like_entity(o):
                continue
            if "source_records" in o:
                yield from _records(o["source_records"])
            stack.extend(v for k, v in reversed(o.items()) if k != "source_records" and isinstance(v, (dict, list)))
        else:
            stack.extend(v for v in reversed(o) if isinstance(v, (dict, list)))


def _items(v) -> list:
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def _record(r: dict) -> dict:
    runs = [
        {"at": _whole(x.get("at")), "hits": [{"page": _whole(h.get("page")), "rank": _whole(h.get("rank"))} for h in _items(x.get("hits")) if isinstance(h, dict)]}
        for x in _items(r.get("runs"))
        if isinstance(x, dict)
    ]
    return {**{n: _text(r.get(n)) for n in ("district", "group", "category", "query")}, "runs": runs}


def places_in(payload: str | None) -> list[dict]:
    """All places of a payload in document order; none where it is not complete JSON."""
    if not payload:
        return []
    try:
        root = json.loads(payload)
    except (ValueError, RecursionError):
        return []
    out, stack = [], [root] if isinstance(root, (dict, list)) else []
    while stack:
        o = stack.pop()
        if isinstance(o, dict):
            if is_place(o):
                xy = [x for x in map(_number, o["coordinates"]) if x is not None]
                out.append({"place_id": _place_id(o["id"]), "title": o["title"], "lon": xy[0], "lat": xy[1], "address": _text(o.get("address")), "records": [_record(r) for r in _own_records(o)]})
            stack.extend(v for v in reversed(o.values()) if isinstance(v, (dict, list)))
        else:
            stack.extend(v for v in reversed(o) if isinstance(v, (dict, list)))
    return out


def strict(text):
    def constant(_):
        raise ValueError

    try:
        return True, json.loads(text or "", parse_constant=constant)
    except (ValueError, RecursionError):
        return False, None


def rebuilt(nodes, row, fields):
    kids: dict[int, list[int]] = {}
    for i in np.flatnonzero(nodes.row == row).tolist():
        kids.setdefault(int(nodes.parent[i]), []).append(i)

    def value(i):
        if nodes.kind[i] == STRING:
            return nodes.text(np.array([i]))[0].as_py()
        if nodes.kind[i] == SCALAR:
            return json.loads(bytes(nodes.data[nodes.start[i] : nodes.end[i]]))
        own = kids.get(i, [])
        return [value(x) for x in own] if nodes.kind[i] == ARRAY else {fields[nodes.key[x]]: value(x) for x in own}

    return value(kids[-1][0])


ODD = ["", None, " ", "1", '"x"', "null", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "01", "1.", "[1}", "{]", '{"a":[}]', "\\", '"\\', '"\\u12g4"', '"\\u0041"', '"\\ud800"', "[]", "{}", "[[]]", "}{", '{"a":"b":1}', "[,1]", "\ufeff1", '"a""b"', "tru e", "nan", "[NaN]", '"\t"', "-", "-0", "1e5", "1E+", '{"a":1}{"b":2}', "[1]]", "[[1]"]


def test_nodes_equal_parsed_documents_and_know_what_is_none():
    r, fields = random.Random(1), ["a", "b", 'c"', "длина", "id"]

    def some(depth):
        x = r.random()
        if depth > 4 or x < 0.3:
            return r.choice([1, -2.5, "x", "", 'q"\\"\\\\', "тест\n", None, True, False, 1e5, "😀", "[1,{}]"])
        return [some(depth + 1) for _ in range(r.randint(0, 4))] if x < 0.65 else {k: some(depth + 1) for k in r.sample(fields, r.randint(0, 5))}

    docs, whole = list(ODD), set()
    for _ in range(500):
        text = json.dumps(some(0), ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 2]))
        whole.add(len(docs))
        docs.append(text)
        for _ in range(3):
            k = r.randrange(len(text))
            docs.append(r.choice([text[:k] + text[k + 1 :], text[:k], text[:k] + r.choice('{}[],:"\\ 1tn\x01а') + text[k:]]))
    for lo in range(0, len(docs), 97):
        part = docs[lo : lo + 97]
        nodes = Nodes(pa.array(part, pa.string()), fields)
        for i, text in enumerate(part):
            ok, value = strict(text)
            assert ok == bool(nodes.valid[i]), text
            if lo + i in whole:
                assert rebuilt(nodes, i, fields) == value, text


def test_places_equal_a_plain_walk():
    r = random.Random(4)

    def record(depth):
        return {k: v for k, v in {"district": r.choice(["А", None]), "query": r.choice(["з", "", None, True]), "runs": r.choice([None, [], {"at": "7"}, [{"at": 5, "hits": [{"page": 1, "rank": "2"}, 3]}, 4, {"hits": {"page": 10**30}}]])}.items() if r.random() < 0.8}

    def some(depth):
        x = r.random()
        if depth > 5 or x < 0.15:
            return r.choice([1, "x", None, [], {}])
        if x < 0.4:
            return [some(depth + 1) for _ in range(r.randint(0, 3))]
        out = {f"k{i}": some(depth + 1) for i in range(r.randint(0, 2))}
        if x < 0.85:
            out |= {k: v for k, v in {"id": r.choice(["12345", 99999, "12", True, 1.5]), "title": r.choice(["Кафе", "—", 5]), "coordinates": r.choice([[1, 2], [1, "2.5", 3], ["x", None, 4], [1], {}, [1e3, "-2"]]), "address": r.choice(["д", None])}.items() if r.random() < 0.85}
        if r.random() < 0.5:
            recs = r.choice([record(0), [record(0), 5, record(0)], [], "[cut", [some(depth + 2)]])
            out["source_records"] = json.dumps(recs) if r.random() < 0.4 else recs
        return dict(r.sample(list(out.items()), len(out)))

    docs = [json.dumps(some(0)) for _ in range(4000)] + ["", None, '{"cut']
    got, valid = nesting.nested_places(pa.array(docs, pa.string()))
    want = [places_in(d) for d in docs]
    assert sum(map(len, want)) > 300 and sum(len(p["records"]) for w in want for p in w) > 100
    for d, g, w in zip(docs, got.to_pylist(), want):
        assert g == w, d
    assert valid.tolist() == [strict(d)[0] for d in docs]


@pytest.mark.parametrize("name", ["p4_found", "p4_payloads", "p4_places", "p4_records", "p4_runs", "p4_hits"])
def test_nested_tables_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW search_payloads AS SELECT * FROM '/root/testdata/sf0.01/search_payloads.parquet'")
    got = general.queries()[name](spark, "/root/testdata/sf0.01")
    key = lambda rows: sorted(map(repr, rows))
    assert key(map(tuple, got.collect())) == key(con.sql(f"SELECT {', '.join(got.columns)} FROM ({general.oracle_sql()[name]})").fetchall())

"""Deeply nested records as related flat tables.

The documents of a batch are one table of nodes found in its Arrow buffer (``jsonnodes``).
What is a place, a source record, a run or a hit is decided for all nodes at once by their
keys and parents, and the chosen nodes become one nested Arrow column by counting children a
parent. From there a list's offsets give the parent of every child, children are taken from
the values buffer, and keys go down by a vectorised take. No row is parsed or walked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators.jsonnodes import ARRAY, OBJECT, SCALAR, STRING, Nodes

FIELDS = ("id", "title", "coordinates", "address", "source_records", "district", "group", "category", "query", "runs", "at", "hits", "page", "rank")
#: Bytes of documents that are taken apart at a time; a larger document is taken by itself.
SLICE_BYTES = 8_000_000


def _key(name: str) -> int:
    return FIELDS.index(name)


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def _numbers(nodes: Nodes, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(finite number or NaN, whether it is one): of JSON numbers and of texts that are a number."""
    texts = nodes.text(which)
    plain = np.isin(nodes.kind[which], (STRING, SCALAR)) & (which >= 0)
    good = plain & _matches(texts, r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$")
    out = np.full(len(which), np.nan)
    out[good] = np.array(texts.filter(pa.array(good)).to_pylist(), dtype=object).astype(float)
    return out, good & np.isfinite(out)


def _wholes(nodes: Nodes, which: np.ndarray) -> pa.Array:
    """Whole numbers of nodes, null where there is none or it exceeds 64 bits; fractions of JSON numbers are cut off."""
    if not len(nodes.kind):
        return pa.nulls(len(which), pa.int64())
    texts = pc.utf8_trim_whitespace(nodes.text(which))
    kind = np.where(which >= 0, nodes.kind[which], -1)
    whole = np.isin(kind, (STRING, SCALAR)) & _matches(texts, r"^[+-]?[0-9]{1,18}$")
    fine = pc.replace_substring_regex(pc.if_else(pa.array(whole), texts, pa.scalar(None, pa.string())), r"^\+", "").cast(pa.int64())
    rest = np.flatnonzero((kind == SCALAR) & ~whole & _matches(texts, r"^-?[0-9]"))
    if not len(rest):
        return fine
    value, good = _numbers(nodes, which[rest])
    good &= np.abs(value) < 2.0**63
    cut = [int(v) if g else None for v, g in zip(value.tolist(), good.tolist())]
    mask = np.zeros(len(which), dtype=bool)
    mask[rest] = True
    return pc.replace_with_mask(fine, pa.array(mask), pa.array(cut, pa.int64()))


def _items(nodes: Nodes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``values``, node) of the objects in a value: itself, or the objects of a list, in order."""
    some = np.flatnonzero(values >= 0)
    owner = np.full(len(nodes.kind) + 1, -1, dtype=np.int64)
    owner[values[some]] = some
    listed = np.flatnonzero((nodes.kind == OBJECT) & (owner[nodes.parent] >= 0))
    listed = listed[nodes.kind[nodes.parent[listed]] == ARRAY]
    alone = some[nodes.kind[values[some]] == OBJECT]
    at, node = np.concatenate((owner[nodes.parent[listed]], alone)), np.concatenate((listed, values[alone]))
    order = np.lexsort((node, at))
    return at[order], node[order]


def _lists(parents: np.ndarray, many: int, values: pa.Array) -> pa.ListArray:
    """A list for each of ``many`` parents of the values, which are sorted by parent."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(parents, minlength=many))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _record_structs(nodes: Nodes, records: np.ndarray) -> pa.StructArray:
    """The source records at some nodes with their runs and hits."""
    child = lambda name, of: nodes.child(_key(name))[of] if len(nodes.kind) else np.full(len(of), -1)
    of_run, runs = _items(nodes, child("runs", records))
    of_hit, hits = _items(nodes, child("hits", runs))
    hit = pa.StructArray.from_arrays([_wholes(nodes, child(n, hits)) for n in ("page", "rank")], names=["page", "rank"])
    run = pa.StructArray.from_arrays([_wholes(nodes, child("at", runs)), _lists(of_hit, len(runs), hit)], names=["at", "hits"])
    texts = [nodes.text(child(n, records)) for n in ("district", "group", "category", "query")]
    return pa.StructArray.from_arrays([*texts, _lists(of_run, len(records), run)], names=["district", "group", "category", "query", "runs"])


def _owners(nodes: Nodes, entity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each container the nearest entity it is or lies in, and whether source records of that entity lie between."""
    n = len(nodes.kind)
    own, kept = np.full(n + 1, -1, dtype=np.int64), np.zeros(n + 1, dtype=bool)
    boxes = np.flatnonzero(nodes.kind <= ARRAY)
    boxes = boxes[np.argsort(nodes.level[boxes], kind="stable")]
    levels = nodes.level[boxes]
    edges = np.flatnonzero(np.diff(levels, prepend=-1)).tolist() + [len(boxes)]
    for a, z in zip(edges, edges[1:]):  # a round for each level of nesting
        at = boxes[a:z]
        above = nodes.parent[at]
        own[at] = np.where(entity[at], at, own[above])
        kept[at] = ~entity[at] & ((nodes.key[at] == _key("source_records")) | kept[above])
    return own, kept


def nested_places(payloads: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """The places of each payload in document order as one nested column, and which payloads are complete JSON.

    A place is an object with an id of five or more digits, a title with a letter or digit and at least two
    coordinates. Its records are those under its ``source_records`` at any depth, but not inside another entity
    (an object with an id and a title or coordinates): a list, a single object, or either as JSON text.
    """
    nodes = Nodes(payloads, FIELDS)
    n = len(nodes.kind)
    child = {f: nodes.child(_key(f)) for f in ("id", "title", "coordinates", "source_records", "address")}
    entity = (child["id"] >= 0) & ((child["title"] >= 0) | (child["coordinates"] >= 0))
    place = np.flatnonzero(entity & (child["title"] >= 0) & (child["coordinates"] >= 0))
    id_, title, xy = (child[f][place] for f in ("id", "title", "coordinates"))
    good = (nodes.kind[id_] >= STRING) & (nodes.kind[title] == STRING) & (nodes.kind[xy] == ARRAY)
    good &= _matches(nodes.text(id_), "^[0-9]{5,}$") & _matches(nodes.text(title), r"[\p{L}\p{N}]")
    place, xy = place[good], xy[good]
    # the first two numbers among the coordinates
    of_list = np.full(n + 1, -1, dtype=np.int64)
    of_list[xy] = np.arange(len(xy))
    parts = np.flatnonzero(of_list[nodes.parent] >= 0)
    value, number = _numbers(nodes, parts)
    parts, value = parts[number], value[number]
    at = of_list[nodes.parent[parts]]
    order = np.argsort(at, kind="stable")
    at, value = at[order], value[order]
    many = np.bincount(at, minlength=len(place))
    begin = np.cumsum(many) - many
    two = many >= 2
    lon, lat, place = value[begin[two]], value[begin[two] + 1], place[two]

    place_no = np.full(n + 1, -1, dtype=np.int64)
    place_no[place] = np.arange(len(place))
    own, kept = _owners(nodes, entity)
    # source records by place, in the order of the objects that hold them
    held = child["source_records"]
    holder = np.flatnonzero(held >= 0)
    holder = holder[(place_no[own[holder]] >= 0) & ~kept[holder]]
    found = held[holder]
    at, record = _items(nodes, found)
    said = np.flatnonzero(nodes.kind[found] == STRING)
    inner = Nodes(nodes.text(found[said]), FIELDS)
    roots = np.full(len(said), -1, dtype=np.int64)
    tops = np.flatnonzero(inner.parent < 0)
    roots[inner.row[tops]] = tops
    in_text, inner_record = _items(inner, roots)
    holders = np.concatenate((holder[at], holder[said[in_text]]))
    order = np.lexsort((np.concatenate((record, inner_record)), holders, place_no[own[holders]]))
    structs = pa.concat_arrays([_record_structs(nodes, record), _record_structs(inner, inner_record)]).take(pa.array(order))
    records = _lists(place_no[own[holders]], len(place), structs)
    columns = {"place_id": nodes.text(child["id"][place]), "title": nodes.text(child["title"][place]), "lon": pa.array(lon), "lat": pa.array(lat), "address": nodes.text(child["address"][place]), "records": records}
    return _lists(nodes.row[place], len(payloads), pa.StructArray.from_arrays(list(columns.values()), names=list(columns))), nodes.valid


def _slices(payloads: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SLICE_BYTES``; a larger document is a range of its own."""
    size = pc.fill_null(pc.binary_length(payloads), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(size):
        yield start, len(size)


def flatten_lists(batch: pa.RecordBatch, path: Sequence[str], keys: Sequence[str], outer: bool = False) -> pa.Table:
    """The elements of the lists along ``path`` with the keys of their ancestors and 1-based positions.

    For every level, the offsets give each element's parent row (``list_parent_indices``) and its
    position, the elements are the flattened values, and all columns collected so far are taken by
    the parent indices. Struct elements become columns ``<level>.<field>``. With ``outer`` a parent
    without elements of the last level gives one row of position 0.
    """
    cols = {k: batch.column(k) for k in keys}
    current = batch.column(path[0])
    for depth, name in enumerate(path):
        lists = current if depth == 0 else cols.pop(f"{path[depth - 1]}.{name}")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        parents = pc.list_parent_indices(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")
        firsts = sizes.cumsum() - sizes
        rows = parents.to_numpy(zero_copy_only=False)
        position = pa.array((np.arange(len(rows)) - firsts[rows] + 1).astype("int32"))
        values = pc.list_flatten(lists)
        if outer and depth == len(path) - 1:
            empty = (sizes == 0).nonzero()[0]
            if len(empty):
                order = pc.sort_indices(pa.table({"p": pa.concat_arrays([pa.array(rows, pa.int64()), pa.array(empty, pa.int64())])}), sort_keys=[("p", "ascending")])
                values = pa.concat_arrays([values, pa.nulls(len(empty), values.type)]).take(order)
                position = pa.concat_arrays([position, pa.array([0] * len(empty), pa.int32())]).take(order)
                parents = pa.concat_arrays([pa.array(rows, pa.int64()), pa.array(empty, pa.int64())]).take(order)
        cols = {k: v.take(parents) for k, v in cols.items()}
        cols[f"{name}.pos"] = position
        if pa.types.is_struct(values.type):
            for i, f in enumerate(values.type):
                cols[f"{name}.{f.name}"] = pc.struct_field(values, [i])
        else:
            cols[name] = values
    return pa.table(cols)


# The tables that come out, their columns and where they come from.
TABLES = {
    "places": (("places",), False, {"payload_id": "payload_id bigint", "places.pos": "place_pos int", "places.place_id": "place_id string", "places.title": "title string", "places.lat": "lat double", "places.lon": "lon double", "places.address": "address string"}),
    "records": (("places", "records"), False, {"payload_id": "payload_id bigint", "places.pos": "place_pos int", "places.place_id": "place_id string", "records.pos": "rec_pos int", "records.district": "district string", "records.group": "group_name string", "records.category": "category string", "records.query": "query_text string"}),
    "runs": (("places", "records", "runs"), True, {"payload_id": "payload_id bigint", "places.pos": "place_pos int", "places.place_id": "place_id string", "records.pos": "rec_pos int", "runs.pos": "run_pos int", "runs.at": "run_at bigint", "records.query": "query_text string"}),
    "hits": (("places", "records", "runs", "hits"), False, {"payload_id": "payload_id bigint", "places.pos": "place_pos int", "places.place_id": "place_id string", "records.pos": "rec_pos int", "runs.pos": "run_pos int", "hits.pos": "hit_pos int", "hits.page": "page bigint", "hits.rank": "hit_rank bigint"}),
}


def flatten_payloads(df: DataFrame, table: str, id_col: str = "payload_id", payload: str = "payload") -> DataFrame:
    """One of the flat tables ``places``, ``records``, ``runs``, ``hits`` of captured payloads.

    Children carry the keys of all their parents: payload_id, place_pos, rec_pos, run_pos. A record
    without runs gives one row of run_pos 0. Null, empty and cut-off payloads give nothing; repeated
    payloads give their rows again; numbers of another type become null, texts are given as they stand
    in the document. Of equal keys in one object the last counts. No shuffle: a payload is flattened where it is read.
    """
    path, outer, columns = TABLES[table]
    schema = ", ".join(columns.values())

    def run(batches):
        for b in batches:
            for x, y in _slices(b.column(1)):
                nested, _ = nested_places(b.column(1).slice(x, y - x))
                flat = flatten_lists(pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), nested], names=["payload_id", "places"]), path, ["payload_id"], outer)
                yield from flat.select(list(columns)).rename_columns([c.split()[0] for c in columns.values()]).to_batches()

    return df.select(F.col(id_col).cast("long").alias("payload_id"), F.col(payload).cast("string").alias("payload")).mapInArrow(run, schema)


def run_rows(df: DataFrame) -> DataFrame:
    """(payload_id, place_id, rec_pos, run_pos, query_text): one row per run, '' for a missing query."""
    return flatten_payloads(df, "runs").select("payload_id", "place_id", "rec_pos", "run_pos", F.coalesce("query_text", F.lit("")).alias("query_text"))


def payload_rows(df: DataFrame, id_col: str = "payload_id", payload: str = "payload") -> DataFrame:
    """(payload_id, readable, n_places): the root table, one row per captured payload."""

    def run(batches):
        for b in batches:
            for x, y in _slices(b.column(1)):
                nested, valid = nested_places(b.column(1).slice(x, y - x))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(valid), pc.list_value_length(nested)], names=["payload_id", "readable", "n_places"])

    return df.select(F.col(id_col).cast("long").alias("payload_id"), F.col(payload).cast("string").alias("payload")).mapInArrow(run, "payload_id bigint, readable boolean, n_places int")


def entities(df: DataFrame, id_col: str = "payload_id", payload: str = "payload") -> DataFrame:
    """The places of captured answers, of each id in an answer the first. Texts too short or long for one, or without the words of one, are not looked at."""
    text = F.col(payload)
    worth = (F.length(text) >= 32) & (F.octet_length(text) <= 4 * 1024 * 1024) & (text.contains('"coordinates"') | text.contains('"title"'))
    places = flatten_payloads(df.filter(worth), "places", id_col, payload)
    return places.groupBy("payload_id", "place_id").agg(F.min_by(F.struct("place_pos", "title", "lat", "lon", "address"), "place_pos").alias("v")).select("payload_id", "place_id", "v.*")

"""Fields that hold several values between inconsistent delimiters.

A cell is a lattice: separators outside quotation marks cut it into pieces, and a run of
consecutive pieces may be one value where that value is seen whole, in quotation marks,
somewhere in the column. How often values occur is learned from the whole column by
expectation-maximisation over all segmentations; the likeliest one of each cell is found
by Viterbi. Quoted spans are pieces that no separator cuts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.session import cut_lineage

SEPARATORS = ",;|/\n\r"
# Opening quotation marks and the marks that close them.
QUOTES = {'"': '"', "«": "»", "“": "”", "„": "“”"}
#: Weight of the base distribution against the learned counts.
PRIOR = 1.0
#: Base probability of a value, and the chance that a value of several pieces is written without its quotation marks. For
#: each piece but the first it also bears the chance of a value met once: so values that stand together as often as apart
#: are several, while one that is mostly met in quotation marks stays whole without them, however many pieces it has.
BASE, INNER = 1e-4, 0.3

_EXTENSION = re.compile(r"\(?\s*(?:доб(?:авочный|\.)?|вн(?:утр|\.)?|ext(?:ension|\.)?|#)[\s.:№]*\d", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]")


def _close(text: str, at: int) -> int:
    """The place of the mark closing the one at ``at``; a doubled mark means one. -1 if there is none."""
    ends = QUOTES[text[at]]
    i = at + 1
    while i < len(text):
        if text[i] in ends:
            if i + 1 < len(text) and text[i + 1] == text[i]:
                i += 2
                continue
            return i
        i += 1
    return -1


_MARKS = re.compile("[" + re.escape(SEPARATORS + "".join(QUOTES)) + "]")


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces that hold a letter or digit, without white space around them.

    An extension belongs to the number before it, so no piece but the first begins with one.
    """
    out: list[tuple[int, int]] = []
    start = i = 0

    def put(a: int, b: int) -> None:
        body = text[a:b]
        if _WORD.search(body):
            a += len(body) - len(body.lstrip())
            b = a + len(body.strip())
            if out and _EXTENSION.match(text, a):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))

    while (m := _MARKS.search(text, i)) is not None:
        i = m.start()
        c = text[i]
        if c in QUOTES:
            if i == start or text[i - 1].isspace() or not text[start:i].strip():
                end = _close(text, i)
                i = max(i, end)
        else:
            put(start, i)
            start = i + 1
        i += 1
    put(start, len(text))
    return out


def bare(value: str) -> str:
    """A value as written, without the marks that enclose all of it; doubled marks inside them mean one."""
    value = value.strip()
    if len(value) > 1 and value[0] in QUOTES and _close(value, 0) == len(value) - 1:
        body = value[1:-1]
        for m in {value[-1], *(value[0] if value[0] == value[-1] else "")}:
            body = body.replace(m + m, m)
        return body.strip()
    return value


def shape(text: str) -> str:
    """What the frequencies are learned of: lower case, digits alike."""
    return re.sub(r"\d", "0", text.lower())


def whole_value(cell: str, at: tuple[int, int]) -> str:
    """The value that a run of pieces makes, from the first one's start to the last one's end."""
    return bare(cell[at[0] : at[1]])


def packed_piece(value: str) -> tuple[str, int] | None:
    """(first two pieces, number of pieces) of a value seen whole that would be cut without its marks; None for others."""
    if not any(c in SEPARATORS for c in value):
        return None
    ps = pieces(value)
    return (_pair(value, ps[0], ps[1]), len(ps)) if len(ps) > 1 and ps[-1][1] == len(value) and ps[0][0] == 0 else None


def _pair(cell: str, a: tuple[int, int], b: tuple[int, int]) -> str:
    return f"{cell[a[0] : a[1]]}\x1f{cell[b[0] : b[1]]}"


def _add(a: float, b: float) -> float:
    """The logarithm of a sum of two numbers given by their logarithms."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _weights(cell_arcs: list[tuple[int, int, float]]) -> dict[tuple[int, int], float]:
    """The posterior chance of each candidate, given as a logarithm, by the forward-backward sums."""
    n = max(j for _, j, _ in cell_arcs)
    fwd, bwd = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    fwd[0] = bwd[n] = 0.0
    logs = sorted(cell_arcs)
    for i, j, p in logs:
        fwd[j] = _add(fwd[j], fwd[i] + p)
    for i, j, p in reversed(logs):
        bwd[i] = _add(bwd[i], p + bwd[j])
    return {(i, j): math.exp(min(0.0, fwd[i] + p + bwd[j] - fwd[n])) for i, j, p in logs} if fwd[n] > -math.inf else {}


def _best(cell_arcs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The likeliest segmentation by the logarithms of chances; of equals the one of more values."""
    n = max(j for _, j, _ in cell_arcs)
    top: list[tuple[float, int, int]] = [(-math.inf, 0, 0)] * (n + 1)
    top[0] = (0.0, 0, 0)
    for i, j, p in sorted(cell_arcs):
        if top[i][0] > -math.inf:
            cand = (top[i][0] + p, top[i][1] + 1, i)
            if (cand[0], cand[1]) > (top[j][0], top[j][1]):
                top[j] = cand
    out, j = [], n
    while j > 0:
        out.append((top[j][2], j))
        j = top[j][2]
    return out[::-1]


def split_values(df: DataFrame, id_col: str, fields: Sequence[str], rounds: int = 3) -> DataFrame:
    """(id, field_name, pos, item_value): one row per value of each cell, positions from 1.

    Null, empty and blank cells give no row; a cell of one value gives one. Empty pieces are no
    values. Rows of a repeated or null id give their values again. Other columns are not read.

    What is learned depends on a cell's shape only, so equal shapes are one row with a count. Values
    seen whole that hold separators make a prefix table, by their first two pieces, of how many pieces
    they have; only runs of pieces that it allows and that are such a value are candidates beside the
    pieces themselves, of any length. Shapes without such a run have one segmentation, so the rounds
    are about the others: they join the candidates to the value frequencies, weigh each shape's
    segmentations, and add up expected counts by value.
    """
    cells = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("cell")) for f in fields])).alias("e")).select("id", "e.*")
    cells = cells.filter(F.col("cell").rlike(r"[\p{L}\p{N}]")).withColumn("shape", F.regexp_replace(F.lower("cell"), r"\p{Nd}", "0"))
    kinds = cells.groupBy("field_name", "shape").agg(F.count("*").alias("n"))

    def expand(batches):
        for b in batches:
            values, pairs, keys, lengths = [], [], [], []
            for s in b.column(1).to_pylist():
                ps = pieces(s)
                own = [shape(whole_value(s, p)) for p in ps]
                values.append(own)
                pairs.append([_pair(s, x, y) for x, y in zip(ps, ps[1:])])
                found = [x for v in own if (x := packed_piece(v))]
                keys.append([k for k, _ in found])
                lengths.append([m for _, m in found])
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, texts), pa.array(pairs, texts), pa.array(keys, texts), pa.array(lengths, pa.list_(pa.int32()))], names=["field_name", "shape", "n", "values", "pairs", "whole_keys", "whole_lengths"])

    lattice = cut_lineage(kinds.mapInArrow(expand, "field_name string, shape string, n bigint, values array<string>, pairs array<string>, whole_keys array<string>, whole_lengths array<int>"))
    prefixes = lattice.select("field_name", F.explode(F.arrays_zip("whole_keys", "whole_lengths")).alias("w")).groupBy("field_name", F.col("w.whole_keys").alias("pair")).agg(F.collect_set("w.whole_lengths").alias("lengths"))
    starts = lattice.select("field_name", "shape", F.posexplode("pairs").alias("i", "pair")).join(prefixes, ["field_name", "pair"]).groupBy("field_name", "shape").agg(F.collect_list(F.struct("i", "lengths")).alias("starts"))

    def runs(batches):
        """Runs of several pieces that the prefix table allows."""
        for b in batches:
            rows: list[tuple] = []
            for f, s, begins in zip(*(b.column(c).to_pylist() for c in ("field_name", "shape", "starts"))):
                ps = pieces(s)
                rows += [(f, s, x["i"], x["i"] + m, shape(whole_value(s, (ps[x["i"]][0], ps[x["i"] + m - 1][1])))) for x in begins for m in x["lengths"] if x["i"] + m <= len(ps)]
            yield _batch(rows, ("field_name", "shape", "i", "j", "value"), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))

    # every piece is a value of its own at first; a run is a candidate if some piece is that value
    single = lattice.select("field_name", "shape", "n", F.posexplode("values").alias("i", "value")).withColumn("j", F.col("i") + 1)
    freq = cut_lineage(single.groupBy("field_name", "value").agg(F.sum(F.col("n").cast("double")).alias("c")))
    joint = cut_lineage(starts.mapInArrow(runs, "field_name string, shape string, i int, j int, value string").join(freq.select("field_name", "value"), ["field_name", "value"], "left_semi"))
    open_ = joint.select("field_name", "shape").distinct()
    arcs = single.join(open_, ["field_name", "shape"], "left_semi")
    counts = lattice.select("field_name", "shape", "n")
    arcs = cut_lineage(arcs.select("field_name", "shape", "n", "i", "j", "value").unionByName(joint.join(counts, ["field_name", "shape"]).select("field_name", "shape", "n", "i", "j", "value")))
    settled = cut_lineage(freq.select("field_name", "value", "c").unionByName(arcs.filter("j = i + 1").select("field_name", "value", (-F.col("n").cast("double")).alias("c"))).groupBy("field_name", "value").agg(F.sum("c").alias("c")))

    def theta(freq: DataFrame) -> DataFrame:
        mass = freq.groupBy("field_name").agg(F.sum("c").alias("mass"))
        more = F.col("j") - F.col("i") - 1
        p = F.log((F.coalesce("c", F.lit(0.0)) + PRIOR * BASE) / (F.col("mass") + PRIOR)) + F.when(more > 0, F.log(F.lit(INNER)) - more * F.log(F.col("mass") + 1)).otherwise(0.0)
        known = arcs.join(freq, ["field_name", "value"], "left").join(F.broadcast(mass), "field_name")  # a row per field
        return known.select("field_name", "shape", "n", F.struct("i", "j", p.alias("p"), "value").alias("arc")).groupBy("field_name", "shape", "n").agg(F.collect_list("arc").alias("arcs"))

    def expect(batches):
        for b in batches:
            rows: list[tuple] = []
            for f, n, cell in zip(*(b.column(c).to_pylist() for c in ("field_name", "n", "arcs"))):
                w = _weights([(a["i"], a["j"], a["p"]) for a in cell])
                rows += [(f, a["value"], n * w.get((a["i"], a["j"]), 0.0)) for a in cell]
            yield _batch(rows, ("field_name", "value", "c"), (pa.string(), pa.string(), pa.float64()))

    for _ in range(rounds - 1):
        counted = theta(freq).mapInArrow(expect, "field_name string, value string, c double")
        freq = cut_lineage(settled.unionByName(counted).groupBy("field_name", "value").agg(F.sum("c").alias("c")))

    def choose(batches):
        cuts = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
        for b in batches:
            best = [[{"i": i, "j": j} for i, j in _best([(a["i"], a["j"], a["p"]) for a in cell])] for cell in b.column("arcs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("field_name"), b.column("shape"), pa.array(best, cuts)], names=["field_name", "shape", "cuts"])

    chosen = theta(freq).mapInArrow(choose, "field_name string, shape string, cuts array<struct<i:int,j:int>>")
    # only shapes with a run of several pieces need their segmentation
    chosen = chosen.filter(F.exists("cuts", lambda c: c["j"] > c["i"] + 1))

    def emit(batches):
        for b in batches:
            memo: dict[str, list[str]] = {}
            parents, positions, values = [], [], []
            for row, (cell, cuts) in enumerate(zip(b.column("cell").to_pylist(), b.column("cuts").to_pylist())):
                own = memo.get(cell) if cuts is None else None
                if own is None:
                    ps = pieces(cell)
                    own = [whole_value(cell, p) for p in ps] if cuts is None else [whole_value(cell, (ps[c["i"]][0], ps[c["j"] - 1][1])) for c in cuts]
                    if cuts is None:
                        memo[cell] = own
                parents += [row] * len(own)
                positions += range(1, len(own) + 1)
                values += own
            at = pa.array(parents, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("field_name").take(at), pa.array(positions, pa.int32()), pa.array(values, pa.string())], names=["id", "field_name", "pos", "item_value"])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = cells.join(chosen, ["field_name", "shape"], "left").select("id", "field_name", "cell", "cuts").mapInArrow(emit, f"id {id_type}, field_name string, pos int, item_value string")
    return rows.withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))

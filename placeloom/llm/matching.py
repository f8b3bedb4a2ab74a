"""Matching two tables of places that share no identifier.

Titles and streets are reduced to MinHash rows, words of titles also to their deletions, in
which words one slip apart always meet; candidates agree in a row or deletion of the title
together with a map cell or with a house number and a row of the street. Pairs get
similarity features, a logistic classifier learns from weak labels which pairs are one
firm, its scores are calibrated on held-out labels, and each object keeps its likeliest place.
"""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.llm.addressparse import _near, parse, signs, to_latin
from placeloom.session import cut_lineage

#: A word is general, as it names a kind of firm or a legal form and does not tell firms apart, if it stands outside the quotation
#: marks of at least so many different titles, and in so large a share of the titles with quotation marks that have it.
GENERAL_TITLES, GENERAL_SHARE = 3, 0.9
#: A word of an address names a town, if another word stands beside the kind of street in at least so many of the rows that have it and tell, and in so large a share of them.
TOWN_ROWS, TOWN_SHARE = 3, 0.9
#: MinHash rows of each word of a title and of a street.
TITLE_ROWS, STREET_ROWS = 3, 2
#: Signs from which a word of a title is keyed by its first and last AFFIX signs; up to there, by its deletions.
LONG_WORD, AFFIX = 24, 10
#: Side of a map cell in degrees of latitude (about 220 m); objects look into the four cells nearest to them.
CELL = 0.002
#: Signs of the endings that words may differ in.
VOWELS = "aeiouyA"
#: Rows of one spot that one task pairs.
SPOT_ROWS = 5_000
#: Hot spots up to which their table is broadcast.
SMALL_ROWS = 100_000
#: Labelled pairs that the classifier is fitted on, at most.
TRAIN_ROWS = 100_000
#: Held-out labels that calibration needs; with fewer the classifier's own chances stand.
CALIBRATED = 40
OWN_CHANCES = [x / 2 for x in range(-16, 17)], [1 / (1 + math.exp(-x / 2)) for x in range(-16, 17)]
FEATURES = ("bias", "contain", "weak", "jaccard", "exact", "no_number", "near", "far", "no_place", "rivals", "same_address", "other_address", "no_address")

ROWS = "side int, id bigint, title string, street array<string>, road array<string>, kind string, ordinal int, number string, lat double, lon double, street_rows array<bigint>"
TITLES = "title string, tokens array<string>, numbers array<string>, title_rows array<bigint>, title_words array<bigint>"
ATTRIBUTES = ("tokens", "numbers", "street", "town", "kind", "ordinal", "number", "lat", "lon")

_QUOTED = re.compile(r'[«"“„]([^«»"“”„]*)[»"”“]')


def title_words(title: str | None) -> tuple[list[str], list[str], list[str]]:
    """The words of a title in signs: all of them, those outside its quotation marks if it has such; and its numbers."""
    t = title or ""
    said = lambda x: re.sub(r"\bno (?=\d)|\bna ([a-z]+oy|[a-z]+om)\b", " ", to_latin(x))
    words = lambda x: sorted({signs(w) for w in re.findall(r"[a-z]+", said(x)) if len(w) > 1})
    numbers = sorted({w.lstrip("0") or "0" for w in re.findall(r"\d+", said(t))})
    return words(t) or sorted({signs(w) for w in re.findall(r"[a-z]+", said(t))}), words(_QUOTED.sub(" ", t)) if _QUOTED.search(t) else [], numbers


def _grams(words: list[str]) -> set[str]:
    return {f"^{w}$"[i : i + 3] for w in words for i in range(max(1, len(w)))}


def minhash(shingles: set[str], rows: int) -> list[int]:
    """For each row, the least of the seeded hashes of all shingles."""
    return [min(xxhash.xxh3_64_intdigest(s, seed=r) for s in shingles) - (1 << 63) for r in range(rows)] if shingles else []


@lru_cache(maxsize=1 << 16)
def street_rows(word: str) -> list[int]:
    return minhash(_grams([word]), STREET_ROWS)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=TITLE_ROWS) - (1 << 63)


def slip_keys(word: str) -> set[int]:
    """Keys of which two words have one in common whenever ``_same`` takes them for one word, if they differ.

    A slip leaves two words a deletion in common; of a long word it leaves the beginning or the end.
    """
    keys = {f"s{word.rstrip(VOWELS)}"} if len(word) >= 5 else set()
    if 3 < len(word) <= LONG_WORD:
        keys |= {f"d{word}", *(f"d{word[:i]}{word[i + 1 :]}" for i in range(len(word)))}
    if len(word) >= LONG_WORD:
        keys |= {f"b{word[:AFFIX]}", f"e{word[-AFFIX:]}"}
    return {_hash(k) for k in keys}


@lru_cache(maxsize=1 << 16)
def word_keys(word: str) -> tuple[tuple[int, int], ...]:
    """(key, word): MinHash rows, whose word is 0, and slip keys of a word. Equal words agree in all rows."""
    own = _hash(word)
    return *((h, 0) for h in minhash(_grams([word]), TITLE_ROWS)), *((h, own) for h in slip_keys(word))


def title_keys(tokens: list[str]) -> list[tuple[int, int]]:
    """The keys of a title's words."""
    return sorted({k for w in tokens for k in word_keys(w)})


def addressed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both tables, from (id, title, address, lat, lon), as one: ``side`` 0 and 1, the address's components and the coordinates in order."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for side, i, title, address, lat, lon in zip(*(c.to_pylist() for c in b.columns)):
                p = parse(address)
                street = [w for w in p.words if len(w) > 3] if p and p.house else []
                road = [w for w, beside in zip(p.words, p.beside) if beside and len(w) > 3] if street else []
                ok = lat is not None and lon is not None and lat == lat and lon == lon and lat != 0 and lon != 0
                if ok and 36 <= lat <= 39.5:
                    lat, lon = lon, lat
                out.append((side, i, title, street, road, p.kind if street else "", p.ordinal if street else 0, p.number if street else "", lat if ok else None, lon if ok else None, [h for w in street for h in street_rows(w)]))
            types = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=[c.split()[0] for c in ROWS.split(", ")])

    slim = lambda df, side: df.select(F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), "title", "address", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return slim(left, 0).unionByName(slim(right, 1)).mapInArrow(run, ROWS)


def towned(rows: DataFrame) -> DataFrame:
    """Rows whose ``street`` is without the words that name the town, which are in ``town``: rows of one town are not in one street.

    Which words do so is learned from the rows that have a word beside a kind of street. A row without another word keeps them as its street.
    """
    each = rows.filter(F.size("road") > 0).select("road", F.explode("street").alias("word"))
    aside = ~F.array_contains("road", F.col("word"))
    towns = each.groupBy("word").agg(F.count_if(aside).alias("aside"), F.count("*").alias("n")).filter((F.col("aside") >= TOWN_ROWS) & (F.col("aside") >= TOWN_SHARE * F.col("n"))).select("word")
    streets = rows.filter(F.size("street") > 0).select("street").distinct()
    named = streets.select("street", F.explode("street").alias("word")).join(towns, "word").groupBy("street").agg(F.collect_set("word").alias("towns"))
    named = named.select("street", F.array_except("street", "towns").alias("rest"), F.array_intersect("street", "towns").alias("town")).filter(F.size("rest") > 0)
    return rows.drop("road").join(named, "street", "left").withColumns({"street": F.coalesce("rest", "street"), "town": F.coalesce("town", F.array().cast("array<string>"))}).drop("rest")


def titled(rows: DataFrame) -> DataFrame:
    """The words that tell firms apart, the numbers and the keys of each distinct title.

    Which words do not tell firms apart is learned from the titles: those that stand outside quotation marks.
    """

    def cut(batches):
        for b in batches:
            found = [title_words(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.list_(pa.string())) for k in range(3))], names=["title", "words", "outside", "numbers"])

    titles = rows.select("title").filter("title is not null").distinct()
    words = cut_lineage(titles.mapInArrow(cut, "title string, words array<string>, outside array<string>, numbers array<string>"))
    each = words.select("title", F.explode("words").alias("word"), F.col("outside"), F.col("title").rlike(_QUOTED.pattern).alias("quoted"))
    out = F.array_contains("outside", F.col("word"))
    general = each.filter("quoted").groupBy("word").agg(F.count_if(out).alias("out"), F.count("*").alias("n")).filter((F.col("out") >= GENERAL_TITLES) & (F.col("out") >= GENERAL_SHARE * F.col("n"))).select("word", F.lit(True).alias("general"))
    telling = each.join(general, "word", "left").filter("general is null").groupBy("title").agg(F.array_sort(F.collect_list("word")).alias("telling"))

    def keyed(batches):
        for b in batches:
            keys = [title_keys(t) for t in b.column("tokens").to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([[k[j] for k in ks] for ks in keys], longs) for j in (0, 1))], names=[c.split()[0] for c in TITLES.split(", ")])

    return words.join(telling, "title", "left").select("title", F.coalesce("telling", "words").alias("tokens"), "numbers").mapInArrow(keyed, TITLES)


def prepared(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables as one, from (id, title, address, lat, lon), with the attributes that pairs are compared by; and the keys of each title."""
    rows = cut_lineage(addressed(left, right))
    titles = cut_lineage(titled(rows))
    words = titles.select("title", "tokens", "numbers")
    whole = towned(rows).join(words, "title", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("tokens", "numbers")})
    return whole, titles.select("title", "title_rows", "title_words")


def placed(rows: DataFrame) -> DataFrame:
    """Rows without coordinates get the middle of the rows, of both tables, that name the same house."""
    house = F.concat_ws("|", F.array_join(F.array_sort(F.array_union("street", "town")), " "), "kind", F.col("ordinal").cast("string"), "number")
    mean = lambda c: F.sum(F.round(F.col(c) * 1e7).cast("long")) / F.count("*") / 1e7  # noqa: E731  sums of whole numbers do not depend on the order of rows
    middle = rows.filter("lat is not null and number <> ''").groupBy(house.alias("house")).agg(mean("lat").alias("mid_lat"), mean("lon").alias("mid_lon"), F.max("lat").alias("top"), F.min("lat").alias("low"))
    middle = middle.filter(F.col("top") - F.col("low") < 0.003)
    lost = F.col("lat").isNull() & (F.col("number") != "")
    found = rows.filter(lost).withColumn("house", house).join(middle.select("house", "mid_lat", "mid_lon"), "house", "left")
    found = found.withColumns({"lat": F.col("mid_lat"), "lon": F.col("mid_lon")}).drop("house", "mid_lat", "mid_lon")
    return rows.filter(~lost).unionByName(found)


def _spots(rows: DataFrame, probes: bool) -> DataFrame:
    """(spot, id, title_rows, title_words): where a row is to be met, by map cell and by house number and street."""
    steps = [0.0] if not probes else [-0.5, 0.5]
    cell = lambda c, scale, d: F.floor(F.col(c) / scale + d)
    near = F.array(*[F.xxhash64(F.lit("c"), cell("lat", CELL, a), cell("lon", 2 * CELL, b)) for a in steps for b in steps])
    here = rows.filter("lat is not null").select(F.explode(near).alias("spot"), "id", "title_rows", "title_words")
    there = rows.filter("number <> ''").select(F.explode(F.transform("street_rows", lambda s: F.xxhash64(F.lit("a"), "number", s))).alias("spot"), "id", "title_rows", "title_words")
    return here.unionByName(there)


def candidates(a: DataFrame, b: DataFrame, titles: DataFrame, spot_rows: int = SPOT_ROWS) -> DataFrame:
    """(id_a, id_b): pairs of prepared rows that agree in a spot and a key of the title; equal words meet in MinHash rows alone.

    A spot with more than ``spot_rows`` rows of ``b`` is spread by salt: those rows keep one each, rows of ``a`` go to all.
    """
    sa, sb = _spots(a.join(titles, "title"), False), _spots(b.join(titles, "title"), True)
    hot = _spots(b.withColumns({"title_rows": F.array(), "title_words": F.array()}), True).groupBy("spot").agg(F.count("*").alias("n")).filter(F.col("n") > spot_rows).select("spot", F.ceil(F.col("n") / spot_rows).cast("int").alias("salts"))
    hot = cut_lineage(hot)
    hot = F.broadcast(hot) if hot.count() <= SMALL_ROWS else hot
    salts = F.coalesce("salts", F.lit(1))
    sa = sa.join(hot, "spot", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    sb = sb.join(hot, "spot", "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    keyed = lambda df, s: df.select(F.col("id").alias(f"id_{s}"), "spot", "salt", F.explode(F.arrays_zip("title_rows", "title_words")).alias("t")).select(f"id_{s}", F.xxhash64("spot", "salt", "t.title_rows").alias("key"), F.col("t.title_words").alias(f"word_{s}"))
    return keyed(sa, "a").join(keyed(sb, "b"), "key").filter("word_a = 0 or word_a <> word_b").select("id_a", "id_b").distinct()


def _same(a: str, b: str) -> bool:
    if a == b or (len(a) > 3 and len(b) > 3 and _near(a, b)):
        return True
    return len(a) >= 5 and len(b) >= 5 and a.rstrip(VOWELS) == b.rstrip(VOWELS)


def _same_road(a: str, b: str) -> bool:
    """Whether two street words are one, up to two slips in a long word."""
    return _same(a, b) or (min(len(a), len(b)) >= 8 and SequenceMatcher(None, a, b, False).ratio() >= 0.8)


class _Lists:
    """A column of lists of words, flat: which row each word is in, its number, and where the rows start."""

    def __init__(self, row: np.ndarray, code: np.ndarray, rows: int):
        self.row, self.code, self.size = row, code, np.bincount(row, minlength=rows)
        self.start = np.cumsum(self.size) - self.size

    def __getitem__(self, keep: np.ndarray) -> "_Lists":
        return _Lists(self.row[keep], self.code[keep], len(self.size))

    def __add__(self, other: "_Lists") -> "_Lists":
        row, code = np.concatenate((self.row, other.row)), np.concatenate((self.code, other.code))
        order = np.argsort(row, kind="stable")
        return _Lists(row[order], code[order], len(self.size))

    def total(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=value, minlength=len(self.size))


class _Words:
    """The distinct words of a batch; pairs of them are compared once."""

    def __init__(self, columns: list[pa.ListArray]):
        flat = [c.flatten() for c in columns]
        coded = pa.concat_arrays([f.cast(pa.string()) for f in flat]).dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        ends = np.cumsum([len(f) for f in flat])
        self.lists = [_Lists(pc.list_parent_indices(c).to_numpy(zero_copy_only=False).astype(np.int64), codes[z - len(f) : z], len(c)) for c, f, z in zip(columns, flat, ends)]

    def any_alike(self, a: _Lists, b: _Lists, alike) -> np.ndarray:
        """For each word of ``a`` whether a word of the same row of ``b`` is like it."""
        many = b.size[a.row]
        left = np.repeat(np.arange(len(a.row)), many)
        right = np.arange(len(left)) + np.repeat(b.start[a.row] - (np.cumsum(many) - many), many)
        key, at = np.unique(a.code[left] * len(self.words) + b.code[right], return_inverse=True)
        x, y = np.divmod(key, max(1, len(self.words)))
        hit = np.fromiter((alike(self.words[i], self.words[j]) for i, j in zip(x.tolist(), y.tolist())), dtype=bool, count=len(key))
        return np.bincount(left, weights=hit[at], minlength=len(a.row)) > 0


def _equal(a: str, b: str) -> bool:
    return a == b


def compared_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    """Per pair the letters in common by the shorter and by both titles, whether titles are equal, whether numbers differ, metres or NaN, and the address: 1 same, -1 other, 0 unknown."""
    n = b.num_rows
    col = b.column
    w = _Words([_list(col(c)) for c in ("tokens_a", "tokens_b", "street_a", "street_b", "numbers_a", "numbers_b", "town_a", "town_b")])
    ta, tb, sa, sb, na, nb, town_a, town_b = w.lists
    # the town or street that a title names beside the firm is in the addresses
    place = sa + sb + town_a + town_b

    def telling(t: _Lists) -> _Lists:
        other = ~w.any_alike(t, place, _same)
        some = t.total(other) > 0
        return t[other | ~some[t.row]]

    ta, tb = telling(ta), telling(tb)
    size_a, size_b = ta.total(w.length[ta.code]), tb.total(w.length[tb.code])
    hit_a = ta.total(w.length[ta.code] * w.any_alike(ta, tb, _same))
    hit_b = tb.total(w.length[tb.code] * w.any_alike(tb, ta, _same))
    short = ta.size <= tb.size
    hit = np.where(short, hit_a, hit_b)
    contain = hit / np.maximum(1, np.where(short, size_a, size_b))
    jaccard = hit / np.maximum(1, size_a + size_b - hit)
    same_set = lambda x, y: (x.size == y.size) & (x.total(w.any_alike(x, y, _equal)) == x.size)
    conflict = ~same_set(na, nb)
    exact = same_set(ta, tb) & ~conflict
    f = lambda c: col(c).to_numpy(zero_copy_only=False).astype(float)
    metres = np.hypot((f("lat_a") - f("lat_b")) * 111320, (f("lon_a") - f("lon_b")) * 111320 * np.cos(np.radians(f("lat_a"))))
    text = lambda c: pc.fill_null(col(c), "")
    is_ = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), dtype=bool)
    known = is_(pc.and_(pc.not_equal(text("number_a"), ""), pc.not_equal(text("number_b"), "")))
    kinds = is_(pc.or_(pc.or_(pc.equal(text("kind_a"), ""), pc.equal(text("kind_b"), "")), pc.equal(text("kind_a"), text("kind_b"))))
    road = sa.total(w.any_alike(sa, sb, _same_road)) > 0
    one = road & kinds & is_(pc.equal(text("number_a"), text("number_b"))) & is_(pc.equal(col("ordinal_a"), col("ordinal_b")))
    address = np.where(known, np.where(one, 1, -1), 0).astype(np.int32)
    assert len(contain) == n
    return pa.RecordBatch.from_arrays([col("id_a"), col("id_b"), *(pa.array(np.asarray(x, dtype=float)) for x in (contain, jaccard, exact, conflict, metres)), pa.array(address)], names=["id_a", "id_b", "contain", "jaccard", "exact", "conflict", "metres", "address"])


def _list(c: pa.Array) -> pa.ListArray:
    return c.cast(pa.list_(pa.string()))


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(id_a, id_b, contain, jaccard, exact, conflict, metres, address) of candidate pairs, whole batches at once."""
    side = lambda df, s: df.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ATTRIBUTES])
    both = pairs.join(side(left, "a"), "id_a").join(side(right, "b"), "id_b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield compared_batch(b)

    return both.mapInArrow(run, "id_a bigint, id_b bigint, contain double, jaccard double, exact double, conflict double, metres double, address int")


def _design(p: pd.DataFrame, known: np.ndarray) -> np.ndarray:
    """The classifier's inputs; ``known`` says where the address may be looked at."""
    m = p["metres"].to_numpy(float)
    lost = np.isnan(m)
    address = np.where(known, p["address"].to_numpy(), 0)
    near = np.where(lost, 0.0, np.minimum(np.nan_to_num(m), 200.0) / 50.0)
    far = np.where(lost, 0.0, np.maximum(0.0, np.minimum(np.nan_to_num(m), 1000.0) - 60.0) / 50.0)
    return np.column_stack(
        [np.ones(len(p)), p["contain"], (p["contain"] < 0.75) | (p["conflict"] > 0), p["jaccard"], p["exact"], p["conflict"], near, far, lost, np.log1p(p["rivals"]), address == 1, address == -1, address == 0]
    ).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; ``weight`` says how many rows each row stands for."""
    w = np.zeros(x.shape[1])
    many = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (many * (p - y)) + ridge * w
        hess = (x * (many * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, knots: int = 20) -> tuple[list[float], list[float]]:
    """Rising calibrated probabilities at the means of groups of scores (pooled adjacent violators).

    Groups hold equal parts of the positives and of the negatives taken together, so that positives are told apart however rare they are.
    """
    many = np.ones(len(y)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    ones, mass = y[order] > 0, many[order]
    part = np.cumsum(np.where(ones, mass / max(1e-9, mass[ones].sum()), mass / max(1e-9, mass[~ones].sum())))
    at = np.linspace(0, part[-1] if len(part) else 0.0, min(knots, max(1, len(order) // 20)) + 1)[1:-1]
    groups = [g for g in np.split(order, np.searchsorted(part, at)) if len(g)]
    blocks: list[list[float]] = []
    for g in groups:
        n = float(many[g].sum())
        blocks.append([float(many[g] @ score[g]) / n, float(many[g] @ y[g]) + 0.5, n + 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s, a, n = blocks.pop()
            t = blocks[-1]
            blocks[-1] = [(t[0] * t[2] + s * n) / (t[2] + n), t[1] + a, t[2] + n]
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


def drawn(labelled: DataFrame, train_rows: int) -> tuple[pd.DataFrame, np.ndarray]:
    """At most ``train_rows`` of the rows of ``label`` and ``draw``, half of them of either label where there are as many, and how many rows each stands for.

    The rarer of the two is drawn more densely: its share falls as tables grow.
    """
    totals = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    half = train_rows // 2
    room = {k: max(half, train_rows - sum(n for j, n in totals.items() if j != k)) for k in totals}
    parts = [
        labelled.filter((F.col("label") == k) & (F.pmod("draw", F.lit(1_000_000_000)) < int(min(1.0, 0.9 * room[k] / n) * 1_000_000_000))).orderBy("draw").limit(room[k]).toPandas()
        for k, n in sorted(totals.items())
    ]
    stands = [totals[p["label"].iloc[0]] / len(p) for p in parts if len(p)]
    weight = np.concatenate([np.full(len(p), x / min(stands)) for p, x in zip((p for p in parts if len(p)), stands)]) if stands else np.zeros(0)
    return pd.concat(parts, ignore_index=True) if parts else labelled.limit(0).toPandas(), weight


def match_places(left: DataFrame, right: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """(id_a, id_b, confidence): the likeliest row of ``left`` for each row of ``right``, of at least ``threshold``.

    Both tables have id, title, address, lat, lon. Rows without a word in the title are matched by
    nothing; null addresses and missing, zero or swapped coordinates are allowed, a row without
    coordinates being placed by other rows of its house. Repeated rows are matched alike, those of
    ``right`` with those of ``left`` in turn; other ties go to the smaller id. Empty tables give an empty table.

    Weak labels: pairs of one address whose titles contain one another are positive; pairs of
    different addresses, or whose titles lack more than a quarter of one another or differ in a number,
    are negative. For half of the labelled
    pairs the address is hidden, so title, distance and number of rivals are learned by themselves.
    The fit uses a sample of at most ``train_rows`` labelled pairs, drawn by hash from either label and
    weighted by its share; all pairs are scored.
    """
    whole, titles = prepared(left, right)
    rows = cut_lineage(alike_rows(cut_lineage(placed(cut_lineage(whole)))))
    a, b = (representatives(rows.filter(F.col("side") == side)) for side in (0, 1))
    seen = cut_lineage(compared(candidates(a, b, titles), a, b).join(a.select(F.col("id").alias("id_a"), "copies"), "id_a"))
    rivals = seen.filter("contain > 0.99 and conflict = 0").groupBy("id_b").agg((F.sum("copies") - 1).alias("rivals"))
    seen = seen.join(rivals, "id_b", "left").fillna({"rivals": 0})
    label = F.when((F.col("address") == 1) & (F.col("contain") > 0.99) & (F.col("conflict") == 0), 1).when((F.col("address") == -1) | (F.col("contain") < 0.75) | (F.col("conflict") == 1), 0)
    labelled = seen.withColumn("label", label).filter("label is not null").withColumn("draw", F.xxhash64("id_a", "id_b", F.lit(7)))
    sample, weight = drawn(labelled, train_rows)
    if not len(sample):
        return seen.select("id_a", "id_b", F.lit(0.0).alias("confidence")).limit(0)
    known = (sample["draw"].to_numpy() // 1_000_003) % 2 == 0
    held = (sample["draw"].to_numpy() // 7_000_003) % 5 == 0
    x, y = _design(sample, known), sample["label"].to_numpy(float)
    if len(set(y)) < 2:
        w, knots = np.zeros(len(FEATURES)), ([0.0], [float(y[0]) if len(y) else 0.0])
    else:
        w = fit_logistic(x[~held], y[~held], weight[~held])
        score = x[held] @ w
        knots = isotonic(score, y[held], weight[held]) if len(score) >= CALIBRATED else OWN_CHANCES

    def run(frames):
        for p in frames:
            s = _design(p, np.ones(len(p), dtype=bool)) @ w
            c = np.interp(s, knots[0], knots[1])
            yield pd.DataFrame({"id_a": p["id_a"], "id_b": p["id_b"], "score": s, "confidence": c})

    scored = seen.mapInPandas(run, "id_a bigint, id_b bigint, score double, confidence double")
    best = scored.groupBy("id_b").agg(F.min_by(F.struct("id_a", "confidence"), F.struct((-F.col("score")).alias("s"), "id_a")).alias("m"))
    best = best.select("m.id_a", F.col("id_b").alias("rep"), "m.confidence").filter(F.col("confidence") >= threshold)
    return shared_out(best, rows)


def alike_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``rep``, the smallest id of the rows of their side with the same attributes: such rows are compared once."""
    told = rows.withColumn("told", F.md5(F.to_json(F.struct("side", *ATTRIBUTES))))
    return told.join(told.groupBy("told").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "told")


def shared_out(best: DataFrame, rows: DataFrame) -> DataFrame:
    """(id_a, id_b, confidence) of pairs of representatives (id_a, rep, confidence): copies of an object go to the copies of its place in turn, in order of ids."""
    turn = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("id")) - 1
    ids = lambda side: rows.filter(f"side = {side}").select("rep", "id", "copies").distinct()
    twins = ids(0).filter("copies > 1").select(F.col("rep").alias("id_a"), "id")
    counts = twins.groupBy("id_a").agg(F.count("*").alias("n"))
    twins = twins.select("id_a", turn("id_a").alias("turn"), F.col("id").alias("twin"))
    pairs = best.join(ids(1), "rep").join(counts, "id_a", "left").withColumn("turn", F.pmod(turn("rep"), F.coalesce("n", F.lit(1))).cast("int"))
    return pairs.join(twins, ["id_a", "turn"], "left").select(F.coalesce("twin", "id_a").alias("id_a"), F.col("id").alias("id_b"), "confidence")


def representatives(rows: DataFrame) -> DataFrame:
    """One row of each class of ``alike_rows``, with its number of copies."""
    return rows.filter("id = rep").dropDuplicates(["id", "told"]).drop("told", "rep", "side")


def register_side(df: DataFrame) -> DataFrame:
    """(id, title, address, lat, lon) of accepted places."""
    return df.select(F.col("final_id").cast("long").alias("id"), "title", "address", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).filter("id is not null")


def mapped_side(df: DataFrame) -> DataFrame:
    """(id, title, address, lat, lon) of mapped objects; ways lie at their centre."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    address: Column = F.when(tag("addr:housenumber").isNotNull(), F.concat_ws(", ", tag("addr:city"), tag("addr:street"), tag("addr:housenumber")))
    return df.select(F.col("osm_id").cast("long").alias("id"), tag("name").alias("title"), address.alias("address"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon")).filter("id is not null")

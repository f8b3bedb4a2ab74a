import random
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeloom.llm import addresses, formatdups, matching, queries, sql, survivor
from placeloom.llm.addressparse import parse

DATA = "/root/testdata/sf0.001"
RAW = "raw_id long, title string, address string, phone string"


def plain_key(t, a, p):
    fold = lambda v: "".join(c for c in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", v or "").casefold()).replace("ё", "е") if c.isalnum())
    parts = sorted(x for x in (fold(x) for x in unicodedata.normalize("NFKC", a or "").replace(";", ",").replace("|", ",").split(",")) if x)
    d = "".join(c for c in unicodedata.normalize("NFKC", p or "") if c.isdigit())
    return fold(t), tuple(parts), "7" + d[1:] if d.startswith("8") else d


def brute(rows):
    first, out = {}, set()
    for i, *v in sorted(rows, key=lambda r: r[0]):
        k = plain_key(*v)
        if k in first:
            out.add((first[k], i))
        first.setdefault(k, i)
    return out


@pytest.mark.parametrize("capacity", [1, 3, 50, 100_000])
def test_format_duplicates_equal_brute_force(spark, clash, capacity):
    r = random.Random(3)
    rows = [(1, "Кафе «Ёж»", "Город, ул. Мира, 5", "8 (000) 1"), (2, "КАФЕ ЕЖ", "ул Мира|5 ;город", "+7-000-1"), (3, "кафе еж", "ул Мира 5, город", "70001"), (4, None, "", "—"), (5, " ", None, ""), (6, "Ⅷ ①", "ａ", "８1"), (7, "VIII 1", "A", "71")]
    names = ["Рыжий Горшок", "рыжий  горшок!", "Белый Ёж", "БЕЛЫЙ ЕЖ", "x" * 3000, "x" * 3000 + "y"]
    rows += [(100 + i, r.choice(names), r.choice(["а, б", "б;а", "в", None]), r.choice(["8 1", "71", ""])) for i in range(300)]
    rows += [(1000 + i, "Сеть", "Мира 1", "8") for i in range(150)]  # a third in one content
    df = clash(spark.createDataFrame(rows, RAW)).repartition(5)
    got = [(x.first_id, x.row_id) for x in formatdups.format_duplicates(df, capacity=capacity).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_format_duplicates_of_the_test_table(spark):
    df = spark.read.parquet(f"{DATA}/raw_places.parquet")
    rows = [tuple(r) for r in df.select("raw_id", "title", "address", "phone").collect()]
    assert {(x.first_id, x.row_id) for x in formatdups.format_duplicates(df, capacity=40).collect()} == brute(rows)
    assert formatdups.format_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [2, 100_000])
def test_format_counts_add_up(spark, clash, capacity):
    rows = [(9, "а б", "x, y", "8 1"), (3, "АБ", "y|x", "7-1"), (4, None, "", "—"), (7, "", " ", None), (8, "АБ", "y|x", "7-1"), (5, "z", None, None), (None, "z", None, None)]
    df = clash(spark.createDataFrame(rows, RAW))
    assert sorted(map(tuple, formatdups.format_counts(df, capacity=capacity).collect())) == [(3, 3), (4, 2), (5, 1)]
    assert formatdups.format_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p5_found", "p5_counts"])
def test_duplicates_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW raw_places AS SELECT * FROM '/root/testdata/sf0.01/raw_places.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql.oracle_sql()[name]})").fetchall())


def test_bucket_tries_count_at_terminals():
    t = formatdups.BucketTrie()
    keys = [b"", b"abcdefgh", b"abcdefghi", b"abcdefgh", b"abcdefghabcdefgh", b"abcdefghabcdefghx", b"", b"abcdefgh"]
    ends = [t.add(k, 0, 10 - i) for i, k in enumerate(keys)]
    assert [tuple(e) for e in ends] == [(4, 2), (3, 3), (8, 1), (3, 3), (6, 1), (5, 1), (4, 2), (3, 3)] and len(t.terminals) == 5


def test_survivors_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW raw_places AS SELECT * FROM '{DATA}/raw_places.parquet'")
    want = sorted(con.sql("SELECT place_id, field_name, raw_id FROM (" + sql.oracle_sql()["p6_found"] + ")").fetchall())
    assert sorted(map(tuple, queries.queries()["p6_found"](spark, DATA).collect())) == want


def test_survivor_ties_blanks_and_unreadable_records(spark, clash):
    cols = "raw_id long, place_id string, detail_level string, source_records string, captured_at timestamp, address string, phone string, website string, opening_hours string, email string"
    row = lambda i, pid, lv, rec, a: (i, pid, lv, rec, None, a, None, "—", "", " ")
    rows = [row(1, "5", "LIST", "[1,2,3]", "x"), row(2, " 5 ", "list ", "[1,2,3]", "y"), row(3, "5", "CARD", "[cut", "…"), row(4, "6", "CARD", None, "z"), row(5, None, "CARD", None, "z"), row(6, " ", None, None, "z"), row(7, "7", None, "{}", "q"), row(8, "7", "FULL", '[{"a":1}]', "r")]
    got = sorted(map(tuple, survivor.trusted_survivors(clash(spark.createDataFrame(rows, cols))).collect()))
    assert got == [("5", "address", 1), ("7", "address", 8)]
    assert survivor.trusted_survivors(spark.createDataFrame([], cols)).count() == 0


def test_fusion_discounts_copies(spark):
    r = random.Random(4)
    rows = []
    for i in range(150):
        truth = f"t{i}"
        for s, acc in (("a", 0.8), ("b", 0.75), ("c", 0.75), ("d", 0.7)):
            rows.append((str(i), s, truth if r.random() < acc else f"f{i}{s}{r.randint(0, 9)}"))
        bad = truth if r.random() < 0.3 else f"w{i}"
        rows += [(str(i), s, bad) for s in ("x", "y", "z")]  # y and z copy x
    df = spark.createDataFrame(rows, "place_id string, source string, address string")
    got = survivor.fuse_claims(survivor.claims_of(df, ("address",)), rounds=4).collect()
    right = sum(x.value == f"t{x.object}" for x in got)
    votes = {}
    for o, _, v in rows:
        votes.setdefault(o, []).append(v)
    majority = sum(max(sorted(set(v)), key=v.count) == f"t{o}" for o, v in votes.items())
    assert len(got) == 150 and right > majority and right >= 120, (right, majority)
    assert survivor.fuse_claims(survivor.claims_of(df.limit(0), ("address",))).count() == 0


def test_copying_is_told_with_its_direction(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        for s, acc in (("a", 0.9), ("b", 0.75), ("c", 0.7), ("d", 0.7)):
            rows.append((str(i), s, f"t{i}" if r.random() < acc else f"f{i}{r.randint(0, 19)}"))
        own = f"t{i}" if r.random() < 0.3 else f"f{i}{r.randint(0, 19)}"
        rows.append((str(i), "copier", rows[-4][2] if r.random() < 0.7 else own))  # of a
    table = {}
    for i, s, v in rows:
        table.setdefault(i, {})[s] = v
    accuracy = {s: sum(t[s] == f"t{i}" for i, t in table.items()) / 400 for s in ("a", "b", "c", "d", "copier")}
    names = sorted(accuracy)

    def counts(x, y):
        same = [(t[x] == f"t{i}") for i, t in table.items() if t[x] == t[y]]
        return (names.index(x), names.index(y), 0.0, float(sum(same)), float(len(same) - sum(same)), float(400 - len(same)))

    pairs = pd.DataFrame([counts(x, y) for x, y in (("a", "copier"), ("a", "b"), ("c", "d"))], columns=["one", "other", "alike", "same_true", "same_false", "differ"])
    forth, back, none = survivor.dependences(pairs, np.array([accuracy[n] for n in names]), 20.0, 0.1, 0.8)
    assert back[0] > 0.9 > 0.1 > forth[0] and none[1] > 0.9 and none[2] > 0.9, (forth, back, none)
    df = spark.createDataFrame(rows, "place_id string, source string, address string")
    got = {x.object: x.value for x in survivor.fuse_claims(survivor.claims_of(df, ("address",))).collect()}
    assert len(got) == 400 and sum(v == f"t{i}" for i, v in got.items()) > 400 * accuracy["a"]


def test_fusion_of_ties_hot_objects_and_repeats(spark, clash):
    rows = [("1", "s1", "б"), ("1", "s2", "а"), ("2", None, "x"), (None, "s1", "y"), ("3", "s1", None), ("3", "s2", " — ")] + [("hot", f"s{i % 40}", f"v{i % 7}") for i in range(3000)]
    df = clash(spark.createDataFrame(rows, "place_id string, source string, address string")).repartition(7)
    got = {x.object: x.value for x in survivor.fuse_claims(survivor.claims_of(df, ("address",))).collect()}
    assert set(got) == {"1", "2", "hot"} and got["1"] == "а" and got["2"] == "x" and got["hot"] in {f"v{i}" for i in range(7)}
    same = {x.object: x.value for x in survivor.fuse_claims(survivor.claims_of(df.unionByName(df), ("address",))).collect()}
    assert same == got


ADDRESSES = [
    (1, "г. Вельск, ул. Лесновская, д. 5 корп. 2"), (2, "Вельск г, Лесновская улица, 5к2"), (3, "000001, ВЕЛЬСК ГОРОД, , , , УЛИЦА ЛЕСНОВСКАЯ, Д.5, 2, , ПОМ.3"), (4, "Лecнoвcкaя ул., 5 к. 2, г. Вельск, этаж 3"),
    (5, "ul. Lesnovskaya, d. 5k2, g. Velsk"), (6, "г. Вельск, ул. Лесновсакя, 5к2"), (7, "г. Вельск, ул. Лесновская, 5"), (8, "г. Вельск, ул. Лесновская, 5А к2"), (9, "г. Вельск, Лесновский пер., 5к2"),
    (10, "г. Вельск, 2-я Лесновская ул., 5к2"), (11, "г. Вельск, вторая Лесновская улица, д.5 к.2"), (12, "пос. Выселки, ул. Лесновская, 5к2"), (13, None), (14, ""), (15, "г. Вельск"), (16, "г. Вельск, ул. Лесновская"), (17, "см. сайт"),
    (18, "г. Вельск, Садовинская ул., 7 стр. 1"), (19, "7с1, Садовинская, Вельск"), (20, "г. Вельск, Садовинская ул., 7 стр. 1"), (21, "г. Вельск, пос. Выселки, Лесновская, № 5к2"), (22, "x" * 20000),
]


def test_buildings_are_told_apart_and_together(spark, clash):
    full = [(100 + i, f"г. Вельск, ул. Лесновская, д. {60 + i}") for i in range(6)] + [(200 + i, f"пос. Выселки, ул. Лесновская, д. {60 + i}") for i in range(4)] + [(300 + i, f"г. Вельск, ул. Садовинская, {80 + i}") for i in range(4)]
    df = clash(spark.createDataFrame(ADDRESSES + full, "addr_id long, address string"))
    for group_rows in (2000, 2):
        got = [(r.addr_id_a, r.addr_id_b) for r in addresses.same_building(df, group_rows=group_rows).collect()]
        groups = [(1, 2, 3, 4, 5, 6), (10, 11), (12, 21), (18, 19, 20)]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for g in groups for a in g for b in g if a < b}
    assert addresses.same_building(df.limit(0)).count() == 0


def test_slips_of_short_words_are_corrected_in_their_postcode(spark):
    rows = [(i, f"000010, г. Вельск, ул. Гать, д. {60 + i}") for i in range(10)] + [(100 + i, f"000020, г. Вельск, ул. Лесновская, д. {60 + i}") for i in range(15)]
    rows += [(200, "000010, г. Вельск, ул. Гтаь, д. 60"), (201, "000010, г. Вельск, ул. Гатт, д. 61"), (202, "000030, пос. Выселки, ул. Гатл, д. 5"), (203, "000030, пос. Выселки, ул. Гатл, д. 5")]
    got = {(r.addr_id_a, r.addr_id_b) for r in addresses.same_building(spark.createDataFrame(rows, "addr_id long, address string")).collect()}
    assert got == {(0, 200), (1, 201), (202, 203)}


def test_parts_of_one_address():
    p = parse("000030, № 26-Б к. 1, ул. 3-я Зочтученская, (оф. 60), ТЦ «Короб», пав. 2")
    assert (p.number, p.kind, p.ordinal, p.postcode) == ("26b|1|", "ulitsa", 3, "000030")
    assert parse("д.50Ак5с2; пер Нобкуденский").number == "50a|5|2"
    assert parse("ПЕРЕУЛОК ЛУЦРУГНЫЙ, ДОМ 10, , СТР.3, ПОМ.37").number == "10||3"


@pytest.mark.parametrize(
    "address, number, kind, ordinal, words",
    [
        ("Ленина, 5/7", "5/7||", "", 0, ["lenina"]),
        ("ул. Ленина 05-7", "5-7||", "ulitsa", 0, ["lenina"]),
        ("Ленина, 57 б", "57b||", "", 0, ["lenina"]),
        ("Ленина 5а/7к2", "5a/7|2|", "", 0, ["lenina"]),
        ("8 Марта, д. 1", "1||", "", 8, ["marta"]),
        ("ул. 8 Марта 15", "15||", "ulitsa", 8, ["marta"]),
        ("восьмого марта ул., 15", "15||", "ulitsa", 8, ["marta"]),
        ("ул. 1 Мая", "||", "ulitsa", 1, ["maA"]),
        ("улица 50 лет Октября, 12к2", "12|2|", "ulitsa", 50, ["oktAbrA"]),
        ("1905 года ул., дом 3", "3||", "ulitsa", 1905, ["goda"]),
        ("26 Бакинских Комиссаров ул., 5", "5||", "ulitsa", 26, ["bakinskiH", "komissarov"]),
        ("12 Ленина ул.", "12||", "ulitsa", 0, ["lenina"]),
        ("ул. Ленина 5, дом 7", "7||", "ulitsa", 0, ["lenina"]),
        ("стр. 3, д. 5, пр-т Мира", "5||3", "prospekt", 0, ["mira"]),
    ],
)
def test_components_of_least_cost(address, number, kind, ordinal, words):
    p = parse(address)
    assert (p.number, p.kind, p.ordinal, p.words) == (number, kind, ordinal, words)


def test_numbers_are_vetoes_and_names_are_whole(spark, clash):
    rows = [(1, "г. Вельск, ул. Ленина, 5"), (2, "г. Вельск, ул. Ленина, 5/7"), (3, "г. Вельск, ул. Ленина, 5/9"), (4, "г. Вельск, ул. Ленина, 57"), (5, "г. Вельск, ул. Ленина, 5-7"), (6, "Ленина ул. 5/7, г. Вельск")]
    rows += [(10, "г. Вельск, 8 Марта, д. 1"), (11, "г. Вельск, 8 Марта, д. 3"), (12, "г. Вельск, ул. 8 Марта, 1"), (13, "г. Вельск, ул. 3 Марта, 1")]
    rows += [(20 + i, f"г. Вельск, ул. Карла {n}, д. {h}") for i, (n, h) in enumerate((n, h) for n in ("Маркса", "Либкнехта") for h in (1, 2, 3, 4))]
    rows += [(40, "п. Дальний, ул. Ленина, 5"), (41, "Ленина, 5, п. Дальний")]
    df = clash(spark.createDataFrame(rows, "addr_id long, address string"))
    assert {(r.addr_id_a, r.addr_id_b) for r in addresses.same_building(df).collect()} == {(2, 6), (10, 12), (40, 41)}
    got = {r.addr_id: (r.class_id, r.links) for r in addresses.building_classes(df).collect()}
    assert len(got) == len(rows) and got[6] == (2, 1) and got[41] == (40, 1) and got[1] == (1, 0)
    assert addresses.building_classes(df.limit(0)).count() == 0


def planted(seed):
    r = random.Random(seed)
    left, right, truth = [], [], set()
    word = lambda: "".join(r.choice("бвгдклмнпрст") + r.choice("аеиоу") for _ in range(3)).capitalize()
    for i in range(400):
        name, lat, lon = f"{word()} {word()}", 55 + r.random() * 0.2, 37 + r.random() * 0.2
        name = "Рыжий Горшок" if i % 10 == 0 else name
        street, house = f"{word()}ская улица", str(r.randint(1, 90))
        left.append((i, f"Кафе «{name}»", f"Город, {street}, {house}" if r.random() < 0.9 else None, lat, lon))
        if r.random() < 0.6:
            j = 1000 + i
            title = r.choice([name, name.upper(), f"{name} (кафе)", f"ООО \"{name}\""])
            right.append((j, title, f"{street}, д. {house}" if r.random() < 0.6 else None, lat + r.gauss(0, 0.00015), lon + r.gauss(0, 0.00025)))
            truth.add((i, j))
    right += [(5000 + i, f"{word()} {word()}", None, 55 + r.random() * 0.2, 37 + r.random() * 0.2) for i in range(100)]
    right += [(6000, None, None, None, None), (6001, "", "", 0.0, 0.0), (6002, "x" * 5000, None, 55.1, 37.1)]
    return left, right, truth


def test_matching_finds_planted_firms(spark, clash):
    left, right, truth = planted(5)
    schema = "id long, title string, address string, lat double, lon double"
    out = matching.match_places(clash(spark.createDataFrame(left, schema)), clash(spark.createDataFrame(right, schema))).collect()
    got = {(r.id_a, r.id_b) for r in out}
    assert len({b for _, b in got}) == len(out)
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got), (len(got), len(truth), len(got & truth))
    sure = [r for r in out if r.confidence > 0.9]
    assert sum((r.id_a, r.id_b) in truth for r in sure) >= 0.95 * len(sure)


def test_pairs_are_compared_as_one_by_one(spark):
    left, right, _ = planted(9)
    schema = "id long, title string, address string, lat double, lon double"
    both, _ = matching.prepared(*(spark.createDataFrame(x, schema) for x in (left[:60], right[:60])))
    a, b = both.filter("side = 0"), both.filter("side = 1")
    pairs = a.select(F.col("id").alias("id_a")).join(b.select(F.col("id").alias("id_b")), F.lit(True))
    rows = {s: {x.id: x for x in df.collect()} for s, df in (("a", a), ("b", b))}
    got = matching.compared(pairs, a, b).collect()
    assert len(got) == len(rows["a"]) * len(rows["b"])
    same = matching._same
    for r in got:
        x, y = rows["a"][r.id_a], rows["b"][r.id_b]
        place = [*x.street, *y.street]
        s, t = ([w for w in v if not any(same(w, p) for p in place)] or v for v in (x.tokens, y.tokens))
        short, long_ = (s, t) if len(s) <= len(t) else (t, s)
        hit = sum(len(w) for w in short if any(same(w, v) for v in long_))
        size = lambda ws: sum(map(len, ws))
        assert abs(r.contain - hit / max(1, size(short))) < 1e-9 and abs(r.jaccard - hit / max(1, size(short) + size(long_) - hit)) < 1e-9
        assert (r.exact, r.conflict) == (float(s == t and x.numbers == y.numbers), float(x.numbers != y.numbers))
        road = any(matching._same_road(p, q) for p in x.street for q in y.street)
        alike = road and x.number == y.number and x.ordinal == y.ordinal and (not x.kind or not y.kind or x.kind == y.kind)
        assert r.address == (0 if not x.number or not y.number else 1 if alike else -1)


def test_copies_of_rows_are_matched_as_their_representative(spark):
    left, right, _ = planted(5)
    schema = "id long, title string, address string, lat double, lon double"
    run = lambda x, y: {(r.id_a, r.id_b) for r in matching.match_places(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema)).collect()}
    got = run(left, [*right, *((20_000 + r[0], *r[1:]) for r in right)])
    assert {(a, b - 20_000) for a, b in got if b >= 20_000} == {(a, b) for a, b in got if b < 20_000}
    assert len(got) > 300


def test_copies_of_both_sides_are_matched_in_turn(spark):
    left, right, _ = planted(5)
    schema = "id long, title string, address string, lat double, lon double"
    copied = lambda x: [(20_000 * k + r[0], *r[1:]) for k in range(3) for r in x]
    got = [(r.id_a, r.id_b) for r in matching.match_places(spark.createDataFrame(copied(left), schema), spark.createDataFrame(copied(right), schema)).collect()]
    assert len(got) == len({b for _, b in got}) > 600
    assert all(a // 20_000 == b // 20_000 for a, b in got)


def test_calibration_tells_rare_positives():
    r = np.random.default_rng(3)
    y = (np.arange(20_000) % 100 == 0).astype(float)
    score = r.normal(size=len(y)) + 8 * y
    for weight in (None, np.where(y > 0, 1.0, 40.0)):
        x, p = matching.isotonic(score, y, weight)
        assert np.interp(8.0, x, p) > 0.9 and np.interp(1.0, x, p) < 0.1
    some = np.concatenate((np.flatnonzero(y), np.flatnonzero(y == 0)[:500]))
    weight = np.where(y[some] > 0, 1.0, (y == 0).sum() / 500)
    x = np.column_stack((np.ones(len(y)), score / 4))
    assert np.allclose(matching.fit_logistic(x[some], y[some], weight), matching.fit_logistic(x, y), rtol=0.3)


def test_labels_are_drawn_of_either_kind(spark):
    df = spark.range(20_000).select((F.col("id") % 100 == 0).cast("int").alias("label"), F.xxhash64("id").alias("draw"))
    sample, weight = matching.drawn(df, 1_000)
    ones = sample["label"].to_numpy() == 1
    assert len(sample) <= 1_000 and ones.sum() >= 170 and (~ones).sum() >= 650
    assert abs(weight[~ones].sum() / weight[ones].sum() - 99) < 1e-6


def test_rare_pairs_of_one_firm_are_found_among_many_branches(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("бвгдклмнпрст") + r.choice("аеиоу") for _ in range(3)).capitalize()
    left, right, truth = [], [], set()
    for spot in range(16):
        lat, lon = 55 + spot * 0.02, 37.0
        for i in range(36):
            k, house = 100 * spot + i, f"{i + 1}"
            street = f"{word()}ская улица"
            at = lat + (i // 6) * 0.00035, lon + (i % 6) * 0.0006
            left.append((k, "Кафе «Рыжий Горшок»", f"Вельск, {street}, {house}", *at))
            if i % 3 == 0:
                right.append((10_000 + k, "Рыжий Горшок", f"Вельск, {street}, д. {house}", at[0] + r.gauss(0, 0.00004), at[1] + r.gauss(0, 0.00007)))
                truth.add((k, 10_000 + k))
    schema = "id long, title string, address string, lat double, lon double"
    got = {(x.id_a, x.id_b) for x in matching.match_places(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got), (len(got), len(truth), len(got & truth))


def test_one_town_is_not_one_street(spark):
    left = [(i, "Кафе «Рыжий Горшок»", f"Вельск, {s}, 7", 55.0 + i, 37.0) for i, s in enumerate(("Лесная улица", "Садовая улица", "Речная улица", "Горная улица"))]
    right = [(10 + i, "Рыжий Горшок", f"Вельск, {s}, 7", 55.0 + i, 37.0) for i, s in enumerate(("Лесная улица", "Садовая ул.", "Речная", "Горная улица"))]
    schema = "id long, title string, address string, lat double, lon double"
    both, _ = matching.prepared(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    a, b = both.filter("side = 0"), both.filter("side = 1")
    pairs = a.select(F.col("id").alias("id_a")).join(b.select(F.col("id").alias("id_b")), F.lit(True))
    assert {(x.id_a, x.id_b): x.address for x in matching.compared(pairs, a, b).collect()} == {(i, 10 + j): 1 if i == j else -1 for i in range(4) for j in range(4)}


def test_matching_of_empty_tables(spark):
    schema = "id long, title string, address string, lat double, lon double"
    empty = spark.createDataFrame([], schema)
    assert matching.match_places(empty, empty).count() == 0


def test_titles_of_one_word_with_a_slip_are_candidates(spark):
    r = random.Random(11)
    letters = "бвгдклмнпрстаеиоу"
    left, right = [], []
    for i in range(300):
        w = "".join(r.choice(letters) for _ in range(r.choice([4, 5, 6, 7, 8, 23, 24, 25, 40])))
        k = r.randrange(len(w) - 1)
        slipped = r.choice([w[:k] + r.choice(letters) + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[: k + 1] + w[k + 2 :] if len(w) > 4 else w, w[:-1] + "ое" if len(w) > 5 else w])
        lat = 55 + i * 0.01
        at = (None, None) if i % 3 == 0 else (lat, 37.0)
        left.append((i, f"Кафе «{w}»", f"Город, Лесная улица, {i + 1}", *at))
        right.append((1000 + i, slipped, f"Лесная улица, д. {i + 1}", *at))
    schema = "id long, title string, address string, lat double, lon double"
    rows, titles = matching.prepared(*(spark.createDataFrame(x, schema) for x in (left, right)))
    a, b = rows.filter("side = 0"), rows.filter("side = 1")
    got = {(x.id_a, x.id_b) for x in matching.candidates(a, b, titles).collect()}
    assert {(x.id_a, x.id_b) for x in matching.candidates(a, b, titles, spot_rows=1).collect()} == got
    ta, tb = ({x.id: x.tokens for x in df.collect()} for df in (a, b))
    assert not any("kafe" in t for t in ta.values())
    alike = {(i, 1000 + i) for i in range(300) if any(matching._same(x, y) or x == y for x in ta[i] for y in tb[1000 + i])}
    assert len(alike) >= 250 and alike <= got, (len(alike), sorted(alike - got)[:5])

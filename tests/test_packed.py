import re

from placeloom.operators import packed

SCHEMA = "final_id long, categories string, phone string"
EXT = re.compile(r"\(?\s*(доб|вн|ext|доб\.|добавочный)[\s.]*\d", re.I)


def plain(cell):
    """Every separator outside quotes splits, an extension stays with its number."""
    out, cur, i, quoted = [], "", 0, None
    while i < len(cell):
        c = cell[i]
        if quoted:
            cur += c
            if c in packed.QUOTES[quoted]:
                if cell[i + 1 : i + 2] == c:
                    cur += c
                    i += 1
                else:
                    quoted = None
        elif c in packed.QUOTES and not cur.strip():
            quoted, cur = c, cur + c
        elif c in ",;|/\n\r":
            out.append((cur, c))
            cur = ""
        else:
            cur += c
        i += 1
    out.append((cur, ""))
    vals, glue = [], ""
    for v, sep in out:
        if vals and EXT.match(v.strip()):
            vals[-1] += glue + v
        elif re.search(r"[^\W_]", v):
            vals.append(v)
        glue = sep if not vals or v.strip() else glue + sep
    return [packed.bare(v) for v in vals]


def got(df, fields=("categories", "phone")):
    out = {}
    for r in packed.split_values(df, "final_id", fields).collect():
        out.setdefault((r.final_id, r.field_name), {})[r.pos] = r.item_value
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in out.values())
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_quotes_extensions_and_blanks(spark, clash):
    rows = [
        (1, 'кафе, "бар, паб"; «торты; пироги» | "магазин ""всё"""', "+7 000 000-00-00, доб. 12; 8(000)1112233"),
        (2, None, ""),
        (3, " — ", "|;, 8 000 000 00 00 (вн. 5) /"),
        (4, "кафе", "80000000000 ext. 9"),
        (5, '"кафе', "доб. 7"),
        (6, "кафе\nбар\r\nпекарня", None),
        (6, "кафе,,бар,", None),
    ]
    df = clash(spark.createDataFrame(rows[:-1], SCHEMA))
    assert got(df) == {
        (1, "categories"): ["кафе", "бар, паб", "торты; пироги", 'магазин "всё"'],
        (1, "phone"): ["+7 000 000-00-00, доб. 12", "8(000)1112233"],
        (3, "phone"): ["8 000 000 00 00 (вн. 5)"],
        (4, "categories"): ["кафе"],
        (4, "phone"): ["80000000000 ext. 9"],
        (5, "categories"): ['"кафе'],
        (5, "phone"): ["доб. 7"],
        (6, "categories"): ["кафе", "бар", "пекарня"],
    }


def test_equals_plain_splitting_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/final_filtered.parquet")
    fields = ("categories", "detected_category_group", "phone")
    want = {}
    for r in df.select("final_id", *fields).collect():
        for f in fields:
            v = plain(r[f] or "")
            if v:
                want[(r.final_id, f)] = v
    assert got(df, fields) == want


def test_values_learned_from_quotes_are_kept_whole_without_them(spark):
    rows = [(i, '"бар, паб"', None) for i in range(30)] + [(i + 50, "кафе, чай", None) for i in range(5)] + [(99, "кафе; бар, паб", None)]
    assert got(spark.createDataFrame(rows, SCHEMA))[(99, "categories")] == ["кафе", "бар, паб"]


def test_a_value_learned_whole_may_have_any_number_of_pieces(spark):
    for known in (299, 5):
        rows = [(i, '"a, b, c, d, e, f"', None) for i in range(known)] + [(900, "a, b, c, d, e, f", None), (901, "x; y; a; b", None), (902, "g, h; i", None)]
        out = got(spark.createDataFrame(rows, SCHEMA))
        assert out[(900, "categories")] == ["a, b, c, d, e, f"]
        assert out[(901, "categories")] == ["x", "y", "a", "b"] and out[(902, "categories")] == ["g", "h", "i"]
    often = [(i, "кафе, бар", None) for i in range(40)] + [(50, '"кафе, бар"', None)]
    assert got(spark.createDataFrame(often, SCHEMA))[(7, "categories")] == ["кафе", "бар"]


def test_empty_table_repeats_and_long_cells(spark):
    assert packed.split_values(spark.createDataFrame([], SCHEMA), "final_id", ("phone",)).count() == 0
    many = ",".join(f"слово{i}" for i in range(2000))
    df = spark.createDataFrame([(1, many, None), (1, "a;b", None), (1, "a;b", None)], SCHEMA)
    assert packed.split_values(df, "final_id", ("categories",)).count() == 2004
    long_ = ", ".join(f"часть{chr(1072 + i // 20)}{chr(1072 + i % 20)}" for i in range(300))
    df = spark.createDataFrame([(i, f'"{long_}"', None) for i in range(9)] + [(20, f"x; {long_}", None)], SCHEMA)
    assert got(df, ("categories",))[(20, "categories")] == ["x", long_]

import base64
import os

import pytest
import tiktoken
from pyspark.sql import functions as F

from placeloom.llm import encoding, mixing, splitting
from placeloom.llm.mph import PerfectHash
from placeloom.llm.tokenizing import BYTE_PATTERN, TOKENIZER_DIR, UNITS, ByteBpe, coarse_cut, engine

DATA = "/root/testdata/sf0.001"
NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k")
ODD = ["", " ", "\n", "12", " 7", "áb 1²½ ", "'S it's I'LL 1's", "<|endoftext|> <s> </s>", "  \n\n x\r\n\ty  ", "▁ a▁▁ b1²³4 12٣", "\n 12\n\n  ab 3", "á 1̈", "x" * 3000, "слово" * 1500, "\U0001f600\U0001f1f7 ‍﻿", "\x1c\x1d a\x85b c", "00:01:02,760 --> 00:01:04,298\r\n"]


def reference(name):
    at = lambda ext: os.path.join(TOKENIZER_DIR, name + ext)
    if os.path.exists(at(".tiktoken")):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(at(".tiktoken"), "rb"))}
        return tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if os.path.exists(at(".model")):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=at(".model")).encode
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(at(".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def texts():
    import duckdb

    return [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]


@pytest.mark.parametrize("name", NAMES)
def test_engines_equal_the_public_libraries(name):
    want, eng = reference(name), engine(name)
    for t in ODD + texts():
        assert eng.encode(t) == list(want(t)), t[:80]


@pytest.mark.parametrize("name", NAMES)
def test_token_ends_add_up_to_the_text(name):
    eng = engine(name)
    for t in ODD + texts()[:20]:
        if t and eng.encode(t):
            flat, _ = UNITS.number([eng.cut(t) if eng.special(t) else coarse_cut(t)])
            ends = eng.table().token_ends(flat)
            done = [e if e >= 0 else -1 - e for e in ends.tolist()]
            assert done == sorted(done) and done[-1] <= len(t)
            if name != "word_bpe_49k":
                assert ends[-1] == len(t)


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = PerfectHash(keys, range(3000))
    assert h.lookup(keys).tolist() == list(range(3000))
    assert sorted(h.value.tolist()) == list(range(3000))
    assert (h.lookup([b"x", b"", b"k3000"]) == -1).all()
    assert PerfectHash([], []).lookup([b"a"]).tolist() == [-1]


def test_encode_table_with_nulls_repeats_and_clashing_columns(spark, clash):
    rows = [(1, None), (2, ""), (3, "Привет, мир"), (3, "Привет, мир"), (None, "a"), (4, "12² x")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = encoding.encode_texts(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    want = reference("byte_bpe_50k")
    assert sorted(map(str, [(r.doc_id, r.ids) for r in got.collect()])) == sorted(map(str, [(i, want(t or "")) for i, t in rows]))
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    counts = encoding.count_tokens(df, "doc_id", "text", keep=("n",)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counts) == sorted((i or 0, len(want(t or ""))) for i, t in rows)


def test_mix_meets_targets_and_caps(spark, clash):
    docs = clash(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    targets = spark.read.parquet("/root/testdata/sf0.01/mix_targets.parquet")
    mix = mixing.mix_sources(docs, targets)
    assert mix.count() == docs.count()
    caps = {r.doc_source: r.max_repeats for r in targets.collect()}
    rows = mix.collect()
    assert all(0 <= r.copies <= caps.get(r.doc_source, 0) for r in rows)
    assert all(r.copies == 0 for r in rows if not r.n_tokens)
    shares = mixing.mix_shares(mix, targets).collect()
    assert abs(sum(r.share for r in shares) - 1) < 1e-9
    assert all(abs(r.share - r.weight) < 0.01 for r in shares), shares
    # the largest mix of these shares: some source gives all it may, and the others their part of it
    most = {r.doc_source: r.available_tokens * r.max_repeats / r.weight for r in shares}
    full = min(most, key=most.get)
    assert all(r.copies == caps[full] for r in rows if r.doc_source == full and r.n_tokens)
    assert all(abs(r.mixed_tokens - most[full] * r.weight) < 0.01 * most[full] for r in shares)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs, targets).collect()))


def test_mix_of_a_given_size_caps_small_sources(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s") for i in range(5)] + [(i, "a b c d", "t") for i in range(10, 200)] + [(900, None, "s"), (901, "x", None), (902, "x", "u")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.5, 3), ("t", 0.5, 2), ("absent", 0.1, 1), (None, 0.2, 1), ("u", 0.0, 5)], "doc_source string, weight double, max_repeats int")
    rows = mixing.mix_sources(docs, targets, total=400).collect()
    by = lambda s: [r.copies for r in rows if r.doc_source == s and r.n_tokens]
    assert by("s") == [3] * 5 and by("u") == [0]
    tokens = sum(r.copies * r.n_tokens for r in rows)
    assert abs(tokens - 400) <= 4
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0


def test_rates_are_tilted_by_size_and_fail_openly(spark):
    sizes = {"s": [1, 2, 3, 40], "t": [5] * 9 + [100], "full": [7, 8]}
    rows = [(k, n, 1) for k, v in sizes.items() for n in v]
    table = spark.createDataFrame(rows, "doc_source string, n_tokens long, n long").groupBy("doc_source", "n_tokens").agg(F.sum("n").alias("n"))
    stats = {k: (len(v), sum(v)) for k, v in sizes.items()}
    caps = {"s": 4, "t": 3, "full": 2}
    for goals in ({"s": 90.0, "t": 20.0, "full": 30.0}, {"s": 0.01, "t": 430.0, "full": 15.0}):
        rates = mixing.solve_rates(table, goals, stats, caps)
        for k, v in sizes.items():
            mean = sum(v) / len(v)
            each = [min(caps[k], 2.718281828459045 ** min(50, rates[k] * n / mean)) for n in v]
            assert abs(sum(r * n for r, n in zip(each, v)) - goals[k]) < 1e-6 * goals[k], (k, rates)
            assert rates[k] != 0 or goals[k] == sum(v)
        assert goals["s"] < 46 or rates["s"] > 0
        assert rates["full"] == (float("inf") if goals["full"] == 30 else rates["full"])
    with pytest.raises(RuntimeError):
        mixing.solve_rates(table, {"s": 90.0}, stats, caps, steps=1)


def test_small_sources_meet_their_weight_on_many_partitions(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s") for i in range(10)] + [(i, "a b c d", "t") for i in range(10, 210)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.04, 3), ("t", 0.96, 3)], "doc_source string, weight double, max_repeats int")
    seen, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("64", "3"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            seen.append(sorted(map(tuple, mixing.mix_sources(docs, targets, total=400).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    tokens = {s: sum(n * k for _, source, n, k in seen[0] if source == s) for s in "st"}
    assert seen[0] == seen[1] and abs(tokens["s"] - 16) <= 4 and abs(tokens["t"] - 384) <= 4, tokens


def check_pieces(text, rows, name, limit, overlap):
    """The pieces of one text cover it, keep the limit and share the overlap, in tokens of the whole text."""
    eng = engine(name)
    flat, _ = UNITS.number([eng.cut(text) if eng.special(text) else coarse_cut(text)])
    ends = eng.table().token_ends(flat).tolist()
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].char_start == 0 and rows[-1].char_end == len(text)
    start = 0
    for r in rows:
        assert r.piece_text == text[r.char_start : r.char_end] and r.n_tokens <= limit
        assert (ends[start - 1] if start else 0) == r.char_start
        end = start + r.n_tokens
        if r.piece_no < len(rows):
            assert ends[end - 1] == r.char_end
            start = end - overlap
        else:
            assert end == len(ends)


LIMITS = [("byte_bpe_50k", 300, 40), ("word_bpe_49k", 128, 12), ("piece_bpe_32k", 500, 0), ("byte_bpe_multi_50k", 64, 8)]
LIMIT_COLUMNS = "tokenizer string, max_tokens int, overlap_tokens int"


def pieces_by_text(df):
    got = {}
    for r in df.collect():
        got.setdefault((r.doc_id, r.tokenizer), []).append(r)
    return got


@pytest.fixture(scope="module")
def whole_pieces(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    return sorted(map(str, splitting.split_oversized(docs, spark.createDataFrame(LIMITS, LIMIT_COLUMNS), range_bytes=2_000_000).collect()))


@pytest.mark.parametrize("span", [50_000, 2_000, 150])
def test_pieces_do_not_depend_on_the_ranges(spark, clash, span, whole_pieces):
    docs = clash(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    limits = spark.createDataFrame(LIMITS, LIMIT_COLUMNS)
    rows = splitting.split_oversized(docs, limits, range_bytes=span)
    got = pieces_by_text(rows)
    assert sorted(str(r) for v in got.values() for r in v) == whole_pieces
    texts_ = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == {(i, n) for i, t in texts_.items() for n, m, _ in LIMITS if t and len(engine(n).encode(t)) > m}
    rule = {n: (m, o) for n, m, o in LIMITS}
    for (i, name), v in got.items():
        check_pieces(texts_[i], v, name, *rule[name])


def test_very_long_texts_are_cut_alike_by_all_ranges(spark):
    line = "00:01:02,760 --> 00:01:04,298\r\nHe said: well, it is 5.50 a piece! And then…  \n\n \t\nГде 12ключей№7?Никто;не знает."
    plain = "".join(f"{i}\n{line[i % 50 :]}" for i in range(12_000))
    gaps = "".join("x" * (i % 7) + "слово" * 1_200 + "ab" * 20 + (" " if i % 3 else "\u00a0\n") for i in range(180))
    docs = spark.createDataFrame([(1, plain), (2, gaps), (1, plain), (None, gaps)], "doc_id long, text string")
    limits = spark.createDataFrame([("byte_bpe_50k", 100, 10), ("piece_bpe_32k", 100, 10)], LIMIT_COLUMNS)
    assert len(plain) > 1_000_000 and len(gaps) > 1_000_000
    seen = [pieces_by_text(splitting.split_oversized(docs, limits, range_bytes=n)) for n in (20_000, 300_000, 8_000_000)]
    one, two, three = (sorted(str(r) for v in s.values() for r in v) for s in seen)
    assert one == two == three
    for (i, name), v in seen[0].items():
        if i == 2:
            check_pieces(gaps, v, name, 100, 10)
        if i == 1:
            check_pieces(plain, v[::2] if [r.piece_no for r in v[:2]] == [1, 1] else v[: len(v) // 2], name, 100, 10)
    assert {k[0] for k in seen[0]} == {1, 2, None}


def test_pieces_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "x" * 5000), (3, "x" * 5000), (4, "\U0001f600" * 300), (5, "слово " * 400), (6, "слово" * 500), (7, " " * 900), (8, "\n" * 900 + "a1" * 300)]
    limits = spark.createDataFrame([("byte_bpe_50k", 100, 10), ("piece_bpe_32k", 64, 5), (None, 5, 1), ("word_bpe_49k", None, 1)], LIMIT_COLUMNS)
    seen = []
    for span in (1_000_000, 600, 100):
        got = pieces_by_text(splitting.split_oversized(spark.createDataFrame(rows, "doc_id long, text string"), limits, range_bytes=span))
        assert {k[0] for k in got} >= {3, 4, 5, 6}
        assert all(x.piece_text for v in got.values() for x in v)
        for (i, name), v in got.items():
            if i != 3:
                check_pieces(dict(rows)[i], v, name, *{"byte_bpe_50k": (100, 10), "piece_bpe_32k": (64, 5)}[name])
        assert len(got[(3, "byte_bpe_50k")]) == 2 * len({r.piece_no for r in got[(3, "byte_bpe_50k")]})
        seen.append(sorted(str(r) for v in got.values() for r in v))
    assert seen[0] == seen[1] == seen[2]
    with pytest.raises(ValueError):
        splitting.split_oversized(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("byte_bpe_50k", 10, 10)], LIMIT_COLUMNS))


def cut(text, name, limit, overlap):
    """(first character, character behind the last) of the pieces of a text."""
    eng = engine(name)
    [(_, _, _, ends, kinds, _)] = splitting._tables([text], [""], [True], {name: eng})
    return [(c0, c1) for _, _, c0, c1 in splitting.Cutter(limit, overlap).feed(ends, kinds, len(text))]


def test_boundaries_are_natural_where_possible():
    text = "\n\n".join(f"{i}\nA line of words here. And another one, longer." for i in range(60))
    near = cut(text, "byte_bpe_50k", 100, 10)
    assert len(near) > 5 and all(text[c1 - 2 : c1] == "\n\n" for _, c1 in near[:-1])
    classes = splitting.boundary_classes('a. b!" c\nd \n\t\n e?F,g 1.5')
    want = {2: "SENTENCE", 6: "SENTENCE", 8: "LINE", 9: "LINE", 10: "EMPTY_LINE", 12: "LINE", 14: "EMPTY_LINE", 17: "GLUED_SENTENCE", 19: "GLUED_CLAUSE", 20: "WORD"}
    assert {i: c for i, c in enumerate(classes.tolist()) if c != splitting.TOKEN} == {i: getattr(splitting, v) for i, v in want.items()}


def test_words_are_cut_only_where_no_boundary_is():
    glued = "".join(f"Этадверьнепришёлнаэтаже{i}?Никтоещёищетключи,наверное,взаперти!Стоит3.50рубля." for i in range(60))
    for text, ok in ((glued, lambda p: p[-1] in ".!?"), ("".join(f"слово{i},дело;" for i in range(300)), lambda p: p[-1] in ",;")):
        near = cut(text, "byte_bpe_50k", 150, 10)
        assert len(near) > 5 and all(ok(text[c0:c1]) and not text[c1].isdigit() for c0, c1 in near[:-1])
    early = "Two words. " + "неразрывно" * 12 + "\n" + "ъэщцй" * 400
    limit = int(2.5 * len(engine("byte_bpe_50k").encode(early[: early.index("\n")])))
    assert cut(early, "byte_bpe_50k", limit, 2)[0][1] in (early.index("\n"), early.index("\n") + 1)


def test_special_is_only_for_unusual_numerals():
    eng = engine("byte_bpe_50k")
    assert isinstance(eng, ByteBpe) and eng.special("1²") and not eng.special("12 слов")
    assert F is not None

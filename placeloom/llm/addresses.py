"""Address records that denote the same building.

Records are parsed one by one, then resolved as *skeletons* (everything but the numbers),
of which there are far fewer: street tokens meet their correct spelling in an index of
deletion neighbourhoods inside blocks of locality, postcode and neighbouring localities,
localities and streets are learned from the records that name them in full, and a skeleton
that leaves something out is assigned the street that fits it best. Numbers of house, block
and building are hard vetoes: they must be equal.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.addressparse import GENDER, gender_of, parse, stem_of
from placeloom.session import cut_lineage

#: A spelling is a slip when a neighbouring one occurs so many times as often, or it occurs at most RARE times itself.
RATIO, RARE = 4, 2
#: A spelling of fewer than SHORT signs, or next to one, is a slip only in a locality or postcode, where it is rare and the other occurs so many times as often.
SHORT, SHORT_RATIO = 5, 8
#: Figures of a postcode that neighbouring localities share.
AREA_FIGURES = 3
#: Records of one building that one task pairs.
GROUP_ROWS = 2_000


def parsed_records(df: DataFrame, id_col: str, address: str) -> DataFrame:
    """(id, number, skeleton): number is house, block and building; skeleton is JSON. Records without a house are left out."""

    def run(batches):
        memo: dict[str, tuple[str, str] | None] = {}
        for b in batches:
            memo.clear()
            ids, numbers, skeletons = [], [], []
            for i, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if a not in memo:
                    p = parse(a)
                    memo[a] = (p.number, json.dumps([p.words, p.beside, p.kind, p.ordinal, p.postcode, p.localities])) if p and p.house and p.words else None
                if memo[a]:
                    ids.append(i)
                    numbers.append(memo[a][0])
                    skeletons.append(memo[a][1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.string()), pa.array(skeletons, pa.string())], names=["id", "number", "skeleton"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(address).cast("string").alias("a")).filter("id is not null and a is not null").mapInArrow(run, "id bigint, number string, skeleton string")


def deletions(word):
    """The word itself and the word without each of its letters, without repeats."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))))


def corrected_words(words: DataFrame) -> DataFrame:
    """(block, word, right): for each slip of (block, word, n), the most frequent spelling one edit away in its block.

    n is how often the word is written anywhere; the block only limits where its spelling is sought.
    Spellings meet where they have a deletion in common; each key passes on only its most frequent
    spelling, so no group gives all its pairs. An edit is a letter more, less, other or swapped. The
    sign T stands for ц and for тс, so slips in either are sought. Words of three and four signs pass on
    theirs beside those of long words and yield to them; words of one or two signs are not sought.
    """
    word = F.col("word")
    both = F.when(word.contains("T"), F.array_union(deletions(word), deletions(F.replace(word, F.lit("T"), F.lit("ts"))))).otherwise(deletions(word))
    keyed = words.filter(F.length("word") >= 3).withColumn("short", F.length("word") < SHORT).withColumn("key", F.explode(both))
    top = keyed.groupBy("block", "key", F.col("short").alias("top_short")).agg(F.max(F.struct("n", "word")).alias("top"))
    near = keyed.join(top, ["block", "key"]).filter("top.word <> word").withColumn("long", ~(F.col("short") | F.col("top_short")))
    slip = F.when(F.col("long"), (F.col("top.n") >= RATIO * F.col("n")) | ((F.col("n") <= RARE) & (F.col("top.n") >= F.col("n")))).otherwise((F.col("block") != "*") & (F.col("n") <= RARE) & (F.col("top.n") >= SHORT_RATIO * F.col("n")))
    return near.filter(slip).groupBy("block", "word").agg(F.max(F.struct("long", "top.n", "top.word")).alias("top")).select("block", "word", F.col("top.word").alias("right"))


def resolved_skeletons(parsed: DataFrame) -> DataFrame:
    """(skeleton, street): the street each skeleton denotes, as locality, kind, ordinal and stem."""
    schema = "words array<string>, beside array<boolean>, kind string, ordinal int, postcode string, localities array<struct<mark:string,at:int,len:int>>"
    kinds = parsed.groupBy("skeleton").agg(F.count("*").alias("n"))
    place = pa.struct([("mark", pa.string()), ("at", pa.int32()), ("len", pa.int32())])

    def opened(batches):
        for b in batches:
            rows = [json.loads(s) for s in b.column(0).to_pylist()]
            cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]
            cols[5] = [[dict(zip(("mark", "at", "len"), x)) for x in ls] for ls in cols[5]]
            types = [pa.list_(pa.string()), pa.list_(pa.bool_()), pa.string(), pa.int32(), pa.string(), pa.list_(place)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=["skeleton", "n", "words", "beside", "kind", "ordinal", "postcode", "localities"])

    sk = cut_lineage(kinds.mapInArrow(opened, f"skeleton string, n bigint, {schema}").withColumn("sid", F.xxhash64("skeleton")))
    posted = F.when(~F.col("postcode").isin("", "000000"), F.col("postcode"))
    last = F.try_element_at("localities", F.lit(-1))
    said = F.array_join(F.slice("words", last["at"] + 1, last["len"]), " ")

    # the area of a locality: the first figures of most of its postcodes; localities of one area are neighbours
    named = sk.select("sid", "n", "words", F.nullif(said, F.lit("")).alias("said"), posted.alias("postcode"))
    areas = named.filter("said is not null and postcode is not null").groupBy("said", F.substring("postcode", 1, AREA_FIGURES).alias("area")).agg(F.sum("n").alias("n")).groupBy("said").agg(F.max_by("area", F.struct("n", "area")).alias("said_area"))
    placed = named.join(areas, "said", "left").withColumn("area", F.coalesce(F.substring("postcode", 1, AREA_FIGURES), "said_area"))

    # spelling: of each word in the block of its locality, of its postcode, and of the neighbouring localities; records of no known area seek everywhere
    near = F.array(F.concat(F.lit("l:"), "said"), F.concat(F.lit("p:"), "postcode"), F.coalesce(F.concat(F.lit("n:"), "area"), F.lit("*")))
    each = placed.select("sid", "n", F.filter(near, F.isnotnull).alias("blocks"), F.posexplode("words").alias("pos", "word"))
    seen = each.groupBy("word").agg(F.sum("n").alias("n"))
    counted = each.select("word", F.explode(F.array_union("blocks", F.array(F.lit("*")))).alias("block")).distinct().join(seen, "word")
    slips = cut_lineage(corrected_words(counted))
    order = F.when(F.col("block").startswith("l:"), 0).when(F.col("block").startswith("p:"), 1).otherwise(2)
    fixes = each.select("sid", "pos", "word", F.explode("blocks").alias("block")).join(slips, ["block", "word"]).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", order.alias("order"), "right"))).alias("fixes"))  # a few a word
    right = F.expr("transform(arrays_zip(words, beside), (w, i) -> struct(i as pos, coalesce(try_element_at(filter(fixes, f -> f.pos = i), 1).right, w.words) as word, w.beside as road))")
    clean = cut_lineage(sk.join(fixes, "sid", "left").select("sid", "skeleton", "n", "kind", "ordinal", "postcode", "localities", right.alias("ws")))

    # localities as the records name them, in right spelling; runs of one to three words that are localities
    words = lambda at, n: F.array_join(F.transform(F.slice("ws", at, n), lambda w: w["word"]), " ")
    said_names = clean.select("n", "ws", F.explode("localities").alias("l")).select("n", words(F.col("l.at") + 1, F.col("l.len")).alias("name"), (F.col("l.mark") == "v").alias("v"))
    as_roads = clean.select("n", F.explode("ws").alias("w")).filter("w.road").groupBy(F.col("w.word").alias("name")).agg(F.sum("n").alias("as_road"))
    towns = said_names.groupBy("name").agg(F.sum("n").alias("seen"), F.max("v").alias("village")).join(as_roads, "name", "left")
    towns = towns.filter("seen >= 2 or coalesce(as_road, 0) <= 2").select("name", "seen", "village")  # what is a street more often is no locality for being called one once
    grams = clean.select("sid", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.size("ws")), lambda i: i + k - 1 <= F.size("ws")), lambda i: F.struct(i.alias("at"), k.alias("len"), words(i, k).alias("name")))))).alias("g")).select("sid", "g.*")
    hits = grams.join(towns, "name")
    place_of = hits.groupBy("sid").agg(F.max(F.struct("village", "len", "seen", "name")).alias("best"), F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1), F.col("len")), lambda k: F.col("at") + k - 1))).alias("taken"))
    rest = clean.join(place_of, "sid", "left").select("sid", "skeleton", "n", "kind", "ordinal", "postcode", F.coalesce("best.name", F.lit("")).alias("town"), F.posexplode(F.expr("filter(ws, w -> not array_contains(coalesce(taken, array()), w.pos + 1))")).alias("k", "w"))
    rest = rest.select("sid", "skeleton", "n", "kind", "ordinal", "postcode", "town", "k", F.col("w.word").alias("word"), F.col("w.road").alias("road"))

    # the street word: the one that stands beside a kind or ordinal most often in the whole data; other words that mostly stand there belong to the name
    roads = rest.groupBy("word").agg(F.sum(F.when(F.col("road"), F.col("n")).otherwise(0)).alias("as_road"), F.sum("n").alias("in_all"))
    pick = rest.join(roads, "word").withColumn("weight", F.col("as_road") / F.col("in_all"))
    more = F.collect_set(F.when(F.col("road") & (F.col("weight") > 0.5) & (F.col("in_all") > RARE), F.col("word"))).alias("more")
    kept = ("skeleton", "n", "kind", "ordinal", "postcode", "town")
    best = pick.groupBy("sid").agg(F.max_by("word", F.struct(F.col("road") & (F.col("weight") > 0.2), F.col("as_road"), -F.col("k"))).alias("word"), more, *[F.first(c).alias(c) for c in kept])

    def stems(batches):
        for b in batches:
            ws = b.column(1).to_pylist()
            names = ["+".join(sorted({stem_of(x) for x in (w, *m)})) for w, m in zip(ws, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array([gender_of(w) for w in ws], pa.string()), *b.columns[3:]], names=["sid", "stem", "gender", *kept])

    street = cut_lineage(best.select("sid", "word", "more", *kept).mapInArrow(stems, "sid bigint, stem string, gender string, skeleton string, n bigint, kind string, ordinal int, postcode string, town string"))

    # streets named in full; what is left out is assigned at least cost: a kind of another gender, then the postcode, then how often the street is named.
    # The best street of a name is found for each kind, with and without the postcode, so no skeleton meets all streets of its name.
    full = street.filter("town <> '' and kind <> ''").groupBy("stem", "ordinal", F.col("town").alias("t"), F.col("kind").alias("k"), "postcode").agg(F.sum("n").alias("posted"))
    total = full.groupBy("stem", "ordinal", "t", "k").agg(F.sum("posted").alias("support"))
    posts = full.filter("postcode not in ('', '000000')").join(total, ["stem", "ordinal", "t", "k"])
    rank = lambda p: F.struct((-p).alias("posted"), (-F.col("support")).alias("support"), "t", "k")
    none = F.lit(0).cast("long")
    anywhere = total.groupBy("stem", "ordinal", "k").agg(F.min(rank(none)).alias("c"))
    by_post = posts.groupBy("stem", "ordinal", "k", "postcode").agg(F.min(rank(F.col("posted"))).alias("c"))
    asked = street.filter("town = '' or kind = ''").groupBy("stem", "ordinal", "town", "kind", "gender", "postcode").agg(F.lit(1).alias("one")).drop("one")
    no_town = asked.filter("town = ''")
    fits = (F.col("kind") == "") | (F.col("kind") == F.col("k"))
    ask = ["stem", "ordinal", "town", "kind", "gender", "postcode"]
    found = no_town.join(anywhere, ["stem", "ordinal"]).filter(fits).select(*ask, "c")
    found = found.unionByName(no_town.join(by_post, ["stem", "ordinal", "postcode"]).filter(fits).select(*ask, "c"))
    in_town = asked.filter("town <> ''").join(total.withColumnRenamed("t", "town"), ["stem", "ordinal", "town"]).join(posts.select("stem", "ordinal", F.col("t").alias("town"), "k", "postcode", "posted"), ["stem", "ordinal", "town", "k", "postcode"], "left")
    found = found.unionByName(in_town.withColumn("t", F.col("town")).select(*ask, rank(F.coalesce("posted", none)).alias("c")))
    gender = F.create_map(*[F.lit(x) for kv in GENDER.items() for x in kv])
    cost = F.when((F.col("kind") == "") & (F.col("gender") != "") & (gender[F.col("c.k")] != F.col("gender")), 1).otherwise(0)
    top = found.groupBy(*ask).agg(F.min_by("c", F.struct(cost, "c")).alias("c"))
    done = street.join(top, ask, "left")
    return done.select("skeleton", F.concat_ws("|", F.coalesce("c.t", "town"), F.coalesce("c.k", "kind"), F.col("ordinal").cast("string"), "stem").alias("street"))


def buildings(df: DataFrame, id_col: str = "addr_id", address: str = "address") -> DataFrame:
    """(id, building): the building that each record denotes. Records that name no house are left out."""
    parsed = cut_lineage(parsed_records(df, id_col, address))
    return cut_lineage(parsed.join(resolved_skeletons(parsed), "skeleton").select("id", F.concat_ws("#", "street", "number").alias("building")))


def building_classes(df: DataFrame, id_col: str = "addr_id", address: str = "address") -> DataFrame:
    """(addr_id, class_id, links): for each record that names a house, the smallest id of its building and how many other records denote it.

    What a building is, is said in ``same_building``; a repeated row is a record of its own here.
    """
    rows = buildings(df, id_col, address)
    size = rows.groupBy("building").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("links"))
    return rows.join(size, "building").select(F.col("id").alias("addr_id"), "class_id", "links")


def same_building(df: DataFrame, id_col: str = "addr_id", address: str = "address", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(addr_id_a, addr_id_b), a < b: every pair of records that denote one building.

    Null and empty addresses and records that name no house are in no pair; records of equal text
    are pairs; a repeated id is no pair with itself. Postcodes help only to choose between streets.
    Other columns are not read. Buildings of more than ``group_rows`` records are paired by several
    tasks: one side keeps one salt of several, the other is repeated for each.
    """
    keyed = buildings(df, id_col, address)
    size = keyed.groupBy("building").agg(F.count("*").alias("n")).filter("n > 1").select("building", F.ceil(F.col("n") / group_rows).cast("int").alias("salts"))
    rows = keyed.join(size, "building")
    a = rows.select("building", F.col("id").alias("addr_id_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    b = rows.select("building", F.col("id").alias("addr_id_b"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    return a.join(b, ["building", "salt"]).filter("addr_id_a < addr_id_b").select("addr_id_a", "addr_id_b")

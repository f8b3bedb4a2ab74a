"""Queries of the register's own operators, each with its SQL. Names carry the ids of the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import geometry, merge, nesting, proximity, quality, reconcile, report, verdicts
from placeloom.plans.tables import table

FIELDS = ("title", "address", "phone", "website", "categories", "opening_hours", "email")
# Order of the groups in labels.
GROUPS = ["Общепит", "Продуктовая розница", "Пищевое производство", "Религиозные учреждения"]
BOX = (55.0, 56.5, 36.5, 39.0)
STOP = ("кафе", "ресторан", "магазин", "продукты")
KINDS = [("церк|храм|часовн|монастыр|приход", "православие"), ("мечет", "ислам"), ("молитвен|общин", "прочие")]
# pieces of SQL that several queries share; white space is spelled out as RE2 knows only the ASCII part
WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"
EXT = "(?i)[\\s,;]*\\(?\\s*(?:доб(?:авочный)?|ext|вн|x)[\\s.:№]*([0-9]{1,6})\\s*\\)?\\s*$"


def norm(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '{WS}', ' ', 'g'))"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def phone(c: str) -> str:
    d = digits(c)
    return f"CASE WHEN length({d}) = 11 AND {d} LIKE '8%' THEN '7' || substr({d}, 2) ELSE {d} END"


def bare_phone(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{EXT}', ''), '[\\s,;]+$', '')"


KEY = f"""CASE WHEN trim(coalesce(place_id, '')) <> '' THEN 'id:' || trim(place_id)
  WHEN coalesce({digits("coalesce(nullif(phone, ''), phones)")}, '') <> '' AND coalesce({norm('address')}, '') <> '' THEN 'phone-address:' || {digits("coalesce(nullif(phone, ''), phones)")} || '|' || {norm('address')}
  WHEN coalesce({norm('title')}, '') <> '' AND coalesce({norm('address')}, '') <> '' THEN 'title-address:' || {norm('title')} || '|' || {norm('address')}
  WHEN coalesce(maps_url, '') <> '' THEN 'url:' || maps_url END"""
RECS = """coalesce(list_filter(list_transform(TRY_CAST(TRY_CAST(source_records AS JSON) AS STRUCT(district VARCHAR, "group" VARCHAR, category VARCHAR, query VARCHAR)[]),
  lambda r: {'d': coalesce(r.district, ''), 'g': coalesce(r."group", ''), 'c': coalesce(r.category, ''), 'q': coalesce(r.query, '')}), lambda r: r.d || r.g || r.c || r.q <> ''), [])"""
LAT = "CASE WHEN latitude BETWEEN 36 AND 39.5 THEN longitude ELSE latitude END"
LON = "CASE WHEN latitude BETWEEN 36 AND 39.5 THEN latitude ELSE longitude END"
POS = f"SELECT final_id AS id, {LAT} AS lat, {LON} AS lon, categories FROM final_filtered WHERE latitude <> 0 AND longitude <> 0"
NEAR = f"""pos AS ({POS}), cells AS (SELECT *, CAST(floor(lat * 2000) AS BIGINT) AS y, CAST(floor(lon * 1000) AS BIGINT) AS x FROM pos),
 near AS (SELECT a.id AS id_a, b.id AS id_b, sqrt(((a.lat - b.lat) * 111320) ** 2 + ((a.lon - b.lon) * 111320 * cos(radians(a.lat))) ** 2) AS metres
  FROM cells a JOIN cells b ON a.id < b.id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1)"""
RINGS = """rings AS (SELECT district_id AS region, unnest(CASE WHEN geojson->>'$.type' = 'Polygon' THEN [CAST(geojson->'$.coordinates' AS DOUBLE[][][])] ELSE CAST(geojson->'$.coordinates' AS DOUBLE[][][][]) END) AS poly FROM districts),
 ring AS (SELECT region, unnest(poly) AS pts, generate_subscripts(poly, 1) AS part FROM rings),
 numbered AS (SELECT region, pts, part, row_number() OVER () AS rid FROM ring),
 corners AS (SELECT region, rid, part, unnest(pts) AS p, generate_subscripts(pts, 1) AS i FROM numbered),
 edges AS (SELECT a.region, a.rid, a.part, a.p[1] AS ax, a.p[2] AS ay, b.p[1] AS bx, b.p[2] AS by_ FROM corners a JOIN corners b ON a.rid = b.rid AND b.i = a.i + 1)"""
INSIDE = f"""{RINGS}, pts AS ({POS}),
 inside AS (SELECT p.id, e.region FROM pts p JOIN edges e ON (e.ay > p.lat) <> (e.by_ > p.lat) AND p.lon < (e.bx - e.ax) * (p.lat - e.ay) / (e.by_ - e.ay) + e.ax GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _raw(s, d):
    return table(s, d, "raw_places")


def _final(s, d):
    return table(s, d, "final_filtered")


#: Districts that may be named in expressions; beyond, they are no fixed list and an error.
MAX_DISTRICTS = 1_000


def district_names(districts):
    """The names of the districts in the order of their ids, which go into expressions."""
    rows = districts.select("district_id", "district_name").limit(MAX_DISTRICTS + 1).collect()
    if len(rows) > MAX_DISTRICTS:
        raise ValueError(f"more than {MAX_DISTRICTS} districts")
    return [r.district_name for r in sorted(rows)]


Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn

    return keep


# scalar functions


@query("ref_P1_P2_P3_P12_text", f"SELECT raw_id, {norm('title')} AS norm_title, {digits('phone')} AS phone_all, {phone('phone')} AS phone_key, regexp_replace({norm('title')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS loose_title FROM raw_places")
def _(s, d):
    return _raw(s, d).select("raw_id", T.normalize(F.col("title")).alias("norm_title"), T.digits(F.col("phone")).alias("phone_all"), T.phone_digits(F.col("phone")).alias("phone_key"), T.loose(F.col("title")).alias("loose_title"))


@query("ref_P4_coordinates", "SELECT raw_id, CASE WHEN w THEN longitude ELSE latitude END AS lat, CASE WHEN w THEN latitude ELSE longitude END AS lon, w AS swapped FROM (SELECT *, coalesce(latitude BETWEEN 36 AND 39.5 AND longitude BETWEEN 54.5 AND 57, false) AS w FROM raw_places)")
def _(s, d):
    w = F.coalesce(F.col("latitude").between(36.0, 39.5) & F.col("longitude").between(54.5, 57.0), F.lit(False))
    return _raw(s, d).select("raw_id", F.when(w, F.col("longitude")).otherwise(F.col("latitude")).alias("lat"), F.when(w, F.col("latitude")).otherwise(F.col("longitude")).alias("lon"), w.alias("swapped"))


@query("ref_P5_stable_key", f"SELECT raw_id, {KEY} AS key FROM raw_places WHERE ({KEY}) IS NOT NULL")
def _(s, d):
    return merge.keyed(_raw(s, d)).select("raw_id", "key")


@query("ref_P10_id_from_url", "SELECT raw_id, CASE WHEN lower(maps_url) LIKE '%/org/%' THEN nullif(list_last(list_filter(string_split(regexp_extract(split_part(split_part(maps_url, '?', 1), '#', 1), '(?i)/org/.*$'), '/'), lambda x: regexp_full_match(x, '[0-9]{5,}'))), '') END AS url_id FROM raw_places")
def _(s, d):
    return _raw(s, d).select("raw_id", T.place_id_from_url(F.col("maps_url")).alias("url_id"))


@query("ref_P11_split_extension", f"SELECT final_id, coalesce(regexp_extract(phone, '{EXT}', 1), '') AS ext, {bare_phone('phone')} AS bare FROM final_filtered")
def _(s, d):
    return _final(s, d).select("final_id", T.phone_extension(F.col("phone")).alias("ext"), T.phone_without_extension(F.col("phone")).alias("bare"))


@query("ref_P13_P16_address_rubric", f"SELECT final_id, regexp_replace({norm('address')}, ',\\s*велегорск$', '') AS addr, {norm('string_split(categories, chr(44))[1]')} AS rubric FROM final_filtered")
def _(s, d):
    return _final(s, d).select("final_id", T.norm_address(F.col("address"), "велегорск").alias("addr"), T.first_rubric(F.col("categories")).alias("rubric"))


# Words for kinds of street, as the survey lists them.
_KINDS_OF_STREET = "улица ул проспект пр-кт просп пр переулок пер бульвар б-р бул шоссе ш проезд пр-д площадь пл набережная наб тупик аллея линия пр-т"
_STREET = f"list_aggregate(list_sort(list_filter(string_split(trim(regexp_replace(regexp_replace({norm('v')}, '[^а-я0-9 -]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains(string_split('{_KINDS_OF_STREET}', ' '), w))), 'string_agg', ' ')"
# figures and letters only, then the words before figures one after another
_HOUSE = f"regexp_replace({norm('h')}, '[^0-9а-яa-z/-]+', ' ', 'g')"
_HOUSE = f"regexp_replace(regexp_replace({_HOUSE}, '([0-9])([а-яa-z])', '\\1 \\2', 'g'), '([а-яa-z])([0-9])', '\\1 \\2', 'g')"
for _rx, _to in (("(^|[ /-])(дом|д|владение|вл) ([0-9])", "\\1\\3"), ("(^|[ /-])(корпус|корп|к) ([0-9])", "\\1к\\3"), ("(^|[ /-])(строение|стр|с) ([0-9])", "\\1с\\3"), (" +", "")):
    _HOUSE = f"regexp_replace({_HOUSE}, '{_rx}', '{_to}', 'g')"


def _tagged(s, d):
    o = table(s, d, "osm_places")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return o.select("osm_id", tag("name").alias("name"), tag("addr:street").alias("v"), tag("addr:housenumber").alias("h"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"))


_TAGGED = "SELECT osm_id, tags['name'] AS name, tags['addr:street'] AS v, tags['addr:housenumber'] AS h, coalesce(lat, center.lat) AS lat, coalesce(lon, center.lon) AS lon FROM osm_places"


@query("ref_P14_P15_street_house_keys", f"SELECT osm_id, coalesce({_STREET}, '') AS street, {_HOUSE} AS house FROM ({_TAGGED}) WHERE v IS NOT NULL AND h IS NOT NULL")
def _(s, d):
    return _tagged(s, d).filter("v is not null and h is not null").select("osm_id", T.street_key(F.col("v")).alias("street"), T.house_key(F.col("h")).alias("house"))


_PARTS = "list_distinct(list_filter(list_transform(string_split_regex(coalesce(detected_category_group, ''), '[|;,/\\n]'), lambda x: trim(x)), lambda x: x <> ''))"
_RANK = f"coalesce(list_position([{', '.join(chr(39) + g + chr(39) for g in GROUPS)}], x), 99)"


@query("ref_P17_group_label", f"SELECT final_id, coalesce(nullif(array_to_string(list_transform(list_sort(list_transform({_PARTS}, lambda x: {{'r': CASE WHEN {_RANK} = 0 THEN 99 ELSE {_RANK} END, 'x': x}})), lambda s: s.x), ' / '), ''), '—') AS label FROM final_filtered")
def _(s, d):
    return _final(s, d).select("final_id", T.group_label(F.col("detected_category_group"), GROUPS).alias("label"))


@query("ref_P27_points", f"SELECT raw_id, CASE WHEN latitude IS NULL OR longitude IS NULL THEN '' ELSE CAST(CAST(floor(latitude * 10000 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(longitude * 10000 + 0.5) AS BIGINT) AS VARCHAR) || '|' || {norm(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} END AS point FROM raw_places")
def _(s, d):
    return _raw(s, d).select("raw_id", T.point_key(F.col("latitude"), F.col("longitude"), F.col("title")).alias("point"))


_STEMS = f"list_sort(list_distinct(list_transform(list_filter(string_split(regexp_replace(regexp_replace({norm('title')}, '\\([^)]*\\)', ' ', 'g'), '[^а-я0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(chr(39) + w + chr(39) for w in STOP)})), lambda w: substr(w, 1, 6))))"


@query("ref_P19_P21_P29_names", f"SELECT final_id, array_to_string({_STEMS}, ' ') AS stems, substr(regexp_extract({norm('title')}, '(?:^| )(?:в|во|на) ([а-я]+)', 1), 1, 5) AS place, CASE {' '.join(f'WHEN regexp_matches({norm(chr(116) + chr(105) + chr(116) + chr(108) + chr(101))}, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{lab}{chr(39)}' for p, lab in KINDS)} ELSE 'нет' END AS kind FROM final_filtered WHERE title IS NOT NULL")
def _(s, d):
    return _final(s, d).filter("title is not null").select("final_id", F.array_join(T.name_key(F.col("title"), STOP), " ").alias("stems"), T.place_word(F.col("title")).alias("place"), T.first_match(F.col("title"), KINDS, "нет").alias("kind"))


@query("ref_P25_P26_ledger_key_duration", f"SELECT raw_id, {norm('coalesce(source_district, ' + chr(39) * 2 + ')')} || '|' || {norm('coalesce(source_query, ' + chr(39) * 2 + ')')} AS yield_key, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS waited FROM (SELECT *, CAST(floor(date_diff('second', captured_at, loaded_at)) AS BIGINT) AS s FROM raw_places) WHERE s >= 0")
def _(s, d):
    sec = F.unix_timestamp(F.date_trunc("second", "loaded_at")) - F.unix_timestamp(F.date_trunc("second", "captured_at"))
    return _raw(s, d).withColumn("s", sec).filter("s >= 0").select("raw_id", F.concat_ws("|", T.normalize(F.coalesce("source_district", F.lit(""))), T.normalize(F.coalesce("source_query", F.lit("")))).alias("yield_key"), T.duration_text(F.col("s") * 1000).alias("waited"))


# sources and filters


@query("ref_S16_address_index", f"SELECT street, house, arg_max(lat, osm_id) AS lat, arg_max(lon, osm_id) AS lon FROM (SELECT osm_id, lat, lon, coalesce({_STREET}, '') AS street, {_HOUSE} AS house FROM ({_TAGGED}) WHERE v IS NOT NULL AND h IS NOT NULL) GROUP BY ALL")
def _(s, d):
    t = _tagged(s, d).filter("v is not null and h is not null").select("osm_id", "lat", "lon", T.street_key(F.col("v")).alias("street"), T.house_key(F.col("h")).alias("house"))
    return t.groupBy("street", "house").agg(F.max_by(F.struct("lat", "lon"), "osm_id").alias("p")).select("street", "house", "p.lat", "p.lon")


@query("ref_S17_register_split", "SELECT raw_id, EXISTS (SELECT 1 FROM final_filtered f WHERE f.place_id = trim(r.place_id)) AS accepted FROM raw_places r WHERE r.place_id IS NOT NULL")
def _(s, d):
    ids = _final(s, d).select(F.col("place_id").alias("pid")).distinct().withColumn("hit", F.lit(True))
    r = _raw(s, d).filter("place_id is not null").withColumn("pid", F.trim("place_id"))
    return r.join(ids, "pid", "left").select("raw_id", F.coalesce("hit", F.lit(False)).alias("accepted"))


@query("ref_F1_F2_rule_match", f"SELECT final_id, CASE WHEN coalesce({norm('categories')}, '') = '' THEN NULL ELSE {norm('categories')} LIKE '%магазин%' AND NOT {norm('categories')} LIKE '%чая%' END AS shop, array_to_string(list_filter([CASE WHEN {norm('categories')} LIKE '%кафе%' OR {norm('categories')} LIKE '%бар%' THEN 'food' END, CASE WHEN {norm('categories')} LIKE '%магазин%' THEN 'retail' END], lambda x: x IS NOT NULL), '|') AS groups FROM final_filtered")
def _(s, d):
    rules = {"магазин": (["магазин"], ["чая"])}
    groups = {"food": ["кафе", "бар"], "retail": ["магазин"]}
    return _final(s, d).select("final_id", T.rule_match(F.lit("Магазин"), F.col("categories"), rules).alias("shop"), F.array_join(T.groups_of_rubrics(F.col("categories"), groups), "|").alias("groups"))


@query("ref_F5_needs_card", "SELECT raw_id FROM raw_places WHERE detail_level = 'LIST' AND (coalesce(categories, '') = '' OR coalesce(phone, '') = '' OR coalesce(website, '') = '' OR coalesce(opening_hours, '') = '')")
def _(s, d):
    return _raw(s, d).filter(merge.needs_card(_raw(s, d))).select("raw_id")


@query("ref_F11_coordinate_sanity", f"SELECT CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing' WHEN latitude = 0 OR longitude = 0 THEN 'zero' WHEN latitude BETWEEN 36 AND 39.5 AND longitude BETWEEN 54.5 AND 57 THEN 'swapped' WHEN NOT (latitude BETWEEN {BOX[0]} AND {BOX[1]} AND longitude BETWEEN {BOX[2]} AND {BOX[3]}) THEN 'outside' ELSE 'good' END AS state, count(*) AS n FROM raw_places GROUP BY 1")
def _(s, d):
    return quality.coordinate_sanity(_raw(s, d), BOX)


# merging

_MERGED = ", ".join(f"arg_min({f}, raw_id) FILTER (WHERE coalesce(CAST({f} AS VARCHAR), '') <> '') AS {f}" for f in FIELDS)
_KEYED = f"SELECT *, {KEY} AS key FROM raw_places"


@query("ref_A1_merge_records", f"WITH k AS (SELECT * FROM ({_KEYED}) WHERE key IS NOT NULL), r AS (SELECT key, unnest({RECS}) AS r FROM k), n AS (SELECT key, count(DISTINCT r) AS n FROM r GROUP BY 1), m AS (SELECT key, {_MERGED}, count(*) AS n_rows, max(CASE detail_level WHEN 'LIST' THEN 0 WHEN 'LIST_ONLY' THEN 1 WHEN 'CARD' THEN 2 ELSE -1 END) AS rank FROM k GROUP BY 1) SELECT m.key, {', '.join(FIELDS)}, n_rows, CASE rank WHEN 0 THEN 'LIST' WHEN 1 THEN 'LIST_ONLY' WHEN 2 THEN 'CARD' ELSE '' END AS detail_level, coalesce(n, 0) AS source_queries_count FROM m LEFT JOIN n USING (key)")
def _(s, d):
    return merge.merge_records(merge.keyed(_raw(s, d)).drop("source_queries_count", "source_district"), FIELDS, "raw_id").select("key", *FIELDS, "n_rows", "detail_level", F.col("source_queries_count").cast("long"))


@query("ref_A2_A3_totals", f"SELECT count(*) AS organisations, CAST(sum(n) AS BIGINT) AS hits, CAST(sum(greatest(n, 1)) AS BIGINT) AS hits_at_least_one FROM (SELECT len({RECS}) AS n FROM raw_places)")
def _(s, d):
    return merge.totals(_raw(s, d))


@query("ref_A5_import_dedupe", f"SELECT key, arg_max(coalesce(title, chr(0)), raw_id) AS t, count(*) AS n_rows FROM ({_KEYED}) WHERE key IS NOT NULL GROUP BY 1")
def _(s, d):
    return merge.import_dedupe(merge.keyed(_raw(s, d)), ("title", "phone"), "raw_id").select("key", F.coalesce("title", F.lit("\0")).alias("t"), "n_rows")


_UPSERTED = ", ".join(f"arg_min({f}, CASE WHEN detail_level = 'CARD' THEN 0 ELSE 1000000000000 END + raw_id) FILTER (WHERE coalesce(CAST({f} AS VARCHAR), '') <> '') AS {f}" for f in FIELDS)


@query("ref_J4_upsert", f"SELECT key, {_UPSERTED} FROM ({_KEYED}) WHERE key IS NOT NULL GROUP BY 1")
def _(s, d):
    k = merge.keyed(_raw(s, d))
    card = F.coalesce(F.col("detail_level") == "CARD", F.lit(False))
    stored = merge.merge_records(k.filter(card), FIELDS, "raw_id", records=None).select("key", *FIELDS, "detail_level")
    return merge.upsert(stored, k.filter(~card).select("key", "raw_id", *FIELDS, "detail_level"), FIELDS, "raw_id").select("key", *FIELDS)


@query("ref_J5_prefer_source", "SELECT place_id, title, 0 AS from_source FROM final_filtered UNION ALL SELECT pid, arg_min(title, raw_id), 1 FROM (SELECT trim(place_id) AS pid, coalesce(title, '') AS title, raw_id FROM raw_places WHERE trim(place_id) <> '') WHERE pid NOT IN (SELECT place_id FROM final_filtered) GROUP BY 1")
def _(s, d):
    raw = _raw(s, d).withColumn("pid", F.trim("place_id")).filter("pid <> ''").groupBy("pid").agg(F.min_by(F.coalesce("title", F.lit("")), "raw_id").alias("title")).select(F.col("pid").alias("place_id"), "title")
    return merge.prefer("place_id", ["title"], _final(s, d).select("place_id", "title"), raw).select("place_id", "title", F.col("from_source").cast("int"))


_PATCH = "SELECT trim(place_id) AS place_id, max(nullif(website, '')) AS website, max(nullif(email, '')) AS email FROM raw_places WHERE trim(place_id) <> '' GROUP BY 1"


@query("ref_J7_enrich", f"SELECT f.final_id, coalesce(p.website, f.website) AS website, f.email FROM final_filtered f LEFT JOIN ({_PATCH}) p USING (place_id)")
def _(s, d):
    patch = _raw(s, d).withColumn("place_id", F.trim("place_id")).filter("place_id <> ''")
    return merge.enrich(_final(s, d), patch, "place_id", ("website", "email"), protected=("email",)).select("final_id", "website", "email")


@query("ref_J8_flag_semi_join", "SELECT raw_id FROM raw_places WHERE detail_level = 'LIST' AND place_id IN (SELECT place_id FROM final_filtered)")
def _(s, d):
    return _raw(s, d).filter("detail_level = 'LIST'").join(_final(s, d).select("place_id"), "place_id", "left_semi").select("raw_id")


@query("ref_J15_fill_blanks", f"SELECT f.final_id, coalesce(nullif(f.website, ''), p.website) AS website, coalesce(nullif(f.email, ''), p.email) AS email FROM final_filtered f LEFT JOIN ({_PATCH}) p USING (place_id)")
def _(s, d):
    patch = _raw(s, d).withColumn("place_id", F.trim("place_id")).filter("place_id <> ''")
    return merge.fill_blanks(_final(s, d), patch, "place_id", ("website", "email"))[0].select("final_id", "website", "email")


@query("ref_J16_U3_without_ids", "SELECT raw_id FROM raw_places WHERE place_id IS NULL OR trim(place_id) NOT IN (SELECT place_id FROM final_filtered)")
def _(s, d):
    raw = _raw(s, d).withColumn("place_id", F.trim("place_id"))
    return merge.without_ids(raw, _final(s, d), "place_id").select("raw_id")


@query("ref_J18_merge_queue", f"SELECT district, query_text FROM query_list UNION ALL SELECT DISTINCT source_district, source_query FROM raw_places r WHERE source_query IS NOT NULL AND source_district IS NOT NULL AND NOT EXISTS (SELECT 1 FROM query_list q WHERE {norm('q.query_text')} = {norm('r.source_query')} AND {norm('q.district')} = {norm('r.source_district')})")
def _(s, d):
    new = _raw(s, d).filter("source_query is not null and source_district is not null").select(F.col("source_district").alias("district"), F.col("source_query").alias("query_text")).distinct()
    return merge.merge_queue(table(s, d, "query_list"), new).select("district", "query_text")


# geometry and nearness


@query("ref_J1_J3_F6_in_district", f"WITH {INSIDE} SELECT id, region FROM inside")
def _(s, d):
    return proximity.points_in_regions(_final(s, d), "final_id", table(s, d, "districts"), "district_id", "geojson").select("id", F.col("region").cast("int"))


@query("ref_J2_best_district", f"WITH {INSIDE} SELECT f.final_id AS id, i.region, CASE WHEN coalesce(f.latitude, 0) = 0 OR coalesce(f.longitude, 0) = 0 THEN 'NO_COORDINATES' WHEN i.region IS NULL THEN 'OUTSIDE' ELSE 'EXACT' END AS quality FROM final_filtered f LEFT JOIN inside i ON i.id = f.final_id")
def _(s, d):
    return geometry.best_region(_final(s, d), "final_id", table(s, d, "districts")).select("id", F.col("region").cast("int"), "quality")


@query("ref_A23_bounds", f"WITH {RINGS} SELECT region, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM edges GROUP BY 1")
def _(s, d):
    return geometry.bounds(table(s, d, "districts"))


@query("ref_J9_near_duplicates", f"WITH {NEAR}, c AS (SELECT final_id, {norm('string_split(categories, chr(44))[1]')} AS r FROM final_filtered), s AS (SELECT id_a, id_b FROM near JOIN c a ON a.final_id = id_a JOIN c b ON b.final_id = id_b WHERE metres <= 40 AND a.r = b.r AND a.r <> '') SELECT id_a AS id, id_b AS other FROM s UNION ALL SELECT id_b, id_a FROM s")
def _(s, d):
    return report.near_duplicates(_final(s, d), "final_id").select("id", "other")


@query("ref_W5_nearest_duplicates", f"WITH {NEAR}, c AS (SELECT final_id, title, {norm('string_split(categories, chr(44))[1]')} AS r FROM final_filtered), s AS (SELECT id_a, id_b, metres FROM near JOIN c a ON a.final_id = id_a JOIN c b ON b.final_id = id_b WHERE metres <= 40 AND a.r = b.r AND a.r <> ''), m AS (SELECT id_a AS id, id_b AS other, metres FROM s UNION ALL SELECT id_b, id_a, metres FROM s), w AS (SELECT id, other, metres, row_number() OVER (PARTITION BY id ORDER BY metres, other) AS rn FROM m) SELECT id, string_agg(coalesce(title, '') || ' (' || CAST(CAST(floor(metres + 0.5) AS BIGINT) AS VARCHAR) || ' м)', '; ' ORDER BY rn) AS nearest FROM w JOIN c ON c.final_id = other WHERE rn <= 3 GROUP BY 1")
def _(s, d):
    f = _final(s, d)
    return report.nearest_duplicates(report.near_duplicates(f, "final_id"), f.select(F.col("final_id").alias("id"), "title"))


@query("ref_J10_nearest", f"WITH p AS ({POS}), o AS ({_TAGGED}), c AS (SELECT o.osm_id AS id_a, p.id AS id_b, sqrt(((o.lat - p.lat) * 111320) ** 2 + ((o.lon - p.lon) * 111320 * cos(radians(o.lat))) ** 2) AS m FROM o JOIN p ON p.lat BETWEEN o.lat - 0.002 AND o.lat + 0.002 AND p.lon BETWEEN o.lon - 0.005 AND o.lon + 0.005) SELECT id_a, arg_min(id_b, m) AS id_b FROM c WHERE m <= 150 GROUP BY 1")
def _(s, d):
    osm = _tagged(s, d).select(F.col("osm_id").alias("id"), "lat", "lon")
    return reconcile.nearest(osm, proximity.positioned(_final(s, d), "final_id"), 150.0).select("id_a", "id_b")


# names and reconciliation


@query("ref_J11_J12_best_name", f"WITH s AS (SELECT final_id, {_STEMS} AS stems FROM final_filtered WHERE title IS NOT NULL), o AS (SELECT osm_id, {_STEMS} AS stems FROM (SELECT osm_id, tags['name'] AS title FROM osm_places) WHERE title IS NOT NULL), c AS (SELECT osm_id AS id_a, final_id AS id_b, len(list_intersect(o.stems, s.stems)) / greatest(1, least(len(o.stems), len(s.stems))) AS score FROM o JOIN s ON list_has_any(o.stems, s.stems)) SELECT id_a, id_b, score FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS rn FROM c WHERE score >= 0.4) WHERE rn = 1")
def _(s, d):
    stems = lambda df, i, t: df.filter(F.col(t).isNotNull()).select(F.col(i).alias("id"), T.name_key(F.col(t), STOP).alias("stems"))
    return reconcile.best_names(stems(_tagged(s, d), "osm_id", "name"), stems(_final(s, d), "final_id", "title"), 0.4)


_INDEX = f"SELECT osm_id, lat, lon, coalesce({_STREET}, '') AS street, {_HOUSE} AS house FROM ({_TAGGED}) WHERE v IS NOT NULL AND h IS NOT NULL"


@query("ref_J13_geocode", f"WITH i AS ({_INDEX}), h AS (SELECT street, house, arg_max(lat, osm_id) AS lat, arg_max(lon, osm_id) AS lon FROM i GROUP BY ALL), l AS (SELECT street, avg(lat) AS lat, avg(lon) AS lon FROM i GROUP BY 1 HAVING max(lat) - min(lat) < 1e-9 AND max(lon) - min(lon) < 1e-9), q AS (SELECT final_id AS id, coalesce({_STREET}, '') AS street, {_HOUSE} AS house FROM (SELECT final_id, string_split(address, ',')[-2] AS v, string_split(address, ',')[-1] AS h FROM final_filtered WHERE address LIKE '%,%')) SELECT id, CASE WHEN h.lat IS NOT NULL THEN 'HOUSE' WHEN l.lat IS NOT NULL THEN 'STREET' ELSE 'NONE' END AS precision FROM q LEFT JOIN h USING (street, house) LEFT JOIN l ON l.street = q.street")
def _(s, d):
    ix = _tagged(s, d).filter("v is not null and h is not null").select(F.col("osm_id").alias("pos"), "lat", "lon", T.street_key(F.col("v")).alias("street"), T.house_key(F.col("h")).alias("house"))
    parts = F.split("address", ",")
    q = _final(s, d).filter("address like '%,%'").select(F.col("final_id").alias("id"), T.street_key(F.try_element_at(parts, F.lit(-2))).alias("street"), T.house_key(F.try_element_at(parts, F.lit(-1))).alias("house"))
    return reconcile.geocode(q, ix).select("id", "precision")


@query("ref_J17_phone_siblings", f"WITH b AS (SELECT final_id AS id, {phone('phone')} AS p, {norm(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} AS t FROM final_filtered WHERE coalesce({phone('phone')}, '') <> ''), n AS (SELECT p, count(DISTINCT t) - 1 AS siblings FROM b GROUP BY 1) SELECT id, siblings FROM b JOIN n USING (p)")
def _(s, d):
    return reconcile.same_phone_siblings(_final(s, d), "final_id", "phone", "title")


@query("ref_A28_greedy_entities")
def _(s, d):
    f = _final(s, d).filter("title is not null").select(F.col("final_id").alias("id"), F.coalesce("detected_district", F.lit("")).alias("block"), T.name_key(F.col("title"), STOP).alias("stems"))
    return reconcile.greedy_entities(f, "block", ["id"])


# chains, summaries, audits

_BY = f"""WITH b AS (SELECT *, coalesce({phone(bare_phone('phone'))}, '') AS k1, coalesce({norm('title')}, '') AS k2, CASE WHEN latitude IS NULL OR longitude IS NULL THEN '' ELSE CAST(CAST(floor(latitude * 10000 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(longitude * 10000 + 0.5) AS BIGINT) AS VARCHAR) || '|' || {norm(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} END AS k3 FROM final_filtered),
 c AS (SELECT *, CASE WHEN k1 = '' THEN 0 ELSE count(*) OVER (PARTITION BY k1) END AS n1, CASE WHEN k2 = '' THEN 0 ELSE count(*) OVER (PARTITION BY k2) END AS n2, CASE WHEN k3 = '' THEN 0 ELSE count(*) OVER (PARTITION BY k3) END AS n3 FROM b)"""


@query("ref_W1_A12_decorate", f"{_BY} SELECT final_id, CASE WHEN greatest(n1, n2) > 1 THEN greatest(n1, n2) END AS chain_size, CASE WHEN greatest(n1, n2) >= 3 THEN 'CHAIN' ELSE '' END AS chain_flag, CASE WHEN n3 > 1 THEN n3 - 1 END AS coord_duplicates FROM c")
def _(s, d):
    return report.decorate(_final(s, d)).select("final_id", "chain_size", "chain_flag", "coord_duplicates")


@query("ref_A13_address_counts", f"WITH b AS (SELECT final_id, coalesce({norm('address')}, '') AS a FROM final_filtered) SELECT final_id, CASE WHEN a = '' THEN 0 ELSE count(*) OVER (PARTITION BY a) END AS same_address FROM b")
def _(s, d):
    return report.key_counts(_final(s, d), {"same_address": T.normalize(F.col("address"))}).select("final_id", "same_address")


@query("ref_A14_A17_summary", f"{_BY}, x AS (SELECT coalesce(nullif(trim(detected_district), ''), '—') AS district, CASE WHEN greatest(n1, n2) >= 3 THEN 1 ELSE 0 END AS ch, CASE WHEN trim(coalesce(phone, '')) <> '' THEN 1 ELSE 0 END AS ph, CASE WHEN trim(coalesce(website, '')) <> '' THEN 1 ELSE 0 END AS si FROM c) SELECT district, count(*) AS total, CAST(sum(ch) AS BIGINT) AS chained, CAST(sum(ph) AS BIGINT) AS with_phone, CAST(sum(si) AS BIGINT) AS with_site FROM x GROUP BY 1 UNION ALL SELECT 'ИТОГО', count(*), CAST(sum(ch) AS BIGINT), CAST(sum(ph) AS BIGINT), CAST(sum(si) AS BIGINT) FROM x")
def _(s, d):
    return report.summary(report.decorate(_final(s, d)), "detected_district", "detected_category_group")


@query("ref_A15_chains", f"WITH b AS (SELECT {norm('title')} AS name, nullif(trim(detected_district), '') AS d, {phone('phone')} AS p FROM final_filtered), n AS (SELECT name, count(*) AS n, coalesce(array_to_string(list_sort(list_distinct(list(d) FILTER (WHERE d IS NOT NULL))), ', '), '') AS districts FROM b WHERE name <> '' GROUP BY 1 HAVING count(*) >= 3), q AS (SELECT name, p, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, p) AS rn FROM b WHERE p <> '' GROUP BY 1, 2) SELECT n.name, n, districts, coalesce(p, '') AS phone FROM n LEFT JOIN q ON q.name = n.name AND rn = 1")
def _(s, d):
    return report.chain_table(_final(s, d))


@query("ref_A16_group_counts", f"SELECT g AS group_name, count(*) AS n FROM (SELECT unnest({_PARTS}) AS g FROM final_filtered) GROUP BY 1")
def _(s, d):
    return report.group_counts(_final(s, d), "detected_category_group")


@query("ref_A18_O5_top_hits", f"SELECT coalesce(nullif(r.d, ''), '—') AS value, count(*) AS n FROM (SELECT unnest({RECS}) AS r FROM raw_places) GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def _(s, d):
    return quality.top_hits(_raw(s, d), "district")


@query("ref_A19_completeness", " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE coalesce(CAST({f} AS VARCHAR), '') <> '') AS filled, CAST(floor(1000.0 * count(*) FILTER (WHERE coalesce(CAST({f} AS VARCHAR), '') <> '') / greatest(count(*), 1) + 0.5) AS BIGINT) AS per_mille FROM raw_places" for f in FIELDS))
def _(s, d):
    return quality.completeness(_raw(s, d), FIELDS)


@query("ref_A20_id_uniqueness", "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS filled, count(*) AS distinct_ids, count(*) FILTER (WHERE n > 1) AS repeated_ids, coalesce(max(n), 0) AS most FROM (SELECT trim(place_id) AS i, count(*) AS n FROM raw_places WHERE trim(place_id) <> '' GROUP BY 1)")
def _(s, d):
    return quality.id_uniqueness(_raw(s, d))


@query("ref_A21_value_counts", " UNION ALL ".join(f"SELECT '{c}' AS column_name, coalesce(nullif({c}, ''), '—') AS value, count(*) AS n FROM final_filtered GROUP BY 2" for c in ("category_validation", "district_validation", "district_quality", "final_status")))
def _(s, d):
    return quality.value_counts(_final(s, d), ("category_validation", "district_validation", "district_quality", "final_status"))


@query("ref_A10_yield_ledger", f"WITH p AS (SELECT {norm('coalesce(source_district, ' + chr(39) * 2 + ')')} AS district, {norm('coalesce(source_query, ' + chr(39) * 2 + ')')} AS query, CAST(captured_at AS DATE) AS day, count(*) AS n FROM raw_places GROUP BY ALL) SELECT district, query, arg_max(n, day) AS n_rows, arg_max(n, day) < 15 AS low FROM p GROUP BY ALL")
def _(s, d):
    return quality.yield_ledger(_raw(s, d))


@query("ref_A7_U5_register_groups", f"SELECT DISTINCT {norm('g')} AS group_name FROM (SELECT r.g AS g FROM (SELECT unnest({RECS}) AS r FROM raw_places) UNION ALL SELECT group_name FROM query_list) WHERE coalesce(trim(g), '') <> ''")
def _(s, d):
    r = _raw(s, d).select(F.explode(T.source_records(F.col("source_records"))).alias("r")).select(F.col("r.group").alias("g"))
    return r.unionByName(table(s, d, "query_list").select(F.col("group_name").alias("g"))).filter("trim(g) <> ''").select(T.normalize(F.col("g")).alias("group_name")).distinct()


# windows, order, sets


@query("ref_W2_first_last", "SELECT trim(place_id) AS place_id, min(raw_id) AS first_id, max(raw_id) AS last_id FROM raw_places WHERE trim(place_id) <> '' GROUP BY 1")
def _(s, d):
    return _raw(s, d).withColumn("place_id", F.trim("place_id")).filter("place_id <> ''").groupBy("place_id").agg(F.min("raw_id").alias("first_id"), F.max("raw_id").alias("last_id"))


@query("ref_W3_numbered_rows", "SELECT final_id, row_number() OVER (PARTITION BY detected_district ORDER BY final_id) AS no FROM final_filtered")
def _(s, d):
    return report.numbered_rows(_final(s, d).select("final_id", "detected_district"), "detected_district", ["final_id"]).select("final_id", "no")


@query("ref_W4_district_numbers", "SELECT district_name AS name, CAST(district_id AS INTEGER) AS no FROM districts UNION ALL SELECT n, CAST((SELECT max(district_id) FROM districts) + row_number() OVER (ORDER BY n) AS INTEGER) FROM (SELECT DISTINCT trim(detected_district) AS n FROM final_filtered WHERE trim(detected_district) <> '' AND trim(detected_district) NOT IN (SELECT district_name FROM districts))")
def _(s, d):
    known = table(s, d, "districts").select(F.col("district_name").alias("name"), F.col("district_id").alias("no"))
    return report.district_numbers(known, _final(s, d).select(F.trim("detected_district").alias("name")).filter("name <> ''"))


@query("ref_O1_O2_page", "SELECT raw_id FROM raw_places ORDER BY raw_id LIMIT 500 OFFSET 500")
def _(s, d):
    return _raw(s, d).select("raw_id").orderBy("raw_id").offset(500).limit(500)


@query("ref_O4_chains_by_size", f"SELECT {norm('title')} AS name, count(*) AS n FROM final_filtered WHERE {norm('title')} <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def _(s, d):
    return _final(s, d).select(T.normalize(F.col("title")).alias("name")).filter("name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)


@query("ref_U4_common_stems", f"WITH s AS (SELECT final_id, {_STEMS} AS a, list_sort(list_distinct(list_transform(list_filter(string_split(regexp_replace(regexp_replace({norm('categories')}, '\\([^)]*\\)', ' ', 'g'), '[^а-я0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(chr(39) + w + chr(39) for w in STOP)})), lambda w: substr(w, 1, 6)))) AS b FROM final_filtered) SELECT final_id, len(list_intersect(a, b)) AS n FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def _(s, d):
    f = _final(s, d).select("final_id", T.name_key(F.col("title"), STOP).alias("a"), T.name_key(F.col("categories"), STOP).alias("b")).filter("a is not null and b is not null")
    return f.select("final_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n"))


# verdicts by record and organisation

_VERDICTS = f"""WITH {RINGS}, k AS (SELECT *, {KEY} AS key FROM raw_places), pts AS (SELECT raw_id AS id, {LAT} AS lat, {LON} AS lon FROM k WHERE key IS NOT NULL AND latitude <> 0 AND longitude <> 0),
 hit AS (SELECT p.id, e.region FROM pts p JOIN edges e ON (e.ay > p.lat) <> (e.by_ > p.lat) AND p.lon < (e.bx - e.ax) * (p.lat - e.ay) / (e.by_ - e.ay) + e.ax GROUP BY ALL HAVING count(*) % 2 = 1),
 inside AS (SELECT id, any_value(district_name) AS found FROM (SELECT id, min(region) AS region FROM hit GROUP BY 1) h JOIN districts d ON d.district_id = h.region GROUP BY 1),
 r AS (SELECT raw_id, key, unnest(CASE WHEN len({RECS}) = 0 THEN [NULL] ELSE {RECS} END) AS r FROM k WHERE key IS NOT NULL),
 v AS (SELECT r.raw_id, r.key, coalesce(r.r.d, '') AS asked, i.found, CASE WHEN p.id IS NULL THEN 'NO_COORDINATES' WHEN i.found IS NULL THEN 'OUTSIDE' WHEN coalesce(r.r.d, '') = '' THEN 'NO_DISTRICT' WHEN {norm('r.r.d')} = {norm('i.found')} THEN 'MATCH' ELSE 'REASSIGNED' END AS verdict
  FROM r LEFT JOIN inside i ON i.id = r.raw_id LEFT JOIN (SELECT DISTINCT id FROM pts) p ON p.id = r.raw_id)"""


def _verdicts(s, d):
    return verdicts.record_verdicts(merge.keyed(_raw(s, d)), "raw_id", table(s, d, "districts"))


@query("ref_F4_record_verdicts", f"{_VERDICTS} SELECT raw_id, asked, found, verdict FROM v")
def _(s, d):
    return _verdicts(s, d).select("raw_id", "asked", "found", "verdict")


@query("ref_A8_rollup", f"{_VERDICTS} SELECT key, count(*) AS n, bool_or(verdict = 'MATCH') AS any_match, bool_and(verdict = 'OUTSIDE') AS every_outside, array_to_string(list_sort(list_distinct(list(verdict))), ' | ') AS verdicts FROM v GROUP BY 1")
def _(s, d):
    return verdicts.roll_up(_verdicts(s, d))


@query("ref_A9_A22_verdict_counts", f"{_VERDICTS}, u AS (SELECT key, array_to_string(list_sort(list_distinct(list(verdict))), ' | ') AS verdicts FROM v GROUP BY 1) SELECT verdicts, count(*) AS organisations FROM u GROUP BY 1")
def _(s, d):
    return verdicts.verdict_counts(verdicts.roll_up(_verdicts(s, d)))


# extraction, lookups and views of the map


@query("ref_S6_S7_P9_X1_entities")
def _(s, d):
    return nesting.entities(table(s, d, "search_payloads")).select("payload_id", "place_id", "title", "lat", "lon", "address")


@query("ref_F3_district_in_text", "SELECT raw_id, coalesce(CASE " + " ".join(f"WHEN contains({norm('address')}, (SELECT {norm('district_name')} FROM districts WHERE district_id = {i})) THEN {i}" for i in range(1, 13)) + " END, 0) AS named FROM raw_places")
def _(s, d):
    return _raw(s, d).select("raw_id", F.coalesce(T.first_contained(F.col("address"), list(enumerate(map(str.lower, district_names(table(s, d, "districts"))), 1))), F.lit(0)).alias("named"))


@query("ref_P20_recapitalise", "SELECT final_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND w[i - 1] IN ('в', 'во', 'на') THEN upper(x[1]) || lower(x[2:]) ELSE x END), ' ') AS name FROM (SELECT final_id, string_split(lower(title), ' ') AS w FROM final_filtered)")
def _(s, d):
    return _final(s, d).select("final_id", T.title_case_after(F.col("title")).alias("name"))


@query("ref_P28_group_labels", f"SELECT final_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN {norm('categories')} LIKE '%кафе%' OR {norm('categories')} LIKE '%ресторан%' THEN 'food' END, CASE WHEN {norm('categories')} LIKE '%магазин%' THEN 'retail' END], lambda x: x IS NOT NULL), ' / '), ''), '—') AS label FROM final_filtered")
def _(s, d):
    g = T.groups_of_rubrics(F.col("categories"), {"food": ["кафе", "ресторан"], "retail": ["магазин"]})
    return _final(s, d).select("final_id", F.coalesce(T.filled(F.array_join(g, " / ")), F.lit("—")).alias("label"))


@query("ref_P30_P31_free_text_address", "SELECT raw_id, regexp_extract(lower(address), '(?:^|[ ,;])([а-яё-]+ (?:улица|проспект|проезд|переулок|шоссе|бульвар|набережная))', 1) AS street, substr(regexp_extract(address, '(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)', 1), 1, 5) AS post FROM raw_places WHERE address IS NOT NULL")
def _(s, d):
    a = F.lower("address")
    return _raw(s, d).filter("address is not null").select("raw_id", F.regexp_extract(a, "(?:^|[ ,;])([а-яё-]+ (?:улица|проспект|проезд|переулок|шоссе|бульвар|набережная))", 1).alias("street"), F.substring(F.regexp_extract("address", "(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)", 1), 1, 5).alias("post"))


@query("ref_A11_run_metadata", "SELECT export_batch_status AS status, count(*) AS n_rows, max(export_queries_total) AS total, max(export_queries_completed) AS completed, coalesce(array_to_string(list_sort(list_distinct(list(export_warnings) FILTER (WHERE coalesce(export_warnings, '') <> ''))), ' | '), '') AS warnings FROM raw_places GROUP BY 1")
def _(s, d):
    w = F.array_join(F.array_sort(F.collect_set(T.filled(F.col("export_warnings")))), " | ")
    return _raw(s, d).groupBy(F.col("export_batch_status").alias("status")).agg(F.count("*").alias("n_rows"), F.max("export_queries_total").alias("total"), F.max("export_queries_completed").alias("completed"), w.alias("warnings"))


@query("ref_C8_first_pending", "SELECT min(query_id) AS query_id FROM query_list q WHERE NOT EXISTS (SELECT 1 FROM raw_places r WHERE r.source_query = q.query_text AND r.export_batch_status = 'COMPLETED')")
def _(s, d):
    done = _raw(s, d).filter("export_batch_status = 'COMPLETED'").select(F.col("source_query").alias("query_text")).distinct()
    return table(s, d, "query_list").join(done, "query_text", "left_anti").agg(F.min("query_id").alias("query_id"))


# event streams


@query("ref_T5_T6_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n, min(ts) AS started FROM g GROUP BY user_id, k")
def _(s, d):
    from placeloom.streaming import ingest

    return ingest.sessions(table(s, d, "events"), "user_id", "ts", "3600 seconds").select("user_id", "n", F.col("start").alias("started"))


@query("ref_T4_overdue", "SELECT user_id, max(ts) AS last, max(ts) < TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 120 SECOND AS silent FROM events GROUP BY 1")
def _(s, d):
    from placeloom.streaming import ingest

    return ingest.overdue(table(s, d, "events"), "user_id", "ts", "2024-06-01 00:00:00")


def queries():
    return {k: fn for k, (fn, _) in Q.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in Q.items() if sql}

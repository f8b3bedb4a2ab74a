"""Queries of importing, storing and exporting the register, and of its remaining lookups, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import geometry, imports, merge, nesting, proximity, reconcile, report, verdicts
from placeloom.operators.store import Register
from placeloom.plans import reference as R
from placeloom.plans.tables import table
from placeloom.session import work_folder
from placeloom.sources import files
from placeloom.streaming import ingest

Q: dict[str, tuple] = {}
TEXTS = ("title", "address", "phone", "website", "maps_url", "categories", "opening_hours", "street", "labels", "email", "phones", "socials")
# white space that a trimmed cell loses, for RE2
_STRIP = f"^{R.WS}|{R.WS}$"


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn

    return keep


def _raw(s, d):
    return table(s, d, "raw_places")


def _final(s, d):
    return table(s, d, "final_filtered")


def _cell(c: str) -> str:
    """A cell of a file as it is read: text without white space around it, null where nothing is left."""
    return f"nullif(regexp_replace(CAST({c} AS VARCHAR), '{_STRIP}', '', 'g'), '')"


def _cells(df):
    return df.select(*[T.filled(F.regexp_replace(F.col(c).cast("string"), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")).alias(c) for c in df.columns])


# delimited files

_NAMES = ("raw_id", "title", "address", "phone", "categories", "source_records")


@query("ref_S1_S2_delimited", f"SELECT {', '.join(f'{_cell(c)} AS {c}' for c in _NAMES)} FROM raw_places")
def _(s, d):
    path = work_folder(s, "delimited")
    _raw(s, d).select(*_NAMES).write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(path)
    return _cells(files.read_delimited(s, path))


@query("ref_K1_K2_single_file", "SELECT CAST(query_id AS VARCHAR) AS query_id, district, group_name, category, query_text FROM query_list")
def _(s, d):
    path = f"{work_folder(s, 'single')}.csv"
    files.write_export(table(s, d, "query_list").select("query_id", "district", "group_name", "category", "query_text"), path, single_file=True)
    return _cells(files.read_delimited(s, path))


@query("ref_S3_F9_query_list", "SELECT 'q-' || CAST(n + 1 AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS id, district, group_name, category, query_text, 'PENDING' AS status FROM (SELECT *, row_number() OVER (ORDER BY query_id) AS n FROM query_list)")
def _(s, d):
    listed = table(s, d, "query_list").orderBy("query_id").coalesce(1)
    twice = listed.unionByName(listed.withColumn("query_text", F.upper("query_text")))  # other writings of what is listed
    path = work_folder(s, "queries")
    twice.select(F.col("district").alias("Район"), F.col("group_name").alias("Группа"), F.col("category").alias("Категория"), F.col("query_text").alias("Запрос")).coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    return files.query_list(files.read_delimited(s, path)).select("id", "district", "group_name", "category", "query_text", "status")


_ZIP = """list_filter(list_transform(generate_series(1, greatest(1, len(ds), len(gs), len(cs), len(qs))), lambda i: {'d': coalesce(ds[i], ds[1], ''), 'g': coalesce(gs[i], gs[1], ''), 'c': coalesce(cs[i], cs[1], ''), 'q': coalesce(qs[i], qs[1], '')}), lambda r: r.d || r.g || r.c || r.q <> '')"""
_SPLIT = ", ".join(f"list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS {n}" for c, n in (("source_district", "ds"), ("source_group", "gs"), ("source_category", "cs"), ("source_query", "qs")))
_REC_OF = f"SELECT *, CASE WHEN json_type(TRY_CAST(source_records AS JSON)) = 'ARRAY' THEN {R.RECS} ELSE {_ZIP} END AS recs FROM (SELECT *, {_SPLIT} FROM raw_places)"


@query("ref_S5_zipped_records", f"SELECT raw_id, i AS pos, r.d AS district, r.g AS group_name, r.c AS category, r.q AS query_text FROM (SELECT raw_id, unnest(z) AS r, CAST(generate_subscripts(z, 1) AS INTEGER) AS i FROM (SELECT raw_id, {_ZIP} AS z FROM (SELECT raw_id, {_SPLIT} FROM raw_places)))")
def _(s, d):
    r = T.zipped_records(*[F.col(c) for c in imports.TEXTS])
    return _raw(s, d).select("raw_id", F.posexplode(r).alias("pos", "r")).select("raw_id", (F.col("pos") + 1).alias("pos"), F.col("r.district").alias("district"), F.col("r.group").alias("group_name"), F.col("r.category").alias("category"), F.col("r.query").alias("query_text"))


_KNOWN = "coalesce(nullif(trim(place_id), ''), nullif(trim(maps_url), ''), nullif(trim(title), '')) IS NOT NULL"
_IMPORT = f"""k AS (SELECT *, {R.KEY} AS key FROM ({_REC_OF}) WHERE {_KNOWN}), kk AS (SELECT * FROM k WHERE key IS NOT NULL),
 one AS (SELECT key, unnest(recs) AS r, raw_id, generate_subscripts(recs, 1) AS i FROM kk), met AS (SELECT key, r, min((raw_id, i)) AS met_at FROM one GROUP BY ALL),
 per AS (SELECT key, count(*) AS n, list(r.q ORDER BY met_at) AS qs FROM met GROUP BY 1),
 lst AS (SELECT key, arg_max({{'title': title, 'phone': phone, 'email': email, 'q': source_query, 'n': coalesce(nullif(source_queries_count, 0), 1)}}, raw_id) AS v, count(*) AS n_rows FROM kk GROUP BY 1),
 rows_ AS (SELECT l.key, v.title AS title, v.phone AS phone, v.email AS email, n_rows, CAST(coalesce(p.n, v.n) AS BIGINT) AS queries, coalesce(p.qs, []) AS qs, v.q AS own FROM lst l LEFT JOIN per p USING (key))"""


def _imported(s, d):
    return imports.import_rows(_raw(s, d), ("title", "phone", "email"), "raw_id")


@query("ref_S4_A5_import", f"WITH {_IMPORT} SELECT key, title, phone, email, n_rows, queries FROM rows_")
def _(s, d):
    return _imported(s, d).select("key", "title", "phone", "email", "n_rows", F.col("source_queries_count").cast("long").alias("queries"))


@query("ref_A6_import_hits", f"WITH {_IMPORT} SELECT count(*) AS organisations, CAST(sum(queries) AS BIGINT) AS hits FROM rows_")
def _(s, d):
    return imports.import_hits(_imported(s, d))


@query("ref_S4_import_queue", f"WITH e AS (SELECT unnest(recs) AS r, raw_id, generate_subscripts(recs, 1) AS i FROM ({_REC_OF})), m AS (SELECT r, min((raw_id, i)) AS met_at FROM e GROUP BY 1) SELECT row_number() OVER (ORDER BY met_at) AS position, r.d AS district, r.g AS group_name, r.c AS category, r.q AS query_text, 'COMPLETED' AS status FROM m")
def _(s, d):
    return imports.import_queue(_raw(s, d), "raw_id").withColumnsRenamed({"group": "group_name", "query": "query_text"})


@query("ref_P6_P7_P8_provenance_texts", f"SELECT raw_id, i AS pos, r.d AS district, r.g AS group_name, r.c AS category, r.q AS query_text FROM (SELECT raw_id, unnest(recs) AS r, CAST(generate_subscripts(recs, 1) AS INTEGER) AS i FROM (SELECT raw_id, {R.RECS} AS recs FROM raw_places))")
def _(s, d):
    return _raw(s, d).select("raw_id", F.posexplode(T.source_records(F.col("source_records"))).alias("pos", "r")).select("raw_id", (F.col("pos") + 1).alias("pos"), F.col("r.district").alias("district"), F.col("r.group").alias("group_name"), F.col("r.category").alias("category"), F.col("r.query").alias("query_text"))


# exports

_META = {"export_batch_status": "RAW_ALL", "export_queries_total": "132", "export_queries_completed": "132", "export_queries_low_yield": "0", "export_warnings": "first | second"}
_EXPORTED = ("raw_id", "place_id", *TEXTS, "rating", "review_count", "photos", "detail_level", "source_queries_count")


@query("ref_K3_raw_export", f"SELECT {', '.join(f'{_cell(c)} AS {c}' for c in _EXPORTED)}, " + ", ".join(f"'{v}' AS {k}" for k, v in _META.items()) + " FROM raw_places")
def _(s, d):
    path = work_folder(s, "raw")
    rows = files.with_run(_raw(s, d).select(*_EXPORTED), "RAW_ALL", 132, 132, 0, ["first", "", "second", "first"])
    files.write_export(rows, path)
    return _cells(files.read_exported(s, path, rows.columns))


_FINAL_TEXT = ("final_id", "place_id", "title", "address", "phone", "website", "categories", "email", "detected_district", "final_status")


@query("ref_K4_S12_final_export", f"{R._BY} SELECT {', '.join(f'{_cell(c)} AS {c}' for c in _FINAL_TEXT)}, CAST(CASE WHEN greatest(n1, n2) > 1 THEN greatest(n1, n2) END AS VARCHAR) AS chain_size, CASE WHEN greatest(n1, n2) >= 3 THEN 'CHAIN' END AS chain_flag, CAST(CASE WHEN n3 > 1 THEN n3 - 1 END AS VARCHAR) AS coord_duplicates FROM c")
def _(s, d):
    path = work_folder(s, "final")
    rows = report.decorate(_final(s, d))
    columns = [c for c in _final(s, d).columns if c != "exported_at"]
    files.write_export(rows.select(*columns), path)
    back = _cells(files.read_exported(s, path, columns))
    return files.require_columns(back, ("title", "address", "detected_district")).select(*_FINAL_TEXT, "chain_size", "chain_flag", "coord_duplicates")


@query("ref_K5_rejected_export", f"{R._VERDICTS}, u AS (SELECT key FROM v GROUP BY 1 HAVING bool_and(verdict = 'OUTSIDE')), f AS (SELECT key, min(raw_id) AS raw_id FROM k WHERE key IS NOT NULL GROUP BY 1) SELECT CAST(r.raw_id AS VARCHAR) AS raw_id, {_cell(R.bare_phone('r.phone'))} AS phone, nullif(regexp_extract(r.phone, '{R.EXT}', 1), '') AS phone_ext, CAST(NULL AS VARCHAR) AS chain_size, 'OUTSIDE' AS exclude_reason FROM u JOIN f USING (key) JOIN raw_places r ON r.raw_id = f.raw_id")
def _(s, d):
    path = work_folder(s, "rejected")
    out = verdicts.roll_up(R._verdicts(s, d)).filter("every_outside").select("key")
    first = merge.keyed(_raw(s, d)).groupBy("key").agg(F.min_by(F.struct("raw_id", "phone"), "raw_id").alias("v")).select("key", "v.*")
    rows = report.rejected(first.join(out, "key", "left_semi"), "OUTSIDE").select("raw_id", "phone", "phone_ext", "chain_size", "exclude_reason")
    files.write_export(rows, path)
    return _cells(files.read_exported(s, path, rows.columns))


@query("ref_K7_books", "WITH f AS (SELECT final_id, coalesce(nullif(trim(detected_district), ''), '—') AS name FROM final_filtered), n AS (SELECT name, printf('%02d', row_number() OVER (ORDER BY name)) || ' ' || name AS book FROM (SELECT DISTINCT name FROM f)), c AS (SELECT osm_id FROM osm_places WHERE elem_type = 'way') SELECT book, final_id AS id, 'own' AS origin FROM f JOIN n USING (name) UNION ALL SELECT book, osm_id, 'common' FROM n, c")
def _(s, d):
    path = work_folder(s, "books")
    common = table(s, d, "osm_places").filter("elem_type = 'way'").select(F.col("osm_id").alias("id"), F.lit("common").alias("origin"))
    rows = files.books(_final(s, d).select(F.col("final_id").alias("id"), "detected_district", F.lit("own").alias("origin")), "detected_district", common)
    files.write_books(rows.select("id", "origin", "book"), path, "book")
    return s.read.csv(path, header=True, schema="id long, origin string, book string").select("book", "id", "origin")


@query("ref_K8_K13_repaired_plain", f"SELECT CAST(raw_id AS VARCHAR) AS raw_id, {_cell('title')} AS title, CAST(CAST(floor(CASE WHEN w THEN longitude ELSE latitude END * 1000000 + 0.5) AS BIGINT) AS VARCHAR) AS lat_e6 FROM (SELECT *, coalesce(latitude BETWEEN 36 AND 39.5 AND longitude BETWEEN 54.5 AND 57, false) AS w FROM raw_places)")
def _(s, d):
    path = work_folder(s, "plain")
    rows = files.raw_export(_raw(s, d).withColumns({"latitude": F.col("latitude").cast("string"), "longitude": F.col("longitude").cast("string")}).withColumn("maps_url", F.coalesce("maps_url", F.lit("-"))))
    rows = rows.select("raw_id", "title", F.floor(F.col("latitude") * 1000000 + 0.5).alias("lat_e6"), F.lit("hidden").alias("_note"))
    files.write_plain(rows, path)
    return _cells(files.read_exported(s, path, ("raw_id", "title", "lat_e6")))


# other sources


@query("ref_S8_state_view", "SELECT NULL")
def _(s, d):
    pages = table(s, d, "search_payloads").select("payload_id", F.concat(F.lit('<html><script type="application/json" class="x state-view">'), "payload", F.lit("</script></html>")).alias("html"))
    return nesting.flatten_payloads(pages.select("payload_id", files.script_state(F.col("html")).alias("payload")), "places").select("payload_id", "place_pos", "place_id", "title")


@query("ref_S14_S15_features", f"WITH {R.RINGS} SELECT d.district_name AS name, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM edges e JOIN districts d ON d.district_id = e.region GROUP BY 1")
def _(s, d):
    path = work_folder(s, "features")
    rows = table(s, d, "districts").orderBy("district_id").select(F.format_string('{"type":"Feature","properties":{"%s":"%s"},"geometry":%s}', F.when(F.col("district_id") % 2 == 0, "NAME").otherwise("name:ru"), F.upper("district_name"), "geojson").alias("f"))
    doc = rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))  # a document is one value
    doc.coalesce(1).write.text(path)
    named = files.features_of(files.read_features(s, path), table(s, d, "districts").select(F.col("district_name").alias("name")))
    return geometry.bounds(named.withColumnRenamed("name", "district_id")).withColumnRenamed("region", "name")


@query("ref_S18_J14_active_cards", "WITH a AS (SELECT trim(place_id) AS place_id, max(raw_id) AS raw_id FROM raw_places WHERE detail_level = 'CARD' AND trim(place_id) <> '' GROUP BY 1) SELECT f.final_id, a.raw_id FROM final_filtered f LEFT JOIN a USING (place_id)")
def _(s, d):
    rows = _raw(s, d).select(F.trim("place_id").alias("place_id"), "detail_level", "raw_id").filter("place_id <> ''")
    return _final(s, d).select("final_id", "place_id").join(reconcile.latest_active(rows, "place_id", "detail_level", "CARD", "raw_id"), "place_id", "left").select("final_id", "raw_id")


@query("ref_S19_attached_names", "WITH l AS (SELECT final_id, list_prepend(coalesce(title, ''), string_split(coalesce(categories, ''), ',')) AS ns FROM final_filtered), u AS (SELECT final_id, unnest(ns) AS one_name, generate_subscripts(ns, 1) AS i FROM l), m AS (SELECT final_id, one_name, min(i) AS i FROM u GROUP BY ALL) SELECT final_id, CAST(row_number() OVER (PARTITION BY final_id ORDER BY i) - 1 AS INTEGER) AS pos, one_name FROM m")
def _(s, d):
    rows = _final(s, d).select("final_id", F.coalesce("title", F.lit("")).alias("name"), F.split(F.coalesce("categories", F.lit("")), ",").alias("others"))
    return files.attached_names(rows, "name", "others").select("final_id", "pos", "one_name")


_LEGACY = "SELECT 0 AS part, * FROM k WHERE detail_level = 'CARD' UNION ALL SELECT 1, * FROM k WHERE detail_level = 'LIST' UNION ALL SELECT 2, * FROM k WHERE detail_level IS NULL OR detail_level NOT IN ('CARD', 'LIST')"


@query("ref_S20_U1_legacy_load", f"WITH k AS (SELECT *, {R.KEY} AS key FROM raw_places), l AS ({_LEGACY}), o AS (SELECT *, part * 1000000000 + raw_id AS seq FROM l WHERE key IS NOT NULL) SELECT key, " + ", ".join(f"arg_min({f}, seq) FILTER (WHERE coalesce({f}, '') <> '') AS {f}" for f in ("title", "phone", "email")) + " FROM o GROUP BY 1")
def _(s, d):
    k = merge.keyed(_raw(s, d))
    parts = [k.filter("detail_level = 'CARD'"), k.filter("detail_level = 'LIST'"), k.filter("detail_level is null or detail_level not in ('CARD', 'LIST')")]
    loaded = merge.union_registers(*parts, *parts)  # loading again changes nothing
    seq = F.when(F.col("part") < 3, F.col("part")).otherwise(F.col("part") - 3)
    return merge.merge_records(loaded.withColumn("seq", F.struct(seq.alias("p"), "raw_id")), ("title", "phone", "email"), "seq", records=None).select("key", "title", "phone", "email")


# the register as a store

_STORED = "SELECT key, count(*) AS hits, max(CASE detail_level WHEN 'LIST' THEN 0 WHEN 'LIST_ONLY' THEN 1 WHEN 'CARD' THEN 2 ELSE -1 END) AS rank, " + ", ".join(f"max(coalesce({f}, '') <> '') AS has_{f}" for f in ("categories", "phone", "website", "opening_hours")) + f" FROM (SELECT *, {R.KEY} AS key FROM raw_places) WHERE key IS NOT NULL GROUP BY 1"


def _register(s, d):
    reg = Register(s, work_folder(s, "register"), ("title", "phone", "website", "categories", "opening_hours"))
    card = F.col("detail_level") == "CARD"
    for part in (_raw(s, d).filter(card), _raw(s, d).filter(~F.coalesce(card, F.lit(False)))):  # cards first, then all other captures
        reg.put_raw(part, "raw_id")
    reg.put("final", _final(s, d).select(F.concat(F.lit("id:"), "place_id").alias("key"), "title"))
    reg.put("final", _final(s, d).select(F.concat(F.lit("id:"), "place_id").alias("key"), F.upper("title").alias("title")))
    return reg


@query("ref_K11_A4_X3_store", f"WITH s AS ({_STORED}) SELECT 'raw' AS store, count(*) AS n_rows, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (WHERE rank = 0 AND NOT (has_categories AND has_phone AND has_website AND has_opening_hours)) AS pending FROM s UNION ALL SELECT 'final', count(*), 0, 0 FROM final_filtered UNION ALL SELECT 'rejected', 0, 0, 0")
def _(s, d):
    return _register(s, d).stats()


@query("ref_K12_clear_stores", "SELECT 'raw' AS store, 0 AS n_rows UNION ALL SELECT 'final', 0 UNION ALL SELECT 'rejected', 0")
def _(s, d):
    reg = _register(s, d)
    reg.clear("raw")
    return reg.stats().select("store", "n_rows")


@query("ref_S10_S11_lookup", f"WITH s AS (SELECT key, min(trim(place_id)) AS place_id, count(*) AS hits FROM (SELECT *, {R.KEY} AS key FROM raw_places) WHERE key IS NOT NULL GROUP BY 1) SELECT key, hits FROM s WHERE place_id IN (SELECT place_id FROM final_filtered)")
def _(s, d):
    reg = Register(s, work_folder(s, "register"), ("title",))
    reg.put_raw(_raw(s, d).withColumn("place_id", F.trim("place_id")), "raw_id")
    return reg.get(_final(s, d)).select("key", "hits")


@query("ref_T3_pending_queue", "SELECT raw_id FROM raw_places r WHERE detail_level = 'LIST' AND (coalesce(categories, '') = '' OR coalesce(phone, '') = '' OR coalesce(website, '') = '' OR coalesce(opening_hours, '') = '') AND NOT EXISTS (SELECT 1 FROM raw_places c WHERE c.detail_level = 'CARD' AND trim(c.place_id) = trim(r.place_id))")
def _(s, d):
    rows = _raw(s, d).withColumn("pid", F.trim("place_id"))
    return merge.still_pending(rows, rows.filter("detail_level = 'CARD'"), "pid").select("raw_id")


# lookups and views


@query("ref_P18_decimal_numbers", "SELECT raw_id, TRY_CAST(replace(trim(replace(CAST(rating AS VARCHAR), '.', ',')), ',', '.') AS DOUBLE) AS rating, TRY_CAST(replace(trim(title), ',', '.') AS DOUBLE) AS of_title FROM raw_places")
def _(s, d):
    return _raw(s, d).select("raw_id", T.number(F.replace(F.col("rating").cast("string"), F.lit("."), F.lit(","))).alias("rating"), T.number(F.col("title")).alias("of_title"))


_PLACE = f"substr(regexp_extract({R.norm('coalesce(title, chr(32))')}, '(?:^| )(?:в|во|на) ([а-я]+)', 1), 1, 4)"


@query("ref_P21_districts_in_names", f"WITH t AS (SELECT final_id, {R.norm('coalesce(title, chr(32))')} AS t, {R.norm('coalesce(address, chr(32))')} AS a, {_PLACE} AS p FROM final_filtered), n AS (SELECT district_id, district_name, {R.norm('district_name')} AS n FROM districts) SELECT final_id, coalesce((SELECT arg_min(district_name, district_id) FROM n WHERE contains(a, substr(n, 1, length(n) - 1)) OR contains(a, '«' || n || '»')), '') AS mentioned, coalesce((SELECT arg_min(district_name, district_id) FROM n WHERE p <> '' AND substr(n, 1, 4) = p), '') AS in_name FROM t")
def _(s, d):
    names = R.district_names(table(s, d, "districts"))
    f = _final(s, d)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    # the address names no place with a preposition, so what it mentions is by name alone
    return f.select("final_id", F.when(T.district_in_name(blank("address"), names) == "", T.district_mentioned(blank("address"), names)).otherwise("").alias("mentioned"), T.district_in_name(blank("title"), names).alias("in_name"))


@query("ref_P23_district_views", f"WITH {R.RINGS}, b AS (SELECT region, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM edges GROUP BY 1) SELECT region, CAST(floor((x0 + x1) / 2 * 1000000 + 0.5) AS BIGINT) AS lon_e6, CAST(floor((y0 + y1) / 2 * 1000000 + 0.5) AS BIGINT) AS lat_e6, CAST(least(16, greatest(11, floor(least(log2(360 * 620 / 256.0 / greatest(x1 - x0, 0.000001)), log2(180 * 560 / 256.0 / greatest(y1 - y0, 0.000001)))))) AS BIGINT) AS zoom FROM b")
def _(s, d):
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 * 1000000 + 0.5)
    b = geometry.bounds(table(s, d, "districts"))
    return b.select("region", mid("x0", "x1").alias("lon_e6"), mid("y0", "y1").alias("lat_e6"), T.zoom_of(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("long").alias("zoom"))


@query("ref_P24_map_roots", "WITH p AS (SELECT raw_id, list_filter(string_split(regexp_replace(regexp_replace(maps_url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS ps FROM raw_places WHERE maps_url LIKE 'http%://%'), r AS (SELECT raw_id, CASE WHEN ps[1] = 'maps' THEN ps[2:] ELSE ps END AS rs FROM p), n AS (SELECT raw_id, rs, coalesce(regexp_full_match(rs[1], '[0-9]+'), false) AS num FROM r), c AS (SELECT raw_id, CASE WHEN num THEN rs[1] ELSE '213' END AS region, coalesce(CASE WHEN num THEN rs[2] ELSE rs[1] END, '') AS city FROM n) SELECT raw_id, region, CASE WHEN city <> '' AND NOT regexp_full_match(city, '[0-9]+') AND lower(city) NOT IN ('search', 'org', 'geo', 'chain', 'stops', 'transport', 'profile', 'discovery', 'reviews', 'photos', 'print', 'routes', 'panorama', 'narrative') THEN city ELSE 'moscow' END AS city FROM c")
def _(s, d):
    root = T.map_root(F.col("maps_url"))
    return _raw(s, d).filter("maps_url like 'http%://%'").select("raw_id", root["region"].alias("region"), root["city"].alias("city"))


@query("ref_P24_search_urls", "SELECT query_id, 'https://maps.example/maps/213/moscow/search/' || url_encode(query_text) || '/?ll=37.5%2C55.25&z=12' AS url FROM query_list")
def _(s, d):
    lit = F.lit
    root = T.map_root(lit("https://maps.example/maps/org/12345"))
    return table(s, d, "query_list").select("query_id", T.search_url(lit("https://maps.example"), root, F.col("query_text"), lit(37.5), lit(55.25), lit(12)).alias("url"))


@query("ref_F10_precedence", "SELECT final_id, CASE WHEN list_contains(g, 'Религиозные учреждения') THEN 'Религиозные учреждения' ELSE array_to_string(list_sort(g), ' / ') END AS label FROM (SELECT final_id, list_distinct(list_filter(list_transform(string_split_regex(coalesce(detected_category_group, ''), '[|;,/\\n]'), lambda x: trim(x)), lambda x: x <> '')) AS g FROM final_filtered)")
def _(s, d):
    return _final(s, d).select("final_id", F.array_join(F.array_sort(verdicts.one_group_first(F.col("detected_category_group"), "Религиозные учреждения")), " / ").alias("label"))


_SCORES = f"s AS (SELECT final_id, {R._STEMS} AS stems FROM final_filtered WHERE title IS NOT NULL), o AS (SELECT osm_id, title, {R._STEMS} AS stems FROM (SELECT osm_id, tags['name'] AS title FROM osm_places) WHERE title IS NOT NULL), c AS (SELECT osm_id, max(len(list_intersect(o.stems, s.stems)) / greatest(1, least(len(o.stems), len(s.stems)))) AS score FROM o JOIN s ON list_has_any(o.stems, s.stems) GROUP BY 1), st AS (SELECT o.osm_id, o.title, CASE WHEN coalesce(c.score, 0) >= 0.6 THEN 'EXISTS' WHEN coalesce(c.score, 0) >= 0.4 THEN 'CHECK' ELSE 'ABSENT' END AS status FROM o LEFT JOIN c USING (osm_id))"


def _statuses(s, d):
    stems = lambda df, i, t: df.filter(F.col(t).isNotNull()).select(F.col(i).alias("id"), T.name_key(F.col(t), R.STOP).alias("stems"))
    o = R._tagged(s, d).filter("name is not null").select("osm_id", F.col("name").alias("title"))
    best = reconcile.best_names(stems(o, "osm_id", "title"), stems(_final(s, d), "final_id", "title"), 0.4).select(F.col("id_a").alias("osm_id"), "score")
    return o.join(best, "osm_id", "left").select("osm_id", "title", reconcile.match_status(F.coalesce("score", F.lit(0.0))).alias("status"))


@query("ref_A27_status_counts", f"WITH {_SCORES} SELECT status, count(*) AS n FROM st GROUP BY 1")
def _(s, d):
    return _statuses(s, d).groupBy("status").agg(F.count("*").alias("n"))


@query("ref_O6_status_order", f"WITH {_SCORES} SELECT row_number() OVER (ORDER BY CASE status WHEN 'ABSENT' THEN 0 WHEN 'CHECK' THEN 1 ELSE 2 END, encode(title), osm_id) AS no, osm_id, status FROM st")
def _(s, d):
    rank = F.when(F.col("status") == "ABSENT", 0).when(F.col("status") == "CHECK", 1).otherwise(2)
    rows = _statuses(s, d).withColumns({"rank": rank, "_sheet": F.lit("all")})
    return report.numbered_rows(rows, "_sheet", ["rank", "title", "osm_id"]).select("no", "osm_id", "status")


@query("ref_J20_exists_same_place", f"WITH s AS (SELECT DISTINCT {R._STEMS} AS stems, {_PLACE.replace('1, 4)', '1, 5)')} AS p FROM final_filtered WHERE title IS NOT NULL), o AS (SELECT osm_id, {R._STEMS} AS stems, {_PLACE.replace('1, 4)', '1, 5)')} AS p FROM (SELECT osm_id, tags['name'] AS title FROM osm_places) WHERE title IS NOT NULL) SELECT osm_id FROM o WHERE EXISTS (SELECT 1 FROM s WHERE s.p = o.p AND list_has_any(o.stems, s.stems) AND len(list_intersect(o.stems, s.stems)) / greatest(1, least(len(o.stems), len(s.stems))) >= 0.8)")
def _(s, d):
    side = lambda df, i, t: df.filter(F.col(t).isNotNull()).select(F.col(i).alias("id"), T.name_key(F.col(t), R.STOP).alias("stems"), T.place_word(F.col(t)).alias("place"))
    return reconcile.exists_similar(side(R._tagged(s, d), "osm_id", "name"), side(_final(s, d), "final_id", "title"), 0.8).select(F.col("id").alias("osm_id"))


@query("ref_A29_only_district", f"WITH b AS (SELECT {R.norm('string_split(address, chr(44))[2]')} AS street, trim(detected_district) AS d FROM final_filtered WHERE address LIKE '%,%' AND trim(detected_district) <> '') SELECT street, min(d) AS district FROM b GROUP BY 1 HAVING count(DISTINCT d) = 1")
def _(s, d):
    rows = _final(s, d).filter("address like '%,%'").select(T.normalize(F.get(F.split("address", ","), F.lit(1))).alias("street"), T.filled(F.trim("detected_district")).alias("district"))
    return reconcile.only_candidate(rows, "street", "district")


@query("ref_J19_books_join", "SELECT f.final_id, o.osm_id FROM final_filtered f JOIN osm_places o ON coalesce(o.tags['addr:city'], '') = coalesce(nullif(trim(f.detected_district), ''), '-') AND o.elem_type = 'way'")
def _(s, d):
    o = table(s, d, "osm_places").filter("elem_type = 'way'").select("osm_id", F.coalesce(F.try_element_at("tags", F.lit("addr:city")), F.lit("")).alias("d"))
    return _final(s, d).select("final_id", F.coalesce(T.filled(F.trim("detected_district")), F.lit("-")).alias("d")).join(o, "d").select("final_id", "osm_id")


# sheets and other writers


@query("ref_C13_region_check", "SELECT district_name AS name, CASE WHEN district_id = 3 THEN 'BROKEN' ELSE 'GOOD' END AS state FROM districts UNION ALL SELECT 'нет такого', 'MISSING'")
def _(s, d):
    real = table(s, d, "districts")
    broken = real.withColumn("geojson", F.when(F.col("district_id") == 3, F.lit("{}")).otherwise(F.col("geojson")))
    return geometry.region_check(broken, real.select(F.col("district_name").alias("name")).unionByName(s.createDataFrame([("нет такого",)], "name string")))


_LABEL = R.Q["ref_P17_group_label"][1]


@query("ref_C15_C16_working_sheet", f"{R._BY}, l AS ({_LABEL}), a AS (SELECT final_id, coalesce({R.norm('address')}, '') AS adr FROM final_filtered), m AS (SELECT final_id, CASE WHEN adr <> '' THEN count(*) OVER (PARTITION BY adr) END AS same FROM a) SELECT coalesce(nullif(trim(c.detected_district), ''), '—') AS sheet, row_number() OVER (PARTITION BY coalesce(nullif(trim(c.detected_district), ''), '—') ORDER BY c.final_id) AS no, c.final_id, c.title, l.label AS groups, CASE WHEN m.same > 1 THEN m.same END AS same_address, CASE WHEN greatest(n1, n2) >= 3 THEN 'Да' ELSE '' END AS chain, coalesce(trim(string_split(c.website, ';')[1]), '') AS link FROM c JOIN l USING (final_id) JOIN m USING (final_id)")
def _(s, d):
    return report.working_sheet(_final(s, d), R.GROUPS)


@query("ref_C18_summary_by_number", "WITH n AS (SELECT DISTINCT coalesce(nullif(trim(detected_district), ''), '—') AS name FROM final_filtered), b AS (SELECT name, row_number() OVER (ORDER BY name) AS no FROM n) SELECT printf('%02d', no) || ' ' || name AS book, name, count(*) AS n FROM b JOIN final_filtered f ON coalesce(nullif(trim(f.detected_district), ''), '—') = name GROUP BY ALL")
def _(s, d):
    return files.books(_final(s, d), "detected_district").groupBy("book").agg(F.count("*").alias("n")).select("book", report.plain_name(F.col("book")).alias("name"), "n").orderBy("book")


@query("ref_K9_K10_json_export", "SELECT osm_id, tags['name'] AS name, coalesce(lat, center.lat) AS lat FROM osm_places")
def _(s, d):
    path = work_folder(s, "json")
    files.write_as(R._tagged(s, d), path, "json", ("osm_id", "name", "lat"))
    return s.read.schema("osm_id long, name string, lat double").json(path)


@query("ref_S13_union_of_sheets", "SELECT sheet, count(*) AS n, count(title) AS titles, count(kind) AS kinds FROM (SELECT 0 AS sheet, title, NULL AS kind FROM final_filtered UNION ALL SELECT 1, name, kind FROM (SELECT tags['name'] AS name, elem_type AS kind FROM osm_places)) GROUP BY 1")
def _(s, d):
    sheets = [_final(s, d).select(F.coalesce("detected_district", F.lit("—")).alias("Район"), "title"), table(s, d, "osm_places").select(F.lit("—").alias("Район"), F.try_element_at("tags", F.lit("name")).alias("title"), F.col("elem_type").alias("kind"))]
    return files.union_sheets(sheets, "Район").groupBy("sheet").agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.count("kind").alias("kinds"))


# geometry, order, sets, streams


@query("ref_J2_ambiguous_district", f"WITH {R.INSIDE} SELECT f.final_id AS id, i.region, CASE WHEN coalesce(f.latitude, 0) = 0 OR coalesce(f.longitude, 0) = 0 THEN 'NO_COORDINATES' WHEN i.region IS NULL THEN 'OUTSIDE' WHEN i.region % 2 = 0 THEN 'AMBIGUOUS' ELSE 'EXACT' END AS quality FROM final_filtered f LEFT JOIN inside i ON i.id = f.final_id")
def _(s, d):
    real = table(s, d, "districts")
    twice = real.unionByName(real.filter("district_id % 2 = 0").withColumn("district_id", F.col("district_id") + 100))  # every second region is claimed twice
    return geometry.best_region(_final(s, d), "final_id", twice).select("id", F.col("region").cast("int"), "quality")


@query("ref_A24_A25_grid_claims", f"WITH {R.RINGS}, box AS (SELECT min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM edges), g AS (SELECT x0 + i * 0.004 AS lon, y0 + j * 0.004 AS lat, i, j FROM box, generate_series(0, CAST(floor((x1 - x0) / 0.004) AS BIGINT)) a(i), generate_series(0, CAST(floor((y1 - y0) / 0.004) AS BIGINT)) b(j)), h AS (SELECT i, j, e.region FROM g JOIN edges e ON (e.ay > g.lat) <> (e.by_ > g.lat) AND g.lon < (e.bx - e.ax) * (g.lat - e.ay) / (e.by_ - e.ay) + e.ax GROUP BY ALL HAVING count(*) % 2 = 1), c AS (SELECT i, j, count(*) AS claims FROM h GROUP BY ALL) SELECT claims, count(*) AS cells FROM c GROUP BY 1")
def _(s, d):
    return geometry.grid_claims(table(s, d, "districts"), 0.004)


@query("ref_A24_pair_overlaps", "SELECT CAST(district_id AS BIGINT) AS region_a, CAST(district_id + 100 AS BIGINT) AS region_b FROM districts WHERE district_id % 2 = 0")
def _(s, d):
    real = table(s, d, "districts")
    twice = real.unionByName(real.filter("district_id % 2 = 0").withColumn("district_id", F.col("district_id") + 100))
    return geometry.pair_overlaps(twice, 0.004).select("region_a", "region_b")


@query("ref_A26_areas", f"WITH {R.RINGS.replace('ring AS (SELECT region, unnest(poly) AS pts, generate_subscripts(poly, 1) AS part FROM rings)', 'ring AS (SELECT region, unnest(poly) AS pts, generate_subscripts(poly, 1) AS part FROM rings)')}, e AS (SELECT * FROM edges WHERE ax <> bx OR ay <> by_), r AS (SELECT region, rid, part, abs(sum(ax * by_ - bx * ay)) / 2 AS deg2, avg(ay) AS lat FROM e GROUP BY ALL) SELECT region, CAST(floor(sum(CASE WHEN part = 1 THEN 1 ELSE -1 END * deg2 * 111.32 * 111.32 * cos(radians(lat))) * 10000 + 0.5) AS BIGINT) AS m2_e2 FROM r GROUP BY 1")
def _(s, d):
    return geometry.areas(table(s, d, "districts")).select("region", F.floor(F.col("km2") * 10000 + 0.5).alias("m2_e2"))


@query("ref_O3_O7_report_order", f"SELECT row_number() OVER (ORDER BY encode(detected_district) NULLS LAST, rank, encode(categories) NULLS LAST, encode(title) NULLS LAST, final_id) AS no, final_id FROM (SELECT *, coalesce(list_min(list_transform({R._PARTS}, lambda x: {R._RANK})), 99) AS rank FROM (SELECT * FROM final_filtered))")
def _(s, d):
    rows = report.ordered_rows(_final(s, d), "detected_district", "detected_category_group", "categories", "title", R.GROUPS, "final_id")
    return rows.select("no", "final_id")


@query("ref_O8_sheet_order", "SELECT row_number() OVER (ORDER BY CASE WHEN name = 'СВОДКА' THEN 0 WHEN name = 'ВСЕ' THEN 1 ELSE 2 END, encode(name)) AS no, name FROM (SELECT DISTINCT coalesce(nullif(trim(detected_district), ''), '—') AS name FROM final_filtered UNION SELECT 'СВОДКА' UNION SELECT 'ВСЕ')")
def _(s, d):
    names = _final(s, d).select(F.coalesce(T.filled(F.trim("detected_district")), F.lit("—")).alias("name"))
    return report.sheet_order(names, ("СВОДКА", "ВСЕ"))


_GROUP_COLUMNS = {f"g{i}": g for i, g in enumerate(R.GROUPS, 1)}


@query("ref_A14_group_summary", f"WITH x AS (SELECT coalesce(nullif(trim(detected_district), ''), '—') AS district, {R._PARTS} AS g FROM final_filtered), y AS (SELECT district, g FROM x UNION ALL SELECT 'ИТОГО', g FROM x) SELECT district, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE list_contains(g, '{g}')) AS {a}" for a, g in _GROUP_COLUMNS.items()) + " FROM y GROUP BY 1")
def _(s, d):
    rows = report.summary(report.decorate(_final(s, d)), "detected_district", "detected_category_group", names=_GROUP_COLUMNS)
    return rows.select("district", "total", *_GROUP_COLUMNS)


@query("ref_U2_external_rows", "SELECT 'own' AS origin, count(*) AS n FROM final_filtered UNION ALL SELECT 'map', count(*) FROM osm_places")
def _(s, d):
    ext = R._tagged(s, d).select(F.concat(F.lit("osm:"), F.col("osm_id").cast("string")).alias("place_id"), F.col("name").alias("title"))
    once = merge.with_external(_final(s, d).select("place_id", "title", F.lit("own").alias("origin")), ext, "place_id", "map")
    return merge.with_external(once, ext, "place_id", "map").groupBy("origin").agg(F.count("*").alias("n"))  # running again adds nothing


@query("ref_T1_T8_streamed_merge", f"SELECT key, {', '.join(f'arg_min({f}, raw_id) FILTER (WHERE coalesce(CAST({f} AS VARCHAR), {chr(39) * 2}) <> {chr(39) * 2}) AS {f}' for f in ('title', 'phone', 'email'))}, count(*) AS n_rows FROM (SELECT *, {R.KEY} AS key FROM raw_places) WHERE key IS NOT NULL GROUP BY 1")
def _(s, d):
    folder = work_folder(s, "stream")
    raw = _raw(s, d)
    raw.repartition(4, "raw_id").write.parquet(f"{folder}/in")
    ingest.merge_stream(ingest.read_stream(s, f"{folder}/in", raw, 1), f"{folder}/state", ("title", "phone", "email"), "raw_id", f"{folder}/mark", 8).awaitTermination()
    return ingest.merged_state(s, f"{folder}/state", None, ("title", "phone", "email")).select("key", "title", "phone", "email", "n_rows")


@query("ref_T2_first_seen", "SELECT DISTINCT user_id FROM events")
def _(s, d):
    folder = work_folder(s, "seen")
    ev = table(s, d, "events")
    stream = s.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    seen = ingest.first_seen(stream, "user_id", "ts", "3650 days").select("user_id")
    seen.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out")


def queries():
    return {k: fn for k, (fn, _) in Q.items()}


def oracle_sql():
    from placeloom.plans import general

    out = {k: sql for k, (_, sql) in Q.items() if sql}
    out["ref_S8_state_view"] = f"SELECT payload_id, place_pos, place_id, title FROM ({general.oracle_sql()['p4_places']})"
    out["ref_S6_S7_P9_X1_entities"] = f"SELECT payload_id, place_id, title, lat, lon, address FROM ({general.oracle_sql()['p4_places']}) QUALIFY row_number() OVER (PARTITION BY payload_id, place_id ORDER BY place_pos) = 1"
    return out

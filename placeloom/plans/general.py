"""Queries of the general training-data operators (problems 2, 4 and 7)."""

from __future__ import annotations

from placeloom.operators import nesting, packed, proximity
from placeloom.plans import reference
from placeloom.plans.tables import table


def queries():
    return {
        "p2_found": lambda s, d: proximity.near_and_inside(table(s, d, "final_filtered"), table(s, d, "districts")),
        "p4_found": lambda s, d: nesting.run_rows(table(s, d, "search_payloads")),
        "p4_payloads": lambda s, d: nesting.payload_rows(table(s, d, "search_payloads")),
        "p4_places": lambda s, d: nesting.flatten_payloads(table(s, d, "search_payloads"), "places"),
        "p4_records": lambda s, d: nesting.flatten_payloads(table(s, d, "search_payloads"), "records"),
        "p4_runs": lambda s, d: nesting.flatten_payloads(table(s, d, "search_payloads"), "runs"),
        "p4_hits": lambda s, d: nesting.flatten_payloads(table(s, d, "search_payloads"), "hits"),
        "p7_found": lambda s, d: packed.split_values(table(s, d, "final_filtered"), "final_id", ("categories", "detected_category_group", "phone")),
    }


# places of each payload with their source records as a JSON array; walks the document as a tree of nodes
_PLACES = """ok AS (SELECT payload_id, CAST(payload AS JSON) AS j FROM search_payloads WHERE json_valid(payload)),
 nodes AS (SELECT payload_id, t.id AS node_at, t.value AS v FROM ok, json_tree(ok.j) t WHERE t.type = 'OBJECT'),
 place AS (SELECT payload_id, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY node_at) AS INTEGER) AS place_pos, v, v->>'$.id' AS place_id, coalesce(v->'$.source_records', v->'$.provenance.source_records') AS s FROM nodes
  WHERE json_type(v, '$.id') IN ('VARCHAR', 'UBIGINT', 'BIGINT') AND regexp_full_match(v->>'$.id', '[0-9]{5,}') AND json_type(v, '$.title') = 'VARCHAR' AND regexp_matches(v->>'$.title', '[\\p{L}\\p{N}]')
   AND json_type(v, '$.coordinates') = 'ARRAY' AND json_array_length(v, '$.coordinates') >= 2),
 txt AS (SELECT *, CASE json_type(s) WHEN 'VARCHAR' THEN TRY_CAST(s->>'$' AS JSON) ELSE s END AS r FROM place),
 arr AS (SELECT payload_id, place_id, place_pos, CASE json_type(r) WHEN 'ARRAY' THEN CAST(r AS JSON[]) WHEN 'OBJECT' THEN [r] ELSE [] END AS recs FROM txt),
 rec AS (SELECT payload_id, place_id, place_pos, unnest(recs) AS rec, CAST(generate_subscripts(recs, 1) AS INTEGER) AS rec_pos FROM arr),
 run AS (SELECT payload_id, place_id, place_pos, rec_pos, rec->>'$.query' AS query, coalesce(rec->>'$.query', '') AS query_text, CASE WHEN json_type(rec, '$.runs') = 'ARRAY' AND json_array_length(rec, '$.runs') > 0 THEN CAST(rec->'$.runs' AS JSON[]) ELSE [NULL] END AS runs FROM rec),
 each AS (SELECT payload_id, place_id, place_pos, rec_pos, query, query_text, unnest(runs) AS x, generate_subscripts(runs, 1) AS i FROM run),
 runs AS (SELECT payload_id, place_id, place_pos, rec_pos, query, query_text, x, CAST(CASE WHEN x IS NULL THEN 0 ELSE i END AS INTEGER) AS run_pos FROM each)"""


# pieces of a cell: quoted spans and what no separator cuts, an extension going on with the number before it
_SPACE = reference.WS
_NUMBER_OF = "\\(?\\s*(?:доб(?:авочный|\\.)?|вн(?:утр|\\.)?|ext(?:ension|\\.)?|#)[\\s.:№]*[0-9]"
_PIECE = f'(?i)(?:"(?:[^"]|"")*"|«(?:[^»]|»»)*»|“(?:[^”]|””)*”|„(?:[^“”]|““|””)*[“”]|[,;|/\n\r]\\s*{_NUMBER_OF}|[^,;|/\n\r])+'
_BARE = lambda v: f"regexp_replace({v}, '^{_SPACE}|{_SPACE}$', '', 'g')"
_UNQUOTED = " ".join(f"WHEN regexp_full_match(v, '{a}(?:[^{b}]|{b}{b})*{b}') THEN {_BARE(f"replace(v[2:-2], '{b}{b}', '{b}')")}" for a, b in ('""', "«»", "“”"))
_VALUES = " UNION ALL ".join(
    f"SELECT final_id, '{f}' AS field_name, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM (SELECT final_id, list_filter(list_transform(regexp_extract_all({f}, '{_PIECE}'), lambda x: {_BARE('x')}), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS p FROM final_filtered)"
    for f in ("categories", "detected_category_group", "phone")
)


def oracle_sql():
    return {
        "p7_found": f"SELECT final_id, field_name, CAST(i AS INTEGER) AS pos, CASE {_UNQUOTED} ELSE v END AS item_value FROM ({_VALUES})",
        "p2_found": f"WITH {reference.NEAR}, {reference.INSIDE.replace('WITH ', '')} SELECT 'near' AS kind, id_a, id_b FROM near WHERE metres <= 40 UNION ALL SELECT 'inside', id, region FROM inside",
        "p4_found": f"WITH {_PLACES} SELECT payload_id, place_id, rec_pos, run_pos, query_text FROM runs",
        "p4_payloads": f"WITH {_PLACES}, n AS (SELECT payload_id, count(*) AS n FROM place GROUP BY 1) SELECT p.payload_id, coalesce(json_valid(p.payload), false) AS readable, CAST(coalesce(n.n, 0) AS INTEGER) AS n_places FROM search_payloads p LEFT JOIN n USING (payload_id)",
        "p4_places": f"WITH {_PLACES} SELECT payload_id, place_pos, place_id, v->>'$.title' AS title, CAST(v->>'$.coordinates[1]' AS DOUBLE) AS lat, CAST(v->>'$.coordinates[0]' AS DOUBLE) AS lon, v->>'$.address' AS address FROM place",
        "p4_records": f"WITH {_PLACES} SELECT payload_id, place_pos, place_id, rec_pos, rec->>'$.district' AS district, rec->>'$.group' AS group_name, rec->>'$.category' AS category, rec->>'$.query' AS query_text FROM rec",
        "p4_runs": f"WITH {_PLACES} SELECT payload_id, place_pos, place_id, rec_pos, run_pos, TRY_CAST(x->>'$.at' AS BIGINT) AS run_at, query AS query_text FROM runs",
        "p4_hits": f"WITH {_PLACES}, h AS (SELECT *, CAST(x->'$.hits' AS JSON[]) AS hs FROM runs WHERE json_type(x, '$.hits') = 'ARRAY'), hit AS (SELECT payload_id, place_pos, place_id, rec_pos, run_pos, unnest(hs) AS hit, CAST(generate_subscripts(hs, 1) AS INTEGER) AS hit_pos FROM h) SELECT payload_id, place_pos, place_id, rec_pos, run_pos, hit_pos, TRY_CAST(hit->>'$.page' AS BIGINT) AS page, TRY_CAST(hit->>'$.rank' AS BIGINT) AS hit_rank FROM hit",
    }

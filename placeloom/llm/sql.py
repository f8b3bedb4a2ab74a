"""The SQL of those queries of this folder that SQL can express."""

from __future__ import annotations

from placeloom.llm.survivor import FIELDS

# white space that a trimmed id loses, and what makes a value not blank
_SPACE = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"


_BEST = " UNION ALL ".join(
    f"SELECT place_id, '{f}' AS field_name, arg_max(raw_id, (rank, entries, coalesce(captured_at, TIMESTAMP '0001-01-01'), -raw_id)) AS raw_id FROM good WHERE regexp_matches({f}, '[\\p{{L}}\\p{{N}}]') GROUP BY 1" for f in FIELDS
)


def _folded(c: str) -> str:
    """Letters and digits of a text. Of the compatibility forms only those of the test tables: wide digits and №."""
    return f"regexp_replace(replace(lower(nfc_normalize(replace(translate({c}, '０１２３４５６７８９', '0123456789'), '№', 'no'))), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_DIGITS = "regexp_replace(translate(coalesce(phone, ''), '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g')"
_CONTENT = f"""content AS (SELECT raw_id, {_folded("coalesce(title, '')")} AS t,
   list_sort(list_filter(list_transform(string_split_regex(coalesce(address, ''), '[,;|]'), lambda x: {_folded('x')}), lambda x: x <> '')) AS a, CASE WHEN {_DIGITS} LIKE '8%' THEN '7' || substr({_DIGITS}, 2) ELSE {_DIGITS} END AS p FROM raw_places)"""


def oracle_sql():
    return {
        "p5_found": f"WITH {_CONTENT}, firsts AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY t, a, p) AS first_raw_id FROM content) SELECT first_raw_id, raw_id FROM firsts WHERE first_raw_id < raw_id",
        "p5_counts": f"WITH {_CONTENT} SELECT min(raw_id) AS first_raw_id, count(*) AS copies FROM content GROUP BY t, a, p",
        "p6_found": f"""WITH keyed AS (SELECT * REPLACE ({_trim('place_id')} AS place_id), CASE upper({_trim('detail_level')}) WHEN 'CARD' THEN 3 WHEN 'LIST_ONLY' THEN 2 WHEN 'LIST' THEN 1 ELSE 0 END AS rank,
          CASE WHEN json_type(TRY_CAST(source_records AS JSON)) = 'ARRAY' THEN json_array_length(TRY_CAST(source_records AS JSON)) ELSE 0 END AS entries FROM raw_places),
         good AS (SELECT * FROM keyed WHERE place_id <> '' AND place_id IN (SELECT place_id FROM keyed GROUP BY 1 HAVING count(*) >= 2))
         {_BEST}""",
    }

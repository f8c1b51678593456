"""SQL that gives the same rows as the queries, written for DuckDB over the same tables."""

import sys
import unicodedata

from .lookalike import LOOK_ALIKES, SEEN

_SKIP = r"[\s\x0b\x1c-\x1f\x85\p{Z}\p{P}$+<=>^`|~]+"
_BREAK = r"[\t-\r !-/:-@\[-`{-~]+"

#: What only says that there is no value, once layout is disregarded.
_FILLERS = (
    "'', 'blank', 'empty', 'missing', 'na', 'nan', 'nil', 'nodata', 'novalue', 'none', 'notavailable', 'notgiven', "
    "'notknown', 'notprovided', 'notspecified', 'null', 'tba', 'tbc', 'tbd', 'undefined', 'unknown', 'unspecified'"
)


def _folded(column: str) -> str:
    return f"regexp_replace(lower({column}), '{_SKIP}', '', 'g')"


def _gone(column: str) -> str:
    return f"({column} IS NULL OR {_folded(column)} IN ({_FILLERS}))"


_LAYOUT = f"""
WITH folded AS (
  SELECT row_id, population, {_folded('city')} AS a, {_folded('country')} AS b
  FROM demo_city WHERE population > 0 AND NOT {_gone('city')} AND NOT {_gone('country')}
), sets AS (
  SELECT row_id, min(row_id) OVER (PARTITION BY population, least(a, b), greatest(a, b)) AS first_row_id FROM folded
)"""

_TERMS = f"""
WITH pieces AS (
  SELECT 'city' AS field_name, row_id, unnest(regexp_split_to_array(city, '{_BREAK}')) AS piece FROM demo_city WHERE city IS NOT NULL
  UNION ALL
  SELECT 'country', row_id, unnest(regexp_split_to_array(country, '{_BREAK}')) FROM demo_city WHERE country IS NOT NULL
), counted AS (
  SELECT field_name, lower(piece) AS term, count(*) AS occurrences, count(DISTINCT row_id) AS records
  FROM pieces WHERE piece <> '' GROUP BY ALL
), present AS (
  SELECT 'city' AS field_name, count(city) AS n FROM demo_city UNION ALL SELECT 'country', count(country) FROM demo_city
), marked AS (
  SELECT field_name, term, occurrences, records,
         CASE WHEN occurrences <= 2 THEN 'rare' WHEN records > 0.03 * n THEN 'common' END AS mark
  FROM counted JOIN present USING (field_name)
)"""

_SURVIVORS = f"""
WITH rows AS (
  SELECT d.*, coalesce(f.trust_rank, 2147483647) AS trust, row_number() OVER (
           PARTITION BY entry_no ORDER BY coalesce(f.trust_rank, 2147483647), recorded_at DESC NULLS LAST, row_id) AS best
  FROM demo_city d LEFT JOIN feeds f USING (feed)
), fields AS (
  SELECT entry_no, count(*) AS n_rows,
         arg_min(row_id, best) FILTER (NOT {_gone('city')}) AS city_row_id,
         arg_min(city, best) FILTER (NOT {_gone('city')}) AS city,
         arg_min(row_id, best) FILTER (NOT {_gone('country')}) AS country_row_id,
         arg_min(country, best) FILTER (NOT {_gone('country')}) AS country,
         arg_min(row_id, best) FILTER (population > 0) AS population_row_id,
         arg_min(population, best) FILTER (population > 0) AS population
  FROM rows WHERE entry_no IS NOT NULL GROUP BY entry_no HAVING count(*) > 1
)"""


def _values(pairs: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs.items())


def _character_forms() -> dict[str, str]:
    """What each character outside ASCII becomes: nothing, a space or its compatibility form."""
    out = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        name, seen = unicodedata.name(c, ""), any(lo <= ord(c) <= hi for lo, hi in SEEN)
        if unicodedata.category(c) == "Cf" and not seen or "FILLER" in name or name.startswith(("VARIATION SELECTOR", "MONGOLIAN FREE", "COMBINING GRAPHEME", "KHMER VOWEL INHERENT")):
            out[c] = ""
        elif c.isspace() and unicodedata.category(c)[0] == "Z":
            out[c] = " "
        elif unicodedata.category(c) not in ("Cn", "Co", "Cs") and unicodedata.normalize("NFKC", c) != c:
            out[c] = unicodedata.normalize("NFKC", c)
    return out


def _look_forms() -> dict[str, str]:
    """Look-alikes and, for letters with marks, the twin with the same marks."""
    twin = {a: b for one, other in LOOK_ALIKES for a, b in zip(one, other, strict=True)}
    marked = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        parts = unicodedata.normalize("NFD", c)
        if parts != c and parts[0] in twin:
            marked[c] = unicodedata.normalize("NFC", twin[parts[0]] + parts[1:])
    return marked | twin


def _by_character(source: str, table: str) -> str:
    """SQL of (v, s, t): t is s with each of its characters looked up in a table."""
    return f"""SELECT v, s, nfc_normalize(coalesce(string_agg(coalesce(f, c), '' ORDER BY p), '')) AS t
FROM (SELECT v, s, p, string_split(s, '')[p] AS c FROM {source}, unnest(range(1, length(s) + 1)) AS x(p)) LEFT JOIN {table} USING (c) GROUP BY v, s"""


def _letters(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


_PLAIN = "regexp_replace(lower({}), '[\\t-\\r \\p{{P}}$+<=>^`|~]+', '', 'g')"

_LOOK_ALIKES = f"""
WITH forms(c, f) AS (VALUES {_values(_character_forms())}), looks(c, f) AS (VALUES {_values(_look_forms())}),
texts AS (SELECT DISTINCT v, nfc_normalize(v) AS s FROM (SELECT city AS v FROM demo_city UNION ALL SELECT city FROM ref_places) WHERE v <> ''),
formed AS ({_by_character('texts', 'forms')}),
readings AS (SELECT v, t AS s FROM formed UNION SELECT v, translate(t, 'νΝ', 'nV') FROM formed),
looked AS ({_by_character('readings', 'looks')}),
keys AS (SELECT DISTINCT v, {_folded('t')} AS key, {_PLAIN.format('v')} AS plain FROM looked WHERE {_folded('t')} <> ''),
places AS (SELECT p.place_id, p.country, c.code, k.key, k.plain FROM ref_places p LEFT JOIN ref_countries c USING (country_id)
           JOIN keys k ON k.v = p.city AND k.key = (SELECT min({_folded('t')}) FROM looked l WHERE l.v = p.city AND l.s = (SELECT t FROM formed f WHERE f.v = p.city))),
cases AS (SELECT d.row_id, d.country, p.place_id, p.country AS land, p.code, p.key FROM demo_city d JOIN keys k ON k.v = d.city JOIN places p ON p.key = k.key
          WHERE NOT EXISTS (SELECT 1 FROM places q WHERE q.key = k.key AND q.plain = k.plain))
SELECT DISTINCT row_id, arg_min(place_id, [CASE WHEN {_letters('country')} = {_letters('code')} THEN -1
         ELSE levenshtein({_letters('country')}, {_letters('land')}) END, place_id]) AS place_id
FROM cases GROUP BY row_id, key"""

_FORMED = f"""
WITH forms(c, f) AS (VALUES {_values(_character_forms())}), looks(c, f) AS (VALUES {_values(_look_forms())}),
texts AS (SELECT DISTINCT city AS v, nfc_normalize(city) AS s FROM demo_city WHERE city <> ''),
formed AS ({_by_character('texts', 'forms')}),
base AS (SELECT v, t AS s FROM formed WHERE t <> ''),
looked AS ({_by_character('base', 'looks')}),
rows AS (SELECT row_id, city, CASE WHEN city IS NOT NULL THEN coalesce(t, '') END AS form FROM demo_city LEFT JOIN looked ON v = city)
SELECT row_id, city, form, {_folded('form')} AS key FROM rows"""

_TOKENS = "list_concat(string_split({0}, ''), list_transform(range(0, length({0}) + 1), lambda i: substring(concat('^', {0}, '$'), i + 1, 2)))"
_CLOSEST = f"""
WITH v AS (SELECT DISTINCT lower(regexp_replace(city, '[^A-Za-z]', '', 'g')) AS value FROM demo_city),
e AS (SELECT place_id, lower(regexp_replace(city, '[^A-Za-z]', '', 'g')) AS text FROM ref_places),
pairs AS (SELECT *, greatest(length(value), length(text)) AS n, damerau_levenshtein(value, text) AS d FROM v JOIN e ON value <> '' AND text <> ''
          AND abs(length(value) - length(text)) <= 0.3 * greatest(length(value), length(text)) + 1e-9),
near AS (SELECT *, {_TOKENS.format('value')} AS a, {_TOKENS.format('text')} AS b FROM pairs WHERE d <= CASE WHEN n >= 4 THEN floor(0.3 * n + 1e-9) ELSE 0 END),
shared AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(length(list_filter(a, lambda y: y = x)), length(list_filter(b, lambda y: y = x))))) AS common FROM near),
scored AS (SELECT *, common / (length(a) + length(b) - common)::DOUBLE AS jaccard FROM shared)
SELECT value, place_id AS ref_id, round(jaccard, 6) AS jaccard, round(1 - d / n::DOUBLE, 6) AS share FROM scored WHERE jaccard >= 0.5 - 1e-9
QUALIFY row_number() OVER (PARTITION BY value ORDER BY 1 - d / n::DOUBLE DESC, jaccard DESC, place_id) = 1"""

ORACLE = {
    "p3_found": _LOOK_ALIKES,
    "p3_forms": _FORMED,
    "p1_found": _LAYOUT + " SELECT first_row_id, row_id AS copy_row_id FROM sets WHERE row_id <> first_row_id",
    "p1_records": _LAYOUT
    + """, counts AS (SELECT first_row_id, count(*) AS n FROM sets GROUP BY 1)
SELECT d.row_id, d.city, d.country, d.population, coalesce(c.n, 1) AS n_rows
FROM demo_city d LEFT JOIN counts c ON c.first_row_id = d.row_id
WHERE d.population > 0 AND d.row_id NOT IN (SELECT row_id FROM sets WHERE row_id <> first_row_id)""",
    "p2_found": _TERMS + " SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_found": """
WITH rows AS (
  SELECT country, batch_no, population FROM demo_city
  WHERE population > 0 AND country IN (SELECT country FROM ref_countries)
), whole AS (SELECT country, median(population) AS m FROM rows GROUP BY 1),
parts AS (SELECT country, batch_no, median(population) AS m FROM rows WHERE batch_no IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT p.country, p.batch_no FROM parts p JOIN whole w USING (country) WHERE p.m > 8 * w.m OR p.m < w.m / 8.0""",
    "p4_percentiles": """
WITH groups AS (
  SELECT country, list_sort(list(population)) AS v, count(*) AS n FROM demo_city
  WHERE population > 0 AND country IN (SELECT country FROM ref_countries) GROUP BY 1
)
SELECT country, n, q, v[floor(q * (n - 1) + 1e-9)::BIGINT + 1]::DOUBLE AS exact, true AS holds
FROM groups, unnest([0.01::DOUBLE, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]) AS t(q)""",
    "p5_found": _SURVIVORS
    + """ SELECT entry_no, city_row_id, country_row_id, population_row_id FROM fields
WHERE city_row_id IS NOT NULL AND country_row_id IS NOT NULL AND population_row_id IS NOT NULL""",
    "p5_records": _SURVIVORS + " SELECT entry_no, n_rows, city, country, population FROM fields",
    "p6_closest": _CLOSEST,
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 8192",
    "p7_totals": """
SELECT count(*) AS documents, sum(greatest(1, ceil(strlen(text) / 8192.0)))::BIGINT AS pieces, sum(strlen(text))::BIGINT AS tokens,
       0::BIGINT AS overfull, false AS wasteful FROM documents WHERE text IS NOT NULL""",
    "p8_found": """
WITH texts AS (
  SELECT doc_id, NULL AS item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT NULL, item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') FROM eval_items
), runs AS (
  SELECT doc_id, item_id, hash(array_to_string(w[i : i + 12], ' ')) AS run FROM texts, unnest(range(1, greatest(len(w) - 11, 1))) AS t(i)
)
SELECT DISTINCT d.doc_id, e.item_id FROM runs d JOIN runs e USING (run) WHERE d.doc_id IS NOT NULL AND e.item_id IS NOT NULL""",
    "p8_verbatim": """
WITH texts AS (
  SELECT doc_id, NULL AS item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT NULL, item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') FROM eval_items
), runs AS (
  SELECT doc_id, item_id, i - 1 AS place, hash(array_to_string(w[i : i + 12], ' ')) AS run FROM texts, unnest(range(1, greatest(len(w) - 11, 1))) AS t(i)
), met AS (
  SELECT d.doc_id, e.item_id, d.place, d.place - e.place AS diagonal FROM runs d JOIN runs e USING (run) WHERE d.doc_id IS NOT NULL AND e.item_id IS NOT NULL
), islands AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY place) AS island FROM met
), long AS (
  SELECT doc_id, item_id, count(*) + 12 AS words, min(place) AS first_word FROM islands GROUP BY doc_id, item_id, diagonal, island
)
SELECT doc_id, item_id, words::INTEGER AS words, first_word FROM long
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, first_word) = 1""",
    "p2_terms": _TERMS + " SELECT field_name, term, occurrences, records, mark FROM marked",
}

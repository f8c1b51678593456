"""SQL that gives the same rows as the queries of the catalogue, written for DuckDB over the same tables."""

from __future__ import annotations

import re
import string

_PUNCT = "'" + string.punctuation.replace("'", "''") + "'"
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
# Letters without a decomposition and how they are written in ASCII.
_WRITTEN = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("Æ", "AE"), ("Œ", "OE"), ("Þ", "TH")]
_WRITTEN_AS_ONE = ("øØłŁđĐðÐıħĦ", "oOlLdDdDihH")
# Compatibility forms that the tables hold, besides full-width ones and spaces.
_SEVERAL = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("…", "...")]
_SINGLE = ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿϲſℓ", "IVXLCDMivxlcdmςsl")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _accents(x: str) -> str:
    """SQL of a text without accents, by DuckDB's own function; compatibility forms are written out before."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    spaces = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
    for a, b in _SEVERAL:
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents(translate({x}, {_quote(wide + _SINGLE[0] + spaces)}, {_quote(plain + _SINGLE[1] + ' ' * len(spaces))}))"


def _fingerprint(x: str) -> str:
    """SQL of the fingerprint of an expression."""
    plain = f"translate(lower(regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')), {_PUNCT}, '')"
    once = "array_to_string(list_filter(cs, lambda c, i: list_position(cs, c) = i), '')"
    latin = f"translate({_accents('f')}, '{_WRITTEN_AS_ONE[0]}', '{_WRITTEN_AS_ONE[1]}')"
    for a, b in _WRITTEN:
        latin = f"replace({latin}, '{a}', '{b}')"
    return f"(SELECT CASE WHEN regexp_full_match(f, '[\\x00-\\x7F]*') THEN f ELSE {latin} END FROM (SELECT {once} AS f FROM (SELECT string_split({plain}, '') AS cs)))"


_PART = "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat('  ', upper(p_name), '!') ELSE p_name END AS p_name, p_brand, p_size FROM part"
_CUSTOMER = """SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 11 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer"""
_MIXED = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN event_type END AS mixed FROM events"


def _clusters(source: str, column: str, key: str) -> str:
    """CTEs ending in clusters (key, value, n, canonical, canonical_n, total)."""
    return f"""
WITH rows AS ({source}),
counts AS (SELECT {column} AS value, count(*) AS n, min({key}) AS first FROM rows WHERE {column} IS NOT NULL GROUP BY 1),
keyed AS (SELECT *, {_fingerprint('value')} AS key FROM counts),
ranked AS (SELECT *, first_value(value) OVER w AS canonical, first_value(n) OVER w AS canonical_n,
             sum(n) OVER (PARTITION BY key)::BIGINT AS total, count(*) OVER (PARTITION BY key) AS variants
           FROM keyed WINDOW w AS (PARTITION BY key ORDER BY n DESC, first)),
clusters AS (SELECT key, value, n, canonical, canonical_n, total FROM ranked WHERE variants > 1)"""


_CLUSTER_COLUMNS = "SELECT key, value, n, canonical, canonical_n, total FROM clusters"


def _resolved(source: str, column: str, key: str) -> str:
    return _clusters(source, column, key) + (
        f" SELECT r.{key}, coalesce(c.canonical, r.{column}) AS {column} FROM rows r LEFT JOIN clusters c ON c.value = r.{column}"
    )


def _matching(source: str, keys: list[str], fixes: list[str], row_id: str, shown: str) -> str:
    """CTEs ending in fixes (key, column, canonical, canonical_n, total), the key as a list."""
    key = "[" + ", ".join(_fingerprint(k) for k in keys) + "]"
    filled = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    cells = " UNION ALL ".join(f"SELECT key, '{c}' AS \"column\", {c}::VARCHAR AS value, {row_id} AS id FROM keyed" for c in fixes)
    return f"""
WITH rows AS ({source}), keyed AS (SELECT *, {key} AS key FROM rows WHERE {filled}), cells AS ({cells}),
counts AS (SELECT key, "column", value, count(*) AS n, min(id) AS first FROM cells GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, "column" ORDER BY n DESC, first) AS rk, sum(n) OVER (PARTITION BY key, "column")::BIGINT AS total FROM counts),
fixes AS (SELECT key, "column", value AS canonical, n AS canonical_n, total FROM ranked WHERE rk = 1 AND n < total)""" + shown


def _blocks(measure: str, rows: str = "part", column: str = "p_name", row_id: str = "p_partkey", size: int = 6, least: float = 0.6) -> str:
    """CTEs ending in pairs of values that share a block and are more alike than ``least``."""
    return f"""
WITH counts AS (SELECT {column} AS value, count(*) AS n, min({row_id}) AS first FROM {rows} WHERE {column} IS NOT NULL GROUP BY 1),
keyed AS (SELECT *, {_fingerprint('value')} AS key FROM counts),
blocks AS (SELECT DISTINCT value, n, first, unnest(CASE WHEN length(key) > {size}
             THEN list_transform(range(0, length(key) // {size}), lambda i: substring(key, i * {size} + 1, {size})) ELSE [key] END) AS block FROM keyed),
near AS (SELECT DISTINCT a.value AS l, b.value AS r, a.n AS nl, b.n AS nr, a.first AS fl, b.first AS fr
         FROM blocks a JOIN blocks b ON a.block = b.block AND a.value < b.value),
scored AS (SELECT *, string_split(l, '') AS a, string_split(r, '') AS b, greatest(length(l), length(r)) AS size FROM near),
pairs AS (
  SELECT l AS value_l, r AS value_r, round({measure}, 6) AS similarity, CASE WHEN nl > nr OR (nl = nr AND fl < fr) THEN l ELSE r END AS canonical,
         greatest(nl, nr) AS canonical_n, nl + nr AS total FROM scored WHERE {measure} > {least})"""


_DIFFERENT = "(list_sum(list_transform(range(1, size + 1), lambda i: CASE WHEN a[i] IS NOT DISTINCT FROM b[i] THEN 0 ELSE 1 END)))"
_COMMON = "(list_sum(list_transform(list_distinct(a), lambda x: least(length(list_filter(a, lambda y: y = x)), length(list_filter(b, lambda y: y = x))))))"
# rows of bits of the longest common subsequence, one step for each character of the second text
_MASKS = "list_transform(b, lambda y: list_reduce(list_transform(range(0, length(l)), lambda i: CASE WHEN a[i + 1] = y THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END), lambda p, q: p | q))"
_FULL = "((1::HUGEINT << length(l)::HUGEINT) - 1)"
_SUBSEQUENCE = f"(length(l) - bit_count(list_reduce({_MASKS}, lambda row, m: ((row + (row & m)) | (row - (row & m))) & {_FULL}, {_FULL})))"
_SUBSTRING = "list_max(list_transform(range(1, length(l) + 1), lambda i: list_max(list_transform(range(0, length(l) - i + 2), lambda k: CASE WHEN contains(r, substring(l, i, k)) THEN k ELSE 0 END))))"


def _rating(x: str) -> str:
    """SQL of the match-rating code of a text, as a list of letters."""
    kept = f"string_split(concat(upper(substring({x}, 1, 1)), regexp_replace(upper(substring({x}, 2)), '[AEIOU]', '', 'g')), '')"
    squeezed = f"list_filter({kept}, lambda c, i: i = 1 OR ({kept})[i - 1] <> c)"
    return f"CASE WHEN length({squeezed}) > 6 THEN list_concat(({squeezed})[1:3], ({squeezed})[-3:]) ELSE {squeezed} END"


def _rated() -> str:
    """SQL of the match-rating similarity of l and r: letters matched from the left, then from the right."""
    left = lambda o, t: f"list_reverse(list_filter({o}, lambda c, i: {t}[i] IS DISTINCT FROM c))"
    codes = f"SELECT {_rating('l')} AS o, {_rating('r')} AS t"
    once = f"SELECT o, t, {left('o', 't')} AS o1, {left('t', 'o')} AS t1 FROM ({codes})"
    score = f"(greatest(length(o), length(t)) - greatest(length({left('o1', 't1')}), length({left('t1', 'o1')}))) / greatest(length(o), length(t))"
    return f"(SELECT CASE WHEN length(o) + length(t) = 0 THEN 1.0::DOUBLE WHEN abs(length(o) - length(t)) > 2 THEN 0.0::DOUBLE ELSE {score} END FROM ({once}))"


_MEASURES = {
    "lcsseq": f"{_SUBSEQUENCE} / size",
    "lcsstr": f"{_SUBSTRING} / size",
    "mra": _rated(),
    "hamming": f"1 - {_DIFFERENT} / size",
    "mlipns": f"CASE WHEN {_DIFFERENT} <= 0.25 * size OR {_DIFFERENT} - 1 <= 0.25 * (size - 1) OR {_DIFFERENT} - 2 <= 0.25 * (size - 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "levenshtein": "1 - levenshtein(l, r) / size",
    "jaccard": f"{_COMMON} / (length(l) + length(r) - {_COMMON})",
    "overlap": f"{_COMMON} / least(length(l), length(r))",
    "cosine": f"{_COMMON} / sqrt(length(l) * length(r))",
}


def _fd(name: str, source: str, lhs: str, rhs: list[str]) -> str:
    """CTEs <name>_counts (violating left values), <name>_fixes (bad and good values) of one rule."""
    right = ", ".join(rhs)
    order = ", ".join(f"{c} NULLS FIRST" for c in rhs)
    columns = ", ".join([f"first_value({c}) OVER low AS bad_{c}, first_value({c}) OVER high AS good_{c}" for c in rhs])
    return f"""{name}_all AS (SELECT {lhs}, {right}, count(*) AS n FROM {source} WHERE {lhs} IS NOT NULL GROUP BY ALL),
{name}_counts AS (SELECT * FROM {name}_all QUALIFY count(*) OVER (PARTITION BY {lhs}) > 1),
{name}_fixes AS (
  SELECT {lhs}, {columns}, min(n) OVER (PARTITION BY {lhs}) AS lo, max(n) OVER (PARTITION BY {lhs}) AS hi FROM {name}_counts
  WINDOW low AS (PARTITION BY {lhs} ORDER BY n, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
         high AS (PARTITION BY {lhs} ORDER BY n DESC, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  QUALIFY lo < hi AND row_number() OVER (PARTITION BY {lhs}) = 1)"""


_HOSPITAL = "WITH " + _fd("z", "hospital_like", "ZIPCode", ["City", "State"]) + ", " + _fd("p", "hospital_like", "ProviderNumber", ["City", "PhoneNumber"])


def _swap(column: str, alias: str, value: str) -> str:
    return f"CASE WHEN {alias}.lo IS NOT NULL AND {value} IS NOT DISTINCT FROM {alias}.bad_{column} THEN {alias}.good_{column} ELSE {value} END"


_TYPES = {
    "integer": r"regexp_full_match(mixed, '\s*[+-]?\d+\s*')",
    "float": r"regexp_full_match(mixed, '\s*[+-]?\d*\.\d+\s*')",
}
_MONTHS = "12 * (2024 - year(x)) + 3 - month(x)"


def _lookup(*steps: tuple[str, list[str]]) -> str:
    x = "o_orderpriority"
    for name, olds in steps:
        x = f"CASE WHEN {x} IN ({', '.join(map(_quote, olds))}) THEN '{name}' ELSE {x} END"
    return f"SELECT o_orderkey, {x} AS o_orderpriority FROM orders"


def _minmax(c: str, source: str) -> str:
    return f"({c} - (SELECT min({c}) FROM {source})) / ((SELECT max({c}) FROM {source}) - (SELECT min({c}) FROM {source}))::DOUBLE"


_INDEXED = "(SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS place FROM {t} GROUP BY {c})"

ORACLE: dict[str, str] = {
    "select_cols": "SELECT o_custkey, o_orderkey FROM orders",
    "select_idx": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "keep_cols": "SELECT o_orderkey, o_totalprice FROM orders",
    "drop_cols": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "rename_cols": "SELECT s_suppkey, s_name AS supplier, s_nationkey, s_acctbal AS balance FROM supplier",
    "move_col": "SELECT s_suppkey, s_acctbal, s_name, s_nationkey FROM supplier",
    "cast_cols": r"SELECT event_id::VARCHAR AS event_id, try_cast(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k, try_cast(event_type AS DOUBLE) AS event_type FROM events",
    "set_col_expr": "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS l_quantity, l_discount FROM lineitem",
    "set_col_python": "SELECT n_nationkey, lower(reverse(n_name)) AS n_name, n_regionkey FROM nation",
    "split_str_col": "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS second, string_split(p_name, ' ')[3] AS third FROM part",
    "add_primary_key_det": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders",
    "add_primary_key": "SELECT count(*) AS rows, count(*) AS ids FROM orders",
    "add_count": "SELECT *, 7 AS counts FROM nation",
    "sql_this": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS dearest FROM orders GROUP BY o_custkey",
    "columns_by_type": """SELECT * FROM (VALUES ('string', 'l_returnflag'), ('string', 'l_linestatus'), ('integer', 'l_orderkey'),
      ('integer', 'l_partkey'), ('integer', 'l_suppkey'), ('integer', 'l_linenumber'), ('double', 'l_quantity'), ('double', 'l_extendedprice'),
      ('double', 'l_discount'), ('double', 'l_tax'), ('date', 'l_shipdate')) AS t(type, name)""",
    "delete_row": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45",
    "row_filter_by_type_integer": f"SELECT * FROM ({_MIXED}) WHERE mixed IS NULL OR NOT {_TYPES['integer']}",
    "row_filter_by_type_float": f"SELECT * FROM ({_MIXED}) WHERE mixed IS NULL OR NOT {_TYPES['float']}",
    "row_filter_by_type_string": f"SELECT * FROM ({_MIXED}) WHERE mixed IS NULL OR {_TYPES['integer']} OR {_TYPES['float']}",
    "row_filter_by_type_null": f"SELECT * FROM ({_MIXED}) WHERE mixed IS NOT NULL",
    "row_filter_by_type_city": "SELECT row_id, city FROM demo_city WHERE city IS NOT NULL",
    "remove_empty_rows_any": """SELECT * FROM demo_gdp WHERE country IS NOT NULL AND city IS NOT NULL AND population IS NOT NULL
      AND averageGDP IS NOT NULL AND NOT isnan(averageGDP) AND recorded_at IS NOT NULL AND row_id IS NOT NULL""",
    "remove_empty_rows_all": "SELECT city, country, population FROM demo_city WHERE city IS NOT NULL OR country IS NOT NULL OR population IS NOT NULL",
    "replace_na": """SELECT row_id, country, coalesce(city, 'nowhere') AS city, coalesce(population, -1) AS population,
      coalesce(averageGDP, 0.0::DOUBLE) AS averageGDP, recorded_at FROM demo_gdp""",
    "replace_na_number": f"SELECT c_custkey, c_name, c_nationkey, coalesce(c_acctbal, 0.5::DOUBLE) AS c_acctbal, c_mktsegment FROM ({_CUSTOMER})",
    "empty_str_to_str": f"SELECT c_custkey, CASE WHEN c_mktsegment <> '' THEN c_mktsegment ELSE 'none given' END AS c_mktsegment FROM ({_CUSTOMER})",
    "impute_mean": """SELECT row_id, round(coalesce(averageGDP, avg(averageGDP) OVER ()), 4) AS gdp,
      round(coalesce(population, avg(population) OVER ()), 4) AS people FROM demo_gdp""",
    "impute_median": "SELECT row_id, coalesce(averageGDP, (SELECT quantile_disc(averageGDP, 0.5) FROM demo_gdp)) AS gdp FROM demo_gdp",
    "replace_col": """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 70 ELSE c_nationkey END AS c_nationkey,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "lookup_list": _lookup(("URGENT", ["1-URGENT", "2-HIGH"])),
    "lookup_dict": _lookup(("high", ["1-URGENT", "2-HIGH"]), ("any", ["high", "3-MEDIUM"]), ("low", ["5-LOW"])),
    "replace_by_id": """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'GOLD'
      ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "lower_case": "SELECT row_id, lower(city) AS city, lower(country) AS country FROM demo_city",
    "upper_case": "SELECT p_partkey, upper(p_name) AS p_name FROM part",
    "trim_col": "SELECT row_id, trim(city, ' ') AS city, trim(country, ' ') AS country FROM demo_city",
    "clear_accents": "SELECT doc_id, strip_accents(text) AS text FROM documents",
    "clear_accents_places": "SELECT place_id, strip_accents(city) AS city, strip_accents(country) AS country FROM ref_places",
    "remove_special_chars": f"SELECT row_id, translate(city, {_PUNCT}, '') AS city, translate(country, {_PUNCT}, '') AS country FROM demo_city",
    "remove_special_chars_regex": "SELECT row_id, regexp_replace(city, '[^A-Za-z]', '', 'g') AS city FROM demo_city",
    "date_transform": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS day FROM orders",
    "age_calculate": f"""SELECT o_orderkey, round(abs(CASE WHEN day(x) = 15 THEN {_MONTHS} ELSE round({_MONTHS} + (15 - day(x)) / 31.0, 8) END) / 12, 4)::DOUBLE AS age
      FROM (SELECT o_orderkey, o_orderdate::DATE AS x FROM orders)""",
    "count_items": "SELECT o_custkey, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL GROUP BY o_custkey",
    "remove_duplicates": "SELECT DISTINCT city, country, population FROM demo_city",
    "remove_duplicates_det": "SELECT row_id, city, country, population FROM demo_city QUALIFY row_number() OVER (PARTITION BY city, country ORDER BY row_id) = 1",
    "fingerprint": f"SELECT doc_id, {_fingerprint('text')} AS fingerprint FROM documents",
    "fingerprint_city": f"SELECT row_id, {_fingerprint('city')} AS fingerprint FROM demo_city",
    "key_collision_clusters": _clusters(_PART, "p_name", "p_partkey") + _CLUSTER_COLUMNS,
    "key_collision_city": _clusters("SELECT * FROM demo_city", "city", "row_id") + _CLUSTER_COLUMNS,
    "dedup_resolve_fingerprint": _resolved(_PART, "p_name", "p_partkey"),
    "dedup_resolve_city": _resolved("SELECT * FROM demo_city", "city", "row_id"),
    "lineitem_fingerprint_resolve": _resolved(
        """SELECT l_orderkey * 8 + l_linenumber AS line, CASE WHEN l_linenumber % 3 = 0 THEN concat(' ', upper(n), '!') ELSE n END AS name
        FROM (SELECT *, concat(l_returnflag, l_linestatus, ' supplier ', l_suppkey::VARCHAR) AS n FROM lineitem)""", "name", "line",
    ),
    "cluster_affected_rows": _clusters(_PART, "p_name", "p_partkey") + " SELECT coalesce(sum(n), 0)::BIGINT AS rows FROM clusters",
    "cluster_preview": _clusters("SELECT * FROM demo_city", "country", "row_id")
    + _CLUSTER_COLUMNS + " WHERE key IN (SELECT key FROM (SELECT DISTINCT key, total FROM clusters) ORDER BY total DESC, key LIMIT 5)",
    "record_matching": _matching(_PART, ["p_name"], ["p_brand", "p_size"], "p_partkey", ' SELECT key[1] AS key, "column", canonical, canonical_n, total FROM fixes'),
    "record_matching_city": _matching(
        "SELECT * FROM demo_city", ["city", "country"], ["population"], "row_id",
        " SELECT array_to_string(key, '|') AS key, \"column\", canonical, canonical_n, total FROM fixes",
    ),
    "resolve_records": _matching(
        _PART, ["p_name"], ["p_brand", "p_size"], "p_partkey",
        """ SELECT k.p_partkey, k.p_name, CASE WHEN b.key IS NOT NULL THEN b.canonical ELSE k.p_brand END AS p_brand,
        CASE WHEN s.key IS NOT NULL THEN s.canonical::INTEGER ELSE k.p_size END AS p_size FROM keyed k
        LEFT JOIN fixes b ON b.key = k.key AND b."column" = 'p_brand' LEFT JOIN fixes s ON s.key = k.key AND s."column" = 'p_size'""",
    ),
    "matched_rows": _matching(_PART, ["p_name"], ["p_brand"], "p_partkey", " SELECT p_partkey FROM keyed WHERE key IN (SELECT key FROM fixes)"),
    "build_pairs": """SELECT a.n_name, a.n_nationkey, b.n_name AS _n_name, b.n_nationkey AS _n_nationkey
      FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""",
    "build_pairs_blocked": """SELECT a.s_name, a.s_suppkey, b.s_name AS _s_name, b.s_suppkey AS _s_suppkey
      FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
    **{f"lsh_pairs_{name}": _blocks(measure) + " SELECT * FROM pairs" for name, measure in _MEASURES.items()},
    "lsh_resolve": _blocks(_MEASURES["levenshtein"])
    + """, sides AS (SELECT value_l AS value, canonical, total FROM pairs UNION ALL SELECT value_r, canonical, total FROM pairs),
best AS (SELECT value, canonical FROM sides WHERE value <> canonical QUALIFY row_number() OVER (PARTITION BY value ORDER BY total DESC, canonical) = 1)
SELECT p.p_partkey, coalesce(b.canonical, p.p_name) AS p_name FROM part p LEFT JOIN best b ON b.value = p.p_name""",
    "lsh_matched_rows": _blocks(_MEASURES["levenshtein"])
    + " SELECT value_l, value_r, p_partkey FROM pairs JOIN part ON p_name IN (value_l, value_r)",
    "lsh_pairs_city": _blocks(_MEASURES["hamming"], "demo_city", "city", "row_id", 4, 0.85) + " SELECT value_l, value_r, similarity, canonical, total FROM pairs",
    "record_preview": _matching(
        "SELECT * FROM demo_city", ["city", "country"], ["population"], "row_id",
        """ SELECT array_to_string(f.key, '|') AS key, f."column", f.canonical, f.total, k.row_id FROM
        (SELECT * FROM fixes ORDER BY total DESC, key, "column" LIMIT 10) f JOIN keyed k USING (key)""",
    ),
    "record_variants": _matching(
        _PART, ["p_name"], ["p_brand"], "p_partkey",
        """ SELECT key[1] AS key, "column", value, n FROM counts WHERE key IN (SELECT key FROM fixes)""",
    ),
    "fd_violations": _HOSPITAL + " SELECT ZIPCode, count(*) AS num FROM z_counts GROUP BY 1",
    "fd_histogram": _HOSPITAL + " SELECT ProviderNumber, City, PhoneNumber, n AS count FROM p_counts",
    "fd_violations_orders": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS num FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
    "fd_row_rules": _HOSPITAL
    + """ SELECT row_id, array_to_string(list_sort(list(rule)), ',') AS rules FROM (
      SELECT row_id, 0 AS rule FROM hospital_like WHERE ZIPCode IN (SELECT ZIPCode FROM z_counts)
      UNION ALL SELECT row_id, 1 FROM hospital_like WHERE ProviderNumber IN (SELECT ProviderNumber FROM p_counts)) GROUP BY row_id""",
    "fd_repair_greedy": _HOSPITAL
    + f""", once AS (SELECT h.row_id, h.ZIPCode, h.ProviderNumber, {_swap('City', 'z', 'h.City')} AS City, {_swap('State', 'z', 'h.State')} AS State, h.PhoneNumber
       FROM hospital_like h LEFT JOIN z_fixes z USING (ZIPCode))
      SELECT o.row_id, o.ZIPCode, o.ProviderNumber, {_swap('City', 'p', 'o.City')} AS City, o.State, {_swap('PhoneNumber', 'p', 'o.PhoneNumber')} AS PhoneNumber
      FROM once o LEFT JOIN p_fixes p USING (ProviderNumber)""",
    "replace_sub_df": _HOSPITAL
    + f""" SELECT h.row_id, h.ZIPCode, h.ProviderNumber, {_swap('City', 'z', 'h.City')} AS City, {_swap('State', 'z', 'h.State')} AS State, h.PhoneNumber
       FROM hospital_like h LEFT JOIN z_fixes z USING (ZIPCode)""",
    "fd_repair_greedy_orders": "WITH "
    + _fd("c", "orders", "o_custkey", ["o_orderpriority"])
    + f" SELECT o.o_orderkey, o.o_custkey, {_swap('o_orderpriority', 'c', 'o.o_orderpriority')} AS o_orderpriority FROM orders o LEFT JOIN c_fixes c USING (o_custkey)",
    "fd_repair_fixpoint": "WITH t0 AS MATERIALIZED (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders), "
    + ", ".join(
        re.sub(r"(_all|_counts|_fixes) AS \(", r"\1 AS MATERIALIZED (", _fd(f"c{k}", f"t{k}", "o_custkey", ["o_orderpriority"]))
        + f", t{k + 1} AS MATERIALIZED (SELECT o.o_orderkey, o.o_custkey, {_swap('o_orderpriority', 'c', 'o.o_orderpriority')} AS o_orderpriority FROM t{k} o LEFT JOIN c{k}_fixes c USING (o_custkey))"
        for k in range(4)
    )
    + " SELECT o_custkey, count(DISTINCT o_orderpriority) AS num FROM t4 GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
    "fd_repair_holistic": _HOSPITAL
    + """, z_best AS (SELECT ZIPCode, City, n FROM z_counts QUALIFY row_number() OVER (PARTITION BY ZIPCode ORDER BY n DESC, City NULLS FIRST, State NULLS FIRST) = 1),
    p_keys AS (SELECT DISTINCT ProviderNumber FROM p_counts)
    SELECT h.row_id, h.ZIPCode, h.ProviderNumber, CASE WHEN b.n > own.n AND k.ProviderNumber IS NOT NULL THEN b.City ELSE h.City END AS City, h.State, h.PhoneNumber
    FROM hospital_like h LEFT JOIN z_best b USING (ZIPCode) LEFT JOIN p_keys k USING (ProviderNumber)
    LEFT JOIN z_counts own ON own.ZIPCode = h.ZIPCode AND own.City IS NOT DISTINCT FROM h.City AND own.State IS NOT DISTINCT FROM h.State""",
    "minmax_normalize": f"SELECT event_id, round({_minmax('value', 'events')}, 9) AS value FROM events",
    "outlier_bounds": "SELECT q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events)",
    "outlier_flag": """WITH q AS (SELECT quantile_disc(population, 0.25)::DOUBLE AS q1, quantile_disc(population, 0.75)::DOUBLE AS q3 FROM demo_outlier_int)
      SELECT row_id, coalesce(population < q1 - 1.5 * (q3 - q1) OR population > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM demo_outlier_int, q""",
    "outlier_delete": """WITH q AS (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events)
      SELECT event_id, value FROM events, q WHERE value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)""",
    "outlier_ids": """WITH q AS (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events)
      SELECT event_id FROM events, q WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)""",
    "outlier_centre_ratio": """
WITH centres(c, x, y) AS (VALUES (0, 1000.0::DOUBLE, 500.0::DOUBLE), (1, 500000.0, 20000.0), (2, 9000000.0, 60000.0)),
far AS (SELECT row_id, c, pow(population / 1000.0::DOUBLE - x, 2) + pow(averageGDP / 10.0::DOUBLE - y, 2) AS d FROM demo_gdp, centres
        WHERE population IS NOT NULL AND averageGDP IS NOT NULL AND NOT isnan(averageGDP)),
near AS (SELECT row_id, arg_min(c, [d, c]) AS c, sqrt(min(d)) AS d FROM far GROUP BY row_id),
rated AS (SELECT row_id, CASE WHEN max(d) OVER (PARTITION BY c) > 0 THEN d / max(d) OVER (PARTITION BY c) ELSE 0 END AS ratio FROM near)
SELECT row_id, round(ratio, 6) AS ratio FROM demo_gdp LEFT JOIN rated USING (row_id)""",
    "outlier_delete_price": """WITH q AS (SELECT quantile_disc(Price, 0.25) AS q1, quantile_disc(Price, 0.75) AS q3 FROM price_area)
      SELECT row_id, Price, AreaLiving FROM price_area, q WHERE Price IS NULL OR Price BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)""",
    "vector_assemble": "SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part",
    "minmax_scale_vec": f"SELECT p_partkey, round({_minmax('p_size', 'part')}, 9) AS a, round({_minmax('p_retailprice', 'part')}, 9) AS b FROM part",
    "normalize_vec": """SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 9) AS a,
      round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 9) AS b FROM part""",
    "string_index": "SELECT p_partkey, place::DOUBLE AS p_brand_index FROM part JOIN " + _INDEXED.format(c="p_brand", t="part") + " USING (p_brand)",
    "index_string_roundtrip": "SELECT p_partkey, p_type, p_type AS back FROM part",
    "one_hot": "SELECT c_custkey, (n - 1)::INTEGER AS size, (CASE WHEN place < n - 1 THEN place + 1 ELSE 0 END)::INTEGER AS place FROM customer JOIN "
    + _INDEXED.format(c="c_mktsegment", t="customer") + " USING (c_mktsegment), (SELECT count(DISTINCT c_mktsegment) AS n FROM customer)",
    "csv_roundtrip": "SELECT * FROM nation",
    "json_roundtrip": "SELECT * FROM supplier",
    "csv_to_parquet": "SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey, o_totalprice FROM orders",
    "parquet_read": "SELECT * FROM nation",
    "create_data_frame": "SELECT * FROM (VALUES (1::BIGINT, 'a', 0.5::DOUBLE), (2, NULL, 1.5)) AS t(k, name, x)",
    "url_csv_read": "SELECT * FROM region",
    "url_json_read": "SELECT * FROM region",
    "checkpointed": "SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, s_acctbal FROM supplier",
    "checkpointed_often": "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier",
    "load_demo": """SELECT * FROM (VALUES ('Bogota', 'Colombia', 37800000), ('New York', 'America', 9795791), ('   São Paulo', 'Brazil', 12341418),
      ('~Madrid', 'Spain', 6489162), ('New York', 'America', 19795791), ('New York  ', 'Amarica', 19795791), ('Bogotá', 'Colombia', 37800000)) AS t(city, country, population)""",
    "column_dictionary": "SELECT n_nationkey, n_name AS nation, n_regionkey::DOUBLE AS region FROM nation",
    "stream_clean_events": "SELECT event_id, upper(event_type) AS event_type FROM events WHERE event_type IS NOT NULL",
    "stream_window_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}

"""One consistent form for texts that look the same but are made of other characters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow

# Letters that look like a Latin letter, and that letter. Both cases are given, as the
# case of a text may have been changed after its letters were.
LOOK_ALIKES = [
    # Cyrillic
    ("АВЕКМНОРСТУХЅІЈҺԚԜӀ", "ABEKMHOPCTYXSIJHQWI"),
    ("авекмнорстухѕіјһԛԝӏ", "abekmhopctyxsijhqwl"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    ("αβεζηικμνορτυχϲ", "abezhikmvoptyxc"),
    # Armenian and phonetic letters
    ("ՕօՍսⱭɑꞬɡıɩ", "OoUuAaGgii"),
    # Cyrillic letters with a diaeresis
    ("ЁёЇї", "ËëÏï"),
]
# Format characters that are seen all the same, first and last of each range.
SEEN = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F)]
# What stands in the names of other characters without a width.
UNSEEN_NAMES = ["VARIATION SELECTOR", "FILLER", "GRAPHEME JOINER", "VOWEL INHERENT"]

#: Rows, and bytes, of Arrow batches that go through the embedded SQL together.
FORM_ROWS, FORM_BYTES = 100_000, 16_000_000
#: Compatibility forms are looked up in parts, first and last code point of each, as texts mostly hold those of one.
PARTS = [(0x80, 0x1FFF), (0x2000, 0x218F), (0x2190, 0xFEFF), (0xFF00, 0xFFFF), (0x10000, sys.maxunicode)]
#: Bytes of a reference list up to which it is broadcast.
BROADCAST_BYTES = 1_000_000

#: Greek nu is V in lower case and N in upper case; where case was changed the other reading holds.
_NU = ("νΝ", "nV")

_LAYOUT = r"[\s\x0b\x1c-\x1f\x85\p{Z}\p{P}$+<=>^`|~]+"
_ORDINARY = r"[\t-\r \p{P}$+<=>^`|~]+"


@lru_cache(maxsize=1)
def tables() -> dict[str, dict[str, str]]:
    """What single characters become, by rule over all of Unicode: unseen, spaces, compatible, look.

    ``compatible`` holds every character that compatibility composition changes beyond canonical composition,
    ``look`` the look-alikes, also with marks.
    """
    pairs = {a: b for src, dst in LOOK_ALIKES for a, b in zip(src, dst, strict=True)}
    unseen, spaces, compatible, look = {}, {}, {}, dict(pairs)
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cs", "Co", "Cn"):
            continue
        if kind == "Cf" and not any(lo <= code <= hi for lo, hi in SEEN) or any(x in unicodedata.name(ch, "") for x in UNSEEN_NAMES):
            unseen[ch] = ""
            continue
        if kind in ("Zs", "Zl", "Zp"):
            spaces[ch] = " "
            continue
        form = unicodedata.normalize("NFKC", ch)
        if form != unicodedata.normalize("NFC", ch):
            compatible[ch] = form
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] in pairs and ch not in pairs:
            look[ch] = unicodedata.normalize("NFC", pairs[parts[0]] + parts[1:])
    return {"unseen": unseen, "spaces": spaces, "compatible": compatible, "look": look}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def character_class(characters: Iterable[str]) -> str:
    """A regular expression of one of the characters, runs of them as ranges."""
    codes, ranges = sorted(map(ord, characters)), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def _parts(text: str, table: dict[str, str]) -> list[str]:
    """SQL expressions, one after the other over column s, that replace the characters of each part where there are some."""
    found = []
    for lo, hi in PARTS:
        own = {a: b for a, b in table.items() if lo <= ord(a) <= hi}
        if own:
            found.append(f"CASE WHEN regexp_matches({text}, '{character_class(own)}') THEN {_replaced(text, own)} ELSE {text} END")
    return found


def _replaced(text: str, table: dict[str, str]) -> str:
    """SQL of a text with characters replaced: those that become one by translate, those that become several by a map."""
    one, several = {a: b for a, b in table.items() if len(b) == 1}, {a: b for a, b in table.items() if len(b) > 1}
    if several:
        keys, values = (", ".join(map(_quoted, x)) for x in (several, several.values()))
        mapped = f"array_to_string(list_transform(string_split({text}, ''), lambda x: coalesce(map([{keys}], [{values}])[x], x)), '')"
        text = f"CASE WHEN regexp_matches({text}, '{character_class(several)}') THEN {mapped} ELSE {text} END"
    return f"translate({text}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"


@lru_cache(maxsize=1)
def form_sql() -> str:
    """The SQL that brings column v of table batch to its form, keys and plain layout-free text."""
    t = tables()
    unseen, spaces, look = (character_class(t[x]) for x in ("unseen", "spaces", "look"))
    parts = _parts("s", t["compatible"])
    steps = "\n".join(f"p{k} AS (SELECT i, v, ascii, CASE WHEN ascii THEN s ELSE {part} END AS s FROM {f'p{k - 1}' if k else 'b'})," for k, part in enumerate(parts))
    last = len(parts) - 1
    key = lambda x: f"regexp_replace(lower({x}), '{_LAYOUT}', '', 'g')"
    nu = f"translate(before, {_quoted(_NU[0])}, {_quoted(_NU[1])})"
    return f"""
WITH a AS (SELECT i, v, regexp_full_match(v, '[\\x00-\\x7F]*') AS ascii FROM batch),
b AS (SELECT i, v, ascii, CASE WHEN ascii THEN v ELSE nfc_normalize(regexp_replace(regexp_replace(v, '{unseen}', '', 'g'), '{spaces}', ' ', 'g')) END AS s FROM a),
{steps}
c AS (SELECT i, v, ascii, CASE WHEN ascii THEN s ELSE nfc_normalize(s) END AS s FROM p{last}),
d AS (SELECT i, v, s AS before, CASE WHEN NOT ascii AND regexp_matches(s, '{look}') THEN nfc_normalize({_replaced('s', t["look"])}) ELSE s END AS s FROM c)
SELECT s AS form, {key('s')} AS key,
       CASE WHEN regexp_matches(before, '[{_NU[0]}]') THEN {key(f'nfc_normalize({_replaced(nu, t["look"])})')} END AS other_key,
       regexp_replace(lower(v), '{_ORDINARY}', '', 'g') AS plain
FROM d ORDER BY i"""


def _forms(sql: str):
    """Each distinct text of some Arrow batches goes through the embedded SQL once; the driver writes that down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FORM_ROWS or sum(b.nbytes for b in held) >= FORM_BYTES:
                yield from _formed(con, sql, held)
                held = []
        if held:
            yield from _formed(con, sql, held)

    return run


def _formed(con, sql: str, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    if not table.num_rows:
        return
    coded = table.column(table.num_columns - 1).chunk(0).dictionary_encode()
    con.register("batch", pa.table({"i": pa.array(range(len(coded.dictionary)), pa.int64()), "v": coded.dictionary}))
    found = con.sql(sql).to_arrow_table().combine_chunks()
    con.unregister("batch")
    out = table.select(table.schema.names[:-1])
    for name in ("form", "key", "other_key", "plain"):
        column = found.column(name)
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        out = out.append_column(name, column.cast(pa.string()).take(coded.indices))
    yield from out.combine_chunks().to_batches(max_chunksize=10_000)


def consistent_form(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with four texts made from ``text_col``:

    - ``form``: no invisible characters, ordinary spaces, all compatibility forms (NFKC) and the look-alikes
      replaced, letters composed; letter case and punctuation stay.
    - ``key``: ``form`` without letter case, white space and punctuation; equal-looking texts have equal keys.
    - ``other_key``: the key under the other reading of Greek nu, null for texts without one.
    - ``plain``: the stored text without letter case, ASCII white space and punctuation; texts with equal
      keys and different plain texts are made of different characters.

    Look-alikes are mapped to Latin letters everywhere, so words of other scripts also compare equal to
    their Latin twins; an accent is never dropped. Null gives null, an empty text empty texts; an
    empty table gives an empty result.
    """
    inner = [F.col(c).alias(f"k{n}") for n, c in enumerate(keep)]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"k{n} {types[c]}" for n, c in enumerate(keep)), "form string, key string, other_key string, plain string"])
    made = map_in_arrow(df.select(*inner, F.col(text_col).cast("string").alias("text")), _forms(form_sql()), schema)
    return made.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], "form", "key", "other_key", "plain")


def look_alike_matches(
    df: DataFrame, id_col: str, text_col: str, group_col: str,
    reference: DataFrame, ref_id: str, ref_text: str, ref_group: str, ref_code: str | None = None,
) -> DataFrame:
    """(id, ref_id) of the rows whose text is a reference text made of other characters.

    Rows that differ from the reference text in case, ASCII white space and punctuation alone are no
    case, nor are other spellings. Where several entries share the text, the row's group decides: the
    entry whose ``ref_code`` it is, punctuation and case disregarded, else the one whose ``ref_group`` is fewest
    edits away, then the smallest ref_id. Null texts never match.
    """
    letters = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", ""))
    code = F.lit("") if ref_code is None else letters(F.col(ref_code))
    named = reference.select(F.col(ref_id).alias("_ref"), letters(F.col(ref_group)).alias("_group"), code.alias("_code"), F.col(ref_text).alias("_text"))
    entries = consistent_form(named, "_text", ["_ref", "_group", "_code"]).where(F.col("key") != "")
    grouped = entries.groupBy(F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("_ref", "_group", "_code")).alias("_entries"), F.collect_set("plain").alias("_plains")
    )
    rows = consistent_form(df, text_col, [id_col, group_col]).where(F.col("key") != "")
    # two readings, one join: a row goes out once for each of its keys
    rows = rows.select(id_col, group_col, "plain", F.explode(F.array_compact(F.array("key", "other_key"))).alias("_key"))
    group = letters(F.col(group_col))
    ranked = F.transform(
        "_entries",
        lambda e: F.struct(
            F.when((e["_code"] != "") & (e["_code"] == group), -1).otherwise(F.levenshtein(group, e["_group"])).alias("far"), e["_ref"].alias("ref")
        ),
    )
    best = F.when(F.size("_entries") == 1, F.col("_entries")[0]["_ref"]).otherwise(F.array_min(ranked)["ref"])
    # a small list goes to the rows; its measured bytes bound the broadcast (keys and texts of an entry are
    # at most a few times its text)
    size = reference.agg(F.sum(64 + F.octet_length(F.concat_ws("", ref_text, ref_group)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        grouped = F.broadcast(grouped)
    found = rows.join(grouped, "_key").where(~F.array_contains("_plains", F.col("plain")))
    return found.select(F.col(id_col), best.alias(ref_id)).distinct()

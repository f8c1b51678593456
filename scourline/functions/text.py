"""Text functions: white space, punctuation, accents, fingerprints, types of values."""

from __future__ import annotations

import itertools
import string
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation
#: White space of Unicode, as str.isspace tells it.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Letters without a decomposition and how they are written in ASCII.
LETTERS = [
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("Æ", "AE"), ("Œ", "OE"), ("Þ", "TH"),
]
# The same for letters written as one.
SINGLE_LETTERS = ("øØłŁđĐðÐıħĦ", "oOlLdDdDihH")
_HANGUL = (0xAC00, 0xD7A3)


def strip_spaces(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def remove_punctuation(c: Column) -> Column:
    """Without the 32 ASCII punctuation characters."""
    return F.translate(c, PUNCTUATION, "")


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) of characters that become one or, beyond the end of ``to``, none; and those that become several.

    Built by rule: compatibility decomposition without the combining characters.
    """
    single, gone, several = {}, [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or _HANGUL[0] <= code <= _HANGUL[1]:
            continue
        ch = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if plain == ch:
            continue
        if not plain:
            gone.append(ch)
        elif len(plain) == 1:
            single[ch] = plain
        else:
            several[ch] = plain
    return "".join([*single, *gone]), "".join(single.values()), several


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_OTHER = r"[^\x00-\x7F]"
#: Below this code point a small table does; it covers the Latin letters with marks.
_FAR = 0x370


def _decomposed(s: Column) -> Column:
    """A text with characters other than ASCII, decomposed.

    Most characters become one or none and are translated. The few that become several are looked up
    once for each distinct one the text holds, Hangul syllables are taken apart by arithmetic.
    """
    src, dst, several = accent_tables()
    first, middle, last = ("".join(map(chr, r)) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))
    # one literal, folded into an array when the query is planned
    keys, values = F.lit("".join(several)), F.split(F.lit("\u0001".join(several.values())), "\u0001")
    hangul = lambda x: (F.ascii(x) >= _HANGUL[0]) & (F.ascii(x) <= _HANGUL[1])

    def plain(x: Column) -> Column:
        at = F.ascii(x) - _HANGUL[0]
        tail = at % 28
        jamo = F.concat(
            F.substr(F.lit(first), F.floor(at / 588).cast("int") + 1, F.lit(1)),
            F.substr(F.lit(middle), F.floor((at % 588) / 28).cast("int") + 1, F.lit(1)),
            F.when(tail > 0, F.substr(F.lit(last), tail.cast("int"), F.lit(1))).otherwise(""),
        )
        return F.when(hangul(x), jamo).otherwise(F.get(values, F.instr(keys, x) - 1))

    distinct = F.array_distinct(F.split(F.regexp_replace(s, r"[\x00-\x7F]+", ""), ""))
    odd = F.filter(distinct, lambda x: (x != "") & (hangul(x) | (F.instr(keys, x) > 0)))
    return F.translate(F.aggregate(odd, s, lambda text, x: F.replace(text, x, plain(x))), src, dst)


def _decomposed_latin(s: Column) -> Column:
    """The same for a text without characters from _FAR on."""
    src, dst, several = accent_tables()
    pairs = [(a, b) for a, b in itertools.zip_longest(src, dst, fillvalue="") if ord(a) < _FAR]
    gone = [a for a, b in pairs if not b]
    few = {a: b for a, b in several.items() if ord(a) < _FAR}
    out = s
    for a, b in few.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    text = F.when(s.rlike(f"[{''.join(few)}]"), out).otherwise(s)
    return F.translate(text, "".join([a for a, b in pairs if b] + gone), "".join(b for _, b in pairs))


def _without_accents(s: Column) -> Column:
    return F.when(s.rlike(f"[^\\x00-\\x{{{_FAR - 1:x}}}]"), _decomposed(s)).otherwise(_decomposed_latin(s))


def clear_accents(c: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining characters; ASCII text is passed on as it is."""
    return F.when(c.rlike(_OTHER), _without_accents(c)).otherwise(c)


def _latin(s: Column) -> Column:
    out = F.translate(_without_accents(s), *SINGLE_LETTERS)
    for src, dst in LETTERS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def latinize(c: Column) -> Column:
    """Accents removed and letters without a decomposition written in ASCII; other scripts stay."""
    return F.when(c.rlike(_OTHER), _latin(c)).otherwise(c)


#: Characters of a long text whose distinct ones are taken first.
_HEAD = 128


def _distinct(s: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(s, "")), "")


def distinct_characters(c: Column) -> Column:
    """Each character once, in the order of appearance.

    Of a long text those of its head come first; the rest is translated without them, which leaves little to be cut into
    characters.
    """

    def long(s: Column) -> Column:
        rest = lambda head: F.call_function("translate", F.substr(s, F.lit(_HEAD + 1)), head, F.lit(""))
        return let(_distinct(F.substr(s, F.lit(1), F.lit(_HEAD))), lambda head: F.concat(head, _distinct(rest(head))))

    return let(c, lambda s: F.when(F.length(s) > _HEAD, long(s)).otherwise(_distinct(s)))


def fingerprint(c: Column) -> Column:
    """Stripped, lower-cased, without punctuation, each character once in order of appearance, latinized.

    Null stays null. Characters are latinized last, so that two of the fingerprint may be equal.
    """
    once = distinct_characters(F.lower(strip_spaces(c.cast("string"))))
    return let(remove_punctuation(once), latinize)


def remove_regex(c: Column, pattern: str) -> Column:
    """Matches removed, again as often as the text has distinct characters, so that newly joined matches go too."""
    return F.aggregate(F.array_distinct(F.split(c, "")), c, lambda text, _: F.regexp_replace(text, pattern, ""))


_INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
_FLOAT = r"(?i)^\s*[+-]?(((\d+(_\d+)*)?\.\d+(_\d+)*|\d+(_\d+)*\.?)(e[+-]?\d+(_\d+)*)?|nan|inf(inity)?)\s*$"


def value_type(c: Column) -> Column:
    """What the text of a value reads as: 'integer', 'float', 'string', or 'null'."""
    text = c.cast("string")
    return (
        F.when(c.isNull(), "null")
        .when(text.rlike(_INTEGER), "integer")
        .when(text.rlike(_FLOAT), "float")
        .otherwise("string")
    )


def reformat_date(c: Column, current: str, wanted: str) -> Column:
    """A date text in another format; null where it doesn't have the current one."""
    return F.date_format(F.try_to_timestamp(c, F.lit(current)), wanted)


def age_in_years(c: Column, form: str, as_of: Column | None = None) -> Column:
    """Years between a date text and ``as_of`` (today if not given), absolute, as text with four decimals."""
    day = F.to_date(F.try_to_timestamp(c, F.lit(form)))
    today = F.current_date() if as_of is None else as_of
    return F.format_number(F.abs(F.months_between(day, today) / 12), 4)

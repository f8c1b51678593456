"""Vectorised code-point tools: skip-and-fold table, rolling polynomial hashes, missing values."""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code points from here on have neither case nor punctuation.
TABLE_SIZE = 0x20000

#: Texts that only say that there is no value, letter case, spaces and punctuation disregarded.
# Fixed values.
FILLERS = [
    "", "blank", "empty", "missing", "na", "nan", "nil", "no data", "no value", "none", "not available",
    "not given", "not known", "not provided", "not specified", "null", "tba", "tbc", "tbd", "undefined",
    "unknown", "unspecified",
]

#: Codes that are hashed over one prefix sum.
BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point the lower-case code point, or 0 where it is to be skipped.

    White space, the 32 ASCII punctuation characters and every character of a Unicode punctuation
    category are skipped. A letter whose lower case has several characters stays itself.
    """
    table = np.arange(TABLE_SIZE, dtype=np.uint32)
    for code in range(TABLE_SIZE):
        ch = chr(code)
        if ch.isspace() or ch in string.punctuation or unicodedata.category(ch)[0] == "P":
            table[code] = 0
        else:
            low = ch.lower()
            if len(low) == 1:
                table[code] = ord(low)
    return table


@lru_cache(maxsize=1)
def fold_list() -> list[int]:
    return fold_table().tolist()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text begins (one more than texts)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = bytes(data[int(offsets[0]) : int(offsets[-1])]) if data is not None else b""
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(starts, out=before[1:])
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, before[offsets - offsets[0]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on unsigned integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def char_values() -> np.ndarray:
    return mix(np.arange(TABLE_SIZE, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE**0 .. _BASE**BLOCK modulo 2**64, and their inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(BLOCK + 1, base & _MASK, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _long_hash(codes: np.ndarray, table: np.ndarray | None) -> np.uint64:
    forward, _ = _powers()
    total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for lo in range(0, len(codes), BLOCK):
        part = codes[lo : lo + BLOCK]
        total += ((part if table is None else table[part]) * forward[: len(part)]).sum(dtype=np.uint64) * power
        power *= forward[BLOCK]
    return total[0]


def span_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hashes of codes[begin:end], rolled over prefix sums of BLOCK codes at a time.

    Spans come in their order and don't overlap. With ``table`` the value of a code is looked up there, block
    by block, so that long texts take no array of values.
    """
    forward, inverse = _powers()
    out = np.zeros(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        lo = int(begins[i])
        j = int(np.searchsorted(ends, lo + BLOCK, "right"))
        if j <= i:
            out[i] = _long_hash(codes[lo : int(ends[i])], table)
            i += 1
            continue
        part = codes[lo : int(ends[j - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part if table is None else table[part]) * forward[: len(part)], out=total[1:])
        b = begins[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[b]) * inverse[b]
        i = j
    return out


def folded_hashes(texts: pa.Array) -> np.ndarray:
    """One rolling polynomial hash per text over its folded, not skipped code points; 0 if none is left."""
    points, begins = code_points(texts)
    small = points < TABLE_SIZE
    folded = np.where(small, fold_table()[np.where(small, points, 0)], points)
    keep = folded != 0
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    folded = folded[keep]
    small = folded < TABLE_SIZE
    values = char_values()[np.where(small, folded, 0)]
    if not small.all():
        values[~small] = mix(folded[~small].astype(np.uint64))
    at = kept[begins]
    return span_hashes(values, at[:-1], at[1:])


@lru_cache(maxsize=1)
def filler_hashes() -> np.ndarray:
    return np.unique(folded_hashes(pa.array(FILLERS)))


def missing(texts: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """Null, blank, or a text that only says that there is no value; hashes are its folded hashes."""
    return np.isin(hashes, filler_hashes()) | texts.is_null().to_numpy(zero_copy_only=False)


def same_but_layout(a: str, b: str) -> bool:
    """Two-pointer comparison of two texts that skips what the fold table skips."""
    if a == b:
        return True
    fold = fold_list()
    i, j, n, m = 0, 0, len(a), len(b)
    while True:
        x = y = 0
        while i < n and not x:
            x = ord(a[i])
            x = fold[x] if x < TABLE_SIZE else x
            i += 1
        while j < m and not y:
            y = ord(b[j])
            y = fold[y] if y < TABLE_SIZE else y
            j += 1
        if x != y:
            return False
        if not x:
            return True

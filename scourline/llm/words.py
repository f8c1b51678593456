"""Vectorised words of many texts at once: their places and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .codepoints import mix, span_hashes

#: Bytes of text that are worked on at once, which bounds the memory of a task.
CHUNK_BYTES = 2_000_000

#: ASCII letters and digits, lower-cased; 0 for every other byte.
WORD_BYTES = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        WORD_BYTES[_c] = ord(chr(_c).lower())
_VALUES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of its rows) of runs of whole texts of about CHUNK_BYTES.

    A text longer than that makes a run of its own.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, begins, ends, first word of each row and one more) of the words of some rows.

    A word is a maximal run of ASCII letters and digits within a row.
    """
    folded = WORD_BYTES[data]
    inside = folded != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    # a row ends the word before it
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    begins, ends = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return folded, begins, ends, np.searchsorted(begins, offsets)


def word_hashes(folded: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hashes(folded, begins, ends, _VALUES))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, whether or not it crosses rows."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + n]
    return out

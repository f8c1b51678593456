"""Evaluation items that documents give away, verbatim or with other numbers, names and units."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from ..storage import stage
from .codepoints import mix
from .words import chunks, find_words, window_hashes, word_hashes

# Words that are replaced by the placeholder of units.
UNITS = [
    "bytes", "celsius", "cents", "centimetres", "cm", "days", "degrees", "dollars", "euros", "feet", "gb", "grams",
    "hours", "inches", "kb", "kg", "kilograms", "kilometres", "km", "litres", "mb", "metres", "miles", "minutes", "mm",
    "months", "ms", "percent", "pounds", "seconds", "tonnes", "weeks", "years",
]
# Characters after which a sentence, line or entry of a list begins.
STOPS = ".!?:;#*\n"
#: Words other than placeholders that a passage with other values must hold.
LEAST_FIXED = 6
#: Bits of the filter of windows: so many for each window, at least and at most; and how many of them are asked.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST, PROBES = 64, 1 << 16, 1 << 28, 4
#: Matching windows of a passage and an item from which they are compared diagonal by diagonal.
MANY_MATCHES = 4_000_000

_NUMBER, _NAME, _UNIT = np.uint64(11), np.uint64(12), np.uint64(13)
_BASE = 0xD6E8FEB86659FD93
_STOP = np.isin(np.arange(256), np.frombuffer(STOPS.encode(), np.uint8))
_DIGIT = (np.arange(256) >= ord("0")) & (np.arange(256) <= ord("9"))
_SMALL = (np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))
_LARGE = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))


def _before(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


@dataclass
class Words:
    """The words of some rows, and what each of them is by its own letters and the sentence it stands in."""

    folded: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # first word of each row, and one more
    exact: np.ndarray  # hashes
    values: np.ndarray  # hashes, with placeholders for numbers and units
    slots: np.ndarray  # whether it is a number or a unit
    inner: np.ndarray  # whether it is capitalised within a sentence
    outer: np.ndarray  # whether it is capitalised where a sentence begins

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, units: np.ndarray, opens: bool = True) -> Words:
        folded, begins, ends, firsts = find_words(data, offsets)
        exact = word_hashes(folded, begins, ends)
        size = ends - begins
        digits, small, stops = _before(_DIGIT[data]), _before(_SMALL[data]), _before(_STOP[data])
        number = digits[ends] - digits[begins] == size
        unit = units[np.minimum(np.searchsorted(units, exact), len(units) - 1)] == exact if len(units) else np.zeros(len(exact), bool)
        capital = (size > 1) & _LARGE[data[begins]] & (small[ends] - small[begins] == size - 1) & ~unit if len(begins) else np.zeros(0, bool)
        start = stops[begins] > stops[np.r_[0, ends[:-1]]] if len(begins) else np.zeros(0, bool)
        at = firsts[:-1][firsts[:-1] < firsts[1:]]
        start[at] = True
        if not opens and len(start):
            start[0] = False
        values = np.where(number, _NUMBER, np.where(unit, _UNIT, exact))
        return cls(folded, begins, ends, firsts, exact, values, number | unit, capital & ~start, capital & start)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def names(self, reading: int) -> np.ndarray:
        """Words read as names: none, those within sentences, or all capitalised ones."""
        return self.inner | self.outer if reading == 2 else self.inner if reading else np.zeros(len(self.inner), bool)

    def text(self, k: int) -> bytes:
        return self.folded[self.begins[k] : self.ends[k]].tobytes()


def windows(words: Words, width: int, least_fixed: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reading, first word, end, hash) of the windows that stand for passages; none crosses rows.

    From each word on, the shortest window of at least ``width`` words with ``least_fixed`` words other than
    placeholders, so that every passage with as many holds the window of its first word. Numbers and units
    are placeholders in all three readings, names in the second and third; windows that read the same are given
    once, unless ``every`` reading is wanted. Windows of ``width`` words with fewer fixed ones are also given as they stand, in the first reading.
    """
    n = len(words.exact)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    row_end = words.firsts[1:][words.rows()]
    steps = np.full(n, _BASE, np.uint64)
    steps[0] = 1
    forward = np.cumprod(steps, dtype=np.uint64)
    steps[1:] = pow(_BASE, -1, 1 << 64)
    backward = np.cumprod(steps, dtype=np.uint64)
    p = np.arange(n)
    out = []
    for reading in (0, 1, 2):
        name = words.names(reading)
        template = np.where(name, _NAME, words.values)
        fixed = _before(~(words.slots | name))
        end = np.maximum(p + width, np.searchsorted(fixed, fixed[:-1] + least_fixed, "left"))
        at = end <= row_end
        if reading and not every:
            fresh = _before(words.inner if reading == 1 else words.outer)
            at &= fresh[np.minimum(end, n)] > fresh[:-1]
        at = np.flatnonzero(at)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(template * forward, out=total[1:])
        out.append((np.full(len(at), reading), at, end[at], mix((total[end[at]] - total[at]) * backward[at])))
        if not reading:
            few = np.flatnonzero((p + width <= row_end) & (fixed[np.minimum(p + width, n)] - fixed[:-1] < least_fixed))
            plain = window_hashes(words.exact, width)
            out.append((np.zeros(len(few), np.int64), few, few + width, mix(plain[few] ^ np.uint64(0x5851F42D4C957F2D))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def consistent_stretch(ours: list[bytes], theirs: list[bytes], slots: list[bool] | None = None, width: int = 1, least_fixed: int = 0) -> tuple[int, int]:
    """(begin, end) of the longest stretch in which the values of slots stand for each other one to one.

    Of those with ``width`` words and ``least_fixed`` words that are no slots; (0, 0) if there is none.
    Without ``slots`` every word is one.
    """
    forth: dict[bytes, tuple[bytes, int]] = {}
    back: dict[bytes, tuple[bytes, int]] = {}
    begin, best, fixed = 0, (0, 0), [0]
    for k, (a, b) in enumerate(zip(theirs, ours, strict=True)):
        slot = slots is None or slots[k]
        fixed.append(fixed[-1] + (not slot))
        if slot:
            for table, x, y in ((forth, a, b), (back, b, a)):
                other, at = table.get(x, (y, -1))
                if other != y:
                    begin = max(begin, at + 1)
                table[x] = (y, k)
        if k + 1 - begin > best[1] - best[0] and k + 1 - begin >= width and fixed[-1] - fixed[begin] >= least_fixed:
            best = (begin, k + 1)
    return best


def _matches(ours: Words, theirs: Words, a: tuple, b: tuple) -> Iterator[tuple[int, int, int, int, int]]:
    """(our reading, theirs, our first word, their first word, words) of runs of matching windows.

    ``a`` and ``b`` are the windows of both.
    """
    order = np.argsort(b[3], kind="stable")
    keys = b[3][order]
    left, right = np.searchsorted(keys, a[3], "left"), np.searchsorted(keys, a[3], "right")
    many = right - left
    if many.sum() > MANY_MATCHES:
        yield from _diagonals(ours, theirs, int(min((a[2] - a[1]).min(), (b[2] - b[1]).min())))
        return
    i = np.repeat(np.arange(len(many)), many)
    j = order[np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    p, q, kind, size = a[1][i], b[1][j], a[0][i] * 3 + b[0][j], a[2][i] - a[1][i]
    order = np.lexsort((p, p - q, kind))
    p, q, kind, size = p[order], q[order], kind[order], size[order]
    if not len(p):
        return
    heads = np.flatnonzero(np.r_[True, (np.diff(kind) != 0) | (np.diff(p - q) != 0) | (np.diff(p) > 1)])
    until = np.maximum.reduceat(p + size, heads)
    for lo, end in zip(heads.tolist(), until.tolist(), strict=True):
        yield int(kind[lo]) // 3, int(kind[lo]) % 3, int(p[lo]), int(q[lo]), int(end - p[lo])


def _diagonals(ours: Words, theirs: Words, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The same for texts that repeat themselves very often, in memory of the order of the texts."""
    for x in range(3):
        one = np.where(ours.names(x), _NAME, ours.values)
        for y in range(3):
            two = np.where(theirs.names(y), _NAME, theirs.values)
            for d in range(1 - len(two), len(one)):
                a, b = max(d, 0), max(-d, 0)
                size = min(len(one) - a, len(two) - b)
                same = np.r_[False, one[a : a + size] == two[b : b + size], False]
                edges = np.flatnonzero(same[1:] != same[:-1])
                for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if hi - lo >= width:
                        yield x, y, a + lo, b + lo, hi - lo


def best_passage(ours: Words, theirs: Words, a: tuple, b: tuple, width: int, least_fixed: int) -> tuple[int, int, int] | None:
    """(1 for verbatim or 0, words, -first word) of the best passage that both texts share."""
    best = None
    for x, y, p, q, size in _matches(ours, theirs, a, b):
        one = [ours.text(k) for k in range(p, p + size)]
        two = [theirs.text(k) for k in range(q, q + size)]
        run, longest, end = 0, 0, 0
        for k, (s, t) in enumerate(zip(one, two, strict=True)):
            run = run + 1 if s == t else 0
            if run > longest:
                longest, end = run, k + 1
        if longest >= width:
            found = (1, longest, longest - end - p)
        else:
            own, other = ours.names(x)[p : p + size], theirs.names(y)[q : q + size]
            mine, its = np.where(own, _NAME, ours.values[p : p + size]), np.where(other, _NAME, theirs.values[q : q + size])
            slots = (ours.slots[p : p + size] | own).tolist()
            alike = [m and (slot or s == t) for m, slot, s, t in zip((mine == its).tolist(), slots, one, two, strict=True)]
            found, at = (-1, 0, 0), 0
            while at < size:  # only a collision of hashes makes more than one part
                stop = next((k for k in range(at, size) if not alike[k]), size)
                lo, hi = consistent_stretch(one[at:stop], two[at:stop], slots[at:stop], width, least_fixed)
                if hi > lo:
                    found = max(found, (0, hi - lo, -(p + at + lo)))
                at = stop + 1
            if found[0] < 0:
                continue
        if best is None or found > best:
            best = found
    return best


def _unit_hashes(units: list[str]) -> np.ndarray:
    found = [np.zeros(0, np.uint64)]
    for _, _, data, offsets in chunks(pa.array(units, pa.string())):
        folded, begins, ends, _ = find_words(data, offsets)
        found.append(word_hashes(folded, begins, ends))
    return np.unique(np.concatenate(found))


def _item_windows(units: np.ndarray, width: int, least_fixed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column(1)):
                words = Words.of(data, offsets, units)
                _, p, _, hashes = windows(words, width, least_fixed)
                rows = words.rows()[p] + lo if len(p) else p
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hashes.view(np.int64))], names=["item", "hash"])

    return run


def _probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th bit of each hash in a filter of so many bits."""
    return (mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(bits - 1)).astype(np.int64)


def _filter_words(bits: int):
    """Hashes to the words of the filter that they set bits of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.unique(batch.column(0).to_numpy().view(np.uint64))
            at = np.unique(np.concatenate([_probe(hashes, k, bits) for k in range(PROBES)]))
            if not len(at):
                continue
            word, heads = np.unique(at >> 6, return_index=True)
            ors = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), heads)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(ors.view(np.int64))], names=["word", "bits"])

    return run


def window_filter(hashes: DataFrame) -> Broadcast:
    """A Bloom filter of a column of hashes, of at most FILTER_MOST bits, broadcast.

    It only says which windows can't match; the fuller it gets, the more windows go to the join in vain.
    """
    share = max(1, hashes.count()) * FILTER_SHARE
    bits = min(max(1 << (share - 1).bit_length(), FILTER_LEAST), FILTER_MOST)
    held = map_in_arrow(hashes, _filter_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = held.toArrow()  # at most FILTER_MOST / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def _passages(units: np.ndarray, width: int, least_fixed: int, shared: Broadcast):
    """(id, text) to its stretches of words whose windows may be those of items, with the hashes of these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        bits = len(held) * 64
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column(1)):
                words = Words.of(data, offsets, units)
                _, p, end, hashes = windows(words, width, least_fixed)
                left = np.arange(len(hashes))
                for k in range(PROBES):
                    at = _probe(hashes[left], k, bits)
                    left = left[(held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0]
                if not len(left):
                    continue
                left = left[np.argsort(p[left], kind="stable")]
                p, end, hashes = p[left], end[left], hashes[left]
                row = words.rows()[p]
                heads = np.flatnonzero(np.r_[True, (np.diff(p) > 1) | (np.diff(row) != 0)])
                first, until = p[heads], np.maximum.reduceat(end, heads)
                stops = _before(_STOP[data])
                before = np.where(first > 0, words.ends[np.maximum(first - 1, 0)], 0)
                opens = (words.firsts[row[heads]] == first) | (stops[words.begins[first]] > stops[before])
                texts = [data[a:b].tobytes().decode() for a, b in zip(words.begins[first].tolist(), words.ends[until - 1].tolist(), strict=True)]
                cuts = np.r_[heads, len(p)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[heads] + lo)), pa.array(first - words.firsts[row[heads]]), pa.array(texts, pa.string()),
                        pa.array(opens), pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.view(np.int64))),
                    ],
                    names=["doc", "first", "passage", "opens", "hits"],
                )

    return run


def _compare(units: np.ndarray, width: int, least_fixed: int):
    """(passage, opens, item, text of the item) to (passage, opens, item, verbatim, words, first word within)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bool], tuple[Words, tuple]] = {}

        def made(text: str, opens: bool) -> tuple[Words, tuple]:
            if (text, opens) not in known:
                if len(known) > 200:
                    known.clear()
                raw = text.encode()
                words = Words.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), units, opens)
                known[text, opens] = (words, windows(words, width, least_fixed, True))
            return known[text, opens]

        for batch in batches:
            found = []
            for k, (passage, opens, _, text) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                (ours, a), (theirs, b) = made(passage, opens), made(text, True)
                best = best_passage(ours, theirs, a, b, width, least_fixed) if len(a[0]) and len(b[0]) else None
                if best is not None:
                    found.append((k, *best))
            if found:
                at, kinds, sizes, begin = (list(x) for x in zip(*found, strict=True))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(rows) for c in batch.columns[:3]], pa.array(kinds, pa.int32()), pa.array(sizes, pa.int32()), pa.array([-x for x in begin], pa.int64())],
                    names=["passage", "opens", "item", "verbatim", "words", "inside"],
                )

    return run


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 13,
    least_fixed: int = LEAST_FIXED, units: list[str] | None = None,
) -> DataFrame:
    """(doc_id, item_id, kind, words, first_word): every document that gives an item away, and where.

    A word is a maximal run of ASCII letters and digits, case disregarded. Numbers, units and names become
    typed placeholders, in documents and items alike by the word itself: digits, UNITS, and capitalised words in
    three readings, which are no names, names within sentences, or names everywhere; so names that no item holds
    are found too. From each word of a text a window of at least ``width`` template words with
    ``least_fixed`` words besides placeholders is hashed, windows of fewer also as they stand; documents and items
    are joined on these hashes, and matching windows that follow each other are one passage. ``kind`` is
    'verbatim' if ``width`` or more consecutive words of the passage are the same, compared as text; 'other
    values' if ``width`` or more words, ``least_fixed`` of them no placeholders, only differ in placeholders that
    stand for each other one to one. For each document and item the verbatim, then longest, then first passage is
    given; ``first_word`` counts from 0.

    Null and empty texts, and texts shorter than a window, give nothing; documents are read whole. A
    repeated id of documents or items is one document or item with several texts.

    A filter of bounded size, broadcast, holds back windows that no item has. The passages that are left are
    compared once for each distinct text, in a hash join with the windows of the items, however many
    documents hold them and however many items there are.
    """
    hashed = _unit_hashes(UNITS if units is None else units)
    kind = dict(docs.dtypes)[doc_id]
    wanted = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    wanted = wanted.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    keys = stage(map_in_arrow(wanted, _item_windows(hashed, width, least_fixed), "item long, hash long").distinct(), "leak-items")
    shared = window_filter(keys.select("hash"))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    schema = f"doc {kind}, first long, passage string, opens boolean, hits array<long>"
    passages = stage(map_in_arrow(rows, _passages(hashed, width, least_fixed, shared), schema), "leak-passages")
    distinct = passages.groupBy("passage", "opens").agg(F.first("hits").alias("hits"))
    pairs = distinct.select("passage", "opens", F.explode("hits").alias("hash")).join(keys, "hash").select("passage", "opens", "item").distinct()
    pairs = pairs.join(wanted, "item").select("passage", "opens", "item", "text")
    compared = map_in_arrow(pairs, _compare(hashed, width, least_fixed), "passage string, opens boolean, item long, verbatim int, words int, inside long")
    best = F.max(F.struct("verbatim", "words", (-(F.col("first") + F.col("inside"))).alias("at")))
    found = passages.select("doc", "first", "passage", "opens").join(compared, ["passage", "opens"]).groupBy("doc", "item").agg(best.alias("b"))
    return found.select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.when(F.col("b.verbatim") == 1, "verbatim").otherwise("other values").alias("kind"),
        F.col("b.words").alias("words"), (-F.col("b.at")).alias("first_word"),
    )

"""Freely typed values mapped to the closest entry of a reference list by a set-similarity join."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from ..storage import stage
from .codepoints import code_points, folded_hashes, missing, mix
from .lookalike import LOOK_ALIKES

#: Buckets of the table of token rarities, which bounds what is broadcast.
RARITY_BUCKETS = 1 << 16
#: Bytes of the texts of a list up to which its index is broadcast; larger lists are joined.
INDEX_BYTES = 4_000_000
#: Parts into which the values of a token are cut in a join with a large list.
SALTS = 16
#: Jaccard similarity of their tokens, and share of letters that needn't be edited, for two texts to be the same name.
LEAST_JACCARD, LEAST_ALIKE = 0.5, 0.7
#: The same for taking a country for a place that stands in the wrong column.
LEAST_SWAPPED = 0.75
#: Letters of a text from which an edit makes a misspelling and not another text.
SHORTEST = 4
#: Keys that are looked up at once, and matches of their tokens held at once.
BLOCK_KEYS, BLOCK_MATCHES = 2048, 2_000_000

# Words that come before or after the name of a place without being part of it.
AFFIXES = ["center", "centre", "city", "municipality", "of", "town", "village"]
# The same for countries.
COUNTRY_AFFIXES = [
    "commonwealth", "democratic", "federal", "federation", "kingdom", "of", "peoples", "rep", "republic", "state",
    "states", "the", "union", "united",
]


@lru_cache(maxsize=1)
def _latin() -> dict[int, str]:
    return {ord(a): b for src, dst in LOOK_ALIKES for a, b in zip(src, dst, strict=True)}


def plain_letters(text: str) -> str:
    """Lower case without compatibility forms, look-alikes, accents and invisible characters."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)).translate(_latin())
    text = unicodedata.normalize("NFD", text).lower()
    return "".join([c for c in text if unicodedata.category(c) not in ("Mn", "Cf")]) if not text.isascii() else text


_WORD = re.compile(r"[^\W_]+")


def keys_of(text: str, affixes: frozenset[str]) -> list[str]:
    """The letters of a value, also without affixes at its ends, and with parts around a comma turned."""
    texts = [text]
    if "ν" in text or "Ν" in text:  # Greek nu is V in lower and N in upper case
        texts.append(text.translate({0x3BD: "n", 0x39D: "V"}))
    keys: dict[str, None] = {}
    for one in texts:
        low = plain_letters(one)
        turned = low.split(",")
        for order in [low] if len(turned) != 2 or not all(map(_WORD.search, turned)) else [low, f"{turned[1]} {turned[0]}"]:
            words = _WORD.findall(order)
            keys["".join(words)] = None
            lo, hi = 0, len(words)
            while hi - lo > 1 and (words[lo] in affixes or words[hi - 1] in affixes):
                lo, hi = (lo + 1, hi) if words[lo] in affixes else (lo, hi - 1)
            keys["".join(words[lo:hi])] = None
    return [k for k in keys if k]


def short_forms(text: str) -> list[str]:
    """Keys of an entry whose first word of several is shortened: initial, first and last letter, consonants."""
    words = _WORD.findall(plain_letters(text))
    if len(words) < 2:
        return []
    first, rest = words[0], "".join(words[1:])
    consonants = first[0] + re.sub(r"[aeiouy]", "", first[1:])
    return list(dict.fromkeys(f + rest for f in (first[0], first[0] + first[-1], re.sub(r"(.)\1+", r"\1", consonants))))


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment), by bit-parallel columns."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, zero, last, score = full, 0, 0, 0, len(a)
    for y in b:
        hit = places.get(y, 0)
        swap = ((~zero & hit) << 1) & last
        zero = ((((hit & up) + up) ^ up) | hit | down | swap) & full
        right, left = down | ~(zero | up) & full, zero & up
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(zero | right) & full, right & zero
        last = hit
    return score


def allowed_edits(letters: np.ndarray, least: float) -> np.ndarray:
    """Edits of a text of so many letters that leave the share ``least``; none of a text under SHORTEST letters."""
    return np.where(letters >= SHORTEST, np.floor((1 - least) * letters + 1e-9), 0).astype(np.int64)


def shared_tokens(size: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """Tokens that two sets of these sizes share at least if their texts are alike.

    So many as LEAST_JACCARD asks for; and as an edit changes three tokens at most (a letter and two pairs, or for a
    swap three pairs), so many as the allowed edits of the longer text leave.
    """
    jaccard = np.ceil(LEAST_JACCARD * (size + other) / (1 + LEAST_JACCARD) - 1e-9).astype(np.int64)
    longer = np.maximum(size, other)
    return np.maximum(jaccard, longer - 3 * allowed_edits(longer // 2, least))


@lru_cache(maxsize=4096)
def _prefix_overlap(size: int, least: float) -> int:
    """Tokens that a set of this size shares at least with that of any text it is alike to."""
    letters = size // 2
    others = np.arange(int(letters * least), int(letters / max(least, 0.01)) + 2)
    others = others[np.abs(others - letters) <= allowed_edits(np.maximum(others, letters), least)]
    return int(shared_tokens(np.int64(size), 2 * others + 1, least).min())


def token_sets(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all keys, where those of each begin): letters, and pairs of letters with those beyond both ends.

    Repeated ones are numbered, so that sets count them.
    """
    points, begins = code_points(keys)
    size = np.diff(begins)
    row = np.repeat(np.arange(len(size)), size)
    edge = np.uint64(0x1FFFFF)
    points = points.astype(np.uint64)
    cuts = np.r_[0, np.cumsum(2 * size + 1)]
    # the text with an edge at both ends; a pair begins at all but the last of its places
    padded = np.full(len(points) + 2 * len(size), edge, np.uint64)
    starts = begins[:-1] + 2 * np.arange(len(size))
    padded[np.arange(len(points)) + 2 * row + 1] = points
    pair_at = np.delete(np.arange(len(padded)), starts + size + 1) if len(size) else np.zeros(0, np.int64)
    pairs = padded[pair_at] << np.uint64(21) | padded[np.minimum(pair_at + 1, len(padded) - 1)] | np.uint64(1 << 63)
    pair_row = np.repeat(np.arange(len(size)), size + 1)
    code, owner = np.r_[points, pairs], np.r_[row, pair_row]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])] if len(code) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    number = np.arange(len(code)) - np.repeat(heads, np.diff(np.r_[heads, len(code)]))
    return mix(code + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), cuts


def ordered_tokens(keys: pa.Array, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """token_sets with the tokens of each key in the order of their rarity."""
    tokens, cuts = token_sets(keys)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    return tokens[np.lexsort((tokens, rarity[(tokens % np.uint64(RARITY_BUCKETS)).astype(np.int64)], owner))], cuts


def prefixes(cuts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, token's place in all) of the rare tokens of which a text that is alike enough has one."""
    size = np.diff(cuts)
    sizes, back = np.unique(size, return_inverse=True)
    overlap = np.array([_prefix_overlap(n, least) for n in sizes.tolist()], np.int64)[back] if len(sizes) else size
    width = np.clip(size - overlap + 1, 0, size)
    key = np.repeat(np.arange(len(size)), width)
    place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return key, place, cuts[key] + place


def token_marks(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """256 bits for each set, one of them set by each token."""
    out = np.zeros((len(cuts) - 1, 4), np.uint64)
    if len(tokens):
        bit = np.uint64(1) << (tokens >> np.uint64(58))
        for k in range(4):
            own = np.where(tokens >> np.uint64(56) & np.uint64(3) == k, bit, 0).astype(np.uint64)
            out[:, k] = np.bitwise_or.reduceat(own, np.minimum(cuts[:-1], len(own) - 1))  # every set has a token
    return out


def _in_scope(tokens: np.ndarray, scopes: np.ndarray) -> np.ndarray:
    return mix(tokens + scopes.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95))


class PrefixIndex:
    """The entries of a list by the rare tokens of their keys."""

    def __init__(self, refs: list[int], keys: list[str], scopes: list[int], least: float = LEAST_ALIKE) -> None:
        self.refs, self.keys, self.least = np.array(refs, np.int64), keys, least
        tokens, cuts = token_sets(pa.array(keys, pa.string()))
        self.rarity = np.bincount((tokens % np.uint64(RARITY_BUCKETS)).astype(np.int64), minlength=RARITY_BUCKETS)
        tokens, cuts = ordered_tokens(pa.array(keys, pa.string()), self.rarity)
        self.size = np.diff(cuts)
        key, place, at = prefixes(cuts, least)
        posts = _in_scope(tokens[at], np.array(scopes, np.int64)[key])
        order = np.argsort(posts, kind="stable")
        self.entry, self.place = key[order], place[order]
        self.posts, heads = np.unique(posts[order], return_index=True)
        self.begins = np.r_[heads, len(order)]
        self.marks = token_marks(tokens, cuts)
        owner = np.repeat(np.arange(len(keys)), self.size)
        self.members = np.sort(_in_scope(tokens, owner))

    def closest(self, keys: list[str], scopes: list[int], least: float) -> list[tuple[float, float, int] | None]:
        """(share of letters not edited, Jaccard similarity, -ref) of the closest entry of each key; ties to the smallest ref."""
        out: list = []
        for lo in range(0, len(keys), BLOCK_KEYS):
            out += self._block(keys[lo : lo + BLOCK_KEYS], np.array(scopes[lo : lo + BLOCK_KEYS], np.int64), max(least, self.least))
        return out

    def _block(self, keys: list[str], scopes: np.ndarray, least: float) -> list:
        tokens, cuts = ordered_tokens(pa.array(keys, pa.string()), self.rarity)
        size = np.diff(cuts)
        key, place, at = prefixes(cuts, self.least)
        probe = _in_scope(tokens[at], scopes[key])
        post = np.minimum(np.searchsorted(self.posts, probe), max(len(self.posts) - 1, 0))
        known = self.posts[post] == probe if len(self.posts) else np.zeros(len(probe), bool)
        left = self.begins[post]
        many = np.where(known, self.begins[np.minimum(post + 1, len(self.begins) - 1)] - left, 0)
        if many.sum() > BLOCK_MATCHES and len(keys) > 1:
            half = len(keys) // 2
            return self._block(keys[:half], scopes[:half], least) + self._block(keys[half:], scopes[half:], least)
        hit = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        v, e, pv, pe = np.repeat(key, many), self.entry[hit], np.repeat(place, many), self.place[hit]
        out: list = [None] * len(keys)
        if not len(v):
            return out
        code = v * len(self.keys) + e
        order = np.argsort(code, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        count = np.diff(np.r_[heads, len(order)])
        v, e = v[order][heads], e[order][heads]
        pv, pe = np.maximum.reduceat(pv[order], heads), np.maximum.reduceat(pe[order], heads)
        longer = np.maximum(size[v], self.size[e]) // 2
        need = shared_tokens(size[v], self.size[e], least)
        # what two keys share besides the tokens of both prefixes comes after the last of these in both
        keep = count + np.minimum(size[v] - pv, self.size[e] - pe) - 1 >= need
        keep &= np.abs(size[v] - self.size[e]) // 2 <= allowed_edits(longer, least)
        v, e, longer, need = v[keep], e[keep], longer[keep], need[keep]
        # a mark of one that the other lacks stands for a token at least that they don't share
        ours, theirs = token_marks(tokens, cuts)[v], self.marks[e]
        lost = np.bitwise_count(ours & ~theirs).sum(axis=1, dtype=np.int64), np.bitwise_count(theirs & ~ours).sum(axis=1, dtype=np.int64)
        keep = np.minimum(size[v] - lost[0], self.size[e] - lost[1]) >= need
        v, e, longer, need = v[keep], e[keep], longer[keep], need[keep]
        both = self._common(tokens, cuts, v, e)
        keep = both >= need
        v, e, longer, both = v[keep], e[keep], longer[keep], both[keep]
        jaccard = both / (size[v] + self.size[e] - both)
        bound = 1 - -(-(2 * longer + 1 - both) // 3) / longer
        order = np.lexsort((self.refs[e], -jaccard, -bound, v))
        allowed = allowed_edits(longer, least)
        for k in order.tolist():
            own, ref = int(v[k]), int(self.refs[e[k]])
            best = out[own]
            if best is not None and (bound[k], jaccard[k], -ref) <= best:
                continue
            a, b = keys[own], self.keys[int(e[k])]
            needed = 0 if a == b else edits(a, b)
            if needed <= allowed[k]:
                found = (1 - needed / int(longer[k]), float(jaccard[k]), -ref)
                if best is None or found > best:
                    out[own] = found
        return out

    def _common(self, tokens: np.ndarray, cuts: np.ndarray, v: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Tokens that key v and entry e share."""
        size = np.diff(cuts)[v]
        owner = np.repeat(np.arange(len(v)), size)
        at = np.repeat(cuts[v], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wanted = _in_scope(tokens[at], e[owner])
        near = np.minimum(np.searchsorted(self.members, wanted), len(self.members) - 1)
        return np.bincount(owner, self.members[near] == wanted, minlength=len(v)).astype(np.int64)

    def map(self, values: list[str], scopes: list[int], least: float, affixes: frozenset[str]) -> list[tuple[float, float, int] | None]:
        """What closest gives for the best key of each value."""
        number: dict[tuple[str, int], int] = {}
        own = [[number.setdefault((key, scope), len(number)) for key in keys_of(value, affixes)] for value, scope in zip(values, scopes, strict=True)]
        found = self.closest([k for k, _ in number], [s for _, s in number], least)
        return [max([found[k] for k in ks if found[k] is not None], default=None) for ks in own]


def _entry_keys(ref: int, text: str, scope: int | None) -> list[tuple[int, str, int]]:
    keys = dict.fromkeys([*keys_of(text, frozenset())[:1], *short_forms(text)])
    return [(ref, key, s) for key in keys for s in sorted({scope or 0, 0})]


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [x for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for x in _entry_keys(*row)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)],
                names=["ref_id", "key", "scope"],
            )


def _entry_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, _ = token_sets(batch.column(0))
        counts = np.bincount((tokens % np.uint64(RARITY_BUCKETS)).astype(np.int64), minlength=RARITY_BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at].astype(np.int64))], names=["bucket", "n"])


@dataclass
class Entries:
    """A reference list made ready: an index that is broadcast, or for large lists staged keys to be joined."""

    least: float
    index: Broadcast | None
    keys: DataFrame | None = None
    rarity: Broadcast | None = None

    @classmethod
    def of(cls, entries: DataFrame, least: float = LEAST_ALIKE) -> Entries:
        """From a list (ref_id, text, scope); null ids and texts are left out. ``least`` is the lowest share to be asked for."""
        listed = entries.where("text is not null and ref_id is not null")
        listed = listed.select(F.col("ref_id").cast("long"), F.col("text").cast("string"), F.col("scope").cast("long"))
        context = entries.sparkSession.sparkContext
        # 64 bytes an entry besides its text, which bounds what is collected here
        size = listed.agg(F.sum(64 + F.octet_length("text"))).first()[0] or 0
        if size <= INDEX_BYTES:
            rows = sorted({x for row in listed.collect() for x in _entry_keys(*row)})
            return cls(least, context.broadcast(PrefixIndex([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], least)))
        keys = map_in_arrow(listed, _entry_rows, "ref_id long, key string, scope long").distinct()
        keys = stage(keys.select(F.monotonically_increasing_id().alias("id"), "ref_id", "key", "scope"), "canonical-entries")
        rarity = np.zeros(RARITY_BUCKETS, np.int64)
        counts = map_in_arrow(keys.select("key"), _entry_tokens, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        for bucket, n in counts.collect():  # at most RARITY_BUCKETS rows
            rarity[bucket] = n
        return cls(least, None, keys, context.broadcast(rarity))


def _value_keys(affixes: frozenset[str]):
    """(vid, value, scope) to one row for each key of the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(v, affixes) for v in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            flat = pa.array([k for own in keys for k in own], pa.string())
            scope = batch.column(2).fill_null(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), flat, scope.take(at)], names=["vid", "key", "scope"])

    return run


def _prefix_rows(shared: Broadcast, least: float):
    """(id, key, scope) to one row (id, scope, token, place, size) for each prefix token of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, cuts = ordered_tokens(batch.column(1), shared.value)
            key, place, at = prefixes(cuts, least)
            rows = pa.array(key)
            columns = [pa.array(tokens[at].view(np.int64)), pa.array(place.astype(np.int32)), pa.array(np.diff(cuts)[key].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), *columns], names=["id", "scope", "token", "place", "size"])

    return run


def _keep_best(least: float):
    """Over candidates (key, scope, ref_id, ref_key) sorted by (key, scope): the closest entry of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, own, done = None, None, {}, []

        def out() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "scope", "ref_id", "jaccard", "share"])

        for batch in batches:
            refs = batch.column(3).dictionary_encode()
            sets, cuts = token_sets(refs.dictionary)
            for key, scope, ref, k in zip(*[c.to_pylist() for c in batch.columns[:3]], refs.indices.to_pylist(), strict=True):
                if (key, scope) != last:
                    if best is not None:
                        done.append((*last, -best[2], best[1], best[0]))
                    last, best, own = (key, scope), None, set(token_sets(pa.array([key]))[0].tolist())
                other = refs.dictionary[k].as_py()
                theirs = sets[cuts[k] : cuts[k + 1]].tolist()
                both = sum(t in own for t in theirs)
                jaccard, longer = both / (len(own) + len(theirs) - both), max(len(key), len(other))
                if both < shared_tokens(np.int64(len(own)), np.int64(len(theirs)), least):
                    continue
                if best is not None and (1 - -(-(2 * longer + 1 - both) // 3) / longer, jaccard, -ref) <= best:
                    continue
                needed = 0 if key == other else edits(key, other)
                if needed <= allowed_edits(np.int64(longer), least) and (best is None or (1 - needed / longer, jaccard, -ref) > best):
                    best = (1 - needed / longer, jaccard, -ref)
            if len(done) > 10_000:
                yield out()
                done.clear()
        if best is not None:
            done.append((*last, -best[2], best[1], best[0]))
        if done:
            yield out()

    return run


def _closest(keys: DataFrame, entries: Entries, least: float) -> DataFrame:
    """The closest entry of each distinct (key, scope), by a prefix-filter join with a large list."""
    keys = stage(keys.select(F.monotonically_increasing_id().alias("id"), "key", "scope"), "canonical-distinct")
    tokens = "id long, scope long, token long, place int, size int"
    left = map_in_arrow(keys, _prefix_rows(entries.rarity, least), tokens)
    right = map_in_arrow(entries.keys.select("id", "key", "scope"), _prefix_rows(entries.rarity, least), tokens)
    right = right.withColumnsRenamed({"id": "_id", "place": "_place", "size": "_size"})
    # a token that very many values hold is cut into parts by the values
    left = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    longer = F.floor(F.greatest("size", "_size") / 2)
    allowed = F.when(longer >= SHORTEST, F.floor((1 - least) * longer + 1e-9)).otherwise(0)
    near = F.floor(F.abs(F.col("size") - F.col("_size")) / 2) <= allowed
    # holds for the first token two keys share in the order of rarity, so no pair is lost
    asked = F.ceil(LEAST_JACCARD / (1 + LEAST_JACCARD) * (F.col("size") + F.col("_size")) - 1e-9)
    needed = F.greatest(asked, F.greatest("size", "_size") - 3 * allowed)
    reachable = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) >= needed
    candidates = left.join(right, ["scope", "token", "salt"]).where(near & reachable).select("id", "_id").distinct()
    theirs = entries.keys.select(F.col("id").alias("_id"), "ref_id", F.col("key").alias("ref_key"))
    candidates = candidates.join(keys, "id").join(theirs, "_id").select("key", "scope", "ref_id", "ref_key")
    sorted_ = candidates.repartition("key", "scope").sortWithinPartitions("key", "scope")
    return map_in_arrow(sorted_, _keep_best(least), "key string, scope long, ref_id long, jaccard double, share double")


def _mapped(shared: Broadcast, least: float, affixes: frozenset[str]):
    """(value, scope) to (value, scope, ref_id, jaccard, share) of those that have an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.map(batch.column(0).to_pylist(), batch.column(1).fill_null(0).to_pylist(), least, affixes)
            at = [k for k, f in enumerate(found) if f is not None]
            columns = [pa.array([-found[k][2] for k in at], pa.int64()), *[pa.array([found[k][n] for k in at], pa.float64()) for n in (1, 0)]]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in batch.columns], *columns], names=["value", "scope", "ref_id", "jaccard", "share"])

    return run


def map_values(values: DataFrame, entries: DataFrame | Entries, least: float = LEAST_ALIKE, affixes: list[str] | None = None) -> DataFrame:
    """(value, scope, ref_id, jaccard, share) for the distinct ``values`` (value, scope) that have an entry.

    ``entries`` (ref_id, text, scope), or Entries made of it, may list several texts of one entry. A value with a scope is only
    compared to entries of that scope, one without (null) to all. Both become sets of letters and pairs of
    letters, counted, without letter case, accents, look-alikes, white space and punctuation. Of the entries with a Jaccard
    similarity of LEAST_JACCARD or more the closest is the one that needs the smallest share of letters edited
    (changed, left out, put in or swapped with a neighbour), at most 1 - ``least``; on ties that of the
    highest similarity, then the smallest ref_id. Texts under SHORTEST letters must be equal.

    The join loses no such entry: similarity and edits give the overlap that two sets must have; tokens are ordered by
    global rarity, only prefixes long enough for that overlap are joined, candidates pass length and
    positional filters, and overlap, similarity and edits are computed exactly. Lists of up to INDEX_BYTES are an
    index that is broadcast and probed where the values lie; larger ones are hash-joined on their tokens.

    Values without a letter or digit and null values have no entry; an empty list maps nothing.
    """
    words = frozenset(AFFIXES if affixes is None else affixes)
    entries = entries if isinstance(entries, Entries) else Entries.of(entries, least)
    if least < entries.least:
        raise ValueError(f"the list was made ready for shares of {entries.least} or more")
    given = values.where("value is not null").select(F.col("value").cast("string").alias("value"), F.col("scope").cast("long").alias("scope"))
    if entries.index is not None:
        return map_in_arrow(given, _mapped(entries.index, least, words), "value string, scope long, ref_id long, jaccard double, share double")
    named = stage(given.select(F.monotonically_increasing_id().alias("vid"), "value", "scope"), "canonical-values")
    keyed = stage(map_in_arrow(named.select("vid", "value", "scope"), _value_keys(words), "vid long, key string, scope long"), "canonical-keys")
    found = _closest(keyed.select("key", "scope").distinct(), entries, least)
    best = keyed.join(found, ["key", "scope"]).groupBy("vid").agg(F.max(F.struct("share", "jaccard", (-F.col("ref_id")).alias("ref"))).alias("b"))
    return named.join(best, "vid").select("value", "scope", (-F.col("b.ref")).alias("ref_id"), F.col("b.jaccard").alias("jaccard"), F.col("b.share").alias("share"))


def _flags(batch: pa.RecordBatch) -> list[pa.Array]:
    """For each column whether its text is missing."""
    flags = []
    for column in batch.columns:
        coded = column.dictionary_encode()
        gone = missing(coded.dictionary, folded_hashes(coded.dictionary))
        flags.append(pa.array(gone).take(coded.indices).fill_null(True))
    return flags


def _missing_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, *_flags(batch)], names=["city", "country", "no_city", "no_country"])


class _Cache:
    """Values that were mapped before in this task."""

    def __init__(self, index: PrefixIndex, least: float, affixes: list[str]) -> None:
        self.index, self.least, self.affixes = index, least, frozenset(affixes)
        self.known: dict = {}

    def __call__(self, wanted: list[tuple[str, int]]) -> dict:
        if len(self.known) > 200_000:
            self.known.clear()
        new = [x for x in dict.fromkeys(wanted) if x not in self.known]
        if new:
            self.known.update(zip(new, self.index.map([v for v, _ in new], [s for _, s in new], self.least, self.affixes), strict=True))
        return self.known


def _pair_cases(places: Broadcast, countries: Broadcast, lists: Broadcast):
    """Distinct (city, country) to one row (city, country, field_name, ref_id) for each case; see canonical_places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, codes = lists.value
        land = _Cache(countries.value, LEAST_ALIKE, COUNTRY_AFFIXES)
        swapped_land, swapped_place = _Cache(places.value, LEAST_SWAPPED, AFFIXES), land
        town = _Cache(places.value, LEAST_ALIKE, [*AFFIXES, *codes])
        for batch in batches:
            no_city, no_country = (f.to_pylist() for f in _flags(batch))
            rows = list(enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)))
            odd_city = [not no_city[k] and c not in names for k, (c, _) in rows]
            odd_country = [not no_country[k] and c not in ids for k, (_, c) in rows]
            found = land([(c, 0) for k, (_, c) in rows if odd_country[k]])
            meant = [found[c, 0] if odd_country[k] else None for k, (_, c) in rows]
            # values that have changed places; a place may be like a country, but not have its very letters
            strange = [k for k, _ in rows if odd_city[k] and odd_country[k] and (meant[k] is None or meant[k][0] < 1)]
            like = swapped_land([(rows[k][1][1], 0) for k in strange])
            strange = [k for k in strange if like[rows[k][1][1], 0] is not None]
            like = swapped_place([(rows[k][1][0], 0) for k in strange])
            swapped = {k for k in strange if like[rows[k][1][0], 0] is not None}
            scope = [ids.get(c, 0) if not no_country[k] and c in ids else -meant[k][2] if meant[k] else 0 for k, (_, c) in rows]
            wanted = [k for k, _ in rows if odd_city[k] and k not in swapped]
            found = town([(rows[k][1][0], scope[k]) for k in wanted])
            at, fields, refs = [], [], []
            for k in wanted:
                best = found[rows[k][1][0], scope[k]]
                at.append(k)
                fields.append("city")
                refs.append(-1 if best is None else -best[2])
            for k, _ in rows:
                if odd_country[k] and k not in swapped:
                    at.append(k)
                    fields.append("country")
                    refs.append(-1 if meant[k] is None else -meant[k][2])
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(taken) for c in batch.columns], pa.array(fields, pa.string()), pa.array(refs, pa.int64())],
                names=["city", "country", "field_name", "ref_id"],
            )

    return run


def _joined_cases(pairs: DataFrame, place_entries: Entries, country_entries: Entries, exact_city: DataFrame, exact_country: DataFrame, codes: list[str]) -> DataFrame:
    """What _pair_cases gives, by joins with lists that are too large for an index."""
    flagged = map_in_arrow(pairs, _missing_flags, "city string, country string, no_city boolean, no_country boolean")
    pairs = stage(flagged.join(exact_city, "city", "left").join(exact_country, "country", "left"), "canonical-pairs")
    none = F.lit(None).cast("long").alias("scope")
    odd_country, odd_city = "not no_country and exact_country is null", "not no_city and city_ok is null"
    known = map_values(pairs.where(odd_country).select(F.col("country").alias("value"), none).distinct(), country_entries, affixes=COUNTRY_AFFIXES)
    known = stage(known, "canonical-countries").select(F.col("value").alias("country"), F.col("ref_id").alias("odd_country"), F.col("share").alias("odd_share"))
    pairs = stage(pairs.join(known, "country", "left").withColumn("country_ref", F.coalesce("exact_country", "odd_country")), "canonical-pairs-known")

    strangers = pairs.where(f"{odd_country} and {odd_city} and coalesce(odd_share, 0) < 1")
    as_place = map_values(strangers.select(F.col("country").alias("value"), none).distinct(), place_entries, LEAST_SWAPPED)
    maybe = stage(strangers.join(as_place.select(F.col("value").alias("country")).distinct(), "country", "left_semi"), "canonical-strangers")
    as_country = map_values(maybe.select(F.col("city").alias("value"), none).distinct(), country_entries, affixes=COUNTRY_AFFIXES)
    swapped = maybe.join(as_country.select(F.col("value").alias("city")), "city", "left_semi").select("city", "country", F.lit(True).alias("swapped"))

    odd = pairs.where(odd_city).select(F.col("city").alias("value"), F.col("country_ref").alias("scope")).distinct()
    found = map_values(odd, place_entries, affixes=[*AFFIXES, *codes])
    found = stage(found, "canonical-cities").select(F.col("value").alias("city"), F.col("scope").alias("country_ref"), F.col("ref_id").alias("odd_city"))
    matched = pairs.alias("p").join(
        found.alias("f"), (F.col("p.city") == F.col("f.city")) & F.col("p.country_ref").eqNullSafe(F.col("f.country_ref")), "left"
    ).select("p.*", "f.odd_city")
    matched = matched.join(swapped, ["city", "country"], "left").where("swapped is null")
    case = lambda test, name: F.when(F.expr(test), F.struct(F.lit(name).alias("field_name"), F.coalesce(f"odd_{name}", F.lit(-1).cast("long")).alias("ref_id")))
    cases = F.array_compact(F.array(case(odd_city, "city"), case(odd_country, "country")))
    return matched.select("city", "country", F.explode(cases).alias("c")).select("city", "country", "c.*")


def canonical_places(
    df: DataFrame, id_col: str, places: DataFrame, countries: DataFrame, city: str = "city", country: str = "country"
) -> DataFrame:
    """(id, field_name, ref_id) for each value of city and country that isn't spelled as in the lists.

    ``places`` has place_id, city, alt_name, country_id; ``countries`` country_id, country, code. ref_id is the
    entry meant, -1 if none is. A city is looked for among the places of the row's country where
    that is known. Missing values (null, blank, filler) are no case; rows that hold a country as
    city and a place as country are left out. Rows without an id are left out.

    Only distinct pairs of values are matched, so a frequent value costs no more than a rare one;
    rows are then joined to the distinct pairs.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(city).alias("city"), F.col(country).alias("country"))
    exact_city = places.where("city is not null").select("city").distinct().withColumn("city_ok", F.lit(True))
    exact_country = countries.where("country is not null").groupBy("country").agg(F.min("country_id").cast("long").alias("exact_country"))
    odd = rows.join(exact_city, "city", "left").join(exact_country, "country", "left")
    odd = odd.where("(city is not null and city_ok is null) or (country is not null and exact_country is null)")
    # spread by number, as matching takes far longer than these few bytes would suggest
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = odd.select("city", "country").distinct().repartition(parts, "city", "country")
    country_entries = Entries.of(countries.select(F.col("country_id").alias("ref_id"), F.explode(F.array("country", "code")).alias("text"), F.lit(0).alias("scope")))
    place_entries = Entries.of(places.select(F.col("place_id").alias("ref_id"), F.explode(F.array("city", "alt_name")).alias("text"), F.col("country_id").alias("scope")))
    codes = []
    if country_entries.index is not None:  # a list of countries that is that large has no codes to be told from names
        codes = [r[0].lower() for r in countries.where("code is not null").select("code").distinct().collect()]
    if place_entries.index is not None and country_entries.index is not None:
        # both lists are bounded by INDEX_BYTES
        lists = ({r[0] for r in exact_city.select("city").collect()}, {r[0]: r[1] for r in exact_country.collect()}, codes)
        shared = df.sparkSession.sparkContext.broadcast(lists)
        cases = map_in_arrow(pairs, _pair_cases(place_entries.index, country_entries.index, shared), "city string, country string, field_name string, ref_id long")
    else:
        cases = _joined_cases(pairs, place_entries, country_entries, exact_city, exact_country, codes)
    hit = odd.alias("r").join(cases.alias("m"), F.col("r.city").eqNullSafe(F.col("m.city")) & F.col("r.country").eqNullSafe(F.col("m.country")))
    return hit.select(F.col("r._id").alias(id_col), "m.field_name", "m.ref_id")

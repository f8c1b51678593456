"""Subject areas of documents: complement naive Bayes, refined on unlabelled documents and calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from ..storage import stage
from .codepoints import mix, span_hashes
from .words import chunks

#: Labelled documents that the model is fitted on, the first by hashed id.
MAX_LABELLED = 4_000
#: Terms of the model, the ones in most documents.
MAX_TERMS = 1 << 16
#: Documents that must contain a term of the model.
LEAST_DOCUMENTS = 3
#: Passes over the unlabelled documents.
EM_STEPS = 2
#: Pseudo-documents of the complement that hold a term.
SMOOTHING = 0.5
#: Fits of the calibration, how far a label may be from one before the next leaves it out, and the share left out at most.
CALIBRATION_FITS, CLEARLY_WRONG, WRONG_SHARE = 3, 0.75, 0.01
#: Parts of the labelled documents; each is judged by a model fitted on the others.
FOLDS = 4
#: Labels that a subject's own calibration takes to move away from the shared one.
SHARED_WEIGHT = 4.0
#: Log-odds from which a term speaks for a subject at all, and from which it casts a whole vote.
LEAST_CONTRAST, FULL_CONTRAST = 1.5, 3.0

_LETTER = np.zeros(256, np.uint8)  # 1: lower case and bytes of other scripts, 2: upper case
_LETTER[ord("a") : ord("z") + 1] = 1
_LETTER[128:] = 1
_LETTER[ord("A") : ord("Z") + 1] = 2
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[ord("A") : ord("Z") + 1] += np.uint64(32)
_VALUES = mix(_FOLDED + np.uint64(0x3C6EF372))
_SHORTEST, _LONGEST = 3, 40


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, its row) of some texts.

    Terms are runs of letters, lower-cased, cut where a lower-case letter is followed by an
    upper-case one, so that the words of an identifier count one by one.
    """
    kind = _LETTER[data]
    inside = kind > 0
    starts, stops = inside.copy(), inside.copy()
    fresh = ~inside[:-1] | ((kind[:-1] == 1) & (kind[1:] == 2))
    starts[1:] &= fresh
    stops[:-1] &= ~inside[1:] | fresh
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    begins, ends = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    fit = (ends - begins >= _SHORTEST) & (ends - begins <= _LONGEST)
    begins, ends = begins[fit], ends[fit]
    return mix(span_hashes(data, begins, ends, _VALUES)), np.searchsorted(offsets, begins, "right") - 1


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and the number of documents of this task that hold them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return terms, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            terms, rows = terms_of(data, offsets)
            pairs = terms * np.uint64(0x9E3779B97F4A7C15) + rows.astype(np.uint64)
            _, first = np.unique(pairs, return_index=True)
            held.append(np.unique(terms[first], return_counts=True))
        if len(held) > 32:
            held = [merged()]
            if len(held[0][0]) > 1_000_000:
                yield from _as_rows(*held[0])
                held = []
    if held:
        yield from _as_rows(*merged())


def _as_rows(terms: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(terms), 100_000):
        part = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(terms[part].view(np.int64)), pa.array(counts[part])], names=["term", "n"])


@dataclass
class Vocabulary:
    """Places of terms by their hashes: tables over the upper bits, each term in the first table where its place is free."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.hashes))
        while len(left):
            table = np.full(1 << 20, -1, np.int32)
            slot = (self.hashes[left] >> np.uint64(44)).astype(np.int64)
            table[slot] = left  # of several the last stays
            self.tables.append(table)
            left = left[table[slot] != left]

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term, -1 for others."""
        slot = (terms >> np.uint64(44)).astype(np.int64)
        out = np.full(len(terms), -1, np.int32)
        for table in self.tables:
            place = table[slot]
            out = np.where((place >= 0) & (self.hashes[place] == terms), place, out)
        return out


def _features(shared):
    """(id, text) to (id, distinct places of the model's terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        size = max(1, len(vocabulary.hashes))
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                terms, rows = terms_of(data, offsets)
                place = vocabulary.find(terms)
                known = np.unique(rows[place >= 0].astype(np.int64) * size + place[place >= 0])
                cuts = np.searchsorted(known, np.arange(hi - lo + 1) * size).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array((known % size).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists], names=["id", "terms"])

    return run


class SubjectModel:
    """Complement naive Bayes over sets of terms, with calibrated independent posteriors."""

    def __init__(self, subjects: list[str]) -> None:
        self.subjects = subjects
        self.contrast = np.zeros((len(subjects), 0), np.float32)
        self.calibration = np.zeros((len(subjects), 2))

    def fit_terms(self, counts: np.ndarray, documents: np.ndarray, total: np.ndarray, all_documents: float) -> None:
        """From documents (weights) of each subject holding each term, and of all documents.

        The contrast of a term for a subject is the log of the term's share in the subject's
        documents, less one standard error of its count, against its share in the complement, all other
        documents: a term seen once or never says nothing, however small the subject.
        """
        sure = np.maximum(counts - np.sqrt(np.maximum(counts, 0)), 0)
        own = (sure + 1e-6) / np.maximum(documents, 1)[:, None]
        rest = (np.maximum(total - counts, 0) + SMOOTHING) / (np.maximum(all_documents - documents, 0)[:, None] + SMOOTHING)
        self.contrast = np.log(own / rest).astype(np.float32)

    def evidence(self, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Votes of the terms of each document for each subject.

        A term casts at most one vote, so that evidence takes several terms, not one very strong one.
        """
        votes = np.clip((self.contrast - LEAST_CONTRAST) / (FULL_CONTRAST - LEAST_CONTRAST), 0, 1).T
        total = np.zeros((len(flat) + 1, len(self.subjects)))
        np.cumsum(votes[flat], axis=0, out=total[1:])
        return total[cuts[1:]] - total[cuts[:-1]]

    def calibrate(self, evidence: np.ndarray, truth: np.ndarray) -> None:
        """Logistic regressions of the labels on the logarithm of the votes: one of all subjects, and one of each.

        ``evidence`` of a document is that of a model that hasn't seen its labels. A subject's own regression is drawn
        to the shared one, the more the fewer labels it has. The share of a subject in a document is no input: every
        labelled document has a subject, so a large share would speak for one even where next to nothing does. Labels
        that the shared fit clearly contradicts are taken for wrong and left out of the next of a few fits.
        """
        x, y = np.log1p(evidence), truth.astype(float)
        mean, scale = x.mean(), x.std() + 1e-9
        z = np.stack([np.ones_like(x), (x - mean) / scale], axis=-1)
        kept = np.ones(y.shape, bool)
        nothing = np.zeros(2)
        for _ in range(CALIBRATION_FITS):
            shared = _logistic(z[kept], y[kept], nothing, np.array([0.0, 1.0]))
            off = np.abs(y - _sigmoid(z @ shared))
            kept = off < max(CLEARLY_WRONG, float(np.quantile(off, 1 - WRONG_SHARE)))
        for s in range(len(self.subjects)):
            own = kept[:, s]
            beta = _logistic(z[own, s], y[own, s], shared, np.full(2, SHARED_WEIGHT))
            self.calibration[s] = beta[0] - beta[1] * mean / scale, beta[1] / scale

    def posteriors(self, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return self.calibrated(self.evidence(flat, cuts))

    def calibrated(self, evidence: np.ndarray) -> np.ndarray:
        return np.where(evidence > 0, _sigmoid(self.calibration[:, 0] + self.calibration[:, 1] * np.log1p(evidence)), 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(z: np.ndarray, y: np.ndarray, centre: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression, pulled to a centre, by Newton steps of bounded size."""
    beta = centre.copy()
    for _ in range(50):
        p = _sigmoid(z @ beta)
        gradient = z.T @ (y - p) - pull * (beta - centre)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-6), gradient)
        beta = beta + step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Labelled:
    """The terms and subjects of the labelled documents, and the part each of them belongs to."""

    flat: np.ndarray
    cuts: np.ndarray
    truth: np.ndarray
    fold: np.ndarray
    terms: int

    def counts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(shares of documents of each subject holding each term, of each subject, documents) over some documents."""
        share = self.truth / np.maximum(self.truth.sum(axis=1, keepdims=True), 1) * rows[:, None]
        weights = np.repeat(share, np.diff(self.cuts), axis=0)
        found = [np.bincount(self.flat, weights[:, s], minlength=self.terms) for s in range(self.truth.shape[1])]
        return np.stack(found), share.sum(axis=0), float(rows.sum())

    def model(self, subjects: list[str], more: np.ndarray) -> SubjectModel:
        """Fitted on all, calibrated by what models of the other parts say of each part.

        ``more`` holds what the unlabelled documents add: terms by subject, the last row for all of them, and in the last
        column the documents.
        """

        def fit(rows: np.ndarray) -> SubjectModel:
            counts, documents, n = self.counts(rows)
            out = SubjectModel(subjects)
            out.fit_terms(counts + more[:-1, :-1], documents + more[:-1, -1], counts.sum(axis=0) + more[-1, :-1], n + more[-1, -1])
            return out

        everyone = np.ones(len(self.truth))
        evidence = np.zeros(self.truth.shape)
        parts = np.unique(self.fold)
        for part in parts:
            own = self.fold == part
            judged = fit(everyone - own if len(parts) > 1 else everyone)
            evidence[own] = judged.evidence(self.flat, self.cuts)[own]
        out = fit(everyone)
        out.calibrate(evidence, self.truth)
        self.held_out = out.calibrated(evidence)
        return out


def reliability(posteriors: np.ndarray, truth: np.ndarray, bins: int = 5) -> list[tuple[float, float, int]]:
    """(mean posterior, share that is true, number) of equal ranges of posteriors."""
    at = np.minimum((posteriors * bins).astype(int), bins - 1)
    return [(float(posteriors[at == k].mean()), float(truth[at == k].mean()), int((at == k).sum())) for k in range(bins) if (at == k).any()]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cuts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0]


def _expected_counts(shared):
    """Expected documents of each subject holding each term, over the documents of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SubjectModel = shared.value
        subjects, size = model.contrast.shape
        counts, documents = np.zeros((subjects + 1, size)), np.zeros(subjects + 1)
        for batch in batches:
            flat, cuts = _lists(batch.column(0))
            if not len(cuts) > 1:
                continue
            p = np.c_[model.posteriors(flat, cuts), np.ones(len(cuts) - 1)]
            documents += p.sum(axis=0)
            weights = np.repeat(p, np.diff(cuts), axis=0)
            for s in range(subjects + 1):
                counts[s] += np.bincount(flat, weights[:, s], minlength=size)
        both = np.c_[counts, documents]
        subject, place = np.nonzero(both > 1e-6)
        yield pa.RecordBatch.from_arrays(
            [pa.array(subject.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(both[subject, place])], names=["subject", "place", "n"]
        )

    return run


def _assign(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SubjectModel = shared.value
        for batch in batches:
            flat, cuts = _lists(batch.column(1))
            p = model.posteriors(flat, cuts)
            row, subject = np.nonzero(p >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(model.subjects).take(pa.array(subject)), pa.array(p[row, subject])],
                names=["id", "subject", "posterior"],
            )

    return run


def _labelled(features: pa.Table, labels: dict, subjects: int, terms: int) -> Labelled:
    """The collected features of labelled documents; ``labels`` come in the order of hashed ids."""
    ids = features.column("id").to_pylist()
    lists = features.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, cuts = _lists(lists)
    truth = np.zeros((len(ids), subjects))
    for k, own in enumerate(ids):
        truth[k, list(labels[own])] = 1
    place = {own: k for k, own in enumerate(labels)}
    return Labelled(flat, cuts, truth, np.array([place[own] % FOLDS for own in ids], np.int64), terms)


def subject_areas(
    docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label: str = "subject",
    max_labelled: int = MAX_LABELLED, em_steps: int = EM_STEPS, least: float = 0.5,
) -> DataFrame:
    """(doc_id, subject, posterior) for each subject a document deals with at a posterior of ``least`` or more.

    ``labels`` (doc_id, label) has one row for each subject of a labelled document. Terms are the words of
    identifiers, comments and strings, each counted once a document; how many documents hold a
    term is counted over all documents. A complement naive Bayes model is fitted on at most ``max_labelled``
    labelled documents, the first by hashed id, then refined by ``em_steps`` passes of
    expectation-maximization over all other documents. Each subject's posterior is calibrated on its own by
    the votes of a document's terms for it, on labels that the judging model wasn't fitted on, so that a document
    may have several subjects or none.

    Documents with null or empty text, or without a term that speaks for a subject, get no row;
    labels of unknown documents and null labels are disregarded. Without labels there is no row.
    Repeated documents count and come out as often as they occur.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    given = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).alias("label")).distinct()
    sample = given.groupBy("id").agg(F.collect_set("label").alias("labels")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    own = sample.collect()  # at most max_labelled rows
    names = sorted({x for r in own for x in r["labels"]})
    number = {x: n for n, x in enumerate(names)}
    wanted = {r["id"]: {number[x] for x in r["labels"]} for r in own}

    counted = map_in_arrow(rows.select("text"), _document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.col("n").desc(), "term").limit(MAX_TERMS)
    hashes = np.sort(np.array([r[0] for r in top.select("term").collect()], np.int64)).view(np.uint64)
    features = stage(map_in_arrow(rows, _features(spark.sparkContext.broadcast(hashes)), f"id {kind}, terms array<int>"), "subject-features")

    # max_labelled bounds what is broadcast and collected here
    ids = spark.createDataFrame([(x,) for x in wanted], f"id {kind}")
    known = _labelled(features.join(F.broadcast(ids), "id", "left_semi").toArrow(), wanted, len(names), len(hashes))
    if names and len(known.truth):
        more = np.zeros((len(names) + 1, len(hashes) + 1))
        model = known.model(names, more)
        others = features.join(F.broadcast(ids), "id", "left_anti").select("terms")
        for _ in range(em_steps):
            shared = spark.sparkContext.broadcast(model)
            expected = map_in_arrow(others, _expected_counts(shared), "subject int, place int, n double")
            summed = expected.groupBy("subject", "place").agg(F.sum("n").alias("n")).toArrow()  # subjects times terms
            more = np.zeros_like(more)
            more[summed.column("subject").to_numpy(), summed.column("place").to_numpy()] = summed.column("n").to_numpy()
            model = known.model(names, more)
    else:
        model = SubjectModel(names)
        model.contrast = np.zeros((len(names), len(hashes)), np.float32)
    found = map_in_arrow(features, _assign(spark.sparkContext.broadcast(model), least), f"id {kind}, subject string, posterior double")
    return found.withColumnRenamed("id", doc_id)

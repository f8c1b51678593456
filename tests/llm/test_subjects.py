import random

import numpy as np
import pyarrow as pa
import pytest

from scourline.llm import subjects as B
from scourline.llm.subjects import Vocabulary, subject_areas, terms_of
from scourline.llm.words import chunks

TOPICS = {s: [f"{s}{chr(97 + k)}{chr(97 + (k * 7) % 26)}" for k in range(20)] for s in ("law", "sport", "music")}
COMMON = [f"common{chr(97 + k)}" for k in range(26)]


def corpus(n, seed):
    rng, docs, truth = random.Random(seed), [], {}
    for d in range(n):
        own = rng.sample(sorted(TOPICS), 0 if d % 25 == 0 else 2 if d % 6 == 0 else 1)
        words = [rng.choice(COMMON) for _ in range(30)] + [rng.choice(TOPICS[s]) for s in own for _ in range(20)]
        if own and d % 7 == 0:
            words.append(rng.choice(TOPICS[rng.choice(sorted(TOPICS))]))  # a passing mention
        rng.shuffle(words)
        if not own:
            words = "keep this notice in every copy nothing here comes with any promise".split()  # never labelled
        docs.append((d, "".join(map(str.capitalize, words)) if d % 2 else "_".join(words)))
        truth[d] = set(own)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(1200, 10)
    rng = random.Random(11)
    labels = []
    for d in range(0, 1200, 5):
        for s in truth[d]:
            labels.append((d, rng.choice(sorted(TOPICS)) if rng.random() < 0.03 else s))  # a few are wrong
    labels += [(99_999, "law"), (3, None)]
    found = subject_areas(spark.createDataFrame(docs, "doc long, text string").repartition(4), "doc", "text", spark.createDataFrame(labels, "doc long, subject string"))
    got = {(r.doc, r.subject) for r in found.collect()}
    want = {(d, s) for d, own in truth.items() for s in own}
    assert len(got & want) > 0.99 * len(want) and len(got - want) < 0.01 * len(want)
    unseen = {(d, s) for d, s in want if d % 5}  # documents without a label
    assert len(got & unseen) > 0.99 * len(unseen) and len({x for x in got - want if x[0] % 5}) < 0.01 * len(unseen)


def test_terms():
    texts = pa.array(["getHTTPName snake_case x2 Straße", None, "", "ALLCAPS ab", "fooBar"])
    found = {}
    for lo, _, data, offsets in chunks(texts):
        hashes, rows = terms_of(data, offsets)
        for h, r in zip(hashes.tolist(), rows.tolist(), strict=True):
            found.setdefault(lo + r, []).append(h)
    alone = lambda w: terms_of(*[x for x in next(chunks(pa.array([w])))[2:]])[0].tolist()
    assert found[0] == alone("get") + alone("httpname") + alone("snake") + alone("case") + alone("straße")
    assert found[3] == alone("allcaps") and found[4] == alone("foo") + alone("bar") and set(found) == {0, 3, 4}


def test_vocabulary_finds_terms_that_share_a_place():
    hashes = np.sort(np.array([5, 6, 7, 1 << 44, (1 << 44) + 1, 2**64 - 1], np.uint64))
    v = Vocabulary(hashes)
    assert v.find(hashes).tolist() == list(range(6)) and v.find(np.array([8, 1 << 50], np.uint64)).tolist() == [-1, -1]
    assert Vocabulary(hashes[:0]).find(hashes).tolist() == [-1] * 6


@pytest.mark.parametrize("labelled", [True, False])
def test_edges(spark, labelled):
    docs, truth = corpus(60, 12)
    docs += [(100, None), (101, ""), (102, "word " * 300_000), (None, "text")]
    labels = [(d, s) for d, own in truth.items() for s in own] if labelled else []
    df = spark.createDataFrame(docs, "id long, text string")
    found = subject_areas(df, "id", "text", spark.createDataFrame(labels, "id long, subject string"))
    assert {r.id for r in found.collect()} <= set(range(60)) and (found.count() > 40) == labelled
    assert subject_areas(df.limit(0), "id", "text", spark.createDataFrame(labels, "id long, subject string")).count() == 0


def test_contrast_needs_more_than_one_document():
    model = B.SubjectModel(["a", "b"])
    model.fit_terms(np.array([[1.0, 9.0, 0.0], [0.0, 0.0, 0.0]]), np.array([10.0, 90.0]), np.array([1.0, 9.0, 0.0]), 100.0)
    assert model.contrast[0, 0] < 0 and model.contrast[0, 1] > B.LEAST_CONTRAST and (model.contrast[:, 2] < 0).all()


def test_posteriors_are_reliable_on_labels_the_judging_model_has_not_seen():
    rng = np.random.default_rng(19)
    n, size = 3000, 400
    truth = np.zeros((n, 2))
    truth[np.arange(n), rng.integers(0, 2, n)] = 1
    rows = []
    for t in truth:
        own = 0 if t[0] else 200
        words = np.r_[rng.integers(own, own + 200, rng.integers(2, 7)), rng.integers(0, 400, rng.integers(0, 3))]
        rows.append(np.unique(words))
    cuts = np.r_[0, np.cumsum([len(r) for r in rows])]
    known = B.Labelled(np.concatenate(rows), cuts, truth, np.arange(n) % B.FOLDS, size)
    model = known.model(["a", "b"], np.zeros((3, size + 1)))
    assert model.calibration.shape == (2, 2)
    for s in range(2):
        bins = B.reliability(known.held_out[:, s], truth[:, s])
        assert sum(many for _, _, many in bins) == n and sum(abs(said - true) * many for said, true, many in bins) / n < 0.06


def test_a_rare_subject_keeps_near_the_shared_calibration():
    rng = np.random.default_rng(20)
    truth = np.c_[rng.random(2000) < 0.5, np.r_[np.ones(3), np.zeros(1997)]]
    evidence = np.where(truth == 1, rng.gamma(9, 1, truth.shape), rng.gamma(1, 1, truth.shape))
    model = B.SubjectModel(["often", "rare"])
    model.calibrate(evidence, truth)
    assert abs(model.calibration[1, 1] - model.calibration[0, 1]) < 0.5 * abs(model.calibration[0, 1])

import random
import re

import pytest

from scourline.llm import leakage
from scourline.llm.leakage import leaked_items

WORDS = re.compile(r"[a-z0-9]+")


def brute(docs, items, width=13):
    runs = lambda t: {tuple(w[k : k + width]) for w in [WORDS.findall(t.lower())] for k in range(len(w) - width + 1)}
    own = {i: runs(t) for i, t in items if t is not None}
    return sorted({(d, i) for d, t in docs if t is not None for r in [runs(t)] for i in own if r & own[i]})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    vocabulary = ["acorn", "brave", "crate", "Dorian", "eats", "7", "19", "km", "return", "x1", "Kilo"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(rng.randrange(5, 50))) + ".") for k in range(30)] + [(90, None), (91, ""), (92, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    docs = []
    for d in range(200):
        parts = words(rng.randrange(60))
        if d % 3 == 0:
            source = WORDS.findall((rng.choice(items[:30])[1]).lower())
            a = rng.randrange(max(1, len(source) - 10))
            parts += [w.upper() if d % 2 else w for w in source[a : a + rng.randrange(8, 30)]]
        if d % 20 == 0:
            parts += [str(k) for k in range(1, 20)]
        docs.append((d, rng.choice([" ", "\n# ", ", ", "_-é"]).join(parts + words(5))))
    return docs + [(500, None), (501, ""), (502, "word " * 100_000 + items[3][1])], items


@pytest.mark.parametrize("chunk", [2_000_000, 300])
def test_verbatim_against_brute_force(spark, texts, monkeypatch, chunk):
    from scourline.llm import words

    monkeypatch.setattr(words, "CHUNK_BYTES", chunk)
    docs, items = texts
    got = leaked_items(spark.createDataFrame(docs, "doc long, text string").repartition(3), "doc", "text", spark.createDataFrame(items, "item long, text string"), "item", "text")
    assert sorted({(r.doc, r.item) for r in got.where("kind = 'verbatim'").collect()}) == brute(docs, items)


@pytest.mark.parametrize("share, most", [(64, 1 << 28), (1, 1 << 16), (1, 64)])
def test_a_full_filter_gives_the_same(spark, texts, monkeypatch, share, most):
    """Every kind of passage, whatever the filter lets through."""
    docs, items = texts
    run = lambda: leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t")
    want = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(leakage, "FILTER_SHARE", share)
    monkeypatch.setattr(leakage, "FILTER_LEAST", 64)
    monkeypatch.setattr(leakage, "FILTER_MOST", most)
    assert sorted(map(tuple, run().collect())) == want and len(want) > 20


ITEM = "A train leaves the station at 9 and runs 120 km to the harbour where Amelia waits for 9 hours with her 3 dogs."


@pytest.mark.parametrize("text, kind, words", [
    (ITEM, "verbatim", 24), (ITEM.upper().replace(" ", "\n"), "verbatim", 24),
    (ITEM.replace("9", "11").replace("120", "80"), "other values", 24),  # 9 becomes 11 in both places
    (ITEM.replace("at 9", "at 11").replace("120", "80").replace("3 dogs", "4 dogs"), "other values", 18),  # up to the second 9
    ("a train leaves the station at 4 and runs 55 km to the harbour where Boris waits", "other values", 17),  # Boris is no name of the items
    ("Boris said: a train leaves the station at 4 and runs 55 miles to the harbour where Boris waits for 4 hours", "other values", 20),
    ("the station at 9 and runs 120 km", None, 0),
])
def test_other_values(spark, text, kind, words):
    docs = spark.createDataFrame([(1, "intro words here. " + text + " and more", 5)], "doc long, text string, item long")
    got = leaked_items(docs, "doc", "text", spark.createDataFrame([(7, ITEM)], "item long, text string"), "item", "text").collect()
    assert [(r.doc, r["item"], r.kind, r.words) for r in got] == ([(1, 7, kind, words)] if kind else [])
    if kind == "verbatim":
        assert got[0].first_word == 3


def test_other_values_must_be_consistent(spark):
    item = "take 5 of 5 then 5 more of 5 and 5 again with 5 left over for 5 days"
    numbers = iter(range(10, 30))
    docs = [(1, re.sub("5", lambda _: str(next(numbers)), item)), (2, item.replace("5", "6"))]
    got = leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(7, item)], "i long, t string"), "i", "t").collect()
    assert [(r.d, r.kind) for r in got] == [(2, "other values")]


def test_results_do_not_depend_on_other_items(spark):
    texts = ["Carla packs 3 boxes of pears for 12 days and gives Amelia the rest of the 9 pears today", "amelia is a word here in lower case and nothing else at all in it", ITEM]
    doc = [(1, "We read: a train leaves the station at 8 and runs 70 km to the harbour where Boris waits for 8 hours with her 2 dogs")]
    docs = spark.createDataFrame(doc, "d long, t string")
    for own in (texts, texts[2:], texts[1:]):
        got = leaked_items(docs, "d", "t", spark.createDataFrame([(len(own) - k, t) for k, t in enumerate(own)], "i long, t string"), "i", "t").collect()
        assert [(r.i, r.kind, r.words) for r in got] == [(1, "other values", 24)]


PEOPLE = ["Amelia", "Boris", "Carla", "Dmitri", "Elena", "Farid", "Greta", "Hugo"]


def retold(rng, item):
    """The item with other numbers, names and units, each value for one other throughout."""
    swap = {}

    def other(m):
        word = m.group()
        if word not in swap:
            pool = [w for w in (PEOPLE if word in PEOPLE else ["km", "miles", "metres"] if word in ("km", "miles") else map(str, range(2, 300))) if w not in swap.values()]
            swap[word] = rng.choice(list(pool))
        return swap[word]

    return re.sub("|".join([r"\b\d+\b", r"\bkm\b|\bmiles\b", *PEOPLE]), other, item)


def test_recall_of_retold_items(spark):
    rng = random.Random(21)
    vocabulary = "the a of walks carries buys then and sells apples pears to from market harbour many with fewer until finds where each how".split()

    def sentence():
        words = [rng.choice(PEOPLE) if rng.random() < 0.12 else str(rng.randrange(2, 200)) if rng.random() < 0.25 else rng.choice(vocabulary) for _ in range(rng.randrange(9, 20))]
        return " ".join(["Then" if rng.random() < 0.5 else rng.choice(PEOPLE), *words, rng.choice(["km", "miles"])]) + "."

    items = [(k, " ".join(sentence() for _ in range(3))) for k in range(80)]
    docs = [(k, "Notes of the day. " + retold(rng, t) + " End of notes.") for k, t in items]
    got = leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()
    found = {(r.d, r.i) for r in got if r.d == r.i}
    assert len(found) == 80  # recall 1 of planted passages
    assert len(got) - len(found) <= 2
    assert sum(r.words >= 0.8 * len(WORDS.findall(dict(items)[r.i].lower())) for r in got if r.d == r.i) >= 76


def retelling_brute(doc, item, width=13, least=6):
    """Whether some alignment has ``width`` words, ``least`` of them fixed, with slots one to one, by trying all stretches."""
    def typed(text):
        out = []
        for m in re.finditer(r"[A-Za-z0-9]+", text):
            w, gap = m.group(), re.search(r"[^A-Za-z0-9]*$", text[: m.start()]).group()
            start = m.start() == len(gap) or any(c in leakage.STOPS for c in gap)
            name = len(w) > 1 and w[0].isupper() and w[1:].islower()
            base = "#" if w.isdigit() else "%" if w.lower() in leakage.UNITS else w.lower()
            names = [base, "@" if name and not start and base == w.lower() else base, "@" if name and base == w.lower() else base]
            out.append((w.lower(), names))
        return out

    a, b = typed(doc), typed(item)
    for x in range(3):
        for y in range(3):
            for d in range(-len(b), len(a)):
                for p in range(max(d, 0), min(len(a), len(b) + d)):
                    forth, back, fixed = {}, {}, 0
                    for k in range(p, min(len(a), len(b) + d)):
                        (s, u), (t, v) = a[k], b[k - d]
                        if u[x] != v[y]:
                            break
                        if u[x] in "#%@":
                            if forth.setdefault(s, t) != t or back.setdefault(t, s) != s:
                                break
                        else:
                            fixed += 1
                        if k + 1 - p >= width and fixed >= least:
                            return True
    return False


def test_other_values_against_brute_force(spark):
    rng = random.Random(22)
    vocabulary = ["7", "8", "12", "30", "km", "hours", "Anna", "Bela", "cat", "dog", "runs", "and"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". ", ", "]) for _ in range(n))
    items = [(k, text(rng.randrange(10, 40))) for k in range(12)]
    docs = [(k, text(6) + (retold(rng, rng.choice(items)[1].replace("Anna", "Greta").replace("Bela", "Hugo")) if k % 2 else "") + text(rng.randrange(20))) for k in range(60)]
    got = leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()
    verbatim = set(brute(docs, items))
    assert {(r.d, r.i) for r in got if r.kind == "verbatim"} == verbatim
    want = {(d, i) for d, t in docs for i, u in items if (d, i) not in verbatim and retelling_brute(t, u)}
    assert {(r.d, r.i) for r in got if r.kind == "other values"} == want and len(want) > 5


def test_texts_that_repeat_themselves(spark, monkeypatch):
    docs, items = [(1, "b b " + "a 7 " * 400)], [(2, "a 9 " * 60), (3, "A 7 " * 20)]
    run = lambda: sorted(map(tuple, leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()))
    want = run()
    assert want == [(1, 2, "other values", 120, 2), (1, 3, "verbatim", 40, 2)]
    monkeypatch.setattr(leakage, "MANY_MATCHES", 10)
    assert run() == want


def test_longest_consistent_stretch():
    def brute(ours, theirs):
        good = lambda a, b: len(set(zip(ours[a:b], theirs[a:b], strict=True))) == len(set(ours[a:b])) == len(set(theirs[a:b]))
        return max(b - a for a in range(len(ours)) for b in range(a, len(ours) + 1) if good(a, b))

    rng = random.Random(13)
    for _ in range(500):
        ours, theirs = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        theirs = (theirs * 9)[: len(ours)]
        begin, end = leakage.consistent_stretch(ours, theirs)
        assert end - begin == brute(ours, theirs)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, ITEM)], "d long, t string"), spark.createDataFrame([(7, ITEM)], "i long, t string")
    assert leaked_items(docs.limit(0), "d", "t", items, "i", "t").count() == 0
    assert leaked_items(docs, "d", "t", items.limit(0), "i", "t").count() == 0

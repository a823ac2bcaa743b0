"""The automaton against plain edit distance, and the model on held-out, quoted, misspelled and odd texts."""

import random
import zlib

import numpy as np
import pytest

from korpusmill.llm import toxicity
from korpusmill.llm.common import utf8

TERMS = ["idiot", "trash", "pathetic", "worthless", "scum", "réeuxou", "vequno", "disgusting", "böse", "stupid"]
SCHEMA = "doc_id long, text string, score string, toxic int, label int"


def distance(a, b):
    """Edits with swaps of neighbours, by the table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def read(texts):
    import pyarrow as pa

    return utf8(pa.array(texts, pa.string()))


def noisy(rng):
    w = list(rng.choice(TERMS))
    for _ in range(rng.randrange(4)):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        if kind == 0:
            w[i] = rng.choice("aeißtrno1")
        elif kind == 1:
            w.insert(i, rng.choice("aeißtrn"))
        elif kind == 2 and len(w) > 3:
            del w[i]
        elif i + 1 < len(w):
            w[i], w[i + 1] = w[i + 1], w[i]
    return "".join(w)


@pytest.mark.parametrize("states", [50_000, 40])
def test_automaton(states):
    rng = random.Random(3)
    words = [noisy(rng) for _ in range(4000)] + ["", "a", "x" * 40]
    automaton = toxicity.Automaton(TERMS, states)
    for k in range(0, len(words), 500):
        some = [w for w in words[k : k + 500] if w]
        read_in = toxicity.read_words(*read([" ".join(some)]))
        assert read_in.text(np.arange(len(read_in.start))) == some
        term, away = automaton.match(read_in)
        for w, t, e in zip(some, term, away, strict=True):
            near = [(distance(w, x), i) for i, x in enumerate(TERMS) if distance(w, x) <= toxicity.edits(x)]
            assert (t, e) == ((min(near)[1], min(near)[0]) if near else (-1, 0)), w
    assert len(automaton.sets) < max(states, 40) * 30


def test_words():
    w = toxicity.read_words(*read([None, "$$$ St*pid!!! don't 'x' @", "", "ÄB-c\n12 漢字🙂 é", "'' @@"]))
    assert w.text(np.arange(len(w.start))) == ["st*pid", "don't", "x", "äb", "c", "12", "漢字", "é"]
    assert w.row.tolist() == [1, 1, 1, 3, 3, 3, 3, 3]


def test_context():
    automaton = toxicity.Automaton(TERMS)
    texts = ['He said "you idiot" and left', "you idiot", "« trash » ici", "the word stupid is old", "one\" two\nidiot \"x", "idiot", 'far "' + " x" * 200 + ' idiot" y']
    found = toxicity.hits(automaton, *read(texts))
    assert found.row.tolist() == list(range(7))
    assert found.quoted.tolist() == [True, False, True, True, False, False, True]
    assert found.addressed.tolist() == [False, True, False, False, False, False, False]


def corpus(n, seed=1):
    rng, syllables = random.Random(seed), ["an", "er", "on", "the", "st", "ing", "re", "ou", "ha", "nd"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(20, 200))], i % 6 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(TERMS))
        out.append((i, " ".join(words), "x", 7, 8, int(toxic)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    data = corpus(1500) + [(10_000 + i, "copied passage " + " ".join(f"own{k}" for k in range(80)) + " idiot", "x", 7, 8, 1) for i in range(200)]
    docs = spark.createDataFrame([r[:5] for r in data], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5]) for r in data] + [(None, 1), (1, None)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels), docs, data


def test_terms(learned):
    model = learned[0]
    assert set(TERMS) <= set(model.lexicon.terms)
    assert not any(t.startswith("own") for t in model.lexicon.terms)  # words of one text and its copies are no terms


def test_held_out(learned):
    model, docs, data = learned
    score = {r.doc_id: r.score for r in model.score(docs).collect()}
    for r in data:
        if zlib.crc32(str(r[0]).encode()) % 5 == 0:
            assert (score[r[0]] >= 0.5) == (r[5] == 1), r


def test_misspelled_and_quoted(spark, learned):
    model, base = learned[0], "the hand reer onding staner " * 6
    abuse = ["you idoit", "w0rthless", "patheticc", "st*pid", "you are trash, idiot"]
    clean = ['"stupid"', "he wrote “worthless” here", "the word pathetic", "thrush", "hand", "", "scam"]
    docs = spark.createDataFrame([(i, base + t + " " + base, "x", 1, 2) for i, t in enumerate(abuse + clean)], SCHEMA)
    score = [r.score for r in sorted(model.score(docs).collect(), key=lambda r: r.doc_id)]
    assert all(s >= 0.5 for s in score[: len(abuse)]) and all(s < 0.5 for s in score[len(abuse) :]), score


def test_edges(spark, learned):
    model = learned[0]
    data = [(1, None, "a", 1, 2), (None, "", "a", 1, 2), (3, "x", "a", 1, 2), (3, "x", "a", 1, 2), (4, "idiot trash " * 300_000, "a", 1, 2), (5, "é" * 2_000_000, "a", 1, 2), (6, "\x00 ￿ 🙂", "a", 1, 2)]
    docs = spark.createDataFrame(data, SCHEMA)
    out = model.score(docs).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 3}) == 1
    assert next(r.score for r in out if r.doc_id == 4) > 0.5 > next(r.score for r in out if r.doc_id == 5)
    assert model.score(docs.limit(0)).collect() == []
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    for l in (labels, labels.limit(0)):
        flat = toxicity.fit(docs, l)
        assert len({r.score for r in flat.score(docs).collect()}) == 1
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_supplied(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.fit(docs, labels).score(docs.select("doc_id", "text")).join(labels, "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.95

import hashlib

import numpy as np
import pytest

from korpusmill.llm import passage_dedup
from korpusmill.llm.suffix_sort import equal_prefixes, suffix_array


def brute(data, length=100):
    seen, out = {}, {}
    for key, text in sorted({((i is not None, i or 0), t or "") for i, t, *_ in data}):
        b = text.encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (key, p)) != (key, p):
                gone[p : p + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out[key, text] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest())
    return [(i, *out[(i is not None, i or 0), t or ""]) for i, t, *_ in data]


def check(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, kept string")
    got = [tuple(r)[:5] for r in passage_dedup.remove_repeats(df).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(data), key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 10, 100, 1000])
def test_suffix_array(n):
    rng = np.random.default_rng(n)
    for letters in (1, 2, 26):
        t = rng.integers(0, letters, n).astype(np.uint64)
        assert suffix_array(t, n + 3).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_equal_prefixes():
    rng = np.random.default_rng(5)
    t = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = np.arange(2900)
    order, group = equal_prefixes(t, starts, 9)
    classes = {}
    for p, g in zip(order.tolist(), group.tolist(), strict=True):
        classes.setdefault(g, set()).add(bytes(t[p : p + 9]))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "thing", "ed", "été", "or", "where", "Zug", "on"], n).tolist())


def test_small(spark):
    rng = np.random.default_rng(1)
    passage, other = words(rng, 60), words(rng, 40)
    data = [(i * 2, words(rng, 30) + " " + passage + " " + words(rng, 20), "x") for i in range(30)]
    data += [(7, passage, ""), (9, passage + passage, ""), (11, None, ""), (13, "", ""), (15, "x" * 99, ""), (17, "x" * 100, ""), (19, "x" * 1000, ""), (21, "ab" * 300, ""), (23, "é" * 400, "")]
    data += [(31, other, ""), (33, other[:-1], ""), (35, other[1:], ""), (None, words(rng, 50), ""), (None, other, ""), (5000, words(rng, 30000), "")]
    check(spark, data)
    check(spark, [])


@pytest.mark.parametrize("local,crowd", [(2, 2), (16, 3), (1000, 5)])
def test_crowded_anchors(spark, local, crowd, monkeypatch):
    monkeypatch.setattr(passage_dedup, "LOCAL", local)
    monkeypatch.setattr(passage_dedup, "CROWD", crowd)
    monkeypatch.setattr(passage_dedup, "CHUNK", 4096)
    rng = np.random.default_rng(2)
    passage = words(rng, 45)
    data = [(i, words(rng, int(rng.integers(0, 30))) + passage[: int(rng.integers(120, len(passage)))] + words(rng, 12), "") for i in rng.permutation(120).tolist()]
    df = spark.createDataFrame(data, "doc_id long, text string, kept string").repartition(6)
    source = [(r.doc_id, r.text, "") for r in df.collect()]
    got = sorted(tuple(r)[:5] for r in passage_dedup.remove_repeats(df).collect())
    assert got == sorted(brute(source))


def test_documents(spark, sf_dir):
    import pyarrow.parquet as pq

    d = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    check(spark, [(i, t, "") for i, t in zip(d["doc_id"], d["text"], strict=True)])


def test_same_ids(spark):
    rng = np.random.default_rng(3)
    p = words(rng, 40)
    data = [(1, p, ""), (1, p, ""), (2, p + " end", "")]
    check(spark, data)

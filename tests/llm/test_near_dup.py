import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from korpusmill.llm import near_dup


def brute_fp(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=4):
    up = {}
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[f] = min(least.get(f, i), i)
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    for f, i in least.items():
        up[find(f)] = min(up.get(find(f), i), i)
    return [up.get(find(f)) for f in fps]


def check(spark, data, **more):
    df = spark.createDataFrame(data, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in near_dup.near_duplicates(df, **more).collect())
    fps = [brute_fp(t) for _, t, _ in data]
    want = brute_components([i for i, *_ in data], fps)
    assert got == sorted((i is not None, i or 0, f, c) for (i, *_), f, c in zip(data, fps, want, strict=True))


def test_small(spark):
    t = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
    texts = [t, t.upper(), t + " today", t.replace("dog", "cat"), "", None, " \n\t", "one", "One", "a b", "é È ñ x\x0by", "long " * 5000, "long " * 5001]
    check(spark, [(i * 3, x, "clash") for i, x in enumerate(texts)] + [(None, t, ""), (None, "only null", ""), (7, t, "")])
    check(spark, [])


def test_documents(spark, sf_dir):
    import pyarrow.parquet as pq

    d = pq.read_table(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").to_pydict()
    check(spark, [(i, t, "") for i, t in zip(d["doc_id"], d["text"], strict=True)])


@pytest.mark.parametrize("crowd", [2, 32])
def test_links_in_a_dense_cluster(spark, crowd, monkeypatch):
    whole = near_dup.allocate
    monkeypatch.setattr(near_dup, "allocate", lambda *a: (*whole(*a)[:2], 0.0))
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**63, 60)}
    centre = int(rng.integers(0, 2**63))
    for _ in range(300):  # a chain of near fingerprints, and a second cluster a few bits away
        x = centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        fps |= {x, x ^ 0b11111 << 20}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    edges = [(r.src, r.dst) for r in near_dup.links(df, crowd=crowd).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    low = {}
    for i in range(len(fps)):
        low.setdefault(find(i), i)
    assert [low[find(i)] for i in range(len(fps))] == brute_components(range(len(fps)), fps)


def test_allocation_covers_the_distance():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < np.linspace(0.1, 0.9, 64)).astype(float)
    for n in (500, 10**6, 10**10):
        parts, t, mean = near_dup.allocate(n, bits.T @ bits * (n / 500), 4)
        assert mean >= 0
        assert sum(x + 1 for x in t) == 5 and sorted(b for p in parts for b in p) == list(range(64))


def test_keep_one(spark):
    t = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(5, t, 1), (2, t + " x", 2), (2, t + " x", 2), (9, "other words stay here", 3), (None, "n", 4)], "doc_id long, text string, component int")
    out = near_dup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 2, 9]


def test_keep_one_of_rows_that_share_an_id(spark):
    t = " ".join(f"w{i}" for i in range(300))
    rows = [(1, t), (1, "alpha text of its own"), (1, "beta text apart"), (2, t + " x"), (None, "beta text apart"), (None, "n"), (None, "n"), (7, "twice"), (7, "twice")]
    out = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [("1", t), ("1", "alpha text of its own"), ("1", "beta text apart"), ("None", "n"), ("7", "twice")]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted(want)

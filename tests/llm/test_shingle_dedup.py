"""Groups by shingle similarity, against brute-force Jaccard."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from korpusmill.llm import near_dup, shingle_dedup
from tests.llm.test_near_dup import brute_fp


def brute_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(texts, similarity=0.8):
    sets = {i: brute_set(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) / max(1, len(x | y)) >= similarity:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: find(i) for i in texts}


def check(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.component_id for r in shingle_dedup.groups(df).collect()} == brute_groups(texts)
    assert sorted(r.doc_id for r in shingle_dedup.keep_one(df).collect()) == sorted(set(brute_groups(texts).values()))


def test_edges(spark):
    check(spark, {3: None, 1: "", 2: " ", 4: "a b", 5: "A  b", 6: "a b c", 7: "a b c d e f g h i", 8: "a b c d e f g h", 9: "b c d e f g h i j"})
    assert shingle_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "x y"), (None, "x y"), (1, "x y"), (1, "p q"), (2, "p q"), (3, "alpha text"), (3, "alpha text"), (3, "beta text"), (None, "q"), (None, "q"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, own string")
    out = shingle_dedup.keep_one(df)
    want = [("1", "p q"), ("1", "x y"), ("3", "alpha text"), ("3", "beta text"), ("4", None), ("None", "q")]
    assert out.columns == df.columns and sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    assert sorted(((str(r.doc_id), r.text) for r in shingle_dedup.keep_one(df, broadcast_rows=0).collect()), key=str) == sorted(want, key=str)


def test_edited_copies(spark):
    rng, texts = random.Random(5), {}
    words = [f"w{i}" for i in range(3000)]
    for base in range(25):
        t = rng.choices(words, k=rng.randint(40, 400))
        for _ in range(6):
            c = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts[len(texts)] = " ".join(c)
        # a chain: each follows the one before it, ends are far apart
        for k in range(6):
            texts[len(texts)] = " ".join(t[k * 3 : k * 3 + 38])
    check(spark, texts)


def test_blocks(spark, monkeypatch):
    """One crowd of near copies of one text, most of them not similar to each other, in blocks of a few rows."""
    rng = random.Random(8)
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(250):
        c = list(base)
        for _ in range(rng.randint(0, 12)):
            c[rng.randrange(len(c))] = f"x{rng.randint(0, 10**6)}"
        texts[i] = " ".join(c)
    whole = shingle_dedup.edges
    for rows in (2048, 40):
        monkeypatch.setattr(shingle_dedup, "edges", lambda *a, rows=rows: whole(*a, block_rows=rows))
        check(spark, texts)


def test_pipeline_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert kept == sorted(set(brute_groups(texts).values()))


def edited(rng, bases=40):
    """Texts with copies of which a word or two are changed."""
    words, texts = [f"w{i}" for i in range(3000)], {}
    for _ in range(bases):
        t = rng.choices(words, k=rng.randint(60, 300))
        for changes in range(4):
            c = list(t)
            for _ in range(changes):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts[len(texts)] = " ".join(c)
    return texts


def test_fingerprints_link_without_bands(spark):
    """With no bands at all, exactly the similar texts whose fingerprints lie within eight bits are linked."""
    texts = edited(random.Random(11))
    sets = {i: brute_set(t) for i, t in texts.items()}
    fps = {i: brute_fp(" ".join(w for w in t.split()), 5) for i, t in texts.items() if len(sets[i]) == len(t.split()) - 4}
    assert fps.keys() == texts.keys()
    df = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("th", F.xxhash64("text")).select("id", "th", "text")
    marked = shingle_dedup._marked(df, 5).cache()
    name = {r.whole: r.id for r in marked.collect()}
    assert {r.id: r.fp & (2**64 - 1) for r in marked.collect()} == fps
    nodes = marked.select("whole", "n", "fp", F.array().cast("array<long>").alias("bands"), "th")
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    similar = [(a, b) for a, b in combinations(texts, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    reached = [(a, b) for a, b in similar if (fps[a] ^ fps[b]).bit_count() <= 8]
    assert 20 < len(reached) < len(similar)
    for a, b in reached:
        up[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i in texts}
    up = {i: i for i in texts}
    for r in shingle_dedup.edges(nodes, df, 5, 0.8, 1000).collect():
        a, b = sorted((find(name[r.src]), find(name[r.dst])))
        up[b] = a
    assert {i: find(i) for i in texts} == want


def test_pipeline_stage_runs_fingerprints(spark, sf_dir, monkeypatch):
    whole, seen = near_dup.candidates, []
    monkeypatch.setattr(near_dup, "candidates", lambda *a: seen.append((a[0].count(), (out := whole(*a)).count())) or out)
    docs = spark.createDataFrame(list(edited(random.Random(12)).items()), "doc_id long, text string")
    corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert len(seen) == 1 and seen[0][0] == 160 and seen[0][1] > 20


def test_candidates(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    flip = lambda k: sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    fps = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    fps += [x ^ flip(rng.integers(0, 12)) for x in fps[:150]] + fps[:20]
    crowd = [centre ^ flip(rng.integers(0, 4)) for _ in range(200)]
    for some in (fps, fps + crowd):
        want = {(a, b) for a, b in combinations(range(len(some)), 2) if (some[a] ^ some[b]).bit_count() <= 8}
        near = Counter(i for p in want for i in p)
        whole = {p for p in want if min(near[p[0]], near[p[1]]) <= 16}
        df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(some)], "fp long, id long")
        got = {(r.src, r.dst) for r in near_dup.candidates(df).collect()}
        assert whole <= got <= want and (whole == want) == (some is fps) and {i for p in got for i in p} == set(near)
        for cells in (1, 5000):
            got = set(zip(*(x.tolist() for x in near_dup.near_pairs(np.array(some, np.uint64), 8, cells=cells)), strict=True))
            assert whole <= got <= want and len(got) <= len(whole) + 200
    assert near_dup.candidates(df.limit(0)).collect() == []


def test_allocation_at_a_larger_distance():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < 0.5).astype(float)
    for n in (2, 500, 10**6, 10**10):
        parts, t, _ = near_dup.allocate(n, bits.T @ bits * (n / 500), 8, pair_cost=0.002)
        assert sum(x + 1 for x in t) == 9 and all(x <= len(p) for x, p in zip(t, parts, strict=True)) and near_dup.masks(parts, t)

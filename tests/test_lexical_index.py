"""Block-max postings against plain sums, ties included, and the work that they leave out."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from korpusmill.functions.topk import Running
from korpusmill.operators import lexical_index as L
from korpusmill.operators import retrieval as R


def brute(queries, corpus, k):
    docs, asked = defaultdict(list), defaultdict(list)
    for i, t, w in corpus:
        if i is not None and t is not None:
            docs[t].append((i, w))
    scores = defaultdict(float)
    for q, t, w in queries:
        for i, v in docs.get(t, ()):
            scores[q, i] += w * v
    for (q, i), s in scores.items():
        asked[q].append((-round(s, 10), i))
    return sorted((q, i, -s, r + 1) for q, v in asked.items() for r, (s, i) in enumerate(sorted(v)[:k]))


def rows(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


def same(got, want):
    return len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 and a[3] == b[3] for a, b in zip(got, want, strict=True))


def corpus(n=600, seed=1, ties=True):
    rng = random.Random(seed)
    tokens = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    out = [(d, t, rng.choice([0.25, 0.5, 1.0]) if ties else rng.random()) for d in range(n) for t in set(rng.choices(tokens, weights, k=rng.randrange(1, 12)))]
    return out + [(d, "everywhere", 0.125) for d in range(n)] + [(None, "t1", 1.0), (5, None, 1.0)]


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("blocks", [1, 7])
def test_equal_to_sums(spark, ties, blocks):
    data = corpus(ties=ties)
    asked = [(q, t, round(random.Random(q * 7 + j).random(), 3) + 0.1) for q in range(40) for j, t in enumerate({"everywhere", f"t{q}", f"t{q % 7}", "nowhere"})]
    c, q = spark.createDataFrame(data, "id long, token string, weight double"), spark.createDataFrame([*asked, (None, "t1", 1.0)], "query_id long, token string, weight double")
    for k in (1, 4, 2000):
        want = brute(asked, data, k)
        assert same(rows(R.sparse_topk(q, L.LexicalIndex.of(c, blocks), k)), want)
    assert same(rows(R.sparse_topk(q, c, 4)), brute(asked, data, 4))
    assert same(rows(R.sparse_topk(q, c, 4, broadcast_rows=3)), brute(asked, data, 4))


def test_stored(spark, tmp_path):
    data = corpus(300)
    c, q = spark.createDataFrame(data, "id long, token string, weight double"), spark.createDataFrame([("a", "t2", 1.0), ("b", "everywhere", 2.0), ("c", "none", 1.0)], "query_id string, token string, weight double")
    index = L.LexicalIndex.write(c, str(tmp_path / "p"), 3)
    want = brute([tuple(r) for r in q.collect()], data, 5)
    assert same(rows(R.sparse_topk(q, index, 5)), want) and same(rows(R.sparse_topk(q, L.LexicalIndex.open(spark, str(tmp_path / "p")), 5)), want)
    assert R.sparse_topk(q.limit(0), index, 5).collect() == [] == R.sparse_topk(q, c.limit(0), 5).collect()


def test_blocks_that_can_not_win_are_left_out():
    """One strong document in the first block: weaker blocks are not read for that query at all, and common tokens only for documents that matter."""
    asked = L.Asked.of(pa.table({"query_id": [1, 1, 2], "token": ["rare", "common", "common"], "weight": [1.0, 1.0, 1.0]}))
    number, best = {t: i for i, t in enumerate(asked.tokens)}, Running(2, 1, L.SLACK)
    token, n = np.array([number["rare"], number["common"]]), 1000
    ids = pa.array(np.arange(n))

    def block(rare, common):
        weight = np.concatenate([[rare], np.full(n, common)])
        return L.score_block(asked, best, token, np.array([rare, common]), np.array([0, 1]), np.array([1, n]), np.concatenate([[3], np.arange(n)]), weight, ids)

    assert block(0.9, 0.1) == 2 * n + 1
    assert best.floor.tolist() == [1.0, 0.1]
    assert block(0.5, 0.05) == 0
    assert block(0.95, 0.08) == n + 1  # query 1 only, by its rare token; common ones are read but to add
    assert best.floor.tolist() == [pytest.approx(1.03), 0.1]

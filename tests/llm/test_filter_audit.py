"""The filter audit against brute force over all orders, on plain, hot, empty and odd tables."""

import math
import re
from collections import Counter
from itertools import permutations

import pytest

from korpusmill.llm import filter_audit

DOCS = "doc_id long, text string, lang string, n int, mask string, part string, digest int"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text))
    return {c for c, f in zip("ABCD", found, strict=True) if f}


def brute(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    parts = {}
    for i, t, lang, *_ in docs:
        f = fails(t or "") | ({"E"} if i is not None and i > least[t or ""] else set())
        parts.setdefault(lang or "", []).append((f, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for k, c in enumerate(order):
                gone, left = [r for r in left if c in r[0]], [r for r in left if c not in r[0]]
                total[c] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(c in r[0] for r in rows) - len(gone), sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def run(spark, docs, labels):
    out = filter_audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    rows = out.collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}


def more(texts, first=0):
    return [(first + i, t, [None, "", "en", "de"][i % 4], 1, "x", "y", 2) for i, t in enumerate(texts)]


PLAIN = " ".join(f"w{i}" for i in range(120))
TEXTS = [PLAIN, PLAIN, None, "", "a b", "#x " * 130, PLAIN.upper(), PLAIN + " 50%", "w " * 99 + "é\x85ü", "\x0b\x0c\t\n", "É" * 10, "AB" + "é" * 18, "AB" + "é" * 17, "x\x00y " * 100, PLAIN + "\n", PLAIN]


def test_brute(spark):
    docs = more(TEXTS) + more(TEXTS[::-1], 7) + [(None, PLAIN, "en", 0, "", "", 0), (None, PLAIN, None, 0, "", "", 0), (0, PLAIN, "en", 0, "", "", 0)]
    labels = [(0, 1, 0), (0, 0, 1), (1, None, 1), (None, 1, 1), (3, 1, None), (999, 1, 1), (8, 1, 1), (9, 0, 0)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_hot_copies_and_long_text(spark):
    docs = more([PLAIN + " #"] * 900 + ["short"] * 300 + [PLAIN * 20_000, "A" * 2_000_000])
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 900, 7)]
    labels = [(a, b, int(c)) for a, b, c in labels]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_supplied(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.filter_audit(docs, labels).collect()}
    assert got == brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, more([None]), []) == brute(more([None]), [])


def weighted(n, v):
    """Shapley values by their definition, times n!."""
    return [sum(math.factorial(s.bit_count()) * math.factorial(n - s.bit_count() - 1) * (v[s | 1 << i] - v[s]) for s in range(1 << n) if not s >> i & 1) for i in range(n)]


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_least_squares_gives_shapley(n):
    v = [0] + [(s * s * 7 + 3 * s) % 101 for s in range(1, 1 << n)]
    assert [sum(a * b for a, b in zip(row, v, strict=True)) for row in filter_audit.shapley_operator(n)] == weighted(n, v)


def test_other_filters_and_pairs(spark):
    counts = spark.createDataFrame([("p", m, m + 1, 0, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.audit(counts, "XYZ").collect()
    assert len(rows) == 18 and all(r.removed + r.kept == 36 for r in rows if r.step == 1)
    pair = {(r.one, r.other): (r.fail_one, r.fail_other, r.fail_both) for r in filter_audit.solo_rates(counts, "XYZ").collect()}
    assert pair["X", "Y"] == (2 + 4 + 6 + 8, 3 + 4 + 7 + 8, 4 + 8)
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "ABCDEFG")

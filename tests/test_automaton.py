"""The phrase trie against plain search, and the alias scan by trie and by join."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from korpusmill.operators import automaton, matching

WORD = st.sampled_from(["a", "b", "ab", "é", "c"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(WORD, min_size=1, max_size=4).map(" ".join), max_size=8), st.lists(st.one_of(st.none(), st.lists(WORD, max_size=12).map(" ".join)), max_size=6))
def test_trie(phrases, texts):
    row, phrase = automaton.PhraseTrie.of(phrases).find(pa.array(texts, pa.string()))
    got = sorted((r, phrases[p]) for r, p in zip(row.tolist(), phrase.tolist(), strict=True))
    want = sorted((r, p) for r, t in enumerate(texts) for p in set(phrases) for i in range(len((t or "").split(" "))) if (t or "").split(" ")[i : i + len(p.split(" "))] == p.split(" "))
    assert got == want


def test_slices_of_a_batch():
    texts = pa.array([None, "x y", "a b", "y x y"])
    row, phrase = automaton.PhraseTrie.of(["x y"]).find(texts.slice(1, 3))
    assert row.tolist() == [0, 2] and phrase.tolist() == [0, 0]
    batch = pa.record_batch([pa.array(range(5)), pa.array(["a" * 10, None, "b" * 30, "", "c"])], ["i", "t"])
    assert [b.column(0).to_pylist() for b in automaton.by_bytes([batch], 1, 12)] == [[0, 1], [2], [3, 4]]


def test_scan_by_trie_and_by_join(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "béta", "GAMMA", "delta", "of", "x"])
    docs = [(i, rng.choice([", ", " ", "\n- "]).join(word() for _ in range(rng.randrange(0, 30)))) for i in range(150)] + [(3, "alpha"), (None, "Alpha beta"), (901, None), (902, ""), (903, "delta " * 200_000 + "epsilon zeta")]
    al = [(f"p{i % 40}", " ".join(word() for _ in range(rng.randrange(1, 7))), i % 3 == 0) for i in range(90)] + [("p", None, True), ("q", "...", True), ("r", "epsilon ZÉTA", None), ("s", "Epsilon zeta", False)]
    d, a = spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(al, "page_id string, alias string, canonical boolean")
    tell = lambda **more: sorted(((r.page_id, r.doc_id) for r in matching.scan_aliases(d, a, stop=["of"], **more).collect()), key=str)
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower().replace("é", "e")).split())
    want = {(p, i) for p, t, c in al for i, x in docs if fold(t) and fold(t) != "of" and (len(fold(t)) >= 4 or c) and f" {fold(t)} " in f" {fold(x)} "}
    by_trie = tell()
    assert len(by_trie) == len(want) and set(by_trie) == want and len(want) > 200
    assert [w for w in by_trie if w[1] is not None] == [w for w in tell(broadcast_bytes=0) if w[1] is not None]
    assert {w for w in by_trie if w[1] == 903} == {("r", 903), ("s", 903)} | {w for w in want if w[1] == 903}
    assert matching.scan_aliases(d, a.limit(0)).collect() == [] == matching.scan_aliases(d.limit(0), a).collect()


def test_numbers_of_pages(spark):
    """Page ids need not be strings, and one alias may name several pages."""
    d = spark.createDataFrame([("d", "one two")], "doc_id string, text string")
    a = spark.createDataFrame([(7, "two", True), (8, "Two", True), (9, "one two", True)], "page_id long, alias string, canonical boolean")
    assert sorted(map(tuple, matching.scan_aliases(d, a).collect())) == [(7, "d"), (8, "d"), (9, "d")]
    assert np.array_equal(automaton.PhraseTrie.of([]).find(pa.array(["x"]))[0], np.zeros(0))

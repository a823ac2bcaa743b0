"""Literals of patterns, and the rules by index against every rule tried on every text."""

import random
import re

import pytest

from korpusmill.operators import filters, topic_rules


@pytest.mark.parametrize(
    "pattern,want",
    [
        (r"(?i)\b(licen[cs]e|all rights)\b", {"licen", "all rights"}), (r"abc", {"abc"}), (r"a.c", None), (r"ab?cde", {"cde"}), (r"abcd*e", {"abc"}), (r"abc+de", {"abc"}), (r"(abc)?def", {"def"}),
        (r"(abc|de)xyz", {"xyz"}), (r"(abc|def){2}", {"abc", "def"}), (r"(abc|def){0,2}", None), (r"x\.yz", {"x.yz"}), (r"\d+ euros", {" euros"}), (r"(?!abc)def", {"def"}), (r"(?=abc)", None), (r"[abc]", None),
        (r"Straße|ŞIK", {"strasse", "şik"}), (r"\Qabc\E", None), (r"(?x) a b c d", None), (r"abc|", None), (r"", None), (r"(abc", None), (r"[a[bc]]defg", {"defg"}), (r"(?<n>abcd)\1", None), (r"a{2}bcd", {"bcd"}), (r"\p{L}name", {"name"}), (r"Abcd", {"abcd"}),
    ],
)
def test_literals(pattern, want):
    got = topic_rules.literals(pattern)
    assert got == (None if want is None else frozenset(want))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equal_to_every_rule_on_every_text(spark):
    rng = random.Random(8)
    bit = lambda: rng.choice(["alpha", "Beta", "GAMMA", "delta", "ſun", "Kelvin", "İst", "ıstan", "x", "ΟΔΟΣ", "7"])
    texts = [(i, " ".join(bit() for _ in range(rng.randrange(12)))) for i in range(200)] + [(3, "alpha"), (None, "beta"), (900, None), (901, ""), (902, "x " * 400_000 + "delta7")]
    patterns = [r"\balpha\b", "beta|gamma", "ta 7", "sun", "kelvin$", "^ist", "istan", "οδος", ".{40,}", "x", "(del|gam)(ta|ma)", "alpha (beta)?", "nowhere", "beta", None]
    rules = [(p, f"r{i}") for i, p in enumerate(patterns)]
    t, r = spark.createDataFrame(texts, "doc_id int, text string").repartition(3), spark.createDataFrame(rules, "pattern string, reason string")
    by_hand = t.filter("text is not null").crossJoin(r).filter("rlike(text, concat('(?iU)', pattern))").select("doc_id", "pattern", "reason")
    want = rows(by_hand)
    for at_once in (200_000, 4):
        kept, log = filters.topic_filter(t, r, "text", "doc_id", at_once=at_once)
        assert rows(log) == want
        hit = {w[0] for w in want}
        assert sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(str(i) for i, _ in texts if i is None or i not in hit)
    assert rows(filters.topic_filter(t, r, "text", "doc_id", broadcast_rows=1)[1]) == want
    assert filters.topic_filter(t, r.limit(0), "text", "doc_id")[0].count() == len(texts)


def test_fifty_thousand_rules(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rules = [(rf"\b({word()}|{word()} {word()})\b", str(i)) for i in range(50_000)]
    texts = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    log = filters.topic_filter(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(rules, "pattern string, reason string"), "text", "k")[1]
    single = {}
    for p, reason in rules:
        for lit in p[3:-3].split("|"):
            single.setdefault(lit, []).append((p, reason))
    want = set()
    for i, t in texts:
        w = t.split(" ")
        for lit in {*w, *map(" ".join, zip(w, w[1:]))}:
            want |= {(i, p, reason) for p, reason in single.get(lit, ())}
    assert set(map(tuple, log.collect())) == want and len(want) > 500


def test_globs(spark):
    domains = ["a", "a.b", "a.b.c", "ab.c", "x.y", "x.yz", "x.y.z", "d10049.q", "", "q*", None, "a+b.c"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(domains)], "i int, d string")
    for globs in (["a.*"], ["x.y"], ["*.c"], ["x.y*", "a"], [], ["*"], [f"d{i}.*" for i in range(10_050)], ["a+b.*"], ["a*c"]):
        fit = lambda d: d is not None and any(re.fullmatch(".*".join(map(re.escape, g.split("*"))), d) for g in globs)  # noqa: B023, E731
        got = {r.i: r.quarantine for r in filters.domain_gate(df, "d", globs).collect()}
        assert got == {i: not fit(d) for i, d in enumerate(domains)}, globs[:3]
    assert filters.domain_gate(df, "d", spark.createDataFrame([("a.*",), (None,)], "glob string")).filter("not quarantine").count() == 2

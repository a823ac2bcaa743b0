"""Benchmark decontamination against a plain version in Python, and on hand-made cases."""

import time

import pytest
import regex

from korpusmill.llm import decontamination

TOKEN = regex.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[\p{L}\p{M}]+")


def kind(w):
    return "#" if w[0].isascii() and w[0].isdigit() else "~" if w.lower() in decontamination.UNITS else "@" if w != w.lower() else ""


def forms(words):
    kinds = [kind(w) for w in words]
    masked = lambda which: tuple((k if k in which and k else w.lower()) for w, k in zip(words, kinds, strict=True))
    if not {"", "@"} & set(kinds):
        return [masked("")]
    if "" not in kinds:
        return [masked("#~")]
    return [masked("#~@"), masked("#~")] if "@" in kinds else [masked("#~")]


def brute(docs, items, width=5, similarity=0.8, consistency=0.8):
    """(doc_id, item_id) to its four counts."""
    out, sides = {}, {i: TOKEN.findall(t) for i, t in items}
    widths = sorted({min(len(w), width) for w in sides.values()} - {0})
    table = {}
    for i, words in sides.items():
        n = min(len(words), width)
        for p in range(len(words) - n + 1 if n else 0):
            window = words[p : p + n]
            fs = forms(window) if n == width else [(n, *(w.lower() for w in window))]
            for f in fs:
                table.setdefault(f, {}).setdefault((i, fs[0]), p)
    n_windows = {}
    for found in table.values():
        for i, win in found:
            n_windows.setdefault(i, set()).add(win)
    for d, text in docs:
        words, hits = TOKEN.findall(text), {}
        for n in {width, *widths}:
            for p in range(len(words) - n + 1):
                window = words[p : p + n]
                for f in forms(window) if n == width else [(n, *(w.lower() for w in window))]:
                    for (i, win), at in table.get(f, {}).items():
                        key = (win, p - at)
                        hits.setdefault(i, {})[key] = min(at, hits.get(i, {}).get(key, at))
        for i, rows in hits.items():
            matched = {win for win, _ in rows}
            if len(matched) < similarity * len(n_windows[i]):
                continue
            theirs, support, places = sides[i], {}, {}
            for _, shift in rows:
                support[shift] = support.get(shift, 0) + 1
            if len(theirs) >= width:
                for (_, shift), at in rows.items():
                    for p in range(at, at + width):
                        if kind(theirs[p]):
                            places[p] = max(places.get(p, (0, 0)), (support[shift], -shift))
            to, back, ok = {}, {}, 0
            values = [(theirs[p].lower(), words[p - s].lower()) for p, (_, s) in sorted(places.items())]
            for a, b in values:
                to.setdefault(a, b)
                back.setdefault(b, a)
            ok = sum(to[a] == b and back[b] == a for a, b in values)
            if ok >= consistency * len(values):
                out[d, i] = (len(matched), len(n_windows[i]), len(values), ok)
    return out


def found(spark, docs, items, **more):
    d = spark.createDataFrame(list(docs), "doc_id long, text string, item_id long")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontamination.contaminated(d, b, **more).collect()}


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


def test_supplied_tables_as_brute_force(spark, tables):
    docs, items = tables
    got = found(spark, [(i, t, 0) for i, t in docs], items)
    assert got == brute(docs, items) and got
    assert {(i, j) for i, t in docs for j, x in items if x in t} <= set(got)


PRIME, TIMES, TRAIN = "Find the largest prime below ninety six", "What is 7 times 8", "A train goes from Rome to Milan at 50 km an hour for 3 hours and then on to Turin at 80"
APPLES = "Anna has 12 apples and gives 5 of them to Boris. Anna then buys 7 more and Boris eats 2. How many apples does Anna have?"


def test_copies_wherever_they_stand(spark):
    items = [(1, PRIME), (2, TIMES), (3, TRAIN), (4, APPLES), (5, "Name the capital"), (6, "Paris"), (7, "??"), (8, "1 2 3 4 5 6 7"), (9, "Anna Boris Carl Dora Emil Fred")]
    before = ["", "please ", "Please: ", "so, ", "Write to ann@example.com. ", "# Title\n", "~ ", "at 5 ", "of McDonald, ", "## 3 ", "(", "x1, "]
    docs = [(100 * i + k, b + t + a, 0) for i, t in items if i != 7 for k, (b, a) in enumerate((b, a) for b in before for a in ("", ". And more.", " km"))]
    docs += [(2000 + i, t.upper(), 0) for i, t in items] + [(3000 + i, t.lower(), 0) for i, t in items]
    got = found(spark, docs, items)
    assert got == brute([x[:2] for x in docs], items)
    assert all((d, d // 100) in got for d, _, _ in docs if d < 2000) and all((k + i, i) in got for i, _ in items if i != 7 for k in (2000, 3000))
    assert not any(i == 7 for _, i in got)


def test_slots_are_one_to_one(spark):
    swapped = APPLES.replace("Anna", "Maria").replace("12", "40").replace("Boris", "Ivan")
    docs = [
        (1, swapped), (2, "Intro. " + swapped + " End."),  # other values
        (3, TRAIN.replace("Milan", "Rome").replace("Turin", "Rome").replace("3 hours", "50 hours").replace("80", "50")),  # all values collapse
        (4, TRAIN.replace("Rome", "Lyon").replace("50 km", "60 miles")), (5, "a@b.com ~ # " + TRAIN),
        (6, APPLES.replace("Anna then", "Carl then").replace("does Anna", "does Dora").replace("Boris eats", "Emil eats").replace("to Boris", "to Boris 12 12")),
        (7, TRAIN.replace(" for 3 hours", " or so for 3 hours")), (8, "Only this: A train goes from Rome to Milan"),
    ]
    items = [(1, APPLES), (2, TRAIN)]
    got = found(spark, [(*x, 0) for x in docs], items)
    assert got == brute(docs, items)
    assert set(got) >= {(1, 1), (2, 1), (4, 2), (5, 2)} and not {3, 8} & {d for d, _ in got}


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    d = spark.createDataFrame([(1, PRIME, 0), (1, "clean words of another text", 0), (2, TRAIN, 0), (2, TRAIN, 0), (None, PRIME, 0), (3, None, 0)], "doc_id long, text string, leak int")
    b = spark.createDataFrame([(1, PRIME), (2, TRAIN), (2, TRAIN)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()) == [(1, 1), (2, 2)]
    kept = decontamination.decontaminate(d, b)
    assert kept.columns == d.columns and sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("1", "clean words of another text"), ("3", ""), ("None", PRIME)]


def test_very_long_texts_in_linear_time(spark):
    began = time.time()
    docs = [
        (1, "data " + ",".join(map(str, range(150_000))) + " end. " + TRAIN, 0), (2, "f" * 1_000_000 + " " + TRAIN, 0), (3, "Anna 5 " * 150_000 + TRAIN, 0),
        (4, "1:" * 500_000, 0), (5, "A" * 1_000_000, 0), (6, "é " * 400_000 + PRIME, 0),
    ]
    assert set(found(spark, docs, [(1, PRIME), (2, TRAIN)])) == {(1, 2), (2, 2), (3, 2), (6, 1)}
    assert time.time() - began < 120

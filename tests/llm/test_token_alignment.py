"""Alignment of two vocabularies against brute force with the slower public library, on odd and supplied texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from korpusmill.llm import token_alignment
from korpusmill.llm.queries import op11_token_alignment

AT = "/opt/tokenizers"
SCHEMA = "doc_id long, text string, n_a string, id int, code long, row int, same binary"


@pytest.fixture(scope="module")
def pair():
    return token_alignment.Pair.read(f"{AT}/byte_bpe_50k.json", f"{AT}/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The tokenizers as the files' own libraries read them."""
    a = Tokenizer.from_file(f"{AT}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{AT}/piece_bpe_32k.model")


def spell(plain, text):
    """Ids and bytes of both sides, or None where they do not spell the text."""
    a, b = plain
    letters = token_alignment._byte_letters()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    by_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    by_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    want = (" " + text).encode()
    return ((ids_a, by_a), (ids_b, by_b)) if b"".join(by_a) == want == b"".join(by_b) else None


def spans(side):
    out, at = [], 0
    for i, b in zip(*side, strict=True):
        out.append((at, at + len(b), i))
        at += len(b)
    return out


def brute(plain, texts):
    links, groups = [], []
    for t in texts:
        found = spell(plain, t) if t else None
        a, b = map(spans, found) if found else ([], [])
        links.append([(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) * len(b) < 4_000_000 else None)
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups.append([([x[2] for x in a if lo <= x[0] < hi], [y[2] for y in b if lo <= y[0] < hi]) for lo, hi in zip([0, *ends], ends)])
    count = Counter(p for one in links for p in set(one))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for one, g in zip(links, groups, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(one), sum(count[p] == best[p[0]] for p in one), sum(count[p] for p in one), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


TEXTS = [None, "", " ", "  a", "a", "aaaaaaa aaa aaaaaaaaaaaaa", "aaaaaaaaaaaa", "<|endoftext|> and </s> <s> <unk> <0x41>", "naïve café ÄÖÜ ß", "漢字 かな 🙂🙃", "a▁b", "x\x00y\n\n\n z\t\t q", "It's 12345 o'clock, isn't it?", "́é", "the the the the", "new\r\nline \x85 　 wide", "ﬁ ligature ½ ²", "﻿mark", " trailing   "]


def rows(texts):
    return [(i, t, "clash", 1, 2, 3, None) for i, t in enumerate(texts)]


def got(frame):
    return [tuple(r[c] for c in token_alignment.RESULT) for r in sorted(frame.collect(), key=lambda r: r.id)]


def test_odd_texts(spark, pair, plain):
    texts = TEXTS * 2 + [" ".join(random.Random(i).choices(["alpha", "Ünder", "of the", "x1", "aaaa", "\n"], k=60)) for i in range(30)]
    want = brute(plain, texts)
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    assert got(token_alignment.alignment(docs, pair)) == want
    assert want[TEXTS.index("a▁b")][:3] == (0, 0, 0) and want[5][5] > 0
    assert got(token_alignment.alignment(docs, pair, broadcast_pairs=10)) == want  # pairs joined


def test_supplied_texts(spark, pair, plain, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    local = sorted(docs.collect(), key=lambda r: r.doc_id)
    short = [r for r in local if len(r.text) < 4000]
    part = spark.createDataFrame([(r.doc_id, r.text) for r in short], "doc_id long, text string")
    assert got(token_alignment.alignment(part, pair)) == brute(plain, [r.text for r in short])
    out = {r.doc_id: r for r in op11_token_alignment(spark, sf_dir).collect()}
    for r in local:  # whole texts: what needs no corpus
        a, b = spell(plain, r.text)
        ends = {x[1] for x in spans(a)} & {x[1] for x in spans(b)}
        assert (out[r.doc_id].n_a, out[r.doc_id].n_b, out[r.doc_id].n_groups) == (len(a[0]), len(b[0]), len(ends))


def test_same_ids_as_the_file(pair, plain):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab zé漢\n\t'1 .,🙂Aſİ‍\x7f", k=rng.randrange(80))) for _ in range(3000)]
    texts += ["a" * 200_000, " " * 100_000, "\n" * 100_000, "ab1 " * 50_000]
    assert pair.a.encode(texts) == [e.ids for e in plain[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_long_text_copies_and_nulls(spark, pair):
    base = "long words and Ähnliches, 42 times; " * 30
    data = [(None, None), (None, base), (3, base), (3, base), (4, base * 1000)] + [(5 + i, base) for i in range(400)]
    out = token_alignment.alignment(spark.createDataFrame(data, "doc_id long, text string"), pair).collect()
    assert len(out) == len(data)
    one = [r for r in out if 0 < r.n_a < 10_000]
    assert len({tuple(r)[1:] for r in one}) == 1 and len(one) == 403
    long = next(r for r in out if r.n_a > 10_000)
    assert long.n_links == long.n_a + long.n_b - long.n_groups


def test_empty(spark, pair):
    assert token_alignment.alignment(spark.createDataFrame([], SCHEMA), pair).collect() == []
    only = token_alignment.alignment(spark.createDataFrame(rows([None, ""]), SCHEMA), pair).collect()
    assert [tuple(r)[1:] for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pack():
    rng = np.random.default_rng(1)
    row = np.sort(rng.integers(0, 50, 4000))
    values = np.concatenate([np.sort(rng.choice(1 << 40, (row == r).sum(), replace=False)) for r in range(50)])
    counts = rng.integers(1, 1 << 20, 4000)
    back = token_alignment.unpack(token_alignment.pack(values, counts, row, 60))
    assert all((x == y).all() for x, y in zip(back, (values, counts, row), strict=True))
    none = np.zeros(0, np.int64)
    assert token_alignment.pack(none, none, none, 3).to_pylist() == [b"", b"", b""]
    assert len(token_alignment.unpack(pa.array([], pa.binary()))[0]) == 0


def test_flush(spark, pair):
    """Small tables handed on early add up to the same counts."""
    docs = spark.createDataFrame([(i, " ".join(random.Random(i % 7).choices(TEXTS[3:], k=9))) for i in range(60)], "doc_id long, text string").repartition(2)
    found = token_alignment.encoded(docs, pair)
    whole, parts = (sorted(map(tuple, token_alignment.pair_counts(found, len(pair.a.tokens), flush=f).collect())) for f in (10**6, 5))
    assert whole == parts and len(whole) > 30

"""Sharding, mixing and line dedup on small tables, with nulls, ties, copies and clashing columns."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from korpusmill.llm import line_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, source string, slot string, copy string, h string, lines int"


def rows(*texts, first=0):
    return [(first + i, t, "s" + str(i % 3) if i % 4 else None, "x", "y", "z", 1) for i, t in enumerate(texts)]


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def size(t):
    return len((t or "").encode()) + 1


def test_shard_law(spark):
    data = rows(*[f"text {i} " + "x" * (i * 7 % 90) for i in range(900)], *["hot copy " * 6] * 500, None, "", "", first=0) + [(None, "a", None, "", "", "", 1)]
    out = sharding.shard(table(spark, data), 16, rows_per_task=20).collect()
    assert len(out) == len(data)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    ideal = sum(size(t[1]) for t in data) / 16
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(size(r.text) for r in rs) - ideal) < 0.05 * ideal + 120
    assert len(by) == 16
    spread = defaultdict(set)
    for r in out:
        spread[r.text].add(r.shard)
    assert all(len(s) == 1 for t, s in spread.items() if t != "hot copy " * 6)
    assert out[0].__fields__.count("slot") == 1


@pytest.mark.parametrize("data", [[], [(1, None, None, None, None, None, None)], [(1, "a", "b", "c", "d", "e", 1)] * 40])
def test_shard_edges(spark, data):
    out = sharding.shard(table(spark, data), 16).collect()
    assert len(out) == len(data)
    assert all(0 <= r.shard < 16 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_mix_counts(spark):
    data = [(i, "t" * (1 + i % 50), "big" if i % 10 else "small", "", "", "", 0) for i in range(4000)] + [(None, None, None, None, None, None, None)]
    docs = table(spark, data)
    rate = {r.source: r.rate for r in mixing.rates(docs).collect()}
    got = Counter((r.doc_id, r.source) for r in mixing.mix(docs).collect())
    import hashlib

    for i, _, s, *_ in data:
        u = int(hashlib.md5(f"17:{i if i is not None else 'null'}:1".encode()).hexdigest()[:13], 16) / 2**52
        if rate[s] <= mixing.LARGEST_MEAN:
            k, p = 0, math.exp(-rate[s])
            cdf = p
            while cdf <= u:
                k += 1
                p *= rate[s] / k
                cdf += p
            assert got[(i, s)] == k
    weight = {s: sum(size(d[1]) * got[(d[0], s)] for d in data if d[2] == s) for s in ("big", "small")}
    want = {s: sum(size(d[1]) for d in data if d[2] == s) ** 0.5 for s in ("big", "small")}
    assert abs(weight["big"] / weight["small"] / (want["big"] / want["small"]) - 1) < 0.15


def test_mix_weights_and_edges(spark):
    data = [(i, "t" * 10, "a" if i < 90 else "b", "", "", "", 0) for i in range(100)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 4.0)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix(table(spark, data), weights, epochs=100.0).collect())
    assert abs(got["a"] / 1000 - 1) < 0.15 and abs(got["b"] / 9000 - 1) < 0.1  # b: mean 900 copies, in parts
    assert mixing.mix(table(spark, [])).count() == 0
    again = [sorted((r.doc_id, r.copy) for r in mixing.mix(table(spark, data)).collect()) for _ in range(2)]
    assert again[0] == again[1]


def brute(data, window=3):
    first = {}
    gone = defaultdict(set)
    for i, t, *_ in sorted((d for d in data if d[1] is not None), key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = t.split("\n")
        for p in range(len(lines) - window + 1):
            if first.setdefault(tuple(lines[p : p + window]), (i, p)) != (i, p):
                gone[i] |= set(range(p, p + window))
    return gone


def test_line_dedup(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc", "q\nq\nq\nq\nq", "a\nb", "", None, "\n\n\n\n", "z\nb\nc\nd\ny\na\nb\nc", "é\r\nb\nc\nd", "é\r\nb\nc\nd"]
    data = rows(*texts) + [(None, "a\nb\nc\nnull id", None, None, None, None, None)]
    gone = brute(data)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, data)).collect()}
    assert len(out) == len(data)
    for i, t, *_ in data:
        lines = t.split("\n") if t is not None else []
        assert out[i].removed == sorted(gone[i]) and out[i].n_lines == len(lines)
        assert out[i].text == (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone[i]))
        assert out[i].h in ("z", None)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_line_dedup_same_rows(spark):
    data = [(1, "a\nb\nc\nd", "s", "", "", "", 1)] * 3 + [(1, "b\nc\nd\ne", "s", "", "", "", 1)]
    out = line_dedup.dedup_lines(table(spark, data)).collect()
    assert len(out) == 4
    assert len({r.text for r in out if r.text.startswith("a") or r.text == ""}) == 1


def test_crc(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit("é").cast("binary"))).first()[0] == zlib.crc32("é".encode())


def test_rows_without_an_id_are_dealt_out(spark):
    """Rows that share a null id lie in several partitions, a text of megabytes among them, and each is as often there as the others."""
    rows = [(None, f"text {i}", "a") for i in range(400)] + [(None, "x" * 3_000_000, "a"), (1, None, None), (2, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be put together
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    got = mixing.mix(df, epochs=4.0).select(F.spark_partition_id().alias("p"), "doc_id", F.md5("text").alias("t"), "copy").collect()
    spark.conf.set(name, before)
    assert len({r.p for r in got if r.doc_id is None and r.copy == 0}) > 1
    counts = Counter(r.t for r in got if r.doc_id is None)
    assert len(counts) == 401 and len(set(counts.values())) == 1

"""Near-duplicate documents: SimHash fingerprints linked by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.batches import map_batches
from korpusmill.llm.common import cut, shingle_hashes, slices, utf8
from korpusmill.llm.components import components
from korpusmill.llm.keeping import keep_keepers, with_keepers

BITS = 64


def fingerprints(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """SimHash of each of ``rows`` texts: bit i is 1 if it is set in over half of its hashes ``h``, which come in order of ``row``."""
    out = np.zeros(rows, np.uint64)
    if not len(h):
        return out
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.diff(np.append(at, len(row)))
    for i in range(0, len(at), 512):  # bounded memory: a few rows at a time
        lo, hi = at[i], at[i + 512] if i + 512 < len(at) else len(row)
        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, at[i : i + 512] - lo, axis=0, dtype=np.int32)
        over = (2 * counts > n[i : i + 512, None]).astype(np.uint8)
        out[row[at[i : i + 512]]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprint(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``th`` (xxhash64 of the text) and ``fp`` (the fingerprint as a signed long) for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fingerprints(*shingle_hashes(*utf8(b.column(2)), width), b.num_rows).view(np.int64))], ["doc_id", "th", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    return map_batches(source, run, "doc_id long, th long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set, over all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            gram, n = gram + bits.T @ bits, n + len(bits)
        yield pa.record_batch([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*gram.ravel(), float(n)])], ["i", "x"])

    sums = {r.i: r.x for r in map_batches(fps.select("fp"), run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    return int(sums.get(BITS * BITS, 0)), np.array([sums.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS)


def partitions(n: int, gram: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` partitions; correlated bits go together."""
    p = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = (len(left) + (m - k) - 1) // (m - k)
        rest = sorted(left)
        group = [rest[int(np.argmax(r[np.ix_(rest, rest)].max(axis=1)))]]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(r[np.ix_(rest, group)].sum(axis=1)))])
        left -= set(group)
        out.append(sorted(group))
    return out


def allocate(n: int, gram: np.ndarray, distance: int, key_cost: float = 1.0, pair_cost: float = 0.1) -> tuple[list[list[int]], list[int], float]:
    """Partitions of the bits, the threshold of each, and the mean bucket to expect, at the least estimated cost.

    Two fingerprints within ``distance`` differ by at most T_i in some partition i if the T_i + 1 add up to distance + 1; T_i = -1
    leaves partition i out. Estimated candidates of partition i at threshold t: all pairs times the probability that two
    random fingerprints differ by at most t there, from the share of ones of each bit over all fingerprints, with fewer
    effective bits where they are correlated. Dynamic programming over the partitions finds the cheapest thresholds for
    each number of partitions; the cheapest of those wins. A key is made, moved and grouped; a candidate is two numbers compared
    inside a join, a tenth of that.
    """
    p = np.diag(gram) / max(n, 1)
    best = (inf, [], [], 0.0)
    for m in range(2, distance + 2):
        parts = partitions(n, gram, m)
        cost, mean = np.full((m, distance + 2), inf), np.zeros((m, distance + 2))
        for i, bits in enumerate(parts):
            pi = p[bits]
            cov = gram[np.ix_(bits, bits)] / max(n, 1) - np.outer(pi, pi)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            effective = min(1.0, len(bits) / max(1.0, ((cov / np.outer(sd, sd)) ** 2).sum()))
            differ = 2 * pi * (1 - pi) * effective
            at = np.zeros(distance + 1)
            at[0] = 1
            for d in differ:
                at[1:] = at[1:] * (1 - d) + at[:-1] * d
                at[0] *= 1 - d
            cost[i, 0] = 0
            for t in range(distance + 1):
                if t <= len(bits) and comb(len(bits), t) <= 1024:
                    mean[i, t + 1] = n * at[: t + 1].sum() / comb(len(bits), t)
                    cost[i, t + 1] = key_cost * n * comb(len(bits), t) + pair_cost * n * n / 2 * at[: t + 1].sum()
        table, back = np.full((m + 1, distance + 2), inf), {}
        table[0, 0] = 0
        for i in range(m):
            for used in range(distance + 2):
                for t in range(distance + 2 - used):
                    if table[i, used] + cost[i, t] < table[i + 1, used + t]:
                        table[i + 1, used + t] = table[i, used] + cost[i, t]
                        back[i + 1, used + t] = t
        if table[m, distance + 1] < best[0]:
            chosen, used = [], distance + 1
            for i in range(m, 0, -1):
                chosen.append(back[i, used] - 1)
                used -= back[i, used]
            chosen = chosen[::-1]
            best = (table[m, distance + 1], parts, chosen, max(mean[i, t + 1] for i, t in enumerate(chosen)))
    return best[1:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(parts: list[list[int]], thresholds: list[int]) -> list[int]:
    """Bits to compare: fingerprints that differ by at most T_i in partition i agree on all of it but some T_i bits."""
    out = []
    for bits, t in zip(parts, thresholds, strict=True):
        if t >= 0:
            whole = sum(1 << b for b in bits)
            out += [_signed(whole ^ sum(1 << b for b in away)) for away in combinations(bits, t)]
    return out


def flips(radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(radius + 1) for c in combinations(range(BITS), k)]


def links(fps: DataFrame, distance: int = 4, crowd: int = 128) -> DataFrame:
    """Edges (``src``, ``dst``) between the ids of distinct fingerprints (``fp``, ``id``) whose closure is all links within ``distance``.

    Fingerprints meet in buckets by their masked values. In a bucket of at most ``crowd`` (and eight
    times the bucket to expect), every pair is compared inside the join. In a larger one, members are verified against its first; where that leaves it in more than one component, its members meet again at all
    fingerprints within half the distance: two fingerprints are within an even distance just if they share such a midpoint. So
    no bucket is capped and none emits its square.
    """
    n, gram = bit_statistics(fps)
    parts, thresholds, mean = allocate(n, gram, distance)
    crowd = max(crowd, int(8 * mean))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(x).alias("mask")) for i, x in enumerate(masks(parts, thresholds))]))
    keyed = fps.select("fp", "id", keys.alias("key")).select("fp", "id", F.col("key.k").alias("k"), F.col("fp").bitwiseAND(F.col("key.mask")).alias("v"))
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp")).alias("lead")).filter("n > 1")
    sizes = cut(sizes.select("k", "v", "n", F.col("lead.id").alias("lead"), F.col("lead.fp").alias("lead_fp")))
    members = cut(keyed.join(sizes, ["k", "v"]).select("k", "v", "fp", "id", "n", "lead", "lead_fp"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    small = members.filter(F.col("n") <= crowd)
    a = small.select("k", "v", F.col("fp").alias("fa"), F.col("id").alias("src"))
    b = small.select("k", "v", F.col("fp").alias("fb"), F.col("id").alias("dst"))
    pairs = a.join(b, (a.k == b.k) & (a.v == b.v) & (F.col("src") < F.col("dst")) & near("fa", "fb")).select("src", "dst")
    starred = members.filter((F.col("n") > crowd) & near("fp", "lead_fp")).select(F.col("lead").alias("src"), F.col("id").alias("dst")).filter("src <> dst")
    edges = cut(pairs.unionByName(starred).distinct())
    crowds = members.filter(F.col("n") > crowd)
    if not crowds.take(1):
        return edges
    found = components(edges)
    spread = crowds.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = spread.groupBy("k", "v").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("k", "v")
    meet = cut(crowds.join(mixed, ["k", "v"]).select("fp", "id").distinct())
    middle = meet.select("id", F.explode(F.array(*[F.lit(x) for x in flips(distance // 2)])).alias("flip"), "fp")
    middle = middle.select("id", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    first = middle.groupBy("mid").agg(F.min("id").alias("src"), F.max("id").alias("last")).filter("src < last").select("mid", "src")
    more = middle.join(first, "mid").filter("src < id").select("src", F.col("id").alias("dst")).distinct()
    return edges.unionByName(more)


def near_pairs(fp: np.ndarray, distance: int, each: int = 16, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the pairs within ``distance`` of which one has at most ``each`` others so near; ``cells`` are compared at a time.

    Of the rest, which is crowded, each is paired with the first leader within ``distance`` only; a leader is one that has no leader before it so near.
    """
    m, found, crowd = len(fp), [], []
    step = max(1, cells // m)
    for a in range(0, m, step):
        near = np.bitwise_count(fp[a : a + step, None] ^ fp) <= distance
        many = near.sum(axis=1) > each + 1
        crowd.append(np.flatnonzero(many) + a)
        near[many] = False
        i, j = np.nonzero(near)
        found.append((i + a, j))
    left = np.concatenate(crowd)
    while len(left):
        near = np.bitwise_count(fp[left] ^ fp[left[0]]) <= distance
        found.append((np.full(near.sum(), left[0]), left[near]))
        left = left[~near]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.divmod(np.unique((np.minimum(i, j) * m + np.maximum(i, j))[i != j]), m)


def candidates(fps: DataFrame, distance: int = 8, piece: int = 1 << 17) -> DataFrame:
    """Pairs (``src``, ``dst``) of different ids whose fingerprints (``fp``, ``id``) lie within ``distance``, for an exact check to follow.

    They meet in buckets as in :func:`links`, but pairs are compared by numpy in one task a bucket, a five-hundredth of what a key costs,
    so there are fewer keys and larger buckets. All pairs of a bucket come out but for those inside a crowd (:func:`near_pairs`) and, of
    more than ``piece`` rows, those of different pieces in order of fingerprint. So a bucket never emits its square; the caller has to
    find what this leaves out.
    """
    n, gram = bit_statistics(fps)
    parts, thresholds, _ = allocate(n, gram, distance, pair_cost=0.002)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(x).alias("mask")) for i, x in enumerate(masks(parts, thresholds))]))
    keyed = fps.select("fp", "id", keys.alias("key")).select("key.k", F.col("fp").bitwiseAND(F.col("key.mask")).alias("v"), "fp", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> tuple[np.ndarray, np.ndarray]:
            fp, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            i, j = near_pairs(fp.view(np.uint64), distance)  # bits of a negative number would be those of its absolute value
            return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

        def table() -> pa.RecordBatch:
            return pa.record_batch([np.concatenate(x) for x in zip(*out, strict=True)], ["src", "dst"])

        held, rows, key, out = [], 0, None, []
        for b in batches:
            if not b.num_rows:
                continue
            k, v, fp, ids = (b.column(c).to_numpy() for c in range(4))
            at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(k)], strict=True):
                if key != (k[i], v[i]) or rows >= piece:
                    if rows > 1:
                        out.append(pairs())
                    held, rows, key = [], 0, (k[i], v[i])
                held.append((fp[i:j], ids[i:j]))
                rows += j - i
            if sum(len(x) for x, _ in out) > 10_000:
                yield table()
                out = []
        if rows > 1:
            out.append(pairs())
        if out:
            yield table()

    return map_batches(keyed.repartition("k", "v").sortWithinPartitions("k", "v", "fp", "id"), run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, crowd: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fp`` (signed long) and ``component_id``, the smallest id reachable over links.

    Fingerprints link if they differ in at most ``distance`` bits (an even number). Copies share a fingerprint and stand for
    one node, so the work after fingerprinting is on distinct fingerprints.

    Null, empty and blank texts have fingerprint zero and link like any other; rows that share an id keep one row each; a null
    id never names a component: one of null ids only has a null ``component_id``; an empty table gives an empty result.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    marked = cut(with_fingerprint(docs, width, doc_id, text))
    # ids of nodes: the smallest doc_id; fingerprints whose documents have null ids only are left to themselves
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("id")))
    named = fps.filter("id is not null")
    # the same id can name several fingerprints: all of them are joined through it
    found = components(links(named, distance, crowd))
    table = fps.join(found, fps.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marked.join(table, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, width: int = 4, distance: int = 4, similarity: float | None = None, broadcast_rows: int = 2_000_000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``: that of the smallest id, of several that of the smallest text hash.

    Groups are linked by fingerprints within ``distance``; or, if a ``similarity`` is given, by texts whose sets of shingles
    have that Jaccard similarity or more: fingerprints find the first of them and MinHash bands the rest, which lies
    beyond the reach of a pigeonhole search (see :mod:`korpusmill.llm.shingle_dedup`).

    Rows that share an id are told apart by their text, and of rows alike in both one stays; null ids come last; null, empty and
    blank texts are alike; an empty table gives an empty result; very long texts are read whole. Texts do not move where at
    most ``broadcast_rows`` rows go.
    """
    if similarity is not None:
        from korpusmill.llm import shingle_dedup  # which itself imports this module

        return shingle_dedup.keep_one(docs, width, similarity, broadcast_rows, doc_id, text)
    marked = cut(with_fingerprint(docs, width, doc_id, text))
    found = components(links(marked.select("fp", F.col("fp").alias("id")).distinct(), distance)).withColumnRenamed("node", "fp")
    rows = marked.groupBy(F.col("doc_id").alias("id"), "th", "fp").agg(F.count("*").alias("copies")).join(found, "fp", "left")
    return keep_keepers(docs, with_keepers(rows.select("id", "th", "copies", F.coalesce("component", "fp").alias("component")), broadcast_rows), broadcast_rows, doc_id, text)

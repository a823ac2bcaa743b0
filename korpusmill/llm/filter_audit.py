"""Filter interaction audit: what each filter of a chain removes, in every order, and its fair share.

A document's failures are one number with a bit a filter. Counted by part and number, they give the documents that each of the
2^n coalitions of filters removes; differences of coalitions are the counts of every step of every order, and a constrained
least-squares fit over the coalitions, solved in rationals, gives the Shapley values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import pairwise, permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusmill.functions.batches import map_batches
from korpusmill.llm.common import SpanHash, cut, fresh, scramble, slices, utf8, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True
NAMES = "ABCDE"
#: Orders grow as the factorial of the filters: 720 at this number.
MOST_FILTERS = 6


def shapley_operator(n: int) -> list[list[int]]:
    """Integers ``m`` with ``n! * shapley[i] = sum(m[i][s] * v[s])`` over the coalitions ``s`` (bits), ``v[0]`` being 0.

    The values minimise ``sum(w[s] * (v[s] - sum of the values in s)^2)`` over the proper coalitions, with kernel weights
    ``w[s] = (n - 1) / (C(n, |s|) |s| (n - |s|))``, under the constraint that they sum to ``v`` of all filters. The normal
    equations with their multiplier are eliminated exactly, once for all right-hand sides.
    """
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    rows = []
    for i in range(n):
        left = [sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *(weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(full + 1))])
    rows.append([*[Fraction(1)] * n, Fraction(0), *(Fraction(int(s == full)) for s in range(full + 1))])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    solved = [[x * factorial(n) for x in rows[i][n + 1 :]] for i in range(n)]
    assert all(x.denominator == 1 for row in solved for x in row)
    return [[int(x) for x in row] for row in solved]


def text_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the conditions on single texts that fail, for each row of a batch of UTF-8 texts: A few words, B repeated words, C capitals, D symbols."""
    n = len(offsets) - 1

    def held(byte_is: np.ndarray) -> np.ndarray:
        """How many bytes of each row are marked."""
        return np.diff(np.searchsorted(np.flatnonzero(byte_is), offsets))

    start, end, row = words(data, offsets)
    n_words = np.bincount(row, minlength=n)
    key = scramble(SpanHash(data)(start, end) + scramble(row.astype(np.uint64) + np.uint64(1)))  # equal words of one text have one key
    order = np.argsort(key)
    first = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
    distinct = np.bincount(row[order[first]], minlength=n)
    fails = [n_words < 100, 100 * distinct < 80 * n_words, 100 * held((data >= 65) & (data <= 90)) > 10 * (np.diff(offsets) - held((data & 0xC0) == 0x80)), held(_SYMBOL[data]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, part, SHA-256 of the text and its mask; the texts stay behind."""
    for b in slices(batches):
        data, offsets = utf8(b.column(2))
        whole = memoryview(data)
        digests = [sha256(whole[i:j]).digest() for i, j in pairwise(offsets.tolist())]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(text_failures(data, offsets), pa.int32())], ["id", "part", "digest", "mask"])


def masked(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``part``, ``mask`` (bit i: filter i of NAMES fails), ``n`` documents, ``good`` and ``toxic`` ones among them.

    Whole texts are judged and digested in one pass; only ids, digests and masks move. A document fails E where the same text,
    by SHA-256, stands under a smaller id anywhere in the table: the copies of one text are counted by label and part before
    they meet, so a text of very many copies is a few rows. A null id is larger than none and no smaller id for others: such
    documents pass E. Rows that repeat an id and its text count each time, and all those of the smallest id pass. Of several
    labels of one id, any that is 1 counts; a null label is none.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    rows = map_batches(given, _judged, f"id {given.schema['id'].dataType.simpleString()}, part string, digest binary, mask int")
    rows = rows.withColumn("digest", F.when(F.col("id").isNotNull(), F.col("digest"))).groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(is_one("quality"), is_one("toxic")).filter("quality + toxic > 0")
    rows = rows.join(marks, "id", "left").fillna(0, ["quality", "toxic"])
    alike = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    alike = alike.withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))  # a row a part and label, not a copy
    passing = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    kinds = F.array(F.struct(passing.alias("n"), F.lit(0).alias("e")), F.struct((F.col("n") - passing).alias("n"), F.lit(1 << (len(NAMES) - 1)).alias("e")))
    parts = alike.select("part", "mask", "quality", "toxic", F.explode(kinds).alias("kind")).filter("kind.n > 0")
    return parts.groupBy("part", F.col("mask").bitwiseOR(F.col("kind.e")).alias("mask")).agg(
        F.sum("kind.n").alias("n"), F.sum(F.col("kind.n") * F.col("quality")).alias("good"), F.sum(F.col("kind.n") * F.col("toxic")).alias("toxic"),
    )


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """One row a part, order and step from ``counts`` (``part``, ``mask``, ``n``, ``good``, ``toxic``; at most 2^n rows a part).

    ``removed`` at a step is what the coalition so far removes beyond the one before it; ``redundant`` fails the step's filter
    but went earlier; ``unique_fails`` fails no other filter; ``shapley`` is the filter's value times n!, a whole number. All
    orders of all parts come out, zeros included; an empty table gives no rows. At most six filters.
    """
    n = len(names)
    if not 1 <= n <= MOST_FILTERS or len(set(names)) != n:
        raise ValueError(f"one to {MOST_FILTERS} filters, each named by a letter of its own")
    full = (1 << n) - 1
    measures = ["n", "good", "toxic"]
    coalition = counts.select("part", "mask", *measures, F.explode(F.sequence(F.lit(0), F.lit(full))).alias("s"))
    gone = F.col("mask").bitwiseAND(F.col("s")) != 0
    tabled = coalition.groupBy("part", "s").agg(*(F.sum(F.when(gone, F.col(m)).otherwise(0)).alias(m) for m in measures), F.sum("n").alias("all"))
    value = tabled.groupBy("part").agg(F.max("all").alias("all"), F.array_sort(F.collect_list(F.struct("s", *measures))).alias("v"))  # 2^n entries
    value = value.select("part", "all", *(F.col(f"v.{m}").alias(m) for m in measures))
    matrix = F.array(*(F.array(*(F.lit(x).cast("long") for x in row)) for row in shapley_operator(n)))
    shares = F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, F.col("n"), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(names))), ",")
    at = lambda k: F.instr(F.lit(names), F.substring(F.col("filter_order"), k, F.lit(1))) - 1
    bits = lambda upto: F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(n)), 1, upto), F.lit(0), lambda m, k: m + F.pow(F.lit(2), at(k)).cast("int"))
    rows = value.withColumn("shares", shares).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = rows.withColumns({"own": at(F.col("step")), "before": bits(F.col("step") - 1)})
    rows = rows.withColumn("bit", F.pow(F.lit(2), F.col("own")).cast("int")).withColumn("now", F.col("before").bitwiseOR(F.col("bit")))
    here = lambda m, s: F.get(F.col(m), s)
    lost = lambda m: here(m, F.col("now")) - here(m, F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("all") - here("n", F.col("now"))).alias("kept"), lost("n").alias("removed"),
        (here("n", F.col("bit")) - lost("n")).alias("redundant"), (here("n", F.lit(full)) - here("n", F.lit(full) - F.col("bit"))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get(F.col("shares"), F.col("own")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`audit` of the five text filters over ``docs``, each part by itself; duplicates are looked for in the whole table.

    Null texts are empty, a null part is the empty string, repeated rows count each time, very long texts are read whole,
    other columns are ignored whatever their names, and an empty table gives an empty result.
    """
    return audit(cut(masked(docs, labels, part, doc_id, text)))


def solo_rates(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """For each part and pair of filters: how many documents fail ``one``, ``other`` and ``both``; pairs that nearly coincide are redundant in every order."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    pair = fresh(counts, "pair")
    entries = F.array(*(F.struct(F.lit(names[i]).alias("one"), F.lit(names[j]).alias("other"), F.lit(1 << i).alias("a"), F.lit(1 << j).alias("b")) for i, j in pairs))
    rows = counts.withColumn(pair, F.explode(entries))
    fails = lambda bit: F.col("mask").bitwiseAND(F.col(f"{pair}.{bit}")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("part", F.col(f"{pair}.one").alias("one"), F.col(f"{pair}.other").alias("other")).agg(
        total(fails("a")).alias("fail_one"), total(fails("b")).alias("fail_other"), total(fails("a") & fails("b")).alias("fail_both"),
    )

"""Topic rules without a limit: an index of the literals that each pattern needs brings a text together with its candidate rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from korpusmill.functions.batches import map_batches
from korpusmill.operators.automaton import by_bytes


class _Unknown(Exception):
    """A construct whose literals are not told."""


def folded(text: str) -> str:
    """Equal for all texts that a pattern without regard to case takes for equal."""
    return text.upper().casefold().replace("̇", "")


def literals(pattern: str) -> frozenset[str] | None:
    """Strings of three letters or more, case folded, one of which stands in every text that the pattern matches; None if none can be told."""
    try:
        found, i = _alternatives(pattern, 0)
    except (_Unknown, IndexError):
        return None
    return found if i == len(pattern) else None


def _alternatives(p: str, i: int) -> tuple[frozenset[str] | None, int]:
    every: list[frozenset[str] | None] = []
    while True:
        found, i = _sequence(p, i)
        every.append(found)
        if i == len(p) or p[i] == ")":
            return (None if None in every else frozenset().union(*every)), i
        i += 1  # the bar


def _sequence(p: str, i: int) -> tuple[frozenset[str] | None, int]:
    """The most telling of what a row of atoms needs."""
    needs: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            needs.append(frozenset({folded(run)}))
        run = ""

    while i < len(p) and p[i] not in "|)":
        atom, i = _atom(p, i)
        least, many, i = _quantifier(p, i)
        if isinstance(atom, str) and least:
            run += atom * min(least, 1)
            if many:
                end()
        else:
            end()
            if isinstance(atom, frozenset) and least:
                needs.append(atom)
    end()
    telling = [n for n in needs if n and min(map(len, n)) >= 3]
    return (max(telling, key=lambda n: (min(map(len, n)), -len(n))) if telling else None), i


def _quantifier(p: str, i: int) -> tuple[int, bool, int]:
    """The least number of times, and whether the atom may stand more often than once."""
    if i == len(p) or p[i] not in "?*+{":
        return 1, False, i
    if p[i] == "{":
        close = p.index("}", i) if "}" in p[i:] else None
        number = p[i + 1 : close].split(",")[0] if close else ""
        if not number.isdigit():
            raise _Unknown
        least, i = int(number), close + 1
    else:
        least, i = int(p[i] == "+"), i + 1
    return least, True, i + (i < len(p) and p[i] in "?+")


def _atom(p: str, i: int) -> tuple[str | frozenset[str] | None, int]:
    c = p[i]
    if c == "(":
        return _group(p, i)
    if c == "[":
        depth, i = 1, i + 1
        while depth:
            if p[i] == "\\":
                if p[i + 1] == "Q":
                    raise _Unknown
                i += 1
            else:
                depth += (p[i] == "[") - (p[i] == "]")
            i += 1
        return None, i
    if c == "\\":
        e = p[i + 1]
        if e in "bBAzZGdDwWsSvVhHRtnrf":
            return None, i + 2
        if e in "pP":
            return None, (p.index("}", i) + 1 if p[i + 2] == "{" else i + 3)
        if e.isalnum():
            raise _Unknown
        return e, i + 2
    if c in "?*+{":
        raise _Unknown
    return (None if c in ".^$" else c), i + 1


def _group(p: str, i: int) -> tuple[frozenset[str] | None, int]:
    told = True
    i += 1
    if p[i] == "?":
        if p[i + 1] in "imsuU" and ")" in p[i:]:
            j = i + 1
            while p[j] in "imsuU":
                j += 1
            if p[j] == ")":
                return None, j + 1
            if p[j] != ":":
                raise _Unknown
            i = j + 1
        elif p[i + 1] in ":>":
            i += 2
        elif p[i + 1] in "=!":
            told, i = False, i + 2
        elif p[i + 1] == "<":
            told = p[i + 2] not in "=!"
            i = p.index(">", i) + 1 if told else i + 3
        else:
            raise _Unknown
    found, i = _alternatives(p, i)
    if p[i] != ")":
        raise _Unknown
    return (found if told else None), i + 1


def _trigrams(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:] if len(points) > 2 else np.zeros(0, np.int64)


@dataclass
class RuleIndex:
    """Literals by one of their trigrams, that which fewest literals have; ``rules`` has the numbers of a literal's rules."""

    keys: np.ndarray
    cuts: np.ndarray
    words: list[str]
    rules: list[list[int]]

    @classmethod
    def of(cls, needs: list[frozenset[str]]) -> RuleIndex:
        by: dict[str, list[int]] = {}
        for k, some in enumerate(needs):
            for word in some:
                by.setdefault(word, []).append(k)
        words = list(by)
        grams = [np.unique(_trigrams(w)) for w in words]
        if not words:
            return cls(np.zeros(0, np.int64), np.zeros(1, np.int64), [], [])
        every, count = np.unique(np.concatenate(grams), return_counts=True)
        rare = np.array([g[count[np.searchsorted(every, g)].argmin()] for g in grams])
        order = np.argsort(rare, kind="stable")
        keys, first = np.unique(rare[order], return_index=True)
        return cls(keys, np.append(first, len(words)), [words[i] for i in order], [by[words[i]] for i in order])

    def candidates(self, text: str) -> list[int]:
        text = folded(text)
        here = _trigrams(text)
        at = np.searchsorted(self.keys, here)
        at[at == len(self.keys)] = 0
        found = np.unique(at[self.keys[at] == here]) if len(self.keys) else []
        return sorted({r for k in found for i in range(self.cuts[k], self.cuts[k + 1]) if self.words[i] in text for r in self.rules[i]})


def topic_filter(blocks: DataFrame, rules: DataFrame, text: str, key: str, at_once: int = 200_000, broadcast_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Blocks that no rule matches, and a log of (block, pattern, reason) for those that one does.

    rules: pattern, reason; as many as there are. Every text is looked through once for the literals that patterns need, and
    only the rules whose literals it holds are tried on it; so work grows with what texts and rules share. Patterns of which
    no literal can be told (``.*``, ``[a-z]+``) are tried on every block, broadcast up to ``broadcast_rows``. Rules are
    indexed ``at_once`` at a time, so memory is bounded. Nothing is dropped without a line in the log.
    """
    spark = blocks.sparkSession
    hit = F.rlike(F.col("_text"), F.concat(F.lit("(?iU)"), F.col("pattern")))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            needs = [literals(p) for p in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([None if n is None else sorted(n) for n in needs], pa.list_(pa.string()))], ["pattern", "reason", "needs"])

    given = rules.filter("pattern is not null").select(F.col("pattern").cast("string"), F.col("reason").cast("string"))
    told_rules = map_batches(given, told, "pattern string, reason string, needs array<string>")
    texts = blocks.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    log = None
    parts = max(1, -(-told_rules.filter("needs is not null").count() // at_once))
    for part in range(parts):
        mine = told_rules.filter("needs is not null").filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        table = mine.toArrow().combine_chunks()
        numbered = F.broadcast(spark.createDataFrame(table.select(["pattern", "reason"]).append_column("_rule", pa.array(range(table.num_rows), pa.int32())))) if table.num_rows else None
        if numbered is None:
            continue
        shared = spark.sparkContext.broadcast(RuleIndex.of([frozenset(n) for n in table.column("needs").to_pylist()]))

        def met(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, 1):
                found = [shared.value.candidates(x) for x in b.column(1).to_pylist()]
                some = pa.array([bool(f) for f in found])
                yield pa.record_batch([*(c.filter(some) for c in b.columns), pa.array([f for f in found if f], pa.list_(pa.int32()))], ["_key", "_text", "_rules"])

        near = map_batches(texts, met, StructType([*texts.schema.fields, StructField("_rules", ArrayType(IntegerType()))]))
        rows = near.select("_key", "_text", F.explode("_rules").alias("_rule")).join(numbered, "_rule").filter(hit).select(F.col("_key").alias(key), "pattern", "reason")
        log = rows if log is None else log.unionByName(rows)
    other = told_rules.filter("needs is null").select("pattern", "reason")
    n = other.limit(broadcast_rows + 1).count()
    if n or log is None:
        rows = texts.join(F.broadcast(other) if n <= broadcast_rows else other, hit).select(F.col("_key").alias(key), "pattern", "reason")
        log = rows if log is None else log.unionByName(rows)
    return blocks.join(log.select(key).distinct(), key, "left_anti"), log


def domain_gate(df: DataFrame, column: str, globs: DataFrame | list[str], broadcast_rows: int = 10_000) -> DataFrame:
    """``quarantine``: true where no glob (a column ``glob``, or a list) fits the dotted domain; a null domain fits none.

    Distinct domains are looked up: globs without a star and those that end with ``.*`` by equality, with the domain or with
    what stands before one of its dots, however many there are; only globs with a star elsewhere are tried one by one.
    """
    spark = df.sparkSession
    table = globs if isinstance(globs, DataFrame) else spark.createDataFrame([(g,) for g in globs], "glob string")
    table = table.filter("glob is not null").select("glob").distinct()
    domains = df.select(F.col(column).alias("_domain")).filter("_domain is not null").distinct()
    plain, whole = ~F.contains("glob", F.lit("*")), F.endswith("glob", F.lit(".*")) & (F.instr("glob", "*") == F.length("glob"))
    dots = F.filter(F.sequence(F.lit(1), F.length("_domain")), lambda i: F.substring(F.col("_domain"), i, F.lit(1)) == ".")
    heads = F.transform(dots, lambda i: F.substring(F.col("_domain"), F.lit(1), i))
    looked = domains.select("_domain", F.explode(F.concat(F.array(F.struct(F.lit(False).alias("whole"), F.col("_domain").alias("text"))), F.transform(heads, lambda h: F.struct(F.lit(True).alias("whole"), h.alias("text"))))).alias("k"))
    keyed = table.filter(plain | whole).select(whole.alias("whole"), F.when(whole, F.expr("left(glob, length(glob) - 1)")).otherwise(F.col("glob")).alias("text"))
    fits = looked.select("_domain", "k.*").join(keyed, ["whole", "text"], "left_semi").select("_domain")
    odd = table.filter(~plain & ~whole)
    n = odd.limit(broadcast_rows + 1).count()
    if n:
        pattern = F.concat(F.lit(r"^\Q"), F.regexp_replace("glob", r"\*", r"\\E.*\\Q"), F.lit(r"\E$"))
        fits = fits.unionByName(domains.join(F.broadcast(odd) if n <= broadcast_rows else odd, F.rlike(F.col("_domain"), pattern)).select("_domain"))
    out = df.join(fits.distinct().withColumn("_fits", F.lit(True)), F.col(column) == F.col("_domain"), "left")
    return out.withColumn("quarantine", F.col("_fits").isNull()).drop("_domain", "_fits")

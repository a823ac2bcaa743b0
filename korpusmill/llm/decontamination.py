"""Benchmark decontamination by template windows, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.llm.common import cut, fresh

#: Units of measure, fixed values: placeholders wherever they stand.
UNITS = (
    "mm cm dm m km mg g kg t ml cl l s min h ms hz khz mhz ghz v w kw mw j kj n pa kpa k mol usd eur gbp dollar dollars cent cents euro euros pound pounds percent "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres mile miles feet foot inch inches yard yards "
    "gram grams kilogram kilograms ton tons liter liters litre litres degree degrees"
).split()
#: Numbers and words. The possessive group is matched in a loop, so a number of any length needs no stack.
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*+|[\p{L}\p{M}]+"
#: The two low bits of a token's code.
PLAIN, NAME, NUMBER, UNIT = range(4)


def codes(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` and ``codes``: a number for each token of the text, the hash of its lower-case form with its kind in the low bits.

    A number is a NUMBER, a unit of measure a UNIT, a word with a capital a NAME. What stands around a token has no say, so an
    item has the same codes wherever it is quoted.
    """
    kind = lambda word, low: F.when(low < ":", NUMBER).when(low.isin(UNITS), UNIT).when(word != low, NAME).otherwise(PLAIN)
    code = lambda word, low: F.xxhash64(low).bitwiseAND(F.lit(-4)).bitwiseOR(kind(word, low).cast("long"))
    words = df.select(*keep, F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)).alias("words"))
    both = words.select(*[F.col(c) for c in words.columns], F.transform("words", F.lower).alias("low"))
    return both.select(*[F.col(c) for c in words.columns if c != "words"], F.zip_with("words", "low", code).alias("codes"))


def _windows(coded: DataFrame, width: int, short: list[int]) -> DataFrame:
    """``pos``, ``win`` and ``w`` of every window of ``width`` tokens, and of those of the ``short`` widths as written.

    A window is found by the hashes ``w``; the first names it, ``win``. Numbers, units and names are placeholders in it; where
    it has names, it is also found with them in lower case, so that letter case does not hide a copy. A window of nothing but
    placeholders says nothing, so its names, or else all its words, are taken as written.

    An outer explode keeps the optimizer from working the array out once more in a filter below it.
    """
    kept = [F.col(c) for c in coded.columns if c != "codes"]
    low = lambda x: x.bitwiseAND(F.lit(3))
    word = lambda x: x.bitwiseAND(F.lit(-4))
    full = F.transform("codes", lambda x: F.when(low(x) == PLAIN, x).otherwise(low(x)))
    cased = F.transform("codes", lambda x: F.when(low(x) <= NAME, word(x)).otherwise(low(x)))
    rows = coded.select(*kept, "codes", full.alias("full"), cased.alias("cased"))
    rows = rows.select(*kept, "codes", "full", "cased", F.posexplode_outer("full").alias("pos", "first")).filter(F.col("pos") <= F.size("codes") - width)
    at = lambda name: [F.get(name, F.col("pos") + j) for j in range(width)]
    pure = lambda name: reduce(mul, [low(x) for x in at(name)]) > 0
    whole = lambda name: F.xxhash64(*at(name))
    rows = rows.select(*kept, "pos", whole("full").alias("f"), whole("cased").alias("c"), F.when(pure("cased"), F.xxhash64(*[word(x) for x in at("codes")])).alias("r"), pure("full").alias("p"))
    forms = F.when(F.col("r").isNotNull(), F.array("r")).when(F.col("p"), F.array("c")).when(F.col("f") != F.col("c"), F.array("f", "c")).otherwise(F.array("f"))
    out = rows.select(*kept, "pos", F.coalesce("r", F.when(F.col("p"), F.col("c")).otherwise(F.col("f"))).alias("win"), F.explode(forms).alias("w"))
    for n in short:
        place = coded.select(*kept, "codes", F.posexplode_outer("codes").alias("pos", "first")).filter(F.col("pos") <= F.size("codes") - n)
        written = F.xxhash64(F.lit(n), *[word(F.get("codes", F.col("pos") + j)) for j in range(n)])
        out = out.unionByName(place.select(*kept, "pos", written.alias("win"), written.alias("w")))
    return out


def _checked(df: DataFrame, most: int) -> DataFrame:
    """A narrow table, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, similarity: float, consistency: float, broadcast_rows: int, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """``id`` and text hash ``d`` of a document, ``item`` and text hash ``t`` of a benchmark item that it holds, with the counts."""
    items = cut(codes(benchmark.filter(F.col(item_id).isNotNull()), item_text, F.col(item_id).alias("item"), F.xxhash64(item_text).alias("t")).filter(F.size("codes") > 0).distinct())
    sizes = [r.n for r in items.select(F.least(F.size("codes"), F.lit(width)).alias("n")).distinct().collect()]  # width numbers at most
    short = sorted(n for n in sizes if n < width)
    # an item has windows of one width; short ones are a single window
    shingled = _windows(items.filter(F.size("codes") >= width), width, [])
    for n in short:
        shingled = shingled.unionByName(_windows(items.filter(F.size("codes") == n), width, [n]))
    bench = cut(shingled.groupBy("item", "t", "win", F.col("w").alias("bw")).agg(F.min("pos").alias("at")))
    per_item = _checked(bench.groupBy("item", "t").agg(F.count_distinct("win").alias("n_windows")), broadcast_rows)
    coded = lambda df: codes(df, text, F.col(doc_id).alias("id"), F.xxhash64(text).alias("d"))
    hits = _windows(coded(docs.filter(F.col(doc_id).isNotNull())), width, short).drop("win").join(_checked(bench, broadcast_rows), F.col("w") == F.col("bw"))
    pair = ["id", "d", "item", "t"]
    hits = cut(hits.groupBy(*pair, "win", (F.col("pos") - F.col("at")).alias("shift")).agg(F.min("at").alias("at")))
    found = hits.groupBy(*pair).agg(F.count_distinct("win").alias("n_matched")).join(per_item, ["item", "t"]).filter(F.col("n_matched") >= similarity * F.col("n_windows"))
    found = cut(found.select(*pair, "n_matched", "n_windows"))
    # each placeholder under a matched window has a place in the document, along the alignment that most windows share
    slots = items.filter(F.size("codes") >= width).select("item", "t", F.posexplode("codes").alias("p", "code")).filter(F.col("code").bitwiseAND(F.lit(3)) != PLAIN)
    slots = slots.select("item", "t", "p", F.col("code").bitwiseAND(F.lit(-4)).alias("theirs"))
    lines = hits.join(_checked(found.select(*pair), broadcast_rows), pair, "left_semi").withColumn("n", F.count("*").over(W.partitionBy(*pair, "shift")))
    under = lines.select(*pair, "shift", "n", F.explode(F.sequence(F.col("at"), F.col("at") + width - 1)).alias("p"))
    under = under.join(_checked(slots, broadcast_rows), ["item", "t", "p"]).groupBy(*pair, "p", "theirs").agg(F.max(F.struct("n", (-F.col("shift")).alias("s"))).alias("best"))
    # the texts of the few pairs found come back for their values
    wanted = _checked(found.select(F.col("id").alias(doc_id)).distinct(), broadcast_rows)
    ours = coded(docs.join(wanted, doc_id, "left_semi"))
    filled = under.join(ours, ["id", "d"]).select(*pair, "p", "theirs", F.get("codes", F.col("p") - F.col("best.s")).bitwiseAND(F.lit(-4)).alias("ours")).distinct()
    first = lambda value, by: F.first(value).over(W.partitionBy(*pair, by).orderBy("p"))
    filled = filled.select(*pair, ((first("ours", "theirs") == F.col("ours")) & (first("theirs", "ours") == F.col("theirs"))).cast("int").alias("ok"))
    counts = filled.groupBy(*pair).agg(F.count("*").alias("n_slots"), F.sum("ok").alias("n_consistent"))
    out = found.join(counts, pair, "left").fillna(0, ["n_slots", "n_consistent"])
    return out.filter(F.col("n_consistent") >= consistency * F.col("n_slots"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, consistency: float = 0.8, broadcast_rows: int = 2_000_000,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: ``doc_id``, ``item_id``, ``n_matched``, ``n_windows``, ``n_slots``, ``n_consistent``.

    Both sides become templates (:func:`codes`): numbers, names (words with a capital) and units are typed placeholders, so an
    item with other values still matches. A pair counts if the document has at least ``similarity`` of the item's distinct
    windows of ``width`` words, and if at least ``consistency`` of the placeholders under those windows are filled one to
    one: equal values of the item have equal values in the document, and different ones different values. An exact
    copy matches wherever it stands, in any letter case.

    Items of fewer than ``width`` words are one window, matched by their words as written but for case; items without words
    match nothing. Null and empty texts match nothing; ids that are null are left out; rows that share an id are each judged by
    their own text and give a pair once, with the best counts; an empty side gives an empty result; texts of any length are
    read whole, in linear time; other columns play no part. Windows of the benchmark, and ids of documents found, are
    broadcast only if they are at most ``broadcast_rows``; beyond that the joins shuffle, and adaptive execution splits
    hot windows.
    """
    out = _leaks(docs, benchmark, width, similarity, consistency, broadcast_rows, doc_id, text, item_id, item_text)
    best = F.max(F.struct("n_matched", "n_consistent", "n_windows", "n_slots")).alias("s")
    out = out.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(best)
    return out.select("doc_id", "item_id", "s.n_matched", "s.n_windows", "s.n_slots", "s.n_consistent")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, consistency: float = 0.8, broadcast_rows: int = 2_000_000,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (:func:`contaminated`), with the same columns.

    Of rows that share an id only those go whose text holds one; rows with a null id stay.
    """
    own, of = fresh(docs, "leak"), fresh(docs, "text_hash")
    leaks = _leaks(docs, benchmark, width, similarity, consistency, broadcast_rows, doc_id, text, item_id, item_text)
    leaks = _checked(cut(leaks.select(F.col("id").alias(own), F.col("d").alias(of)).distinct()), broadcast_rows)
    return docs.join(leaks, (F.col(doc_id) == F.col(own)) & (F.xxhash64(F.col(text)) == F.col(of)), "left_anti")

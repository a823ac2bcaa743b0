"""Mentions to known entities: dictionary scan, ledger, resolution, all-pairs similarity and recovery."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from korpusmill.functions import text as T
from korpusmill.functions.batches import map_batches
from korpusmill.functions.checkpoints import cut
from korpusmill.functions.sizes import small
from korpusmill.operators.automaton import PhraseTrie, by_bytes
from korpusmill.operators.retrieval import dense_topk
from korpusmill.operators.vector_index import VectorIndex


def words(text: Column) -> Column:
    return F.filter(F.split(fold_words(text), " "), lambda w: w != "")


def ngrams(df: DataFrame, id_col: str, text: str, lengths: list[int]) -> DataFrame:
    """Distinct (id, gram): hashes of the runs of as many words as ``lengths`` say, lower-case and without accents."""
    hashed = df.select(F.col(id_col), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))
    run = lambda n: F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(id_col, F.explode(F.array_distinct(F.concat(*[run(n) for n in lengths]))).alias("gram"))


def fold_words(c: Column) -> Column:
    return F.regexp_replace(T.fold(F.lower(c)), r"[^\p{L}\p{N}]+", " ")


def scan_aliases(docs: DataFrame, aliases: DataFrame, stop: list[str] = [], least: int = 4, anchor: int = 3, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:  # noqa: B006
    """(page_id, doc_id) for each alias that stands in a document as whole words, case and accents aside.

    Aliases of at most ``broadcast_bytes`` together become one trie that every task has, and each text is read once, whatever
    the lengths of aliases; nothing but hits leaves the task. More of them are met by a join: documents become hashed runs of
    words, of ``anchor`` words at the most, and a longer alias is looked for by its first ``anchor`` and then compared whole.
    Aliases shorter than ``least`` count only if canonical; stop words never do. Aliases that are equal but for case and
    accents each give their pages; null aliases and texts give none; rows of ``docs`` that repeat give one row.
    """
    key = F.array_join(words(F.col("alias")), " ")
    table = aliases.select("page_id", key.alias("key"), F.coalesce("canonical", F.lit(False)).alias("canonical"))
    table = table.filter(((F.length("key") >= least) | F.col("canonical")) & ~F.col("key").isin(*stop) & (F.col("key") != "")).select("page_id", "key").distinct()
    size = table.agg(F.sum(F.octet_length("key") + 64).alias("bytes")).first().bytes or 0  # with what the trie holds beside
    if size > broadcast_bytes:
        return _scan_by_join(docs, table, anchor, doc_id, text)
    listed = table.orderBy("key", "page_id").toArrow().combine_chunks()
    coded = listed.column("key").combine_chunks().dictionary_encode()
    cuts = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1))
    pages = listed.column("page_id").combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((PhraseTrie.of(coded.dictionary.to_pylist()), cuts, pages))
    folded = docs.select(F.col(doc_id), fold_words(F.col(text)).alias("folded"))

    def run(batches):
        trie, cuts, pages = shared.value
        for b in by_bytes(batches, 1):
            row, phrase = np.divmod(np.unique(np.array(trie.find(b.column(1))).T @ np.array([max(len(cuts), 1), 1])), max(len(cuts), 1))
            size = cuts[phrase + 1] - cuts[phrase]
            ends = np.cumsum(size)
            which = np.arange(ends[-1] if len(ends) else 0) + np.repeat(cuts[phrase] - ends + size, size)
            yield pa.record_batch([pages.take(pa.array(which)), b.column(0).take(pa.array(np.repeat(row, size)))], ["page_id", doc_id])

    return map_batches(folded, run, StructType([table.schema["page_id"], folded.schema[doc_id]])).distinct()


def _scan_by_join(docs: DataFrame, table: DataFrame, anchor: int, doc_id: str, text: str) -> DataFrame:
    """The same by an equality join on hashes of 64 bits, for any number of aliases (``page_id``, ``key``)."""
    table = table.select("page_id", "key", F.transform(F.split("key", " "), lambda w: F.xxhash64(w)).alias("h"))
    lengths = sorted(r.n for r in table.select(F.least(F.size("h"), F.lit(anchor)).alias("n")).distinct().collect())  # anchor numbers at most
    gram = F.coalesce(*[F.when(F.least(F.size("h"), F.lit(anchor)) == n, F.xxhash64(*[F.get("h", F.lit(j)) for j in range(n)])) for n in lengths])
    table = table.select("page_id", gram.alias("gram"), F.when(F.size("h") > anchor, F.concat(F.lit(" "), "key", F.lit(" "))).alias("rest"))
    hits = ngrams(docs, doc_id, text, lengths).join(table, "gram").select("page_id", doc_id, "rest").distinct()
    long = hits.filter("rest is not null").join(docs.select(doc_id, F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" ")).alias("folded")), doc_id)
    return hits.filter("rest is null").select("page_id", doc_id).unionByName(long.filter(F.contains("folded", F.col("rest"))).select("page_id", doc_id)).distinct()


def ledger(entries: DataFrame, terms: DataFrame, entry: str = "entry_id", surface: str = "surface_form", least: int = 4, broadcast_rows: int = 100_000) -> DataFrame:
    """Entries whose normalised surface form contains a term (page_id, term) of ``least`` characters or more, anywhere.

    Terms and surfaces are cut into character n-grams of ``least``. A term is looked for by that of its n-grams which the
    fewest surfaces have, so a common prefix costs nothing; only those pairs are compared. At most ``broadcast_rows`` terms
    are sent to the tasks; more are joined. The n-grams of the surfaces are never sent: Spark sizes them by the table that they
    are exploded from, and would take them for small.
    """
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substr(c, i, F.lit(least)))))
    t = terms.select("page_id", T.match_norm(F.col("term")).alias("term")).filter(F.length("term") >= least).distinct()
    s = entries.select(F.col(entry), T.match_norm(F.col(surface)).alias("s")).filter(F.length("s") >= least).withColumn("gram", grams(F.col("s")))
    seen = s.groupBy("gram").agg(F.count("*").alias("n")).hint("merge")
    rare = t.withColumn("gram", grams(F.col("term"))).hint("merge").join(seen, "gram", "left").groupBy("page_id", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    rare = small(cut(rare.filter("g.n > 0").select("page_id", "term", "g.gram")), broadcast_rows)
    return s.hint("merge").join(rare, "gram").filter(F.contains("s", F.col("term"))).select(entry, "page_id").distinct()


def alias_map(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """One page for each key: ids before names before aliases, then the smallest page id."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    rows = pages.select(key("page_id").alias("key"), F.lit(0).alias("p"), "page_id").unionByName(pages.select(key("canonical_name").alias("key"), F.lit(1).alias("p"), "page_id"))
    rows = rows.unionByName(aliases.select(key("alias").alias("key"), F.lit(2).alias("p"), "page_id")).filter("key is not null and key <> ''")
    return rows.groupBy("key").agg(F.min(F.struct("p", "page_id")).alias("m")).select("key", "m.page_id")


def resolve(candidates: DataFrame, mapping: DataFrame, guess: str = "canonical_guess", surface: str = "surface_form") -> DataFrame:
    """``page_id``: the page that the guess names, else the one that the surface form names, else null."""
    a, b = mapping.toDF("_k1", "_p1"), mapping.toDF("_k2", "_p2")
    out = candidates.join(a, F.lower(F.trim(F.col(guess))) == F.col("_k1"), "left").join(b, F.lower(F.trim(F.col(surface))) == F.col("_k2"), "left")
    return out.withColumn("page_id", F.coalesce("_p1", "_p2")).drop("_k1", "_k2", "_p1", "_p2")


def match_topk(left: DataFrame, right: DataFrame | VectorIndex, k: int = 5, least: float = 0.5, exact: bool = True) -> DataFrame:
    """The k best right rows of each left row by cosine, if its best reaches ``least``.

    An index on the right is read in the cells that can hold one of them, or in the nearest ones if not ``exact``; a plain table is scored whole.
    """
    hits = cut(right.search(left, k, exact=exact)) if isinstance(right, VectorIndex) else dense_topk(left, right, k)
    good = hits.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= least).select("query_id")
    return hits.join(good, "query_id", "left_semi")


def cached_decisions(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (surface, reason, ids) with their cached decision: ``state`` is hit, miss or applied."""
    key = F.concat(T.cache_key(T.match_norm(F.col("surface")), F.col("reason")), F.lit(":"), T.cache_key(F.array_join("ids", "|")))
    out = pairs.withColumn("cache_key", key).join(decisions.select("cache_key", "confidence", "applied_at", F.lit(1).alias("_hit")), "cache_key", "left")
    return out.withColumn("state", F.when(F.col("_hit").isNull(), "miss").when(F.col("applied_at").isNotNull(), "applied").otherwise("hit")).drop("_hit")


def apply_recovery(decisions: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Outcome of each confident decision (page_id, doc_id, alias, alias_ok, confidence, applied_at); applied ones are left alone, so a second run does nothing."""
    todo = decisions.filter((F.col("confidence") == "high") & F.col("applied_at").isNull())
    out = todo.join(pages.select("page_id", F.lit(1).alias("_p")).distinct(), "page_id", "left").join(docs.select("doc_id", F.lit(1).alias("_d")).distinct(), "doc_id", "left")
    outcome = F.when(F.col("_p").isNull(), "page_missing").when(F.col("_d").isNull(), "video_missing").when(F.coalesce("alias_ok", F.lit(False)), "applied_citation+alias").otherwise("applied_citation")
    return out.withColumn("outcome", outcome).drop("_p", "_d")


def materialise(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations per (page, document): existing and new times together, sorted, and how many are new. Findings without a time are left out."""
    new = findings.filter("ts is not null").groupBy("page_id", "doc_id").agg(F.collect_set("ts").alias("new"))
    old = citations.groupBy("page_id", "doc_id").agg(F.collect_set("ts").alias("old"))
    none = F.array().cast(new.schema["new"].dataType)
    both = new.join(old, ["page_id", "doc_id"], "full_outer").select("page_id", "doc_id", F.coalesce("new", none).alias("new"), F.coalesce("old", none).alias("old"))
    return both.select("page_id", "doc_id", F.array_join(F.array_sort(F.array_union("old", "new")), ",").alias("times"), F.size(F.array_except("new", "old")).alias("n_new"))


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases with those of ``new`` that no alias of the page equals, case and accents aside; the first of equal new ones."""
    have = aliases.select("page_id", T.match_norm(F.col("alias")).alias("_k"))
    add = new.withColumn("_k", T.match_norm(F.col("alias"))).join(have, ["page_id", "_k"], "left_anti").groupBy("page_id", "_k").agg(F.min("alias").alias("alias"))
    return aliases.select("page_id", "alias").unionByName(add.select("page_id", "alias"))

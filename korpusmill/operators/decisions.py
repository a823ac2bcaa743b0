"""The decision log: aggregates, review queues and audits.

log: doc_id, entity, decision, minutes, flag columns, one row an occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK = {"high": 0, "medium": 1, "low": 2}


def explode_records(records: DataFrame, arrays: dict[str, str], key: str = "doc_id") -> DataFrame:
    """One row for each element of several lists of a record; ``arrays`` maps a list to the decision it implies if the element names none."""
    out = None
    for name, default in arrays.items():
        rows = records.select(key, F.explode(name).alias("e")).select(key, "e.*", F.lit(default).alias("_default"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("decision", F.coalesce("decision", "_default")).drop("_default")


def aggregate_log(log: DataFrame, by: list[str], flags: list[str] = []) -> DataFrame:  # noqa: B006
    """Per entity: occurrences, distinct decisions (a missing one is "discard"), minutes (missing ones are 0), documents, flags (true if any is)."""
    decision = F.coalesce("decision", F.lit("discard"))
    return log.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.round(F.sum(F.coalesce("minutes", F.lit(0.0))), 2).alias("minutes"),
        F.array_sort(F.collect_set(decision)).alias("decisions"), *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags],
    )


def review_priority(external: Column, whitelisted: Column, n: Column, minutes: Column, decisions: Column, promoting: list[str], discard: str = "discard") -> Column:
    """Priority and reason of an aggregated entity, by the first rule that holds."""
    dropped, promoted = F.array_contains(decisions, discard), F.arrays_overlap(decisions, F.array(*[F.lit(p) for p in promoting]))
    of = lambda p, why: F.struct(F.lit(p).alias("priority"), F.lit(why).alias("reason"))
    return (
        F.when(external & dropped, of("high", "external entity discarded")).when((n >= 3) & ~promoted, of("high", "recurrent without promotion"))
        .when((minutes >= 20) & (n >= 2) & ~promoted, of("high", "sustained without promotion")).when((n >= 2) & (F.size(decisions) > 1), of("high", "inconsistent decisions"))
        .when(whitelisted & dropped, of("medium", "whitelisted entity discarded")).otherwise(of("low", None))
    )


def run_stats(log: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), *[F.count_if(F.coalesce("decision", F.lit("discard")) == k).alias(f"n_{k}") for k in kinds])


def bibliography(refs: DataFrame) -> DataFrame:
    """References (title, surface, author, domain, seq) by title (else surface form, else "unknown"): authors in order of first sight, first domain, count."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("surface", F.lit("")), F.lit("unknown"))
    # each author once before the titles are gathered, so that a title that many references share stays a short list
    by_author = refs.groupBy(title.alias("book_title"), "author").agg(F.min("seq").alias("seq"), F.min(F.when(F.col("domain").isNotNull(), F.struct("seq", "domain"))).alias("d"), F.count("*").alias("n"))
    out = by_author.groupBy("book_title").agg(F.array_sort(F.collect_list(F.struct("seq", "author"))).alias("x"), F.min("d").alias("d"), F.sum("n").alias("n"))
    return out.select("book_title", F.array_join(F.transform("x", lambda e: e["author"]), ",").alias("authors"), F.col("d.domain").alias("domain"), "n")


def recurrence_facts(log: DataFrame, by: str, flag: Column) -> DataFrame:
    return log.groupBy(by).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("minutes").alias("max_minutes"), F.round(F.sum("minutes"), 2).alias("minutes"), F.bool_or(flag).alias("flagged"))


def compile_inputs(decisions: DataFrame, updates: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: whether it is new, decisions and updates proposed, distinct source documents; most proposed first."""
    both = decisions.select("page_id", "doc_id", F.lit(1).alias("d"), F.lit(0).alias("u")).unionByName(updates.select("page_id", "doc_id", F.lit(0).alias("d"), F.lit(1).alias("u")))
    out = both.groupBy("page_id").agg(F.sum("d").alias("n_proposed"), F.sum("u").alias("n_updates"), F.count_distinct("doc_id").alias("n_sources"))
    out = out.join(pages.select("page_id", F.lit(False).alias("_old")).distinct(), "page_id", "left").withColumn("is_new", F.coalesce("_old", F.lit(True))).drop("_old")
    return out.orderBy(F.desc("n_proposed"), F.desc("n_updates"), "page_id")


def stale(entries: DataFrame, fresh_docs: DataFrame, new_code: str = "new_code", least: int = 3) -> DataFrame:
    """Documents with ``least`` or more entries that the present rules would decide otherwise, but for those already decided by them."""
    old = entries.filter(F.col(new_code).isNotNull()).join(fresh_docs.select("doc_id").distinct(), "doc_id", "left_anti")
    return old.groupBy("doc_id").agg(F.count("*").alias("n_stale"), F.count_distinct(new_code).alias("n_codes")).filter(F.col("n_stale") >= least)


def worklist(flagged: DataFrame, docs: DataFrame) -> DataFrame:
    """Flagged documents: those in the corpus to process again, the rest reported missing."""
    here = flagged.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("status", F.lit("reprocess"))
    return here.unionByName(flagged.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("status", F.lit("missing")))


def audit_by_page(findings: DataFrame, least: int = 1) -> DataFrame:
    """Findings per page with a histogram of their priorities; most first."""
    out = findings.groupBy("page_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("priority") == p).alias(p) for p in RANK])
    return out.filter(F.col("n") >= least).orderBy(F.desc("n"), "page_id")


def priority_order(c: Column) -> Column:
    out = F.lit(len(RANK))
    for name, i in RANK.items():
        out = F.when(c == name, i).otherwise(out)
    return out


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def visible_before(events: DataFrame, batch: str, order: str, page: str, created: Column) -> DataFrame:
    """For each row, whether an earlier row of the same batch created its page."""
    w = W.partitionBy(batch, page).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("visible", F.coalesce(F.max(created.cast("int")).over(w), F.lit(0)) == 1)


def recovery_stats(outcomes: DataFrame, by: list[str], confidences: list[str] = ["high", "medium", "low"]) -> DataFrame:  # noqa: B006
    """Of a recovery run (``by``, ``eligible``, ``state`` hit, miss or skipped, ``confidence``): eligible entries, hits, misses, skipped, and matches by confidence."""
    one = lambda name, condition: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    state = F.col("state")
    matched = [one(f"matched_{c}", state.isin("hit", "miss") & (F.col("confidence") == c)) for c in confidences]
    return outcomes.groupBy(*by).agg(one("eligible", F.col("eligible")), one("hits", state == "hit"), one("misses", state == "miss"), one("skipped", state == "skipped"), *matched)


def has_marker(lists: dict, texts: list[Column], scalars: list[Column]) -> Column:
    """Whether a record shows any sign of the newer schema: an element of a list that meets its condition, a filled text, or a scalar that is there.

    lists: the name of a list column to the condition on its elements, a function of a column; nulls are no sign.
    """
    signs = [F.exists(F.col(c), test) for c, test in lists.items()] + [F.trim(t) != "" for t in texts] + [s.isNotNull() for s in scalars]
    out = F.lit(False)
    for sign in signs:
        out = out | F.coalesce(sign, F.lit(False))
    return out


def all_runs(log: DataFrame, flags: list[str], kinds: list[str], external: Column, listed: Column, promoting: list[str], run: str = "run_id", by: str = "entity") -> dict[str, DataFrame]:
    """Every run aggregated again: ``entities`` with their review priority and ``stats``, keyed by run; runs without rows have none."""
    entities = aggregate_log(log, [run, by], flags)
    p = review_priority(external, listed, F.col("n"), F.col("minutes"), F.col("decisions"), promoting)
    entities = entities.withColumn("_p", p).select(*entities.columns, F.col("_p.priority").alias("priority"), F.col("_p.reason").alias("reason"))
    return {"entities": entities, "stats": run_stats(log, [run], kinds)}


def quarantine(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Records without errors, and the others with theirs; :func:`korpusmill.sources.tables.write_split` writes both. errors: an array with nulls for checks that passed."""
    marked = df.withColumn("errors", F.filter(errors, lambda e: e.isNotNull()))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)

"""Row predicates and projections over chunks, pages and decision records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions import text as T
from korpusmill.functions.sizes import small
from korpusmill.operators.topic_rules import domain_gate, topic_filter  # noqa: F401


def equals(df: DataFrame, filters: dict) -> DataFrame:
    """Rows equal in all given columns; a value of None is no condition, a list is any of its values."""
    kept = [F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in filters.items() if v is not None and v != []]
    return df.filter(reduce(Column.__and__, kept, F.lit(True)))


def must_not(df: DataFrame, filters: dict) -> DataFrame:
    """Rows that equal none of the values; rows without a value pass."""
    return df.filter(reduce(Column.__and__, [~F.col(k).eqNullSafe(v) for k, v in filters.items()], F.lit(True)))


def absent(df: DataFrame, field: str, include: bool = False) -> DataFrame:
    return df if include else df.filter(F.col(field).isNull())


def canonical(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``column`` replaced by the name in ``names`` (column ``name``) that it equals but for case and accents; others stay.

    ``names`` is a list of categories, broadcast if it is small.
    """
    table = names.select(F.col("name").alias("_name"), T.match_norm(F.col("name")).alias("_key")).dropDuplicates(["_key"])
    out = df.join(small(table), T.match_norm(F.col(column)) == F.col("_key"), "left")
    return out.withColumn(column, F.coalesce("_name", column)).drop("_name", "_key")


def compact(df: DataFrame, score: str = "score", title: str = "title", url: str = "url", seconds: str = "timestamp_seconds") -> DataFrame:
    """Score at four digits, and a Markdown citation of title, time and deep link."""
    at = T.seconds_to_time(F.col(seconds))
    cite = F.concat(F.lit("["), F.col(title), F.lit(" ("), at, F.lit(")]("), T.deep_link(F.col(url), F.col(seconds)), F.lit(")"))
    return df.withColumn(score, F.round(score, 4)).withColumn("cite_markdown", cite)


def tag_policy(chunks: DataFrame, flags: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``policy_filter``: the latest flag of each key by ``order``, as a struct; null where there is none."""
    rest = [c for c in flags.columns if c not in keys]
    latest = flags.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("policy_filter"))
    return chunks.join(latest, keys, "left")


def recoverable(df: DataFrame, reasons: list[str], reason: str = "reason_code", surface: str = "surface_form", chars: int = 120, words: int = 15) -> DataFrame:
    """Discarded entries for one of ``reasons`` with a short surface form."""
    n = F.size(F.split(F.trim(F.col(surface)), r"\s+"))
    return df.filter(F.col(reason).isin(*reasons) & (F.length(surface) <= chars) & (n <= words))


def alias_ok(alias: Column, surface: Column, chars: int = 50, words: int = 4) -> Column:
    """A short alias that stands in the surface form as whole words, case and accents aside."""
    a, s = T.match_norm(alias), T.match_norm(surface)
    inside = F.contains(F.concat(F.lit(" "), F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(a, r"[^\p{L}\p{N}]+", " "), F.lit(" ")))
    return (F.length(alias) <= chars) & (F.size(F.split(F.trim(alias), r"\s+")) <= words) & (a != "") & inside


def verify_quotes(entries: DataFrame, docs: DataFrame, quotes: str = "quotes", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``quotes_ok``: every quote of the list occurs in the document after cosmetic normalisation. Null and blank quotes pass."""
    source = docs.select(F.col(doc).alias("_doc"), T.quote_norm(F.col(text)).alias("_text"))
    ok = F.forall(F.coalesce(F.col(quotes), F.array().cast("array<string>")), lambda q: q.isNull() | (F.trim(q) == "") | F.contains("_text", T.quote_norm(q)))
    return entries.join(source, F.col(doc) == F.col("_doc"), "left").withColumn("quotes_ok", F.coalesce(ok, F.lit(False))).drop("_doc", "_text")


def all_empty(df: DataFrame, arrays: list[str]) -> Column:
    """True where every list is null or empty."""
    return reduce(Column.__and__, [F.coalesce(F.size(F.col(a)), F.lit(0)) <= 0 for a in arrays])


def auto_promote(minutes: Column, marks: Column, parts: Column, needs_human: Column, least: tuple[int, int, int] = (30, 3, 4)) -> Column:
    """Enough minutes, marks and parts, and no human asked for; what is missing counts as nothing."""
    zero = F.lit(0)
    return (F.coalesce(minutes.try_cast("int"), zero) >= least[0]) & (F.coalesce(marks, zero) >= least[1]) & (F.coalesce(parts, zero) >= least[2]) & ~F.coalesce(needs_human, F.lit(False))


def promotion_rule(page_type: Column, thresholds: dict[str, dict[str, float]], facts: dict[str, Column]) -> Column:
    """True if any threshold of the row's page type is met. thresholds: type to {fact: least}."""
    out = F.lit(False)
    for kind, limits in thresholds.items():
        out = F.when(page_type == kind, reduce(Column.__or__, [facts[f] >= least for f, least in limits.items()])).otherwise(out)
    return out


def classify(reason: Column, text: Column, rules: list[tuple[list[str], str | None, str]]) -> Column:
    """The new code of the first rule (reasons, pattern or None, new code) that fits; null if none does."""
    out = F.lit(None).cast("string")
    for reasons, pattern, code in reversed(rules):
        fits = reason.isin(*reasons) if reasons else F.lit(True)
        out = F.when(fits & (F.rlike(text, F.lit("(?iU)" + pattern)) if pattern else F.lit(True)), F.lit(code)).otherwise(out)
    return out


def source_type(url: Column) -> Column:
    """Kind of a source by its address, by the first rule that fits."""
    low = F.lower(url)
    return (
        F.when(F.rlike(low, F.lit(r"(youtube\.com/|youtu\.be/)")), "youtube").when(F.rlike(low, F.lit(r"(arxiv\.org/|doi\.org/)")), "paper")
        .when(F.rlike(low, F.lit(r"\.pdf(\?|#|$)")), "pdf").when(F.rlike(low, F.lit("^https?://")), "web").otherwise("unknown")
    )


def valid_slug(c: Column) -> Column:
    return F.rlike(c, F.lit("^[a-z][a-z0-9-]{1,40}[a-z0-9]$"))


def valid_page_id(c: Column) -> Column:
    return F.rlike(c, F.lit("^[a-z0-9][a-z0-9_-]*$"))


def catalogue(pages: DataFrame, relations: DataFrame, aliases: DataFrame, order: list[str], most: int = 5, chars: int = 120) -> DataFrame:
    """One line per page: name, type, aliases (first ``chars``), first ``most`` relations by ``order`` (as stated) and how many more there are.

    Lists are cut before they are collected: ``most`` relations, and as many aliases as fit.
    """
    from pyspark.sql import Window as W

    ranked = relations.withColumn("_n", F.row_number().over(W.partitionBy("from_page_id").orderBy(*order)))
    kept = F.when(F.col("_n") <= most, F.struct("_n", F.concat_ws(":", "type", "to_page_id").alias("x")))
    rel = ranked.groupBy(F.col("from_page_id").alias("page_id")).agg(F.array_sort(F.collect_list(kept)).alias("rel"), F.count("*").alias("n_rel"))
    rel = rel.select("page_id", F.transform("rel", lambda r: r["x"]).alias("rel"), "n_rel")
    first = aliases.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("alias"))).filter(F.col("_n") <= chars)
    ali = first.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), ", ").alias("ali"))
    n = F.coalesce("n_rel", F.lit(0))
    shown = F.array_join(F.slice(F.coalesce("rel", F.array().cast("array<string>")), 1, most), "; ")
    return pages.join(rel, "page_id", "left").join(ali, "page_id", "left").select(
        "page_id", "page_type", "canonical_name", F.substring(F.coalesce("ali", F.lit("")), 1, chars).alias("aliases"),
        F.concat(shown, F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(")"))).otherwise("")).alias("relations"),
    )


def bundle(items: DataFrame, key: str, order: list[str], fields: dict[str, int], most: int) -> DataFrame:
    """Per key the first ``most`` items by ``order`` with their fields cut to given lengths, and how many there are in all."""
    from pyspark.sql import Window as W

    ranked = items.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).withColumn("_all", F.count("*").over(W.partitionBy(key)))
    cut = F.struct("_n", *[F.substring(F.col(f).cast("string"), 1, n).alias(f) for f, n in fields.items()])
    out = ranked.filter(F.col("_n") <= most).groupBy(key).agg(F.array_sort(F.collect_list(cut)).alias("items"), F.max("_all").alias("n_items"))
    return out.withColumn("items", F.transform("items", lambda x: F.concat_ws("|", *[x[f] for f in fields])))

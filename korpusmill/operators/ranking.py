"""What to document next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recurrence(hits: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Per candidate over all its query variants: chunks (each at its best score) at ``threshold`` or more, mean of the ten best, and the commonest category.

    hits: candidate, chunk_id, category, score.
    """
    best = hits.groupBy("candidate", "chunk_id").agg(F.max("score").alias("score"), F.min("category").alias("category"))
    w = W.partitionBy("candidate").orderBy(F.desc("score"), "chunk_id")
    ranked = best.withColumn("r", F.row_number().over(w))
    good = ranked.filter(F.col("score") >= threshold).groupBy("candidate", "category").agg(F.count("*").alias("n")).groupBy("candidate").agg(F.max_by("category", F.struct("n", -F.hash("category"), "category")).alias("dominant"))
    out = ranked.groupBy("candidate").agg(F.count_if(F.col("score") >= threshold).alias("n_chunks"), F.round(F.avg(F.when(F.col("r") <= 10, F.col("score"))), 4).alias("avg_top10"))
    return out.join(good, "candidate", "left")


def rank_candidates(rec: DataFrame, incoming: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), min_chunks: int = 10, min_avg: float = 0.55) -> DataFrame:
    """Score of each candidate: recurrence and incoming links by their greatest value, and a bonus; best first.

    incoming: candidate, n_in, bonus. A candidate is viable with enough chunks of enough mean score.
    """
    both = rec.join(incoming, "candidate", "left").withColumn("n_in", F.coalesce("n_in", F.lit(0))).withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    top = both.agg(F.greatest(F.max("n_chunks"), F.lit(1)).alias("max_n"), F.greatest(F.max("n_in"), F.lit(1)).alias("max_in"))
    both = both.crossJoin(F.broadcast(top))  # one row
    score = F.round(weights[0] * F.col("n_chunks") / F.col("max_n") + weights[1] * F.col("n_in") / F.col("max_in") + weights[2] * F.col("bonus"), 4)
    why = F.when(F.col("n_chunks") < min_chunks, "few chunks").when(F.coalesce("avg_top10", F.lit(0.0)) < min_avg, "low scores").otherwise("ok")
    return both.select("candidate", score.alias("score"), "n_chunks", "avg_top10", "n_in", why.alias("reason"), (why == "ok").alias("viable")).orderBy(F.desc("score"), "candidate")


def weighted_rank(facts: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """A weighted sum of facts, each divided by its greatest value; nothing is left out. Best first."""
    top = facts.agg(*[F.greatest(F.max(c).cast("double"), F.lit(1e-9)).alias(f"_{c}") for c in weights])
    score = sum((w * F.coalesce(F.col(c), F.lit(0)) / F.col(f"_{c}") for c, w in weights.items()), F.lit(0.0))
    return facts.crossJoin(F.broadcast(top)).select(key, F.round(score, 4).alias("score")).orderBy(F.desc("score"), key)


def coverage(docs: DataFrame, ledger: DataFrame, log: DataFrame) -> DataFrame:
    """Per document whether it was processed, and how many themes the log proposes, filters and queues for it."""
    done = ledger.select("doc_id", F.lit(True).alias("processed")).distinct()
    n = log.groupBy("doc_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("proposed", "filtered", "queued")])
    out = docs.select("doc_id").join(done, "doc_id", "left").join(n, "doc_id", "left")
    zero = {s: F.coalesce(s, F.lit(0)).alias(s) for s in ("proposed", "filtered", "queued")}
    status = F.when(F.coalesce("processed", F.lit(False)) & (F.coalesce("queued", F.lit(0)) > 0), "queued").when(F.coalesce("processed", F.lit(False)), "done").otherwise("pending")
    return out.select("doc_id", *zero.values(), status.alias("status"))


def stale_pages(hits: DataFrame, citations: DataFrame, least: int = 4) -> DataFrame:
    """Queries (pages) of whose best chunks ``least`` or more are in no source of theirs. hits: page_id, doc_id."""
    cited = citations.select("page_id", "doc_id").distinct().withColumn("_c", F.lit(1))
    out = hits.join(cited, ["page_id", "doc_id"], "left").groupBy("page_id").agg(F.count_if(F.col("_c").isNull()).alias("n_foreign"), F.count("*").alias("n"))
    return out.withColumn("stale", F.col("n_foreign") >= least)

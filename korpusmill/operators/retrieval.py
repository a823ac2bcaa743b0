"""Batch retrieval: dense and lexical top-k, fusion, re-ranking, the citation lane, and the merged answer."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from korpusmill.functions.batches import map_batches
from korpusmill.functions.checkpoints import cut
from korpusmill.functions.topk import Running
from korpusmill.operators.lexical_index import LexicalIndex

#: Products that are worked out at a time, and bytes of vectors in a group of blocks.
CELLS, GROUP_BYTES = 1 << 22, 1 << 27


def _block(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of one block."""
    ids, vectors = rows.values.flatten()
    return ids.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def _blocks(df: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
    """Rows of ``size`` (id, vector) pairs, or what is left of a partition; nothing is moved."""
    some = df.filter(F.col("vector").isNotNull()).select(F.col(id_col).alias("id"), "vector")

    def pack(batches):
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                held.append(part)
                n += part.num_rows
                if n >= size:
                    yield _packed(held, name)
                    held, n = [], 0
        if n:
            yield _packed(held, name)

    return map_batches(some, pack, StructType([StructField(name, ArrayType(StructType(some.schema.fields)))]))


def _packed(held: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    pairs = pa.StructArray.from_arrays(whole.columns, ["id", "vector"])
    return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)], [name])


def top_k(df: DataFrame, by: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The ``k`` best rows per group with their ``rank`` from 1; equal scores by ``tie``."""
    w = W.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Sent(NamedTuple):
    """Queries that every task has: a broadcast of their ids and matrix, or none if they are too many, and their number."""

    shared: object
    n: int


def send(queries: DataFrame, broadcast_bytes: int = 32 << 20) -> Sent:
    """Collect the queries (``query_id``, ``vector``) once, if they take at most ``broadcast_bytes`` as doubles; several searches can share them."""
    some = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector")
    size = some.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if size.n * (size.dims or 0) * 8 > broadcast_bytes:
        return Sent(None, size.n)
    table = some.toArrow().combine_chunks()
    matrix = np.stack(table.column(1).to_numpy()).astype(np.float64) if size.n else np.zeros((0, 0))
    return Sent(queries.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), matrix)), size.n)


def dense_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 5, floor: float | None = None, skip_self: bool = True, block: int = 2048, broadcast_bytes: int = 32 << 20,
    sent: Sent | None = None, candidates: int = 200_000,
) -> DataFrame:
    """Cosine top-k of every query (``query_id``, ``vector``) over ``corpus`` (``id``, ``vector``), unit vectors.

    Queries of at most ``broadcast_bytes`` (as doubles) and ``candidates`` results are one matrix that every task has; the corpus is
    read once, in blocks of ``block`` vectors that are multiplied with some rows of it at a time, and does not move; ``sent``
    (:func:`send`) shares the matrix with other searches. More queries are packed into blocks too, and a Cartesian product of
    blocks, which shuffles neither side, brings each to all of the corpus, whose blocks are in few groups. A task passes on k
    candidates a query (more where scores tie); a window over the candidates finishes. Filters belong on ``corpus`` before the
    call, so that they reach the scan. Rows without a vector are left out.
    """
    out = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", corpus.schema["id"].dataType), StructField("score", DoubleType())])

    def offer(best: Running, qi, qv, ci, cv):
        ids, step = pa.array(ci), max(1, CELLS // max(1, len(ci)))
        for i in range(0, len(qi), step):
            s = np.round(qv[i : i + step] @ cv.T, 6)
            if skip_self:
                s[qi[i : i + step, None] == ci[None, :]] = -np.inf
            s[np.isnan(s)] = -np.inf
            best.offer(np.arange(i, i + len(s)), s, ids, -np.inf if floor is None else floor - 1e-12)

    sent = sent or send(queries, broadcast_bytes)
    if sent.shared is not None and sent.n * k <= candidates:
        shared = sent.shared

        def stream(batches):
            qi, qv = shared.value
            best = Running(len(qi), k)
            for b in (b.slice(i, block) for b in batches for i in range(0, b.num_rows, block)):
                if len(qi):
                    c, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                    offer(best, qi, qv, c, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1))
            yield from best.batches(pa.array(qi), out.names)

        found = map_batches(corpus.filter(F.col("vector").isNotNull()).select("id", "vector"), stream, out)
    else:

        def run(batches):
            held, at, c = {}, None, None
            for b in batches:
                for i in range(b.num_rows):
                    q, now = b.column("qn")[i].as_py(), b.column("cn")[i].as_py()
                    if q not in held:
                        qi, qv = _block(b.column("q")[i])
                        held[q] = Running(len(qi), k), qi, qv
                    if now != at:
                        at, c = now, _block(b.column("c")[i])
                    offer(*held[q], *c)
            for best, qi, _ in held.values():
                yield from best.batches(pa.array(qi), out.names)

        q = cut(_blocks(queries, "query_id", block, "q").withColumn("qn", F.monotonically_increasing_id()).repartition(max(1, -(-sent.n // block))))
        c = cut(_blocks(corpus, "id", block, "c").withColumn("cn", F.monotonically_increasing_id()))
        size = c.agg(F.sum(F.size("c").cast("long") * F.size(F.get("c", F.lit(0))["vector"]) * 8)).first()[0] or 0
        pairs = c.coalesce(max(1, -(-size // GROUP_BYTES))).crossJoin(q.hint("shuffle_replicate_nl"))
        found = map_batches(pairs, run, out)
    return top_k(found, ["query_id"], "score", k, "id")


def sparse_topk(queries: DataFrame, corpus: DataFrame | LexicalIndex, k: int = 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Lexical top-k: sum of products of positive weights over shared tokens. Both sides: id (``query_id`` / ``id``), ``token``, ``weight``.

    The corpus, a token table or a stored index, is read as block-max postings (:mod:`korpusmill.operators.lexical_index`): a
    document costs its matching postings at most, and those of blocks that can't beat a query's k best so far are left out.
    """
    index = corpus if isinstance(corpus, LexicalIndex) else LexicalIndex.of(corpus)
    return top_k(index.search(queries, k, broadcast_rows).withColumn("score", F.round("score", 10)), ["query_id"], "score", k, "id")


def token_weights(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Tokens of a text with the share of its tokens each has: an offline stand-in for learned lexical weights."""
    words = df.select(F.col(id_col).alias("id"), F.col(text).alias(text)).repartition("id")  # texts are shorter than their tokens; the sums need no other exchange
    words = words.select("id", F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("token"))
    n = words.groupBy("id", "token").agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.col("n") / F.sum("n").over(W.partitionBy("id"))).drop("n")


def rrf(lanes: DataFrame, k: int = 2, top: int = 5) -> DataFrame:
    """Reciprocal-rank fusion of rows (lane, query_id, id, rank from 1): the sum of 1 / (k + rank from 0)."""
    fused = lanes.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank") - 1)), 6).alias("score"), F.count("*").alias("n_lanes"))
    return top_k(fused, ["query_id"], "score", top, "id")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: the built-in re-ranking score."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.coalesce(F.round(F.size(F.array_intersect(words(query), words(text))) / F.nullif(F.size(words(query)), F.lit(0)), 6), F.lit(0.0))


def rerank(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """The old score as ``dense_score``, ``score`` from any expression (a pandas UDF too), and the k best of each query."""
    return top_k(hits.drop("rank").withColumn("dense_score", F.col("score")).withColumn("score", score), ["query_id"], "score", k, "id")


def citation_lane(seeds: DataFrame, citations: DataFrame, exact_min: float = 0.55, doc_min: float = 0.60, penalty: float = 0.3) -> DataFrame:
    """Pages reached through the chunks they cite.

    seeds: query_id, doc_id, ts, dense_score. citations: page_id, doc_id, ts. A seed of ``exact_min`` or more reaches the pages
    that cite its chunk. One of ``doc_min`` or more that no page cites reaches the pages that cite its document, at
    ``penalty`` times its score, but for pages that another seed of the query reaches exactly through that document.
    """
    cites = citations.select("page_id", "doc_id", "ts").distinct()
    exact = seeds.filter(F.col("dense_score") >= exact_min).join(cites, ["doc_id", "ts"]).select("query_id", "page_id", "doc_id", "ts", F.lit("exact").alias("match_strength"), F.round("dense_score", 4).alias("effective_score"))
    alone = seeds.filter(F.col("dense_score") >= doc_min).join(cites.select("doc_id", "ts").distinct(), ["doc_id", "ts"], "left_anti")
    loose = alone.join(cites.select("page_id", "doc_id").distinct(), "doc_id").join(exact.select("query_id", "page_id", "doc_id").distinct(), ["query_id", "page_id", "doc_id"], "left_anti")
    loose = loose.select("query_id", "page_id", "doc_id", "ts", F.lit("same_document").alias("match_strength"), F.round(penalty * F.col("dense_score"), 4).alias("effective_score"))
    return exact.unionByName(loose)


def citing_pages(hits: DataFrame, citations: DataFrame) -> DataFrame:
    """Each hit with the sorted pages that cite its chunk; an empty list where none does."""
    pages = citations.groupBy("doc_id", "ts").agg(F.array_sort(F.collect_set("page_id")).alias("in_pages"))
    return hits.join(pages, ["doc_id", "ts"], "left").withColumn("in_pages", F.coalesce("in_pages", F.array().cast(pages.schema["in_pages"].dataType)))


def merge_lanes(semantic: DataFrame, cited: DataFrame) -> DataFrame:
    """Pages of both lanes: how each was found, and its score (semantic if it has one, else the best effective score)."""
    by_page = cited.groupBy("query_id", "page_id").agg(F.max("effective_score").alias("effective"), F.max((F.col("match_strength") == "exact").cast("int")).alias("exact"), F.count("*").alias("n_triggers"))
    sem = semantic.select("query_id", F.col("id").alias("page_id"), F.round("score", 4).alias("semantic"))
    both = sem.join(by_page, ["query_id", "page_id"], "full_outer")
    via = F.when(F.col("semantic").isNotNull() & F.col("effective").isNotNull(), "both").when(F.col("semantic").isNotNull(), "semantic").when(F.col("exact") == 1, "citation").otherwise("citation_video")
    return both.select("query_id", "page_id", via.alias("match_via"), F.coalesce("semantic", "effective").alias("score"), F.coalesce("n_triggers", F.lit(0)).alias("n_triggers"))


def classify_mode(queries: DataFrame, raw: DataFrame, pages: DataFrame, semantic: DataFrame, dominant: float = 0.65, thin: float = 0.55) -> DataFrame:
    """Per query the best scores, counts of pages by how they were found, and the mode of the answer. Scores are dense cosines."""
    r = raw.groupBy("query_id").agg(F.max("score").alias("top_raw"))
    s = semantic.groupBy("query_id").agg(F.max("score").alias("top_page"))
    kinds = {k: F.count_if(F.col("match_via") == k).alias(f"n_{k}") for k in ("both", "semantic", "citation", "citation_video")}
    p = pages.groupBy("query_id").agg(*kinds.values())
    out = queries.select("query_id").join(r, "query_id", "left").join(s, "query_id", "left").join(p, "query_id", "left")
    cited = F.coalesce(F.col("n_citation") + F.col("n_citation_video") + F.col("n_both"), F.lit(0))
    mode = (
        F.when(F.col("top_raw").isNull() & F.col("top_page").isNull(), "no_results")
        .when(F.col("top_page").isNull() & (cited > 0), "raw_with_wiki_via_citation").when(F.col("top_page").isNull(), "raw_only")
        .when((F.col("top_page") >= dominant) & (F.col("top_page") > F.coalesce("top_raw", F.lit(-1.0))), "wiki_dominant")
        .when(F.coalesce("top_raw", F.lit(-1.0)) < thin, "raw_with_warning").otherwise("balanced")
    )
    return out.select("query_id", F.round("top_raw", 4).alias("top_raw"), F.round("top_page", 4).alias("top_page"), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds], mode.alias("mode"))


class Hybrid(NamedTuple):
    pages: DataFrame
    chunks: DataFrame
    metadata: DataFrame


def hybrid(
    queries: DataFrame, chunks: DataFrame, pages: DataFrame, citations: DataFrame, k_raw: int = 5, k_pages: int = 2, exact_min: float = 0.55,
    doc_min: float = 0.60, dominant: float = 0.65, thin: float = 0.55,
) -> Hybrid:
    """A batch of queries (query_id, vector) against chunks (id, doc_id, ts, vector) and pages (id, vector): three tables keyed by query."""
    sent = send(queries)  # once for both lanes
    raw = dense_topk(queries, chunks, k_raw, sent=sent)
    found = raw.join(chunks.select("id", "doc_id", "ts"), "id")
    semantic = dense_topk(queries, pages, k_pages, sent=sent)
    cited = citation_lane(found.withColumnRenamed("score", "dense_score"), citations, exact_min, doc_min)
    merged = merge_lanes(semantic, cited)
    return Hybrid(merged, citing_pages(found, citations), classify_mode(queries, raw, merged, semantic, dominant, thin))


def evaluate(ranked: DataFrame, labels: DataFrame, lanes: list[str], k: int = 5) -> DataFrame:
    """Position of each query's labelled id in each lane (a column a lane, null if absent), and whether it is among the first k.

    ranked: lane, query_id, id, rank. labels: query_id, id.
    """
    at = ranked.join(labels, ["query_id", "id"]).groupBy("query_id").pivot("lane", lanes).agg(F.min("rank"))
    out = labels.select("query_id").distinct().join(at, "query_id", "left")
    return out.select("query_id", *lanes, *[(F.coalesce(F.col(x), F.lit(1 << 30)) <= k).cast("int").alias(f"{x}_hit") for x in lanes])


def lane_summary(evaluated: DataFrame, lanes: list[str]) -> DataFrame:
    """Of :func:`evaluate`, per lane: queries, the share with a hit among the first k, and the mean reciprocal rank (0 where the label is absent)."""
    rows = evaluated.select(F.explode(F.array(*[F.struct(F.lit(x).alias("lane"), F.col(x).alias("at"), F.col(f"{x}_hit").alias("hit")) for x in lanes])).alias("r"))
    reciprocal = F.when(F.col("r.at") > 0, 1 / F.col("r.at")).otherwise(0.0)
    return rows.groupBy("r.lane").agg(F.count("*").alias("n"), F.round(F.avg("r.hit"), 6).alias("recall"), F.round(F.avg(reciprocal), 6).alias("mrr"))

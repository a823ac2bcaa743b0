"""Retrieval queries. Queries are the vectors whose id is divisible by 50, against all; documents are runs of five vectors.

Chunks are the vectors with a label above 0, pages those with label 0; a page cites a chunk where a supplier sold 45 or more at a discount
of a tenth. Thresholds suit the scores of these tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions import vectors
from korpusmill.functions.checkpoints import cut
from korpusmill.operators import filters, ranking
from korpusmill.operators import retrieval as R
from korpusmill.plans.registry import Tables, query, scratch

EXACT, DOC, DOMINANT, THIN = 0.25, 0.28, 0.33, 0.27


def vec(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.floor(F.col("vec_id") / 5).alias("doc_id"), (F.col("vec_id") % 5).cast("int").alias("ts"))


def asked(t: Tables) -> DataFrame:
    return vec(t).filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector")


def cites(t: Tables) -> DataFrame:
    rows = t.lineitem.filter((F.col("l_quantity") >= 45) & (F.col("l_discount") == 0.1)).crossJoin(F.broadcast(t.embeddings.agg(F.count("*").alias("n"))))  # one row
    return rows.select((F.col("l_suppkey") * 10 % F.col("n")).alias("page_id"), (F.col("l_orderkey") % F.ceil(F.col("n") / 5)).alias("doc_id"), (F.col("l_linenumber") % 5).cast("int").alias("ts")).distinct()


BASE = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, vec_id // 5 AS doc_id, CAST(vec_id % 5 AS INT) AS ts FROM embeddings),
sc AS (SELECT query_id, id, label, doc_id, ts, round(list_dot_product(qv, v), 6) AS score FROM q, e WHERE id <> query_id),
cites AS (SELECT DISTINCT l_suppkey * 10 % (SELECT count(*) FROM embeddings) AS page_id, l_orderkey % (((SELECT count(*) FROM embeddings) + 4) // 5) AS doc_id, CAST(l_linenumber % 5 AS INT) AS ts FROM lineitem WHERE l_quantity >= 45 AND l_discount = 0.1),
raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE label > 0) WHERE rank <= 5),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE label = 0) WHERE rank <= 2),
exact AS (SELECT query_id, page_id, raw.doc_id, raw.ts, 'exact' AS match_strength, round(score, 4) AS effective_score FROM raw JOIN cites ON raw.doc_id = cites.doc_id AND raw.ts = cites.ts WHERE score >= 0.25),
alone AS (SELECT * FROM raw WHERE score >= 0.28 AND NOT EXISTS (SELECT 1 FROM cites c WHERE c.doc_id = raw.doc_id AND c.ts = raw.ts)),
loose AS (SELECT query_id, page_id, a.doc_id, a.ts, 'same_document' AS match_strength, round(0.3 * score, 4) AS effective_score
  FROM alone a JOIN (SELECT DISTINCT page_id, doc_id FROM cites) c ON a.doc_id = c.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM exact x WHERE x.query_id = a.query_id AND x.page_id = c.page_id AND x.doc_id = a.doc_id)),
lane AS (SELECT * FROM exact UNION ALL SELECT * FROM loose),
bp AS (SELECT query_id, page_id, max(effective_score) AS effective, max(CASE WHEN match_strength = 'exact' THEN 1 ELSE 0 END) AS ex, count(*) AS n FROM lane GROUP BY 1, 2),
merged AS (SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.id, b.page_id) AS page_id,
  CASE WHEN s.id IS NOT NULL AND b.page_id IS NOT NULL THEN 'both' WHEN s.id IS NOT NULL THEN 'semantic' WHEN ex = 1 THEN 'citation' ELSE 'citation_video' END AS match_via,
  coalesce(round(s.score, 4), effective) AS score, coalesce(n, 0) AS n_triggers
  FROM sem s FULL OUTER JOIN bp b ON s.query_id = b.query_id AND s.id = b.page_id)
"""


@query(BASE + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5")
def r1_dense_search(t: Tables) -> DataFrame:
    return R.dense_topk(asked(t), vec(t), 5)


def _index(t: Tables, rows: DataFrame):
    """An index of this run's own, in the folder that driver and executors share."""
    from korpusmill.operators.vector_index import VectorIndex

    return VectorIndex.build(rows.select("id", "vector"), f"{scratch(t.spark)}/vectors-{uuid.uuid4().hex[:12]}", target=0.97)


@query()
def r1_indexed_search(t: Tables) -> DataFrame:
    """The nearest cells of each query only; tests hold its recall against the exact result."""
    return _index(t, vec(t)).search(asked(t), 5)


@query(BASE + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5")
def r1_indexed_exact(t: Tables) -> DataFrame:
    return _index(t, vec(t)).search(asked(t), 5, exact=True)


@query(BASE + ", m AS (SELECT query_id FROM raw GROUP BY 1 HAVING max(score) >= 0.3) SELECT query_id, id, score, rank FROM raw WHERE query_id IN (SELECT query_id FROM m)")
def j10_indexed_match(t: Tables) -> DataFrame:
    from korpusmill.operators.matching import match_topk

    return match_topk(asked(t), _index(t, vec(t).filter("label > 0")), 5, 0.3)


@query(BASE + "SELECT query_id, id, score, rank FROM sem")
def r2_page_search(t: Tables) -> DataFrame:
    return R.dense_topk(asked(t), vec(t).filter("label = 0"), 2)


@query(BASE + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE label = 3) WHERE rank <= 3")
def p1_equality_filter(t: Tables) -> DataFrame:
    return R.dense_topk(asked(t), filters.equals(vec(t), {"label": 3, "doc_id": None}), 3)


@query(BASE + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE label <> 3) WHERE rank <= 3")
def p2_must_not_filter(t: Tables) -> DataFrame:
    return R.dense_topk(asked(t), filters.must_not(vec(t), {"label": 3}), 3)


@query(BASE + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE rank <= 3")
def p3_absent_field(t: Tables) -> DataFrame:
    flags = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("policy_filter")).distinct()
    return R.dense_topk(asked(t), filters.absent(vec(t).join(flags, "id", "left"), "policy_filter"), 3)


@query(BASE + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE label IN (1, 2)) WHERE rank <= 3")
def p5_scope_filter(t: Tables) -> DataFrame:
    return R.dense_topk(asked(t), filters.equals(vec(t), {"label": [1, 2]}), 3)


@query(BASE + "SELECT * FROM lane")
def r4_citation_lane(t: Tables) -> DataFrame:
    return R.citation_lane(_seeds(t), cites(t), EXACT, DOC)


def _seeds(t: Tables) -> DataFrame:
    chunks = vec(t).filter("label > 0")
    return R.dense_topk(asked(t), chunks, 5).join(chunks.select("id", "doc_id", "ts"), "id").withColumnRenamed("score", "dense_score")


@query(BASE + "SELECT query_id, page_id, doc_id, ts, effective_score FROM exact")
def j1_exact_citations(t: Tables) -> DataFrame:
    return R.citation_lane(_seeds(t), cites(t), EXACT, 2.0).select("query_id", "page_id", "doc_id", "ts", "effective_score")


@query(BASE + "SELECT query_id, page_id, doc_id, ts, effective_score FROM loose")
def j2_same_document(t: Tables) -> DataFrame:
    return R.citation_lane(_seeds(t), cites(t), EXACT, DOC).filter("match_strength = 'same_document'").select("query_id", "page_id", "doc_id", "ts", "effective_score")


@query(BASE + "SELECT query_id, id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT page_id)), ',') FROM cites c WHERE c.doc_id = raw.doc_id AND c.ts = raw.ts), '') AS in_pages FROM raw")
def j3_citing_pages(t: Tables) -> DataFrame:
    return R.citing_pages(_seeds(t), cites(t)).select("query_id", "id", F.array_join(F.transform("in_pages", lambda x: x.cast("string")), ",").alias("in_pages"))


@query(BASE + "SELECT * FROM merged")
def r5_hybrid(t: Tables) -> DataFrame:
    return _hybrid(t).pages


def _hybrid(t: Tables) -> R.Hybrid:
    return R.hybrid(asked(t), vec(t).filter("label > 0"), vec(t).filter("label = 0"), cites(t), 5, 2, EXACT, DOC, DOMINANT, THIN)


@query(
    BASE
    + """, p AS (SELECT query_id, count(*) FILTER (match_via = 'both') AS n_both, count(*) FILTER (match_via = 'semantic') AS n_semantic, count(*) FILTER (match_via = 'citation') AS n_citation,
  count(*) FILTER (match_via = 'citation_video') AS n_citation_video FROM merged GROUP BY 1),
r AS (SELECT query_id, max(score) AS top_raw FROM raw GROUP BY 1), s AS (SELECT query_id, max(score) AS top_page FROM sem GROUP BY 1)
SELECT q.query_id, round(top_raw, 4) AS top_raw, round(top_page, 4) AS top_page, coalesce(n_both, 0) AS n_both, coalesce(n_semantic, 0) AS n_semantic, coalesce(n_citation, 0) AS n_citation,
  coalesce(n_citation_video, 0) AS n_citation_video, CASE WHEN top_page >= 0.33 AND top_page > top_raw THEN 'wiki_dominant' WHEN top_raw < 0.27 THEN 'raw_with_warning' ELSE 'balanced' END AS mode
FROM q LEFT JOIN r ON q.query_id = r.query_id LEFT JOIN s ON q.query_id = s.query_id LEFT JOIN p ON q.query_id = p.query_id"""
)
def r6_mode(t: Tables) -> DataFrame:
    return _hybrid(t).metadata


@query(BASE + ", m AS (SELECT query_id FROM raw GROUP BY 1 HAVING max(score) >= 0.3) SELECT query_id, id, score, rank FROM raw WHERE query_id IN (SELECT query_id FROM m)")
def j10_all_pairs_match(t: Tables) -> DataFrame:
    from korpusmill.operators.matching import match_topk

    return match_topk(asked(t), vec(t).filter("label > 0"), 5, 0.3)


@query(
    BASE
    + """, r14 AS (SELECT r.query_id AS page_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM cites c WHERE c.page_id = r.query_id AND c.doc_id = r.doc_id)) AS n_foreign, count(*) AS n FROM raw r GROUP BY 1)
SELECT page_id, n_foreign, n, n_foreign >= 4 AS stale FROM r14"""
)
def r14_stale_pages(t: Tables) -> DataFrame:
    return ranking.stale_pages(_seeds(t).select(F.col("query_id").alias("page_id"), "doc_id"), cites(t))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def f1_norm(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 5) AS total FROM embeddings")
def f2_normalise(t: Tables) -> DataFrame:
    v = vectors.normalise(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
TURNS = f"""
WITH u AS (SELECT conv_id AS query_id, {WORDS} AS qw FROM conversations WHERE role = 'user' AND turn = 0),
a AS (SELECT conv_id * 1000 + turn AS id, {WORDS} AS aw FROM conversations WHERE role = 'assistant'),
qt AS (SELECT query_id, token, count(*) AS n FROM (SELECT query_id, unnest(qw) AS token FROM u) GROUP BY 1, 2),
qs AS (SELECT query_id, token, n / sum(n) OVER (PARTITION BY query_id) AS w FROM qt),
atk AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(aw) AS token FROM a) GROUP BY 1, 2),
aws AS (SELECT id, token, n / sum(n) OVER (PARTITION BY id) AS w FROM atk),
s0 AS (SELECT query_id, id, round(sum(qs.w * aws.w), 10) AS score FROM qs JOIN aws USING (token) GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s0) WHERE rank <= 20),
o0 AS (SELECT sp.query_id, sp.id, sp.score AS dense_score, coalesce(round(len(list_intersect(list_distinct(qw), list_distinct(aw))) / nullif(len(list_distinct(qw)), 0), 6), 0) AS score FROM sparse sp JOIN u USING (query_id) JOIN a USING (id)),
re AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o0) WHERE rank <= 20),
f0 AS (SELECT query_id, id, round(sum(1.0 / (2 + rank - 1)), 6) AS score, count(*) AS n_lanes FROM (SELECT query_id, id, rank FROM sparse UNION ALL SELECT query_id, id, rank FROM re) GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f0) WHERE rank <= 5)
"""


def _turns(t: Tables) -> tuple[DataFrame, DataFrame]:
    u = t.conversations.filter("role = 'user' and turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    return u, t.conversations.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _sparse(t: Tables) -> DataFrame:
    u, a = _turns(t)
    q = R.token_weights(u, "query_id", "query").withColumnRenamed("id", "query_id")
    return R.sparse_topk(q, R.token_weights(a, "id", "text"), 20)


def _reranked(t: Tables, sparse: DataFrame) -> DataFrame:
    u, a = _turns(t)
    both = sparse.join(u, "query_id").join(a, "id")
    return R.rerank(both, R.overlap(F.col("query"), F.col("text")), 20).select("query_id", "id", "dense_score", "score", "rank")


@query(TURNS + "SELECT query_id, id, score, rank FROM sparse")
def r7_sparse_search(t: Tables) -> DataFrame:
    return _sparse(t)


@query(TURNS + "SELECT query_id, id, dense_score, score, rank FROM re WHERE rank <= 5")
def r3_rerank(t: Tables) -> DataFrame:
    return _reranked(t, _sparse(t)).filter("rank <= 5")


def _lanes(t: Tables) -> DataFrame:
    sparse = cut(_sparse(t))  # searched once for both
    return sparse.select(F.lit("sparse").alias("lane"), "query_id", "id", "rank").unionByName(_reranked(t, sparse).select(F.lit("rerank").alias("lane"), "query_id", "id", "rank"))


@query(TURNS + "SELECT query_id, id, score, n_lanes, rank FROM fused")
def r8_rank_fusion(t: Tables) -> DataFrame:
    return R.rrf(_lanes(t), 2, 5)


@query(
    TURNS
    + """, lb AS (SELECT conv_id AS query_id, min(conv_id * 1000 + turn) AS id FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT query_id FROM u) GROUP BY 1),
lanes AS (SELECT 'sparse' AS lane, query_id, id, rank FROM sparse UNION ALL SELECT 'rerank', query_id, id, rank FROM re UNION ALL SELECT 'rrf', query_id, id, rank FROM fused)
SELECT lb.query_id, coalesce(max(rank) FILTER (lane = 'sparse'), 0) AS sparse, coalesce(max(rank) FILTER (lane = 'rerank'), 0) AS rerank, coalesce(max(rank) FILTER (lane = 'rrf'), 0) AS rrf,
  CAST(coalesce(max(rank) FILTER (lane = 'sparse'), 99) <= 5 AS INT) AS sparse_hit, CAST(coalesce(max(rank) FILTER (lane = 'rerank'), 99) <= 5 AS INT) AS rerank_hit, CAST(coalesce(max(rank) FILTER (lane = 'rrf'), 99) <= 5 AS INT) AS rrf_hit
FROM lb LEFT JOIN lanes ON lb.query_id = lanes.query_id AND lb.id = lanes.id GROUP BY lb.query_id"""
)
def r9_evaluation(t: Tables) -> DataFrame:
    u, a = _turns(t)
    labels = a.withColumn("query_id", F.floor(F.col("id") / 1000)).groupBy("query_id").agg(F.min("id").alias("id")).join(u.select("query_id").distinct(), "query_id", "left_semi")
    lanes = cut(_lanes(t))
    fused = R.rrf(lanes, 2, 5).select(F.lit("rrf").alias("lane"), "query_id", "id", "rank")
    names = ["sparse", "rerank", "rrf"]
    return R.evaluate(lanes.unionByName(fused), labels, names, 5).fillna(0, names)


DENSE = """,
qd AS (SELECT query_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS d, count(*) AS n FROM (SELECT query_id, unnest(qw) AS w FROM u) GROUP BY 1, 2), qn AS (SELECT query_id, sqrt(sum(n * n)) AS z FROM qd GROUP BY 1),
ad AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS d, count(*) AS n FROM (SELECT id, unnest(aw) AS w FROM a) GROUP BY 1, 2), an AS (SELECT id, sqrt(sum(n * n)) AS z FROM ad GROUP BY 1),
d0 AS (SELECT query_id, id, round(sum(qd.n * ad.n) / (any_value(qn.z) * any_value(an.z)), 6) AS score FROM qd JOIN ad USING (d) JOIN qn USING (query_id) JOIN an USING (id) GROUP BY 1, 2),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d0) WHERE rank <= 20),
h0 AS (SELECT query_id, id, round(sum(1.0 / (2 + rank - 1)), 6) AS score, count(*) AS n_lanes FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM sparse) GROUP BY 1, 2),
mixed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h0) WHERE rank <= 5)
"""


def _dense(t: Tables) -> DataFrame:
    """Turns by their hashed word vectors: what an embedding model would fill."""
    u, a = _turns(t)
    return R.dense_topk(u.select("query_id", vectors.hash_embedding(F.col("query")).alias("vector")), a.select("id", vectors.hash_embedding(F.col("text")).alias("vector")), 20, floor=1e-6, skip_self=False)


def _dense_and_sparse(t: Tables) -> DataFrame:
    lane = lambda name, df: df.select(F.lit(name).alias("lane"), "query_id", "id", "rank")
    return lane("dense", _dense(t)).unionByName(lane("sparse", _sparse(t)))


@query(TURNS + DENSE + "SELECT query_id, id, score, n_lanes, rank FROM mixed")
def r8_dense_and_sparse(t: Tables) -> DataFrame:
    return R.rrf(_dense_and_sparse(t), 2, 5)


@query(
    TURNS + DENSE
    + """, lb AS (SELECT conv_id AS query_id, min(conv_id * 1000 + turn) AS id FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT query_id FROM u) GROUP BY 1),
lanes AS (SELECT 'dense' AS lane, query_id, id, rank FROM dense UNION ALL SELECT 'sparse', query_id, id, rank FROM sparse UNION ALL SELECT 'rrf', query_id, id, rank FROM mixed),
p AS (SELECT l.lane, lb.query_id, max(x.rank) AS place FROM lb CROSS JOIN (SELECT DISTINCT lane FROM lanes) l LEFT JOIN lanes x ON x.lane = l.lane AND x.query_id = lb.query_id AND x.id = lb.id GROUP BY 1, 2)
SELECT lane, count(*) AS n, round(avg(CASE WHEN place <= 5 THEN 1 ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr FROM p GROUP BY 1"""
)
def r9_summary(t: Tables) -> DataFrame:
    u, a = _turns(t)
    labels = a.withColumn("query_id", F.floor(F.col("id") / 1000)).groupBy("query_id").agg(F.min("id").alias("id")).join(u.select("query_id").distinct(), "query_id", "left_semi")
    lanes, names = cut(_dense_and_sparse(t)), ["dense", "sparse", "rrf"]
    fused = R.rrf(lanes, 2, 5).select(F.lit("rrf").alias("lane"), "query_id", "id", "rank")
    return R.lane_summary(R.evaluate(lanes.unionByName(fused), labels, names, 5).fillna(0, names), names)


@query(
    BASE
    + """, v AS (SELECT query_id // 100 * 100 AS candidate, id AS chunk_id, label AS category, score FROM raw), b AS (SELECT candidate, chunk_id, max(score) AS score FROM v GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, chunk_id) AS r FROM b), rec AS (SELECT candidate, count(*) FILTER (score >= 0.25) AS n_chunks, round(avg(CASE WHEN r <= 10 THEN score END), 4) AS avg_top10 FROM k GROUP BY 1),
inc AS (SELECT page_id AS candidate, count(*) AS n_in FROM cites GROUP BY 1), j AS (SELECT rec.*, coalesce(n_in, 0) AS n_in, CASE WHEN n_in IS NULL THEN 0.0 ELSE 1.0 END AS bonus FROM rec LEFT JOIN inc USING (candidate))
SELECT candidate, round(0.5 * n_chunks / greatest((SELECT max(n_chunks) FROM j), 1) + 0.3 * n_in / greatest((SELECT max(n_in) FROM j), 1) + 0.2 * bonus, 4) AS score, n_chunks, avg_top10, n_in,
  CASE WHEN n_chunks < 3 THEN 'few chunks' WHEN avg_top10 < 0.28 THEN 'low scores' ELSE 'ok' END AS reason, n_chunks >= 3 AND avg_top10 >= 0.28 AS viable FROM j"""
)
def a20_candidate_ranking(t: Tables) -> DataFrame:
    hits = _seeds(t).join(vec(t).select("id", "label"), "id").select((F.floor(F.col("query_id") / 100) * 100).alias("candidate"), F.col("id").alias("chunk_id"), F.col("label").alias("category"), F.col("dense_score").alias("score"))
    incoming = cites(t).groupBy(F.col("page_id").alias("candidate")).agg(F.count("*").alias("n_in")).withColumn("bonus", F.lit(1.0))
    return ranking.rank_candidates(ranking.recurrence(hits, 0.25).drop("dominant"), incoming, min_chunks=3, min_avg=0.28)


@query(BASE + ", b AS (SELECT query_id // 100 * 100 AS candidate, id, max(score) AS score FROM raw GROUP BY 1, 2) SELECT candidate, count(*) FILTER (score >= 0.25) AS n_chunks, round(avg(CASE WHEN r <= 10 THEN score END), 4) AS avg_top10 FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, id) AS r FROM b) GROUP BY 1")
def a19_recurrence(t: Tables) -> DataFrame:
    hits = _seeds(t).join(vec(t).select("id", "label"), "id").select((F.floor(F.col("query_id") / 100) * 100).alias("candidate"), F.col("id").alias("chunk_id"), F.col("label").alias("category"), F.col("dense_score").alias("score"))
    return ranking.recurrence(hits, 0.25).drop("dominant")

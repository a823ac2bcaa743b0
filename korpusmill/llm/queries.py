"""The registered queries of this package, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from korpusmill.llm import decontamination, filter_audit, html_extraction, line_dedup, mixing, near_dup, passage_dedup, pseudonyms, quality_classifier, quality_rules, sharding, token_alignment, toxicity
from korpusmill.llm.labelled import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.remove_repeats(table(spark, sf_dir, "documents"), kept=False)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", F.col("copy").cast("long").alias("copy"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key="of the supplied tables").select("doc_id", "text", "n_replaced")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = "/opt/tokenizers") -> DataFrame:
    pair = token_alignment.Pair.read(f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return token_alignment.alignment(table(spark, sf_dir, "documents"), pair).withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_html_extraction, op2_simhash_near_dup, op3_line_dedup, op4_quality_classifier, op5_suffix_dedup, op6_mix_sources, op7_shard, op8_pseudonyms, op9_decontaminate, op10_quality_rules, op11_token_alignment, op12_filter_audit, op13_toxicity)}
    return {**named, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3, "op6_mix_sources": OP6, "op12_filter_audit": OP12}


OP3 = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents
), w AS (
  SELECT doc_id, i, x[i] || chr(10) || x[i + 1] || chr(10) || x[i + 2] AS win
  FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM l)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w
), c AS (
  SELECT DISTINCT doc_id, i + j AS line FROM r, (SELECT unnest(range(0, 3)) AS j) WHERE k > 1
), g AS (
  SELECT doc_id, list(line ORDER BY line) AS gone FROM c GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(x) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  coalesce(array_to_string(list_transform(gone, lambda y: CAST(y - 1 AS VARCHAR)), ','), '') AS removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda y: NOT list_contains(gone, y)), lambda y: x[y]), chr(10)), '') END) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""

OP6 = """
WITH s AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS bytes FROM documents GROUP BY source
), w AS (
  SELECT source, bytes, sqrt(bytes) AS weight FROM s
), r AS (
  SELECT source, (SELECT sum(bytes) FROM w) * weight / (SELECT sum(weight) FROM w) / bytes AS rate FROM w
), p AS (
  SELECT source, rate, CAST(greatest(ceil(rate / 32), 1) AS INT) AS parts FROM r
), c AS (
  SELECT source, sum(exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM p, (SELECT unnest(range(0, 140)) AS k)
), g AS (
  SELECT source, list(cdf ORDER BY cdf) AS cdf FROM c GROUP BY source
), n AS (
  SELECT d.doc_id, d.source, (
    SELECT sum(len(list_filter(g.cdf, lambda x: x <= CAST('0x' || substr(md5('17:' || d.doc_id || ':' || j), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))))
    FROM (SELECT unnest(range(1, p.parts + 1)) AS j)) AS n
  FROM documents d JOIN g ON d.source = g.source JOIN p ON d.source = p.source
)
SELECT doc_id, source, CAST(unnest(range(0, CAST(n AS BIGINT))) AS BIGINT) AS copy FROM n
"""

OP12 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), f AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w
), l AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), h AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5
), st AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) - 1 AS own, list_sum(list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', filter_order[k]) - 1))) AS prior
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, own, CAST(sum(CASE WHEN mask & (coalesce(prior, 0) | (1 << own)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & coalesce(prior, 0) = 0 AND mask & (1 << own) > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & coalesce(prior, 0) > 0 AND mask & (1 << own) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = (1 << own) THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & coalesce(prior, 0) = 0 AND mask & (1 << own) > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & coalesce(prior, 0) = 0 AND mask & (1 << own) > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM h, st GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

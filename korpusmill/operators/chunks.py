"""Documents to chunks, and views of documents made from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.functions import text as T

#: The grammar of the files, which must match. A line that opens a chunk is a dash, a time and a title; bullets
#: are indented by spaces or tabs on their own line.
HEADER = r"^- (\d{1,2}(?::\d{2}){1,2})\s+(\S.*?)\s*$"
BULLET = r"(?m)^[ \t]{2,}- (.+?)[,.]?$"


def split_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per timed header with bullets: doc, ``timestamp``, ``timestamp_seconds``, ``theme``, ``content``.

    The body of a chunk reaches to the next header. Headers without bullets make no chunk; text before the first header is
    left out.
    """
    parts = F.split(F.col(text), r"(?m)(?=^- \d{1,2}(?::\d{2}){1,2}\s+\S)")
    rows = docs.select(F.col(doc_id), F.posexplode(parts).alias("pos", "part"))
    head = F.substring_index("part", "\n", 1)
    bullets = F.regexp_extract_all("part", F.lit(BULLET), F.lit(1))
    stamp = F.regexp_extract(head, HEADER, 1)
    out = rows.select(
        doc_id, stamp.alias("timestamp"), T.time_to_seconds(stamp).alias("timestamp_seconds"), F.regexp_extract(head, HEADER, 2).alias("theme"),
        F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n").alias("content"),
    )
    return out.filter((F.col("timestamp") != "") & (F.col("content") != ""))


def spans(df: DataFrame, doc: str, pos: str) -> DataFrame:
    """``until``: where the next piece of the document starts; null for the last."""
    return df.withColumn("until", F.lead(pos).over(W.partitionBy(doc).orderBy(pos)))


def document_summary(chunks: DataFrame, doc: str, order: str, header: list[str], fields: list[str]) -> DataFrame:
    """Per document the header of its first chunk and all chunks in order."""
    first = [F.min_by(h, order).alias(h) for h in header]
    return chunks.groupBy(doc).agg(*first, F.array_sort(F.collect_list(F.struct(order, *fields))).alias("chunks"), F.count("*").alias("n_chunks"))


def list_documents(chunks: DataFrame, doc: str, order: str, fields: list[str], latest: str, where: Column | None = None) -> DataFrame:
    """Distinct documents with the metadata of their first chunk, newest first, missing dates last."""
    rows = chunks if where is None else chunks.filter(where)
    out = rows.groupBy(doc).agg(F.min_by(F.struct(*fields), order).alias("m"), F.count("*").alias("n_chunks")).select(doc, "m.*", "n_chunks")
    return out.orderBy(F.col(latest).desc_nulls_last(), doc)


def enclosing(hits: DataFrame, headers: DataFrame, doc: str, pos: str, value: str) -> DataFrame:
    """Each hit with the ``value`` of the last header at or before its position, null before the first: a backward as-of join.

    One sort of both kinds together by document and position; no pair of rows is compared.
    """
    both = headers.select(doc, pos, F.col(value).alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast(hits.schema[[c for c in hits.columns if c not in (doc, pos)][0]].dataType).alias("_hit"))
    key = [c for c in hits.columns if c not in (doc, pos)][0]
    both = both.unionByName(hits.select(doc, pos, F.lit(None).cast(headers.schema[value].dataType).alias("_v"), F.lit(1).alias("_kind"), F.col(key).alias("_hit")))
    w = W.partitionBy(doc).orderBy(pos, "_kind").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return out.filter("_kind = 1").select(doc, pos, F.col("_hit").alias(key), value)

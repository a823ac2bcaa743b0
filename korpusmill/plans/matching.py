"""Matching queries. Benchmark items and part names stand in for entities, documents for texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions import text as T
from korpusmill.operators import filters
from korpusmill.operators import matching as M
from korpusmill.plans.registry import Tables, query

FOLDED = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def heads(t: Tables) -> DataFrame:
    """The first three and the first six words of each benchmark item, as aliases of the item and of its thousandth successor."""
    first = lambda n, more: t.benchmark.select((F.col("item_id") + more).alias("page_id"), F.array_join(F.slice(M.words(F.col("text")), 1, n), " ").alias("alias"), F.lit(False).alias("canonical"))
    return first(3, 0).unionByName(first(6, 1000))


@query(
    rf"""WITH w AS (SELECT item_id, list_filter(string_split_regex({FOLDED.format('text')}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS x FROM benchmark),
a AS (SELECT item_id AS page_id, array_to_string(x[1:3], ' ') AS alias FROM w UNION ALL SELECT item_id + 1000, array_to_string(x[1:6], ' ') FROM w),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex({FOLDED.format('text')}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ' AS x FROM documents)
SELECT DISTINCT page_id, doc_id FROM d, a WHERE length(alias) >= 4 AND contains(x, ' ' || alias || ' ')"""
)
def j7_alias_scan(t: Tables) -> DataFrame:
    return M.scan_aliases(t.documents, heads(t), stop=["the"])


@query(
    rf"""WITH s AS (SELECT p_partkey AS entry_id, trim(regexp_replace({FOLDED.format("p_name || ' of ' || p_brand || ' ' || p_type")}, '\s+', ' ', 'g')) AS s FROM part), n AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT lower(p_brand) FROM part)
SELECT DISTINCT entry_id, term AS page_id FROM s, n WHERE length(term) >= 4 AND contains(s, term)"""
)
def j8_ledger(t: Tables) -> DataFrame:
    entries = t.part.select(F.col("p_partkey").alias("entry_id"), F.concat_ws(" ", "p_name", F.lit("of"), "p_brand", "p_type").alias("surface_form"))
    names = t.part.select(F.col("p_name").alias("term")).unionByName(t.part.select(F.lower("p_brand").alias("term"))).distinct().withColumn("page_id", F.col("term"))
    return M.ledger(entries, names)


@query("""WITH k AS (SELECT lower(n_name) AS key, 0 AS p, 'n' || n_nationkey AS page_id FROM nation UNION ALL SELECT lower(p_name), 1, 'p' || p_partkey FROM part UNION ALL SELECT lower(p_brand), 2, 'p' || p_partkey FROM part),
m AS (SELECT key, arg_min(page_id, p || '#' || page_id) AS page_id FROM k GROUP BY 1)
SELECT p_partkey, coalesce(a.page_id, b.page_id) AS page_id FROM part LEFT JOIN m a ON a.key = lower(p_type) LEFT JOIN m b ON b.key = lower(p_brand)""")
def j9_resolve(t: Tables) -> DataFrame:
    entries = t.part.select("p_partkey", F.col("p_type").alias("canonical_guess"), F.col("p_brand").alias("surface_form"))
    return M.resolve(entries, _mapping(t)).select("p_partkey", "page_id")


def _mapping(t: Tables) -> DataFrame:
    part = F.concat(F.lit("p"), "p_partkey")
    rows = t.nation.select(F.lower("n_name").alias("key"), F.lit(0).alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("page_id"))
    rows = rows.unionByName(t.part.select(F.lower("p_name").alias("key"), F.lit(1).alias("p"), part.alias("page_id"))).unionByName(t.part.select(F.lower("p_brand").alias("key"), F.lit(2).alias("p"), part.alias("page_id")))
    return rows.groupBy("key").agg(F.min(F.struct("p", "page_id")).alias("m")).select("key", "m.page_id")


@query("""WITH p AS (SELECT 'p' || p_partkey AS page_id, p_name, p_brand FROM part), k AS (SELECT lower(page_id) AS key, 0 AS p, page_id FROM p UNION ALL SELECT lower(p_name), 1, page_id FROM p UNION ALL SELECT lower(p_brand), 2, page_id FROM p)
SELECT key, arg_min(page_id, p || '#' || page_id) AS page_id FROM k GROUP BY 1""")
def j9_alias_map(t: Tables) -> DataFrame:
    p = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("page_id"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("alias"))
    return M.alias_map(p, p)


KEY = "substr(sha1(lower(p_name) || '|' || p_type), 1, 16) || ':' || substr(sha1(p_brand || '|' || p_type), 1, 16)"


def _pairs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_name").alias("surface"), F.col("p_type").alias("reason"), F.array("p_brand", "p_type").alias("ids"), "p_size")


@query(f"""WITH c AS (SELECT p_partkey, {KEY} AS cache_key, p_size FROM part), d AS (SELECT cache_key, max(p_size) AS s FROM c WHERE p_size >= 20 GROUP BY 1)
SELECT p_partkey, c.cache_key, CASE WHEN d.cache_key IS NULL THEN 'miss' WHEN s >= 40 THEN 'applied' ELSE 'hit' END AS state FROM c LEFT JOIN d ON c.cache_key = d.cache_key""")
def j11_decision_cache(t: Tables) -> DataFrame:
    key = F.concat(T.cache_key(T.match_norm(F.col("surface")), F.col("reason")), F.lit(":"), T.cache_key(F.array_join("ids", "|")))
    known = _pairs(t).filter("p_size >= 20").groupBy(key.alias("cache_key")).agg(F.max("p_size").alias("s"))
    known = known.select("cache_key", F.lit("high").alias("confidence"), F.when(F.col("s") >= 40, "then").alias("applied_at"))
    return M.cached_decisions(_pairs(t), known).select("p_partkey", "cache_key", "state")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY') THEN 'page_missing' WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'video_missing' WHEN l_linestatus = 'O' THEN 'applied_citation+alias' ELSE 'applied_citation' END AS outcome FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 25")
def r15_apply_recovery(t: Tables) -> DataFrame:
    d = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("page_id"), F.col("l_orderkey").alias("doc_id"), (F.col("l_linestatus") == "O").alias("alias_ok"),
        F.when(F.col("l_returnflag") == "R", "high").otherwise("low").alias("confidence"), F.when(F.col("l_quantity") > 25, "before").alias("applied_at"),
    )
    pages, docs = t.part.filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("page_id")), t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return M.apply_recovery(d, pages, docs).select("l_orderkey", "l_linenumber", "l_partkey", "outcome")


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS page_id, l_orderkey AS doc_id, l_linenumber AS ts FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_suppkey AS page_id, l_orderkey AS doc_id, l_linenumber AS ts FROM lineitem WHERE l_returnflag = 'A'),
u AS (SELECT * FROM f UNION SELECT * FROM c)
SELECT page_id, doc_id, string_agg(CAST(ts AS VARCHAR), ',' ORDER BY ts) AS times, CAST(count(*) FILTER ((page_id, doc_id, ts) NOT IN (SELECT (page_id, doc_id, ts) FROM c)) AS INT) AS n_new FROM u GROUP BY 1, 2""")
def r18_materialise(t: Tables) -> DataFrame:
    side = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("page_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ts"))
    return M.materialise(side("R"), side("A"))


@query("SELECT p_type AS page_id, lower(p_brand) AS k, count(*) AS n FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size <= 25 UNION SELECT p_type, min(upper(p_brand)) FROM part WHERE p_size > 25 AND (p_type, lower(p_brand)) NOT IN (SELECT (p_type, lower(p_brand)) FROM part WHERE p_size <= 25) GROUP BY p_type, lower(p_brand)) GROUP BY 1, 2")
def e8_add_aliases(t: Tables) -> DataFrame:
    old = t.part.filter("p_size <= 25").select(F.col("p_type").alias("page_id"), F.col("p_brand").alias("alias")).distinct()
    new = t.part.filter("p_size > 25").select(F.col("p_type").alias("page_id"), F.upper("p_brand").alias("alias"))
    return M.add_aliases(old, new).groupBy("page_id", F.lower("alias").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, length(a) <= 50 AND len(string_split_regex(trim(a), '\\s+')) <= 4 AND contains(' ' || regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g') || ' ') AS ok
FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN string_split(p_name, ' ')[2] ELSE substr(p_name, 2) END AS a, p_name || ', ' || p_brand AS s FROM part)""")
def p12_alias_gate(t: Tables) -> DataFrame:
    alias = F.when(F.col("p_size") > 25, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.substr("p_name", F.lit(2), F.length("p_name")))
    return t.part.select("p_partkey", filters.alias_ok(alias, F.concat("p_name", F.lit(", "), "p_brand")).alias("ok"))


NORM = r"trim(regexp_replace(lower(regexp_replace({}, '[*_`]', '', 'g')), '\s+', ' ', 'g'))"


@query(f"SELECT d.doc_id, item_id, contains({NORM.format('d.text')}, {NORM.format('b.text')}) AS quotes_ok FROM documents d JOIN benchmark b ON item_id = d.doc_id % (SELECT count(*) FROM benchmark)")
def p13_quote_check(t: Tables) -> DataFrame:
    """Each document is to hold the benchmark item of its number."""
    n = t.benchmark.agg(F.count("*").alias("n"))
    entries = t.documents.select("doc_id").crossJoin(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"))
    entries = entries.join(t.benchmark.select("item_id", F.array("text").alias("quotes")), "item_id")
    return filters.verify_quotes(entries, t.documents.select("doc_id", "text")).select("doc_id", "item_id", "quotes_ok")


@query("SELECT lang, CASE lower(lang) WHEN 'en' THEN 'EN' WHEN 'de' THEN 'DE' ELSE lang END AS name, count(*) AS n FROM documents GROUP BY 1, 2")
def p4_canonical_category(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("EN",), ("DE",)], "name string")
    return filters.canonical(t.documents.withColumn("name", F.col("lang")), "name", names).groupBy("lang", "name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(o_totalprice / 100, 4) AS score, '[' || o_orderpriority || ' (' || CASE WHEN o_custkey < 3600 THEN (o_custkey // 60) || ':' ELSE (o_custkey // 3600) || ':' || printf('%02d', o_custkey % 3600 // 60) || ':' END || printf('%02d', o_custkey % 60) || ')](u' || CASE WHEN o_custkey > 0 THEN '?t=' || o_custkey ELSE '' END || ')' AS cite FROM orders")
def p6_compact(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") / 100).alias("score"), F.col("o_orderpriority").alias("title"), F.lit("u").alias("url"), F.col("o_custkey").alias("timestamp_seconds"))
    return filters.compact(rows).select("o_orderkey", "score", F.col("cite_markdown").alias("cite"))


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds, CAST(count(DISTINCT l_partkey) AS INT) AS n_targets FROM lineitem GROUP BY 1")
def p7_page_compact(t: Tables) -> DataFrame:
    rel = t.lineitem.groupBy("l_suppkey").agg(F.collect_set(F.struct("l_returnflag", "l_partkey")).alias("relations"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("relations", lambda r: r["l_returnflag"]))), ",")
    return rel.select("l_suppkey", kinds.alias("kinds"), F.size(F.array_distinct(F.transform("relations", lambda r: r["l_partkey"]))).alias("n_targets"))


@query("SELECT l_suppkey AS page_id, count(DISTINCT o_orderkey) AS n_sources, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS n_done FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def j16_sources(t: Tables) -> DataFrame:
    docs = t.lineitem.groupBy(F.col("l_suppkey").alias("page_id")).agg(F.collect_set("l_orderkey").alias("ids")).select("page_id", F.explode("ids").alias("o_orderkey"))
    both = docs.join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return both.groupBy("page_id").agg(F.count("*").alias("n_sources"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))


@query("""WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R')) AS x, list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A')) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS n_union, len(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v))) AS n_except, list_has_any(coalesce(x, []), coalesce(y, [])) AS overlap FROM a""")
def u3_u4_u5_set_ops(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("x"), F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("y"))
    return a.select("l_orderkey", F.size(F.array_union("x", "y")).cast("long").alias("n_union"), F.size(F.array_except("x", "y")).cast("long").alias("n_except"), F.arrays_overlap("x", "y").alias("overlap"))

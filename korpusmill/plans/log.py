"""Decision-log queries. An event is an occurrence: the user is the entity, the kind the decision, the value its minutes, the hour the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions import text as T
from korpusmill.operators import decisions as D
from korpusmill.operators import filters, ranking
from korpusmill.operators.run_states import RunStates
from korpusmill.plans.registry import Tables, query, scratch


def log(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        "event_id", F.col("user_id").alias("entity"), F.date_format("ts", "yyyy-MM-dd HH").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("decision"),
        F.col("value").alias("minutes"), F.get_json_object("props", "$.k").cast("long").alias("k"), "ts",
    ).withColumns({"external": F.col("k") >= 95, "listed": F.col("k") < 10})


L = """
WITH log AS (SELECT event_id, user_id AS entity, strftime(ts, '%Y-%m-%d %H') AS doc_id, strftime(ts, '%Y-%m-%d') AS run_id, CASE WHEN event_type <> 'view' THEN event_type END AS decision, value AS minutes,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, CAST(json_extract(props, '$.k') AS BIGINT) >= 95 AS external, CAST(json_extract(props, '$.k') AS BIGINT) < 10 AS listed FROM events),
agg AS (SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(sum(coalesce(minutes, 0)), 2) AS minutes, list_sort(list(DISTINCT coalesce(decision, 'discard'))) AS decisions, bool_or(external) AS external, bool_or(listed) AS listed FROM log GROUP BY 1)
"""


def _agg(t: Tables) -> DataFrame:
    return D.aggregate_log(log(t), ["entity"], ["external", "listed"])


@query(L + "SELECT entity, n, n_docs, minutes, array_to_string(decisions, ',') AS decisions, external, listed FROM agg")
def a1_log_aggregate(t: Tables) -> DataFrame:
    return _agg(t).withColumn("decisions", F.array_join("decisions", ","))


@query(
    L + """, day AS (SELECT entity, run_id, count(*) AS n, round(sum(minutes), 2) AS minutes, list(DISTINCT coalesce(decision, 'discard')) AS ds, bool_or(external) AS external, bool_or(listed) AS listed FROM log GROUP BY 1, 2)
SELECT entity, run_id, CASE WHEN external AND list_contains(ds, 'discard') THEN 'high' WHEN n >= 3 AND NOT list_has_any(ds, ['purchase', 'signup']) THEN 'high' WHEN minutes >= 20 AND n >= 2 AND NOT list_has_any(ds, ['purchase', 'signup']) THEN 'high'
 WHEN n >= 2 AND len(ds) > 1 THEN 'high' WHEN listed AND list_contains(ds, 'discard') THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN external AND list_contains(ds, 'discard') THEN 'external entity discarded' WHEN n >= 3 AND NOT list_has_any(ds, ['purchase', 'signup']) THEN 'recurrent without promotion' WHEN minutes >= 20 AND n >= 2 AND NOT list_has_any(ds, ['purchase', 'signup']) THEN 'sustained without promotion'
 WHEN n >= 2 AND len(ds) > 1 THEN 'inconsistent decisions' WHEN listed AND list_contains(ds, 'discard') THEN 'whitelisted entity discarded' END AS reason FROM day"""
)
def a2_review_priority(t: Tables) -> DataFrame:
    day = D.aggregate_log(log(t), ["entity", "run_id"], ["external", "listed"])
    p = D.review_priority(F.col("external"), F.col("listed"), F.col("n"), F.col("minutes"), F.col("decisions"), ["purchase", "signup"])
    return day.withColumn("p", p).select("entity", "run_id", "p.priority", "p.reason")


KINDS = ["click", "purchase", "signup", "error", "discard"]
STATS = "count(*) AS n, count(DISTINCT doc_id) AS n_docs, " + ", ".join(f"count(*) FILTER (coalesce(decision, 'discard') = '{k}') AS n_{k}" for k in KINDS)


@query(L + f"SELECT {STATS} FROM log")
def a3_run_stats(t: Tables) -> DataFrame:
    return D.run_stats(log(t), [], KINDS)


@query(L + f"SELECT run_id, {STATS} FROM log GROUP BY 1")
def a32_all_runs(t: Tables) -> DataFrame:
    return D.run_stats(log(t), ["run_id"], KINDS)


@query(
    L + """, day AS (SELECT entity, run_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(sum(coalesce(minutes, 0)), 2) AS minutes, list_sort(list(DISTINCT coalesce(decision, 'discard'))) AS ds, bool_or(external) AS external, bool_or(listed) AS listed FROM log GROUP BY 1, 2)
SELECT run_id, entity, n, n_docs, minutes, array_to_string(ds, ',') AS decisions, CASE WHEN external AND list_contains(ds, 'discard') THEN 'high' WHEN n >= 3 AND NOT list_has_any(ds, ['purchase', 'signup']) THEN 'high' WHEN minutes >= 20 AND n >= 2 AND NOT list_has_any(ds, ['purchase', 'signup']) THEN 'high'
 WHEN n >= 2 AND len(ds) > 1 THEN 'high' WHEN listed AND list_contains(ds, 'discard') THEN 'medium' ELSE 'low' END AS priority FROM day"""
)
def a32_all_entities(t: Tables) -> DataFrame:
    out = D.all_runs(log(t), ["external", "listed"], KINDS, F.col("external"), F.col("listed"), ["purchase", "signup"])["entities"]
    return out.select("run_id", "entity", "n", "n_docs", "minutes", F.array_join("decisions", ",").alias("decisions"), "priority")


@query(L + f"SELECT run_id, {STATS} FROM log GROUP BY 1")
def a32_all_stats(t: Tables) -> DataFrame:
    return D.all_runs(log(t), ["external", "listed"], KINDS, F.col("external"), F.col("listed"), ["purchase", "signup"])["stats"]


def _states(t: Tables) -> RunStates:
    """The states of all days: put once, the last day wrongly, then that day again; the logs of the others are not read for it."""
    import uuid

    rows = log(t)
    last = rows.agg(F.max("run_id").alias("r")).first().r
    wrong = rows.withColumns({"decision": F.when(F.col("run_id") == last, "wrong").otherwise(F.col("decision")), "minutes": F.when(F.col("run_id") == last, 99.0).otherwise(F.col("minutes"))})
    states = RunStates(t.spark, f"{scratch(t.spark)}/states-{uuid.uuid4().hex[:12]}", "entity", ["external", "listed"]).put(wrong)
    return states.put(rows.filter(F.col("run_id") == last))


@query(L + "SELECT entity, n, n_docs, minutes, array_to_string(decisions, ',') AS decisions, external, listed FROM agg")
def a1_merged_states(t: Tables) -> DataFrame:
    return _states(t).entities().withColumn("decisions", F.array_join("decisions", ","))


@query(L + "SELECT entity, count(DISTINCT doc_id) AS n_docs, max(minutes) AS max_minutes, round(sum(minutes), 2) AS minutes, bool_or(external) AS flagged FROM log GROUP BY 1")
def a5_merged_states(t: Tables) -> DataFrame:
    return _states(t).recurrence_facts("external")


@query(L + f"SELECT run_id, {STATS} FROM log GROUP BY 1")
def a32_stats_of_states(t: Tables) -> DataFrame:
    return _states(t).run_stats(KINDS)


@query("""WITH r AS (SELECT p_name AS title, p_brand AS author, CASE WHEN p_size > 25 THEN p_type END AS domain, p_partkey AS seq FROM part),
f AS (SELECT title, author, min(seq) AS s FROM r GROUP BY 1, 2)
SELECT title AS book_title, (SELECT string_agg(author, ',' ORDER BY s) FROM f WHERE f.title = r.title) AS authors, arg_min(domain, seq) FILTER (domain IS NOT NULL) AS domain, count(*) AS n FROM r GROUP BY 1""")
def a4_bibliography(t: Tables) -> DataFrame:
    refs = t.part.select(F.col("p_name").alias("title"), F.lit(None).cast("string").alias("surface"), F.col("p_brand").alias("author"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("domain"), F.col("p_partkey").alias("seq"))
    return D.bibliography(refs)


@query(L + "SELECT entity, count(DISTINCT doc_id) AS n_docs, max(minutes) AS max_minutes, round(sum(minutes), 2) AS minutes, bool_or(external) AS flagged FROM log GROUP BY 1")
def a5_recurrence_facts(t: Tables) -> DataFrame:
    return D.recurrence_facts(log(t), "entity", F.col("external"))


@query(L + ", f AS (SELECT entity, run_id, count(DISTINCT doc_id) AS n_docs, sum(minutes) AS minutes, bool_or(external) AS x FROM log GROUP BY 1, 2) SELECT entity, run_id, CASE WHEN x THEN n_docs >= 3 OR minutes >= 10 WHEN NOT x THEN n_docs >= 5 ELSE false END AS promote FROM f")
def p16_promotion(t: Tables) -> DataFrame:
    f = log(t).groupBy("entity", "run_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("minutes").alias("minutes"), F.when(F.bool_or("external"), "author").otherwise("concept").alias("kind"))
    rule = filters.promotion_rule(F.col("kind"), {"author": {"docs": 3, "minutes": 10}, "concept": {"docs": 5}}, {"docs": F.col("n_docs"), "minutes": F.col("minutes")})
    return f.select("entity", "run_id", rule.alias("promote"))


def _queues(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = log(t).withColumn("page_id", F.col("entity"))
    return e.filter("decision in ('purchase', 'signup')"), e.filter("decision = 'error'"), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("page_id"))


@query(L + """, pg AS (SELECT c_custkey AS page_id FROM customer WHERE c_acctbal > 0) SELECT entity AS page_id, count(*) FILTER (decision <> 'error') AS n_proposed, count(*) FILTER (decision = 'error') AS n_updates, count(DISTINCT doc_id) AS n_sources,
entity NOT IN (SELECT page_id FROM pg) AS is_new FROM log WHERE decision IN ('purchase', 'signup', 'error') GROUP BY 1""")
def a6_compile_inputs(t: Tables) -> DataFrame:
    return D.compile_inputs(*_queues(t))


@query(L + "SELECT entity, string_agg(r || '|' || doc_id || '|' || substr(CAST(k AS VARCHAR), 1, 1), ';' ORDER BY r) AS items, any_value(c) AS n_items FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_id) AS r, count(*) OVER (PARTITION BY entity) AS c FROM log) WHERE r <= 8 GROUP BY 1")
def p23_bundle(t: Tables) -> DataFrame:
    out = filters.bundle(log(t), "entity", ["event_id"], {"doc_id": 13, "k": 1}, 8)
    return out.withColumn("items", F.array_join(F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), x)), ";"))


REASON = "CASE WHEN regexp_matches(text, '(?i)license') AND lang IN ('en', 'fr') THEN 'reference' WHEN regexp_matches(text, '(?i)idiot|clown') THEN 'insult' WHEN lang = 'es' THEN 'other' END"


def _reason() -> Column:
    return filters.classify(F.col("lang"), F.col("text"), [(["en", "fr"], "license", "reference"), ([], "idiot|clown", "insult"), (["es"], None, "other")])


@query(f"SELECT doc_id, {REASON} AS new_code FROM documents")
def p17_stale_codes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", _reason().alias("new_code"))


@query(f"WITH c AS (SELECT source AS doc_id, {REASON} AS new_code FROM documents) SELECT doc_id, count(*) AS n_stale, count(DISTINCT new_code) AS n_codes FROM c WHERE new_code IS NOT NULL AND doc_id <> 'src3' GROUP BY 1 HAVING count(*) >= 3")
def a23_stale_audit(t: Tables) -> DataFrame:
    e = t.documents.select(F.col("source").alias("doc_id"), _reason().alias("new_code"))
    return D.stale(e, e.filter("doc_id = 'src3'").select("doc_id"))


@query("WITH f AS (SELECT DISTINCT l_partkey AS doc_id FROM lineitem WHERE l_quantity = 50) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN 'reprocess' ELSE 'missing' END AS status FROM f")
def a33_worklist(t: Tables) -> DataFrame:
    return D.worklist(t.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("doc_id")).distinct(), t.documents)


def _findings(t: Tables) -> DataFrame:
    return log(t).select(F.col("entity").alias("page_id"), F.when(F.col("minutes") > 20, "high").when(F.col("minutes") > 8, "medium").otherwise("low").alias("priority"))


@query(L + ", f AS (SELECT entity AS page_id, CASE WHEN minutes > 20 THEN 'high' WHEN minutes > 8 THEN 'medium' ELSE 'low' END AS priority FROM log) SELECT page_id, count(*) AS n, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'low') AS low FROM f GROUP BY 1 HAVING count(*) >= 2")
def a22_audit_by_page(t: Tables) -> DataFrame:
    return D.audit_by_page(_findings(t), 2)


@query(L + ", f AS (SELECT event_id, CASE WHEN minutes > 20 THEN 'high' WHEN minutes > 8 THEN 'medium' ELSE 'low' END AS priority FROM log) SELECT event_id, priority, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, event_id) AS place FROM f QUALIFY place <= 20")
def t5_priority_order(t: Tables) -> DataFrame:
    f = log(t).select("event_id", F.when(F.col("minutes") > 20, "high").when(F.col("minutes") > 8, "medium").otherwise("low").alias("priority"))
    top = f.orderBy(D.priority_order(F.col("priority")), "event_id").limit(20)
    from pyspark.sql import Window as W

    return top.withColumn("place", F.row_number().over(W.orderBy(D.priority_order(F.col("priority")), "event_id")))


@query(L + "SELECT entity, decision, min(event_id) AS event_id FROM log WHERE decision IS NOT NULL GROUP BY 1, 2")
def w3_first_seen(t: Tables) -> DataFrame:
    return D.first_seen(log(t).filter("decision is not null"), ["entity", "decision"], ["event_id"]).select("entity", "decision", "event_id")


@query(L + "SELECT entity, doc_id, arg_max(decision, event_id) FILTER (decision IS NOT NULL) AS reason FROM log GROUP BY 1, 2")
def p8_policy_tags(t: Tables) -> DataFrame:
    chunks = log(t).select("entity", "doc_id").distinct()
    flags = log(t).filter("decision is not null").select("entity", "doc_id", F.col("decision").alias("reason_code"), "event_id")
    return filters.tag_policy(chunks, flags, ["entity", "doc_id"], ["event_id"]).select("entity", "doc_id", F.col("policy_filter.reason_code").alias("reason"))


@query(L + "SELECT event_id, coalesce(max(CASE WHEN decision = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, entity ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS visible FROM log")
def w8_visible_before(t: Tables) -> DataFrame:
    return D.visible_before(log(t), "run_id", "event_id", "entity", F.coalesce(F.col("decision") == "signup", F.lit(False))).select("event_id", "visible")


@query(L + "SELECT entity, min(run_id) AS first_run, max(run_id) AS last_run, count(*) AS n_runs FROM log GROUP BY 1")
def w7_first_last_run(t: Tables) -> DataFrame:
    from korpusmill.streaming.incremental import first_last

    return first_last(log(t), "entity", "run_id")


@query(L + "SELECT event_id, CAST(round(minutes) AS INT) >= 15 AND k >= 30 AND length(decision) >= 5 AND NOT external AS promote FROM log WHERE decision IS NOT NULL")
def p15_auto_promote(t: Tables) -> DataFrame:
    return log(t).filter("decision is not null").select("event_id", filters.auto_promote(F.round("minutes").cast("int").cast("string"), F.col("k"), F.length("decision"), F.col("external"), (15, 30, 5)).alias("promote"))


@query("SELECT doc_id, lang IN ('en', 'de') AND length(text) <= 120 AND len(string_split_regex(trim(text), '\\s+')) <= 15 AS recoverable FROM documents WHERE lang IN ('en', 'de') AND length(text) <= 120 AND len(string_split_regex(trim(text), '\\s+')) <= 15")
def p11_recoverable(t: Tables) -> DataFrame:
    return filters.recoverable(t.documents, ["en", "de"], "lang", "text").select("doc_id", F.lit(True).alias("recoverable"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS label FROM customer")
def p19_first_filled(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.first_filled(F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("label"))


@query(L + """, led AS (SELECT DISTINCT doc_id FROM log WHERE decision = 'purchase'), n AS (SELECT doc_id, count(*) FILTER (decision = 'click') AS proposed, count(*) FILTER (decision = 'error') AS filtered, count(*) FILTER (decision = 'signup') AS queued FROM log GROUP BY 1)
SELECT doc_id, proposed, filtered, queued, CASE WHEN doc_id IN (SELECT doc_id FROM led) AND queued > 0 THEN 'queued' WHEN doc_id IN (SELECT doc_id FROM led) THEN 'done' ELSE 'pending' END AS status FROM n""")
def r17_coverage(t: Tables) -> DataFrame:
    e = log(t)
    state = F.when(F.col("decision") == "click", "proposed").when(F.col("decision") == "error", "filtered").when(F.col("decision") == "signup", "queued")
    return ranking.coverage(e.select("doc_id").distinct(), e.filter("decision = 'purchase'"), e.select("doc_id", state.alias("state")))


@query(L + ", f AS (SELECT entity, n, n_docs, minutes FROM agg) SELECT entity, round(0.3 * n / (SELECT max(n) FROM f) + 0.2 * n_docs / (SELECT max(n_docs) FROM f) + 0.5 * minutes / (SELECT max(minutes) FROM f), 4) AS score FROM f")
def r16_weighted_rank(t: Tables) -> DataFrame:
    return ranking.weighted_rank(_agg(t), {"n": 0.3, "n_docs": 0.2, "minutes": 0.5}, "entity")


CONF = {"high": "k >= 60", "medium": "k BETWEEN 30 AND 59", "low": "k < 30"}


@query(L + "SELECT entity, count(*) FILTER (k >= 20) AS eligible, count(*) FILTER (decision = 'purchase') AS hits, count(*) FILTER (decision = 'error') AS misses, count(*) FILTER (decision IS NULL) AS skipped, "
       + ", ".join(f"count(*) FILTER (decision IN ('purchase', 'error') AND {c}) AS matched_{n}" for n, c in CONF.items()) + " FROM log GROUP BY 1")
def a24_recovery_stats(t: Tables) -> DataFrame:
    state = F.when(F.col("decision") == "purchase", "hit").when(F.col("decision") == "error", "miss").when(F.col("decision").isNull(), "skipped")
    confidence = F.when(F.col("k") >= 60, "high").when(F.col("k") >= 30, "medium").otherwise("low")
    return D.recovery_stats(log(t).select("entity", (F.col("k") >= 20).alias("eligible"), state.alias("state"), confidence.alias("confidence")), ["entity"])


@query("""SELECT c.c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 490000)
 OR trim(CASE WHEN c_acctbal > 9900 THEN c_name ELSE ' ' END) <> '' OR (c_acctbal < -950) AS v03 FROM customer c""")
def p18_schema_version(t: Tables) -> DataFrame:
    marks = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("marks"), F.collect_list(F.when(F.col("o_totalprice") > 490000, F.col("o_totalprice"))).alias("prices"))
    out = t.customer.join(marks, F.col("c_custkey") == F.col("o_custkey"), "left")
    note, scalar = F.when(F.col("c_acctbal") > 9900, F.col("c_name")).otherwise(" "), F.when(F.col("c_acctbal") < -950, F.col("c_acctbal"))
    return out.select("c_custkey", D.has_marker({"marks": lambda m: m == "P", "prices": lambda p: p > 490000}, [note], [scalar]).alias("v03"))


@query(L + ", d AS (SELECT doc_id, count(*) FILTER (decision = 'purchase') AS a, count(*) FILTER (decision = 'error') AS b FROM log GROUP BY 1) SELECT doc_id, a = 0 AND b = 0 AS rejected FROM d")
def p14_all_empty(t: Tables) -> DataFrame:
    d = log(t).groupBy("doc_id").agg(F.collect_list(F.when(F.col("decision") == "purchase", F.col("event_id"))).alias("a"), F.collect_list(F.when(F.col("decision") == "error", F.col("event_id"))).alias("b"))
    return d.select("doc_id", filters.all_empty(d, ["a", "b"]).alias("rejected"))

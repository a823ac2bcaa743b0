"""Patches, projects, queues and incremental runs over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.operators import decisions, patches, projects
from korpusmill.plans.registry import Tables, query, scratch
from korpusmill.sources.ranges import RangeSnapshot, changes
from korpusmill.streaming import incremental as I


def _edits(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "insert_after").when(F.col("doc_id") % 4 == 1, "insert_before").when(F.col("doc_id") % 4 == 2, "extend").otherwise("replace")
    return t.documents.select("doc_id", "text", F.substring("text", 5, 12).alias("anchor"), F.lit("NEW").alias("content"), kind.alias("kind"))


@query("""WITH e AS (SELECT doc_id, text, substr(text, 5, 12) AS a, (length(text) - length(replace(text, substr(text, 5, 12), ''))) // nullif(length(substr(text, 5, 12)), 0) AS n, instr(text, substr(text, 5, 12)) AS i FROM documents)
SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 'anchor_missing' WHEN n > 1 THEN 'anchor_ambiguous' ELSE 'applied' END AS outcome,
md5(CASE WHEN n = 1 THEN substr(text, 1, i - 1) || CASE doc_id % 4 WHEN 0 THEN a || chr(10) || 'NEW' WHEN 1 THEN 'NEW' || chr(10) || a WHEN 2 THEN a || ' NEW' ELSE 'NEW' END || substr(text, i + length(a)) ELSE text END) AS new_text FROM e""")
def e1_unique_anchor(t: Tables) -> DataFrame:
    return patches.unique_anchor(_edits(t)).select("doc_id", "outcome", F.md5("new_text").alias("new_text"))


@query()
def e4_ordered_updates(t: Tables) -> DataFrame:
    """Every conversation page takes an edit for each turn of its own, in order."""
    from korpusmill.plans.text import markdown

    pages = markdown(t).select(F.col("conv_id").alias("page_id"), F.col("body").alias("text"))
    kind = F.when(F.col("turn") % 3 == 0, "append_section").when(F.col("turn") % 3 == 1, "extend").otherwise("resolve_gap")
    anchor = F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.substring("text", 1, 30))
    ups = t.conversations.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), kind.alias("kind"), anchor.alias("anchor"), F.concat(F.lit("note "), "turn").alias("content"))
    return patches.apply_updates(pages, ups, limit=50)


MD = "md AS (SELECT conv_id, string_agg('## ' || role || chr(10) || '- ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1)"


def _pages(t: Tables) -> DataFrame:
    from korpusmill.plans.text import markdown

    return markdown(t).select(F.col("conv_id").alias("page_id"), F.col("body").alias("text"))


def _outcome(out: DataFrame) -> DataFrame:
    return out.select("page_id", F.md5("new_text").alias("new_text"), "n_applied", "log")


@query(rf"""WITH {MD}, l AS (SELECT conv_id, string_split(body, chr(10)) AS x, CASE WHEN conv_id % 5 = 0 THEN 'nobody' ELSE 'assistant' END AS h FROM md),
s AS (SELECT conv_id, x, list_position(list_transform(x, lambda v: regexp_full_match(lower(v), '##\s+' || h || '\s*')), true) AS st FROM l),
e AS (SELECT conv_id, x, st, coalesce(list_position(list_transform(x[st + 1:], lambda v: regexp_matches(v, '^#{{1,2}}\s')), true) + st, len(x) + 1) AS en FROM s),
k AS (SELECT conv_id, x, st, coalesce(list_max(list_filter(range(st + 1, en), lambda i: trim(x[i], ' ' || chr(9) || chr(10) || chr(13)) <> '')), st) AS last FROM e)
SELECT conv_id AS page_id, md5(array_to_string(CASE WHEN coalesce(st, 0) = 0 THEN x ELSE x[1:last] || ['- added to ' || conv_id] || x[last + 1:] END, chr(10))) AS new_text, CAST(coalesce(st, 0) > 0 AS INT) AS n_applied, CASE WHEN coalesce(st, 0) > 0 THEN 'applied' ELSE 'section_missing' END AS log FROM k""")
def e2_append_section(t: Tables) -> DataFrame:
    """A bullet at the end of the first section of that name, one for each page; a fifth of the pages are asked for a section that they lack."""
    heading = F.when(F.col("page_id") % 5 == 0, "nobody").otherwise("assistant")
    ups = _pages(t).select("page_id", F.lit(1).alias("seq"), F.lit("append_section").alias("kind"), heading.alias("anchor"), F.concat(F.lit("- added to "), "page_id").alias("content"))
    return _outcome(patches.apply_updates(_pages(t), ups))


@query(rf"""WITH {MD}, g AS (SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN 'abc ' ELSE '' END || arg_min(substr(text, 1, 60), turn) AS gap FROM conversations WHERE turn > 0 GROUP BY 1),
l AS (SELECT md.conv_id, string_split(body, chr(10)) AS x, lower(trim(gap, ' ' || chr(9) || chr(10) || chr(13))) AS gap, list_transform(list_filter(regexp_extract_all(gap, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 4)[1:3], lambda w: lower(w)) AS ws FROM md JOIN g USING (conv_id)),
p AS (SELECT conv_id, x, coalesce(nullif(list_position(list_transform(x, lambda v: starts_with(v, '- ') AND contains(lower(v), gap)), true), 0),
 CASE WHEN len(ws) > 0 THEN nullif(list_position(list_transform(x, lambda v: starts_with(v, '- ') AND len(list_filter(ws, lambda w: NOT contains(lower(v), w))) = 0), true), 0) END) AS i FROM l)
SELECT conv_id AS page_id, md5(array_to_string(CASE WHEN i IS NULL THEN x ELSE x[1:i - 1] || ['<!-- resolved -->'] || x[i:] END, chr(10))) AS new_text, CAST(i IS NOT NULL AS INT) AS n_applied, CASE WHEN i IS NULL THEN 'gap_missing' ELSE 'applied' END AS log FROM p""")
def e3_resolve_gap(t: Tables) -> DataFrame:
    """A marker before the bullet that states a gap: literally, or for a third of the pages, whose gap has a word put before it, by its longer words."""
    gap = t.conversations.filter("turn > 0").groupBy(F.col("conv_id").alias("page_id")).agg(F.min_by(F.substring("text", 1, 60), "turn").alias("g"))
    anchor = F.concat(F.when(F.col("page_id") % 3 == 1, "abc ").otherwise(""), "g")
    ups = gap.select("page_id", F.lit(1).alias("seq"), F.lit("resolve_gap").alias("kind"), anchor.alias("anchor"), F.lit("<!-- resolved -->").alias("content"))
    return _outcome(patches.apply_updates(_pages(t).join(gap.select("page_id"), "page_id", "left_semi"), ups))


def _fold_sql(order: str) -> str:
    return f"""WITH RECURSIVE {MD}, u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS k, substr(text, 1, 9) AS a, 'note ' || turn AS c, turn % 3 AS kind FROM conversations WHERE length(text) > 0),
f(conv_id, k, t, n) AS (SELECT conv_id, CAST(0 AS BIGINT), body, 0 FROM md UNION ALL
 SELECT f.conv_id, u.k, CASE WHEN length(t) - length(replace(t, a, '')) = length(a) THEN replace(t, a, CASE kind WHEN 0 THEN a || ' ' || c WHEN 1 THEN c ELSE a || chr(10) || c END) ELSE t END, n + CAST(length(t) - length(replace(t, a, '')) = length(a) AS INT)
 FROM f JOIN u ON u.conv_id = f.conv_id AND u.k = f.k + 1)
SELECT conv_id AS page_id, md5(t) AS new_text, n AS n_applied FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1"""


def _anchored(t: Tables) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 0, "extend").when(F.col("turn") % 3 == 1, "replace").otherwise("insert_after")
    return t.conversations.filter("length(text) > 0").select(F.col("conv_id").alias("page_id"), "turn", kind.alias("kind"), F.substring("text", 1, 9).alias("anchor"), F.concat(F.lit("note "), "turn").alias("content"))


@query(_fold_sql("turn"))
def e4_anchor_fold(t: Tables) -> DataFrame:
    """Edits by anchor, each on what the last one left: an anchor that an edit doubled or took away is found no more."""
    return patches.apply_updates(_pages(t), _anchored(t).withColumnRenamed("turn", "seq")).select("page_id", F.md5("new_text").alias("new_text"), "n_applied")


@query(_fold_sql("turn % 2, -turn"))
def e9_replay(t: Tables) -> DataFrame:
    """The same edits from two logged files, the one of even turns written first, the last turn of each first."""
    records = _anchored(t).select("*", (F.col("turn") % 2).alias("mtime"), F.lit("a").alias("file"), (-F.col("turn")).alias("idx"))
    return patches.replay(_pages(t), records).select("page_id", F.md5("new_text").alias("new_text"), "n_applied")


@query("SELECT conv_id AS page_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 5")
def e5_over_limit(t: Tables) -> DataFrame:
    return patches.over_limit(t.conversations.withColumnRenamed("conv_id", "page_id"), 5)


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'gone' WHEN lang = 'en' AND source IN ('src1', 'src2') AND text <> upper(text) THEN 'changed' WHEN source = 'src5' THEN 'new' ELSE 'unchanged' END AS status FROM documents WHERE NOT (lang = 'fr' AND source = 'src5')")
def e6_change_report(t: Tables) -> DataFrame:
    before = t.documents.filter("source <> 'src5'")
    after = t.documents.filter("lang <> 'fr'").withColumn("text", F.when(F.expr("lang = 'en' and source in ('src1', 'src2')"), F.upper("text")).otherwise(F.col("text")))
    return patches.change_report(before, after, "doc_id", "text")


@query("SELECT 'p' || p_partkey AS page_id, '---' || chr(10) || 'page_id: p' || p_partkey || chr(10) || 'page_type: ' || p_type || chr(10) || '---' || chr(10) || '# ' || p_name || chr(10) AS text FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)")
def e7_stubs(t: Tables) -> DataFrame:
    c = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("page_id"), F.col("p_type").alias("page_type"), F.col("p_name").alias("canonical_name"))
    have = t.lineitem.filter("l_quantity >= 40").select(F.concat(F.lit("p"), "l_partkey").alias("page_id"))
    return patches.stubs(c, have).select("page_id", "text")


@query("SELECT path, status FROM (SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'unchanged' ELSE 'new' END AS status FROM orders)")
def s13_snapshot_diff(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("path"), "o_orderstatus", F.col("o_orderpriority").alias("body"))
    return patches.change_report(rows.filter("o_orderstatus = 'F'"), rows, "path", "body")


@query("""WITH d AS (SELECT *, doc_id > 0.9 * (SELECT max(doc_id) FROM documents) AS late FROM documents)
SELECT doc_id, CASE WHEN NOT late THEN 'unchanged' WHEN lang = 'fr' THEN 'gone' WHEN source = 'src5' THEN 'new' WHEN source = 'src1' AND text <> upper(text) THEN 'changed' ELSE 'unchanged' END AS status FROM d WHERE NOT (late AND lang = 'fr' AND source = 'src5')""")
def s13_ranged_diff(t: Tables) -> DataFrame:
    """Two snapshots that differ in their last tenth; the other ranges are told apart by digests alone."""
    import uuid

    root = f"{scratch(t.spark)}/ranges-{uuid.uuid4().hex[:12]}"
    most = t.documents.agg(F.max("doc_id").alias("m")).first().m
    rows = t.documents.withColumn("late", F.col("doc_id") > 0.9 * (most or 0))
    a = RangeSnapshot.write(rows.filter("not (late and source = 'src5')"), f"{root}/a", "doc_id", "text")
    text = F.when(F.col("late") & (F.col("source") == "src1"), F.upper("text")).otherwise(F.col("text"))
    b = RangeSnapshot.write(rows.filter("not (late and lang = 'fr')").withColumn("text", text), f"{root}/b", "doc_id", "text", like=a)
    return changes(a, b, unchanged=True)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j12_pending(t: Tables) -> DataFrame:
    return I.pending(t.customer.select("c_custkey"), t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY 1 LIMIT 20")
def t6_next_batch(t: Tables) -> DataFrame:
    led = t.orders.join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return I.pending(t.orders.select("o_orderkey"), led, "o_orderkey", limit=20)


DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"


@query(DAYS)
def t8_daily_rates(t: Tables) -> DataFrame:
    return I.event_rates(t.events, "1 day")


@query("SELECT s AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOURS]) AS s, event_type, value FROM events) GROUP BY 1, 2")
def t8_sliding_rates(t: Tables) -> DataFrame:
    return I.event_rates(t.events, "1 day", "12 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def t8_sessions(t: Tables) -> DataFrame:
    return I.sessions(t.events, "6 hours")


@query(DAYS)
def t8_streamed_rates(t: Tables) -> DataFrame:
    """The daily rates again, by a streaming query over the events."""
    import uuid

    root = f"{scratch(t.spark)}/rates-{uuid.uuid4().hex[:12]}"
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    I.stream_rates(I.event_rates(stream, "1 day", late="1 day"), f"{root}/table", f"{root}/state")
    return I.read_rates(t.spark, f"{root}/table")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def t1_t3_stream_latest(t: Tables) -> DataFrame:
    """The last event of each user, kept by a stream that appends its batches and remembers what it has read."""
    import uuid

    root = f"{scratch(t.spark)}/stream-{uuid.uuid4().hex[:12]}"
    I.run_stream(t.spark, f"{t.sf_dir}/event[s].parquet", t.events.schema, lambda b: b.select("user_id", "ts", "event_id", "event_type"), f"{root}/table", f"{root}/state", ["user_id"], order=["ts", "event_id"])
    return I.read_stream(t.spark, f"{root}/table", ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS k FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 300)) WHERE k = 1")
def t5_apply_once(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type")
    return I.apply_once(e, t.events.filter("value > 300").select("user_id"), "user_id").select("event_id", "user_id")


STATES = """WITH RECURSIVE x AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' WHEN 'signup' THEN CASE WHEN value > 45 THEN 'cancel' ELSE 'other' END ELSE 'other' END AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, state, n) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'pending', 0 FROM x UNION ALL
 SELECT x.user_id, x.k, CASE WHEN state IN ('done', 'failed', 'cancelled') THEN state WHEN e = 'cancel' THEN 'cancelled' WHEN e = 'start' AND state = 'pending' THEN 'processing' WHEN e = 'done' AND state = 'processing' THEN 'done' WHEN e = 'fail' AND state = 'processing' THEN CASE WHEN n + 1 > 3 THEN 'failed' ELSE 'pending' END ELSE state END,
 CASE WHEN state = 'processing' AND e = 'fail' THEN n + 1 ELSE n END FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
SELECT user_id, state, n AS retries FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""


def _requests(events: DataFrame) -> DataFrame:
    e = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").when((F.col("event_type") == "signup") & (F.col("value") > 45), "cancel").otherwise("other")
    return events.withColumn("e", e)


@query(STATES)
def t6_queue_states(t: Tables) -> DataFrame:
    return projects.fold_states(_requests(t.events), "user_id", ["ts", "event_id"], "e").select("user_id", "state", "retries")


@query(STATES)
def t6_streamed_states(t: Tables) -> DataFrame:
    """The same states from a stateful stream, its state in the shared folder."""
    import uuid

    from korpusmill.streaming import queue

    root = f"{scratch(t.spark)}/queue-{uuid.uuid4().hex[:12]}"
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    states = queue.queue_states(_requests(stream), "user_id", "ts", "event_id", "e")
    queue.start_queue(states, f"{root}/table", f"{root}/state").awaitTermination()
    return queue.read_queue(t.spark, f"{root}/table", "user_id").select("user_id", "state", "retries")


@query("""WITH q AS (SELECT o_custkey AS project_id, o_orderpriority AS url FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey AS project_id, o_orderpriority AS url, min(o_orderkey) AS created_at FROM orders WHERE o_orderstatus <> 'P' AND (o_custkey, o_orderpriority) NOT IN (SELECT (project_id, url) FROM q) GROUP BY 1, 2""")
def t7_enqueue(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("url"), F.col("o_orderkey").alias("created_at"), "o_orderstatus")
    queue = rows.filter("o_orderstatus = 'P'").withColumn("status", F.lit("pending"))
    return projects.enqueue(queue, rows.filter("o_orderstatus <> 'P'").drop("o_orderstatus"))


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS priority, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total_matching FROM orders WHERE o_orderstatus = 'O' ORDER BY 2 DESC, o_orderkey LIMIT 50")
def t7_list_queue(t: Tables) -> DataFrame:
    rows = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority"))
    return projects.list_queue(rows, ["o_orderkey"])


@query("SELECT c_custkey AS project_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_pages, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_pending FROM customer WHERE c_acctbal >= 0")
def a28_list_projects(t: Tables) -> DataFrame:
    p = t.customer.select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_acctbal") < 0, "then").alias("archived_at"))
    o = t.orders.withColumnRenamed("o_custkey", "project_id")
    return projects.list_projects(p, (o, "n_pages"), (o.filter("o_orderstatus = 'O'"), "n_pending")).drop("archived_at")


@query("SELECT l_orderkey AS query_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS projects_seen FROM lineitem GROUP BY 1")
def a29_projects_seen(t: Tables) -> DataFrame:
    return projects.projects_seen(t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("project_id")))


@query("SELECT o_orderkey, 'error' AS decision FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'promote' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def u2_exploded_records(t: Tables) -> DataFrame:
    one = F.array(F.struct(F.col("o_orderstatus").alias("surface"), F.lit("error").alias("decision")))
    two = F.when(F.col("o_totalprice") > 250000, F.array(F.struct(F.col("o_orderstatus").alias("surface"), F.lit(None).cast("string").alias("decision"))))
    rows = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", one.alias("entities"), two.alias("promote_new"))
    return decisions.explode_records(rows, {"entities": "discard", "promote_new": "promote"}, "o_orderkey").select("o_orderkey", "decision")


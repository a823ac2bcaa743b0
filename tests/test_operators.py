"""Hand-made cases with expected results, and laws that hold for any input."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpusmill.functions import text as T
from korpusmill.operators import chunks, decisions, filters, graph, matching, patches, projects, ranking
from korpusmill.operators import retrieval as R
from korpusmill.sources import tables
from korpusmill.streaming import incremental


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("s,n", [("05:23", 323), ("1:02:03", 3723), ("99:99", 6039), ("x", None)])
def test_times(spark, s, n):
    assert one(spark, T.time_to_seconds(F.col("s")), s=s) == n


def test_time_text_and_links(spark):
    assert [one(spark, T.seconds_to_time(F.col("n")), n=n) for n in (5, 323, 3723)] == ["0:05", "5:23", "1:02:03"]
    assert one(spark, T.deep_link(F.lit("u"), F.col("n")), n=0) == "u" and one(spark, T.deep_link(F.lit("u"), F.col("n")), n=5) == "u?t=5"


def test_text_functions(spark):
    assert one(spark, T.fold(F.col("s")), s="Ñandú ÉÀç") == "Nandu EAc"
    assert one(spark, T.slug(F.col("s")), s="  ¡Él  es, así! ") == "el-es-asi"
    assert one(spark, T.alias_variants(F.col("s")), s="Él (libro)") == ["Él (libro)", "El (libro)", "Él", "El"]
    assert one(spark, T.query_variants(F.col("s")), s="carl-jung") == ["carl jung", "jung carl"]
    assert one(spark, T.query_variants(F.col("s")), s="aion-1951-book") == ["aion 1951 book", "aion"]
    assert one(spark, T.trim_section(F.col("s")), s="a\n## Citations\nb") == "a\n"
    assert one(spark, T.first_section(F.col("s")), s="x\n## H\n> q\n→ r\nbody\n## J\nz") == "body"
    assert one(spark, T.snippet(F.col("s"), 800), s="# T\n## H\n\npara one\n\nmore") == "# T\n## H\npara one"
    assert one(spark, T.one_liner(F.col("s")), s="First one. Second") == "First one."
    assert one(spark, T.balanced_json(F.col("s")), s='x ```{"a": {"b": 1}}``` y') == '{"a": {"b": 1}}'
    assert one(spark, T.coerce_enum(F.col("s"), ["high"], "low"), s="NULL") is None
    assert one(spark, T.section_bullets(F.col("s"), "Lagunas"), s="## Lagunas\n- a\n- b\n## X\n- c") == 2


def test_chunks(spark):
    text = "intro\n- 05:23 First\n  - bullet one,\n  - bullet two.\n- 06:00 Empty\n- 1:02:03 Last\n\t\t- z\n- 123:45 no header\n"
    out = chunks.split_chunks(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc_id string, text string")).collect()
    assert [(r.timestamp, r.timestamp_seconds, r.theme, r.content) for r in out] == [("05:23", 323, "First", "- bullet one\n- bullet two"), ("1:02:03", 3723, "Last", "- z")]


def test_citation_lane(spark):
    seeds = spark.createDataFrame([(1, "d1", 10, 0.56), (1, "d2", 5, 0.61), (1, "d3", 1, 0.59), (1, "d1", 99, 0.7)], "query_id int, doc_id string, ts int, dense_score double")
    cites = spark.createDataFrame([("p1", "d1", 10), ("p2", "d2", 7), ("p3", "d3", 2), ("p4", "d1", 3)], "page_id string, doc_id string, ts int")
    got = {(r.page_id, r.match_strength, r.effective_score) for r in R.citation_lane(seeds, cites).collect()}
    assert got == {("p1", "exact", 0.56), ("p2", "same_document", 0.183), ("p4", "same_document", 0.21)}


def test_modes(spark):
    q = spark.createDataFrame([(i,) for i in range(6)], "query_id int")
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, score double")
    pages = spark.createDataFrame([(2, "citation")], "query_id int, match_via string")
    out = R.classify_mode(q, hits([(1, 0.6), (2, 0.6), (3, 0.6), (4, 0.5), (5, 0.6)]), pages, hits([(3, 0.7), (4, 0.5), (5, 0.5)])).collect()
    assert {r.query_id: r.mode for r in out} == {0: "no_results", 1: "raw_only", 2: "raw_with_wiki_via_citation", 3: "wiki_dominant", 4: "raw_with_warning", 5: "balanced"}


def test_rrf(spark):
    lanes = spark.createDataFrame([("a", 1, 7, 1), ("b", 1, 7, 1), ("a", 1, 8, 2)], "lane string, query_id int, id int, rank int")
    assert {r.id: r.score for r in R.rrf(lanes).collect()} == {7: 1.0, 8: 0.333333}


def test_dense_blocks_agree(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id < 30").withColumnRenamed("id", "query_id")
    small, large = (sorted(map(tuple, R.dense_topk(q, e, 4, block=b).collect())) for b in (37, 4096))
    assert small == large and len(small) == 120
    assert R.dense_topk(q.limit(0), e, 4).count() == 0 and R.dense_topk(q, e.limit(0), 4).count() == 0


def test_walk_and_drift(spark):
    rel = spark.createDataFrame([("a", "t", "b", "strong"), ("b", "t", "c", "strong"), ("c", "t", "a", "strong"), ("a", "t", "z", "tangential")], "from_page_id string, type string, to_page_id string, weight string")
    got = {(r.page_id, r.hops) for r in graph.walk(rel, spark.createDataFrame([("a",)], "page_id string"), 3).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    links = spark.createDataFrame([("a", "b"), ("a", "q")], "page_id string, target_page_id string")
    assert {(r.to_page_id, r.only_in) for r in graph.drift(rel, links).collect()} == {("q", "wikilink"), ("c", "relation"), ("a", "relation"), ("z", "relation")}


def test_alias_gate(spark):
    gate = lambda a, s: one(spark, filters.alias_ok(F.col("a"), F.col("s")), a=a, s=s)
    assert gate("Él", "dijo el, no") and not gate("el", "elefante") and not gate("a b c d e", "a b c d e") and not gate("x" * 51, "x" * 51)


def test_alias_scan_and_resolve(spark):
    docs = spark.createDataFrame([(1, "La Gran Obra, de Jung"), (2, "jungla y yo")], "doc_id int, text string")
    al = spark.createDataFrame([("p1", "gran obra", False), ("p2", "Jung", False), ("p3", "yo", True), ("p4", "yo", False)], "page_id string, alias string, canonical boolean")
    assert {(r.page_id, r.doc_id) for r in matching.scan_aliases(docs, al).collect()} == {("p1", 1), ("p2", 1), ("p3", 2)}
    assert {(r.page_id, r.doc_id) for r in matching.scan_aliases(docs, al, stop=["yo"]).collect()} == {("p1", 1), ("p2", 1)}


def test_idempotence(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = tables.upsert(old, new, ["id"])
    assert sorted(map(tuple, tables.upsert(once, new, ["id"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    al = spark.createDataFrame([("p", "Él")], "page_id string, alias string")
    add = spark.createDataFrame([("p", "el"), ("p", "Ella")], "page_id string, alias string")
    first = matching.add_aliases(al, add)
    assert sorted(r.alias for r in first.collect()) == ["Ella", "Él"] == sorted(r.alias for r in matching.add_aliases(first, add).collect())


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=40), st.text("ab", max_size=4), st.sampled_from(["insert_after", "insert_before", "extend", "replace", "nonsense"]))
def test_anchor_edit_law(text, anchor, kind):
    now, what = patches._anchor_edit(text, kind, anchor, "NEW")
    assert (what == "applied") == (bool(anchor) and text.count(anchor) == 1 and kind != "nonsense")
    assert what == "applied" or now == text


def test_section_edits():
    page = "# T\n## A\n- first gap here\n### Sub\nx\n\n## B\ny"
    assert patches.append_to_section(page, "A → Sub", "new") == ("# T\n## A\n- first gap here\n### Sub\nx\nnew\n\n## B\ny", "applied")
    assert patches.append_to_section(page, "A → Nope", "new") == (page, "section_missing") and patches.append_to_section(page, "A", "x")[1] == "present"
    assert patches.resolve_gap(page, "First gap", "<!-- done -->")[0].split("\n")[2] == "<!-- done -->" and patches.resolve_gap(page, "none such", "m")[1] == "gap_missing"


def test_ordered_updates(spark):
    pages = spark.createDataFrame([(1, "## A\none"), (2, "x x"), (3, "t")], "page_id int, text string")
    ups = spark.createDataFrame([(1, 2, "extend", "two", "three"), (1, 1, "extend", "one", "two"), (2, 1, "replace", "x", "y"), (3, 1, "replace", "t", "u"), (3, 2, "replace", "u", "v")], "page_id int, seq int, kind string, anchor string, content string")
    got = {r.page_id: (r.new_text, r.log, r.status) for r in patches.apply_updates(pages, ups, 5).collect()}
    assert got == {1: ("## A\none two three", "applied,applied", "changed"), 2: ("x x", "anchor_ambiguous", "unchanged"), 3: ("v", "applied,applied", "changed")}
    assert {r.page_id: r.status for r in patches.apply_updates(pages, ups, 1).collect()}[1] == "over_limit"


def test_replay_order(spark):
    pages = spark.createDataFrame([(1, "a")], "page_id int, text string")
    rec = spark.createDataFrame([(1, 2, "f", 0, "replace", "b", "c"), (1, 1, "g", 1, "extend", "x", "y"), (1, 1, "g", 0, "replace", "a", "b x")], "page_id int, mtime int, file string, idx int, kind string, anchor string, content string")
    assert patches.replay(pages, rec).first().new_text == "c x y"


def test_queue(spark):
    ev = [(1, i, e) for i, e in enumerate(["start", "fail"] * 4 + ["start"])] + [(2, 0, "start"), (2, 1, "done"), (2, 2, "cancel")] + [(3, 0, "cancel"), (3, 1, "start")] + [(4, 0, "start"), (4, 1, "fail")]
    out = {r.k: (r.state, r.retries, r.wait_s) for r in projects.fold_states(spark.createDataFrame(ev, "k int, t int, e string"), "k", ["t"], "e").collect()}
    assert out == {1: ("failed", 4, None), 2: ("done", 0, None), 3: ("cancelled", 0, None), 4: ("pending", 1, 60)}


def test_priority_and_bibliography(spark):
    df = spark.createDataFrame([(True, False, 1, 1.0, ["discard"]), (False, False, 3, 1.0, ["discard"]), (False, False, 2, 25.0, ["discard"]), (False, False, 2, 1.0, ["discard", "promote_new"]), (False, True, 1, 1.0, ["discard"]), (False, False, 1, 1.0, ["x"])], "e boolean, w boolean, n int, m double, d array<string>")
    p = decisions.review_priority(F.col("e"), F.col("w"), F.col("n"), F.col("m"), F.col("d"), ["promote_new", "update_existing"])
    assert [r.p.priority for r in df.select(p.alias("p")).collect()] == ["high", "high", "high", "high", "medium", "low"]
    refs = spark.createDataFrame([("T", None, "B", None, 2), ("T", None, "A", "d", 1), (None, "S", "C", None, 3), ("", None, "D", None, 4)], "title string, surface string, author string, domain string, seq int")
    assert {(r.book_title, r.authors, r.domain) for r in decisions.bibliography(refs).collect()} == {("T", "A,B", "d"), ("S", "C", None), ("unknown", "D", None)}


def test_ranking_floor(spark):
    rec = spark.createDataFrame([("a", 0, None)], "candidate string, n_chunks long, avg_top10 double")
    inc = spark.createDataFrame([], "candidate string, n_in long, bonus double")
    r = ranking.rank_candidates(rec, inc).first()
    assert (r.score, r.viable, r.reason) == (0.0, False, "few chunks")


def test_sources(spark, tmp_path):
    d = tmp_path / "corpus/coll/doc-a"
    d.mkdir(parents=True)
    (d / "summary.md").write_text("- 00:05 T\n  - b\n")
    (d / "meta.json").write_text(json.dumps({"video_id": "v1", "title": "A"}))
    lone = tmp_path / "corpus/coll/doc-b"
    lone.mkdir()
    (lone / "summary.md").write_text("x")
    r = tables.scan_corpus(spark, str(tmp_path / "corpus")).collect()
    assert [(x.doc_id, x.collection, x.slug, x.category, x.duration_s, x.channel) for x in r] == [("v1", "coll", "doc-a", "uncategorized", 0, "unknown")]
    w = tmp_path / "wiki/sub"
    w.mkdir(parents=True)
    (w / "p.md").write_text("---\npage_id: p-1\npage_type: concept\ncanonical_name: 'P One'\naliases:\n  - a1\n  - \"a2\"\ndomain: [x.y, z]\nsources_count: abc\nrelations:\n  - type: see_also\n    to: q\n    weight: strong\n  - type: lost\n---\n# P\n[[q|Q]] and [[r]]\n")
    (w / "README.md").write_text("---\npage_id: no\n---\n")
    (w / "bad.md").write_text("no frontmatter")
    p = tables.scan_pages(spark, str(tmp_path / "wiki")).collect()
    assert len(p) == 1 and p[0].aliases == ["a1", "a2"] and p[0].domain == ["x.y", "z"] and p[0].sources_count is None and p[0].canonical_name == "P One"
    assert [tuple(x) for x in p[0].relations] == [("see_also", "q", "strong", None)]
    assert {x.target_page_id for x in graph.wikilinks(tables.scan_pages(spark, str(tmp_path / "wiki"))).collect()} == {"q", "r"}
    run = tmp_path / "runs/r1"
    run.mkdir(parents=True)
    (run / "abcdefghijk.json").write_text(json.dumps({"video_id": "abcdefghijk", "entities": [{"surface_form": "s", "decision": "discard"}]}))
    (run / "discard_log.json").write_text("{}")
    (run / "zzzzzzzzzzz.json").write_text("{broken")
    x = {r.file: r for r in tables.scan_extractions(spark, str(tmp_path / "runs")).collect()}
    assert set(x) == {"abcdefghijk", "zzzzzzzzzzz"} and x["abcdefghijk"].run_id == "r1" and x["zzzzzzzzzzz"]._corrupt
    kinds = spark.createDataFrame([(json.dumps({"types": {"t": {"description": "d", "inverse": "u", "from": ["a"], "to": []}}}),)], "value string")
    assert [tuple(r) for r in tables.flatten_dictionary(kinds).collect()] == [("t", "d", "u", ["a"], [])]


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, project_id string")
    assert tables.write_snapshot({"t": df}, str(tmp_path), "v1", "project_id") == {"t": 1}
    assert tables.migrate({"t": df.drop("project_id")}, "p", {"id": "source_id"})["t"].columns == ["source_id", "project_id"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    pick = lambda df: df.select("event_id", "event_type", "value")
    go = lambda: incremental.run_stream(spark, str(tmp_path / "in"), events.schema, pick, str(tmp_path / "out"), str(tmp_path / "ck"), ["event_id"], 1)
    go()
    batches = sorted(p.name for p in (tmp_path / "out").glob("batch=*"))
    assert len(batches) == 3 and incremental.read_stream(spark, str(tmp_path / "out"), ["event_id"]).count() == events.count()
    go()  # nothing new: nothing happens
    assert sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == batches
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    first = incremental.stream_to_memory(incremental.dedupe_open(stream.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days"), "dedupe_open", "append")
    assert first.count() == events.select("user_id", "event_type").distinct().count()


def test_stream_keeps_the_latest_record(spark, tmp_path):
    schema = "key int, at int, value string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, seen = str(tmp_path / "out"), []
    before = lambda s: s.read.parquet(out).count() if seen else 0

    def transform(batch, known):
        seen.append(known)
        return batch

    go = lambda: incremental.run_stream(spark, str(tmp_path / "in"), schema, transform, out, str(tmp_path / "ck"), ["key"], 10, ["at"], before)
    table = lambda at: sorted(map(tuple, incremental.read_stream(spark, at, ["key"], ["at"]).collect()))
    put((1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 5, "x"), (3, None, "n"))  # repeated keys in the first batch
    go()
    assert table(out) == [(1, 3, "c"), (2, 5, "x"), (3, None, "n")]
    first = (tmp_path / "out" / "batch=0").stat().st_mtime
    put((1, 2, "late"), (2, 6, "y"), (3, 1, "m"), (4, 1, "z"))  # an older record that arrives later
    go()
    want = [(1, 3, "c"), (2, 6, "y"), (3, 1, "m"), (4, 1, "z")]
    assert table(out) == want and (tmp_path / "out" / "batch=0").stat().st_mtime == first and seen == [0, 3]
    incremental.compact(spark, out, str(tmp_path / "folded"), ["key"], ["at"])
    assert table(str(tmp_path / "folded")) == want and [p.name for p in (tmp_path / "folded").glob("batch=*")] == ["batch=1"]
    old, new = spark.createDataFrame([(1, 3, "c"), (2, 1, "x")], schema), spark.createDataFrame([(1, 2, "late"), (2, 2, "y"), (2, 3, "z")], schema)
    assert sorted(map(tuple, tables.upsert(old, new, ["key"], ["at"]).collect())) == [(1, 3, "c"), (2, 3, "z")]


def test_pointer_queues_and_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, "r1"), (2, "r2")], "id int, run_id string")
    root = str(tmp_path / "snap")
    assert tables.write_snapshot({"t": df}, root, "v1") == {"t": 2} and tables.read_snapshot(spark, root, "t").count() == 2
    assert tables.write_snapshot({"t": df.limit(1)}, root, "v2") == {"t": 1} and tables.read_snapshot(spark, root, "t").count() == 1
    queues = {name: df for name in tables.QUEUES}
    tables.write_queues(queues, str(tmp_path / "q"))
    tables.write_queues({name: df.filter("id = 2").withColumn("id", F.lit(9)) for name in tables.QUEUES}, str(tmp_path / "q"))
    assert all(sorted(r.id for r in spark.read.parquet(str(tmp_path / "q" / name)).collect()) == [1, 9] for name in tables.QUEUES)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    assert tables.write_split(df, F.array(F.when(F.col("id") == 2, "even")), good, bad) == {good: 1, bad: 1}
    assert spark.read.parquet(bad).first().errors == ["even"] and spark.read.parquet(good).columns == df.columns
    new = tables.migrate({"t": df, "u": df}, "p", {"id": "source_id"})
    report = tables.migration_report({"t": df, "u": df}, {**new, "u": new["u"].limit(1)})
    assert sorted(map(tuple, report.collect())) == [("t", 2, 2, True), ("u", 2, 1, False)]
    assert tables.created_at(spark.createDataFrame([("2024-02-01",), ("2023-05-01",), (None,)], "indexed_at string")) == "2023-05-01"


def test_policy_files(spark):
    text = json.dumps({"version": 1, "note": "x", "policy_notes": ["a note"], "authors": [{"page_id_canonical": "ann", "name": " Ann ", "auto_promote": True}, {"name": ""}], "works": [{"name": "W2"}, {"other": 1}], "empty": []})
    got = tables.load_whitelist(spark.createDataFrame([(text,)], "value string"))
    assert sorted(map(tuple, got.collect()), key=str) == [("authors", "ann", "Ann", True, None, None), ("works", None, "W2", False, None, None)]
    text = json.dumps({"include_domains": ["a.*"], "exclude_patterns": [{"pattern": "a.b", "scope": "title", "reason": "r"}, {"scope": "no pattern"}, {"pattern": "c"}]})
    got = tables.load_topic_filters(spark.createDataFrame([(text,)], "value string"))
    assert sorted(map(tuple, got.collect()), key=str) == [("a.b", "r", "title"), ("c", None, None)]
    assert [r.glob for r in tables.load_globs(spark.createDataFrame([(text,)], "value string")).collect()] == ["a.*"]
    many = json.dumps({"include_domains": [f"d{i}.*" for i in range(10_050)]})
    assert tables.load_globs(spark.createDataFrame([(many,)], "value string")).distinct().count() == 10_050


def test_filters_reach_the_scan(spark, sf_dir):
    df = filters.equals(spark.read.parquet(f"{sf_dir}/orders.parquet"), {"o_orderstatus": "F"}).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_library_stands_without_llm():
    import pathlib

    import korpusmill

    root = pathlib.Path(korpusmill.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "korpusmill.llm" in p.read_text()]


def test_searches_by_joins_give_the_same(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(R.dense_topk(q, e, 4))
    assert want and rows(R.dense_topk(q, e, 4, block=16, broadcast_bytes=0)) == want and len({w[0] for w in want}) * 4 == len(want)
    assert R.dense_topk(q.limit(0), e, 4).collect() == [] and R.dense_topk(q, e.limit(0), 4).collect() == []
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null").withColumn("k", F.col("conv_id") * 100 + F.col("turn"))
    words = R.token_weights(turns, "k", "text")
    asked = words.filter("id % 5 = 0").withColumnRenamed("id", "query_id")
    want = rows(R.sparse_topk(asked, words, 3))
    assert want and rows(R.sparse_topk(asked, words, 3, broadcast_rows=0)) == want
    assert R.sparse_topk(asked.limit(0), words, 3).collect() == []


def test_page_grammar(spark, tmp_path):
    (tmp_path / "p.md").write_text(
        "---\npage_id: p\npage_type: 't''s'\ncanonical_name: \"A \\\"B\\\", C\"\naliases: [\"Smith, John\", 'O''Hara, S', plain, \"a [b]\", null]\nrelations:\n"
        "  - {type: cites, to: q, weight: strong, note: \"see to: x, or {y}\"}\n  - type: part_of\n    to: 'r'\n    note: a, b\n  - {type: lost, note: to}\n  - {to: s, type: t, note: 'it''s'}\n---\n"
        "[ T one ](https://youtu.be/ab_-1?t=12) [T two](https://youtu.be/ab_-1?t=12) [x](http://www.youtu.be/cd) [y](https://youtu.be/cd?t=0) [z](https://example.org/ab)\n[[ok-1]] [[ok_2|Any label]] [[See Also]] [[Upper]] [[a#b]] [[|x]]\n"
    )
    page = tables.scan_pages(spark, str(tmp_path))
    row = page.first()
    assert row.aliases == ["Smith, John", "O'Hara, S", "plain", "a [b]"] and row.canonical_name == 'A "B", C' and row.page_type == "t's"
    edges = graph.relation_edges(page)
    assert {(r.type, r.to_page_id, r.weight, r.note) for r in edges.collect()} == {("cites", "q", "strong", "see to: x, or {y}"), ("part_of", "r", None, "a, b"), ("t", "s", None, "it's")}
    assert {r.target_page_id for r in graph.wikilinks(page).collect()} == {"ok-1", "ok_2"}
    got = {(r.doc_id, r.ts): (r.title, r.n, r.url) for r in graph.citations(page).collect()}
    assert got == {("ab_-1", 12): ("T one", 2, "https://youtu.be/ab_-1?t=12"), ("cd", 0): ("x", 2, "https://youtu.be/cd")}
    assert {r.note for r in graph.backlinks(edges, graph.wikilinks(page)).filter("page_id = 'q'").collect()} == {"see to: x, or {y}"}

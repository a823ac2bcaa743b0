"""Graph queries. Suppliers, nations, regions and parts (but those of type ECONOMY) are pages; sales returned and places are typed edges; large sales are links."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions import text as T
from korpusmill.operators import filters
from korpusmill.operators import graph as G
from korpusmill.plans.registry import Tables, query
from korpusmill.sources import tables

KINDS = [("supplies", "supplied_by", ["supplier"], ["part"]), ("located_in", "location_of", ["supplier"], ["region"]), ("part_of", "has_part", ["any"], ["region"])]


class Graph:
    def __init__(self, t: Tables):
        self.t = t

    @cached_property
    def pages(self) -> DataFrame:
        page = lambda df, p, key, kind, name: df.select(F.concat(F.lit(p), F.col(key)).alias("page_id"), F.lit(kind).alias("page_type"), F.col(name).alias("canonical_name"))
        t = self.t
        out = page(t.supplier, "s", "s_suppkey", "supplier", "s_name").unionByName(page(t.nation, "n", "n_nationkey", "nation", "n_name"))
        return out.unionByName(page(t.region, "r", "r_regionkey", "region", "r_name")).unionByName(page(t.part.filter("p_type <> 'ECONOMY'"), "p", "p_partkey", "part", "p_name"))

    @cached_property
    def relations(self) -> DataFrame:
        edge = lambda df, a, x, kind, b, y, w: df.select(F.concat(F.lit(a), F.col(x)).alias("from_page_id"), F.lit(kind).alias("type"), F.concat(F.lit(b), F.col(y)).alias("to_page_id"), F.lit(w).alias("weight"))
        t = self.t
        out = edge(t.lineitem.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct(), "s", "l_suppkey", "supplies", "p", "l_partkey", "strong")
        out = out.unionByName(edge(t.supplier, "s", "s_suppkey", "located_in", "n", "s_nationkey", "canonical")).unionByName(edge(t.nation, "n", "n_nationkey", "part_of", "r", "n_regionkey", "canonical"))
        return out.unionByName(edge(t.customer.select("c_nationkey", "c_mktsegment").distinct(), "n", "c_nationkey", "buys", "m", "c_mktsegment", "tangential"))

    @cached_property
    def links(self) -> DataFrame:
        rows = self.t.lineitem.filter("l_quantity >= 45").select(F.concat(F.lit("s"), "l_suppkey").alias("page_id"), F.concat(F.lit("p"), "l_partkey").alias("target_page_id"))
        return rows.distinct()

    @cached_property
    def aliases(self) -> DataFrame:
        return self.t.part.filter("p_type <> 'ECONOMY'").select(F.concat(F.lit("p"), "p_partkey").alias("page_id"), F.col("p_brand").alias("alias"))

    @cached_property
    def citations(self) -> DataFrame:
        return self.t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("page_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ts")).distinct()

    @cached_property
    def types(self) -> DataFrame:
        return self.t.spark.createDataFrame(KINDS, "type string, inverse string, from_types array<string>, to_types array<string>")


CTE = """
WITH pages AS (SELECT 's' || s_suppkey AS page_id, 'supplier' AS page_type, s_name AS canonical_name FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'region', r_name FROM region UNION ALL SELECT 'p' || p_partkey, 'part', p_name FROM part WHERE p_type <> 'ECONOMY'),
relations AS (SELECT DISTINCT 's' || l_suppkey AS from_page_id, 'supplies' AS type, 'p' || l_partkey AS to_page_id, 'strong' AS weight FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 's' || s_suppkey, 'located_in', 'n' || s_nationkey, 'canonical' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, 'canonical' FROM nation
  UNION ALL SELECT DISTINCT 'n' || c_nationkey, 'buys', 'm' || c_mktsegment, 'tangential' FROM customer),
links AS (SELECT DISTINCT 's' || l_suppkey AS page_id, 'p' || l_partkey AS target_page_id FROM lineitem WHERE l_quantity >= 45),
aliases AS (SELECT 'p' || p_partkey AS page_id, p_brand AS alias FROM part WHERE p_type <> 'ECONOMY'),
citations AS (SELECT DISTINCT 's' || l_suppkey AS page_id, l_orderkey AS doc_id, l_linenumber AS ts FROM lineitem),
types AS (SELECT * FROM (VALUES ('supplies', 'supplied_by', ['supplier'], ['part']), ('located_in', 'location_of', ['supplier'], ['region']), ('part_of', 'has_part', ['any'], ['region'])) v(type, inverse, from_types, to_types))
"""


@query(CTE + "SELECT to_page_id AS page_id, from_page_id AS source, 'relation' AS kind, type FROM relations UNION ALL SELECT target_page_id, page_id, 'wikilink', NULL FROM links")
def a10_backlinks(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.backlinks(g.relations, g.links).select("page_id", "source", "kind", "type")


@query(CTE + "SELECT to_page_id, count(*) AS n_incoming, count(DISTINCT from_page_id) AS n_sources, min(from_page_id) AS first_source, max(from_page_id) AS last_source FROM relations WHERE to_page_id NOT IN (SELECT page_id FROM pages) GROUP BY 1")
def a11_broken_targets(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.broken_targets(g.relations, g.pages)


@query(CTE + "SELECT to_page_id, string_agg(DISTINCT from_page_id, ',' ORDER BY from_page_id) AS sources FROM relations GROUP BY 1")
def a11_sources(t: Tables) -> DataFrame:
    return G.sources_of(Graph(t).relations)


@query(CTE + "SELECT from_page_id, type, to_page_id FROM relations WHERE to_page_id NOT IN (SELECT page_id FROM pages)")
def j14_missing_targets(t: Tables) -> DataFrame:
    g = Graph(t)
    return g.relations.join(g.pages.select(F.col("page_id").alias("to_page_id")), "to_page_id", "left_anti").select("from_page_id", "type", "to_page_id")


@query(CTE + ", r AS (SELECT DISTINCT from_page_id, to_page_id FROM relations), k AS (SELECT page_id AS from_page_id, target_page_id AS to_page_id FROM links) SELECT *, 'wikilink' AS only_in FROM (SELECT * FROM k EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'relation' FROM (SELECT * FROM r EXCEPT SELECT * FROM k)")
def j15_drift(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.drift(g.relations, g.links)


@query(CTE + "SELECT page_id, doc_id, ts FROM citations")
def a12_citations(t: Tables) -> DataFrame:
    return Graph(t).citations.orderBy("doc_id", "ts", "page_id")


@query(CTE + "SELECT page_type, count(*) AS n FROM pages GROUP BY 1")
def a13_pages_by_type(t: Tables) -> DataFrame:
    return G.counts(Graph(t).pages, "page_type")


@query(CTE + "SELECT type, count(*) AS n FROM relations GROUP BY 1")
def a14_relations_by_type(t: Tables) -> DataFrame:
    return G.counts(Graph(t).relations, "type")


@query(CTE + "SELECT doc_id, count(DISTINCT page_id) AS n_pages, count(*) AS n FROM citations GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def a15_most_cited(t: Tables) -> DataFrame:
    return G.most_cited(Graph(t).citations)


@query(CTE + "SELECT to_page_id, count(*) AS n FROM relations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a16_most_referenced(t: Tables) -> DataFrame:
    return G.most_referenced(Graph(t).relations)


@query(CTE + "SELECT DISTINCT 'unknown_type' AS rule, type AS key FROM relations WHERE type NOT IN (SELECT type FROM types) UNION ALL SELECT 'duplicate_id', page_id FROM pages GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'no_edges', page_id FROM pages WHERE page_id NOT IN (SELECT from_page_id FROM relations)")
def a17_integrity(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.checks(g.pages, g.relations, g.types)


CONFLICTS = """, tc AS (SELECT from_page_id, r.type, to_page_id,
  a.page_type IS NOT NULL AND len(from_types) > 0 AND NOT list_contains(from_types, 'any') AND NOT list_contains(from_types, a.page_type) AS bad_from,
  b.page_type IS NOT NULL AND len(to_types) > 0 AND NOT list_contains(to_types, 'any') AND NOT list_contains(to_types, b.page_type) AS bad_to
  FROM relations r JOIN types t ON r.type = t.type LEFT JOIN pages a ON r.from_page_id = a.page_id LEFT JOIN pages b ON r.to_page_id = b.page_id),
inv AS (SELECT from_page_id, type, to_page_id FROM relations UNION SELECT to_page_id, inverse, from_page_id FROM relations r JOIN types t ON r.type = t.type),
rec AS (SELECT * FROM inv EXCEPT SELECT from_page_id, type, to_page_id FROM relations)
"""


@query(CTE + CONFLICTS + "SELECT * FROM tc WHERE bad_from OR bad_to")
def j13_edge_types(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.type_conflicts(g.relations, g.pages, g.types)


@query(
    CTE + CONFLICTS + """SELECT 'error' AS severity, 'malformed_id' AS rule, count(*) AS n FROM pages WHERE NOT regexp_matches(page_id, '^[a-z0-9][a-z0-9_-]*$')
UNION ALL SELECT 'error', 'incomplete_edge', count(*) FROM relations WHERE type IS NULL OR to_page_id IS NULL UNION ALL SELECT 'error', 'unknown_type', count(*) FROM relations WHERE type NOT IN (SELECT type FROM types)
UNION ALL SELECT 'error', 'duplicate_id', count(*) FROM (SELECT page_id FROM pages GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'warning', 'page_type', count(*) FROM tc WHERE bad_from OR bad_to
UNION ALL SELECT 'warning', 'missing_target', count(*) FROM relations WHERE from_page_id <> to_page_id AND to_page_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT 'warning', 'missing_reciprocal', count(*) FROM rec"""
)
def a18_validator(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.validate(g.pages, g.relations, g.types)


@query(CTE + CONFLICTS + "SELECT * FROM inv")
def r11_inverse_edges(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.inverse_edges(g.relations, g.types)


@query(CTE + CONFLICTS + "SELECT * FROM rec")
def r12_missing_reciprocals(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.missing_reciprocals(g.relations, g.types)


@query(
    CTE + """, e AS (SELECT DISTINCT from_page_id AS a, to_page_id AS b FROM relations WHERE weight IN ('canonical', 'strong')), s0 AS (SELECT page_id AS seed, page_id, 0 AS hops FROM pages WHERE page_type = 'supplier'),
s1 AS (SELECT DISTINCT seed, b AS page_id, 1 AS hops FROM s0 JOIN e ON a = page_id), s2 AS (SELECT DISTINCT seed, b AS page_id, 2 AS hops FROM s1 JOIN e ON a = page_id), s3 AS (SELECT DISTINCT seed, b AS page_id, 3 AS hops FROM s2 JOIN e ON a = page_id)
SELECT seed, page_id, min(hops) AS hops FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) GROUP BY 1, 2"""
)
def r10_walk(t: Tables) -> DataFrame:
    g = Graph(t)
    return G.walk(g.relations, g.pages.filter("page_type = 'supplier'"), 3)


@query(
    CTE + """SELECT p.page_id, page_type, canonical_name, coalesce((SELECT string_agg(DISTINCT alias, ',' ORDER BY alias) FROM aliases a WHERE a.page_id = p.page_id), '') AS aliases,
coalesce(targets, '') AS targets, coalesce(types, '') AS types FROM pages p LEFT JOIN (SELECT from_page_id, string_agg(DISTINCT to_page_id, ',' ORDER BY to_page_id) AS targets, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM relations GROUP BY 1) r
ON r.from_page_id = p.page_id WHERE p.page_id IN (SELECT target_page_id FROM links) OR p.page_id IN (SELECT page_id FROM links)"""
)
def j4_hydrate(t: Tables) -> DataFrame:
    g = Graph(t)
    ids = g.links.select("page_id").unionByName(g.links.select(F.col("target_page_id").alias("page_id")))
    return G.hydrate(ids, g.pages, g.aliases, g.relations)


@query(
    CTE + """, r AS (SELECT from_page_id, list(type || ':' || to_page_id ORDER BY type || ':' || to_page_id) AS x FROM relations GROUP BY 1), a AS (SELECT page_id, string_agg(alias, ', ' ORDER BY alias) AS al FROM aliases GROUP BY 1)
SELECT p.page_id, page_type, canonical_name, substr(coalesce(al, ''), 1, 120) AS aliases, coalesce(array_to_string(x[1:5], '; '), '') || CASE WHEN len(x) > 5 THEN ' (+' || (len(x) - 5) || ')' ELSE '' END AS relations
FROM pages p LEFT JOIN r ON r.from_page_id = p.page_id LEFT JOIN a ON a.page_id = p.page_id"""
)
def p22_catalogue(t: Tables) -> DataFrame:
    g = Graph(t)
    return filters.catalogue(g.pages, g.relations, g.aliases, [F.concat_ws(":", "type", "to_page_id")])


@query("SELECT l1, l2, l3, count(*) AS n FROM (SELECT r_name AS l1, n_name AS l2, c_mktsegment AS l3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (l1, l2, l3)")
def a31_domain_facets(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return G.domain_facets(rows.select(F.concat_ws(".", "r_name", "n_name", "c_mktsegment").alias("domain")))


@query(CTE + "SELECT 's' || l_suppkey AS page_id, l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS ts, arg_min(l_returnflag, l_partkey) AS title, count(*) AS n FROM lineitem GROUP BY ALL")
def a9_first_citation(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("page_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ts"), F.col("l_returnflag").alias("title"), F.col("l_partkey").alias("pos"))
    return G.first_citations(rows)


@query("""SELECT page_id, target FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"#]+)"', 1)) AS target FROM pages)""")
def f11_wikilinks(t: Tables) -> DataFrame:
    return G.wikilinks(t.pages, "html", r'href="/([^"#]+)"').withColumnRenamed("target_page_id", "target")


@query("""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"#]+)"', 1)) AS target FROM pages), k AS (SELECT DISTINCT trim(lower(regexp_extract(url, '^https?://([^/]+)', 1))) AS host FROM pages)
SELECT target, count(*) AS n_in, count(DISTINCT page_id) AS n_pages FROM l WHERE lower(target) NOT IN (SELECT host FROM k) GROUP BY 1""")
def a21_broken_link_degree(t: Tables) -> DataFrame:
    links = G.wikilinks(t.pages, "html", r'href="/([^"#]+)"').select("page_id", F.lower("target_page_id").alias("key"), F.col("target_page_id").alias("target"))
    hosts = t.pages.select(F.trim(F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1))).alias("key")).distinct()
    return links.join(hosts, "key", "left_anti").groupBy("target").agg(F.count("*").alias("n_in"), F.count_distinct("page_id").alias("n_pages"))


@query("SELECT p_name, p_partkey, p_brand, (SELECT string_agg(DISTINCT q.p_brand, ',' ORDER BY q.p_brand) FROM part q WHERE q.p_name = p.p_name) AS projects FROM part p QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey, p_brand) = 1")
def w9_oldest_page(t: Tables) -> DataFrame:
    return G.oldest(t.part.select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey", "p_brand")


@query(CTE + "SELECT page_id, regexp_matches(page_id, '^[a-z0-9][a-z0-9_-]*$') AS page_ok, regexp_matches(trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '-'), '^[a-z][a-z0-9-]{1,40}[a-z0-9]$') AS slug_ok FROM pages")
def p21_valid_ids(t: Tables) -> DataFrame:
    p = Graph(t).pages
    return p.select("page_id", filters.valid_page_id(F.col("page_id")).alias("page_ok"), filters.valid_slug(T.slug(F.col("canonical_name"))).alias("slug_ok"))


@query(CTE + "SELECT * FROM (SELECT type, inverse FROM types UNION ALL SELECT DISTINCT type, NULL FROM relations WHERE type NOT IN (SELECT type FROM types))")
def u6_merged_dictionary(t: Tables) -> DataFrame:
    g = Graph(t)
    more = g.relations.select("type").distinct().withColumn("inverse", F.lit(None).cast("string"))
    return G.merge_types(g.types.select("type", "inverse"), more)[0]


def _written(t: Tables) -> DataFrame:
    """Each conversation as a page of Markdown with frontmatter: whole turns as notes of its relations, links and citations in its body."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r'(["\\\\])', r"\\$1"), r"\s", " "), F.lit('"'))
    turn = F.col("turn").cast("string")
    relation = F.concat(F.lit("  - {type: said_by, to: "), "role", F.lit(", weight: strong, note: "), quoted(F.coalesce("text", F.lit(""))), F.lit("}\n"))
    line = F.concat(
        F.lit("\u2192 [ "), "role", F.lit(" "), turn, F.lit(" ](https://youtu.be/d"), F.col("conv_id") % 7, F.lit("?t="), turn * 10, F.lit(") [intro "), turn, F.lit("](http://www.youtu.be/e"), F.col("turn") % 3,
        F.lit(") and [["), "role", F.lit("-"), turn, F.lit("|Turn]] [["), "role", F.lit("]] [[See Also]] [[Upper|x]] [x](https://example.org/1)\n"),
    )
    lines = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", relation.alias("relation"), line.alias("line")))).alias("x"))
    joined = lambda part: F.array_join(F.transform("x", lambda r: r[part]), "")
    aliases = F.concat(F.lit('aliases: ["Talk, no. '), "conv_id", F.lit("\", 'it''s', plain ]\n"))
    front = F.concat(F.lit("---\npage_id: c"), "conv_id", F.lit("\npage_type: talk\ncanonical_name: Talk\n"), aliases, F.lit("relations:\n"), joined("relation"), F.lit("---\n"))
    return tables.parse_pages(lines.select(F.concat(front, joined("line")).alias("v"), F.concat(F.lit("c"), "conv_id").alias("file_path")))


@query("""WITH m AS (SELECT 'c' || conv_id AS page_id, 'd' || (conv_id % 7) AS doc_id, CAST(turn * 10 AS INT) AS ts, role || ' ' || turn AS title, 2 * turn AS pos FROM conversations
UNION ALL SELECT 'c' || conv_id, 'e' || (turn % 3), 0, 'intro ' || turn, 2 * turn + 1 FROM conversations)
SELECT page_id, doc_id, ts, arg_min(title, pos) AS title, count(*) AS n, 'https://youtu.be/' || doc_id || CASE WHEN ts > 0 THEN '?t=' || ts ELSE '' END AS url FROM m GROUP BY page_id, doc_id, ts""")
def a9_page_citations(t: Tables) -> DataFrame:
    """The citation table out of page texts."""
    return G.citations(_written(t))


@query("SELECT DISTINCT 'c' || conv_id AS page_id, unnest([role, role || '-' || turn]) AS target_page_id FROM conversations")
def f11_page_links(t: Tables) -> DataFrame:
    return G.wikilinks(_written(t))


@query(r"""SELECT role AS page_id, 'c' || conv_id AS source, 'relation' AS kind, 'said_by' AS type, 'strong' AS weight, nullif(trim(regexp_replace(coalesce(text, ''), '\s', ' ', 'g')), '') AS note FROM conversations
UNION ALL SELECT DISTINCT unnest([role, role || '-' || turn]), 'c' || conv_id, 'wikilink', NULL, NULL, NULL FROM conversations""")
def a10_page_backlinks(t: Tables) -> DataFrame:
    """Backlinks out of page texts; each relation has a whole turn as its note."""
    pages = _written(t)
    return G.backlinks(G.relation_edges(pages), G.wikilinks(pages)).withColumn("note", F.nullif(F.trim("note"), F.lit("")))


@query("SELECT DISTINCT 'c' || conv_id AS page_id, unnest(['Talk, no. ' || conv_id, 'it''s', 'plain']) AS alias FROM conversations")
def s4_page_aliases(t: Tables) -> DataFrame:
    return _written(t).select("page_id", F.explode("aliases").alias("alias"))

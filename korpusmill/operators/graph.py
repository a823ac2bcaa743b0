"""The document graph: edges, link audits, typed-edge checks and bounded walks.

relations: from_page_id, type, to_page_id, weight. links: page_id, target_page_id. pages: page_id, page_type, canonical_name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.functions import text as T
from korpusmill.functions.checkpoints import cut
from korpusmill.functions.sizes import small

#: How far each weight of an edge comes forward; weaker edges last.
WEIGHTS = ("canonical", "strong", "tangential")


#: Fixed values, the grammar of page texts: a link to a page by its id, with a label or without; a link into a document, with a second or without.
WIKILINK = r"\[\[([a-z0-9][a-z0-9_-]*)(?:\|[^\]]+)?\]\]"
CITATION = r"\[([^\]]+)\]\(https?://(?:www\.)?youtu\.be/([a-zA-Z0-9_-]+)(?:\?t=(\d+))?\)"
DOCUMENT_URL = "https://youtu.be/"


def wikilinks(pages: DataFrame, text: str = "body", pattern: str = WIKILINK) -> DataFrame:
    """Distinct (page_id, target_page_id) of the links in a text. Only page ids are targets: ``[[See Also]]`` is prose."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
    return pages.select("page_id", found.alias("target_page_id")).distinct()


def mentions(pages: DataFrame, text: str = "body", pattern: str = CITATION) -> DataFrame:
    """(page_id, doc_id, ts, title, pos) of each citation in a text, in order; one without a second is of second 0."""
    part = lambda k: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(k))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(part(1).alias("title"), part(2).alias("doc_id"), part(3).alias("at"))).alias("pos", "m"))
    ts = F.coalesce(F.col("m.at").try_cast("int"), F.lit(0))
    return rows.select("page_id", F.col("m.doc_id").alias("doc_id"), ts.alias("ts"), F.trim("m.title").alias("title"), "pos")


def citations(pages: DataFrame, text: str = "body", pattern: str = CITATION) -> DataFrame:
    """The citation table of page texts: one row for each (page, document, second) with its first title, its link and how often it is cited."""
    url = F.concat(F.lit(DOCUMENT_URL), F.col("doc_id"), F.when(F.col("ts") > 0, F.concat(F.lit("?t="), F.col("ts"))).otherwise(""))
    return first_citations(mentions(pages, text, pattern)).withColumn("url", url)


def relation_edges(pages: DataFrame) -> DataFrame:
    """The relation table of scanned pages: (from_page_id, type, to_page_id, weight, note)."""
    return pages.select(F.col("page_id").alias("from_page_id"), F.explode("relations").alias("r")).select("from_page_id", "r.type", F.col("r.to").alias("to_page_id"), "r.weight", "r.note")


def first_citations(mentions: DataFrame) -> DataFrame:
    """Per (page_id, doc_id, ts) the title that comes first by ``pos``, and how often it is cited."""
    return mentions.groupBy("page_id", "doc_id", "ts").agg(F.min_by("title", "pos").alias("title"), F.count("*").alias("n"))


def backlinks(relations: DataFrame, links: DataFrame) -> DataFrame:
    """(page, source, kind, type) of all edges that lead to a page; with their weight and note if the relations have them."""
    more = [c for c in ("weight", "note") if c in relations.columns]
    a = relations.select(F.col("to_page_id").alias("page_id"), F.col("from_page_id").alias("source"), F.lit("relation").alias("kind"), "type", *more)
    b = links.select(F.col("target_page_id").alias("page_id"), F.col("page_id").alias("source"), F.lit("wikilink").alias("kind"), F.lit(None).cast("string").alias("type"), *(F.lit(None).cast("string").alias(c) for c in more))
    return a.unionByName(b)


def broken_targets(relations: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets that are no pages: how many edges lead there, from how many pages, and the first and last of those."""
    gone = relations.join(pages.select(F.col("page_id").alias("to_page_id")), "to_page_id", "left_anti")
    return gone.groupBy("to_page_id").agg(F.count("*").alias("n_incoming"), F.count_distinct("from_page_id").alias("n_sources"), F.min("from_page_id").alias("first_source"), F.max("from_page_id").alias("last_source"))


def sources_of(relations: DataFrame) -> DataFrame:
    """Distinct sources of each target, sorted and joined by commas."""
    return relations.groupBy("to_page_id").agg(F.array_join(F.array_sort(F.collect_set("from_page_id")), ",").alias("sources"))


def drift(relations: DataFrame, links: DataFrame) -> DataFrame:
    """Edges that stand in one kind only."""
    r = relations.select("from_page_id", "to_page_id", F.lit("relation").alias("kind"))
    k = links.select(F.col("page_id").alias("from_page_id"), F.col("target_page_id").alias("to_page_id"), F.lit("wikilink").alias("kind"))
    both = r.unionByName(k).groupBy("from_page_id", "to_page_id").agg(F.min("kind").alias("only_in"), F.max("kind").alias("_last"))
    return both.filter("only_in = _last").drop("_last")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def most_cited(citations: DataFrame, k: int = 10) -> DataFrame:
    out = citations.groupBy("doc_id").agg(F.count_distinct("page_id").alias("n_pages"), F.count("*").alias("n"))
    return out.orderBy(F.desc("n_pages"), F.desc("n"), "doc_id").limit(k)


def most_referenced(relations: DataFrame, k: int = 10) -> DataFrame:
    return relations.groupBy("to_page_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_page_id").limit(k)


def checks(pages: DataFrame, relations: DataFrame, types: DataFrame) -> DataFrame:
    """Violations (rule, key): types not in the dictionary, page ids used twice, pages without edges."""
    unknown = relations.select("type").distinct().join(types.select("type"), "type", "left_anti").select(F.lit("unknown_type").alias("rule"), F.col("type").alias("key"))
    twice = pages.groupBy("page_id").count().filter("count > 1").select(F.lit("duplicate_id").alias("rule"), F.col("page_id").alias("key"))
    alone = pages.select("page_id").distinct().join(relations.select(F.col("from_page_id").alias("page_id")), "page_id", "left_anti").select(F.lit("no_edges").alias("rule"), F.col("page_id").alias("key"))
    return unknown.unionByName(twice).unionByName(alone)


def _typed(relations: DataFrame, pages: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with what the dictionary (type, from_types, to_types, inverse) and the pages say of them, in one pass.

    ``known``: the type is in the dictionary; ``target``: the target is a page; ``bad_from``, ``bad_to``: an end is of a page
    type that the dictionary does not allow ("any" and an empty list allow all).
    """
    kind = pages.groupBy("page_id").agg(F.min("page_type").alias("page_type"))
    src, dst = kind.toDF("from_page_id", "from_type"), kind.toDF("to_page_id", "to_type").withColumn("target", F.lit(True))
    e = relations.join(small(types.select("type", "from_types", "to_types", F.lit(True).alias("known"))), "type", "left").join(src, "from_page_id", "left").join(dst, "to_page_id", "left")
    bad = lambda side, allowed: F.coalesce(F.col(side).isNotNull() & (F.size(allowed) > 0) & ~F.array_contains(allowed, "any") & ~F.array_contains(F.col(allowed), F.col(side)), F.lit(False))
    return e.select("from_page_id", "type", "to_page_id", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("target", F.lit(False)).alias("target"), bad("from_type", "from_types").alias("bad_from"), bad("to_type", "to_types").alias("bad_to"))


def type_conflicts(relations: DataFrame, pages: DataFrame, types: DataFrame) -> DataFrame:
    """Edges whose ends are of page types that the dictionary does not allow."""
    return _typed(relations, pages, types).filter("bad_from or bad_to").select("from_page_id", "type", "to_page_id", "bad_from", "bad_to")


def validate(pages: DataFrame, relations: DataFrame, types: DataFrame) -> DataFrame:
    """Findings (severity, rule, n): ids and types that are missing or malformed, targets that are not pages, disallowed ends, missing reciprocals."""
    col = lambda severity, rule, n: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), n.alias("n"))
    rows = lambda df, *cols: df.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    of_pages = rows(
        pages.groupBy("page_id").agg(F.count("*").alias("k")),
        col("error", "malformed_id", F.coalesce(F.sum(F.when(~F.rlike("page_id", F.lit("^[a-z0-9][a-z0-9_-]*$")), F.col("k")).otherwise(0)), F.lit(0))), col("error", "duplicate_id", F.count_if(F.col("k") > 1)),
    )
    of_edges = rows(
        _typed(relations, pages, types), col("error", "incomplete_edge", F.count_if(F.col("type").isNull() | F.col("to_page_id").isNull())), col("error", "unknown_type", F.count_if(~F.col("known"))),
        col("warning", "page_type", F.count_if(F.col("bad_from") | F.col("bad_to"))), col("warning", "missing_target", F.count_if(~F.col("target") & (F.col("from_page_id") != F.col("to_page_id")))),
    )
    return of_pages.unionByName(of_edges).unionByName(rows(missing_reciprocals(relations, types), col("warning", "missing_reciprocal", F.count("*"))))


def inverse_edges(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Edges and their inverses by the dictionary, distinct."""
    inv = relations.join(small(types.filter("inverse is not null").select("type", "inverse")), "type")
    turned = inv.select(F.col("to_page_id").alias("from_page_id"), F.col("inverse").alias("type"), F.col("from_page_id").alias("to_page_id"))
    return relations.select("from_page_id", "type", "to_page_id").unionByName(turned).distinct()


def missing_reciprocals(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Inverse edges that no page states."""
    have = relations.select("from_page_id", "type", "to_page_id")
    return inverse_edges(relations, types).join(have, ["from_page_id", "type", "to_page_id"], "left_anti")


def walk(relations: DataFrame, seeds: DataFrame, hops: int = 3, weights: tuple[str, ...] = WEIGHTS[:2], hub: int = 100_000) -> DataFrame:
    """Pages within ``hops`` typed edges of the seeds, each with the least number of hops; edges of ``weights`` only.

    One join a hop, on the frontier alone; a hop is checkpointed, so the next one neither runs it again nor carries its plan, and
    the walk ends where nothing new is reached. The edges of a page with more than ``hub`` of them are dealt over as many parts
    as it takes, and a frontier row meets each part, so no task reads all of a hub. Null seeds lead nowhere but are kept.
    """
    edges = relations.filter(F.col("weight").isin(*weights)).select(F.col("from_page_id").alias("page_id"), "to_page_id").distinct()
    edges = cut(edges.filter("page_id is not null"))
    hubs = small(cut(edges.groupBy("page_id").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts")).filter("parts > 1")))
    parts = F.coalesce("parts", F.lit(1))
    edges = edges.join(hubs, "page_id", "left").select("page_id", F.pmod(F.xxhash64("to_page_id"), parts).cast("int").alias("part"), "to_page_id")
    seen = frontier = cut(seeds.select(F.col("page_id").alias("seed"), "page_id").distinct().withColumn("hops", F.lit(0)))
    for h in range(1, hops + 1):
        spread = frontier.join(hubs, "page_id", "left").select("seed", "page_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        step = spread.join(edges, ["page_id", "part"]).select("seed", F.col("to_page_id").alias("page_id")).distinct()
        frontier = cut(step.join(seen.select("seed", "page_id"), ["seed", "page_id"], "left_anti").withColumn("hops", F.lit(h)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def hydrate(ids: DataFrame, pages: DataFrame, aliases: DataFrame, relations: DataFrame) -> DataFrame:
    """Pages of the given ids with their aliases and relation targets as sorted lists; ids that are no pages go."""
    some = pages.join(ids.select("page_id").distinct(), "page_id", "left_semi")
    a = aliases.join(ids.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    r = relations.withColumnRenamed("from_page_id", "page_id").join(ids.select("page_id").distinct(), "page_id", "left_semi")
    r = r.groupBy("page_id").agg(F.array_sort(F.collect_set("to_page_id")).alias("targets"), F.array_sort(F.collect_set("type")).alias("types"))
    none = F.array().cast("array<string>")
    return some.join(a, "page_id", "left").join(r, "page_id", "left").select("page_id", "page_type", "canonical_name", *[F.array_join(F.coalesce(c, none), ",").alias(c) for c in ("aliases", "targets", "types")])


def page_get(ids: DataFrame, pages: DataFrame, body: str = "body", trim: bool = True) -> DataFrame:
    """Each id asked for with its page, without the citations section on demand, how much that saved, and an error where there is none."""
    text = T.trim_section(F.col(body)) if trim else F.col(body)
    out = ids.select("page_id").distinct().join(pages.select("page_id", F.col(body).alias(body)), "page_id", "left")
    return out.select("page_id", text.alias(body), (F.length(body) - F.length(text)).alias("n_trimmed"), F.when(F.col(body).isNull(), "not found").alias("error"))


def domain_facets(pages: DataFrame, column: str = "domain") -> DataFrame:
    """Pages per level of a dotted domain, with subtotals (null below the level counted)."""
    parts = F.split(F.col(column), r"\.")
    levels = pages.select(*[F.get(parts, F.lit(i)).alias(f"l{i + 1}") for i in range(3)])
    return levels.rollup("l1", "l2", "l3").agg(F.count("*").alias("n"))


def oldest(pages: DataFrame, key: str, age: str, project: str) -> DataFrame:
    """The oldest page of each id, and all projects that have it."""
    w = W.partitionBy(key).orderBy(age, project)
    return pages.withColumn("_n", F.row_number().over(w)).withColumn("projects", F.array_join(F.array_sort(F.collect_set(project).over(W.partitionBy(key))), ",")).filter("_n = 1").drop("_n")


def merge_types(core: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dictionary with its extension, and the types that both define."""
    clash = core.select("type").join(more.select("type"), "type", "left_semi")
    return core.unionByName(more.join(core.select("type"), "type", "left_anti")), clash

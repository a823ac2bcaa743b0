"""Reading corpora, pages, logs and dictionaries from files, and writing snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

META = "video_id string, title string, category string, channel string, upload_date string, duration int, url string"
ENTITY = "surface_form string, canonical_guess string, page_type string, minutes_estimate double, decision string, quote_evidence string, reason_code string, review_priority string"
RECORD = f"video_id string, video_title string, category string, entities array<struct<{ENTITY.replace(' string', ':string').replace(' double', ':double')}>>, promote_new array<struct<{ENTITY.replace(' string', ':string').replace(' double', ':double')}>>, discarded array<struct<{ENTITY.replace(' string', ':string').replace(' double', ':double')}>>, _corrupt string"
#: Files of a run that hold aggregates, not records. Fixed values, as are the field names above: both must match the files.
AGGREGATES = ("discard_log", "pending_updates", "promote_queue", "thesis_candidates", "blocks_filtered", "recommended_references", "aggregation_stats")


def _parts(path: Column, n: int) -> Column:
    return F.element_at(F.split(path, "/"), F.lit(-n))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Documents of ``root/<collection>/<slug>/{summary.md,meta.json}``; folders that lack one of the two are left out. Missing metadata gets defaults."""
    text = spark.read.text(f"{root}/*/*/summary.md", wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("p"))
    meta = spark.read.schema(META).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/*/meta.json").withColumn("p", F.col("_metadata.file_path"))
    folder = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    both = text.withColumn("f", folder(F.col("p"))).drop("p").join(meta.withColumn("f", folder(F.col("p"))).drop("p"), "f")
    return both.select(
        F.coalesce("video_id", _parts(F.col("f"), 1)).alias("doc_id"), F.coalesce("title", _parts(F.col("f"), 1)).alias("title"), _parts(F.col("f"), 2).alias("collection"), _parts(F.col("f"), 1).alias("slug"),
        F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("channel", F.lit("unknown")).alias("channel"), F.coalesce("duration", F.lit(0)).alias("duration_s"), "upload_date", F.coalesce("url", F.lit("")).alias("url"),
        "text", F.floor(F.length("text") / 4).cast("int").alias("est_tokens"),
    )


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)


#: A quoted value of YAML, in either kind of quotes.
QUOTED = r"""\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^']*+(?:''[^']*+)*+'"""


def unquoted(value: Column) -> Column:
    """A YAML value without its quotes and their escapes; blank, "null" and "~" without quotes are null."""
    v = F.trim(value)
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    double = F.regexp_replace(inner, r'\\(["\\/])', "$1")
    bare = F.when(~F.lower(v).isin("", "null", "~"), v)
    return F.when(F.rlike(v, F.lit(r'(?s)^".*"$')) & (F.length(v) > 1), double).when(F.rlike(v, F.lit(r"(?s)^'.*'$")) & (F.length(v) > 1), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(bare)


def yaml_scalar(front: Column, key: str) -> Column:
    """A scalar of the frontmatter without quotes; blank and "null" are null."""
    value = unquoted(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.when(~F.lower(value).isin("", "null", "~"), value)


def yaml_list(front: Column, key: str) -> Column:
    """A list of the frontmatter, written ``[a, b]`` or as dashes; commas inside quotes part nothing."""
    flow = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\n((?:[ \t]+-.*\n?)+)", 1)
    items = F.when(flow != "", F.regexp_extract_all(flow, F.lit(rf"\s*({QUOTED}|[^,]+)"), F.lit(1))).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+-[ \t]*(.+)$"), F.lit(1)))
    return F.filter(F.transform(items, unquoted), lambda x: x.isNotNull() & (x != ""))


def scan_pages(spark: SparkSession, root: str) -> DataFrame:
    """Markdown pages below ``root`` but README files; pages without id, type or name are left out."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return parse_pages(raw.select(F.col("value").alias("v"), F.col("_metadata.file_path").alias("file_path")).filter(~F.rlike("file_path", F.lit("(?i)/readme\\.md$"))))


def parse_pages(raw: DataFrame) -> DataFrame:
    """The pages of whole Markdown texts (``v``, ``file_path``) with frontmatter."""
    f = frontmatter(F.col("v"))
    return raw.select(
        yaml_scalar(f, "page_id").alias("page_id"), yaml_scalar(f, "page_type").alias("page_type"), yaml_scalar(f, "canonical_name").alias("canonical_name"), yaml_scalar(f, "domain_primary").alias("domain_primary"),
        yaml_list(f, "domain").alias("domain"), yaml_list(f, "aliases").alias("aliases"), yaml_scalar(f, "sources_count").try_cast("int").alias("sources_count"), yaml_scalar(f, "last_compiled").alias("last_compiled"),
        "file_path", F.regexp_replace("v", r"(?s)\A---\n.*?\n---\n", "").alias("body"), relations(f).alias("relations"),
    ).filter("page_id is not null and page_type is not null and canonical_name is not null")


def relations(front: Column) -> Column:
    """Relations of the frontmatter that have both a type and a target, with weight and note; written as ``{type: a, to: b}`` or a line a field.

    Fields are read one after another, so that what stands inside a quoted value is taken neither for a field nor for an end.
    """
    block = F.regexp_extract(front, r"(?m)^relations:[ \t]*\n((?:[ \t]+.*\n?)+)", 1)
    items = F.filter(F.split(block, r"(?m)^[ \t]*- "), lambda x: F.trim(x) != "")
    parts = lambda x, rest, k: F.regexp_extract_all(x, F.lit(rf"(\w+)[ \t]*:[ \t]*({QUOTED}|{rest})"), F.lit(k))
    fields = lambda x, k: F.when(F.startswith(F.ltrim(x), F.lit("{")), parts(x, r"[^,}\n]*", k)).otherwise(parts(x, r"[^\n]*", k))
    field = lambda x, name: unquoted(F.get(F.filter(F.arrays_zip(fields(x, 1).alias("k"), fields(x, 2).alias("v")), lambda f: f["k"] == name), F.lit(0))["v"])
    made = lambda x: F.struct(*(F.nullif(field(x, name), F.lit("")).alias(name) for name in ("type", "to", "weight", "note")))
    return F.filter(F.transform(items, made), lambda r: r["type"].isNotNull() & r["to"].isNotNull())


def scan_extractions(spark: SparkSession, root: str) -> DataFrame:
    """Extraction records ``root/<run>/<id>.json`` with ``run_id``, file name and time; aggregates and failed records are left out by name, broken files keep only ``_corrupt``."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(f"{root}/*")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    raw = raw.withColumn("file", name).withColumn("run_id", _parts(F.col("_metadata.file_path"), 2)).withColumn("mtime", F.col("_metadata.file_modification_time"))
    return raw.filter(~F.col("file").isin(*AGGREGATES) & ~F.endswith("file", F.lit(".failed")))


def flatten_dictionary(json_text: DataFrame, column: str = "value") -> DataFrame:
    """Rows (type, description, inverse, from_types, to_types) of a JSON object of edge types."""
    kind = "map<string, struct<description: string, inverse: string, `from`: array<string>, `to`: array<string>>>"
    rows = json_text.select(F.explode(F.from_json(F.get_json_object(F.col(column), "$.types"), kind)).alias("type", "d"))
    return rows.select("type", "d.description", "d.inverse", F.col("d.from").alias("from_types"), F.col("d.to").alias("to_types"))


def read_json_lines(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(paths)


def latest(df: DataFrame, keys: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """The last row of each key by ``order`` (nulls first), then by all columns."""
    rest = [c for c in sorted(set(df.columns) - set(keys)) if c not in order]
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, *rest]] or keys)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of ``old`` and ``new``, one for each key. A second run changes nothing.

    With ``order`` (a time, a version) the last row of a key wins wherever it comes from, so a record that arrives late does not
    replace a newer one. Without it ``new`` wins, and of its rows with equal keys the greatest by all columns.
    """
    if order:
        return latest(old.unionByName(new), keys, order)
    last = latest(new, keys)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """Delete by a condition, then insert. Rows for which the condition is null stay."""
    return old.filter(~F.coalesce(condition, F.lit(False))).unionByName(new)


def write_snapshot(tables: dict[str, DataFrame], root: str, version: str, partition: str | None = None) -> dict[str, int]:
    """Each table below ``root/version``, then the pointer of ``root`` to it; returns rows per table, counted while writing.

    Readers (:func:`read_snapshot`) go by the pointer, a file that is renamed into place once all tables are written; so they
    see all of the old version or all of the new one.
    """
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(f"{root}/{version}/{name}")
        counts[name] = seen.get["n"]
    _point(next(iter(tables.values())).sparkSession, root, version)
    return counts


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Write ``root/CURRENT`` beside its place and rename it over the old one, through the file system that Spark uses."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, place = (jvm.org.apache.hadoop.fs.Path(f"{root}/{name}") for name in ("CURRENT.new", "CURRENT"))
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(new, place, options)


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that ``root`` points to."""
    version = spark.read.text(f"{root}/CURRENT").first().value
    return spark.read.parquet(f"{root}/{version}/{name}")


#: The review queues of a run; the names are fixed by the file format.
QUEUES = AGGREGATES


def write_queues(queues: dict[str, DataFrame], root: str, run: str = "run_id") -> None:
    """The seven review queues below ``root``, each partitioned by run; runs that are written again are replaced, others stay."""
    missing = set(QUEUES) - set(queues)
    if missing:
        raise ValueError(f"queues without a table: {sorted(missing)}")
    for name in QUEUES:
        queues[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(f"{root}/{name}")


def write_split(df: DataFrame, errors: Column, good: str, bad: str) -> dict[str, int]:
    """Records without errors to ``good``, the others with their ``errors`` to ``bad``; returns rows of each. errors: an array with nulls for checks that passed."""
    marked = df.withColumn("errors", F.filter(errors, lambda e: e.isNotNull()))
    counts = {}
    for path, rows in ((good, marked.filter(F.size("errors") == 0).drop("errors")), (bad, marked.filter(F.size("errors") > 0))):
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        counts[path] = seen.get["n"]
    return counts


#: Fields of an entry of the whitelist and of a topic rule; both must match the files.
WHITELIST_ENTRY = "page_id_canonical string, name string, auto_promote boolean, domain_primary string, reason string"
TOPIC_RULE = "pattern string, reason string, scope string"


def load_whitelist(json_text: DataFrame, column: str = "value") -> DataFrame:
    """Rows (kind, page_id, name, auto_promote, domain_primary, reason) of a JSON object that has a list of entries for each kind. Keys that hold anything else, and entries without a name, are left out."""
    lists = json_text.select(F.explode(F.from_json(F.col(column), "map<string, string>")).alias("kind", "v")).filter(F.startswith(F.trim("v"), F.lit("[")))
    items = lists.select("kind", F.explode(F.from_json("v", "array<string>")).alias("x")).filter(F.startswith("x", F.lit("{")))
    entries = items.select("kind", F.from_json("x", WHITELIST_ENTRY).alias("e")).filter("trim(e.name) <> ''")
    return entries.select("kind", F.col("e.page_id_canonical").alias("page_id"), F.trim("e.name").alias("name"), F.coalesce("e.auto_promote", F.lit(False)).alias("auto_promote"), "e.domain_primary", "e.reason")


def load_topic_filters(json_text: DataFrame, column: str = "value", field: str = "exclude_patterns") -> DataFrame:
    """Rows (pattern, reason, scope) of a JSON object with a list of rules; rules without a pattern are left out."""
    rules = json_text.select(F.explode(F.from_json(F.get_json_object(F.col(column), f"$.{field}"), f"array<struct<{TOPIC_RULE.replace(' string', ': string')}>>")).alias("r"))
    return rules.select("r.*").filter("pattern is not null and pattern <> ''")


def load_globs(json_text: DataFrame, column: str = "value", field: str = "include_domains") -> DataFrame:
    """The domain globs of the same file, all of them, as a table (``glob``) for :func:`korpusmill.operators.filters.domain_gate`."""
    return json_text.select(F.explode(F.from_json(F.get_json_object(F.col(column), f"$.{field}"), "array<string>")).alias("glob"))


def backfill(df: DataFrame, column: str, value: str) -> DataFrame:
    """``column`` set where it is missing or null; a second run changes nothing."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value))


def migration_report(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """``name``, rows before and after, and whether they are equal, for each table; one job."""
    one = [t.select(F.lit(name).alias("name"), F.lit(side).alias("side")) for side, tables in (("before", old), ("after", new)) for name, t in tables.items()]
    rows = one[0]
    for t in one[1:]:
        rows = rows.unionByName(t)
    names = rows.sparkSession.createDataFrame([(n,) for n in old], "name string")
    counts = rows.groupBy("name").agg(F.count_if(F.col("side") == "before").alias("n_before"), F.count_if(F.col("side") == "after").alias("n_after"))
    out = names.join(counts, "name", "left").fillna(0, ["n_before", "n_after"])
    return out.withColumn("equal", F.col("n_before") == F.col("n_after"))


def created_at(pages: DataFrame, indexed: str = "indexed_at") -> str | None:
    """When a project began: the earliest time at which one of its pages was indexed."""
    return pages.agg(F.min(indexed).alias("t")).first().t


def migrate(tables: dict[str, DataFrame], project: str, renamed: dict[str, str]) -> dict[str, DataFrame]:
    """Tables with a project key and columns renamed."""
    return {name: backfill(df, "project_id", project).withColumnsRenamed({a: b for a, b in renamed.items() if a in df.columns}) for name, df in tables.items()}


def breakdown(chunks: DataFrame, category: str, tagged: str) -> DataFrame:
    return chunks.groupBy(category).agg(F.count("*").alias("n"), F.count(tagged).alias("n_tagged"))


def flatten_pages(json_pages: DataFrame, column: str, schema: str) -> DataFrame:
    """Results of downloaded listing pages in one table."""
    return json_pages.select(F.explode(F.from_json(F.col(column), schema)["results"]).alias("r")).select("r.*")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "Observation", "SparkSession", "F", "T", "W")]

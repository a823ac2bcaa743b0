"""Edits of page texts as keyed table updates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.batches import ship


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text``, without overlaps; none for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("int")).otherwise(0)


def unique_anchor(df: DataFrame, text: str = "text", anchor: str = "anchor", content: str = "content", kind: str = "kind") -> DataFrame:
    """``new_text`` and ``outcome``: the edit is made only where its anchor occurs exactly once.

    Kinds: insert_after, insert_before, extend (after the anchor, with a space), replace.
    """
    t, a, c = F.col(text), F.col(anchor), F.col(content)
    n = occurrences(t, a)
    made = F.when(F.col(kind) == "insert_after", F.concat(a, F.lit("\n"), c)).when(F.col(kind) == "insert_before", F.concat(c, F.lit("\n"), a)).when(F.col(kind) == "extend", F.concat(a, F.lit(" "), c)).when(F.col(kind) == "replace", c)
    at = F.instr(t, a)
    new = F.concat(F.substr(t, F.lit(1), at - 1), made, F.substr(t, at + F.length(a), F.length(t)))
    outcome = F.when(made.isNull(), "unknown_kind").when(n == 0, "anchor_missing").when(n > 1, "anchor_ambiguous").otherwise("applied")
    return df.withColumn("outcome", outcome).withColumn("new_text", F.when(F.col("outcome") == "applied", new).otherwise(t))


def append_to_section(text: str, path: str, content: str) -> tuple[str, str]:
    """Content at the end of the section "H2 → H3" (or "H2"); skipped if it is there already."""
    if content.strip() in text:
        return text, "present"
    names = [p.strip().lower() for p in path.split("→")]
    lines, start, level = text.split("\n"), 0, 1
    for name in names:
        level += 1
        start = next((i + 1 for i in range(start, len(lines)) if re.match(rf"#{{{level}}}\s+{re.escape(name)}\s*$", lines[i].lower())), -1)
        if start < 0:
            return text, "section_missing"
    end = next((i for i in range(start, len(lines)) if re.match(rf"#{{1,{level}}}\s", lines[i])), len(lines))
    while end > start and not lines[end - 1].strip():
        end -= 1
    return "\n".join([*lines[:end], content, *lines[end:]]), "applied"


def resolve_gap(text: str, gap: str, marker: str) -> tuple[str, str]:
    """``marker`` before the bullet that states the gap: literally, or by its first three longer words."""
    lines = text.split("\n")
    longer = [w.lower() for w in re.findall(r"\w+", gap) if len(w) > 4][:3]
    tests = [lambda x: gap.strip().lower() in x.lower(), lambda x: bool(longer) and all(w in x.lower() for w in longer)]
    for fits in tests:
        for i, line in enumerate(lines):
            if line.startswith("- ") and fits(line):
                return "\n".join([*lines[:i], marker, *lines[i:]]), "applied"
    return text, "gap_missing"


def _anchor_edit(text: str, kind: str, anchor: str, content: str) -> tuple[str, str]:
    n = text.count(anchor) if anchor else 0
    if n != 1:
        return text, "anchor_ambiguous" if n else "anchor_missing"
    made = {"insert_after": f"{anchor}\n{content}", "insert_before": f"{content}\n{anchor}", "extend": f"{anchor} {content}", "replace": content}.get(kind)
    return (text, "unknown_kind") if made is None else (text.replace(anchor, made), "applied")


def apply_updates(pages: DataFrame, updates: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages (page_id, text) with their updates (page_id, seq, kind, anchor, content) made in order, each on the text that the last one left.

    Returns page_id, new_text, n_applied, log (outcomes in order) and status (new, changed, unchanged; over_limit where a page
    has more than ``limit`` updates and is left alone). One group is one page and its updates.
    """
    ship(pages.sparkSession)
    ordered = updates.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "anchor", "content"))).alias("ups"))
    both = pages.join(ordered, "page_id", "left").withColumn("ups", F.coalesce("ups", F.array().cast(ordered.schema["ups"].dataType)))

    def fold(batches):
        for b in batches:
            rows = []
            for page, text, ups in zip(b["page_id"], b["text"], b["ups"], strict=True):
                ups = [u if isinstance(u, dict) else u.asDict() for u in ups]
                now, log = text, []
                if limit is not None and len(ups) > limit:
                    rows.append((page, text, 0, "", "over_limit"))
                    continue
                for u in ups:
                    if u["kind"] == "append_section":
                        now, what = append_to_section(now, u["anchor"], u["content"])
                    elif u["kind"] == "resolve_gap":
                        now, what = resolve_gap(now, u["anchor"], u["content"])
                    else:
                        now, what = _anchor_edit(now, u["kind"], u["anchor"], u["content"])
                    log.append(what)
                rows.append((page, now, log.count("applied"), ",".join(log), "unchanged" if now == text else "changed"))
            yield pd.DataFrame(rows, columns=["page_id", "new_text", "n_applied", "log", "status"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.select("page_id", "text", "ups").mapInPandas(fold, f"page_id {kind}, new_text string, n_applied int, log string, status string")


def replay(pages: DataFrame, records: DataFrame, limit: int | None = None) -> DataFrame:
    """:func:`apply_updates` for logged updates (page_id, mtime, file, idx, kind, anchor, content) in the order they were written."""
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("page_id").orderBy("mtime", "file", "idx"))
    return apply_updates(pages, records.withColumn("seq", seq).select("page_id", "seq", "kind", "anchor", "content"), limit)


def over_limit(updates: DataFrame, limit: int) -> DataFrame:
    return updates.groupBy("page_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def change_report(before: DataFrame, after: DataFrame, key: str, body: str) -> DataFrame:
    """new, changed, unchanged or gone for each key of two snapshots, by a hash of the body."""
    a = before.select(F.col(key).alias("_a"), F.sha2(F.col(body), 256).alias("ha"))
    b = after.select(F.col(key).alias("_b"), F.sha2(F.col(body), 256).alias("hb"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("ha").eqNullSafe(F.col("hb")), "unchanged").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def stubs(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """A template page for each candidate (page_id, page_type, canonical_name) that has no page."""
    new = candidates.select("page_id", "page_type", "canonical_name").dropDuplicates(["page_id"]).join(pages.select("page_id"), "page_id", "left_anti")
    text = F.concat(F.lit("---\npage_id: "), "page_id", F.lit("\npage_type: "), "page_type", F.lit("\n---\n# "), "canonical_name", F.lit("\n"))
    return new.withColumn("text", text)

"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Candidates come from SimHash fingerprints, and from MinHash bands where these don't reach; whole sets give the verdict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.batches import map_batches
from korpusmill.llm import near_dup
from korpusmill.llm.common import cut, scramble, shingle_hashes, slices, utf8
from korpusmill.llm.components import components
from korpusmill.llm.keeping import checked, keep_keepers, with_keepers

#: Two sets of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.999997 at s = 0.8.
BANDS, ROWS = 32, 5
_SEEDS = scramble(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32).reshape(2, BANDS, ROWS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 hashes of the distinct word shingles of all rows, in order of row and hash, and the number of each row."""
    h, row = shingle_hashes(data, offsets, width)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(offsets) - 1)


def set_hashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for an empty one."""
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        out[full] = scramble(np.add.reduceat(scramble(h), (np.cumsum(n) - n)[full], dtype=np.uint64) + n[full].astype(np.uint64))
    return out


def bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each set that is not empty."""
    at = (np.cumsum(n) - n)[n > 0]
    out = np.zeros((len(at), BANDS), np.uint64)
    if len(at):
        short = (h >> np.uint64(32)).astype(np.uint32)
        for b in range(BANDS):
            key = np.full(len(at), b + 1, np.uint64)
            for r in range(ROWS):
                low = np.minimum.reduceat((short ^ _SEEDS[0, b, r]) * (_SEEDS[1, b, r] | np.uint32(1)), at)
                key = scramble(key ^ low)
            out[:, b] = key
    return out


def _marked(texts: DataFrame, width: int) -> DataFrame:
    """``id``, ``th``, the hash ``whole`` of its set, its size ``n``, its fingerprint ``fp`` and its ``bands``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, n = shingle_sets(*utf8(b.column(2)), width)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands(h, n).ravel().view(np.int64)))
            fp = near_dup.fingerprints(h, np.repeat(np.arange(len(n)), n), len(n))
            columns = [pa.array(x.view(np.int64)) for x in (set_hashes(h, n), n.astype(np.int64), fp)]
            yield pa.record_batch([b.column(0), b.column(1), *columns, keys], ["id", "th", "whole", "n", "fp", "bands"])

    return map_batches(texts, run, "id long, th long, whole long, n long, fp long, bands array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``whole`` and the hashes ``shingles`` of its set, for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, n = shingle_sets(*utf8(b.column(1)), width)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.record_batch([pa.array(set_hashes(h, n).view(np.int64)), lists], ["whole", "shingles"])

    return map_batches(texts.select("th", "text"), run, "whole long, shingles array<long>")


def linked(sets: list[np.ndarray], labels: np.ndarray, similarity: float, cells: int = 1 << 23) -> list[tuple[int, int]]:
    """Pairs of members that join the labels of a group: two labels are joined if a set of one and a set of the other have the similarity.

    Common elements of all pairs are counted by products of 0/1 matrices, ``cells`` numbers at a time. There are fewer pairs than labels.
    """
    m, n = len(sets), np.array([len(s) for s in sets])
    names, label = np.unique(labels, return_inverse=True)
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(m), n), count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(shared.sum())
    common, step = np.zeros((m, m), np.float32), max(1, min(cells // m, width))
    for a in range(0, width, step):
        i, j = np.searchsorted(column, [a, a + step])
        x = np.zeros((m, min(step, width - a)), np.float32)
        x[row[i:j], column[i:j] - a] = 1
        common += x @ x.T
    alike = common >= similarity * (n[:, None] + n[None, :] - common) - 1e-6
    root = np.arange(len(names))
    while True:  # labels take the least label that they are joined to, until nothing changes
        now = root[label]
        least = np.where(alike, now[None, :], len(names)).min(axis=1)
        new = root.copy()
        np.minimum.at(new, label, least)
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.full(len(names), -1)
    member[label[::-1]] = np.arange(m)[::-1]
    return [(int(member[r]), int(member[k])) for k, r in enumerate(root) if r != k]


def _linked(similarity: float):
    """Links within each group (``v``, ``i``, ``j``) of rows that come sorted by group."""

    def one(rows: list[tuple]) -> list[tuple[int, int]]:
        wholes = {r[0]: r for r in rows}  # a member can come twice
        rows = list(wholes.values())
        labels = np.array([r[1] for r in rows])
        if (labels == labels[0]).all():
            return []
        found = linked([r[2] for r in rows], labels, similarity)
        return [(rows[a][0], rows[b][0]) for a, b in found]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, out = None, []
        for b in batches:
            v, i, j, whole, label = (b.column(k).to_numpy() for k in range(5))
            lists = b.column(5)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for r in range(b.num_rows):
                now = (v[r], i[r], j[r])
                if now != key:
                    if held:
                        out += one(held)
                    held, key = [], now
                held.append((int(whole[r]), int(label[r]), values[ends[r] : ends[r + 1]].copy()))
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["src", "dst"])
                out = []
        if held:
            out += one(held)
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["src", "dst"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``src``, ``dst``) whose ``sets`` have the similarity."""
    both = pairs.join(sets.select(F.col("whole").alias("dst"), F.col("shingles").alias("b")), "dst").join(sets.select(F.col("whole").alias("src"), F.col("shingles").alias("a")), "src")
    common = F.size(F.array_intersect("a", "b"))
    return cut(both.filter(common >= similarity * (F.size("a") + F.size("b") - common) - 1e-6).select("src", "dst"))


def edges(
    nodes: DataFrame, texts: DataFrame, width: int, similarity: float, broadcast_rows: int, distance: int = 8, block_bytes: int = 1 << 25, block_rows: int = 2048,
) -> DataFrame:
    """Links (``src``, ``dst``) between distinct sets (``whole``, ``n``, ``fp``, ``bands``, ``th``) whose closure is all similar pairs that share a band or whose fingerprints meet within ``distance``."""
    near = cut(near_dup.candidates(nodes.filter("n > 0").select("fp", F.col("whole").alias("id")), distance))
    keyed = nodes.select("whole", "n", F.explode("bands").alias("v"))
    leads = keyed.groupBy("v").agg(F.count("*").alias("c"), F.min(F.struct("whole", "n")).alias("lead")).filter("c > 1").select("v", F.col("lead.whole").alias("lead"), F.col("lead.n").alias("lead_n"))
    members = cut(keyed.join(checked(cut(leads), broadcast_rows), "v"))
    # the sets of all that meet another
    ends = members.select("whole").unionByName(near.select(F.col("src").alias("whole"))).unionByName(near.select(F.col("dst").alias("whole")))
    ends = checked(cut(ends.distinct()), broadcast_rows)
    theirs = checked(cut(nodes.join(ends, "whole", "left_semi").select("th").distinct()), broadcast_rows)
    sets = cut(_sets(texts.join(theirs, "th", "left_semi"), width).join(ends, "whole", "left_semi").dropDuplicates(["whole"]))
    # what fingerprints link; bands then take the pairs that this leaves apart
    first = _similar(near, sets, similarity)
    least = lambda df, a, b: checked(cut(df.groupBy(F.col("dst").alias(a)).agg(F.min("src").alias(b))), broadcast_rows)
    star = members.filter((F.col("whole") != F.col("lead")) & (F.least("n", "lead_n") / F.greatest("n", "lead_n") >= similarity)).select(F.col("lead").alias("src"), F.col("whole").alias("dst")).distinct()
    star = star.join(least(first, "src", "src_in"), "src", "left").join(least(first, "dst", "dst_in"), "dst", "left")
    star = star.filter(F.coalesce("src_in", "src") != F.coalesce("dst_in", "dst")).select("src", "dst")
    stars = first.unionByName(_similar(star, sets, similarity))
    # buckets that still hold several stars: their members meet in blocks, and only what joins two stars comes out
    label = least(stars, "whole", "label")
    spread = members.select("v", "whole", "n").join(label, "whole", "left").withColumn("label", F.coalesce("label", "whole"))
    mixed = spread.groupBy("v").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.sum("n").alias("size"), F.count("*").alias("c")).filter("a < b")
    mixed = cut(mixed.select("v", F.greatest(F.ceil(F.col("size") * 8 / block_bytes), F.ceil(F.col("c") / block_rows)).cast("int").alias("blocks")))
    placed = spread.join(checked(mixed, broadcast_rows), "v").join(sets, "whole")
    own = F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int")
    placed = placed.select("v", "whole", "label", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "whole", "label", "shingles")
    more = map_batches(placed.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j"), _linked(similarity), "src long, dst long")
    return stars.unionByName(cut(more.distinct()))


def _classes(docs: DataFrame, width: int, similarity: float, broadcast_rows: int, doc_id: str, text: str) -> DataFrame:
    """``id``, ``th``, ``copies``, ``component`` and ``keeper`` (id, text hash) of each distinct pair of id and text hash."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    marked = cut(_marked(texts, width))
    nodes = cut(marked.groupBy("whole").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("th").alias("th")))
    found = components(edges(nodes, texts, width, similarity, broadcast_rows)).withColumnRenamed("node", "whole")
    rows = marked.groupBy("id", "th", "whole").agg(F.count("*").alias("copies"))
    rows = rows.join(checked(found, broadcast_rows), "whole", "left").select("id", "th", "copies", F.coalesce("component", "whole").alias("component"))
    return with_keepers(rows, broadcast_rows)


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, broadcast_rows: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text_hash`` and ``component_id`` of each distinct row: the smallest id reachable over pairs of texts whose shingle sets have Jaccard ``similarity`` or more.

    Equal sets are one node. Nodes whose fingerprints lie within 8 bits are linked first, each pair verified by exact
    similarity (:func:`near_dup.candidates`). Pairs may be similar with fingerprints further apart, so nodes also meet in buckets by
    MinHash bands; those not yet linked with the least of their bucket are verified against it. Where that leaves a bucket in
    several stars, its members meet in blocks of bounded size inside tasks, where all pairs are compared exactly, and only the
    links that join two stars come out. So no bucket is capped, and what is emitted grows with the members of a bucket, not
    with its square.

    A pair is missed only if its fingerprints don't meet and it shares no band: probability at most 3e-6 at similarity 0.8, less above. Texts of fewer than ``width``
    words are one shingle; null, empty and blank texts have the empty set and belong together; rows that share an id are told
    apart by their text; a null id counts as larger than any other, so it names a component only where there is no other; an
    empty table gives an empty result; very long texts are read whole.
    """
    out = _classes(docs, width, similarity, broadcast_rows, doc_id, text)
    return out.select("id", F.col("th").alias("text_hash"), F.col("keeper.id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, broadcast_rows: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group (:func:`groups`), with the columns of ``docs``: that of the smallest id, of several that of the smallest text hash.

    Of rows alike in id and text one stays. Texts do not move where at most ``broadcast_rows`` rows go.
    """
    return keep_keepers(docs, _classes(docs, width, similarity, broadcast_rows, doc_id, text), broadcast_rows, doc_id, text)

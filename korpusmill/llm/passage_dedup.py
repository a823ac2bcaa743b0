"""Removal of repeated byte strings across documents, by a distributed difference-cover suffix sort.

A suffix sort of every byte would move each byte of the corpus many times. So anchors, chosen by content, come first: each
``length``-byte window has the same anchor wherever it occurs. Consecutive windows with one anchor are a span. Spans with an
equal earlier span are repeats as a whole; spans whose anchor no other span has hold no repeats; the windows of the rest (a few
in a hundred) are suffix-sorted in tasks dealt out by anchor, and neighbours are compared. All of it is exact but for
collisions of 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from korpusmill.functions.batches import map_batches
from korpusmill.llm.common import SpanHash, scramble, slices, utf8
from korpusmill.llm.suffix_sort import equal_prefixes

#: Bytes hashed at an anchor; routing numbers of the first exchange, the least and for each of its partitions.
ANCHOR, ROUTES, ROUTES_EACH = 32, 4096, 16
#: Spans held by a task of the first step before it sends them on; different spans of one anchor, seen by one task of the
#: first step or met in the second, from which the anchor counts as crowded.
HELD, LOCAL, CROWD = 1_500_000, 16, 2_000
#: Text sorted at a time.
CHUNK = 1 << 20

SPAN = np.dtype([("s", "u8"), ("u", "u8"), ("id", "i8"), ("l", "i4"), ("th", "i4"), ("w", "u1"), ("kind", "u1")])
PLAIN, SPREAD, MARK = 0, 1, 2  # kinds of entries: by anchor; of a crowded anchor, by span; sign that an anchor is crowded
REPEAT, NARROW, WIDE = 0, 1, 2  # kinds of finds
FINDS = "id long, th int, a int, b int, kind int, key long"


def spans(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each span, its row, the hash at its anchor, and the hash of its text."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n, width = len(data), length - ANCHOR + 1
    if n < length:
        return none
    hashes = SpanHash(data)
    at = np.arange(n - ANCHOR + 1)
    h = hashes(at, at + ANCHOR)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # the least hash, the leftmost of equals
    reach = 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, offsets[:-1], 1)
    row = np.cumsum(inside[: len(anchor)]) - 1
    fits = np.arange(len(anchor)) + length <= offsets[row + 1]
    cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])))
    last = np.append(cut[1:], len(anchor)) - 1
    keep = fits[cut]
    first, last = cut[keep], last[keep]
    return first, last, row[first], h[anchor[first]], hashes(first, last + length)


def _finds(ids, ths, a, b, kind, key) -> pa.RecordBatch:
    n = len(ids)
    fill = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n))
    return pa.record_batch([fill(ids, np.int64), fill(ths, np.int32), fill(a, np.int32), fill(b, np.int32), fill(kind, np.int32), fill(key, np.int64)], ["id", "th", "a", "b", "kind", "key"])


def _firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` by anchor, text and place, each place once; which entries are the first of their text."""
    x = x[np.lexsort((x["l"], x["th"], x["id"], x["u"], x["s"]))]
    if len(x):
        x = x[np.append(True, np.any([x[f][1:] != x[f][:-1] for f in ("s", "u", "id", "th", "l")], axis=0))]
    return x, np.append(True, (x["s"][1:] != x["s"][:-1]) | (x["u"][1:] != x["u"][:-1])) if len(x) else np.zeros(0, bool)


def _group_sizes(s: np.ndarray) -> np.ndarray:
    """For sorted ``s``: how many equals each entry has, itself included."""
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    n = np.diff(np.append(at, len(s)))
    return np.repeat(n, n)


def _collect(length: int, routes: int):
    """First step: spans of all texts, less those with an equal in the same task, dealt out by anchor."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, first = _firsts(np.concatenate(held))
        again, x = x[~first], x[first]
        crowded = _group_sizes(x["s"]) >= LOCAL if len(x) else np.zeros(0, bool)
        x["kind"][crowded] = SPREAD
        signs = x[crowded][np.append(True, x["s"][crowded][1:] != x["s"][crowded][:-1])] if crowded.any() else x[:0]
        signs = signs.copy()
        signs["kind"] = MARK
        x = np.concatenate([x, signs])
        route = scramble(x["s"] ^ np.where(x["kind"] == SPREAD, x["u"], 0)) & np.uint64(routes - 1)
        order = np.argsort(route, kind="stable")
        x, route = x[order], route[order]
        cut = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
        blobs = [x[i:j] for i, j in zip(cut, np.append(cut[1:], len(x)), strict=True)]
        own = _merged(again, length)
        dealt = np.concatenate([route[cut].astype(np.int64), own[:, 0] % routes if len(own) else np.zeros(0, np.int64)])
        yield pa.record_batch([pa.array(dealt.astype(np.int32)), pa.array([b"s" + b.tobytes() for b in blobs] + [b"r" + r.tobytes() for r in own], pa.binary())], ["route", "data"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches):
            data, offsets = utf8(b.column(2))
            first, last, row, seed, text = spans(data, offsets, length)
            x = np.zeros(len(first), SPAN)
            x["s"], x["u"], x["l"], x["w"] = seed, text, first - offsets[row], last - first + 1
            x["id"], x["th"] = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            held.append(x)
            n += len(x)
            if n >= HELD:
                yield from send(held)
                held, n = [], 0
        if n:
            yield from send(held)

    return run


def _merged(x: np.ndarray, length: int) -> np.ndarray:
    """Ranges covered by the windows of spans: rows of id, th, start, end; overlapping ones are joined."""
    if not len(x):
        return np.zeros((0, 4), np.int64)
    rows = np.column_stack([x["id"], x["th"].astype(np.int64), x["l"].astype(np.int64), x["l"].astype(np.int64) + x["w"] - 1 + length])
    return joined(rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))])


def joined(rows: np.ndarray) -> np.ndarray:
    """Sorted ranges of about one length (no later one ends earlier) with overlapping and touching ones made one."""
    new = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] > np.maximum.accumulate(rows[:, 3])[:-1]) | (rows[1:, 2] > rows[:-1, 3]))
    at = np.flatnonzero(new)
    out = rows[at].copy()
    out[:, 3] = np.maximum.reduceat(rows[:, 3], at)
    return out


def _compare(length: int):
    """Second step: spans of one anchor meet. Finds are repeats, and spans whose windows have to be sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], []
        for b in batches:
            for d in b.column(1):
                raw = d.as_buffer().to_pybytes()
                (held if raw[:1] == b"s" else own).append(raw[1:])
        if own:
            r = np.frombuffer(b"".join(own), np.int64).reshape(-1, 4)
            yield _finds(r[:, 0], r[:, 1], r[:, 2], r[:, 3], REPEAT, 0)
        if not held:
            return
        x = np.frombuffer(b"".join(held), SPAN)
        signs = np.unique(x["s"][x["kind"] == MARK])
        x, first = _firsts(x[x["kind"] != MARK])
        r = _merged(x[~first], length)
        yield _finds(r[:, 0], r[:, 1], r[:, 2], r[:, 3], REPEAT, 0)
        x = x[first]
        n = _group_sizes(x["s"])
        signed = np.isin(x["s"], signs)
        wide = (x["kind"] == SPREAD) | signed | (n > CROWD)
        narrow = ~wide & (n > 1)
        for mask, kind in ((wide, WIDE), (narrow, NARROW)):
            y = x[mask]
            yield _finds(y["id"], y["th"], y["l"], y["w"], kind, y["s"].view(np.int64))

    return run


def _texts(length: int):
    """Third step: the text of the spans to sort. Windows of crowded anchors go singly, as two hashes, once for each task."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held)
        x = x[np.lexsort((x["a"], x["th"], x["id"], x["other"], x["key"]))]
        again = np.append(False, (x["key"][1:] == x["key"][:-1]) & (x["other"][1:] == x["other"][:-1]))
        same_place = np.append(False, (x["id"][1:] == x["id"][:-1]) & (x["th"][1:] == x["th"][:-1]) & (x["a"][1:] == x["a"][:-1])) & again
        x, again = x[~same_place], again[~same_place]
        other = x["other"].astype(np.uint64).view("V8")
        yield _rows(x["key"], x["id"], x["th"], x["a"], np.where(again, 0, SINGLE), pa.array([v.tobytes() for v in other], pa.binary()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            out: list[tuple] = []
            for id_, th, text, finds in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                todo = [f for f in finds or () if f["kind"] != REPEAT]
                if not todo:
                    continue
                data = text.encode()
                wide = [f for f in todo if f["kind"] == WIDE]
                out += [(f["key"], id_, th, f["a"], f["b"], data[f["a"] : f["a"] + f["b"] - 1 + length]) for f in todo if f["kind"] == NARROW]
                if wide:
                    raw = np.frombuffer(data, np.uint8)
                    at = np.concatenate([np.arange(f["a"], f["a"] + f["b"]) for f in wide])
                    x = np.zeros(len(at), WINDOW)
                    x["key"], x["other"] = SpanHash(raw)(at, at + length).view(np.int64), SpanHash(raw, 1)(at, at + length)
                    x["id"], x["th"], x["a"] = id_, th, at
                    held.append(x)
                    n += len(x)
            if out:
                yield _rows(*zip(*out, strict=True))
            if n >= HELD:
                yield from send(held)
                held, n = [], 0
        if n:
            yield from send(held)

    return run


#: A window by itself, by two hashes of its text.
WINDOW, SINGLE = np.dtype([("key", "i8"), ("other", "u8"), ("id", "i8"), ("th", "i4"), ("a", "i4")]), -1
SORTED = "key long, id long, th int, a int, w int, text binary"


def _rows(*columns) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "id", "th", "a", "w", "text"])


def _sort(length: int):
    """Fourth step: suffix-sort the spans that may share windows; every window but the first of its equals is a repeat. Single windows are compared by their hashes."""

    def chunk(keys, ids, ths, at, w, parts) -> np.ndarray:
        text = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        k = np.repeat(np.arange(len(w)), w)
        step = np.arange(len(k)) - np.repeat(np.concatenate([[0], np.cumsum(w)[:-1]]), w)
        start = base[k] + step
        owner = np.zeros(len(text), np.int64)
        owner[start] = np.arange(len(start))
        order, group = equal_prefixes(text, start, length)
        i = owner[order]
        spot = np.column_stack([ids[k[i]], ths[k[i]].astype(np.int64), at[k[i]] + step[i]])
        by = np.lexsort((spot[:, 2], spot[:, 1], spot[:, 0], group))
        spot, group = spot[by], group[by]
        once = np.append(True, (group[1:] != group[:-1]) | (spot[1:] != spot[:-1]).any(axis=1))
        spot, group = spot[once], group[once]
        later = spot[1:][(group[1:] == group[:-1])]
        rows = np.column_stack([later, later[:, 2] + length])
        return joined(rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]) if len(rows) else np.zeros((0, 4), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        keys, ids, ths, at, w = (whole.column(i).to_numpy() for i in range(5))
        text = whole.column(5).combine_chunks()
        r = w == 0
        yield _finds(ids[r], ths[r], at[r], at[r] + length, REPEAT, 0)
        one = np.flatnonzero(w == SINGLE)
        if len(one):
            other = np.frombuffer(b"".join(text.take(pa.array(one)).to_pylist()), np.uint64)
            by = np.lexsort((at[one], ths[one], ids[one], other, keys[one]))
            one, other = one[by], other[by]
            k = one[1:][(keys[one][1:] == keys[one][:-1]) & (other[1:] == other[:-1]) & ((ids[one][1:] != ids[one][:-1]) | (ths[one][1:] != ths[one][:-1]) | (at[one][1:] != at[one][:-1]))]
            yield _finds(ids[k], ths[k], at[k], at[k] + length, REPEAT, 0)
        order = np.argsort(keys, kind="stable")
        order = order[w[order] > 0]
        if not len(order):
            return
        sizes = np.cumsum(w[order] + length - 1)
        new_key = np.append(True, keys[order][1:] != keys[order][:-1])
        cuts, done = [0], 0
        for i in np.flatnonzero(new_key):
            if sizes[i - 1] - done > CHUNK and i:
                cuts.append(int(i))
                done = sizes[i - 1]
        for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
            o = order[i:j]
            rows = chunk(keys[o], ids[o], ths[o], at[o], w[o], text.take(pa.array(o)).to_pylist())
            yield _finds(rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], REPEAT, 0)

    return run


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last step: cut the repeats out of each text."""
    for b in batches:
        out: list[tuple] = []
        for n, (text, *lists) in enumerate(zip(*(b.column(i).to_pylist() for i in range(2, 5)), strict=True)):
            data = (text or "").encode()
            ranges = sorted((f["a"], f["b"]) for fs in lists if fs for f in fs if f["kind"] == REPEAT)
            runs: list[list[int]] = []
            for a, e in ranges:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([a, e])
            kept, at = [], 0
            for a, e in runs:
                kept.append(data[at:a])
                at = e
            rest = b"".join([*kept, data[at:]])
            out.append((len(data), sum(e - a for a, e in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest, n))
        cols = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols[:5], types, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", kept: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and, if ``kept``, the remaining bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id, or earlier in
    the same one. Strings are judged on the input and lie within a document. Remaining bytes need not be UTF-8.

    A null text is empty; a null id counts as the smallest; rows that share an id are told apart by their text and come in
    the order of a hash of it, and exact copies of a row with the same id are one document, each with that document's result;
    texts shorter than ``length`` stay; an empty table gives an empty result; other columns are left out.
    """
    if length <= ANCHOR or length - ANCHOR + 1 > 255:
        raise ValueError(f"length must be above {ANCHOR} and below {ANCHOR + 255}")
    source = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.pmod(F.xxhash64(F.col(text)), F.lit((1 << 31) - 1)).cast("int").alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    each = ROUTES_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routes = max(ROUTES, 1 << min(30, (each - 1).bit_length()))  # a power of two, so that more partitions mean smaller tasks
    sent = map_batches(source, _collect(length, routes), "route int, data binary").repartition("route")
    found = map_batches(sent, _compare(length), FINDS).groupBy("id", "th").agg(F.collect_list(F.struct("a", "b", "kind", "key")).alias("finds"))
    both = source.join(found, ["id", "th"], "left").select("id", "th", "text", "finds")
    more = map_batches(map_batches(both, _texts(length), SORTED).repartition("key"), _sort(length), FINDS)
    more = more.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b", "kind", "key")).alias("more"))
    last = both.join(more, ["id", "th"], "left").select("id", "th", "text", "finds", "more")
    fields = [StructField("id", LongType()), *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType()), StructField("kept", BinaryType())]
    out = map_batches(last, _apply, StructType(fields))
    id_ = F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id")
    return out.select(id_, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else []))

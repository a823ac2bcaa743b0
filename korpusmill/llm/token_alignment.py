"""Alignment of two tokenizers' tokens by byte offsets, and the statistics of linked ids over a corpus.

Where tokens of both vocabularies end at one byte, a group ends. Most groups are one token on either side with the same bytes;
those are counted in vectors as long as the first vocabulary. Only the pairs of other groups go through a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.batches import map_batches
from korpusmill.llm.common import cut, slices, utf8

#: How a byte-level vocabulary splits text before its merges (public, goes with the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level vocabulary from the JSON file's bytes. ``encode`` puts a space before the text; special tokens are plain text."""

    def __init__(self, content: bytes, split: str = SPLIT):
        import tiktoken

        found, letter = json.loads(content), _byte_letters()
        special = {t["id"] for t in found.get("added_tokens", []) if t["special"]}
        vocabulary = {bytes(letter[c] for c in entry): i for entry, i in found["model"]["vocab"].items() if i not in special}
        self.tokens = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        self.plain = np.ones(len(self.tokens), bool)
        self._encode = tiktoken.Encoding("byte-level", pat_str=split, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encode(" " + t) for t in texts]


class Pieces:
    """A piece vocabulary with byte fallback from the model file's bytes. It puts a space before each text by itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = range(self._model.get_piece_size())
        as_bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [self._model.id_to_piece(i)]]
        self.tokens, self.plain = as_bytes, np.array([not (self._model.is_byte(i) or self._model.is_control(i) or self._model.is_unknown(i)) for i in ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@dataclass
class Pair:
    """Two vocabularies, each a class of this module and the bytes of its file, so that executors need no copy of the file."""

    kind_a: type
    file_a: bytes
    kind_b: type
    file_b: bytes

    @classmethod
    def read(cls, path_a: str, path_b: str, kind_a: type = ByteLevel, kind_b: type = Pieces) -> Pair:
        return cls(kind_a, Path(path_a).read_bytes(), kind_b, Path(path_b).read_bytes())

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("kind_a", "file_a", "kind_b", "file_b")}

    @cached_property
    def a(self):
        return self.kind_a(self.file_a)

    @cached_property
    def b(self):
        return self.kind_b(self.file_b)

    @cached_property
    def same(self) -> np.ndarray:
        """For each id of A the id of B with the same bytes, an ordinary piece before a byte; -1 for none."""
        of = {t: i for i, t in sorted(enumerate(self.b.tokens), key=lambda x: (self.b.plain[x[0]], -x[0]))}
        return np.array([of.get(t, -1) if t else -1 for t in self.a.tokens])

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in v.tokens], np.int64) for v in (self.a, self.b))

    @cached_property
    def written(self) -> list[bytes]:
        """Each id of A with ``,`` and ``|`` after it, then each of B with ``,``, ``;`` and nothing."""
        return [b"%d%c" % (i, c) for i in range(len(self.a.tokens)) for c in b",|"] + [b"%d%s" % (i, c) for i in range(len(self.b.tokens)) for c in (b",", b";", b"")]


def whole(vocabulary, ids: list[list[int]], texts: list[str]) -> list[bool]:
    """Whether the tokens' bytes are those of the text after a space."""
    token = vocabulary.tokens.__getitem__
    return [b"".join(map(token, i)) == b" " + t.encode() for i, t in zip(ids, texts, strict=True)]


@dataclass
class Aligned:
    """Tokens of a batch of texts; ends are counted from the batch's first byte, so texts never share one."""

    a: np.ndarray
    b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    ends: np.ndarray  # of groups
    stops: np.ndarray  # of texts: ends of tokens of A, of B, of groups


def align(pair: Pair, ids_a: list[list[int]], ids_b: list[list[int]]) -> Aligned:
    flat = [np.fromiter((x for i in ids for x in i), np.int64, sum(map(len, ids))) for ids in (ids_a, ids_b)]
    end_a, end_b = (np.cumsum(size[x]) for size, x in zip(pair.lengths, flat, strict=True))
    both = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two sorted runs: a merge
    ends = both[1:][both[1:] == both[:-1]]
    n_a, n_b = np.cumsum([len(i) for i in ids_a]), np.cumsum([len(i) for i in ids_b])
    last = np.concatenate([[0], end_a])[n_a]
    return Aligned(*flat, end_a, end_b, ends, np.array([n_a, n_b, np.searchsorted(ends, last, "right")]))


def described(pair: Pair, x: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each text."""
    group_a, group_b = np.searchsorted(x.ends, x.end_a), np.searchsorted(x.ends, x.end_b)
    last_a, last_b = x.ends[group_a] == x.end_a, x.ends[group_b] == x.end_b
    count_a, count_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(x.ends)))]) for g in (group_a, group_b))
    out = np.empty(len(x.a) + len(x.b), np.int64)
    out[np.arange(len(x.a)) + count_b[group_a]] = 2 * x.a + last_a
    closing = last_b.astype(np.int64)
    closing[x.stops[1][np.diff(x.stops[1], prepend=0) > 0] - 1] = 2
    out[np.arange(len(x.b)) + count_a[group_b + 1]] = 2 * len(pair.a.tokens) + 3 * x.b + closing
    parts, at = list(map(pair.written.__getitem__, out.tolist())), x.stops[0] + x.stops[1]
    return [b"".join(parts[i:j]) for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]


def links(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of all tokens whose bytes overlap, and the text. Each stretch between two ends, of whichever side, is one such pair."""
    both = np.sort(np.concatenate([x.end_a, x.end_b]), kind="stable")
    ends = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    at_a, at_b = np.searchsorted(x.end_a, ends), np.searchsorted(x.end_b, ends)
    return at_a, at_b, np.searchsorted(x.stops[0], at_a, "right")


def pack(values: np.ndarray, counts: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """One binary a row: rising ``values`` as differences and their ``counts``, in turn, seven bits a byte."""
    first = np.append(True, row[1:] != row[:-1])[: len(row)]
    delta = np.where(first, values, np.diff(values, prepend=0))
    stream = np.column_stack([delta, counts]).reshape(-1).astype(np.uint64)
    size = np.ones(len(stream), np.int64)
    for k in range(1, 9):
        size += stream >> np.uint64(7 * k) > 0
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[start[:-1][some] + k] = (stream[some] >> np.uint64(7 * k) & np.uint64(127)) | np.where(size[some] > k + 1, np.uint64(128), np.uint64(0))
    stops = start[2 * np.searchsorted(row, np.arange(n + 1))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(stops), pa.py_buffer(out)])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, counts and rows of :func:`pack`."""
    data, offsets = utf8(column.cast(pa.binary()))
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last + 1])[:-1]
    stream = np.zeros(len(last), np.int64)
    for k in range(int((last - first + 1).max(initial=0))):
        some = first + k <= last
        stream[some] |= (data[first[some] + k] & 127).astype(np.int64) << (7 * k)
    row = np.searchsorted(offsets, first[::2], "right") - 1
    total = np.cumsum(stream[::2])
    before = np.concatenate([[0], total])[np.searchsorted(row, np.arange(len(offsets) - 1))]
    return total - before[row], stream[1::2], row


SUMMARY = ["n_a", "n_b", "n_groups", "n_links"]


def encoded(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's counts, the digest of its groups and its distinct links with their number, packed; written to the checkpoint folder, as the statistics need them twice.

    ``same`` holds the ids of A linked with the id of B that has the same bytes, ``other`` the rest as ``a * |B| + b``.
    Texts are tokenised once, whole; a null or empty one, or one that the tokens do not spell, has no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        width = len(p.b.tokens)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids_a, ids_b = p.a.encode(texts), p.b.encode(texts)
            fine = [bool(t) and x and y for t, x, y in zip(texts, whole(p.a, ids_a, texts), whole(p.b, ids_b, texts), strict=True)]
            ids_a, ids_b = ([i if ok else [] for i, ok in zip(ids, fine, strict=True)] for ids in (ids_a, ids_b))
            x, n = align(p, ids_a, ids_b), len(texts)
            digest = [sha256(s).hexdigest() if s else "" for s in described(p, x)]
            at_a, at_b, row = links(x)
            n_links = np.bincount(row, minlength=n)
            code = x.a[at_a] * width + x.b[at_b]
            key, times = np.unique(row * (len(p.a.tokens) * width) + code, return_counts=True)
            row, code = np.divmod(key, len(p.a.tokens) * width)
            a = code // width
            same = p.same[a] == code % width
            numbers = [*np.diff(x.stops, prepend=0), n_links]
            packed = [pack(v[m], times[m], row[m], n) for v, m in ((a, same), (code, ~same))]
            yield pa.record_batch([batch.column(0), *(pa.array(v.astype(np.int64)) for v in numbers), pa.array(digest, pa.string()), *packed], ["id", *SUMMARY, "groups_sha256", "same", "other"])

    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return cut(map_batches(given, run, f"id {kind}, {', '.join(f'{c} long' for c in SUMMARY)}, groups_sha256 string, same binary, other binary"))


def pair_counts(found: DataFrame, n_a: int, flush: int = 2_000_000) -> DataFrame:
    """``code`` and ``n``, the number of texts with that link: ``a * |B| + b``, or ``-1 - a`` for the id of the same bytes.

    A task counts the latter in a vector of ``n_a`` numbers and the former in a sorted table that it hands on at ``flush``
    codes, so its memory is bounded; what is shuffled is counts, not links.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, none = np.zeros(n_a, np.int64), np.zeros(0, np.int64)
        waiting, codes, counts = [], none, none
        made = lambda c, n: pa.record_batch([pa.array(c), pa.array(n)], ["code", "n"])

        def fold() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([none, *waiting]), return_counts=True)
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, times]), len(both)).astype(np.int64)

        for batch in batches:
            vector += np.bincount(unpack(batch.column(0))[0], minlength=n_a)
            waiting.append(unpack(batch.column(1))[0])
            if sum(map(len, waiting)) > flush:
                codes, counts = fold()
                waiting = []
                if len(codes) > flush:
                    yield made(codes, counts)
                    codes = counts = none
        codes, counts = fold()
        if len(codes):
            yield made(codes, counts)
        some = np.flatnonzero(vector)
        if len(some):
            yield made(-1 - some, vector[some])

    return map_batches(found.select("same", "other"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, pair: Pair, broadcast_pairs: int = 4_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A link is a pair of tokens whose bytes overlap; its count is the number of texts of the corpus that hold its ids linked.
    ``n_best`` counts links whose count is the highest of their id in A, ties included; ``count_sum`` adds the counts up.
    The counts of up to ``broadcast_pairs`` pairs (16 bytes each) are sent to the tasks; more are joined by a shuffle, with the
    same result. Rows that repeat an id are texts of their own; ids may be null; other columns are ignored, whatever their
    names; an empty table gives an empty result. Very long texts are tokenised whole.
    """
    n_a, width = len(pair.a.tokens), len(pair.b.tokens)
    found = encoded(docs, pair, doc_id, text)
    counts = cut(pair_counts(found, n_a))
    a_of = F.when(F.col("code") < 0, -1 - F.col("code")).otherwise(F.expr(f"code div {width}"))
    best = np.zeros(n_a, np.int64)
    top = counts.groupBy(a_of.alias("a")).agg(F.max("n").alias("n")).toArrow()  # at most a row for each id of A
    best[top["a"].to_numpy()] = top["n"].to_numpy()
    same = np.zeros(n_a, np.int64)
    known = counts.filter("code < 0").toArrow()
    same[-1 - known["code"].to_numpy()] = known["n"].to_numpy()
    others = counts.filter("code >= 0")
    sc = docs.sparkSession.sparkContext
    if others.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        table = others.toArrow().sort_by("code")
        return _by_table(found, sc.broadcast((best, same, table["code"].to_numpy(), table["n"].to_numpy(), width)))
    return _by_join(found, others, sc.broadcast((best, same, width)))


def _sums(best: np.ndarray, same: np.ndarray, column: pa.Array, n: int) -> list[np.ndarray]:
    a, times, row = unpack(column)
    return [np.bincount(row, times * (same[a] == best[a]), n), np.bincount(row, times * same[a], n)]


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _by_table(found: DataFrame, shared) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, same, codes, counts, width = shared.value
        for batch in batches:
            n = batch.num_rows
            n_best, total = _sums(best, same, batch.column("same"), n)
            code, times, row = unpack(batch.column("other"))
            count = counts[np.searchsorted(codes, code)] if len(code) else code
            n_best = n_best + np.bincount(row, times * (count == best[code // width]), n)
            total = total + np.bincount(row, times * count, n)
            made = [pa.array(np.rint(v).astype(np.int64)) for v in (n_best, total)]
            yield pa.record_batch([*batch.columns[:5], *made, batch.column("groups_sha256")], ["id", *RESULT])

    types = ", ".join(f"{c} long" for c in RESULT[:-1])
    return map_batches(found, run, f"id {found.schema['id'].dataType.simpleString()}, {types}, groups_sha256 string")


def _by_join(found: DataFrame, others: DataFrame, shared) -> DataFrame:
    """The same where the pairs are too many to send: each text's pairs meet their counts by a join and are added up again."""
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, same, _ = shared.value
        for batch in batches:
            sums = _sums(best, same, batch.column("same"), batch.num_rows)
            yield pa.record_batch([batch.column("row"), *(pa.array(np.rint(s).astype(np.int64)) for s in sums)], ["row", "n_best", "count_sum"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, _, width = shared.value
        for batch in batches:
            code, times, row = unpack(batch.column("other"))
            yield pa.record_batch([batch.column("row").take(pa.array(row)), pa.array(code), pa.array(times), pa.array(best[code // width])], ["row", "code", "times", "best"])

    added = map_batches(found.select("row", "same"), own, "row long, n_best long, count_sum long")
    met = map_batches(found.select("row", "other"), spread, "row long, code long, times long, best long").join(others, "code")
    met = met.select("row", F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = added.unionByName(met).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.join(sums, "row").select("id", *RESULT)

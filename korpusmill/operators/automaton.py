"""Phrases of whole words in texts: all phrases in one trie, held in flat arrays, and every text read once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class PhraseTrie:
    """The words of all phrases, and a trie over their numbers.

    ``first`` is the node of each word at the root; the other edges are sorted numbers ``node * words + word`` with their
    ``child``. ``phrase`` is the phrase that ends at a node, or -1.
    """

    words: pa.Array
    first: np.ndarray
    edges: np.ndarray
    child: np.ndarray
    phrase: np.ndarray

    @classmethod
    def of(cls, phrases: list[str]) -> PhraseTrie:
        """Phrases are words with one space between; of equal ones the first counts."""
        number: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends = [-1]
        for k, text in enumerate(phrases):
            node = 0
            for word in text.split(" "):
                key = (node, number.setdefault(word, len(number)))
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            if node and ends[node] < 0:
                ends[node] = k
        n = len(number)
        first = np.zeros(n, np.int64)
        deep: dict[int, int] = {}
        for (node, word), child in edges.items():
            if node:
                deep[node * n + word] = child
            else:
                first[word] = child
        keys = np.array(sorted(deep), np.int64)
        return cls(pa.array(list(number), pa.string()), first, keys, np.array([deep[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and phrase of each occurrence in texts of words with single spaces between; null texts have none.

        All words of all texts start at the root and go on together as long as an edge leads on, so a text costs its words and
        what phrases begin alike, not one row for each run of words.
        """
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        word = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets -= offsets[0]
        rows, found = [], []
        at = np.flatnonzero(word >= 0)
        end = offsets[np.searchsorted(offsets, at, "right")]  # of the text
        node = self.first[word[at]]
        going = node > 0
        at, end, node, step = at[going], end[going], node[going], 1
        while len(at):
            done = self.phrase[node] >= 0
            rows.append(np.searchsorted(offsets, at[done], "right") - 1)
            found.append(self.phrase[node[done]])
            inside = at + step < end
            at, end, node = at[inside], end[inside], node[inside]
            next_word = word[at + step]
            key = node * len(self.first) + next_word
            place = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            going = (next_word >= 0) & (self.edges[place] == key) if len(self.edges) else np.zeros(len(at), bool)
            at, end, node, step = at[going], end[going], self.child[place[going]] if len(self.edges) else node[going], step + 1
        none = [np.zeros(0, np.int64)]
        return np.concatenate(rows or none), np.concatenate(found or none)


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes of a text column; a longer text stands alone, whole."""
    for b in batches:
        if b.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
                yield b.slice(i, j - i)
                i = j

"""Toxicity: Levenshtein automata over a trie of learned terms, and the context of each hit.

The terms are words that labelled toxic texts hold far oftener than others. Their Levenshtein automata share the terms' trie: a
state is the set of trie nodes that the letters read so far may have reached, each with its number of edits. Whole texts are read
by the words of a batch in step. What stands around a hit tells abuse from quotation; a logistic regression weighs the evidence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from korpusmill.functions.batches import map_batches
from korpusmill.llm.common import SpanHash, cut, fresh, runs, scramble, shingles, slices, utf8
from korpusmill.llm.labelled import labelled_sample, log_loss, sigmoid

#: Code points from here on (pictures, rare scripts) part words.
PLANE = 1 << 16
#: 1 letters, digits and marks; 2 signs that may stand for a letter inside a word; 0 all else.
_KIND = np.zeros(PLANE, np.uint8)
_KIND[[i for i in range(PLANE) if unicodedata.category(chr(i))[0] in "LNM"]] = 1
_KIND[[ord(c) for c in "@$*'’"]] = 2
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(PLANE)], np.uint16)
#: Marks that open or close a quotation.
_QUOTES = np.array([ord(c) for c in '"“”„«»'], np.uint16)
#: Words that tell of another's words, and words that address the reader.
REPORTING = "said says saying called calls wrote writes quote quoted quotes term word words sagte nannte schrieb wort zitat dit disait appelé mot citation dijo llamó palabra cita"
ADDRESS = "you your you're youre u du dich dir dein deine ihr euch tu toi ton ta vous votre tú tu ti usted ustedes eres"
_CUES = dict.fromkeys(REPORTING.split(), 1) | dict.fromkeys(ADDRESS.split(), 2)
#: How many words before a hit are its context.
REACH = 6


@dataclass
class Words:
    """The words of a batch of texts: places in its lower-cased code points, and the text of each."""

    letters: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    offsets: np.ndarray

    def text(self, which: np.ndarray) -> list[str]:
        whole = self.letters.tobytes().decode("utf-16-le", "surrogatepass")
        return [whole[i:j] for i, j in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """A word is a run of letters, digits and marks; ``@ $ * '`` between two of them belong to it."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    letters = _LOWER[np.minimum(points, PLANE - 1)]
    at = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    kind = _KIND[letters]
    start, end, row = runs((kind > 0).view(np.uint8), at)
    inked = np.flatnonzero(kind == 1)
    if not len(inked):
        start = end = row = start[:0]
    first, last = np.searchsorted(inked, start), np.searchsorted(inked, end) - 1
    some = first <= last
    return Words(letters, inked[first[some]], inked[last[some]] + 1, row[some], at)


def edits(term: str) -> int:
    """How many edits a term may be away: none below five letters, one below eight, then two."""
    return (len(term) >= 5) + (len(term) >= 8)


class Automaton:
    """The union of the terms' Levenshtein automata, a swap of neighbours being one edit, made deterministic as far as texts need it.

    ``match`` gives each word's term (-1 for none), the nearest and of those the first in order, and its edits. At most
    ``states`` states are kept; beyond that the table starts anew, so memory is bounded whatever the texts hold.
    """

    def __init__(self, terms: list[str], states: int = 50_000):
        self.terms, self.states = terms, states
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.limit = [0]
        for i, term in enumerate(terms):
            node, most = 0, edits(term)
            self.limit[0] = max(self.limit[0], most)
            for c in map(ord, term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], most)
            if self.ends[node] < 0:
                self.ends[node] = i
        self.alphabet = sorted({ord(c) for t in terms for c in t})
        self.of = np.zeros(PLANE, np.int32)  # 0: a letter of no term
        self.of[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.shortest = min((len(t) - edits(t) for t in terms), default=1)
        self.longest = max((len(t) + edits(t) for t in terms), default=0)
        self._begin()

    def _begin(self) -> None:
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.next = np.full((64, len(self.alphabet) + 1), -1, np.int32)
        self.term, self.away = np.full(64, -1, np.int32), np.zeros(64, np.int8)
        self._state(frozenset())  # 0: no term can follow
        self._state(self._closed({(0, 0, 0)}))

    def _closed(self, found: set) -> frozenset:
        """With letters of a term left out; of several ways to a node the cheapest."""
        best: dict[tuple[int, int], int] = {}
        todo = list(found)
        while todo:
            node, wait, e = todo.pop()
            if e > self.limit[node] or best.get((node, wait), 9) <= e:
                continue
            best[node, wait] = e
            if not wait:
                todo += [(child, 0, e + 1) for child in self.children[node].values()]
        return frozenset((node, wait, e) for (node, wait), e in best.items())

    def _state(self, members: frozenset) -> int:
        if members in self.number:
            return self.number[members]
        k = self.number[members] = len(self.sets)
        self.sets.append(members)
        if k == len(self.term):
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.term, self.away = np.concatenate([self.term, np.full_like(self.term, -1)]), np.concatenate([self.away, np.zeros_like(self.away)])
        ending = [(e, self.ends[node]) for node, wait, e in members if not wait and self.ends[node] >= 0 and e <= edits(self.terms[self.ends[node]])]
        self.next[k] = -1
        self.term[k], self.away[k] = min(ending, default=(0, -1))[::-1]
        if not members:
            self.next[k] = 0
        return k

    def _step(self, state: int, letter: int) -> int:
        found = set()
        for node, wait, e in self.sets[state]:
            if wait:
                if wait == letter:
                    found.add((node, 0, e))
                continue
            found.add((node, 0, e + 1))  # a letter too many
            for c, child in self.children[node].items():
                found.add((child, 0, e + (c != letter)))
                if c != letter and letter in self.children[child]:
                    found.add((self.children[child][letter], c, e + 1))  # two letters swapped: the other must follow
        return self._state(self._closed(found))

    def match(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        term, away = np.full(len(w.start), -1, np.int32), np.zeros(len(w.start), np.int8)
        length = w.end - w.start
        live = np.flatnonzero((length >= self.shortest) & (length <= self.longest))
        if len(self.sets) > self.states:
            self._begin()
        state, j = np.ones(len(live), np.int32), 0
        while len(live):
            letter = self.of[w.letters[w.start[live] + j]]
            to = self.next[state, letter]
            unknown = to < 0
            if unknown.any():
                for key in np.unique(state[unknown].astype(np.int64) * len(self.next[0]) + letter[unknown]).tolist():
                    s, c = divmod(key, len(self.next[0]))
                    made = self._step(s, self.alphabet[c - 1] if c else -1)  # may replace the tables
                    self.next[s, c] = made
                to = self.next[state, letter]
            j += 1
            done = length[live] == j
            term[live[done]], away[live[done]] = self.term[to[done]], self.away[to[done]]
            going = (to > 0) & ~done
            live, state = live[going], to[going]
        return term, away


@dataclass
class Lexicon:
    """Terms, the strongest first, with the weights of a hit as written and of a misspelled one (0: no evidence)."""

    terms: list[str]
    exact: np.ndarray
    near: np.ndarray

    def __getstate__(self):
        return {"terms": self.terms, "exact": self.exact, "near": self.near}

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(self.terms)


@dataclass
class Hits:
    """Hits of a batch: text, term, whether misspelled, quoted, addressed; and the words of each text."""

    row: np.ndarray
    term: np.ndarray
    near: np.ndarray
    quoted: np.ndarray
    addressed: np.ndarray
    n_words: np.ndarray


def hits(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> Hits:
    """Whole words of whole texts against the automaton; a hit is quoted by marks around it in its line or by a reporting word near it."""
    w = read_words(data, offsets)
    term, away = automaton.match(w)
    hit = np.flatnonzero(term >= 0)
    quoted = _quoted(w, hit) | _cued(w, hit, 1)
    return Hits(w.row[hit], term[hit], away[hit] > 0, quoted, _cued(w, hit, 2) & ~quoted, np.bincount(w.row, minlength=len(offsets) - 1))


#: Evidence of a text: the strongest hit and all hits outside and inside quotations; the share of hits; addressed hits; length.
EVIDENCE = 7
#: What the evidence is held to weigh before any label is seen; quoted terms little.
PRIOR = np.array([1.0, 0.5, 0.1, 0.0, 0.2, 0.3, 0.2])


def weighed(found: Hits, lexicon: Lexicon, least: float = 0.0) -> np.ndarray:
    """EVIDENCE numbers for each text, from the hits whose weight is ``least`` or more."""
    n = len(found.n_words)
    out = np.zeros((n, EVIDENCE))
    weight = np.where(found.near, lexicon.near[found.term], lexicon.exact[found.term]) if len(found.term) else np.zeros(0)
    some = (weight >= least) & (weight > 0)
    direct = some & ~found.quoted
    for k, those in enumerate((direct, some & found.quoted)):
        np.maximum.at(out[:, 2 * k], found.row[those], weight[those])
        out[:, 2 * k + 1] = np.log1p(np.bincount(found.row[those], weight[those], n))
    out[:, 4] = np.log1p(100 * np.bincount(found.row[direct], minlength=n) / np.maximum(found.n_words, 1))
    out[:, 5] = np.log1p(np.bincount(found.row[direct & found.addressed], minlength=n))
    out[:, 6] = np.where(np.bincount(found.row[some], minlength=n) > 0, -np.log1p(found.n_words), 0)
    return out


def _quoted(w: Words, hit: np.ndarray, reach: int = 200) -> np.ndarray:
    """Whether an odd number of quotation marks stands before the hit in its line and the next mark is near."""
    marks = np.flatnonzero(np.isin(w.letters, _QUOTES))
    if not len(marks):
        return np.zeros(len(hit), bool)
    breaks = np.union1d(np.flatnonzero(w.letters == 10), w.offsets[:-1] - 1)
    at = w.start[hit]
    line = np.searchsorted(breaks, at)
    begin = breaks[line - 1]
    until = np.append(breaks, len(w.letters))[line]
    before = np.searchsorted(marks, at)
    after = np.append(marks, len(w.letters) + reach)[before]
    return ((before - np.searchsorted(marks, begin, "right")) % 2 == 1) & (after < np.minimum(until, at + reach))


def _cued(w: Words, hit: np.ndarray, kind: int) -> np.ndarray:
    """Whether a cue of a kind is among the REACH words before or the two after the hit, in the same text."""
    found = np.zeros(len(hit), bool)
    for d in (*range(-REACH, 0), 1, 2):
        at = hit + d
        inside = (at >= 0) & (at < len(w.row))
        inside[inside] &= w.row[at[inside]] == w.row[hit[inside]]
        short = np.flatnonzero(inside & ~found)
        short = short[(w.end - w.start)[at[short]] <= 10]
        said = np.array([_CUES.get(t) == kind for t in w.text(at[short])], bool)
        found[short[said]] = True
    return found


@dataclass
class ToxicityModel:
    """Terms with their weights, and the weights of the evidence; ``score`` is the probability of label 1."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.lexicon.terms:
            return np.full(len(offsets) - 1, sigmoid(np.array(self.bias)))
        return sigmoid(weighed(hits(self.lexicon.automaton, data, offsets), self.lexicon) @ self.weights + self.bias)

    def score(self, docs: DataFrame, name: str = "score", text: str = "text") -> DataFrame:
        """``docs`` with the score of each whole text in column ``name``, which is replaced if it is there.

        Null and empty texts hold no term and score as such texts do; rows that repeat score alike; very long texts are read
        whole; an empty table gives an empty result.
        """
        shared = docs.sparkSession.sparkContext.broadcast(self)  # a bounded number of terms
        docs = docs.drop(name)
        place = docs.columns.index(text)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text):
                yield pa.record_batch([*b.columns, pa.array(shared.value.probabilities(*utf8(b.column(place))))], [*b.schema.names, name])

        return map_batches(docs, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def sampled_words(sample: DataFrame) -> DataFrame:
    """``id``, ``label`` and the distinct ``words`` of three to twenty-four letters of each labelled text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = read_words(*utf8(b.column(1)))
            size = w.end - w.start
            fit = np.flatnonzero((size >= 3) & (size <= 24))
            found, cuts = w.text(fit), np.searchsorted(w.row[fit], np.arange(b.num_rows + 1)).tolist()
            yield pa.record_batch([b.column(0), b.column(2), pa.array([sorted(set(found[i:j])) for i, j in zip(cuts, cuts[1:])], pa.list_(pa.string()))], ["id", "label", "words"])

    return map_batches(sample, run, f"id {sample.schema['id'].dataType.simpleString()}, label int, words array<string>")


def half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(2))


def sketches(sample: DataFrame) -> DataFrame:
    """``id`` and three least hashes of each text's five-word shingles; null without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            joined, start, end, row = shingles(*utf8(b.column(1)), 5)
            h = SpanHash(np.frombuffer(joined, np.uint8))(start, end)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
            made = []
            for k in range(3):
                least = np.zeros(b.num_rows, np.uint64)
                if len(h):
                    least[row[first]] = np.minimum.reduceat(scramble(h + np.uint64(k + 1)), first)
                made.append(pa.array(least.view(np.int64), mask=np.bincount(row, minlength=b.num_rows) == 0))
            yield pa.record_batch([b.column(0), *made], ["id", "m0", "m1", "m2"])

    return map_batches(sample.select("id", "text"), run, f"id {sample.schema['id'].dataType.simpleString()}, m0 long, m1 long, m2 long")


def with_votes(sample: DataFrame) -> DataFrame:
    """``sample`` with its ``half`` and ``vote``. Texts that share a least hash of their shingles are near copies and share one vote, so that the words of a much copied toxic text do not pass for terms."""
    votes = sketch = cut(sketches(sample))
    for k in range(3):  # a sample of bounded size: its groups are sent, not shuffled, however large one of them is
        votes = votes.join(F.broadcast(sketch.groupBy(f"m{k}").agg(F.count("*").alias(f"n{k}"))), f"m{k}", "left")
    votes = votes.select("id", (1 / F.greatest(F.lit(1), "n0", "n1", "n2")).alias("vote"))
    return cut(sample.join(F.broadcast(votes), "id").withColumn("half", half(F.col("id"))))  # votes: a row each of a bounded sample


def _cells() -> list[Column]:
    """Votes of toxic texts of either half, then of the others."""
    return [F.sum(F.when((F.col("label") == label) & (F.col("half") == h), F.col("vote")).otherwise(0.0)).alias(f"c{label}{h}") for label in (1, 0) for h in (0, 1)]


def candidates(sample: DataFrame, terms: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The likeliest ``terms`` words, their votes (see :func:`_cells`) and those of all texts."""
    totals = np.array([x or 0.0 for x in sample.agg(*_cells()).first()])
    words = sampled_words(sample).join(F.broadcast(sample.select("id", "half", "vote")), "id")
    counts = words.select("label", "half", "vote", F.explode("words").alias("word")).groupBy("word").agg(*_cells())
    toxic, other = F.col("c10") + F.col("c11"), F.col("c00") + F.col("c01")
    low = F.log((toxic + 0.5) / (other + 0.5)) - 1.64 * F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    rows = counts.filter(toxic >= max(1.5, 0.003 * totals[:2].sum())).orderBy(F.desc(F.round(low, 9)), "word").limit(terms).collect()
    return [r.word for r in rows], np.array([list(r)[1:] for r in rows]).reshape(-1, 4), totals


def near_votes(sample: DataFrame, words: list[str]) -> np.ndarray:
    """Votes of the texts that hold each word misspelled."""
    shared = sample.sparkSession.sparkContext.broadcast(Lexicon(words, np.ones(len(words)), np.ones(len(words))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = hits(shared.value.automaton, *utf8(b.column(0)))
            row, term = np.divmod(np.unique(found.row[found.near] * len(words) + found.term[found.near]), len(words))
            yield pa.record_batch([pa.array(term), *(b.column(k).take(pa.array(row)) for k in (1, 2, 3))], ["term", "label", "half", "vote"])

    out = np.zeros((len(words), 4))
    for r in map_batches(sample.select("text", "label", "half", "vote"), run, "term long, label int, half long, vote double").groupBy("term").agg(*_cells()).collect():
        out[r.term] = list(r)[1:]
    return out


def lexicon_of(words: list[str], votes: np.ndarray, near: np.ndarray, totals: np.ndarray, halves: list[int], misspelled: float = 0.05) -> Lexicon:
    """Weights from the votes of some halves: the lower bound of the log of how much higher the odds of a toxic text are.

    A misspelled hit weighs three quarters of one as written where no other text holds a word as near. Where some do, it is
    taken to come from a toxic text for at least a share ``misspelled`` of the hits as written, which is then hardly evidence.
    """
    toxic, other = (votes[:, [h + k for h in halves]].sum(axis=1) for k in (0, 2))
    base = np.log((totals[[2 + h for h in halves]].sum() + 1) / (totals[halves].sum() + 1))

    def low(t: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(np.log((t + 0.5) / (n + 0.5)) + base - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5)), 0)

    exact = np.where(toxic >= 1.5, low(toxic, other), 0)
    near_toxic, near_other = (near[:, [h + k for h in halves]].sum(axis=1) for k in (0, 2))
    return Lexicon(words, exact, np.minimum(0.75 * exact, np.where(near_other > 0, low(near_toxic + misspelled * toxic, near_other), np.inf)))


def regress(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's steps, its weights drawn to ``prior`` and kept from falling below zero."""
    theta = np.append(prior, np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    pull = np.append(np.full(len(prior), strength), 1e-3)
    z, anchor = np.column_stack([x, np.ones(len(x))]), np.append(prior, theta[-1])
    for _ in range(60):
        p = sigmoid(z @ theta)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * (theta - anchor))
        theta = theta - np.clip(step, -1, 1)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return theta[:-1], float(theta[-1])


#: Weights below which a hit is no evidence; the labelled rows choose among them.
LEAST = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, terms: int = 512, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """At most ``terms`` terms and the weights of the evidence, from at most ``most`` labelled rows outside the held-out fold.

    The evidence of one half of the rows is gathered with weights from the other, so it weighs as it will in unseen texts.
    Without two labelled rows of either kind every text scores the smoothed share of label 1.
    """
    sample = cut(labelled_sample(docs, labels, most, label, doc_id, text))
    kinds = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    positive, negative = kinds.get(1, 0), kinds.get(0, 0)
    words: list[str] = []
    if min(positive, negative) >= 2:
        sample = with_votes(sample)
        words, votes, totals = candidates(sample, terms)
    if not words:
        p = (positive + 1) / (positive + negative + 2)
        return ToxicityModel(Lexicon([], np.zeros(0), np.zeros(0)), np.zeros(EVIDENCE), float(np.log(p / (1 - p))))
    near = near_votes(sample, words)
    crossed = docs.sparkSession.sparkContext.broadcast([lexicon_of(words, votes, near, totals, [1 - h]) for h in (0, 1)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, which = hits(crossed.value[0].automaton, *utf8(b.column(0))), b.column(1).to_numpy()
            x = np.stack([np.where(which[:, None] == 0, *(weighed(found, x, least) for x in crossed.value)) for least in LEAST], axis=1)
            yield pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary()), b.column(2)], ["x", "label"])

    rows = sorted((bytes(r.x), r.label) for r in map_batches(sample.select("text", "half", "label"), run, "x binary, label int").collect())
    x, y = np.frombuffer(b"".join(r[0] for r in rows)).reshape(-1, len(LEAST), EVIDENCE), np.array([r[1] for r in rows], float)
    fits = [regress(x[:, k], y, PRIOR) for k in range(len(LEAST))]
    k = min(range(len(LEAST)), key=lambda k: log_loss(sigmoid(x[:, k] @ fits[k][0] + fits[k][1]), y))
    whole = lexicon_of(words, votes, near, totals, [0, 1])
    kept = [i for i in np.argsort(-whole.exact, kind="stable").tolist() if whole.exact[i] >= LEAST[k]]
    return ToxicityModel(Lexicon([words[i] for i in kept], whole.exact[kept], np.where(whole.near >= LEAST[k], whole.near, 0)[kept]), *fits[k])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the same columns; see :func:`fit` and :meth:`ToxicityModel.score`."""
    name = fresh(docs, "toxic")
    return fit(docs, labels, doc_id=doc_id, text=text).score(docs, name, text).filter(F.col(name) < threshold).drop(name)

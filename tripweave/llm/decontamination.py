"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every training passage."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
SHINGLE = 5
SIMILARITY = 0.8
PART_OVERLAP = 0.5
ANSWER_SHARE = 0.25
#: Items whose posting blocks share one maximum, and items of one index; more items make more indexes.
BLOCK, INDEX_ITEMS = 4, 4096
SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
#: Bounds kept at once; with them the words of as many passages are held.
CELLS = 400_000
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingles(words: Sequence[str]) -> list[tuple[str, ...]]:
    """All runs of SHINGLE words; a shorter sequence is one shingle."""
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


class Corpus:
    """What BM25 takes from all items: their number, mean length, and how many hold each word."""

    def __init__(self) -> None:
        self.n, self.length, self.holding = 0, 0, Counter()

    def add(self, text: str | None) -> None:
        words = words_of(text)
        if words:
            self.n, self.length = self.n + 1, self.length + len(words)
            self.holding.update(set(words))

    @classmethod
    def of(cls, items: Iterable[tuple[int, str | None]]) -> Corpus:
        out = cls()
        for _, text in items:
            out.add(text)
        return out

    @property
    def mean(self) -> float:
        return self.length / max(1, self.n)

    def idf(self, word: str) -> float:
        return float(np.log(1 + (self.n - self.holding[word] + 0.5) / (self.holding[word] + 0.5)))


class Index:
    """BM25 postings of some items. Weights are divided by the item's threshold, so 1 is enough.

    The threshold of an item is the least score of a passage that holds SIMILARITY of its
    shingles: every missing word breaks a shingle, so at most as many words are missing as
    shingles may be, and at worst those of the largest weights. Nothing above it is lost.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], corpus: Corpus | None = None):
        """``corpus``: statistics of all items, when these are a part of them."""
        items = list(items)
        corpus = corpus or Corpus.of(items)
        pairs = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.ids, self.words = [i for i, _ in pairs], [w for _, w in pairs]
        counts = [Counter(w) for w in self.words]
        found = {t for c in counts for t in c}
        self.vocabulary = {t: k for k, t in enumerate(sorted(found))}
        n = len(pairs)
        postings: list[list[tuple[int, float]]] = [[] for _ in found]
        self.longest = max(map(len, self.words), default=1)
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(self.words[i]) / corpus.mean)
            weights = {t: corpus.idf(t) * tf * (K1 + 1) / (tf + norm) for t, tf in c.items()}
            spare = int((1 - SIMILARITY) * len(shingles(self.words[i])) + 1e-9)
            least = sum(weights.values()) - sum(sorted(weights.values(), reverse=True)[:spare])
            for t, w in weights.items():
                postings[self.vocabulary[t]].append((i, w / (least * (1 - 1e-9))))
        self.items = [[i for i, _ in p] for p in postings]
        self.weights = [[w for _, w in p] for p in postings]
        self.most = [max(w) for w in self.weights]
        self.block_most: list[dict[int, float]] = []
        for p in postings:
            tops: dict[int, float] = {}
            for i, w in p:
                tops[i // BLOCK] = max(tops.get(i // BLOCK, 0.0), w)
            self.block_most.append(tops)
        self.blocks = -(-n // BLOCK)
        self.parts = [self._parts(w) for w in self.words]
        self._lay_out(n)

    @staticmethod
    def _parts(words: list[str]) -> tuple[set, set, set]:
        """Shingles of the item, of its question and of its answer (the last ANSWER_SHARE of the words)."""
        every = shingles(words)
        cut = max(1, int(len(every) * (1 - ANSWER_SHARE)))
        return set(every), set(every[:cut]), set(every[cut:]) or set(every)

    def _lay_out(self, n: int) -> None:
        """Block maxima as arrays. Terms in over a tenth of the items are not looked up: their
        maxima count as present in every passage."""
        common = [len(p) > max(2, n // 10) for p in self.items]
        self.always = np.zeros(self.blocks)
        starts, blocks, tops = [0], [], []
        for k, maxima in enumerate(self.block_most):
            if common[k]:
                for b, w in maxima.items():
                    self.always[b] += w
            else:
                blocks += maxima.keys()
                tops += maxima.values()
            starts.append(len(blocks))
        self.looked_up = np.append(~np.array(common, bool), False)
        self.starts, self.at, self.top = np.array(starts), np.array(blocks, np.int64), np.array(tops)

    def search(self, terms: Iterable[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, weight) that reach 1 for a passage with these terms."""
        cursors = [[self.items[t][0], 0, t] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) >= 1:
                if cursors[0][0] == item:
                    weight = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if weight >= 1:
                        out.append((item, weight))
                    goal = item + 1
                else:
                    goal = item
            else:  # no item up to the end of the block, or to the next cursor, can reach 1
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
            kept = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < goal:
                    own = self.items[c[2]]
                    c[1] = bisect.bisect_left(own, goal, c[1])
                    if c[1] == len(own):
                        continue
                    c[0] = own[c[1]]
                kept.append(c)
            cursors = kept
        return out

    def verify(self, item: int, passage: Sequence[str]) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles in the passage."""
        size = min(SHINGLE, len(self.words[item]))
        held = set(zip(*(passage[i:] for i in range(size))))
        return tuple(len(part & held) / len(part) for part in self.parts[item])

    def leaks(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(row, item_id, score, overlap, question overlap, answer overlap) of each item found in a text.

        A passage is two neighbouring steps of as many words as the longest item has, so
        an occurrence lies whole in some passage. The block maxima of all passages are summed
        at once; only passages with a block that reaches 1 are searched.
        """
        step = max(32, self.longest)
        rows: list[tuple[int, list[str], np.ndarray, int]] = []
        halves = 0
        for row, text in enumerate(texts):
            words = words_of(text)
            if words and self.ids:
                ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
                rows.append((row, words, ids, halves))
                halves += -(-len(words) // step) + 1  # one empty step between texts
            if halves * self.blocks > CELLS:
                yield from self._passages(rows, halves, step)
                rows, halves = [], 0
        if rows:
            yield from self._passages(rows, halves, step)

    def _passages(self, rows: list, halves: int, step: int) -> Iterator[tuple[int, int, float, float, float, float]]:
        v = len(self.vocabulary)
        every = np.concatenate([ids for _, _, ids, _ in rows])
        lengths = np.array([len(ids) for _, _, ids, _ in rows])
        begins = np.cumsum(lengths) - lengths
        at = np.flatnonzero(self.looked_up[every])  # the last entry stands for words of no item
        row = np.searchsorted(begins, at, side="right") - 1
        keys = ((at - begins[row]) // step + np.array([first for *_, first in rows])[row]) * v + every[at]
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        half, term = keys // v, keys % v
        size = self.starts[term + 1] - self.starts[term]
        spot = np.repeat(self.starts[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        bound = np.bincount(np.repeat(half, size) * self.blocks + self.at[spot], self.top[spot], (halves + 1) * self.blocks)
        bound = bound.reshape(halves + 1, self.blocks)
        open_passages = np.flatnonzero(((bound[:-1] + bound[1:] + self.always) >= 1).any(axis=1))
        firsts = [first for _, _, _, first in rows]
        best: dict[tuple[int, int], tuple] = {}
        for passage in open_passages.tolist():
            row, words, ids, first = rows[bisect.bisect_right(firsts, passage) - 1]
            lo = (passage - first) * step
            terms = set(ids[lo : lo + 2 * step].tolist()) - {-1}
            for item, weight in self.search(terms):
                overlap, question, answer = self.verify(item, words[lo : lo + 2 * step])
                if overlap >= SIMILARITY and min(question, answer) >= PART_OVERLAP:
                    found = (overlap, weight, question, answer)
                    best[row, item] = max(best.get((row, item), found), found)
        for (row, item), (overlap, weight, question, answer) in best.items():
            yield row, self.ids[item], float(weight), overlap, question, answer


def indexes(items: DataFrame, size: int = INDEX_ITEMS) -> list[Index]:
    """Indexes of at most ``size`` items each; every one is built and sent to the tasks by itself. Scores
    do not depend on the cut: word statistics are those of all items."""
    clean = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    corpus = Corpus()
    for r in clean.toLocalIterator():
        corpus.add(r["text"])
    out, part = [], []
    for r in clean.toLocalIterator():
        part.append((r["item_id"], r["text"]))
        if len(part) == size:
            out.append(Index(part, corpus))
            part = []
    return out + [Index(part, corpus)] if part or not out else out


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds, with the best passage's figures.

    ``docs`` has doc_id and text, ``items`` item_id and text. A passage holds an item if it has
    SIMILARITY of the item's five-word shingles (lower case, marks ignored), and PART_OVERLAP of
    its question's and of its answer's, the answer being the last quarter. ``score`` is BM25 in
    parts of the item's threshold. Null and wordless texts and items give nothing; so do items
    without an id. Documents without an id are judged and named null. Repeated rows repeat
    their leaks; items with equal text are found each. Extra columns are ignored.
    """
    result = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in indexes(items):

        def judged(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0), list(index.leaks(batch.column(1).to_pylist()))
                row, *rest = zip(*rows) if rows else [[]] * 6
                columns = [ids.take(pa.array(row, pa.int64())), pa.array(rest[0], pa.int64()), *(pa.array(c, pa.float64()) for c in rest[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = texts.mapInArrow(judged, SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result


def drop_leaking(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, columns as they came and with any name.

    Judged as in ``find_leaks``: null, empty and wordless texts hold nothing and stay, repeated rows stay or
    go together, and without items all stay.
    """
    for index in indexes(items):
        docs = docs.filter(_clean(index)(docs["text"]))
    return docs


def _clean(index: Index) -> Callable[[Column], Column]:
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        out[[row for row, *_ in index.leaks(texts.tolist())]] = False
        return pd.Series(out)

    return clean

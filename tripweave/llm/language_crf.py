"""Language of words and texts: a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents of each language used for the fit, those with the smallest hashes of doc_id.
SAMPLE = 100
ROUNDS, RATE, L2 = 30, 0.2, 1e-4
#: Features are hashed into 2^BUCKET_BITS weights. One must occur in this many different words; the
#: lexicon (features of kind LEXICON) takes words that occur this often.
BUCKET_BITS, MIN_WORDS, MIN_TIMES, LEXICON = 18, 2, 5, 40
#: Training texts are cut into sequences of at most this many words.
CUT = 300
#: Words handled together, and different words whose weights a worker remembers.
GROUP_WORDS, REMEMBERED = 1_500_000, 400_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if the text has no letter."""
    words = LETTERS.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _spread(kind: int, value: np.ndarray) -> np.ndarray:
    """Bucket of each feature: a hash of its kind and content."""
    x = (value + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of every word: affixes of 1 to 3 letters, letter pairs
    and triples, and the word itself for the lexicon."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    number = np.repeat(np.arange(len(words)), sizes)
    left = ends[number] - np.arange(len(c))  # letters from here to the end of the word
    shift = np.uint64(21)
    gram = c
    owners, buckets = [], []
    for k in (1, 2, 3):
        if k > 1:
            gram = (gram[:-1] << shift) | c[k - 1 :]
            inside = np.flatnonzero(left[: len(gram)] >= k)
            owners.append(number[inside])
            buckets.append(_spread(k, gram[inside]))
        long = np.flatnonzero(sizes >= k)
        owners += [long, long]
        buckets += [_spread(10 + k, gram[starts[long]]), _spread(20 + k, gram[ends[long] - k])]
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
    whole = np.add.reduceat((c + np.uint64(1)) * powers[np.arange(len(c)) - starts[number]], starts) if len(c) else c
    owners.append(np.arange(len(words)))
    buckets.append(_spread(LEXICON, whole))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (buckets, labels)
    moves: np.ndarray  # (labels, labels), log
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: list[np.ndarray] = field(default_factory=list, repr=False)
    _new: list[str] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_rows": [], "_new": []}

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """exp(score) of each word and label, the largest of a word being 1."""
        owner, bucket = features(words)
        return _emit(owner, bucket, self.weights, len(words))

    def ids(self, words: Sequence[str]) -> np.ndarray:
        """A number for each word; new words get theirs, and their weights with the next table()."""
        known = self._known
        out = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            if (at := known.get(w)) is None:
                at = known[w] = len(known)
                self._new.append(w)
            out[i] = at
        return out

    def table(self) -> np.ndarray:
        if self._new:
            self._rows = [np.concatenate([*self._rows, self.emissions(self._new)])]
            self._new = []
        return self._rows[0]

    def forget(self) -> None:
        if len(self._known) > REMEMBERED:
            self._known, self._rows, self._new = {}, [], []


def _emit(owner: np.ndarray, bucket: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    scores = np.stack([np.bincount(owner, column[bucket], n) for column in weights.T.copy()], axis=1)
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60)).astype(np.float32)


def forward_backward(emit: np.ndarray, ids: np.ndarray, lengths: np.ndarray, moves: np.ndarray, details: bool = False):
    """Label marginals summed over each sequence, (sequences, labels); with ``details`` also the
    marginals of each word and the expected moves. Sequences stand end to end in ``ids``; all
    advance together, longest first, so a step is a few array operations."""
    k = moves.shape[0]
    step = np.exp(moves - moves.max()).astype(np.float32)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, size = starts[order], lengths[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    ahead = np.empty((len(ids), k), np.float32)
    state = np.full((k, len(size)), 1 / k, np.float32)  # labels first: sums over labels are row sums
    for t in range(longest):
        n = active[t]
        at = start[:n] + t
        state = (step.T @ state[:, :n] if t else state[:, :n]) * emit[ids[at]].T
        state /= state.sum(axis=0)
        ahead[at] = state.T
    total = np.zeros((k, len(size)))
    words = np.empty((len(ids), k), np.float32) if details else None
    moved = np.zeros((k, k))
    behind = np.full((k, len(size)), 1 / k, np.float32)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        here = ahead[at].T
        if t + 1 < longest and (m := active[t + 1]):
            later = emit[ids[start[:m] + t + 1]].T * behind[:, :m]
            back = step @ later
            if details:
                moved += step * ((here[:, :m] / (here[:, :m] * back).sum(axis=0)) @ later.T)
            behind[:, :m] = back / back.sum(axis=0)
        share = here * behind[:, :n]
        share /= share.sum(axis=0)
        total[:, :n] += share
        if details:
            words[at] = share.T
    total = total.T
    out = np.empty_like(total)
    out[order] = total
    return (out, words, moved) if details else out


def switched(texts: list[list[str]], gold: list[int], rng: np.random.Generator) -> tuple[list[list[str]], list[np.ndarray]]:
    """Training sequences: the texts, and as many words again spliced from pieces of 3 to 40 words of
    all texts in random order, so that moves between languages are seen."""
    cut = [(t[at : at + CUT], g) for t, g in zip(texts, gold) for at in range(0, len(t), CUT)]
    sequences, labels = [t for t, _ in cut], [np.full(len(t), g) for t, g in cut]
    pieces = []
    for t, g in zip(texts, gold):
        at = 0
        while at < len(t):
            n = int(rng.integers(3, 41))
            pieces.append((t[at : at + n], g))
            at += n
    order = rng.permutation(len(pieces))
    for lo in range(0, len(order), 12):
        part = [pieces[i] for i in order[lo : lo + 12]]
        sequences.append([w for p, _ in part for w in p])
        labels.append(np.concatenate([np.full(len(p), g) for p, g in part]))
    return sequences, labels


def fit_crf(texts: Sequence[str | None], langs: Sequence[str], rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Maximise the conditional likelihood of the words' labels by Adam steps on the whole sample.
    Without a usable text the model knows no language."""
    pairs = [(w, g) for w, g in ((words_of(t), g) for t, g in zip(texts, langs)) if w]
    labels = sorted({g for _, g in pairs})
    number = {g: i for i, g in enumerate(labels)}
    sequences, gold = switched([w for w, _ in pairs], [number[g] for _, g in pairs], np.random.default_rng(7)) if pairs else ([], [])
    times = Counter(w for s in sequences for w in s)
    unique = {w: i for i, w in enumerate(sorted(times))}
    model = Model(labels, np.zeros((1 << BUCKET_BITS, len(labels))), np.zeros((len(labels), len(labels))))
    if len(labels) < 2:
        return model
    owner, flat = features(list(unique))
    lexical = np.arange(len(flat)) >= len(flat) - len(unique)  # the words themselves come last
    often = np.array([times[w] for w in unique]) >= MIN_TIMES
    support = np.bincount(flat, minlength=1 << BUCKET_BITS)
    use = np.where(lexical, often[owner], support[flat] >= MIN_WORDS)
    owner, flat = owner[use], flat[use]
    used, flat = np.unique(flat, return_inverse=True)
    weights = np.zeros((len(used), len(labels)))
    ids = np.concatenate([[unique[w] for w in s] for s in sequences])
    truth, lengths = np.concatenate(gold), np.array([len(s) for s in sequences])
    k = len(labels)
    follows = np.ones(len(ids), bool)
    follows[np.cumsum(lengths) - lengths] = False
    later = np.flatnonzero(follows)
    seen = np.bincount(truth[later - 1] * k + truth[later], minlength=k * k).reshape(k, k)
    wanted = np.stack([np.bincount(ids, truth == c, len(unique)) for c in range(k)], axis=1)
    n = len(ids)
    params = [weights, model.moves]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for r in range(1, rounds + 1):
        emit = _emit(owner, flat, weights, len(unique))
        _, share, moved = forward_backward(emit, ids, lengths, model.moves, details=True)
        found = np.stack([np.bincount(ids, share[:, c], len(unique)) for c in range(k)], axis=1)
        gap = (wanted - found) / n
        slopes = [np.stack([np.bincount(flat, gap[owner, c], len(used)) for c in range(k)], axis=1) - L2 * weights, (seen - moved) / n - L2 * model.moves]
        for p, g, (m, v) in zip(params, slopes, memory):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    model.weights[used] = weights
    return model


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each language among those where ``learn`` holds, with
    their whole texts. Rows without text, language or id are not used."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learn)
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("_place", place).filter(F.col("_place") <= sample).drop("_place")
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    both = (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), both).filter("text is not null")
    table = rows.select("doc_id", "lang", "text").distinct().toPandas().sort_values(["doc_id", "lang", "text"])
    return fit_crf(table["text"].tolist(), table["lang"].tolist())


def identify(texts: Sequence[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and share of the marginal mass of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.labels:
        return langs, scores
    rows: list[int] = []
    parts: list[np.ndarray] = []
    waiting = 0

    def settle() -> None:
        nonlocal waiting
        if rows:
            lengths = np.array([len(p) for p in parts])
            mass = forward_backward(model.table(), np.concatenate(parts), lengths, model.moves)
            for row, m, n in zip(rows, mass, lengths):
                best = int(m.argmax())
                langs[row], scores[row] = model.labels[best], float(min(1.0, m[best] / n))
        rows.clear()
        parts.clear()
        waiting = 0
        model.forget()

    for row, text in enumerate(texts):
        if words := words_of(text):
            rows.append(row)
            parts.append(model.ids(words))
            waiting += len(words)
        if waiting > GROUP_WORDS or len(model._known) > REMEMBERED:
            settle()
    settle()
    return langs, scores


def predict(docs: DataFrame, model: Model, keep: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) of every row; only ``text`` is looked at.

    The label with the largest sum of word marginals, and its share. Null texts and texts without a
    letter give ``und`` and 0. Null ids and repeated rows stay as they are; extra columns are ignored.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    schema = kept.drop("text").schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = identify(batch.column(batch.num_columns - 1).to_pylist(), sent.value)
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def word_runs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first, last, lang): the runs of words of one language in each text, by the best label
    of each word; words are numbered from 0 as ``words_of`` gives them. Texts without words give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text) if model.labels else []
                if not words:
                    continue
                ids = model.ids(words)
                _, share, _ = forward_backward(model.table(), ids, np.array([len(words)]), model.moves, details=True)
                best = share.argmax(axis=1)
                cuts = np.flatnonzero(np.append(True, best[1:] != best[:-1])).tolist() + [len(best)]
                out += [(doc_id, a, b - 1, model.labels[best[a]]) for a, b in zip(cuts, cuts[1:])]
                model.forget()
            yield pd.DataFrame(out, columns=["doc_id", "first", "last", "lang"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, first long, last long, lang string")

"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most this many labelled rows are used for the fit, those with the smallest hashes.
SAMPLE = 20_000
TREES, TREE_DEPTH, BINS, RATE, MIN_HESSIAN, L2 = 60, 4, 64, 0.15, 5.0, 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "sentence_marks", "other_marks", "wide", "mean_word", "longest_word",
    "distinct_words", "top_word", "same_as_before", "marked_words", "single_letters", "log_lines", "distinct_lines", "mean_line", "longest_line",
)
LOWER, UPPER_CASE, DIGIT, SPACE, SENTENCE, MARK, WIDE = range(7)


def _classes() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = LOWER
    kinds[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = UPPER_CASE
    kinds[[ord(c) for c in "0123456789"]] = DIGIT
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[[ord(c) for c in ".,;:?'\"-()"]] = SENTENCE
    kinds[128:] = WIDE
    return kinds


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one whole text; all 0 for a null or empty one."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = CLASSES[np.frombuffer(raw, np.uint8)]
    share = np.bincount(kinds, minlength=7) / n
    inside = np.zeros(n + 2, np.int8)
    np.not_equal(kinds, SPACE, out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2] - 1  # of each word
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    counts = Counter(words)
    longest = int((last - first).max()) + 1 if words else 0
    return [
        np.log1p(n), np.log1p(len(words)), share[LOWER], share[UPPER_CASE], share[DIGIT], share[SPACE], share[SENTENCE], share[MARK], share[WIDE],
        (n * (1 - share[SPACE])) / k, np.log1p(longest), len(counts) / k, max(counts.values(), default=0) / k,
        sum(map(eq, words, words[1:])) / k, np.count_nonzero(kinds[last] == MARK) / k, np.count_nonzero(first == last) / k,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(max(map(len, lines))),
    ]


def statistics_table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Complete binary trees of one depth in flat arrays: node i has children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); rows above go right
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for the log loss. Each level sums gradients per (node, bin) and splits each
    node at its best border. No row, or labels of one kind only, give a constant score."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return none
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T)], axis=1)
    margin = np.full(len(y), base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        cut = np.full(inner, bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(width, 1e-9)
            for f, border in enumerate(borders):
                if not len(border):
                    continue
                slot = at * bins + binned[:, f]
                gs = np.bincount(slot, g, width * bins).reshape(width, bins)
                hs = np.bincount(slot, h, width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(1)[:, : len(border)], hs.cumsum(1)[:, : len(border)]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < MIN_HESSIAN) | (ht - hl < MIN_HESSIAN)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best):
                    best[i] = top[i]
                    feature[first + i], cut[first + i], threshold[first + i] = f, k[i], border[k[i]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += value[leaf]
        out.append((feature, threshold, value))
    f, t, v = (np.stack(parts) for parts in zip(*out))
    return Trees(base, f, t, v)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents: those with the smallest hashes of doc_id.

    ``labels`` has doc_id and quality; ``learn`` is a condition on doc_id. Only the statistics
    of the sampled documents reach the driver. Repeated labels of an id count once, the largest.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def measured(batches):
        for batch in batches:
            table = pd.DataFrame(statistics_table(batch["text"]), columns=list(FEATURES))
            table.insert(0, "_label", batch["_label"].to_numpy())
            table.insert(0, "_id", batch["_id"].to_numpy())
            yield table

    columns = ", ".join(f"{c} double" for c in FEATURES)
    rows = texts.select("_id", "_label", "text").mapInPandas(measured, f"_id long, _label int, {columns}").toPandas()
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    return fit_trees(rows[list(FEATURES)].to_numpy(np.float64), (rows["_label"] > 0).to_numpy(np.float64))


def scorer(model: Trees) -> Callable[[Column], Column]:
    """A column function: probability of label 1 of a whole text; null and empty texts too."""

    @F.pandas_udf(T.DoubleType())
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics_table(texts)), dtype="float64")

    return quality


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is ``threshold`` or more, columns as they came."""
    return docs.filter(scorer(model)(docs["text"]) >= threshold)

"""Token counts by section: each document is encoded once and its token spans joined to the sections."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Who gets a token that crosses a border: the section with its first byte, with its last, with most
#: of its bytes (the earlier on a tie), or each section its share of the bytes.
RULES = ("first", "last", "most", "split")
SCHEMA = "doc_id long, section int, start long, end long, n_bytes long, tokens double, crossing long, doc_tokens long"
Sections = Callable[[str], Sequence[tuple[int, int]]]


def lines(text: str) -> list[tuple[int, int]]:
    """Sections of a text: its lines, each with its line feed, as (start, end) in characters."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


class Encoder:
    """A byte-level BPE vocabulary: base64 token and rank a line."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def borders(self, text: str) -> np.ndarray:
        """Byte offset of each token's start and, last, of the end of the text."""
        ids = np.array(self.encode(text), np.int64)
        return np.concatenate([[0], np.cumsum(self.sizes[ids])]) if len(ids) else np.zeros(1, np.int64)


def byte_offsets(raw: np.ndarray) -> np.ndarray:
    """Byte offset of each character of UTF-8 bytes and, last, of their end."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def character_spans(text: str, borders: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in characters of each token; a token with part of a character has all of it."""
    starts = byte_offsets(np.frombuffer(text.encode(), np.uint8))
    first = np.searchsorted(starts, borders[:-1], side="right") - 1
    last = np.searchsorted(starts, borders[1:] - 1, side="right")
    return list(zip(first.tolist(), last.tolist()))


def allocate(borders: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section and how many of them cross one of its borders, and the tokens outside all.

    ``begins`` and ``ends`` are byte offsets of sections that do not overlap, ascending. The
    interval join: a section holds the tokens between two binary searches whole; only the tokens
    at its two borders are cut into pieces (in one section, or outside), and the rule turns the
    pieces into owners.
    """
    k, n = len(begins), len(borders) - 1
    if n < 1 or not k:
        return np.zeros(k), np.zeros(k, np.int64), float(max(n, 0))
    low = np.searchsorted(borders, begins, side="left")  # first token that starts in the section
    high = np.searchsorted(borders, ends, side="right") - 1  # first token that ends after it
    counts, crossing = np.maximum(high - low, 0).astype(np.float64), np.zeros(k, np.int64)
    inside = int(counts.sum())
    cut = {t for t in (low - 1).tolist() if t >= 0 and t < n} | {t for t in high.tolist() if t < n}
    first, last = begins.tolist(), ends.tolist()
    outside, crossed = 0.0, 0
    for t in sorted(cut):
        lo, hi = int(borders[t]), int(borders[t + 1])
        j = max(0, bisect.bisect_right(first, lo) - 1)
        pieces, at = [], lo  # (bytes, owner); k: outside
        while at < hi:
            if j < k and last[j] <= at:
                j += 1
            elif j < k and first[j] <= at:
                pieces.append((min(hi, last[j]) - at, j))
                at += pieces[-1][0]
            else:
                end = min(hi, first[j]) if j < k else hi
                pieces.append((end - at, k))
                at = end
        if len(pieces) == 1:
            continue  # whole in a section or outside all
        crossed += 1
        for j in {p[1] for p in pieces if p[1] < k}:
            crossing[j] += 1
        if rule == "split":
            shares = [(size / (hi - lo), j) for size, j in pieces]
        else:
            shares = [(1.0, pieces[0][1] if rule == "first" else pieces[-1][1] if rule == "last" else max(pieces, key=lambda p: p[0])[1])]
        for share, j in shares:
            if j < k:
                counts[j] += share
            else:
                outside += share
    return counts, crossing, outside + n - inside - crossed


def tokens_by_section(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, sections: Sections = lines, rule: str = "most",
) -> DataFrame:
    """(doc_id, section, start, end, n_bytes, tokens, crossing, doc_tokens): a row a section, in order.

    ``sections`` gives a text's sections as (start, end) in characters, ascending and not
    overlapping; ``start``, ``end`` repeat them. Tokens outside all sections come as section
    null. The rule is one of RULES; with any of them a document's rows add up to ``doc_tokens``.
    ``crossing`` counts the tokens with a part in the section and a part elsewhere. A null or
    empty text has one row: section null, no token. Null ids and repeated rows stay as they are.
    Extra columns are ignored. An empty table gives an empty one.

    The driver reads the vocabulary file (a fixed, small size) and sends it to the tasks.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    content, pattern = _read(docs.sparkSession, vocabulary), pattern or _pattern()
    sent = docs.sparkSession.sparkContext.broadcast((content, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                borders, parts = encoder.borders(text), list(sections(text))
                at = byte_offsets(np.frombuffer(text.encode(), np.uint8))
                spans = np.array(parts, np.int64).reshape(-1, 2)
                begins, ends = at[spans[:, 0]], at[spans[:, 1]]
                counts, crossing, outside = allocate(borders, begins, ends, rule)
                k, total = len(parts), len(borders) - 1
                rows = [range(k), spans[:, 0].tolist(), spans[:, 1].tolist(), (ends - begins).tolist(), counts.tolist(), crossing.tolist()]
                if outside or not k:
                    rows = [[*r, x] for r, x in zip(rows, (None, None, None, None, outside, 0))]
                    k += 1
                for column, more in zip(out, ([doc_id] * k, *rows, [total] * k)):
                    column.extend(more)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _read(spark: SparkSession, path: str) -> bytes:
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()

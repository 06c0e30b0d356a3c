"""Phrase collocations by set-oriented mining (SETM) over sorted occurrence relations.

The relation of length k holds, for every chunk of whole documents, the frequent phrase of k words
that starts at each position, sorted by piece and position and stored. Neighbouring positions of
a piece are merge-joined into candidates of k + 1 words; they are counted in each chunk, then over
all chunks; and the chunk's relation is semi-joined with the frequent ones before the next length.
A chunk is a row: its positions are an array of slots in a table of phrase numbers, with a gap at
every border of a piece, so that neighbours in the array are neighbours in a piece.

Candidates are shuffled once, by buckets of their hash: a row holds those of one chunk in one bucket,
packed. The bucket sums them, numbers the frequent ones and answers each row with their numbers in the
row's own order, so that the semi-join sends back numbers only; the chunk makes its order again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.llm.common import n_parts, stored
from tripweave.session import release, scratch_scope

#: Words of one chunk; a document is never split.
CHUNK = 400_000
#: Words of the corpus for each bucket; a bucket has at most as many candidates, and is counted in one task.
BUCKET = 1 << 21
LONGEST, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer one that contains it has this share of its count or more, as a fraction.
WITHIN = (50, 100)
#: A score of 1 means that the two parts of a phrase occur nowhere else.
SCALE = 1_000_000
NO_LANG = "und"
BORDERS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
PLAIN = bytes.maketrans(UPPER + BORDERS + b"\t", LOWER + b"." * len(BORDERS) + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in order, A-Z lower-cased; ``.`` stands for every border of a piece."""
    return (text or b"").translate(PLAIN).replace(b".", b" . ").split()


class _Slots(dict):
    """Slot of each word of a language in its chunk; slots of all languages are counted together."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b".": -1})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.words)
        self.words.append((self.lang, word))
        return self[word]


def occurrences(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chunk, slots, words): slots is an array of int32, one a word and -1 at borders, packed in a binary;
    words has language, word and count of each slot."""
    kinds = "chunk long, slots binary, words array<struct<lang: string, word: binary, n: long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        parts, size, words, tables = [], 0, [], {}

        def row() -> pa.RecordBatch:
            slots = np.concatenate(parts)
            n = np.bincount(slots[slots >= 0], minlength=len(words))
            lang, word = pa.array([w[0] for w in words], pa.string()), pa.array([w[1] for w in words], pa.binary())
            table = pa.StructArray.from_arrays([lang, word, pa.array(n, pa.int64())], names=["lang", "word", "n"])
            rows = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), table)
            columns = [pa.array([first + done], pa.int64()), pa.array([slots.tobytes()], pa.binary()), rows]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "slots", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tokens(text.as_py())
                if not found:
                    continue
                if lang not in tables:
                    tables[lang] = _Slots(lang, words)
                parts.append(np.append(np.fromiter(map(tables[lang].__getitem__, found), np.int32, len(found)), np.int32(-1)))
                size += len(found)
                if size >= chunk:
                    yield row()
                    parts, size, words, tables, done = [], 0, [], {}, done + 1
        if parts:
            yield row()

    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, kinds)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up without the leading zero bytes that all have; the lowest bytes of all come first, so
    that bytes which are alike lie together. The first byte is the number of bytes of each."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, : len(planes)] = planes.T
    return x.view("<i8")[:, 0]


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """Entries in the order of their buckets, and where each bucket's are in it."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, {k: slice(i, j) for k, i, j in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)])}


def _word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def _pair_buckets(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _pairs(slots: bytes, groups: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of frequent phrases at neighbouring positions of a chunk in ascending order: both numbers and the count of each;
    how many positions there are, where pairs are, and which pair is there."""
    slots, groups = _unpacked(zlib.decompress(slots)) - 1, np.cumsum(_unpacked(zlib.decompress(groups)))
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    kinds, which, n = np.unique(slots[at] * len(groups) + slots[at + 1], return_inverse=True, return_counts=True)
    a, b = np.divmod(kinds, len(groups)) if len(groups) else (kinds, kinds)
    return groups[a], groups[b], n, len(slots), at, which


def _word_rows(cut: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, langs, lang, word, n): the words of each chunk in each bucket, packed; lang is a place in langs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, table in zip(*batch.columns):
                words, n = table.values.field("word").to_pylist(), table.values.field("n").to_numpy()
                langs = table.values.field("lang").dictionary_encode()
                names, codes, words = langs.dictionary.to_pylist(), langs.indices.to_numpy(), np.array(words, object)
                order, parts = _dealt(_word_buckets(words, buckets))
                columns = [[] for _ in range(6)]
                for bucket, part in parts.items():
                    own = order[part]
                    row = (bucket, chunk.as_py(), names, _packed(codes[own]), b"\n".join(words[own]), _packed(n[own]))
                    for column, value in zip(columns, row):
                        column.append(value)
                kinds = pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "langs", "lang", "word", "n"])

    return cut.select("chunk", "words").mapInArrow(rows, "bucket long, chunk long, langs array<string>, lang binary, word binary, n binary")


def _pair_rows(relation: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, a, b, n): the pairs of each chunk in each bucket, ascending and packed; a as its steps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, slots, groups in zip(*batch.columns):
                a, b, n, *_ = _pairs(slots.as_py(), groups.as_py())
                order, parts = _dealt(_pair_buckets(a, b, buckets))
                a, b, n = a[order], b[order], n[order]
                columns = [[*parts], [chunk.as_py()] * len(parts)]
                columns += [[_packed(np.diff(a[p], prepend=0)) for p in parts.values()], *([_packed(x[p]) for p in parts.values()] for x in (b, n))]
                kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "a", "b", "n"])

    return relation.select("chunk", "slots", "groups").mapInArrow(rows, "bucket long, chunk long, a binary, b binary, n binary")


def _answered(rows: pa.Table, sizes: list[int], kind: np.ndarray, f: np.ndarray, least: int, back: bool) -> tuple[np.ndarray, list[list]]:
    """The frequent kinds of a bucket, and for each row that has some: chunk, bucket, which of its entries
    are frequent (a bit each), and the places of their kinds among the frequent ones. ``kind`` is that of each entry."""
    often = np.flatnonzero(f >= least)
    place = np.full(len(f), -1)
    place[often] = np.arange(len(often))
    answers = [[], [], [], []]
    if back:
        for chunk, own in zip(rows["chunk"].to_pylist(), np.split(place[kind], np.cumsum(sizes)[:-1])):
            if (held := own >= 0).any():
                for column, value in zip(answers, (chunk, rows["bucket"][0].as_py(), np.packbits(held).tobytes(), _packed(own[held]))):
                    column.append(value)
    return often, answers


ANSWER = "chunk long, bucket long, held binary, places binary, f array<long>"


def _answer_table(rows: pa.Table, answers: list[list], f: np.ndarray, more: dict[str, tuple[pa.DataType, object]]) -> pa.Table:
    """Answers to the rows, then one row without a chunk: the frequent kinds themselves and their counts."""
    none, bucket = [None] * len(answers[0]), rows["bucket"][0].as_py()
    last = [None, bucket, None, None]
    columns = {n: pa.array([*c, v], k) for n, c, v, k in zip(("chunk", "bucket", "held", "places"), answers, last, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))}
    lists = {"f": (pa.int64(), f), **more}
    return pa.table(columns | {n: pa.array([*none, x], pa.list_(k)) for n, (k, x) in lists.items()})


def _counted_words(rows: DataFrame, least: int) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        found, kind, sizes = {}, [], []
        for langs, lang, word in zip(*(table[c].to_pylist() for c in ("langs", "lang", "word"))):
            words = word.split(b"\n")
            sizes.append(len(words))
            kind += [found.setdefault(key, len(found)) for key in zip(map(langs.__getitem__, _unpacked(lang).tolist()), words)]
        kind, n = np.array(kind), np.concatenate([_unpacked(x) for x in table["n"].to_pylist()])
        f = np.zeros(len(found), np.int64)
        np.add.at(f, kind, n)
        often, answers = _answered(table, sizes, kind, f, least, True)
        keys = list(found)
        keys = [keys[i] for i in often.tolist()]
        return _answer_table(table, answers, f[often], {"lang": (pa.string(), [k[0] for k in keys]), "word": (pa.binary(), [k[1] for k in keys])})

    return stored(rows.groupBy("bucket").applyInArrow(count, f"{ANSWER}, lang array<string>, word array<binary>"))


def _counted_pairs(rows: DataFrame, least: int, back: bool) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        steps, b, n = ([_unpacked(x) for x in table[c].to_pylist()] for c in ("a", "b", "n"))
        sizes = [len(x) for x in steps]
        a, b, n = np.concatenate([np.cumsum(x) for x in steps]), np.concatenate(b), np.concatenate(n)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        starts = np.flatnonzero(first)
        kind = np.empty(len(a), np.int64)
        kind[order] = np.cumsum(first) - 1
        f = np.add.reduceat(n[order], starts)
        often, answers = _answered(table, sizes, kind, f, least, back)
        return _answer_table(table, answers, f[often], {"a": (pa.int64(), a[starts[often]]), "b": (pa.int64(), b[starts[often]])})

    return stored(rows.groupBy("bucket").applyInArrow(count, f"{ANSWER}, a array<long>, b array<long>"))


def _often(counted: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """The frequent words or pairs with their count f and their number gid."""
    rows = counted.filter("chunk is null").select("bucket", F.posexplode(F.arrays_zip(*columns, "f")).alias("place", "k"))
    return rows.select((F.col("place") * F.lit(buckets) + F.col("bucket")).alias("gid"), *[F.col(f"k.{c}").alias(c) for c in (*columns, "f")])


RELATION = "chunk long, slots binary, groups binary"


def _semi_joined(left: DataFrame, counted: DataFrame, buckets: int, words: bool) -> DataFrame:
    """Relation of the frequent words or pairs of each chunk: the slots in its groups plus one, 0 for none, and the
    groups' numbers ascending, as steps; both packed."""

    def of_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, slots, table, answers in zip(*batch.columns):
                if words:
                    at, size = np.frombuffer(slots.as_py(), np.int32), len(table)
                    order, parts = _dealt(_word_buckets(table.values.to_pylist(), buckets))
                else:
                    a, b, _, n, where, which = _pairs(slots.as_py(), table.as_py())
                    at, size = np.full(n, -1), len(a)
                    at[where] = which
                    order, parts = _dealt(_pair_buckets(a, b, buckets))
                gid = np.full(size, -1)
                for bucket, held, places in zip(*(answers.values.field(c).to_pylist() for c in ("bucket", "held", "places"))):
                    own = order[parts[bucket]]
                    held = np.unpackbits(np.frombuffer(held, np.uint8), count=len(own)).astype(bool)
                    gid[own[held]] = _unpacked(places) * buckets + bucket
                kept = np.flatnonzero(gid >= 0)
                kept = kept[np.argsort(gid[kept])]
                moved = np.zeros(size + 1, np.int64)  # the last entry is that of -1
                moved[kept] = np.arange(1, len(kept) + 1)
                packed = [zlib.compress(_packed(x), 1) for x in (moved[at], np.diff(gid[kept], prepend=0))]
                columns = [pa.array([chunk.as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "slots", "groups"])

    answers = counted.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "held", "places")).alias("answers"))
    return stored(left.join(answers, "chunk").mapInArrow(of_answers, RELATION))


def _cut_scores(length: int) -> Column:
    """The lowest-scoring cut of a phrase, the first of equals: score, words before it, counts of its parts.
    Products are decimals of 38 digits, exact for counts below 10^15; ``div`` drops the fraction."""
    cuts = []
    for k in range(1, length):
        parts = f"heads[{k - 1}] as l, tails[{length - k - 1}] as r"
        wide = "decimal(15,0)"
        squares = f"cast({SCALE} as decimal(7,0)) * cast(a as {wide}) * cast(a as {wide})"
        score = f"({squares}) div (cast(heads[{k - 1}] as {wide}) * cast(tails[{length - k - 1}] as {wide}))"
        cuts.append(F.expr(f"struct({score} as score, {k} as k, {parts})"))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, within: tuple[int, int] = WITHIN, chunk: int = CHUNK
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language.

    ``docs`` has text and lang. A phrase lies within a piece (texts are cut at ``.,;:!?`` and line ends)
    and occurs ``least`` times or more: a times, overlaps included. Its score is a * a / (l * r) in parts
    of SCALE, rounded down, at the cut into two parts (counts l and r) where that is lowest. A phrase goes
    if a longer one that holds its words in a row occurs ``within`` of a times or more. ``n`` counts
    all words of the language. Order: score, then a, both falling, then phrase by its bytes.

    Null, empty and blank texts have no words; a null language is ``und``. Repeated rows count each.
    Extra columns and doc_id are ignored. No words, or no phrase that occurs often enough: no rows.
    """
    if longest < 2:
        raise ValueError("longest must be 2 or more")
    p, q = within
    with scratch_scope(docs.sparkSession):
        cut = stored(occurrences(docs, chunk))
        totals = stored(cut.select(F.explode("words").alias("w")).groupBy("w.lang").agg(F.sum("w.n").alias("n")), compact=True)
        buckets = max(4 * n_parts(docs.sparkSession), (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET)
        counted = _counted_words(_word_rows(cut, buckets), least)
        none, word = F.array().cast("array<bigint>"), F.col("word").cast("string")
        groups = stored(_often(counted, buckets, "lang", "word").select(
            "gid", "lang", word.alias("phrase"), word.alias("last"), F.col("f").alias("a"), none.alias("heads"), none.alias("tails")
        ))
        relation = _semi_joined(cut.select("chunk", "slots", "words.word"), counted, buckets, True)
        release(cut, counted)
        found = None
        for length in range(2, longest + 1):
            counted = _counted_pairs(_pair_rows(relation, buckets), least, length < longest)
            left = groups.select(F.col("gid").alias("a"), "lang", "phrase", F.col("a").alias("fa"), "heads")
            right = groups.select(F.col("gid").alias("b"), F.col("last"), F.col("a").alias("fb"), "tails")
            longer = stored(
                _often(counted, buckets, "a", "b").join(left, "a").join(right, "b").select(
                    "gid", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.col("f").alias("a"), F.array_append("heads", F.col("fa")).alias("heads"),
                    F.array_append("tails", F.col("fb")).alias("tails"), F.col("a").alias("first"), F.col("b").alias("rest"),
                )
            )
            if length > 2:
                found = found.unionByName(_not_within(groups, longer, p, q, length - 1)) if found is not None else _not_within(groups, longer, p, q, length - 1)
            shorter = relation
            if length < longest:
                relation = _semi_joined(shorter, counted, buckets, False)
            release(shorter, counted)
            groups = longer
        last = _scored(groups, longest)
        found = last if found is None else found.unionByName(last)
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        return stored(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), compact=True, keep=True)


def _scored(groups: DataFrame, length: int) -> DataFrame:
    cut = groups.select("lang", "phrase", "a", _cut_scores(length).alias("c"))
    return cut.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def _not_within(groups: DataFrame, longer: DataFrame, p: int, q: int, length: int) -> DataFrame:
    """Scored phrases that no longer one holds so often; the most frequent longer one has one word more."""
    held = longer.select(F.explode(F.array("first", "rest")).alias("gid"), F.col("a").alias("m")).groupBy("gid").agg(F.max("m").alias("m"))
    free = groups.join(held, "gid", "left").filter(F.col("m").isNull() | (q * F.col("m") < p * F.col("a")))
    return _scored(free, length)

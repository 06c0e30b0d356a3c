"""Document fingerprints from a randomised edit embedding: shared random walks over characters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm import minhash
from tripweave.llm.common import n_parts, stored
from tripweave.operators.dedup import components
from tripweave.session import scratch_scope

SEED = 20_261
#: Sampled steps of the walk; each gives one hex digit.
DIGITS = 256
BANDS = 32
LIKENESS = 0.8
#: The walk's random bits depend on the character (in KINDS classes) and the step (repeating).
KINDS, PERIOD = 128, 4096
#: Documents still walking when fewer than this many are left go on one by one.
FEW = 48
#: Characters of text dealt to one task.
PART_CHARS = 6_000_000


def _random(label: str, size: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.md5(f"{SEED}/{label}".encode()).digest()[:8], "big")
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, size, dtype=np.int64)


class Walk:
    """Shared randomness: how long a walk stays on a character, and which steps are sampled.

    At each step the walk writes the character it is on and moves on if a random bit of
    (character, step) says so. ``stay[kind, step]`` counts the steps until that happens, so one
    lookup a character does. Texts at a small edit distance fall into step again after an
    edit and write the same character at almost all later steps.
    """

    _one: Walk | None = None

    @classmethod
    def shared(cls) -> Walk:
        """One for each Python worker; it holds constants only."""
        cls._one = cls._one or cls()
        return cls._one

    def __init__(self) -> None:
        moves = (_random("moves", KINDS * PERIOD) >> 40 & 1).astype(bool).reshape(KINDS, PERIOD)
        moves[:, -1] = True  # no endless stay
        after = np.full((KINDS, PERIOD), PERIOD)
        after[moves] = np.broadcast_to(np.arange(PERIOD), moves.shape)[moves]
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
        self.stay = (after - np.arange(PERIOD) + 1).astype(np.int32)
        self.flat = self.stay.ravel()
        self.lists = self.stay.tolist()
        self.digit_keys = _random("digits", DIGITS).astype(np.uint64)
        # positions of running minima of a random hash over the steps, for each digit
        draws = (_random("records", DIGITS * 64).reshape(DIGITS, 64) + 1) / float(1 << 63)
        records = [np.zeros(DIGITS)]
        for k in range(64):
            records.append(np.floor(np.minimum((records[-1] + 1) / draws[:, k], 1e15)))
        self.records = np.stack(records, axis=1).astype(np.int64)
        self._steps: dict[int, np.ndarray] = {}

    @staticmethod
    def kinds(chars: np.ndarray) -> np.ndarray:
        return ((chars.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64)

    def entries(self, kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Step at which each character is entered, for many texts in one array; ``begin`` is the
        step of each text's first character. One more entry a text: the step after its last."""
        out = np.empty(len(kinds) + len(lengths), np.int64)
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        source, target, step = starts[order], (starts + np.arange(len(starts)))[order], begin[order].astype(np.int64)
        active = len(order)
        mask, i = PERIOD - 1, 0
        while active:
            active = int(np.searchsorted(-size, -i, side="left"))
            if active < FEW:
                break
            now = step[:active]
            out[target[:active] + i] = now
            now += self.flat[kinds[source[:active] + i] * PERIOD + (now & mask)]
            i += 1
        for k in range(active):
            at, lists = int(step[k]), self.lists
            path = []
            for kind in kinds[source[k] + i : source[k] + size[k]].tolist():
                path.append(at)
                at += lists[kind][at & mask]
            out[target[k] + i : target[k] + size[k]] = path
            step[k] = at
        out[target + size] = step
        return out

    def steps(self, n_chars: int) -> np.ndarray:
        """The sampled steps for a text of ``n_chars``: for each digit the step whose hash is smallest
        among the first 2 n. They spread evenly, and texts of similar length share almost all.

        A running minimum at r is followed by the next at s or later with chance (r + 1) / s,
        which is how ``records`` was drawn.
        """
        if n_chars not in self._steps:
            if len(self._steps) > 20_000:
                self._steps.clear()
            last = (self.records < max(1, 2 * n_chars)).sum(axis=1) - 1
            self._steps[n_chars] = self.records[np.arange(DIGITS), last]
        return self._steps[n_chars]

    def digits(self, chars: np.ndarray, entered: np.ndarray) -> np.ndarray:
        """One digit a sampled step: a hash of the character the walk is on, or of the end.
        ``entered`` has the step of each character and, last, of the end."""
        at = np.searchsorted(entered, self.steps(len(chars)), side="right") - 1
        on = np.append(chars, np.uint32(0x110000))[at].astype(np.uint64)
        x = (on + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ self.digit_keys
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(60)).astype(np.uint8)


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_hex(digits: np.ndarray) -> str:
    return HEX[digits].tobytes().decode()


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprints(walk: Walk, texts: Sequence[str], tails: Sequence[tuple[int, str]] = ()) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digits of each text and, given ``tails``, of its edit: (kept, tail) keeps the first ``kept``
    characters and goes on with ``tail``. The walk over what is kept is not done again."""

    def walked(parts: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(lengths) - lengths
        together = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        entered = walk.entries(walk.kinds(together), starts, lengths, begin)
        return [entered[s + k : s + k + n + 1] for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist()))]

    chars = [characters(t) for t in texts]
    entered = walked(chars, np.zeros(len(chars), np.int64))
    own = [walk.digits(c, e) for c, e in zip(chars, entered)]
    if not tails:
        return own, []
    more = [characters(t) for _, t in tails]
    later = walked(more, np.array([e[k] for e, (k, _) in zip(entered, tails)], np.int64))
    edited = [
        walk.digits(np.concatenate([c[:k], m]), np.concatenate([e[:k], x])) for c, e, m, x, (k, _) in zip(chars, entered, more, later, tails)
    ]
    return own, edited


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal digits."""
    return float(np.count_nonzero(a == b)) / DIGITS


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row: DIGITS hex digits. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk.shared()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                own, _ = fingerprints(walk, [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([as_hex(d) for d in own], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def near_groups(docs: DataFrame, least: float = LIKENESS, bands: int = BANDS, block: int = minhash.BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id): group of each document under links of fingerprints alike by ``least`` or more.

    Each band samples DIGITS / ``bands`` digits by a shared permutation; fingerprints with an equal band
    meet. A pair at a likeness of 0.8 shares none of 32 bands with a chance of (1 - 0.8^8)^32, 0.3 %. Whatever
    meets is decided digit by digit: first with the smallest of its bucket, then across the groups found,
    block by block, so a crowd of any size loses no pair that meets and makes no list of its pairs.

    ``component_id`` is the smallest doc_id of the group, null if it has none. Null texts count as
    empty; repeated rows stay; extra columns are ignored; an empty table gives an empty one.
    """
    order = np.argsort(_random("bands", DIGITS)).tolist()
    width = DIGITS // bands
    picked = [F.concat(*[F.substring("fingerprint", order[k * width + i] + 1, 1) for i in range(width)]) for k in range(bands)]
    equal = math.ceil(least * DIGITS)  # as many equal of DIGITS marked digits each are equal / (2 DIGITS - equal) of both
    with scratch_scope(docs.sparkSession):
        rows = stored(with_fingerprints(docs))
        prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
        marked = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(DIGITS)), lambda i: F.concat(i, F.lit(":"), F.substr("fingerprint", i, F.lit(1)))))
        keys = F.array(*[F.xxhash64(F.lit(k), digits) for k, digits in enumerate(picked)])
        nodes = stored(prints.select(
            F.unhex("fingerprint").alias("node"), F.lit(DIGITS).cast("long").alias("n"), keys.alias("keys"), marked.cast("binary").alias("text"), "fingerprint", "first_id",
        ))
        found = components(minhash.links(nodes, nodes.select("node", "text"), (equal, 2 * DIGITS - equal), 1, block)).withColumnRenamed("node", "_node")
        named = nodes.join(found, F.col("node") == F.col("_node"), "left").select("fingerprint", "first_id", F.coalesce("component", "node").alias("root"))
        named = stored(named)
        roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        groups = named.join(roots, "root").select("fingerprint", "component_id")
        return stored(rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id"), keep=True)


def _edits(table: pa.Table) -> pa.Table:
    """Rows of one part, in order; the last row or rows, marked, only serve as the next document."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("guest", "doc_id", "text"))), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    own = [r for r in rows if not r[0]]
    guests = [r for r in rows if r[0]]
    following = [r[2] for r in own[1:]] + [guests[0][2]] if own else []
    texts = [r[2] for r in own]
    quarter = [len(t) // 4 for t in texts]
    tails = [(len(t) - q, n[:q]) for t, q, n in zip(texts, quarter, following)]
    walk = Walk.shared()
    prints, edited = fingerprints(walk, texts + [g[2] for g in guests[:1]], tails + [(len(g[2]), "") for g in guests[:1]])
    whole = [t[:k] + tail for t, (k, tail) in zip(texts, tails)]
    n = len(own)
    return pa.table({
        "doc_id": pa.array([r[1] for r in own], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in whole], pa.string()),
        "fingerprint": pa.array([as_hex(d) for d in prints[:n]], pa.string()),
        "edited_fingerprint": pa.array([as_hex(d) for d in edited[:n]], pa.string()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(prints, edited[:n])], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(prints[:n], prints[1:])], pa.float64()),
    })


def edit_table(docs: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edit replaces the last quarter (rounded down) of a text's code points by as many of the
    start of the next document's, in order of doc_id; the last document is followed by the first.
    Null texts count as empty. Rows without a doc_id come before all others; rows that tie in
    doc_id follow each other by text. Extra columns are ignored. An empty table gives an empty one.

    Documents are dealt by ranges of doc_id, each about ``part_chars`` bytes of text; the first
    document of a range also goes to the range before it. Only the ranges' first ids are known
    to every task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = max(1, -(-(size or 0) // part_chars))
    ids = rows.select("doc_id").repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    cuts = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("known"))
    found = cuts.collect()  # one row a range
    lowest = -(1 << 63)
    nulls = any(r["all"] > r["known"] for r in found)
    firsts = sorted({r["first"] for r in found if r["first"] is not None} | ({lowest} if nulls else set()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(firsts, np.int64)
        for batch in batches:
            keys = batch.column(0).fill_null(lowest).to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, keys, side="right") - 1
            lead = np.flatnonzero(edges[at] == keys)
            take = np.concatenate([np.arange(len(keys)), lead])
            part = np.concatenate([at, (at[lead] - 1) % len(edges)])
            guest = np.arange(len(take)) >= len(keys)
            columns = [pa.array(part, pa.int64()), pa.array(guest), *(c.take(pa.array(take)) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "guest", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part long, guest boolean, doc_id long, text string")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.repartition(max(parts, n_parts(docs.sparkSession)), "part").groupBy("part").applyInArrow(_edits, out)

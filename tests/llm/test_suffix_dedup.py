import hashlib
import random

import numpy as np
import pytest

from tripweave.llm import suffix_dedup as sd


def plain(rows):
    """Brute force over (doc_id, text): strings of 50 bytes that start in a document with a smaller id."""
    big = (1 << 63) - 1
    data = sorted(((big if i is None else i), (t or "").encode()) for i, t in rows)
    first = {}
    for i, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs, p = [], 0
        while p < len(b):
            if gone[p]:
                q = p
                while q < len(b) and gone[q]:
                    q += 1
                runs.append((p, q))
                p = q
            else:
                p += 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((None if i == big else i, len(b), sum(gone), len(runs), hashlib.sha256(kept).hexdigest(), runs))
    return sorted(out, key=repr)


def result(docs, **options):
    rows = sd.remove_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(x) for x in r.removed]) for r in rows), key=repr)


def test_residues_cover_every_difference():
    assert {(a - b) % sd.COVER for a in sd.RESIDUES for b in sd.RESIDUES} == set(range(sd.COVER))


def test_names_follow_content():
    data = np.frombuffer(("abcdefghij" * 40).encode(), np.uint8)
    old, sd.CHUNK = sd.CHUNK, 37
    try:
        got = sd.names(data, 30)
        some = sd.names(data, 30, np.array([0, 3, 36, 37, 38, 200, 370]))
    finally:
        sd.CHUNK = old
    whole = sd.names(data, 30)
    assert (got == whole).all() and len(set(got.tolist())) == 10 and (some == whole[[0, 3, 36, 37, 38, 200, 370]]).all()


@pytest.mark.parametrize("block_bytes", [4_000_000, 3_000, 300])
def test_brute_force(make_docs, block_bytes):
    rng = random.Random(block_bytes)
    words = ["ab", "cd", "é", "ff ", "ghi", "x"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    for k in range(40, 90):
        a, b = rng.choice(texts), rng.choice(texts)
        cut = rng.randint(0, len(a))
        texts.append(rng.choice([a, a[:cut] + b, a[cut:], a[:cut] + "!" + a[cut:], a + a, b[:49], "q" * rng.randint(40, 160)]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 3, t) for i, t in zip(order, texts)] + [(None, texts[5]), (None, texts[5]), (9, texts[7]), (9, texts[7]), (400, None), (401, "")]
    assert result(make_docs(rows), block_bytes=block_bytes) == plain(rows)


def test_odd_rows(odd, no_docs):
    from conftest import ODD  # noqa: PLC0415

    rows = [(r[0], r[1]) for r in ODD if not r[1] or len(r[1]) < 10000]
    assert result(odd.filter("length(text) < 10000 or text is null")) == plain(rows)
    assert len(result(odd)) == len(ODD)
    assert sd.remove_repeats(no_docs).count() == 0

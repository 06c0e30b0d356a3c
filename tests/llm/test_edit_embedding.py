import hashlib
import random

import numpy as np

from tripweave.llm import edit_embedding as ee


def plain_digits(walk, text):
    """The walk step by step: write the character, move on if the random bit says so."""
    chars = ee.characters(text)
    kinds = walk.kinds(chars)
    wanted = walk.steps(len(chars))
    written, i, step = {}, 0, 0
    last = int(wanted.max())
    while step <= last:
        written[step] = int(chars[i]) if i < len(chars) else 0x110000
        if i < len(chars) and walk.stay[kinds[i], step % ee.PERIOD] == 1:
            i += 1
        step += 1
    out = []
    for k, s in enumerate(wanted.tolist()):
        x = (written[s] + 1) * 0x9E3779B97F4A7C15 % 2**64 ^ int(walk.digit_keys[k])
        out.append((x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> 60)
    return out


TEXTS = ["", "a", "ab", "é漢😀", "the quick brown fox " * 30, "aaaa" * 200, "x" * 3, "many words of some length, and marks. " * 200]


def test_walks_are_the_plain_ones():
    walk = ee.Walk.shared()
    tails = [(len(t) - len(t) // 4, n[: len(t) // 4]) for t, n in zip(TEXTS, TEXTS[1:] + TEXTS[:1])]
    old = ee.FEW
    for ee.FEW in (0, 3, old):  # all together, together and then one by one, one by one
        own, edited = ee.fingerprints(walk, TEXTS, tails)
        for t, d, (k, tail), e in zip(TEXTS, own, tails, edited):
            assert d.tolist() == plain_digits(walk, t) and e.tolist() == plain_digits(walk, t[:k] + tail)
    ee.FEW = old


def test_sampled_steps_spread_and_stay():
    walk = ee.Walk.shared()
    steps = walk.steps(5000) / 10000
    assert steps.max() < 1 and abs(np.mean(steps) - 0.5) < 0.07
    assert np.mean(walk.steps(5000) == walk.steps(5250)) > 0.9


def test_likeness_falls_with_edits():
    rng = random.Random(8)
    walk = ee.Walk.shared()
    text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    near = list(text)
    for _ in range(5):
        near[rng.randrange(len(near))] = rng.choice(["", "zz", "q"])
    far = "".join(rng.sample(text, len(text)))
    (a, b, c), _ = ee.fingerprints(walk, [text, "".join(near), far])
    assert ee.likeness(a, b) > 0.75 > 0.35 > ee.likeness(a, c)


def plain_edits(rows):
    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in rows), key=lambda r: r[:3])
    out = []
    for k, (_, _, t, i) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][2]
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edits_over_many_ranges(make_docs):
    rng = random.Random(1)
    rows = [(i * 7 % 101, "".join(rng.choice("abcé漢 ") for _ in range(rng.randint(0, 200)))) for i in range(101)]
    rows += [(5, rows[3][1]), (5, rows[3][1]), (None, "no id"), (None, None), (500, None)]
    for size in (10**9, 3000, 200):
        got = ee.edit_table(make_docs(rows), size).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == plain_edits(rows)
        assert all(len(r.fingerprint) == ee.DIGITS and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        texts = {i: t or "" for i, t in rows if i not in (None, 5)}
        prints = {}
        for r in got:
            if r.doc_id in texts:
                assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_odd_rows(odd, no_docs):
    assert ee.edit_table(odd).count() == odd.count()
    assert ee.edit_table(no_docs).count() == 0 and ee.with_fingerprints(no_docs).count() == 0


def groups_of(prints, links):
    root = {p: p for p in prints}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_groups_of_pairs_and_of_a_crowd(make_docs):
    """60 pairs, and 400 texts a few edits from one text: nothing joined that should not be, and the crowd found whole."""
    rng = random.Random(6)
    text = lambda n, letters="abcdefghij ": "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for i in range(60):
        t = text(400)
        rows += [(2 * i, t), (2 * i + 1, t[:-20] + text(20, "klm"))]
    base = text(500)
    for i in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((1000 + i, "".join(t)))
    for block in (256, 16):
        got = {r.doc_id: r for r in ee.near_groups(make_docs(rows), block=block).collect()}
        assert len(got) == len(rows)
        digits = {r.fingerprint: ee.np.frombuffer(r.fingerprint.encode(), ee.np.uint8) for r in got.values()}
        names = list(digits)
        links = [(a, b) for k, a in enumerate(names) for b in names[:k] if (digits[a] == digits[b]).sum() >= 0.8 * ee.DIGITS]
        want = groups_of(names, links)
        own = {r.fingerprint: r.component_id for r in got.values()}
        assert all(want[r.fingerprint] == want[got[r.component_id].fingerprint] for r in got.values())
        assert len(links) > 2000 and sum(own[a] == own[b] for a, b in links) >= 0.99 * len(links)
        assert min(i for i in got if got[i].component_id == got[1000].component_id) == got[1000].component_id


def test_groups_of_odd_rows(odd, no_docs):
    rows = ee.near_groups(odd).collect()
    assert len(rows) == odd.count() and ee.near_groups(no_docs).count() == 0
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 9)} == {1}
    assert {r.component_id for r in rows if r.doc_id == 6} == {6}

import random

import pytest
import xxhash

from tripweave.llm import simhash


def plain_fingerprint(text):
    words, word = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    words += [word] * bool(word)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vs}


def test_fingerprint_is_the_plain_one():
    for text in (None, "", " ", "A b", "a B c", "Ünï CODE words À la carte\x0bnext\x85line x y", "w " * 70000, "a b c d e f g " * 9):
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance,segments,bucket", [(2, 5, 64), (2, 5, 2), (2, 3, 64), (2, 7, 64), (1, 3, 64), (1, 4, 2)])
def test_links_connect_what_all_pairs_connect(spark, distance, segments, bucket):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        seed = rng.getrandbits(64)
        for _ in range(8):
            values.add(seed)
            for _ in range(rng.randint(1, 4)):
                seed ^= 1 << rng.randrange(64)
    values = {signed(v) for v in values}
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, segments, bucket).collect()
    for a, b in got:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= distance
    want = plain_components(values, distance)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in got:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {v: find(v) for v in values} == want


def test_pigeonring_chain_finds_every_close_pair(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 4)):
            b ^= 1 << rng.randrange(64)
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    hits = None
    for start in range(5):
        part = df.selectExpr("a", "b", f"{start} as start").filter(simhash.chain_holds("a", "b", "start", 5, 2))
        hits = part if hits is None else hits.union(part)
    got = {(r.a, r.b) for r in hits.collect()}
    assert got == {(a, b) for a, b in rows if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_groups_and_odd_rows(spark, odd, no_docs):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {by_id[i][0].component_id for i in (1, 2, 3, 9)} == {1}
    assert by_id[10][0].component_id == by_id[11][0].component_id == 10
    assert [r.component_id for r in by_id[6]] == [6, 6]
    assert sorted(r.component_id for r in by_id[None]) == [1, 6]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_query_is_brute_force(spark, data):
    from tripweave.llm.queries import QUERIES

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    roots = plain_components(set(prints.values()), 2)
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(roots[p], i)
    assert got == {i: (f"{p:016x}", first[roots[p]]) for i, p in prints.items()}

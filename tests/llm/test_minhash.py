import random

import numpy as np
import pytest

from tripweave.llm import minhash
from tripweave.llm.common import shingles


def plain(rows, p=85, q=100):
    """(doc_id, set size, smallest id of the group, kept) with all pairs compared; ids are unique."""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def crowd(seed=5):
    """Chains of near copies, a crowd around one text, texts that share a long passage but are not alike, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = ["one two three", "One  two THREE", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i j k l", "a b c d e f g h i j k", None, " ", "É b c d e", "é b c d e"]
    for _ in range(25):
        words = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(5):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(200)]
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(200)] = word()
        texts.append(" ".join(words))
    passage = [word() for _ in range(150)]
    for _ in range(60):
        tail = [word() for _ in range(60)]
        texts += [" ".join(passage + tail), " ".join(passage + tail[:-1])]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [256, 8])
def test_groups_equal_brute_force(make_docs, block):
    rows = crowd()
    want = plain(rows)
    groups = [w[2] for w in want]
    assert max(map(groups.count, set(groups))) > 60 and len(set(groups)) > 60
    got = minhash.near_duplicates(make_docs(rows), block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == want


def test_a_crowd_in_one_bucket_of_different_groups(spark, make_docs):
    """With one band of one bin everything meets by chance in few buckets; no link is lost there."""
    rows = crowd(9)
    got = minhash.near_duplicates(make_docs(rows), bands=60, rows=1, block=16)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_odd_rows(odd):
    got = sorted(minhash.near_duplicates(odd).collect(), key=repr)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert len(got) == odd.count()
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)}
    assert by[4] == {(1, 4, True)} and by[6] == {(2, 6, True)} and by[8] == {(1, 8, True)}
    assert by[10] == {(5, 10, True)} and by[11] == {(5, 10, False)}
    assert by[None] == {(2, 6, False), (0, None, True)}


def test_empty_table(no_docs):
    got = minhash.near_duplicates(no_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0


def test_bins_agree_as_often_as_sets_are_alike():
    rng = random.Random(2)
    bins = minhash.Bins()
    for size in (8, 60, 900):
        shared = []
        for _ in range(60):
            words = [str(rng.random()) for _ in range(size + 4)]
            a = shingles(" ".join(words).encode())
            b = shingles(" ".join(words[: -size // 5]).encode())
            alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            shared.append((bins.signature(a) == bins.signature(b)).mean() - alike)
        assert abs(np.mean(shared)) < 0.03


def test_every_band_of_similar_sets_is_met_often_enough():
    rng = random.Random(4)
    bins = minhash.Bins()
    for size in (7, 40, 400):
        for _ in range(200):
            words = [str(rng.random()) for _ in range(size + 4)]
            a, b = shingles(" ".join(words).encode()), shingles(" ".join(words[: -max(1, size * 3 // 20)]).encode())
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                x, y = bins.signature(a), bins.signature(b)
                assert (bins.keys(x) == bins.keys(y)).any()


def test_intersections_of_blocks_are_exact():
    rng = random.Random(8)
    x, y = ([np.array(sorted(rng.sample(range(9000), rng.randint(1, 4500)))) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert minhash._shared(x, y).tolist() == want
    assert minhash._shared([np.array([1])], [np.array([2, 3])]).tolist() == [[0]]


def test_names_are_sorted_only_for_keys_of_several_sets(spark, make_docs, monkeypatch):
    """Every key of every set was sorted and shuffled with the set's name, although most keys have one set."""
    from pyspark.sql import functions as F

    from tripweave.llm.common import stored

    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.random()) for _ in range(40))) for i in range(300)] + [(300, "a b c d e f g h i j k l"), (301, "a b c d e f g h i j k l m")]
    marked = stored(minhash.with_signatures(make_docs(rows), minhash.Bins()))
    tables = []
    monkeypatch.setattr(minhash, "sift", lambda df, keys, wanted: tables.append((df, keys, wanted)) or df.join(wanted, keys, "left_semi"))
    found = minhash.links(marked.select("node", "n", "keys"), marked.select("node", "text")).collect()
    assert len(found) == 1
    keyed, keys, wanted = tables[0]
    assert keys == "key" and wanted.columns == ["key"]
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    assert sorted(r.key for r in wanted.collect()) == sorted(r.key for r in size.filter("size > 1").collect())
    assert keyed.count() == 302 * minhash.BANDS and wanted.count() < 2 * minhash.BANDS

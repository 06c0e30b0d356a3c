import itertools
import random

import numpy as np

from tripweave.llm import language_crf as lc


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    emit, moves = rng.random((6, 3)).astype(np.float32) + 0.05, rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 5])
    ids = rng.integers(0, 6, lengths.sum())
    total, words, moved = lc.forward_backward(emit, ids, lengths, moves, details=True)
    at, want_moves = 0, np.zeros((3, 3))
    for s, n in enumerate(lengths):
        seq = ids[at : at + n]
        share, z, pairs = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([emit[w, c] for w, c in zip(seq, path)]) * np.exp(sum(moves[a, b] for a, b in zip(path, path[1:])))
            z += p
            for t, c in enumerate(path):
                share[t, c] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        np.testing.assert_allclose(words[at : at + n], share / z, rtol=2e-4)
        np.testing.assert_allclose(total[s], (share / z).sum(axis=0), rtol=2e-4)
        want_moves += pairs / z
        at += n
    np.testing.assert_allclose(moved, want_moves, rtol=2e-4)


def test_words_of_a_code_switched_text():
    rng = random.Random(4)
    left, right = ["ba", "bo", "bi", "bu"], ["zel", "zan", "zor", "zim"]
    text = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    model = lc.fit_crf([text(left, 60) for _ in range(20)] + [text(right, 60) for _ in range(20)], ["l"] * 20 + ["r"] * 20)
    words = lc.words_of(text(left, 15) + " " + text(right, 25))
    _, share, _ = lc.forward_backward(model.emissions(words), np.arange(len(words)), np.array([len(words)]), model.moves, details=True)
    assert [model.labels[i] for i in share.argmax(axis=1)] == ["l"] * 15 + ["r"] * 25
    assert lc.identify([" ".join(words), None, "12 !", "²", "Bababa"], model)[0] == ["r", "und", "und", "und", "l"]


def test_held_out_accuracy(spark, data):
    from tripweave.llm.queries import QUERIES

    folder = data.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in QUERIES["op6_language_crf"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").filter("lang is not null").collect()
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if got[d.doc_id].held_out]
    assert len(got) == 1000 and len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark, odd, no_docs):
    from pyspark.sql import functions as F

    model = lc.fit(odd, F.lit(True))
    rows = lc.predict(odd, model).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 9, 12)} == {"und"}
    assert lc.predict(no_docs, model).count() == 0
    none = lc.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in lc.predict(odd, none).collect()} == {"und"}
    runs = lc.word_runs(odd.filter("doc_id = 10"), model).collect()
    assert [(r.first, r.last) for r in runs] == [(0, 8)]

import numpy as np
from pyspark.sql import functions as F

from tripweave.llm import quality_trees as qt


def test_flat_traversal_is_the_plain_one():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = qt.fit_trees(x, y, trees=12, depth=3)
    score = model.score(x)
    for i in range(0, 400, 37):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert np.isclose(score[i], 1 / (1 + np.exp(-total)))
    assert np.mean((score > 0.5) == (y > 0)) > 0.95


def test_splits_are_the_best_ones():
    """One tree of depth one: its split has the largest gain over all borders."""
    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=(200, 3)), rng.random(200)
    y = (x[:, 1] + 0.5 * noise > 0.3).astype(float)
    model = qt.fit_trees(x, y, trees=1, depth=1, bins=16)
    g, h = np.full(200, (y.sum() + 0.5) / 201) - y, None
    p = (y.sum() + 0.5) / 201
    h = np.full(200, p * (1 - p))
    best = max(
        (
            g[m].sum() ** 2 / (h[m].sum() + qt.L2) + g[~m].sum() ** 2 / (h[~m].sum() + qt.L2), f, t)
            for f in range(3) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1], method="lower"))
            for m in [x[:, f] <= t] if h[m].sum() >= qt.MIN_HESSIAN and h[~m].sum() >= qt.MIN_HESSIAN
    )
    assert model.feature[0, 0] == best[1] and model.threshold[0, 0] == best[2]


def test_statistics_of_odd_texts():
    assert qt.statistics(None) == qt.statistics("") == [0.0] * len(qt.FEATURES)
    for text in (" ", "\n", "é", "a", "!!!", "A b\nA b\n", "漢" * 1000):
        values = qt.statistics(text)
        assert len(values) == len(qt.FEATURES) and np.isfinite(values).all()
    table = dict(zip(qt.FEATURES, qt.statistics("Ab ab ab! x\nAb")))
    assert table["distinct_words"] == 4 / 5 and table["same_as_before"] == 0 and table["top_word"] == 2 / 5
    assert table["marked_words"] == 1 / 5 and table["single_letters"] == 1 / 5 and table["upper"] == 2 / 14


def test_held_out_quality(spark, data):
    from tripweave.llm.queries import QUERIES

    folder = data.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in QUERIES["op9_quality_trees"](spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(rows[i].score, labels[i]) for i in labels if i in rows and rows[i].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert len(bad) > 3 and np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows.values())


def test_odd_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    model = qt.fit(odd, labels, F.lit(True))
    scored = odd.select("doc_id", qt.scorer(model)(F.col("text")).alias("score")).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    kept = qt.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    nothing = qt.fit(no_docs, labels.limit(0), F.lit(True))
    assert nothing.score(np.zeros((2, len(qt.FEATURES)))).tolist() == [0.5, 0.5]
    assert qt.keep_good(no_docs, nothing).count() == 0

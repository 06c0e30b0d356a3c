import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripweave.llm import resampling as rs
from tripweave.llm.queries import QUERIES


def plain(docs, target, ngram=1, buckets=10_000, min_words=20, share=(10, 100), seed=2024):
    """(doc_id, n_features, weight, score, rank) in memory; docs: (doc_id, text)."""

    def bag(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text) if w]
        runs = [" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    bags = [bag(t) for _, t in docs]
    s, t = Counter(), Counter()
    for _, b in bags:
        s.update(b)
    for text in target:
        t.update(bag(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (i, _), (n_words, b) in zip(docs, bags):
        n = sum(b.values())
        weight = sum(gain(x) * c for x, c in b.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[4], r[1]))
    drawn = able[: len(able) * share[0] // share[1]]
    out = [(*r[:4], k) for k, r in enumerate(drawn, 1)]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted(out + [(*r, None) for r in left.elements()], key=repr)


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["É1", "naïve", "漢字"]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choice(words).upper() for _ in range(rng.randint(0, 80)))) for i in range(400)]
    docs += [(i, docs[i][1]) for i in range(0, 60, 3)] + [(None, docs[5][1])] * 3 + [(900, None), (901, ""), (902, " ... ")]
    return docs, [" ".join(rng.choice(words[:80]) for _ in range(30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"ngram": 2, "buckets": 97}, {"share": (1, 3), "min_words": 1}, {"share": (1, 1), "pivots": 2}, {"share": (0, 1)}, {"pivots": 1}])
def test_draw_equals_brute_force(spark, options):
    docs, target = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "'x' as tag", "3 as s", "4 as id").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = rs.resample(table, goal, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, **{k: v for k, v in options.items() if k != "pivots"})


def test_query_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"](spark, data)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target)


def test_odd_and_empty_tables(spark, odd, no_docs):
    goal = spark.createDataFrame([("one two three",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, rs.resample(odd, goal).collect()), key=repr) == plain(docs, ["one two three"])
    assert sorted(map(tuple, rs.resample(odd, goal.limit(0)).collect()), key=repr) == plain(docs, [])
    assert rs.resample(no_docs, goal).count() == 0


@pytest.mark.parametrize("pivots", [1, 4, 31])
def test_quickselect_finds_every_rank(spark, pivots):
    rng = random.Random(3)
    rows = [(rng.randint(-3, 3), rng.random() < 0.1, rng.randint(0, 4), 20, 20, k) for k in range(60)]
    keys = spark.createDataFrame(rows, "s long, bare boolean, id long, n_words long, n_features long, tag long").persist()
    ordered = sorted(rows)
    for k in (1, 2, 30, 59, 60):
        assert rs.kth_key(keys, k, pivots) == ordered[k - 1]
    assert rs.kth_key(keys, 61, pivots) is None and rs.kth_key(keys.filter(F.lit(False)), 1, pivots) is None

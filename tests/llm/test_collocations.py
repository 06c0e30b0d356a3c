import random
import re
import time
from collections import Counter

import pytest

from tripweave.llm import collocations as co
from tripweave.llm.queries import QUERIES


def plain(rows, longest=3, least=10, top=2000, p=50, q=100):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything in memory. Rows: (text, lang)."""
    counts = {}
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        good = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        held = Counter()
        for w, c in good.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    held[w[i : i + k]] = max(held[w[i : i + k]], c)
        found = []
        for w, a in good.items():
            if q * held[w] < p * a or not held[w]:
                cuts = [(1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w))]
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed=1):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "new", "york", "é", "Ünder", "x\x1cy", "-"]
    rows = []
    for _ in range(150):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            parts += ["New", "York", "city"]
        rows.append((rng.choice([" ", "  ", "\t"]).join(parts).replace(" of", rng.choice([" of", ". of", "\nof", "\x0bof"])), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", "fr"), (" .,\n", None), ("one two", "es")] + [("aa aa aa aa", "rep")] * 5


SCHEMA = "text string, lang string"


@pytest.mark.parametrize("options", [{}, {"chunk": 50}, {"longest": 2}, {"longest": 5, "least": 4, "chunk": 300}, {"top": 7}, {"within": (90, 100)}])
def test_phrases_equal_brute_force(spark, options):
    rows = texts()
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as chunk", "'x' as phrase", "2 as gid").repartition(3)
    plainly = {k: v for k, v in options.items() if k not in ("chunk", "within")}
    if "within" in options:
        plainly["p"], plainly["q"] = options["within"]
    want = plain(rows, **plainly)
    got = co.collocations(table, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(want) > 10 and sorted(map(tuple, got.collect())) == want


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect()
    assert sorted(map(tuple, QUERIES["op11_collocations"](spark, data).collect())) == plain(docs)


def test_odd_and_empty_tables(spark, odd, no_docs):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert sorted(map(tuple, co.collocations(odd).collect())) == plain(rows)
    assert co.collocations(no_docs).count() == 0
    assert co.collocations(spark.createDataFrame([("one two three", "en")] * 3, SCHEMA)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**13 + 1, 3 * 10**13 + 7, 3 * 10**13 + 5
    row = spark.createDataFrame([(a, [left], [right])], "a long, heads array<long>, tails array<long>")
    assert row.select(co._cut_scores(2)["score"]).first()[0] == 10**6 * a * a // (left * right)


def test_words_at_borders():
    assert co.tokens(b"Ab.c  D\te\x1cF\n\xc3\x89") == [b"ab", b".", b"c", b"d", b"e\x1cf", b".", b"\xc3\x89"]


def test_candidates_are_shuffled_packed_and_once(spark):
    """Counting shuffles each candidate once, and the semi-join sends numbers back; all that is written stays under 9 bytes a word."""
    rng = random.Random(5)
    words = [f"word{int(rng.paretovariate(0.5))}" for _ in range(300_000)]
    table = spark.createDataFrame([(" ".join(words[i : i + 300]), "en") for i in range(0, len(words), 300)], SCHEMA).repartition(3)

    def written():
        time.sleep(2)  # the store lags behind
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    table.count()
    before = written()
    assert co.collocations(table, least=2, chunk=20_000).count() == 2000
    assert written() - before < 9 * len(words)


def test_packed_numbers():
    import numpy as np

    for x in ([], [0], [255, 256, 0], [2**40, 3, 2**33 + 1]):
        assert co._unpacked(co._packed(np.array(x, np.int64))).tolist() == x

import random

from tripweave.llm import decontamination as dc


def plain_leaks(docs, items):
    """Shingle shares in any run of twice the longest item's words, item by item."""
    prepared = [(i, dc.words_of(t)) for i, t in items if dc.words_of(t)]
    step = max(32, max(len(w) for _, w in prepared))
    out = set()
    for doc, text in docs:
        words = dc.words_of(text)
        for item, w in prepared:
            size = min(5, len(w))
            every, question, answer = dc.Index._parts(w)
            for lo in range(0, max(1, len(words)), step):
                part = words[lo : lo + 2 * step]
                held = {tuple(part[i : i + size]) for i in range(len(part) - size + 1)}
                share = lambda s, h=held: len(s & h) / len(s)
                if share(every) >= 0.8 and min(share(question), share(answer)) >= 0.5:
                    out.add((doc, item))
    return out


def corpus():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(300)] + ["the", "of"] * 40
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(6, 40)).capitalize() + ".") for i in range(60)] + [(60, "two words"), (61, ""), (62, None), (63, "Solo")]
    docs = []
    for d in range(150):
        body = text(rng.randint(0, 300)).split()
        if d % 3 == 0:
            item = dict(items)[rng.randrange(60)].split()
            if d % 2:
                item[rng.randrange(len(item))] = "changed"
            if d % 5 == 0:
                item = [w.upper() + "," for w in item]
            if d % 12 == 0:
                item = item[: len(item) * 3 // 4]
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((d, " ".join(body)))
    return docs + [(150, None), (151, ""), (152, "two words here"), (153, "solo")], items


def test_leaks_are_the_plain_ones(spark, make_docs):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, "more") for i, t in items] + [(None, "x y z a b c", "")], "item_id long, text string, score string")
    got = [(r.doc_id, r.item_id) for r in dc.find_leaks(make_docs(docs), table).collect()]
    want = plain_leaks(docs, items)
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    clean = dc.drop_leaking(make_docs(docs), table)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_several_indexes_find_the_same(spark, make_docs, monkeypatch):
    docs, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    parts = dc.indexes(table, 17)
    assert len(parts) == 4 and sum(len(p.ids) for p in parts) == 62
    whole = sorted(map(tuple, dc.find_leaks(make_docs(docs), table).collect()))
    monkeypatch.setattr(dc.indexes, "__defaults__", (17,))
    assert whole and sorted(map(tuple, dc.find_leaks(make_docs(docs), table).collect())) == whole  # scores too


def test_wand_equals_the_full_sum():
    _, items = corpus()
    index = dc.Index(items)
    rng = random.Random(2)
    for _ in range(200):
        item = rng.choice(index.words)
        terms = {index.vocabulary[w] for w in rng.sample(item, rng.randint(1, len(item)))} | {rng.randrange(len(index.vocabulary)) for _ in range(30)}
        full = {}
        for t in terms:
            for i, w in zip(index.items[t], index.weights[t]):
                full[i] = full.get(i, 0) + w
        assert {i for i, _ in index.search(terms)} == {i for i, w in full.items() if w >= 1 + 1e-12} | ({i for i, _ in index.search(terms)} & {i for i, w in full.items() if abs(w - 1) < 1e-12})


def test_empty_tables(spark, odd, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(odd, none).count() == 0 and dc.drop_leaking(odd, none).count() == odd.count()
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert sorted(map(repr, (r.doc_id for r in dc.find_leaks(odd, some).collect()))) == ["6", "6", "None"]
    assert dc.find_leaks(no_docs, some).count() == 0

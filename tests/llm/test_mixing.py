import pytest

from tripweave.llm import mixing


def plain_targets(sizes, share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**out, **{s: level * weight[s] for s in left}}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= over
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 3, "c": 40, "d": 7, None: 500}, {"z": 5}, {"a": 0, "b": 10}, {"é": 9, "e": 900, "Z": 30, "~": 4, "漢": 77},
])
def test_targets_are_the_reshared_ones(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_meets_every_target(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault((r.source, r.target), []).append(r.taken)
    for (_, target), words in taken.items():
        assert abs(sum(words) - target) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_odd_rows(odd, no_docs):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert {r.size for r in rows if r.doc_id in (1, 2, 3, 9)} == {0}
    assert {r.source_size for r in rows if r.source == "a"} == {0}
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_documents_come_as_often_as_taken(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    times = {r.doc_id: -(-r.taken // r.size) if r.size else 1 for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in times.items() if n}


def test_ids_shared_by_sources_and_any_column_names(spark):
    rows = [(i % 50, " ".join(["w"] * (10 + i % 7)), "a" if i < 50 else "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _id", "2 as _size", "3 as _times", "4 as row", "5 as tag", "6 as size")
    planned = mixing.mix(docs).collect()
    wanted = sum(-(-r.taken // r.size) * r.size for r in planned)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == wanted
    assert wanted - sum(r.taken for r in planned) < 2 * 17


def test_texts_are_stored_once(spark, data, monkeypatch):
    """The rows were stored with their texts, and beside them all the copies that the mix takes."""
    from tripweave.llm import common

    texts = []

    def spy(df, *args, **kwargs):
        texts.append("text" in df.columns or "row" in df.columns)
        return common.stored(df, *args, **kwargs)

    monkeypatch.setattr(mixing, "stored", spy)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert sum(texts) == 1
    assert out.count() == out.count() > docs.count() and sum(texts) == 1

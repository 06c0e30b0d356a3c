import random

import pytest

from tripweave.llm import near_copies


def plain_groups(texts):
    """Root of each text: links at a five-word Jaccard similarity of 0.8 or more, all pairs compared."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def crowd():
    """Near copies at many distances, chains of them, a crowd around one text and a line that all share."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    line = [word() for _ in range(30)]
    texts = ["one two three", "One  two three", None, " ", ""]
    for _ in range(40):
        words = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(5):
            texts.append(" ".join(words + line * rng.randint(0, 1)))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(200)]
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(200)] = word()
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [256, 16])
def test_one_of_each_brute_force_group_stays(make_docs, monkeypatch, block):
    texts = crowd()
    roots = plain_groups(texts)
    assert 40 < len(set(roots)) < len(texts) - 100
    got = near_copies.drop_near_copies(make_docs(list(enumerate(texts))), block=block)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(roots))


def test_stage_drops_near_copies_simhash_leaves(spark, data):
    import corpus_pipeline as cp
    from tripweave.llm import simhash

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    kept = cp.near_duplicates(spark, docs, data)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [rows[i].doc_id for i in sorted(set(plain_groups([r.text for r in rows])))]
    assert kept.count() < simhash.near_duplicates(docs).select("component_id").distinct().count()


def test_empty_table(no_docs):
    assert near_copies.drop_near_copies(no_docs).count() == 0


def test_one_row_of_each_group_stays(make_docs, odd):
    got = near_copies.drop_near_copies(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 6, 7, 8, 10, 12]
    bare = make_docs([(None, "only here and nowhere else")] * 3 + [(3, "Another text"), (3, "another  TEXT"), (3, "a third one")])
    assert sorted((r.doc_id or 0) for r in near_copies.drop_near_copies(bare).collect()) == [0, 3, 3]


def test_a_text_goes_to_python_once_in_small_batches(spark, make_docs, monkeypatch):
    """Long texts filled batches of up to 64 MB twice each, as the text and inside the row beside it."""
    from tripweave.llm import common

    written = []

    def spy(df, *args, **kwargs):
        written.append((df, int(spark.conf.get(common.BATCH_CONF).removesuffix("b"))))
        return common.stored(df, *args, **kwargs)

    monkeypatch.setattr(near_copies, "stored", spy)
    docs = make_docs([(i, f"Text {i % 2} of its own. " * 100) for i in range(20)])
    before = spark.conf.get(common.BATCH_CONF)
    got = near_copies.drop_near_copies(docs)
    assert got.dtypes == docs.dtypes and sorted((r.doc_id, r.text[:7]) for r in got.collect()) == [(0, "Text 0 "), (1, "Text 1 ")]
    marked, size = next(w for w in written if "keys" in w[0].columns)
    names = [f.name for c in marked.schema.fields for f in ([c] if c.dataType.typeName() != "struct" else c.dataType.fields)]
    assert names.count("text") == 1 and size <= 4 << 20
    assert spark.conf.get(common.BATCH_CONF) == before


def test_small_batches_bound_bytes_and_lose_no_row(spark):
    import pyarrow as pa

    from tripweave.llm.common import BATCH_BYTES, small_batches, stored

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    rows = spark.range(0, 1500, 1, 1).selectExpr("repeat('0123456789', if(id = 7, 600000, 1000)) as text")
    with small_batches(spark):
        got = stored(rows.mapInArrow(sizes, "n long, bytes long")).collect()
    assert sum(r.n for r in got) == 1500
    assert all(r.bytes <= BATCH_BYTES + 6_100_000 for r in got) and sorted(r.bytes for r in got)[-2] <= BATCH_BYTES + 20_000


def _shuffled(node, column):
    """Rows written by the executed plan's shuffles of ``column``."""
    name = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    children = node.children()
    rows = sum(_shuffled(n, column) for n in inner + [children.apply(i) for i in range(children.size())])
    output = node.output()
    if name == "ShuffleExchangeExec" and column in [output.apply(i).name() for i in range(output.size())]:
        rows += node.metrics().apply("shuffleRecordsWritten").value()
    return rows


def test_texts_are_not_shuffled_to_drop_a_few(spark, make_docs, monkeypatch):
    """At the end all rows were shuffled with their texts, as soon as the kept ids were too many to be broadcast."""
    from tripweave.llm import common

    moved = []

    def spy(df, *args, **kwargs):
        if kwargs.get("keep"):
            df.collect()
            moved.append(_shuffled(df._jdf.queryExecution().executedPlan(), "text"))
        return common.stored(df, *args, **kwargs)

    monkeypatch.setattr(near_copies, "stored", spy)
    rng = random.Random(6)
    texts = [" ".join(str(rng.random()) for _ in range(30)) for _ in range(300)]
    docs = make_docs(list(enumerate(texts + texts[:40])))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_copies.drop_near_copies(docs)
        assert sorted(r.doc_id for r in got.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(moved) == 1 and moved[0] < 10


@pytest.mark.parametrize("bits", [24, 7])
def test_sieve_parts_the_rows_and_loses_none(spark, bits):
    from tripweave.llm.common import sieve

    rows = spark.range(2000).selectExpr("if(id = 7, null, id) as k", "id as v")
    wanted = spark.range(0, 2000, 20).selectExpr("id as k")
    held, rest = sieve(rows, "k", wanted, bits)
    assert held.columns == rest.columns == rows.columns
    held, rest = {r.v for r in held.collect()}, {r.v for r in rest.collect()}
    assert not held & rest and held | rest == set(range(2000)) and held >= set(range(0, 2000, 20))
    none, every = sieve(rows, "k", wanted.limit(0), bits)
    assert none.count() == 0 and every.count() == 2000

"""Each stage of the pipeline against a plain version of its decision."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline as cp
from tripweave.llm import decontamination, quality_trees
from tripweave.llm.queries import quality_model


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    tables = [spark.read.parquet(f"{data}/documents.parquet")]
    for name, stage in cp.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, tables[-1], data).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_stages_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    for t in steps[1:-1]:
        assert t.columns == steps[0].columns


def test_quality_rejects_by_the_model(spark, data, steps):
    model = quality_model(spark, data)
    scores = {r.doc_id: float(model.score(quality_trees.np.array([quality_trees.statistics(r.text)]))[0]) for r in steps[0].collect()}
    assert {r.doc_id for r in steps[1].collect()} == {i for i, s in scores.items() if s >= quality_trees.THRESHOLD}


def test_one_of_each_group_stays(steps):
    from test_near_copies import plain_groups

    rows = sorted(steps[1].collect(), key=lambda r: r.doc_id)
    first = set(plain_groups([r.text for r in rows]))
    assert len(first) < len(rows)
    assert sorted(r.doc_id for r in steps[2].collect()) == [rows[i].doc_id for i in sorted(first)]


def test_no_leak_stays_and_no_other_goes(spark, data, steps):
    from test_decontamination import plain_leaks

    docs = [(r.doc_id, r.text) for r in steps[2].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {d for d, _ in plain_leaks(docs, items)}
    assert leaks and {r.doc_id for r in steps[3].collect()} == {d for d, _ in docs} - leaks
    assert decontamination.find_leaks(steps[3], spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0


def test_mix_follows_targets(steps):
    from test_mixing import plain_targets

    size = lambda t: len((t or "").encode().split())
    before, after = steps[3].collect(), Counter()
    sizes = Counter()
    for r in before:
        sizes[r.source] += size(r.text)
    for r in steps[4].collect():
        after[r.source] += size(r.text)
    largest = max(size(r.text) for r in before)
    for source, target in plain_targets(dict(sizes)).items():
        assert target - 1 <= after[source] <= target + largest


def test_every_row_has_its_slot(steps):
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and all(r.slot < sizes[r.shard] for r in rows)
    crc = Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in steps[4].collect())
    assert crc == Counter((r.doc_id, r.text_crc32) for r in rows)


def test_odd_and_empty_documents_go_through(spark, data, odd, no_docs):
    for docs in (odd, no_docs):
        out = docs
        for name, stage in cp.STAGES:
            before, out = out, stage(spark, out, data)
            if name != "sharding":
                assert out.columns == docs.columns
                assert name == "mixing" or out.count() <= before.count()
        assert out.count() == before.count()


def test_run_gives_the_same(spark, data, steps):
    assert sorted(map(tuple, cp.run(spark, data).collect())) == sorted(map(tuple, steps[5].collect()))


def test_run_leaves_no_texts_of_finished_stages(spark, data):
    """What a stage returned was stored by the stage and again by run(); the first copy stayed."""
    import os
    from glob import glob

    from tripweave.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    cp.run(spark, data)
    made = [f"{folder}/{name}" for name in set(os.listdir(folder)) - before if glob(f"{folder}/{name}/*.parquet")]
    tables = [spark.read.parquet(f"file://{path}").columns for path in made]
    assert [c for c in tables if "text" in c or "row" in c] == [spark.read.parquet(f"{data}/documents.parquet").columns]

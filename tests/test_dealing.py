"""Narrow tables are dealt over tasks before their rows are multiplied or sorted."""

from tripweave import queries as bound
from tripweave.operators import ranking
from tripweave.queries import statistics, surveys
from tripweave.tables import dealt

bound.load_all()


def tasks(df):
    return df.rdd.getNumPartitions()


def test_dealing_is_not_merged_and_stays_below_the_sorting_shuffle(spark):
    rows = spark.range(100)
    assert tasks(dealt(rows, "id")) == 4
    spark.conf.set("spark.sql.shuffle.partitions", "700")
    try:
        assert tasks(dealt(rows, "id")) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_choices_of_one_file_are_made_in_many_tasks(spark, data):
    assert tasks(surveys.choices(spark, data)) == 4


def test_ratings_of_one_file_are_made_in_many_tasks(spark, data):
    assert tasks(surveys.ratings(spark, data)) == 4


def test_compared_models_share_one_table_of_observations(spark, data, monkeypatch):
    stored = []
    cut = statistics.cut_lineage
    monkeypatch.setattr(statistics, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    got = {r["model"]: r["ll"] for r in statistics.choice_model_comparison(spark, data).collect()}
    assert stored == [["obs_id", "x", "pos"]]
    names = list(statistics.TERMS)[:3]
    alone = statistics.cm.fit_logit(statistics.standard_tasks(spark, data, names), names, 3)
    assert got["cost only"] == round(alone.loglik, 6)


def test_extremes_pass_on_few_rows_of_a_hot_key(spark):
    data = [("hot", i, float(i % 97)) for i in range(400)] + [("nine", i, 1.0) for i in range(9)] + [("null", i, None) for i in range(20)]
    data += [("ten", i, float(-i)) for i in range(10)] + [(None, i, float(i)) for i in range(12)]
    out = ranking.extremes(spark.createDataFrame(data, "k string, i int, v double"), "k", "v", "i")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan and "REPARTITION_BY_NUM" in plan
    got = {}
    for r in out.collect():
        got.setdefault((r["k"], r["side"]), []).append((r["rank"], r["i"]))
    def picked(items, low):
        best = sorted(items, key=lambda t: (t[2] if low else -t[2], t[1]))[:5]
        return [(n, t[1]) for n, t in enumerate(best, 1)]
    want = {(k, s): picked([t for t in data if t[0] == k], s == "bottom") for k in ("hot", "ten", None) for s in ("top", "bottom")}
    assert {k: sorted(v) for k, v in got.items()} == want

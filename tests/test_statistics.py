"""Statistics and fits against closed forms and known coefficients."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripweave.operators import choice_models as cm
from tripweave.operators import linear, posterior, psychometrics, tails


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[:, 2] += 0.8 * x[:, 0]
    y = 1.5 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(size=400)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.f_upper(3.0, 2, 20) == pytest.approx(0.0725, abs=1e-4)
    assert tails.chi2_upper(5.0, 3) == pytest.approx(0.1717971, abs=1e-6)
    assert tails.chi2_upper(40.0, 3) == pytest.approx(1.0655e-8, rel=1e-3)
    assert tails.normal_two_sided(1.96) == pytest.approx(0.0499958, abs=1e-6)
    assert tails.f_quantile(1 - tails.f_upper(2.5, 4, 30), 4, 30) == pytest.approx(2.5)


def test_ols_matches_lstsq(spark, sample):
    table, fit = linear.ols(spark.createDataFrame(sample), "y", ["a", "b", "c"])
    got = {r["parameter"]: r for r in table.collect()}
    x = np.column_stack([np.ones(400), sample[["a", "b", "c"]]])
    beta, rss = np.linalg.lstsq(x, sample["y"], rcond=None)[:2]
    cov = np.linalg.inv(x.T @ x) * rss[0] / 396
    for i, name in enumerate(["const", "a", "b", "c"]):
        assert got[name]["estimate"] == pytest.approx(beta[i]) and got[name]["se"] == pytest.approx(math.sqrt(cov[i, i]))
    assert fit.first()["r2"] == pytest.approx(1 - rss[0] / ((sample["y"] - sample["y"].mean()) ** 2).sum())


def test_vif_uncentred(spark, sample):
    shifted = sample[["a", "b", "c"]] + 2.0
    got = {r["variable"]: r["vif"] for r in linear.vif(spark.createDataFrame(shifted), ["a", "b", "c"]).collect()}
    for c in "abc":
        others = shifted.drop(columns=c).to_numpy()
        fitted = others @ np.linalg.lstsq(others, shifted[c], rcond=None)[0]
        r2 = 1 - ((shifted[c] - fitted) ** 2).sum() / (shifted[c] ** 2).sum()
        assert got[c] == pytest.approx(1 / (1 - r2))


@pytest.mark.parametrize("scale", ["zscore", "minmax"])
def test_components(spark, sample, scale):
    x = sample[["a", "b", "c"]]
    z = (x - x.mean()) / x.std(ddof=0) if scale == "zscore" else (x - x.min()) / (x.max() - x.min())
    pca = linear.PrincipalComponents(spark.createDataFrame(sample), ["a", "b", "c"], scale)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert pca.values == pytest.approx(values)
    scores = np.array([r[0] for r in pca.scores(spark.createDataFrame(x), 1).select("pc1").collect()])
    assert scores.mean() == pytest.approx(0, abs=1e-9) and scores.var(ddof=1) == pytest.approx(values[0])
    assert pca.counts()["n95"] == int(np.searchsorted(np.cumsum(values / values.sum()), 0.95) + 1)


def test_spearman_matches_pandas(spark, sample):
    s = sample.round(1)
    assert linear.spearman(spark.createDataFrame(s), "a", "c").first()["rho"] == pytest.approx(s["a"].rank().corr(s["c"].rank()))


def test_kmo_matches_direct(spark, sample):
    items, overall = psychometrics.kmo_bartlett(spark.createDataFrame(sample), ["a", "b", "c", "y"])
    r = sample[["a", "b", "c", "y"]].corr().to_numpy()
    inv = np.linalg.inv(r)
    p = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(4, dtype=bool)
    row = overall.first()
    assert row["kmo"] == pytest.approx((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (p[off] ** 2).sum()))
    assert row["chi2"] == pytest.approx(-(399 - 13 / 6) * math.log(np.linalg.det(r))) and items.count() == 4


def test_alpha_interval(spark, sample):
    r = psychometrics.cronbach_alpha(spark.createDataFrame(sample), {"s": ["a", "c"]}).first()
    x = sample[["a", "c"]]
    want = 2 * (1 - x.var().sum() / x.sum(axis=1).var())
    assert r["alpha"] == pytest.approx(want) and r["low"] < want < r["high"]


def ordinal_alpha(matrix):
    values = sorted({v for u in matrix for v in u})
    o = {(a, b): 0.0 for a in values for b in values}
    for u in matrix:
        for i, a in enumerate(u):
            for j, b in enumerate(u):
                if i != j:
                    o[a, b] += 1 / (len(u) - 1)
    n = {a: sum(o[a, b] for b in values) for a in values}
    d = {(a, b): (sum(n[v] for v in values if min(a, b) <= v <= max(a, b)) - (n[a] + n[b]) / 2) ** 2 for a in values for b in values}
    total = sum(n.values())
    return 1 - (total - 1) * sum(o[k] * d[k] for k in o) / sum(n[a] * n[b] * d[a, b] for a in values for b in values)


def test_krippendorff_matches_pairs(spark):
    rng = np.random.default_rng(4)
    units = [[int(v) for v in np.clip(rng.normal(u, 1, size=rng.integers(2, 6)).round() + 1, 1, 5)] for u in range(5)]
    df = spark.createDataFrame([(u, v) for u, vs in enumerate(units) for v in vs] + [(9, 3)], "u int, v int")
    assert psychometrics.krippendorff_ordinal(df, "u", "v", [1, 2, 3, 4, 5]).first()["alpha"] == pytest.approx(ordinal_alpha(units))


def test_krippendorff_counts_values_outside_the_scale(spark):
    rows = [(1, 1), (1, 2), (2, 3), (2, 3), (2, 9), (3, 0), (4, None)]
    df = spark.createDataFrame(rows, "u int, v int")
    out = psychometrics.krippendorff_ordinal(df, "u", "v", [1, 2, 3]).first()
    assert (out.n_pairable, out.n_outside) == (4.0, 2)
    assert out.alpha == pytest.approx(ordinal_alpha([[1, 2], [3, 3]]))
    none = psychometrics.krippendorff_ordinal(df.filter("u > 2"), "u", "v", [1, 2, 3]).first()
    assert (none.n_pairable, none.n_outside, none.alpha) == (0.0, 1, None)
    assert psychometrics.krippendorff_ordinal(df.limit(0), "u", "v", [1, 2, 3]).first().n_outside == 0


def test_special_functions():
    x = np.array([0.3, 1.0, 2.5, 7.9, 40.0])
    assert cm._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-10)
    h = 1e-5
    assert cm._digamma(x) == pytest.approx([(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], abs=1e-5)
    assert cm._trigamma(x) == pytest.approx([(cm._digamma(np.array([v + h]))[0] - cm._digamma(np.array([v - h]))[0]) / (2 * h) for v in x], rel=1e-5)


@pytest.fixture(scope="module")
def choice_long():
    rng = np.random.default_rng(8)
    n = 3000
    cost, med = rng.uniform(0, 4, size=(n, 3)), rng.integers(0, 2, size=(n, 3)).astype(float)
    cost[:, 2] = med[:, 2] = 0
    v = -0.8 * cost + 0.5 * med + np.array([0.3, -0.2, 0.0])
    chosen = (v + rng.gumbel(size=v.shape)).argmax(axis=1)
    return pd.DataFrame({
        "obs": np.repeat(np.arange(n), 3), "alt": np.tile([0, 1, 2], n), "cost": cost.ravel(), "beta_med": med.ravel(),
        "chosen": (np.tile([0, 1, 2], n) == np.repeat(chosen, 3)).astype(int),
    })


TERMS = {"ASC_A": (None, [0]), "ASC_B": (None, [1]), "cost": ("cost", [0, 1]), "beta_med": ("beta_med", [0, 1])}


def test_logit_recovers_coefficients(spark, choice_long):
    arrays = cm.choice_arrays(spark.createDataFrame(choice_long), "obs", "alt", [0, 1, 2], TERMS)
    fit = cm.fit_logit(arrays, list(TERMS), 3)
    assert np.abs(fit.gradient).max() < 1e-4
    se = np.sqrt(np.diag(fit.covariance))
    assert (np.abs(fit.beta - np.array([0.3, -0.2, -0.8, 0.5])) < 4 * se).all()
    small = cm.fit_logit(cm.choice_arrays(spark.createDataFrame(choice_long), "obs", "alt", [0, 1, 2], {k: TERMS[k] for k in ("ASC_A", "ASC_B")}), ["ASC_A", "ASC_B"], 3)
    shares = choice_long.query("chosen == 1")["alt"].value_counts(normalize=True)
    assert small.beta == pytest.approx([math.log(shares[0] / shares[2]), math.log(shares[1] / shares[2])], abs=1e-5)
    assert cm.lr_test(spark, small, fit, "x").first()["df"] == 2
    assert fit.measures()["rho2"] > small.measures()["rho2"]


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(9)
    n = 3000
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n)]).astype(float)
    base, phi = rng.uniform(50, 200, n), 2.5
    mu = base * np.exp(x @ np.array([0.4, -0.3]))
    y = rng.poisson(mu * rng.gamma(phi, 1 / phi, n))
    return pd.DataFrame({"n": y, "base": base, "beta_med": x[:, 0], "z": x[:, 1]})


def test_counts_recover_coefficients(spark, counts):
    rows = cm.count_rows(spark.createDataFrame(counts), "n", "base", ["beta_med", "z"])
    fit = cm.fit_counts(rows, ["beta_med", "z"], {"beta_med": (0.0, 10.0), "z": (0.0, 10.0)})
    assert np.abs(fit.gradient).max() < 1e-3
    se = np.sqrt(np.diag(fit.covariance))
    assert (np.abs(fit.beta - np.array([0.4, -0.3, math.log(2.5)])) < 4 * se + 0.02).all()
    back = cm.priors_from(cm.prior_table(spark, fit, "x"), fit.names)
    assert back["z"] == pytest.approx((fit.beta[1], se[1]))
    predicted = cm.expected_counts(spark.createDataFrame(counts), fit, "base", ["beta_med", "z"], "p")
    assert cm.fit_metrics(predicted, "n", "p").first()["r"] > 0.3


def test_joint_reduces_to_its_parts(spark, choice_long, counts):
    arrays = cm.choice_arrays(spark.createDataFrame(choice_long), "obs", "alt", [0, 1, 2], TERMS)
    rows = cm.count_rows(spark.createDataFrame(counts), "n", "base", ["beta_med", "z"])
    only = cm.fit_joint(None, [], 3, rows, ["beta_med", "z"], {"beta_med": (0.0, 10.0), "z": (0.0, 10.0)})
    alone = cm.fit_counts(rows, ["beta_med", "z"], {"beta_med": (0.0, 10.0), "z": (0.0, 10.0)})
    assert only.beta == pytest.approx(alone.beta, abs=1e-6)
    both = cm.fit_joint(arrays, list(TERMS), 3, rows, ["beta_med", "z"], {})
    choice_only = cm.fit_logit(arrays, list(TERMS), 3)
    shared = both.beta[both.names.index("beta_med")]
    assert min(alone.beta[0], choice_only.beta[3]) - 1e-6 <= shared <= max(alone.beta[0], choice_only.beta[3]) + 1e-6


def test_newton_leaves_a_convex_region_beside_steep_parameters():
    def evaluate(b):
        gap = b[1] - 5
        bend = 1 + gap * gap
        value = -5e7 * (b[0] - 1) ** 2 - 1e3 * math.log(bend)
        grad = np.array([-1e8 * (b[0] - 1), -2e3 * gap / bend])
        return value, grad, np.diag([-1e8, -2e3 * (1 - gap * gap) / bend**2])

    beta, _, grad, _, steps = cm._newton(evaluate, np.zeros(2))
    assert beta == pytest.approx([1.0, 5.0]) and steps < 20


def test_count_sums_of_a_step_too_far_are_not_finite():
    batch = {"x": np.ones((2, 1)), "y": np.array([1.0, 2.0]), "offset": np.zeros(2)}
    assert not np.isfinite(cm._count_parts(np.array([0.0, 1000.0]))(batch)[0])


def test_draws_and_robustness(spark):
    draws = spark.createDataFrame([(c, i, p, v) for c in range(2) for i in range(50) for p, v in (("pos", 1.0 + i / 100), ("zero", i - 24.5))], "chain int, draw int, param string, value double")
    out = {r["param"]: r for r in posterior.draws_summary(draws).collect()}
    assert out["pos"]["significant"] and out["pos"]["verdict"] == "positive"
    assert not out["zero"]["significant"] and out["zero"]["verdict"] == "uncertain"
    runs = spark.createDataFrame(
        [("b", "baseline", "ok", 1.0, 0.5, "Yes"), ("x", "k", "ok", 1.2, 0.5, "Yes"), ("b", "baseline", "far", 1.0, 0.1, "Yes"), ("x", "k", "far", 1.2, 0.1, "Yes"),
         ("b", "baseline", "flip", 1.0, 0.5, "Yes"), ("x", "k", "flip", 1.1, 0.5, "No")],
        "tag string, varied_param string, parameter string, mean double, sd double, significant string",
    )
    assert {r["parameter"]: r["robust"] for r in posterior.robustness(runs).collect()} == {"ok": True, "far": False, "flip": False}
    grid = posterior.parameter_grid(spark)
    assert grid.count() == 7 and grid.filter(F.col("varied_param") == "baseline").count() == 1


def test_survey_to_joint_recovers_known_coefficients(spark):
    """Choices with cost, size and four attitude terms, and counts that share the size coefficient."""
    import numpy as np
    from tripweave.operators import choice_models as cm
    from tripweave.plans import joint_estimation as je

    rng = np.random.default_rng(12)
    true = {"asc": 0.4, "cost": -0.8, "beta_lrg": 0.7, "att1": 0.5, "att2": -0.5, "att3": 0.3, "att4": 0.0}
    long = []
    for i in range(3000):
        att = rng.normal(size=4)
        cost, large = rng.random(3) * 3, rng.integers(0, 2, 3)
        u = true["cost"] * cost + true["beta_lrg"] * large + rng.gumbel(size=3)
        u[:2] += true["asc"] + sum(true[f"att{k + 1}"] * att[k] for k in range(4))
        for j in range(3):
            long.append((i, j, int(j == u.argmax()), float(cost[j]), float(large[j]), *map(float, att)))
    df = spark.createDataFrame(long, "obs int, alt int, chosen int, cost double, large double, a1 double, a2 double, a3 double, a4 double")
    terms = {"asc": (None, [0, 1]), "cost": ("cost", [0, 1, 2]), "beta_lrg": ("large", [0, 1, 2]), **je.person_terms({f"att{k}": f"a{k}" for k in (1, 2, 3, 4)}, [0, 1])}
    arrays = cm.choice_arrays(df, "obs", "alt", [0, 1, 2], terms)
    large = rng.integers(0, 2, 2000)
    base = 3 + 4 * rng.random(2000)
    counts = spark.createDataFrame([(float(rng.poisson(b * np.exp(0.7 * x) * rng.gamma(8, 1 / 8))), float(b), float(x)) for b, x in zip(base, large)], "n double, base double, beta_lrg double")
    out = je.run(arrays, list(terms), 3, cm.count_rows(counts, "n", "base", ["beta_lrg"]), ["beta_lrg"], {})
    final = {r.parameter: r for r in out["final"].collect()}
    for name, value in true.items():
        assert abs(final[name].mean - value) < 4 * final[name].sd and final[name].converged
    assert final["beta_lrg"].layer == "shared" and final["cost"].layer == "choice" and final["beta_lrg"].p_positive > 0.99
    survey = {r.parameter: r for r in out["handover"].filter("source = 'survey'").collect()}
    assert final["beta_lrg"].sd < survey["beta_lrg"].prior_sigma


def test_crowded_ranges_are_cut_again(spark, monkeypatch):
    """With three rows a range, several rounds cut every range; quantiles, ranks and running sums stay exact."""
    import random

    from pyspark.sql import functions as F

    from tripweave.operators import quantiles as q

    rng = random.Random(3)
    rows = [(k, float(rng.choice([rng.gauss(0, 1), rng.randint(0, 5), 1e9, float("inf")]))) for k in "aab" for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.1, "mid": 0.5, "hi": 0.93}
    plain = {c: (q.exact_quantiles(df, ["k"], "v", probs), q.average_ranks(df, "v", "r", ["k"])) for c in "x"}["x"]
    want = [sorted(map(tuple, d.collect()), key=repr) for d in plain]
    rounds = []
    real = q.cut_lineage
    monkeypatch.setattr(q, "cut_lineage", lambda d, **o: rounds.append(d.columns) or real(d, **o))
    monkeypatch.setattr(q, "RANGE_ROWS", 3)
    counted = real(df.distinct().withColumn("_range", F.lit(0).cast("long")))
    cut = q.refine_ranges(counted, ["k"], "v")
    assert max(r["count"] for r in cut.groupBy("k", "_range").count().collect()) <= 3
    assert sum("_borders" in c for c in rounds) >= 2
    for k in "ab":
        one = sorted((r.v, r._range) for r in cut.collect() if r.k == k)
        assert [r for _, r in one] == sorted(r for _, r in one)
    got = [sorted(map(tuple, d.collect()), key=repr) for d in (q.exact_quantiles(df, ["k"], "v", probs), q.average_ranks(df, "v", "r", ["k"]))]
    assert got == want

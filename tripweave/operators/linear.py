"""Correlation, least squares, collinearity and principal components.

Spark sums moments in one pass over the data; only k x k matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.operators.quantiles import average_ranks
from tripweave.operators.tails import f_upper, t_two_sided


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance over complete rows, in one aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = _complete(df, cols).agg(
        F.count(F.lit(1)),
        *[F.avg(F.col(c)) for c in cols],
        *[F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")) for i, j in pairs],
    ).first()
    k = len(cols)
    if row[0] == 0:
        raise ValueError("no complete rows")
    mean = np.array(row[1 : 1 + k], dtype=float)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :]):
        cov[i, j] = cov[j, i] = v
    return int(row[0]), mean, cov


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, pairwise complete: (a, b, r, n)."""
    pairs = list(combinations(cols, 2))
    one = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
    )
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)
    ])
    return one.select(F.inline(rows))


def correlation_matrix(long: DataFrame) -> DataFrame:
    """Both triangles and the diagonal of a long correlation table."""
    names = long.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    diagonal = names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r"))
    return long.select("a", "b", "r").unionByName(
        long.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    ).unionByName(diagonal)


def strong_pairs(long: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Pairs with ``|r|`` at least the threshold, strongest first, with a label."""
    size = F.abs("r")
    return long.filter(size >= threshold).withColumn(
        "level", F.when(size >= 0.90, "VERY HIGH").otherwise("HIGH")
    ).orderBy(size.desc(), "a", "b")


def ranked(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Replace columns by their average ranks over rows complete in all of them."""
    df = _complete(df, [*keys, *cols])
    for c in cols:
        df = average_ranks(df, c, f"_rank_{c}", keys).drop(c).withColumnRenamed(f"_rank_{c}", c)
    return df


def safe_corr(a: str, b: str) -> Column:
    """Correlation as an aggregate; NULL, not an error, where a column does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of two columns, overall or per group."""
    both = ranked(df.select(*keys, a, b), [a, b], keys)
    return both.groupBy(*keys).agg(safe_corr(a, b).alias("rho"), F.count(F.lit(1)).alias("n"))


def rank_gap(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson, Spearman and their absolute difference per pair."""
    complete = _complete(df, cols)
    pearson = correlations(complete, cols).select("a", "b", F.col("r").alias("pearson"))
    rank = correlations(ranked(complete.select(*cols), cols), cols).select("a", "b", F.col("r").alias("spearman"))
    return pearson.join(rank, ["a", "b"]).withColumn("gap", F.abs(F.col("pearson") - F.col("spearman")))


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept and r of ``y`` on ``x``, one row."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r")
    )


def residualise(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """Add the residual of ``y`` on ``x``: the part of ``y`` orthogonal to ``x``."""
    line = df.agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"))
    return (
        df.crossJoin(F.broadcast(line))
        .withColumn(out, F.col(y) - (F.col("_slope") * F.col(x) + F.col("_intercept")))
        .drop("_slope", "_intercept")
    )


def interactions(cols: Sequence[str], flag: str) -> dict[str, Column]:
    """Product of each column with a 0/1 flag."""
    return {f"{c}_x_{flag}": F.col(c) * F.col(flag) for c in cols}


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Least squares with intercept.

    Returns the coefficient table (parameter, estimate, se, t, p) and the fit table
    (n, r2, adj_r2, f, f_p).
    """
    n, mean, cov = moments(df, [y, *xs])
    k = len(xs)
    sxx, sxy = cov[1:, 1:] * n, cov[1:, 0] * n
    beta = np.linalg.solve(sxx, sxy)
    rss = max(cov[0, 0] * n - beta @ sxy, 0.0)
    dof = n - k - 1
    s2 = rss / dof
    inverse = np.linalg.inv(sxx)
    constant = mean[0] - beta @ mean[1:]
    se = np.sqrt(s2 * np.array([1 / n + mean[1:] @ inverse @ mean[1:], *np.diag(inverse)]))
    estimates = [constant, *beta]
    rows = []
    for name, b, e in zip(["const", *xs], estimates, se):
        t = float(b / e)
        rows.append((name, float(b), float(e), t, t_two_sided(t, dof)))
    tss = cov[0, 0] * n
    r2 = float(1 - rss / tss)
    f = (r2 / k) / ((1 - r2) / dof)
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "parameter string, estimate double, se double, t double, p double")
    fit = spark.createDataFrame(
        [(n, r2, 1 - (1 - r2) * (n - 1) / dof, f, f_upper(f, k, dof))],
        "n bigint, r2 double, adj_r2 double, f double, f_p double",
    )
    return table, fit


def vif(df: DataFrame, cols: Sequence[str], centred: bool = False) -> DataFrame:
    """Variance inflation per column.

    Uncentred by default: each column is regressed on the others without an intercept.
    """
    n, mean, cov = moments(df, cols)
    gram = cov if centred else cov + np.outer(mean, mean)
    values = np.diag(np.linalg.inv(gram)) * np.diag(gram)
    spark = df.sparkSession
    table = spark.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "variable string, vif double")
    return table.withColumn(
        "status", F.when(F.col("vif") < 5, "OK").when(F.col("vif") < 10, "MODERATE").otherwise("HIGH")
    )


def scaled_covariance(df: DataFrame, cols: Sequence[str], scale: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Row count, centre, scale and sample covariance after ``zscore`` or ``minmax`` scaling."""
    n, mean, cov = moments(df, cols)
    if scale == "zscore":
        spread = np.sqrt(np.diag(cov))
    elif scale == "minmax":
        row = _complete(df, cols).agg(*[(F.max(c) - F.min(c)).cast("double") for c in cols]).first()
        spread = np.array(row, dtype=float)
    else:
        spread = np.ones(len(cols))
    spread = np.where(spread == 0, 1.0, spread)
    return n, mean, spread, cov / np.outer(spread, spread) * n / (n - 1)


def condition_number(df: DataFrame, cols: Sequence[str], scale: str = "minmax") -> float:
    """Square root of the ratio of the extreme positive eigenvalues."""
    values = np.linalg.eigvalsh(scaled_covariance(df, cols, scale)[3])
    values = values[values > 1e-15]
    return float(np.sqrt(values.max() / values.min()))


class PrincipalComponents:
    """Components of scaled columns. The largest loading of each is made positive."""

    def __init__(self, df: DataFrame, cols: Sequence[str], scale: str = "zscore"):
        self.cols, self.spark = list(cols), df.sparkSession
        _, self.mean, self.spread, cov = scaled_covariance(df, cols, scale)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1]
        self.values = np.clip(values[order], 0, None)
        vectors = vectors[:, order]
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(cols))])
        self.vectors = vectors * signs

    def variance(self) -> DataFrame:
        """Eigenvalue, ratio, running ratio and first-crossing mark per component."""
        ratio = self.values / self.values.sum()
        total = np.cumsum(ratio)
        rows = []
        for i, (v, r, c) in enumerate(zip(self.values, ratio, total)):
            before = total[i - 1] if i else 0.0
            marks = [m for m in (80, 90, 95) if c >= m / 100 - 1e-12 and before < m / 100 - 1e-12]
            rows.append((i + 1, float(v), float(r), float(c), marks[-1] if marks else None))
        return self.spark.createDataFrame(
            rows, "component int, eigenvalue double, ratio double, cumulative double, crosses int"
        )

    def counts(self) -> dict[str, int]:
        """Components with eigenvalue above 1, and needed for 80/90/95 %."""
        total = np.cumsum(self.values / self.values.sum())
        need = {f"n{m}": int(np.searchsorted(total, m / 100 - 1e-12) + 1) for m in (80, 90, 95)}
        return {"kaiser": int((self.values > 1).sum()), **need}

    def loadings(self) -> DataFrame:
        """(variable, component, loading)."""
        rows = [
            (c, j + 1, float(self.vectors[i, j])) for i, c in enumerate(self.cols) for j in range(len(self.cols))
        ]
        return self.spark.createDataFrame(rows, "variable string, component int, loading double")

    def scores(self, df: DataFrame, n: int = 1, prefix: str = "pc") -> DataFrame:
        """Add component scores as column expressions; an incomplete row gets NULL."""
        for j in range(n):
            score = F.lit(0.0)
            for c, m, s, w in zip(self.cols, self.mean, self.spread, self.vectors[:, j]):
                score = score + (F.col(c) - F.lit(float(m))) * F.lit(float(w / s))
            df = df.withColumn(f"{prefix}{j + 1}", score)
        return df


def cumulative_marks(df: DataFrame, order: str, share: str, marks: Mapping[str, float]) -> DataFrame:
    """Running total of shares by ``order`` and the first position reaching each mark."""
    from tripweave.operators.quantiles import running_total

    ran = running_total(df.select(order, share), [], order, share, "cumulative")
    return ran.agg(*[F.min(F.when(F.col("cumulative") >= m, F.col(order))).alias(n) for n, m in marks.items()])

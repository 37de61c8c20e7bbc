"""Aggregates behind the factor models: moments, Gram matrices, fits, diagnostics.

Data stay distributed: each pass returns one row of at most p(p+1)/2 + p sums,
and only the p by p system (p of about 10) is solved on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import sigmoid

RIDGE, VIF_RIDGE, VIF_ALERT = 1e-6, 1.0, 5.0


def moments(df: DataFrame, xs: list[str]) -> DataFrame:
    """One row of mean_<x> and std_<x>: unweighted, population; no spread gives 1."""
    dev = lambda x: F.when(F.stddev_pop(x) == 0, F.lit(1.0)).otherwise(F.stddev_pop(x))
    return df.agg(*(c for x in xs for c in (F.avg(x).alias(f"mean_{x}"), dev(x).alias(f"std_{x}"))))


def standardise(df: DataFrame, xs: list[str], m: DataFrame | None = None) -> DataFrame:
    m = moments(df, xs) if m is None else m
    rows = df.join(F.broadcast(m))  # one row
    return rows.withColumns({x: (F.col(x) - F.col(f"mean_{x}")) / F.col(f"std_{x}") for x in xs}).drop(*(f"{s}_{x}" for x in xs for s in ("mean", "std")))


def gram_columns(xs: list[Column], y: Column, w: Column) -> list[Column]:
    p = len(xs)
    out = [F.sum(w * xs[i] * xs[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    return out + [F.sum(w * xs[i] * y).alias(f"y{i}") for i in range(p)]


def gram(df: DataFrame, xs: list[str], y: str, w: str | None = None) -> DataFrame:
    """X'WX (upper part, x<i>_<j>) and X'Wy (y<i>) with an intercept at 0, in one
    aggregate row."""
    cols = [F.lit(1.0), *(F.col(x) for x in xs)]
    return df.agg(*gram_columns(cols, F.col(y), F.lit(1.0) if w is None else F.col(w)))


def _system(row: dict, p: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = row[f"x{i}_{j}"] or 0.0
    return a, np.array([row[f"y{i}"] or 0.0 for i in range(p)])


def fit_ols(df: DataFrame, xs: list[str], y: str, w: str, ridge: float = RIDGE) -> list[float]:
    """Weighted least squares by normal equations; the ridge is on the whole
    diagonal, intercept included."""
    a, b = _system(gram(df, xs, y, w).first().asDict(), len(xs) + 1)
    return np.linalg.solve(a + ridge * np.eye(len(a)), b).tolist()


def linear(xs: list[str], beta: list[float]) -> Column:
    out = F.lit(beta[0])
    for x, b in zip(xs, beta[1:], strict=True):
        out = out + F.col(x) * b
    return out


def fit_logistic(df: DataFrame, xs: list[str], y: str, w: str, ridge: float = RIDGE, rounds: int = 25, tolerance: float = 1e-7) -> list[float]:
    """Weighted logistic regression by iteratively reweighted least squares: one
    small aggregate of the (cached) design rows in each of at most ``rounds``."""
    p = len(xs) + 1
    beta = [0.0] * p
    cols = [F.lit(1.0), *(F.col(x) for x in xs)]
    for _ in range(rounds):
        eta = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), linear(xs, beta)))
        rows = df.withColumn("_eta", eta).withColumn("_mu", sigmoid("_eta"))
        rows = rows.withColumn("_v", F.greatest(F.lit(1e-6), F.col("_mu") * (1 - F.col("_mu"))))
        rows = rows.withColumn("_z", F.col("_eta") + (F.col(y) - F.col("_mu")) / F.col("_v"))
        a, b = _system(rows.agg(*gram_columns(cols, F.col("_z"), F.col(w) * F.col("_v"))).first().asDict(), p)
        new = np.linalg.solve(a + ridge * np.eye(p), b)
        moved = float(np.abs(new - beta).max())
        beta = new.tolist()
        if moved < tolerance:
            break
    return beta


def moments_where(df: DataFrame, xs: list[str], cases: dict[str, Column]) -> dict[str, dict]:
    """n, means and deviations (population; no spread gives 1) of the rows of each case,
    from one aggregate."""
    cols = []
    for k, case in cases.items():
        cols.append(F.count_if(case).alias(f"{k}_n"))
        cols += [f(F.when(case, F.col(x))).alias(f"{k}_{name}_{x}") for x in xs for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    row = df.agg(*cols).first().asDict()
    return {k: {"n": row[f"{k}_n"], "mean": [row[f"{k}_mean_{x}"] or 0.0 for x in xs], "std": [row[f"{k}_std_{x}"] or 1.0 for x in xs]} for k in cases}


def scaled(xs: list[str], m: dict) -> list[Column]:
    return [(F.col(x) - mean) / std for x, mean, std in zip(xs, m["mean"], m["std"], strict=True)]


def grams_where(df: DataFrame, cases: dict[str, tuple[Column, list[Column], Column, Column]]) -> dict[str, dict]:
    """Gram sums of several cases (condition, standardised columns, y, weight), each with
    an intercept at 0, from one aggregate over the rows."""
    cols = []
    for k, (case, xs, y, w) in cases.items():
        only = lambda c: F.when(case, c)  # noqa: E731, B023
        cols += [F.sum(only(c)).alias(f"{k}:{name}") for c, name in _gram_terms([F.lit(1.0), *xs], y, w)]
    row = df.agg(*cols).first().asDict()
    return {k: {c.split(":", 1)[1]: v for c, v in row.items() if c.startswith(f"{k}:")} for k in cases}


def _gram_terms(xs: list[Column], y: Column, w: Column) -> list[tuple[Column, str]]:
    p = len(xs)
    return [(w * xs[i] * xs[j], f"x{i}_{j}") for i in range(p) for j in range(i, p)] + [(w * xs[i] * y, f"y{i}") for i in range(p)]


def fit_logistic_where(df: DataFrame, xs: list[str], y: str, w: str, cases: dict[str, dict], rounds: int = 25, tolerance: float = 1e-7) -> dict[str, list[float]]:
    """``fit_logistic`` of several cases (where, mean, std, ridge) at once: each round is
    one aggregate, until none moves."""
    p = len(xs) + 1
    beta = {k: [0.0] * p for k in cases}
    for _ in range(rounds):
        # coefficients come as one row, so that every round runs the same compiled code
        now = df.sparkSession.range(1).select(*(F.lit(b).alias(f"{k}_b{i}") for k in cases for i, b in enumerate(beta[k])))
        rows, terms = df.join(F.broadcast(now)), {}  # one row
        for k, case in cases.items():
            z = scaled(xs, case)
            eta = F.col(f"{k}_b0")
            for i, c in enumerate(z, 1):
                eta = eta + c * F.col(f"{k}_b{i}")
            rows = rows.withColumn(f"{k}_eta", F.least(F.lit(30.0), F.greatest(F.lit(-30.0), eta)))
            rows = rows.withColumn(f"{k}_mu", sigmoid(f"{k}_eta"))
            rows = rows.withColumn(f"{k}_v", F.greatest(F.lit(1e-6), F.col(f"{k}_mu") * (1 - F.col(f"{k}_mu"))))
            target = F.col(f"{k}_eta") + (F.col(y) - F.col(f"{k}_mu")) / F.col(f"{k}_v")
            terms[k] = case["where"], z, target, F.col(w) * F.col(f"{k}_v")
        moved = 0.0
        for k, row in grams_where(rows, terms).items():
            a, b = _system(row, p)
            new = np.linalg.solve(a + cases[k]["ridge"] * np.eye(p), b)
            moved = max(moved, float(np.abs(new - beta[k]).max()))
            beta[k] = new.tolist()
        if moved < tolerance:
            break
    return beta


def vif(df: DataFrame, xs: list[str], ridge: float = RIDGE) -> dict[str, float]:
    """Variance inflation factors: every auxiliary regression is a sub-matrix of
    one unweighted Gram aggregate. R2 of 0.999 or more gives infinity."""
    return vif_of(gram(df.withColumn("_one", F.lit(0.0)), xs, "_one").first().asDict(), xs, ridge)


def vif_of(row: dict, xs: list[str], ridge: float = RIDGE) -> dict[str, float]:
    """The same from the sums of a Gram aggregate."""
    p = len(xs) + 1
    a, _ = _system(row, p)
    n, out = a[0, 0], {}
    for j, x in enumerate(xs, 1):
        others = [i for i in range(p) if i != j]
        s, t = a[np.ix_(others, others)] + ridge * np.eye(p - 1), a[others, j]
        beta = np.linalg.solve(s, t)
        rss = a[j, j] - 2 * beta @ t + beta @ a[np.ix_(others, others)] @ beta
        tss = a[j, j] - a[0, j] ** 2 / n
        r2 = 1 - rss / tss if tss > 1e-9 * max(1.0, a[j, j]) else 0.0
        out[x] = float(1 / (1 - r2)) if r2 < 0.999 else math.inf
    return out


def weighted_r2(df: DataFrame, y: str, yhat: Column, w: str) -> DataFrame:
    """One row r2 = 1 - sum w (y - yhat)^2 / sum w (y - weighted mean)^2; 0 without
    spread."""
    mean = df.agg((F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("_mean"))
    rows = df.withColumn("_hat", yhat).join(F.broadcast(mean))  # one row
    sq = lambda d: F.sum(F.col(w) * d * d)
    got = rows.agg(sq(F.col(y) - F.col("_hat")).alias("res"), sq(F.col(y) - F.col("_mean")).alias("tot"))
    return got.select(F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(F.lit(0.0)).alias("r2"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row auc: Mann-Whitney with average ranks, null with one class.

    Rows are counted by distinct score first, and these are ranked in ranges.
    """
    from ..operators.ranking import rows_below

    by = df.groupBy(score).agg(F.count("*").alias("_n"), F.count_if(F.col(y).cast("double") == 1.0).alias("_p"))
    ranked = rows_below(by, score, "_n", "_below").withColumn("_r", F.col("_below") + (F.col("_n") + 1) / 2)
    s = ranked.agg(F.sum(F.col("_r") * F.col("_p")).alias("r"), F.sum("_p").cast("double").alias("p"), F.sum("_n").cast("double").alias("n"))
    neg = F.col("n") - F.col("p")
    return s.select(F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auc"))


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, 0 when a side is constant."""
    r = F.corr(x, y)
    return F.when(r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row spearman: correlation of average ranks."""
    from ..operators.ranking import avg_rank

    ranked = avg_rank(avg_rank(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(pearson("_rx", "_ry").alias("spearman"))

"""Joint fits against single ones and against the gradient of the likelihood."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from synergist.functions import models as M


def test_joint_fits_equal_single_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 3 + 0.3 * x[:, 1])))).astype(float)
    w = rng.choice([1.0, 0.6, 0.35], 400)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(*x.T, y, w))], "i long, a double, b double, y double, w double")
    cases = {"all": F.lit(True), "some": F.col("i") % 3 == 0}
    m = M.moments_where(df, ["a", "b"], cases)
    got = M.fit_logistic_where(df, ["a", "b"], "y", "w", {k: {"where": c, **m[k], "ridge": M.RIDGE} for k, c in cases.items()})
    for k, c in cases.items():
        part = df.where(c)
        one = M.fit_logistic(M.standardise(part, ["a", "b"]), ["a", "b"], "y", "w")
        assert got[k] == pytest.approx(one, abs=1e-6)
        rows = [(1.0, *((r[n] - mean) / std for n, mean, std in zip("ab", m[k]["mean"], m[k]["std"]))) for r in part.collect()]
        wy = [(r.w, r.y) for r in part.collect()]
        for j in range(3):  # the weighted score equations hold
            g = sum(u * r[j] * (t - 1 / (1 + math.exp(-sum(p * q for p, q in zip(r, got[k]))))) for r, (u, t) in zip(rows, wy))
            assert abs(g - M.RIDGE * got[k][j]) < 1e-4
    gram = M.grams_where(df, {"all": (F.lit(True), M.scaled(["a", "b"], m["all"]), F.lit(0.0), F.lit(1.0))})["all"]
    assert M.vif_of(gram, ["a", "b"]) == pytest.approx(M.vif(M.standardise(df, ["a", "b"]), ["a", "b"]))

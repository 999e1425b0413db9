"""Ranks and quantiles over cut ranges against plain ones."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from tracelane.operators import order_statistics as os_


def rows(seed=1, n=600):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float(rng.randrange(5)), rng.gauss(0, 10), rng.gauss(0, 10), float("nan")])
    return [(rng.choice(["a", "a", "a", "b", None]), value(), value()) for _ in range(n)] + [("c", 1.0, None), ("c", 2.0, None), ("d", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0), ("e", None, None)]


@pytest.mark.parametrize("width", [7, 40, 10_000])
def test_quantiles_and_ranks_equal_plain_ones(spark, width):
    data = rows()
    df = spark.createDataFrame(data, "k string, x double, y double")
    plain = pd.DataFrame(data, columns=["k", "x", "y"])
    qs = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = {(r.k, r.metric, r.q): r.value for r in os_.quantiles(df, ["k"], ["x", "y"], qs, width).collect()}
    for k, group in plain.groupby("k", dropna=False):
        name = None if pd.isna(k) else k
        for c in ("x", "y"):
            known = group[c].dropna()
            for q in qs:
                v = got.pop((name, c, q))
                assert (v is None) == known.empty and (known.empty or v == pytest.approx(np.quantile(known, q), abs=1e-9))
    assert not got
    clean = df.where("NOT isnan(x) AND NOT isnan(y)")
    rho = {r.k: (r.n, r.rho) for r in os_.rank_correlation(clean, ["k"], "x", "y", width).collect()}
    both = plain.dropna(subset=["x", "y"])
    for k, group in both.groupby("k", dropna=False):
        n, r = rho.pop(None if pd.isna(k) else k)
        want = group["x"].rank().corr(group["y"].rank()) if len(group) > 2 and group["x"].nunique() > 1 and group["y"].nunique() > 1 else None
        assert n == len(group) and (r is None if want is None else r == pytest.approx(want, abs=1e-9))
    assert not rho


def test_places_of_a_large_group(spark):
    df = spark.range(20_000).selectExpr("'g' AS k", "id % 5000 AS v").unionByName(spark.range(3).selectExpr("'s' AS k", "id AS v"))
    out = os_.placed(df, ["k"], "v", 500)
    assert out.where("k = 'g' AND (n <> 4 OR before_n <> v * 4 OR all_n <> 20000)").count() == 0 and out.count() == 5003
    assert os_.placed(df.limit(0), ["k"], "v").count() == 0

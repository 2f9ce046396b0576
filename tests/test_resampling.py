"""Bootstraps and the mixed model as relations, against the same on arrays."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.functions.special import normal_two_tails
from meterloom.operators import stats as X

PARTS = ["est_kwh", "true_kwh", "matched_err_kwh", "false_add_kwh", "missed_kwh"]


def hashed(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48


def four(a):
    t = a.sum(0)
    return [t[0] / t[1] - 1, np.abs(t[2:]).sum() / t[1], np.abs(a[:, 2:]).sum() / t[1], np.median(np.abs(a[:, 0] / a[:, 1] - 1))]


def expected(pdf, unit, n):
    pdf = pdf.groupby(["entity", "site"], as_index=False)[PARTS].sum()
    pdf = pdf[pdf.true_kwh > 0]
    names = sorted(pdf[unit].unique())
    rows = {u: pdf.loc[pdf[unit] == u, PARTS].to_numpy() for u in names}
    picks = ([names[int(hashed("boot", rep, i) * len(names))] for i in range(len(names))] for rep in range(n))
    reps = np.array([four(np.concatenate([rows[u] for u in pick])) for pick in picks])
    return np.column_stack([four(pdf[PARTS].to_numpy()), np.percentile(reps, 2.5, axis=0), np.percentile(reps, 97.5, axis=0)])


@pytest.fixture(scope="module")
def ops():
    rng = np.random.default_rng(3)
    out = pd.DataFrame({"model": ["a"] * 60 + ["b"] * 31, "entity": [f"e{i % 57}" for i in range(60)] + [f"e{i}" for i in range(31)]})
    out["site"] = "s" + (out.entity.str[1:].astype(int) ** 2 % 7).astype(str)
    for c in PARTS:
        out[c] = rng.gamma(2, 3, len(out)).round(1) * (rng.choice([-1, 1], len(out)) if c == PARTS[2] else 1)
    out.loc[5, "true_kwh"] = out.loc[70, "true_kwh"] = 0.0  # left out
    out.loc[[8, 9, 10, 11, 12], ["est_kwh", "true_kwh"]] = [2.0, 1.0]  # ties
    return out


@pytest.mark.parametrize("unit", ["entity", "site"])
@pytest.mark.parametrize("block", [4, 1024])
def test_ratio_bootstrap_equals_arrays(spark, ops, unit, block):
    got = X.ratio_bootstrap(spark.createDataFrame(ops), ["model"], unit, n=60, block=block).toPandas()
    for model, pdf in ops.groupby("model"):
        one = got[got.model == model].set_index("stat").loc[["agg_bias", "agg_gross_rel", "pb_gross_rel", "median_abs_rel_err"], ["value", "lo", "hi"]]
        assert one.to_numpy() == pytest.approx(expected(pdf, unit, 60), abs=1e-9)


def test_ratio_bootstrap_of_one_and_of_none(spark, ops):
    df = spark.createDataFrame(ops)
    one = X.ratio_bootstrap(df.where("model = 'a' and entity = 'e20'"), ["model"], n=5).collect()
    assert len(one) == 4 and all(r["value"] == r["lo"] == r["hi"] for r in one)
    assert X.ratio_bootstrap(df.where("false"), ["model"], n=5).count() == 0
    assert X.ratio_bootstrap(df.where("true_kwh = 0"), ["model"], n=5).count() == 0
    # a null key is a key like others
    nothing = df.where("model = 'b'").withColumn("model", F.lit(None).cast("string"))
    a, b = (sorted(tuple(r)[1:] for r in X.ratio_bootstrap(x, ["model"], n=5).collect()) for x in (nothing, df.where("model = 'b'")))
    assert len(a) == 4 and np.array([r[1:] for r in a]) == pytest.approx(np.array([r[1:] for r in b]))


def by_matrices(d, site, lam):
    """The REML likelihood, mean and its error from whole covariance matrices."""
    same = (site[:, None] == site[None]).astype(float)
    inv = np.linalg.inv(np.eye(len(d)) + lam * same)
    one = np.ones(len(d))
    xx = one @ inv @ one
    mu = one @ inv @ d / xx
    q = (d - mu) @ inv @ (d - mu)
    s2 = q / (len(d) - 1)
    return -0.5 * ((len(d) - 1) * math.log(s2) - np.linalg.slogdet(inv)[1] + math.log(xx)), mu, math.sqrt(s2 / xx)


@pytest.mark.parametrize("spread", [0.0, 0.3, 2.0])
def test_mixed_model_equals_matrices_with_unequal_groups(spark, spread):
    rng = np.random.default_rng(int(spread * 10))
    sizes = [1, 2, 3, 8, 21]
    site = np.repeat(np.arange(5), sizes)
    d = 0.4 + rng.normal(0, spread, 5)[site] + rng.normal(0, 1, len(site))
    r = X.random_intercept(spark.createDataFrame(pd.DataFrame({"k": "x", "site": site, "d": d})), ["k"]).first()
    lams = np.concatenate([[0.0], np.logspace(-6, 4, 3000)])
    likes = [by_matrices(d, site, x)[0] for x in lams]
    i = int(np.argmax(likes))
    fine = np.linspace(lams[max(i - 1, 0)], lams[min(i + 1, 3000)], 400)
    _, mu, se = by_matrices(d, site, max(fine, key=lambda x: by_matrices(d, site, x)[0]))
    assert r["mixed_est"] == pytest.approx(mu, abs=1e-5)
    assert r["p_mixed"] == pytest.approx(math.erfc(abs(mu / se) / math.sqrt(2)), rel=1e-3)


def test_mixed_model_of_too_little(spark):
    rows = [("one", "s", 1.0), ("same", "s", 2.0), ("same", "t", 2.0), ("null", "s", None), ("ok", "s", 1.0), ("ok", "s", 2.0), ("ok", "t", 4.0), (None, "s", 1.0), (None, None, 3.0)]
    got = {r["k"]: r["mixed_est"] for r in X.random_intercept(spark.createDataFrame(rows, "k string, site string, d double"), ["k"]).collect()}
    assert set(got) == {"one", "same", "ok", None} and got["one"] is None and got["same"] is None
    assert 2.0 < got["ok"] < 3.1 and got[None] == pytest.approx(2.0)


def test_normal_tails(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 1.96, 2.999, 3.0, 3.001, 5.0, 8.0, 12.0, 30.0]
    df = spark.createDataFrame([(s * x,) for x in z for s in (1, -1)], "z double")
    for r in df.select("z", normal_two_tails(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-12)

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import effects, pooling


@pytest.fixture(scope="module")
def studies():
    rng = np.random.default_rng(17)
    rows = []
    for o in range(4):
        for s in range(12 + 5 * o):
            v = rng.uniform(0.02, 0.2)
            x, z = rng.normal(), rng.random()
            y = 0.3 + 0.2 * o * x + rng.normal() * np.sqrt(v + 0.05 * o)
            rows.append((f"o{o}", s, float(y), float(v), float(x), float(z)))
    rows.append(("single", 1, 0.5, 0.1, 1.0, 0.2))
    return rows


SCHEMA = "outcome string, study int, yi double, vi double, x double, z double"


def _dense(y, v, x, tau2):
    w = np.diag(1 / (v + tau2))
    inv = np.linalg.inv(x.T @ w @ x)
    p = w - w @ x @ inv @ x.T @ w
    return w, inv, p


def _loglik(y, v, x, tau2, method):
    w, inv, p = _dense(y, v, x, tau2)
    ll = -0.5 * (np.log(v + tau2).sum() + y @ p @ y)
    k, q = x.shape
    if method == "ML":
        return ll - 0.5 * k * np.log(2 * np.pi)
    return (
        ll - 0.5 * (k - q) * np.log(2 * np.pi)
        - 0.5 * np.linalg.slogdet(x.T @ w @ x)[1] + 0.5 * np.linalg.slogdet(x.T @ x)[1]
    )


@pytest.mark.parametrize("method", ["REML", "ML"])
@pytest.mark.parametrize("mods", [[], ["x"], ["x", "z"]])
def test_fit_is_the_likelihood_maximum(spark, studies, method, mods):
    df = spark.createDataFrame(studies, SCHEMA)
    got = {r.outcome: r for r in pooling.random_effects(df, moderators=mods, method=method).collect()}
    for o in range(4):
        part = [r for r in studies if r[0] == f"o{o}"]
        y, v = np.array([r[2] for r in part]), np.array([r[3] for r in part])
        x = np.column_stack([np.ones(len(y)), *[[r[{"x": 4, "z": 5}[m]] for r in part] for m in mods]])
        r = got[f"o{o}"]
        best = _loglik(y, v, x, r.tau2, method)
        assert r.loglik == pytest.approx(best)
        for other in np.concatenate([[0.0], r.tau2 + np.array([-1e-3, 1e-3])]):
            if other >= 0:
                assert _loglik(y, v, x, other, method) <= best + 1e-9
        w, inv, p = _dense(y, v, x, r.tau2)
        b = inv @ x.T @ w @ y
        np.testing.assert_allclose(r.estimate, b, atol=1e-9)
        s2 = y @ p @ y / (len(y) - x.shape[1])
        np.testing.assert_allclose(r.std_error, np.sqrt(np.diag(inv) * s2), rtol=1e-8)
        _, _, p0 = _dense(y, v, x, 0.0)
        assert r.q == pytest.approx(y @ p0 @ y)
        assert r.q_df == len(y) - x.shape[1]
    if not mods:
        assert got["single"].tau2 == 0.0 and got["single"].std_error == [None]


@pytest.mark.parametrize("method", ["REML", "ML", "DL"])
@pytest.mark.parametrize("mods", [[], ["x"]])
def test_outcomes_together_agree_with_one_by_one(spark, studies, mods, method):
    """Each outcome settles at its own step; one has far more studies."""
    rng = np.random.default_rng(4)
    more = [
        ("many", i, float(y), 0.2 + float(rng.random()), float(rng.random()), float(rng.random()))
        for i, y in enumerate(rng.normal(size=3000))
    ]
    df = spark.createDataFrame([*studies, *more], SCHEMA).repartition(5)
    together = {r.outcome: r for r in pooling.random_effects(df, moderators=mods, method=method).collect()}
    for o in ("o1", "single", "many"):
        (alone,) = pooling.random_effects(df.where(F.col("outcome") == o), moderators=mods, method=method).collect()
        assert alone.tau2 == pytest.approx(together[o].tau2, abs=1e-9)
        if o != "single":
            np.testing.assert_allclose(alone.estimate, together[o].estimate, rtol=1e-9)


def test_an_outcome_that_does_not_settle_is_an_error(spark, studies, monkeypatch):
    monkeypatch.setattr(pooling, "_STEPS", 1)
    with pytest.raises(ValueError, match="settled"):
        pooling.random_effects(spark.createDataFrame(studies, SCHEMA))


def test_heterogeneity_and_comparison(spark, studies):
    df = spark.createDataFrame(studies, SCHEMA).where("outcome <> 'single'")
    het = {r.outcome: r for r in pooling.heterogeneity(df, ["outcome"]).collect()}
    none = pooling.random_effects(df)
    for r in none.collect():
        assert het[r.outcome].q == pytest.approx(r.q)
        assert het[r.outcome].i2 == pytest.approx(r.i2)
    with_x = pooling.random_effects(df, moderators=["x"])
    for r in pooling.explained(with_x, none).collect():
        assert 0 <= r.r2 <= 1
    small = pooling.random_effects(df, moderators=["x"], method="ML")
    large = pooling.random_effects(df, moderators=["x", "z"], method="ML")
    for r in pooling.likelihood_ratio(small, large).collect():
        assert r.lrt >= 0 and r.lrt_df == 1 and 0 <= r.lrt_p <= 1
    bubbles = pooling.bubble_rows(df, with_x, "x").groupBy("outcome").sum("weight_pct").collect()
    assert all(r[1] == pytest.approx(100.0) for r in bubbles)
    assert pooling.bubble_line(df, with_x, "x", points=5).count() == 20
    assert pooling.coefficient_rows(with_x, ["intercept", "x"]).count() == 8


def test_effects_with_empty_cells(spark):
    df = spark.createDataFrame(
        [(10, 0, 12, 3, 5.0, 6.0), (10, 4, 12, 3, 5.0, 6.0)],
        "n_e int, event_e int, n_c int, event_c int, time_e double, time_c double",
    )
    rr = effects.ratio_effect(df, "RR").collect()
    assert rr[0].yi == pytest.approx(np.log(0.5 / 11) - np.log(3.5 / 13))
    assert rr[1].yi == pytest.approx(np.log(0.4) - np.log(0.25))
    odds = effects.ratio_effect(df, "OR").collect()
    assert odds[1].vi == pytest.approx(1 / 4 + 1 / 6 + 1 / 3 + 1 / 9)
    irr = effects.rate_ratio(df).collect()
    assert irr[1].yi == pytest.approx(np.log(4 / 5 / (3 / 6)))
    prop = effects.proportion_effect(df, "n_e", "event_e").collect()
    assert prop[0].yi == pytest.approx(np.log(0.5 / 10.5))
    with pytest.raises(ValueError):
        effects.ratio_effect(df, "XX")
    with pytest.raises(ValueError):
        effects.hazard_ratio(df)

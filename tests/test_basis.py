import numpy as np
import pytest

from lagloom.functions.transforms import log_spaced_lags
from lagloom.models import basis as bs
from lagloom.models.crossbasis import CrossBasis, crossbasis

SPLINES = [
    bs.bspline(3, [2.0, 3.5, 7.0], 0.0, 10.0, intercept=True),
    bs.bspline(2, [4.0], 0.0, 10.0, intercept=True),
    bs.natural([2.0, 3.5, 7.0], 0.0, 10.0, intercept=True),
]
ALL = SPLINES + [
    bs.linear(), bs.linear(True), bs.polynomial(4, 12.0), bs.polynomial(2, 5.0, True),
    bs.threshold([3.0]), bs.threshold([3.0], "l"), bs.threshold([3.0], "d"),
    bs.threshold([2.0, 6.0], "d", True), bs.strata([2.0, 6.0]), bs.strata([2.0, 6.0], True),
    bs.natural([5.0], 0.0, 10.0), bs.natural([], 0.0, 10.0), bs.natural([], 0.0, 10.0, True),
    bs.natural(np.linspace(0, 10, 42)[1:-1], 0.0, 10.0),
]


@pytest.mark.parametrize("b", ALL, ids=lambda b: f"{b.kind}{b.width}")
def test_spark_and_numpy_agree(spark, b):
    x = [-3.0, 0.0, 0.5, 2.0, 3.0, 3.5, 5.0, 6.0, 7.0, 9.99, 10.0, 14.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    got = df.select("x", b.column("x").alias("b")).collect()
    assert got[-1].b is None
    np.testing.assert_allclose([r.b for r in got[:-1]], b.values(x), atol=1e-12)


def test_bsplines_sum_to_one_and_are_smooth():
    for b in SPLINES[:2]:
        x = np.linspace(0, 10, 301)
        np.testing.assert_allclose(b.values(x).sum(1), 1.0, atol=1e-12)
    b = SPLINES[0]
    for knot in (2.0, 3.5, 7.0):
        lo, hi = b.values([knot - 1e-9])[0], b.values([knot + 1e-9])[0]
        np.testing.assert_allclose(lo, hi, atol=1e-7)


def _bend(b, x, e=1e-3):
    v = b.values([x - e, x, x + e])
    return (v[0] - 2 * v[1] + v[2]) / e**2


def test_natural_spline_is_straight_outside_and_spans_constants():
    for k in ([], [5.0], [3.0, 6.0], [2.0, 3.5, 7.0]):
        b = bs.natural(k, 0.0, 10.0, intercept=True)
        assert b.width == len(k) + 2
        for x in (-4.0, 12.0):
            np.testing.assert_allclose(_bend(b, x), 0.0, atol=1e-6)
        for x in (1e-3, 10 - 1e-3):
            assert np.abs(_bend(b, x)).max() < 0.02  # tends to zero at the boundary
        x = np.linspace(-2, 12, 60)
        for target in (np.ones_like(x), x):
            v = b.values(x)
            coef = np.linalg.lstsq(v, target, rcond=None)[0]
            np.testing.assert_allclose(v @ coef, target, atol=1e-9)


def test_natural_spline_same_space_as_truncated_powers():
    knots = np.array([0.0, 2.0, 3.5, 7.0, 10.0])
    x = np.linspace(-1, 11, 80)

    def d(k):
        a = np.maximum(x - knots[k], 0) ** 3 - np.maximum(x - knots[-1], 0) ** 3
        return a / (knots[-1] - knots[k])

    known = np.column_stack([np.ones_like(x), x, *[d(k) - d(len(knots) - 2) for k in range(3)]])
    ours = bs.natural(knots[1:-1], 0.0, 10.0, intercept=True).values(x)
    coef = np.linalg.lstsq(known, ours, rcond=None)[0]
    np.testing.assert_allclose(known @ coef, ours, atol=1e-8)


def test_small_examples():
    steps = bs.strata([2, 4]).values([1, 2, 3, 4, 5])
    assert steps.tolist() == [[0, 0], [1, 0], [1, 0], [0, 1], [0, 1]]
    spline = bs.bspline(2, [np.quantile([1, 2, 3, 4, 5], 1 / 3), np.quantile([1, 2, 3, 4, 5], 2 / 3)],
                        1.0, 5.0)
    assert spline.width == 4
    np.testing.assert_allclose(log_spaced_lags(30, 3), [1.106, 3.322, 9.983], atol=1e-3)


def test_bad_specs():
    with pytest.raises(ValueError):
        bs.BasisSpec("bs", df=2, degree=3).probs()
    with pytest.raises(ValueError):
        bs.bspline(3, [], 1.0, 1.0)
    with pytest.raises(ValueError):
        bs.build_basis(bs.BasisSpec("nope"), 0.0, 1.0, [])


def test_custom_basis(spark):
    bs.register_basis("double", lambda spec, lo, hi, knots: bs.polynomial(1, 0.5))
    df = spark.createDataFrame([(3.0,)], "x double")
    b = bs.fit_basis(df, "x", bs.BasisSpec("double"))
    assert df.select(b.column("x").alias("b")).first().b == [6.0]


def test_knots_by_population(spark):
    df = spark.createDataFrame(
        [("a", float(i)) for i in range(11)] + [("b", 10.0 * i) for i in range(11)],
        "g string, x double",
    )
    spec = bs.BasisSpec("ns", df=2)
    both = bs.fit_bases(df, "x", {"a": spec, "b": spec}, "g")
    assert both["a"].about["knots"] == [5.0] and both["b"].about["knots"] == [50.0]


def _brute(cb, x):
    n = len(x)
    c = cb.weights
    out = np.full((n, cb.width), np.nan)
    for t in range(cb.max_lag, n):
        window = x[t - cb.max_lag : t + 1][::-1]
        if not np.isnan(window).any():
            out[t] = (cb.var.values(window).T @ c).ravel()
    return out


@pytest.mark.parametrize("block", [8, 16, 1000])
def test_series_design_does_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(2)
    x = rng.random(60) * 10
    x[30] = np.nan
    rows = [("s", t, None if np.isnan(v) else float(v)) for t, v in enumerate(x)]
    rows += [("u", t, float(v)) for t, v in enumerate(rng.random(20))]
    df = spark.createDataFrame(rows, "g string, t long, x double").repartition(5)
    cb = CrossBasis(
        bs.bspline(3, [4.0], 0.0, 10.0), bs.lag_basis(bs.BasisSpec("ns", df=3), 5), 5
    )
    out = cb.on_series(df, "t", "x", keys=["g"], block=block).collect()
    assert len(out) == len(rows)
    got = {(r.g, r.t): r.cb for r in out}
    want = _brute(cb, x)
    for t in range(60):
        if np.isnan(want[t]).any():
            assert got[("s", t)] is None
        else:
            np.testing.assert_allclose(got[("s", t)], want[t], atol=1e-10)
    assert all(got[("u", t)] is None for t in range(5)) and got[("u", 5)] is not None


def test_series_design_needs_no_gap(spark):
    df = spark.createDataFrame([(t, 1.0 + t) for t in range(12) if t != 6], "t long, x double")
    cb = CrossBasis(bs.linear(), bs.strata([], True), 2)
    got = {r.t: r.cb for r in cb.on_series(df, "t", "x").collect()}
    assert [t for t, v in got.items() if v is None] == [0, 1, 7, 8]


def test_repeated_day_does_not_hide_a_gap(spark):
    df = spark.createDataFrame([(t, float(t)) for t in (4, 5, 5, 7)], "t long, x double")
    cb = CrossBasis(bs.linear(), bs.strata([], True), 2)
    assert all(r.cb is None for r in cb.on_series(df, "t", "x").collect())


def test_constant_exposure_gives_products(spark):
    df = spark.createDataFrame([([4.0] * 6,), ([4.0] * 5,), ([4.0] * 5 + [None],)], "history array<double>")
    cb = CrossBasis(bs.polynomial(2, 8.0), bs.lag_basis(bs.BasisSpec("ns", df=2), 5), 5)
    got = cb.on_histories(df).collect()
    want = np.outer(cb.var.values([4.0])[0], cb.weights.sum(0)).ravel()
    np.testing.assert_allclose(got[0].cb, want, atol=1e-12)
    assert got[1].cb is None and got[2].cb is None


def test_summary(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    cb = crossbasis(df, "x", 4, bs.BasisSpec("bs", df=5), bs.BasisSpec("ns", df=3), "temp")
    rows = {r.part: r for r in cb.summary(spark).collect()}
    assert rows["exposure"].width == 5 and rows["lag"].width == 3 and rows["lag"].lag_to == 4
    assert cb.width == 15 and len(cb.terms) == 15

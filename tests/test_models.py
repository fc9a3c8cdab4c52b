"""Model fits against dense fits in numpy that share no code with them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagloom.models import basis as bs
from lagloom.models import predict
from lagloom.models.cox import cox_design, cox_step, fit_cox
from lagloom.models.crossbasis import CrossBasis
from lagloom.models.fitted import compare, tidy
from lagloom.models.glm import GlmSpec, Term, fit_glm
from lagloom.models.matched import clogit_design, fit_clogit
from lagloom.models.moments import solve_information
from lagloom.models.quantile import fit_quantile


def frame(spark, x, **cols):
    pdf = pd.DataFrame({**cols, "x": np.asarray(x, float).tolist()})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 600
    x = np.column_stack([rng.normal(size=n), rng.random(n), rng.integers(0, 2, n)]).astype(float)
    return rng, n, x


@pytest.mark.parametrize("family", ["poisson", "quasipoisson", "binomial", "gaussian"])
def test_glm_matches_dense_newton(spark, data, family):
    rng, n, x = data
    rng = np.random.default_rng(1)
    eta = 0.3 + x @ [0.4, -0.5, 0.2]
    if family == "gaussian":
        y = eta + rng.normal(size=n)
    elif family == "binomial":
        y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    else:
        y = rng.poisson(np.exp(eta)).astype(float)
    df = frame(spark, x, y=y).repartition(7)
    spec = GlmSpec("y", family, (Term("x", "x", ("a", "b", "c")),))
    fit = fit_glm(df, spec)
    z = np.column_stack([np.ones(n), x])
    b = np.zeros(4)
    for _ in range(60):
        e = z @ b
        if family == "gaussian":
            mu, v = e, np.ones(n)
        elif family == "binomial":
            mu = 1 / (1 + np.exp(-e))
            v = mu * (1 - mu)
        else:
            mu = np.exp(e)
            v = mu
        b = b + np.linalg.solve((z * v[:, None]).T @ z, z.T @ (y - mu))
    np.testing.assert_allclose(fit.coef, b, atol=1e-7)
    phi = np.sum((y - mu) ** 2 / v) / (n - 4) if family in ("quasipoisson", "gaussian") else 1.0
    np.testing.assert_allclose(
        fit.cov, phi * np.linalg.inv((z * v[:, None]).T @ z), rtol=1e-5, atol=1e-10
    )
    assert fit.converged and fit.n == n
    again = fit_glm(df.repartition(2), spec)
    np.testing.assert_allclose(again.coef, fit.coef, atol=1e-9)


def test_glm_offset_weight_missing_rows_update_and_comparison(spark, data):
    _, n, x = data
    rng = np.random.default_rng(4)
    t = rng.random(n) + 0.5
    y = rng.poisson(t * np.exp(0.2 + 0.3 * x[:, 0])).astype(float)
    df = frame(spark, x, y=y, lt=np.log(t)).withColumn("k", F.col("x")[0])
    df = df.unionByName(df.limit(20).withColumn("y", F.lit(None).cast("double")))
    one = GlmSpec("y", "poisson", (Term("k", "k", ("k",), array=False),), offset="lt", name="one")
    fit = fit_glm(df, one)
    assert fit.n == n
    full = one.update(drop=("k",), add=(Term("x", "x", ("a", "b", "c")),), name="full")
    with pytest.raises(ValueError):
        one.update(drop=("nothing",))
    big = fit_glm(df, full)
    rows = {r.model: r for r in compare(spark, fit, big).collect()}
    assert rows["full"].df_diff == 2 and 0 <= rows["full"].p_value <= 1
    assert rows["full"].statistic == pytest.approx(2 * (big.loglik - fit.loglik))
    table = {r.term: r for r in tidy(spark, [fit]).collect()}
    assert table["k"].exp_estimate == pytest.approx(np.exp(fit.coef[1]))


def test_aliased_columns_have_null_errors(spark, data):
    _, n, x = data
    y = x[:, 0] + 1.0
    both = np.column_stack([x[:, 0], 2 * x[:, 0]])
    fit = fit_glm(frame(spark, both, y=y + x[:, 1]), GlmSpec("y", "gaussian", (Term("x", "x", ("a", "b")),)))
    rows = {r.term: r for r in tidy(spark, [fit]).collect()}
    assert rows["b"].estimate is None and rows["a"].std_error is not None
    sol, inv = solve_information(np.zeros((1, 1)), np.zeros(1))
    assert sol[0] == 0 and np.isnan(inv[0, 0])


def _cox_dense(x, entry, exit, event, stratum, ties, beta):
    """Log likelihood, score and information by direct sums over risk sets."""
    p = x.shape[1]
    ll, u, info = 0.0, np.zeros(p), np.zeros((p, p))
    w = np.exp(x @ beta)
    for s in np.unique(stratum):
        m = stratum == s
        for t in np.unique(exit[m & (event == 1)]):
            risk = m & (exit >= t) & (entry < t)
            dead = m & (exit == t) & (event == 1)
            d = dead.sum()
            ll += (x[dead] @ beta).sum()
            u += x[dead].sum(0)
            for r in range(d):
                share = r / d if ties == "efron" else 0.0
                a = w * (risk - share * dead)
                s0, s1 = a.sum(), a @ x
                s2 = (x * a[:, None]).T @ x
                ll -= np.log(s0)
                u -= s1 / s0
                info += s2 / s0 - np.outer(s1, s1) / s0**2
    return ll, u, info


@pytest.mark.parametrize("ties", ["efron", "breslow"])
@pytest.mark.parametrize("entry", [False, True])
@pytest.mark.parametrize("bucket", [None, 4.0])
def test_cox_step_matches_direct_sums(spark, data, ties, entry, bucket):
    _, n, x = data
    rng = np.random.default_rng(8)
    exit_ = rng.integers(3, 16, n).astype(float)
    start = np.minimum(rng.integers(0, 6, n), exit_ - 1).astype(float)
    event = (rng.random(n) < 0.5).astype(float)
    g = rng.integers(0, 3, n)
    df = frame(spark, x, exit=exit_, start=start, event=event, g=g).repartition(5)
    design = cox_design(
        df, "exit", "event", [F.col("x")], stratum=F.col("g"), entry="start" if entry else None
    )
    beta = np.array([0.3, -0.8, 0.5])
    ll, u, info, d = cox_step(
        design, {"model": beta}, {"model": np.zeros(3)}, ties, entry, bucket
    )["model"]
    want = _cox_dense(x, start if entry else np.full(n, -1.0), exit_, event, g, ties, beta)
    np.testing.assert_allclose(ll, want[0], rtol=1e-10)
    np.testing.assert_allclose(u, want[1], atol=1e-8)
    np.testing.assert_allclose(info, want[2], atol=1e-8)
    assert d == event.sum()


def test_cox_fit_many_models_at_once(spark, data):
    _, n, x = data
    rng = np.random.default_rng(9)
    exit_ = rng.integers(2, 22, n).astype(float)
    event = (rng.random(n) < 0.6).astype(float)
    g = rng.integers(0, 2, n)
    df = frame(spark, x, exit=exit_, event=event, g=g)
    parts = [
        cox_design(df, "exit", "event", [F.col("x")], model=F.lit("pooled"), stratum=F.col("g")),
        cox_design(df.where("g = 1"), "exit", "event", [F.slice("x", 1, 1)], model=F.lit("one")),
    ]
    labels = {"pooled": ["a", "b", "c"], "one": ["a"]}
    fits = fit_cox(parts[0].unionByName(parts[1]), labels)
    for name, rows, cols in (("pooled", np.ones(n, bool), 3), ("one", g == 1, 1)):
        b = np.zeros(cols)
        strat = g[rows] if name == "pooled" else np.zeros(rows.sum())
        for _ in range(30):
            _, u, info = _cox_dense(
                x[rows][:, :cols], np.full(rows.sum(), -1.0), exit_[rows], event[rows], strat,
                "efron", b,
            )
            b = b + np.linalg.solve(info, u)
        np.testing.assert_allclose(fits[name].coef, b, atol=1e-6)
        np.testing.assert_allclose(fits[name].cov, np.linalg.inv(info), rtol=1e-4)
        assert fits[name].n == rows.sum() and fits[name].converged


def test_cox_without_events_is_an_error(spark):
    df = frame(spark, np.ones((4, 1)), exit=[1.0, 2, 3, 4], event=[0.0] * 4)
    with pytest.raises(ValueError):
        fit_cox(cox_design(df, "exit", "event", [F.col("x")]), {"model": ["a"]})


def test_tied_sums_for_many_ties(spark):
    from lagloom.models.cox import _tied_sums_sql

    rows = []
    for d in (2, 3, 17, 400, 5000):
        for q in (d, d + 0.25, 3.0 * d, 1e4 * d):
            u = q - np.arange(d)
            rows.append(tuple(map(float, (d, q, (1 / u).sum(), (1 / u**2).sum(), np.log(u).sum()))))
    df = spark.createDataFrame(rows, "d double, _q double, a double, b double, c double")
    got = df.withColumns({k: F.expr(v) for k, v in _tied_sums_sql().items()}).collect()
    for r in got:
        np.testing.assert_allclose([r._h1, r._h2, r._lu], [r.a, r.b, r.c], rtol=1e-10)


def test_clogit_matches_dense(spark):
    rng = np.random.default_rng(12)
    sets = np.repeat(np.arange(150), 4)
    x = rng.normal(size=(600, 2))
    case = np.zeros(600)
    for s in range(150):
        p = np.exp(x[sets == s] @ [0.5, -0.3])
        case[4 * s + rng.choice(4, p=p / p.sum())] = 1
    df = frame(spark, x, set=sets, case=case)
    lonely = frame(spark, x[:3], set=np.array([901, 902, 903]), case=np.array([1.0, 0.0, 1.0]))
    df = df.unionByName(lonely).repartition(6)
    fit = fit_clogit(clogit_design(df, "set", "case", [F.col("x")]), ["a", "b"])
    b = np.zeros(2)
    for _ in range(30):
        u, info = np.zeros(2), np.zeros((2, 2))
        for s in range(150):
            xs, cs = x[sets == s], case[sets == s]
            w = np.exp(xs @ b)
            m = w @ xs / w.sum()
            u += cs @ xs - m
            info += (xs * w[:, None]).T @ xs / w.sum() - np.outer(m, m)
        b = b + np.linalg.solve(info, u)
    np.testing.assert_allclose(fit.coef, b, atol=1e-7)
    np.testing.assert_allclose(fit.cov, np.linalg.inv(info), rtol=1e-5)
    assert fit.n_event == 150


def test_clogit_several_cases_by_enumeration(spark):
    """Sets of 2 to 7 members with 1 to 3 cases, against all subsets."""
    from itertools import combinations

    rng = np.random.default_rng(21)
    rows, sets = [], []
    for k in range(60):
        n = int(rng.integers(2, 8))
        m = int(rng.integers(1, min(4, n + 1)))
        xs = rng.normal(size=(n, 2))
        at = rng.choice(n, m, replace=False, p=(w := np.exp(xs[:, 0])) / w.sum())
        sets.append((xs, tuple(sorted(at))))
        rows += [(k, float(i in at), [float(v) for v in xs[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "set int, case double, x array<double>").repartition(7)
    fit = fit_clogit(clogit_design(df, "set", "case", [F.col("x")]), ["a", "b"])
    b = np.zeros(2)
    for _ in range(30):
        ll, u, info = 0.0, np.zeros(2), np.zeros((2, 2))
        for xs, at in sets:
            sums = np.array([xs[list(c)].sum(0) for c in combinations(range(len(xs)), len(at))])
            w = np.exp(sums @ b)
            mean = w @ sums / w.sum()
            own = xs[list(at)].sum(0)
            ll += own @ b - np.log(w.sum())
            u += own - mean
            info += (sums * w[:, None]).T @ sums / w.sum() - np.outer(mean, mean)
        b = b + np.linalg.solve(info, u)
    np.testing.assert_allclose(fit.coef, b, atol=1e-7)
    np.testing.assert_allclose(fit.cov, np.linalg.inv(info), rtol=1e-5)
    np.testing.assert_allclose(fit.loglik, ll, rtol=1e-9)


def _drawn_together(eta, x, m):
    """Log denominator, mean and covariance of the sum of x over m members of a
    set, by its polynomial with a scale taken out after every member."""
    p = x.shape[1]
    e, s, q, scale = np.zeros(m + 1), np.zeros((m + 1, p)), np.zeros((m + 1, p, p)), 0.0
    e[0] = 1.0
    u = np.exp(eta - eta.mean()) * m / (len(eta) - m)
    for w, v in zip(u, x):
        sv = s[:-1, :, None] * v
        q[1:] += w * (q[:-1] + sv + sv.transpose(0, 2, 1) + e[:-1, None, None] * np.outer(v, v))
        s[1:] += w * (s[:-1] + e[:-1, None] * v)
        e[1:] += w * e[:-1]
        top = e.max()
        e, s, q, scale = e / top, s / top, q / top, scale + np.log(top)
    mean = s[m] / e[m]
    log = np.log(e[m]) + scale + m * (eta.mean() - np.log(m / (len(eta) - m)))
    return log, mean, q[m] / e[m] - np.outer(mean, mean)


def _many_cases():
    """Sets of one, few and more than 600 cases, with equal and different members."""
    rng = np.random.default_rng(5)
    sets = []
    for n, m in ((1500, 700), (1300, 20), (40, 39), (9, 1), (6, 3)):
        x = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n) if n != 1500 else rng.integers(0, 3, n)])
        case = np.zeros(n)
        case[rng.choice(n, m, replace=False, p=(w := np.exp(0.5 * x[:, 0])) / w.sum())] = 1
        sets.append((x.astype(float), case))
    return sets


def test_clogit_any_number_of_cases(spark):
    sets = _many_cases()
    x, case = np.concatenate([x for x, _ in sets]), np.concatenate([c for _, c in sets])
    df = frame(spark, x, set=np.repeat(np.arange(len(sets)), [len(c) for _, c in sets]), case=case).repartition(4)
    fit = fit_clogit(clogit_design(df, "set", "case", [F.col("x")]), ["a", "b"])
    b = np.zeros(2)
    for _ in range(12):
        ll, u, info = 0.0, np.zeros(2), np.zeros((2, 2))
        for xs, cs in sets:
            below, mean, spread = _drawn_together(xs @ b, xs, int(cs.sum()))
            ll, u, info = ll + cs @ xs @ b - below, u + cs @ xs - mean, info + spread
        b = b + np.linalg.solve(info, u)
    np.testing.assert_allclose(fit.coef, b, atol=1e-7)
    np.testing.assert_allclose(fit.cov, np.linalg.inv(info), rtol=1e-6)
    np.testing.assert_allclose(fit.loglik, ll, rtol=1e-10)
    assert (fit.n, fit.n_event) == (len(x), len(sets))


def test_clogit_large_sets_are_summed_apart(spark, monkeypatch):
    """Sets of more different members than a row holds, and with a number of
    their own, as the fit with every set in one row has them."""
    from lagloom.models import matched

    sets = _many_cases()
    x, case = np.concatenate([x for x, _ in sets]), np.concatenate([c for _, c in sets])
    many = np.repeat([2, 1, 3, 1, 1], [len(c) for _, c in sets])
    key = np.repeat(np.arange(len(sets)), [len(c) for _, c in sets])
    df = frame(spark, x, set=key, case=case, many=many).repartition(4)
    design = clogit_design(df, "set", "case", [F.col("x")], "many")
    monkeypatch.setattr(matched, "_VALUES", 10**6)
    one_row = fit_clogit(design, ["a", "b"])
    monkeypatch.setattr(matched, "_VALUES", 32)
    apart = fit_clogit(design, ["a", "b"])
    np.testing.assert_allclose(apart.coef, one_row.coef, atol=1e-9)
    np.testing.assert_allclose(apart.cov, one_row.cov, rtol=1e-8)
    np.testing.assert_allclose(apart.loglik, one_row.loglik, rtol=1e-11)
    assert (apart.n, apart.n_event) == (one_row.n, one_row.n_event)


def test_clogit_counted_sets_stand_for_equal_sets(spark):
    """Sets of one or several cases, each given once with its number."""
    rng = np.random.default_rng(8)
    sets, many = np.repeat(np.arange(40), 5), rng.integers(1, 6, 40)
    x, case = rng.normal(size=(200, 2)), np.zeros(200)
    for s in range(40):
        case[5 * s + rng.choice(5, size=1 + s % 2, replace=False)] = 1
    row = np.concatenate([np.flatnonzero(sets == s) for s in range(40) for _ in range(many[s])])
    copy = np.repeat(np.arange(many.sum()), 5)
    once = clogit_design(frame(spark, x, set=sets, case=case, n=many[sets]), "set", "case", [F.col("x")], "n")
    all_ = clogit_design(frame(spark, x[row], set=copy, case=case[row]), "set", "case", [F.col("x")])
    a, b = (fit_clogit(d, ["a", "b"]) for d in (once, all_))
    np.testing.assert_allclose(a.coef, b.coef, atol=1e-9)
    np.testing.assert_allclose(a.cov, b.cov, rtol=1e-7)
    assert (a.n, a.n_event) == (b.n, b.n_event) == (5 * many.sum(), many.sum())


def _check_loss(y, x, b, tau):
    r = y - x @ b
    return np.sum(r * (tau - (r < 0)))


def test_quantile_fit_is_a_minimum(spark):
    rng = np.random.default_rng(13)
    n = 2000
    x = np.column_stack([np.ones(n), rng.random(n), rng.integers(0, 2, n)]).astype(float)
    y = x @ [1.0, 2.0, -1.0] + rng.standard_normal(n) * (1 + x[:, 1])
    df = frame(spark, x, y=y, model=["m"] * n).repartition(4)
    for f, tau in zip(fit_quantile(df, ["one", "a", "b"], [0.2, 0.5, 0.9]), (0.2, 0.5, 0.9), strict=True):
        assert f.converged
        best = _check_loss(y, x, f.coef, tau)
        assert best == pytest.approx(-f.loglik)
        for _ in range(200):
            move = rng.standard_normal(3) * 10 ** rng.uniform(-6, -1)
            assert _check_loss(y, x, f.coef + move, tau) >= best * (1 - 2e-9)


def test_quantile_fit_with_many_ties(spark):
    """A rounded response, far more tied rows than any task holds apart: the
    fit on two strata is the quantile of each."""
    rng = np.random.default_rng(3)
    n = 60_001
    group = (rng.random(n) < 0.3).astype(float)
    y = np.rint(30 + 5 * rng.standard_normal(n) + 3 * group)
    df = frame(spark, np.column_stack([np.ones(n), group]), y=y, model=["m"] * n)
    taus = [0.1, 0.5, 0.77]
    for f, tau in zip(fit_quantile(df, ["one", "g"], taus), taus, strict=True):
        want = [np.quantile(y[group == g], tau, method="inverted_cdf") for g in (0, 1)]
        assert np.allclose([f.coef[0], f.coef.sum()], want, atol=1e-5)


@pytest.mark.parametrize("kind", ["smooth", "counts", "long tail"])
def test_quantile_path_gets_the_rows_near_the_fit(spark, monkeypatch, kind):
    """Of many rows only those near a fit go through the steps of its path; the
    minimum is that of all rows."""
    from lagloom.models import quantile

    rng = np.random.default_rng(1)
    n = 30_000
    x = np.column_stack([np.ones(n), rng.random(n), rng.random(n) < 0.3]).astype(float)
    y = {
        "smooth": x @ [3.0, 2.0, -1.0] + rng.standard_normal(n) * (1 + x[:, 1]),
        "counts": np.floor(50 * rng.random(n)),
        "long tail": np.round(np.exp(3 * rng.standard_normal(n)), 2),
    }[kind]
    df = frame(spark, x, y=y, model=["m"] * n).repartition(4)
    taus, sizes, solve = [0.1, 0.5], [], quantile._solve

    def watched(rows, *rest):
        sizes.append(rows.count())
        return solve(rows, *rest)

    monkeypatch.setattr(quantile, "_solve", watched)
    monkeypatch.setattr(quantile, "_WHOLE", 10**9, raising=False)
    whole = fit_quantile(df, ["one", "a", "b"], taus)
    monkeypatch.setattr(quantile, "_WHOLE", 1000, raising=False)
    monkeypatch.setattr(quantile, "_NEAR", 1000, raising=False)
    sizes.clear()
    for f, g, tau in zip(fit_quantile(df, ["one", "a", "b"], taus), whole, taus, strict=True):
        best = _check_loss(y, x, f.coef, tau)
        assert best == pytest.approx(-f.loglik, rel=1e-9)
        assert best <= -g.loglik * (1 + 2e-9)
        assert f.n == n
    assert sizes[0] < n / 5


def _small_dlnm(spark):
    rng = np.random.default_rng(21)
    n, lag = 900, 6
    x = 10 + 8 * np.sin(np.arange(n) / 30) + rng.normal(size=n)
    cb = CrossBasis(
        bs.bspline(3, [8.0, 12.0], float(x.min()), float(x.max())),
        bs.lag_basis(bs.BasisSpec("ns", df=3), lag), lag, "t",
    )
    effect = np.zeros(n)
    for k in range(lag + 1):
        effect[lag:] += 0.02 * np.exp(-k / 2) * (x[lag - k : n - k] - 10)
    y = rng.poisson(40 * np.exp(effect))
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "x": x, "y": y.astype(float)}))
    rows = cb.on_series(df, "t", "x")
    fit = fit_glm(rows, GlmSpec("y", "quasipoisson", (Term("x", "cb", tuple(cb.terms)),)))
    return cb, rows, fit


def test_predictions(spark):
    cb, rows, fit = _small_dlnm(spark)
    at = [6.0, 10.0, 14.0]
    overall = {r["at"]: r for r in predict.overall_effects(spark, cb, fit, at, cen=10.0).collect()}
    assert overall[10.0].fit == 0.0 and overall[10.0].se == 0.0 and overall[10.0].rr == 1.0
    coef, cov = fit.block(cb.terms)
    z = np.outer(cb.var.values([14.0])[0] - cb.var.values([10.0])[0], cb.weights.sum(0)).ravel()
    assert overall[14.0].fit == pytest.approx(z @ coef)
    assert overall[14.0].se == pytest.approx(np.sqrt(z @ cov @ z))
    assert overall[14.0].rr_low == pytest.approx(np.exp(z @ coef - 1.959963984540054 * overall[14.0].se))
    # Recovery of the simulated slope: 4 units times the lag sum.
    truth = 4 * 0.02 * np.exp(-np.arange(7) / 2).sum()
    assert abs(overall[14.0].fit - truth) < 4 * overall[14.0].se
    by_lag = predict.lag_effects(spark, cb, fit, at, cen=10.0).where("at = 14").collect()
    assert sum(r.fit for r in by_lag) == pytest.approx(overall[14.0].fit)
    steps = {r.lag: r for r in predict.cumulative_effects(spark, cb, fit, at, cen=10.0).where("at = 14").collect()}
    assert steps[6].fit == pytest.approx(overall[14.0].fit)
    assert steps[6].se == pytest.approx(overall[14.0].se)
    assert len(predict.lag_effects(spark, cb, fit, at, lags=[0, 5], cen=10.0).collect()) == 6
    wide = predict.overall_effects(spark, cb, fit, [14.0], cen=10.0, level=0.99).first()
    assert wide.rr_high > overall[14.0].rr_high
    assert predict.overall_effects(spark, cb, fit, [14.0]).first().cen == pytest.approx(
        sum(cb.var.about["boundary"]) / 2
    )
    scored = predict.score_rows(rows, cb, fit, "cb", cen=10.0).where("cb is not null").first()
    base = np.outer(cb.var.values([10.0])[0], cb.weights.sum(0)).ravel()
    assert scored.log_effect == pytest.approx((np.array(scored.cb) - base) @ coef)


def test_grouped_time_series_fit_equals_filtered(spark):
    """Design of two groups together equals the designs of each alone."""
    rng = np.random.default_rng(31)
    rows = [(g, t, float(rng.random())) for g in "ab" for t in range(50)]
    df = spark.createDataFrame(rows, "g string, t long, x double")
    cb = CrossBasis(bs.linear(), bs.lag_basis(bs.BasisSpec("ns", df=2), 4), 4)
    both = {(r.g, r.t): r.cb for r in cb.on_series(df, "t", "x", keys=["g"]).collect()}
    for g in "ab":
        alone = cb.on_series(df.where(F.col("g") == g), "t", "x").collect()
        for r in alone:
            assert both[(g, r.t)] == r.cb


def test_cox_counts_stand_for_rows(spark, data):
    """A row with a count and several events equals that many rows."""
    rng = np.random.default_rng(5)
    rows = [
        (float(rng.integers(1, 6)), float(e := rng.integers(0, n + 1)), float(n), [float(v) for v in rng.normal(size=2)])
        for n in rng.integers(1, 5, 60)
    ]
    df = spark.createDataFrame(rows, "exit double, event double, n double, x array<double>")
    one = [(t, 1.0 if i < e else 0.0, x) for t, e, n, x in rows for i in range(int(n))]
    flat = spark.createDataFrame(one, "exit double, event double, x array<double>")
    beta = {"model": np.array([0.4, -0.3])}
    zero = {"model": np.zeros(2)}
    got = cox_step(cox_design(df, "exit", "event", [F.col("x")], count="n"), beta, zero)["model"]
    want = cox_step(cox_design(flat, "exit", "event", [F.col("x")]), beta, zero)["model"]
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_cox_models_by_key(spark, data):
    """Many models as rows give the fits of the models one by one."""
    from lagloom.models.cox import fit_cox_models, model_coefficients

    rng = np.random.default_rng(12)
    rows = [
        (f"m{k}", str(i % 2), None, float(rng.integers(1, 9)), float(rng.random() < 0.6), 1.0,
         [float(v) for v in rng.normal(size=1 + k % 3)])
        for k in range(12) for i in range(60)
    ]
    rows += [("silent", "", None, 3.0, 0.0, 1.0, [0.1, 0.2])] * 4
    schema = "model string, stratum string, entry double, exit double, event double, n double, x array<double>"
    design = spark.createDataFrame(rows, schema)
    fits = fit_cox_models(design, 3)
    terms = spark.createDataFrame(
        [(f"m{k}", i, f"x{i}") for k in range(12) for i in range(1 + k % 3)], "model string, place int, term string"
    )
    got = {(r.model, r.term): r for r in model_coefficients(fits, terms).collect()}
    assert len(got) == 24 and all(r.converged and r.n == 60 for r in got.values())
    for k in range(12):
        one = fit_cox(design.where(F.col("model") == f"m{k}"), {f"m{k}": [f"x{i}" for i in range(1 + k % 3)]}, tol=1e-14)[f"m{k}"]
        for i in range(1 + k % 3):
            r = got[f"m{k}", f"x{i}"]
            np.testing.assert_allclose([r.estimate, r.std_error], [one.coef[i], one.cov[i, i] ** 0.5], rtol=1e-6)
            np.testing.assert_allclose(r.loglik, one.loglik, rtol=1e-9)


def test_risk_cells_against_persons(spark):
    """Episodes from counts, and a covariate that changes with time, against a
    dense fit on one row per person and week."""
    from lagloom.operators.exposure import risk_cells

    rng = np.random.default_rng(3)
    windows = [("a", 2, 5), ("b", 5, 9), ("c", 2, 9)]
    people = [(int(rng.integers(0, 3)), int(rng.integers(0, 6)), int(rng.integers(1, 12))) for _ in range(400)]
    x = rng.normal(size=(3, 40))
    df = spark.createDataFrame([*people, (1, None, 4), (1, 2, None)], "area int, start int, stop int")
    cells = risk_cells(df, ["area"], "start", F.col("stop"), windows)
    got = {(r.window, r.area, r.start, r.time): (r.at_risk, r.events) for r in cells.collect()}
    want = {}
    for area, start, stop in people:
        for name, low, high in windows:
            for t in range(low + 1, min(stop, high) + 1) if stop > low else ():
                n, e = want.get((name, area, start, t), (0, 0))
                want[name, area, start, t] = (n + 1, e + (t == stop))
    assert got == want
    values = spark.createDataFrame([(a, t, float(x[a, t])) for a in range(3) for t in range(40)], "area int, t int, v double")
    rows = cells.withColumn("t", F.col("start") + F.col("time")).join(values, ["area", "t"])
    design = cox_design(
        rows, "time", "events", [F.array("v")], model=F.col("window"), stratum=F.col("time"), count="at_risk"
    )
    fits = fit_cox(design, {n: ["v"] for n, _, _ in windows})
    for name, low, high in windows:
        part = [(t, a, s, e) for a, s, e in people for t in range(low + 1, min(e, high) + 1) if e > low]
        xs = np.array([[x[a, s + t]] for t, a, s, _ in part])
        time, event = np.array([float(p[0]) for p in part]), np.array([float(p[0] == p[3]) for p in part])
        b = np.zeros(1)
        for _ in range(20):
            _, u, info = _cox_dense(xs, np.full(len(part), -1.0), time, event, time, "efron", b)
            b = b + u / info[0]
        np.testing.assert_allclose(fits[name].coef, b, rtol=1e-6)
        np.testing.assert_allclose(fits[name].cov[0, 0], 1 / info[0, 0], rtol=1e-6)


def test_qr_tree_on_nearly_collinear_columns(spark):
    """Powers of a variable far from zero: Gram matrices lose these digits."""
    rng = np.random.default_rng(7)
    u = rng.uniform(-1, 1, 3000)
    x = np.column_stack([((25 + 6.5 * u) / 32) ** k for k in range(1, 7)])
    y = 1 + np.sin(2 * u) + 0.1 * rng.normal(size=3000)
    df = frame(spark, x, y=y).repartition(70)
    fit = fit_glm(df, GlmSpec("y", "gaussian", (Term("p", "x", tuple(f"p{i}" for i in range(6))),)))
    assert np.isfinite(fit.cov).all() and fit.df_model == 7
    want = np.polynomial.polynomial.polyval(u, np.polynomial.polynomial.polyfit(u, y, 6))
    got = fit.coef[0] + x @ fit.coef[1:]
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_dlnm_compare_on_a_narrow_exposure(spark, tmp_path):
    """Daily means of very many orders differ little and lie far from zero;
    powers of them were collinear and the polynomial fit did not converge."""
    from lagloom.plans.model_plans import dlnm_compare

    rng = np.random.default_rng(5)
    day = np.repeat(np.arange(500), 2 + rng.poisson(3, 500))
    n = len(day)
    pdf = pd.DataFrame({
        "o_orderkey": np.arange(n), "o_custkey": np.arange(n) % 50,
        "o_orderdate": pd.Timestamp("1995-01-01") + pd.to_timedelta(day, "D"),
        "o_totalprice": 250_000 + rng.normal(0, 3000, n).round(2),
    })
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "orders.parquet"))
    rows = dlnm_compare(spark, str(tmp_path)).where("model = 'polynomial' and lag is not null").collect()
    assert [r.lag for r in sorted(rows, key=lambda r: r.lag)] == list(range(31))
    assert all(np.isfinite([r.fit, r.se]).all() for r in rows)


def test_chebyshev_spans_the_powers(spark):
    x = np.linspace(24.0, 26.0, 41)
    a = np.column_stack([np.ones(41), bs.chebyshev(4, 24.0, 26.0).values(x)])
    powers = (x[:, None] - 25.0) ** np.arange(5)
    np.testing.assert_allclose(a @ np.linalg.lstsq(a, powers, rcond=None)[0], powers, atol=1e-12)
    assert np.linalg.cond(a) < 10
    got = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = got.select(bs.chebyshev(4, 24.0, 26.0).column("x").alias("b")).collect()
    np.testing.assert_allclose([r.b for r in got], a[:, 1:], atol=1e-12)


def test_quantile_bands_take_few_passes(spark, monkeypatch):
    """A band that fits in a task is solved there, in one pass instead of two a
    step, and gives the fit of the steps over distributed rows."""
    from lagloom.models import quantile

    rng = np.random.default_rng(4)
    n = 20_000
    x = np.column_stack([np.ones(n), rng.random(n), rng.random(n) < 0.4]).astype(float)
    y = x @ [1.0, 2.0, -1.0] + rng.standard_normal(n) * (1 + x[:, 1])
    df = frame(spark, x, y=y, model=["m"] * n).repartition(4)
    passes, summed = [], quantile.sum_vectors

    def watched(*args):
        passes.append(1)
        return summed(*args)

    monkeypatch.setattr(quantile, "sum_vectors", watched)
    monkeypatch.setattr(quantile, "_WHOLE", 5000)
    monkeypatch.setattr(quantile, "_NEAR", 2500)
    one_task = fit_quantile(df, ["one", "a", "b"], [0.1, 0.5])
    few = len(passes)
    monkeypatch.setattr(quantile, "_TASK", 0, raising=False)
    spread = fit_quantile(df, ["one", "a", "b"], [0.1, 0.5])
    assert few + 15 < len(passes) - few
    for a, b, tau in zip(one_task, spread, (0.1, 0.5), strict=True):
        assert _check_loss(y, x, a.coef, tau) == pytest.approx(_check_loss(y, x, b.coef, tau), rel=2e-9)
        np.testing.assert_allclose(a.coef, b.coef, atol=1e-5)


def test_fits_that_need_nothing_of_each_other_run_together(spark):
    from threading import Barrier

    from lagloom.plans.model_plans import _side_by_side

    both = Barrier(2, timeout=60)

    def step(n):
        both.wait()
        return spark.range(n).count()

    assert _side_by_side(spark, lambda: step(3), lambda: step(5)) == [3, 5]
    with pytest.raises(ValueError, match="lost"):
        _side_by_side(spark, lambda: 1, lambda: (_ for _ in ()).throw(ValueError("lost")))

"""Generalised linear models by iteratively reweighted least squares, each step
one pass that factors the weighted rows in a tree."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.models.fitted import Fitted
from lagloom.models.moments import keep, least_squares, pack, triangular_factors

_lgamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass(frozen=True)
class Family:
    """Variance and link of a response; `scaled` estimates the dispersion."""

    name: str
    link: str
    scaled: bool

    def start(self, y):
        if self.name == "poisson":
            return y + 0.1
        if self.name == "binomial":
            return (y + 0.5) / 2.0
        return y

    def eta(self, mu):
        if self.link == "log":
            return np.log(mu)
        if self.link == "logit":
            return np.log(mu / (1.0 - mu))
        return mu

    def mean(self, eta):
        if self.link == "log":
            return np.exp(np.clip(eta, -700.0, 700.0))
        if self.link == "logit":
            return 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))
        return eta

    def slope(self, mu):
        """Derivative of the mean by the linear predictor."""
        if self.link == "log":
            return mu
        if self.link == "logit":
            return np.maximum(mu * (1.0 - mu), 1e-300)
        return np.ones_like(mu)

    def variance(self, mu):
        if self.name == "poisson":
            return np.maximum(mu, 1e-300)
        if self.name == "binomial":
            return np.maximum(mu * (1.0 - mu), 1e-300)
        return np.ones_like(mu)

    def deviance(self, y, mu):
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.name == "poisson":
                return 2.0 * (np.where(y > 0, y * np.log(y / mu), 0.0) - (y - mu))
            if self.name == "binomial":
                a = np.where(y > 0, y * np.log(y / mu), 0.0)
                b = np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - mu)), 0.0)
                return 2.0 * (a + b)
        return (y - mu) ** 2

    def loglik(self, y, mu):
        """Log likelihood of a unit-dispersion model (Poisson, binomial)."""
        if self.name == "poisson":
            return y * np.log(np.maximum(mu, 1e-300)) - mu - _lgamma(y + 1.0)
        if self.name == "binomial":
            with np.errstate(divide="ignore", invalid="ignore"):
                a = np.where(y > 0, y * np.log(np.maximum(mu, 1e-300)), 0.0)
                b = np.where(y < 1, (1 - y) * np.log(np.maximum(1 - mu, 1e-300)), 0.0)
            return a + b
        return np.zeros_like(y)


FAMILIES = {
    "gaussian": Family("gaussian", "identity", True),
    "poisson": Family("poisson", "log", False),
    "quasipoisson": Family("poisson", "log", True),
    "binomial": Family("binomial", "logit", False),
    "quasibinomial": Family("binomial", "logit", True),
    "gaussian_log": Family("gaussian", "log", True),
}


@dataclass(frozen=True)
class Term:
    """A named part of the linear predictor: an array column, or a number."""

    name: str
    column: str
    labels: tuple[str, ...]
    array: bool = True


@dataclass(frozen=True)
class GlmSpec:
    """Response, family and terms; the intercept is always first."""

    response: str
    family: str
    terms: tuple[Term, ...]
    offset: str | None = None
    weight: str | None = None
    name: str = "model"

    def update(
        self, drop: tuple[str, ...] = (), add: tuple[Term, ...] = (), name: str | None = None
    ) -> GlmSpec:
        """The same model with some terms dropped and others added."""
        missing = set(drop) - {t.name for t in self.terms}
        if missing:
            raise ValueError(f"no such term: {sorted(missing)}")
        kept = tuple(t for t in self.terms if t.name not in drop)
        return replace(self, terms=kept + tuple(add), name=name or self.name)

    @property
    def labels(self) -> list[str]:
        return ["intercept", *[label for t in self.terms for label in t.labels]]

    def design(self, df: DataFrame) -> DataFrame:
        """Rows as (model, y, offset, w, x). A row with a missing part has a
        NaN somewhere and is left out by the fit."""
        parts: list[Column] = [F.array(F.lit(1.0))]
        for t in self.terms:
            parts.append(
                F.col(t.column) if t.array else F.array(F.col(t.column).cast("double"))
            )
        offset = F.col(self.offset) if self.offset else F.lit(0.0)
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        missing = F.array_repeat(F.lit(float("nan")), len(self.labels))
        return df.select(
            F.lit(self.name).alias("model"),
            F.col(self.response).cast("double").alias("y"),
            offset.cast("double").alias("offset"),
            weight.cast("double").alias("w"),
            F.coalesce(F.concat(*parts), missing).alias("x"),
        )


def fit_design(
    design: DataFrame,
    labels: dict[str, list[str]],
    family: str,
    tol: float = 1e-10,
    max_iter: int = 50,
) -> dict[str, Fitted]:
    """Fit every model of a design (model, y, offset, w, x) together: one job
    per iteration for all of them. `labels` names the columns of each model."""
    fam = FAMILIES[family]

    def step(betas: dict[str, np.ndarray]):
        """Triangular factor of the weighted rows (x, working response) and
        sums at the coefficients `betas`, per model."""

        def block(model: str, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            x, y, w = c["x"], c["y"], c["w"]
            if model in betas:
                eta = x @ betas[model] + c["offset"]
                mu = fam.mean(eta)
            else:
                mu = fam.start(y)
                eta = fam.eta(mu) if fam.link != "log" else np.log(np.maximum(mu, 1e-8))
            slope = fam.slope(mu)
            var = fam.variance(mu)
            root = np.sqrt(w * slope * slope / var)
            z = eta - c["offset"] + (y - mu) / slope
            sums = pack(
                np.sum(w * fam.deviance(y, mu)), np.sum(w * (y - mu) ** 2 / var),
                np.sum(w * fam.loglik(y, mu)), len(y),
            )
            return np.column_stack([x, z]) * root[:, None], sums

        return triangular_factors(design, block)

    beta: dict[str, np.ndarray] = {}
    last: dict[str, float] = {}
    done: dict[str, Fitted] = {}
    for iteration in range(max_iter):
        found = step(beta)
        for m, (upper, sums) in found.items():
            dev, pearson, ll, n, lost = (float(v) for v in sums)
            if n == 0 or m in done:
                continue
            coef, root, _ = least_squares(upper)
            if m in last and abs(dev - last[m]) <= tol * (abs(dev) + 0.1):
                aliased = np.isnan(root).any(axis=1) if root.shape[1] else np.ones(len(coef), bool)
                r = int((~aliased).sum())
                df_resid = n - r
                phi = pearson / df_resid if fam.scaled and df_resid > 0 else 1.0
                if fam.name == "gaussian":
                    ll = -0.5 * n * (math.log(2 * math.pi * max(dev, 1e-300) / n) + 1.0)
                cov = root @ root.T * phi
                cov[aliased, :] = cov[:, aliased] = np.nan
                done[m] = Fitted(
                    m, labels[m], beta[m], cov, int(n), ll, dev, phi, df_resid,
                    iterations=iteration, use_t=fam.scaled, n_dropped=int(lost),
                )
            elif m in beta:
                last[m] = dev
            if m not in done:
                beta[m] = coef
        if set(done) == set(beta):
            return done
    raise ValueError(f"no convergence in {max_iter} steps: {sorted(set(beta) - set(done))}")


def fit_glm(df: DataFrame, spec: GlmSpec, tol: float = 1e-10, max_iter: int = 50) -> Fitted:
    """Fit one model. The design rows are kept in memory or on executor disk
    over the iterations."""
    design = keep(spec.design(df))
    try:
        fits = fit_design(design, {spec.name: spec.labels}, spec.family, tol, max_iter)
    finally:
        design.unpersist()
    if not fits or fits[spec.name].n == 0:
        raise ValueError("no complete rows to fit")
    return fits[spec.name]


def wls_line(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted straight line per group from one partial aggregate."""
    # Sums about the overall means: group means far from zero cancel no digits.
    at = df.agg(F.avg(x).alias("x"), F.avg(y).alias("y")).first()
    x0, y0 = (F.lit(float(v or 0.0)) for v in at)
    w, u, v = F.col(weight), F.col(x) - x0, F.col(y) - y0
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(w).alias("sw"),
        F.sum(w * u).alias("sx"),
        F.sum(w * v).alias("sy"),
        F.sum(w * u * u).alias("sxx"),
        F.sum(w * u * v).alias("sxy"),
    )
    det = F.expr("sxx - sx * sx / sw")
    slope = F.when(det > 0, F.expr("sxy - sx * sy / sw") / det)
    return s.select(
        *keys, "n", slope.alias("slope"),
        (y0 + F.col("sy") / F.col("sw") - slope * (x0 + F.col("sx") / F.col("sw"))).alias("intercept"),
    )

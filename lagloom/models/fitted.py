"""Fitted models: small driver-side results with tidy tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lagloom.functions.tails import chi2_upper, normal_quantile, normal_two_sided, t_quantile, t_two_sided


@dataclass
class Fitted:
    name: str
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    loglik: float | None = None
    deviance: float | None = None
    dispersion: float = 1.0
    df_resid: float | None = None
    n_event: int | None = None
    iterations: int = 0
    converged: bool = True
    n_dropped: int = 0
    use_t: bool = False

    def block(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and covariance of some terms."""
        at = [self.terms.index(t) for t in terms]
        return self.coef[at], self.cov[np.ix_(at, at)]

    @property
    def df_model(self) -> int:
        return int(np.sum(np.isfinite(np.diag(self.cov))))


_TIDY = (
    "model string, term string, estimate double, std_error double, statistic double, "
    "p_value double, conf_low double, conf_high double, exp_estimate double, "
    "exp_low double, exp_high double, n long, n_dropped long, converged boolean"
)


def _clean(v):
    v = float(v)
    return v if np.isfinite(v) else None


def tidy(spark: SparkSession, fits: list[Fitted], level: float = 0.95) -> DataFrame:
    """Coefficient table: estimate, interval and p value, also on the ratio
    scale, with the rows used and left out. Aliased terms have null errors."""
    rows = []
    for f in fits:
        se = np.sqrt(np.diag(f.cov))
        with np.errstate(all="ignore"):
            z = f.coef / se
        if f.use_t:
            q = float(t_quantile(0.5 + level / 2, f.df_resid))
            p = t_two_sided(z, f.df_resid)
        else:
            q, p = normal_quantile(0.5 + level / 2), normal_two_sided(z)
        lo, hi = f.coef - q * se, f.coef + q * se
        for i, term in enumerate(f.terms):
            aliased = not np.isfinite(se[i])
            est = None if aliased else float(f.coef[i])
            with np.errstate(over="ignore"):
                ratio = [None] * 3 if aliased else [
                    _clean(np.exp(v)) for v in (f.coef[i], lo[i], hi[i])
                ]
            rows.append(
                (f.name, term, est, _clean(se[i]), _clean(z[i]), _clean(p[i]),
                 _clean(lo[i]), _clean(hi[i]), *ratio, int(f.n), int(f.n_dropped), bool(f.converged))
            )
    return spark.createDataFrame(rows, _TIDY)


def compare(spark: SparkSession, small: Fitted, large: Fitted) -> DataFrame:
    """Likelihood-ratio test of nested models fitted to the same rows."""
    if small.n != large.n:
        raise ValueError("nested models must be fitted to the same rows")
    stat = 2.0 * (large.loglik - small.loglik)
    df = large.df_model - small.df_model
    rows = [
        (
            f.name, f.n, f.df_model, float(f.loglik),
            float(-2 * f.loglik + 2 * f.df_model),
            float(-2 * f.loglik + np.log(f.n) * f.df_model),
            s, d, p,
        )
        for f, s, d, p in (
            (small, None, None, None),
            (large, float(stat), int(df), float(chi2_upper(max(stat, 0.0), df))),
        )
    ]
    return spark.createDataFrame(
        rows,
        "model string, n long, df int, loglik double, aic double, bic double, "
        "statistic double, df_diff int, p_value double",
    )

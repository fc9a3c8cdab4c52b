"""Effects from a fitted distributed-lag model on a grid of exposures and lags.

The grid is made by Spark from the chosen exposure values; coefficients and
their covariance enter as literals of model size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions.tails import normal_quantile
from lagloom.models.basis import Basis
from lagloom.models.crossbasis import CrossBasis, _literal_rows
from lagloom.models.fitted import Fitted

_DOT = "aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"


def exposure_grid(basis: Basis, by: float | None = None, points: int = 50) -> list[float]:
    """Default exposure values: multiples of `by` inside the training range, or
    `points` equal steps over it."""
    lo, hi = basis.about["boundary"]
    if by is None:
        return [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    first, last = math.ceil(lo / by - 1e-9), math.floor(hi / by + 1e-9)
    return [i * by for i in range(first, last + 1)]


def default_centre(basis: Basis) -> float | None:
    """Threshold, step and linear bases need no centre; smooth bases use the
    middle of their training range."""
    if basis.kind in {"thr", "strata", "lin"}:
        return None
    if "boundary" not in basis.about:
        raise ValueError(f"give a centre for a {basis.kind} basis")
    return sum(basis.about["boundary"]) / 2.0


def _centre_values(cb: CrossBasis, cen: float | None) -> np.ndarray:
    return np.zeros(cb.var.width) if cen is None else cb.var.values([cen])[0]


def _effects(
    spark: SparkSession,
    cb: CrossBasis,
    fit: Fitted,
    at: Sequence[float],
    lag_rows: list[tuple[int, np.ndarray]],
    cen: float | None,
    level: float,
    terms: list[str] | None,
) -> DataFrame:
    cen = default_centre(cb.var) if cen is None else cen
    coef, cov = _usable(cb, fit, terms)
    base = _literal_rows(_centre_values(cb, cen)[None])
    grid = spark.createDataFrame([(float(v),) for v in at], "at double")
    lags = ", ".join(
        f"struct({k} as lag, array({', '.join(repr(float(v)) + 'D' for v in c)}) as c)"
        for k, c in lag_rows
    )
    half = normal_quantile(0.5 + level / 2.0)
    out = (
        grid.withColumn("_b", cb.var.column("at"))
        .withColumn("_d", F.expr(f"zip_with(_b, {base}[0], (p, q) -> p - q)"))
        .withColumn("_g", F.explode(F.expr(f"array({lags})")))
        .select("at", "_d", "_g.*")
    )
    out = _with_effect(out, coef, cov)
    lo, hi = F.col("fit") - half * F.col("se"), F.col("fit") + half * F.col("se")
    return out.select(
        F.lit(fit.name).alias("model"),
        "at",
        F.col("lag").cast("int").alias("lag"),
        "fit",
        "se",
        F.exp("fit").alias("rr"),
        F.exp(lo).alias("rr_low"),
        F.exp(hi).alias("rr_high"),
        F.lit(cen).cast("double").alias("cen"),
    )


def _usable(cb: CrossBasis, fit: Fitted, terms: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    coef, cov = fit.block(terms or cb.terms)
    if not np.all(np.isfinite(cov)):
        raise ValueError("some terms of the design are aliased in this fit")
    return coef, cov


def _with_effect(rows: DataFrame, coef: np.ndarray, cov: np.ndarray) -> DataFrame:
    """fit = z'b and se = sqrt(z'Vz) for z from basis differences `_d` and lag
    weights `c`."""
    z = "flatten(transform(_d, v -> transform(c, w -> v * w)))"
    return (
        rows.withColumn("_z", F.expr(z))
        .withColumn("fit", F.expr(_DOT.format(a="_z", b=f"{_literal_rows(coef[None])}[0]")))
        .withColumn(
            "_vz",
            F.expr(f"transform({_literal_rows(cov)}, r -> {_DOT.format(a='r', b='_z')})"),
        )
        .withColumn("se", F.expr(f"sqrt(greatest({_DOT.format(a='_z', b='_vz')}, 0D))"))
    )


def contrast_rows(
    df: DataFrame, cb: CrossBasis, fit: Fitted, at: str = "at", cen: str = "cen",
    level: float = 0.95, terms: list[str] | None = None,
) -> DataFrame:
    """Every row of `df` with the effect of its own exposure `at` against its
    own centre `cen`, sustained over all lags: fit, se, rr, rr_low, rr_high. A
    null point or centre gives null effects. Any number of rows; nothing but the
    coefficients is on the driver."""
    coef, cov = _usable(cb, fit, terms)
    half = normal_quantile(0.5 + level / 2.0)
    weights = _literal_rows(cb.weights.sum(0)[None])
    rows = (
        df.withColumn("_b", cb.var.column(at))
        .withColumn("_b0", cb.var.column(cen))
        .withColumn("_d", F.expr("zip_with(_b, _b0, (p, q) -> p - q)"))
        .withColumn("c", F.expr(f"{weights}[0]"))
    )
    out = _with_effect(rows, coef, cov).drop("_b", "_b0", "_d", "_z", "_vz", "c")
    return out.withColumns(
        {
            "rr": F.exp("fit"),
            "rr_low": F.exp(F.col("fit") - half * F.col("se")),
            "rr_high": F.exp(F.col("fit") + half * F.col("se")),
        }
    )


def lag_effects(
    spark, cb: CrossBasis, fit: Fitted, at, lags=None, cen=None, level=0.95, terms=None
) -> DataFrame:
    """Effect at each exposure value and lag: the whole surface, or slices of
    it by choosing exposure values or lags."""
    c = cb.weights
    chosen = range(cb.max_lag + 1) if lags is None else lags
    return _effects(spark, cb, fit, at, [(k, c[k]) for k in chosen], cen, level, terms)


def overall_effects(
    spark, cb: CrossBasis, fit: Fitted, at, cen=None, level=0.95, terms=None
) -> DataFrame:
    """Effect of an exposure sustained over all lags."""
    rows = [(cb.max_lag, cb.weights.sum(0))]
    return _effects(spark, cb, fit, at, rows, cen, level, terms)


def cumulative_effects(
    spark, cb: CrossBasis, fit: Fitted, at, cen=None, level=0.95, terms=None
) -> DataFrame:
    """Effect accumulated from lag 0 to each lag, with the variance of the
    accumulated contrast."""
    c = np.cumsum(cb.weights, axis=0)
    rows = [(k, c[k]) for k in range(cb.max_lag + 1)]
    return _effects(spark, cb, fit, at, rows, cen, level, terms)


def smooth_band(
    spark: SparkSession, cb: CrossBasis, fit: Fitted, at: Sequence[float], level: float = 0.95
) -> DataFrame:
    """Fitted curve of a model with an intercept and one unlagged basis, with
    its pointwise band."""
    from lagloom.functions.tails import t_quantile

    coef, cov = fit.block(["intercept", *cb.terms])
    q = float(t_quantile(0.5 + level / 2.0, fit.df_resid)) if fit.use_t else normal_quantile(
        0.5 + level / 2.0
    )
    grid = spark.createDataFrame([(float(v),) for v in at], "at double")
    out = (
        grid.withColumn("_z", F.concat(F.array(F.lit(1.0)), cb.var.column("at")))
        .withColumn("fit", F.expr(_DOT.format(a="_z", b=f"{_literal_rows(coef[None])}[0]")))
        .withColumn(
            "_vz", F.expr(f"transform({_literal_rows(cov)}, r -> {_DOT.format(a='r', b='_z')})")
        )
        .withColumn("se", F.expr(f"sqrt(greatest({_DOT.format(a='_z', b='_vz')}, 0D))"))
    )
    return out.select(
        "at", "fit", "se",
        (F.col("fit") - q * F.col("se")).alias("low"),
        (F.col("fit") + q * F.col("se")).alias("high"),
    )


def score_rows(
    df: DataFrame, cb: CrossBasis, fit: Fitted, column: str, cen: float | None = None,
    out: str = "log_effect", terms: list[str] | None = None,
) -> DataFrame:
    """Log relative effect of each row's own exposure history."""
    cen = default_centre(cb.var) if cen is None else cen
    coef, _ = fit.block(terms or cb.terms)
    base = np.outer(_centre_values(cb, cen), cb.weights.sum(0)).ravel() @ coef
    dot = _DOT.format(a=column, b=f"{_literal_rows(coef[None])}[0]")
    return df.withColumn(out, F.expr(f"case when {column} is not null then {dot} end") - float(base))

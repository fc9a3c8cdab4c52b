"""Pooling of study effects, many outcomes at once.

Fixed-effect and moment estimates are plain aggregates. REML and ML scoring
needs only weighted moments per outcome: tau^2 is a column of a table of
outcomes, every scoring step one grouped aggregate of the studies of all open
outcomes, and the small solves happen where an outcome's row is. No outcome,
however large, is gathered in one task and none has a row on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import chi2_p, chi2_upper, f_upper, t_quantile, t_two_sided
from lagloom.models.moments import solve_information
from lagloom.session import settled

# Scoring steps after which an outcome that has not settled is an error.
_STEPS = 200

_RESULT = (
    "outcome string, k long, p long, tau2 double, q double, q_df long, q_p double, "
    "i2 double, h2 double, i2_resid double, loglik double, fm double, fm_df1 long, fm_df2 long, "
    "fm_p double, estimate array<double>, std_error array<double>, statistic array<double>, "
    "p_value array<double>, conf_low array<double>, conf_high array<double>, iterations long"
)


# --- closed forms ------------------------------------------------------------


def pool_moments(df: DataFrame, by: Sequence[str], yi="yi", vi="vi") -> DataFrame:
    """Per outcome: sums of w, w^2, wy, wy^2 at w = 1/v, in one aggregate."""
    w = 1.0 / F.col(vi)
    return df.where(f"{yi} is not null and {vi} > 0").groupBy(*by).agg(
        F.count("*").alias("k"),
        F.sum(w).alias("sw"),
        F.sum(w * w).alias("sw2"),
        F.sum(w * F.col(yi)).alias("swy"),
        F.sum(w * F.col(yi) * F.col(yi)).alias("swyy"),
    )


def pool_fixed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inverse-variance pooled effect and standard error."""
    return pool_moments(df, by).select(
        *by, "k", F.expr("swy / sw").alias("estimate"), F.expr("sqrt(1 / sw)").alias("std_error")
    )


def heterogeneity(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Q, its degrees of freedom and p value, I^2 and H^2. Q is summed from the pooled
    effect in a second aggregate, not from a difference of large sums."""
    fixed = pool_moments(df, by)
    centre = fixed.select(
        *[F.col(b).alias(f"_k_{b}") for b in by], F.expr("swy / sw").alias("_mu"),
        "sw", "sw2",
    )
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    dev = (F.col("yi") - F.col("_mu")) * (F.col("yi") - F.col("_mu")) / F.col("vi")
    q = (
        df.where("yi is not null and vi > 0")
        .join(centre, on)
        .groupBy(*by)
        .agg(
            F.count("*").alias("k"),
            F.sum(dev).alias("q"),
            F.first("sw").alias("sw"),
            F.first("sw2").alias("sw2"),
        )
    )
    df_ = F.col("k") - 1
    return q.select(
        *by,
        "k",
        "q",
        df_.cast("long").alias("q_df"),
        F.when(df_ > 0, chi2_p(F.col("q"), df_)).alias("q_p"),
        F.when((F.col("q") > 0) & (df_ > 0), F.greatest(F.lit(0.0), (F.col("q") - df_) / F.col("q")))
        .otherwise(0.0)
        .alias("i2"),
        F.when(df_ > 0, F.col("q") / df_).alias("h2"),
        F.when(
            df_ > 0,
            F.greatest(
                F.lit(0.0), (F.col("q") - df_) / (F.col("sw") - F.col("sw2") / F.col("sw"))
            ),
        )
        .otherwise(0.0)
        .alias("tau2_dl"),
    )


def pool_dl(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Random-effects pooling with the closed-form moment estimate of tau^2."""
    het = heterogeneity(df, by).select(
        *[F.col(b).alias(f"_k_{b}") for b in by], F.col("tau2_dl").alias("tau2")
    )
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    w = 1.0 / (F.col("vi") + F.col("tau2"))
    return (
        df.where("yi is not null and vi > 0").join(het, on).groupBy(*by)
        .agg(
            F.count("*").alias("k"),
            F.first("tau2").alias("tau2"),
            (F.sum(w * F.col("yi")) / F.sum(w)).alias("estimate"),
            F.sqrt(1.0 / F.sum(w)).alias("std_error"),
        )
    )


def weighted_line(df: DataFrame, moderator: str, outcome: str = "outcome") -> DataFrame:
    """Weighted least squares of yi on one moderator at weights 1/(vi + tau2),
    from sums about the weighted means."""
    w = 1.0 / (F.col("vi") + F.col("tau2"))
    x = F.col(moderator)
    rows = df.where("yi is not null and vi > 0").withColumn("_w", w)
    means = rows.groupBy(F.col(outcome).alias("_o")).agg(
        (F.sum(F.col("_w") * x) / F.sum("_w")).alias("_mx"),
        (F.sum(F.col("_w") * F.col("yi")) / F.sum("_w")).alias("_my"),
    )
    dx = x - F.col("_mx")
    sums = (
        rows.join(means, F.col(outcome) == F.col("_o"))
        .groupBy(outcome)
        .agg(
            F.sum(F.col("_w") * dx * (F.col("yi") - F.col("_my"))).alias("_sxy"),
            F.sum(F.col("_w") * dx * dx).alias("_sxx"),
            F.first("_mx").alias("_mx"),
            F.first("_my").alias("_my"),
        )
    )
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx"))
    return sums.select(
        outcome, slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept")
    )


# --- scoring -------------------------------------------------------------------


class _Moments:
    """Sums over the studies of one outcome at one tau^2: weighted cross
    products of z = (x, y) for powers 0..3 of the weight, and traces."""

    def __init__(self, k, log_sum, powers, crosses):
        self.k, self.log_sum = k, log_sum
        self.w1, self.w2 = powers
        self.m0, self.m1, self.m2, self.m3 = crosses
        p = self.m1.shape[0] - 1
        self.coef, self.inv = solve_information(self.m1[:p, :p], self.m1[:p, p])
        self.rank = int(np.sum(np.isfinite(np.diag(self.inv))))
        a = np.nan_to_num(self.inv)
        g = np.append(-self.coef, 1.0)
        self.rwr = float(max(g @ self.m1 @ g, 0.0))
        self.rwwr = float(g @ self.m2 @ g)
        x2, x3 = self.m2[:p, :p], self.m3[:p, :p]
        self.tr_p = self.w1 - float(np.trace(a @ x2))
        self.tr_pp = self.w2 - 2 * float(np.trace(a @ x3)) + float(np.trace(a @ x2 @ a @ x2))

    def loglik(self, method: str) -> float:
        out = -0.5 * (self.log_sum + self.rwr)
        if method == "ML":
            return out - 0.5 * self.k * math.log(2 * math.pi)
        p = self.m1.shape[0] - 1
        _, log_w = np.linalg.slogdet(self.m1[:p, :p])
        _, log_x = np.linalg.slogdet(self.m0[:p, :p])
        return out + 0.5 * (log_x - log_w) - 0.5 * (self.k - p) * math.log(2 * math.pi)


def _next_tau2(now: _Moments, tau2: float, method: str) -> float | None:
    """The next tau^2 after a scoring step, None when it has settled."""
    if method == "REML":
        move = (now.rwwr - now.tr_p) / now.tr_pp
    elif method == "ML":
        move = (now.rwwr - now.w1) / now.w2
    else:
        return None
    target = max(0.0, tau2 + move)
    return None if abs(target - tau2) <= 1e-12 + 1e-10 * tau2 else target


def _result(
    outcome: str, now: _Moments, tau2: float, rounds: int, q: float, q_df: int, tr_p0: float, method: str, level: float
) -> tuple:
    """Knapp-Hartung intervals and tests, heterogeneity and fit statistics, from
    the moments at the final tau^2 and a summary of those at zero."""
    p, k = now.rank, now.k
    spare = k - p
    if spare <= 0:
        s2, crit = math.nan, math.nan
    else:
        s2 = now.rwr / spare
        crit = float(t_quantile(0.5 + level / 2.0, spare))
    cov = now.inv * s2
    se = np.sqrt(np.diag(cov))
    with np.errstate(all="ignore"):
        t = now.coef / se
        pv = t_two_sided(t, spare) if spare > 0 else np.full_like(t, np.nan)
    mods = np.arange(1, len(now.coef))
    mods = mods[np.isfinite(se[mods])] if len(mods) else mods
    fm = fm_p = None
    if len(mods) and spare > 0 and s2 > 0:
        b = now.coef[mods]
        fm = float(b @ np.linalg.solve(cov[np.ix_(mods, mods)], b) / len(mods))
        fm_p = float(f_upper(fm, len(mods), spare))
    typical = q_df / tr_p0 if tr_p0 > 0 and q_df > 0 else math.nan

    def clean(values):
        return [float(v) if math.isfinite(v) else None for v in values]

    def one(v):
        return None if v is None or not math.isfinite(v) else float(v)

    return (
        outcome, int(k), int(p), float(tau2), float(q), int(q_df),
        one(float(chi2_upper(q, q_df))) if q_df > 0 else None,
        one(max(0.0, (q - q_df) / q)) if q > 0 and q_df > 0 else 0.0,
        one(q / q_df) if q_df > 0 else None,
        one(tau2 / (tau2 + typical)), one(now.loglik(method)), fm,
        len(mods), int(spare), fm_p, clean(now.coef), clean(se), clean(t), clean(pv),
        clean(now.coef - crit * se), clean(now.coef + crit * se), rounds,
    )


def _moment_columns(p: int) -> list[Column]:
    """Aggregates of the studies of one outcome at its tau^2."""
    z = [F.get("x", F.lit(i)) for i in range(p)] + [F.col("yi")]
    total = F.col("vi") + F.col("tau2")
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    out = [
        F.count("*").alias("k"), F.sum(F.ln(total)).alias("log_sum"),
        F.sum(1 / total).alias("w1"), F.sum(1 / (total * total)).alias("w2"),
    ]
    for power in range(4):
        w = F.lit(1.0)
        for _ in range(power):
            w = w / total
        out.append(F.array(*[F.sum(w * z[i] * z[j]) for i, j in pairs]).alias(f"m{power}"))
    return out


# A row per outcome between steps: the tau^2 to look at, and Q, its degrees of
# freedom and a trace at zero once they are known.
_STATE = "tau2 double, rounds int, q double, q_df long, tr_p0 double"
_OPEN = f"outcome string, {_STATE}, done boolean"


def _score_step(p: int, method: str, level: float):
    """The next state of each outcome from its moments; a settled outcome's row
    carries its result."""
    at = np.triu_indices(p + 1)
    names = [part.split(" ")[0] for part in f"{_OPEN}, {_RESULT}".split(", ")]
    # The result repeats the outcome and tau^2 under names of its own.
    names = [n if i < len(_OPEN.split(", ")) else f"r_{n}" for i, n in enumerate(names)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                crosses = []
                for m in (r.m0, r.m1, r.m2, r.m3):
                    full = np.zeros((p + 1, p + 1))
                    full[at] = m
                    crosses.append(full + np.triu(full, 1).T)
                now = _Moments(r.k, r.log_sum, (r.w1, r.w2), crosses)
                tau2, rounds, q, q_df, tr_p0 = r.tau2, r.rounds, r.q, r.q_df, r.tr_p0
                if rounds == 0:
                    # At zero: heterogeneity, and the moment estimate as a start.
                    q, q_df, tr_p0 = now.rwr, now.k - now.rank, now.tr_p
                    start = max(0.0, (q - q_df) / tr_p0) if q_df > 0 and tr_p0 > 0 else 0.0
                    target = start if start > 0 or q_df <= 0 else _next_tau2(now, 0.0, method)
                    target = None if q_df <= 0 else target
                else:
                    target = _next_tau2(now, tau2, method)
                q_df, rounds = int(q_df), int(rounds)
                if target is not None:
                    out.append((r.outcome, target, rounds + 1, q, q_df, tr_p0, False, *[None] * len(_columns())))
                else:
                    done = _result(r.outcome, now, tau2, rounds, q, q_df, tr_p0, method, level)
                    out.append((r.outcome, tau2, rounds, q, q_df, tr_p0, True, *done))
            yield pd.DataFrame(out, columns=names)

    kinds = ", ".join(f"r_{part}" for part in _RESULT.split(", "))
    return rows, f"{_OPEN}, {kinds}"


def random_effects(
    df: DataFrame,
    outcome: str = "outcome",
    moderators: Sequence[str] = (),
    method: str = "REML",
    level: float = 0.95,
) -> DataFrame:
    """Random-effects pooling or meta-regression of every outcome: one row per
    outcome with tau^2, Q, I^2, the moderator test and coefficient arrays
    (intercept first) with Knapp-Hartung errors. `method` is REML, ML or DL; an
    outcome whose tau^2 does not settle is an error."""
    parts = [F.lit(1.0), *[F.col(m).cast("double") for m in moderators]]
    p = len(parts)
    rows = df.select(
        F.col(outcome).cast("string").alias("outcome"),
        F.col("yi").cast("double").alias("yi"),
        F.col("vi").cast("double").alias("vi"),
        F.array(*parts).alias("x"),
    ).where("yi is not null and vi > 0 and outcome is not null and not exists(x, v -> v is null)")
    rows = rows.persist()
    step, schema = _score_step(p, method, level)
    results = [f"r_{c}" for c in _columns()]
    state = rows.select("outcome").distinct().selectExpr(
        "outcome", "0D as tau2", "0 as rounds", "0D as q", "0L as q_df", "0D as tr_p0"
    )
    finished = None
    try:
        for _ in range(_STEPS):
            moments = rows.join(state, "outcome").groupBy("outcome", "tau2", "rounds", "q", "q_df", "tr_p0")
            after = settled(moments.agg(*_moment_columns(p)).mapInPandas(step, schema))
            done = after.where("done").select(results)
            finished = done if finished is None else finished.unionByName(done)
            state = after.where("not done").drop("done", *results)
            if state.isEmpty():
                return finished.toDF(*_columns())
    finally:
        rows.unpersist()
    raise ValueError(f"tau^2 has not settled in {_STEPS} steps")


def _columns() -> list[str]:
    return [part.strip().split(" ")[0] for part in _RESULT.split(", ")]


def coefficient_rows(fits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row per outcome and coefficient."""
    cols = ["estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
    names = F.array(*[F.lit(t) for t in terms])
    zipped = F.arrays_zip(names.alias("term"), *[F.col(c) for c in cols])
    return fits.select("outcome", "k", "tau2", F.explode(zipped).alias("r")).select(
        "outcome", "k", "tau2", F.col("r")["term"].alias("term"), *[f"r.{c}" for c in cols]
    )


def explained(with_mods: DataFrame, without: DataFrame) -> DataFrame:
    """Share of the heterogeneity variance explained by moderators."""
    base = without.select("outcome", F.col("tau2").alias("tau2_none"))
    return with_mods.join(base, "outcome").withColumn(
        "r2",
        F.when(
            F.col("tau2_none") > 0,
            F.greatest(F.lit(0.0), 1 - F.col("tau2") / F.col("tau2_none")),
        ).otherwise(0.0),
    )


def likelihood_ratio(small: DataFrame, large: DataFrame) -> DataFrame:
    """Likelihood-ratio test of nested ML fits per outcome, with AIC and BIC.
    One more parameter than coefficients: tau^2. Fits on different studies are
    not nested: such an outcome keeps its row, with null test values.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        free = F.col("p") + 1
        return df.select(
            "outcome",
            F.col("k").alias(f"k_{tag}"),
            free.alias(f"df_{tag}"),
            F.col("loglik").alias(f"loglik_{tag}"),
            (-2 * F.col("loglik") + 2 * free).alias(f"aic_{tag}"),
            (-2 * F.col("loglik") + F.ln("k") * free).alias(f"bic_{tag}"),
        )

    from lagloom.functions.tails import chi2_p

    out = side(small, "small").join(side(large, "large"), "outcome")
    stat = F.greatest(F.lit(0.0), 2 * (F.col("loglik_large") - F.col("loglik_small")))
    stat = F.when(F.col("k_small") == F.col("k_large"), stat)
    out = out.withColumn("lrt", stat).withColumn(
        "lrt_df", F.col("df_large") - F.col("df_small")
    )
    return out.withColumn("lrt_p", chi2_p(F.col("lrt"), F.col("lrt_df")))


def bubble_rows(
    df: DataFrame, fits: DataFrame, moderator: str, outcome: str = "outcome"
) -> DataFrame:
    """Studies with their weight share and fitted value for one moderator."""
    lines = fits.select(
        F.col("outcome").alias("_o"), "tau2",
        F.get("estimate", F.lit(0)).alias("_a"), F.get("estimate", F.lit(1)).alias("_b"),
    )
    rows = df.where("yi is not null and vi > 0").join(
        lines, F.col(outcome).cast("string") == F.col("_o")
    )
    rows = rows.withColumn("weight", 1 / (F.col("vi") + F.col("tau2")))
    # The total is a grouped sum, not a window over the studies of an outcome.
    total = rows.groupBy("_o").agg(F.sum("weight").alias("_total")).withColumnRenamed("_o", "_t")
    fitted: Column = F.col("_a") + F.col("_b") * F.col(moderator)
    return (
        rows.join(total, F.col("_o") == F.col("_t"))
        .withColumns({"fitted": fitted, "weight_pct": 100 * F.col("weight") / F.col("_total")})
        .drop("_o", "_t", "_total", "_a", "_b")
    )


def bubble_line(
    df: DataFrame, fits: DataFrame, moderator: str, points: int = 20, outcome: str = "outcome"
) -> DataFrame:
    """Fitted line of each outcome on a grid over its moderator range."""
    span = df.where("yi is not null and vi > 0").groupBy(
        F.col(outcome).cast("string").alias("outcome")
    ).agg(F.min(moderator).alias("_lo"), F.max(moderator).alias("_hi"))
    lines = fits.select(
        "outcome", F.get("estimate", F.lit(0)).alias("_a"), F.get("estimate", F.lit(1)).alias("_b")
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    return (
        span.join(lines, "outcome")
        .withColumn("_i", at)
        .withColumn(moderator, F.expr(f"_lo + _i * (_hi - _lo) / {points - 1}"))
        .select("outcome", moderator, (F.col("_a") + F.col("_b") * F.col(moderator)).alias("fitted"))
    )



"""Proportional hazards models by sums over (stratum, time).

One Newton step is two aggregates over the design. The first sums exp(eta) and
x exp(eta) per stratum and time; running sums over those time-level rows give
the risk sets. The second is one weighted cross product of the rows: swapping
the order of summation, each row enters with the baseline hazard it has lived
through, so no p x p matrix is kept per time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import normal_p, normal_quantile
from lagloom.models.fitted import Fitted
from lagloom.models.moments import (
    grouped_sums,
    keep,
    pack,
    solve_information,
    sum_vectors,
    unpack,
    whole,
)
from lagloom.operators.scans import running_sums
from lagloom.session import settled


def cox_design(
    df: DataFrame,
    exit: str,
    event: str,
    parts: Sequence[Column],
    model: Column | None = None,
    stratum: Column | None = None,
    entry: str | None = None,
    count: str | None = None,
) -> DataFrame:
    """Rows as (model, stratum, entry, exit, event, n, x); `parts` are array
    columns, joined to one array. A row stands for `count` persons, of which
    `event` have the event at `exit`. Rows whose array is missing or has a
    missing element are left out by the fit."""
    rows = df.select(
        (model if model is not None else F.lit("model")).alias("model"),
        (stratum if stratum is not None else F.lit("")).cast("string").alias("stratum"),
        (F.col(entry) if entry else F.lit(None)).cast("double").alias("entry"),
        F.col(exit).cast("double").alias("exit"),
        F.col(event).cast("double").alias("event"),
        (F.col(count) if count else F.lit(1)).cast("double").alias("n"),
        F.concat(*parts).alias("x"),
    )
    return rows.where(
        F.col("exit").isNotNull()
        & F.col("event").isNotNull()
        & F.col("stratum").isNotNull()
        & (F.col("entry").isNotNull() if entry else F.lit(True))
        & (F.col("entry").isNull() | (F.col("entry") < F.col("exit")))
    )


def _tied_sums_sql() -> dict[str, str]:
    """Sums over tied events r = 0..d-1 of c = 1/(s0 - r b), with b = d0/d and
    q = s0/b: sums of 1/u, 1/u^2 and ln u over u = q, q-1, ..., q-d+1 are
    differences of the digamma, trigamma and log-gamma functions. Their
    asymptotic series after a shift of ten keeps the cost independent of d, so
    a month with a billion tied events costs as much as one."""
    z1, z2 = "(_q + 1)", "greatest(_q - d + 1, 1D)"
    y1, y2 = "(_q + 11)", f"({z2} + 10)"

    def series(y: str, terms: list[tuple[str, int]]) -> str:
        return "(" + " + ".join(f"{c} / pow({y}, {k})" for c, k in terms) + ")"

    a = [("-1D/2", 1), ("-1D/12", 2), ("1D/120", 4), ("-1D/252", 6), ("1D/240", 8),
         ("-1D/132", 10)]
    b = [("1D/2", 2), ("1D/6", 3), ("-1D/30", 5), ("1D/42", 7), ("-1D/30", 9), ("5D/66", 11)]
    g = [("1D/12", 1), ("-1D/360", 3), ("1D/1260", 5), ("-1D/1680", 7), ("1D/1188", 9)]
    ratio = f"(-log1p(-d / {y1}))"
    steps = range(10)
    h1 = f"{ratio} + {series(y1, a)} - {series(y2, a)} + " + " + ".join(
        f"d / (({z1} + {k}) * ({z2} + {k}))" for k in steps
    )
    h2 = f"d / ({y1} * {y2}) + {series(y2, b)} - {series(y1, b)} + " + " + ".join(
        f"(1 / pow({z2} + {k}, 2) - 1 / pow({z1} + {k}, 2))" for k in steps
    )
    ln = (
        f"d * ln({y1}) + ({y2} - 0.5D) * {ratio} - d + {series(y1, g)} - {series(y2, g)} - ("
        + " + ".join(f"log1p(d / ({z2} + {k}))" for k in steps)
        + ")"
    )
    return {"_h1": h1, "_h2": h2, "_lu": ln}


def _arrays(prefix: str, p: int) -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(p)])


def _time_table(
    rows: DataFrame, p: int, ties: str, entry: bool, bucket_width: float | None
) -> DataFrame:
    """Time-level rows: risk sums, tied-event sums and the running baseline."""
    x = [F.get("x", F.lit(i)) for i in range(p)]
    w, e, n = F.col("w"), F.col("event"), F.col("n")
    cells = rows.groupBy("model", "stratum", F.col("exit").alias("time")).agg(
        F.sum(n * w).alias("m0"),
        *[F.sum(n * w * xi).alias(f"m1_{i}") for i, xi in enumerate(x)],
        F.sum(e).alias("d"),
        F.sum(e * w).alias("d0"),
        *[F.sum(e * w * xi).alias(f"d1_{i}") for i, xi in enumerate(x)],
        *[F.sum(e * xi).alias(f"ex_{i}") for i, xi in enumerate(x)],
        F.sum(e * F.col("eta")).alias("ee"),
    )
    if entry:
        late = (
            rows.where(F.col("entry").isNotNull())
            .groupBy("model", "stratum", F.col("entry").alias("time"))
            .agg(
                (-F.sum(n * w)).alias("m0"),
                *[(-F.sum(n * w * xi)).alias(f"m1_{i}") for i, xi in enumerate(x)],
            )
        )
        sums = [c for c in cells.columns if c not in {"model", "stratum", "time"}]
        cells = (
            cells.unionByName(late, allowMissingColumns=True)
            .groupBy("model", "stratum", "time")
            .agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in sums])
        )
    bucket = None if bucket_width is None else F.floor(F.col("time") / bucket_width)
    keys = ["model", "stratum"]
    risk = running_sums(
        cells, keys, "time",
        {"s0": "m0", **{f"s1_{i}": f"m1_{i}" for i in range(p)}},
        bucket, reverse=True,
    )
    risk = risk.select(
        "model", "stratum", "time", "d", "s0", "d0", "ee",
        _arrays("s1_", p).alias("s1"), _arrays("d1_", p).alias("d1"),
        _arrays("ex_", p).alias("ex"),
    )
    if ties == "efron":
        risk = risk.withColumns({
                "_b": F.expr("case when d > 0 then d0 / d end"),
                "_q": F.expr("case when d > 0 then s0 * d / d0 end"),
            }
        )
        risk = risk.withColumns({k: F.expr(v) for k, v in _tied_sums_sql().items()})
        sums = {
            "c": "_h1 / _b",
            "rc": "(_q * _h1 - d) / (_b * d)",
            "q0": "_h2 / (_b * _b)",
            "q1": "(_q * _h2 - _h1) / (_b * _b * d)",
            "q2": "(_q * _q * _h2 - 2 * _q * _h1 + d) / (_b * _b * d * d)",
            "ln_risk": "d * ln(_b) + _lu",
        }
        single = {
            "c": "1 / s0", "rc": "0D", "q0": "1 / (s0 * s0)", "q1": "0D", "q2": "0D",
            "ln_risk": "ln(s0)",
        }
        risk = risk.withColumns(
            {
                k: F.expr(
                    f"case when d = 0 then 0D when d = 1 then {single[k]} else {v} end"
                )
                for k, v in sums.items()
            }
        ).drop("_b", "_q", "_h1", "_h2", "_lu")
    elif ties == "breslow":
        risk = risk.withColumns(
            {
                "c": F.expr("case when d = 0 then 0D else d / s0 end"),
                "rc": F.lit(0.0),
                "q0": F.expr("case when d = 0 then 0D else d / (s0 * s0) end"),
                "q1": F.lit(0.0),
                "q2": F.lit(0.0),
                "ln_risk": F.expr("case when d = 0 then 0D else d * ln(s0) end"),
            }
        )
    else:
        raise ValueError("ties must be 'efron' or 'breslow'")
    return running_sums(risk, keys, "time", {"lived": "c"}, bucket)


def _at(rows: DataFrame, p: int) -> DataFrame:
    """Rows with coefficients `_b` and centres `_c`: x about the centre, the
    linear predictor and its exponential."""
    moved = [f"x[{i}] - _c[{i}]" for i in range(p)]
    rows = rows.withColumn("x", F.expr(f"array({', '.join(moved)})"))
    rows = rows.withColumn("eta", F.expr(" + ".join(f"x[{i}] * _b[{i}]" for i in range(p))))
    return rows.withColumn("w", F.exp("eta")).drop("_b", "_c")


def _events_of(times: DataFrame) -> DataFrame:
    return times.where("d > 0").select(
        "model", "s1", "d1", "ex", "c", "rc", "q0", "q1", "q2", "ln_risk", "ee", "d"
    )


def _level_sums(_: str, c: dict[str, np.ndarray]) -> np.ndarray:
    s, e = c["s1"], c["d1"]
    score = c["ex"].sum(0) - c["c"] @ s + c["rc"] @ e
    cross = (s * c["q1"][:, None]).T @ e
    spread = (s * c["q0"][:, None]).T @ s - cross - cross.T
    spread += (e * c["q2"][:, None]).T @ e
    return pack(score, spread, np.sum(c["ee"] - c["ln_risk"]), c["d"].sum())


def _row_sums(_: str, c: dict[str, np.ndarray]) -> np.ndarray:
    x = c["x"]
    return pack((x * (c["w"] * c["h"])[:, None]).T @ x)


def _weighted_rows(rows: DataFrame, times: DataFrame, entry: bool) -> DataFrame:
    """Rows with the baseline hazard they have lived through."""
    marks = times.select(
        F.col("model").alias("_m"), F.col("stratum").alias("_s"),
        F.col("time").alias("_t"), "lived", "rc",
    )
    on = (F.col("model") == F.col("_m")) & (F.col("stratum") == F.col("_s"))
    weighted = rows.join(marks, on & (F.col("exit") == F.col("_t"))).select(
        "model", "stratum", "entry", "x", "w", "n",
        (F.col("n") * F.col("lived") - F.col("event") * F.col("rc")).alias("h"),
    )
    if entry:
        start = marks.withColumnRenamed("lived", "_lived0").drop("rc")
        weighted = weighted.join(
            start, on & (F.col("entry") == F.col("_t")), "left"
        ).withColumn("h", F.col("h") - F.col("n") * F.coalesce("_lived0", F.lit(0.0)))
    return weighted.select("model", "x", "w", "h")


def cox_step(
    design: DataFrame,
    betas: dict[str, np.ndarray],
    centre: dict[str, np.ndarray],
    ties: str = "efron",
    entry: bool = False,
    bucket_width: float | None = None,
) -> dict[str, tuple[float, np.ndarray, np.ndarray, int]]:
    """Log likelihood, score, information and number of events of every model
    at its coefficients. All models of one call share the width of `x`."""
    spark = design.sparkSession
    p = len(next(iter(betas.values())))
    table = spark.createDataFrame(
        [
            (m, [float(v) for v in b], [float(v) for v in centre[m]])
            for m, b in betas.items()
        ],
        "model string, _b array<double>, _c array<double>",
    )
    # One row per model of the specification.
    rows = _at(design.where(whole("x")).join(F.broadcast(table), "model"), p)
    times = _time_table(rows, p, ties, entry, bucket_width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        level = sum_vectors(_events_of(times), _level_sums)
        second = sum_vectors(_weighted_rows(rows, times, entry), _row_sums)
    finally:
        times.unpersist()
    out = {}
    for m in betas:
        if m not in level:
            continue
        score, spread, loglik, d = unpack(level[m], (p,), (p, p), (), ())
        info = second[m].reshape(p, p) - spread
        out[m] = (loglik, score, info, int(round(d)))
    return out


def fit_cox(
    design: DataFrame,
    labels: dict[str, list[str]],
    ties: str = "efron",
    entry: bool = False,
    bucket_width: float | None = None,
    tol: float = 1e-10,
    max_iter: int = 30,
) -> dict[str, Fitted]:
    """Fit all models of a design together, each Newton step in one pass.

    `labels` names the columns of each model. Models narrower than the widest
    are padded with zero columns, which drop out of their solution. Give
    `bucket_width` when time is continuous (see `running_sums`)."""
    width = {m: len(v) for m, v in labels.items()}
    p = max(width.values())
    short = any(w < p for w in width.values())
    if short:
        design = design.withColumn("x", F.expr(f"concat(x, array_repeat(0D, {p} - size(x)))"))
    padded = keep(design)
    try:
        sizes = sum_vectors(
            padded.where(whole("x")).select("model", "x", "event", "n"),
            lambda _, c: pack(c["n"] @ c["x"], c["n"].sum(), c["event"].sum()),
        )
        count = {m: int(v[p]) for m, v in sizes.items()}
        lost_rows = padded.where(F.col("model").isin(list(labels)) & ~F.coalesce(whole("x"), F.lit(False)))
        dropped = {r["model"]: int(r["n"]) for r in lost_rows.groupBy("model").agg(F.sum("n").alias("n")).collect()}
        deaths = {m: int(v[p + 1]) for m, v in sizes.items()}
        lost = sorted(set(labels) - {m for m, d in deaths.items() if d > 0})
        if lost:
            raise ValueError(f"no events among the complete rows of: {lost}")
        centre = {m: sizes[m][:p] / count[m] for m in labels}
        current = {m: np.zeros(p) for m in labels}
        trial = dict(current)
        best: dict[str, tuple] = {}
        moves: dict[str, np.ndarray] = {}
        done: dict[str, Fitted] = {}
        for iteration in range(max_iter):
            active = {m: b for m, b in trial.items() if m not in done}
            found = cox_step(padded, active, centre, ties, entry, bucket_width)
            for m in active:
                loglik, score, info, _ = found[m]
                old = best.get(m)
                worse = old is not None and not loglik >= old[0] - tol * abs(old[0])
                if worse:
                    moves[m] = moves[m] / 2.0
                    trial[m] = current[m] + moves[m]
                    continue
                current[m] = trial[m]
                sol, inv = solve_information(info, score)
                # Half the Newton decrement is the gain the next step would bring.
                settled = 0.5 * float(score @ sol) <= tol * (abs(loglik) + 1e-3)
                best[m] = (loglik, score, info)
                if settled:
                    current[m] = current[m] + sol
                if settled:
                    k = width[m]
                    done[m] = Fitted(
                        m, labels[m], current[m][:k], inv[:k, :k], count[m], loglik,
                        n_event=deaths[m], iterations=iteration, n_dropped=dropped.get(m, 0),
                    )
                else:
                    moves[m] = sol
                    trial[m] = current[m] + sol
            if len(done) == len(labels):
                break
    finally:
        padded.unpersist()
    if len(done) < len(labels):
        raise ValueError(f"no convergence in {max_iter} steps: {sorted(set(labels) - set(done))}")
    return done


# --- any number of models ---------------------------------------------------------

_FIT = (
    "model string, n double, n_event double, _c array<double>, beta array<double>, tried array<double>, "
    "loglik double, cov array<double>, iterations int, converged boolean"
)


def _newton(p: int, tol: float):
    """Next state of each model from its sums at the tried coefficients."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                score, spread, loglik, _ = unpack(np.asarray(r.level), (p,), (p, p), (), ())
                beta, tried = np.asarray(r.beta), np.asarray(r.tried)
                row = [r.model, r.n, r.n_event, r.c_]
                if np.isfinite(r.loglik) and not loglik >= r.loglik - 1e-10 * abs(r.loglik):
                    # Not better: half the step.
                    out.append([*row, beta, (beta + tried) / 2, r.loglik, r.cov, r.iterations + 1, False])
                    continue
                move, inv = solve_information(np.asarray(r.second).reshape(p, p) - spread, score)
                # Half the Newton decrement is the gain the next step would bring.
                done = 0.5 * float(score @ move) <= tol * (abs(loglik) + 1e-3)
                now = tried + move if done else tried
                out.append([*row, now, tried + move, loglik, inv.ravel(), r.iterations + 1, bool(done)])
            names = [part.split(" ")[0] for part in _FIT.split(", ")]
            yield pd.DataFrame(out, columns=names)

    return rows


def fit_cox_models(
    design: DataFrame,
    p: int,
    ties: str = "efron",
    entry: bool = False,
    bucket_width: float | None = None,
    tol: float = 1e-14,
    max_iter: int = 40,
) -> DataFrame:
    """Fits of all models in the rows of a design, as a table: model, n,
    n_event, loglik, beta (array of p), cov (p x p, row by row, NaN for aliased
    columns), iterations, converged.

    Coefficients are a table keyed by model that every step joins to the rows;
    sums are added up and solved by key, so the number of models may grow with
    the data and nothing but the number of open models reaches the driver. `x`
    of models with fewer columns is filled with zeros. Models without an event
    have no row. A fit that does not settle is an error."""
    rows = design.withColumn("x", F.expr(f"concat(x, array_repeat(0D, {p} - size(x)))"))
    rows = keep(rows).where(whole("x"))
    sums = grouped_sums(
        rows.select("model", "x", "event", "n"),
        lambda _, c: pack(c["n"] @ c["x"], c["n"].sum(), c["event"].sum()),
    )
    zero = F.array_repeat(F.lit(0.0), p)
    state = settled(
        sums.where(F.get("vec", F.lit(p + 1)) > 0).select(
            "model",
            F.get("vec", F.lit(p)).alias("n"),
            F.get("vec", F.lit(p + 1)).alias("n_event"),
            F.expr(f"transform(slice(vec, 1, {p}), v -> v / vec[{p}])").alias("_c"),
            zero.alias("beta"),
            zero.alias("tried"),
            F.lit(float("-inf")).alias("loglik"),
            F.array_repeat(F.lit(0.0), p * p).alias("cov"),
            F.lit(0).alias("iterations"),
            F.lit(False).alias("converged"),
        )
    )
    for _ in range(max_iter):
        open_ = state.where("not converged")
        if open_.isEmpty():
            break
        at = _at(rows.join(open_.select("model", F.col("tried").alias("_b"), "_c"), "model"), p)
        times = _time_table(at, p, ties, entry, bucket_width).persist(StorageLevel.MEMORY_AND_DISK)
        found = grouped_sums(_events_of(times), _level_sums, "level").join(
            grouped_sums(_weighted_rows(at, times, entry), _row_sums, "second"), "model"
        )
        moved = open_.join(found, "model").withColumnRenamed("_c", "c_").mapInPandas(_newton(p, tol), _FIT)
        state = settled(moved.unionByName(state.where("converged")))
        times.unpersist()
    else:
        left = [r["model"] for r in state.where("not converged").select("model").limit(5).collect()]
        raise ValueError(f"no convergence in {max_iter} steps, among others: {left}")
    return state.drop("_c", "tried")


def model_coefficients(fits: DataFrame, terms: DataFrame, level: float = 0.95) -> DataFrame:
    """Coefficient table of `fit_cox_models` for the terms (model, place, term):
    estimate, error, statistic, p value and interval, also on the ratio scale.
    Aliased terms have null values."""
    half = normal_quantile(0.5 + level / 2.0)
    rows = fits.join(terms, "model").withColumn("_v", F.expr("cov[place * size(beta) + place]"))
    known = ~F.isnan("_v")
    rows = rows.select(
        "model", "place", "term",
        F.when(known, F.expr("beta[place]")).alias("estimate"),
        F.when(known, F.sqrt("_v")).alias("std_error"),
        F.col("n").cast("long").alias("n"), F.col("n_event").cast("long").alias("n_event"),
        "loglik", "converged",
    )
    rows = rows.withColumn("statistic", F.col("estimate") / F.col("std_error"))
    rows = rows.withColumns(
        {
            "p_value": normal_p(F.col("statistic")),
            "conf_low": F.col("estimate") - half * F.col("std_error"),
            "conf_high": F.col("estimate") + half * F.col("std_error"),
        }
    )
    return rows.withColumns(
        {"exp_estimate": F.exp("estimate"), "exp_low": F.exp("conf_low"), "exp_high": F.exp("conf_high")}
    )

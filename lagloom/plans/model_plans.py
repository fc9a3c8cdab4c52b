"""Regressions: moments, counts, distributed lags, survival, quantiles, matched
sets and smooth trends."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import functions as F

from lagloom.functions import dates, factors
from lagloom.functions.transforms import log_spaced_lags
from lagloom.models import predict
from lagloom.models.basis import BasisSpec, basis_table, build_basis, fit_basis, lag_basis, strata
from lagloom.models.cox import cox_design, cox_step, fit_cox, fit_cox_models, model_coefficients
from lagloom.models.crossbasis import CrossBasis, crossbasis, histories_by_table, history_cells
from lagloom.models.fitted import tidy
from lagloom.models.glm import GlmSpec, Term, fit_glm, wls_line
from lagloom.models.matched import clogit_design, fit_clogit
from lagloom.models.moments import gram_sql
from lagloom.models.quantile import fit_quantile
from lagloom.operators import exposure
from lagloom.operators.scans import exact_percentiles
from lagloom.plans import fixtures as fx
from lagloom.plans.cohort_plans import histories
from lagloom.plans.exposure_plans import births_with_window
from lagloom.plans.registry import analysis, rounded
from lagloom.plans.sql_text import BIRTHS, DAILY, SUBJECT, floor_week, newton_one_sql
from lagloom.session import settled

# --- moments ------------------------------------------------------------------

_GRAM = ["one", "l_quantity", "l_discount", "l_tax"]


@analysis(
    "with l as (select *, 1.0::double as one from lineitem) "
    + " union all ".join(
        f"select l_returnflag, '{a}' as a, '{b}' as b, round(sum({a} * {b}), 3) as value "
        "from l group by 1"
        for i, a in enumerate(_GRAM)
        for b in _GRAM[i:]
    )
)
def gram_small(spark, folder):
    rows = fx.table(spark, folder, "lineitem").withColumn("one", F.lit(1.0))
    out = gram_sql(rows, _GRAM, ["l_returnflag"])
    return out.withColumn("value", rounded("value", 3))


@analysis(
    f"""with {BIRTHS}, s as (select area, price as y, ga as x, 1 + discount as w from births),
    m as (select area, count(*) as n, sum(w) as sw, sum(w * x) / sum(w) as mx,
          sum(w * y) / sum(w) as my from s group by 1),
    c as (select s.area, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) as slope
          from s join m on m.area = s.area group by 1)
    select m.area, n, round(slope, 5) as slope, round(my - slope * mx, 5) as intercept
    from m join c on c.area = m.area""",
    name="wls_line",
)
def wls_by_area(spark, folder):
    rows = fx.births(spark, folder).withColumn("w", 1 + F.col("discount"))
    out = wls_line(rows, ["area"], "ga", "price", "w")
    return out.select("area", "n", rounded("slope", 5).alias("slope"),
                      rounded("intercept", 5).alias("intercept"))


# --- counts ---------------------------------------------------------------------

_DAYS = [str(i) for i in range(1, 8)]


def _weekday(df):
    cols = factors.indicators(F.col("dow").cast("string"), _DAYS)
    return df.withColumn("dow_code", F.array(*cols))


_DOW = Term("dow", "dow_code", tuple(f"dow{d}" for d in _DAYS[1:]))


def _tidy_columns(out):
    nums = ["estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
    nums += ["exp_estimate", "exp_low", "exp_high"]
    about = [c for c in ("n", "n_dropped", "converged") if c in out.columns]
    return out.select("model", "term", *[rounded(c, 6).alias(c) for c in nums], *about)


@analysis(
    f"""with {DAILY}, g as (select dow, sum(y)::double as s, count(*) as n from daily group by 1),
    b as (select s / n as m, s from g where dow = 1), t as (select sum(n)::bigint as n from g)
    select 'intercept' as term, round(ln(b.m), 6) as estimate,
      round(sqrt(1 / b.s), 6) as std_error, t.n from b, t
    union all
    select 'dow' || g.dow, round(ln(g.s / g.n) - ln(b.m), 6),
      round(sqrt(1 / g.s + 1 / b.s), 6), t.n from g, b, t where g.dow > 1"""
)
def poisson_one_factor(spark, folder):
    rows = _weekday(fx.daily(spark, folder))
    fit = fit_glm(rows, GlmSpec("y", "poisson", (_DOW,)))
    return _tidy_columns(tidy(spark, [fit])).select("term", "estimate", "std_error", "n")


@analysis(
    f"""with {BIRTHS}, s as (select case when ga < 37 then 1 else 0 end as y, sex from eligible),
    g as (select sex, sum(y)::double as a, count(*)::double as n from s group by 1)
    select 'intercept' as term, round(ln(a / (n - a)), 6) as estimate,
      round(sqrt(1 / a + 1 / (n - a)), 6) as std_error from g where sex = 'F'
    union all
    select 'sexO', round(ln(o.a / (o.n - o.a)) - ln(f.a / (f.n - f.a)), 6),
      round(sqrt(1 / o.a + 1 / (o.n - o.a) + 1 / f.a + 1 / (f.n - f.a)), 6)
    from g o, g f where o.sex = 'O' and f.sex = 'F'"""
)
def binomial_one_factor(spark, folder):
    rows = fx.eligible_births(spark, folder).withColumns(
        {"y": (F.col("ga") < 37).cast("double"), "o": (F.col("sex") == "O").cast("double")}
    )
    fit = fit_glm(rows, GlmSpec("y", "binomial", (Term("sex", "o", ("sexO",), array=False),)))
    return _tidy_columns(tidy(spark, [fit])).select("term", "estimate", "std_error")


@analysis(
    f"""with {BIRTHS}, s as (select count(*)::double as n, regr_slope(price, ga) as b,
      regr_intercept(price, ga) as a, regr_sxx(price, ga) as sxx, regr_syy(price, ga) as syy,
      avg(ga) as mx from births),
    v as (select *, (syy - b * b * sxx) / (n - 2) as s2 from s)
    select 'intercept' as term, round(a, 4) as estimate,
      round(sqrt(s2 * (1 / n + mx * mx / sxx)), 4) as std_error from v
    union all select 'ga', round(b, 4), round(sqrt(s2 / sxx), 4) from v"""
)
def gaussian_line(spark, folder):
    fit = fit_glm(
        fx.births(spark, folder),
        GlmSpec("price", "gaussian", (Term("ga", "ga", ("ga",), array=False),)),
    )
    out = tidy(spark, [fit])
    return out.select("term", rounded("estimate", 4).alias("estimate"),
                      rounded("std_error", 4).alias("std_error"))


# --- distributed lags on the daily series -----------------------------------------

# Lags of both exposures in days, the centile of the second that is
# its threshold and its lag strata, and the centre of the first.
_TEMP_LAG, _OZONE_LAG = 30, 10
_THRESHOLD_AT, _STRATA, _CENTRE = 0.75, (2, 6), 25.0


class _DailyModel:
    """Daily counts on lagged x (spline) and z (threshold), season and weekday.

    Use as a context: the daily series is kept in memory inside it."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.base = _weekday(fx.daily(spark, folder)).persist(StorageLevel.MEMORY_AND_DISK)
        base = self.base
        self.lags = BasisSpec("ns", knots=tuple(log_spaced_lags(_TEMP_LAG, 3)))
        self.x = crossbasis(
            base, "x", _TEMP_LAG, BasisSpec("bs", df=6, degree=3), self.lags, "x"
        )
        ends = exact_percentiles(base, [], "z", {"low": 0.0, "cut": _THRESHOLD_AT, "high": 1.0}).first()
        self.threshold, self.z_range = ends.cut, (ends.low, ends.high)
        self.z = crossbasis(
            base, "z", _OZONE_LAG, BasisSpec("thr", at=(self.threshold,), side="h"),
            BasisSpec("strata", breaks=_STRATA), "z",
        )
        ends = base.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
        # Percentiles of a complete index are equally spaced.
        df = 7 * max(1, round((ends.b - ends.a) / 365.25))
        knots = tuple(ends.a + (ends.b - ends.a) * i / df for i in range(1, df))
        spec = BasisSpec("ns", knots=knots, boundary=(float(ends.a), float(ends.b)))
        season = build_basis(spec, ends.a, ends.b, knots)
        rows = self.x.on_series(base, "time", "x", out="cb_x")
        rows = self.z.on_series(rows, "time", "z", out="cb_z")
        self.rows = rows.withColumn("season", season.column("time"))
        self.terms = {
            "x": Term("x", "cb_x", tuple(self.x.terms)),
            "z": Term("z", "cb_z", tuple(self.z.terms)),
            "season": Term(
                "season", "season", tuple(f"season{i + 1}" for i in range(season.width))
            ),
            "dow": _DOW,
        }
        self.spec = GlmSpec("y", "quasipoisson", tuple(self.terms.values()), name="spline")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.base.unpersist()

    def fit(self):
        return fit_glm(self.rows, self.spec)

    def grid(self, by=2.0):
        return predict.exposure_grid(self.x.var, by)


def _effect_columns(out, *extra):
    nums = ["fit", "se", "rr", "rr_low", "rr_high"]
    return out.select("model", "at", *extra, *[rounded(c, 6).alias(c) for c in nums], "cen")


@analysis()
def dlnm_poisson(spark, folder):
    with _DailyModel(spark, folder) as m:
        return _tidy_columns(tidy(spark, [m.fit()]))


@analysis()
def dlnm_overall(spark, folder):
    with _DailyModel(spark, folder) as m:
        fit = m.fit()
        x = predict.overall_effects(spark, m.x, fit, m.grid(), cen=_CENTRE)
        low, high = m.z_range
        at = [low + (high - low) * i / 40 for i in range(41)]
        z = predict.overall_effects(spark, m.z, fit, [*at, m.threshold])
        return _effect_columns(
            x.withColumn("exposure", F.lit("x")).unionByName(z.withColumn("exposure", F.lit("z"))),
            "exposure",
        ).withColumn("at", rounded("at"))


@analysis()
def dlnm_slice(spark, folder):
    with _DailyModel(spark, folder) as m:
        out = predict.lag_effects(
            spark, m.x, m.fit(), [10.0, 20.0, 32.0], cen=_CENTRE, level=0.99
        )
        title = F.concat_ws(" ", F.lit("Exposure ="), F.col("at").cast("int").cast("string"))
        return _effect_columns(out.withColumn("label", title), "lag", "label")


@analysis()
def dlnm_at_lags(spark, folder):
    with _DailyModel(spark, folder) as m:
        out = predict.lag_effects(spark, m.x, m.fit(), m.grid(), lags=[0, 5, 20], cen=_CENTRE)
        return _effect_columns(out, "lag")


@analysis()
def dlnm_surface(spark, folder):
    with _DailyModel(spark, folder) as m:
        return _effect_columns(predict.lag_effects(spark, m.x, m.fit(), m.grid(), cen=_CENTRE), "lag")


@analysis()
def dlnm_cumulative(spark, folder):
    with _DailyModel(spark, folder) as m:
        out = predict.cumulative_effects(spark, m.x, m.fit(), m.grid(5.0), cen=_CENTRE)
        return _effect_columns(out, "lag")


@analysis()
def dlnm_compare(spark, folder):
    """Three exposure bases in the same model: overall effects (lag null) and
    effects of one exposure by lag, stacked."""

    def effects(cb, fit, cen):
        total = predict.overall_effects(spark, cb, fit, m.grid(), cen=cen)
        by_lag = predict.lag_effects(spark, cb, fit, [_CENTRE + 7.0], cen=cen)
        return total.withColumn("lag", F.lit(None).cast("int")).unionByName(
            by_lag.withColumn("lag", F.col("lag").cast("int"))
        )

    with _DailyModel(spark, folder) as m:
        rows = m.rows
        out = effects(m.x, m.fit(), _CENTRE)
        for name, spec, cen in (
            # Powers of a narrow exposure far from zero are collinear to double precision.
            ("polynomial", BasisSpec("cheb", degree=6), _CENTRE),
            ("double threshold", BasisSpec("thr", at=(_CENTRE,), side="d"), None),
        ):
            cb = crossbasis(rows, "x", _TEMP_LAG, spec, m.lags, "alt")
            other = cb.on_series(rows, "time", "x", out="cb_alt")
            changed = m.spec.update(
                drop=("x",), add=(Term("alt", "cb_alt", tuple(cb.terms)),), name=name
            )
            fit = fit_glm(other, changed)
            out = out.unionByName(effects(cb, fit, cen))
        return _effect_columns(out, "lag")


@analysis()
def dlnm_score_rows(spark, folder):
    with _DailyModel(spark, folder) as m:
        scored = predict.score_rows(m.rows, m.x, m.fit(), "cb_x", cen=_CENTRE)
        return scored.where("cb_x is not null").select(
            dates.iso("day").alias("day"), rounded("log_effect", 6).alias("log_effect")
        )


@analysis(
    f"""with {DAILY},
    lagged as (
      select a.time, a.y,
        sum(case when k < 2 then b.x end) as s1, sum(case when k >= 2 then b.x end) as s2
      from daily a join range(6) t(k) on true join daily b on b.time = a.time - k
      group by 1, 2 having count(b.x) = 6),
    m as (select count(*)::double as n, avg(y) as my, avg(s1) as m1, avg(s2) as m2 from lagged),
    s as (select sum((s1 - m1) * (s1 - m1)) as a11, sum((s1 - m1) * (s2 - m2)) as a12,
            sum((s2 - m2) * (s2 - m2)) as a22, sum((s1 - m1) * (y - my)) as c1,
            sum((s2 - m2) * (y - my)) as c2 from lagged, m),
    b as (select (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) as b1,
            (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) as b2 from s)
    select round(b1, 8) as lag_0_1, round(b2, 8) as lag_2_5, round(2 * b1 + 4 * b2, 8) as overall,
      (select count(*) from lagged) as n_kept, (select count(*) from daily) - (select count(*) from lagged) as n_dropped
    from b"""
)
def dlm_gaussian(spark, folder):
    """A linear distributed lag with two lag strata; the overall effect of one
    unit is the sum of its lag coefficients."""
    base = fx.daily(spark, folder)
    cb = CrossBasis(fit_basis(base, "x", BasisSpec("lin")), strata([2], intercept=True), 5)
    rows = cb.on_series(base, "time", "x")
    fit = fit_glm(rows, GlmSpec("y", "gaussian", (Term("x", "cb", tuple(cb.terms)),)))
    overall = predict.overall_effects(spark, cb, fit, [1.0])
    return overall.select(
        rounded(F.lit(float(fit.coef[1])), 8).alias("lag_0_1"),
        rounded(F.lit(float(fit.coef[2])), 8).alias("lag_2_5"),
        rounded("fit", 8).alias("overall"),
        F.lit(fit.n).cast("long").alias("n_kept"),
        F.lit(fit.n_dropped).cast("long").alias("n_dropped"),
    )


# --- survival ---------------------------------------------------------------------

_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@analysis(
    f"""with {SUBJECT},
    cells as (select region as g, n_periods as time, count(*) as m, sum(event) as d
              from subject group by 1, 2),
    ng as (select a.g, t.time, sum(case when a.time >= t.time then a.m else 0 end)::double as n,
             sum(case when a.time = t.time then a.d else 0 end)::double as d
           from cells a cross join (select distinct time from cells) t group by 1, 2),
    tot as (select time, sum(n) as n, sum(d) as d from ng group by 1)
    select ng.g as term, round(sum(ng.d - ng.n * tot.d / tot.n), 6) as score,
      round(sum(tot.d * ng.n / tot.n * (1 - ng.n / tot.n)), 6) as information
    from ng join tot on tot.time = ng.time where ng.g <> 'AFRICA' group by 1"""
)
def cox_breslow_score0(spark, folder):
    """Score and information of region indicators at zero: observed minus
    expected deaths."""
    people = fx.subjects(spark, folder)
    labels = _REGIONS[1:]
    codes = F.array(*factors.indicators("region", _REGIONS))
    design = cox_design(people, "n_periods", "event", [codes])
    import numpy as np

    zero = np.zeros(len(labels))
    _, score, info, _ = cox_step(design, {"model": zero}, {"model": zero}, "breslow")["model"]
    rows = [(n, float(score[i]), float(info[i, i])) for i, n in enumerate(labels)]
    out = spark.createDataFrame(rows, "term string, score double, information double")
    return out.select("term", rounded("score", 6).alias("score"),
                      rounded("information", 6).alias("information"))


_LAGS = fx.HISTORY - 1


def _people(spark, folder):
    """Episodes with complete histories of 21 rows."""
    whole = histories(spark, folder).where("history_complete").drop("history_complete")
    return fx.episodes(spark, folder).join(whole, "subject")


def _cox_strata(spark, folder):
    people = _people(spark, folder)
    var = fit_basis(history_cells(people), "x", BasisSpec("ns", df=3))
    cb = CrossBasis(var, lag_basis(BasisSpec("ns", df=2), _LAGS), _LAGS)
    rows = cb.on_histories(people)
    design = cox_design(rows, "n_periods", "event", [F.col("cb")], stratum=F.col("region"))
    return cb, fit_cox(design, {"model": cb.terms})["model"]


@analysis()
def cox_strata(spark, folder):
    _, fit = _cox_strata(spark, folder)
    return _tidy_columns(tidy(spark, [fit]))


@analysis()
def cox_effects(spark, folder):
    """Hazard ratios of the stratified model over exposures: the whole surface,
    the running sums over lags, and overall (lag null), against the middle of
    the range."""
    cb, fit = _cox_strata(spark, folder)
    at = predict.exposure_grid(cb.var, points=20)
    arms = {
        "surface": predict.lag_effects(spark, cb, fit, at),
        "cumulative": predict.cumulative_effects(spark, cb, fit, at),
        "overall": predict.overall_effects(spark, cb, fit, at).withColumn("lag", F.lit(None).cast("int")),
    }
    out = None
    for kind, rows in arms.items():
        rows = _effect_columns(rows.withColumn("kind", F.lit(kind)), "kind", "lag")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns({"at": rounded("at"), "cen": rounded("cen")})


# Populations with the exposure df of the unadjusted and the
# adjusted model.
_POPULATIONS = {
    "all": (3, 2), "AFRICA": (2, 4), "AMERICA": (2, 1), "ASIA": (2, 2), "EUROPE": (1, 1),
}
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_TYPES = ["click", "error", "purchase", "signup", "view"]


@analysis()
def cox_dlnm_specs(spark, folder):
    """Ten models over one history table: every population, unadjusted and
    adjusted, knots from its own histories. Models, bases and coefficients are
    rows joined by key; people are read once."""
    specs = spark.createDataFrame(
        [
            (f"{p} {kind}", p, df[side], bool(side))
            for p, df in _POPULATIONS.items()
            for side, kind in enumerate(("unadjusted", "adjusted"))
        ],
        "model string, population string, df int, adjusted boolean",
    )
    people = _people(spark, folder).withColumn(
        "population", F.explode(F.array(F.lit("all"), F.col("region")))
    )
    covariates = F.array(
        *factors.indicators("segment", _SEGMENTS), *factors.indicators("first_type", _TYPES),
        (F.col("balance") < 0).cast("double"),
    )
    names = [*_SEGMENTS[1:], *_TYPES[1:], "overdrawn"]
    lag = lag_basis(BasisSpec("ns", df=2), _LAGS)
    bases = basis_table(
        history_cells(people, keep=["population"]), "x", "population", specs, "ns",
        sorted({d for pair in _POPULATIONS.values() for d in pair}),
    )
    rows = histories_by_table(people.join(specs, "population").join(bases, "model"), lag, _LAGS)
    none = F.array().cast("array<double>")
    design = cox_design(
        rows, "n_periods", "event",
        [F.col("cb"), F.when(F.col("adjusted"), covariates).otherwise(none)],
        model=F.col("model"),
        stratum=F.when(F.col("population") == "all", F.col("region")).otherwise(""),
    )
    widest = max(max(df) for df in _POPULATIONS.values()) * lag.width + len(names)
    fits = fit_cox_models(design, widest)
    # Terms of a model: v1_l1, v1_l2, v2_l1 ... and the covariates.
    cells = F.expr(
        f"flatten(transform(sequence(1, df), v -> transform(sequence(1, {lag.width}), l -> concat('cb_v', v, '_l', l))))"
    )
    listed = F.concat(cells, F.when(F.col("adjusted"), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")))
    terms = specs.select("model", F.posexplode(listed).alias("place", "term"))
    return _tidy_columns(model_coefficients(fits, terms))


_WINDOWS = [("22-28", 22, 28), ("28-32", 28, 32), ("32-37", 32, 37), ("22-37", 22, 37)]


def _weekly(spark, folder, daily=None):
    """Weekly exposure of each area with a week number `t`, and week 0; `daily`
    is the areas' daily exposure if it is there already."""
    daily = fx.area_daily(spark, folder) if daily is None else daily
    weekly = exposure.weekly_exposure(daily, "area", "day", "x")
    first = weekly.agg(F.min("week").alias("w")).scalar()
    return weekly.withColumn("t", (F.datediff("week", first) / 7).cast("long")), first


def _window_designs(weekly, var, lag):
    """Per area and week a lagged design for each outcome window: as many weekly
    lags as the window has weeks of pregnancy at its upper end."""
    names, rows = {}, weekly
    for i, (name, _, high) in enumerate(_WINDOWS):
        cb = CrossBasis(var, lag(high - 1), high - 1)
        rows = cb.on_series(rows, "t", "exposure", keys=["area"], out=f"cb{i}")
        names[name] = cb
    return names, rows.select("area", "t", *[f"cb{i}" for i in range(len(_WINDOWS))])


def _risk_rows(spark, folder, designs, first, keys):
    """Persons at risk by window and gestational week, counted, with the design
    of the calendar week they were in."""
    births = fx.eligible_births(spark, folder).withColumn(
        "start",
        (F.datediff(dates.floor_date(dates.conception_date("birth", "ga")), F.lit(first)) / 7).cast("long"),
    )
    cells = exposure.risk_cells(births, ["area", *keys], "start", F.col("ga") + 1, _WINDOWS)
    rows = cells.withColumn("t", F.col("start") + F.col("time") - 1).join(designs, ["area", "t"], "left")
    cb = F.lit(None)
    for i, (name, _, _) in enumerate(_WINDOWS):
        cb = F.when(F.col("window") == name, F.col(f"cb{i}")).otherwise(cb)
    # Each week of pregnancy is a risk set of its own, as the design changes with it.
    week = F.concat_ws("|", *[k for k in keys if k != "sex"], F.col("time").cast("string"))
    return rows.withColumns({"cb": cb, "set": week})


@analysis()
def cox_truncated(spark, folder):
    """Each outcome window from its entry week: a spline of the weekly exposure
    over all lags of the pregnancy, changing with gestational age."""
    weekly, first = _weekly(spark, folder)
    var = fit_basis(weekly, "exposure", BasisSpec("ns", df=3))
    arms, designs = _window_designs(weekly, var, lambda n: lag_basis(BasisSpec("ns", df=2), n))
    rows = _risk_rows(spark, folder, designs, first, ["birth_type", "sex"])
    design = cox_design(
        rows, "time", "events",
        [F.col("cb"), F.array((F.col("sex") == "O").cast("double"))],
        model=F.col("window"), stratum=F.col("set"), count="at_risk",
    )
    labels = {n: [*cb.terms, "sexO"] for n, cb in arms.items()}
    fits = fit_cox(design, labels)
    return _tidy_columns(tidy(spark, [fits[n] for n in labels]))


def _newton_sql(rows: str, steps: int) -> str:
    """Cox fits of two columns x1, x2 by unrolled Newton steps, ties after
    Efron, from counted rows r(model, s, x1, x2, n, e)."""
    parts = [rows, "b0 as (select distinct model, 0::double as b1, 0::double as b2 from r)"]
    mean = lambda j: f"(s{j} - k / d * d{j})"
    for i in range(steps + 1):
        parts.append(f"""w{i} as materialized (select r.model, s, x1, x2, n, e, exp(b1 * x1 + b2 * x2) as w
  from r join b{i} using (model)),
t{i} as materialized (select model, s, sum(e)::double as d, sum(e * x1) as e1, sum(e * x2) as e2,
    sum(n * w) as s0, sum(n * w * x1) as s1, sum(n * w * x2) as s2, sum(n * w * x1 * x1) as s11,
    sum(n * w * x1 * x2) as s12, sum(n * w * x2 * x2) as s22, sum(e * w) as d0, sum(e * w * x1) as d1,
    sum(e * w * x2) as d2, sum(e * w * x1 * x1) as d11, sum(e * w * x1 * x2) as d12, sum(e * w * x2 * x2) as d22
  from w{i} group by all having sum(e) > 0),
k{i} as materialized (select *, unnest(range(d::bigint)) as k from t{i}),
g{i} as materialized (select model, sum(e1 / d - {mean(1)} / {mean(0)}) as u1, sum(e2 / d - {mean(2)} / {mean(0)}) as u2,
    sum({mean(11)} / {mean(0)} - {mean(1)} * {mean(1)} / {mean(0)} / {mean(0)}) as i11,
    sum({mean(12)} / {mean(0)} - {mean(1)} * {mean(2)} / {mean(0)} / {mean(0)}) as i12,
    sum({mean(22)} / {mean(0)} - {mean(2)} * {mean(2)} / {mean(0)} / {mean(0)}) as i22
  from k{i} group by model),
b{i + 1} as materialized (select model, b1 + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12) as b1,
    b2 + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12) as b2,
    sqrt(i22 / (i11 * i22 - i12 * i12)) as se1, sqrt(i11 / (i11 * i22 - i12 * i12)) as se2
  from b{i} join g{i} using (model))""")
    return "with " + ", ".join(parts)


_WEEKLY_SQL = f"""{BIRTHS},
weekly as (select area, {floor_week("day")} as week, avg(x) as x from area_daily group by all),
week0 as (select min(week) as w0 from weekly),
series as materialized (select area, ((week - w0) // 7)::bigint as t, x from weekly, week0),
windows(win, low, high) as (values ('22-28', 22, 28), ('28-32', 28, 32), ('32-37', 32, 37), ('22-37', 22, 37)),
lagged as materialized (select win, a.area, a.t, sum(case when a.t - b.t < 4 then b.x end) as x1,
    sum(case when a.t - b.t >= 4 then b.x end) as x2
  from series a cross join windows join series b on b.area = a.area and b.t <= a.t and b.t > a.t - high
  group by win, high, a.area, a.t having count(*) = high),
people as (select area, birth_type, ({floor_week("(birth - cast(7 * ga as integer))")} - w0) // 7 as start,
    cast(ga as bigint) + 1 as done from eligible, week0),
split as (select win as model, birth_type || '|' || time as s, area, start + time - 1 as t, done, time
  from people join windows on done > low, (select unnest(range(23, 38)) as time)
  where time > low and time <= least(done, high)),
r as materialized (select model, s, x1, x2, count(*)::double as n, sum(case when time = done then 1 else 0 end)::double as e
  from split p join lagged l on l.win = p.model and l.area = p.area and l.t = p.t group by all)"""


@analysis(
    _newton_sql(_WEEKLY_SQL, 7)
    + """ select model, unnest(['lag_0_3', 'lag_4_up']) as term, round(unnest([b1, b2]), 5) + 0 as estimate,
      round(unnest([se1, se2]), 5) as std_error, (select cast(sum(n) as bigint) from r where r.model = b8.model) as n,
      (select count(*) from split where split.model = b8.model)
        - (select cast(sum(n) as bigint) from r where r.model = b8.model) as n_dropped
      from b8"""
)
def cox_weekly_lags(spark, folder):
    """Each outcome window with linear weekly lags 0-3 and 4 up to the whole
    pregnancy; n counts person-weeks at risk."""
    weekly, first = _weekly(spark, folder)
    var = fit_basis(weekly, "exposure", BasisSpec("lin"))
    arms, designs = _window_designs(weekly, var, lambda n: strata([4], intercept=True))
    rows = _risk_rows(spark, folder, designs, first, ["birth_type"])
    design = cox_design(
        rows, "time", "events", [F.col("cb")], model=F.col("window"), stratum=F.col("set"), count="at_risk"
    )
    fits = fit_cox(design, {n: ["lag_0_3", "lag_4_up"] for n in arms})
    out = tidy(spark, [fits[n] for n in arms])
    return out.select("model", "term", rounded("estimate", 5).alias("estimate"),
                      rounded("std_error", 5).alias("std_error"), "n", "n_dropped")


# --- quantiles ----------------------------------------------------------------------

_TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]


@analysis(
    f"with {BIRTHS}, q as ("
    + " union all ".join(
        f"select {t}::double as tau, quantile_disc(price, {t}) as q from births" for t in _TAUS
    )
    + """)
    select tau, round(any_value(q) / 1000, 1) as estimate,
      round(sum((price - q) * (tau - case when price < q then 1 else 0 end)) / 1000, 4) as loss
    from births cross join q group by 1"""
)
def quantile_intercept(spark, folder):
    """Intercept-only fits: percentiles, with the minimised check loss."""
    rows = fx.births(spark, folder).select(
        F.lit("model").alias("model"), (F.col("price") / 1000).alias("y"),
        F.array(F.lit(1.0)).alias("x"),
    )
    fits = fit_quantile(rows, ["intercept"], _TAUS)
    out = spark.createDataFrame(
        [(t, float(f.coef[0]), float(-f.loglik)) for t, f in zip(_TAUS, fits, strict=True)],
        "tau double, estimate double, loss double",
    )
    return out.select(
        "tau", rounded("estimate", 1).alias("estimate"), rounded("loss", 4).alias("loss")
    )


@analysis(
    f"with {BIRTHS}, q as ("
    + " union all ".join(
        f"select {t}::double as tau, sex, quantile_disc(ga, {t}) as q from births group by sex"
        for t in _TAUS
    )
    + """), fit as (
      select tau, sex, any_value(q) as q, sum((ga - q) * (tau - case when ga < q then 1 else 0 end)) as loss
      from births join q using (sex) group by tau, sex)
    select tau, round(sum(loss), 4) as loss from fit group by tau"""
)
def quantile_strata(spark, folder):
    """Gestational age on sex, a saturated fit on heavily tied rows: the loss is
    that of the percentiles of each sex."""
    rows = fx.births(spark, folder).select(
        F.lit("model").alias("model"), F.col("ga").cast("double").alias("y"),
        F.array(F.lit(1.0), (F.col("sex") == "O").cast("double")).alias("x"),
    )
    fits = fit_quantile(rows, ["intercept", "sexO"], _TAUS)
    out = spark.createDataFrame(
        [(t, float(-f.loglik)) for t, f in zip(_TAUS, fits, strict=True)], "tau double, loss double"
    )
    return out.select("tau", rounded("loss", 4).alias("loss"))


@analysis()
def quantile_spline(spark, folder):
    """Gestational age on a spline of the last week's exposure with two inner
    knots; effects of high percentiles against the median exposure."""
    births = births_with_window(spark, folder).where("window_mean is not null")
    var = fit_basis(births, "window_mean", BasisSpec("ns", df=3))
    cb = CrossBasis(var, strata([], intercept=True), 0, "exposure")
    rows = births.select(
        F.lit("model").alias("model"),
        F.col("ga").cast("double").alias("y"),
        F.concat(
            F.array(F.lit(1.0)), var.column("window_mean"),
            F.array((F.col("sex") == "O").cast("double")),
        ).alias("x"),
    )
    fits = fit_quantile(rows, ["intercept", *cb.terms, "sexO"], [0.1, 0.5])
    marks = exact_percentiles(
        births, [], "window_mean", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    ).first()
    out = None
    for f in fits:
        e = predict.overall_effects(
            spark, cb, f, [marks.p90, marks.p95, marks.p99], cen=marks.p50
        )
        out = e if out is None else out.unionByName(e)
    return out.select("model", rounded("at", 6).alias("at"), rounded("fit", 4).alias("fit"),
                      rounded("se", 4).alias("se"), rounded("cen", 6).alias("cen"))


@analysis()
def quantile_dlnm(spark, folder):
    """Gestational age on the weekly exposure lags before birth that all these
    pregnancies have, 0 to 21. The design is made once per area and week and
    joined to the births."""
    weekly, _ = _weekly(spark, folder)
    cb = crossbasis(weekly, "exposure", 21, BasisSpec("ns", df=2), BasisSpec("ns", df=2), "weekly")
    design = cb.on_series(weekly, "t", "exposure", keys=["area"]).where("cb is not null")
    births = fx.eligible_births(spark, folder).withColumn("week", dates.floor_date("birth"))
    rows = births.join(design.select("area", "week", "cb"), ["area", "week"]).select(
        F.lit("model").alias("model"),
        F.col("ga").cast("double").alias("y"),
        F.concat(F.array(F.lit(1.0)), F.col("cb")).alias("x"),
    )
    fits = fit_quantile(rows, ["intercept", *cb.terms], [0.5])
    return _tidy_columns(tidy(spark, fits)).select("model", "term", "estimate", "std_error", "n")


# --- matched sets ---------------------------------------------------------------------

_PAIRS = """
  cases as (select distinct user_id, cast(ts as date) as day from events
            where event_type = 'error'),
  ev as (select cast(ts as date) as ref_day, avg(value) as exposure from events
         where event_type <> 'error' group by 1),
  cut as (select avg(exposure) as m from ev),
  pairs as (
    select user_id, day, case when a.exposure > m then 1 else 0 end as xc,
           case when b.exposure > m then 1 else 0 end as xr
    from cases join ev a on a.ref_day = day join ev b on b.ref_day = day - 7 cross join cut)"""


@analysis(
    f"""with {_PAIRS},
    c as (select sum(case when xc = 1 and xr = 0 then 1 else 0 end)::double as up,
          sum(case when xc = 0 and xr = 1 then 1 else 0 end)::double as down,
          count(*) as sets from pairs)
    select round(ln(up / down), 6) as estimate, round(sqrt(1 / up + 1 / down), 6) as std_error,
      sets from c"""
)
def clogit_discordant(spark, folder):
    """Each case day with the day one week before, exposure above its mean."""
    daily = fx.event_exposure(spark, folder)
    mean = daily.agg(F.avg("exposure").alias("m")).scalar()
    high = daily.select("ref_day", (F.col("exposure") > mean).cast("double").alias("high"))
    days = F.array(F.col("day"), F.date_sub("day", 7))
    sets = fx.cases(spark, folder).withColumn("ref_day", F.explode(days))
    rows = sets.join(high, "ref_day").select(
        F.struct("user_id", "day").alias("set"),
        (F.col("ref_day") == F.col("day")).cast("long").alias("is_case"),
        F.array("high").alias("x"),
    )
    fit = fit_clogit(clogit_design(rows, "set", "is_case", [F.col("x")]), ["high"])
    out = tidy(spark, [fit])
    return out.select(
        rounded("estimate", 6).alias("estimate"), rounded("std_error", 6).alias("std_error"),
        F.lit(fit.n_event).cast("long").alias("sets"),
    )


@analysis()
def clogit_fit(spark, folder):
    """Time-stratified sets with a spline of the exposure."""
    sets = exposure.time_stratified_controls(fx.cases(spark, folder), "day")
    rows = sets.join(fx.event_exposure(spark, folder), "ref_day")
    var = fit_basis(rows, "exposure", BasisSpec("ns", df=3))
    rows = rows.withColumn("b", var.column("exposure")).withColumn(
        "set", F.struct("user_id", "day")
    )
    labels = [f"exposure{i + 1}" for i in range(var.width)]
    fit = fit_clogit(clogit_design(rows, "set", "is_case", [F.col("b")]), labels)
    return _tidy_columns(tidy(spark, [fit]))


def _hypergeometric_sql(steps: int) -> str:
    """Newton steps of one binary exposure: sets of n members, m cases, k
    exposed, a exposed cases; j runs over the possible exposed cases."""
    ways = "lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(n - k + 1) - lgamma(m - j + 1) - lgamma(n - k - m + j + 1)"
    parts = [f"""{BIRTHS},
cells as materialized (select area, {floor_week("birth")} as week, count(*) as n,
    sum(case when ga < 28 then 1 else 0 end) as m, sum(case when sex = 'O' then 1 else 0 end) as k,
    sum(case when ga < 28 and sex = 'O' then 1 else 0 end) as a from eligible group by 1, 2
  having sum(case when ga < 28 then 1 else 0 end) between 1 and count(*) - 1),
grid as materialized (select *, {ways} as lw from (
    select *, unnest(range(greatest(0, m + k - n)::bigint, least(k, m)::bigint + 1)) as j from cells)),
b0 as (select 0::double as b)"""]
    for i in range(steps + 1):
        parts.append(f"""g{i} as materialized (select area, week, any_value(a) as a, sum(exp(lw + b * j)) as e0,
    sum(j * exp(lw + b * j)) as e1, sum(j * j * exp(lw + b * j)) as e2 from grid, b{i} group by 1, 2),
b{i + 1} as materialized (select any_value(b) + sum(a - e1 / e0) / sum(e2 / e0 - e1 * e1 / e0 / e0) as b,
    1 / sqrt(sum(e2 / e0 - e1 * e1 / e0 / e0)) as se, count(*) as sets from g{i}, b{i})""")
    return "with " + ", ".join(parts)


@analysis(
    _hypergeometric_sql(6) + " select round(b, 6) as estimate, round(se, 6) as std_error, sets from b7"
)
def clogit_several(spark, folder):
    """Births of an area and week as a set: the extremely preterm ones, often
    several, against the others, by sex."""
    rows = fx.eligible_births(spark, folder).select(
        F.struct("area", dates.floor_date("birth").alias("week")).alias("set"),
        (F.col("ga") < 28).cast("long").alias("is_case"),
        F.array((F.col("sex") == "O").cast("double")).alias("x"),
    )
    fit = fit_clogit(clogit_design(rows, "set", "is_case", [F.col("x")]), ["sexO"], tol=1e-13)
    out = tidy(spark, [fit])
    return out.select(
        rounded("estimate", 6).alias("estimate"), rounded("std_error", 6).alias("std_error"),
        F.lit(fit.n_event).cast("long").alias("sets"),
    )


# --- contrasts by area -----------------------------------------------------------------

_CENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _area_points(weekly):
    """High centiles of the weekly exposure of each area against its median."""
    found = exact_percentiles(weekly, ["area"], "exposure", _CENTILES)
    high = F.array(*[F.struct(F.lit(c).alias("centile"), F.col(c).alias("at")) for c in _CENTILES if c != "p50"])
    return found.select("area", F.col("p50").alias("cen"), F.explode(high).alias("h")).select("area", "cen", "h.*")


def _week_of_birth_rows(spark, folder, var, first, weekly):
    """Risk rows whose exposure is that of the current week."""
    designs = weekly.select("area", "t", var.column("exposure").alias("cb0"))
    births = fx.eligible_births(spark, folder).withColumn(
        "start",
        (F.datediff(dates.floor_date(dates.conception_date("birth", "ga")), F.lit(first)) / 7).cast("long"),
    )
    cells = exposure.risk_cells(births, ["area", "birth_type"], "start", F.col("ga") + 1, _WINDOWS[3:])
    rows = cells.withColumn("t", F.col("start") + F.col("time") - 1).join(designs, ["area", "t"])
    return rows.withColumn("set", F.concat_ws("|", "birth_type", F.col("time").cast("string")))


_AREA_SQL = f"""{BIRTHS},
weekly as (select area, {floor_week("day")} as week, avg(x) as x from area_daily group by all),
week0 as (select min(week) as w0 from weekly),
series as materialized (select area, ((week - w0) // 7)::bigint as t, x from weekly, week0),
people as (select area, birth_type, ({floor_week("(birth - cast(7 * ga as integer))")} - w0) // 7 as start,
    cast(ga as bigint) + 1 as done from eligible, week0),
split as (select area, birth_type, time, start + time - 1 as t, case when time = done then 1 else 0 end as e
  from people, (select unnest(range(23, 38)) as time) where time <= done),
r0 as (select birth_type || '|' || time as time, x, count(*)::double as n0, sum(e)::double as e0
  from split join series using (area, t) group by all),
risk as materialized (select 'all' as model, time, x, n0 as n, e0 / n0 as e,
    sum(e0) over (partition by time) as d, sum(e0 * x) over (partition by time) as ex from r0),
centiles as (select area, quantile_cont(x, 0.5) as cen, quantile_cont(x, 0.9) as p90, quantile_cont(x, 0.95) as p95,
    quantile_cont(x, 0.99) as p99 from weekly group by 1),
points as (select area, cen, unnest(['p90', 'p95', 'p99']) as centile, unnest([p90, p95, p99]) as hi from centiles)"""


@analysis(
    newton_one_sql(_AREA_SQL + ", r as (select distinct model from risk)", 6, having="d > 0")
    + """ select area, centile, round(hi, 8) as "at", round(cen, 8) as cen, round((hi - cen) * b, 7) + 0 as fit,
      round(abs(hi - cen) * sqrt(var), 7) as se from points, b7"""
)
def area_contrasts_line(spark, folder):
    """Hazards at each area's own high centiles against its own median, for a
    linear exposure in the week at risk."""
    weekly, first = _weekly(spark, folder)
    var = fit_basis(weekly, "exposure", BasisSpec("lin"))
    rows = _week_of_birth_rows(spark, folder, var, first, weekly)
    design = cox_design(rows, "time", "events", [F.col("cb0")], stratum=F.col("set"), count="at_risk")
    cb = CrossBasis(var, strata([], intercept=True), 0, "exposure")
    fit = fit_cox(design, {"model": cb.terms}, tol=1e-13)["model"]
    out = predict.contrast_rows(_area_points(weekly), cb, fit)
    return out.select("area", "centile", rounded("at", 8).alias("at"), rounded("cen", 8).alias("cen"),
                      rounded("fit", 7).alias("fit"), rounded("se", 7).alias("se"))


def _side_by_side(spark, *steps):
    """Results of steps that need nothing of each other, run at the same time:
    their passes are too short to fill a cluster."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(f)) for f in steps]
        return [r.result() for r in running]


@analysis()
def area_contrasts(spark, folder):
    """The week before birth in three designs, a spline with two inner knots
    each, at every area's 90th, 95th and 99th centile against its median."""
    # Tables of areas and days, which all designs read.
    daily = settled(fx.area_daily(spark, folder))
    weekly, first = _weekly(spark, folder, daily)
    weekly = settled(weekly)
    var = fit_basis(weekly, "exposure", BasisSpec("ns", df=3))
    cb = CrossBasis(var, strata([], intercept=True), 0, "exposure")
    births = exposure.window_exposure(fx.eligible_births(spark, folder), daily, "area", "birth", "day", "x")
    births = births.where("window_mean is not null")
    taus = [0.1, 0.5]
    rows = births.select(
        F.lit("model").alias("model"), F.col("ga").cast("double").alias("y"),
        F.concat(F.array(F.lit(1.0)), var.column("window_mean")).alias("x"),
    )
    at_risk = _week_of_birth_rows(spark, folder, var, first, weekly)
    design = cox_design(at_risk, "time", "events", [F.col("cb0")], stratum=F.col("set"), count="at_risk")
    cases = births.where("ga < 37").select("l_orderkey", "l_linenumber", "area", "birth")
    # Births of an area and day have equal sets: each is made once and counted.
    sets = cases.groupBy("l_orderkey", "l_linenumber").agg(
        F.sort_array(F.collect_list(F.struct("area", "birth"))).alias("set")
    )
    sets = sets.groupBy("set").agg(F.count("*").alias("many")).select("*", F.explode("set").alias("c")).select("set", "many", "c.*")
    sets = exposure.time_stratified_controls(sets, "birth").drop("birth").withColumnRenamed("ref_day", "birth")
    sets = exposure.window_exposure(sets, daily, "area", "birth", "day", "x")
    matched = sets.where("window_mean is not null").select(
        "set", "many", "is_case", var.column("window_mean").alias("x")
    )
    quantiles, hazard, crossover, points = _side_by_side(
        spark,
        lambda: fit_quantile(rows, ["intercept", *cb.terms], taus),
        lambda: fit_cox(design, {"model": cb.terms})["model"],
        lambda: fit_clogit(clogit_design(matched, "set", "is_case", [F.col("x")], "many"), cb.terms),
        lambda: settled(_area_points(weekly)),
    )
    fits = dict(zip([f"quantile {t}" for t in taus], quantiles, strict=True))
    fits |= {"time to event": hazard, "case-crossover": crossover}
    out = None
    for name, fit in fits.items():
        part = predict.contrast_rows(points, cb, fit).withColumn("design", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("design", "area", "centile", *[rounded(c, 5).alias(c) for c in ("at", "cen", "fit", "se")])


# --- smooth trend -----------------------------------------------------------------------


@analysis()
def trend_smooth(spark, folder):
    """Cubic regression spline of price on quantity with its band."""
    births = fx.births(spark, folder).select("ga", "price")
    var = fit_basis(births, "ga", BasisSpec("bs", df=6, degree=3))
    cb = CrossBasis(var, strata([], intercept=True), 0, "trend")
    rows = births.withColumn("b", var.column("ga"))
    fit = fit_glm(rows, GlmSpec("price", "gaussian", (Term("trend", "b", tuple(cb.terms)),)))
    band = predict.smooth_band(spark, cb, fit, predict.exposure_grid(var, points=40))
    return band.select(*[rounded(c, 3).alias(c) for c in ("at", "fit", "low", "high")])

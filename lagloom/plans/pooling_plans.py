"""Effect sizes and pooled analyses over study arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.functions.tails import normal_quantile
from lagloom.models.cox import cox_design, fit_cox_models
from lagloom.operators import effects, pooling
from lagloom.plans import fixtures as fx
from lagloom.plans.registry import analysis, rounded
from lagloom.plans.sql_text import ARMS, chi2_p_sql, newton_one_sql, t_p_sql
from lagloom.session import settled

_KEYS = ["outcome", "study"]


def _effect(df, keys, digits=11):
    return df.select(
        *keys, rounded("yi", digits).alias("yi"), rounded("vi", digits).alias("vi")
    )


# Prices are given in units of 1,300, so that rounded means are never exact
# decimal halves.
_UNIT = 1300


def _sql(yi: str, vi: str, source: str, keys: str = "outcome, study", digits: int = 11) -> str:
    return (
        f"with {ARMS} select {keys}, round({yi}, {digits}) + 0 as yi, "
        f"round({vi}, {digits}) + 0 as vi "
        f"from {source}"
    )


@analysis(
    _sql(f"mean / {_UNIT}", f"sd / {_UNIT} * sd / {_UNIT} / n", "arms where n >= 2",
         "outcome, study, arm", 8)
)
def effect_mean(spark, folder):
    rows = fx.arms(spark, folder).where("n >= 2").withColumns(
        {"mean": F.col("mean") / _UNIT, "sd": F.col("sd") / _UNIT}
    )
    return _effect(effects.mean_effect(rows), [*_KEYS, "arm"], 8)


_ADD1 = "(case when event = 0 or event = n then 0.5::double else 0 end)"


@analysis(
    _sql(
        f"ln((event + {_ADD1}) / (n - event + {_ADD1}))",
        f"1 / (event + {_ADD1}) + 1 / (n - event + {_ADD1})",
        "arms", "outcome, study, arm",
    )
)
def effect_prop(spark, folder):
    return _effect(effects.proportion_effect(fx.arms(spark, folder)), [*_KEYS, "arm"])


@analysis(_sql("atanh(cor)", "1.0::double / (n - 3)", "arms where n > 3", "outcome, study, arm"))
def effect_cor(spark, folder):
    rows = fx.arms(spark, folder).where("n > 3")
    return _effect(effects.correlation_effect(rows), [*_KEYS, "arm"])


@analysis(
    _sql(f"(mean_e - mean_c) / {_UNIT}",
         f"(sd_e * sd_e / n_e + sd_c * sd_c / n_c) / {_UNIT * _UNIT}", "studies", digits=8)
)
def effect_md(spark, folder):
    out = effects.mean_difference(fx.studies(spark, folder))
    return _effect(
        out.withColumns({"yi": F.col("yi") / _UNIT, "vi": F.col("vi") / (_UNIT * _UNIT)}),
        _KEYS, 8,
    )


@analysis(_sql("yi", "vi", "smd"))
def effect_smd(spark, folder):
    return _effect(effects.standardised_difference(fx.studies(spark, folder)), _KEYS)


_CELLS = """, c0 as (select *, case when event_e = 0 or event_c = 0 or event_e = n_e
    or event_c = n_c then 0.5::double else 0 end as add0 from studies),
  cells as (select outcome, study, event_e + add0 as a, n_e - event_e + add0 as b,
    event_c + add0 as c, n_c - event_c + add0 as d from c0)"""


@analysis(
    f"""with {ARMS} {_CELLS}
    select outcome, study, 'RR' as measure, round(ln(a / (a + b)) - ln(c / (c + d)), 11) as yi,
      round(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d), 11) as vi from cells
    union all
    select outcome, study, 'OR', round(ln(a * d / (b * c)), 11),
      round(1 / a + 1 / b + 1 / c + 1 / d, 11) from cells"""
)
def effect_rr_or(spark, folder):
    s = fx.studies(spark, folder)
    rr = effects.ratio_effect(s, "RR").withColumn("measure", F.lit("RR"))
    odds = effects.ratio_effect(s, "OR").withColumn("measure", F.lit("OR"))
    return _effect(rr.unionByName(odds), [*_KEYS, "measure"])


_IRR = """, r0 as (select *, case when event_e = 0 or event_c = 0 then 0.5::double else 0 end
    as add0 from studies),
  irr as (select outcome, study, ln((event_e + add0) / time_e) - ln((event_c + add0) / time_c)
      as yi, 1 / (event_e + add0) + 1 / (event_c + add0) as vi from r0)"""


@analysis(
    f"with {ARMS} {_IRR} select outcome, study, round(yi, 11) as yi, round(vi, 11) as vi from irr"
)
def effect_irr(spark, folder):
    return _effect(effects.rate_ratio(fx.studies(spark, folder)), _KEYS)


_STUDY_SQL = f"""{ARMS},
r as materialized (select p_type || '|' || s_nationkey as model, l_quantity as done, l_returnflag = 'R' as died,
    case when l_linestatus = 'O' then 1.0::double else 0 end as x
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
ends as (select model, done as time, count(*) as d, sum(x) as ex from r where died group by all),
risk as materialized (select r.model, time, any_value(d) as d, any_value(ex) as ex, x,
    case when died and done = time then 1 else 0 end as e, count(*) as n
  from r join ends on ends.model = r.model and done >= time group by all)"""


def study_hazards(spark, folder):
    """Per outcome and study the log hazard ratio of the arms, every study a
    model of one grouped fit."""
    line = fx.study_lines(spark, folder)
    rows = line.withColumns(
        {
            "study_model": F.concat_ws("|", "outcome", F.col("study").cast("string")),
            "died": (F.col("l_returnflag") == "R").cast("long"),
            "x": F.array((F.col("l_linestatus") == "O").cast("double")),
        }
    )
    fits = fit_cox_models(
        cox_design(rows, "l_quantity", "died", [F.col("x")], model=F.col("study_model")), 1
    )
    name = F.split("model", r"\|")
    return fits.select(
        name[0].alias("outcome"), name[1].cast("long").alias("study"), "n", "n_event",
        F.get("beta", F.lit(0)).alias("log_hr"), F.sqrt(F.get("cov", F.lit(0))).alias("se"),
    ).where("se is not null and not isnan(se)")


@analysis(
    newton_one_sql(_STUDY_SQL, 7)
    + """ select split_part(model, '|', 1) as outcome, split_part(model, '|', 2)::bigint as study,
      round(b, 6) + 0 as yi, round(var, 6) + 0 as vi from b8 where isfinite(var)"""
)
def effect_hr(spark, folder):
    """Log hazard ratios of the arms from a Cox fit per study."""
    fits = study_hazards(spark, folder)
    return _effect(effects.hazard_ratio(fits, log_hr="log_hr", se="se"), _KEYS, 6)


@analysis(
    newton_one_sql(_STUDY_SQL, 7)
    + """ select split_part(model, '|', 1) as outcome, count(*) as k,
      round(sum(b / var) / sum(1 / var), 6) + 0 as estimate, round(sqrt(1 / sum(1 / var)), 6) as std_error
      from b8 where isfinite(var) group by 1"""
)
def pool_hr(spark, folder):
    """Hazard ratios of the studies, fitted and pooled; published ratios and
    their intervals give the same effects back."""
    fits = effects.hazard_ratio(study_hazards(spark, folder), log_hr="log_hr", se="se")
    half = normal_quantile(0.975) * F.sqrt("vi")
    published = fits.select(
        *_KEYS, F.exp("yi").alias("hr"), F.exp(F.col("yi") - half).alias("low"), F.exp(F.col("yi") + half).alias("high")
    )
    out = pooling.pool_fixed(effects.hazard_ratio(published, hr="hr", low="low", high="high"), ["outcome"])
    return out.select("outcome", "k", rounded("estimate").alias("estimate"), rounded("std_error").alias("std_error"))


def _smd(spark, folder):
    return effects.standardised_difference(fx.studies(spark, folder)).select(
        *_KEYS, "yi", "vi", "mod_discount", "mod_quantity"
    )


_FIXED = """, f as (select outcome, count(*) as k, sum(1 / vi) as sw, sum(1 / (vi * vi)) as sw2,
    sum(yi / vi) / sum(1 / vi) as mu from smd group by 1),
  h as (select f.outcome, any_value(k) as k, any_value(sw) as sw, any_value(sw2) as sw2,
    sum((yi - mu) * (yi - mu) / vi) as q from smd join f on f.outcome = smd.outcome group by 1),
  t as (select *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) as tau2 from h)"""


@analysis(
    f"""with {ARMS} {_FIXED} select outcome, k, round(mu, 8) as estimate,
    round(sqrt(1 / sw), 8) as std_error from f"""
)
def pool_fixed(spark, folder):
    out = pooling.pool_fixed(_smd(spark, folder), ["outcome"])
    return out.select("outcome", "k", rounded("estimate", 8).alias("estimate"),
                      rounded("std_error", 8).alias("std_error"))


@analysis(
    f"""with {ARMS} {_FIXED} select t.outcome, count(*) as k, round(any_value(tau2), 8) as tau2,
    round(sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)), 8) as estimate,
    round(sqrt(1 / sum(1 / (vi + tau2))), 8) as std_error
    from smd join t on t.outcome = smd.outcome group by 1"""
)
def pool_dl(spark, folder):
    out = pooling.pool_dl(_smd(spark, folder), ["outcome"])
    return out.select("outcome", "k", *[rounded(c, 8).alias(c)
                                        for c in ("tau2", "estimate", "std_error")])


@analysis(
    f"""with {ARMS} {_FIXED} select outcome, k, round(q, 6) as q, k - 1 as q_df,
    round(greatest(0, (q - (k - 1)) / q), 6) as i2, round(q / (k - 1), 6) as h2 from t"""
)
def pool_q_i2(spark, folder):
    out = pooling.heterogeneity(_smd(spark, folder), ["outcome"])
    return out.select("outcome", "k", rounded("q").alias("q"), "q_df",
                      rounded("i2").alias("i2"), rounded("h2").alias("h2"))


@analysis(
    f"with {ARMS} {_FIXED} select outcome, k, round(q, 6) as q, k - 1 as q_df, "
    f"round({chi2_p_sql('q', 'k - 1')}, 7) + 0 as q_p from t"
)
def pool_q_test(spark, folder):
    """The test of equal effects."""
    out = pooling.heterogeneity(_smd(spark, folder), ["outcome"])
    return out.select("outcome", "k", rounded("q").alias("q"), "q_df", rounded("q_p", 7).alias("q_p"))


def _scoring_sql(method: str) -> str:
    """Scoring steps of an intercept-only fit as a recursive query."""
    move = {
        "REML": "(p2 - (s1 - s2 / s1)) / (s2 - 2 * s3 / s1 + (s2 / s1) * (s2 / s1))",
        "ML": "(p2 - s1) / s2",
    }[method]
    return f"""{_FIXED},
  step(outcome, i, tau2) as (
    select outcome, 0, cast(tau2 as double) from t
    union all
    select outcome, i + 1, greatest(0, tau2 + {move}) from (
      select g.outcome, g.i, any_value(g.tau2) as tau2, sum(g.w) as s1, sum(g.w * g.w) as s2,
        sum(g.w * g.w * g.w) as s3, sum(g.w * g.w * (g.yi - g.mu) * (g.yi - g.mu)) as p2
      from (select s.outcome, s.i, s.tau2, m.yi, 1 / (m.vi + s.tau2) as w,
              sum(m.yi / (m.vi + s.tau2)) over (partition by s.outcome, s.i)
              / sum(1 / (m.vi + s.tau2)) over (partition by s.outcome, s.i) as mu
            from step s join smd m on m.outcome = s.outcome where s.i < 60) g
      group by g.outcome, g.i)),
  last as (select outcome, tau2 from step where i = 60)"""


@analysis(
    f"""with recursive {ARMS} {_scoring_sql('REML')},
    b as (select l.outcome, any_value(l.tau2) as tau2, count(*) as k,
        sum(1 / (vi + l.tau2)) as sw, sum(yi / (vi + l.tau2)) / sum(1 / (vi + l.tau2)) as mu
      from last l join smd on smd.outcome = l.outcome group by 1),
    r as (select b.outcome, any_value(k) as k, any_value(tau2) as tau2, any_value(mu) as mu,
        sqrt(sum((yi - mu) * (yi - mu) / (vi + tau2)) / (any_value(k) - 1) / any_value(sw)) as se
      from b join smd on smd.outcome = b.outcome group by 1)
    select r.outcome, r.k, round(r.tau2, 7) as tau2, round(mu, 6) as estimate,
      round(se, 6) as std_error, round(mu / se, 4) as statistic, round(h.q, 6) as q
    from r join h on h.outcome = r.outcome"""
)
def pool_reml_hk(spark, folder):
    fits = pooling.random_effects(_smd(spark, folder), method="REML")
    first = F.lit(0)
    return fits.select(
        "outcome", "k", rounded("tau2", 7).alias("tau2"),
        rounded(F.get("estimate", first), 6).alias("estimate"),
        rounded(F.get("std_error", first), 6).alias("std_error"),
        rounded(F.get("statistic", first), 4).alias("statistic"),
        rounded("q", 6).alias("q"),
    )


@analysis(
    f"""with recursive {ARMS} {_scoring_sql('ML')}
    select outcome, round(tau2, 7) as tau2 from last"""
)
def pool_ml(spark, folder):
    fits = pooling.random_effects(_smd(spark, folder), method="ML")
    return fits.select("outcome", rounded("tau2", 7).alias("tau2"))


@analysis(
    f"""with {ARMS} {_FIXED},
    z as (select smd.outcome, yi, vi + tau2 as v, mod_quantity as x from smd
          join t on t.outcome = smd.outcome),
    m as (select outcome, sum(x / v) / sum(1 / v) as mx, sum(yi / v) / sum(1 / v) as my
          from z group by 1),
    s as (select z.outcome, sum((x - mx) * (yi - my) / v) / sum((x - mx) * (x - mx) / v) as slope
          from z join m on m.outcome = z.outcome group by 1)
    select m.outcome, round(slope, 6) as slope, round(my - slope * mx, 6) as intercept
    from m join s on s.outcome = m.outcome"""
)
def metareg_fixed_tau(spark, folder):
    """Weighted line of the effects on a moderator at the closed-form tau^2."""
    rows = _smd(spark, folder)
    tau = pooling.pool_dl(rows, ["outcome"]).select("outcome", "tau2")
    line = pooling.weighted_line(rows.join(tau, "outcome"), "mod_quantity")
    return line.select("outcome", rounded("slope").alias("slope"),
                       rounded("intercept").alias("intercept"))


def _line_sql(source: str) -> str:
    """Weighted lines of yi on mod_quantity: every study with its weight w, the
    distance u from the weighted mean, the residual e and the sums sw, suu."""
    over = "over (partition by outcome, i)"
    return f"""(select *, v - suv / suu * u as e from (
      select *, sum(w * u * u) {over} as suu, sum(w * u * v) {over} as suv from (
        select *, x - sum(w * x) {over} / sw as u, yi - sum(w * yi) {over} / sw as v from (
          select *, sum(w) {over} as sw from ({source}) s0) s1) s2) s3)"""


_LINE_STEP = _line_sql(
    "select s.outcome, s.i, s.tau2, m.yi, m.mod_quantity as x, 1 / (m.vi + s.tau2) as w "
    "from mstep s join smd m on m.outcome = s.outcome where s.i < 60"
)
_AT = "select m.outcome, study, 0 as i, yi, mod_quantity as x, 1 / (vi + {0}) as w from smd m join mlast using (outcome)"
# REML of one moderator: traces of P and P P from the weights and distances.
_METAREG = _scoring_sql("REML") + f""",
  mstep(outcome, i, tau2) as (
    select outcome, 0, cast(tau2 as double) from t
    union all
    select outcome, i + 1, greatest(0, tau2 + (pp - (w1 - h2)) / (w2 - 2 * h3 + a * a + 2 * b * b + c * c)) from (
      select outcome, i, any_value(tau2) as tau2, sum(w * w * e * e) as pp, sum(w) as w1, sum(w * w) as w2,
        sum(w * w * (1 / sw + u * u / suu)) as h2, sum(w * w * w * (1 / sw + u * u / suu)) as h3,
        sum(w * w) / any_value(sw) as a, sum(w * w * u) / sqrt(any_value(sw) * any_value(suu)) as b,
        sum(w * w * u * u) / any_value(suu) as c
      from {_LINE_STEP} g group by outcome, i)),
  mlast as (select outcome, tau2 from mstep where i = 60),
  fitted as (select * from {_line_sql(_AT.format("mlast.tau2"))} f),
  zero as (select outcome, sum(w * e * e) as q, count(*) - 2 as q_df,
      sum(w) - sum(w * w * (1 / sw + u * u / suu)) as tr from {_line_sql(_AT.format("0"))} z group by 1),
  line as (select outcome, count(*) as k, any_value(suv / suu) as slope, any_value(yi - e - suv / suu * x) as a,
      sqrt(sum(w * e * e) / (count(*) - 2) / any_value(suu)) as slope_se from fitted group by 1)"""


@analysis(
    f"""with recursive {ARMS} {_METAREG}
    select l.outcome, k, round(m.tau2, 6) + 0 as tau2,
      round(case when n.tau2 > 0 then greatest(0, 1 - m.tau2 / n.tau2) else 0 end, 6) + 0 as r2,
      round(m.tau2 / (m.tau2 + q_df / tr), 6) + 0 as i2_resid, round(q, 6) as q,
      round({chi2_p_sql("q", "q_df")}, 6) + 0 as q_p, round(power(slope / slope_se, 2), 6) as fm,
      round({t_p_sql("slope / slope_se", "k - 2")}, 6) as fm_p, round(slope, 6) + 0 as slope,
      round(slope_se, 6) as slope_se, round({t_p_sql("slope / slope_se", "k - 2")}, 6) as slope_p
    from line l join zero z using (outcome) join mlast m using (outcome) join last n using (outcome)"""
)
def metareg_reml(spark, folder):
    rows = settled(_smd(spark, folder))
    none = pooling.random_effects(rows, method="REML")
    fits = pooling.explained(
        pooling.random_effects(rows, moderators=["mod_quantity"], method="REML"), none
    )
    nums = ["tau2", "r2", "i2_resid", "q", "q_p", "fm", "fm_p"]
    second = F.lit(1)
    return fits.select(
        "outcome", "k", *[rounded(c, 6).alias(c) for c in nums],
        rounded(F.get("estimate", second), 6).alias("slope"),
        rounded(F.get("std_error", second), 6).alias("slope_se"),
        rounded(F.get("p_value", second), 6).alias("slope_p"),
    )


@analysis()
def metareg_ml(spark, folder):
    mods = ["mod_quantity", "mod_discount"]
    fits = pooling.random_effects(_smd(spark, folder), moderators=mods, method="ML")
    out = pooling.coefficient_rows(fits, ["intercept", *mods])
    nums = ["tau2", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
    return out.select("outcome", "term", *[rounded(c, 5).alias(c) for c in nums])


@analysis(
    f"""with recursive {ARMS} {_METAREG}
    select outcome, study, round(x, 6) as mod_quantity, round(yi, 6) + 0 as yi,
      round(100 * w / sw, 6) as weight_pct, round(a + slope * x, 6) + 0 as fitted
    from fitted join line using (outcome)"""
)
def bubble(spark, folder):
    rows = settled(_smd(spark, folder))
    fits = pooling.random_effects(rows, moderators=["mod_quantity"], method="REML")
    out = pooling.bubble_rows(rows, fits, "mod_quantity")
    return out.select(
        *_KEYS, *[rounded(c, 6).alias(c) for c in ("mod_quantity", "yi", "weight_pct", "fitted")]
    )


@analysis(
    f"""with recursive {ARMS} {_METAREG},
    span as (select outcome, min(x) as lo, max(x) as hi from fitted group by 1)
    select outcome, round(lo + j * (hi - lo) / 19, 6) as mod_quantity,
      round(a + slope * (lo + j * (hi - lo) / 19), 6) + 0 as fitted
    from span join line using (outcome), range(20) r(j)"""
)
def bubble_line(spark, folder):
    rows = settled(_smd(spark, folder))
    fits = pooling.random_effects(rows, moderators=["mod_quantity"], method="REML")
    out = pooling.bubble_line(rows, fits, "mod_quantity")
    return out.select("outcome", *[rounded(c, 6).alias(c) for c in ("mod_quantity", "fitted")])


@analysis()
def lrt(spark, folder):
    rows = settled(_smd(spark, folder))
    small = pooling.random_effects(rows, moderators=["mod_quantity"], method="ML")
    large = pooling.random_effects(
        rows, moderators=["mod_quantity", "mod_discount"], method="ML"
    )
    out = pooling.likelihood_ratio(small, large)
    nums = ["loglik_small", "loglik_large", "aic_small", "aic_large", "bic_small", "bic_large",
            "lrt", "lrt_p"]
    return out.select("outcome", "lrt_df", *[rounded(c, 6).alias(c) for c in nums])

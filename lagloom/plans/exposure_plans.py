"""Exposure tables, series, bases and cross-bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.functions import dates
from lagloom.models.basis import BasisSpec, fit_basis, lag_basis
from lagloom.models.crossbasis import CrossBasis, crossbasis, history_cells
from lagloom.operators import exposure
from lagloom.operators.scans import exact_percentiles
from lagloom.plans import fixtures as fx
from lagloom.plans.cohort_plans import histories
from lagloom.plans.registry import analysis, rounded
from lagloom.plans.sql_text import (
    BIRTHS,
    DAILY,
    VISITS,
    bspline,
    floor_week,
    natural_two_knots,
)

_P = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@analysis(
    f"""with {BIRTHS}, q as (select area, """
    + ", ".join(f"quantile_cont(x, {p}) as {n}" for n, p in _P.items())
    + """ from area_daily group by 1)
    select area, """
    + ", ".join(f"round({n}, 8) as {n}" for n in _P)
    + """, round(p90 - p50, 8) as d90, round(p95 - p50, 8) as d95, round(p99 - p50, 8) as d99
    from q"""
)
def area_percentiles(spark, folder):
    q = exact_percentiles(fx.area_daily(spark, folder), ["area"], "x", _P)
    return q.select(
        "area",
        *[rounded(n, 8).alias(n) for n in _P],
        *[rounded(F.col(f"p{k}") - F.col("p50"), 8).alias(f"d{k}") for k in (90, 95, 99)],
    )


_WEEKLY = f"""{BIRTHS},
  weekly as (select area, {floor_week('day')} as week, avg(x) as exposure, count(x) as n_days
             from area_daily group by 1, 2)"""


@analysis(
    f"""with {_WEEKLY} select area, cast(week as varchar) as week, round(exposure, 10) as exposure,
    n_days from weekly"""
)
def weekly_exposure(spark, folder):
    w = exposure.weekly_exposure(fx.area_daily(spark, folder), "area", "day", "x")
    return w.select("area", dates.iso("week").alias("week"),
                    rounded("exposure", 10).alias("exposure"), "n_days")


@analysis(
    f"""with {_WEEKLY} select l_orderkey, l_linenumber, round(exposure, 10) as exposure
    from eligible b left join weekly w on w.area = b.area and w.week = {floor_week('birth')}"""
)
def assigned_exposure(spark, folder):
    weekly = exposure.weekly_exposure(fx.area_daily(spark, folder), "area", "day", "x")
    b = fx.eligible_births(spark, folder).withColumn("week", dates.floor_date("birth"))
    out = exposure.assign_exposure(b, weekly, ["area", "week"], "exposure")
    return out.select("l_orderkey", "l_linenumber", rounded("exposure", 10).alias("exposure"))


def births_with_window(spark, folder):
    return exposure.window_exposure(
        fx.eligible_births(spark, folder), fx.area_daily(spark, folder), "area", "birth", "day", "x"
    )


@analysis(
    f"""with {BIRTHS},
    spots as (select distinct area, birth from eligible),
    m as (select s.area, s.birth, avg(x) as window_mean, count(x) as window_days
          from spots s left join area_daily a on a.area = s.area
           and a.day between s.birth - 6 and s.birth group by 1, 2)
    select l_orderkey, l_linenumber, round(window_mean, 10) as window_mean, window_days
    from eligible b join m on m.area = b.area and m.birth = b.birth"""
)
def window_exposure(spark, folder):
    return births_with_window(spark, folder).select(
        "l_orderkey", "l_linenumber", rounded("window_mean", 10).alias("window_mean"),
        "window_days",
    )


@analysis(
    f"""with {DAILY} select cast(day as varchar) as day, y, round(x, 11) as x, round(z, 8) as z,
    time, dow from daily"""
)
def daily_complete(spark, folder):
    d = fx.daily(spark, folder)
    return d.select(dates.iso("day").alias("day"), "y", rounded("x", 11).alias("x"),
                    rounded("z", 8).alias("z"), "time", "dow")


@analysis(
    f"""with {BIRTHS}, s as (select area, count(*) as n_rows, count(distinct birth) as n_days,
      max(birth) - min(birth) + 1 as span_days from births group by 1)
    select area, n_rows, n_days, span_days, span_days - n_days as missing_days,
    n_rows - n_days as repeated_days, 0::bigint as null_values from s"""
)
def series_gaps(spark, folder):
    return exposure.series_check(fx.births(spark, folder), ["area"], "birth", ["discount"])


@analysis(
    f"""with {DAILY}, present as (select day, lag(day) over (order by day) as prev
      from per_day)
    select cast(prev + 1 as varchar) as gap_start, cast(day - 1 as varchar) as gap_end,
    day - prev - 1 as gap_days from present where day - prev > 1"""
)
def gap_list(spark, folder):
    days = fx.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"))
    g = exposure.gap_list(days, "day")
    return g.select(dates.iso("gap_start").alias("gap_start"), dates.iso("gap_end").alias("gap_end"),
                    "gap_days")


def _basis_rows(spark, folder, spec: BasisSpec):
    d = fx.daily(spark, folder).select("day", "x")
    b = fit_basis(d, "x", spec)
    rows = d.withColumn("b", b.column("x"))
    return rows.select(
        dates.iso("day").alias("day"),
        *[rounded(F.get("b", F.lit(i)), 11).alias(f"b{i + 1}") for i in range(b.width)],
    )


def _basis_sql(columns: list[str], extra: str = "") -> str:
    listed = ", ".join(f"round({c}, 11) as b{i + 1}" for i, c in enumerate(columns))
    return f"with {DAILY} {extra} select cast(day as varchar) as day, {listed} from daily"


@analysis(
    _basis_sql(
        [f"power(x / (select max(abs(x)) from daily), {d})" for d in range(1, 7)]
    )
)
def basis_poly(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("poly", degree=6))


_LIN = _basis_sql(["x"])


@analysis(_LIN)
def basis_lin(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("lin"))


_HIGH = "case when x is null then null when x > 25 then x - 25 else 0 end"
_LOWER = "case when x is null then null when x < 25 then 25 - x else 0 end"


@analysis(_basis_sql([_HIGH]))
def basis_thr_high(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("thr", at=(25.0,), side="h"))


@analysis(_basis_sql([_LOWER, _HIGH]))
def basis_thr_double(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("thr", at=(25.0,), side="d"))


@analysis(
    _basis_sql(
        [
            "case when x is null then null when x >= 20 and x < 30 then 1.0::double else 0 end",
            "case when x is null then null when x >= 30 then 1.0::double else 0 end",
        ]
    )
)
def basis_strata(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("strata", breaks=(20.0, 30.0)))


_KNOTS = """, k as (select min(x) as lo, max(x) as hi,
  quantile_cont(x, 0.25) as k1, quantile_cont(x, 0.5) as k2, quantile_cont(x, 0.75) as k3,
  quantile_cont(x, 1.0::double / 3) as t1, quantile_cont(x, 2.0::double / 3) as t2 from daily)"""


def _with_knots(columns: list[str]) -> str:
    listed = ", ".join(
        f"case when x is not null then round({c}, 11) + 0.0::double end as b{i + 1}"
        for i, c in enumerate(columns)
    )
    return (
        f"with {DAILY} {_KNOTS} select cast(day as varchar) as day, {listed} "
        "from daily cross join k"
    )


@analysis(_with_knots(bspline("x", ["lo"] * 4 + ["k1", "k2", "k3"] + ["hi"] * 4, 3)[1:]))
def basis_bs(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("bs", df=6, degree=3))


@analysis(_with_knots(bspline("x", ["lo"] * 3 + ["t1", "t2"] + ["hi"] * 3, 2)[1:]))
def basis_bs_quadratic(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("bs", df=4, degree=2))


@analysis(_with_knots(natural_two_knots("x", "t1", "t2", "lo", "hi")))
def basis_ns(spark, folder):
    return _basis_rows(spark, folder, BasisSpec("ns", df=3))


def _design_columns(width: int, digits: int = 10):
    return [rounded(F.get("cb", F.lit(i)), digits).alias(f"c{i + 1}") for i in range(width)]


def _lagged(source: str, keys: str, values: list[str], weights: list[str], max_lag: int) -> str:
    """Design by a self join on the lag, for complete windows only."""
    on = " and ".join(["b.time = a.time - k", *([f"b.{keys} = a.{keys}"] if keys else [])])
    listed = ", ".join(
        f"round(sum(({v}) * ({w})), 10) as c{i * len(weights) + j + 1}"
        for i, v in enumerate(values)
        for j, w in enumerate(weights)
    )
    key = f"a.{keys}, " if keys else ""
    return (
        f"select {key}a.time, {listed} from {source} a join range({max_lag + 1}) t(k) on true "
        f"join {source} b on {on} group by {key}a.time "
        f"having count(b.x) = {max_lag + 1}"
    )


@analysis(
    f"with {DAILY} "
    + _lagged(
        "daily", "",
        ["case when b.x > 25 then b.x - 25 else 0 end"],
        ["case when k < 2 then 1 else 0 end", "case when k >= 2 and k < 6 then 1 else 0 end",
         "case when k >= 6 then 1 else 0 end"],
        10,
    )
)
def crossbasis_series(spark, folder):
    d = fx.daily(spark, folder).select("time", "x")
    cb = crossbasis(
        d, "x", 10, BasisSpec("thr", at=(25.0,), side="h"), BasisSpec("strata", breaks=(2, 6))
    )
    rows = cb.on_series(d, "time", "x", block=256).where("cb is not null")
    return rows.select("time", *_design_columns(cb.width))


_SEGMENTS = """
  seg as (
    select c_mktsegment as segment, cast(o_orderdate as date) as day,
           avg(o_totalprice) / 10000 as x
    from orders join customer on c_custkey = o_custkey group by 1, 2),
  series as (select segment, day - (select min(day) from seg) as time, x from seg)"""


def segment_series(spark, folder):
    """Daily exposure of each market segment, unrelated series with gaps."""
    orders = fx.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"), "o_totalprice"
    )
    customer = fx.table(spark, folder, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment")
    )
    seg = orders.join(customer, "c_custkey").groupBy("segment", "day").agg(
        (F.avg("o_totalprice") / 10000).alias("x")
    )
    first = seg.agg(F.min("day").alias("d")).scalar()
    return seg.withColumn("time", F.datediff("day", first).cast("long"))


@analysis(
    f"with {_SEGMENTS}, top as (select max(abs(x)) as m from series) "
    + _lagged(
        "series", "segment",
        ["b.x / (select m from top)", "power(b.x / (select m from top), 2)"],
        ["1 - k / 5.0::double", "k / 5.0::double"],
        5,
    )
)
def crossbasis_grouped(spark, folder):
    s = segment_series(spark, folder)
    cb = crossbasis(s, "x", 5, BasisSpec("poly", degree=2), BasisSpec("ns", df=2))
    rows = cb.on_series(s, "time", "x", keys=["segment"]).where("cb is not null")
    return rows.select("segment", "time", *_design_columns(cb.width))


_NS = natural_two_knots("x", "t1", "t2", "lo", "hi")


@analysis(
    f"""with {VISITS},
    whole as (select subject from hist group by 1 having count(*) = {fx.HISTORY}),
    cells as (select h.* from hist h join whole w on w.subject = h.subject),
    k as (select min(x) as lo, max(x) as hi, quantile_cont(x, 1.0::double / 3) as t1,
          quantile_cont(x, 2.0::double / 3) as t2 from cells)
    select subject, """
    + ", ".join(
        f"round(sum({v} * ({w})), 10) as c{i * 2 + j + 1}"
        for i, v in enumerate(_NS)
        for j, w in enumerate(
            [f"1 - lag / {fx.HISTORY - 1}.0::double", f"lag / {fx.HISTORY - 1}.0::double"]
        )
    )
    + " from cells cross join k group by 1"
)
def crossbasis_history(spark, folder):
    h = histories(spark, folder).where("history_complete")
    var = fit_basis(history_cells(h), "x", BasisSpec("ns", df=3))
    lag = lag_basis(BasisSpec("ns", df=2), fx.HISTORY - 1)
    cb = CrossBasis(var, lag, fx.HISTORY - 1)
    return cb.on_histories(h).select("subject", *_design_columns(cb.width))


_CASES = """
  cases as (select distinct user_id, cast(ts as date) as day from events
            where event_type = 'error'),
  ev as (select cast(ts as date) as ref_day, avg(value) as exposure from events
         where event_type <> 'error' group by 1)"""


@analysis(
    f"""with {_CASES} select user_id, cast(day as varchar) as day,
    cast(e.ref_day as varchar) as ref_day, case when e.ref_day = day then 1 else 0 end as is_case,
    round(exposure, 8) as exposure
    from cases join ev e on date_trunc('month', e.ref_day) = date_trunc('month', day)
     and dayofweek(e.ref_day) = dayofweek(day)"""
)
def control_selection(spark, folder):
    sets = exposure.time_stratified_controls(fx.cases(spark, folder), "day")
    out = sets.join(fx.event_exposure(spark, folder), "ref_day")
    return out.select(
        "user_id", dates.iso("day").alias("day"), dates.iso("ref_day").alias("ref_day"),
        "is_case", rounded("exposure", 8).alias("exposure"),
    )


_WINDOWS = [("22-28", 22, 28), ("28-32", 28, 32), ("32-37", 32, 37), ("22-37", 22, 37)]


def births_followed(spark, folder, rows=None):
    """Births at risk per outcome window; a birth in completed week g ends at
    g + 1 on the weekly axis."""
    rows = fx.eligible_births(spark, folder) if rows is None else rows
    return exposure.followup_windows(rows, F.col("ga") + 1, _WINDOWS)


@analysis(
    f"""with {BIRTHS}, w(win, lo, hi) as (values {', '.join(f"('{n}', {a}, {b})" for n, a, b in _WINDOWS)})
    select win as "window", cast(lo as double) as entry, cast(least(ga + 1, hi) as double) as exit,
      case when ga + 1 <= hi then 1 else 0 end as event, count(*) as n
    from eligible join w on ga + 1 > lo group by 1, 2, 3, 4"""
)
def followup_windows(spark, folder):
    return births_followed(spark, folder).groupBy("window", "entry", "exit", "event").agg(
        F.count("*").alias("n")
    )

"""Cohort building, histories and survival tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.operators import survival
from lagloom.operators.clean import first_rows, group_size_filter, semi, wide
from lagloom.operators.cohort import bind_history, exposure_histories, history_long
from lagloom.operators.scans import in_order, numbered
from lagloom.plans import fixtures as fx
from lagloom.plans.registry import analysis, rounded
from lagloom.plans.sql_text import BIRTHS, SUBJECT, VISITS

L = fx.HISTORY


@analysis(f"with {SUBJECT} select o_custkey, n_periods, event, first_priority, region from subject")
def subject_summary(spark, folder):
    return fx.subjects(spark, folder).select(
        "o_custkey", "n_periods", "event", "first_priority", "region"
    )


@analysis(
    f"""with {SUBJECT} select n.o_custkey, o_orderkey, rn - 1 as lag from numbered n
    where rn <= {L} and o_custkey in (select o_custkey from subject)"""
)
def first_k_rows(spark, folder):
    rows = fx.person_period(spark, folder).select("o_custkey", "o_orderdate", "o_orderkey")
    kept = first_rows(rows, ["o_custkey"], fx.ORDER, L)
    return semi(kept, fx.subjects(spark, folder), "o_custkey").select(
        "o_custkey", "o_orderkey", "lag"
    )


@analysis(
    """select o_custkey, o_orderkey from orders where o_custkey in
    (select o_custkey from orders group by 1 having count(*) between 2 and 10)""",
    name="group_size_filter",
)
def group_size_filter_rows(spark, folder):
    rows = fx.person_period(spark, folder).select("o_custkey", "o_orderkey")
    return group_size_filter(rows, ["o_custkey"], 2, 10)


@analysis(f"with {SUBJECT} select o_custkey, o_orderkey, rn - 1 as lag from numbered")
def lag_index(spark, folder):
    rows = fx.person_period(spark, folder).select("o_custkey", "o_orderdate", "o_orderkey")
    month = F.trunc("o_orderdate", "quarter")
    return numbered(rows, ["o_custkey"], fx.ORDER, month).select("o_custkey", "o_orderkey", "lag")


@analysis(
    """select event_id, value, row_number() over (order by value desc, event_id) as position from events"""
)
def events_in_order(spark, folder):
    """All events from the largest value to the smallest, numbered."""
    rows = fx.table(spark, folder, "events").select("event_id", "value")
    return in_order(rows, [F.desc("value"), F.col("event_id")])


def histories(spark, folder, carry=()):
    return exposure_histories(
        fx.visits(spark, folder), "subject", ["place"], "exposure", L,
        min_rows=fx.LOW, max_rows=fx.HIGH, carry=carry,
    )


@analysis(
    f"with {VISITS} select subject, "
    + ", ".join(f"max(case when lag = {i} then round(x, 8) end) as lag{i}" for i in range(L))
    + " from hist group by 1"
)
def history_wide(spark, folder):
    cells = history_long(histories(spark, folder), "subject")
    out = wide(cells, "subject", "lag", "x", range(L), "lag")
    return out.select("subject", *[rounded(f"lag{i}", 8).alias(f"lag{i}") for i in range(L)])


@analysis(
    f"""with {VISITS} select s.subject, cast(i as bigint) as lag, round(x, 8) as x
    from (select distinct subject from hist) s cross join range({L}) t(i)
    left join hist h on h.subject = s.subject and h.lag = i""",
    name="history_long",
)
def history_long_rows(spark, folder):
    return history_long(histories(spark, folder), "subject").select(
        "subject", F.col("lag").cast("long").alias("lag"), rounded("x", 8).alias("x")
    )


@analysis(
    f"""with {VISITS} select subject, string_agg(cast(cast(round(x * 1000000) as bigint) as varchar),
    ',' order by lag) as history, case when count(*) = {L} then 1 else 0 end as complete
    from hist group by 1"""
)
def history_array(spark, folder):
    micro = F.transform("history", lambda v: F.round(v * 1000000).cast("long").cast("string"))
    return histories(spark, folder).select(
        "subject",
        F.array_join(micro, ",").alias("history"),
        F.col("history_complete").cast("long").alias("complete"),
    )


@analysis(
    f"""with {VISITS}, whole as (
      select subject, sum(x) as total from hist group by 1 having count(*) = {L})
    select s.subject, s.event, s.region, round(total, 8) as total
    from episode s join whole w on w.subject = s.subject"""
)
def history_bound(spark, folder):
    """Histories bound to their outcome rows by key."""
    whole = histories(spark, folder).where("history_complete")
    total = F.aggregate("history", F.lit(0.0), lambda s, v: s + v)
    return bind_history(whole, fx.episodes(spark, folder), "subject").select(
        "subject", "event", "region", rounded(total, 8).alias("total")
    )


_RISK = f"""{SUBJECT},
  cells as (select region, n_periods as time, count(*) as m, sum(event) as d
            from subject group by 1, 2),
  risk as (select *, sum(m) over (partition by region order by time desc) as n from cells)"""


@analysis(
    f"""with {_RISK}
    select region, time, cast(n as bigint) as n_risk, cast(d as bigint) as n_event,
           cast(m - d as bigint) as n_censor,
           round(exp(sum(ln(case when d < n then 1 - d::double / n else 1 end)) over w)
             * (case when max(case when d = n then 1 else 0 end) over w = 1 then 0 else 1 end), 8)
             as survival,
           case when max(case when d = n then 1 else 0 end) over w = 1 then null else round(
             exp(sum(ln(case when d < n then 1 - d::double / n else 1 end)) over w)
             * sqrt(sum(case when d < n then d::double / (n * (n - d)) else 0 end) over w), 8) end
             as std_err
    from risk window w as (partition by region order by time)"""
)
def km_by_region(spark, folder):
    table = survival.life_table(fx.subjects(spark, folder), "n_periods", "event", "region")
    return survival.kaplan_meier(table, "region").select(
        "region", "time", "n_risk", "n_event", "n_censor",
        rounded("survival", 8).alias("survival"), rounded("std_err", 8).alias("std_err"),
    )


@analysis(
    f"""with {_RISK}
    select region, time,
      case when max(case when d = n then 1 else 0 end) over w = 1 then null else
        round(-sum(ln(case when d < n then 1 - d::double / n else 1 end)) over w, 8) + 0 end
        as cumhaz,
      round(sum(d::double / n) over w, 8) as nelson_aalen
    from risk window w as (partition by region order by time)"""
)
def cumhaz_by_region(spark, folder):
    table = survival.life_table(fx.subjects(spark, folder), "n_periods", "event", "region")
    return survival.kaplan_meier(table, "region").select(
        "region", "time", rounded("cumhaz", 8).alias("cumhaz"),
        rounded("nelson_aalen", 8).alias("nelson_aalen"),
    )


@analysis(
    f"""with {SUBJECT}, breaks as (select unnest([2, 6, 10, 14, 18, 21]) as b)
    select region, cast(b as double) as time,
           sum(case when n_periods >= b then 1 else 0 end)::bigint as n_risk,
           sum(case when n_periods <= b and event = 1 then 1 else 0 end)::bigint as cum_events
    from subject cross join breaks group by 1, 2"""
)
def risk_table(spark, folder):
    return survival.risk_table(
        fx.subjects(spark, folder), "n_periods", "event", "region", [2, 6, 10, 14, 18, 21]
    )


_LOGRANK = f"""{SUBJECT},
  cells as (select region as g, n_periods as time, count(*) as m, sum(event) as d
            from subject group by 1, 2),
  grid as (select * from (select distinct g from cells) cross join
           (select distinct time from cells)),
  filled as (select grid.g, grid.time, coalesce(m, 0) as m, coalesce(d, 0) as d
             from grid left join cells c on c.g = grid.g and c.time = grid.time),
  risk as (select *, sum(m) over (partition by g order by time desc) as ng from filled),
  tot as (select time, sum(ng)::double as n, sum(d)::double as dd from risk group by 1
          having sum(d) > 0),
  rt as (select r.g, r.time, r.ng::double as ng, r.d, n, dd from risk r
         join tot on tot.time = r.time)"""


@analysis(
    f"""with {_LOGRANK},
    oe as (select g, sum(d)::bigint as observed, sum(ng * dd / n) as expected from rt group by 1)
    select a.g, b.g as h, any_value(observed) as observed, round(any_value(expected), 8) as expected,
           round(sum(case when a.n > 1 then a.dd * (a.n - a.dd) / (a.n - 1) else 0 end
             * a.ng / a.n * ((case when a.g = b.g then 1 else 0 end) - b.ng / b.n)), 8) + 0
             as covariance
    from rt a join rt b on a.time = b.time join oe on oe.g = a.g group by 1, 2"""
)
def logrank_region(spark, folder):
    parts = survival.logrank_parts(fx.subjects(spark, folder), "n_periods", "event", "region")
    return parts.select(
        "g", "h", F.col("observed").cast("long").alias("observed"),
        rounded("expected", 8).alias("expected"), rounded("covariance", 8).alias("covariance"),
    )


@analysis(
    f"""with {BIRTHS},
    cells as (select birth_type as g, ga as time, count(*) as m,
                sum(case when ga < 37 then 1 else 0 end) as d from eligible group by 1, 2),
    grid as (select * from (select distinct g from cells) cross join
             (select distinct time from cells)),
    filled as (select grid.g, grid.time, coalesce(m, 0) as m, coalesce(d, 0) as d
               from grid left join cells c on c.g = grid.g and c.time = grid.time),
    risk as (select *, sum(m) over (partition by g order by time desc) as ng from filled),
    tot as (select time, sum(ng)::double as n, sum(d)::double as dd from risk group by 1
            having sum(d) > 0),
    rt as (select r.g, r.time, r.ng::double as ng, r.d, n, dd,
             case when n > 1 then dd * (n - dd) / (n - 1) else 0 end as s
           from risk r join tot on tot.time = r.time),
    w as (select time, any_value(n) as n, any_value(s) as s,
            sum(case when g = 'A' then ng else 0 end) / any_value(n) as pa,
            sum(case when g = 'N' then ng else 0 end) / any_value(n) as pn,
            sum(case when g = 'A' then d - ng * dd / n else 0 end) as za,
            sum(case when g = 'N' then d - ng * dd / n else 0 end) as zn
          from rt group by 1),
    v as (select sum(za) as za, sum(zn) as zn, sum(s * pa * (1 - pa)) as vaa,
            sum(s * pn * (1 - pn)) as vnn, -sum(s * pa * pn) as van from w),
    t as (select (za * za * vnn - 2 * za * zn * van + zn * zn * vaa) / (vaa * vnn - van * van) as x
          from v)
    select round(x, 6) as statistic, 2::integer as df, round(exp(-x / 2), 8) as p_value from t"""
)
def logrank_birth_type(spark, folder):
    """Preterm birth by birth type: the test of three groups."""
    rows = fx.eligible_births(spark, folder).withColumn("event", (F.col("ga") < 37).cast("int"))
    out = survival.logrank_table(rows, "ga", "event", "birth_type")
    return out.select(
        rounded("statistic", 6).alias("statistic"), "df", rounded("p_value", 8).alias("p_value")
    )


@analysis(
    f"""with {SUBJECT}, c as (select n_periods as time, count(*) as m, sum(event) as d
      from subject group by 1),
    r as (select time, d::double as d, sum(m) over (order by time desc)::double as n from c),
    k as (select time, n, d, exp(sum(case when d < n then ln(1 - d / n) end)
        over (order by time)) as surv, max(case when d >= n then 1 else 0 end)
        over (order by time) as gone from r)
    select cast(time as double) as time, n::bigint as n_risk, d::bigint as n_event,
      round(case when gone = 1 then 0 else coalesce(surv, 1) end, 8) as survival from k"""
)
def km_all(spark, folder):
    """The curve of all subjects together."""
    table = survival.life_table(fx.subjects(spark, folder), "n_periods", "event")
    return survival.kaplan_meier(table).select(
        F.col("time").cast("double").alias("time"), F.col("n_risk").cast("long").alias("n_risk"),
        F.col("n_event").cast("long").alias("n_event"), rounded("survival", 8).alias("survival"),
    )

"""SQL pieces shared by the comparison texts."""

from __future__ import annotations

EVENT = "(o_orderpriority = '1-URGENT' and o_orderstatus = 'F')"

SUBJECT = f"""
  numbered as (
    select o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_totalprice / 10000 as exposure,
           case when {EVENT} then 1 else 0 end as ev,
           row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn
    from orders),
  subj as (
    select n.o_custkey, count(*) as n_periods, max(ev) as event,
           max(case when rn = 1 then o_orderpriority end) as first_priority
    from numbered n group by n.o_custkey having count(*) between 2 and 21),
  subject as (
    select s.*, r_name as region, c_mktsegment as segment, c_acctbal as balance
    from subj s join customer on c_custkey = o_custkey
    join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"""

VISITS = """
  visit as (
    select user_id * 1000000 + (rn - 1) // 21 as subject, user_id, (rn - 1) % 21 as lag, value as x,
           event_type, case when event_type = 'error' and value >= 50 then 1 else 0 end as ev
    from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events)),
  episode0 as (
    select subject, any_value(user_id) as user_id, count(*) as n_rows, max(ev) as event,
           coalesce(min(case when ev = 1 then lag + 1 end), count(*)) as n_periods,
           max(case when lag = 0 then event_type end) as first_type
    from visit group by subject),
  episode as (
    select e.*, r_name as region, c_mktsegment as segment, c_acctbal as balance
    from episode0 e join customer on c_custkey = user_id
    join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
    where n_periods >= 2),
  hist as (select subject, lag, x from visit
           where subject in (select subject from episode0 where n_rows between 2 and 21))"""

DAILY = """
  per_day as (
    select cast(o_orderdate as date) as day, count(*) as y0, avg(o_totalprice) / 10000 as x,
           max(o_totalprice) / 10000 as z
    from orders group by 1),
  ends as (select min(day) as a, max(day) as b from per_day),
  calendar as (
    select cast(a + cast(i as integer) as date) as day, a from ends,
           range(0, (select b - a + 1 from ends)) t(i)),
  daily as (
    select c.day, coalesce(y0, 0) as y, x, z, c.day - a + 1 as time, dayofweek(c.day) + 1 as dow
    from calendar c left join per_day p on p.day = c.day)"""

BIRTHS = """
  births as (
    select l_orderkey, l_linenumber, l_quantity as ga, cast(l_shipdate as date) as birth,
           cast(s_nationkey as bigint) as area, l_linestatus as sex, l_returnflag as birth_type,
           l_extendedprice as price, l_discount as discount, l_tax as tax
    from lineitem join supplier on s_suppkey = l_suppkey),
  eligible as (select * from births where ga > 22 and ga <= 44),
  area_daily as (
    select area, birth as day, avg(discount) as x from births group by area, birth)"""

PRETERM = """case when ga < 28 then 'extremely' when ga < 32 then 'very'
              when ga < 37 then 'moderately' else 'term' end"""

SEASON = """case when month(birth) in (12, 1, 2) then 'December-February'
             when month(birth) in (3, 4, 5) then 'March-May'
             when month(birth) in (6, 7, 8) then 'June-August'
             else 'September-November' end"""

ARMS = """
  arms as (
    select p_type as outcome, cast(s_nationkey as bigint) as study, l_linestatus as arm,
           count(*) as n, avg(l_extendedprice) as mean, stddev_samp(l_extendedprice) as sd,
           sum(case when l_returnflag = 'R' then 1 else 0 end) as event,
           sum(l_quantity) as time, sum(l_discount) as s_discount,
           corr(l_quantity, l_extendedprice) as cor
    from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
    group by 1, 2, 3),
  studies as (
    select e.outcome, e.study, e.n as n_e, e.mean as mean_e, e.sd as sd_e, e.event as event_e,
           e.time as time_e, c.n as n_c, c.mean as mean_c, c.sd as sd_c, c.event as event_c,
           c.time as time_c, (e.s_discount + c.s_discount) / (e.n + c.n) as mod_discount,
           (e.time + c.time) / (e.n + c.n) as mod_quantity
    from arms e join arms c on e.outcome = c.outcome and e.study = c.study
    where e.arm = 'O' and c.arm = 'F' and e.n >= 2 and c.n >= 2),
  smd0 as (
    select *, n_e + n_c as nn,
           sqrt(((n_e - 1) * sd_e * sd_e + (n_c - 1) * sd_c * sd_c) / (n_e + n_c - 2)) as sp
    from studies),
  smd1 as (select *, (1 - 3.0::double / (4 * nn - 9)) * (mean_e - mean_c) / sp as yi from smd0),
  smd as (
    select *, nn::double / (n_e * n_c) + yi * yi / (2 * (nn - 3.94::double)) as vi from smd1)"""


def floor_week(d: str) -> str:
    """Sunday on or before a date."""
    return f"cast(date_trunc('week', {d} + 1) as date) - 1"


def bspline(x: str, knots: list[str], degree: int) -> list[str]:
    """The B-spline recursion as text. Equal knot names are repeated knots; the
    last name closes the top interval."""
    top = knots[-1]
    level = []
    for i in range(len(knots) - 1):
        if knots[i] == knots[i + 1]:
            level.append(None)
            continue
        right = "<=" if knots[i + 1] == top else "<"
        level.append(
            f"(case when {x} >= {knots[i]} and {x} {right} {knots[i + 1]} then 1.0::double "
            "else 0 end)"
        )
    for k in range(1, degree + 1):
        nxt = []
        for i in range(len(knots) - 1 - k):
            parts = []
            if level[i] is not None and knots[i] != knots[i + k]:
                parts.append(f"({x} - {knots[i]}) / ({knots[i + k]} - {knots[i]}) * {level[i]}")
            if level[i + 1] is not None and knots[i + 1] != knots[i + k + 1]:
                parts.append(
                    f"({knots[i + k + 1]} - {x}) / ({knots[i + k + 1]} - {knots[i + 1]}) "
                    f"* {level[i + 1]}"
                )
            nxt.append("(" + " + ".join(parts) + ")" if parts else None)
        level = nxt
    return level


def natural_two_knots(x: str, k1: str, k2: str, lo: str, hi: str) -> list[str]:
    """Natural cubic splines with two inner knots and no intercept: of the five
    B-spline columns two are replaced through the zero-curvature conditions."""
    b = bspline(x, [lo] * 4 + [k1, k2] + [hi] * 4, 3)
    third = f"(6 / (({k1} - {lo}) * ({k2} - {lo})))"
    second = f"(-(6 / (({k1} - {lo}) * ({k1} - {lo})) + {third}))"
    fourth = f"(6 / (({hi} - {k2}) * ({hi} - {k1})))"
    last = f"(6 / (({hi} - {k2}) * ({hi} - {k2})))"
    fifth = f"(-({last} + {fourth}))"
    return [
        f"({b[1]} - {second} / {third} * {b[2]})",
        f"({b[4]} - {fifth} / {fourth} * {b[3]})",
        f"({b[5]} - {last} / {fourth} * {b[3]})",
    ]


def simpson(f: str, x: str, to: str, steps: int = 600) -> str:
    """Integral of the SQL expression `f` of the lambda variable `x` from 0 to
    `to`, by Simpson's rule."""
    h = f"(({to}) / {steps}.0::double)"
    inner = f.replace(f"@{x}", f"(i * {h})")
    weight = f"(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"(list_sum(list_transform(range({steps + 1}), lambda i: {weight} * ({inner}))) * {h} / 3)"


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of Student t: an integral over the angle atan(t / sqrt(df))."""
    scale = f"(2 / sqrt(pi()) * exp(lgamma((({df}) + 1) / 2.0::double) - lgamma(({df}) / 2.0::double)))"
    area = simpson(f"power(cos(@x), ({df}) - 1)", "x", f"atan(abs({t}) / sqrt({df}))")
    return f"greatest(0, 1 - {scale} * {area})"


def chi2_p_sql(q: str, df: str) -> str:
    """Upper tail of chi-square, as an integral over the root of x."""
    area = simpson(f"power(@x, ({df}) - 1) * exp(-@x * @x / 2)", "x", f"sqrt({q})")
    return f"greatest(0, 1 - {area} / exp(lgamma(({df}) / 2.0::double) + ln(2) * (({df}) / 2.0::double - 1)))"


def normal_p_sql(z: str) -> str:
    """Two-sided p of a normal deviate."""
    return f"greatest(0, 1 - sqrt(2 / pi()) * {simpson('exp(-@x * @x / 2)', 'x', f'abs({z})')})"


def newton_one_sql(rows: str, steps: int, having: str = "true") -> str:
    """Cox fits of one column x by unrolled Newton steps, ties after Efron, from
    counted risk sets risk(model, time, d, ex, x, e, n)."""
    parts = [rows, "b0 as (select distinct model, 0::double as b from r)"]
    mean = lambda j: f"(s{j} - k / d * d{j})"
    for i in range(steps + 1):
        parts.append(f"""t{i} as materialized (select model, time, any_value(d)::double as d, any_value(ex) as ex,
    sum(n * exp(b * x)) as s0, sum(n * x * exp(b * x)) as s1, sum(n * x * x * exp(b * x)) as s2,
    sum(n * e * exp(b * x)) as d0, sum(n * e * x * exp(b * x)) as d1, sum(n * e * x * x * exp(b * x)) as d2
  from risk join b{i} using (model) where {having} group by all),
g{i} as materialized (select model, sum(ex / d - {mean(1)} / {mean(0)}) as u,
    sum({mean(2)} / {mean(0)} - {mean(1)} * {mean(1)} / {mean(0)} / {mean(0)}) as v
  from (select *, unnest(range(d::bigint)) as k from t{i}) group by model),
b{i + 1} as materialized (select model, b + u / v as b, 1 / v as var from b{i} join g{i} using (model))""")
    return "with " + ", ".join(parts)

"""Counts, histograms, descriptive and cross tables, cleaning and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.functions import dates, factors, text
from lagloom.operators import clean, describe
from lagloom.plans import fixtures as fx
from lagloom.plans.registry import analysis, rounded
from lagloom.plans.sql_text import BIRTHS, PRETERM, SEASON, floor_week, normal_p_sql, t_p_sql

_WEEK = floor_week("cast(ts as date)")


@analysis(
    f"""select event_type as hospital, cast({_WEEK} as varchar) as week, count(*) as n
    from events group by 1, 2"""
)
def weekly_counts(spark, folder):
    counted = describe.counts_by_period(fx.linelist(spark, folder), ["hospital"], "date_onset")
    return counted.dropna(subset=["week"]).withColumn("week", dates.iso("week"))


@analysis("select event_type as hospital, count(*) as n from events group by 1")
def category_counts(spark, folder):
    return describe.counts_by(fx.linelist(spark, folder), "hospital")


@analysis(
    f"""select event_type as hospital, cast({_WEEK} as varchar) as week, count(*) as n,
    case when event_type = 'purchase' then 1 else 0 end as is_highlighted
    from events group by 1, 2"""
)
def highlight_weekly(spark, folder):
    counted = describe.counts_by_period(fx.linelist(spark, folder), ["hospital"], "date_onset")
    marked = clean.highlight(
        counted.dropna(subset=["week"]), F.col("hospital") == "purchase"
    )
    return marked.withColumns(
        {"week": dates.iso("week"), "is_highlighted": F.col("is_highlighted").cast("int")}
    )


_BINS = """
  r as (select min(value) as lo, (max(value) - min(value)) / 30 as w from events),
  binned as (select event_type as hospital,
               greatest(0, least(cast(floor((value - lo) / w) as integer), 29)) as bin
             from events cross join r),
  bins as (select i as bin, lo + i * w as bin_start, lo + (i + 1) * w as bin_end
           from range(30) t(i) cross join r)"""


@analysis(
    f"""with {_BINS} select cast(b.bin as bigint) as bin, round(bin_start, 8) as bin_start,
    round(bin_end, 8) as bin_end, count(x.bin) as n
    from bins b left join binned x on x.bin = b.bin group by 1, 2, 3"""
)
def histogram(spark, folder):
    h = describe.histogram(fx.linelist(spark, folder), "age_years")
    return h.select(
        "bin", rounded("bin_start", 8).alias("bin_start"), rounded("bin_end", 8).alias("bin_end"),
        "n",
    )


_FACETS = f"""{_BINS},
  counted as (select h.hospital, b.bin, b.bin_start, count(x.bin) as n
              from (select distinct hospital from binned) h cross join bins b
              left join binned x on x.hospital = h.hospital and x.bin = b.bin
              group by 1, 2, 3)"""


@analysis(
    f"""with {_FACETS} select hospital, cast(bin as bigint) as bin, round(bin_start, 8) as bin_start,
    n, max(n) over (partition by hospital) as facet_peak from counted"""
)
def facet_histogram(spark, folder):
    h = describe.histogram(fx.linelist(spark, folder), "age_years", by=["hospital"])
    return describe.with_facet_peak(h, "hospital").select(
        "hospital", "bin", rounded("bin_start", 8).alias("bin_start"), "n", "facet_peak"
    )


@analysis(
    f"""with {_FACETS} select hospital, cast(bin as bigint) as bin, n,
    cast(sum(n) over (partition by bin) - n as bigint) as n_other from counted"""
)
def facet_shadow(spark, folder):
    h = describe.histogram(fx.linelist(spark, folder), "age_years", by=["hospital"])
    return describe.shadow_histogram(h, "hospital").select("hospital", "bin", "n", "n_other")


_BOX = """
  q as (select event_type as hospital, quantile_cont(value, 0.25) as q1,
               quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3
        from events group by 1)"""


@analysis(
    f"""with {_BOX},
    m as (select q.*, value, value between q1 - 1.5::double * (q3 - q1)
            and q3 + 1.5::double * (q3 - q1) as inside
          from events join q on hospital = event_type)
    select hospital, count(*) as n, round(any_value(q1), 6) as q1,
      round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
      min(case when inside then value end) as whisker_low,
      max(case when inside then value end) as whisker_high,
      count(*) filter (where not inside) as n_outliers
    from m group by 1"""
)
def box_summary(spark, folder):
    b = describe.box_summary(fx.linelist(spark, folder), "hospital", "age_years")
    return b.select(
        "hospital", "n", *[rounded(q, 6).alias(q) for q in ("q1", "median", "q3")],
        "whisker_low", "whisker_high", "n_outliers",
    )


@analysis(
    f"""with {_BOX} select event_id, hospital, value as age_years from events
    join q on hospital = event_type
    where value < q1 - 1.5::double * (q3 - q1) or value > q3 + 1.5::double * (q3 - q1)"""
)
def box_outliers(spark, folder):
    out = describe.box_outliers(fx.linelist(spark, folder), "hospital", "age_years")
    return out.select("event_id", "hospital", "age_years")


@analysis(
    f"""with {_BOX},
    r as (select min(value) as lo, max(value) as hi, (max(value) - min(value)) / 512 as w from events),
    s as (select event_type as hospital, count(*) as n, stddev_samp(value) as sd
          from events group by 1),
    bw as (select s.hospital, n, 0.9::double * power(n, -0.2::double)
             * (case when q3 > q1 then least(sd, (q3 - q1) / 1.34::double) else sd end) as h
           from s join q on q.hospital = s.hospital),
    binned as (select event_type as hospital,
                 greatest(0, least(cast(floor((value - lo) / w) as integer), 511)) as bin,
                 count(*) as c from events cross join r group by 1, 2),
    grid as (select lo + i * (hi - lo) / 63 as x from range(64) t(i) cross join r),
    cells as (select hospital, (lo + bin * w + lo + (bin + 1) * w) / 2 as m, c
              from binned cross join r)
    select cells.hospital, round(x, 6) as x,
      round(sum(c * exp(-0.5::double * power((x - m) / h, 2))) / (any_value(n) * any_value(h)
        * sqrt(2 * pi())), 8) as density
    from cells join bw on bw.hospital = cells.hospital cross join grid
    group by cells.hospital, x"""
)
def density_grid(spark, folder):
    d = describe.density(fx.linelist(spark, folder), "hospital", "age_years")
    return d.select("hospital", rounded("x", 6).alias("x"), rounded("density", 8).alias("density"))


@analysis("select event_id, event_type as hospital, value as age_years from events where value is not null")
def scatter_points(spark, folder):
    return describe.scatter_points(
        fx.linelist(spark, folder), "event_id", ["hospital", "age_years"]
    )


@analysis(
    """select floor(l_quantity / 5.0) * 5.0 as x, floor(l_extendedprice / 1000.0) * 1000.0 as y,
    count(*) as n from lineitem group by 1, 2"""
)
def scatter_binned(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return describe.binned_scatter(rows, F.col("l_quantity"), F.col("l_extendedprice"), 5.0, 1000.0)


@analysis(f"with {BIRTHS} select l_orderkey, l_linenumber, ga, area from eligible")
def births_excluded(spark, folder):
    return fx.eligible_births(spark, folder).select("l_orderkey", "l_linenumber", "ga", "area")


@analysis(f"with {BIRTHS} select l_orderkey, l_linenumber, {PRETERM} as class from eligible")
def preterm_class(spark, folder):
    return fx.eligible_births(spark, folder).select(
        "l_orderkey", "l_linenumber", fx.preterm().alias("class")
    )


@analysis(
    f"""with {BIRTHS} select l_orderkey, l_linenumber, {SEASON} as season,
    cast(birth - cast(ga * 7 as integer) as varchar) as conceived,
    month(birth - cast(ga * 7 as integer)) as conceived_month,
    year(birth - cast(ga * 7 as integer)) as conceived_year from births"""
)
def season(spark, folder):
    b = fx.births(spark, folder).withColumn("c", dates.conception_date("birth", "ga"))
    return b.select(
        "l_orderkey", "l_linenumber", dates.season("birth").alias("season"),
        dates.iso("c").alias("conceived"),
        F.month("c").cast("long").alias("conceived_month"),
        F.year("c").cast("long").alias("conceived_year"),
    )


_BANDS = """case when price is null then 'Missing' when price <= 24000 then '<=24k'
  when price <= 48000 then '24k-48k' when price <= 72000 then '48k-72k' else '>72k' end"""


def _band():
    return factors.classify(
        "price", [24000, 48000, 72000], ["<=24k", "24k-48k", "48k-72k", ">72k"],
        right=True, missing="Missing",
    )


@analysis(f"with {BIRTHS} select l_orderkey, l_linenumber, {_BANDS} as band from births")
def banded(spark, folder):
    return fx.births(spark, folder).select("l_orderkey", "l_linenumber", _band().alias("band"))


@analysis(
    f"""with {BIRTHS} select coalesce(nullif(birth_type, 'N'), 'Missing') as birth_type,
    count(*) as n from births group by 1"""
)
def missing_level(spark, folder):
    b = fx.births(spark, folder).withColumn("t", F.nullif("birth_type", F.lit("N")))
    return describe.counts_by(
        b.select(factors.missing_as_level("t").alias("birth_type")), "birth_type"
    )


@analysis(
    f"""with {BIRTHS}, c as (select {PRETERM} as class, count(*) as n from eligible group by 1)
    select class, n, round(100.0::double * n / sum(n) over (), 8) as percent from c"""
)
def class_prevalence(spark, folder):
    p = describe.prevalence(fx.eligible_births(spark, folder), fx.preterm(), "class")
    return p.select("class", "n", rounded("percent", 8).alias("percent"))


_VARS = f"""
  rows_ as (
    select 'sex' as variable, coalesce(sex, 'Missing') as level, {PRETERM} as class from eligible
    union all
    select 'birth_type', coalesce(nullif(birth_type, 'N'), 'Missing'), {PRETERM} from eligible
    union all select 'season', {SEASON}, {PRETERM} from eligible
    union all select 'band', {_BANDS}, {PRETERM} from eligible)"""


@analysis(
    f"""with {BIRTHS}, {_VARS},
    c as (select variable, level, class, count(*) as n from rows_ group by 1, 2, 3),
    p as (select *, 100.0::double * n / sum(n) over (partition by variable, class) as pct from c)
    select variable, level,
    """
    + ", ".join(
        f"coalesce(max(case when class = '{c}' then n end), 0) as n_{i}, "
        f"coalesce(max(case when class = '{c}' then round(pct, 8) end), 0) as pct_{i}"
        for i, c in enumerate(fx.PRETERM_CLASSES)
    )
    + " from p group by 1, 2"
)
def cross_table(spark, folder):
    out = describe.cross_table(
        fx.eligible_births(spark, folder),
        {
            "sex": F.col("sex"),
            "birth_type": F.nullif("birth_type", F.lit("N")),
            "season": dates.season("birth"),
            "band": _band(),
        },
        fx.preterm(),
        fx.PRETERM_CLASSES,
    )
    keep = [c for c in out.columns if not c.startswith("pct_")]
    return out.select(
        *keep, *[rounded(f"pct_{i}", 8).alias(f"pct_{i}") for i in range(4)]
    )


@analysis(
    f"""with {BIRTHS},
    scored as (
      select case when ga < 28 then 0 when ga < 32 then 1 when ga < 37 then 2 else 3 end as y, *
      from eligible),
    v as (
      select 'sex' as variable, case when sex = 'F' then 1 else 0 end as x, y from scored
      union all select 'season', (month(birth) % 12) // 3, y from scored
      union all select 'band', case when price <= 24000 then 0 when price <= 48000 then 1
                                    when price <= 72000 then 2 else 3 end, y from scored)
    , s as (select variable, count(*) as n, (count(*) - 1) * power(corr(x, y), 2) as statistic from v group by 1)
    select variable, n, round(statistic, 5) as statistic,
      round({normal_p_sql("sqrt(statistic)")}, 7) as p_value from s"""
)
def trend_stat(spark, folder):
    levels = ["<=24k", "24k-48k", "48k-72k", ">72k"]
    out = describe.trend_statistic(
        fx.eligible_births(spark, folder),
        {
            "sex": (F.col("sex") == "F").cast("int"),
            "season": factors.level_order(dates.season("birth"), dates.SEASONS) - 1,
            "band": factors.level_order(_band(), levels) - 1,
        },
        factors.level_order(fx.preterm(), fx.PRETERM_CLASSES) - 1,
    )
    return out.select("variable", "n", rounded("statistic", 5).alias("statistic"),
                      rounded("p_value", 7).alias("p_value"))


@analysis(
    f"""with {BIRTHS} select sex, count(price) as n, count(*) - count(price) as n_missing,
    round(avg(price), 4) as mean, round(stddev_samp(price), 4) as sd,
    round(min(price), 4) as min, round(max(price), 4) as max,
    round(quantile_cont(price, 0.5), 4) as median, round(quantile_cont(price, 0.25), 4) as q1,
    round(quantile_cont(price, 0.75), 4) as q3 from births group by 1"""
)
def descriptive_by_group(spark, folder):
    out = describe.summary_by(fx.births(spark, folder), ["sex"], "price")
    nums = ["mean", "sd", "min", "max", "median", "q1", "q3"]
    return out.select("sex", "n", "n_missing", *[rounded(c, 4).alias(c) for c in nums])


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@analysis(
    " union all ".join(
        f"""select '{c}' as "column", count(*) as n, count(*) - count({c}) as n_null,
        count(distinct {c}) as n_distinct, cast(min({c}) as varchar) as min,
        cast(max({c}) as varchar) as max from orders"""
        for c in _PROFILED
    )
)
def profile(spark, folder):
    rows = fx.table(spark, folder, "orders").select(*_PROFILED)
    return describe.profile(rows, distinct="exact").drop("type")


@analysis(
    """select column_, count(*) as n from (
       select 'lineitem' as column_, l_orderkey from lineitem) group by 1""",
    name="inspect_size",
)
def inspect_size(spark, folder):
    rows = fx.table(spark, folder, "lineitem").select(F.lit("lineitem").alias("column_"))
    return describe.counts_by(rows, "column_")


@analysis("select distinct l_returnflag, l_linestatus, l_quantity from lineitem")
def distinct_rows(spark, folder):
    return clean.distinct_rows(
        fx.table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"
    )


@analysis(
    """select count(*) filter (where l_returnflag <> 'N' and l_discount > 0) as kept,
    count(*) filter (where not (l_returnflag <> 'N' and l_discount > 0)) as dropped
    from lineitem"""
)
def complete_cases(spark, folder):
    rows = fx.table(spark, folder, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
    )
    return clean.complete_case_counts(rows, ["flag", "discount"])


@analysis(
    """select s_suppkey as supplier_key, trim(s_name) as s_name, s_acctbal as account_balance_percent
    from supplier"""
)
def clean_names(spark, folder):
    messy = fx.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias(" Supplier Key"),
        F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("S Name"),
        F.col("s_acctbal").alias("AccountBalance (%)"),
    )
    return clean.clean_text(clean.clean_names(messy))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@analysis(
    "select o_orderkey, "
    + ", ".join(
        f"case when o_orderpriority = '{p}' then 1.0::double else 0.0::double end as p{i}"
        for i, p in enumerate(_PRIORITIES[1:], 1)
    )
    + " from orders"
)
def indicator_coding(spark, folder):
    cols = factors.indicators("o_orderpriority", _PRIORITIES)
    return fx.table(spark, folder, "orders").select(
        "o_orderkey", *[c.alias(f"p{i}") for i, c in enumerate(cols, 1)]
    )


@analysis(
    """with c as (select p_brand, count(*) as n from part group by 1),
    r as (select *, row_number() over (order by n desc, p_brand) as rk from c)
    select case when rk <= 8 then r.p_brand else 'Other' end as brand, sum(n)::bigint as n
    from r group by 1"""
)
def lump_levels(spark, folder):
    part = fx.table(spark, folder, "part").select("p_brand")
    lumped = factors.lump_levels(part, "p_brand", 8).withColumnRenamed("p_brand", "brand")
    return describe.counts_by(lumped, "brand")


@analysis(
    """select lang, count(*) as n, count(*) filter (where regexp_matches(text, '[0-9]{4}'))
    as with_number, count(*) filter (where regexp_matches(text, '[Ll]icen[cs]e')) as with_license
    from documents group by 1"""
)
def text_match(spark, folder):
    return (
        fx.table(spark, folder, "documents").groupBy("lang").agg(
            F.count("*").alias("n"),
            F.count_if(text.str_detect("text", "[0-9]{4}")).alias("with_number"),
            F.count_if(text.str_detect("text", "[Ll]icen[cs]e")).alias("with_license"),
        )
    )


@analysis(
    """select page_id, nullif(regexp_extract(url, '[a-z0-9.-]+\\.(com|org|net)', 0), '') as host,
    nullif(regexp_extract(url, 'page=[0-9]+', 0), '') as page,
    'page ' || cast(page_id as varchar) as label from pages"""
)
def text_extract(spark, folder):
    return fx.table(spark, folder, "pages").select(
        "page_id",
        text.str_extract("url", r"[a-z0-9.-]+\.(com|org|net)").alias("host"),
        text.str_extract("url", "page=[0-9]+").alias("page"),
        text.label("page", F.col("page_id")).alias("label"),
    )


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@analysis(
    "with c as ("
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r, count(*) as n from lineitem"
        for i, a in enumerate(_CORR)
        for b in _CORR[i + 1 :]
    )
    + f") select a, b, round(r, 8) as r, n, round({t_p_sql('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')}, 7) as p_value from c"
)
def correlations(spark, folder):
    out = describe.correlations(fx.table(spark, folder, "lineitem"), _CORR)
    return out.withColumns({"r": rounded("r", 8), "p_value": rounded("p_value", 7)})

"""Counts, histograms, box and density tables, cross tables, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.dates import floor_date
from lagloom.functions.tails import normal_p, t_p
from lagloom.operators.scans import exact_percentiles


def profile(df: DataFrame, distinct: str | None = "approx") -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, min and max as
    text, from a single pass. `distinct` is 'approx', 'exact' or None."""
    fields = df.schema.fields
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [
            F.count_if(c.isNull()).alias(f"null{i}"),
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
        ]
        if distinct:
            count = F.approx_count_distinct(c) if distinct == "approx" else F.count_distinct(c)
            aggs.append(count.alias(f"distinct{i}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("n"),
            F.col(f"null{i}").alias("n_null"),
            (F.col(f"distinct{i}") if distinct else F.lit(None).cast("long")).alias("n_distinct"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
        )
        for i, f in enumerate(fields)
    ]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out if distinct else out.drop("n_distinct")


def counts_by_period(
    df: DataFrame, keys: Sequence[str], day: str, unit: str = "week", name: str = "week"
) -> DataFrame:
    """Rows per group and calendar unit; null groups and dates are kept."""
    return df.groupBy(*keys, floor_date(day, unit).alias(name)).agg(F.count("*").alias("n"))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def histogram(
    df: DataFrame,
    value: str,
    bins: int = 30,
    width: float | None = None,
    by: Sequence[str] = (),
    sparse: bool = False,
) -> DataFrame:
    """Equal-width histogram on breaks shared by all groups; the last bin holds
    the maximum. Empty bins are filled in unless `sparse`.

    The range is a scalar subquery over the same scan, so the query is two
    partial aggregates and no join of the rows."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*by, x.alias("_x"))
    ends = rows.agg(F.min("_x").alias("a"), F.max("_x").alias("b"))
    if width is None:
        breaks = ends.select(
            F.struct(
                F.col("a").alias("lo"),
                ((F.col("b") - F.col("a")) / bins).alias("w"),
                F.lit(bins).alias("k"),
            )
        )
    else:
        lo = F.floor(F.col("a") / width) * width
        count = (F.floor((F.col("b") - lo) / width) + 1).cast("int")
        breaks = ends.select(
            F.struct(lo.alias("lo"), F.lit(float(width)).alias("w"), count.alias("k"))
        )
    r = breaks.scalar()
    step = F.when(r["w"] > 0, r["w"]).otherwise(F.lit(1.0))
    raw = F.floor((F.col("_x") - r["lo"]) / step).cast("int")
    index = F.greatest(F.lit(0), F.least(raw, r["k"] - 1))
    counted = rows.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))
    if not sparse:
        # Fill from the counted table: groups are its keys, bins are 0..k-1.
        found = counted.groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m")
        )
        counted = found.withColumn("bin", F.explode(F.sequence(F.lit(0), r["k"] - 1))).select(
            *by, "bin", F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("n")
        )
    out = counted.withColumns(
        {
            "bin_start": r["lo"] + F.col("bin") * r["w"],
            "bin_end": r["lo"] + (F.col("bin") + 1) * r["w"],
        }
    )
    return out.select(*by, F.col("bin").cast("long").alias("bin"), "bin_start", "bin_end", "n")


def with_facet_peak(hist: DataFrame, facet: str) -> DataFrame:
    """Adds the largest count of each facet, the upper limit of a free axis."""
    return hist.withColumn("facet_peak", F.max("n").over(Window.partitionBy(facet)))


def shadow_histogram(hist: DataFrame, facet: str) -> DataFrame:
    """Each facet's bin count beside the count of all other groups."""
    total = hist.groupBy("bin").agg(F.sum("n").alias("_all"))
    return hist.join(total, "bin").withColumn("n_other", F.col("_all") - F.col("n")).drop("_all")


_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that treats null keys as equal."""
    renamed = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def box_summary(df: DataFrame, by: str, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends within `reach` interquartile ranges, and the
    number of rows beyond them."""
    rows = df.where(F.col(value).isNotNull()).select(by, value)
    boxes = exact_percentiles(rows, [by], value, _QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    marked = _on_keys(rows, boxes, [by]).withColumn(
        "_in",
        F.col(value).between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr),
    )
    return marked.groupBy(by).agg(
        F.count("*").alias("n"),
        *[F.first(q).alias(q) for q in _QUARTILES],
        F.min(F.when(F.col("_in"), F.col(value))).alias("whisker_low"),
        F.max(F.when(F.col("_in"), F.col(value))).alias("whisker_high"),
        F.count_if(~F.col("_in")).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, by: str, value: str, reach: float = 1.5) -> DataFrame:
    """The rows beyond the whiskers."""
    rows = df.where(F.col(value).isNotNull())
    boxes = exact_percentiles(rows, [by], value, {"_q1": 0.25, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    outside = (F.col(value) < F.col("_q1") - reach * iqr) | (
        F.col(value) > F.col("_q3") + reach * iqr
    )
    return _on_keys(rows, boxes, [by]).where(outside).drop("_q1", "_q3")


def density(
    df: DataFrame, by: str, value: str, points: int = 64, bins: int = 512
) -> DataFrame:
    """Gaussian kernel density per group on a shared grid.

    Rows are binned first; the kernel runs over at most `bins` counts per
    group. The bandwidth is 0.9 n^(-1/5) min(sd, IQR / 1.34)."""
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_x"))
    hist = histogram(rows, "_x", bins=bins, by=[by], sparse=True)
    quart = exact_percentiles(rows, [by], "_x", {"_q1": 0.25, "_q3": 0.75})
    spread = rows.groupBy(by).agg(F.count("*").alias("_n"), F.stddev_samp("_x").alias("_sd"))
    width = _on_keys(spread, quart, [by]).withColumn(
        "bandwidth",
        0.9
        * F.pow(F.col("_n"), F.lit(-0.2))
        * F.when(F.col("_q3") > F.col("_q1"), F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.34))
        .otherwise(F.col("_sd")),
    )
    mid = ((F.col("bin_start") + F.col("bin_end")) / 2).alias("m")
    # At most `bins` structs per group.
    cells = hist.groupBy(by).agg(F.collect_list(F.struct(mid, "n")).alias("_cells"))
    r = rows.agg(F.struct(F.min("_x").alias("a"), F.max("_x").alias("b"))).scalar()
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    at = _on_keys(cells, width, [by]).withColumn("_i", step)
    at = at.withColumn("x", r["a"] + F.col("_i") * (r["b"] - r["a"]) / (points - 1))
    kernel = F.aggregate(
        "_cells",
        F.lit(0.0),
        lambda acc, c: acc
        + c["n"] * F.exp(-0.5 * F.pow((F.col("x") - c["m"]) / F.col("bandwidth"), F.lit(2.0))),
    )
    norm = F.col("_n") * F.col("bandwidth") * F.sqrt(2 * F.pi())
    shape = F.when(F.col("bandwidth") > 0, kernel / norm)
    return at.select(by, "x", shape.alias("density"), "bandwidth")


def scatter_points(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """All complete rows for a scatter."""
    return df.dropna(subset=list(cols)).select(key, *cols)


def binned_scatter(df: DataFrame, x: Column, y: Column, width_x: float, width_y: float) -> DataFrame:
    """Counts of complete rows on a grid: what a scatter of any number of rows
    shows. Cells are closed on the left and named by their lower corner."""
    cell = [F.floor(v / w) * F.lit(float(w)) for v, w in ((x, width_x), (y, width_y))]
    return (
        df.where(x.isNotNull() & y.isNotNull())
        .groupBy(cell[0].alias("x"), cell[1].alias("y"))
        .agg(F.count("*").alias("n"))
    )


def correlations(df: DataFrame, cols: Sequence[str], na: str = "pairwise") -> DataFrame:
    """Pairwise Pearson r, n and the p value of no correlation for all column
    pairs, in one aggregate.

    `na='pairwise'` skips incomplete pairs; `na='propagate'` gives null for a
    pair with any missing value."""
    pairs = list(combinations(cols, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        if na == "propagate":
            r = F.when(F.bool_and(both), r)
        aggs += [r.alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    rows = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"),
            F.col(f"n{i}").alias("n"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    free = F.col("n") - 2
    t = F.abs("r") * F.sqrt(free / F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return out.withColumn("p_value", F.when((free > 0) & (F.abs("r") < 1), t_p(t, free)).when(free > 0, F.col("r") * 0))


def summary_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, missing, mean, sd, median and quartiles by group."""
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return _on_keys(base, exact_percentiles(df, by, value, _QUARTILES), list(by))


def prevalence(df: DataFrame, level: Column, name: str = "level") -> DataFrame:
    """n and percent of all rows per class."""
    counted = df.groupBy(level.alias(name)).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counted.withColumn("percent", 100.0 * F.col("n") / total)


def cross_table(
    df: DataFrame, variables: dict[str, Column], outcome: Column, classes: Sequence[str]
) -> DataFrame:
    """Many variables against the outcome classes: n and column percent per
    level, null as level 'Missing', one counting pass over the rows."""
    rows = df.select(
        outcome.alias("_class"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("variable"),
                        F.coalesce(c.cast("string"), F.lit("Missing")).alias("level"),
                    )
                    for n, c in variables.items()
                ]
            )
        ).alias("_v"),
    ).where(F.col("_class").isin(list(classes)))
    cells = rows.groupBy("_v.variable", "_v.level", "_class").agg(F.count("*").alias("n"))
    column = Window.partitionBy("variable", "_class")
    cells = cells.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(column))
    wide = (
        cells.groupBy("variable", "level")
        .pivot("_class", list(classes))
        .agg(F.first("n").alias("n"), F.first("pct").alias("pct"))
    )
    return wide.select(
        "variable",
        "level",
        *[
            part
            for i, c in enumerate(classes)
            for part in (
                F.coalesce(F.col(f"`{c}_n`"), F.lit(0)).cast("long").alias(f"n_{i}"),
                F.coalesce(F.col(f"`{c}_pct`"), F.lit(0.0)).alias(f"pct_{i}"),
            )
        ],
    )


def trend_statistic(
    df: DataFrame, variables: dict[str, Column], score: Column
) -> DataFrame:
    """Linear-by-linear association of each scored variable with the class
    score: (n - 1) r^2, chi-square with one degree of freedom, and its p value.

    The rows are counted per (variable, score pair) first; the statistic comes
    from those counts."""
    rows = df.select(
        score.cast("double").alias("_y"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("variable"), c.cast("double").alias("x"))
                    for n, c in variables.items()
                ]
            )
        ).alias("_v"),
    ).where("_y is not null and _v.x is not null")
    cells = rows.groupBy(
        F.col("_v.variable").alias("variable"), F.col("_v.x").alias("x"), "_y"
    ).agg(F.count("*").alias("n"))
    # About the means of each variable's counts, so that no digits cancel.
    means = cells.groupBy("variable").agg(
        (F.sum(F.expr("n * x")) / F.sum("n")).alias("_mx"), (F.sum(F.expr("n * _y")) / F.sum("n")).alias("_my")
    )
    sums = cells.join(means, "variable").groupBy("variable").agg(
        F.sum("n").alias("n"),
        F.sum(F.expr("n * (x - _mx) * (x - _mx)")).alias("sxx"),
        F.sum(F.expr("n * (_y - _my) * (_y - _my)")).alias("syy"),
        F.sum(F.expr("n * (x - _mx) * (_y - _my)")).alias("sxy"),
    )
    stat = F.when(
        (F.col("sxx") > 0) & (F.col("syy") > 0), F.expr("(n - 1) * sxy * sxy / (sxx * syy)")
    )
    out = sums.select("variable", "n", stat.alias("statistic"))
    return out.withColumn("p_value", normal_p(F.sqrt("statistic")))

"""Survival curves, risk tables and the log-rank test.

Rows are aggregated to (group, time) first; every later step works on those
time-level rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.operators.scans import running_sums


def life_table(
    df: DataFrame, time: str, event: str, by: str | None = None, bucket: Column | None = None
) -> DataFrame:
    """Per group and time: at risk, events, censored.

    Pass `bucket` (a column ascending with time) when time is continuous, so
    that a long axis is spread over tasks."""
    keys = [by] if by else []
    rows = df.dropna(subset=[time, event])
    counted = rows.groupBy(*keys, F.col(time).alias("time")).agg(
        F.count("*").alias("_n"),
        F.sum(F.col(event).cast("long")).alias("n_event"),
    )
    at_risk = running_sums(counted, keys, "time", {"n_risk": "_n"}, bucket, reverse=True)
    return at_risk.withColumn("n_censor", F.col("_n") - F.col("n_event")).drop("_n")


def kaplan_meier(table: DataFrame, by: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Survival with Greenwood standard error, minus-log-survival hazard and
    Nelson-Aalen hazard, from a life table."""
    keys = [by] if by else []
    rows = table.withColumns(
        {
            "_all": (F.col("n_event") == F.col("n_risk")).cast("long"),
            "_ln": F.when(
                F.col("n_event") < F.col("n_risk"),
                F.log1p(-F.col("n_event") / F.col("n_risk")),
            ).otherwise(0.0),
            "_gw": F.when(
                F.col("n_event") < F.col("n_risk"),
                F.col("n_event") / (F.col("n_risk") * (F.col("n_risk") - F.col("n_event"))),
            ).otherwise(0.0),
            "_na": F.col("n_event") / F.col("n_risk"),
        }
    )
    run = running_sums(
        rows,
        keys,
        "time",
        {"_dead": "_all", "_sln": "_ln", "_sgw": "_gw", "nelson_aalen": "_na"},
        bucket,
    )
    alive = F.col("_dead") == 0
    out = run.withColumns(
        {
            "survival": F.when(alive, F.exp("_sln")).otherwise(0.0),
            "std_err": F.when(alive, F.exp("_sln") * F.sqrt("_sgw")),
            "cumhaz": F.when(alive, -F.col("_sln") + 0.0),
        }
    )
    return out.select(
        *keys, "time", "n_risk", "n_event", "n_censor",
        "survival", "std_err", "cumhaz", "nelson_aalen",
    )


def risk_table(
    df: DataFrame, time: str, event: str, by: str, breaks: list[float]
) -> DataFrame:
    """Numbers still at risk and events so far at chosen times, one aggregate."""
    rows = df.dropna(subset=[time, event])
    t = F.col(time)
    aggs = []
    for i, b in enumerate(breaks):
        aggs += [
            F.count_if(t >= b).alias(f"r{i}"),
            F.count_if((t <= b) & (F.col(event) == 1)).alias(f"e{i}"),
        ]
    cells = [
        F.struct(
            F.lit(float(b)).alias("time"),
            F.col(f"r{i}").alias("n_risk"),
            F.col(f"e{i}").alias("cum_events"),
        )
        for i, b in enumerate(breaks)
    ]
    return (
        rows.groupBy(by).agg(*aggs).select(by, F.explode(F.array(*cells)).alias("c"))
        .select(by, "c.*")
    )


def logrank_parts(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Observed, expected and the covariance entries of the log-rank test:
    one row per group pair (g, h) with O and E of g and the covariance of both.

    At each time the groups' risk counts sit in one map, whose size is the
    number of groups, so pairs are formed from group counts only."""
    table = _grouped_risk(df, time, event, by)
    expected = F.expr("ng * d / n")
    scale = F.when(
        F.col("n") > 1,
        F.expr("d * (n - d) / (n - 1)"),
    ).otherwise(0.0)
    per_group = table.select(
        "time", "n", "d", F.explode("groups").alias("g")
    ).select("time", "n", "d", F.col("g.name").alias("g"), F.col("g.n").alias("ng"),
             F.col("g.d").alias("dg"))
    oe = per_group.groupBy("g").agg(
        F.sum("dg").alias("observed"), F.sum(expected).alias("expected")
    )
    same = table.select(
        F.explode("groups").alias("g"), scale.alias("_s"), "n", "groups"
    ).select("_s", "n", "g", F.explode("groups").alias("h"))
    share_g, share_h = F.col("g.n") / F.col("n"), F.col("h.n") / F.col("n")
    delta = (F.col("g.name") == F.col("h.name")).cast("double")
    cov = same.groupBy(F.col("g.name").alias("g"), F.col("h.name").alias("h")).agg(
        F.sum(F.col("_s") * share_g * (delta - share_h)).alias("covariance")
    )
    return cov.join(oe, "g").select("g", "h", "observed", "expected", "covariance")


def _grouped_risk(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Per event time: totals and each group's numbers at risk and dying.

    Group counts at times where a group has no row are carried by a running
    sum over (group, event time) cells, made from the list of groups."""
    rows = df.dropna(subset=[time, event, by]).groupBy(
        F.col(by).alias("name"), F.col(time).alias("time")
    ).agg(F.count("*").alias("m"), F.sum(F.col(event).cast("long")).alias("d"))
    names = rows.agg(F.array_sort(F.collect_set("name")).alias("all")).scalar()
    per_time = rows.groupBy("time").agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("m", "d")))).alias("_c")
    )
    cells = per_time.withColumn("name", F.explode(names)).select(
        "time",
        "name",
        F.coalesce(F.try_element_at("_c", F.col("name"))["m"], F.lit(0)).alias("m"),
        F.coalesce(F.try_element_at("_c", F.col("name"))["d"], F.lit(0)).alias("d"),
    )
    w = (
        Window.partitionBy("name").orderBy(F.desc("time"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    cells = cells.withColumn("n", F.sum("m").over(w))
    return (
        cells.groupBy("time")
        .agg(
            F.sum("n").alias("n"),
            F.sum("d").alias("d"),
            F.collect_list(F.struct("name", "n", "d")).alias("groups"),
        )
        .where("d > 0")
    )


def logrank_test(df: DataFrame, time: str, event: str, by: str) -> dict:
    """Chi-square statistic, degrees of freedom and p value. The covariance
    matrix has one row per group."""
    import numpy as np

    from lagloom.functions.tails import chi2_upper

    parts = logrank_parts(df, time, event, by).collect()
    groups = sorted({r.g for r in parts})
    pos = {g: i for i, g in enumerate(groups)}
    v = np.zeros((len(groups), len(groups)))
    z = np.zeros(len(groups))
    for r in parts:
        v[pos[r.g], pos[r.h]] = r.covariance
        z[pos[r.g]] = r.observed - r.expected
    k = len(groups) - 1
    stat = float(z[:k] @ np.linalg.solve(v[:k, :k], z[:k])) if k else 0.0
    return {"statistic": stat, "df": k, "p": float(chi2_upper(stat, k)) if k else 1.0}


def logrank_table(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """The log-rank test as one row: statistic, df, p_value."""
    test = logrank_test(df, time, event, by)
    return df.sparkSession.createDataFrame(
        [(test["statistic"], test["df"], test["p"])], "statistic double, df int, p_value double"
    )

"""Time series and exposure tables, exposure windows and control selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.dates import floor_date


def complete_calendar(df: DataFrame, day: str, fill_zero: Sequence[str] = ()) -> DataFrame:
    """A daily table with every day between its first and last present, a time
    index from 1 and the weekday (1 = Sunday). `df` has one row per day."""
    bounds = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias(day), F.col("a"))
    out = days.join(df, day, "left").withColumns(
        {
            "time": (F.datediff(day, "a") + 1).cast("long"),
            "dow": F.dayofweek(day).cast("long"),
        }
    )
    return out.drop("a").fillna(0, subset=list(fill_zero)) if fill_zero else out.drop("a")


def series_check(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Per series: rows, distinct days, span, missing days, repeated days and
    null values. A series is valid when all three defect counts are zero.

    Counting needs no ordering: a complete daily series has as many distinct
    days as its span."""
    per_day = df.groupBy(*keys, day).agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(v).isNull()).alias(f"_null_{v}") for v in values],
    )
    span = F.datediff(F.max(day), F.min(day)) + 1
    nulls = sum((F.sum(f"_null_{v}") for v in values), F.lit(0))
    return per_day.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_days"),
        span.cast("long").alias("span_days"),
        (span - F.count("*")).cast("long").alias("missing_days"),
        F.sum(F.col("_n") - 1).alias("repeated_days"),
        nulls.cast("long").alias("null_values"),
    )


def gap_list(df: DataFrame, day: str) -> DataFrame:
    """First and last missing day of every gap of a single daily series, which
    has at most one row per calendar day after `distinct`."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    step = df.select(day).distinct().withColumn("_prev", F.lag(day).over(w))
    return step.where(F.datediff(day, "_prev") > 1).select(
        F.date_add("_prev", 1).alias("gap_start"),
        F.date_sub(day, 1).alias("gap_end"),
        (F.datediff(day, "_prev") - 1).cast("long").alias("gap_days"),
    )


def weekly_exposure(daily: DataFrame, area: str, day: str, value: str) -> DataFrame:
    """Weekly mean of a daily exposure per area; weeks start on Sunday."""
    return daily.groupBy(area, floor_date(day).alias("week")).agg(
        F.avg(value).alias("exposure"), F.count(value).alias("n_days")
    )


def assign_exposure(
    persons: DataFrame, exposure: DataFrame, on: Sequence[str], value: str
) -> DataFrame:
    """Area-and-time exposure joined to persons at their place and time.

    No broadcast hint: Spark broadcasts the exposure table when its size is
    under the session limit and shuffles otherwise."""
    return persons.join(exposure.select(*on, value), list(on), "left")


def window_exposure(
    persons: DataFrame,
    daily: DataFrame,
    area: str,
    at: str,
    day: str,
    value: str,
    first: int = 0,
    last: int = 6,
) -> DataFrame:
    """Mean exposure over the days `first..last` before each person's date.

    The window is applied to the exposure table, which has one row per area and
    day: every daily value is sent forward to the dates it counts for and
    averaged there. Persons then need one equi join and are never multiplied."""
    target = F.explode(F.sequence(F.date_add(day, first), F.date_add(day, last)))
    windows = (
        daily.where(F.col(value).isNotNull())
        .select(area, target.alias(at), F.col(value).alias("_x"))
        .groupBy(area, at)
        .agg(F.avg("_x").alias("window_mean"), F.count("*").alias("window_days"))
    )
    return persons.join(windows, [area, at], "left").withColumn(
        "window_days", F.coalesce("window_days", F.lit(0).cast("long"))
    )


def time_stratified_controls(cases: DataFrame, case_day: str) -> DataFrame:
    """Each case with the days of its month that fall on its weekday; `is_case`
    marks its own day. At most five rows per case."""
    start = F.date_trunc("month", case_day).cast("date")
    # First day of the month with the weekday of the case.
    first = F.date_add(start, F.pmod(F.datediff(case_day, start), F.lit(7)))
    days = F.sequence(first, F.last_day(case_day), F.expr("interval 7 days"))
    return cases.withColumn("ref_day", F.explode(days)).withColumn(
        "is_case", (F.col("ref_day") == F.col(case_day)).cast("long")
    )


def followup_windows(
    df: DataFrame, end: Column, windows: Sequence[tuple[str, float, float]]
) -> DataFrame:
    """(entry, exit, event) rows for several outcome windows.

    A subject is at risk in the window (low, high] when its end is above `low`.
    An end inside the window is the event; a later end is censored at `high`.
    One row per subject and window entered."""
    table = F.array(
        *[
            F.struct(
                F.lit(n).alias("window"),
                F.lit(float(a)).alias("entry"),
                F.lit(float(b)).alias("upper"),
            )
            for n, a, b in windows
        ]
    )
    rows = df.withColumn("_end", end.cast("double")).withColumn("_w", F.explode(table))
    rows = rows.select("*", "_w.*").where(F.col("_end") > F.col("entry"))
    return rows.withColumns(
        {
            "exit": F.least("_end", "upper"),
            "event": (F.col("_end") <= F.col("upper")).cast("long"),
        }
    ).drop("_w", "_end", "upper")


def risk_cells(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: Column,
    windows: Sequence[tuple[str, int, int]],
) -> DataFrame:
    """Persons at risk in every step of the time axis of every outcome window:
    (window, keys, start, time, at_risk, events).

    A person that starts at `start` and ends at the whole number `end` is at
    risk at the times low + 1 to min(end, high) of each window (low, high] with
    end > low; the event is at `end` if that is inside, later ends are censored.
    A covariate that changes with time is a function of `start` and `time`, so
    episodes need no row per person: persons are counted by (keys, start, end)
    first, and only those counts are split into times."""
    table = F.array(
        *[
            F.struct(F.lit(n).alias("window"), F.lit(int(a)).alias("_low"), F.lit(int(b)).alias("_high"))
            for n, a, b in windows
        ]
    )
    counted = (
        df.withColumn("_end", end.cast("int"))
        .where(F.col("_end").isNotNull() & F.col(start).isNotNull())
        .groupBy(*keys, start, "_end")
        .agg(F.count("*").alias("_n"))
    )
    split = counted.withColumn("_w", F.explode(table)).select("*", "_w.*").where("_end > _low")
    split = split.withColumn("time", F.explode(F.expr("sequence(_low + 1, least(_end, _high))")))
    return split.groupBy("window", *keys, start, "time").agg(
        F.sum("_n").alias("at_risk"),
        F.sum(F.when(F.col("time") == F.col("_end"), F.col("_n")).otherwise(0)).alias("events"),
    )

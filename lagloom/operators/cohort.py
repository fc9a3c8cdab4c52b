"""Person-period records to subjects and exposure histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.operators.clean import first_rows


def summarise_subjects(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    event: Column,
    first: Sequence[str] = (),
    low: int | None = None,
    high: int | None = None,
    na: str = "propagate",
    count_name: str = "n_periods",
    event_name: str = "event",
) -> DataFrame:
    """One row per subject: periods, whether the event ever happened, and the
    first value of each covariate in the given order (nulls included).

    `na='propagate'` gives a null event when any period has one; `na='skip'`
    ignores nulls. All parts are partial aggregates."""
    if na not in {"propagate", "skip"}:
        raise ValueError("na must be 'propagate' or 'skip'")
    top = F.max(event.cast("long"))
    if na == "propagate":
        top = F.when(F.bool_or(event.isNull()), None).otherwise(top)
    by = F.struct(*order)
    firsts = (
        [F.min_by(F.struct(*first), by).alias("_first")] if first else []
    )
    out = df.groupBy(key).agg(
        F.count("*").alias(count_name), top.alias(event_name), *firsts
    )
    if first:
        out = out.select(key, count_name, event_name, "_first.*")
    if low is not None or high is not None:
        out = out.where(
            (F.col(count_name) >= (low or 0))
            & (F.lit(True) if high is None else F.col(count_name) <= high)
        )
    return out


def exposure_histories(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    exposure: str,
    length: int,
    min_rows: int = 1,
    max_rows: int | None = None,
    direction: str = "since_start",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per subject with an array of `length` exposures and a flag
    `history_complete`.

    `direction='since_start'`: element 0 is the first period. `before_end`:
    element 0 is the last of the rows taken. Subjects with fewer than
    `min_rows` or more than `max_rows` rows are dropped. Groups are cut to at most `max_rows + 1` (or `length`) rows before the
    exchange, which is enough to see that a subject is too long, so the arrays
    are bounded whatever the input."""
    if direction not in {"since_start", "before_end"}:
        raise ValueError("direction must be 'since_start' or 'before_end'")
    cut = max(length, min_rows, (max_rows or 0) + 1)
    if direction == "before_end":
        rows = first_rows(df, [key], [F.desc(c) for c in order], cut, "_pos")
    else:
        rows = first_rows(df, [key], list(order), cut, "_pos")
    # A null exposure stays in place: the struct keeps the array from skipping it.
    cell = F.struct(F.col("_pos"), F.col(exposure).cast("double").alias("x"))
    out = rows.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.sort_array(F.collect_list(cell)).alias("_cells"),
        *[F.min_by(c, "_pos").alias(c) for c in carry],
    )
    if min_rows > 1:
        out = out.where(F.col("_n") >= min_rows)
    if max_rows is not None:
        out = out.where(F.col("_n") <= max_rows)
    taken = F.slice("_cells", 1, length)
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(taken, i)["x"]
    )
    out = out.withColumn("history", padded)
    complete = ~F.exists("history", lambda v: v.isNull())
    return out.select(key, *carry, "history", complete.alias("history_complete"))


def history_long(hist: DataFrame, key: str) -> DataFrame:
    """One row per subject and lag, missing cells included."""
    return hist.select(key, F.posexplode("history").alias("lag", "x"))


def history_wide(hist: DataFrame, key: str, length: int, prefix: str = "lag") -> DataFrame:
    """Histories as columns, for export."""
    return hist.select(
        key, *[F.get("history", F.lit(i)).alias(f"{prefix}{i}") for i in range(length)]
    )


def bind_history(hist: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """Histories joined to their outcome rows by key, never by position."""
    return outcome.join(hist, key)

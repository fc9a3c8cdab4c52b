"""Cleaning, filtering and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lagloom.functions.text import snake_case


def clean_names(df: DataFrame) -> DataFrame:
    """Lower snake-case column names, made unique by a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = snake_case(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def clean_text(df: DataFrame) -> DataFrame:
    """Trim text columns; blank text becomes null."""
    return df.withColumns(
        {
            f.name: F.nullif(F.trim(F.col(f.name)), F.lit(""))
            for f in df.schema
            if isinstance(f.dataType, StringType)
        }
    )


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows, over some columns if given."""
    return df.select(*cols).distinct() if cols else df.distinct()


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with no null in the model columns."""
    return df.dropna(subset=list(cols))


def complete_case_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows kept and dropped by `complete_cases`, in one pass."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def wide(
    df: DataFrame,
    key: str | Sequence[str],
    names_from: str,
    values_from: str,
    values: Sequence,
    prefix: str = "",
) -> DataFrame:
    """Long to wide over a fixed value list; missing cells are null."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df.groupBy(*keys).pivot(names_from, list(values)).agg(F.first(values_from))
    return out.select(*keys, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def highlight(df: DataFrame, predicate: Column, name: str = "is_highlighted") -> DataFrame:
    """Mark the rows of interest and keep the others as context."""
    return df.withColumn(name, F.coalesce(predicate, F.lit(False)))


def group_size_filter(
    df: DataFrame, keys: Sequence[str], low: int = 1, high: int | None = None
) -> DataFrame:
    """Rows of groups whose size is within [low, high].

    Sizes come from a partial aggregate and the rows from a semi join, so a hot
    group is never gathered by a window."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    keep = F.col("_n") >= low
    if high is not None:
        keep = keep & (F.col("_n") <= high)
    chosen = sizes.where(keep).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(chosen, on, "left_semi")


def semi(df: DataFrame, other: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """Rows whose key is in `other`; with `null_safe` a null key matches null."""
    if not null_safe:
        return df.join(other.select(key), key, "left_semi")
    keys = other.select(F.col(key).alias("_k"))
    return df.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_semi")


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, name: str = "lag"
) -> DataFrame:
    """First `k` rows of every group in an explicit order, numbered from zero.

    The rank filter lets Spark cut each group to `k` rows before the exchange,
    so no task receives more than `k` rows per group and map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= k)
        .withColumn(name, (F.col("_rn") - 1).cast("long"))
        .drop("_rn")
    )

"""Categories: cut into classes, code against a base level, lump, reorder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify(
    x: Column | str,
    cuts: Sequence[float],
    labels: Sequence[str],
    right: bool = False,
    missing: str | None = None,
) -> Column:
    """Ordered classes of a numeric column.

    `right=False`: class i holds cuts[i-1] <= x < cuts[i]; `right=True`:
    cuts[i-1] < x <= cuts[i]. Null stays null unless `missing` names a level."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one more label than cuts")
    if list(cuts) != sorted(cuts):
        raise ValueError("cuts must ascend")
    x = _c(x)
    out = F.when(x.isNull(), F.lit(missing))
    for cut, text in zip(cuts, labels, strict=False):
        out = out.when(x <= cut if right else x < cut, F.lit(text))
    return out.otherwise(F.lit(labels[-1]))


def missing_as_level(x: Column | str, text: str = "Missing") -> Column:
    """Null and blank text as a level of their own."""
    return F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), F.lit(text))


def indicators(x: Column | str, levels: Sequence[str], base: str | None = None) -> list[Column]:
    """One 0/1 column per non-base level; null gives null, so the row drops out
    of a model. A value outside `levels` is an error, not the base level."""
    base = levels[0] if base is None else base
    if base not in levels:
        raise ValueError(f"base {base!r} is not a level")
    x = _c(x)
    known = x.isin(list(levels))
    bad = F.raise_error(F.concat(F.lit("value outside the level list: "), x.cast("string")))
    return [
        F.when(x.isNull(), None)
        .when(~known, bad.cast("double"))
        .when(x == level, 1.0)
        .otherwise(0.0)
        for level in levels
        if level != base
    ]


def lump_levels(df: DataFrame, col: str, keep: int, other: str = "Other") -> DataFrame:
    """Keep the `keep` most frequent levels, ties by name; the rest become `other`.

    The kept levels are a top-k of a partial aggregate, so the broadcast side
    holds at most `keep` rows whatever the number of levels."""
    top = (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .count()
        .orderBy(F.desc("count"), col)
        .limit(keep)
        .select(F.col(col), F.lit(True).alias("_kept"))
    )
    lumped = F.when(F.col("_kept"), F.col(col)).when(F.col(col).isNull(), None).otherwise(other)
    return (
        df.join(F.broadcast(top), col, "left")
        .withColumn(col, lumped)
        .select(*df.columns)
    )


def level_order(x: Column | str, levels: Sequence[str], reverse: bool = False) -> Column:
    """Position of a value in an explicit level list, from 1; null if unknown."""
    levels = list(reversed(levels)) if reverse else list(levels)
    return F.nullif(
        F.array_position(F.array(*[F.lit(v) for v in levels]), _c(x)), F.lit(0).cast("long")
    )

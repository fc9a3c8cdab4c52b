"""Exposure by lag designs: sums over lags of an exposure basis times a lag
basis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.models.basis import Basis, BasisSpec, fit_basis, lag_basis, piece_values_sql


def _literal_rows(m: np.ndarray) -> str:
    rows = ("array(" + ", ".join(repr(float(v)) + "D" for v in r) + ")" for r in m)
    return "array(" + ", ".join(rows) + ")"


@dataclass(frozen=True)
class CrossBasis:
    """Frozen design: column (v, l) is the sum over lags k of exposure basis
    column v at lag k times lag basis column l at k; v is the outer index."""

    var: Basis
    lag: Basis
    max_lag: int
    name: str = "cb"

    @property
    def width(self) -> int:
        return self.var.width * self.lag.width

    @property
    def weights(self) -> np.ndarray:
        """Lag basis values, one row per lag."""
        return self.lag.values(np.arange(self.max_lag + 1))

    @property
    def terms(self) -> list[str]:
        return [
            f"{self.name}_v{v + 1}_l{k + 1}"
            for v in range(self.var.width)
            for k in range(self.lag.width)
        ]

    def summary(self, spark: SparkSession) -> DataFrame:
        """Functions, sizes, knots and lag range of the design."""
        rows = [
            (
                self.name, part, b.kind, b.width, 0, self.max_lag,
                ", ".join(f"{k}={v}" for k, v in sorted(b.about.items())),
            )
            for part, b in (("exposure", self.var), ("lag", self.lag))
        ]
        return spark.createDataFrame(
            rows,
            "design string, part string, fun string, width int, lag_from int, lag_to int, "
            "settings string",
        )

    def _combine_sql(self, bases: str) -> str:
        """SQL for the design array from an array (over lags) of basis arrays.
        The lag weights are one literal; the expression does not grow with the
        number of lags times columns."""
        per_column = (
            f"transform(sequence(0, {self.var.width - 1}), i -> transform({bases}, b -> b[i]))"
        )
        dot = "aggregate(zip_with(bv, c, (p, q) -> p * q), 0D, (s, z) -> s + z)"
        return (
            f"flatten(transform({per_column}, bv -> "
            f"transform({_literal_rows(self.weights.T)}, c -> {dot})))"
        )

    def on_histories(self, df: DataFrame, history: str = "history", out: str = "cb") -> DataFrame:
        """Design from an array column, element k being lag k. A history that
        is short or has a null gives a null design."""
        size = self.max_lag + 1
        taken = f"slice({history}, 1, {size})"
        bases = f"transform({taken}, x -> {self.var.sql('x')})"
        whole = f"size({history}) >= {size} and not exists({taken}, x -> x is null)"
        return (
            df.withColumn("_bases", F.expr(f"case when {whole} then {bases} end"))
            .withColumn(out, F.expr(f"case when _bases is not null then "
                                    f"{self._combine_sql('_bases')} end"))
            .drop("_bases")
        )

    def on_series(
        self,
        df: DataFrame,
        t: str,
        x: str,
        keys: Sequence[str] = (),
        out: str = "cb",
        block: int | None = None,
    ) -> DataFrame:
        """Design for an equally spaced series with integer time `t`, or for
        several unrelated series given by `keys`. The first `max_lag` rows of a
        series, and rows with a null or a gap in their window, get null.

        A series is cut into blocks of time. Each row goes to its block and the
        last `max_lag` rows of a block also to the next one, so a window covers
        one block and one long series still uses many tasks."""
        size = block or max(1024, 8 * self.max_lag)
        if size < max(self.max_lag, 1):
            raise ValueError("block must be at least the lag range")
        home = F.floor(F.col(t) / size)
        spill = F.when(
            F.col(t) - home * size >= size - self.max_lag, F.array(home, home + 1)
        ).otherwise(F.array(home))
        rows = df.withColumns({"_home": home, "_v": self.var.column(x)})
        rows = rows.withColumn("_block", F.explode(spill))
        w = (
            Window.partitionBy(*keys, "_block").orderBy(t)
            .rowsBetween(-self.max_lag, Window.currentRow)
        )
        cells = F.collect_list(F.struct(F.col(t).alias("t"), F.col("_v").alias("b"))).over(w)
        rows = rows.withColumn("_cells", cells).where(F.col("_block") == F.col("_home"))
        whole = (
            f"size(_cells) = {self.max_lag + 1} and not exists(_cells, c -> c.b is null) and "
            # Every place holds its own time: a repeated day does not hide a gap.
            f"not exists(transform(_cells, (c, i) -> c.t = {t} - {self.max_lag} + i), ok -> not ok)"
        )
        bases = "reverse(transform(_cells, c -> c.b))"
        return (
            rows.withColumn("_bases", F.expr(f"case when {whole} then {bases} end"))
            .withColumn(out, F.expr(f"case when _bases is not null then "
                                    f"{self._combine_sql('_bases')} end"))
            .drop("_home", "_v", "_block", "_cells", "_bases")
        )


def crossbasis(
    df: DataFrame, x: str, max_lag: int, var: BasisSpec, lag: BasisSpec, name: str = "cb"
) -> CrossBasis:
    """Freeze a design with exposure constants from column `x` of `df`."""
    return CrossBasis(fit_basis(df, x, var), lag_basis(lag, max_lag), max_lag, name)


def history_cells(df: DataFrame, history: str = "history", keep: Sequence[str] = ()) -> DataFrame:
    """All cells of all histories, one row each: the values that knots of a
    history design are computed on."""
    return df.select(*keep, F.explode(history).alias("x")).where("x is not null")


def histories_by_table(
    df: DataFrame, lag: Basis, max_lag: int, history: str = "history", out: str = "cb"
) -> DataFrame:
    """Designs from histories whose exposure basis comes with the row (the
    columns of `basis_table`): every row may belong to another model. A history
    that is short or has a null gives a null design."""
    size = max_lag + 1
    taken = f"slice({history}, 1, {size})"
    whole = f"size({history}) >= {size} and not exists({taken}, x -> x is null)"
    bases = f"transform({taken}, x -> {piece_values_sql('x')})"
    dot = "aggregate(zip_with(bv, w, (p, q) -> p * q), 0D, (s, z) -> s + z)"
    weights = _literal_rows(lag.values(np.arange(size)).T)
    per_column = "transform(sequence(0, size(_bases[0]) - 1), i -> transform(_bases, b -> b[i]))"
    joined = f"flatten(transform({per_column}, bv -> transform({weights}, w -> {dot})))"
    return (
        df.withColumn("_bases", F.expr(f"case when {whole} then {bases} end"))
        .withColumn(out, F.expr(f"case when _bases is not null then {joined} end"))
        .drop("_bases")
    )

"""Distributed sums for model fits.

Rows stay in Spark. A fit step maps each partition to one flat vector per
model by numpy on Arrow batches, the vectors are added up, and only sums of
size p or p x p reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Above this many partitions, partial vectors are first added up in Spark and
# the driver receives at most this many per model.
_DRIVER_PARTS = 32


def whole(x: str = "x") -> Column:
    """True for an array with no null (and no infinite) element: a search for
    a value that is not there ends in null when an element is null. Apply it to
    stored designs; a filter on a freshly made basis would make Spark compute
    the basis twice in one oversized generated method."""
    return F.array_contains(F.col(x), float("inf")) == F.lit(False)


def keep(design: DataFrame) -> DataFrame:
    """Persist a design for repeated passes. A design in fewer partitions than
    the session has cores is spread over all of them first."""
    kept = design.persist(StorageLevel.MEMORY_AND_DISK)
    cores = design.sparkSession.sparkContext.defaultParallelism
    if kept.rdd.getNumPartitions() >= cores:
        return kept
    kept.unpersist()
    return design.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)


def as_matrix(column: pa.Array) -> np.ndarray:
    """A list<double> column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_vector(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _merge(totals: dict, key: str, vec: np.ndarray) -> None:
    if key in totals:
        totals[key] += vec
    else:
        totals[key] = np.array(vec, float)


def _emit(totals: dict) -> pa.RecordBatch:
    keys = list(totals)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.string()),
            pa.array([totals[k].tolist() for k in keys], pa.list_(pa.float64())),
        ],
        names=["model", "vec"],
    )


def _complete(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    bad = np.zeros(len(next(iter(cols.values()))), bool)
    for v in cols.values():
        bad |= np.isnan(v).any(axis=1) if v.ndim == 2 else np.isnan(v)
    return {k: v[~bad] for k, v in cols.items()} if bad.any() else cols


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """The rows of each model of a batch, list columns as matrices."""
    names = batch.column(0).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    cols = {}
    for name, column in zip(batch.schema.names[1:], batch.columns[1:], strict=True):
        kind = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
        cols[name] = as_matrix(column) if kind else as_vector(column)
    models = names.dictionary.to_pylist()
    for code, model in enumerate(models):
        if len(models) == 1:
            yield model, cols
        else:
            hit = codes == code
            yield model, {k: v[hit] for k, v in cols.items()}


def sum_vectors(
    df: DataFrame,
    block: Callable[[str, dict[str, np.ndarray]], np.ndarray],
    drop_incomplete: bool = False,
) -> dict[str, np.ndarray]:
    """Sum over all rows of `block(model, columns)`, per model.

    `df` has a string column `model`; list columns reach `block` as matrices
    and other columns as vectors; nulls become NaN, and with `drop_incomplete`
    rows with a NaN are left out. The number of models and the vector length
    are set by the specification, not by the data."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for model, part in _by_model(batch):
                if drop_incomplete:
                    part = _complete(part)
                _merge(totals, model, block(model, part))
        yield _emit(totals)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            for key, vec in zip(batch.column(0).to_pylist(), vectors, strict=True):
                _merge(totals, key, np.array(vec))
        yield _emit(totals)

    first = df.columns[0]
    if first != "model":
        df = df.select("model", *[c for c in df.columns if c != "model"])
    parts = df.mapInArrow(per_partition, "model string, vec array<double>")
    spark = df.sparkSession
    wide = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    if wide > _DRIVER_PARTS:
        parts = parts.repartition(_DRIVER_PARTS).mapInArrow(
            add_up, "model string, vec array<double>"
        )
    totals: dict[str, np.ndarray] = {}
    for r in parts.collect():  # a fixed number of vectors of model size
        _merge(totals, r.model, np.array(r.vec))
    return totals


# Models whose partial sums a task holds before it sends them on.
_HELD = 512


def grouped_sums(
    df: DataFrame, block: Callable[[str, dict[str, np.ndarray]], np.ndarray], out: str = "vec"
) -> DataFrame:
    """As `sum_vectors` for any number of models: a table (model, `out`). Each
    task sends one partial vector per model it has met, at most _HELD at a time."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for model, part in _by_model(batch):
                _merge(totals, model, block(model, part))
                if len(totals) >= _HELD:
                    yield _emit(totals)
                    totals = {}
        yield _emit(totals)

    def add_up(key: tuple, rows: pa.Table) -> pa.Table:
        total = as_matrix(rows.column(1)).sum(axis=0)
        return pa.table({"model": pa.array([key[0].as_py()]), out: pa.array([total.tolist()])})

    if df.columns[0] != "model":
        df = df.select("model", *[c for c in df.columns if c != "model"])
    parts = df.mapInArrow(per_partition, "model string, vec array<double>")
    return parts.groupBy("model").applyInArrow(add_up, f"model string, {out} array<double>")


# Partial factors that one task merges, and that reach the driver at most.
_FAN = 32


def _stacked(upper: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows below another factor."""
    return np.linalg.qr(rows if upper is None else np.vstack([upper, rows]), mode="r")


def _fold(found: dict, model: str, upper: np.ndarray, sums: np.ndarray) -> None:
    if model in found:
        old, total = found[model]
        found[model] = (_stacked(old, upper), total + sums)
    else:
        found[model] = (upper, sums)


_FACTORS = "model string, width int, upper array<double>, sums array<double>"


def _emit_factors(found: dict) -> pa.RecordBatch:
    numbers = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(found), pa.string()),
            pa.array([u.shape[1] for u, _ in found.values()], pa.int32()),
            pa.array([u.ravel().tolist() for u, _ in found.values()], numbers),
            pa.array([t.tolist() for _, t in found.values()], numbers),
        ],
        names=["model", "width", "upper", "sums"],
    )


def _merge_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, tuple] = {}
    for batch in batches:
        for r in batch.to_pylist():
            _fold(found, r["model"], np.reshape(r["upper"], (-1, r["width"])), np.array(r["sums"]))
    yield _emit_factors(found)


def triangular_factors(
    df: DataFrame, block: Callable[[str, dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per model the triangular factor of all rows of `block(model, columns)`
    and the sums of its second value, followed by the number of rows that were
    left out for a NaN.

    Each task factors its Arrow blocks one below the other and returns one
    factor; the factors are merged in a tree of _FAN at a time, so no task and
    not the driver holds more than _FAN of them per model. Nothing is squared:
    the columns may be as close to collinear as double precision can tell."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for model, cols in _by_model(batch):
                size = len(next(iter(cols.values())))
                cols = _complete(cols)
                lost = size - len(next(iter(cols.values())))
                rows, sums = block(model, cols)
                _fold(found, model, _stacked(None, rows), np.append(sums, lost))
        yield _emit_factors(found)

    if df.columns[0] != "model":
        df = df.select("model", *[c for c in df.columns if c != "model"])
    parts = df.mapInArrow(per_partition, _FACTORS)
    left = df.rdd.getNumPartitions()
    while left > _FAN:
        left = -(-left // _FAN)
        parts = parts.repartition(left).mapInArrow(_merge_factors, _FACTORS)
    found: dict[str, tuple] = {}
    for r in parts.collect():  # at most _FAN factors of model size
        _fold(found, r["model"], np.reshape(r["upper"], (-1, r["width"])), np.array(r["sums"]))
    return found


def least_squares(upper: np.ndarray, tol: float = 1e-11):
    """Coefficients of the last column on the others from their triangular
    factor, a matrix C with C C' the inverse cross products, and the residual
    sum of squares. A column whose part across the earlier ones is below `tol`
    of its length is aliased: coefficient 0, NaN in C."""
    upper = np.vstack([upper, np.zeros((max(0, upper.shape[1] - len(upper)), upper.shape[1]))])
    p = upper.shape[1] - 1
    kept, across = [], np.zeros((len(upper), 0))
    for j in range(p):
        column, length = upper[:, j], np.linalg.norm(upper[:, j])
        for _ in range(2):
            column = column - across @ (across.T @ column)
        if length > 0 and np.linalg.norm(column) > tol * length:
            kept.append(j)
            across = np.hstack([across, (column / np.linalg.norm(column))[:, None]])
    coef, root = np.zeros(p), np.full((p, len(kept)), np.nan)
    both = np.linalg.qr(upper[:, [*kept, p]], mode="r")
    k = len(kept)
    inverse = np.linalg.solve(both[:k, :k], np.eye(k)) if k else np.zeros((0, 0))
    coef[kept] = inverse @ both[:k, k]
    root[kept] = inverse
    return coef, root, float((both[k:, k] ** 2).sum())


def pack(*parts) -> np.ndarray:
    """Flatten matrices and scalars to one vector."""
    return np.concatenate([np.ravel(np.asarray(p, float)) for p in parts])


def unpack(vec: np.ndarray, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape)) if shape else 1
        piece = vec[at : at + size]
        out.append(piece.reshape(shape) if shape else float(piece[0]))
        at += size
    return out


def gram_sql(df: DataFrame, cols: list[str], keys: list[str], weight: str | None = None):
    """Weighted cross products of a few columns, per group, as one partial
    aggregate: rows (keys, a, b, value), the diagonal included."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = list(combinations_with_replacement(cols, 2))
    aggs = [
        F.sum(w * F.col(a).cast("double") * F.col(b).cast("double")).alias(f"m{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m{i}").alias("value"))
        for i, (a, b) in enumerate(pairs)
    ]
    one = df.groupBy(*keys).agg(*aggs)
    return one.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def independent_columns(gram: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the columns that do not depend on earlier ones, by a sweep
    of the scaled matrix, and the scale of every column."""
    d = np.sqrt(np.maximum(np.diag(gram), 0.0))
    scale = np.where(d > 0, 1.0 / np.where(d > 0, d, 1.0), 0.0)
    work = gram * np.outer(scale, scale)
    kept = []
    for j in range(len(d)):
        # Remaining variance of column j given the kept columns before it.
        if d[j] > 0 and work[j, j] > tol:
            kept.append(j)
            work = work - np.outer(work[:, j], work[j]) / work[j, j]
    return np.array(kept, int), scale


def solve_information(info: np.ndarray, score: np.ndarray, tol: float = 1e-12):
    """Solution and inverse of a symmetric system. Columns that depend on
    earlier ones are aliased: solution 0, inverse NaN there."""
    p = len(score)
    kept, scale = independent_columns(info, tol)
    inv = np.full((p, p), np.nan)
    sol = np.zeros(p)
    if len(kept):
        sub = np.linalg.inv(info[np.ix_(kept, kept)] * np.outer(scale[kept], scale[kept]))
        inv[np.ix_(kept, kept)] = sub * np.outer(scale[kept], scale[kept])
        sol[kept] = scale[kept] * (sub @ (scale[kept] * score[kept]))
    return sol, inv

"""Centroid clustering over space-filling-curve zone maps.

Vectors of whole numbers are put in the order of a Hilbert curve through all
their components (range-partitioned by the curve's key, sorted inside) and cut
into blocks of `BLOCK` vectors that carry the least and greatest value of each
component. The blocks are written once. A round sends the centroids, k rows, to
the blocks: the distances from a centroid to the nearest and farthest point of a
block's box bound its distances to all of the block's vectors, and a centroid
that is farther than another one everywhere in the box cannot be nearest to any
of them. Only the centroids that are left are compared with the vectors, all at
once and in whole numbers, so the result does not depend on the blocks.

Each task returns one row of sums per centroid; the driver sees k rows a round."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.shared import partitions_for, scratch

BLOCK = 256
# Bits per component of the curve's key.
BITS = 4
# Components beyond this would not leave room for a squared distance in a long.
LIMIT = 1 << 26
# Up to this size of component every sum below is exact in double precision.
_DOUBLES = 1 << 20
BLOCK_TYPE = "ids array<long>, vectors array<int>, low array<int>, high array<int>"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Keys, as bytes that sort along the Hilbert curve, of the rows of `cells`:
    one column per dimension, values from 0 to 2^bits - 1."""
    x = cells.T.astype(np.uint32)
    dims = len(x)
    high = np.uint32(1 << (bits - 1))
    # Undo the turns of each level, from the coarsest, then take the Gray code.
    q = high
    while q > 1:
        p = q - np.uint32(1)
        for i in range(dims):
            swap = (x[0] ^ x[i]) & p
            on = (x[i] & q) != 0
            x[0] ^= np.where(on, p, swap)
            x[i] ^= np.where(on, np.uint32(0), swap)
        q >>= np.uint32(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    last = np.zeros(x.shape[1], np.uint32)
    q = high
    while q > 1:
        last ^= np.where((x[dims - 1] & q) != 0, q - np.uint32(1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= last
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.Array, dims: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _keyed(dims: int, centre: float, width: float):
    """Adds the curve's key to (id, vector)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (_matrix(batch.column(1), dims, np.float64) - centre) / width + 0.5
            cells = np.clip(np.floor(cells * (1 << BITS)), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hilbert_keys(cells), pa.binary())], names=["id", "vector", "key"]
            )

    return rows


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as one list per row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def _blocks(dims: int):
    """Sorted rows (id, vector) as blocks with their boxes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = _matrix(part.column(1), dims, np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        _lists(v.reshape(1, -1), pa.int32()),
                        _lists(v.min(axis=0, keepdims=True), pa.int32()),
                        _lists(v.max(axis=0, keepdims=True), pa.int32()),
                    ],
                    names=["ids", "vectors", "low", "high"],
                )

    return rows


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector of the box, ascending; for
    a tie with the nearest one nothing is left out."""
    nearest = (np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2).sum(axis=1)
    farthest = (np.maximum(np.abs(centroids - low), np.abs(high - centroids)) ** 2).sum(axis=1)
    some = np.flatnonzero(nearest <= farthest.min())
    # The difference of two squared distances is linear: its extreme is a corner.
    middle = ((2 * centroids[some] - low - high) ** 2).sum(axis=1)
    lead = centroids[some[np.argmin(middle)]]
    away = centroids[some] - lead
    most = (lead**2).sum() - (centroids[some] ** 2).sum(axis=1) + 2 * np.maximum(low * away, high * away).sum(axis=1)
    return some[most >= 0]


def assign_block(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray):
    """Nearest centroid (the smaller number of equals) and squared distance of
    each vector of a block."""
    some = candidates(low, high, centroids)
    kind = np.float64 if max(np.abs(low).max(), np.abs(high).max(), np.abs(centroids).max()) <= _DOUBLES else np.int64
    v, c = vectors.astype(kind), centroids[some].astype(kind)
    distance = (v**2).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c**2).sum(axis=1)
    best = np.argmin(distance, axis=1)
    return some[best], distance[np.arange(len(v)), best].astype(np.int64)


def _each_block(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    dims = centroids.shape[1]
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            low, high = (_matrix(one.column(c), dims)[0] for c in (2, 3))
            v = _matrix(one.column(1), dims)
            yield one.column(0).flatten(), v, *assign_block(v, low, high, centroids)


def _sums(centroids: np.ndarray) -> Callable:
    """Per task and centroid: number, sum of distances, sums of components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, inertia, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, v, cluster, distance in _each_block(batches, centroids):
            for c in np.unique(cluster):
                mine = cluster == c
                count[c] += int(mine.sum())
                # Python numbers: a sum of distances may outgrow a long here.
                inertia[c] += sum(distance[mine].tolist())
                total[c] += v[mine].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int32), pa.int32()),
                pa.array(count[some], pa.int64()),
                pa.array([str(inertia[c]) for c in some], pa.string()),
                _lists(total[some], pa.int64()),
            ],
            names=["cluster", "n", "inertia", "total"],
        )

    return rows


def _labels(centroids: np.ndarray) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _each_block(batches, centroids):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"]
            )

    return rows


def whole_vectors(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column, dims: int) -> Column:
    """True for vectors of `dims` components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`; equal ids are
    ordered by their components, a null id is hashed as empty."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def zone_blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, vector) as blocks along the curve, written to the shared folder."""
    flat = vectors.select(F.explode("vector").alias("x")).agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("x")))
    centre, deviation, most = flat.first()
    if most is not None and most > LIMIT:
        raise ValueError(f"a component of {most} is beyond {LIMIT}: squared distances would not fit in a long")
    small = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<int>").alias("vector"))
    keyed = small.mapInArrow(
        _keyed(dims, float(centre or 0), 4 * float(deviation or 0) or 1.0), "id long, vector array<int>, key binary"
    )
    # Equal vectors may be a third of all: their ids cut them into ranges too.
    ordered = keyed.repartitionByRange(partitions_for(vectors.sparkSession), "key", "id")
    ordered = ordered.sortWithinPartitions("key", "id").select("id", "vector")
    return scratch(ordered.mapInArrow(_blocks(dims), BLOCK_TYPE), "zones")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> DataFrame:
    """Columns id and vector (`dims` whole numbers each) to one row per vector:
    id, cluster, distance (squared), cluster_inertia, inertia, centroid (array).

    The k vectors that `first_centroids` draws are the start (all, if there are
    fewer). In each round every vector goes to its nearest centroid, ties to the
    smaller number, and a centroid moves to the floor of the mean of its vectors;
    one without vectors stays. After the last round vectors are assigned once
    more. Repeated rows count as often as they appear; rows with a null id take
    part. An empty table gives an empty result. A component beyond 2^26 is an
    error, since distances would not fit in a long."""
    schema = "id long, cluster int, distance long"
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        spark = vectors.sparkSession
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid array<long>")
    blocks = zone_blocks(vectors, dims)
    for turn in range(rounds + 1):
        parts = blocks.mapInArrow(_sums(centroids), "cluster int, n long, inertia string, total array<long>")
        wide = "decimal(38,0)"
        sums = (
            parts.select("cluster", "n", F.col("inertia").cast(wide), F.posexplode("total").alias("at", "x"))
            .groupBy("cluster", "at")
            .agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum(F.col("x").cast(wide)).alias("x"))
            .collect()  # k * dims rows
        )
        if turn < rounds:
            centroids = centroids.copy()
            for r in sums:
                centroids[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    inertia = {r["cluster"]: int(r["inertia"]) for r in sums}
    about = vectors.sparkSession.createDataFrame(
        [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in sorted(inertia)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    # One row per centroid.
    return blocks.mapInArrow(_labels(centroids), schema).join(F.broadcast(about), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


"""Exact top-k inner products by branch and bound over ball trees.

Vectors are spread over shards by a hash of their id; each shard builds a ball
tree. A ball with centre c and radius r holds no vector with an inner product
above q.c + |q| r, so nodes are visited by that bound, best first, until it
falls below the k-th score so far. Queries go in blocks: each block searches
one shard first, and its k-th scores are carried along as the bound for all
other shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.shared import scratch

SHARD_ROWS = 4096
QUERY_BLOCK = 512
LEAF = 48
# Sums of products below this are exact in double precision.
_EXACT = 2.0**52


def valid(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class BallTree:
    """Nodes as arrays; rows are reordered so that a node is a run of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        points = rows.astype(float)
        order = np.arange(len(ids))
        lows, highs, centres, radii, children = [], [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            node = len(lows)
            if parent >= 0:
                children[parent].append(node)
            part = points[order[lo:hi]]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            lows.append(lo)
            highs.append(hi)
            centres.append(centre)
            radii.append(away.max() * (1 + 1e-9) + 1e-9)
            children.append([])
            if hi - lo <= leaf or away.max() == 0:
                continue
            # Split at the middle of the line between two far points.
            a = part[away.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            side = part @ (b - a)
            middle = (hi - lo) // 2
            at = np.argpartition(side, middle)
            order[lo:hi] = order[lo:hi][at]
            todo += [(lo, lo + middle, node), (lo + middle, hi, node)]
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.lows, self.highs, self.children = lows, highs, children
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(
        self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int
    ) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query the (score, id) that may be among its `k` best, best
        first. `least` holds scores that k rows reach already; `own` is left out."""
        q = queries.astype(float)
        # Rounding of the bound is far below the added part.
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        bounds = q @ self.centres.T + size * self.radii[None, :]
        bounds += 1e-9 * (1 + np.abs(bounds) + size * self.radii[None, :])
        top = max(1.0, float(np.abs(self.rows).max(initial=0))) * max(1.0, float(np.abs(queries).max(initial=0)))
        exact = top * max(1, q.shape[1]) < _EXACT
        for i in range(len(q)):
            bound = bounds[i]
            best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst on top
            floor = least[i]
            todo = [(-bound[0], 0)]
            while todo:
                high, node = heapq.heappop(todo)
                if -high < floor:
                    break
                inner = self.children[node]
                if inner:
                    for c in inner:
                        if bound[c] >= floor:
                            heapq.heappush(todo, (-bound[c], c))
                    continue
                lo, hi = self.lows[node], self.highs[node]
                if exact:
                    scores = self.points[lo:hi] @ q[i]
                    near = np.flatnonzero(scores >= floor)
                    found = [(int(scores[j]), int(self.ids[lo + j])) for j in near]
                else:
                    scores = self.rows[lo:hi].astype(object) @ queries[i].astype(object)
                    found = [(s, int(v)) for s, v in zip(scores, self.ids[lo:hi], strict=True) if s >= floor]
                for s, v in found:
                    if v == own[i]:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
                if len(best) == k and best[0][0] > floor:
                    floor = best[0][0]
            yield i, sorted(((s, -v) for s, v in best), key=lambda t: (-t[0], t[1]))


def _matrix(lists: pa.ChunkedArray | pa.ListArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


_RESULT = "query_id long, vec_id long, score long"


def _clipped(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _search_shard(k: int):
    def search(key, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(rows) and len(blocks):
            dim = key[0].as_py()
            tree = BallTree(rows.column("id").to_numpy(), _matrix(rows.column("v"), dim))
            for block in range(len(blocks)):
                ids = blocks.column("ids")[block].values.to_numpy()
                own = blocks.column("vectors")[block].values.to_numpy().astype(np.int64).reshape(-1, dim)
                least = blocks.column("least")[block].values.to_numpy()
                for i, best in tree.search(own, ids, least, k):
                    out += [(int(ids[i]), v, _clipped(s)) for s, v in best]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table(
            [pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"]
        )

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_: str = "vec_id",
    vector: str = "vector",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` the `k`
    rows of `vectors` (both: id_, vector of whole numbers) with the largest
    inner product, all if there are fewer, ties to smaller ids; a row with the
    query's own id is no candidate.

    Rows with a null id or vector, or with a null component, take no part.
    Vectors are compared within one length only. Repeated rows count once, as
    an id with equal vector. Scores are exact; one beyond the range of long is
    clipped to it. Empty tables give an empty result."""

    def cleaned(df: DataFrame) -> DataFrame:
        return (
            df.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
            .where("id is not null and v is not null and not exists(v, x -> x is null)")
            .withColumn("dim", F.size("v"))
        )

    rows = scratch(cleaned(vectors).dropDuplicates(["id", "v"]), "vectors")
    asked = cleaned(queries).dropDuplicates(["id", "v"])
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    shards = {d: max(1, -(-n // shard_rows)) for d, n in sizes.items()}
    of_dim = F.create_map(*[F.lit(x) for item in shards.items() for x in item]) if shards else F.lit(None)
    if not shards:
        return rows.limit(0).select(
            F.col("id").alias("query_id"),
            F.lit(1).alias("rank"),
            F.col("id").alias("vec_id"),
            F.col("id").alias("score"),
        )
    count = F.try_element_at(of_dim, F.col("dim"))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), count).cast("int")).select("dim", "shard", "id", "v")
    # Blocks of queries of one length; the block number spreads them evenly.
    per = asked.groupBy("dim").count()
    blocks = (
        asked.join(F.broadcast(per), "dim")
        .withColumn(
            "block",
            F.pmod(F.xxhash64(F.lit(3), "id"), F.ceil(F.col("count") / QUERY_BLOCK)).cast("int"),
        )
        .withColumn("shards", count.cast("int"))
        .where("shards is not null")
        .select("dim", "block", "shards", "id", "v")
    )
    blocks = scratch(blocks, "query-rows")
    first = _packed(blocks.withColumn("least", F.lit(-(2.0**80)))).withColumn(
        "shard", F.expr("block % shards")
    )
    one = scratch(_searched(placed, first, k), "first-shard")
    # The k-th score found so far, where k were found, bounds the other shards.
    kth = one.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(None)).cast("double").alias("kth")
    )
    bounded = blocks.join(kth, F.col("id") == F.col("query_id"), "left").select(
        "dim", "block", "shards", "id", "v", F.coalesce("kth", F.lit(-(2.0**80))).alias("least")
    )
    others = _packed(bounded).withColumn(
        "shard",
        F.explode(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.expr("block % shards"))),
    )
    found = one.unionByName(_searched(placed, others, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _packed(queries: DataFrame) -> DataFrame:
    """One row per block of at most about QUERY_BLOCK queries."""
    return (
        queries.groupBy("dim", "block", "shards")
        .agg(F.collect_list(F.struct("id", "least", "v")).alias("q"))
        .select(
            "dim",
            "block",
            "shards",
            F.col("q.id").alias("ids"),
            F.col("q.least").alias("least"),
            F.flatten("q.v").alias("vectors"),
        )
    )


def _searched(placed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    return (
        placed.groupBy("dim", "shard")
        .cogroup(blocks.groupBy("dim", "shard"))
        .applyInArrow(_search_shard(k), _RESULT)
    )

"""Corpus shuffle into shards by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets by a seeded hash; pass two
shuffles every bucket in memory (Fisher-Yates) and hands out global positions,
so a record's place is uniform over the corpus. Shards are equal runs of
positions: their row counts differ by at most one (law `rows`), and a bucket is
written into one or two shards without another exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lagloom.llm.shared import scratch

SHARDS = 24
BUCKET_BYTES = 16 << 20
SEED = 20
ROW_BYTES = 8


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + ROW_BYTES).cast("long")


def _fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """Positions 0 to n - 1 in random order; numpy's permutation is a
    Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def shuffled_shards(
    docs: DataFrame,
    text: str = "text",
    doc: str = "doc_id",
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All columns of `docs` with size (UTF-8 bytes and 8), shard, slot.

    Slots of a shard run from 0 without gaps in shuffled order. The outcome
    depends on the rows and the seed only, not on how they were read. Repeated
    rows are kept; a null id or text is a value like any other. With fewer rows
    than shards some shards are empty; an empty table gives an empty result.
    Columns of `docs` named size, shard, slot or bucket are replaced."""
    names = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot", "bucket")]
    total = docs.agg(F.sum(_size(text))).first()[0] or 0
    buckets = max(shards, -(-total // bucket_bytes))
    # Rows of one id fall into one bucket, unless their texts differ.
    place = F.pmod(
        F.xxhash64(F.lit(seed), F.col(f"`{doc}`"), F.xxhash64(F.col(f"`{text}`"))), F.lit(buckets)
    ).cast("int")
    placed = docs.select(*[F.col(f"`{c}`") for c in names], _size(text).alias("size"), place.alias("bucket"))
    counts = scratch(placed.groupBy("bucket").agg(F.count("*").alias("n")), "bucket-counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    # One row per bucket: a window over bytes / bucket_bytes rows.
    starts = counts.select(
        "bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("_sh_start")
    )

    def shuffle(key: tuple, rows_: pa.Table) -> pa.Table:
        # A defined order first, so that retries and other plans agree.
        order = pc.sort_indices(rows_, sort_keys=[(doc, "ascending"), ("size", "ascending"), (text, "ascending")])
        mixed_ = order.take(pa.array(_fisher_yates(len(rows_), seed, key[0].as_py())))
        return rows_.take(mixed_).append_column("slot", pa.array(np.arange(len(rows_), dtype=np.int64)))

    schema = StructType([*placed.schema.fields, StructField("slot", LongType())])
    mixed = placed.groupBy("bucket").applyInArrow(shuffle, schema)
    at = F.col("_sh_start") + F.col("slot")
    shard = F.expr(f"(_sh_start + slot) * {shards} div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return (
        mixed.join(F.broadcast(starts), "bucket")
        .withColumn("shard", shard)
        .withColumn("slot", at - first)
        .select(
            *[F.col(f"`{c}`") for c in names],
            "size",
            F.col("shard").cast(IntegerType()).alias("shard"),
            F.col("slot").cast(LongType()).alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard. Rows arrive in slot order inside each bucket."""
    sharded.write.partitionBy("shard").parquet(path)

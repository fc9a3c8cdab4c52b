"""Scratch tables in the cluster's shared folder, joins of checked size, and
column rules that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after its rows were counted and their
# estimated bytes are below this; otherwise the join shuffles.
BROADCAST_BYTES = 32 << 20

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (local
    tests), one temporary folder per application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base is None:
        base = _own_folder.get(app)
        if base is None:
            base = _own_folder[app] = tempfile.mkdtemp(prefix="lagloom-scratch-")
    return f"{base.rstrip('/')}/lagloom-{app}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage is
    cut, the rows survive lost executors and each column is read on demand."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove the files of a table made by `scratch` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_folder(spark)
    for path in {os.path.dirname(p) for p in df.inputFiles()}:
        if f"/lagloom-{spark.sparkContext.applicationId}/" not in path:
            raise ValueError(f"{path} is not below {root}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """While texts are written, Python workers get `rows` of them at a time at
    most: a task holds a batch on both sides, in buffers outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its counted rows times `row_bytes` stay
    below `limit`; unchanged otherwise, so that Spark shuffles the join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def with_replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """All columns of `df`, then `new`; an existing column of the same name
    (upper or lower case) is replaced in its place."""
    fresh = {k.lower(): (k, c) for k, c in new.items()}
    out = []
    for c in df.columns:
        hit = fresh.pop(c.lower(), None)
        out.append(hit[1].alias(c) if hit else F.col(f"`{c}`"))
    return df.select(*out, *[c.alias(k) for k, c in fresh.values()])


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])

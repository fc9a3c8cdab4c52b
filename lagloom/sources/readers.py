"""Table readers. Every reader returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# File suffix -> Spark format name and reader options.
_FORMATS = {
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
    "json": ("json", {}),
    "csv": ("csv", {"header": "true"}),
    "tsv": ("csv", {"header": "true", "sep": "\t"}),
    "txt": ("text", {}),
}


def load(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    fmt: str | None = None,
    **options: str,
) -> DataFrame:
    """Load a table, or several files of one; the format follows the (first)
    file suffix unless `fmt` is given."""
    first = path if isinstance(path, str) else path[0]
    suffix = (fmt or first.rstrip("/").removesuffix("/*").rsplit(".", 1)[-1]).lower()
    if suffix not in _FORMATS:
        raise ValueError(f"no reader for .{suffix}; known: {', '.join(_FORMATS)}")
    source, defaults = _FORMATS[suffix]
    reader = spark.read.format(source).options(**{**defaults, **options})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def load_named(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a catalogue folder, by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manual_rows(
    spark: SparkSession, rows: Sequence[tuple], schema: StructType | str, key: str | Sequence[str]
) -> DataFrame:
    """A hand-typed table. It must carry a unique key, so that it is joined by
    key and never bound to another table by position."""
    df = spark.createDataFrame(list(rows), schema)
    keys = [key] if isinstance(key, str) else list(key)
    where = [df.columns.index(k) for k in keys]
    seen = [tuple(r[i] for i in where) for r in rows]
    if any(None in k for k in seen) or len(set(seen)) != len(seen):
        raise ValueError(f"key {keys} must be present and unique in hand-typed rows")
    return df


def load_newest(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    fmt: str | None = None,
    **options: str,
) -> DataFrame:
    """Rows of the most recently modified file of a folder (ties keep all).

    The newest time comes from the file listing of the same reader, so only
    the matching files are read afterwards."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    newest = files.select(F.max("modificationTime").alias("t")).scalar()
    chosen = [r.path for r in files.where(F.col("modificationTime") == newest).collect()]
    if not chosen:
        raise FileNotFoundError(path)
    return load(spark, sorted(chosen), schema, fmt, **options)


def load_with_banner(
    spark: SparkSession,
    path: str,
    header_pattern: str,
    schema: str,
    sep: str = ",",
) -> DataFrame:
    """Delimited files with title lines and a messy header on top.

    Lines before the header (the first line that matches `header_pattern`) and
    the header itself are dropped, per file; a later line that matches is data.
    The header position is found by byte order within a file, so a file may be
    read by many tasks. A file with lines but without a header fails the query."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    lines = lines.withColumn("_is_header", F.col("value").rlike(header_pattern))
    # One row per file: the first header line in (block, line) order.
    start = (
        lines.where("_is_header")
        .groupBy("_file")
        .agg(F.min(F.struct("_block", "_line")).alias("_start"))
    )
    missing = F.raise_error(F.concat(F.lit("no header line in "), F.col("_file"))).cast("boolean")
    # One row per file is joined; the hint is left to Spark's size statistics.
    body = lines.join(start, "_file", "left").where(
        F.when(F.col("_start").isNull(), missing).otherwise(
            (F.struct("_block", "_line") > F.col("_start")) & (F.trim("value") != "")
        )
    )
    parsed = F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE"})
    return body.select(parsed.alias("r")).select("r.*")

"""Table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def export(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a table; the format follows the suffix of `path`."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in {"parquet", "orc", "json", "csv"}:
        raise ValueError(f"no writer for .{suffix}")
    writer = df.write.mode(mode).format(suffix)
    if suffix == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)

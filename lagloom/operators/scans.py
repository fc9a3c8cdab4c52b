"""Running sums, positions and exact percentiles that never need one whole
group in one task.

A window over a hot group puts the group into a single task. The helpers here
work in two levels: sums per (group, bucket) first, a window over those few
rows, then a window inside each bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.session import settled


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    bucket: Column | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Inclusive running sums (suffix sums if `reverse`) of the columns in
    `sums` (output name -> input name) along `order` inside `keys`.

    `df` is an aggregate with one row per (keys, order). Without a `bucket` one
    group is one task: right for calendar-like axes with a known, small number
    of distinct values. With a `bucket`, a column that ascends with `order`,
    a group of any length is spread over its buckets."""

    def ordered(*by: str) -> Window:
        return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))

    direction = F.desc if reverse else F.asc
    if bucket is None:
        w = ordered(*keys).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(src).over(w) for out, src in sums.items()})
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*keys, "_bucket").agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()]
    )
    before = (
        ordered(*keys).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    on = F.col("_bucket") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = (
        ordered(*keys, "_bucket")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = df.join(totals, on).withColumns(
        {o: F.sum(src).over(w) + F.col(f"_o_{o}") for o, src in sums.items()}
    )
    return out.drop("_bucket", "_b", *[f"_k_{k}" for k in keys], *[f"_o_{o}" for o in sums])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "lag"
) -> DataFrame:
    """Zero-based position of every row in its group, for groups of any size.

    `bucket` is a coarse version of the first order column, such as its month.
    Rows are counted per (keys, bucket) before any window, and the row window
    covers one bucket only."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        df.join(offsets, on)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_b", "_offset", *[f"_k_{k}" for k in keys])
    )


def in_order(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """All rows in one global order with their positions from 1.

    Rows are range-partitioned and sorted inside; a row's position is its place
    in its partition plus the rows of the partitions before. The partitions are
    settled first, so that counting and numbering see the same ones. No window
    holds more than one row per partition. Rows equal in `order` have their
    positions in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits of this number are the partition, the lower the place in it.
    rows = settled(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per partition.
    placed = rows.join(F.broadcast(offsets), part == F.col("_part"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, F.col("_offset") + place + 1).drop("_id", "_part", "_offset")


# Cells per power of two in the two searches for a rank. A group's first cells
# number at most about 2^8 times the binary orders its values span; the second
# search divides one of them into 2^18.
_CELLS = (2**8, 2**26)


def value_cell(x: Column, per_octave: int) -> Column:
    """A whole number that never falls as `x` rises: `per_octave` cells for
    every power of two. Continuous in between, so an exponent that rounding puts
    one off at a power of two gives the same cell."""
    size = F.abs(x)
    exponent = F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double"))
    inside = exponent + size / F.pow(F.lit(2.0), exponent) + 1100.0
    cell = F.when(size == float("inf"), F.lit(2200.0)).otherwise(inside)
    cell = (F.signum(x) * F.floor(cell * per_octave)).cast("long")
    # Not a number sorts last.
    return F.when(F.isnan(x), F.lit(2**62)).when(x == 0, F.lit(0)).otherwise(cell)


def _on(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact percentiles by linear interpolation, one column per entry of
    `probs` (output name -> probability), nulls skipped.

    The built-in exact percentile holds every distinct value of a group in one
    task. Here rows are counted by (key, value) first, which spreads any group.
    Each wanted rank is then searched from coarse to fine: counts by value cell
    say which cell holds it, a second division narrows the cell, and only the
    values of that are put in order. No exchange carries rows by key alone."""
    keys = list(keys)
    names = list(probs)
    counts = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_x"))
        .groupBy(*keys, "_x")
        .agg(F.count("*").alias("_c"))
        .withColumn("_cell", value_cell(F.col("_x"), _CELLS[0]))
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        counts.groupBy(*keys, "_cell")
        .agg(F.sum("_c").alias("_n"))
        .withColumns(
            {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(whole)}
        )
    )
    # Wanted ranks (from 1): two per probability, lower and upper neighbour.
    wanted = []
    for name in names:
        at = f"({float(probs[name])!r}D * (_size - 1))"
        wanted += [f"floor({at}) + 1", f"least(floor({at}) + 2, _size)"]
    sought = (
        cells.select("*", F.posexplode(F.expr(f"array({', '.join(wanted)})")).alias("_i", "_rank"))
        .where("_rank > _before and _rank <= _before + _n")
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in keys],
            F.col("_cell").alias("_at"),
            "_i",
            (F.col("_rank") - F.col("_before")).alias("_rank"),
            "_size",
        )
    )
    renamed = [f"_k_{c}" for c in keys]
    near = (
        counts.join(sought, _on([*keys, "_cell"], [*renamed, "_at"]))
        .drop("_cell", "_at", *renamed)
        .withColumn("_fine", value_cell(F.col("_x"), _CELLS[1]))
    )
    target = Window.partitionBy(*keys, "_i")
    upto = target.orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)
    fine = (
        near.groupBy(*keys, "_i", "_fine")
        .agg(F.sum("_c").alias("_n"), F.first("_rank").alias("_rank"))
        .withColumn("_to", F.sum("_n").over(upto))
        .where("_rank <= _to and _rank > _to - _n")
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in keys],
            F.col("_i").alias("_j"),
            F.col("_fine").alias("_at"),
            (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_left"),
        )
    )
    upto = target.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        near.join(fine, _on([*keys, "_i", "_fine"], [*renamed, "_j", "_at"]))
        .drop(*renamed)
        .withColumn("_to", F.sum("_c").over(upto))
        .where("_left <= _to and _left > _to - _c")
        .groupBy(*keys)
        .agg(
            F.first("_size").alias("_size"),
            # Two entries per probability.
            F.map_from_entries(F.collect_list(F.struct("_i", "_x"))).alias("_m"),
        )
    )
    out = []
    for i, name in enumerate(names):
        at = F.expr(f"{float(probs[name])!r}D * (_size - 1)")
        lo = F.element_at("_m", F.lit(2 * i))
        hi = F.element_at("_m", F.lit(2 * i + 1))
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)

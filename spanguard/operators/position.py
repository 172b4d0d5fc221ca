"""Positions of rows in an ordered group, without a window over the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanguard.session import cut

_ROW_BITS = 33


def with_position(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "position", partitions: int | None = None
) -> DataFrame:
    """Add the zero-based position of each row among the rows of its group.

    One group may hold a large share of all rows, so the rows are range-sorted over the whole data
    set, which spreads a large group over many tasks. Each (group, partition) run then gets the
    number of rows in the runs before it; a group has at most one run per partition, so the only
    window is bounded by the partition count. The input is checkpointed because range bounds are
    sampled from it first, the sorted rows so that no row moves between the count and the join.
    `order` must tell all rows of a group apart, or equal rows must be interchangeable.
    """
    by = [*[F.col(k) for k in keys], *order]
    source = cut(df)
    ranged = source.repartitionByRange(*by) if partitions is None else source.repartitionByRange(partitions, *by)
    placed = cut(ranged.sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_run", F.shiftright("_row", _ROW_BITS))
    runs = placed.groupBy(*keys, "_run").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *keys, "_run", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    joined = placed.join(offsets, [*keys, "_run"])
    return joined.select(*df.columns, (F.col("_row") + F.col("_shift")).cast("bigint").alias(name))


def with_previous(
    df: DataFrame, keys: list[str], order: list[Column], fields: list[str], prefix: str = "previous_"
) -> DataFrame:
    """Add the fields of the row before, and has_previous; a lag by join on (group, position)."""
    placed = with_position(df, keys, order, "_pos")
    earlier = placed.select(
        *keys, (F.col("_pos") + 1).alias("_pos"), F.lit(True).alias("_has"),
        *[F.col(f).alias(prefix + f) for f in fields],
    )
    return (
        placed.join(earlier, [*keys, "_pos"], "left")
        .withColumn("has_previous", F.coalesce("_has", F.lit(False)))
        .drop("_has", "_pos")
    )

"""Global rank without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haggle.session import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _range_sorted(df: DataFrame, order: list, partitions: int | None) -> DataFrame:
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    # a written table keeps the ranges; in columns, so that counting reads one narrow column only
    return written(placed, "ranges").withColumn("_pid", F.shiftright("_mid", _ROW_BITS)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )


def global_rank(df: DataFrame, order: list, name: str = "rank", total: str | None = None,
                partitions: int | None = None) -> DataFrame:
    """Number all rows from 1 in `order`, which must end in a unique column.

    Range-partition and sort once, write that result (both passes must see the
    same ranges), count rows per range, add the offset of earlier ranges. The
    offsets are one row per range, so their broadcast is bounded by the number
    of partitions. With `total` the overall row count is added as a column."""
    ranked = _range_sorted(df, order, partitions)
    counts = ranked.groupBy("_pid").agg(F.max("_pos").alias("_last"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_off"),
        F.sum(F.col("_last") + 1).over(Window.orderBy(F.lit(1)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    out = ranked.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_pos") + 1)
    if total:
        out = out.withColumn(total, F.col("_n"))
    return out.drop("_mid", "_pid", "_pos", "_off", "_n")


def global_running(df: DataFrame, order: list, sums: dict, partitions: int | None = None) -> DataFrame:
    """Running sums over the whole table in `order`, by the same two passes:
    a window inside each range plus the totals of the earlier ranges."""
    ranked = _range_sorted(df, order, partitions)
    for n, c in sums.items():
        ranked = ranked.withColumn(f"_v_{n}", c)
    totals = ranked.groupBy("_pid").agg(F.max("_pos").alias("_last"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    upto = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumns({n: F.sum(f"_v_{n}").over(upto) for n in sums})
    out = out.join(F.broadcast(offsets), "_pid").withColumn("rank", F.col("_off") + F.col("_pos") + 1)
    out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_mid", "_pid", "_pos", "_off", *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])

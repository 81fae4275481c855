"""Isotonic curves over rows of any number.

Neighbours that fall are pooled inside ranges of x; each range leaves a stack of rising
blocks. Only where one range's last block is not below the next range's first can
blocks still fall, so the blocks are cut into other ranges and pooled again until no
border falls. The pooled curve is the same whatever the ranges were. Scoring lays
rows and blocks on one line, on which the curve is a running maximum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.operators.metrics import bin_of
from haggle.operators.ordered import done, grouped, with_running
from haggle.session import scratch_path

BLOCK = "lo double, hi double, s double, w double, range int"


def pool(lo: list, hi: list, s: list, w: list, stack: list[list]) -> None:
    """Push blocks (least x, greatest x, sum, weight) on a stack that rises; what falls is pooled with what lies under it."""
    for block in zip(lo, hi, s, w):
        top = list(block)
        while stack and stack[-1][2] * top[3] >= top[2] * stack[-1][3]:
            under = stack.pop()
            top = [under[0], top[1], under[2] + top[2], under[3] + top[3]]
        stack.append(top)


def _pool_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack, number = [], None
    for batch in batches:
        if batch.num_rows:
            number = batch.column("range")[0].as_py()
            pool(*(batch.column(c).to_pylist() for c in ("lo", "hi", "s", "w")), stack)
    for i in range(0, len(stack), 100_000):
        cols = np.array(stack[i : i + 100_000]).T
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in cols), pa.array(np.full(cols.shape[1], number), pa.int32())], ["lo", "hi", "s", "w", "range"])


def rising_blocks(points: DataFrame, ranges: int | None = None) -> DataFrame:
    """(lo, hi, value, weight) of the weighted isotonic curve through points (x, y, w): its
    blocks by the least and greatest x in them, values strictly rising.

    Points of one x are one; rows with a null take no part. The driver sees one row per range and round."""
    spark = points.sparkSession
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND w > 0")
    blocks = known.groupBy("x").agg(F.sum(F.col("y") * F.col("w")).alias("s"), F.sum("w").cast("double").alias("w")).select(F.col("x").alias("lo"), F.col("x").alias("hi"), "s", "w")
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = None
    while True:
        # another number of ranges puts the borders elsewhere
        cut = blocks.repartitionByRange(n, "lo").sortWithinPartitions("lo").withColumn("range", F.spark_partition_id())
        path = scratch_path(spark, "blocks")
        cut.mapInArrow(_pool_range, BLOCK).write.parquet(path)
        pooled = spark.read.parquet(path)
        ends = pooled.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("s", "w"), "lo").alias("first"), F.max_by(F.struct("s", "w"), "lo").alias("last")).orderBy("range").collect()
        falls = sum(a["last"]["s"] * b["first"]["w"] >= b["first"]["s"] * a["last"]["w"] for a, b in zip(ends, ends[1:]))
        blocks, now = pooled.drop("range"), sum(r["n"] for r in ends)
        if not falls:
            return blocks.select("lo", "hi", (F.col("s") / F.col("w")).alias("value"), F.col("w").alias("weight"))
        # with few blocks, or where nothing was pooled, ranges grow; one range ends it
        n = max(1, n // 2) if now == left or now < 2 * n else n + 1
        left = now


def isotonic(pred: DataFrame, bins: int | None = None) -> DataFrame:
    """pred (p, target, ...) with `calibrated`: the isotonic curve of target over p (or its bin),
    as a step function; a p takes the value of the last block that starts at or below it, one
    below all blocks the first one's. A null p is not calibrated."""
    x = bin_of(F.col("p"), bins).cast("double") if bins else F.col("p").cast("double")
    rows = pred.withColumn("_x", x)
    curve = rising_blocks(rows.select(F.col("_x").alias("x"), F.col("target").cast("double").alias("y"), F.lit(1.0).alias("w")))
    packed = rows.select(F.lit(0).alias("_line"), "_x", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_value"), F.struct(*pred.columns).alias("_row"))
    empty = F.lit(None).cast(packed.schema["_row"].dataType)
    steps = curve.select(F.lit(0).alias("_line"), F.col("lo").alias("_x"), F.lit(0).alias("_side"), F.col("value").alias("_value"), empty.alias("_row"))
    line = with_running(grouped(packed.unionByName(steps), ["_line"], ["_x", "_side"]), maxes={"_step": F.col("_value")})
    # one row
    first = curve.agg(F.min("value").alias("_first"))
    found = done(line).where("_side = 1").crossJoin(F.broadcast(first))
    value = F.when(F.col("_x").isNotNull(), F.coalesce("_step", "_first"))
    return found.select("_row.*", value.alias("calibrated"))

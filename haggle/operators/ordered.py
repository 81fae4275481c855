"""Ordered work inside groups that stays distributed when one group is huge.

A window partitioned by a key puts the whole group into one task. Where the largest
group is counted above the limit, rows are instead range-partitioned by key and order
together, so a group of any size spreads over as many ranges as it fills. Windows run
inside a range; what crosses a range's border is one carry for its first and one for
its last group, and a scan of those carries completes every row. It makes no difference
how many groups are large. Where none is, the plan is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from haggle.session import scratch_path

DEFAULT_HOT_ROWS = 1_000_000

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def hot_limit(df: DataFrame) -> int:
    """Rows of a group above which groups are spread over ranges (haggle.hot.rows)."""
    return int(df.sparkSession.conf.get("haggle.hot.rows", str(DEFAULT_HOT_ROWS)))


#: Cells in which rows are counted before their groups are.
COUNT_CELLS = 1 << 16


def largest_group(df: DataFrame, keys: list[str], enough: int = 0) -> int:
    """Rows of the largest group, counted in each task before the shuffle. Keys are
    counted by hash, so two of them may count as one, which only spreads more. A cell of
    hashes holds whole groups: where no cell has more than `enough` rows, that count will do."""
    key = F.xxhash64(*keys)
    for k in [F.pmod(key, F.lit(COUNT_CELLS)), key] if enough else [key]:
        most = df.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= enough:
            break
    return most


@dataclass
class Grouped:
    """A frame with its groups' order. Where `hot`, rows lie in ranges: `_range_no` is the
    range and `_range_at` the row's place over all ranges."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    hot: bool

    def window(self):
        if self.hot:
            return Window.partitionBy("_range_no", *self.keys).orderBy("_range_at")
        return Window.partitionBy(*self.keys).orderBy(*self.order)


def grouped(df: DataFrame, keys: list[str], order: list[str], probe: DataFrame | None = None) -> Grouped:
    """Count the largest group and spread the rows where it is above the limit.

    `probe` is a cheaper frame to count in, for instance the scan that df was joined
    from. It holds some of the keys, with one row or more per row of df; a group of all
    keys is never larger than its group of some. A probe with no more rows than the
    limit needs no count of groups."""
    limit = hot_limit(df)
    if probe is None:
        hot = largest_group(df, keys, limit) > limit
    else:
        hot = probe.count() > limit and largest_group(probe, [k for k in keys if k in probe.columns], limit) > limit
    return spread(df, keys, order) if hot else Grouped(df, keys, order, False)


def spread(df: DataFrame, keys: list[str], order: list[str]) -> Grouped:
    """Range-partition by keys and order and write the sorted ranges once, since all
    passes must see the same ones. Rows alike in both are told apart by a hash of
    their other plain columns, so that they spread as well."""
    spark = df.sparkSession
    plain = [f.name for f in df.schema if f.name not in (*keys, *order) and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    ranks = [*keys, *order, F.xxhash64(*plain)] if plain else [*keys, *order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    df.repartitionByRange(ranges, *ranks).sortWithinPartitions(*ranks).withColumn("_range_at", F.monotonically_increasing_id()).write.parquet(path)
    return Grouped(spark.read.parquet(path).withColumn("_range_no", F.shiftright("_range_at", _ROW_BITS).cast("int")), keys, order, True)


def _segment_rows(g: Grouped, **aggs: Column) -> DataFrame:
    """One row for the first and the last group of each range: only they can go on in another."""
    key = F.struct(*g.keys)
    ends = g.df.groupBy("_range_no").agg(F.min(key).alias("_range_first"), F.max(key).alias("_range_last"))
    # one row per range
    border = g.df.join(F.broadcast(ends), "_range_no").where(key.eqNullSafe(F.col("_range_first")) | key.eqNullSafe(F.col("_range_last")))
    return border.groupBy("_range_no", *g.keys).agg(*[c.alias(n) for n, c in aggs.items()])


def _carried(g: Grouped, df: DataFrame, carries: DataFrame) -> DataFrame:
    """df with what its range and group are handed; two carries per range at most."""
    on = ["_range_no", *g.keys]
    renamed = carries.select([F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in carries.columns])
    same = F.lit(True)
    for c in on:
        same = same & df[c].eqNullSafe(renamed[f"_r_{c}"])
    return df.join(F.broadcast(renamed), same, "left").drop(*[f"_r_{c}" for c in on])


def with_next(g: Grouped, cols: dict[str, str]) -> Grouped:
    """Add, per new name, the value of a column in the next row of the group,
    plus `_is_last`."""
    packed = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    df = g.df.withColumn("_next", F.lead(packed).over(g.window()))
    if g.hot:
        heads = _segment_rows(g, _head=F.min_by(packed, "_range_at"))
        scan = Window.partitionBy(*g.keys).orderBy("_range_no")
        heads = heads.withColumn("_nexthead", F.lead("_head").over(scan)).drop("_head")
        df = _carried(g, df, heads)
        df = df.withColumn("_next", F.coalesce("_next", "_nexthead")).drop("_nexthead")
    df = df.withColumn("_is_last", F.col("_next").isNull())
    for new in cols:
        df = df.withColumn(new, F.col(f"_next.{new}"))
    return Grouped(df.drop("_next"), g.keys, g.order, g.hot)


def with_previous(g: Grouped, cols: dict[str, str]) -> Grouped:
    """Add the value of a column in the previous row of the group, plus `_is_first`."""
    packed = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    df = g.df.withColumn("_prev", F.lag(packed).over(g.window()))
    if g.hot:
        tails = _segment_rows(g, _tail=F.max_by(packed, "_range_at"))
        scan = Window.partitionBy(*g.keys).orderBy("_range_no")
        tails = tails.withColumn("_prevtail", F.lag("_tail").over(scan)).drop("_tail")
        df = _carried(g, df, tails)
        df = df.withColumn("_prev", F.coalesce("_prev", "_prevtail")).drop("_prevtail")
    df = df.withColumn("_is_first", F.col("_prev").isNull())
    for new in cols:
        df = df.withColumn(new, F.col(f"_prev.{new}"))
    return Grouped(df.drop("_prev"), g.keys, g.order, g.hot)


def with_running(
    g: Grouped, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, inclusive: bool = True
) -> Grouped:
    """Add running sums and maxima of the rows up to (and with) the current one.
    With inclusive=False the current row is left out (sums start at 0)."""
    sums, maxes = sums or {}, maxes or {}
    upto = g.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = g.df
    for n, c in {**sums, **maxes}.items():
        df = df.withColumn(f"_v_{n}", c)
    adds = {n: F.sum(f"_v_{n}").over(upto) for n in sums} | {n: F.max(f"_v_{n}").over(upto) for n in maxes}
    df = df.withColumns(adds) if adds else df
    if g.hot:
        base = Grouped(df, g.keys, g.order, True)
        totals = _segment_rows(
            base, **{f"_t_{n}": F.sum(f"_v_{n}") for n in sums}, **{f"_t_{n}": F.max(f"_v_{n}") for n in maxes}
        )
        before = Window.partitionBy(*g.keys).orderBy("_range_no").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumns(
            {f"_b_{n}": F.sum(f"_t_{n}").over(before) for n in sums}
            | {f"_b_{n}": F.max(f"_t_{n}").over(before) for n in maxes}
        ).select("_range_no", *g.keys, *[f"_b_{n}" for n in [*sums, *maxes]])
        df = _carried(g, df, totals)
        df = df.withColumns(
            {
                n: F.when(F.col(n).isNull() & F.col(f"_b_{n}").isNull(), None).otherwise(
                    F.coalesce(n, F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0))
                )
                for n in sums
            }
            | {n: F.greatest(n, f"_b_{n}") for n in maxes}
        ).drop(*[f"_b_{n}" for n in [*sums, *maxes]])
    if not inclusive:
        df = df.withColumns({n: F.coalesce(n, F.lit(0)) for n in sums})
    return Grouped(df.drop(*[f"_v_{n}" for n in [*sums, *maxes]]), g.keys, g.order, g.hot)


def with_row_number(g: Grouped, name: str) -> Grouped:
    """Number the rows of every group from 1 in group order."""
    if not g.hot:
        return Grouped(g.df.withColumn(name, F.row_number().over(g.window())), g.keys, g.order, False)
    out = with_running(g, sums={name: F.lit(1)})
    return Grouped(out.df.withColumn(name, F.col(name).cast("int")), g.keys, g.order, True)


def with_totals(g: Grouped, aggs: dict[str, Column]) -> Grouped:
    """Add aggregates over the whole group to each of its rows. They take no order, so where
    groups are large they meet in an aggregate; keys that are null lose their rows there."""
    if not g.hot:
        return Grouped(g.df.withColumns({n: c.over(Window.partitionBy(*g.keys)) for n, c in aggs.items()}), g.keys, g.order, False)
    totals = g.df.groupBy(*g.keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return Grouped(g.df.join(totals, g.keys), g.keys, g.order, True)


def done(g: Grouped) -> DataFrame:
    return g.df.drop("_range_no", "_range_at") if g.hot else g.df

"""Order inside groups: the scan over ranges equals plain windows, whatever the groups are like."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from haggle.operators import ordered


def every(g):
    g = ordered.with_row_number(g, "nth")
    g = ordered.with_next(g, {"next_v": "v", "next_w": "w"})
    g = ordered.with_previous(g, {"prev_v": "v"})
    g = ordered.with_running(g, sums={"cum": F.col("v")}, maxes={"peak": F.col("w")})
    return ordered.done(ordered.with_running(g, sums={"before": F.col("v")}, inclusive=False))


def by_window(df):
    w = Window.partitionBy("k", "s").orderBy("t", "u")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        "nth": F.row_number().over(w), "next_v": F.lead("v").over(w), "next_w": F.lead("w").over(w), "_is_last": F.lead("u").over(w).isNull(),
        "prev_v": F.lag("v").over(w), "_is_first": F.lag("u").over(w).isNull(), "cum": F.sum("v").over(upto), "peak": F.max("w").over(upto),
        "before": F.coalesce(F.sum("v").over(before), F.lit(0))})


def sample(spark, n, k):
    """`t` is one and the same for a third of the rows; some keys and values are null."""
    r = spark.range(n).withColumn("k", k)
    return r.select("k", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("s"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") * 37) % 1000).alias("t"),
                    F.xxhash64("id").alias("u"), F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("v"), F.when(F.col("id") % 7 > 0, (F.col("id") * 13) % 101).alias("w"),
                    F.array(F.col("id")).alias("more"))


KEYS = {
    "one group": "cast(1 as bigint)",
    "a group of a third and many small ones": "if(id % 3 = 0, -1, id % 500)",
    "null keys": "if(id % 4 > 0, null, id % 3)",
    "groups of one row": "id",
}


@pytest.mark.parametrize("name", KEYS)
def test_ranges_equal_windows(spark, hot, name):
    df = sample(spark, 3000, F.expr(KEYS[name]))
    g = ordered.grouped(df, ["k", "s"], ["t", "u"])
    assert g.hot == (name != "groups of one row")
    got = every(g if g.hot else ordered.spread(df, ["k", "s"], ["t", "u"]))
    want = by_window(df).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 3000


def test_a_group_of_one_time_is_spread(spark):
    """Rows alike in key and order lie in several ranges, none of which holds them all."""
    df = spark.range(4000).select(F.lit(1).alias("k"), F.lit(5).alias("t"), F.col("id").alias("v"))
    g = ordered.spread(df, ["k"], ["t"])
    sizes = [r["count"] for r in g.df.groupBy("_range_no").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2000
    numbered = ordered.done(ordered.with_row_number(g, "nth"))
    assert numbered.agg(F.count_distinct("nth"), F.max("nth")).first() == (4000, 4000)


def test_many_hot_groups(spark, hot):
    """A hundred thousand groups above the limit: none is listed anywhere."""
    df = sample(spark, 800_000, F.col("id") % 100_000).select("k", "t", "u", "v")
    g = ordered.grouped(df, ["k"], ["t", "u"])
    assert g.hot
    out = ordered.done(ordered.with_running(ordered.with_row_number(g, "nth"), sums={"cum": F.col("v")}))
    w = Window.partitionBy("k").orderBy("t", "u")
    want = df.withColumns({"nth": F.row_number().over(w), "cum": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    digest = F.sum(F.xxhash64("k", "t", "u", "nth", "cum").cast("decimal(38,0)"))
    assert out.agg(F.count(F.lit(1)), digest).first() == want.agg(F.count(F.lit(1)), digest).first()


def test_probe_counts_the_largest_group(spark):
    probe = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert ordered.largest_group(probe, ["k"]) == 10 and ordered.largest_group(probe.limit(0), ["k"]) == 0
    assert not ordered.grouped(probe.withColumn("t", F.lit(1)), ["k"], ["t"], probe).hot

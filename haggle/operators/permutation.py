"""Permutation null of a difference in means, for any number of rows and outcome values.

A permutation deals the treated places to the rows at random. Rows with one outcome are
alike, so it is enough to know how many treated places fall on each value. These counts
come from a tree of hypergeometric splits: all places over two halves of the value
ranges, each half's share over its halves, down to single ranges, and inside a range
from value to value. A range's values pass by once, for all permutations together."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.session import scratch_path

#: The library's generator draws from populations below this; larger ones are drawn here.
LIBRARY_ROWS = 10**9

#: Constants of the ratio of uniforms for unimodal discrete distributions: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
WIDTH, EXTRA = 2 * (2 / np.e) ** 0.5, 3 - 2 * (3 / np.e) ** 0.5

_SMALL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 64)))))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    z = np.maximum(x, 1.0)
    series = (z + 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return np.where(x < 64, _SMALL[np.clip(x, 0, 63).astype(np.int64)], series)


def _log_growth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(b! / a!), from the difference itself where both are large, so that nothing of it cancels."""
    both, gap = np.maximum(a, 64.0), b - a
    far = (both + 0.5) * np.log1p(np.maximum(gap, 63 - both) / both) + gap * (np.log(np.maximum(b, 64.0)) - 1) + (1 / np.maximum(b, 64.0) - 1 / both) / 12
    return np.where((a >= 64) & (b >= 64), far, _log_factorial(b) - _log_factorial(a))


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, places: np.ndarray) -> np.ndarray:
    """Ratio-of-uniforms rejection with exact probability ratios to the mode, for any population."""
    out = np.empty(len(places), np.int64)
    open_ = np.arange(len(places))
    g, n = float(good), float(good + bad)
    while len(open_):
        m = places[open_].astype(np.float64)
        mean = m * (g / n)
        spread = np.sqrt(np.maximum(mean * ((n - g) / n) * ((n - m) / max(n - 1, 1)), 0) + 0.5)
        mode = np.floor((m + 1) * ((g + 1) / (n + 2)))
        u, v = rng.random(len(m)), rng.random(len(m))
        x = np.floor(mean + 0.5 + (WIDTH * spread + EXTRA) * (v - 0.5) / np.maximum(u, 1e-300))
        fits = (x >= np.maximum(0, m - (n - g))) & (x <= np.minimum(m, g))
        y = np.where(fits, x, mode)
        ratio = -_log_growth(mode, y) - _log_growth(g - mode, g - y) - _log_growth(m - mode, m - y) - _log_growth(n - g - m + mode, n - g - m + y)
        taken = fits & (2 * np.log(np.maximum(u, 1e-300)) <= ratio)
        out[open_[taken]] = y[taken].astype(np.int64)
        open_ = open_[~taken]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, places: np.ndarray) -> np.ndarray:
    """How many of each number of places fall on the `good` of good + bad rows."""
    if good == 0 or bad == 0:
        return places * (bad == 0)
    if good + bad < LIBRARY_ROWS:
        return rng.hypergeometric(good, bad, places)
    return _large_hypergeometric(rng, good, bad, places)


def _over_ranges(sizes: list[int], treated: int, seed: int):
    """Each permutation's treated places by range, by halving the list of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.concatenate(([0], np.cumsum(sizes)))
        for batch in batches:
            for i in batch.column("id").to_pylist():
                rng, share = np.random.default_rng([seed, 0, i]), np.zeros(len(sizes), np.int64)
                todo = [(0, len(sizes), treated)]
                while todo:
                    a, b, places = todo.pop()
                    if b - a == 1:
                        share[a] = places
                        continue
                    mid = (a + b) // 2
                    left = int(hypergeometric(rng, int(before[mid] - before[a]), int(before[b] - before[mid]), np.array([places]))[0])
                    todo += [(a, mid, left), (mid, b, places - left)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes)), pa.int32()), pa.array(np.full(len(sizes), i), pa.int64()), pa.array(share, pa.int64())], ["part", "id", "n"])

    return run


def _inside_ranges(sizes: list[int], seed: int):
    """Sums of the outcomes that each permutation treats in a range: its shares come first, then its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, places = None, [], []

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total if total is not None else np.zeros(len(ids)), pa.float64())], ["id", "total"])

        total = None
        for batch in batches:
            for p, is_value, i, y, n in zip(*(batch.column(c).to_pylist() for c in ("part", "is_value", "id", "y", "n"))):
                if p != part:
                    if part is not None:
                        yield ended()
                    part, ids, places, total, rest = p, [], [], None, sizes[p]
                    rng = np.random.default_rng([seed, 1, p])
                if not is_value:
                    ids.append(i)
                    places.append(n)
                    continue
                if total is None:
                    total, left = np.zeros(len(ids)), np.array(places, np.int64)
                took = (rng.random(len(left)) * rest < left).astype(np.int64) if n == 1 else hypergeometric(rng, n, rest - n, left)
                total += y * took
                left -= took
                rest -= n
        if part is not None:
            yield ended()

    return run


def permutation_test(df: DataFrame, treatment: str, outcome: str, samples: int = 2000, seed: int = 1729) -> DataFrame:
    """Method, samples, observed difference in means, mean of the null and two-sided p value.

    Where there are no more assignments than `samples`, all are listed; else as many
    are drawn, each exactly uniform. Rows without an outcome or treatment take no part;
    there must be rows in both arms. Outcomes may have any number of values."""
    spark = df.sparkSession
    rows = df.select(F.col(outcome).cast("double").alias("y"), F.col(treatment).cast("long").alias("k")).where("y IS NOT NULL AND k IS NOT NULL")
    path = scratch_path(spark, "outcomes")
    per = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    per.repartitionByRange("y").withColumn("part", F.spark_partition_id()).write.parquet(path)
    values = spark.read.parquet(path)
    ranges = values.groupBy("part").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("y") * F.col("n")).alias("all"), F.sum(F.col("y") * F.col("k")).alias("seen"))
    found = ranges.orderBy("part").collect()  # one row per range
    n, treated = sum(r["n"] for r in found), sum(r["k"] for r in found)
    if not 0 < treated < n:
        raise ValueError("a permutation needs rows in both arms")
    total, seen = sum(r["all"] for r in found), sum(r["seen"] for r in found)

    def gap(s):
        return s / treated - (total - s) / (n - treated)

    observed = gap(seen)
    schema = "method string, samples long, observed double, null_mean double, p_value double"
    # the count of assignments is at least n choose 1; it is worked out only where it may be small
    if n <= samples and comb(n, treated) <= samples:
        flat = [r["y"] for r in values.orderBy("y").collect() for _ in range(r["n"])]  # `samples` values at most
        null = [gap(sum(x)) for x in combinations(flat, treated)]
        hits = sum(abs(x) >= abs(observed) for x in null)
        return spark.createDataFrame([("exact_permutation_null", len(null), observed, sum(null) / len(null), hits / len(null))], schema)

    sizes = {r["part"]: r["n"] for r in found}
    order = sorted(sizes)
    counts = [sizes[p] for p in order]
    # ranges are numbered anew, since empty ones have no row
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("part")).cast("int") - 1
    shares = spark.range(samples).mapInArrow(_over_ranges(counts, treated, seed), "part int, id bigint, n bigint")
    shares = shares.select("part", F.lit(False).alias("is_value"), "id", F.lit(None).cast("double").alias("y"), "n")
    stream = shares.unionByName(values.select(place.alias("part"), F.lit(True).alias("is_value"), F.lit(None).cast("long").alias("id"), "y", "n"))
    met = stream.repartition("part").sortWithinPartitions("part", "is_value", "id", "y")
    sums = met.mapInArrow(_inside_ranges(counts, seed), "id bigint, total double").groupBy("id").agg(F.sum("total").alias("s"))
    null = sums.select((F.col("s") / treated - (F.lit(float(total)) - F.col("s")) / (n - treated)).alias("ate"))
    return null.agg(F.lit("sampled_permutation_null").alias("method"), F.count(F.lit(1)).alias("samples"), F.lit(float(observed)).alias("observed"),
                    F.avg("ate").alias("null_mean"), F.avg((F.abs("ate") >= abs(observed)).cast("int")).alias("p_value"))

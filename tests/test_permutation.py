"""The permutation null: exact where small, and draws that follow the hypergeometric law at any size."""

from __future__ import annotations

import math
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from haggle.operators import permutation


def test_exact_null_equals_sql(spark):
    rows = [(1, 3.5), (1, 2.0), (0, 2.0), (0, -1.0), (1, 8.25), (0, 0.5), (0, 2.0), (None, 5.0), (1, None)]
    got = permutation.permutation_test(spark.createDataFrame(rows, "t int, y double"), "t", "y").first()
    # three of seven rows, in every way
    want = duckdb.sql("""WITH r(i, t, y) AS (VALUES (1, 1, 3.5), (2, 1, 2.0), (3, 0, 2.0), (4, 0, -1.0), (5, 1, 8.25), (6, 0, 0.5), (7, 0, 2.0)),
      s AS (SELECT a.y + b.y + c.y AS s FROM r a JOIN r b ON a.i < b.i JOIN r c ON b.i < c.i),
      o AS (SELECT SUM(y) FILTER (WHERE t = 1) / 3 - SUM(y) FILTER (WHERE t = 0) / 4 AS o, SUM(y) AS y FROM r)
      SELECT COUNT(*), ANY_VALUE(o), AVG(s / 3 - (y - s) / 4), AVG(CASE WHEN ABS(s / 3 - (y - s) / 4) >= ABS(o) THEN 1 ELSE 0 END) FROM s, o""").fetchall()[0]
    assert got["method"] == "exact_permutation_null"
    assert (got["samples"], got["observed"], got["null_mean"], got["p_value"]) == pytest.approx([float(x) for x in want])


@pytest.mark.parametrize("good, bad, places", [(7, 5, 6), (40, 3, 20), (2, 90, 30), (1, 1, 1), (500, 700, 300), (3, 4, 7)])
def test_large_draws_follow_the_law(good, bad, places):
    """The sampler for populations beyond the library's, on small ones whose probabilities are known."""
    n = 60_000
    draws = permutation._large_hypergeometric(np.random.default_rng(2), good, bad, np.full(n, places))
    for x in range(max(0, places - bad), min(good, places) + 1):
        p = math.comb(good, x) * math.comb(bad, places - x) / math.comb(good + bad, places)
        assert abs((draws == x).mean() - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    assert draws.min() >= max(0, places - bad) and draws.max() <= min(good, places)


def test_draws_from_billions():
    good, bad, places = 3 * 10**11, 10**12, 4 * 10**11
    draws = permutation.hypergeometric(np.random.default_rng(3), good, bad, np.full(40_000, places)).astype(float)
    n = good + bad
    mean, var = places * good / n, places * good / n * bad / n * (n - places) / (n - 1)
    z = (draws - mean) / math.sqrt(var)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.02 and abs((z < -1).mean() - 0.1587) < 0.01


def test_more_values_than_any_limit(spark):
    """Thirty thousand rows, nearly all with a value of their own: mean and spread of the null are those of theory."""
    df = spark.range(30_000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("t"), F.when(F.col("id") % 10 == 0, 0.5).otherwise((F.xxhash64("id") % 100003) / 100003.0).alias("y"))
    got = permutation.permutation_test(df, "t", "y", samples=800).first()
    again = permutation.permutation_test(df.repartition(7), "t", "y", samples=800).first()
    s = df.agg(F.var_samp("y").alias("v")).first()["v"]
    sd = math.sqrt(s * 30_000 / (10_000 * 20_000))
    assert got["samples"] == 800 and abs(got["null_mean"]) < 4 * sd / math.sqrt(800)
    p = math.erfc(abs(got["observed"]) / sd / math.sqrt(2))
    assert abs(got["p_value"] - p) < 4 * math.sqrt(p * (1 - p) / 800) + 0.005
    assert again["null_mean"] == pytest.approx(got["null_mean"]) and again["p_value"] == got["p_value"]


def test_sampled_null_of_few_values(spark):
    rows = [(i % 2, float(i % 3)) for i in range(40)]
    got = permutation.permutation_test(spark.createDataFrame(rows, "t int, y double"), "t", "y", samples=3000).first()
    values = [y for _, y in rows]
    rng = np.random.default_rng(0)
    null = []
    for _ in range(20_000):
        s = rng.permutation(values)[:20].sum()
        null.append(s / 20 - (sum(values) - s) / 20)
    want = np.mean(np.abs(null) >= abs(got["observed"]) - 1e-12)
    assert abs(got["p_value"] - want) < 0.05
    with pytest.raises(ValueError):
        permutation.permutation_test(spark.createDataFrame([(1, 1.0)], "t int, y double"), "t", "y")

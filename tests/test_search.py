"""The term search against fits made one by one."""

from __future__ import annotations

import numpy as np
import pytest

from haggle.operators import search


def fit(x, y, l2):
    """Ridge logistic weights by plain Newton steps."""
    a, w = np.column_stack((np.ones(len(y)), x)), np.zeros(x.shape[1] + 1)
    ridge = l2 * np.append(0.0, np.ones(x.shape[1]))
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a / len(y) + np.diag(ridge), a.T @ (p - y) / len(y) + ridge * w)
    return w


def search_one_by_one(train, dev, columns, max_terms=5, l2=0.01):
    x, y, z, t = columns(train), train["target"], columns(dev), dev["target"]
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd <= 1e-9] = 1.0
    x, z = (x - mean) / sd, (z - mean) / sd
    chosen, losses = [], []
    while len(chosen) < max_terms:
        best = (losses[-1] if losses else np.inf, None)
        for i in range(x.shape[1]):
            if i not in chosen:
                w = fit(x[:, [*chosen, i]], y, l2)
                p = np.clip(1 / (1 + np.exp(-(w[0] + z[:, [*chosen, i]] @ w[1:]))), 1e-6, 1 - 1e-6)
                loss = -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()
                if loss < best[0] - 1e-8:
                    best = (loss, i)
        if best[1] is None:
            break
        losses.append(best[0])
        chosen.append(best[1])
    return chosen, losses


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    n = 1500
    a, b, c, d, e = rng.normal(5, 2, n), rng.normal(0, 1, n), rng.integers(0, 4, n).astype(float), rng.exponential(3, n), rng.normal(0, 100, n)
    # an indicator and a product tell more than any single feature
    z = 1.5 * (d > np.median(d)) + 1.2 * b * c - 1
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    cols = {"a": a, "b": b, "c": c, "d": d, "e": e, "target": y}
    frame = spark.createDataFrame(list(zip(*[v.tolist() for v in cols.values()])), "a double, b double, c double, d double, e double, target int").repartition(5)
    return frame, cols


def test_forward_search_equals_single_fits(table):
    frame, cols = table
    train, dev = frame.where("e < 40"), frame.where("e >= 40")
    got = search.forward_search(train, dev, list("abcde"))
    assert len(got["candidates"]) == 18 and len(got["terms"]) >= 2
    assert any(" * " in t for t in got["terms"]) and any("if(" in t for t in got["terms"])
    side = lambda keep: {k: v[keep] for k, v in cols.items()}

    def columns(part):
        out = []
        for t in got["candidates"]:
            if "if(" in t:
                name, cut = t[3:].split(",")[0].split(" > ")
                out.append((part[name] > float(cut)).astype(float))
            else:
                out.append(np.prod([part[x] for x in t.split(" * ")], axis=0))
        return np.column_stack(out)

    chosen, losses = search_one_by_one(side(cols["e"] < 40), side(cols["e"] >= 40), columns)
    assert got["terms"] == [got["candidates"][i] for i in chosen]
    assert got["losses"] == pytest.approx(losses, abs=1e-7)
    # one aggregate a Newton step for all candidates, one more for their losses
    assert got["aggregates"] <= 6 * 15


def test_upper_medians(spark, hot):
    df = spark.createDataFrame([(float(i % 7), None if i == 0 else float(-i)) for i in range(40)], "a double, b double")
    want = {"a": sorted(float(i % 7) for i in range(40))[20], "b": sorted([0.0, *[-float(i) for i in range(1, 40)]])[20]}
    assert search.upper_medians(df, ["a", "b"]) == want


def test_forward_search_of_little(table):
    frame, _ = table
    none = search.forward_search(frame.limit(0), frame.limit(0), ["a", "b"])
    assert none["terms"] == [] and none["aggregates"] == 0
    flat = search.forward_search(frame.selectExpr("1.0 as a", "target"), frame.limit(0), ["a"], max_terms=1)
    assert flat["terms"] == ["a"]
    apart = frame.selectExpr("a", "cast(a > 5 as int) as target")  # separable: the ridge keeps weights finite
    assert search.forward_search(apart, apart, ["a"], max_terms=2)["log_loss"] < 0.3

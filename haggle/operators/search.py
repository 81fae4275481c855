"""Forward search for a few terms of a logistic model.

All terms are computed once. A round fits every candidate at the same time: each Newton
step is one aggregate, which brings the gradients and curvatures of all of them, and one
more brings their losses on the development rows. So jobs grow with Newton steps, not
with candidates, and the driver holds a handful of small matrices."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.operators.models import _num, rank_features, term_columns
from haggle.operators.ordered import done, grouped, with_running
from haggle.session import scratch_path

# Fixed values of the search: features ranked first, those with an indicator, those with products, terms in all.
RANKED, FLAGGED, MULTIPLIED, CANDIDATES, MAX_TERMS = 8, 6, 5, 18, 5

#: Newton steps of a fit at most, and the change of a weight below which it has settled.
STEPS, SETTLED = 40, 1e-9

#: A round must lower the loss by more than this.
GAIN = 1e-8


def upper_medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """The value at place n / 2 (from 0) of each feature in order, exactly: distinct values are
    counted and the counts run up in order, so no feature's values come together."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), _num(f).alias("value")) for f in features])))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    run = done(with_running(grouped(counts, ["feature"], ["value"]), sums={"upto": F.col("n")}))
    half = counts.groupBy("feature").agg(F.floor(F.sum("n") / 2).alias("half"))
    found = run.join(half, "feature").where(F.col("upto") > F.col("half")).groupBy("feature").agg(F.min("value").alias("median"))
    return {r["feature"]: r["median"] for r in found.collect()}  # one row per feature


def candidate_terms(train: DataFrame, features: list[str], limit: int = CANDIDATES) -> list[str]:
    """Ranked features, indicators above their medians and products of the first ones."""
    ranked = [r["feature"] for r in rank_features(train, features).orderBy(F.desc("score"), "feature").collect()]
    top = ranked[:RANKED]
    cut = upper_medians(train, top[:FLAGGED]) if top else {}
    flags = [f"if({f} > {Decimal(f'{cut[f]:.6g}'):f}, 1, 0)" for f in top[:FLAGGED] if f in cut]
    pairs = [f"{a} * {b}" for i, a in enumerate(top[:MULTIPLIED]) for b in top[i + 1 : MULTIPLIED]]
    return list(dict.fromkeys([*top, *flags, *pairs]))[:limit]


def _sums(models: dict[int, tuple[list[int], np.ndarray]], mean: np.ndarray, scale: np.ndarray, slopes: bool):
    """Each model's loss, and with `slopes` its gradient and curvature, summed over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros(1 + (len(w) + len(w) ** 2) * slopes) for m, (_, w) in models.items()}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = batch.column("target").to_numpy(zero_copy_only=False).astype(np.float64)
            x = (batch.column("terms").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) - mean) / scale
            for m, (picked, w) in models.items():
                design = np.column_stack((np.ones(len(y)), x[:, picked]))
                p = 1 / (1 + np.exp(-np.clip(design @ w, -700, 700)))
                q = np.clip(p, 1e-6, 1 - 1e-6)
                parts = [[-(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()]]
                if slopes:
                    parts += [design.T @ (p - y), (design.T @ (design * (p * (1 - p))[:, None])).ravel()]
                total[m] += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["model", "sums"])

    return run


def _summed(rows: DataFrame, models: dict, mean: np.ndarray, scale: np.ndarray, slopes: bool) -> dict[int, np.ndarray]:
    per_task = rows.select("target", "terms").mapInArrow(_sums(models, mean, scale, slopes), "model int, sums array<double>")
    flat = per_task.select("model", F.posexplode("sums").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {m: np.zeros(1 + (len(w) + len(w) ** 2) * slopes) for m, (_, w) in models.items()}
    for r in flat.collect():  # a few hundred numbers
        found[r["model"]][r["i"]] = r["v"]
    return found


def fit_many(rows: DataFrame, n: int, start: dict[int, tuple[list[int], np.ndarray]], mean: np.ndarray, scale: np.ndarray, l2: float) -> tuple[dict[int, tuple[list[int], np.ndarray]], int]:
    """Weights of ridge logistic fits on standardised terms, all at once, and the aggregates it took.

    A step that does not lower the penalised loss is halved, so every fit goes down to its one minimum."""
    now, best, step, taken = dict(start), {}, {}, 0
    moving = set(now)
    while moving and taken < STEPS:
        sums = _summed(rows, {m: now[m] for m in moving}, mean, scale, True)
        taken += 1
        for m in sorted(moving):
            picked, w = now[m]
            k, s = len(w), sums[m]
            ridge = l2 * np.append(0.0, np.ones(k - 1))
            loss = s[0] / n + 0.5 * (ridge * w * w).sum()
            if m in best and loss > best[m][0] + 1e-12:
                step[m] = step[m] / 2
                now[m] = (picked, best[m][1] + step[m])
            else:
                gradient, curve = s[1 : 1 + k] / n + ridge * w, s[1 + k :].reshape(k, k) / n + np.diag(ridge)
                best[m] = (loss, w)
                step[m] = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
                now[m] = (picked, w + step[m])
            if np.abs(step[m]).max() < SETTLED:
                moving.discard(m)
    return {m: (start[m][0], best[m][1] + (step[m] if m not in moving else 0)) for m in start}, taken


def forward_search(train: DataFrame, dev: DataFrame, features: list[str], max_terms: int = MAX_TERMS, limit: int = CANDIDATES, l2: float = 0.01) -> dict:
    """Add the term that lowers the development loss most until none does: `terms`,
    `log_loss`, `losses` after each term, `aggregates` used and the `candidates`.

    Terms are standardised by the training rows (population deviation, 1 where it is at
    most 1e-9). Equal losses go to the earlier candidate. Without development rows the
    training rows decide; without training rows there is no term. Rows without a target take no part."""
    spark = train.sparkSession
    pool = candidate_terms(train, features, limit)

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        terms = F.array(*term_columns(pool, df.columns))
        df.where("target IS NOT NULL").select(F.col("target").cast("double").alias("target"), terms.alias("terms")).write.parquet(path)
        return spark.read.parquet(path)

    rows = written(train, "train-terms")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("terms")[i]).alias(f"{a}{i}") for i in range(len(pool)) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, nothing = stats["n"], {"terms": [], "log_loss": float("inf"), "losses": [], "aggregates": 0, "candidates": pool}
    if not n or not pool:
        return nothing
    mean = np.array([stats[f"m{i}"] for i in range(len(pool))])
    scale = np.array([s if (s := stats[f"s{i}"]) > 1e-9 else 1.0 for i in range(len(pool))])
    judges = written(dev, "dev-terms")
    n_judges = judges.count()
    if not n_judges:
        judges, n_judges = rows, n

    chosen: list[int] = []
    weights, losses, aggregates = np.zeros(1), [], 0
    while len(chosen) < min(max_terms, len(pool)):
        tried = {i: ([*chosen, i], np.append(weights, 0.0)) for i in range(len(pool)) if i not in chosen}
        fitted, taken = fit_many(rows, n, tried, mean, scale, l2)
        scored = {i: s[0] / n_judges for i, s in _summed(judges, fitted, mean, scale, False).items()}
        aggregates += taken + 1
        least, pick = losses[-1] if losses else float("inf"), None
        for i in sorted(scored):
            if scored[i] < least - GAIN:
                least, pick = float(scored[i]), i
        if pick is None:
            break
        chosen, weights = fitted[pick]
        losses.append(least)
    return {"terms": [pool[i] for i in chosen], "log_loss": losses[-1] if losses else float("inf"), "losses": losses, "aggregates": aggregates, "candidates": pool}

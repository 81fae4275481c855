"""Scores of predictions. A prediction row has row_id, label, prediction and,
for classes, probs: map<label, probability>. Group columns score many models,
targets and splits in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.scalar import clip
from haggle.operators.rank import global_rank
from haggle.operators.split import rank_within

EPS = 1e-12


def prob_of(label: Column | str, default: float = 0.0) -> Column:
    key = F.lit(label) if isinstance(label, str) else label
    return F.coalesce(F.try_element_at("probs", key), F.lit(default))


def top_of(probs: Column) -> Column:
    """(probability, label) of the most probable class, ties by label order."""
    ordered = F.array_min(F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label"))))
    return F.struct((-ordered["p"]).alias("p"), ordered["label"].alias("label"))


def multiclass_brier(labels: list[str]) -> Column:
    total = F.lit(0.0)
    for name in labels:
        total = total + F.pow(prob_of(name) - F.when(F.col("label") == name, 1.0).otherwise(0.0), F.lit(2))
    return total


def classification_metrics(pred: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Accuracy, log loss and multiclass Brier score in one aggregate."""
    p = clip(prob_of(F.col("label"), EPS), EPS, 1 - EPS)
    return pred.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"),
        F.avg(-F.log(p)).alias("log_loss"),
        F.avg(multiclass_brier(labels)).alias("brier"),
    )


def pinball(q: float) -> Column:
    d = F.col("label") - F.col("prediction")
    return F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d)


def regression_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = F.col("prediction") - F.col("label")
    return pred.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        F.avg(pinball(0.5)).alias("pinball"))


def bin_of(p: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(p * bins).cast("int")))


def _binned(pred: DataFrame, p: Column, hit: Column, bins: int, by: list[str]) -> DataFrame:
    return pred.groupBy(*by, bin_of(p, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_prediction"), F.avg(hit.cast("double")).alias("empirical_rate"))


def reliability(pred: DataFrame, label: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Reliability bins for one class. Without groups the empty bins are listed too."""
    out = _binned(pred, prob_of(label), F.col("label") == label, bins, by or [])
    if by:
        return out
    every = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(out, "bin", "left").select(
        "bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["count", "mean_prediction", "empirical_rate"]])


def ece(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    gap = F.col("count") * F.abs(F.col("mean_prediction") - F.col("empirical_rate"))
    return bins.groupBy(*(by or [])).agg(F.try_divide(F.sum(gap), F.sum("count")).alias("ece"), F.sum("count").alias("n"))


def calibration_report(pred: DataFrame, labels: list[str], bins: int = 10) -> DataFrame:
    """Top-label error, one-vs-rest error per class and their mean, from one
    grouped pass over (class, bin)."""
    top = top_of(F.col("probs"))
    entry = F.array(F.struct(F.lit("top_label").alias("class"), top["p"].alias("p"), (F.col("label") == top["label"]).alias("hit")),
                    *[F.struct(F.lit(x).alias("class"), prob_of(x).alias("p"), (F.col("label") == x).alias("hit")) for x in labels])
    long = pred.select(F.inline(entry))
    per = ece(_binned(long, F.col("p"), F.col("hit"), bins, ["class"]), ["class"]).select("class", "ece")
    macro = per.filter(F.col("class") != "top_label").agg(F.avg("ece").alias("ece")).select(F.lit("macro").alias("class"), "ece")
    return per.unionByName(macro)


def exact_quantiles(df: DataFrame, part: list[str], value: str, row_id: str, levels: dict[str, float]) -> DataFrame:
    """The value at index round((n-1)q) of each group, by distributed rank, so a
    large group is never sorted in one task. Index rounding is half to even."""
    ranked = rank_within(df.select(*part, value, row_id).filter(F.col(value).isNotNull()), part, [value, row_id])
    want = {n: F.bround((F.col("n") - 1) * F.lit(q), 0).cast("long") + 1 for n, q in levels.items()}
    return ranked.groupBy(*part).agg(*[F.max(F.when(F.col("rank") == w, F.col(value))).alias(n) for n, w in want.items()])


def exact_median(df: DataFrame, part: list[str], value: str, row_id: str, name: str = "median") -> DataFrame:
    ranked = rank_within(df.select(*part, value, row_id).filter(F.col(value).isNotNull()), part, [value, row_id])
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    return ranked.filter((F.col("rank") == low) | (F.col("rank") == high)).groupBy(*part).agg(F.avg(value).alias(name))


def interval_report(pred: DataFrame, train: DataFrame) -> DataFrame:
    """Coverage of [lower, upper], median width against the training IQR, and
    pinball loss against the training median."""
    spread = exact_quantiles(train.withColumn("_k", F.lit(1)), ["_k"], "label", "row_id", {"q1": 0.25, "q3": 0.75})
    mid = exact_median(train.withColumn("_k", F.lit(1)), ["_k"], "label", "row_id")
    wide = pred.withColumn("width", F.col("upper") - F.col("lower")).withColumn("_k", F.lit(1))
    width = exact_median(wide, ["_k"], "width", "row_id", "width")
    # one row each
    stats = spread.join(mid, "_k").join(width, "_k")
    joined = wide.drop("width").join(F.broadcast(stats), "_k")
    base = F.col("label") - F.col("median")
    row = joined.groupBy("_k", "q1", "q3", "width").agg(
        F.avg(((F.col("lower") <= F.col("label")) & (F.col("label") <= F.col("upper"))).cast("int")).alias("coverage"),
        F.avg(pinball(0.5)).alias("loss"), F.avg(F.greatest(0.5 * base, -0.5 * base)).alias("base_loss"))
    iqr = F.col("q3") - F.col("q1")
    return row.select(
        "coverage", F.abs(F.col("coverage") - 0.8).alias("coverage_error"),
        F.coalesce(F.try_divide("width", iqr), F.lit(0.0)).alias("width_to_iqr"),
        (F.col("loss") / F.greatest(F.col("base_loss"), F.lit(EPS))).alias("pinball_ratio"))


# Features whose range is checked, and those whose values are.
NUMERIC_FEATURES = ["listing_price", "current_amount", "offer_to_asking_ratio", "round_number", "prior_turn_count",
                    "prior_counter_count", "event_hour"]
CATEGORICAL_FEATURES = ["category", "condition", "current_actor", "current_action"]


def support_profile(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numeric ranges as one row, seen category values as (feature, value) rows."""
    ranges = train.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in NUMERIC_FEATURES for n, f in (("min", F.min), ("max", F.max))])
    seen = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value"))
        for c in CATEGORICAL_FEATURES])).alias("s")).select("s.*").distinct()
    return ranges, seen


def abstain(df: DataFrame, profile: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Mark rows outside the training support. A missing number counts as 0.
    The ranges are one row; the seen values join by equality per feature."""
    ranges, seen = profile
    out = df.withColumn("_k", F.lit(1)).join(F.broadcast(ranges.withColumn("_k", F.lit(1))), "_k").drop("_k")
    outside = F.lit(False)
    for c in NUMERIC_FEATURES:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        outside = outside | F.coalesce((v < F.col(f"{c}_min")) | (v > F.col(f"{c}_max")), F.lit(False))
    for c in CATEGORICAL_FEATURES:
        values = seen.filter(F.col("feature") == c).select(F.col("value").alias(f"_v_{c}"))
        out = out.join(values, F.coalesce(F.col(c).cast("string"), F.lit("missing")) == F.col(f"_v_{c}"), "left")
        outside = outside | F.col(f"_v_{c}").isNull()
    drop = [f"{c}_{n}" for c in NUMERIC_FEATURES for n in ("min", "max")] + [f"_v_{c}" for c in CATEGORICAL_FEATURES]
    return out.withColumn("abstained", outside).drop(*drop)


def offer_band(ratio: Column) -> Column:
    r = F.coalesce(ratio, F.lit(0.0))
    return F.when(r < 0.7, "low_offer").when(r < 0.85, "middle_offer").otherwise("high_offer")


def calibration_slices(pred: DataFrame, label: str) -> DataFrame:
    """Five-bin calibration by category and by offer band."""
    long = pred.select("probs", "label", F.explode(F.array(
        F.struct(F.lit("category").alias("slice"), F.coalesce("category", F.lit("missing")).alias("key")),
        F.struct(F.lit("offer_range").alias("slice"), offer_band(F.col("offer_to_asking_ratio")).alias("key")))).alias("s")).select("probs", "label", "s.*")
    return ece(_binned(long, prob_of(label), F.col("label") == label, 5, ["slice", "key"]), ["slice", "key"])


def drift(pred: DataFrame, label: str, order: list) -> DataFrame:
    """Calibration error of the earlier and the later half."""
    ranked = global_rank(pred, order, "_r", total="_tot").withColumn(
        "half", F.when(F.col("_r") <= F.floor(F.col("_tot") / 2), "early").otherwise("late"))
    per = ece(_binned(ranked, prob_of(label), F.col("label") == label, 5, ["half"]), ["half"])
    row = per.agg(*[F.max(F.when(F.col("half") == h, F.col(c))).alias(f"{h}_{n}") for h in ("early", "late") for c, n in (("ece", "ece"), ("n", "rows"))])
    return row.withColumn("absolute_drift", F.abs(F.col("late_ece") - F.col("early_ece")))


def bootstrap_brier(pred: DataFrame, label: str, samples: int = 200, seed: int = 7) -> DataFrame:
    """Poisson bootstrap of the Brier score in one pass: each row draws a weight
    per replicate from its hash, replicates are summed side by side. The
    reference's random sequence is not reproduced."""
    err = F.pow(prob_of(label) - F.when(F.col("label") == label, 1.0).otherwise(0.0), F.lit(2))
    # Poisson(1) by its cumulative distribution
    cuts = [0.36787944117, 0.73575888234, 0.91969860292, 0.98101184311, 0.99634015317, 0.99940581518]
    rows = pred.select(err.alias("e"), "row_id")

    def weight(b: int) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(b), F.col("row_id")), F.lit(1 << 30)) / float(1 << 30)
        return sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))

    sums = rows.agg(*[F.struct(F.sum(weight(b) * F.col("e")).alias("s"), F.sum(weight(b)).alias("w")).alias(f"b{b}") for b in range(samples)])
    scores = sums.select(F.array_sort(F.array(*[F.try_divide(f"b{b}.s", f"b{b}.w") for b in range(samples)])).alias("s"))
    lo, hi = int(0.025 * (samples - 1)), int(0.975 * (samples - 1))
    return scores.select((F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / samples).alias("mean_brier"),
                         F.col("s")[lo].alias("low"), F.col("s")[hi].alias("high"))


def log_loss_one(p: Column, target: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return -(target * F.log(q) + (1 - target) * F.log(1 - q))


def evaluate_binary(pred: DataFrame) -> DataFrame:
    """Log loss, Brier, ten-bin calibration and lift over the base rate, for
    columns p and target. Two bounded passes: per bin, then over ten rows."""
    p, t = clip(F.col("p"), 1e-6, 1 - 1e-6), F.col("target").cast("double")
    bins = pred.groupBy(bin_of(p, 10).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(p).alias("sp"), F.sum(t).alias("st"),
        F.sum(log_loss_one(p, t)).alias("sl"), F.sum((p - t) * (p - t)).alias("sb"))
    row = bins.agg(F.sum("c").alias("n"), F.sum("st").alias("st"), F.sum("sl").alias("sl"), F.sum("sb").alias("sb"),
                   F.sum(F.abs(F.col("sp") - F.col("st"))).alias("gap"))
    base = clip(F.col("st") / F.col("n"), 1e-6, 1 - 1e-6)
    mean_t = F.col("st") / F.col("n")
    base_loss = -(mean_t * F.log(base) + (1 - mean_t) * F.log(1 - base))
    return row.select("n", (F.col("sl") / F.col("n")).alias("log_loss"), (F.col("sb") / F.col("n")).alias("brier"),
                      (F.col("gap") / F.col("n")).alias("calibration_error"), base.alias("base_rate"),
                      (base_loss - F.col("sl") / F.col("n")).alias("lift"))


def paired_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean paired loss difference of two models with its interval, and the
    share of cases the second wins."""
    j = a.select("row_id", F.col("p").alias("pa"), "target").join(b.select("row_id", F.col("p").alias("pb")), "row_id")
    t = F.col("target").cast("double")
    d = j.select((log_loss_one(F.col("pa"), t) - log_loss_one(F.col("pb"), t)).alias("d"))
    row = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("improvement"), F.stddev_pop("d").alias("sd"),
                F.avg((F.col("d") > 0).cast("int")).alias("b_wins"))
    half = 1.96 * F.col("sd") / F.sqrt(F.col("n"))
    return row.select("n", "improvement", (F.col("improvement") - half).alias("low"), (F.col("improvement") + half).alias("high"), "b_wins")


def top_residuals(pred: DataFrame, k: int) -> DataFrame:
    """The k largest absolute errors; ties by row id."""
    r = pred.withColumn("residual", F.abs(F.col("target") - F.col("p")))
    return r.orderBy(F.desc("residual"), "row_id").limit(k).select("row_id", "p", "target", "residual")


def top_disagreements(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    j = a.select("row_id", F.col("p").alias("pa")).join(b.select("row_id", F.col("p").alias("pb")), "row_id")
    return j.withColumn("gap", F.abs(F.col("pa") - F.col("pb"))).orderBy(F.desc("gap"), "row_id").limit(k)


def recent_rate(df: DataFrame, order: list, n: int = 25) -> DataFrame:
    """Smoothed rate of the last n targets in order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).agg(
        ((F.sum("target") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("rate"), F.count(F.lit(1)).alias("rows"))


def assert_finite(df: DataFrame) -> DataFrame:
    """Rows per double column that are NaN or infinite; all zero when sound."""
    cols = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    bad = {c: F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c in cols}
    row = df.agg(*[v.alias(c) for c, v in bad.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("bad_rows")) for c in cols])))

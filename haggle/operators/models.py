"""Baselines and small models: a fit is a distributed aggregate or a
pyspark.ml estimator, a score is columns joined from the fitted table."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.scalar import clip, entropy_bits, logit, sigmoid
from haggle.operators.metrics import bin_of, exact_median, exact_quantiles, log_loss_one, top_of
from haggle.operators.rank import global_running
from haggle.session import written

KEEP = ["row_id", "label"]

#: Positions of history that nearest_ratio packs into one row.
RUN_POSITIONS = 32


def _num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _cat(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("missing"))


def class_labels(train: DataFrame) -> list[str]:
    """The class names; a handful by the label contract."""
    return sorted(r[0] for r in train.select("label").distinct().collect())


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one_row.withColumn("_k", F.lit(1))), "_k").drop("_k")


def normalize(raw: dict[str, Column]) -> Column:
    """Probabilities from non-negative weights; uniform when all are zero."""
    clean = {k: F.greatest(F.lit(0.0), v) for k, v in raw.items()}
    total = sum(clean.values(), F.lit(0.0))
    pairs = [x for k, v in clean.items() for x in (F.lit(k), F.when(total > 0, v / total).otherwise(1.0 / len(raw)))]
    return F.create_map(*pairs)


def counts_wide(df: DataFrame, labels: list[str], by: list[str], prefix: str = "n_") -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col("label") == x).alias(f"{prefix}{i}") for i, x in enumerate(labels)])


def _rates(labels: list[str], prefix: str) -> Column:
    return normalize({x: F.col(f"{prefix}{i}").cast("double") for i, x in enumerate(labels)})


def _pred(df: DataFrame, probs: Column) -> DataFrame:
    out = df.withColumn("probs", probs)
    return out.withColumn("prediction", top_of(F.col("probs"))["label"])


def majority(train: DataFrame, df: DataFrame, labels: list[str]) -> DataFrame:
    """Class rates of the training rows for every row; ties to the first label."""
    return _pred(_attach(df, counts_wide(train, labels, [])), _rates(labels, "n_")).drop(*[f"n_{i}" for i in range(len(labels))])


def category_majority(train: DataFrame, df: DataFrame, labels: list[str]) -> DataFrame:
    per = counts_wide(train.withColumn("_cat", _cat("category")), labels, ["_cat"], "c_")
    wide = _attach(df.withColumn("_cat", _cat("category")), counts_wide(train, labels, [])).join(per, "_cat", "left")
    probs = F.when(F.col("c_0").isNotNull(), _rates(labels, "c_")).otherwise(_rates(labels, "n_"))
    drop = [f"{p}{i}" for p in ("n_", "c_") for i in range(len(labels))]
    return _pred(wide, probs).drop("_cat", *drop)


def ratio_rule(df: DataFrame, accept: float = 0.85, counter: float = 0.65) -> DataFrame:
    r = _num("offer_to_asking_ratio")
    label = F.when(r >= accept, "accept").when(r >= counter, "counter").otherwise("decline")
    probs = F.create_map(*[x for k in ["accept", "counter", "decline", "expire"]
                           for x in (F.lit(k), F.when(F.col("prediction") == k, 0.85).otherwise(0.05))])
    return df.withColumn("prediction", label).withColumn("probs", probs)


def _pointed(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.withColumn("probs", normalize({k: F.when(F.col("prediction") == k, 0.85).otherwise(0.05) for k in labels}))


def prior_concession_rule(train: DataFrame, df: DataFrame, labels: list[str]) -> DataFrame:
    """A counter after an earlier counter, else the class rates."""
    base = majority(train, df, labels)
    if "counter" not in labels:
        return base
    hit = _num("prior_counter_count") > 0
    pointed = normalize({k: F.lit(0.85 if k == "counter" else 0.05) for k in labels})
    return base.withColumns({"probs": F.when(hit, pointed).otherwise(F.col("probs")),
                             "prediction": F.when(hit, "counter").otherwise(F.col("prediction"))})


def split_difference_rule(df: DataFrame, labels: list[str]) -> DataFrame:
    r = _num("offer_to_asking_ratio")
    label = F.lit("decline" if "decline" in labels else labels[0])
    if "counter" in labels:
        label = F.when(r >= 0.5, "counter").otherwise(label)
    if "accept" in labels:
        label = F.when(r >= 0.875, "accept").otherwise(label)
    return _pointed(df.withColumn("prediction", label), labels)


def regression_baselines(train: DataFrame, df: DataFrame) -> DataFrame:
    """Six regressors side by side: median, category median, slope through the
    origin, midpoint, concession shift and median split."""
    t = train.withColumns({"_cat": _cat("category"), "_r": _num("offer_to_asking_ratio"), "_one": F.lit(1)})
    med = exact_median(t, ["_one"], "label", "row_id", "m_all").drop("_one")
    cat = exact_median(t, ["_cat"], "label", "row_id", "m_cat")
    cut = exact_median(t, ["_one"], "_r", "row_id", "cut")
    prior = _num("prior_counter_count")
    y, r = F.col("label"), F.col("_r")
    stats = t.join(F.broadcast(cut), "_one").groupBy("cut").agg(
        F.coalesce(F.try_divide(F.sum(r * y), F.sum(r * r)), F.lit(1.0)).alias("slope"), F.avg(y).alias("base"),
        F.avg(F.when(prior > 0, y)).alias("pos"), F.avg(F.when(prior <= 0, y)).alias("zero"),
        F.avg(F.when(r < F.col("cut"), y)).alias("left"), F.avg(F.when(r >= F.col("cut"), y)).alias("right"))
    d = _attach(_attach(df.withColumns({"_cat": _cat("category"), "_r": _num("offer_to_asking_ratio")}), med), stats).join(cat, "_cat", "left")
    price, amount = _num("listing_price"), _num("current_amount")
    step = F.coalesce("pos", "base") - F.coalesce("zero", "base")
    return d.select(
        "row_id", "label", F.col("m_all").alias("median_regressor"), F.coalesce("m_cat", "m_all").alias("category_median_regressor"),
        (F.col("_r") * F.col("slope")).alias("offer_ratio_regressor"),
        F.when(price != 0, (amount + price) / 2 / price).otherwise(0.0).alias("split_the_difference_regressor"),
        (F.col("base") + step * F.least(prior, F.lit(1.0))).alias("prior_concession_regressor"),
        F.when(F.col("_r") >= F.col("cut"), F.coalesce("right", "base")).otherwise(F.coalesce("left", "base")).alias("small_tree_regressor"))


def ratio_bin(bins: int = 8) -> Column:
    r = clip(_num("offer_to_asking_ratio"), 0.0, 1.5)
    return F.least(F.lit(bins - 1), F.floor(r / 1.5 * bins).cast("int"))


def offer_histogram(train: DataFrame, df: DataFrame, labels: list[str], bins: int = 8, smoothing: float = 1.0) -> DataFrame:
    """Smoothed class counts by category and ratio bin."""
    keyed = {"_cat": _cat("category"), "_bin": ratio_bin(bins)}
    per = counts_wide(train.withColumns(keyed), labels, ["_cat", "_bin"], "c_")
    d = _attach(df.withColumns(keyed), counts_wide(train, labels, [])).join(per, ["_cat", "_bin"], "left")
    raw = {x: F.coalesce(f"c_{i}", F.lit(0)) + smoothing * (F.col(f"n_{i}") + smoothing) for i, x in enumerate(labels)}
    return _pred(d, normalize(raw)).drop("_cat", "_bin", *[f"{p}{i}" for p in ("n_", "c_") for i in range(len(labels))])


def stump_votes(train: DataFrame, df: DataFrame, labels: list[str]) -> DataFrame:
    """Votes of three median stumps and two category stumps."""
    d, votes = df, {x: F.lit(1.0) for x in labels}
    drop = []
    for f in ["offer_to_asking_ratio", "round_number", "prior_counter_count"]:
        t = train.withColumns({"_v": _num(f), "_one": F.lit(1)})
        cut = exact_median(t, ["_one"], "_v", "row_id", f"cut_{f}")
        side = t.join(F.broadcast(cut), "_one").withColumn("_side", F.col("_v") >= F.col(f"cut_{f}"))
        row = side.agg(*[F.count_if((F.col("label") == x) & (F.col("_side") if s else ~F.col("_side"))).alias(f"{f}_{int(s)}_{i}")
                         for s in (True, False) for i, x in enumerate(labels)])
        d = _attach(_attach(d, cut.drop("_one")), row)
        for i, x in enumerate(labels):
            votes[x] = votes[x] + F.when(_num(f) >= F.col(f"cut_{f}"), F.col(f"{f}_1_{i}")).otherwise(F.col(f"{f}_0_{i}"))
        drop += [f"cut_{f}", *[f"{f}_{s}_{i}" for s in (0, 1) for i in range(len(labels))]]
    for f in ["category", "current_action"]:
        per = counts_wide(train.withColumn(f"_{f}", _cat(f)), labels, [f"_{f}"], f"{f}_")
        d = d.withColumn(f"_{f}", _cat(f)).join(per, f"_{f}", "left")
        for i, x in enumerate(labels):
            votes[x] = votes[x] + F.coalesce(f"{f}_{i}", F.lit(0))
        drop += [f"_{f}", *[f"{f}_{i}" for i in range(len(labels))]]
    return _pred(d, normalize(votes)).drop(*drop)


def _pool(values: list[float], weights: list[float]) -> list[float]:
    """Pool adjacent violators over a handful of bins."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in blocks for _ in range(n)]


def monotone_accept(train: DataFrame, df: DataFrame, labels: list[str], positive: str = "accept", bins: int = 8) -> DataFrame:
    """Acceptance rate by ratio bin, made monotone, the rest by class share."""
    found = {r["_bin"]: (r["a"], r["n"]) for r in train.withColumn("_bin", ratio_bin(bins)).groupBy("_bin").agg(
        F.count_if(F.col("label") == positive).alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    cells = [found.get(b, (0, 0)) for b in range(bins)]
    curve = _pool([(a + 0.5) / (n + 1.0) for a, n in cells], [max(n, 1) for _, n in cells])
    others = [x for x in labels if x != positive]
    d = _attach(df, counts_wide(train, labels, []))
    total = sum((F.col(f"n_{i}") for i, x in enumerate(labels) if x != positive), F.lit(0))
    p = F.element_at(F.array(*[F.lit(float(v)) for v in curve]), ratio_bin(bins) + 1)
    raw = {x: p if x == positive else (1 - p) * (F.col(f"n_{i}") + 1.0) / (total + len(others)) for i, x in enumerate(labels)}
    return _pred(d, normalize(raw)).drop(*[f"n_{i}" for i in range(len(labels))])


def category_quantiles(train: DataFrame, df: DataFrame, lower: float = 0.1, upper: float = 0.9) -> DataFrame:
    """Median, lower and upper label of the category, else of all rows."""
    levels = {"lower": lower, "median": 0.5, "upper": upper}
    t = train.withColumns({"_cat": _cat("category"), "_one": F.lit(1)})
    per = exact_quantiles(t, ["_cat"], "label", "row_id", levels)
    every = exact_quantiles(t, ["_one"], "label", "row_id", {f"g_{k}": v for k, v in levels.items()}).drop("_one")
    d = _attach(df.withColumn("_cat", _cat("category")), every).join(per, "_cat", "left")
    return d.select(*KEEP, F.coalesce("median", "g_median").alias("prediction"), F.coalesce("lower", "g_lower").alias("lower"),
                    F.coalesce("upper", "g_upper").alias("upper"))


def terms() -> dict[str, Column]:
    """The named formula terms as columns."""
    r, amount, price = _num("offer_to_asking_ratio"), _num("current_amount"), _num("listing_price")
    rounds, prior = _num("round_number"), _num("prior_counter_count")

    def over_price(x: Column) -> Column:
        return F.when(price != 0, x / price).otherwise(0.0)

    return {
        "relative_offer": r, "gap_to_listing": over_price(price - amount), "round_number": rounds,
        "timing_hour": _num("event_hour") / 24.0, "seller_experience": prior, "prior_counter_count": prior,
        "listing_price_ratio": over_price(amount),
        "category_refurbished": F.when(F.lower(F.coalesce("category", F.lit(""))).contains("refurbished"), 1.0).otherwise(0.0),
        "relative_offer_below_70": F.when(r < 0.70, 1.0).otherwise(0.0),
        "relative_offer_above_85": F.when(r >= 0.85, 1.0).otherwise(0.0), "relative_offer_x_round": r * rounds,
    }


# The five candidate formulas, their target class and terms.
FORMULAS = {
    "formula_relative_offer_accept": ("accept", ["relative_offer", "gap_to_listing", "round_number"]),
    "formula_low_offer_decline": ("decline", ["relative_offer_below_70", "gap_to_listing", "seller_experience"]),
    "formula_concession_counter": ("counter", ["relative_offer", "prior_counter_count", "round_number"]),
    "formula_timing_category_interaction": ("counter", ["timing_hour", "category_refurbished", "relative_offer_x_round"]),
    "formula_listing_price_threshold": ("accept", ["listing_price_ratio", "relative_offer_above_85", "round_number"]),
}


def formula_models(train: DataFrame, dev: DataFrame, labels: list[str]) -> DataFrame:
    """Development log loss of every formula against the base rate. All
    coefficients come from one aggregate, all losses from a second."""
    t = terms()
    means = [F.avg(F.when((F.col("label") == g) == s, t[x])).alias(f"{f}__{x}__{int(s)}")
             for f, (g, xs) in FORMULAS.items() for x in xs for s in (True, False)]
    fit = train.agg(*means, F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == x).alias(f"n_{i}") for i, x in enumerate(labels)])
    d = _attach(dev, fit)
    n, cell = F.col("n"), {x: F.col(f"n_{i}") for i, x in enumerate(labels)}
    truth = F.col("label")

    def loss(probs: dict[str, Column]) -> Column:
        clean = {k: F.greatest(F.lit(0.0), v) for k, v in probs.items()}
        total = sum(clean.values(), F.lit(0.0))
        mine = sum((F.when(truth == k, v).otherwise(0.0) for k, v in clean.items()), F.lit(0.0))
        return -F.log(clip(mine / total, 1e-12, 1 - 1e-12))

    out = {"baseline": loss({k: c / n for k, c in cell.items()})}
    for f, (g, xs) in FORMULAS.items():
        hits = cell.get(g, F.lit(0))
        rate = (hits + 0.5) / (n + 1.0)
        score = F.log(rate / F.greatest(1 - rate, F.lit(1e-9)))
        for x in xs:
            coef = F.coalesce(f"{f}__{x}__1", F.lit(0.0)) - F.coalesce(f"{f}__{x}__0", F.lit(0.0))
            score = score + coef * t[x]
        p = sigmoid(score, 20.0)
        others = [k for k in labels if k != g]
        rest = sum((cell[k] for k in others), F.lit(0))
        out[f] = loss({**{k: (1 - p) * (cell[k] + 1.0) / (rest + len(others)) for k in others}, g: p})
    row = d.agg(*[F.avg(c).alias(k) for k, c in out.items()])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("formula_id"), F.col(f).alias("log_loss"), F.col("baseline").alias("baseline_log_loss"),
        F.lit(len(FORMULAS[f][1])).alias("complexity"), (F.col(f) < F.col("baseline")).alias("passed")) for f in FORMULAS])))


def rank_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features by standardised mean difference of the binary target."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.when(F.col("target") == 1, _num(f))).alias(f"{f}_p"), F.avg(F.when(F.col("target") == 0, _num(f))).alias(f"{f}_q"),
                 F.stddev_pop(_num(f)).alias(f"{f}_s")]
    score = {f: F.coalesce(F.abs(F.col(f"{f}_p") - F.col(f"{f}_q")) / F.greatest(F.col(f"{f}_s"), F.lit(1e-9)), F.lit(0.0)) for f in features}
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), s.alias("score")) for f, s in score.items()])))


def residual_terms(df: DataFrame, features: list[str]) -> DataFrame:
    """Features by absolute correlation with the residual target - p."""
    r = F.col("target") - F.col("p")
    aggs = [F.corr(_num(f), r).alias(f) for f in features] + [F.stddev_pop(_num(f)).alias(f"{f}_s") for f in features]
    row = df.agg(*aggs, F.stddev_pop(r).alias("_rs"))
    ok = {f: F.when((F.col(f"{f}_s") > 1e-9) & (F.col("_rs") > 1e-9), F.abs(F.col(f))).otherwise(0.0) for f in features}
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), s.alias("score")) for f, s in ok.items()])))


def threshold_rule(train: DataFrame, variables: list[str], limit: int = 25) -> DataFrame:
    """Best single threshold over at most `limit` evenly spaced cut points per
    variable, by closed-form log loss of the two smoothed rates. Cumulative
    counts over the distinct values come from one range sort of all variables."""
    long = train.select("target", F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(v).alias("variable"), _num(v).alias("value")) for i, v in enumerate(variables)])).alias("e")).select("target", "e.*")
    per = long.groupBy("pos", "variable", "value").agg(F.count(F.lit(1)).alias("c"), F.sum("target").alias("s"))
    run = global_running(per, ["pos", "value"], {"cum_c": F.col("c"), "cum_s": F.col("s")})
    span = run.groupBy("pos").agg(F.min("rank").alias("r0"), F.count(F.lit(1)).alias("distinct"),
                                  F.max("cum_c").alias("end_c"), F.max("cum_s").alias("end_s"), F.sum("c").alias("n"), F.sum("s").alias("k"))
    nxt = run.select((F.col("rank") - 1).alias("rank"), F.col("value").alias("next_value"), F.col("pos").alias("next_pos"))
    j = run.join(F.broadcast(span), "pos").join(nxt, "rank").filter(F.col("pos") == F.col("next_pos"))
    idx, cuts = F.col("rank") - F.col("r0"), F.col("distinct") - 1
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (cuts - 1) / float(limit - 1), 0).cast("long"))
    j = j.filter((cuts <= limit) | F.array_contains(picks, idx))
    low_n = F.col("cum_c") - (F.col("end_c") - F.col("n"))
    low_k = F.col("cum_s") - (F.col("end_s") - F.col("k"))
    high_n, high_k = F.col("n") - low_n, F.col("k") - low_k
    low, high = (low_k + 1.0) / (low_n + 2.0), (high_k + 1.0) / (high_n + 2.0)

    def part(p: Column, m: Column, s: Column) -> Column:
        q = clip(p, 1e-6, 1 - 1e-6)
        return -(s * F.log(q) + (m - s) * F.log(1 - q))

    j = j.select("variable", "pos", ((F.col("value") + F.col("next_value")) / 2).alias("threshold"), low.alias("low_rate"), high.alias("high_rate"),
                 ((part(low, low_n, low_k) + part(high, high_n, high_k)) / F.col("n")).alias("log_loss"))
    return j.orderBy(F.round("log_loss", 12), "pos", "threshold").limit(1).drop("pos")


def score_proposals(train: DataFrame, rows: DataFrame, proposals: dict[str, tuple[str, list[Column]]]) -> DataFrame:
    """Log loss of many proposed term sets at once: thresholds in one aggregate
    over the training rows, losses in a second over the scored rows."""
    score = {k: sum(ts, F.lit(0.0)) for k, (_, ts) in proposals.items()}
    fit = train.agg(F.count(F.lit(1)).alias("n"), *[a for k, (g, _) in proposals.items() for a in (
        F.avg(F.when(F.col("label") == g, score[k])).alias(f"{k}_p"), F.avg(F.when(F.col("label") != g, score[k])).alias(f"{k}_q"),
        F.count_if(F.col("label") == g).alias(f"{k}_n"))])
    d = _attach(rows, fit)
    losses = []
    for k, (g, _) in proposals.items():
        mid = (F.coalesce(f"{k}_p", F.lit(0.0)) + F.coalesce(f"{k}_q", F.lit(0.0))) / 2.0
        p = (F.col(f"{k}_n") + 0.5) / (F.col("n") + 1.0) + 0.25 * F.tanh(score[k] - mid)
        losses.append(F.avg(log_loss_one(p, F.when(F.col("label") == g, 1.0).otherwise(0.0))).alias(k))
    row = d.agg(*losses)
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("proposal_id"), F.lit(len(ts)).alias("complexity"),
                                                  F.col(k).alias("log_loss")) for k, (_, ts) in proposals.items()])))


def leaderboard(scores: DataFrame, metric: str, baselines: list[str], tolerance: float = 0.01) -> DataFrame:
    """Relative improvement over the best baseline per (split, target), and the
    pick: among models within the tolerance of the best, the simplest, then by
    id. `scores` has one row per split, target and model."""
    from pyspark.sql import Window

    group = Window.partitionBy("split", "target")
    base = F.min(F.when(F.col("model").isin(baselines), F.col(metric))).over(group)
    s = scores.withColumns({"baseline": base, "best": F.min(metric).over(group)})
    s = s.withColumn("relative_improvement", F.try_divide(F.col("baseline") - F.col(metric), F.col("baseline")))
    near = F.when(F.col(metric) <= F.col("best") * (1 + tolerance), 0).otherwise(1)
    pick = F.row_number().over(group.orderBy(near, "complexity", "model"))
    return s.withColumn("selected", pick == 1).drop("best")


def encoder(numeric: list[str], categorical: list[str]) -> Pipeline:
    """Standardised numbers and one-hot categories in one vector."""
    stages = [StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep"),
              OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_oh" for c in categorical]),
              VectorAssembler(inputCols=numeric, outputCol="num_vec"),
              StandardScaler(inputCol="num_vec", outputCol="num_std", withMean=True),
              VectorAssembler(inputCols=["num_std", *[f"{c}_oh" for c in categorical]], outputCol="features_vec")]
    return Pipeline(stages=stages)


def _clean(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    return df.withColumns({**{c: _num(c) for c in numeric}, **{c: _cat(c) for c in categorical}})


def glm(train: DataFrame, df: DataFrame, numeric: list[str], categorical: list[str], reg: float = 0.01) -> DataFrame:
    """Regularised multinomial logistic regression."""
    t, d = _clean(train, numeric, categorical), _clean(df, numeric, categorical)
    enc = encoder(numeric, categorical).fit(t)
    names = StringIndexer(inputCol="label", outputCol="label_ix", handleInvalid="keep", stringOrderType="alphabetAsc").fit(t)
    labels = names.labels
    model = LogisticRegression(featuresCol="features_vec", labelCol="label_ix", regParam=reg, maxIter=50, family="multinomial").fit(
        names.transform(enc.transform(t)))
    arr = vector_to_array(F.col("probability"))
    probs = F.create_map(*[x for i, k in enumerate(labels) for x in (F.lit(k), arr[i])])
    scored = model.transform(enc.transform(d)).drop("prediction")
    return _pred(scored, probs).select(*df.columns, "probs", "prediction")


def linear(train: DataFrame, df: DataFrame, numeric: list[str], categorical: list[str], reg: float = 0.01) -> DataFrame:
    t, d = _clean(train, numeric, categorical), _clean(df, numeric, categorical)
    enc = encoder(numeric, categorical).fit(t)
    model = LinearRegression(featuresCol="features_vec", labelCol="label", regParam=reg, maxIter=50).fit(enc.transform(t))
    return model.transform(enc.transform(d)).select("row_id", "label", "prediction")


# Functions a term expression may call; anything else is refused.
TERM_FUNCTIONS = ["abs", "log", "log1p", "sqrt", "exp", "least", "greatest", "if", "tanh", "pow"]


def term_columns(exprs: list[str], columns: list[str]) -> list[Column]:
    """Spark SQL expressions as terms, checked against a closed list of
    functions and the known columns."""
    import re

    for e in exprs:
        if re.search(r"[;'\"`]|--|/\*", e):
            raise ValueError(f"term {e!r} holds a character that is not allowed")
        for name, call in re.findall(r"([A-Za-z_]\w*)\s*(\()?", e):
            if call and name.lower() not in TERM_FUNCTIONS:
                raise ValueError(f"function {name} is not allowed in a term")
            if not call and name not in columns and name.lower() not in ("and", "or", "not"):
                raise ValueError(f"unknown column {name} in a term")
    return [F.expr(f"coalesce(cast({e} as double), 0.0)") for e in exprs]


def fit_terms(train: DataFrame, exprs: list[str], l2: float = 0.01):
    """Logistic fit of a term list; weights are on the original scale."""
    cols = term_columns(exprs, train.columns)
    names = [f"t{i}" for i in range(len(cols))]
    flat = train.select("target", *[c.alias(n) for c, n in zip(cols, names)])
    vec = VectorAssembler(inputCols=names, outputCol="v").transform(flat)
    m = LogisticRegression(featuresCol="v", labelCol="target", regParam=l2, standardization=True, maxIter=100).fit(vec)
    return float(m.intercept), [float(w) for w in m.coefficients]


def score_terms(df: DataFrame, exprs: list[str], fitted) -> DataFrame:
    b, ws = fitted
    z = sum((F.lit(w) * c for w, c in zip(ws, term_columns(exprs, df.columns))), F.lit(b))
    return df.withColumn("p", sigmoid(z))


def two_state(train: DataFrame, df: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """Two clusters of the standardised features, each with its smoothed rate,
    mixed by exp(-distance)."""
    t = train.select("target", *[_num(f).alias(f) for f in features])
    row = t.agg(*[F.avg(f).alias(f"{f}_m") for f in features], *[F.stddev_pop(f).alias(f"{f}_s") for f in features]).first()
    mean = {f: row[f"{f}_m"] for f in features}
    scale = {f: row[f"{f}_s"] if row[f"{f}_s"] and row[f"{f}_s"] > 1e-9 else 1.0 for f in features}

    def std(d: DataFrame) -> DataFrame:
        return d.withColumns({f"_z_{f}": (_num(f) - mean[f]) / scale[f] for f in features})

    vec = VectorAssembler(inputCols=[f"_z_{f}" for f in features], outputCol="_v")
    model = KMeans(k=2, featuresCol="_v", predictionCol="_state", maxIter=20, seed=seed).fit(vec.transform(std(t)))
    rate = {r["_state"]: (r["s"] + 1.0) / (r["n"] + 2.0) for r in model.transform(vec.transform(std(t))).groupBy("_state").agg(
        F.sum("target").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    d, w = std(df), []
    for center in model.clusterCenters():
        dist = sum((F.pow(F.col(f"_z_{f}") - F.lit(float(c)), F.lit(2)) for f, c in zip(features, center)), F.lit(0.0))
        w.append(F.exp(-F.least(dist, F.lit(50.0))))
    p = sum((wi * rate.get(i, 0.5) for i, wi in enumerate(w)), F.lit(0.0)) / sum(w, F.lit(0.0))
    return d.withColumn("p", p).drop(*[f"_z_{f}" for f in features])


def platt(pred: DataFrame) -> DataFrame:
    """Sigmoid calibration of p: a logistic fit on its logit."""
    x = pred.withColumn("_x", logit(F.col("p")))
    vec = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(x)
    m = LogisticRegression(featuresCol="_v", labelCol="target", maxIter=100).fit(vec)
    return x.withColumn("calibrated", sigmoid(F.lit(float(m.coefficients[0])) * F.col("_x") + F.lit(float(m.intercept)))).drop("_x")


def nearest_ratio(candidates: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """The k history rows of the same category nearest in ratio, per candidate.

    Both sides are laid on one line per category in ratio order; a nearest row
    is among the k before or the k after the candidate. History rows get their
    position by a distributed rank, a candidate's position is the number of
    history rows at or below it. History is packed by runs of positions, each with
    k more at both ends, so a candidate meets one run, takes its 2k positions
    out of that and keeps k: no row per position is joined or shuffled."""
    c = candidates.select("cand_id", "category", "ratio")
    h = history.select("hist_id", "category", "ratio", "label")
    kind = h.schema["label"].dataType
    line = written(h.select("category", "ratio", F.lit(0).alias("side"), F.col("hist_id").alias("id"), "label").unionByName(
        c.select("category", "ratio", F.lit(1).alias("side"), F.col("cand_id").alias("id"), F.lit(None).cast(kind).alias("label"))), "line")
    # ids that repeat: a history row has the labels of all rows of its id, candidates of one id share their k
    again = {r["side"] for r in line.groupBy("side", F.xxhash64("id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("side").distinct().collect()}
    run = global_running(line, ["category", "ratio", "side", "id"], {"pos": (F.col("side") == 0).cast("long")})

    held = run.filter("side = 0").select(F.col("id").alias("hist_id"), F.col("category").alias("h_category"), F.col("ratio").alias("h_ratio"), "pos", "label")
    if 0 in again:
        labels = line.filter("side = 0").groupBy(F.col("id").alias("hist_id")).agg(F.collect_list(F.struct("label")).alias("labels"))
        held = held.join(labels, "hist_id", "left").withColumn("label", F.explode_outer("labels.label")).drop("labels")
    width = max(RUN_POSITIONS, 4 * k)
    first, last = (F.floor((F.col("pos") + d) / width) for d in (-k, k - 1))
    runs = held.withColumn("run", F.explode(F.sequence(first, last))).groupBy("run").agg(
        F.sort_array(F.collect_list(F.struct("pos", "hist_id", "h_category", "h_ratio", "label"))).alias("held"))

    spot = run.filter("side = 1").select(F.col("id").alias("cand_id"), "category", "ratio", "pos", F.floor(F.col("pos") / width).alias("run"))
    low = F.greatest(F.col("pos") - (k - 1), F.lit(1))
    if 0 in again:  # several rows of one position
        around = F.filter("held", lambda x: (x["pos"] >= low) & (x["pos"] <= F.col("pos") + k))
    else:
        base = F.greatest(F.col("run") * width - (k - 1), F.lit(1))
        around = F.slice("held", (low - base + 1).cast("int"), (F.col("pos") + k - low + 1).cast("int"))

    def place(x: Column, i: Column) -> Column:
        after = x["h_ratio"] > F.col("ratio")
        # ties go to the closest position on the line
        return F.when(x["hist_id"].isNotNull() & (x["h_category"] == F.col("category")), F.struct(
            F.abs(x["h_ratio"] - F.col("ratio")).alias("gap"), after.alias("after"), F.when(after, x["pos"]).otherwise(-x["pos"]).alias("closest"), (i + 1).alias("at")))

    # the places of at most 2k rows are sorted, the rows themselves are taken by place
    met = spot.join(runs, "run").select("cand_id", "category", "ratio", "pos", around.alias("around"))
    met = met.withColumn("best", F.slice(F.sort_array(F.array_compact(F.transform("around", place))), 1, k))
    row = lambda x: F.struct(x["gap"].alias("gap"), x["after"].alias("after"), x["closest"].alias("closest"), "category", "ratio", *[
        F.try_element_at("around", x["at"])[c].alias(c) for c in ("hist_id", "h_ratio", "label")])
    if 1 not in again:
        return met.select("cand_id", "around", "category", "ratio", F.posexplode("best").alias("nearest", "x")).select("cand_id", row(F.col("x")).alias("x"), "nearest").select(
            "cand_id", "x.category", "x.ratio", "x.hist_id", "x.h_ratio", "x.label", (F.col("nearest") + 1).alias("nearest"))
    near = met.select("cand_id", F.transform("best", row).alias("near"))
    near = near.groupBy("cand_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return near.select("cand_id", F.posexplode("near").alias("nearest", "x")).select(
        "cand_id", "x.category", "x.ratio", "x.hist_id", "x.h_ratio", "x.label", (F.col("nearest") + 1).alias("nearest"))


def offer_frontier(candidates: DataFrame, history: DataFrame, k: int = 5) -> DataFrame:
    """Response shares of the k nearest counters for candidates inside the
    observed ratio range of their category."""
    seen = history.filter("ratio > 0").groupBy("category").agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"))
    c = candidates.join(seen, "category", "left").withColumn(
        "supported", F.coalesce((F.col("ratio") >= F.col("low")) & (F.col("ratio") <= F.col("high")), F.lit(False)))
    near = nearest_ratio(c.filter("supported"), history, k)
    state = F.when(F.lower("label") == "accept", "accept").when(F.lower("label") == "counter", "counter").otherwise("exit")
    share = near.withColumn("s", state).groupBy("cand_id").agg(
        F.count(F.lit(1)).alias("comparables"), *[F.avg((F.col("s") == x).cast("int")).alias(f"p_{x}") for x in ("accept", "counter", "exit")])
    ent = entropy_bits(F.col("p_accept")) + entropy_bits(F.col("p_counter")) + entropy_bits(F.col("p_exit"))
    return c.select("cand_id", "category", "ratio", "supported").join(share, "cand_id", "left").withColumns(
        {"expected_rounds": 1.0 + F.col("p_counter"), "response_entropy": ent})

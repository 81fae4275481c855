"""Off-policy values, uplift, randomised comparisons and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.scalar import hash_uniform
from haggle.operators.rank import global_rank


def ope(logs: DataFrame, policy: Column, cap: float = 10.0) -> DataFrame:
    """Five estimates of a target policy's value in one aggregate over the logs.
    `policy` is a map<action, probability>. The mean reward per action is a
    table of the logged actions; unlogged target actions count as violations."""
    means = logs.groupBy(F.col("action").cast("string").alias("a")).agg(F.avg("reward").alias("m"))
    # one entry per action
    table = means.agg(F.map_from_entries(F.collect_list(F.struct("a", "m"))).alias("_m")).withColumn("_k", F.lit(1))
    d = logs.withColumns({"_policy": policy, "_k": F.lit(1)}).join(F.broadcast(table), "_k")
    target = F.coalesce(F.try_element_at("_policy", F.col("action").cast("string")), F.lit(0.0))
    model = F.aggregate(F.map_entries("_policy"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("_m"), e["key"]), F.lit(0.0)))
    on = (target > 0) & (F.col("propensity") > 0)
    lost = (target > 0) & (F.col("propensity") <= 0)
    w = F.when(on, target / F.col("propensity")).otherwise(0.0)
    r = F.col("reward").cast("double")
    d = d.select(w.alias("w"), F.least(w, F.lit(cap)).alias("wc"), r.alias("r"), model.alias("dm"), lost.alias("lost"),
                 F.when(on, model + w * (r - F.try_element_at(F.col("_m"), F.col("action").cast("string")))).when(target <= 0, model).alias("dr"),
                 F.filter(F.map_keys("_policy"), lambda a: (F.element_at("_policy", a) > 0) & ~F.map_contains_key("_m", a)).alias("unlogged"))
    row = d.agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("on_policy"), F.count_if("lost").alias("lost"),
        F.size(F.array_distinct(F.flatten(F.collect_set("unlogged")))).alias("unlogged"),
        *[a for k, v in {"dm": F.col("dm"), "ips": F.col("w") * F.col("r"), "clip": F.col("wc") * F.col("r"), "dr": F.col("dr")}.items()
          for a in (F.avg(v).alias(f"{k}_v"), F.stddev_samp(v).alias(f"{k}_s"), F.count(v).alias(f"{k}_n"))],
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum("wc").alias("swc"), F.sum(F.col("wc") * F.col("wc")).alias("swc2"))
    c = F.col
    ess, essc = F.coalesce(F.try_divide(c("sw") * c("sw"), c("sw2")), F.lit(0.0)), F.coalesce(F.try_divide(c("swc") * c("swc"), c("swc2")), F.lit(0.0))
    none = F.lit(None).cast("double")
    mean_w = c("sw") / c("n")
    sn_v = F.coalesce(F.try_divide(c("ips_v"), mean_w), F.lit(0.0))
    violations = c("lost") + c("unlogged")
    rows = [("direct_method", c("dm_v"), c("dm_s"), c("dm_n"), none, c("unlogged").cast("long")), ("ips", c("ips_v"), c("ips_s"), c("ips_n"), ess, violations),
            ("self_normalized_ips", sn_v, F.try_divide(c("ips_s"), mean_w), c("ips_n"), ess, violations),
            ("doubly_robust", F.coalesce("dr_v", "dm_v"), c("dr_s"), c("dr_n"), ess, violations), ("switch_ips", c("clip_v"), c("clip_s"), c("clip_n"), essc, violations)]

    def item(name, v, s, n, e, bad):
        half = F.coalesce(1.96 * s / F.sqrt(n), F.lit(0.0))
        return F.struct(F.lit(name).alias("estimator"), v.alias("value"), e.alias("effective_sample_size"), bad.cast("long").alias("support_violations"),
                        (v - half).alias("low"), (v + half).alias("high"), (F.abs(v - c("on_policy")) / F.greatest(F.abs("on_policy"), F.lit(1e-12))).alias("relative_error"))

    return row.select(F.inline(F.array(*[item(*x) for x in rows])))


def unlogged_actions(logs: DataFrame, policy: DataFrame) -> DataFrame:
    """Target actions never logged (U4)."""
    return policy.filter("probability > 0").select("action").distinct().join(logs.select("action"), "action", "left_anti")


def uplift(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """Arm rates, effect, standard error and interval."""
    t = F.col(treatment) == 1
    y = F.col(outcome).cast("double")
    row = df.agg(F.count_if(t).alias("treatment_count"), F.count_if(~t).alias("control_count"), F.avg(F.when(t, y)).alias("treatment_rate"), F.avg(F.when(~t, y)).alias("control_rate"),
                 F.coalesce(F.var_samp(F.when(t, y)), F.lit(0.0)).alias("vt"), F.coalesce(F.var_samp(F.when(~t, y)), F.lit(0.0)).alias("vc"))
    ate, se = F.col("treatment_rate") - F.col("control_rate"), F.sqrt(F.col("vt") / F.col("treatment_count") + F.col("vc") / F.col("control_count"))
    return row.select("treatment_count", "control_count", "treatment_rate", "control_rate", ate.alias("ate"), se.alias("standard_error"),
                      (ate - 1.96 * se).alias("low"), (ate + 1.96 * se).alias("high"))


def compare_arms(trials: DataFrame, block: str = "block") -> DataFrame:
    """Randomised difference overall and per block: plain means with an
    Agresti-Caffo interval, or Hajek weights where probabilities vary. One pass:
    weighted sums carry the squared residuals."""
    t, y, p = F.col("treated") == 1, F.col("outcome").cast("double"), F.col("probability")
    w = F.when(t, 1 / p).otherwise(1 / (1 - p))
    keys = F.array(F.lit("all"), F.concat(F.lit("block="), F.coalesce(F.col(block).cast("string"), F.lit("unblocked"))))
    d = trials.select(t.alias("t"), y.alias("y"), p.alias("p"), w.alias("w"), F.coalesce("nonadherent", F.lit(False)).alias("bad"), F.explode(keys).alias("scope"))

    def arm(side: Column, n: str) -> list[Column]:
        v = lambda x: F.when(side, x)
        w2 = F.col("w") * F.col("w")
        return [F.count_if(side).alias(f"{n}n"), F.sum(v(F.col("y"))).alias(f"{n}y"), F.sum(v(F.col("w"))).alias(f"{n}w"), F.sum(v(F.col("w") * F.col("y"))).alias(f"{n}wy"),
                F.sum(v(w2)).alias(f"{n}q"), F.sum(v(w2 * F.col("y"))).alias(f"{n}qy"), F.sum(v(w2 * F.col("y") * F.col("y"))).alias(f"{n}qyy")]

    g = d.groupBy("scope").agg(*arm(F.col("t"), "t"), *arm(~F.col("t"), "c"), (F.max("p") - F.min("p") > 1e-12).alias("varying"), F.count_if("bad").alias("nonadherent"))
    c = F.col
    both = (c("tn") > 0) & (c("cn") > 0)

    def mean(n: str) -> Column:
        return F.coalesce(F.when(c("varying"), F.try_divide(c(f"{n}wy"), c(f"{n}w"))).otherwise(F.try_divide(c(f"{n}y"), c(f"{n}n"))), F.lit(0.0))

    def var(n: str) -> Column:
        m = c(f"{n}wy") / c(f"{n}w")
        return (c(f"{n}qyy") - 2 * m * c(f"{n}qy") + m * m * c(f"{n}q")) / (c(f"{n}w") * c(f"{n}w"))

    rt, rc = (F.coalesce("ty", F.lit(0.0)) + 1) / (c("tn") + 2), (F.coalesce("cy", F.lit(0.0)) + 1) / (c("cn") + 2)
    ac = F.sqrt(rt * (1 - rt) / (c("tn") + 2) + rc * (1 - rc) / (c("cn") + 2))
    hj = F.sqrt(F.greatest(var("t") + var("c"), F.lit(0.0)))
    use_h = c("varying") & (hj > 1e-12)
    g = g.withColumns({"treatment_mean": mean("t"), "comparator_mean": mean("c")})
    diff = c("treatment_mean") - c("comparator_mean")
    se = F.when(~both, 0.0).when(use_h, hj).otherwise(ac)
    mid = F.when(use_h, diff).otherwise(rt - rc)
    return g.withColumns({"difference": diff, "standard_error": se}).select(
        "scope", c("tn").alias("treatment_n"), c("cn").alias("comparator_n"), "treatment_mean", "comparator_mean", "difference", "standard_error",
        F.when(~both, -1.0).otherwise(F.greatest(F.lit(-1.0), mid - 1.96 * c("standard_error"))).alias("low"),
        F.when(~both, 1.0).otherwise(F.least(F.lit(1.0), mid + 1.96 * c("standard_error"))).alias("high"),
        F.when(c("varying"), "hajek_inverse_probability_weighted").otherwise("unweighted_randomized_difference_in_means").alias("estimator"), "nonadherent")


# Fixed edges of the experiment's price band.
def price_band(asking: Column) -> Column:
    a = F.coalesce(asking, F.lit(0.0))
    return F.when(a < 100, "under_100").when(a < 500, "100_499").otherwise("500_plus")


def assign(units: DataFrame, experiments: DataFrame) -> DataFrame:
    """Deterministic assignment by hash draw, the first planned units by time.

    Units carry experiment_id, offer_id, opened_at, assigned_at, decided, has
    outcome, exposed; only those free before exposure, decision and outcome and
    not backdated take part. The cap counts units by a distributed rank, so an
    experiment with a third of all units is not sorted in one task."""
    e = experiments.select("experiment_id", "created_at", "planned_units", "probability", "preregistration_hash")
    ok = ~F.col("decided") & ~F.col("matured") & ~F.col("exposed") & (F.col("assigned_at") >= F.col("created_at")) & (F.col("assigned_at") >= F.col("opened_at"))
    d = units.join(e, "experiment_id").filter(ok)
    ranked = global_rank(d, ["experiment_id", "assigned_at", "offer_id"], "_g")
    first = ranked.groupBy("experiment_id").agg(F.min("_g").alias("_first"))
    ranked = ranked.join(first, "experiment_id").withColumn("assignment_index", F.col("_g") - F.col("_first"))
    draw = hash_uniform(F.concat_ws("|", "experiment_id", "offer_id", "preregistration_hash"))
    return ranked.filter(F.col("assignment_index") < F.col("planned_units")).withColumns(
        {"draw": draw, "assigned_arm": F.when(draw < F.col("probability"), "treatment").otherwise("control")}).drop("_g", "_first")


def experiment_report(assignments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Arm counts and outcome difference, overall and by block."""
    latest = outcomes.groupBy("assignment_id").agg(F.max_by("value", "ordinal").alias("value"))
    d = assignments.join(latest, "assignment_id", "left").select(
        "assigned_arm", "value", F.explode(F.array(F.lit("all"), F.concat(F.lit("block="), F.col("block")))).alias("scope"))
    t = F.col("assigned_arm") == "treatment"
    g = d.groupBy("scope").agg(F.count_if(t).alias("treatment_n"), F.count_if(~t).alias("control_n"), F.count("value").alias("observed"),
                               F.avg(F.when(t, F.col("value"))).alias("treatment_mean"), F.avg(F.when(~t, F.col("value"))).alias("control_mean"))
    return g.withColumns({"missing": F.col("treatment_n") + F.col("control_n") - F.col("observed"),
                          "difference": F.round(F.col("treatment_mean") - F.col("control_mean"), 4)})


def propose(predictions: DataFrame, cost: float = 0.1, risk: float = 0.1, burden: float = 0.1) -> DataFrame:
    """Most useful experiment context: model disagreement minus cost, risk and
    burden (C7). Predictions have one row per context and model."""
    effect = F.col("p_treatment") - F.col("p_comparator")
    span = lambda c: F.max(c) - F.min(c)
    per = predictions.groupBy("context_id", "task_size_large", "fatigue").agg(
        F.greatest(span("p_treatment"), span("p_comparator"), span(effect)).alias("separation"))
    c = F.when(F.col("task_size_large") > 0, 0.2).otherwise(0.1)
    u = F.col("separation") - cost * c - risk * 0.05 - burden * (0.15 + 0.1 * F.col("fatigue"))
    return per.withColumn("utility", u).orderBy(F.desc("utility"), "context_id").limit(1)


def trial_integrity(prereg: DataFrame, assignments: DataFrame, trials: DataFrame) -> DataFrame:
    """Violations of trials against their assignment and preregistration."""
    a = assignments.select("assignment_id", F.col("assigned_treatment").alias("_at"), F.col("preregistration_id").alias("_pr"), "assigned_at")
    p = prereg.select(F.col("preregistration_id").alias("_pr"), F.col("target").alias("_target"))
    j = trials.join(a, "assignment_id", "left").join(p, "_pr", "left")
    rules = F.array_compact(F.array(
        F.when(F.col("assigned_at").isNull(), F.lit("assignment_missing")),
        F.when(F.col("assigned_treatment") != F.col("_at"), F.lit("assignment_field_mismatch")),
        F.when(F.col("recorded_at") < F.col("assigned_at"), F.lit("outcome_before_assignment")),
        F.when(F.col("_pr").isNotNull() & F.col("_target").isNull(), F.lit("preregistration_missing")),
        F.when(F.col("_target").isNotNull() & ~F.map_contains_key("outcomes", F.col("_target")), F.lit("target_missing"))))
    bad = j.select("assignment_id", F.explode(rules).alias("violation")).groupBy("assignment_id", "violation").agg(F.count(F.lit(1)).alias("rows"))
    twice = trials.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("assignment_id", F.lit("duplicate_outcome").alias("violation"), "rows")
    return bad.unionByName(twice)


def validate_experiments(prereg: DataFrame) -> DataFrame:
    """First broken rule of each preregistration."""
    rule = (
        F.when(~((F.col("probability") > 0) & (F.col("probability") < 1)), "probability_out_of_range")
        .when(F.col("treatment") == F.col("control"), "arms_equal")
        .when(F.col("planned_units") < 1, "no_planned_units")
        .when(F.coalesce("primary_outcome", F.lit("")) == "", "primary_outcome_missing")
        .when(F.col("margin_floor") < 0, "negative_floor")
    )
    return prereg.withColumn("violation", rule)


def linear_bid(multiplier: float):
    """A strategy that bids a share of the value, at most what is left."""
    return lambda value, step, left: min(max(value * multiplier, 0.0), left)


def replay_bids(log: DataFrame, strategies: dict, budget: float) -> DataFrame:
    """Budgeted bid replay per (campaign, strategy) over an auction log.
    A strategy is bid(value, step, budget left). The budget carries from row to
    row, so each campaign is read once in order; rows stream through sorted
    partitions and only the running totals are held, never the campaign. The
    oracle takes profitable auctions by gain while the budget lasts."""
    names = list(strategies)

    def sweep(order_by_gain: bool):
        def run(batches):
            import pandas as pd

            current, state = None, {}

            def flush():
                rows = []
                for n, (left, reward, spend, wins, sq, step) in state.items():
                    mean = reward / step
                    rows.append((current, n, reward, spend, left, wins, max(sq / step - mean * mean, 0.0)))
                return pd.DataFrame(rows, columns=["campaign_id", "strategy", "reward", "spend", "budget_remaining", "wins", "reward_variance"])

            for b in batches:
                for camp, value, price in zip(b["campaign_id"], b["value"], b["price"]):
                    if camp != current:
                        if current is not None:
                            yield flush()
                        current, state = camp, {n: (budget, 0.0, 0.0, 0, 0.0, 0) for n in (["oracle"] if order_by_gain else names)}
                    for n, (left, reward, spend, wins, sq, step) in state.items():
                        hit = value > price if order_by_gain else strategies[n](value, step, left) >= price
                        if hit and left >= price:
                            gain = value - price
                            left, reward, spend, wins, sq = left - price, reward + gain, spend + price, wins + 1, sq + gain * gain
                        state[n] = (left, reward, spend, wins, sq, step + 1)
            if current is not None:
                yield flush()

        gain = F.desc(F.round(F.col("value") - F.col("price"), 9))
        order = ["campaign_id", gain, "auction_id"] if order_by_gain else ["campaign_id", "ts", "auction_id"]
        ready = log.select("campaign_id", "ts", "auction_id", "value", "price").repartition("campaign_id").sortWithinPartitions(*order)
        kind = log.schema["campaign_id"].dataType.simpleString()
        return ready.mapInPandas(run, f"campaign_id {kind}, strategy string, reward double, spend double, budget_remaining double, wins long, reward_variance double")

    best = sweep(True).select("campaign_id", F.col("reward").alias("_best"))
    return sweep(False).join(best, "campaign_id").withColumn("regret", F.col("_best") - F.col("reward")).drop("_best")

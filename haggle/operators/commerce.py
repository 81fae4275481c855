"""Merchant offers: threads of events, audits, action economics, rule replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.scalar import bucket, clip, safe_div, seconds_between

OFFER = ["merchant_id", "offer_id"]
CONTEXT = ["asking_price", "buyer_offer_amount", "cost_basis", "merchant_floor", "platform_fee_rate", "payment_fee_flat",
           "shipping_cost", "fulfillment_cost", "return_allowance", "category", "sku", "inventory_age_days"]
OUTCOME = ["buyer_paid", "returned", "cancelled", "return_window_matured", "final_sale_price", "refund_amount",
           "mature_contribution_margin", "paid_at"]
COUNTERS = ["counter_at_amount", "free_shipping_counter", "bundle_counter"]


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in order (W5). A partial aggregate, so a hot key
    sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def offer_threads(events: DataFrame) -> DataFrame:
    """One row per (merchant, offer): the offer, its latest decision and latest
    outcome. All three come from one grouped pass, no join (J6)."""
    kind = F.col("event_type")
    offer = F.struct("occurred_at", "listing_id", "surface", "available_actions", *CONTEXT)
    decision = F.struct("occurred_at", "selected_action")
    outcome = F.struct("occurred_at", *OUTCOME)
    time = F.struct("occurred_at", "ordinal")
    return (
        events.filter(kind.isin("offer_opened", "merchant_decision", "outcome_matured"))
        .groupBy(*OFFER)
        .agg(
            F.max_by(offer, F.when(kind == "offer_opened", F.col("ordinal"))).alias("offer"),
            F.max_by(decision, F.when(kind == "merchant_decision", time)).alias("decision"),
            F.max_by(outcome, F.when(kind == "outcome_matured", time)).alias("outcome"),
            F.count_if(kind == "offer_opened").alias("_opens"),
            F.count_if(kind == "merchant_decision").alias("_decisions"),
            F.count_if(kind == "outcome_matured").alias("_outcomes"),
        )
        .filter("_opens > 0")
        .withColumns({"decision": F.when(F.col("_decisions") > 0, F.col("decision")),
                      "outcome": F.when(F.col("_outcomes") > 0, F.col("outcome"))})
        .drop("_opens", "_decisions", "_outcomes")
    )


def open_offers(events: DataFrame) -> DataFrame:
    """Opened offers with neither decision nor outcome."""
    closed = events.filter(F.col("event_type").isin("merchant_decision", "outcome_matured")).select(*OFFER)
    opened = events.filter(F.col("event_type") == "offer_opened")
    return opened.join(closed, OFFER, "left_anti").select(*OFFER, "listing_id", "surface", "occurred_at", "available_actions", *CONTEXT)


def mature_paid(o: str = "outcome") -> Column:
    c = lambda f: F.coalesce(F.col(f"{o}.{f}"), F.lit(False))
    return c("buyer_paid") & c("return_window_matured") & ~c("cancelled") & F.col(f"{o}.mature_contribution_margin").isNotNull()


def action_amount(action: Column, buyer_offer: Column) -> Column:
    a = action["amount"]
    return F.when(action["action"] == "accept", F.when(a != 0, a).otherwise(buyer_offer)).when(action["action"].isin(COUNTERS), a)


def margin_if_sold(amount: Column, at: str = "") -> Column:
    """What a sale at this amount leaves after fees, shipping, fulfilment, return
    allowance and cost; null when the cost is unknown."""
    c = lambda f: F.coalesce(F.col(f"{at}{f}"), F.lit(0.0))
    return (amount - amount * c("platform_fee_rate") - c("payment_fee_flat") - c("shipping_cost") - c("fulfillment_cost")
            - c("return_allowance") - F.col(f"{at}cost_basis"))


def action_economics(offers: DataFrame) -> DataFrame:
    """Margin and floor violation of every available action."""
    d = offers.select(*OFFER, *CONTEXT, F.explode("available_actions").alias("a"))
    amount = action_amount(F.col("a"), F.col("buyer_offer_amount"))
    margin = margin_if_sold(amount)
    return d.select(*OFFER, F.col("a.action").alias("action"), amount.alias("amount"), F.round(margin, 2).alias("mature_margin_if_sold"),
                    F.coalesce(margin < F.col("merchant_floor"), F.lit(False)).alias("violates_merchant_floor"))


def merchant_audit(events: DataFrame) -> DataFrame:
    """Counts, coverage and mature margin per merchant."""
    kind = F.col("event_type")
    paid = (kind == "outcome_matured") & F.col("buyer_paid") & F.col("return_window_matured") & ~F.coalesce("cancelled", F.lit(False)) & \
        F.col("mature_contribution_margin").isNotNull()
    offers = F.count_if(kind == "offer_opened")
    known = F.count_if((kind == "offer_opened") & F.col("cost_basis").isNotNull())
    out = events.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("events"), offers.alias("offers_opened"), F.count_if(kind == "merchant_decision").alias("merchant_decisions"),
        F.count_if(kind == "outcome_matured").alias("mature_outcomes"), F.count_if(paid).alias("mature_paid_outcomes"),
        F.round(F.coalesce(F.sum(F.when(paid, F.col("mature_contribution_margin"))), F.lit(0.0)), 2).alias("total_margin"),
        F.round(F.coalesce(safe_div(known, offers), F.lit(0.0)), 4).alias("cost_coverage"))
    return out.withColumn("gate", (F.col("cost_coverage") >= 0.8) & (F.col("mature_paid_outcomes") >= 30))


def surface_counts(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'offer_opened'").groupBy("merchant_id", "surface").agg(F.count(F.lit(1)).alias("offers"))


def thread_integrity(events: DataFrame) -> DataFrame:
    """Violations of the event order, as (merchant, offer, violation, rows)."""
    kind = F.col("event_type")
    per = events.groupBy(*OFFER).agg(
        F.count_if(kind == "offer_opened").alias("opens"),
        F.max_by(F.struct("occurred_at", "available_actions"), F.when(kind == "offer_opened", F.col("ordinal"))).alias("o"))
    dup = per.filter("opens > 1").select(*OFFER, F.lit("duplicate_offer_opened").alias("violation"), (F.col("opens") - 1).alias("rows"))
    later = events.filter(kind.isin("merchant_decision", "outcome_matured")).join(per, OFFER, "left")
    opened = F.coalesce(F.col("opens"), F.lit(0)) > 0
    sel = F.col("selected_action")
    there = F.exists("o.available_actions", lambda a: (a["action"] == sel["action"]) & a["amount"].eqNullSafe(sel["amount"]))
    rules = F.array_compact(F.array(
        F.when(~opened, F.concat(kind, F.lit("_without_offer_opened"))),
        F.when(opened & (F.col("occurred_at") < F.col("o.occurred_at")), F.concat(kind, F.lit("_before_offer_opened"))),
        F.when(opened & (kind == "merchant_decision") & ~there, F.lit("merchant_decision_unavailable_action"))))
    bad = later.select(*OFFER, F.explode(rules).alias("violation")).groupBy(*OFFER, "violation").agg(F.count(F.lit(1)).alias("rows"))
    return dup.unionByName(bad)


# Fixed edges of this report; the other reports have their own.
def age_bucket_wide(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 7, "0-7").when(days <= 30, "8-30").when(days <= 60, "31-60").otherwise("61+")


def margin_by_product(threads: DataFrame) -> DataFrame:
    paid = threads.filter(mature_paid())
    key = F.coalesce("offer.sku", "offer.listing_id")
    m = F.col("outcome.mature_contribution_margin")
    return paid.groupBy(key.alias("product_key"), age_bucket_wide(F.col("offer.inventory_age_days")).alias("inventory_age_bucket")).agg(
        F.count(F.lit(1)).alias("paid_outcomes"), F.round(F.sum(m), 2).alias("total_mature_margin"), F.round(F.avg(m), 2).alias("average_mature_margin"))


def concessions(threads: DataFrame) -> DataFrame:
    """Amount conceded against the asking price per decided offer."""
    amount = action_amount(F.col("decision.selected_action"), F.col("offer.buyer_offer_amount"))
    asking = F.col("offer.asking_price")
    d = threads.filter(F.col("decision").isNotNull()).withColumn("selected_amount", amount).filter("selected_amount IS NOT NULL")
    cut = F.greatest(asking - F.col("selected_amount"), F.lit(0.0))
    return d.select(*OFFER, asking.alias("asking_price"), "selected_amount", F.round(cut, 2).alias("amount_conceded"),
                    F.when(asking > 0, F.round(cut / asking, 4)).otherwise(0.0).alias("concession_rate"))


def merchant_utility(threads: DataFrame) -> DataFrame:
    """Funnel, concessions, time to payment and unpaid accepted offers."""
    decided = F.col("decision").isNotNull()
    act = F.col("decision.selected_action.action")
    accepted = decided & act.isin("accept", *COUNTERS)
    paid = F.coalesce(mature_paid(), F.lit(False))
    amount = action_amount(F.col("decision.selected_action"), F.col("offer.buyer_offer_amount"))
    asking = F.col("offer.asking_price")
    cut = F.when(decided & amount.isNotNull(), F.greatest(asking - amount, F.lit(0.0)))
    secs = F.when(paid, seconds_between(F.col("offer.occurred_at"), F.col("outcome.paid_at")))
    unpaid = accepted & ~F.coalesce(F.col("outcome.buyer_paid") & ~F.col("outcome.cancelled"), F.lit(False))
    return threads.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("offers_opened"), F.count_if(decided).alias("merchant_responded"), F.count_if(accepted).alias("accepted_or_countered"),
        F.count("outcome").alias("mature_outcomes"), F.count_if(paid).alias("paid_mature_outcomes"),
        F.count_if(paid & ~F.col("outcome.returned")).alias("paid_nonreturned"), F.count_if(F.col("outcome.returned")).alias("returned"),
        F.avg(cut).alias("average_concession"), F.avg(F.when(asking > 0, cut / asking)).alias("average_concession_rate"),
        F.avg(secs).alias("average_seconds_to_payment"), F.count_if(unpaid).alias("unpaid_accepted"),
        F.coalesce(F.sum(F.when(paid, F.col("outcome.final_sale_price"))), F.lit(0.0)).alias("gross_paid_sales"),
        F.coalesce(F.sum("outcome.refund_amount"), F.lit(0.0)).alias("refunds"),
        F.coalesce(F.sum(F.when(paid, F.col("outcome.mature_contribution_margin"))), F.lit(0.0)).alias("mature_margin"))


def comparables_as_of(threads: DataFrame) -> DataFrame:
    """For every offer, how many paid mature outcomes with the same key were
    known when it opened, and the range of their amounts (J11).

    Offers and outcomes lie on one time line per key; running totals over it
    replace the range join. The line is sorted by range partitions, so a key
    holding a third of all rows is cut into many of them."""
    from haggle.operators.ordered import done, grouped, with_running

    amount = action_amount(F.col("decision.selected_action"), F.col("offer.buyer_offer_amount"))
    key = F.col("offer.category").alias("key")
    none = F.lit(None).cast("double")
    known = threads.filter(mature_paid() & F.col("decision").isNotNull()).select(
        *OFFER, key, F.col("outcome.occurred_at").alias("at"), F.lit(0).alias("side"), amount.alias("amount"), F.lit(1).alias("one"))
    asked = threads.select(*OFFER, key, F.col("offer.occurred_at").alias("at"), F.lit(1).alias("side"), none.alias("amount"), F.lit(0).alias("one"))
    line = known.unionByName(asked)
    g = grouped(line, ["key"], ["at", "side", *OFFER])
    g = with_running(g, sums={"comparables": F.col("one")}, maxes={"high": F.col("amount"), "_low": -F.col("amount")})
    out = done(g).filter("side = 1").select(*OFFER, F.col("comparables").cast("long"), (-F.col("_low")).alias("low"), "high")
    # an offer whose own outcome is dated at or before it opened is not its own comparable
    own = threads.filter(mature_paid() & F.col("decision").isNotNull() & (F.col("outcome.occurred_at") <= F.col("offer.occurred_at")))
    return out.join(own.select(*OFFER, F.lit(1).alias("_own")), OFFER, "left").withColumn(
        "comparables", F.col("comparables") - F.coalesce("_own", F.lit(0))).drop("_own")


def shadow_recommend(threads: DataFrame, as_of: str, floor_buffer: float = 10.0, minimum: int = 5, holdouts: DataFrame | None = None) -> DataFrame:
    """Shadow recommendation for every open offer (D4): accept when its margin
    clears the floor, else the best supported counter that beats it, else
    abstain. Decided offers and holdout controls get none."""
    d = threads.filter(F.col("decision").isNull()).join(comparables_as_of(threads), OFFER)
    if holdouts is not None:
        d = d.join(holdouts.filter("assigned_arm = 'control'").select(*OFFER), OFFER, "left_anti")
    buyer, floor = F.col("offer.buyer_offer_amount"), F.col("offer.merchant_floor") + floor_buffer
    accept = margin_if_sold(buyer, "offer.")

    def candidate(a: Column) -> Column:
        amount = action_amount(a, buyer)
        return F.struct(F.round(margin_if_sold(amount, "offer."), 2).alias("margin"), amount.alias("amount"), a["action"].alias("action"))

    cands = F.transform("offer.available_actions", candidate)
    good = F.filter(cands, lambda c: c["action"].isin(COUNTERS) & (c["margin"] >= floor) & (c["margin"] > accept)
                    & (c["amount"] >= F.round("low", 2)) & (c["amount"] <= F.round("high", 2)))
    best = F.array_max(good)
    may_accept = F.exists("offer.available_actions", lambda a: a["action"] == "accept") & (accept >= floor)
    reasons = F.array_compact(F.array(
        F.when(F.col("offer.cost_basis").isNull(), F.lit("cost_basis_missing")),
        F.when(F.col("outcome").isNotNull() & ~F.coalesce(F.col("outcome.return_window_matured"), F.lit(False)), F.lit("return_maturity_incomplete")),
        F.when(F.col("comparables") < minimum, F.lit("too_few_comparable_mature_outcomes"))))
    blocked = F.size(reasons) > 0
    action = F.when(blocked, "abstain").when(may_accept, "accept").when(best.isNotNull(), best["action"]).otherwise("abstain")
    why = F.when(blocked, F.array_join(reasons, ",")).when(may_accept, "accept_margin_clears_floor_buffer").when(
        best.isNotNull(), "counter_margin_beats_accept_now_inside_supported_range").otherwise("no_supported_action_clears_margin_rule")
    return d.select(*OFFER, "comparables", action.alias("action"), F.when(~blocked, F.when(may_accept, buyer).when(best.isNotNull(), best["amount"])).alias("amount"),
                    why.alias("reason"), F.lit(as_of).cast("timestamp").alias("generated_at"))


def replay_rule(threads: DataFrame, rule_type: str = "counter_percent_above_offer", markup: float = 0.08, cap: float = 1.0, buffer: float = 0.0) -> DataFrame:
    """Fixed rule over all offers; the observed margin is reused only where the
    taken action equals the simulated one (D5)."""
    buyer, asking = F.col("offer.buyer_offer_amount"), F.col("offer.asking_price")
    floor = F.col("offer.merchant_floor") + buffer
    known = F.col("offer.cost_basis").isNotNull()
    accept = margin_if_sold(buyer, "offer.")
    counter = F.round(F.least(asking * cap, buyer * (1.0 + markup)), 2)
    low = known & (margin_if_sold(counter, "offer.") < floor)
    takes = F.lit(rule_type in ("accept_if_margin_then_counter", "decline_below_margin_floor")) & F.coalesce(accept >= floor, F.lit(False))
    refuses = (F.lit(rule_type == "decline_below_margin_floor") & F.coalesce(accept < floor, F.lit(False))) | low
    want = F.when(takes, "accept").when(refuses, "decline").otherwise("counter_at_amount")
    target = F.when(takes, buyer).when(~refuses, counter)
    same = F.filter("offer.available_actions", lambda a: a["action"] == F.col("_want"))
    near = F.array_min(F.transform(same, lambda a: F.struct(F.abs(F.coalesce(a["amount"], F.lit(0.0)) - F.col("_target")).alias("d"), a["amount"].alias("amount"))))
    d = threads.withColumns({"_want": want, "_target": target}).withColumns({"_n": F.size(same), "_near": near})
    action = F.when(F.col("_n") == 0, "abstain").otherwise(F.col("_want"))
    amount = F.when((F.col("_n") > 0) & F.col("_target").isNotNull(), F.col("_near.amount"))
    d = d.withColumns({"simulated_action": action, "simulated_amount": amount})
    act = F.col("decision.selected_action")
    match = F.coalesce((act["action"] == F.col("simulated_action")) & (
        (act["amount"].isNull() & F.col("simulated_amount").isNull()) | F.coalesce(F.abs(act["amount"] - F.col("simulated_amount")) <= 0.01, F.lit(False))), F.lit(False))
    reuse = match & F.coalesce(F.col("outcome.return_window_matured"), F.lit(False))
    return d.select(*OFFER, "simulated_action", "simulated_amount", match.alias("actions_match"),
                    F.when(reuse, F.col("outcome.mature_contribution_margin")).alias("observed_mature_margin"))


# ---- decision snapshots


def buyer_paid() -> Column:
    return F.coalesce(F.col("buyer_paid") & ~F.col("order_cancelled") & ~F.col("unpaid_order"), F.lit(False))


def snapshot_mature_paid() -> Column:
    return buyer_paid() & F.coalesce("return_window_matured", F.lit(False)) & F.col("mature_margin").isNotNull()


def _summary() -> list[Column]:
    m = F.when(snapshot_mature_paid(), F.col("mature_margin"))
    day = F.greatest(F.when(F.coalesce("days_to_sale", F.lit(0.0)) != 0, F.col("days_to_sale")).otherwise(1.0), F.lit(1.0))
    return [F.count(F.lit(1)).alias("decisions"), F.round(F.avg(buyer_paid().cast("int")), 4).alias("buyer_paid_rate"),
            F.count_if(F.col("seller_accepted") & ~F.col("buyer_paid")).alias("seller_accepted_unpaid"), F.count(m).alias("mature_decisions"),
            F.round(F.coalesce(F.sum(m), F.lit(0.0)), 2).alias("total_mature_margin"), F.round(F.avg(m), 2).alias("average_mature_margin"),
            F.round(F.avg(m / day), 2).alias("average_margin_per_listing_day")]


def profit_audit(snapshots: DataFrame) -> DataFrame:
    """Summary by action and by channel in one pass."""
    d = snapshots.filter("has_outcome")
    return d.select("*", F.explode(F.array(
        F.struct(F.lit("action").alias("dimension"), F.col("action").alias("key")),
        F.struct(F.lit("channel").alias("dimension"), F.col("decision_channel").alias("key")))).alias("g")).groupBy(
        F.col("g.dimension").alias("dimension"), F.col("g.key").alias("key")).agg(*_summary())


# Fixed edges of the policy audit.
def policy_buckets() -> dict[str, Column]:
    c = F.col
    ratio = bucket(c("offer_to_asking_ratio"), [0.65, 0.75, 0.85], ["below_65_pct", "65_to_75_pct", "75_to_85_pct", "above_85_pct"], "no_buyer_offer")
    return {
        "offer_ratio": ratio, "category": c("category"),
        "listing_age": bucket(c("days_active"), [14, 45, 90], ["0_to_13_days", "14_to_44_days", "45_to_89_days", "90_plus_days"]),
        "cost_band": bucket(c("seller_cost_basis"), [100, 500, 1000], ["under_100", "100_to_499", "500_to_999", "1000_plus"], "missing_cost_basis"),
        "traffic": c("traffic_trend"),
        "interested": F.when(c("interested_buyers") == 0, "0").when(c("interested_buyers") <= 2, "1_to_2").when(c("interested_buyers") <= 5, "3_to_5").otherwise("6_plus"),
        "prior_offers": F.when(c("prior_offer_count") == 0, "0").when(c("prior_offer_count") <= 2, "1_to_2").otherwise("3_plus"),
        "urgency": c("seller_urgency").cast("string"),
    }


def policy_audit(snapshots: DataFrame) -> DataFrame:
    """Eight bucketed breakouts with the action mix (A32). The rows are first
    counted per (breakout, bucket, action), a bounded table; the mix and the
    rates come from it."""
    d = snapshots.filter("has_outcome")
    pairs = F.array(*[F.struct(F.lit(n).alias("breakout"), b.alias("bucket")) for n, b in policy_buckets().items()])
    m = F.when(snapshot_mature_paid(), F.col("mature_margin"))
    per = d.select("action", buyer_paid().alias("paid"), m.alias("m"), F.explode(pairs).alias("p")).groupBy(
        "p.breakout", "p.bucket", "action").agg(F.count(F.lit(1)).alias("n"), F.count_if("paid").alias("paid"), F.count("m").alias("k"), F.sum("m").alias("s"))
    return per.groupBy("breakout", "bucket").agg(
        F.sum("n").alias("decisions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("action", "n"))), lambda x: F.concat_ws(":", x["action"], x["n"].cast("string"))), ",").alias("action_mix"),
        F.round(F.sum("paid") / F.sum("n"), 4).alias("buyer_paid_rate"), F.sum("k").alias("mature_paid_outcomes"),
        F.round(F.try_divide(F.sum("s"), F.sum("k")), 2).alias("average_mature_margin"))


def data_quality(snapshots: DataFrame, max_traffic_hours: float = 24.0) -> DataFrame:
    """Four coverages and their mean."""
    o = F.count_if("has_outcome")
    n = F.count(F.lit(1))

    def cover(hit: Column, of: Column) -> Column:
        return F.round(F.coalesce(safe_div(hit, of), F.lit(0.0)), 4)

    row = snapshots.agg(
        n.alias("snapshots"), o.alias("decisions_with_outcomes"), cover(F.count("seller_cost_basis"), n).alias("cost_coverage"),
        cover(F.count_if(F.col("has_outcome") & F.col("actual_fees").isNotNull()), o).alias("fee_coverage"),
        cover(F.count_if(F.col("has_outcome") & F.col("return_window_matured")), o).alias("mature_coverage"),
        cover(F.count_if(F.col("traffic_age_hours") <= max_traffic_hours), n).alias("traffic_coverage"),
        F.count_if(F.col("has_outcome") & snapshot_mature_paid()).alias("mature_paid_outcomes"))
    warn = F.array_compact(F.array(
        F.when(F.col("cost_coverage") < 0.95, F.lit("cost basis")), F.when(F.col("fee_coverage") < 0.95, F.lit("fees")),
        F.when(F.col("mature_coverage") < 0.8, F.lit("return windows")), F.when(F.col("mature_paid_outcomes") < 30, F.lit("mature outcomes")),
        F.when(F.col("traffic_coverage") < 0.95, F.lit("stale traffic"))))
    mean = (F.col("cost_coverage") + F.col("fee_coverage") + F.col("mature_coverage") + F.col("traffic_coverage")) / 4
    return row.withColumns({"score": F.round(mean, 3), "warnings": F.array_join(warn, ",")})


def missed_opportunities(snapshots: DataFrame, limit: int = 10) -> DataFrame:
    """The report's first rows, by decision id."""
    m = F.when(snapshot_mature_paid(), F.col("mature_margin"))
    why = F.when(F.col("action").isin("decline", "wait") & F.col("buyer_offer_amount").isNotNull() & (m <= 0), "retrospective_positive_offer_was_not_closed").when(
        (F.col("action") == "accept") & F.col("returned"), "accepted_order_later_returned")
    return snapshots.filter("has_outcome").withColumn("reason", why).filter("reason IS NOT NULL").orderBy("decision_id").limit(limit).select(
        "decision_id", "reason", "buyer_offer_amount")


def comparable_counts(snapshots: DataFrame) -> DataFrame:
    """Mature comparable records per channel and case-folded category."""
    ok = F.col("has_outcome") & F.col("seller_cost_basis").isNotNull() & snapshot_mature_paid() & F.col("actual_fees").isNotNull()
    return snapshots.filter(ok).groupBy("decision_channel", F.lower("category").alias("folded")).agg(F.count(F.lit(1)).alias("comparables"))


def evaluate_actions(snapshots: DataFrame, fee: float = 0.1325, holding: float = 0.0, return_cost: float = 0.0, horizon: int = 7,
                     digits: int = 2) -> DataFrame:
    """Expected margin of every available action of a decision."""
    d = snapshots.select("*", F.explode("available_actions").alias("a"))
    act, c = F.col("a.action"), F.col
    amount = F.when(act == "decline", None).when(act == "wait", c("asking_price")).when(
        act == "accept", F.coalesce(F.when(c("a.amount") != 0, c("a.amount")), c("buyer_offer_amount"), F.lit(0.0))).otherwise(c("a.amount"))
    trend = F.when(c("traffic_trend") == "declining", -0.06).when(c("traffic_trend") == "increasing", 0.06).when(c("traffic_trend") == "flat", 0.0).otherwise(-0.02)
    urgency = 0.03 * c("seller_urgency")
    traffic = F.least(F.lit(0.12), F.log1p(F.greatest(c("views_7d"), F.lit(0))) / 60)
    interest = c("interested_buyers")
    offer = c("buyer_offer_amount")
    gap = F.greatest(c("a.amount") - offer, F.lit(0.0)) / F.greatest(offer, F.lit(1.0))
    rel = c("a.amount") / c("asking_price")
    cold = clip(0.10 + F.greatest(F.lit(0.0), 1.0 - rel) * 1.8 + 0.04 * interest + traffic + trend, 0.02, 0.88)
    warm = clip(0.78 - 1.85 * gap - 0.25 * F.greatest(rel - 0.85, F.lit(0.0)) + traffic + trend + urgency, 0.02, 0.95)
    p = F.when(act == "accept", 1.0).when(act == "decline", 0.0).when(
        act == "wait", clip(0.12 + traffic + 0.03 * interest + trend - urgency, 0.02, 0.65)).when(offer.isNull(), cold).otherwise(warm)
    h = float(horizon)
    days = F.when(act == "accept", 0.1).when(act == "decline", h).when(
        act == "wait", F.least(F.lit(h), F.greatest(F.lit(1.0), 7.0 - c("seller_urgency")))).otherwise(clip((1.0 - p) * h, 0.5, h))
    d = d.withColumns({"action_name": act, "amount": amount, "p": p, "days": days})
    net = F.col("amount") * (1.0 - fee) - c("shipping_cost") - c("promotion_cost")
    margin = net - c("seller_cost_basis")
    expected = F.col("p") * margin - F.col("days") * holding - F.col("p") * F.greatest(margin, F.lit(0.0)) * return_cost
    return d.select(*[x for x in snapshots.columns if x != "action"], F.col("action_name").alias("action"), F.round("amount", 2).alias("amount"), F.round("p", 4).alias("sale_probability"),
                    F.round(expected, digits).alias("expected_margin"), F.round(margin, digits).alias("net_margin_if_sold"), F.round("days", 2).alias("extra_days"),
                    F.coalesce(net < c("minimum_net_proceeds"), F.lit(False)).alias("violates_floor"))


def recommend(snapshots: DataFrame, history: DataFrame, minimum: int = 30, max_traffic_hours: float = 24.0, **cfg) -> DataFrame:
    """Best viable action per decision, or the reasons to abstain (D3)."""
    ev = evaluate_actions(snapshots, **cfg)
    viable = ~F.col("violates_floor") & F.col("expected_margin").isNotNull()
    top = F.struct("expected_margin", F.struct(F.col("action").alias("action"), F.col("amount").alias("amount")).alias("pick"))
    keys = ["decision_id", "decision_channel", "category", "seller_cost_basis", "traffic_age_hours"]
    # a decision has a handful of actions
    per = ev.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(viable, top)), asc=False).alias("v"),
                                F.max(F.when(F.col("action") == "accept", F.col("expected_margin"))).alias("accept_margin"))
    d = per.withColumn("folded", F.lower("category")).join(comparable_counts(history), ["decision_channel", "folded"], "left").withColumn(
        "comparables", F.coalesce("comparables", F.lit(0)))
    first, second = F.try_element_at("v", F.lit(1)), F.try_element_at("v", F.lit(2))
    reasons = F.array_compact(F.array(
        F.when(F.col("seller_cost_basis").isNull(), F.lit("missing_seller_cost_basis")),
        F.when(F.col("traffic_age_hours") > max_traffic_hours, F.lit("stale_traffic_data")),
        F.when(F.col("comparables") < minimum, F.lit("insufficient_comparable_mature_outcomes")),
        F.when(F.size("v") == 0, F.lit("no_viable_actions_above_floor")),
        F.when(first["expected_margin"] - second["expected_margin"] < 5.0, F.lit("top_actions_too_close_for_confident_choice"))))
    go = F.size(reasons) == 0
    return d.select("decision_id", F.when(go, "recommend").otherwise("abstain").alias("status"), F.array_join(reasons, ",").alias("reasons"), "comparables",
                    F.when(go, first["pick"]["action"]).alias("action"), F.when(go, first["expected_margin"]).alias("expected_margin"),
                    F.when(go, F.round(first["expected_margin"] - F.col("accept_margin"), 2)).alias("advantage"),
                    F.when(go, F.when(F.col("comparables") >= 100, "moderate").when(F.col("comparables") >= 30, "low-moderate").otherwise("low")).alias("confidence"))


# ---- lifecycle transactions


def transactions(events: DataFrame, states: DataFrame) -> DataFrame:
    """Reached states and money components per transaction, first and last by
    append order (A24). One grouped pass; `states` is the lifecycle replay."""
    t, o = F.col("transition_to"), F.col("ordinal")
    keys = ["merchant_namespace", "transaction_id"]

    def first(c: str, cond: Column | None = None) -> Column:
        ok = F.col(c).isNotNull() if cond is None else cond
        return F.min_by(c, F.when(ok, o))

    is_offer, is_paid, is_mature = t == "offer_submitted", t == "paid", t == "mature"
    out = events.groupBy(*keys).agg(
        F.collect_set("transition_to").alias("transitions"), first("currency").alias("currency"), first("sku", is_offer).alias("sku"),
        first("inventory_age_days").alias("inventory_age_days"), first("asking_price_minor", is_offer).alias("asking_price_minor"),
        first("buyer_offer_minor", is_offer).alias("buyer_offer_minor"), first("merchant_floor_minor").alias("merchant_floor_minor"),
        F.max_by("final_sale_minor", F.when(is_paid, o)).alias("revenue_minor"), first("cost_basis_minor").alias("item_cost_minor"),
        F.coalesce(F.max_by("shipping_charged_minor", F.when(is_paid, o)), F.lit(0)).alias("shipping_charged_minor"),
        F.coalesce(first("shipping_cost_minor"), F.lit(0)).alias("shipping_cost_minor"),
        F.coalesce(F.sum("shipping_discount_minor"), F.lit(0)).alias("free_shipping_minor"),
        first("fees_minor", is_mature).alias("fees_minor"),
        F.coalesce(F.sum(F.when(t.isin("partially_refunded", "fully_refunded"), F.col("refund_minor"))), F.lit(0)).alias("refund_minor"),
        F.coalesce(first("return_loss_minor", is_mature), F.lit(0)).alias("return_loss_minor"), first("margin_minor", is_mature).alias("margin_minor"))
    out = out.join(states.select(*keys, "current_state"), keys)
    late = F.col("current_state") == "mature"
    missing = F.array_compact(F.array(
        F.when(F.col("item_cost_minor").isNull(), F.lit("item_cost_minor")), F.when(late & F.col("revenue_minor").isNull(), F.lit("gross_negotiated_revenue_minor")),
        F.when(late & F.col("fees_minor").isNull(), F.lit("platform_payment_fees_minor")), F.when(late & F.col("margin_minor").isNull(), F.lit("mature_contribution_margin_minor"))))
    return out.withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


FUNNEL = {
    "offers_submitted": ["offer_submitted"], "merchant_accepted": ["merchant_accepted"], "merchant_countered": ["merchant_countered"],
    "buyer_accepted": ["buyer_accepted"], "checkout_created": ["checkout_created"], "paid": ["paid"], "cancelled": ["cancelled"],
    "refunded": ["partially_refunded", "fully_refunded"], "mature": ["mature"],
}


def _has(*states: str) -> Column:
    return F.arrays_overlap("transitions", F.array(*[F.lit(s) for s in states]))


def offer_funnel(tx: DataFrame) -> DataFrame:
    """Transactions that reached each state."""
    return tx.groupBy("merchant_namespace").agg(*[F.count_if(_has(*s)).alias(n) for n, s in FUNNEL.items()])


MARGIN_FIELDS = ["revenue_minor", "item_cost_minor", "shipping_charged_minor", "shipping_cost_minor", "free_shipping_minor", "fees_minor",
                 "refund_minor", "return_loss_minor", "margin_minor"]


def mature_margin_summary(tx: DataFrame) -> DataFrame:
    """Totals over complete mature transactions only."""
    done = _has("mature") & F.col("complete")
    cur = F.when(done, F.col("currency"))
    return tx.groupBy("merchant_namespace").agg(
        *[F.coalesce(F.sum(F.when(done, F.col(f))), F.lit(0)).alias(f) for f in MARGIN_FIELDS], F.count_if(done).alias("complete_mature"),
        F.count_if(_has("mature") & ~F.col("complete")).alias("excluded_mature"),
        F.when(F.min(cur) == F.max(cur), F.max(cur)).alias("currency")).withColumn("provisional", F.col("excluded_mature") > 0)


def margin_leakage(tx: DataFrame) -> DataFrame:
    """Where margin is lost."""
    lacks = lambda f: F.array_contains("missing", f)
    return tx.groupBy("merchant_namespace").agg(
        F.sum("free_shipping_minor").alias("free_shipping_minor"), F.sum(F.col("refund_minor") + F.col("return_loss_minor")).alias("refunds_returns_minor"),
        F.count_if(_has("merchant_accepted", "buyer_accepted") & ~_has("paid")).alias("unpaid_accepted_offers"),
        F.count_if(_has("checkout_expired")).alias("expired_checkout_links"), F.count_if(lacks("item_cost_minor")).alias("missing_cost_basis"),
        F.count_if(lacks("platform_payment_fees_minor")).alias("missing_fees"), F.count_if(~_has("mature")).alias("immature_outcomes"))


# Fixed edges of the transaction breakdown.
def age_bucket_report(days: Column) -> Column:
    return bucket(days, [15, 31, 61, 91], ["0-14", "15-30", "31-60", "61-90", "91+"], "unknown")


def ratio_bucket_report(offer: Column, asking: Column) -> Column:
    return bucket(F.when(asking > 0, offer / asking), [0.5, 0.7, 0.85, 1.0], ["<50%", "50-69%", "70-84%", "85-99%", "100%+"], "unknown")


def ratio_bucket_storefront(offer: Column, asking: Column) -> Column:
    return bucket(F.when(asking > 0, offer / asking), [0.7, 0.85, 1.0], ["<70%", "70-85%", "85-100%", ">=100%"], None)


def breakdown(tx: DataFrame) -> DataFrame:
    """Transactions, mature ones and complete margin by product, inventory age
    and offer ratio, in one pass (A27)."""
    keys = F.array(
        F.struct(F.lit("sku").alias("dimension"), F.coalesce("sku", F.lit("unknown")).alias("bucket")),
        F.struct(F.lit("age").alias("dimension"), age_bucket_report(F.col("inventory_age_days")).alias("bucket")),
        F.struct(F.lit("ratio").alias("dimension"), ratio_bucket_report(F.col("buyer_offer_minor"), F.col("asking_price_minor")).alias("bucket")))
    return tx.select("transitions", "complete", "margin_minor", F.explode(keys).alias("k")).groupBy("k.dimension", "k.bucket").agg(
        F.count(F.lit(1)).alias("transactions"), F.count_if(_has("mature")).alias("mature"),
        F.coalesce(F.sum(F.when(F.col("complete"), F.col("margin_minor"))), F.lit(0)).alias("complete_margin_minor"))


def threshold_replay(tx: DataFrame, accept: float = 0.85, markup: float = 0.08, floor_buffer: int = 0) -> DataFrame:
    """Threshold rule on minor units; the counter is rounded half to even."""
    ask, bid, floor = F.col("asking_price_minor"), F.col("buyer_offer_minor"), F.col("merchant_floor_minor")
    action = F.when(ask.isNull() | bid.isNull(), "abstain_missing_offer_context").when(bid < floor + floor_buffer, "decline").when(
        (ask > 0) & (bid / ask >= accept), "accept").otherwise("counter_at_amount")
    d = tx.withColumn("selected_action", action)
    amount = F.when(F.col("selected_action") == "accept", bid).when(F.col("selected_action") == "counter_at_amount", F.bround(bid * (1.0 + markup), 0).cast("long"))
    return d.select("merchant_namespace", "transaction_id", "selected_action", amount.alias("amount_minor"))

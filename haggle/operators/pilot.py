"""Seller pilot audits over ten joined datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.scalar import bucket, safe_div, seconds_between
from haggle.operators.metrics import exact_median

Pilot = dict[str, DataFrame]


def order_flags(orders: DataFrame, returns: DataFrame, as_of: str) -> DataFrame:
    """Paid, completed and return-matured per order. The window is over when
    the order's or any of its returns' maturity lies at or before `as_of`."""
    t = F.lit(as_of).cast("timestamp")
    ends = returns.groupBy("order_id").agg(F.min("return_window_matured_at").alias("_ends"))
    d = orders.join(ends, "order_id", "left")
    status = F.lower(F.coalesce("order_status", F.lit("")))
    over = lambda c: F.coalesce(F.col(c) <= t, F.lit(False))
    return d.withColumns({
        "buyer_paid": F.col("paid_at").isNotNull() | status.isin("paid", "completed", "shipped", "delivered"),
        "order_completed": F.col("completed_at").isNotNull() | status.isin("completed", "delivered"),
        "return_matured": over("return_window_matured_at") | over("_ends")}).drop("_ends")


def order_costs(p: Pilot) -> DataFrame:
    """Orders with summed fees, shipping and refunds, and the latest cost of the
    listing (J9). Every side is reduced to its key before the join."""
    total = lambda df, c, n: df.groupBy("order_id").agg(F.sum(c).alias(n))
    cost = p["cost_basis"].groupBy("listing_id").agg(F.max_by("cost", F.struct("available_at", "ordinal")).alias("cost"))
    return (
        p["orders"].join(total(p["fees"], "fee_amount", "fee"), "order_id", "left").join(total(p["shipping"], "shipping_amount", "shipping"), "order_id", "left")
        .join(total(p["returns"], "refund_amount", "refund"), "order_id", "left").join(cost, "listing_id", "left")
    )


def link_orders(offers: DataFrame, orders: DataFrame) -> DataFrame:
    """An offer's order: by offer id, else the only order of the listing."""
    by_offer = orders.filter(F.col("offer_id").isNotNull()).groupBy("offer_id").agg(F.max_by("order_id", "ordinal").alias("_o1"))
    single = orders.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), F.min("order_id").alias("_o2")).filter("n = 1").drop("n")
    return offers.join(by_offer, "offer_id", "left").join(single, "listing_id", "left").withColumn("order_id", F.coalesce("_o1", "_o2")).drop("_o1", "_o2")


# Fixed edges of the pilot's inventory age.
def pilot_age_bucket(days: Column) -> Column:
    return bucket(days, [30, 90, 180], ["0_to_29_days", "30_to_89_days", "90_to_179_days", "180_plus_days"], "unknown")


def margin_rows(p: Pilot, as_of: str) -> DataFrame:
    """Mature orders with every cost known and their margin; costs are never imputed."""
    flagged = order_flags(order_costs(p), p["returns"], as_of)
    ok = F.col("buyer_paid") & F.col("order_completed") & F.col("return_matured")
    known = F.col("cost").isNotNull() & F.col("fee").isNotNull() & F.col("shipping").isNotNull() & F.col("sale_price").isNotNull()
    d = flagged.filter(ok & known).join(p["listings"].select("listing_id", "category", "asking_price", "age_days"), "listing_id", "left")
    margin = F.col("sale_price") - F.col("fee") - F.col("shipping") - F.coalesce("refund", F.lit(0.0)) - F.col("cost") * F.coalesce("quantity", F.lit(1))
    return d.select("order_id", "listing_id", "offer_id", F.coalesce("category", F.lit("unknown")).alias("category"), pilot_age_bucket(F.col("age_days")).alias("inventory_age_bucket"),
                    F.round(F.try_divide("sale_price", F.when(F.col("asking_price") != 0, F.col("asking_price"))), 4).alias("realized_to_asking_ratio"),
                    F.round(margin, 2).alias("margin"))


def margin_breakdown(rows: DataFrame) -> DataFrame:
    return rows.select("margin", F.explode(F.array(
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("key")),
        F.struct(F.lit("inventory_age").alias("dimension"), F.col("inventory_age_bucket").alias("key")))).alias("g")).groupBy("g.dimension", "g.key").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("margin"), 2).alias("total"), F.round(F.avg("margin"), 4).alias("average"))


def pilot_audit(p: Pilot, as_of: str) -> DataFrame:
    """Funnel, rates, latency and margin totals as one row."""
    one = F.lit(1)
    flagged = order_flags(p["orders"], p["returns"], as_of)
    linked = link_orders(p["offers"], p["orders"]).join(flagged.select("order_id", "buyer_paid", "order_completed", "return_matured"), "order_id", "left")
    hours = seconds_between(F.col("event_time"), F.col("response_time")) / 3600
    linked = linked.withColumns({"hours": hours, "_k": one})
    states = [c for c in ("seller_response", "offer_state") if c in p["offers"].columns]
    accepted = F.coalesce(*[F.when(F.lower(c).isin("accept", "accepted", "seller_accepted"), True) for c in states], F.lit(False))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    funnel = linked.agg(F.count(one).alias("offers"), F.count_if(accepted).alias("accepted"), yes("buyer_paid").alias("paid"), yes("order_completed").alias("completed"),
                        yes("return_matured").alias("return_matured"), F.count("hours").alias("latencies"), F.avg("hours").alias("latency_mean"),
                        F.count_if(F.col("seller_response").isNotNull() & F.col("response_time").isNotNull()).alias("decided"))
    windows = flagged.filter("order_completed").agg(F.count(one).alias("completed_orders"), F.count_if("return_matured").alias("matured_orders"))
    mid = exact_median(linked, ["_k"], "hours", "offer_id", "latency_median").drop("_k")
    m = margin_rows(p, as_of).agg(F.count(one).alias("mature_orders"), F.sum("margin").alias("margin_total"), F.avg("margin").alias("margin_mean"),
                                  F.avg("realized_to_asking_ratio").alias("price_ratio"))
    gaps = order_costs(p).agg(F.count(one).alias("orders"), F.countDistinct(F.when(F.col("cost").isNull(), F.col("listing_id"))).alias("no_cost"),
                              F.count_if(F.col("fee").isNull()).alias("no_fee"), F.count_if(F.col("shipping").isNull()).alias("no_shipping"))
    row = funnel
    for side in (mid, m, gaps, windows):  # one row each
        row = row.withColumn("_k", one).join(side.withColumn("_k", one), "_k").drop("_k")
    cover = lambda miss: F.round(safe_div(F.col("orders") - F.col(miss), F.col("orders")), 4)
    row = row.withColumns({"acceptance_rate": F.round(safe_div(F.col("accepted"), F.col("offers")), 4), "cost_coverage": cover("no_cost"),
                           "fee_coverage": cover("no_fee"), "shipping_coverage": cover("no_shipping"),
                           "decision_coverage": F.round(safe_div(F.col("decided"), F.col("offers")), 4),
                           "return_coverage": F.round(F.coalesce(safe_div(F.col("matured_orders"), F.col("completed_orders")), F.lit(0.0)), 4)})
    ready = F.col("mature_orders") >= 30
    # fixed thresholds of the readiness gate
    for c, least in {"cost_coverage": 0.95, "fee_coverage": 0.95, "shipping_coverage": 0.95, "decision_coverage": 0.8, "return_coverage": 0.8}.items():
        ready = ready & (F.col(c) >= least)
    return row.withColumn("ready", ready)


def decision_of(response: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(response, F.lit("unknown"))))
    return F.when(r.isin("accept", "accepted", "seller_accepted"), "accepted").when(r.isin("decline", "declined", "rejected"), "declined").when(
        r.isin("counter", "countered", "counter_offer"), "countered").when(r == "", "unknown").otherwise(r)


def decision_rows(p: Pilot, as_of: str) -> DataFrame:
    """Margin rows with the seller's decision: by offer id, else the listing's only offer."""
    offers = p["offers"]
    by_id = offers.groupBy("offer_id").agg(F.max_by("seller_response", "ordinal").alias("_r1"))
    single = offers.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), F.min("seller_response").alias("_r2")).filter("n = 1").drop("n")
    d = margin_rows(p, as_of).join(by_id, "offer_id", "left").join(single, "listing_id", "left")
    return d.withColumn("decision_type", decision_of(F.coalesce("_r1", "_r2"))).drop("_r1", "_r2")


def decision_margins(p: Pilot, as_of: str) -> DataFrame:
    """Margin by decision: mean, median, total, negatives and 95% interval."""
    d = decision_rows(p, as_of)
    mid = exact_median(d, ["decision_type"], "margin", "order_id")
    row = d.groupBy("decision_type").agg(F.count(F.lit(1)).alias("mature_outcomes"), F.avg("margin").alias("mean"), F.sum("margin").alias("total"),
                                         F.count_if(F.col("margin") < 0).alias("negative"), F.stddev_samp("margin").alias("sd"))
    half = F.coalesce(1.96 * F.col("sd") / F.sqrt("mature_outcomes"), F.lit(0.0))
    return row.join(mid, "decision_type").select("decision_type", "mature_outcomes", "mean", "median", "total", "negative",
                                                 (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def counterexamples(p: Pilot, as_of: str, k: int = 5) -> DataFrame:
    """The k lowest margins, ids hashed. Negative ones are told apart; when there
    are any, only they are listed."""
    low = decision_rows(p, as_of).orderBy("margin", "order_id").limit(k)
    negative = F.col("margin") < 0
    # at most k rows from here on
    tagged = low.withColumn("_k", F.lit(1))
    any_negative = tagged.groupBy("_k").agg(F.bool_or(negative).alias("_any"))
    d = tagged.join(any_negative, "_k").filter(negative | ~F.col("_any"))
    return d.select(F.sha2("order_id", 256).alias("order_id_hash"), "decision_type", "category", "margin",
                    F.when(negative, "negative_margin").otherwise("lowest_observed_margin").alias("reason"))


def latest_import(rows: DataFrame) -> DataFrame:
    """Rows of the latest import of each pilot; an import whose content equals
    the one before is no new version (A48)."""
    per = rows.groupBy("pilot_id", "import_id").agg(F.max("import_seq").alias("seq"), F.max("content_hash").alias("hash"))
    # the first import with a given content stands for its later repeats
    firsts = per.groupBy("pilot_id", "hash").agg(F.min_by("import_id", "seq").alias("import_id"), F.max("seq").alias("seq"))
    last = firsts.groupBy("pilot_id").agg(F.max_by("import_id", "seq").alias("import_id"))
    return rows.join(last, ["pilot_id", "import_id"], "left_semi")

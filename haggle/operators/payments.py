"""Payment side of a transaction: snapshots, refunds, returns, maturity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.operators.ordered import done, grouped, with_previous, with_running

TX = "transaction_id"

# Fields taken from the last event of a type.
BY_TYPE = {
    "offer_submitted": ["submitted_at", "store_id", "product_title", "product_reference_hash", "offer_amount_minor", "currency"],
    "merchant_countered": ["counter_amount_minor"],
    "order_created": ["order_total_minor", "order_reference_hash"],
    "paid": ["paid_at", "paid_total_minor", "paid_currency"],
    "refund_recorded": ["refund_total_minor", "cumulative_refund_total_minor", "refund_currency"],
    "mature": ["matured_at", "net_revenue_minor", "mature_margin_minor", "maturity_input_hash"],
}
MATURE_FIELDS = BY_TYPE["mature"]


def offer_snapshots(events: DataFrame) -> DataFrame:
    """Latest fields per transaction in append order (T6). A new submission
    starts over; events before any submission do not count; a refund or return
    after a maturity clears it."""
    start = events.filter("event_type = 'offer_submitted'").groupBy(TX).agg(F.max("ordinal").alias("_start"))
    d = events.join(start, TX).filter(F.col("ordinal") >= F.col("_start"))
    kind, o = F.col("event_type"), F.col("ordinal")

    def last(c: str, *types: str) -> Column:
        return F.max_by(c, F.when(kind.isin(*types), o))

    fields = [last(c, t).alias(c) for t, cs in BY_TYPE.items() for c in cs]
    out = d.groupBy(TX).agg(
        *fields,
        last("accepted_amount_minor", "buyer_accepted", "checkout_created").alias("accepted_amount_minor"),
        last("return_exposure_state", "return_status_recorded", "mature").alias("return_exposure_state"),
        last("payment_state", "paid", "refund_recorded", "mature").alias("payment_lifecycle_state"),
        F.max_by(F.struct("lifecycle_state", "event_type", "occurred_at"), o).alias("_last"),
        F.max(F.when(kind == "mature", o)).alias("_mature"), F.max(F.when(kind.isin("refund_recorded", "return_status_recorded"), o)).alias("_undo"))
    undone = F.coalesce(F.col("_undo") > F.col("_mature"), F.lit(False))
    back = (F.col("_last.event_type") == "return_status_recorded") & (F.col("_last.lifecycle_state") == "mature")
    state = F.when(back, F.coalesce("payment_lifecycle_state", F.lit("paid"))).otherwise(F.col("_last.lifecycle_state"))
    return out.withColumns({"lifecycle_state": state, "updated_at": F.col("_last.occurred_at"),
                            **{c: F.when(~undone, F.col(c)) for c in MATURE_FIELDS}}).drop("_last", "_mature", "_undo")


def refund_ledger(refunds: DataFrame, payments: DataFrame) -> DataFrame:
    """Status of every refund delivery and the running total of recorded ones
    (T7). A reference seen before is refused; one before payment is held; one
    without amount or in another currency waits for reconciliation."""
    first = refunds.groupBy("refund_reference_hash").agg(F.min("ordinal").alias("_first"))
    d = refunds.join(first, "refund_reference_hash").join(payments.select(TX, "paid_ordinal", "paid_total_minor", "paid_currency"), TX, "left")
    status = (
        F.when(F.col("ordinal") > F.col("_first"), "duplicate_refused")
        .when(F.col("paid_ordinal").isNull() | (F.col("ordinal") < F.col("paid_ordinal")), "held_before_paid")
        .when(F.col("refund_total_minor").isNull() | (F.col("currency") != F.col("paid_currency")), "needs_reconciliation")
        .otherwise("recorded"))
    d = d.withColumn("status", status)
    amount = F.when(F.col("status") == "recorded", F.col("refund_total_minor")).otherwise(0)
    g = done(with_running(grouped(d, [TX], ["ordinal"]), sums={"cumulative_refund_total_minor": amount}))
    state = F.when(F.col("status") == "recorded", F.when(F.col("cumulative_refund_total_minor") >= F.col("paid_total_minor"), "refunded").otherwise("partially_refunded"))
    return g.withColumn("payment_state", state).drop("_first", "paid_ordinal", "paid_total_minor", "paid_currency")


def return_exposure(returns: DataFrame) -> DataFrame:
    """Changes of a return's status and whether exposure is open after it (T8);
    a repeated status is ignored."""
    g = with_previous(grouped(returns, ["return_reference_hash"], ["ordinal"]), {"_before": "return_status"})
    d = done(g).filter(F.col("_is_first") | ~F.col("_before").eqNullSafe(F.col("return_status")))
    closed = F.upper("return_status").isin("CLOSED", "CANCELED", "DECLINED")
    return d.withColumn("return_exposure_state", F.when(closed, "closed").otherwise("open")).drop("_before", "_is_first")


HOLDS = ["needs_reconciliation", "held_before_paid"]


def input_hash(window_days: int, currency: str, costs: dict[str, int]) -> Column:
    """Fingerprint of all a maturity depends on."""
    cfg = "|".join([str(window_days), currency, *[f"{k}={v}" for k, v in sorted(costs.items())]])
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [TX, "paid_total_minor", "cumulative_refund_total_minor", "return_exposure_state"]]
    return F.sha2(F.concat_ws("|", *parts, F.lit(cfg)), 256)


def mature(snapshots: DataFrame, refs: DataFrame, matured: DataFrame, as_of: str, window_days: int, currency: str, costs: dict[str, int]) -> DataFrame:
    """Eligibility of every transaction in the reference's order of tests, and
    the margin of the eligible (T9). `refs` are refund and return references
    with a status per delivery; the latest per reference counts."""
    latest = refs.groupBy(TX, "reference_hash").agg(F.max_by("status", "ordinal").alias("s"))
    holds = latest.filter(F.col("s").isin(HOLDS)).groupBy(TX).agg(F.count(F.lit(1)).alias("holds"))
    seen = matured.select(TX, F.col("maturity_input_hash").alias("_seen")).distinct()
    d = snapshots.withColumn("input_hash", input_hash(window_days, currency, costs)).join(holds, TX, "left")
    d = d.join(seen.withColumnRenamed(TX, "_t"), (F.col(TX) == F.col("_t")) & (F.col("input_hash") == F.col("_seen")), "left")
    refund = F.coalesce("cumulative_refund_total_minor", F.lit(0))
    age_ok = F.lit(as_of).cast("timestamp") >= F.col("paid_at") + F.make_interval(days=F.lit(window_days))
    reason = (
        F.when(F.col("paid_at").isNull() | F.col("paid_total_minor").isNull(), "not_paid")
        .when(F.coalesce(F.col("return_exposure_state") == "open", F.lit(False)), "return_exposure_open")
        .when(~age_ok, "maturity_window_open")
        .when(F.col("paid_currency") != currency, "currency_mismatch")
        .when(F.coalesce((refund > 0) & (F.col("refund_currency") != currency), F.lit(False)), "currency_mismatch")
        .when(F.col("holds") > 0, "reconciliation_hold")
        .when(F.col("_seen").isNotNull(), "duplicate_maturity_input"))
    net = F.col("paid_total_minor") - refund
    total = sum(costs.values())
    d = d.withColumns({"reason": reason, "_net": net})
    ok = F.col("reason").isNull()
    return d.select(TX, "reason", ok.alias("eligible"), "input_hash", F.when(ok, F.col("_net")).alias("net_revenue_minor"), F.when(ok, F.col("_net") - total).alias("mature_margin_minor"))


def maturity_label() -> Column:
    return (F.when(F.col("lifecycle_state") == "mature", "current_mature").when(F.coalesce(F.col("return_exposure_state") == "open", F.lit(False)), "maturity_blocked_open_return")
            .when(F.col("paid_at").isNotNull(), "not_currently_mature").otherwise("not_paid"))


def maturity_status(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Transactions per maturity status, with the mature events that are no
    longer current (T10)."""
    cur = snapshots.withColumn("maturity_status", maturity_label())
    old = events.filter("event_type = 'mature'").select(TX, F.col("maturity_input_hash").alias("_h")).join(
        cur.select(TX, "maturity_status", "lifecycle_state", "maturity_input_hash"), TX, "left")
    live = (F.col("lifecycle_state") == "mature") & (F.col("maturity_input_hash") == F.col("_h"))
    stale = old.filter(~F.coalesce(live, F.lit(False))).groupBy(F.coalesce("maturity_status", F.lit("no_snapshot")).alias("maturity_status")).agg(F.count(F.lit(1)).alias("stale_mature_events"))
    n = cur.groupBy("maturity_status").agg(F.count(F.lit(1)).alias("transactions"))
    return n.join(stale, "maturity_status", "full").select("maturity_status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("transactions", "stale_mature_events")])


def transaction_ledger(snapshots: DataFrame) -> DataFrame:
    """One display row per transaction, no identifiers beyond hashes."""
    mature_now = F.col("lifecycle_state") == "mature"
    label = F.concat(F.coalesce("product_title", F.lit("Product")), F.lit(" ("), F.substring(F.coalesce("product_reference_hash", F.lit("")), 1, 8), F.lit(")"))
    return snapshots.select(
        TX, label.alias("product"), "lifecycle_state", maturity_label().alias("maturity_status"), "offer_amount_minor",
        F.coalesce("accepted_amount_minor", "counter_amount_minor", "offer_amount_minor").alias("selected_amount_minor"), "paid_total_minor",
        F.coalesce("cumulative_refund_total_minor", F.lit(0)).alias("refund_total_minor"), F.coalesce("return_exposure_state", F.lit("none")).alias("return_exposure_state"),
        F.when(mature_now, F.col("mature_margin_minor")).alias("mature_margin_minor"))


NEXT_ACTION = {"offer_submitted": "merchant_review", "merchant_countered": "await_buyer", "buyer_accepted": "create_checkout", "checkout_created": "await_order",
               "order_created": "await_payment", "paid": "await_maturity"}


def inbox(snapshots: DataFrame) -> DataFrame:
    """Open offers with amounts and the next allowed step."""
    steps = F.create_map(*[F.lit(x) for kv in NEXT_ACTION.items() for x in kv])
    d = snapshots.withColumn("next_action", F.try_element_at(steps, F.col("lifecycle_state")))
    return d.filter("next_action IS NOT NULL").select(TX, "lifecycle_state", "next_action", "offer_amount_minor", "counter_amount_minor", "currency")


def reconcile_mature(events: DataFrame) -> DataFrame:
    """Whether sale equals checkout and margin equals its parts."""
    t, o = F.col("transition_to"), F.col("ordinal")
    g = events.groupBy("merchant_namespace", TX).agg(
        F.max_by("buyer_offer_minor", F.when(t == "offer_submitted", o)).alias("offer"), F.max_by("final_sale_minor", F.when(t == "paid", o)).alias("sale"),
        F.min_by("cost_basis_minor", F.when(F.col("cost_basis_minor").isNotNull(), o)).alias("cost"), F.max("fees_minor").alias("fees"), F.max("shipping_cost_minor").alias("fulfilment"),
        F.sum("refund_minor").alias("refunds"), F.max_by("margin_minor", F.when(t == "mature", o)).alias("margin"), F.bool_or(t == "mature").alias("is_mature"))
    z = lambda c: F.coalesce(c, F.lit(0))
    want = F.col("sale") - z("cost") - z("fees") - z("fulfilment") - z("refunds")
    return g.filter("is_mature").select("merchant_namespace", TX, F.coalesce(F.col("sale") == F.col("offer"), F.lit(False)).alias("sale_matches"), want.alias("expected_margin_minor"),
                                        F.coalesce(F.col("margin") == want, F.lit(False)).alias("margin_matches"))


def bind_references(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Transaction of each delivery by its hashed reference."""
    known = refs.groupBy("reference_hash").agg(F.min_by(TX, "ordinal").alias(TX))
    return events.join(known, "reference_hash", "left").withColumn("bound", F.col(TX).isNotNull())

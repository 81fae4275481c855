"""Merchant offers, snapshots and lifecycle transactions over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from haggle.operators import commerce as C
from haggle.operators import lifecycle as L
from haggle.plans.registry import fixture, query, view

# ---- inputs: an order is an offer; every branch is an edge case of the checks

view("v_base", """
SELECT o_orderkey AS k, CONCAT('m', CAST(o_custkey % 5 AS STRING)) AS merchant_id, CAST(o_orderkey AS STRING) AS offer_id,
       CONCAT(CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 5 AS STRING)) AS listing_id, o_orderdate AS d, o_orderpriority AS category,
       CASE o_orderstatus WHEN 'F' THEN 'web' WHEN 'O' THEN 'app' ELSE 'phone' END AS surface,
       CAST(FLOOR(o_totalprice / 100) AS DOUBLE) AS asking, FLOOR(CAST(FLOOR(o_totalprice / 100) AS DOUBLE) * (50 + o_orderkey % 50) / 100) AS bid,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE FLOOR(CAST(FLOOR(o_totalprice / 100) AS DOUBLE) * 40 / 100) END AS cost
FROM orders""")
view("v_ctx", """
SELECT *, FLOOR(asking * 90 / 100) AS c90, FLOOR(asking * 80 / 100) AS c80,
       CASE WHEN k % 4 = 0 THEN 'accept' WHEN k % 4 = 3 THEN 'decline' ELSE 'counter_at_amount' END AS pick,
       CASE WHEN k % 89 = 0 THEN asking WHEN k % 4 = 0 THEN bid WHEN k % 4 = 1 THEN FLOOR(asking * 90 / 100) WHEN k % 4 = 2 THEN FLOOR(asking * 80 / 100) END AS pick_amount
FROM v_base""")
view("v_offer_rows", """
SELECT c.*, s.event_type, k * 10 + s.seq AS ordinal,
       CASE s.seq WHEN 0 THEN d WHEN 1 THEN d + INTERVAL '1' HOUR WHEN 2 THEN CASE WHEN k % 97 = 0 THEN d - INTERVAL '1' DAY ELSE d + INTERVAL '1' DAY END
            ELSE d + INTERVAL '30' DAY END AS occurred_at
FROM v_ctx c JOIN (VALUES (0, 'offer_opened'), (1, 'offer_opened'), (2, 'merchant_decision'), (3, 'outcome_matured')) AS s(seq, event_type)
  ON (s.seq = 0 AND k % 103 <> 0) OR (s.seq = 1 AND k % 101 = 0) OR (s.seq = 2 AND k % 3 <> 0) OR (s.seq = 3 AND (k % 3 = 1 OR k % 6 = 2))""")


def offer_events(spark, sf):
    e = fixture(spark, sf, "v_offer_rows")
    act = lambda a, x: F.struct(F.lit(a).alias("action"), x.cast("double").alias("amount"))
    paid = F.when(F.col("event_type") == "outcome_matured", True)
    only = lambda c: F.when(paid, c)
    k = F.col("k")
    return e.select(
        "merchant_id", "offer_id", "event_type", "ordinal", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "listing_id", "surface",
        F.array(act("accept", F.col("bid")), act("counter_at_amount", F.col("c90")), act("counter_at_amount", F.col("c80")), act("decline", F.lit(None))).alias("available_actions"),
        F.col("asking").alias("asking_price"), F.col("bid").cast("double").alias("buyer_offer_amount"), F.col("cost").cast("double").alias("cost_basis"), F.lit(10.0).alias("merchant_floor"),
        F.lit(0.125).alias("platform_fee_rate"), F.lit(0.25).alias("payment_fee_flat"), F.lit(5.0).alias("shipping_cost"), F.lit(1.0).alias("fulfillment_cost"),
        F.lit(0.5).alias("return_allowance"), "category", F.when(k % 2 == 0, F.col("category")).alias("sku"), F.when(k % 17 == 0, None).otherwise(k % 100).alias("inventory_age_days"),
        F.when(F.col("event_type") == "merchant_decision", F.struct(F.col("pick").alias("action"), F.col("pick_amount").cast("double").alias("amount"))).alias("selected_action"),
        only(k % 5 != 0).alias("buyer_paid"), only(k % 7 == 0).alias("returned"), only(k % 13 == 0).alias("cancelled"), only(k % 8 != 1).alias("return_window_matured"),
        only(F.coalesce("pick_amount", "bid").cast("double")).alias("final_sale_price"), only(F.when(k % 7 == 0, 5.0).otherwise(0.0)).alias("refund_amount"),
        only(F.coalesce("pick_amount", "bid").cast("double") - F.coalesce(F.col("cost").cast("double"), F.lit(0.0))).alias("mature_contribution_margin"),
        only(F.col("d").cast("timestamp") + F.expr("INTERVAL '1' DAY") * (k % 10)).alias("paid_at"))


def threads(spark, sf):
    return C.offer_threads(offer_events(spark, sf))


# the same events as one row per offer, for the checks
view("v_threads", """
SELECT *, k % 3 <> 0 AS decided, (k % 3 = 1 OR k % 6 = 2) AS matured, COALESCE(pick_amount, bid) AS final_sale,
       COALESCE(pick_amount, bid) - COALESCE(cost, 0) AS margin,
       CASE WHEN k % 3 <> 0 THEN CASE WHEN pick = 'decline' THEN NULL WHEN pick = 'accept' AND pick_amount = 0 THEN bid ELSE pick_amount END END AS sel_amount,
       (k % 3 = 1 OR k % 6 = 2) AND k % 5 <> 0 AND k % 8 <> 1 AND k % 13 <> 0 AS mpaid,
       CASE WHEN k % 101 = 0 THEN d + INTERVAL '1' HOUR ELSE d END AS opened,
       CASE WHEN k % 17 = 0 THEN NULL ELSE k % 100 END AS age, CASE WHEN k % 2 = 0 THEN category END AS sku
FROM v_ctx WHERE k % 103 <> 0 OR k % 101 = 0""")
_M = "({0} - {0} * 0.125::DOUBLE - 0.25::DOUBLE - 5 - 1 - 0.5::DOUBLE - cost)"


@query("offer_threads", """
SELECT merchant_id, offer_id, opened AS opened_at, CASE WHEN decided THEN pick END AS action, CASE WHEN decided THEN pick_amount END AS amount,
       CASE WHEN matured THEN margin END AS margin FROM v_threads""")
def _(spark, sf):
    return threads(spark, sf).select("merchant_id", "offer_id", F.col("offer.occurred_at").alias("opened_at"), F.col("decision.selected_action.action").alias("action"),
                                     F.col("decision.selected_action.amount").alias("amount"), F.col("outcome.mature_contribution_margin").alias("margin"))


@query("open_offers", "SELECT merchant_id, offer_id, ordinal - k * 10 AS seq FROM v_offer_rows WHERE event_type = 'offer_opened' AND NOT (k % 3 <> 0 OR k % 3 = 1 OR k % 6 = 2)")
def _(spark, sf):
    e = offer_events(spark, sf)
    o = C.open_offers(e).select("merchant_id", "offer_id", "occurred_at")
    return o.join(e.filter("event_type = 'offer_opened'").select("merchant_id", "offer_id", "occurred_at", "ordinal"), ["merchant_id", "offer_id", "occurred_at"]).select(
        "merchant_id", "offer_id", (F.col("ordinal") - F.col("offer_id").cast("long") * 10).alias("seq"))


@query("action_economics", f"""
SELECT merchant_id, offer_id, action, amount, round(m, 2) AS mature_margin_if_sold, COALESCE(m < 10, FALSE) AS violates_merchant_floor FROM (
  SELECT r.merchant_id, r.offer_id, a.action, a.amount, {_M.format('a.amount')} AS m FROM v_offer_rows r,
    LATERAL (VALUES ('accept', CASE WHEN bid <> 0 THEN bid ELSE bid END), ('counter_at_amount', c90), ('counter_at_amount', c80), ('decline', NULL)) AS a(action, amount)
  WHERE r.event_type = 'offer_opened') t""")
def _(spark, sf):
    return C.action_economics(offer_events(spark, sf).filter("event_type = 'offer_opened'"))


_OPEN = "event_type = 'offer_opened'"
_PAID = "event_type = 'outcome_matured' AND k % 5 <> 0 AND k % 8 <> 1 AND k % 13 <> 0"
_MARG = "COALESCE(pick_amount, bid) - COALESCE(cost, 0)"


@query("merchant_audit", f"""
SELECT *, cost_coverage >= 0.8 AND mature_paid_outcomes >= 30 AS gate FROM (
SELECT merchant_id, COUNT(*) AS events, COUNT(*) FILTER (WHERE {_OPEN}) AS offers_opened, COUNT(*) FILTER (WHERE event_type = 'merchant_decision') AS merchant_decisions,
  COUNT(*) FILTER (WHERE event_type = 'outcome_matured') AS mature_outcomes, COUNT(*) FILTER (WHERE {_PAID}) AS mature_paid_outcomes,
  COALESCE(SUM({_MARG}) FILTER (WHERE {_PAID}), 0) AS total_margin,
  round(COUNT(*) FILTER (WHERE {_OPEN} AND cost IS NOT NULL)::DOUBLE / COUNT(*) FILTER (WHERE {_OPEN}), 4) AS cost_coverage
FROM v_offer_rows GROUP BY 1) t""", "total_margin:2")
def _(spark, sf):
    return C.merchant_audit(offer_events(spark, sf))


@query("surface_counts", f"SELECT merchant_id, surface, COUNT(*) AS offers FROM v_offer_rows WHERE {_OPEN} GROUP BY 1, 2")
def _(spark, sf):
    return C.surface_counts(offer_events(spark, sf))


_HAS = "(k % 103 <> 0 OR k % 101 = 0)"


@query("thread_integrity", f"""
SELECT merchant_id, offer_id, 'duplicate_offer_opened' AS violation, 1::BIGINT AS rows FROM v_ctx WHERE k % 103 <> 0 AND k % 101 = 0
UNION ALL SELECT merchant_id, offer_id, event_type || '_without_offer_opened', 1 FROM v_offer_rows WHERE NOT {_OPEN} AND NOT {_HAS}
UNION ALL SELECT merchant_id, offer_id, 'merchant_decision_before_offer_opened', 1 FROM v_ctx WHERE {_HAS} AND k % 3 <> 0 AND k % 97 = 0
UNION ALL SELECT merchant_id, offer_id, 'merchant_decision_unavailable_action', 1 FROM v_ctx WHERE {_HAS} AND k % 3 <> 0 AND NOT (
  (pick = 'accept' AND pick_amount = bid) OR (pick = 'counter_at_amount' AND pick_amount IN (c90, c80)) OR (pick = 'decline' AND pick_amount IS NULL))""")
def _(spark, sf):
    return C.thread_integrity(offer_events(spark, sf))


@query("margin_by_product", """
SELECT COALESCE(sku, listing_id) AS product_key, CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 7 THEN '0-7' WHEN age <= 30 THEN '8-30' WHEN age <= 60 THEN '31-60' ELSE '61+' END AS inventory_age_bucket,
  COUNT(*) AS paid_outcomes, SUM(margin) AS total_mature_margin, CAST(round(CAST(AVG(margin) AS DECIMAL(38,16)), 2) AS DOUBLE) AS average_mature_margin FROM v_threads WHERE mpaid GROUP BY 1, 2""", "total_mature_margin:2 average_mature_margin")
def _(spark, sf):
    return C.margin_by_product(threads(spark, sf))


@query("concessions", """
SELECT merchant_id, offer_id, asking AS asking_price, sel_amount AS selected_amount, GREATEST(asking - sel_amount, 0) AS amount_conceded,
  CAST(round(CAST(CASE WHEN asking > 0 THEN GREATEST(asking - sel_amount, 0) / asking ELSE 0 END AS DECIMAL(38,16)), 4) AS DOUBLE) AS concession_rate FROM v_threads WHERE sel_amount IS NOT NULL""", "concession_rate")
def _(spark, sf):
    return C.concessions(threads(spark, sf))


@query("merchant_utility", """
SELECT merchant_id, COUNT(*) AS offers_opened, COUNT(*) FILTER (WHERE decided) AS merchant_responded, COUNT(*) FILTER (WHERE decided AND pick <> 'decline') AS accepted_or_countered,
  COUNT(*) FILTER (WHERE matured) AS mature_outcomes, COUNT(*) FILTER (WHERE mpaid) AS paid_mature_outcomes, COUNT(*) FILTER (WHERE mpaid AND k % 7 <> 0) AS paid_nonreturned,
  COUNT(*) FILTER (WHERE matured AND k % 7 = 0) AS returned, AVG(GREATEST(asking - sel_amount, 0)) FILTER (WHERE sel_amount IS NOT NULL) AS average_concession,
  AVG(GREATEST(asking - sel_amount, 0) / asking) FILTER (WHERE sel_amount IS NOT NULL AND asking > 0) AS average_concession_rate,
  AVG((k % 10) * 86400.0::DOUBLE - CASE WHEN k % 101 = 0 THEN 3600 ELSE 0 END) FILTER (WHERE mpaid) AS average_seconds_to_payment,
  COUNT(*) FILTER (WHERE decided AND pick <> 'decline' AND NOT (matured AND k % 5 <> 0 AND k % 13 <> 0)) AS unpaid_accepted,
  COALESCE(SUM(final_sale) FILTER (WHERE mpaid), 0) AS gross_paid_sales, SUM(CASE WHEN matured AND k % 7 = 0 THEN 5.0::DOUBLE ELSE 0 END) AS refunds,
  COALESCE(SUM(margin) FILTER (WHERE mpaid), 0) AS mature_margin FROM v_threads GROUP BY 1""",
       "average_concession average_concession_rate average_seconds_to_payment:4 gross_paid_sales:2 refunds:2 mature_margin:2")
def _(spark, sf):
    return C.merchant_utility(threads(spark, sf))


view("v_comp", """
SELECT t.merchant_id, t.offer_id, COUNT(h.offer_id) AS comparables, MIN(h.sel_amount) AS low, MAX(h.sel_amount) AS high FROM v_threads t
LEFT JOIN v_threads h ON h.category = t.category AND h.mpaid AND h.decided AND h.d + INTERVAL 30 DAY <= t.opened AND h.offer_id <> t.offer_id GROUP BY 1, 2""")


@query("comparables_as_of", "SELECT * FROM v_comp")
def _(spark, sf):
    return C.comparables_as_of(threads(spark, sf))


_BUY = _M.format("bid")


@query("shadow_recommend", f"""
SELECT merchant_id, offer_id, comparables,
  CASE WHEN blocked THEN 'abstain' WHEN acc >= 20 THEN 'accept' WHEN best IS NOT NULL THEN 'counter_at_amount' ELSE 'abstain' END AS action,
  CASE WHEN blocked THEN NULL WHEN acc >= 20 THEN bid ELSE best END AS amount FROM (
  SELECT t.merchant_id, t.offer_id, c.comparables, t.bid, {_BUY} AS acc, t.cost IS NULL OR c.comparables < 5 AS blocked,
    CASE WHEN {_M.format('c90')} >= 20 AND {_M.format('c90')} > {_BUY} AND c90 BETWEEN low AND high THEN c90
         WHEN {_M.format('c80')} >= 20 AND {_M.format('c80')} > {_BUY} AND c80 BETWEEN low AND high THEN c80 END AS best
  FROM v_threads t JOIN v_comp c ON c.offer_id = t.offer_id WHERE NOT t.decided AND NOT (t.k % 2 = 1)) q""")
def _(spark, sf):
    t = threads(spark, sf)
    hold = t.select("merchant_id", "offer_id", F.when(F.col("offer_id").cast("long") % 2 == 1, "control").otherwise("treatment").alias("assigned_arm"))
    return C.shadow_recommend(t, "2030-01-01 00:00:00", holdouts=hold).select("merchant_id", "offer_id", "comparables", "action", "amount")


@query("replay_rule", f"""
SELECT merchant_id, offer_id, action AS simulated_action, CASE WHEN action = 'accept' THEN bid WHEN action = 'counter_at_amount' THEN CASE WHEN ABS(c80 - tgt) < ABS(c90 - tgt) OR (ABS(c80 - tgt) = ABS(c90 - tgt) AND c80 < c90) THEN c80 ELSE c90 END END AS simulated_amount
FROM (SELECT *, CASE WHEN COALESCE({_BUY} >= 10, FALSE) THEN 'accept' WHEN cost IS NOT NULL AND {_M.format('tgt')} < 10 THEN 'decline' ELSE 'counter_at_amount' END AS action
  FROM (SELECT *, round(LEAST(asking, bid * 1.08::DOUBLE), 2) AS tgt FROM v_threads) a) b""")
def _(spark, sf):
    return C.replay_rule(threads(spark, sf), "accept_if_margin_then_counter").select("merchant_id", "offer_id", "simulated_action", "simulated_amount")


@query("replay_rule_reuse", """
SELECT simulated_action, COUNT(*) AS offers, COUNT(*) FILTER (WHERE matched) AS matches, SUM(CASE WHEN matched AND matured AND k % 8 <> 1 THEN margin END) AS reused_margin FROM (
  SELECT *, decided AND pick = simulated_action AND (pick = 'decline' OR ABS(pick_amount - amt) <= 0.01) AS matched FROM (
    SELECT t.*, CASE WHEN cost IS NOT NULL AND """ + _M.format("tgt") + """ < 10 THEN 'decline' ELSE 'counter_at_amount' END AS simulated_action,
      CASE WHEN ABS(c80 - tgt) < ABS(c90 - tgt) OR (ABS(c80 - tgt) = ABS(c90 - tgt) AND c80 < c90) THEN c80 ELSE c90 END AS amt
    FROM (SELECT *, round(LEAST(asking, bid * 1.08::DOUBLE), 2) AS tgt FROM v_threads) t) u) v GROUP BY 1""", "reused_margin:2")
def _(spark, sf):
    r = C.replay_rule(threads(spark, sf))
    return r.groupBy("simulated_action").agg(F.count(F.lit(1)).alias("offers"), F.count_if("actions_match").alias("matches"), F.sum("observed_mature_margin").alias("reused_margin"))


# ---- decision snapshots

view("v_snap", """
SELECT offer_id AS decision_id, CASE WHEN k % 3 = 0 THEN 'inbox' ELSE 'bulk' END AS decision_channel, CASE WHEN k % 2 = 0 THEN UPPER(category) ELSE LOWER(category) END AS category,
  CASE WHEN k % 10 = 0 THEN NULL ELSE bid END AS buyer_offer_amount, asking + 1 AS asking_price, cost AS seller_cost_basis, CASE WHEN k % 10 = 0 THEN NULL ELSE bid / (asking + 1) END AS offer_to_asking_ratio,
  CAST(k % 120 AS INTEGER) AS days_active, CAST(k % 40 AS INTEGER) AS views_7d, CASE k % 4 WHEN 0 THEN 'declining' WHEN 1 THEN 'flat' WHEN 2 THEN 'increasing' ELSE 'unknown' END AS traffic_trend,
  CAST(k % 9 AS INTEGER) AS interested_buyers, CAST(k % 5 AS INTEGER) AS prior_offer_count, CAST(k % 3 AS INTEGER) AS seller_urgency, CAST(k % 30 AS DOUBLE) AS traffic_age_hours,
  CAST(4 AS DOUBLE) AS shipping_cost, CAST(1 AS DOUBLE) AS promotion_cost, asking * 45 / 100 AS minimum_net_proceeds, c90,
  CASE k % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'counter' WHEN 2 THEN 'decline' ELSE 'wait' END AS action, k % 5 <> 4 AS has_outcome, k % 3 <> 0 AS buyer_paid, k % 17 = 0 AS order_cancelled, k % 19 = 0 AS unpaid_order,
  k % 7 <> 0 AS return_window_matured, k % 2 = 0 AS seller_accepted, k % 23 = 0 AS returned, CASE WHEN k % 29 = 0 THEN NULL ELSE bid - 200 END AS mature_margin,
  CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(3 AS DOUBLE) END AS actual_fees, CAST(k % 20 AS DOUBLE) AS days_to_sale
FROM v_ctx""")


def snapshots(spark, sf):
    s = fixture(spark, sf, "v_snap")
    dbl = ["buyer_offer_amount", "asking_price", "seller_cost_basis", "offer_to_asking_ratio", "minimum_net_proceeds", "mature_margin", "c90"]
    s = s.withColumns({c: F.col(c).cast("double") for c in dbl})
    act = lambda a, x: F.struct(F.lit(a).alias("action"), x.cast("double").alias("amount"))
    return s.withColumn("available_actions", F.array(act("accept", F.col("buyer_offer_amount")), act("counter", F.col("c90")), act("decline", F.lit(None)), act("wait", F.lit(None)))).drop("c90")




def _r(expr: str, d: int) -> str:
    """Half-up on the decimal text of a double, as Spark rounds."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,16)), {d}) AS DOUBLE)"


_BP = "(buyer_paid AND NOT order_cancelled AND NOT unpaid_order)"
_MP = f"({_BP} AND return_window_matured AND mature_margin IS NOT NULL)"
_MM = f"CASE WHEN {_MP} THEN mature_margin END"
_SUMS = f"""COUNT(*) AS decisions, {_r(f"AVG(CASE WHEN {_BP} THEN 1 ELSE 0 END)", 4)} AS buyer_paid_rate, COUNT(*) FILTER (WHERE seller_accepted AND NOT buyer_paid) AS seller_accepted_unpaid,
  COUNT({_MM}) AS mature_decisions, COALESCE(SUM({_MM}), 0) AS total_mature_margin, {_r(f"AVG({_MM})", 2)} AS average_mature_margin, {_r(f"AVG({_MM} / GREATEST(days_to_sale, 1))", 2)} AS average_margin_per_listing_day"""


@query("profit_audit", f"SELECT 'action' AS dimension, action AS key, {_SUMS} FROM v_snap WHERE has_outcome GROUP BY 2 UNION ALL SELECT 'channel', decision_channel, {_SUMS} FROM v_snap WHERE has_outcome GROUP BY 2",
       "buyer_paid_rate total_mature_margin:2 average_mature_margin average_margin_per_listing_day")
def _(spark, sf):
    return C.profit_audit(snapshots(spark, sf))


_BUCKETS = {
    "offer_ratio": "CASE WHEN offer_to_asking_ratio IS NULL THEN 'no_buyer_offer' WHEN offer_to_asking_ratio < 0.65 THEN 'below_65_pct' WHEN offer_to_asking_ratio < 0.75 THEN '65_to_75_pct' WHEN offer_to_asking_ratio < 0.85 THEN '75_to_85_pct' ELSE 'above_85_pct' END",
    "category": "category", "listing_age": "CASE WHEN days_active < 14 THEN '0_to_13_days' WHEN days_active < 45 THEN '14_to_44_days' WHEN days_active < 90 THEN '45_to_89_days' ELSE '90_plus_days' END",
    "cost_band": "CASE WHEN seller_cost_basis IS NULL THEN 'missing_cost_basis' WHEN seller_cost_basis < 100 THEN 'under_100' WHEN seller_cost_basis < 500 THEN '100_to_499' WHEN seller_cost_basis < 1000 THEN '500_to_999' ELSE '1000_plus' END",
    "traffic": "traffic_trend", "interested": "CASE WHEN interested_buyers = 0 THEN '0' WHEN interested_buyers <= 2 THEN '1_to_2' WHEN interested_buyers <= 5 THEN '3_to_5' ELSE '6_plus' END",
    "prior_offers": "CASE WHEN prior_offer_count = 0 THEN '0' WHEN prior_offer_count <= 2 THEN '1_to_2' ELSE '3_plus' END", "urgency": "CAST(seller_urgency AS STRING)"}


@query("policy_audit", " UNION ALL ".join(f"""
SELECT '{n}' AS breakout, bucket, SUM(n)::BIGINT AS decisions, STRING_AGG(action || ':' || n, ',' ORDER BY action) AS action_mix, {_r("SUM(p) / SUM(n)", 4)} AS buyer_paid_rate, SUM(k)::BIGINT AS mature_paid_outcomes,
  {_r("SUM(s) / SUM(k)", 2)} AS average_mature_margin FROM (SELECT {b} AS bucket, action, COUNT(*) AS n, COUNT(*) FILTER (WHERE {_BP}) AS p, COUNT({_MM}) AS k, SUM({_MM}) AS s FROM v_snap WHERE has_outcome GROUP BY 1, 2) t GROUP BY 2"""
    for n, b in _BUCKETS.items()), "buyer_paid_rate average_mature_margin")
def _(spark, sf):
    return C.policy_audit(snapshots(spark, sf))


@query("data_quality", f"""
SELECT snapshots, decisions_with_outcomes, cost_coverage, fee_coverage, mature_coverage, traffic_coverage, mature_paid_outcomes, round((cost_coverage + fee_coverage + mature_coverage + traffic_coverage) / 4, 3) AS score,
  CONCAT_WS(',', CASE WHEN cost_coverage < 0.95 THEN 'cost basis' END, CASE WHEN fee_coverage < 0.95 THEN 'fees' END, CASE WHEN mature_coverage < 0.8 THEN 'return windows' END,
   CASE WHEN mature_paid_outcomes < 30 THEN 'mature outcomes' END, CASE WHEN traffic_coverage < 0.95 THEN 'stale traffic' END) AS warnings FROM (
SELECT COUNT(*) AS snapshots, COUNT(*) FILTER (WHERE has_outcome) AS decisions_with_outcomes, round(COUNT(seller_cost_basis)::DOUBLE / COUNT(*), 4) AS cost_coverage,
  round(COUNT(*) FILTER (WHERE has_outcome AND actual_fees IS NOT NULL)::DOUBLE / COUNT(*) FILTER (WHERE has_outcome), 4) AS fee_coverage,
  round(COUNT(*) FILTER (WHERE has_outcome AND return_window_matured)::DOUBLE / COUNT(*) FILTER (WHERE has_outcome), 4) AS mature_coverage,
  round(COUNT(*) FILTER (WHERE traffic_age_hours <= 24)::DOUBLE / COUNT(*), 4) AS traffic_coverage, COUNT(*) FILTER (WHERE has_outcome AND {_MP}) AS mature_paid_outcomes FROM v_snap) t""")
def _(spark, sf):
    return C.data_quality(snapshots(spark, sf))


@query("missed_opportunities", f"""
SELECT decision_id, CASE WHEN action IN ('decline', 'wait') THEN 'retrospective_positive_offer_was_not_closed' ELSE 'accepted_order_later_returned' END AS reason, buyer_offer_amount
FROM v_snap WHERE has_outcome AND ((action IN ('decline', 'wait') AND buyer_offer_amount IS NOT NULL AND {_MM} <= 0) OR (action = 'accept' AND returned)) ORDER BY decision_id LIMIT 10""")
def _(spark, sf):
    return C.missed_opportunities(snapshots(spark, sf))


view("v_compcat", f"SELECT decision_channel, lower(category) AS folded, COUNT(*) AS comparables FROM v_snap WHERE has_outcome AND seller_cost_basis IS NOT NULL AND {_MP} AND actual_fees IS NOT NULL GROUP BY 1, 2")


@query("comparable_counts", "SELECT * FROM v_compcat")
def _(spark, sf):
    return C.comparable_counts(snapshots(spark, sf))


_TREND = "CASE traffic_trend WHEN 'declining' THEN -0.06 WHEN 'increasing' THEN 0.06 WHEN 'flat' THEN 0 ELSE -0.02 END::DOUBLE"
_TRAF = "LEAST(0.12::DOUBLE, ln(1 + views_7d) / 60)"
view("v_eval", f"""
SELECT *, amount * (1 - 0.125::DOUBLE) - shipping_cost - promotion_cost AS net FROM (SELECT s.decision_id, s.decision_channel, s.category, seller_cost_basis, traffic_age_hours, shipping_cost, promotion_cost, minimum_net_proceeds, seller_urgency, a.action,
  CASE a.action WHEN 'accept' THEN COALESCE(buyer_offer_amount, 0) WHEN 'counter' THEN c90 WHEN 'wait' THEN asking_price END AS amount,
  CASE a.action WHEN 'accept' THEN 1.0::DOUBLE WHEN 'decline' THEN 0.0 WHEN 'wait' THEN GREATEST(0.02, LEAST(0.65, 0.12 + {_TRAF} + 0.03::DOUBLE * interested_buyers + {_TREND} - 0.03::DOUBLE * seller_urgency))
   ELSE CASE WHEN buyer_offer_amount IS NULL THEN GREATEST(0.02, LEAST(0.88, 0.10 + GREATEST(0, 1 - c90 / asking_price) * 1.8::DOUBLE + 0.04::DOUBLE * interested_buyers + {_TRAF} + {_TREND}))
   ELSE GREATEST(0.02, LEAST(0.95, 0.78 - 1.85::DOUBLE * (GREATEST(c90 - buyer_offer_amount, 0) / GREATEST(buyer_offer_amount, 1)) - 0.25::DOUBLE * GREATEST(c90 / asking_price - 0.85, 0) + {_TRAF} + {_TREND} + 0.03::DOUBLE * seller_urgency)) END END AS p
  FROM v_snap s CROSS JOIN (VALUES ('accept'), ('counter'), ('decline'), ('wait')) AS a(action)) t""")


@query("evaluate_actions", f"""
SELECT decision_id, action, amount, {_r('p', 4)} AS sale_probability, p * (net - seller_cost_basis) AS expected_margin, COALESCE(net < minimum_net_proceeds, FALSE) AS violates_floor,
  {_r("CASE action WHEN 'accept' THEN 0.1::DOUBLE WHEN 'decline' THEN 7 WHEN 'wait' THEN LEAST(7, GREATEST(1, 7 - seller_urgency)) ELSE GREATEST(0.5, LEAST(7, (1 - p) * 7)) END", 2)} AS extra_days FROM v_eval""",
       "sale_probability expected_margin:9 extra_days")
def _(spark, sf):
    return C.evaluate_actions(snapshots(spark, sf), fee=0.125, digits=12).select("decision_id", "action", "amount", "sale_probability", "expected_margin", "violates_floor", "extra_days")


@query("recommend", """
SELECT decision_id, CASE WHEN reasons = '' THEN 'recommend' ELSE 'abstain' END AS status, reasons, comparables, CASE WHEN reasons = '' THEN best END AS action FROM (
  SELECT r.decision_id, COALESCE(c.comparables, 0) AS comparables, best, CONCAT_WS(',', CASE WHEN seller_cost_basis IS NULL THEN 'missing_seller_cost_basis' END, CASE WHEN traffic_age_hours > 24 THEN 'stale_traffic_data' END,
    CASE WHEN COALESCE(c.comparables, 0) < 30 THEN 'insufficient_comparable_mature_outcomes' END, CASE WHEN e1 IS NULL THEN 'no_viable_actions_above_floor' END,
    CASE WHEN round(e1 - e2, 6) < 5 THEN 'top_actions_too_close_for_confident_choice' END) AS reasons FROM (
    SELECT decision_id, decision_channel, category, seller_cost_basis, traffic_age_hours, MAX(CASE WHEN rn = 1 THEN em END) AS e1, MAX(CASE WHEN rn = 2 THEN em END) AS e2, MAX(CASE WHEN rn = 1 AND em IS NOT NULL THEN action END) AS best FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY decision_id ORDER BY em DESC NULLS LAST, action DESC) AS rn FROM (
        SELECT *, CASE WHEN NOT COALESCE(net < minimum_net_proceeds, FALSE) AND amount IS NOT NULL THEN round(p * (net - seller_cost_basis), 2)
                       WHEN action = 'decline' THEN NULL END AS em FROM v_eval) z) q GROUP BY 1, 2, 3, 4, 5) r
  LEFT JOIN v_compcat c ON c.decision_channel = r.decision_channel AND c.folded = lower(r.category)) t""")
def _(spark, sf):
    s = snapshots(spark, sf)
    return C.recommend(s, s, fee=0.125).select("decision_id", "status", "reasons", "comparables", "action")


# ---- lifecycle transactions: twelve paths, legal, out of order, duplicated, illegal

_PATHS = {
    0: "offer_submitted merchant_accepted checkout_created order_created paid mature",
    1: "offer_submitted merchant_countered buyer_accepted checkout_created payment_pending paid partially_refunded mature",
    2: "offer_submitted merchant_declined", 3: "offer_submitted merchant_countered buyer_countered merchant_accepted checkout_created checkout_expired",
    4: "paid offer_submitted merchant_accepted checkout_created", 5: "offer_submitted cancelled paid",
    6: "offer_submitted merchant_accepted checkout_created order_created paid return_opened return_closed mature",
    7: "offer_submitted mature", 8: "offer_submitted merchant_accepted paid", 9: "offer_submitted offer_expired merchant_accepted",
    10: "offer_submitted merchant_accepted checkout_created paid order_created paid fully_refunded", 11: "offer_submitted"}
_VALUES = ", ".join(f"({p}, {i}, '{t}')" for p, path in _PATHS.items() for i, t in enumerate(path.split()))
view("v_life", f"""
SELECT merchant_id AS merchant_namespace, offer_id AS transaction_id, CONCAT(offer_id, '-', CAST(s.seq AS STRING)) AS event_id, k, k * 10 + s.seq AS ordinal, s.seq, s.transition_to,
  d + INTERVAL '1' DAY * s.seq AS occurred_at, d + INTERVAL '1' DAY * s.seq + INTERVAL '1' HOUR AS received_at,
  CASE WHEN k % 37 = 0 AND s.seq = 2 THEN 'EUR' ELSE 'USD' END AS currency, k % 2 = 0 AS has_conversion,
  CASE WHEN s.seq = 0 THEN CONCAT('sku', CAST(k % 9 AS STRING)) END AS sku, CASE WHEN s.seq = 0 AND k % 17 <> 0 THEN CAST(k % 100 AS INTEGER) END AS inventory_age_days,
  CASE WHEN s.transition_to = 'offer_submitted' THEN CAST(asking * 100 AS BIGINT) END AS asking_price_minor, CASE WHEN s.transition_to = 'offer_submitted' AND k % 41 <> 0 THEN CAST(bid * 100 AS BIGINT) END AS buyer_offer_minor,
  CASE WHEN s.seq = 1 AND k % 3 = 0 THEN CAST(asking * 60 AS BIGINT) END AS merchant_floor_minor, CASE WHEN s.transition_to = 'paid' THEN CAST(bid * 100 AS BIGINT) + s.seq END AS final_sale_minor,
  CASE WHEN s.seq IN (0, 1) AND cost IS NOT NULL THEN CAST(cost * 100 AS BIGINT) + s.seq END AS cost_basis_minor, CASE WHEN s.transition_to = 'paid' AND k % 4 = 0 THEN CAST(700 AS BIGINT) END AS shipping_charged_minor,
  CASE WHEN s.seq = 2 THEN CAST(500 AS BIGINT) END AS shipping_cost_minor, CASE WHEN s.transition_to = 'checkout_created' AND k % 3 = 0 THEN CAST(300 AS BIGINT) END AS shipping_discount_minor,
  CASE WHEN s.transition_to = 'mature' AND k % 29 <> 0 THEN CAST(250 AS BIGINT) END AS fees_minor,
  CASE WHEN s.transition_to IN ('partially_refunded', 'fully_refunded') THEN CAST(1000 AS BIGINT) END AS refund_minor, CASE WHEN s.transition_to = 'mature' AND k % 5 = 0 THEN CAST(90 AS BIGINT) END AS return_loss_minor,
  CASE WHEN s.transition_to = 'mature' THEN CAST(bid * 100 AS BIGINT) - CAST(COALESCE(cost, 0) * 100 AS BIGINT) END AS margin_minor,
  CASE WHEN k % 43 = 0 THEN NULL ELSE 'done' END AS executed_action
FROM v_base b JOIN (VALUES {_VALUES}) AS s(path, seq, transition_to) ON s.path = b.k % 12""")


def life(spark, sf):
    e = fixture(spark, sf, "v_life")
    return e.withColumns({c: F.col(c).cast("timestamp") for c in ("occurred_at", "received_at")})


_EDGES = ", ".join(f"('{a}', '{b}')" for a, bs in L.TRANSITIONS.items() for b in bs)
_REACH = ", ".join(f"('{a}', '{b}')" for a in L.TRANSITIONS for b in L.reachable(a))
_WEB = ", ".join(f"'{s}'" for s in L.WEBHOOK_STATES)
def _fold(source: str) -> str:
    return f"""
WITH RECURSIVE edge(a, b) AS (VALUES {_EDGES}), reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
ev AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_namespace, transaction_id ORDER BY occurred_at, received_at, event_id) AS rn FROM {source}),
run AS (SELECT merchant_namespace, transaction_id, CAST(0 AS BIGINT) AS rn, '' AS state, CAST(NULL AS STRING) AS event_id, CAST(NULL AS STRING) AS transition_to, CAST(NULL AS STRING) AS outcome, '' AS before FROM (SELECT DISTINCT merchant_namespace, transaction_id FROM {source}) x
 UNION ALL SELECT r.merchant_namespace, r.transaction_id, ev.rn, CASE WHEN NOT (ev.currency = 'EUR' AND NOT ev.has_conversion) AND EXISTS (SELECT 1 FROM edge WHERE a = r.state AND b = ev.transition_to) THEN ev.transition_to ELSE r.state END,
   ev.event_id, ev.transition_to, CASE WHEN ev.currency = 'EUR' AND NOT ev.has_conversion THEN 'currency_mismatch' WHEN EXISTS (SELECT 1 FROM edge WHERE a = r.state AND b = ev.transition_to) THEN 'applied'
     WHEN EXISTS (SELECT 1 FROM reach WHERE a = r.state AND b = ev.transition_to) THEN CASE WHEN ev.transition_to IN ({_WEB}) THEN 'pending' ELSE 'missing_predecessor' END ELSE 'invalid_transition' END, r.state
 FROM run r JOIN ev ON ev.merchant_namespace = r.merchant_namespace AND ev.transaction_id = r.transaction_id AND ev.rn = r.rn + 1)
SELECT merchant_namespace, transaction_id, LAST_VALUE(state) OVER (PARTITION BY merchant_namespace, transaction_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_state,
  event_id, transition_to, outcome, before AS state, rn FROM run"""


view("v_fold", _fold("v_life"))


@query("replay_lifecycle", "SELECT merchant_namespace, transaction_id, current_state, event_id, transition_to, outcome, state FROM v_fold WHERE rn > 0")
def _(spark, sf):
    return L.replay_lifecycle(life(spark, sf))


view("v_states", """
SELECT merchant_namespace, transaction_id, MAX(current_state) AS current_state, COUNT(*) AS events, COUNT(*) FILTER (WHERE outcome = 'applied') AS applied,
  COUNT(*) FILTER (WHERE outcome = 'pending') AS pending, COUNT(*) FILTER (WHERE outcome NOT IN ('applied', 'pending')) AS errors FROM v_fold WHERE rn > 0 GROUP BY 1, 2""")


@query("transaction_states", "SELECT * FROM v_states")
def _(spark, sf):
    return L.transaction_states(L.replay_lifecycle(life(spark, sf)))


@query("pending_reason", f"""
WITH reach(a, b) AS (VALUES {_REACH})
SELECT x.state, x.transition_to, CASE WHEN EXISTS (SELECT 1 FROM reach WHERE a = x.state AND b = x.transition_to) THEN 'missing_predecessor' ELSE 'invalid_transition' END AS reason, COUNT(*) AS events
FROM v_fold x WHERE rn > 0 AND outcome NOT IN ('applied', 'currency_mismatch') GROUP BY ALL""")
def _(spark, sf):
    r = L.replay_lifecycle(life(spark, sf)).filter("outcome NOT IN ('applied', 'currency_mismatch')")
    return r.groupBy("state", "transition_to", L.pending_reason(F.col("state"), F.col("transition_to")).alias("reason")).agg(F.count(F.lit(1)).alias("events"))


@query("ingest", """
SELECT transaction_id AS idempotency_key, arg_min(body, ordinal) AS accepted_hash, COUNT(*) FILTER (WHERE body = first_body) - 1 AS replays, COUNT(*) FILTER (WHERE body <> first_body) AS conflicts FROM (
  SELECT *, FIRST_VALUE(body) OVER (PARTITION BY transaction_id ORDER BY ordinal) AS first_body FROM (SELECT transaction_id, ordinal, sha256(CASE WHEN seq % 3 = 2 THEN transition_to ELSE 'same' END) AS body FROM v_life) a) t GROUP BY 1""")
def _(spark, sf):
    e = life(spark, sf).withColumn("body_hash", F.sha2(F.when(F.col("seq") % 3 == 2, F.col("transition_to")).otherwise("same"), 256))
    return L.ingest(e.withColumnRenamed("transaction_id", "idempotency_key"), ["idempotency_key"], "body_hash", "ordinal")


view("v_new", "SELECT transaction_id, LEAST(MAX(seq), 1) AS seq FROM v_life GROUP BY 1")
view("v_old", "SELECT l.* FROM v_life l LEFT JOIN v_new n ON n.transaction_id = l.transaction_id AND n.seq = l.seq WHERE n.seq IS NULL")
view("v_before", _fold("v_old"))


@query("admit", """
WITH lost AS (SELECT b.transaction_id, COUNT(*) AS n FROM v_before b JOIN v_fold f ON f.event_id = b.event_id WHERE b.outcome = 'applied' AND f.outcome <> 'applied' GROUP BY 1)
SELECT f.merchant_namespace, f.transaction_id, f.event_id, f.outcome, COALESCE(lost.n, 0)::BIGINT AS invalidated, lost.n IS NULL AND f.outcome IN ('applied', 'pending') AS admitted
FROM v_fold f JOIN v_life l ON l.event_id = f.event_id JOIN v_new n ON n.transaction_id = l.transaction_id AND n.seq = l.seq LEFT JOIN lost ON lost.transaction_id = f.transaction_id""")
def _(spark, sf):
    """The second event of every transaction (the only one, if there is one) arrives late."""
    e = life(spark, sf)
    late = e.groupBy(*L.TX).agg(F.least(F.max("seq"), F.lit(1)).alias("_late"))
    # by the transaction alone, so that its events lie together for what follows
    placed = e.join(late, L.TX, "left")
    mine = F.coalesce(F.col("seq") == F.col("_late"), F.lit(False))
    return L.admit(placed.filter(~mine).drop("_late"), placed.filter(mine).drop("_late"))


@query("validate_lifecycle", """
SELECT event_id, CASE WHEN transition_to IN ('merchant_accepted', 'merchant_declined', 'merchant_countered', 'checkout_created', 'checkout_expired', 'cancelled') AND executed_action IS NULL THEN 'action_state_without_executed_action'
  WHEN transition_to = 'mature' AND fees_minor IS NULL THEN 'incomplete_mature_outcome' END AS violation FROM v_life
WHERE (transition_to IN ('merchant_accepted', 'merchant_declined', 'merchant_countered', 'checkout_created', 'checkout_expired', 'cancelled') AND executed_action IS NULL) OR (transition_to = 'mature' AND fees_minor IS NULL)""")
def _(spark, sf):
    return L.validate_lifecycle(life(spark, sf)).filter("violation IS NOT NULL").select("event_id", "violation")


def tx_of(spark, sf):
    e = life(spark, sf)
    return C.transactions(e, L.transaction_states(L.replay_lifecycle(e)))


_F = {"currency": "currency", "inventory_age_days": "inventory_age_days", "merchant_floor_minor": "merchant_floor_minor", "item_cost_minor": "cost_basis_minor"}


def _first(c: str, cond: str = "TRUE") -> str:
    return f"arg_min({c}, ordinal) FILTER (WHERE {c} IS NOT NULL AND {cond})"


view("v_tx", f"""
SELECT *, len(string_split(missing, ',')) = 1 AND missing = '' AS complete FROM (SELECT t.*, s.current_state, CONCAT_WS(',', CASE WHEN item_cost_minor IS NULL THEN 'item_cost_minor' END, CASE WHEN s.current_state = 'mature' AND revenue_minor IS NULL THEN 'gross_negotiated_revenue_minor' END,
  CASE WHEN s.current_state = 'mature' AND fees_minor IS NULL THEN 'platform_payment_fees_minor' END, CASE WHEN s.current_state = 'mature' AND margin_minor IS NULL THEN 'mature_contribution_margin_minor' END) AS missing
FROM (SELECT merchant_namespace, transaction_id, list_sort(list_distinct(list(transition_to))) AS transitions, {_first('currency')} AS currency, {_first('sku', "transition_to = 'offer_submitted'")} AS sku,
  {_first('inventory_age_days')} AS inventory_age_days, MAX(asking_price_minor) AS asking_price_minor, MAX(buyer_offer_minor) AS buyer_offer_minor, MAX(merchant_floor_minor) AS merchant_floor_minor,
  arg_max(final_sale_minor, ordinal) FILTER (WHERE transition_to = 'paid') AS revenue_minor, {_first('cost_basis_minor')} AS item_cost_minor,
  COALESCE(arg_max(shipping_charged_minor, ordinal) FILTER (WHERE transition_to = 'paid'), 0) AS shipping_charged_minor, COALESCE(MAX(shipping_cost_minor), 0) AS shipping_cost_minor,
  COALESCE(SUM(shipping_discount_minor), 0)::BIGINT AS free_shipping_minor, MAX(fees_minor) AS fees_minor, COALESCE(SUM(refund_minor), 0)::BIGINT AS refund_minor,
  COALESCE(MAX(return_loss_minor), 0) AS return_loss_minor, MAX(margin_minor) AS margin_minor FROM v_life GROUP BY 1, 2) t JOIN v_states s USING (merchant_namespace, transaction_id)) u""")


@query("financial_components", "SELECT * REPLACE (array_to_string(transitions, ',') AS transitions) FROM v_tx")
def _(spark, sf):
    return tx_of(spark, sf).withColumns({"transitions": F.array_join(F.array_sort("transitions"), ","), "missing": F.array_join("missing", ",")})


def _hs(*s: str) -> str:
    return "(" + " OR ".join(f"list_contains(transitions, '{x}')" for x in s) + ")"


@query("offer_funnel", "SELECT merchant_namespace, " + ", ".join(f"COUNT(*) FILTER (WHERE {_hs(*s)}) AS {n}" for n, s in C.FUNNEL.items()) + " FROM v_tx GROUP BY 1")
def _(spark, sf):
    return C.offer_funnel(tx_of(spark, sf))


@query("mature_margin_summary", "SELECT merchant_namespace, " + ", ".join(f"COALESCE(SUM({f}) FILTER (WHERE {_hs('mature')} AND complete), 0)::BIGINT AS {f}" for f in C.MARGIN_FIELDS) + f""",
 COUNT(*) FILTER (WHERE {_hs('mature')} AND complete) AS complete_mature, COUNT(*) FILTER (WHERE {_hs('mature')} AND NOT complete) AS excluded_mature,
 CASE WHEN COUNT(DISTINCT currency) FILTER (WHERE {_hs('mature')} AND complete) = 1 THEN MAX(currency) FILTER (WHERE {_hs('mature')} AND complete) END AS currency,
 COUNT(*) FILTER (WHERE {_hs('mature')} AND NOT complete) > 0 AS provisional FROM v_tx GROUP BY 1""")
def _(spark, sf):
    return C.mature_margin_summary(tx_of(spark, sf))


@query("margin_leakage", f"""
SELECT merchant_namespace, SUM(free_shipping_minor)::BIGINT AS free_shipping_minor, SUM(refund_minor + return_loss_minor)::BIGINT AS refunds_returns_minor,
 COUNT(*) FILTER (WHERE {_hs('merchant_accepted', 'buyer_accepted')} AND NOT {_hs('paid')}) AS unpaid_accepted_offers, COUNT(*) FILTER (WHERE {_hs('checkout_expired')}) AS expired_checkout_links,
 COUNT(*) FILTER (WHERE item_cost_minor IS NULL) AS missing_cost_basis, COUNT(*) FILTER (WHERE missing LIKE '%platform%') AS missing_fees, COUNT(*) FILTER (WHERE NOT {_hs('mature')}) AS immature_outcomes FROM v_tx GROUP BY 1""")
def _(spark, sf):
    return C.margin_leakage(tx_of(spark, sf))


_DIM = {"sku": "COALESCE(sku, 'unknown')", "age": "CASE WHEN inventory_age_days IS NULL THEN 'unknown' WHEN inventory_age_days < 15 THEN '0-14' WHEN inventory_age_days < 31 THEN '15-30' WHEN inventory_age_days < 61 THEN '31-60' WHEN inventory_age_days < 91 THEN '61-90' ELSE '91+' END",
        "ratio": "CASE WHEN buyer_offer_minor IS NULL OR COALESCE(asking_price_minor, 0) <= 0 THEN 'unknown' WHEN buyer_offer_minor / asking_price_minor < 0.5 THEN '<50%' WHEN buyer_offer_minor / asking_price_minor < 0.7 THEN '50-69%' WHEN buyer_offer_minor / asking_price_minor < 0.85 THEN '70-84%' WHEN buyer_offer_minor / asking_price_minor < 1 THEN '85-99%' ELSE '100%+' END"}


@query("breakdown", " UNION ALL ".join(f"SELECT '{d}' AS dimension, {e} AS bucket, COUNT(*) AS transactions, COUNT(*) FILTER (WHERE {_hs('mature')}) AS mature, COALESCE(SUM(margin_minor) FILTER (WHERE complete), 0)::BIGINT AS complete_margin_minor FROM v_tx GROUP BY 2" for d, e in _DIM.items()))
def _(spark, sf):
    return C.breakdown(tx_of(spark, sf))


@query("threshold_replay", """
SELECT merchant_namespace, transaction_id, a AS selected_action, CASE a WHEN 'accept' THEN buyer_offer_minor WHEN 'counter_at_amount' THEN round_even(buyer_offer_minor * (1 + 0.08::DOUBLE), 0)::BIGINT END AS amount_minor FROM (
  SELECT *, CASE WHEN asking_price_minor IS NULL OR buyer_offer_minor IS NULL THEN 'abstain_missing_offer_context' WHEN merchant_floor_minor IS NOT NULL AND buyer_offer_minor < merchant_floor_minor THEN 'decline'
    WHEN asking_price_minor > 0 AND buyer_offer_minor / asking_price_minor >= 0.85::DOUBLE THEN 'accept' ELSE 'counter_at_amount' END AS a FROM v_tx) t""")
def _(spark, sf):
    return C.threshold_replay(tx_of(spark, sf))

"""Money series, pilot datasets, logs of randomised and logged policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from haggle.operators import causal as X
from haggle.operators import money as Y
from haggle.operators import pilot as P
from haggle.operators.permutation import permutation_test
from haggle.plans.registry import fixture, query, view
from haggle.sources.tables import table

view("v_entry", """
SELECT CAST(o_orderkey AS STRING) AS decision_id, s.seq, o_orderdate AS decision_timestamp, o_orderpriority AS strategy_id, CONCAT('c', CAST(o_custkey % 3 AS STRING)) AS contract_hash,
  CASE o_orderstatus WHEN 'F' THEN NULL ELSE o_orderstatus END AS source_id, CASE WHEN o_orderkey % 6 = 0 THEN CONCAT('e', CAST(o_custkey % 50 AS STRING)) END AS economic_event_key,
  CASE WHEN o_orderkey % 5 = 0 THEN 'wait' ELSE 'buy' END AS selected_action, 'wait' AS no_action_alternative, 'paper' AS designation,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(FLOOR(o_totalprice) - 150000 + s.seq AS BIGINT) END AS realized_net_value, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(FLOOR(o_totalprice / 2) - 70000 AS BIGINT) END AS conservative_expected_net_value,
  CAST(o_orderkey % 100 AS BIGINT) AS capital_required, CAST(o_orderkey % 40 AS BIGINT) AS maximum_possible_loss,
  CASE WHEN s.seq = 0 THEN CASE WHEN o_orderkey % 31 = 0 THEN 'x' END ELSE CASE WHEN o_orderkey % 37 = 0 THEN 'x' ELSE CONCAT('h', CAST(o_orderkey AS STRING), '-0') END END AS supersedes_entry_hash,
  CONCAT('h', CAST(o_orderkey AS STRING), '-', CAST(s.seq AS STRING)) AS record_hash, CASE WHEN s.seq = 1 AND o_orderkey % 41 <> 0 THEN 'resolved_paper' ELSE 'paper_decision' END AS evidence_state,
  CAST(NULL AS STRING) AS correction_reason, CASE WHEN s.seq = 1 AND o_orderkey % 43 = 0 THEN 'f2' ELSE 'f1' END AS feature_program_hash
FROM orders JOIN (VALUES (0), (1)) AS s(seq) ON s.seq = 0 OR o_orderkey % 4 = 0""")


def entries(spark, sf):
    return fixture(spark, sf, "v_entry")


_COST = ["l_tax", "l_discount", "ship"]
view("v_costs", """SELECT CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id, l_extendedprice AS gross_value, l_tax, l_discount,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS ship, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity / 8 END AS uncertainty_adjustment FROM lineitem""")


@query("decision_accounting", """
SELECT id, gross_value::DECIMAL(18,2) AS gross, CASE WHEN ok THEN total END AS total_costs, CASE WHEN ok THEN (gross_value::DECIMAL(18,2) - total)::DECIMAL(18,2) END AS net_value,
  CASE WHEN ok THEN round((gross_value::DECIMAL(18,2) - total) - adj::DECIMAL(18,6), 2)::DECIMAL(18,2) END AS conservative_net, ok AS eligible, CASE WHEN ok THEN '' ELSE 'ship' END AS missing_material_costs FROM (
  SELECT *, ship IS NOT NULL AS ok, (round(l_tax::DECIMAL(18,6), 2) + round(l_discount::DECIMAL(18,6), 2) + COALESCE(round(ship::DECIMAL(18,6), 2), 0))::DECIMAL(18,2) AS total, COALESCE(uncertainty_adjustment, 0) AS adj FROM v_costs) t""")
def _(spark, sf):
    d = Y.decision_accounting(fixture(spark, sf, "v_costs"), _COST, ["ship"])
    return d.select("id", "gross", "total_costs", "net_value", "conservative_net", "eligible", F.array_join("missing_material_costs", ",").alias("missing_material_costs"))


view("v_eff", """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ek ORDER BY decision_timestamp DESC, decision_id DESC) AS r2 FROM (
  SELECT *, COALESCE(economic_event_key, decision_id) AS ek, COALESCE(realized_net_value, conservative_expected_net_value, 0) AS val FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY decision_id ORDER BY seq DESC) AS r1 FROM v_entry) a WHERE r1 = 1) b) c WHERE r2 = 1""")
_AGG = "COUNT(*) AS opportunities, COUNT(*) FILTER (WHERE selected_action = no_action_alternative) AS no_action, SUM(val)::DECIMAL(18,2) AS value, SUM(capital_required)::DECIMAL(18,2) AS capital_at_risk, SUM(maximum_possible_loss)::DECIMAL(18,2) AS maximum_possible_loss, MIN(designation) AS designation"


@query("money_summary", f"SELECT 'all' AS dimension, 'all' AS key, {_AGG} FROM v_eff" + "".join(
    f" UNION ALL SELECT '{d}', COALESCE({c}, 'unknown'), {_AGG} FROM v_eff GROUP BY 2" for d, c in (("contract", "contract_hash"), ("strategy", "strategy_id"), ("source", "source_id"))))
def _(spark, sf):
    return Y.money_summary(entries(spark, sf))


_DD = """WITH c AS (SELECT {k} AS key, SUM(v) OVER (PARTITION BY {k} ORDER BY o_orderdate, o_orderkey) AS cum, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY o_orderdate, o_orderkey) - 1 AS pos
  FROM (SELECT *, CAST(FLOOR(o_totalprice) - 150000 AS BIGINT) AS v FROM orders) o),
p AS (SELECT *, MAX(cum) OVER (PARTITION BY key ORDER BY pos) AS peak FROM c), b AS (SELECT key, peak - cum AS dd, peak, pos, ROW_NUMBER() OVER (PARTITION BY key ORDER BY peak - cum DESC, pos) AS r FROM p)
SELECT {out}b.dd::BIGINT AS maximum_drawdown, b.pos AS trough_index, MIN(p.pos) AS peak_index FROM b JOIN p ON p.key = b.key AND p.cum = b.peak AND p.pos <= b.pos WHERE b.r = 1 GROUP BY b.key, b.dd, b.pos"""


def series(spark, sf):
    return table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_orderpriority", (F.floor("o_totalprice") - 150000).cast("long").alias("v"))


@query("max_drawdown", _DD.format(k="o_orderpriority", out="b.key AS o_orderpriority, "))
def _(spark, sf):
    return Y.max_drawdown(series(spark, sf), ["o_orderdate", "o_orderkey"], "v", ["o_orderpriority"])


@query("global_drawdown", _DD.format(k="1", out=""))
def _(spark, sf):
    return Y.global_drawdown(series(spark, sf), ["o_orderdate", "o_orderkey"], "v")


@query("supersession_check", """
SELECT decision_id, seq, CASE WHEN seq = 0 THEN 'first_entry_supersedes' WHEN supersedes_entry_hash = 'x' THEN 'not_linked_to_latest' WHEN feature_program_hash = 'f2' THEN 'immutable_field_rewritten' ELSE 'same_state_without_reason' END AS violation
FROM v_entry WHERE (seq = 0 AND supersedes_entry_hash IS NOT NULL) OR (seq = 1 AND (supersedes_entry_hash = 'x' OR feature_program_hash = 'f2' OR evidence_state = 'paper_decision'))""")
def _(spark, sf):
    v = Y.supersession_check(entries(spark, sf), ["contract_hash", "feature_program_hash"])
    return v.filter("violation IS NOT NULL").select("decision_id", "seq", "violation")


@query("verify_chain", """
SELECT CAST(l_orderkey AS STRING) AS ledger, n AS seq, CASE WHEN l_orderkey % 50 = 0 THEN 'record_hash_mismatch' ELSE 'previous_hash_mismatch' END AS violation FROM (
  SELECT l_orderkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) t
WHERE (l_orderkey % 50 = 0 AND n = 3) OR (l_orderkey % 50 = 1 AND n = 3)""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<struct<payload:string,previous_hash:string,record_hash:string>>").alias("out"))

    def link(a, x):
        body = F.concat_ws(",", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))
        h = Y.chain_hash(a["h"], body)
        return F.struct(h.alias("h"), F.concat(a["out"], F.array(F.struct(body.alias("payload"), a["h"].alias("previous_hash"), h.alias("record_hash")))).alias("out"))

    # the test log: one chain per order, a handful of records each
    logs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("a")).select(
        "l_orderkey", F.posexplode(F.aggregate("a", start, link)["out"]).alias("p", "r")).select(
        F.col("l_orderkey").cast("string").alias("ledger"), F.col("l_orderkey").alias("k"), (F.col("p") + 1).cast("long").alias("seq"), "r.*")
    bad = logs.withColumn("payload", F.when((F.col("k") % 50 == 0) & (F.col("seq") == 3), "tampered").otherwise(F.col("payload")))
    bad = bad.filter(~((F.col("k") % 50 == 1) & (F.col("seq") == 2)))
    return Y.verify_chain(bad.drop("k"), ["ledger"]).select("ledger", "seq", "violation")


@query("validate_contracts", """
SELECT contract_id, CASE WHEN p_size % 5 = 0 THEN 'unknown_action_mode' WHEN p_size % 7 = 0 THEN 'negative_amount' ELSE 'no_action_missing' END AS violation
FROM (SELECT CAST(p_partkey AS STRING) AS contract_id, p_size FROM part) t WHERE p_size % 5 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0""")
def _(spark, sf):
    s = F.col("p_size")
    act = lambda i, m, c: F.struct(i.alias("action_id"), m.alias("mode"), c.alias("capital_required"), F.lit(0.0).alias("fixed_costs"))
    d = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("contract_id"), F.lit("none").alias("no_action_alternative"),
        F.array(act(F.lit("buy"), F.when(s % 5 == 0, "odd").otherwise("reactive"), F.when(s % 7 == 0, -1.0).otherwise(1.0)),
                act(F.when(s % 11 == 0, "sell").otherwise("none"), F.lit("interventional"), F.lit(0.0))).alias("available_actions"))
    return Y.validate_contracts(d).filter("violation IS NOT NULL").select("contract_id", "violation")


# ---- pilot: ten datasets cut from orders, lines and parts

AS_OF = "1998-01-01 00:00:00"
view("v_porder", """
SELECT CAST(o_orderkey AS STRING) AS order_id, CONCAT(CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 5 AS STRING)) AS listing_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CONCAT('o', CAST(o_orderkey AS STRING)) END AS offer_id,
  o_orderkey AS ordinal, CASE WHEN o_orderkey % 9 = 0 THEN 'pending' WHEN o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderstatus = 'P' THEN 'Shipped' ELSE 'completed' END AS order_status, CAST(NULL AS TIMESTAMP) AS paid_at, CAST(NULL AS TIMESTAMP) AS completed_at, CAST(FLOOR(o_totalprice / 100) AS DOUBLE) AS sale_price, CAST(1 + o_orderkey % 2 AS INTEGER) AS quantity,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '300' DAY END AS return_window_matured_at FROM orders""")
view("v_poffer", """
SELECT CONCAT('o', CAST(o_orderkey AS STRING)) AS offer_id, CONCAT(CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 5 AS STRING)) AS listing_id, o_orderkey AS ordinal, o_orderdate AS event_time,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 50) END AS response_time,
  CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'counter' WHEN 2 THEN 'declined' WHEN 3 THEN NULL ELSE 'ACCEPT' END AS seller_response FROM orders""")
view("v_pfee", "SELECT CAST(l_orderkey AS STRING) AS order_id, l_quantity AS fee_amount FROM lineitem WHERE l_linenumber <= 2")
view("v_pship", "SELECT CAST(l_orderkey AS STRING) AS order_id, l_quantity / 4 AS shipping_amount FROM lineitem WHERE l_linenumber >= 2")
view("v_pret", "SELECT CAST(l_orderkey AS STRING) AS order_id, l_quantity / 2 AS refund_amount, l_shipdate + INTERVAL '60' DAY AS return_window_matured_at FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1")
view("v_plist", """SELECT DISTINCT CONCAT(CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 5 AS STRING)) AS listing_id, CONCAT('cat', CAST(o_custkey % 6 AS STRING)) AS category, CAST(1000 + o_custkey % 300 AS DOUBLE) AS asking_price,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 250 AS INTEGER) END AS age_days FROM orders""")
view("v_pcost", """SELECT CONCAT(CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 5 AS STRING)) AS listing_id, o_orderdate AS available_at, o_orderkey AS ordinal, CAST(FLOOR(o_totalprice / 300) AS DOUBLE) AS cost FROM orders WHERE o_orderpriority <> '1-URGENT'""")


def pilot(spark, sf):
    names = {"orders": "v_porder", "offers": "v_poffer", "fees": "v_pfee", "shipping": "v_pship", "returns": "v_pret", "listings": "v_plist", "cost_basis": "v_pcost"}
    out = {k: fixture(spark, sf, v) for k, v in names.items()}
    return {k: d.withColumns({c: F.col(c).cast("timestamp") for c, t in d.dtypes if t == "timestamp_ntz"}) for k, d in out.items()}


view("v_pcosts", """
SELECT o.*, f.fee, s.shipping, r.refund, r.ends, c.cost FROM v_porder o LEFT JOIN (SELECT order_id, SUM(fee_amount) AS fee FROM v_pfee GROUP BY 1) f ON f.order_id = o.order_id
LEFT JOIN (SELECT order_id, SUM(shipping_amount) AS shipping FROM v_pship GROUP BY 1) s ON s.order_id = o.order_id LEFT JOIN (SELECT order_id, SUM(refund_amount) AS refund, MIN(return_window_matured_at) AS ends FROM v_pret GROUP BY 1) r ON r.order_id = o.order_id
LEFT JOIN (SELECT listing_id, arg_max(cost, (available_at, ordinal)) AS cost FROM v_pcost GROUP BY 1) c ON c.listing_id = o.listing_id""")
view("v_pflag", f"SELECT *, order_status IN ('Shipped', 'completed') AS buyer_paid, order_status = 'completed' AS order_completed, COALESCE(return_window_matured_at <= TIMESTAMP '{AS_OF}', FALSE) OR COALESCE(ends <= TIMESTAMP '{AS_OF}', FALSE) AS return_matured FROM v_pcosts")


@query("order_costs", "SELECT order_id, fee, shipping, refund, cost FROM v_pcosts", "fee shipping refund cost")
def _(spark, sf):
    return P.order_costs(pilot(spark, sf)).select("order_id", "fee", "shipping", "refund", "cost")


view("v_plink", """SELECT f.*, COALESCE(a.order_id, b.order_id) AS order_id FROM v_poffer f LEFT JOIN v_porder a ON a.offer_id = f.offer_id
LEFT JOIN (SELECT listing_id, MIN(order_id) AS order_id FROM v_porder GROUP BY 1 HAVING COUNT(*) = 1) b ON b.listing_id = f.listing_id""")


@query("link_orders", "SELECT offer_id, order_id FROM v_plink")
def _(spark, sf):
    p = pilot(spark, sf)
    return P.link_orders(p["offers"], p["orders"]).select("offer_id", "order_id")


view("v_pmargin", """SELECT m.order_id, m.listing_id, m.offer_id, COALESCE(l.category, 'unknown') AS category, CASE WHEN l.age_days IS NULL THEN 'unknown' WHEN l.age_days < 30 THEN '0_to_29_days' WHEN l.age_days < 90 THEN '30_to_89_days' WHEN l.age_days < 180 THEN '90_to_179_days' ELSE '180_plus_days' END AS inventory_age_bucket,
  CAST(round(CAST(sale_price / asking_price AS DECIMAL(28,8)), 4) AS DOUBLE) AS realized_to_asking_ratio, CAST(round(CAST(sale_price - fee - shipping - COALESCE(refund, 0) - cost * quantity AS DECIMAL(28,8)), 2) AS DOUBLE) AS margin
FROM v_pflag m LEFT JOIN v_plist l ON l.listing_id = m.listing_id WHERE buyer_paid AND order_completed AND return_matured AND cost IS NOT NULL AND fee IS NOT NULL AND shipping IS NOT NULL""")


@query("pilot_margin_rows", "SELECT * FROM v_pmargin", "realized_to_asking_ratio margin")
def _(spark, sf):
    return P.margin_rows(pilot(spark, sf), AS_OF)


@query("margin_breakdown", " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS key, COUNT(*) AS orders, CAST(round(CAST(SUM(margin) AS DECIMAL(28,8)), 2) AS DOUBLE) AS total, CAST(round(CAST(AVG(margin) AS DECIMAL(28,8)), 4) AS DOUBLE) AS average FROM v_pmargin GROUP BY 2"
                                              for d, c in (("category", "category"), ("inventory_age", "inventory_age_bucket"))), "total average")
def _(spark, sf):
    return P.margin_breakdown(P.margin_rows(pilot(spark, sf), AS_OF))


@query("pilot_audit", """
SELECT f.*, m.*, g.orders, g.no_cost, w.*, round(accepted / offers, 4) AS acceptance_rate, round((g.orders - no_cost) / g.orders, 4) AS cost_coverage FROM
(SELECT COUNT(*) AS offers, COUNT(*) FILTER (WHERE lower(seller_response) IN ('accept', 'accepted')) AS accepted, COUNT(*) FILTER (WHERE buyer_paid) AS paid, COUNT(*) FILTER (WHERE order_completed) AS completed, COUNT(*) FILTER (WHERE return_matured) AS return_matured,
  AVG(h) AS latency_mean, MEDIAN(h) AS latency_median FROM (SELECT l.*, o.buyer_paid, o.order_completed, o.return_matured, (epoch_us(response_time) - epoch_us(event_time)) / 3.6e9 AS h FROM v_plink l LEFT JOIN v_pflag o ON o.order_id = l.order_id) x) f,
(SELECT COUNT(*) AS mature_orders, SUM(margin) AS margin_total, AVG(margin) AS margin_mean, AVG(realized_to_asking_ratio) AS price_ratio FROM v_pmargin) m,
(SELECT COUNT(*) AS orders, COUNT(DISTINCT CASE WHEN cost IS NULL THEN listing_id END) AS no_cost FROM v_pcosts) g, (SELECT round(COUNT(*) FILTER (WHERE return_matured) / COUNT(*), 4) AS return_coverage FROM v_pflag WHERE order_completed) w""",
       "latency_mean latency_median margin_total:4 margin_mean price_ratio acceptance_rate cost_coverage return_coverage")
def _(spark, sf):
    return P.pilot_audit(pilot(spark, sf), AS_OF).select("offers", "accepted", "paid", "completed", "return_matured", "latency_mean", "latency_median", "mature_orders", "margin_total", "margin_mean",
                                                         "price_ratio", "orders", "no_cost", "acceptance_rate", "cost_coverage", "return_coverage")


view("v_pdec", """SELECT m.*, CASE WHEN lower(r) IN ('accept', 'accepted') THEN 'accepted' WHEN r = 'declined' THEN 'declined' WHEN r = 'counter' THEN 'countered' ELSE 'unknown' END AS decision_type FROM (
  SELECT m.*, COALESCE(a.seller_response, b.seller_response) AS r FROM v_pmargin m LEFT JOIN v_poffer a ON a.offer_id = m.offer_id LEFT JOIN (SELECT listing_id, MIN(seller_response) AS seller_response FROM v_poffer GROUP BY 1 HAVING COUNT(*) = 1) b ON b.listing_id = m.listing_id) m""")


@query("decision_margins", """SELECT decision_type, COUNT(*) AS mature_outcomes, AVG(margin) AS mean, MEDIAN(margin) AS median, SUM(margin) AS total, COUNT(*) FILTER (WHERE margin < 0) AS negative,
  AVG(margin) - 1.96 * stddev_samp(margin) / SQRT(COUNT(*)) AS low, AVG(margin) + 1.96 * stddev_samp(margin) / SQRT(COUNT(*)) AS high FROM v_pdec GROUP BY 1""", "mean median total:4 low high")
def _(spark, sf):
    return P.decision_margins(pilot(spark, sf), AS_OF)


@query("counterexamples", "SELECT sha256(order_id) AS order_id_hash, decision_type, category, margin, 'negative_margin' AS reason FROM v_pdec WHERE margin < 0 ORDER BY margin, order_id LIMIT 5", "margin")
def _(spark, sf):
    return P.counterexamples(pilot(spark, sf), AS_OF)


@query("latest_import", """
SELECT o_orderkey, pilot_id, import_id FROM (SELECT o_orderkey, 'p' || (o_custkey % 7) AS pilot_id, 'i' || (o_orderkey % 4) AS import_id FROM orders) t
WHERE import_id = CASE WHEN substr(pilot_id, 2)::INTEGER % 2 = 0 THEN 'i1' ELSE 'i3' END""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # in even pilots the imports 1, 2 and 3 carry the same content
    content = F.when((c % 7) % 2 == 0, F.when(k % 4 == 0, "a").otherwise("b")).otherwise((k % 4).cast("string"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("p"), (c % 7).cast("string")).alias("pilot_id"), F.concat(F.lit("i"), (k % 4).cast("string")).alias("import_id"),
                                             (k % 4).alias("import_seq"), content.alias("content_hash"))
    return P.latest_import(rows).select("o_orderkey", "pilot_id", "import_id")


# ---- logged and randomised policies over the event table

view("v_log", """SELECT e.event_id, e.event_type AS action, COALESCE(e.value, 0) AS reward, CASE WHEN e.event_id % 50 = 0 THEN 0.0 ELSE s.p END AS propensity FROM events e JOIN (
  SELECT g, event_type, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY g) AS p FROM (SELECT user_id % 4 AS g, event_type FROM events) x GROUP BY g, event_type) s ON s.g = e.user_id % 4 AND s.event_type = e.event_type""")
_POLICY = {"view": 0.5, "click": 0.3, "purchase": 0.15, "share": 0.05}


def logs(spark, sf):
    ev = table(spark, sf, "events").withColumn("g", F.col("user_id") % 4)
    per = ev.groupBy("g", "event_type").agg(F.count(F.lit(1)).alias("n"))
    tot = ev.groupBy("g").agg(F.count(F.lit(1)).alias("t"))
    share = per.join(tot, "g").select("g", "event_type", (F.col("n") / F.col("t")).alias("p"))
    return ev.join(share, ["g", "event_type"]).select("event_id", F.col("event_type").alias("action"), F.coalesce("value", F.lit(0.0)).alias("reward"),
                                                      F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("p")).alias("propensity"))


def _ope_sql() -> str:
    pol = "CASE action " + " ".join(f"WHEN '{a}' THEN {p}::DOUBLE" for a, p in _POLICY.items()) + " ELSE 0 END"
    dm = " + ".join(f"{p}::DOUBLE * COALESCE((SELECT AVG(reward) FROM v_log WHERE action = '{a}'), 0)" for a, p in _POLICY.items())
    base = f"""WITH m AS (SELECT action AS a, AVG(reward) AS m FROM v_log GROUP BY 1), r AS (SELECT reward, {pol} AS t, propensity, CASE WHEN {pol} > 0 AND propensity > 0 THEN {pol} / propensity ELSE 0 END AS w, {dm} AS dm, m.m FROM v_log JOIN m ON m.a = action),
 z AS (SELECT *, LEAST(w, 10) AS wc, CASE WHEN t <= 0 THEN dm WHEN propensity > 0 THEN dm + w * (reward - m) END AS dr FROM r), k AS (SELECT COUNT(*) FILTER (WHERE t > 0 AND propensity <= 0) AS lost FROM z)"""

    def one(name, v, s, n, ess, bad):
        half = f"1.96 * {s} / SQRT({n})"
        return f"SELECT '{name}' AS estimator, {v} AS value, {ess} AS effective_sample_size, {bad} AS support_violations, {v} - COALESCE({half}, 0) AS low, {v} + COALESCE({half}, 0) AS high, ABS({v} - AVG(reward)) / ABS(AVG(reward)) AS relative_error FROM z"

    e, ec, lost = "pow(SUM(w), 2) / SUM(w * w)", "pow(SUM(wc), 2) / SUM(wc * wc)", "(SELECT lost FROM k) + 1"
    rows = [one("direct_method", "AVG(dm)", "stddev_samp(dm)", "COUNT(*)", "NULL::DOUBLE", "1::BIGINT"), one("ips", "AVG(w * reward)", "stddev_samp(w * reward)", "COUNT(*)", e, lost),
            one("self_normalized_ips", "SUM(w * reward) / SUM(w)", "(stddev_samp(w * reward) / AVG(w))", "COUNT(*)", e, lost), one("doubly_robust", "AVG(dr)", "stddev_samp(dr)", "COUNT(dr)", e, lost),
            one("switch_ips", "AVG(wc * reward)", "stddev_samp(wc * reward)", "COUNT(*)", ec, lost)]
    return base + " ".join(["", " UNION ALL ".join(rows)])


@query("ope", _ope_sql(), "value effective_sample_size low high relative_error")
def _(spark, sf):
    policy = F.create_map(*[x for a, p in _POLICY.items() for x in (F.lit(a), F.lit(p))])
    return X.ope(logs(spark, sf), policy)


@query("unlogged_actions", "SELECT 'share' AS action WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'share')")
def _(spark, sf):
    return X.unlogged_actions(logs(spark, sf), spark.createDataFrame(list(_POLICY.items()), "action string, probability double"))


view("v_trial", """SELECT event_id, user_id % 2 AS treated, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS outcome, user_id % 3 AS block, CASE WHEN user_id % 3 = 0 THEN 0.5 ELSE CASE WHEN user_id % 5 = 0 THEN 0.4 ELSE 0.6 END END::DOUBLE AS p, event_id % 90 = 0 AS bad FROM events""")


def trials(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select("event_id", (u % 2).alias("treated"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("outcome"), (u % 3).alias("block"),
                                             F.when(u % 3 == 0, 0.5).when(u % 5 == 0, 0.4).otherwise(0.6).alias("probability"), (F.col("event_id") % 90 == 0).alias("nonadherent"))


@query("uplift", """SELECT *, ate - 1.96 * standard_error AS low, ate + 1.96 * standard_error AS high FROM (SELECT COUNT(*) FILTER (WHERE treated = 1) AS treatment_count, COUNT(*) FILTER (WHERE treated = 0) AS control_count, AVG(outcome) FILTER (WHERE treated = 1) AS treatment_rate,
  AVG(outcome) FILTER (WHERE treated = 0) AS control_rate, AVG(outcome) FILTER (WHERE treated = 1) - AVG(outcome) FILTER (WHERE treated = 0) AS ate,
  SQRT(var_samp(outcome) FILTER (WHERE treated = 1) / COUNT(*) FILTER (WHERE treated = 1) + var_samp(outcome) FILTER (WHERE treated = 0) / COUNT(*) FILTER (WHERE treated = 0)) AS standard_error FROM v_trial) t""",
       "treatment_rate control_rate ate standard_error low high")
def _(spark, sf):
    return X.uplift(trials(spark, sf), "treated", "outcome")


@query("permutation_test")
def _(spark, sf):
    return permutation_test(trials(spark, sf), "treated", "outcome")


def _arms_sql(scope: str, where: str, varying: bool) -> str:
    m = "SUM(w * outcome) FILTER (WHERE treated = {0}) / SUM(w) FILTER (WHERE treated = {0})" if varying else "AVG(outcome) FILTER (WHERE treated = {0})"
    mt, mc = m.format(1), m.format(0)
    if varying:
        se = f"SQRT((SELECT SUM(w * w * pow(outcome - (SELECT {mt} FROM {{s}}), 2)) FILTER (WHERE treated = 1) / pow(SUM(w) FILTER (WHERE treated = 1), 2) + SUM(w * w * pow(outcome - (SELECT {mc} FROM {{s}}), 2)) FILTER (WHERE treated = 0) / pow(SUM(w) FILTER (WHERE treated = 0), 2) FROM {{s}}))"
        mid = f"({mt} - {mc})"
    else:
        r = "((SUM(outcome) FILTER (WHERE treated = {0}) + 1) / (COUNT(*) FILTER (WHERE treated = {0}) + 2))"
        n = "(COUNT(*) FILTER (WHERE treated = {0}) + 2)"
        se = f"SQRT({r.format(1)} * (1 - {r.format(1)}) / {n.format(1)} + {r.format(0)} * (1 - {r.format(0)}) / {n.format(0)})"
        mid = f"({r.format(1)} - {r.format(0)})"
    src = f"(SELECT *, CASE WHEN treated = 1 THEN 1 / p ELSE 1 / (1 - p) END AS w FROM v_trial {where}) s"
    se = se.replace("{s}", src)
    est = "hajek_inverse_probability_weighted" if varying else "unweighted_randomized_difference_in_means"
    return f"""SELECT '{scope}' AS scope, COUNT(*) FILTER (WHERE treated = 1) AS treatment_n, COUNT(*) FILTER (WHERE treated = 0) AS comparator_n, {mt} AS treatment_mean, {mc} AS comparator_mean, {mt} - {mc} AS difference, {se} AS standard_error,
      GREATEST(-1, {mid} - 1.96 * {se}) AS low, LEAST(1, {mid} + 1.96 * {se}) AS high, '{est}' AS estimator, COUNT(*) FILTER (WHERE bad) AS nonadherent FROM {src}"""


@query("compare_arms", " UNION ALL ".join([_arms_sql("all", "", True), _arms_sql("block=0", "WHERE block = 0", False), _arms_sql("block=1", "WHERE block = 1", True), _arms_sql("block=2", "WHERE block = 2", True)]),
       "treatment_mean comparator_mean difference standard_error low high")
def _(spark, sf):
    return X.compare_arms(trials(spark, sf))


view("v_unit", """SELECT 'x' || (user_id % 3) AS experiment_id, CAST(event_id AS STRING) AS offer_id, ts AS opened_at, ts + INTERVAL 1 HOUR AS assigned_at, event_type = 'purchase' AS decided, event_id % 17 = 0 AS exposed FROM events""")
view("v_assign", """SELECT *, CASE WHEN draw < 0.4::DOUBLE THEN 'treatment' ELSE 'control' END AS assigned_arm FROM (SELECT experiment_id, offer_id, ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY assigned_at, offer_id) - 1 AS assignment_index,
  ('0x' || substr(sha256(concat_ws('|', experiment_id, offer_id, 'h' || substr(experiment_id, 2))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE AS draw
  FROM v_unit WHERE NOT decided AND NOT exposed AND assigned_at >= TIMESTAMP '2024-01-05 00:00:00') t WHERE assignment_index < 1500""")


def assigned(spark, sf):
    u = table(spark, sf, "events").select(
        F.concat(F.lit("x"), (F.col("user_id") % 3).cast("string")).alias("experiment_id"), F.col("event_id").cast("string").alias("offer_id"), F.col("ts").cast("timestamp").alias("opened_at"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL '1' HOUR")).alias("assigned_at"), (F.col("event_type") == "purchase").alias("decided"), F.lit(False).alias("matured"), (F.col("event_id") % 17 == 0).alias("exposed"))
    e = u.select("experiment_id").distinct().withColumns({
        "created_at": F.lit("2024-01-05 00:00:00").cast("timestamp"), "planned_units": F.lit(1500), "probability": F.lit(0.4), "preregistration_hash": F.concat(F.lit("h"), F.substring("experiment_id", 2, 9))})
    return X.assign(u, e)


@query("assign", "SELECT experiment_id, offer_id, assignment_index, draw, assigned_arm FROM v_assign", "draw")
def _(spark, sf):
    return assigned(spark, sf).select("experiment_id", "offer_id", "assignment_index", "draw", "assigned_arm")


_REP = """COUNT(*) FILTER (WHERE assigned_arm = 'treatment') AS treatment_n, COUNT(*) FILTER (WHERE assigned_arm = 'control') AS control_n, COUNT(v) AS observed, AVG(v) FILTER (WHERE assigned_arm = 'treatment') AS treatment_mean,
  AVG(v) FILTER (WHERE assigned_arm = 'control') AS control_mean, COUNT(*) - COUNT(v) AS missing, CAST(round(CAST(AVG(v) FILTER (WHERE assigned_arm = 'treatment') - AVG(v) FILTER (WHERE assigned_arm = 'control') AS DECIMAL(28,8)), 4) AS DOUBLE) AS difference"""


@query("experiment_report", f"""WITH a AS (SELECT s.*, CASE WHEN e.event_id % 4 <> 0 THEN e.value END AS v FROM v_assign s JOIN events e ON CAST(e.event_id AS STRING) = s.offer_id)
SELECT 'all' AS scope, {_REP} FROM a UNION ALL SELECT 'block=' || experiment_id, {_REP} FROM a GROUP BY 1""", "treatment_mean control_mean difference")
def _(spark, sf):
    a = assigned(spark, sf).select(F.col("offer_id").alias("assignment_id"), "assigned_arm", F.col("experiment_id").alias("block"))
    o = table(spark, sf, "events").filter("event_id % 4 <> 0").select(F.col("event_id").cast("string").alias("assignment_id"), "value", F.col("event_id").alias("ordinal"))
    return X.experiment_report(a, o)


@query("propose", """
SELECT context_id, task_size_large, fatigue, separation, separation - 0.1 * CASE WHEN task_size_large > 0 THEN 0.2 ELSE 0.1 END - 0.1 * 0.05 - 0.1 * (0.15 + 0.1 * fatigue) AS utility FROM (
  SELECT user_id AS context_id, user_id % 2 AS task_size_large, (user_id % 5)::DOUBLE AS fatigue, GREATEST(MAX(a) - MIN(a), MAX(b) - MIN(b), MAX(a - b) - MIN(a - b)) AS separation FROM (
    SELECT user_id, (event_id % 97) / 97.0::DOUBLE AS a, (event_id % 89) / 89.0::DOUBLE AS b FROM events) x GROUP BY 1) t ORDER BY utility DESC, context_id LIMIT 1""", "separation utility")
def _(spark, sf):
    p = table(spark, sf, "events").select(F.col("user_id").alias("context_id"), (F.col("user_id") % 2).alias("task_size_large"), (F.col("user_id") % 5).cast("double").alias("fatigue"),
                                          (F.col("event_id") % 97 / 97.0).alias("p_treatment"), (F.col("event_id") % 89 / 89.0).alias("p_comparator"))
    return X.propose(p)


@query("trial_integrity", """
SELECT CAST(event_id AS STRING) AS assignment_id, 'assignment_missing' AS violation, 1::BIGINT AS rows FROM events WHERE user_id % 10 = 9
UNION ALL SELECT CAST(event_id AS STRING), 'assignment_field_mismatch', 1 FROM events WHERE user_id % 10 <> 9 AND event_id % 8 = 0
UNION ALL SELECT CAST(event_id AS STRING), 'outcome_before_assignment', 1 FROM events WHERE user_id % 10 <> 9 AND event_id % 9 = 0
UNION ALL SELECT CAST(event_id AS STRING), 'preregistration_missing', 1 FROM events WHERE user_id % 10 <> 9 AND user_id % 4 = 3
UNION ALL SELECT CAST(event_id AS STRING), 'target_missing', 1 FROM events WHERE user_id % 10 <> 9 AND user_id % 4 <> 3 AND event_type = 'error'""")
def _(spark, sf):
    ev = table(spark, sf, "events").withColumns({"id": F.col("event_id").cast("string"), "t": F.col("ts").cast("timestamp")})
    pr = F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))
    a = ev.filter("user_id % 10 <> 9").select(F.col("id").alias("assignment_id"), F.lit("a").alias("assigned_treatment"), pr.alias("preregistration_id"), F.col("t").alias("assigned_at"))
    p = ev.select((F.col("user_id") % 4).alias("g")).distinct().filter("g < 3").select(F.concat(F.lit("p"), F.col("g").cast("string")).alias("preregistration_id"), F.lit("sold").alias("target"))
    late = F.when(F.col("event_id") % 9 == 0, F.col("t") - F.expr("INTERVAL '1' DAY")).otherwise(F.col("t"))
    t = ev.select(F.col("id").alias("assignment_id"), F.when(F.col("event_id") % 8 == 0, "b").otherwise("a").alias("assigned_treatment"), late.alias("recorded_at"),
                  F.create_map(F.when(F.col("event_type") == "error", "other").otherwise("sold"), F.lit(1.0)).alias("outcomes"))
    return X.trial_integrity(p, a, t)


@query("validate_experiments", """
SELECT CAST(p_partkey AS STRING) AS experiment_id, CASE WHEN p_size % 5 = 0 THEN 'probability_out_of_range' WHEN p_size % 7 = 0 THEN 'arms_equal' ELSE 'no_planned_units' END AS violation FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0""")
def _(spark, sf):
    s = F.col("p_size")
    d = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("experiment_id"), F.when(s % 5 == 0, 1.0).otherwise(0.5).alias("probability"), F.lit("a").alias("treatment"),
                                        F.when(s % 7 == 0, "a").otherwise("b").alias("control"), F.when(s % 11 == 0, 0).otherwise(10).alias("planned_units"), F.lit("margin").alias("primary_outcome"), F.lit(0.0).alias("margin_floor"))
    return X.validate_experiments(d).filter("violation IS NOT NULL").select("experiment_id", "violation")


@query("replay_bids")
def _(spark, sf):
    log = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("campaign_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("auction_id"),
                                              F.col("l_quantity").alias("value"), (F.col("l_discount") * 400).alias("price")).filter("price > 0")
    return X.replay_bids(log, {"fixed_policy": X.linear_bid(0.6), "conservative_policy": X.linear_bid(0.45), "learned_policy": X.linear_bid(0.72)}, 500.0)

"""Payment snapshots and streams over events cut from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from haggle.operators import payments as P
from haggle.plans.market import life
from haggle.plans.registry import fixture, query, view
from haggle.session import scratch_path
from haggle.sources.tables import table
from haggle.streaming import funnels as U
from haggle.streaming import lifecycle as S

_STEPS = [("offer_submitted", "offer_submitted", "TRUE"), ("merchant_countered", "merchant_countered", "k % 3 = 0"), ("buyer_accepted", "buyer_accepted", "k % 8 <> 7"), ("checkout_created", "checkout_created", "k % 8 <> 7"),
          ("order_created", "order_created", "k % 8 <> 7"), ("paid", "paid", "k % 8 <> 7 AND k % 5 <> 0"), ("mature", "mature", "k % 8 <> 7 AND k % 5 <> 0 AND k % 6 = 0"),
          ("refund_recorded", "partially_refunded", "k % 8 <> 7 AND k % 5 <> 0 AND k % 7 = 0"), ("return_status_recorded", "mature", "k % 8 <> 7 AND k % 5 <> 0 AND k % 6 = 0 AND k % 11 = 0"),
          ("return_status_recorded", "paid", "k % 8 <> 7 AND k % 5 <> 0 AND k % 6 <> 0 AND k % 11 = 0"), ("return_status_recorded", "paid", "k % 8 <> 7 AND k % 5 <> 0 AND k % 22 = 0"), ("offer_submitted", "offer_submitted", "k % 53 = 0")]
_VALS = ", ".join(f"({i}, '{t}', '{s}')" for i, (t, s, _) in enumerate(_STEPS))
_ON = " OR ".join(f"(s.seq = {i} AND {c})" for i, (_, _, c) in enumerate(_STEPS))
view("v_pay", f"""
SELECT offer_id AS transaction_id, k, s.seq, k * 20 + s.seq AS ordinal, s.event_type, s.lifecycle_state, d + INTERVAL '1' DAY * s.seq AS occurred_at, d AS submitted_at, 'store' AS store_id, category AS product_title, listing_id AS product_reference_hash,
  CAST(bid * 100 AS BIGINT) AS offer_amount_minor, 'USD' AS currency, CASE WHEN s.event_type = 'merchant_countered' THEN CAST(asking * 90 AS BIGINT) END AS counter_amount_minor, CAST(bid * 100 AS BIGINT) + s.seq AS accepted_amount_minor,
  CAST(bid * 100 AS BIGINT) AS order_total_minor, CONCAT('r', offer_id) AS order_reference_hash, d + INTERVAL '5' DAY AS paid_at, CAST(bid * 100 AS BIGINT) AS paid_total_minor, CASE WHEN k % 59 = 0 THEN 'EUR' ELSE 'USD' END AS paid_currency,
  CAST(500 AS BIGINT) AS refund_total_minor, CAST(500 AS BIGINT) AS cumulative_refund_total_minor, 'USD' AS refund_currency, CASE s.seq WHEN 8 THEN 'open' WHEN 9 THEN 'open' WHEN 10 THEN 'closed' END AS return_exposure_state,
  CASE s.event_type WHEN 'refund_recorded' THEN 'partially_refunded' ELSE 'paid' END AS payment_state, d + INTERVAL '6' DAY AS matured_at, CAST(bid * 100 AS BIGINT) AS net_revenue_minor, CAST(bid * 60 AS BIGINT) AS mature_margin_minor, CONCAT('m', offer_id) AS maturity_input_hash
FROM v_base b JOIN (VALUES {_VALS}) AS s(seq, event_type, lifecycle_state) ON {_ON}""")


def pay(spark, sf):
    e = fixture(spark, sf, "v_pay")
    return e.withColumns({c: F.col(c).cast("timestamp") for c, t in e.dtypes if t == "timestamp_ntz"})


_KEPT = "(SELECT p.* FROM v_pay p JOIN (SELECT transaction_id, MAX(ordinal) AS st FROM v_pay WHERE event_type = 'offer_submitted' GROUP BY 1) x ON x.transaction_id = p.transaction_id AND p.ordinal >= x.st)"


def _last(c: str, *types: str) -> str:
    return f"arg_max({c}, ordinal) FILTER (WHERE event_type IN ({', '.join(repr(t) for t in types)}) AND {c} IS NOT NULL) AS {c}"


view("v_psnap", f"""
SELECT * EXCLUDE (lt, ls, mo, uo, matured_at, net_revenue_minor, mature_margin_minor, maturity_input_hash), CASE WHEN lt = 'return_status_recorded' AND ls = 'mature' THEN COALESCE(payment_state, 'paid') ELSE ls END AS lifecycle_state,
  {', '.join(f"CASE WHEN COALESCE(uo > mo, FALSE) THEN NULL ELSE {c} END AS {c}" for c in P.MATURE_FIELDS)} FROM (
SELECT transaction_id, {', '.join(_last(c, t) for t, cs in P.BY_TYPE.items() for c in cs)}, {_last('accepted_amount_minor', 'buyer_accepted', 'checkout_created')}, {_last('return_exposure_state', 'return_status_recorded', 'mature')},
  {_last('payment_state', 'paid', 'refund_recorded', 'mature')}, arg_max(event_type, ordinal) AS lt, arg_max(lifecycle_state, ordinal) AS ls, MAX(ordinal) FILTER (WHERE event_type = 'mature') AS mo,
  MAX(ordinal) FILTER (WHERE event_type IN ('refund_recorded', 'return_status_recorded')) AS uo FROM {_KEPT} e GROUP BY 1) t""")
_COLS = "transaction_id, lifecycle_state, offer_amount_minor, counter_amount_minor, accepted_amount_minor, paid_total_minor, cumulative_refund_total_minor, return_exposure_state, mature_margin_minor"


def snaps(spark, sf):
    s = P.offer_snapshots(pay(spark, sf))
    return s


@query("offer_snapshots", f"SELECT {_COLS} FROM v_psnap")
def _(spark, sf):
    return snaps(spark, sf).select(*[c.strip() for c in _COLS.split(",")])


_LABEL = "CASE WHEN lifecycle_state = 'mature' THEN 'current_mature' WHEN COALESCE(return_exposure_state = 'open', FALSE) THEN 'maturity_blocked_open_return' WHEN paid_at IS NOT NULL THEN 'not_currently_mature' ELSE 'not_paid' END"


@query("transaction_ledger", f"""SELECT transaction_id, product_title || ' (' || substr(product_reference_hash, 1, 8) || ')' AS product, lifecycle_state, {_LABEL} AS maturity_status, offer_amount_minor,
  COALESCE(accepted_amount_minor, counter_amount_minor, offer_amount_minor) AS selected_amount_minor, paid_total_minor, COALESCE(cumulative_refund_total_minor, 0) AS refund_total_minor, COALESCE(return_exposure_state, 'none') AS return_exposure_state,
  CASE WHEN lifecycle_state = 'mature' THEN mature_margin_minor END AS mature_margin_minor FROM v_psnap""")
def _(spark, sf):
    return P.transaction_ledger(snaps(spark, sf))


@query("maturity_status", f"""SELECT COALESCE(a.maturity_status, b.maturity_status) AS maturity_status, COALESCE(transactions, 0) AS transactions, COALESCE(stale_mature_events, 0) AS stale_mature_events FROM
 (SELECT {_LABEL} AS maturity_status, COUNT(*) AS transactions FROM v_psnap GROUP BY 1) a FULL JOIN
 (SELECT {_LABEL.replace('lifecycle_state', 's.lifecycle_state').replace('return_exposure_state', 's.return_exposure_state').replace('paid_at', 's.paid_at')} AS maturity_status, COUNT(*) AS stale_mature_events FROM v_pay e JOIN v_psnap s ON s.transaction_id = e.transaction_id
  WHERE e.event_type = 'mature' AND NOT COALESCE(s.lifecycle_state = 'mature' AND s.maturity_input_hash = e.maturity_input_hash, FALSE) GROUP BY 1) b ON a.maturity_status = b.maturity_status""")
def _(spark, sf):
    return P.maturity_status(snaps(spark, sf), pay(spark, sf))


@query("inbox", """SELECT transaction_id, lifecycle_state, CASE lifecycle_state WHEN 'offer_submitted' THEN 'merchant_review' WHEN 'merchant_countered' THEN 'await_buyer' WHEN 'order_created' THEN 'await_payment' WHEN 'paid' THEN 'await_maturity' END AS next_action,
  offer_amount_minor, counter_amount_minor, currency FROM v_psnap WHERE lifecycle_state IN ('offer_submitted', 'merchant_countered', 'order_created', 'paid')""")
def _(spark, sf):
    return P.inbox(snaps(spark, sf))


_COSTS = {"product_cost": 1000, "shipping_cost": 300, "platform_fee": 200, "return_loss": 50}
_CFG = "|".join(["14", "USD", *[f"{k}={v}" for k, v in sorted(_COSTS.items())]])
_NOW = "1998-06-01 00:00:00"


@query("mature", f"""SELECT transaction_id, reason, reason IS NULL AS eligible, CASE WHEN reason IS NULL THEN net END AS net_revenue_minor, CASE WHEN reason IS NULL THEN net - 1550 END AS mature_margin_minor FROM (
SELECT s.transaction_id, paid_total_minor - COALESCE(cumulative_refund_total_minor, 0) AS net, CASE WHEN paid_at IS NULL THEN 'not_paid' WHEN COALESCE(return_exposure_state = 'open', FALSE) THEN 'return_exposure_open' WHEN TIMESTAMP '{_NOW}' < paid_at + INTERVAL 14 DAY THEN 'maturity_window_open'
  WHEN paid_currency <> 'USD' THEN 'currency_mismatch' WHEN CAST(s.transaction_id AS BIGINT) % 13 = 0 AND CAST(s.transaction_id AS BIGINT) % 26 <> 0 THEN 'reconciliation_hold' WHEN CAST(s.transaction_id AS BIGINT) % 17 = 0 THEN 'duplicate_maturity_input' END AS reason FROM v_psnap s) t""")
def _(spark, sf):
    s = snaps(spark, sf)
    n = F.col("transaction_id").cast("long")
    # a held reference that is settled later for even transactions, and past maturities with the same input
    held = s.filter(n % 13 == 0).select("transaction_id", F.lit("x").alias("reference_hash"), F.explode(F.array(
        F.struct(F.lit(1).alias("ordinal"), F.lit("needs_reconciliation").alias("status")), F.struct(F.lit(2).alias("ordinal"), F.when(n % 26 == 0, "recorded").otherwise("held_before_paid").alias("status")))).alias("e")).select("transaction_id", "reference_hash", "e.*")
    old = s.filter(n % 17 == 0).select("transaction_id", P.input_hash(14, "USD", _COSTS).alias("maturity_input_hash"))
    return P.mature(s, held, old, _NOW, 14, "USD", _COSTS).drop("input_hash")


view("v_refund", """SELECT CAST(l_orderkey AS STRING) AS transaction_id, CONCAT('f', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber % 3 AS STRING)) AS refund_reference_hash, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_quantity * 100 AS BIGINT) END AS refund_total_minor, CASE WHEN l_partkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM lineitem""")


@query("refund_ledger", """
SELECT transaction_id, ordinal, refund_reference_hash, refund_total_minor, currency, status, c AS cumulative_refund_total_minor, CASE WHEN status = 'recorded' THEN CASE WHEN c >= 9000 THEN 'refunded' ELSE 'partially_refunded' END END AS payment_state FROM (
  SELECT *, SUM(CASE WHEN status = 'recorded' THEN refund_total_minor ELSE 0 END) OVER (PARTITION BY transaction_id ORDER BY ordinal)::BIGINT AS c FROM (
    SELECT *, CASE WHEN ordinal > MIN(ordinal) OVER (PARTITION BY refund_reference_hash) THEN 'duplicate_refused' WHEN CAST(transaction_id AS BIGINT) % 7 = 0 OR ordinal < 2 THEN 'held_before_paid' WHEN refund_total_minor IS NULL OR currency <> 'USD' THEN 'needs_reconciliation' ELSE 'recorded' END AS status FROM v_refund) a) b""")
def _(spark, sf):
    r = fixture(spark, sf, "v_refund").withColumn("ordinal", F.col("ordinal").cast("long"))
    paid = r.select("transaction_id").distinct().filter(F.col("transaction_id").cast("long") % 7 != 0).withColumns({"paid_ordinal": F.lit(2), "paid_total_minor": F.lit(9000), "paid_currency": F.lit("USD")})
    return P.refund_ledger(r, paid)


view("v_ret", """SELECT CAST(l_orderkey AS STRING) AS return_reference_hash, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal, CASE l_partkey % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'REQUESTED' WHEN 2 THEN 'CLOSED' ELSE 'OPEN' END AS return_status FROM lineitem""")


@query("return_exposure", """SELECT return_reference_hash, ordinal, return_status, CASE WHEN return_status = 'CLOSED' THEN 'closed' ELSE 'open' END AS return_exposure_state FROM (
  SELECT *, LAG(return_status) OVER (PARTITION BY return_reference_hash ORDER BY ordinal) AS b FROM v_ret) t WHERE b IS NULL OR b <> return_status""")
def _(spark, sf):
    return P.return_exposure(fixture(spark, sf, "v_ret").withColumn("ordinal", F.col("ordinal").cast("long")))


@query("reconcile_mature", """
SELECT merchant_namespace, transaction_id, COALESCE(sale = offer, FALSE) AS sale_matches, want AS expected_margin_minor, COALESCE(margin = want, FALSE) AS margin_matches FROM (
  SELECT *, (sale - COALESCE(cost, 0) - COALESCE(fees, 0) - COALESCE(ship, 0) - COALESCE(refunds, 0))::BIGINT AS want FROM (SELECT merchant_namespace, transaction_id, MAX(buyer_offer_minor) AS offer, arg_max(final_sale_minor, ordinal) FILTER (WHERE transition_to = 'paid') AS sale,
    arg_min(cost_basis_minor, ordinal) FILTER (WHERE cost_basis_minor IS NOT NULL) AS cost, MAX(fees_minor) AS fees, MAX(shipping_cost_minor) AS ship, SUM(refund_minor) AS refunds, MAX(margin_minor) AS margin, BOOL_OR(transition_to = 'mature') AS m FROM v_life GROUP BY 1, 2) a WHERE m) b""")
def _(spark, sf):
    return P.reconcile_mature(life(spark, sf))


@query("bind_references", """SELECT CAST(l_orderkey AS STRING) AS delivery, l_linenumber, CASE WHEN o.o_orderkey IS NOT NULL THEN CAST(o.o_custkey AS STRING) END AS transaction_id, o.o_orderkey IS NOT NULL AS bound
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey""")
def _(spark, sf):
    from haggle.sources.tables import table

    ev = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("delivery"), "l_linenumber", F.sha2(F.col("l_orderkey").cast("string"), 256).alias("reference_hash"))
    refs = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("reference_hash"), F.col("o_custkey").cast("string").alias("transaction_id"), F.col("o_orderkey").alias("ordinal"))
    return P.bind_references(ev, refs).drop("reference_hash")


# ---- streams: the events are written as files of a few batches and drained


def _in_files(spark, df, path: str, batches: int = 2) -> int:
    """Write df in as many files a batch as there are cores, rows dealt by hash; returns how many those are."""
    each = max(1, spark.sparkContext.defaultParallelism)
    df.repartition(batches * each, *df.columns).write.parquet(path)
    return each


def _as_stream(spark, df, name: str):
    path = scratch_path(spark, name)
    each = _in_files(spark, df, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


@query("lifecycle_stream", "SELECT * FROM v_states")
def _(spark, sf):
    e = life(spark, sf).select("merchant_namespace", "transaction_id", "event_id", "occurred_at", "received_at", "transition_to", "currency", "has_conversion")
    out, cp = scratch_path(spark, "life-out"), scratch_path(spark, "life-cp")
    S.run_to_table(S.lifecycle_stream(_as_stream(spark, e, "life-in")), out, cp)
    return S.latest_rows(spark, out, ["merchant_namespace", "transaction_id"])


@query("ingest_stream", """
WITH b AS (SELECT transaction_id, ordinal, sha256(CASE WHEN seq % 3 = 2 THEN transition_to ELSE 'same' END) AS body FROM v_life),
f AS (SELECT *, FIRST_VALUE(body) OVER (PARTITION BY transaction_id ORDER BY ordinal) AS first_body FROM b)
SELECT transaction_id AS idempotency_key, MIN(first_body) AS accepted_hash, COUNT(*) FILTER (WHERE body = first_body) - 1 AS replays, COUNT(*) FILTER (WHERE body <> first_body) AS conflicts FROM f GROUP BY 1""")
def _(spark, sf):
    e = life(spark, sf).withColumn("body_hash", F.sha2(F.when(F.col("seq") % 3 == 2, F.col("transition_to")).otherwise("same"), 256)).select("transaction_id", "body_hash", "ordinal")
    out, cp = scratch_path(spark, "ing-out"), scratch_path(spark, "ing-cp")
    S.run_to_table(S.ingest_stream(_as_stream(spark, e, "ing-in"), "transaction_id", "body_hash"), out, cp)
    return S.latest_rows(spark, out, ["idempotency_key"])


@query("maturity_stream", """
SELECT transaction_id, 'mature' AS status, MAX(paid_total_minor) FILTER (WHERE event_type = 'paid') - 500 * COUNT(*) FILTER (WHERE event_type = 'refund_recorded') AS net_revenue_minor
FROM v_pay GROUP BY 1 HAVING COUNT(*) FILTER (WHERE event_type = 'paid') > 0
  AND COALESCE(arg_max(return_exposure_state, occurred_at) FILTER (WHERE event_type = 'return_status_recorded'), 'closed') <> 'open'""")
def _(spark, sf):
    amount = F.when(F.col("event_type") == "paid", F.col("paid_total_minor")).when(F.col("event_type") == "refund_recorded", F.lit(500)).otherwise(0).cast("long")
    e = pay(spark, sf).select("transaction_id", "event_type", "occurred_at", amount.alias("amount_minor"), "return_exposure_state")
    path = scratch_path(spark, "mature-in")
    each = _in_files(spark, e, path)
    # events of a time beyond all windows move the watermark past every timer
    for at in ("2100-01-01", "2100-01-02"):
        last = e.limit(1).select(F.lit("last").alias("transaction_id"), F.lit("seen").alias("event_type"), F.lit(at).cast("timestamp").alias("occurred_at"), F.lit(0).cast("long").alias("amount_minor"), "return_exposure_state")
        last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", each).parquet(path).withWatermark("occurred_at", "3650 days")
    out, cp = scratch_path(spark, "mature-out"), scratch_path(spark, "mature-cp")
    S.run_to_table(S.maturity_stream(stream, 14, keep_days=36500), out, cp, mode="append")
    return spark.read.parquet(out).drop("batch")


# ---- funnels: events come in a few batches; those beyond all windows close the last of them

_FUNNEL = ["view", "click", "purchase"]
_N = ", ".join(f"COUNT(*) FILTER (WHERE event_type = '{s}') AS n_{i}, MIN(ts) FILTER (WHERE event_type = '{s}') AS f{i}" for i, s in enumerate(_FUNNEL))
_DEPTH = "CASE WHEN f0 IS NULL THEN 0 WHEN f1 IS NULL OR f1 < f0 THEN 1 WHEN f2 IS NULL OR f2 < f1 THEN 2 ELSE 3 END AS depth"


def _closed(spark, sf, build):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "funnel-in")
    e.repartitionByRange(3, "ts").write.parquet(path)
    for at in ("2100-01-01", "2100-02-01"):
        e.limit(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), F.lit(at).cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "30 days")
    out, cp = scratch_path(spark, "funnel-out"), scratch_path(spark, "funnel-cp")
    late = S.run_to_table(build(stream), out, cp, mode="append")
    closed = spark.read.parquet(out).where("window_end < timestamp'2100-01-01'").drop("batch")
    plain = {c: F.to_timestamp_ntz(F.col(c).cast("string")) for c in ("window_start", "window_end")}
    return closed.withColumns({**plain, "late": F.lit(late).cast("long")})


@query("tumbling_funnel", f"""SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, events, n_0, n_1, n_2, {_DEPTH}, 0::BIGINT AS late
FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, COUNT(*) AS events, {_N} FROM events GROUP BY 1) t""")
def _(spark, sf):
    return _closed(spark, sf, lambda s: U.tumbling_funnel(s, "6 hours", _FUNNEL))


@query("sliding_funnel", f"""SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, events, n_0, n_1, n_2, {_DEPTH}, 0::BIGINT AS late
FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS window_start, COUNT(*) AS events, {_N} FROM events, (VALUES (0), (1)) v(k) GROUP BY 1) t""")
def _(spark, sf):
    return _closed(spark, sf, lambda s: U.sliding_funnel(s, "1 day", "12 hours", _FUNNEL))


@query("session_funnel", f"""SELECT window_start, window_end, user_id, events, n_0, n_1, n_2, {_DEPTH}, 0::BIGINT AS late FROM (
  SELECT user_id, MIN(ts) AS window_start, MAX(ts) + INTERVAL 8 HOUR AS window_end, COUNT(*) AS events, {_N} FROM (
    SELECT *, SUM(CASE WHEN p IS NULL OR ts - p > INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
    FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) a) b GROUP BY user_id, run) t""")
def _(spark, sf):
    return _closed(spark, sf, lambda s: U.session_funnel(s, "8 hours", _FUNNEL, ["user_id"]))

"""Cases, splits and guards over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from haggle.operators import guards as G
from haggle.operators import split as P
from haggle.operators import tasks as K
from haggle.operators.ordered import done, grouped, with_row_number
from haggle.operators.rank import global_rank
from haggle.plans.registry import query, staged, view
from haggle.sources.tables import TURN_ORDER, listings_view, table, thread_probe, turns_view

ORDER = ", ".join(TURN_ORDER)


def norm_turns(spark, sf):
    t = done(with_row_number(grouped(turns_view(spark, sf), ["thread_id"], TURN_ORDER, thread_probe(spark, sf)), "turn_index"))
    return K.decode_codes(t).select("thread_id", "listing_id", "buyer_id", "turn_index", "actor", "action",
                                    F.col("offer_price").alias("amount"), "status", "status_id", "event_time", "response_time")


def norm_listings(spark, sf):
    return listings_view(spark, sf).select(
        "listing_id", "seller_id", "category", F.col("condition_id").cast("string").alias("condition"),
        F.col("start_price").alias("listing_price"), F.col("item_price").alias("final_sale_price"),
        (F.col("bo_ck") == 1).alias("sold_by_best_offer"))


def cases_of(spark, sf, target=None):
    """The case table, or one target of it. Its turns are staged, since every split, metric and model reads them."""
    write = lambda path: K.case_turns(norm_turns(spark, sf), norm_listings(spark, sf), thread_probe(spark, sf)).write.parquet(path)
    return K.emit_cases(spark.read.parquet(staged(spark, sf, "case-turns", ("lineitem", "orders", "customer"), write)), target)


def fresh_cases(spark, sf):
    return K.build_cases(norm_turns(spark, sf), norm_listings(spark, sf), thread_probe(spark, sf))


view("v_nturns", f"""
SELECT thread_id, listing_id, buyer_id, CAST(ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY {ORDER}) AS INTEGER) AS turn_index,
       CASE offer_type WHEN 2 THEN 'seller' ELSE 'buyer' END AS actor,
       CASE offer_type WHEN 0 THEN 'offer' ELSE 'counter' END AS action, offer_price AS amount,
       CASE status_id WHEN 0 THEN 'expired' WHEN 1 THEN 'accepted' WHEN 2 THEN 'declined' WHEN 6 THEN 'auto_declined'
            WHEN 7 THEN 'countered' WHEN 8 THEN 'declined_other_buyer_accepted' WHEN 9 THEN 'auto_accepted' END AS status,
       status_id, event_time, response_time
FROM v_turns""")
view("v_nlistings", """
SELECT listing_id, seller_id, category, CAST(condition_id AS STRING) AS condition, start_price AS listing_price,
       item_price AS final_sale_price, bo_ck = 1 AS sold_by_best_offer FROM v_listings""")
view("v_annot", """
SELECT t.*, l.seller_id, l.category, l.condition, l.listing_price, l.final_sale_price, l.sold_by_best_offer,
       LEAD(actor) OVER w AS next_actor, LEAD(action) OVER w AS next_action, LEAD(event_time) OVER w AS next_time,
       COALESCE(SUM(CASE WHEN action = 'counter' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_counter_count,
       (turn_index - 1)::BIGINT AS prior_turn_count
FROM v_nturns t JOIN v_nlistings l ON l.listing_id = t.listing_id
WINDOW w AS (PARTITION BY thread_id ORDER BY turn_index)""")
view("v_agree", """
SELECT thread_id, CASE WHEN deal THEN '1' WHEN other THEN NULL WHEN last_status IN (0, 2, 6) THEN '0' END AS label, other
FROM (SELECT thread_id, BOOL_OR(status_id IN (1, 9)) AS deal, BOOL_OR(status_id = 8) AS other,
             arg_max(status_id, turn_index) AS last_status FROM v_nturns GROUP BY 1) t""")


def _feat(first: bool) -> str:
    zero = "0::BIGINT"
    return f"""category, condition, listing_price, actor AS current_actor, action AS current_action, amount AS current_amount,
       CASE WHEN amount <> 0 AND listing_price <> 0 THEN amount / listing_price END AS offer_to_asking_ratio,
       turn_index AS round_number, {zero if first else 'prior_turn_count'} AS prior_turn_count,
       {zero if first else 'prior_counter_count'} AS prior_counter_count,
       hour(event_time) + minute(event_time) / 60.0::DOUBLE AS event_hour,
       thread_id, listing_id, seller_id, buyer_id, event_time AS "timestamp\""""


def _label(side: str) -> str:
    return f"""CASE WHEN status_id IN (1, 9) THEN 'accept' WHEN status_id IN (2, 6) THEN 'decline' WHEN status_id = 0 THEN 'expire'
            WHEN status_id = 7 AND next_actor = '{side}' AND next_action = 'counter' THEN 'counter' END"""


def _state(known: str, cens: str) -> str:
    return f"CASE WHEN {known} IS NOT NULL THEN 'supervised' WHEN {cens} THEN 'censored' ELSE 'unknown' END AS outcome_state"


_LAT = "CASE WHEN status_id <> 8 AND response_time >= event_time THEN epoch_us(response_time) / 1e6 - epoch_us(event_time) / 1e6 END"
_RATIO = "CASE WHEN sold_by_best_offer AND g.label = '1' AND listing_price <> 0 THEN round(final_sale_price / listing_price, 6) END"
_NO, _NONUM = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"
view("v_heads", """
SELECT a.*, g.label AS agreed, g.other FROM v_annot a JOIN v_agree g ON g.thread_id = a.thread_id WHERE a.turn_index = 1""")
view("v_cases", f"""
SELECT thread_id || ':' || turn_index || ':seller_next_action' AS row_id, 'seller_next_action' AS target,
       {_label('seller')} AS label, {_NONUM} AS value, {_state(_label('seller'), 'status_id = 8')}, {_feat(False)}
FROM v_annot WHERE actor = 'buyer'
UNION ALL
SELECT thread_id || ':' || turn_index || ':buyer_response', 'buyer_response_to_counter',
       {_label('buyer')}, {_NONUM}, {_state(_label('buyer'), 'status_id = 8')}, {_feat(False)}
FROM v_annot WHERE actor = 'seller' AND action = 'counter'
UNION ALL
SELECT thread_id || ':agreement', 'agreement', agreed, {_NONUM}, {_state('agreed', 'other')}, {_feat(True)} FROM v_heads
UNION ALL
SELECT thread_id || ':final_price_ratio', 'final_price_ratio', {_NO}, {_RATIO.replace('g.label', 'agreed')},
       {_state(_RATIO.replace('g.label', 'agreed'), 'other')}, {_feat(True)} FROM v_heads
UNION ALL
SELECT thread_id || ':' || turn_index || ':response_latency', 'response_latency', {_NO}, {_LAT},
       {_state(_LAT, 'status_id = 8')}, {_feat(False)}
FROM v_annot""")
_CASE_DOUBLES = "value listing_price current_amount offer_to_asking_ratio event_hour"


@query("build_cases", "SELECT * FROM v_cases", _CASE_DOUBLES)
def _(spark, sf):
    return fresh_cases(spark, sf)


@query("build_tasks", "SELECT * FROM v_cases WHERE outcome_state = 'supervised'", _CASE_DOUBLES)
def _(spark, sf):
    return K.build_tasks(norm_turns(spark, sf), norm_listings(spark, sf), thread_probe(spark, sf))


@query("agreement_label", "SELECT thread_id, label, other AS has_other FROM v_agree")
def _(spark, sf):
    return K.agreement_label(norm_turns(spark, sf))


@query("status_label", f"""
SELECT thread_id, turn_index, CASE WHEN actor = 'buyer' THEN {_label('seller')} ELSE {_label('buyer')} END AS label FROM v_annot""")
def _(spark, sf):
    t = K.annotate_turns(norm_turns(spark, sf), thread_probe(spark, sf))
    side = [K.status_label(F.col("status_id"), s, F.col("next_actor"), F.col("next_action")) for s in ("seller", "buyer")]
    return t.select("thread_id", "turn_index", F.when(F.col("actor") == "buyer", side[0]).otherwise(side[1]).alias("label"))


view("v_sturns", """
SELECT thread_id, listing_id, buyer_id, turn_index, actor,
       CASE status_id WHEN 1 THEN 'accept' WHEN 9 THEN 'accept' WHEN 2 THEN 'counter' WHEN 6 THEN 'decline'
            WHEN 0 THEN 'expire' WHEN 8 THEN 'leave' ELSE 'offer' END AS action,
       amount, '' AS status, CAST(NULL AS INTEGER) AS status_id, event_time FROM v_nturns""")
view("v_sannot", """
SELECT t.*, l.seller_id, l.category, l.condition, l.listing_price,
       LEAD(actor) OVER w AS next_actor, LEAD(action) OVER w AS next_action, LEAD(event_time) OVER w AS next_time,
       COALESCE(SUM(CASE WHEN action = 'counter' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_counter_count,
       (turn_index - 1)::BIGINT AS prior_turn_count
FROM v_sturns t JOIN v_nlistings l ON l.listing_id = t.listing_id WINDOW w AS (PARTITION BY thread_id ORDER BY turn_index)""")
view("v_sheads", """
SELECT a.*, g.deal, g.label, g.accepted_amount FROM v_sannot a JOIN (
  SELECT thread_id, BOOL_OR(action = 'accept' AND amount IS NOT NULL) AS deal,
         arg_min(amount, turn_index) FILTER (WHERE action = 'accept' AND amount IS NOT NULL) AS accepted_amount,
         CASE WHEN BOOL_OR(action = 'accept') THEN '1'
              WHEN arg_max(action, turn_index) IN ('decline', 'expire', 'leave', 'reject', 'quit') THEN '0' END AS label
  FROM v_sturns GROUP BY 1) g ON g.thread_id = a.thread_id WHERE a.turn_index = 1""")
_SUP = "'supervised' AS outcome_state"


@query("build_tasks_simple", f"""
SELECT thread_id || ':' || turn_index || ':seller_next_action' AS row_id, 'seller_next_action' AS target,
       CASE WHEN next_action IN ('accept', 'counter', 'decline') THEN next_action ELSE 'expire' END AS label, {_NONUM} AS value, {_SUP}, {_feat(False)}
FROM v_sannot WHERE actor = 'buyer' AND next_actor = 'seller'
UNION ALL
SELECT thread_id || ':' || turn_index || ':buyer_response', 'buyer_response_to_counter',
       CASE WHEN next_action IN ('accept', 'counter', 'expire') THEN next_action ELSE 'leave' END, {_NONUM}, {_SUP}, {_feat(False)}
FROM v_sannot WHERE actor = 'seller' AND action = 'counter' AND next_actor = 'buyer'
UNION ALL SELECT thread_id || ':agreement', 'agreement', label, {_NONUM}, {_SUP}, {_feat(True)} FROM v_sheads WHERE label IS NOT NULL
UNION ALL SELECT thread_id || ':final_price_ratio', 'final_price_ratio', {_NO},
       round(accepted_amount / nullif(listing_price, 0), 6), CASE WHEN accepted_amount / nullif(listing_price, 0) IS NULL THEN 'unknown' ELSE 'supervised' END, {_feat(True)} FROM v_sheads WHERE deal
UNION ALL SELECT thread_id || ':' || turn_index || ':response_latency', 'response_latency', {_NO},
       epoch_us(next_time) / 1e6 - epoch_us(event_time) / 1e6, {_SUP}, {_feat(False)} FROM v_sannot WHERE next_time IS NOT NULL""",
       "value:6 listing_price current_amount offer_to_asking_ratio event_hour")
def _(spark, sf):
    act = F.create_map(*[F.lit(x) for p in {1: "accept", 9: "accept", 2: "counter", 6: "decline", 0: "expire", 8: "leave", 7: "offer"}.items() for x in p])
    t = norm_turns(spark, sf).withColumn("action", F.element_at(act, F.col("status_id"))).withColumns(
        {"status": F.lit(""), "status_id": F.lit(None).cast("int")})
    return K.build_tasks_simple(t, norm_listings(spark, sf), thread_probe(spark, sf))


@query("task_manifest", """
SELECT target, COUNT(*) AS eligible_rows, COUNT(*) FILTER (WHERE outcome_state = 'supervised') AS supervised_rows,
       COUNT(*) FILTER (WHERE outcome_state = 'unknown') AS unknown_outcome_rows,
       COUNT(*) FILTER (WHERE outcome_state = 'censored') AS censored_outcome_rows,
       (SELECT COUNT(*) FROM v_nturns t WHERE turn_index = 1 AND NOT EXISTS
          (SELECT 1 FROM v_nlistings l WHERE l.listing_id = t.listing_id)) AS excluded_rows
FROM v_cases GROUP BY target""")
def _(spark, sf):
    turns, listings = norm_turns(spark, sf), norm_listings(spark, sf)
    _, lost = K.turns_with_listing(turns, listings)
    return K.task_manifest(K.build_cases(turns, listings, thread_probe(spark, sf)), lost)


@query("turns_with_listing", """
SELECT COUNT(DISTINCT t.thread_id) AS excluded_threads FROM v_nturns t LEFT JOIN
  (SELECT * FROM v_nlistings WHERE category <> 'BUILDING') l ON l.listing_id = t.listing_id WHERE l.listing_id IS NULL""")
def _(spark, sf):
    return K.turns_with_listing(norm_turns(spark, sf), norm_listings(spark, sf).filter("category <> 'BUILDING'"))[1]


@query("case_history", """
SELECT c.row_id, COUNT(*)::BIGINT AS turns, STRING_AGG(t.actor || '-' || t.action, ',' ORDER BY t.turn_index) AS path
FROM v_cases c JOIN v_nturns t ON t.thread_id = c.thread_id AND t.turn_index <= c.round_number
WHERE c.target = 'seller_next_action' GROUP BY c.row_id""")
def _(spark, sf):
    turns = norm_turns(spark, sf)
    cases = K.build_cases(turns, norm_listings(spark, sf), thread_probe(spark, sf)).filter("target = 'seller_next_action'")
    h = K.with_history(cases, turns)
    path = F.transform("observed_history", lambda x: F.concat_ws("-", x["actor"], x["action"]))
    return h.select("row_id", F.size("observed_history").cast("long").alias("turns"), F.array_join(path, ",").alias("path"))


# chunks of two turns stored once, cases with a count of chunks and a tail, and the history that they stand for
@query("case_history_chunks", """
SELECT c.row_id, (c.round_number // 2)::BIGINT AS chunks, COUNT(*) FILTER (WHERE t.turn_index > c.round_number // 2 * 2) AS tail_turns, STRING_AGG(t.actor || '-' || t.action, ',' ORDER BY t.turn_index) AS path
FROM v_cases c JOIN v_nturns t ON t.thread_id = c.thread_id AND t.turn_index <= c.round_number
WHERE c.target = 'seller_next_action' GROUP BY c.row_id, c.round_number""")
def _(spark, sf):
    turns = norm_turns(spark, sf)
    cases = K.build_cases(turns, norm_listings(spark, sf), thread_probe(spark, sf)).filter("target = 'seller_next_action'")
    tails = K.with_history_tail(cases, turns, 2)
    whole = K.expand_history(tails, K.history_chunks(turns, 2), ["row_id"], ["thread_id", "chunks", "tail"])
    path = F.array_join(F.transform("observed_history", lambda x: F.concat_ws("-", x["actor"], x["action"])), ",")
    # rows of one row_id meet each of its histories: a join by row_id, done inside the thread
    histories = F.collect_list(F.struct("path")).over(Window.partitionBy("thread_id", "row_id"))
    met = whole.withColumn("path", path).withColumn("_met", histories).withColumn("_met", F.explode("_met"))
    return met.select("row_id", "chunks", F.size("tail").cast("long").alias("tail_turns"), "_met.path")


# ---- ranks and splits

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("global_rank", f"""
SELECT l_orderkey, l_linenumber, l_partkey, ROW_NUMBER() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS rank FROM lineitem""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_ORDER)
    return global_rank(lines, LINE_ORDER, partitions=7).select("l_orderkey", "l_linenumber", "l_partkey", "rank")


def _region(r: str, n: str) -> str:
    te = f"GREATEST(1, FLOOR({n} * 0.6::DOUBLE))"
    de = f"GREATEST({te}, FLOOR({n} * 0.8::DOUBLE))"
    de = f"(CASE WHEN {n} >= 3 THEN LEAST({de}, {n} - 1) ELSE {de} END)"
    return f"CASE WHEN {r} <= {te} THEN 'train' WHEN {r} <= {de} THEN 'development' ELSE 'hidden' END"


_RANKED = """SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY "timestamp", row_id) AS r,
  COUNT(*) OVER (PARTITION BY target) AS n FROM v_cases"""
view("v_chrono", f"SELECT row_id, target, listing_id, r, {_region('r', 'n')} AS region FROM ({_RANKED}) t")


def one_target(spark, sf, target):
    return cases_of(spark, sf, target)


@query("chronological_split", "SELECT row_id, r AS rank, region FROM v_chrono WHERE target = 'agreement'")
def _(spark, sf):
    return P.chronological_split(one_target(spark, sf, "agreement").select("row_id", "timestamp"), "timestamp", "row_id").drop("timestamp")


@query("purged_split", """
SELECT row_id, region FROM v_chrono WHERE target = 'response_latency' AND listing_id IN
  (SELECT listing_id FROM v_chrono WHERE target = 'response_latency' GROUP BY 1 HAVING COUNT(DISTINCT region) = 1)""")
def _(spark, sf):
    df = one_target(spark, sf, "response_latency").select("row_id", "timestamp", "listing_id")
    return P.purged_split(df, "timestamp", "listing_id", "row_id").select("row_id", "region")


def _group_sql(target: str, group: str, order: str) -> str:
    return f"""SELECT c.row_id, g.region FROM v_cases c JOIN (
  SELECT g, {_region('r', 'n')} AS region FROM (SELECT g, ROW_NUMBER() OVER (ORDER BY {order}) AS r, COUNT(*) OVER () AS n
    FROM (SELECT DISTINCT {group} AS g FROM v_cases WHERE target = '{target}') d) t) g ON g.g = c.{group} WHERE c.target = '{target}'"""


@query("group_split", _group_sql("seller_next_action", "thread_id", "g"))
def _(spark, sf):
    df = one_target(spark, sf, "seller_next_action").select("row_id", "thread_id")
    return P.group_split(df, "thread_id").select("row_id", "region")


@query("hash_group_split", _group_sql("seller_next_action", "buyer_id", "sha256('buyer_id|' || g), g"))
def _(spark, sf):
    df = one_target(spark, sf, "seller_next_action").select("row_id", "buyer_id")
    return P.hash_group_split(df, "buyer_id", "exclude").select("row_id", "region")


@query("campaign_split", """
SELECT case_id, ROW_NUMBER() OVER (ORDER BY ts, case_id) AS rank,
       CASE WHEN ROW_NUMBER() OVER (ORDER BY ts, case_id) <= FLOOR(COUNT(*) OVER () * 0.6::DOUBLE) THEN 'training'
            WHEN ROW_NUMBER() OVER (ORDER BY ts, case_id) <= FLOOR(COUNT(*) OVER () * 0.6::DOUBLE) + FLOOR(COUNT(*) OVER () * 0.2::DOUBLE) THEN 'development'
            ELSE 'hidden' END AS split
FROM (SELECT CAST(event_id AS STRING) AS case_id, ts FROM events) e""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("case_id"), "ts")
    return P.campaign_split(ev, "ts", "case_id").select("case_id", "rank", "split")


@query("classify_post_freeze", """
WITH f AS (SELECT CAST(user_id % 3 AS STRING) AS campaign_id, arg_max(CAST(event_id AS STRING), (ts, event_id)) AS freeze_id,
             arg_max(ts - INTERVAL 12 HOUR, (ts, event_id)) AS cutoff, MAX(ts) AS frozen_at
           FROM events WHERE event_type = 'error' AND user_id % 3 < 2 AND event_id % 50 < 25 GROUP BY 1)
SELECT CAST(e.event_id AS STRING) AS case_id, CASE WHEN e.ts > f.cutoff AND e.ts + INTERVAL 6 HOUR > f.frozen_at THEN 'prospective' ELSE 'staging' END AS split,
       CASE WHEN f.freeze_id IS NULL THEN 'pre_freeze_staging' WHEN e.ts > f.cutoff AND e.ts + INTERVAL 6 HOUR > f.frozen_at THEN 'post_freeze_prospective'
            ELSE 'post_freeze_backfill_staging' END AS policy,
       CASE WHEN e.ts > f.cutoff AND e.ts + INTERVAL 6 HOUR > f.frozen_at THEN f.freeze_id END AS freeze_id
FROM events e LEFT JOIN f ON f.campaign_id = CAST(e.user_id % 3 AS STRING)""")
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("campaign_id", (F.col("user_id") % 3).cast("string"))
    fr = ev.filter("event_type = 'error' AND user_id % 3 < 2 AND event_id % 50 < 25").select(
        "campaign_id", F.lpad(F.col("event_id").cast("string"), 20, " ").alias("freeze_id"),
        (F.col("ts") - F.expr("INTERVAL 12 HOURS")).alias("data_cutoff_time"), F.col("ts").alias("frozen_at"))
    rows = ev.select("campaign_id", F.col("event_id").cast("string").alias("case_id"), F.col("ts").alias("decision_time"),
                     (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("recorded_at"))
    return P.classify_post_freeze(rows, fr).select("case_id", "split", "policy", F.trim("freeze_id").alias("freeze_id"))


_GROUPS = [(s, g) for s, (g, how) in P.SPLITS.items() if how != "purge"]
view("v_splits", "SELECT 'chronological_listing_purged' AS split, target, region, row_id FROM v_chrono WHERE (target, listing_id) IN "
     "(SELECT (target, listing_id) FROM v_chrono GROUP BY target, listing_id HAVING COUNT(DISTINCT region) = 1)" + "".join(
         f""" UNION ALL SELECT '{s}', c.target, g.region, c.row_id FROM v_cases c JOIN (SELECT target, g, {_region('r', 'n')} AS region FROM
  (SELECT target, g, ROW_NUMBER() OVER (PARTITION BY target ORDER BY sha256('{g}|' || g), g) AS r, COUNT(*) OVER (PARTITION BY target) AS n
   FROM (SELECT DISTINCT target, {g} AS g FROM v_cases) d) t) g ON g.target = c.target AND g.g = c.{g}""" for s, g in _GROUPS))


@query("split_manifests", """
SELECT split, target, region, COUNT(*) AS rows, SUM(('0x' || substr(sha256(row_id), 1, 15))::BIGINT)::VARCHAR AS case_set_hash
FROM v_splits GROUP BY ALL""")
def _(spark, sf):
    return P.split_manifests(P.split_table(cases_of(spark, sf)))


view("v_split_ids", " UNION ALL ".join(f"SELECT '{s}' AS split, target, row_id, {g} AS g FROM v_cases" for s, (g, _) in P.SPLITS.items()))


@query("split_audit", """
WITH j AS (SELECT i.split, i.target, i.row_id, i.g, s.region FROM v_split_ids i LEFT JOIN v_splits s ON s.split = i.split AND s.target = i.target AND s.row_id = i.row_id),
per AS (SELECT split, target, g, COUNT(region) AS kept, COUNT(*) - COUNT(region) AS purged, COUNT(DISTINCT region) AS regions, COUNT(*) - COUNT(DISTINCT row_id) AS again FROM j GROUP BY ALL)
SELECT split, target, SUM(kept)::BIGINT AS rows, SUM(purged)::BIGINT AS purged_rows, COUNT(*) FILTER (WHERE purged > 0 AND kept = 0) AS purged_groups, 0::BIGINT AS missing_identifier_rows,
  SUM(again) = 0 AS no_duplicate_cases, MAX(regions) <= 1 AS group_disjoint, 0::BIGINT AS stray_rows, SUM(again) = 0 AND MAX(regions) <= 1 AS passed FROM per GROUP BY ALL""")
def _(spark, sf):
    cases = cases_of(spark, sf)
    return P.split_audit(P.split_groups(cases, P.split_table(cases)))


@query("assert_disjoint", """
SELECT listing_id, MIN(region) AS first_region, MAX(region) AS last_region FROM v_chrono WHERE target = 'agreement'
GROUP BY 1 HAVING COUNT(DISTINCT region) > 1""")
def _(spark, sf):
    df = one_target(spark, sf, "agreement").select("row_id", "timestamp", "listing_id")
    return P.assert_disjoint(P.chronological_split(df, "timestamp", "row_id"), "listing_id")


@query("publish_cases", """
SELECT c.target, c.row_id, c.outcome_state, c.offer_to_asking_ratio, s.region, s.region = 'hidden' AS label_redacted
FROM v_cases c JOIN v_splits s ON s.row_id = c.row_id AND s.target = c.target
WHERE s.split = 'seller_disjoint' AND s.region = 'hidden'""", "offer_to_asking_ratio")
def _(spark, sf):
    cases = cases_of(spark, sf)
    public, _ = P.publish_cases(cases)
    return P.read_public(public, P.split_table(cases), "seller_disjoint", "hidden").select(
        "target", "row_id", "outcome_state", "offer_to_asking_ratio", "region", "label_redacted")


@query("split_assignments", """
SELECT 'c' || (o_custkey % 4) AS campaign, CAST(o_custkey AS STRING) AS case_id, 'malformed_split_assignment' AS violation, 1::BIGINT AS rows
FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'c' || (o_custkey % 4), CAST(o_custkey AS STRING), 'multiple_split_assignments', COUNT(*) FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")).alias("campaign"), F.col("o_custkey").cast("string").alias("case_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise("training").alias("split"))
    return P.split_assignments(o, "campaign", "case_id", "split")


@query("supervised_union", """
SELECT CAST(event_id AS STRING) AS case_id, ts AS decision_time, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS target,
       CASE WHEN user_id % 2 = 0 THEN 'episode' ELSE 'trial' END AS origin,
       CASE WHEN user_id % 2 = 1 THEN user_id % 3 END AS block FROM events""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("case_id"), F.col("ts").alias("decision_time"),
                                           F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("target"), "user_id")
    ep = ev.filter("user_id % 2 = 0").drop("user_id")
    tr = ev.filter("user_id % 2 = 1").withColumn("block", F.col("user_id") % 3).drop("user_id")
    return P.supervised_union(ep, tr)


@query("supervised_rows", """
SELECT CAST(event_id AS STRING) AS case_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS target
FROM events WHERE event_type IN ('purchase', 'click') AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-15 00:00:00'""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("case_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("decision_time"),
        F.col("ts").alias("observation_cutoff"), F.create_map(F.lit("value"), F.col("value")).alias("features"),
        F.when(F.col("event_type").isin("purchase", "click"), F.create_map(F.lit("sold"), (F.col("value") > 50).cast("double")))
        .otherwise(F.create_map().cast("map<string,double>")).alias("later_outcomes"))
    return P.supervised_rows(ev, "sold", "2024-01-15 00:00:00").select("case_id", "target")


# ---- guards and controls


@query("feature_contract", """
SELECT CASE event_type WHEN 'purchase' THEN 'final_sale_price' WHEN 'error' THEN 'status' ELSE 'invented' END AS feature, COUNT(*) AS rows
FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1""")
def _(spark, sf):
    name = F.when(F.col("event_type") == "purchase", "final_sale_price").when(F.col("event_type") == "error", "status").when(
        F.col("event_type") == "signup", "invented").otherwise("event_hour")
    ev = table(spark, sf, "events").select(F.create_map(F.lit("category"), F.lit("x"), name, F.lit("1")).alias("features"))
    return G.feature_contract(ev, "features")


@query("no_future_leakage", """
SELECT row_id, 'future_history_field' AS leak FROM v_cases WHERE target = 'seller_next_action' AND label IN ('accept', 'counter')""")
def _(spark, sf):
    c = one_target(spark, sf, "seller_next_action")
    item = F.when(F.col("label") == "counter", F.create_map(F.lit("future_rounds"), F.lit("2"))).when(
        F.col("label") == "accept", F.create_map(F.lit("status"), F.lit("accepted"))).otherwise(F.create_map(F.lit("actor"), F.lit("buyer")))
    d = c.select("row_id", F.create_map(F.lit("category"), F.col("category")).alias("features"), F.array(item).alias("history"))
    return G.no_future_leakage(d, "features", "history").select("row_id", "leak")


@query("pre_decision_guard", """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'reserved_key' ELSE 'cutoff_after_decision' END AS leak
FROM events WHERE event_type = 'purchase' OR user_id % 7 = 0""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    body = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.struct(F.col("value").alias("Actual_Action")).alias("context"))))
    body = body.otherwise(F.to_json(F.struct(F.struct(F.col("value").alias("price")).alias("context"))))
    df = ev.select("event_id", body.alias("snapshot"), F.col("ts").alias("decision"),
                   F.when(F.col("user_id") % 7 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("cutoff"))
    return G.pre_decision_guard(df, "snapshot", "cutoff", "decision").select("event_id", "leak")


@query("rotated_labels", """
SELECT row_id, label, COALESCE(LEAD(label) OVER (ORDER BY "timestamp", row_id), FIRST_VALUE(label) OVER (ORDER BY "timestamp", row_id)) AS rotated_label
FROM v_cases WHERE target = 'agreement' AND label IS NOT NULL""")
def _(spark, sf):
    df = one_target(spark, sf, "agreement").filter("label IS NOT NULL").select("row_id", "timestamp", "label")
    return G.rotate_labels(df, ["timestamp", "row_id"]).select("row_id", "label", "rotated_label")


@query("random_row_split", """
SELECT target, CASE WHEN ('0x' || substr(sha256(row_id), 1, 8))::BIGINT % 5 < 3 THEN 'train' ELSE 'evaluation' END AS region, COUNT(*) AS rows
FROM v_cases GROUP BY ALL""")
def _(spark, sf):
    return G.random_row_split(cases_of(spark, sf), "row_id").groupBy("target", "region").agg(F.count(F.lit(1)).alias("rows"))


@query("tied_timestamps", """
SELECT target, COUNT(*) AS tied_timestamps, SUM(n)::BIGINT AS tied_rows FROM (
  SELECT target, "timestamp", COUNT(*) AS n FROM v_cases GROUP BY 1, 2 HAVING COUNT(*) > 1) t GROUP BY target""")
def _(spark, sf):
    # times and targets need few of the turns' columns, so this reads less from fresh cases than staging all columns would write
    return G.tied_timestamps(fresh_cases(spark, sf), "timestamp", ["target"])


@query("censoring_control", """
SELECT target, COUNT(*) FILTER (WHERE outcome_state <> 'supervised') AS affected_rows,
       COUNT(*) FILTER (WHERE outcome_state <> 'supervised') > 0 AS variant_applicable, TRUE AS adds_up
FROM v_cases GROUP BY target""")
def _(spark, sf):
    return G.censoring_control(K.task_manifest(cases_of(spark, sf)))


@query("canary_controls", """
SELECT target, control, COUNT(*) AS rows, COUNT(*) FILTER (WHERE control <> 'unchanged') AS rejected_rows, '' AS identifiers_used, TRUE AS passed
FROM v_cases, (VALUES ('future_status_canary'), ('accepted_price_canary'), ('identifier_memorization_canary'), ('artifact_name_leakage_canary'), ('unchanged')) AS c(control) GROUP BY ALL""")
def _(spark, sf):
    names = ["category", "condition", "round_number", "offer_to_asking_ratio"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    return G.canary_controls(cases_of(spark, sf).select("target", F.create_map(*pairs).alias("features")), "features", ["target"], used=names)


@query("training_lineage", """
SELECT COUNT(*) AS training_rows, SUM(('0x' || substr(sha256(row_id), 1, 15))::BIGINT)::VARCHAR AS row_hash,
       SUM(('0x' || substr(sha256(concat_ws(chr(31), row_id, category, COALESCE(condition, ''), round_number)), 1, 15))::BIGINT)::VARCHAR AS feature_hash
FROM v_cases WHERE outcome_state = 'supervised'""")
def _(spark, sf):
    return G.lineage(cases_of(spark, sf).filter("outcome_state = 'supervised'"), "row_id", ["category", "condition", "round_number"])


view("v_tokens", """
SELECT row_id, target, sha256('content|' || concat_ws(chr(31), category, COALESCE(condition, ''), round_number, listing_id)) AS content_token,
       sha256('source|' || thread_id) AS source_token FROM v_cases WHERE target = 'agreement'""")
view("v_spent", "SELECT sha256('source|' || CAST(o_orderkey AS STRING)) AS token FROM orders WHERE o_orderpriority = '1-URGENT'")


def _tokens(spark, sf):
    c = one_target(spark, sf, "agreement")
    spent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.sha2(F.concat(F.lit("source|"), F.col("o_orderkey").cast("string")), 256).alias("token"))
    return G.case_tokens(c, ["category", "condition", "round_number", "listing_id"], "thread_id"), spent


@query("exclude_tokens", """
SELECT row_id, content_token, source_token FROM v_tokens WHERE source_token NOT IN (SELECT token FROM v_spent)
  AND content_token NOT IN (SELECT token FROM v_spent)""")
def _(spark, sf):
    cases, spent = _tokens(spark, sf)
    return G.exclude_tokens(cases, spent, strict=False).select("row_id", "content_token", "source_token")


@query("token_overlap", "SELECT COUNT(DISTINCT source_token) AS overlap FROM v_tokens WHERE source_token IN (SELECT token FROM v_spent)")
def _(spark, sf):
    return G.token_overlap(*_tokens(spark, sf))

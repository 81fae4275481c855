"""Sources, cleaning, privacy and text over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from haggle.functions.scalar import partition_id, row_hash
from haggle.operators import privacy as V
from haggle.operators import quality as Q
from haggle.operators import text as X
from haggle.plans.learning import norm_listings, norm_turns
from haggle.plans.registry import query, staged, view
from haggle.session import scratch_path, written
from haggle.sources import files as S
from haggle.sources.tables import listings_view, table, thread_probe, turns_view

#: Rows of a file of the text source; a packed file is read by one task.
FILE_ROWS = 100_000

T_DATE, T_TIME = "ddMMMyyyy", "ddMMMyyyy HH:mm:ss"


def raw_threads(spark, sf):
    """The turns written as the 16-column text source, with faulty rows."""
    t = turns_view(spark, sf)
    k = F.col("l_partkey")
    stamp = lambda c, f: F.coalesce(F.lower(F.date_format(c, f)), F.lit(""))
    cells = {
        "anon_item_id": F.col("listing_id"), "anon_thread_id": F.when(k % 97 == 0, "").otherwise(F.col("thread_id")), "anon_byr_id": F.col("buyer_id"), "anon_slr_id": F.lit("s1"),
        "src_cre_dt": stamp("event_time", T_DATE), "fdbk_score_src": F.col("l_linenumber").cast("string"), "fdbk_pstv_src": F.lit("99.5"), "offr_type_id": F.col("offer_type").cast("string"),
        "status_id": F.when(k % 89 == 0, "5").otherwise(F.col("status_id").cast("string")), "offr_price": F.coalesce(F.col("offer_price").cast("string"), F.lit("")),
        "src_cre_date": stamp("event_time", T_TIME), "response_time": stamp("response_time", T_TIME), "slr_hist": F.col("l_suppkey").cast("string"), "byr_hist": F.col("l_partkey").cast("string"),
        "any_mssg": F.when(k % 79 == 0, "2").otherwise((k % 2).cast("string")), "byr_us": F.lit("1")}
    # a row that comes twice is made where it is read, so that the turns are joined once
    twice = t.withColumn("_copy", F.explode(F.when(k % 83 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return twice.select(*[c.alias(n) for n, c in cells.items()])


view("v_raw", """SELECT *, l_partkey % 97 = 0 AS blank, l_partkey % 89 = 0 AS odd, l_partkey % 79 = 0 AS flag FROM v_turns""")


def staged_threads(spark, sf):
    """The text source as packed CSV files in the shared folder, written where the turns lie: the text
    is several times as large as the tables, so it is neither shuffled nor stored as it is."""
    def write(path: str) -> None:
        raw_threads(spark, sf).write.option("header", True).option("emptyValue", "").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).csv(path)

    return S.read_threads(spark, staged(spark, sf, "threads-csv", ("lineitem", "orders"), write)).drop(S.CORRUPT)


@query("read_threads", "SELECT listing_id AS anon_item_id, COUNT(*) + COUNT(*) FILTER (WHERE l_partkey % 83 = 0) AS rows, COUNT(offer_price) + COUNT(offer_price) FILTER (WHERE l_partkey % 83 = 0) AS priced FROM v_turns GROUP BY 1")
def _(spark, sf):
    return staged_threads(spark, sf).groupBy("anon_item_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.nullif("offr_price", F.lit(""))).alias("priced"))


@query("quarantine", """SELECT reason, COUNT(*) + COUNT(*) FILTER (WHERE l_partkey % 83 = 0) AS rows, LEAST(25, COUNT(*) + COUNT(*) FILTER (WHERE l_partkey % 83 = 0))::INTEGER AS examples FROM (
  SELECT *, CASE WHEN blank THEN 'missing_required_thread_identifier' WHEN odd THEN 'unknown_status_id' END AS reason FROM v_raw) t WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    _, _, summary = Q.quarantine(raw_threads(spark, sf), Q.thread_rules())
    return summary.select("reason", "rows", F.size("example_hashes").alias("examples"))


@query("drop_exact_duplicates", "SELECT COUNT(*) FILTER (WHERE l_partkey % 83 = 0) AS duplicates FROM v_turns")
def _(spark, sf):
    return Q.drop_exact_duplicates(raw_threads(spark, sf))[1]


@query("normalize_turns", """SELECT thread_id, turn_index, actor, action, amount, event_time, response_time, has_message, status FROM (
  SELECT thread_id, ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY event_time, offer_type, offer_price NULLS FIRST, rh)::INTEGER AS turn_index, CASE offer_type WHEN 2 THEN 'seller' ELSE 'buyer' END AS actor, CASE offer_type WHEN 0 THEN 'offer' ELSE 'counter' END AS action,
    offer_price AS amount, event_time, response_time, l_partkey % 2 = 1 AS has_message, flag, CASE status_id WHEN 0 THEN 'expired' WHEN 1 THEN 'accepted' WHEN 2 THEN 'declined' WHEN 6 THEN 'auto_declined' WHEN 7 THEN 'countered' WHEN 8 THEN 'declined_other_buyer_accepted' ELSE 'auto_accepted' END AS status
  FROM (SELECT *, l_linenumber AS rh FROM v_raw WHERE NOT blank AND NOT odd) a) t WHERE NOT flag""", "amount")
def _(spark, sf):
    good, _, _ = Q.quarantine(staged_threads(spark, sf), Q.thread_rules())
    probe = thread_probe(spark, sf).select(F.col("thread_id"))
    return Q.normalize_turns(good, drop_duplicates=True, probe=probe)[0].select("thread_id", "turn_index", "actor", "action", "amount", F.to_timestamp_ntz(F.col("event_time").cast("string")).alias("event_time"),
                                             F.to_timestamp_ntz(F.col("response_time").cast("string")).alias("response_time"), "has_message", "status")


def raw_listings(spark, sf):
    d = listings_view(spark, sf)
    cells = {c: F.lit("") for c in S.LISTING_COLUMNS}
    cells |= {"anon_item_id": F.col("listing_id"), "anon_slr_id": F.col("seller_id"), "anon_leaf_categ_id": F.col("category"), "anon_product_id": F.when(F.col("bo_ck") == 1, "547957").otherwise("77"),
              "start_price_usd": F.coalesce(F.col("start_price").cast("string"), F.lit("")), "item_price": F.coalesce(F.col("item_price").cast("string"), F.lit("")), "bo_ck_yn": F.when(F.col("seller_id") == "3", "y").otherwise(F.col("bo_ck").cast("string")),
              "auct_start_dt": F.lit("01may2012"), "count4": F.coalesce(F.col("count4").cast("string"), F.lit("")), "anon_buyer_id": F.coalesce("buyer_id", F.lit(""))}
    return d.select(*[cells[c].alias(c) for c in S.LISTING_COLUMNS])


@query("normalize_listings", """SELECT listing_id, seller_id, category, CASE WHEN bo_ck = 1 THEN NULL ELSE '77' END AS product_id, start_price AS listing_price, item_price AS final_sale_price, bo_ck = 1 AS sold_by_best_offer,
  CAST(count4 AS BIGINT) AS excluded_reference_count4, buyer_id AS buyer_id_if_sold FROM v_listings WHERE seller_id <> '3'""", "listing_price final_sale_price")
def _(spark, sf):
    path = scratch_path(spark, "listings-csv")
    raw_listings(spark, sf).write.option("header", True).option("emptyValue", "").csv(path)
    raw = S.read_listings(spark, path).drop(S.CORRUPT)
    return Q.normalize_listings(raw)[0].select("listing_id", "seller_id", "category", "product_id", "listing_price", "final_sale_price", "sold_by_best_offer", "excluded_reference_count4", "buyer_id_if_sold")


@query("dedupe_key", "SELECT o_custkey, MIN(o_orderkey) AS o_orderkey, COUNT(*) - 1 AS later FROM orders GROUP BY 1")
def _(spark, sf):
    kept, dups = Q.dedupe_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    n = dups.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("later"))
    return kept.join(n, "o_custkey", "left").select("o_custkey", "o_orderkey", F.coalesce("later", F.lit(0)).alias("later"))


@query("limit_threads", "SELECT l_orderkey, COUNT(*) AS rows FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey, MIN((l_shipdate, l_orderkey)) AS o FROM lineitem GROUP BY 1) t ORDER BY o LIMIT 500) GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_shipdate", "l_orderkey").alias("o"))
    return Q.limit_threads(d, "l_orderkey", "o", 500).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"))


@query("linked_listings", "SELECT COUNT(DISTINCT t.listing_id) AS referenced, COUNT(DISTINCT l.listing_id) AS matched, COUNT(DISTINCT t.listing_id) - COUNT(DISTINCT l.listing_id) AS unmatched FROM v_nturns t LEFT JOIN (SELECT * FROM v_nlistings WHERE category <> 'BUILDING') l ON l.listing_id = t.listing_id")
def _(spark, sf):
    return Q.linked_listings(norm_listings(spark, sf).filter("category <> 'BUILDING'"), norm_turns(spark, sf))[1]


@query("normalization_summary", """
SELECT 'turns' AS section, 'rows' AS key, CAST(COUNT(*) AS STRING) AS value FROM v_nturns UNION ALL SELECT 'turns', 'distinct_thread_id', CAST(COUNT(DISTINCT thread_id) AS STRING) FROM v_nturns UNION ALL SELECT 'turns', 'distinct_listing_id', CAST(COUNT(DISTINCT listing_id) AS STRING) FROM v_nturns
UNION ALL SELECT 'turns', 'distinct_buyer_id', CAST(COUNT(DISTINCT buyer_id) AS STRING) FROM v_nturns UNION ALL SELECT 'listings', 'rows', CAST(COUNT(*) AS STRING) FROM v_nlistings UNION ALL SELECT 'listings', 'distinct_listing_id', CAST(COUNT(DISTINCT listing_id) AS STRING) FROM v_nlistings
UNION ALL SELECT 'listings', 'distinct_seller_id', CAST(COUNT(DISTINCT seller_id) AS STRING) FROM v_nlistings UNION ALL SELECT 'listings', 'distinct_category', CAST(COUNT(DISTINCT category) AS STRING) FROM v_nlistings
UNION ALL SELECT 'top_category', category, CAST(COUNT(*) AS STRING) FROM v_nlistings GROUP BY category UNION ALL SELECT 'status', status, CAST(COUNT(*) AS STRING) FROM v_nturns GROUP BY status UNION ALL SELECT 'action', action, CAST(COUNT(*) AS STRING) FROM v_nturns GROUP BY action
UNION ALL SELECT 'turns', 'event_time_min', strftime(MIN(event_time), '%Y-%m-%d %H:%M:%S') FROM v_nturns UNION ALL SELECT 'turns', 'event_time_max', strftime(MAX(event_time), '%Y-%m-%d %H:%M:%S') FROM v_nturns
UNION ALL SELECT 'turns', 'response_time_min', strftime(MIN(response_time), '%Y-%m-%d %H:%M:%S') FROM v_nturns UNION ALL SELECT 'turns', 'response_time_max', strftime(MAX(response_time), '%Y-%m-%d %H:%M:%S') FROM v_nturns""")
def _(spark, sf):
    return Q.normalization_summary(norm_turns(spark, sf), norm_listings(spark, sf))


# quoted cells with separators, quotes and line feeds; rows of a cell too many; a row equal to the header
_FINE, _DATED = "o_orderkey % 10 <> 0", "o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0"
@query("profile_csv", f"""SELECT COUNT(*) FILTER (WHERE {_FINE}) + COUNT(*) FILTER (WHERE o_orderkey % 97 = 0) AS accepted_rows, COUNT(*) FILTER (WHERE NOT ({_FINE})) AS rejected_rows, COUNT(*) FILTER (WHERE {_DATED}) AS dated_rows,
  MIN(o_orderdate) FILTER (WHERE {_DATED}) AS min_date, MAX(o_orderdate) FILTER (WHERE {_DATED}) AS max_date, sha256('key,date,note') AS header_hash FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    when = F.when(k % 7 == 0, "never").when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.lower(F.date_format("o_orderdate", "ddMMMyyyy"))).otherwise(F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('"')))
    note = F.when(k % 10 == 0, "a,b").when(k % 4 == 0, '"a, ""b"", c"').when(k % 9 == 0, '"one\ntwo, three\n\nfour"').otherwise("a")
    path = scratch_path(spark, "profile")
    line = F.concat_ws(",", k.cast("string"), when, note)
    # as one file: the header first, now and then a row like it
    like_header = F.when(k % 97 == 0, F.concat(line, F.lit("\nkey,date,note"))).otherwise(line)
    head = spark.range(1).select(F.lit("key,date,note").alias("value"))
    head.unionByName(table(spark, sf, "orders").select(like_header.alias("value"))).coalesce(1).write.text(path)
    p = Q.profile_csv(spark, path, 3, 1)
    return p.select("accepted_rows", "rejected_rows", "dated_rows", F.to_timestamp_ntz(F.col("min_date").cast("string")).alias("min_date"), F.to_timestamp_ntz(F.col("max_date").cast("string")).alias("max_date"), "header_hash")


@query("sample_n", "SELECT o_orderkey FROM orders ORDER BY sha256('7|' || o_orderkey), o_orderkey LIMIT 100")
def _(spark, sf):
    return Q.sample_n(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@query("chronological_samples", """WITH m AS (SELECT (MIN(epoch_us(ts)) + MAX(epoch_us(ts))) / 2 AS mid FROM events)
SELECT * FROM (SELECT event_id, 'earliest' AS slice FROM events ORDER BY ts, event_id LIMIT 20) a UNION ALL SELECT * FROM (SELECT event_id, 'latest' FROM events ORDER BY ts DESC, event_id LIMIT 20) b
UNION ALL SELECT * FROM (SELECT event_id, 'midpoint' FROM events, m ORDER BY ABS(epoch_us(ts) - mid), event_id LIMIT 20) c""")
def _(spark, sf):
    return Q.chronological_samples(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id", 20).select("event_id", "slice")


@query("redact", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS c_name FROM customer")
def _(spark, sf):
    return Q.redact(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"])


@query("row_hash", "SELECT o_orderkey, upper(sha256(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus, o_orderpriority))) AS h FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", row_hash(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("h"))


@query("partition_id", """SELECT o_orderkey, list_reduce(list_transform(range(8), lambda i: ('0x' || substr(sha256(CAST(o_orderkey AS STRING)), (1 + 8 * i)::INTEGER, 8))::BIGINT), lambda a, x: (a * (4294967296 % 37) + x) % 37, 0::BIGINT)::BIGINT AS bucket FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", partition_id(F.col("o_orderkey"), 37).alias("bucket"))


@query("write_table", "SELECT listing_id, COUNT(*) AS turns FROM v_nturns GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "turns")
    S.write_table(norm_turns(spark, sf), path, "listing_id", 8)
    return S.read_table(spark, path).groupBy("listing_id").agg(F.count(F.lit(1)).alias("turns"))


@query("verify_partitions", """
WITH p AS (SELECT 'part=' || (o_orderkey % 6) AS partition, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT 'part=ghost' AS partition, 'missing_partition' AS failure, 7::BIGINT AS listed_rows, NULL::BIGINT AS found_rows
UNION ALL SELECT partition, 'unknown_partition', NULL, n FROM p WHERE partition = 'part=1' UNION ALL SELECT partition, 'hash_mismatch', n, n FROM p WHERE partition = 'part=2'
UNION ALL SELECT partition, 'duplicate_partition', n, n FROM p WHERE partition = 'part=3' UNION ALL SELECT partition, 'row_count_mismatch', n + 1, n FROM p WHERE partition = 'part=4'
UNION ALL SELECT '(table)', 'row_sum_mismatch', CAST((SELECT SUM(n) FROM p WHERE partition <> 'part=1') + (SELECT n FROM p WHERE partition = 'part=3') + 8 AS BIGINT), CAST((SELECT SUM(n) FROM p) AS BIGINT)""")
def _(spark, sf):
    path = scratch_path(spark, "orders")
    table(spark, sf, "orders").withColumn("part", F.col("o_orderkey") % 6).repartition(3).write.partitionBy("part").parquet(path)
    S.write_manifest(spark, path)
    whole = spark.read.parquet(f"{path}/_manifest")
    part, rows = F.col("partition"), F.col("rows")
    edited = whole.where(part != "part=1").withColumns({"sha256": F.when(part == "part=2", F.lit("0")).otherwise(F.col("sha256")), "rows": F.when(part == "part=4", rows + 1).otherwise(rows)})
    edited = edited.unionByName(whole.where(part == "part=3")).unionByName(whole.limit(1).select(F.lit("part=ghost").alias("partition"), F.lit(7).cast("long").alias("rows"), F.lit("0").alias("sha256")))
    return Q.verify_partitions(Q.partition_hashes(spark, path), edited).unionByName(S.check_table(spark, path))


@query("validate_pilot", """SELECT reason, COUNT(*) AS rows FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'available_before_event' WHEN o_orderkey % 11 = 0 THEN 'response_before_event' WHEN o_orderkey % 13 = 0 THEN 'bad_currency' WHEN o_orderkey % 17 = 0 THEN 'negative_money' WHEN o_orderkey % 19 = 0 THEN 'negative_count' END AS reason FROM orders) t WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    day = F.expr("INTERVAL '1' DAY")
    d = table(spark, sf, "orders").select("o_orderkey", t.alias("event_time"), F.when(k % 7 == 0, t - day).otherwise(t).alias("available_at"), F.when(k % 11 == 0, t - day).otherwise(t).alias("response_time"),
                                          F.when(k % 13 == 0, "usd").otherwise("USD").alias("currency"), F.when(k % 17 == 0, -1.0).otherwise(1.0).alias("amount"), F.when(k % 19 == 0, -1).otherwise(1).alias("quantity"))
    return Q.quarantine(d, Q.pilot_rules(["amount"], ["quantity"]))[2].select("reason", "rows")


@query("validate_snapshots", """SELECT reason, COUNT(*) AS rows FROM (SELECT CASE WHEN CAST(decision_id AS BIGINT) % 7 = 0 THEN 'cutoff_after_decision' WHEN CAST(decision_id AS BIGINT) % 11 = 0 THEN 'action_not_available' WHEN CAST(decision_id AS BIGINT) % 13 = 0 AND buyer_offer_amount IS NOT NULL THEN 'ratio_mismatch' WHEN returned AND NOT buyer_paid THEN 'outcome_inconsistent' END AS reason FROM v_snap) t WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from haggle.plans.market import snapshots

    s = snapshots(spark, sf)
    k = F.col("decision_id").cast("long")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    d = s.withColumns({"decision_time": at, "observation_cutoff": F.when(k % 7 == 0, at + F.expr("INTERVAL '1' DAY")).otherwise(at), "action": F.when(k % 11 == 0, "auction").otherwise(F.col("action")),
                       "offer_to_asking_ratio": F.when(k % 13 == 0, F.col("offer_to_asking_ratio") + 0.1).otherwise(F.col("offer_to_asking_ratio"))})
    return Q.quarantine(d, Q.snapshot_rules())[2].select("reason", "rows")


@query("validate_offer_events", """SELECT reason, COUNT(*) AS rows FROM (SELECT CASE WHEN event_type = 'merchant_decision' AND k % 21 = 0 THEN 'decision_without_action' WHEN event_type = 'outcome_matured' AND k % 5 <> 0 AND k % 13 = 0 THEN 'paid_and_cancelled' WHEN event_type = 'outcome_matured' AND k % 7 = 0 THEN 'margin_mismatch' END AS reason FROM v_offer_rows) t WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from haggle.plans.market import offer_events

    e = offer_events(spark, sf).withColumns({"fees": F.lit(0.0), "cost": F.coalesce("cost_basis", F.lit(0.0))})
    k = F.col("offer_id").cast("long")
    e = e.withColumn("selected_action", F.when(k % 21 != 0, F.col("selected_action")))
    return Q.quarantine(e, Q.offer_event_rules())[2].select("reason", "rows")


@query("validate_episodes", """SELECT reason, COUNT(*) AS rows FROM (SELECT CASE WHEN event_type = 'error' THEN 'no_features' WHEN event_id % 7 = 0 THEN 'outcome_before_decision' WHEN event_id % 11 = 0 THEN 'source_hash_mismatch' END AS reason FROM events) t WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    k, t = F.col("event_id"), F.col("ts").cast("timestamp")
    body = F.coalesce("props", F.lit("{}"))
    d = table(spark, sf, "events").select(k.cast("string").alias("episode_id"), t.alias("decision_time"), F.when(k % 7 == 0, t - F.expr("INTERVAL '1' DAY")).otherwise(t).alias("outcome_time"), body.alias("body"),
                                          F.when(F.col("event_type") == "error", F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("value"), F.coalesce("value", F.lit(0.0)))).alias("features"),
                                          F.when(k % 11 == 0, "x").otherwise(F.sha2(body, 256)).alias("source_hash"))
    return Q.quarantine(d, Q.episode_rules(F.col("body")))[2].select("reason", "rows")


@query("validate_research", """SELECT reason, COUNT(*) AS rows FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'missing_pseudonym' WHEN event_id % 11 = 0 THEN 'money_without_minor_units' WHEN event_id % 13 = 0 THEN 'fractional_number' END AS reason FROM events) t WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    k = F.col("event_id")
    p = F.when(k % 7 == 0, "raw").otherwise(F.concat(F.lit("cp_buyer_"), F.substring(F.sha2(k.cast("string"), 256), 1, 32)))
    body = F.concat(F.lit('{"buyer_pseudonym":"'), p, F.lit('",'), F.when(k % 11 == 0, '"sale_price":12').when(k % 13 == 0, '"ratio":0.5').otherwise('"price_minor":1200'), F.lit("}"))
    return Q.quarantine(table(spark, sf, "events").select(k, body.alias("payload")), Q.research_rules("payload"))[2].select("reason", "rows")


@query("capture_status", """SELECT event_type AS phase, COUNT(*) AS episodes, SUM(CASE WHEN event_id % 2 = 0 AND ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 0 END)::BIGINT AS overdue, SUM(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS missed FROM events GROUP BY 1""")
def _(spark, sf):
    f = F.array(F.struct((F.col("ts").cast("timestamp") + F.expr("INTERVAL '1' DAY")).alias("due"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("missed").alias("status")))
    return Q.capture_status(table(spark, sf, "events").select(F.col("event_type").alias("phase"), F.col("event_id").alias("episode_id"), f.alias("followups")), "2024-01-10 00:00:00")


# ---- webhooks and offers: payloads cut from orders

_REF = "'sha256:' || sha256(CAST({} AS STRING))"


@query("normalize_orders", f"""SELECT CAST(o_orderkey AS STRING) AS delivery_id, 't' || o_custkey AS transaction_id, {_REF.format('o_orderkey')} AS order_reference_hash, CAST(round(o_totalprice * 100) AS BIGINT) AS order_total_minor, CAST(500 AS BIGINT) AS shipping_total_minor, 'USD' AS currency, o_orderstatus = 'F' AS paid, o_orderkey % 3 <> 0 AS production_evidence FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit("usd").alias("currency"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total_price"), (F.col("o_orderkey") % 3 == 0).alias("test"),
                              F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending").alias("financial_status"), F.struct(F.struct(F.lit("5.00").alias("amount")).alias("shop_money")).alias("total_shipping_price_set"),
                              F.array(F.struct(F.lit("other").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("transaction_id").alias("name"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("value"))).alias("note_attributes")))
    d = S.normalize_orders(o.select(F.col("o_orderkey").cast("string").alias("delivery_id"), body.alias("payload")))
    return d.select("delivery_id", "transaction_id", "order_reference_hash", "order_total_minor", "shipping_total_minor", "currency", "paid", "production_evidence")


@query("normalize_refunds", f"""SELECT CAST(o_orderkey AS STRING) AS delivery_id, {_REF.format('o_custkey')} AS order_reference_hash, CASE o_orderkey % 4 WHEN 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) WHEN 1 THEN CAST(round(o_totalprice * 100) AS BIGINT) + 25 END AS refund_total_minor, CASE WHEN o_orderkey % 4 = 0 THEN 'USD' END AS currency,
  CASE o_orderkey % 4 WHEN 0 THEN 'successful_refund_transactions' WHEN 1 THEN 'refund_line_items' WHEN 2 THEN 'successful_refund_transactions' ELSE 'unavailable' END AS refund_amount_source FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    tx = lambda st, cur: F.struct(F.lit("refund").alias("kind"), F.lit(st).alias("status"), price.alias("amount"), F.lit(cur).alias("currency"))
    txs = F.when(k == 0, F.array(tx("success", "usd"), tx("failure", "usd"))).when(k == 2, F.array(tx("success", "usd"), tx("success", "eur"))).otherwise(F.array(tx("failure", "usd")))
    lines = F.when(k == 1, F.array(F.struct(price.alias("subtotal"), F.lit("0.25").alias("total_tax")))).otherwise(F.array().cast("array<struct<subtotal:string,total_tax:string>>"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("order_id"), txs.alias("transactions"), lines.alias("refund_line_items")))
    return S.normalize_refunds(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("delivery_id"), body.alias("payload"))).drop("refund_reference_hash")


@query("normalize_returns", f"SELECT CAST(o_orderkey AS STRING) AS delivery_id, {_REF.format('o_custkey')} AS order_reference_hash, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS return_status, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS return_exposure_state, o_orderkey % 5 AS total_return_line_items FROM orders")
def _(spark, sf):
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), (F.col("o_orderkey") % 5).alias("total_return_line_items")))
    return S.normalize_returns(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("delivery_id"), body.alias("payload"))).drop("return_reference_hash")


@query("normalize_webhooks", """SELECT CAST(o_orderkey AS STRING) AS delivery_id, CASE o_orderkey % 6 WHEN 0 THEN 'order_created' WHEN 1 THEN 'paid' WHEN 2 THEN 'fully_refunded' WHEN 3 THEN 'return_opened' WHEN 4 THEN 'payment_pending' END AS transition_to, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
  CASE WHEN o_orderkey % 6 = 5 THEN 'unknown_topic' WHEN o_orderkey % 7 = 0 THEN 'missing_time' WHEN o_orderkey % 11 = 0 THEN 'stale' ELSE 'accepted' END AS delivery_state FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    topics = F.array(*[F.lit(t) for t in ("orders/create", "orders.paid", "refunds/create", "RETURNS/REQUEST", "orders/updated", "shop/update")])
    money = F.when(k % 6 == 1, "paid").when(k % 6 == 4, "partially_paid")
    body = F.to_json(F.struct(k.alias("id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total_price"), money.alias("financial_status"), F.when(k % 6 == 2, "full").alias("refund_status"),
                              F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at")))
    d = table(spark, sf, "orders").select(k.cast("string").alias("delivery_id"), topics[(k % 6).cast("int")].alias("topic"), body.alias("payload"),
                                          (F.col("o_orderdate").cast("timestamp") + F.when(k % 11 == 0, F.expr("INTERVAL '3' DAY")).otherwise(F.expr("INTERVAL '0' DAY"))).alias("received_at"))
    return S.normalize_webhooks(d).select("delivery_id", "transition_to", "amount_minor", "delivery_state")


@query("normalize_offers", """SELECT CAST(o_orderkey AS STRING) AS delivery_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unexpected_field' WHEN o_orderkey % 11 = 0 THEN 'bad_amount' WHEN o_orderkey % 13 = 0 THEN 'bad_currency' WHEN o_orderkey % 17 = 0 THEN 'bad_quantity' END AS reason,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS offer_amount_minor, 'sha256:' || sha256('a' || o_custkey || '@x.org') AS buyer_contact_reference FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.when(k % 11 == 0, "12,50").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("offer_amount"), F.when(k % 13 == 0, "usd").otherwise("USD").alias("currency"),
                              F.when(k % 17 == 0, "0").otherwise("2").alias("quantity"), F.concat(F.lit(" A"), F.col("o_custkey").cast("string"), F.lit("@X.org")).alias("buyer_contact"), F.when(k % 7 == 0, "x").alias("admin")))
    return S.normalize_offers(table(spark, sf, "orders").select(k.cast("string").alias("delivery_id"), body.alias("payload"))).select("delivery_id", "reason", "offer_amount_minor", "buyer_contact_reference")


@query("read_events", "SELECT user_id % 3 AS m, COUNT(*) AS records FROM events WHERE event_type = 'purchase' GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "log")
    e = table(spark, sf, "events")
    log = e.select(F.col("event_id").cast("string").alias("record_id"), F.col("event_type").alias("record_type"), F.col("ts").cast("timestamp").alias("written_at"),
                   F.to_json(F.struct((F.col("user_id") % 3).cast("string").alias("merchant_id"), "value")).alias("payload"))
    log.write.json(path)
    return S.read_events(spark, path, "purchase").groupBy(F.get_json_object("payload", "$.merchant_id").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("records"))


@query("read_snapshots", "SELECT CAST(o_orderkey AS STRING) AS decision_id, CAST(2 AS INTEGER) AS actions, o_orderpriority AS category FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "snap") + ".jsonl"
    act = F.struct(F.lit("accept").alias("action"), F.col("o_totalprice").alias("amount"))
    table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("decision_id"), F.create_map(F.lit("category"), F.col("o_orderpriority")).alias("pre_decision_context"),
                                      F.array(act, act).alias("available_actions"), act.alias("action_taken")).write.json(path)
    return S.read_snapshots(spark, path).select("decision_id", F.size("available_actions").alias("actions"), F.element_at("pre_decision_context", "category").alias("category"))


@query("apply_mapping", "SELECT CAST(c_custkey AS STRING) AS listing_id, NULLIF(trim(CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END), '') AS category FROM customer")
def _(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("Item"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("Cat"), F.lit("x").alias("Extra"))
    return S.apply_mapping(d, {"Item": "listing_id", "Cat": "category", "Extra": "ignore"}, ["listing_id"], ["category"])


# ---- privacy and text

# the postal, commerce and url patterns have no look-around and are the operator's own
_DUCK = {k: V.VALUE_PATTERNS[k].replace("'", "''") for k in ("postal address", "commerce identifier", "url")} | {"email address": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "phone number": r"(^|[^0-9])(\+?1[-.\s]?)?(\(\d{3}\)\s*|\d{3}[-.\s]?)\d{3}[-.\s]?\d{4}($|[^0-9])", "ip address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b"}


@query("pii_findings", " UNION ALL ".join(f"SELECT 'text' AS path, '{k}' AS kind, COUNT(*) AS rows FROM documents WHERE regexp_matches(text, '{p}') HAVING COUNT(*) > 0" for k, p in _DUCK.items()))
def _(spark, sf):
    return V.pii_findings(table(spark, sf, "documents").select("text"), ["text"])


@query("pii_findings_pages")
def _(spark, sf):
    return V.pii_findings(table(spark, sf, "pages").select("url", "html"), ["url", "html"])


@query("report_leaks", r"""SELECT 'raw commerce identifier' AS leak, COUNT(*) FILTER (WHERE regexp_matches(text, 'gid://shopify/')) AS rows FROM documents UNION ALL SELECT 'checkout or order url', COUNT(*) FILTER (WHERE regexp_matches(text, 'https?://\S+')) FROM documents
UNION ALL SELECT 'email address', COUNT(*) FILTER (WHERE regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) FROM documents UNION ALL SELECT 'phone number', COUNT(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])(\+?1[-.\s]?)?(\(\d{3}\)\s*|\d{3}[-.\s]?)\d{3}[-.\s]?\d{4}($|[^0-9])')) FROM documents
UNION ALL SELECT 'raw token', COUNT(*) FILTER (WHERE regexp_matches(text, '(?i)\b(?:access|refresh|token|secret)[-_A-Za-z0-9]{8,}\b')) FROM documents""")
def _(spark, sf):
    return V.report_leaks(table(spark, sf, "documents"), "text")


# names at three levels: of a buyer's object only the parts above tell that "handle" and "id" are a person's
@query("pii_json_keys", """
SELECT key, COUNT(*) AS rows FROM (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'buyer_name' ELSE 'contact_email' END AS key FROM events
  UNION ALL SELECT 'handle' FROM events WHERE user_id % 3 = 0
  UNION ALL SELECT 'id' FROM events WHERE user_id % 3 = 0
  UNION ALL SELECT 'payment_id' FROM events WHERE user_id % 5 = 0) GROUP BY 1""")
def _(spark, sf):
    deep = F.when(F.col("user_id") % 3 == 0, '"buyer":[{"handle":"h","ref":{"id":1,"hashed_id":2}}]').otherwise('"offer":[{"handle":"h","ref":{"id":1}}]')
    paid = F.when(F.col("user_id") % 5 == 0, ',"x":[[{"payment_id":3}]]').otherwise(',"x":[[{"payment_kind":3}]]')
    body = F.concat(F.lit('{"a":{"'), F.when(F.col("user_id") % 2 == 0, "buyer_name").otherwise("contact_email"), F.lit('":"x"},"hashed_buyer_id":1,"amount":2,'), deep, paid, F.lit("}"))
    return V.pii_json_keys(table(spark, sf, "events").select(body.alias("j")), "j")


_KEY = b"rotation-secret"
_PADK = _KEY.ljust(64, b"\0")
_IPAD, _OPAD = bytes(b ^ 0x36 for b in _PADK).hex(), bytes(b ^ 0x5C for b in _PADK).hex()


@query("pseudonymize", f"""SELECT c_custkey, 'cp_buyer_' || substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode('{{"merchant_id":"m' || (c_custkey % 3) || '","namespace":"buyer","raw_identifier":"' || c_name || '","rotation_id":"r1","store_id":"s"}}')))), 1, 32) AS pseudonymous_id FROM customer""")
def _(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("m"), (F.col("c_custkey") % 3).cast("string")).alias("merchant_id"), F.lit("s").alias("store_id"))
    return V.pseudonymize(d, "c_name", "Buyer", _KEY, "r1").select("c_custkey", "pseudonymous_id")


view("v_consent", """SELECT 'm' || (user_id % 20) AS merchant_id, 's' AS store_id, event_id, ts AS granted_at, event_type IN ('signup', 'purchase') AS g, event_type = 'error' AS b, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 6 HOUR END AS revoked_at, lpad(CAST(event_id AS STRING), 12, '0') AS record_id
FROM events WHERE event_type IN ('signup', 'purchase', 'error')""")


def consents(spark, sf):
    e = table(spark, sf, "events").filter("event_type IN ('signup', 'purchase', 'error')")
    t = F.col("ts").cast("timestamp")
    p, none = F.array(F.lit("training")), F.array().cast("array<string>")
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("merchant_id"), F.lit("s").alias("store_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("record_id"), t.alias("granted_at"),
                    F.when(F.col("event_type") == "error", none).otherwise(p).alias("granted_purposes"), F.when(F.col("event_type") == "error", p).otherwise(none).alias("prohibited_purposes"),
                    F.when(F.col("event_id") % 5 == 0, t + F.expr("INTERVAL '6' HOUR")).alias("revoked_at"))


@query("consent_at", """SELECT merchant_id, store_id, arg_max(g AND NOT COALESCE(revoked_at <= TIMESTAMP '2024-01-12 00:00:00', FALSE), (granted_at, CASE WHEN b THEN 2 ELSE 1 END, record_id)) AS active FROM v_consent WHERE granted_at <= TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1, 2""")
def _(spark, sf):
    return V.consent_at(consents(spark, sf), "training", "2024-01-12 00:00:00")


@query("consent_as_of", """SELECT e.merchant_id, 's' AS store_id, CAST(e.event_id AS STRING) AS event_id, COALESCE(arg_max(c.g AND NOT COALESCE(c.revoked_at <= e.ts, FALSE), (c.granted_at, CASE WHEN c.b THEN 2 ELSE 1 END, c.record_id)), FALSE) AS active
FROM (SELECT *, 'm' || (user_id % 20) AS merchant_id FROM events WHERE event_type = 'view') e LEFT JOIN v_consent c ON c.merchant_id = e.merchant_id AND c.granted_at <= e.ts GROUP BY 1, 2, 3""")
def _(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'view'").select(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("merchant_id"), F.lit("s").alias("store_id"), "event_id", F.col("ts").cast("timestamp").alias("occurred_at"))
    return V.consent_as_of(e, consents(spark, sf), "training")


@query("training_dataset", """
WITH c AS (SELECT merchant_id, store_id, arg_max((record_id, revoked_at, g), (granted_at, CASE WHEN b THEN 2 ELSE 1 END, record_id)) AS l FROM v_consent WHERE granted_at <= TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1, 2),
ok AS (SELECT merchant_id, store_id, l[1] AS record_id FROM c WHERE l[3] AND NOT COALESCE(l[2] <= TIMESTAMP '2024-01-12 00:00:00', FALSE)),
e AS (SELECT event_id, 'm' || (user_id % 20) AS merchant_id FROM events),
d AS (SELECT COUNT(*) AS n, SUM(('0x' || substr(sha256('{"event_id":' || event_id || ',"merchant_id":"' || merchant_id || '","store_id":"s"}'), 1, 15))::BIGINT)::VARCHAR AS h FROM e WHERE merchant_id IN (SELECT merchant_id FROM ok))
SELECT ok.merchant_id, store_id, record_id, TRUE AS active, d.n AS event_count, sha256('cross_merchant_training|' || d.n || '|' || d.h) AS dataset_id FROM ok, d WHERE ok.merchant_id IN (SELECT merchant_id FROM e)""")
def _(spark, sf):
    """One training set of all stores that consented, with the consents behind it."""
    purpose = V.CROSS_MERCHANT
    named = lambda c: F.transform(c, lambda _: F.lit(purpose))
    c = consents(spark, sf).withColumns({k: named(F.col(k)) for k in ("granted_purposes", "prohibited_purposes")})
    e = table(spark, sf, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("merchant_id"), F.lit("s").alias("store_id"), "event_id")
    asked = V.consent_at(c, purpose, "2024-01-12 00:00:00").filter("active").select("merchant_id", "store_id")
    _, data, behind = V.training_dataset(e.join(asked, ["merchant_id", "store_id"], "left_semi"), c, purpose, "2024-01-12 00:00:00", cross=True)
    return behind.select("merchant_id", "store_id", "record_id", "active").join(F.broadcast(data.select("event_count", "dataset_id")))  # one row


@query("normalize_merchant_actions", """
SELECT CAST(o_orderkey AS STRING) AS delivery_id, reason, CASE WHEN reason IS NULL THEN CASE act WHEN 'accept' THEN 'merchant_accepted' WHEN 'counter' THEN 'merchant_countered' ELSE 'merchant_declined' END END AS transition_to,
  CASE WHEN reason IS NULL THEN 's' || o_custkey END AS store_id, CASE WHEN reason IS NULL AND act = 'counter' THEN round(o_totalprice * 100)::BIGINT END AS counter_amount_minor, CASE WHEN reason IS NULL AND act = 'counter' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' ELSE 'USD' END END AS currency FROM (
  SELECT *, CASE WHEN act = 'refund' THEN 'unknown_action' WHEN o_orderkey % 19 = 0 THEN 'not_an_object' WHEN o_orderkey % 7 = 0 THEN 'unexpected_field' WHEN o_orderkey % 11 = 0 THEN 'bad_store_id' WHEN act = 'counter' AND o_orderkey % 13 = 0 THEN 'bad_amount'
    WHEN act = 'counter' AND o_orderkey % 17 = 0 THEN 'bad_currency' END AS reason FROM (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'counter' WHEN 2 THEN 'decline' ELSE 'refund' END AS act FROM orders) a) t""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    money = F.when(k % 13 == 0, "1e3").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    code = F.when(k % 17 == 0, "U$D").when(k % 5 == 0, "eur")
    body = F.to_json(F.struct(F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" s"), F.col("o_custkey").cast("string"))).alias("store_id"), F.when(c == 1, money).alias("counter_amount"), F.when(c == 1, code).alias("currency"), F.when(k % 7 == 0, "x").alias("admin")))
    action = F.when(c == 0, "accept").when(c == 1, "counter").when(c == 2, "decline").otherwise("refund")
    return S.normalize_merchant_actions(table(spark, sf, "orders").select(k.cast("string").alias("delivery_id"), action.alias("action"), F.when(k % 19 == 0, F.lit("[1]")).otherwise(body).alias("payload")))


@query("read_pilot", """
SELECT 'orders' AS dataset, COUNT(*) AS rows, MIN(o_orderkey)::STRING AS least FROM orders UNION ALL SELECT 'offers', COUNT(*), MIN(l_orderkey)::STRING FROM lineitem
UNION ALL SELECT 'inventory', COUNT(*), MIN(p_partkey)::STRING FROM part UNION ALL SELECT 'fees', COUNT(*), MIN(s_suppkey)::STRING FROM supplier""")
def _(spark, sf):
    """Four datasets in three formats, two named by the manifest, two found by their stems."""
    home = scratch_path(spark, "pilot")
    cut = lambda name, key: table(spark, sf, name).select(F.col(key).alias("id"))
    cut("orders", "o_orderkey").write.option("header", True).csv(f"{home}/web-orders.csv")
    cut("lineitem", "l_orderkey").write.json(f"{home}/offers.jsonl")
    cut("part", "p_partkey").write.parquet(f"{home}/inventory.parquet")
    cut("supplier", "s_suppkey").write.parquet(f"{home}/charges.parquet")
    found = S.read_pilot(spark, home, {"orders": "web-orders.csv", "fees": "charges.parquet", "returns_refunds": "absent.csv"})
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("id").cast("long")).cast("string").alias("least")).withColumn("dataset", F.lit(n)) for n, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("header_reports", """SELECT 'order_matches' AS state, COUNT(DISTINCT o_orderstatus) AS files FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'missing anon_thread_id, unexpected thread', COUNT(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, sf):
    """A folder of turns per order status; in that of P one column has another name. Its files count as one where they agree."""
    home = scratch_path(spark, "headers")
    raw = turns_view(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("thread_id"), "o_orderstatus"), "thread_id")
    raw = written(raw.select("listing_id", "o_orderstatus"), "header-turns")
    cells = lambda names: [F.coalesce(F.col("listing_id"), F.lit("")).alias(n) for n in names]
    wrong = ["thread" if n == "anon_thread_id" else n for n in S.THREAD_COLUMNS]
    for state, names in (("F", S.THREAD_COLUMNS), ("O", S.THREAD_COLUMNS), ("P", wrong)):
        raw.filter(F.col("o_orderstatus") == state).select(*cells(names)).write.option("header", True).csv(f"{home}/{state}")
    r = S.header_reports(spark, f"{home}/*", S.THREAD_COLUMNS)
    state = F.when(F.col("order_matches"), "order_matches").otherwise(F.concat(F.lit("missing "), F.array_join("missing", ","), F.lit(", unexpected "), F.array_join("unexpected", ",")))
    return r.groupBy(state.alias("state")).agg(F.count_distinct(F.element_at(F.split("file", "/"), -2)).alias("files"))


@query("retention_due", "SELECT o_orderkey, o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '1996-01-01 00:00:00' AS deleted FROM orders WHERE o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '1996-01-01 00:00:00'")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '365' DAY")).alias("retention_expires_at"))
    _, stones = V.apply_deletions(d, V.retention_due(d, "1996-01-01 00:00:00"), ["o_orderkey"], "1996-01-01 00:00:00", "retention")
    return stones.select("o_orderkey", F.lit(True).alias("deleted"))


def _in(words: list[str]) -> str:
    return "(" + " OR ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in words) + ")"


_NUM = r"regexp_extract_all(text, '(?i)(?:\$|usd\s*)?(\d+(?:\.\d{1,2})?)', 1)"


def _acts(src: str, cols: str) -> str:
    return f"""SELECT {cols}, a AS offer_amount, CASE WHEN {_in(X.ACCEPT)} THEN 'accept' WHEN {_in(X.REJECT)} THEN 'reject' WHEN {_in(X.QUIT)} THEN 'quit' WHEN a IS NOT NULL AND {_in(X.COUNTER)} THEN 'counter' WHEN a IS NOT NULL THEN 'propose' ELSE 'other' END AS act,
  CONCAT_WS(',', CASE WHEN {_in(X.DELIVERY)} THEN 'delivery_or_shipping' END, CASE WHEN {_in(X.PICKUP)} THEN 'pickup_or_meetup' END, CASE WHEN {_in(X.PAYMENT)} THEN 'payment_method' END) AS side_conditions, {_in(X.CONCESSION)} AS concession
  FROM (SELECT *, {_NUM}[-1]::DOUBLE AS a FROM {src}) t"""


@query("dialogue_acts", _acts("conversations", "conv_id, turn"))
def _(spark, sf):
    return X.dialogue_acts(table(spark, sf, "conversations")).select("conv_id", "turn", "offer_amount", "act", F.array_join("side_conditions", ",").alias("side_conditions"), "concession")


@query("dialogue_acts_documents", _acts("documents", "doc_id"))
def _(spark, sf):
    return X.dialogue_acts(table(spark, sf, "documents")).select("doc_id", "offer_amount", "act", F.array_join("side_conditions", ",").alias("side_conditions"), "concession")


@query("price_sequence", f"SELECT source AS conv, doc_id AS turn, a AS offer_amount, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id, a)::INTEGER AS position FROM (SELECT *, {_NUM}[-1]::DOUBLE AS a FROM documents) t WHERE a IS NOT NULL")
def _(spark, sf):
    # the documents of a source, read as one conversation
    d = table(spark, sf, "documents").select(F.col("source").alias("conv"), F.col("doc_id").alias("turn"), "text")
    return X.price_sequence(d, "conv", "turn")


@query("act_accuracy", f"SELECT COUNT(*) AS rows, AVG(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS offer_accuracy, AVG(CASE WHEN act = 'other' THEN 1 ELSE 0 END) AS act_accuracy, COUNT(*) FILTER (WHERE len({_NUM}) > 1) AS ambiguous_rows FROM (SELECT text, offer_amount AS a, act FROM ({_acts('conversations', 'text')}) x) y", "offer_accuracy act_accuracy")
def _(spark, sf):
    d = table(spark, sf, "conversations").withColumns({"label_amount": F.lit(None).cast("double"), "label_act": F.lit("other")})
    return X.act_accuracy(d, "text", "label_amount", "label_act")

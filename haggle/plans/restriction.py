"""Restriction run: thread flags to listing sample, audits and moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from haggle.operators import sample as S
from haggle.operators import threads as T
from haggle.plans.registry import query, view
from haggle.sources.tables import TURN_ORDER, listings_view, thread_probe, turns_view

ORDINAL = TURN_ORDER[1:]


def flags_of(spark, sf):
    return T.thread_flags(turns_view(spark, sf), ORDINAL, probe=thread_probe(spark, sf))


def summary_of(spark, sf):
    return T.thread_summary(turns_view(spark, sf), ORDINAL, probe=thread_probe(spark, sf))


def sample_of(spark, sf):
    flags = T.listing_flags(flags_of(spark, sf))
    return S.sample_flags(S.listing_sample(listings_view(spark, sf), flags))


_ORDER = "event_time, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _flags_sql(order: str) -> str:
    return f"""
SELECT listing_id, buyer_id,
       SUM(CASE WHEN offer_type IN (0, 1) THEN 1 ELSE 0 END)::BIGINT AS buyer_offers,
       SUM(CASE WHEN offer_type = 2 THEN 1 ELSE 0 END)::BIGINT AS seller_offers,
       MAX(offer_price) AS max_offer,
       MAX(CASE WHEN status_id = 7 AND ((offer_type IN (0, 1) AND COALESCE(nt, -1) <> 2)
                OR (offer_type = 2 AND COALESCE(nt, -1) <> 1)) THEN 1 ELSE 0 END) AS crit_counter,
       MAX(CASE WHEN status_id IN (1, 9) AND pos < n THEN 1 ELSE 0 END) AS crit_accept,
       CASE WHEN COUNT(*) > COUNT(DISTINCT event_time) THEN 1 ELSE 0 END AS crit_duplicate_time,
       CASE WHEN SUM(CASE WHEN offer_type IN (0, 1) THEN 1 ELSE 0 END) > 3 THEN 1 ELSE 0 END AS crit_numoff_byr,
       CASE WHEN SUM(CASE WHEN offer_type = 2 THEN 1 ELSE 0 END) > 3 THEN 1 ELSE 0 END AS crit_numoff_slr
FROM (SELECT *, LEAD(offer_type) OVER w AS nt, ROW_NUMBER() OVER w AS pos,
             COUNT(*) OVER (PARTITION BY listing_id, buyer_id) AS n
      FROM v_turns WINDOW w AS (PARTITION BY listing_id, buyer_id ORDER BY {order})) t
GROUP BY listing_id, buyer_id"""


view("v_flags", _flags_sql(_ORDER))
view("v_listing_flags", """
SELECT listing_id, 1 AS has_thread, MAX(max_offer) AS max_offer,
       MAX(crit_numoff_byr) AS crit_numoff_byr, MAX(crit_numoff_slr) AS crit_numoff_slr,
       MAX(crit_counter) AS crit_counter, MAX(crit_accept) AS crit_accept,
       MAX(crit_duplicate_time) AS crit_duplicate_time, COUNT(*) AS thread_count,
       SUM(GREATEST(crit_numoff_byr, crit_numoff_slr, crit_counter, crit_accept, crit_duplicate_time))::BIGINT
         AS violating_thread_count
FROM v_flags GROUP BY listing_id""")
view("v_joined", """
SELECT l.*, f.max_offer, COALESCE(f.has_thread, 0) AS has_thread,
       COALESCE(f.crit_numoff_byr, 0) AS crit_numoff_byr, COALESCE(f.crit_numoff_slr, 0) AS crit_numoff_slr,
       COALESCE(f.crit_counter, 0) AS crit_counter, COALESCE(f.crit_accept, 0) AS crit_accept,
       COALESCE(f.crit_duplicate_time, 0) AS crit_duplicate_time, COALESCE(f.thread_count, 0) AS thread_count,
       COALESCE(f.violating_thread_count, 0) AS violating_thread_count
FROM v_listings l LEFT JOIN v_listing_flags f ON f.listing_id = l.listing_id""")
_CORE = """(start_price > 1000 OR (item_price IS NOT NULL AND start_price IS NOT NULL AND item_price > start_price)
  OR (max_offer IS NOT NULL AND start_price IS NOT NULL AND max_offer > start_price)
  OR crit_numoff_byr = 1 OR crit_numoff_slr = 1 OR crit_counter = 1 OR crit_accept = 1)"""
view("v_sample", f"""
SELECT *, CASE WHEN start_price > 1000 THEN 1 ELSE 0 END AS crit_1k,
       CASE WHEN item_price > start_price THEN 1 ELSE 0 END AS crit_price,
       CASE WHEN max_offer > start_price THEN 1 ELSE 0 END AS crit_offr,
       CASE WHEN NOT {_CORE} THEN 1 ELSE 0 END AS sample_no_t5,
       CASE WHEN NOT ({_CORE} OR crit_duplicate_time = 1) THEN 1 ELSE 0 END AS sample_with_t5,
       CASE WHEN count4 IS NOT NULL AND count4 >= 20 AND condition_id IS NOT NULL AND NOT {_CORE} THEN 1 ELSE 0 END
         AS ref_sample
FROM v_joined""")
view("v_numbered", f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY listing_id, buyer_id ORDER BY {_ORDER}) AS pos FROM v_turns""")
view("v_summary", """
SELECT listing_id, buyer_id, COUNT(*) AS rounds, MAX(CASE WHEN status_id IN (1, 9) THEN 1 ELSE 0 END) AS success,
       MAX(CASE WHEN pos = 1 THEN offer_price END) AS first_offer_price,
       MAX(CASE WHEN pos = 1 THEN status_id END) AS first_status,
       MAX(CASE WHEN pos = 1 THEN offer_type END) AS first_offer_type,
       STRING_AGG(CAST(offer_type AS STRING), ',' ORDER BY pos) FILTER (WHERE pos <= 6) AS offer_types,
       STRING_AGG(CAST(status_id AS STRING), ',' ORDER BY pos) FILTER (WHERE pos <= 6) AS statuses
FROM v_numbered GROUP BY listing_id, buyer_id""")
view("v_buyers", """
SELECT buyer_id, SUM(n)::BIGINT AS num_offrs, COUNT(*) AS num_threads
FROM (SELECT listing_id, buyer_id, SUM(CASE WHEN offer_type IN (0, 1) THEN 1 ELSE 0 END) AS n
      FROM v_turns GROUP BY 1, 2) t GROUP BY buyer_id""")


@query("thread_flags", "SELECT * FROM v_flags", "max_offer")
def _(spark, sf):
    return flags_of(spark, sf)


@query("thread_flags_value_ties",
       _flags_sql("event_time, offer_type, offer_price NULLS FIRST, status_id"), "max_offer")
def _(spark, sf):
    return T.thread_flags(turns_view(spark, sf), ORDINAL, tie_order="value", probe=thread_probe(spark, sf))


@query("listing_flags", "SELECT * FROM v_listing_flags", "max_offer")
def _(spark, sf):
    return T.listing_flags(flags_of(spark, sf))


_FLAGS = T.FLAG_COLUMNS


@query("flag_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS flag, (SELECT SUM({c})::BIGINT FROM v_flags) AS threads, SUM({c})::BIGINT AS listings, "
    f"COUNT(*) AS listings_with_thread FROM v_listing_flags" for c in _FLAGS))
def _(spark, sf):
    return T.flag_counts(flags_of(spark, sf))


@query("thread_summary", "SELECT * FROM v_summary", "first_offer_price")
def _(spark, sf):
    return summary_of(spark, sf)


@query("buyer_stats", "SELECT * FROM v_buyers")
def _(spark, sf):
    return T.buyer_stats(turns_view(spark, sf))


@query("ambiguous_threads", """
SELECT sha256(listing_id) AS listing_id_hash, sha256(buyer_id) AS buyer_id_hash,
       CONCAT_WS(',', CASE WHEN a THEN 'countered_event_missing_offer_type' END,
                 CASE WHEN b THEN 'missing_src_cre_date' END) AS reasons, n AS row_count
FROM (SELECT listing_id, buyer_id, BOOL_OR(status_id = 7 AND l_quantity > 40) AS a,
             BOOL_OR(l_quantity < 2) AS b, COUNT(*) AS n FROM v_turns GROUP BY 1, 2) t
WHERE a OR b ORDER BY 1, 2 LIMIT 100""")
def _(spark, sf):
    turns = turns_view(spark, sf)
    holes = turns.withColumns({
        "offer_type": F.when(F.col("l_quantity") > 40, None).otherwise(F.col("offer_type")),
        "event_time": F.when(F.col("l_quantity") < 2, None).otherwise(F.col("event_time")),
    })
    return T.ambiguous_threads(holes)


@query("listing_sample", "SELECT * FROM v_joined", "start_price item_price max_offer")
def _(spark, sf):
    return S.listing_sample(listings_view(spark, sf), T.listing_flags(flags_of(spark, sf)))


@query("sample_flags", "SELECT * FROM v_sample", "start_price item_price max_offer")
def _(spark, sf):
    return sample_of(spark, sf)


_PREDS = ["crit_1k", "crit_price", "crit_offr", "crit_numoff_byr", "crit_numoff_slr", "crit_counter", "crit_accept"]
_NAMES = ["raw_source", *[f"after_{s}" for s in S.STEPS], "after_T5"]


def _waterfall_sql() -> str:
    conds = ["TRUE"] + [" AND ".join(f"{p} = 0" for p in _PREDS[: i + 1]) for i in range(7)] + ["sample_with_t5 = 1"]
    steps = " UNION ALL ".join(
        f"SELECT {i + 1} AS pos, '{n}' AS step, COUNT(*) AS k FROM v_sample WHERE {c}"
        for i, (n, c) in enumerate(zip(_NAMES, conds)))
    return f"""WITH steps AS ({steps})
SELECT pos, step, k AS retained_listings, LAG(k) OVER (ORDER BY pos) - k AS removed FROM steps
UNION ALL SELECT 10, 'union_excluded', NULL, (SELECT k FROM steps WHERE pos = 1) - (SELECT k FROM steps WHERE pos = 9)
UNION ALL SELECT 11, 'final_retained_sample', (SELECT k FROM steps WHERE pos = 9), 0"""


@query("waterfall", _waterfall_sql())
def _(spark, sf):
    return S.waterfall(sample_of(spark, sf))


_OVERLAP = "SELECT " + ", ".join(f"{c} AS {n}" for n, c in S.CRITERIA.items()) + ", COUNT(*) AS n FROM v_sample GROUP BY ALL"


@query("overlap_matrix", _OVERLAP)
def _(spark, sf):
    return S.overlap_matrix(sample_of(spark, sf))


@query("flag_totals", " UNION ALL ".join(
    f"SELECT '{n}' AS flag, SUM({c})::BIGINT AS n FROM v_sample" for n, c in S.CRITERIA.items()))
def _(spark, sf):
    return S.flag_totals(S.overlap_matrix(sample_of(spark, sf)))


@query("eligibility", "SELECT listing_id, " + ", ".join(
    f"{c} AS {n}_violation" for n, c in S.CRITERIA.items()) +
    ", sample_with_t5 AS eligible_main_sample, 'driver-tables' AS source_hash, "
    "'restrictions-v1' AS restriction_contract_version FROM v_sample")
def _(spark, sf):
    return S.eligibility(sample_of(spark, sf), "driver-tables")


view("v_restricted", """
SELECT listing_id, upper(sha256(seller_id)) AS seller_hash, start_price, item_price, condition_id,
       condition_id >= 3000 AS used, feedback AS seller_feedback,
       COALESCE(start_price > 1000, FALSE) AS "L1_violation", COALESCE(item_price > start_price, FALSE) AS "L2_violation",
       CAST(NULL AS BOOLEAN) AS "T1_violation", CAST(NULL AS BOOLEAN) AS "T2_buyer_violation",
       CAST(NULL AS BOOLEAN) AS "T2_seller_violation", CAST(NULL AS BOOLEAN) AS "T3_violation",
       CAST(NULL AS BOOLEAN) AS "T4_violation", CAST(NULL AS BOOLEAN) AS "T5_violation",
       NOT COALESCE(start_price > 1000, FALSE) AND NOT COALESCE(item_price > start_price, FALSE) AS eligible_l1_l2,
       'restrictions-v1' AS restriction_contract_version
FROM v_listings""")


@query("listing_restrictions", "SELECT * FROM v_restricted", "start_price item_price")
def _(spark, sf):
    return S.listing_restrictions(listings_view(spark, sf))


@query("listing_stats", """
SELECT COUNT(*) AS listings, COUNT(start_price) AS price_count, COUNT(*) - COUNT(start_price) AS price_missing,
       MIN(start_price) AS price_min, MAX(start_price) AS price_max, AVG(start_price) AS price_mean,
       COUNT(*) FILTER (WHERE used) AS used_true, COUNT(*) FILTER (WHERE NOT used) AS used_false,
       COUNT(used) AS used_known, COUNT(*) - COUNT(used) AS used_missing, AVG(CAST(used AS INTEGER)) AS used_rate,
       COUNT(*) FILTER (WHERE "L1_violation") AS l1, COUNT(*) FILTER (WHERE "L2_violation") AS l2,
       COUNT(*) FILTER (WHERE eligible_l1_l2) AS eligible
FROM v_restricted""", "price_min price_max price_mean used_rate")
def _(spark, sf):
    return S.listing_stats(S.listing_restrictions(listings_view(spark, sf)))


@query("price_histogram", """
SELECT CASE WHEN start_price IS NULL THEN 'missing' WHEN start_price < 10 THEN '0_to_10'
            WHEN start_price < 25 THEN '10_to_25' WHEN start_price < 50 THEN '25_to_50'
            WHEN start_price < 100 THEN '50_to_100' WHEN start_price < 250 THEN '100_to_250'
            WHEN start_price < 500 THEN '250_to_500' WHEN start_price <= 1000 THEN '500_to_1000'
            ELSE 'over_1000' END AS bucket, COUNT(*) AS n
FROM v_restricted GROUP BY 1""")
def _(spark, sf):
    return S.price_histogram(S.listing_restrictions(listings_view(spark, sf)))


@query("seller_feedback", """
SELECT COUNT(*) AS sellers_before, COUNT(*) FILTER (WHERE kept) AS sellers_after,
       COUNT(b) AS feedback_before, COUNT(CASE WHEN kept THEN a END) AS feedback_after
FROM (SELECT seller_hash, MAX(seller_feedback) AS b, BOOL_OR(eligible_l1_l2) AS kept,
             MAX(CASE WHEN eligible_l1_l2 THEN seller_feedback END) AS a
      FROM v_restricted GROUP BY 1) t""")
def _(spark, sf):
    return S.seller_feedback(S.listing_restrictions(listings_view(spark, sf)))


@query("sample_threads", """
SELECT t.*, l.start_price, l.seller_id, l.category FROM v_summary t
JOIN v_sample l ON l.listing_id = t.listing_id WHERE l.sample_no_t5 = 1""", "first_offer_price start_price")
def _(spark, sf):
    return S.sample_threads(summary_of(spark, sf), sample_of(spark, sf), "sample_no_t5")


@query("active_buyers", """
SELECT DISTINCT l.buyer_id FROM v_sample l JOIN v_buyers b ON b.buyer_id = l.buyer_id WHERE l.sample_with_t5 = 1""")
def _(spark, sf):
    return S.active_buyers(sample_of(spark, sf), T.buyer_stats(turns_view(spark, sf)), "sample_with_t5")


_RAW = "(SELECT COUNT(*) FROM v_sample)"
_KEEP = "FROM v_sample WHERE sample_no_t5 = 1"
_REF = "FROM v_sample WHERE ref_sample = 1"
_SANE = "FROM v_summary t JOIN v_sample l ON l.listing_id = t.listing_id WHERE {} AND first_offer_price / nullif(start_price, 0) <= 1"
_ROOT = "FROM v_summary t JOIN v_sample l ON l.listing_id = t.listing_id WHERE sample_no_t5 = 1 AND first_offer_type = 0"
_MOMENTS = {
    ("struct_raw_listings_before_restrictions", "value"): f"COUNT(*) FROM v_sample",
    ("struct_main_sample_listings_after_restrictions", "value"): "SUM(sample_no_t5) FROM v_sample",
    ("struct_main_sample_listings_after_restrictions", "released_code_with_t5"): "SUM(sample_with_t5) FROM v_sample",
    ("struct_main_sample_listings_after_restrictions", "crit_duplicate_time_count"): "SUM(crit_duplicate_time) FROM v_sample",
    ("struct_l1_price_over_1000_exclusions", "count"): "SUM(crit_1k) FROM v_sample",
    ("struct_l1_price_over_1000_exclusions", "fraction"): f"SUM(crit_1k) / {_RAW} FROM v_sample",
    ("struct_l2_sale_price_above_listing_exclusions", "count"): "SUM(crit_price) FROM v_sample",
    ("struct_l2_sale_price_above_listing_exclusions", "fraction"): f"SUM(crit_price) / {_RAW} FROM v_sample",
    ("struct_t1_offer_above_listing_exclusions", "count"): "SUM(crit_offr) FROM v_sample",
    ("struct_t1_offer_above_listing_exclusions", "fraction"): f"SUM(crit_offr) / {_RAW} FROM v_sample",
    ("struct_t2_offer_limit_exclusions", "buyer_count"): "SUM(crit_numoff_byr) FROM v_sample",
    ("struct_t2_offer_limit_exclusions", "buyer_fraction"): f"SUM(crit_numoff_byr) / {_RAW} FROM v_sample",
    ("struct_t2_offer_limit_exclusions", "seller_count"): "SUM(crit_numoff_slr) FROM v_sample",
    ("struct_t2_offer_limit_exclusions", "seller_fraction"): f"SUM(crit_numoff_slr) / {_RAW} FROM v_sample",
    ("struct_t3_t4_sequence_integrity_exclusions", "missing_counter_count"): "SUM(crit_counter) FROM v_sample",
    ("struct_t3_t4_sequence_integrity_exclusions", "missing_counter_fraction"): f"SUM(crit_counter) / {_RAW} FROM v_sample",
    ("struct_t3_t4_sequence_integrity_exclusions", "accepted_not_last_count"): "SUM(crit_accept) FROM v_sample",
    ("struct_t3_t4_sequence_integrity_exclusions", "accepted_not_last_fraction"): f"SUM(crit_accept) / {_RAW} FROM v_sample",
    ("struct_t3_t4_sequence_integrity_exclusions", "duplicate_timestamp_count_released_code_t5"): "SUM(crit_duplicate_time) FROM v_sample",
    ("pub_table1_listing_price_mean", "value"): f"AVG(start_price) {_KEEP}",
    ("pub_table1_listing_used_rate", "value"): f"AVG(CASE WHEN condition_id >= 3000 THEN 1.0 WHEN condition_id IS NOT NULL THEN 0.0 END) {_KEEP}",
    ("pub_table1_listing_used_rate", "nonmissing_denominator"): f"COUNT(condition_id) {_KEEP}",
    ("pub_table1_listing_revised_rate", "value"): f"AVG(bin_rev) {_KEEP}",
    ("pub_table1_listing_sold_rate", "value"): f"AVG(CASE WHEN item_price IS NOT NULL THEN 1.0 ELSE 0.0 END) {_KEEP}",
    ("pub_table1_listing_sold_best_offer_rate", "value"): f"AVG(CASE WHEN bo_ck = 1 THEN 1.0 ELSE 0.0 END) {_KEEP}",
    ("pub_table1_listing_received_offer_rate", "value"): f"AVG(CASE WHEN has_thread = 1 THEN 1.0 ELSE 0.0 END) {_KEEP}",
    ("pub_table1_listing_sale_price_to_list", "value"): f"AVG(item_price / nullif(start_price, 0)) {_KEEP}",
    ("pub_table1_listing_bargained_price_to_list", "value"): f"AVG(item_price / nullif(start_price, 0)) {_KEEP} AND bo_ck = 1",
    ("pub_table1_seller_count_and_feedback_denominator", "seller_count"): f"COUNT(DISTINCT seller_id) {_KEEP}",
    ("pub_table1_seller_count_and_feedback_denominator", "feedback_nonmissing_sellers"): f"COUNT(DISTINCT CASE WHEN feedback IS NOT NULL THEN seller_id END) {_KEEP}",
    ("pub_table1_seller_count_and_feedback_denominator", "feedback_positive_percent_mean"): f"AVG(f) FROM (SELECT MAX(feedback) AS f {_KEEP} GROUP BY seller_id)",
    ("pub_table1_buyer_count", "value"): f"COUNT(DISTINCT buyer_id) {_KEEP} AND buyer_id IN (SELECT buyer_id FROM v_buyers)",
    ("pub_table1_thread_count", "value"): "COUNT(*) " + _SANE.format("sample_no_t5 = 1"),
    ("pub_table1_thread_offer_count_mean", "value"): "AVG(rounds) " + _SANE.format("sample_no_t5 = 1"),
    ("pub_table1_thread_agreement_rate", "value"): "AVG(success) " + _SANE.format("sample_no_t5 = 1"),
    ("pub_table1_thread_first_offer_to_list", "value"): "AVG(first_offer_price / start_price) " + _SANE.format("sample_no_t5 = 1"),
    ("diag_ref_sample_listing_count", "value"): f"COUNT(*) {_REF}",
    ("diag_ref_sample_sold_rate", "value"): f"AVG(CASE WHEN item_price IS NOT NULL THEN 1.0 ELSE 0.0 END) {_REF}",
    ("diag_ref_sample_received_offer_rate", "value"): f"AVG(CASE WHEN has_thread = 1 THEN 1.0 ELSE 0.0 END) {_REF}",
    ("diag_ref_sample_bargained_price_to_list", "value"): f"AVG(item_price / nullif(start_price, 0)) {_REF} AND bo_ck = 1",
    ("diag_ref_sample_thread_agreement_rate", "value"): "AVG(success) " + _SANE.format("ref_sample = 1"),
    ("diag_figure4_root_game_tree_count", "value"): f"COUNT(*) {_ROOT}",
    ("diag_figure4_first_seller_response_shares", "accept_share"): f"AVG(CASE WHEN first_status IN (1, 9) THEN 1.0 ELSE 0.0 END) {_ROOT}",
    ("diag_figure4_first_seller_response_shares", "counter_share"): f"AVG(CASE WHEN first_status = 7 THEN 1.0 ELSE 0.0 END) {_ROOT}",
    ("diag_figure4_first_seller_response_shares", "decline_share"): f"AVG(CASE WHEN first_status IN (1, 7, 9) THEN 0.0 ELSE 1.0 END) {_ROOT}",
}
view("v_moments", " UNION ALL ".join(
    f"SELECT '{t}' AS target_id, '{p}' AS part, CAST(o AS DOUBLE) AS observed FROM (SELECT {e.replace(' FROM', ' AS o FROM', 1) if not e.startswith(('SUM(crit', 'SUM(sample')) or '/' not in e else e.replace(' FROM v_sample', ' AS o FROM v_sample').replace('(SELECT COUNT(*) AS o', '(SELECT COUNT(*)')})"
    for (t, p), e in _MOMENTS.items()))


def moments_of(spark, sf):
    turns = turns_view(spark, sf)
    return S.moments(sample_of(spark, sf), summary_of(spark, sf), T.buyer_stats(turns))


@query("moments", "SELECT * FROM v_moments", "observed")
def _(spark, sf):
    return moments_of(spark, sf)


# Targets derived from the tables themselves: the listing sums, expected within 1%.
@query("moment_check", """
SELECT m.target_id, m.part, e.expected, e.tolerance, e.fatal, m.observed, ABS(m.observed - e.expected) <= e.tolerance AS passed
FROM v_moments m JOIN (
  SELECT 'pub_table1_listing_price_mean' AS target_id, 'value' AS part, AVG(c_acctbal) / 8 AS expected, 30.0::DOUBLE AS tolerance, TRUE AS fatal FROM customer
  UNION ALL SELECT 'struct_raw_listings_before_restrictions', 'value', COUNT(DISTINCT o_custkey * 5 + o_orderkey % 5)::DOUBLE, 0.0::DOUBLE, TRUE FROM orders
) e ON e.target_id = m.target_id AND e.part = m.part""", "observed expected tolerance")
def _(spark, sf):
    from haggle.sources.tables import table

    price = table(spark, sf, "customer").agg((F.avg("c_acctbal") / 8).alias("expected"))
    raw = table(spark, sf, "orders").agg(
        F.countDistinct(F.col("o_custkey") * 5 + F.col("o_orderkey") % 5).cast("double").alias("expected"))

    def target(df, name, tol):
        return df.select(F.lit(name).alias("target_id"), F.lit("value").alias("part"), "expected",
                         F.lit(tol).alias("tolerance"), F.lit(True).alias("fatal"))

    targets = target(price, "pub_table1_listing_price_mean", 30.0).unionByName(
        target(raw, "struct_raw_listings_before_restrictions", 0.0))
    return S.moment_check(moments_of(spark, sf), targets)


def _audit_sql() -> str:
    kept = "FROM v_sample WHERE sample_with_t5 = 1"
    panel = f"(SELECT seller_id, COUNT(*) AS n, MAX(feedback) AS f {kept} GROUP BY 1)"
    bought = f"{kept} AND buyer_id IN (SELECT buyer_id FROM v_buyers)"
    threads = "FROM v_summary t JOIN v_sample l ON l.listing_id = t.listing_id WHERE l.sample_with_t5 = 1"
    rows = [
        ("listing", "retained_listing_count", f"COUNT(*) AS v {kept}"),
        ("listing", "used_true_numerator", f"COUNT(*) AS v {kept} AND condition_id >= 3000"),
        ("listing", "used_nonmissing_denominator", f"COUNT(condition_id) AS v {kept}"),
        ("listing", "used_missing_count", f"COUNT(*) - COUNT(condition_id) AS v {kept}"),
        ("listing", "used_rate", f"AVG(CASE WHEN condition_id >= 3000 THEN 1 ELSE 0 END) AS v {kept} AND condition_id IS NOT NULL"),
        ("seller", "seller_count", f"COUNT(*) AS v FROM {panel}"),
        ("seller", "feedback_nonmissing_seller_count", f"COUNT(f) AS v FROM {panel}"),
        ("seller", "feedback_missing_seller_count", f"COUNT(*) - COUNT(f) AS v FROM {panel}"),
        ("seller", "feedback_positive_percent_mean", f"AVG(f) AS v FROM {panel}"),
        ("seller", "listings_per_seller", f"AVG(n) AS v FROM {panel}"),
        ("buyer", "buyer_count", f"COUNT(DISTINCT buyer_id) AS v {bought}"),
        ("buyer", "null_buyer_listing_rows", "0 AS v"),
        ("buyer", "empty_buyer_listing_rows", f"COUNT(*) AS v {bought} AND buyer_id = ''"),
        ("buyer", "sentinel_buyer_listing_rows", f"COUNT(*) AS v {bought} AND lower(buyer_id) IN ('null', 'none', 'nan', '.')"),
        ("buyer", "retained_thread_offer_buyer_count", f"COUNT(DISTINCT t.buyer_id) AS v {threads}"),
        ("thread", "thread_count", f"COUNT(*) AS v {threads}"),
        ("thread", "distinct_listing_buyer_pairs", f"COUNT(DISTINCT t.listing_id || '|' || t.buyer_id) AS v {threads}"),
        ("thread", "duplicate_listing_buyer_pairs", f"COUNT(*) - COUNT(DISTINCT t.listing_id || '|' || t.buyer_id) AS v {threads}"),
        ("thread", "malformed_identifier_threads", f"COUNT(*) AS v {threads} AND (t.listing_id = '' OR t.buyer_id = '')"),
    ]
    return " UNION ALL ".join(f"SELECT '{a}' AS level, '{m}' AS measure, CAST(v AS DOUBLE) AS value FROM (SELECT {e})" for a, m, e in rows)


@query("denominator_audit", _audit_sql(), "value")
def _(spark, sf):
    turns = turns_view(spark, sf)
    return S.denominator_audit(sample_of(spark, sf), summary_of(spark, sf), T.buyer_stats(turns))

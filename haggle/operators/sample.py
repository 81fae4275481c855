"""Listing sample: restriction flags, moments, audits, waterfall, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.functions.scalar import bucket, safe_div, sha256_hex

# Price above which a listing is left out, first "used" condition code.
PRICE_LIMIT = 1000
USED_FROM = 3000

CRITERIA = {
    "L1": "crit_1k", "L2": "crit_price", "T1": "crit_offr", "T2_buyer": "crit_numoff_byr",
    "T2_seller": "crit_numoff_slr", "T3": "crit_counter", "T4": "crit_accept", "T5": "crit_duplicate_time",
}


def listing_sample(listings: DataFrame, flags: DataFrame) -> DataFrame:
    """Listings with the flags of their threads; no thread means no violation."""
    joined = listings.join(flags, "listing_id", "left")
    zero = ["has_thread", "crit_numoff_byr", "crit_numoff_slr", "crit_counter", "crit_accept",
            "crit_duplicate_time", "thread_count", "violating_thread_count"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def sample_flags(joined: DataFrame) -> DataFrame:
    """L1, L2, T1 flags and the three samples. The samples follow SQL's
    three-valued logic: with no start price the negation is unknown, so the
    listing stays out although no flag is set."""
    start, sold, offer = F.col("start_price"), F.col("item_price"), F.col("max_offer")
    over = start > PRICE_LIMIT
    sold_over = sold.isNotNull() & start.isNotNull() & (sold > start)
    offer_over = offer.isNotNull() & start.isNotNull() & (offer > start)
    core = over | sold_over | offer_over
    for c in ["crit_numoff_byr", "crit_numoff_slr", "crit_counter", "crit_accept"]:
        core = core | (F.col(c) == 1)

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    df = joined.withColumns(
        {
            "crit_1k": one(over),
            "crit_price": one(sold_over),
            "crit_offr": one(offer_over),
            "sample_no_t5": one(~core),
            "sample_with_t5": one(~(core | (F.col("crit_duplicate_time") == 1))),
        }
    )
    if "count4" in joined.columns:
        ref = (F.col("count4") >= 20) & F.col("condition_id").isNotNull() & ~core
        df = df.withColumn("ref_sample", one(ref))
    return df


def listing_restrictions(listings: DataFrame, version: str = "restrictions-v1") -> DataFrame:
    """Listing-only pass: here a missing start price stays eligible, and thread
    flags are unset until joined."""
    start, sold = F.col("start_price"), F.col("item_price")
    l1 = F.coalesce(start > PRICE_LIMIT, F.lit(False))
    l2 = F.coalesce(sold > start, F.lit(False))
    unset = F.lit(None).cast("boolean")
    return listings.select(
        "listing_id",
        F.upper(sha256_hex(F.col("seller_id"))).alias("seller_hash"),
        "start_price", "item_price", "condition_id",
        (F.col("condition_id") >= USED_FROM).alias("used"),
        F.col("feedback").alias("seller_feedback"),
        l1.alias("L1_violation"), l2.alias("L2_violation"),
        *[unset.alias(f"{t}_violation") for t in ["T1", "T2_buyer", "T2_seller", "T3", "T4", "T5"]],
        (~l1 & ~l2).alias("eligible_l1_l2"),
        F.lit(version).alias("restriction_contract_version"),
    )


# Fixed bucket edges of the listing price histogram; 1000 belongs to the last but one.
PRICE_EDGES = [10, 25, 50, 100, 250, 500, 1000]
PRICE_LABELS = ["0_to_10", "10_to_25", "25_to_50", "50_to_100", "100_to_250", "250_to_500", "500_to_1000", "over_1000"]


def price_bucket(c: Column) -> Column:
    return bucket(c, PRICE_EDGES, PRICE_LABELS, missing="missing", last_inclusive=True)


def listing_stats(restricted: DataFrame) -> DataFrame:
    price = F.col("start_price")
    return restricted.agg(
        F.count(F.lit(1)).alias("listings"),
        F.count(price).alias("price_count"),
        F.count_if(price.isNull()).alias("price_missing"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.avg(price).alias("price_mean"),
        F.count_if("used").alias("used_true"),
        F.count_if(~F.col("used")).alias("used_false"),
        F.count("used").alias("used_known"),
        F.count_if(F.col("used").isNull()).alias("used_missing"),
        F.avg(F.col("used").cast("int")).alias("used_rate"),
        F.count_if("L1_violation").alias("l1"),
        F.count_if("L2_violation").alias("l2"),
        F.count_if("eligible_l1_l2").alias("eligible"),
    )


def price_histogram(restricted: DataFrame) -> DataFrame:
    return restricted.groupBy(price_bucket(F.col("start_price")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def seller_feedback(restricted: DataFrame) -> DataFrame:
    """Best known feedback per seller, counted before and after L1 and L2."""
    per = restricted.filter(F.col("seller_hash").isNotNull()).groupBy("seller_hash").agg(
        F.max("seller_feedback").alias("before"),
        F.max(F.when(F.col("eligible_l1_l2"), F.col("seller_feedback"))).alias("after"),
        F.bool_or("eligible_l1_l2").alias("kept"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("sellers_before"),
        F.count_if("kept").alias("sellers_after"),
        F.count("before").alias("feedback_before"),
        F.count(F.when(F.col("kept"), F.col("after"))).alias("feedback_after"),
    )


def sample_threads(threads: DataFrame, sample: DataFrame, flag: str) -> DataFrame:
    """Thread summaries of the listings in one sample (J3). The filter runs
    before the join, so only kept listings are shuffled."""
    kept = sample.filter(F.col(flag) == 1).select("listing_id", "start_price", "seller_id", "category")
    return threads.join(kept, "listing_id")


def active_buyers(sample: DataFrame, buyers: DataFrame, flag: str) -> DataFrame:
    """Buyers of kept listings who also made offers."""
    kept = sample.filter((F.col(flag) == 1) & F.col("buyer_id").isNotNull()).select("buyer_id").distinct()
    return kept.join(buyers.select("buyer_id"), "buyer_id", "left_semi")


def _rate(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def moments(sample: DataFrame, threads: DataFrame, buyers: DataFrame) -> DataFrame:
    """Published moments as (target_id, part, observed) rows. Three passes: one
    over listings, one over sellers, one over the threads of kept listings."""
    start, sold = F.col("start_price"), F.col("item_price")
    keep, ref = F.col("sample_no_t5") == 1, F.col("ref_sample") == 1
    ratio = F.when(start != 0, sold / start)
    deal = F.col("bo_ck") == 1

    def among(cond: Column, value: Column) -> Column:
        return F.avg(F.when(cond, value))

    def flag(cond: Column) -> Column:
        return F.when(cond, 1.0).otherwise(0.0)

    used = F.when(F.col("condition_id").isNotNull(), flag(F.col("condition_id") >= USED_FROM))
    raw = F.count(F.lit(1))
    columns = {
        ("struct_raw_listings_before_restrictions", "value"): raw,
        ("struct_main_sample_listings_after_restrictions", "value"): F.sum("sample_no_t5"),
        ("struct_main_sample_listings_after_restrictions", "released_code_with_t5"): F.sum("sample_with_t5"),
        ("struct_main_sample_listings_after_restrictions", "crit_duplicate_time_count"): F.sum("crit_duplicate_time"),
        ("pub_table1_listing_price_mean", "value"): among(keep, start),
        ("pub_table1_listing_used_rate", "value"): among(keep, used),
        ("pub_table1_listing_used_rate", "nonmissing_denominator"): F.count(F.when(keep, F.col("condition_id"))),
        ("pub_table1_listing_revised_rate", "value"): among(keep, F.col("bin_rev").cast("double")),
        ("pub_table1_listing_sold_rate", "value"): among(keep, flag(sold.isNotNull())),
        ("pub_table1_listing_sold_best_offer_rate", "value"): among(keep, flag(deal)),
        ("pub_table1_listing_received_offer_rate", "value"): among(keep, flag(F.col("has_thread") == 1)),
        ("pub_table1_listing_sale_price_to_list", "value"): among(keep, ratio),
        ("pub_table1_listing_bargained_price_to_list", "value"): among(keep & deal, ratio),
        ("diag_ref_sample_listing_count", "value"): F.count_if(ref),
        ("diag_ref_sample_sold_rate", "value"): among(ref, flag(sold.isNotNull())),
        ("diag_ref_sample_received_offer_rate", "value"): among(ref, flag(F.col("has_thread") == 1)),
        ("diag_ref_sample_bargained_price_to_list", "value"): among(ref & deal, ratio),
    }
    counted = {
        ("struct_l1_price_over_1000_exclusions", ""): "crit_1k",
        ("struct_l2_sale_price_above_listing_exclusions", ""): "crit_price",
        ("struct_t1_offer_above_listing_exclusions", ""): "crit_offr",
        ("struct_t2_offer_limit_exclusions", "buyer_"): "crit_numoff_byr",
        ("struct_t2_offer_limit_exclusions", "seller_"): "crit_numoff_slr",
        ("struct_t3_t4_sequence_integrity_exclusions", "missing_counter_"): "crit_counter",
        ("struct_t3_t4_sequence_integrity_exclusions", "accepted_not_last_"): "crit_accept",
    }
    for (target, prefix), crit in counted.items():
        columns[(target, f"{prefix}count")] = F.sum(crit)
        columns[(target, f"{prefix}fraction")] = F.sum(crit) / raw
    columns[("struct_t3_t4_sequence_integrity_exclusions", "duplicate_timestamp_count_released_code_t5")] = F.sum(
        "crit_duplicate_time"
    )
    listing_rows = _long(sample, columns)

    panel = sample.filter(keep).groupBy("seller_id").agg(F.max("feedback").alias("f"))
    seller = "pub_table1_seller_count_and_feedback_denominator"
    seller_rows = _long(panel, {
        (seller, "seller_count"): F.count(F.lit(1)),
        (seller, "feedback_nonmissing_sellers"): F.count("f"),
        (seller, "feedback_positive_percent_mean"): F.avg("f"),
    })
    buyer_rows = _long(active_buyers(sample, buyers, "sample_no_t5"),
                       {("pub_table1_buyer_count", "value"): F.count(F.lit(1))})

    flags = sample.filter(keep | ref).select("listing_id", "start_price", "sample_no_t5", "ref_sample")
    both = threads.join(flags, "listing_id")
    first = F.col("first_offer_price") / F.when(start != 0, start)
    sane, root = keep & (first <= 1), keep & (F.col("first_offer_type") == 0)
    status = F.col("first_status")
    shares = "diag_figure4_first_seller_response_shares"
    thread_rows = _long(both, {
        ("pub_table1_thread_count", "value"): F.count_if(sane),
        ("pub_table1_thread_offer_count_mean", "value"): among(sane, F.col("rounds")),
        ("pub_table1_thread_agreement_rate", "value"): among(sane, F.col("success")),
        ("pub_table1_thread_first_offer_to_list", "value"): among(sane, first),
        ("diag_ref_sample_thread_agreement_rate", "value"): among(ref & (first <= 1), F.col("success")),
        ("diag_figure4_root_game_tree_count", "value"): F.count_if(root),
        (shares, "accept_share"): among(root, flag(status.isin(1, 9))),
        (shares, "counter_share"): among(root, flag(status == 7)),
        (shares, "decline_share"): among(root, flag(~F.coalesce(status.isin(1, 7, 9), F.lit(False)))),
    })
    return listing_rows.unionByName(seller_rows).unionByName(buyer_rows).unionByName(thread_rows)


def _long(df: DataFrame, columns: dict[tuple[str, str], Column]) -> DataFrame:
    names = {k: f"m{i}" for i, k in enumerate(columns)}
    row = df.agg(*[c.alias(names[k]) for k, c in columns.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target_id"), F.lit(p).alias("part"), F.col(names[(t, p)]).cast("double").alias("observed"))
        for t, p in columns])))


def moment_check(observed: DataFrame, targets: DataFrame) -> DataFrame:
    """Each expected value against its observed one. Targets carry
    (target_id, part, expected, tolerance, fatal); an unobserved target does
    not pass. The target table holds a few dozen published numbers."""
    joined = targets.join(observed, ["target_id", "part"], "left")
    near = F.abs(F.col("observed") - F.col("expected")) <= F.col("tolerance")
    both_null = F.col("observed").isNull() & F.col("expected").isNull()
    return joined.withColumn("passed", F.coalesce(near, both_null))


def moment_verdict(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.bool_and(F.col("passed") | ~F.col("fatal")).alias("fatal_passed"),
    )


# Texts that stand for a missing buyer id.
BUYER_SENTINELS = ["null", "none", "nan", "."]


def denominator_audit(sample: DataFrame, threads: DataFrame, buyers: DataFrame) -> DataFrame:
    """Denominators of the final sample at four levels, as (level, measure, value)."""
    kept = sample.filter(F.col("sample_with_t5") == 1)
    cond = F.col("condition_id")
    one = F.lit(1)

    def level(name: str, df: DataFrame, cols: dict[str, Column]) -> DataFrame:
        row = df.agg(*[c.alias(k) for k, c in cols.items()])
        return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("level"), F.lit(k).alias("measure"),
                                                      F.col(k).cast("double").alias("value")) for k in cols])))

    listing = level("listing", kept, {
        "retained_listing_count": F.count(one),
        "used_true_numerator": F.count_if(cond >= USED_FROM),
        "used_nonmissing_denominator": F.count(cond),
        "used_missing_count": F.count_if(cond.isNull()),
        "used_rate": F.avg(F.when(cond.isNotNull(), (cond >= USED_FROM).cast("int"))),
    })
    panel = kept.groupBy("seller_id").agg(F.count(one).alias("n"), F.max("feedback").alias("f"))
    seller = level("seller", panel, {
        "seller_count": F.count(one),
        "feedback_nonmissing_seller_count": F.count("f"),
        "feedback_missing_seller_count": F.count_if(F.col("f").isNull()),
        "feedback_positive_percent_mean": F.avg("f"),
        "listings_per_seller": F.avg("n"),
    })
    b = F.col("buyer_id")
    bought = kept.join(buyers.select("buyer_id"), "buyer_id", "left_semi").groupBy("buyer_id").agg(F.count(one).alias("n"))
    buyer = level("buyer", bought, {
        "buyer_count": F.count_if(b.isNotNull() & (b != "")),
        "null_buyer_listing_rows": F.coalesce(F.sum(F.when(b.isNull(), F.col("n"))), F.lit(0)),
        "empty_buyer_listing_rows": F.coalesce(F.sum(F.when(b == "", F.col("n"))), F.lit(0)),
        "sentinel_buyer_listing_rows": F.coalesce(F.sum(F.when(F.lower(b).isin(BUYER_SENTINELS), F.col("n"))), F.lit(0)),
    })
    pairs = threads.join(kept.select("listing_id"), "listing_id").groupBy("listing_id", "buyer_id").agg(F.count(one).alias("n"))
    bad = F.coalesce(F.col("listing_id"), F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe("")
    thread = level("thread", pairs, {
        "thread_count": F.coalesce(F.sum("n"), F.lit(0)),
        "distinct_listing_buyer_pairs": F.count(one),
        "duplicate_listing_buyer_pairs": F.coalesce(F.sum("n") - F.count(one), F.lit(0)),
        "malformed_identifier_threads": F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)),
    })
    makers = pairs.filter(b.isNotNull() & (b != "")).select("buyer_id").distinct()
    maker = level("buyer", makers, {"retained_thread_offer_buyer_count": F.count(one)})
    return listing.unionByName(seller).unionByName(buyer).unionByName(maker).unionByName(thread)


STEPS = ["L1", "L2", "T1", "T2_buyer", "T2_seller", "T3", "T4"]


def waterfall(sample: DataFrame) -> DataFrame:
    """Nine cumulative steps in one pass. The last step uses the sample flag, so
    listings with no start price drop there."""
    clear = F.lit(True)
    counts: dict[str, Column] = {"raw_source": F.count(F.lit(1))}
    for s in STEPS:
        clear = clear & (F.col(CRITERIA[s]) == 0)
        counts[f"after_{s}"] = F.count_if(clear)
    counts["after_T5"] = F.count_if(F.col("sample_with_t5") == 1)
    names = list(counts)
    row = sample.agg(*[c.alias(n) for n, c in counts.items()])

    def line(pos: int, step: str, kept: Column, removed: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), F.lit(step).alias("step"),
                        kept.cast("long").alias("retained_listings"), removed.cast("long").alias("removed"))

    none = F.lit(None)
    lines = [line(1, names[0], F.col(names[0]), none)]
    lines += [line(i + 1, n, F.col(n), F.col(names[i - 1]) - F.col(n)) for i, n in enumerate(names) if i]
    last = F.col(names[-1])
    lines += [line(10, "union_excluded", none, F.col("raw_source") - last), line(11, "final_retained_sample", last, F.lit(0))]
    return row.select(F.inline(F.array(*lines)))


def overlap_matrix(sample: DataFrame) -> DataFrame:
    """Listings per combination of the eight flags."""
    return sample.groupBy(*[F.col(c).alias(n) for n, c in CRITERIA.items()]).agg(F.count(F.lit(1)).alias("n"))


def flag_totals(overlap: DataFrame) -> DataFrame:
    """Listings per flag, from the at most 256 rows of the overlap matrix."""
    row = overlap.agg(*[F.sum(F.when(F.col(f) == 1, F.col("n")).otherwise(0)).alias(f) for f in CRITERIA])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in CRITERIA])))


def eligibility(sample: DataFrame, source_hash: str, version: str = "restrictions-v1") -> DataFrame:
    """One row per listing with its flags and whether it is in the main sample."""
    return sample.select(
        "listing_id",
        *[F.coalesce(c, F.lit(0)).cast("int").alias(f"{n}_violation") for n, c in CRITERIA.items()],
        F.coalesce("sample_with_t5", F.lit(0)).cast("int").alias("eligible_main_sample"),
        F.lit(source_hash).alias("source_hash"),
        F.lit(version).alias("restriction_contract_version"),
    )


def same_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two tables and whether they agree."""
    a = left.agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.agg(F.count(F.lit(1)).alias("right_rows"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn(
        "same", F.col("left_rows") == F.col("right_rows"))

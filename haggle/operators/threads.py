"""Thread-level aggregates of turns: integrity flags, summaries, buyer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.scalar import sha256_hex
from haggle.operators.ordered import done, grouped, with_next, with_row_number

THREAD = ["listing_id", "buyer_id"]
BUYER_TYPES = (0, 1)
SELLER_TYPE = 2
ACCEPTED = (1, 9)
COUNTERED = 7
MAX_PROPOSALS = 3

FLAG_COLUMNS = ["crit_numoff_byr", "crit_numoff_slr", "crit_counter", "crit_accept", "crit_duplicate_time"]


def turn_order(tie_order: str, ordinal: list[str]) -> list[str]:
    """Order of turns inside a thread: ties in time by source position
    ('ordinal') or by type, price and status ('value')."""
    if tie_order == "ordinal":
        return ["event_time", *ordinal]
    if tie_order == "value":
        return ["event_time", "offer_type", "offer_price", "status_id"]
    raise ValueError(f"unknown tie_order {tie_order!r}")


def _flag(cond: Column) -> Column:
    return F.max(F.when(cond, 1).otherwise(0))


def thread_flags(turns: DataFrame, ordinal: list[str], tie_order: str = "ordinal",
                 probe: DataFrame | None = None) -> DataFrame:
    """Restriction flags per (listing, buyer). One shuffle by thread: the window
    that looks at the next turn and the aggregate share the partitioning."""
    order = turn_order(tie_order, ordinal)
    g = grouped(turns, THREAD, order, probe)
    df = with_next(g, {"_next_type": "offer_type", "_next_time": "event_time"}).df
    kind, status = F.col("offer_type"), F.col("status_id")
    countered = status == COUNTERED
    unanswered = (kind.isin(*BUYER_TYPES) & ~F.col("_next_type").eqNullSafe(SELLER_TYPE)) | (
        (kind == SELLER_TYPE) & ~F.col("_next_type").eqNullSafe(1)
    )
    # equal times are neighbours in this order, and missing times count as equal
    same_time = ~F.col("_is_last") & F.col("event_time").eqNullSafe(F.col("_next_time"))
    out = df.groupBy(*THREAD).agg(
        F.count_if(kind.isin(*BUYER_TYPES)).alias("buyer_offers"),
        F.count_if(kind == SELLER_TYPE).alias("seller_offers"),
        F.max("offer_price").alias("max_offer"),
        _flag(countered & unanswered).alias("crit_counter"),
        _flag(status.isin(*ACCEPTED) & ~F.col("_is_last")).alias("crit_accept"),
        _flag(same_time).alias("crit_duplicate_time"),
    )
    return out.withColumns(
        {
            "crit_numoff_byr": (F.col("buyer_offers") > MAX_PROPOSALS).cast("int"),
            "crit_numoff_slr": (F.col("seller_offers") > MAX_PROPOSALS).cast("int"),
        }
    )


def listing_flags(flags: DataFrame) -> DataFrame:
    """Thread flags propagated to the listing."""
    violating = F.greatest(*FLAG_COLUMNS)
    return flags.groupBy("listing_id").agg(
        F.lit(1).alias("has_thread"),
        F.max("max_offer").alias("max_offer"),
        *[F.max(c).alias(c) for c in FLAG_COLUMNS],
        F.count(F.lit(1)).alias("thread_count"),
        F.sum(violating).alias("violating_thread_count"),
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    """Threads and listings hit by each flag, in one pass over the listing table."""
    per = flags.groupBy("listing_id").agg(*[F.sum(c).alias(c) for c in FLAG_COLUMNS])
    sums = per.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"t_{c}") for c in FLAG_COLUMNS],
        *[F.count_if(F.col(c) > 0).alias(f"l_{c}") for c in FLAG_COLUMNS],
    )
    pairs = [F.struct(F.lit(c).alias("flag"), F.col(f"t_{c}").alias("threads"), F.col(f"l_{c}").alias("listings"),
                      F.col("n").alias("listings_with_thread")) for c in FLAG_COLUMNS]
    return sums.select(F.inline(F.array(*pairs)))


def thread_summary(turns: DataFrame, ordinal: list[str], tie_order: str = "ordinal",
                 probe: DataFrame | None = None) -> DataFrame:
    """Rounds, success, first offer and the first six types and statuses."""
    order = turn_order(tie_order, ordinal)
    df = done(with_row_number(grouped(turns, THREAD, order, probe), "_pos"))
    first = F.col("_pos") == 1

    def head_list(col: str) -> Column:
        # at most six entries per thread reach the list
        items = F.collect_list(F.when(F.col("_pos") <= 6, F.struct("_pos", F.col(col).cast("string").alias("v"))))
        return F.array_join(F.transform(F.array_sort(items), lambda s: F.coalesce(s["v"], F.lit(""))), ",")

    return df.groupBy(*THREAD).agg(
        F.count(F.lit(1)).alias("rounds"),
        F.max(F.when(F.col("status_id").isin(*ACCEPTED), 1).otherwise(0)).alias("success"),
        F.max(F.when(first, F.col("offer_price"))).alias("first_offer_price"),
        F.max(F.when(first, F.col("status_id"))).alias("first_status"),
        F.max(F.when(first, F.col("offer_type"))).alias("first_offer_type"),
        head_list("offer_type").alias("offer_types"),
        head_list("status_id").alias("statuses"),
    )


def buyer_stats(turns: DataFrame) -> DataFrame:
    """Offers and threads per buyer; pre-aggregated by thread, so a hot buyer
    shuffles one row per thread at most."""
    per = turns.filter(F.coalesce("buyer_id", F.lit("")) != "").groupBy(*THREAD).agg(
        F.count_if(F.col("offer_type").isin(*BUYER_TYPES)).alias("n")
    )
    return per.groupBy("buyer_id").agg(F.sum("n").alias("num_offrs"), F.count(F.lit(1)).alias("num_threads"))


def ambiguous_threads(turns: DataFrame, examples: int = 100) -> DataFrame:
    """Threads whose rows cannot be judged, ids hashed; the report keeps the
    first hundred by hash."""
    marked = turns.select(
        *THREAD,
        ((F.col("status_id") == COUNTERED) & F.col("offer_type").isNull()).alias("no_type"),
        F.col("event_time").isNull().alias("no_time"),
    )
    per = marked.groupBy(*THREAD).agg(
        F.bool_or(F.coalesce("no_type", F.lit(False))).alias("no_type"),
        F.bool_or("no_time").alias("no_time"),
        F.count(F.lit(1)).alias("row_count"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("no_type"), F.lit("countered_event_missing_offer_type")),
            F.when(F.col("no_time"), F.lit("missing_src_cre_date")),
        )
    )
    return (
        per.filter("no_type OR no_time")
        .select(
            sha256_hex(F.col("listing_id")).alias("listing_id_hash"),
            sha256_hex(F.col("buyer_id")).alias("buyer_id_hash"),
            F.array_join(reasons, ",").alias("reasons"),
            "row_count",
        )
        .orderBy("listing_id_hash", "buyer_id_hash")
        .limit(examples)
    )

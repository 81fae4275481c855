"""Turns and listings seen through a folder of order tables.

An order is a thread, a customer and order-number residue is a listing, lines
are turns, a nation is the seller and a market segment the category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Total order of the turns inside a thread.
TURN_ORDER = ["event_time", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listing_key(cust: str, order: str):
    return F.concat(F.col(cust).cast("string"), F.lit("-"), (F.col(order) % 5).cast("string"))


def turns_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    # joined on the thread's key, so that the windows by thread that follow need no other shuffle
    lines = table(spark, sf_dir, "lineitem").withColumn("thread_id", F.col("l_orderkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("thread_id"), "o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    code = F.col("l_partkey") % 20
    free = F.col("l_tax") == 0
    status = F.when(code == 0, 7).when(code == 1, 1).when(code == 2, 9).when(code == 3, 8)
    status = status.when(code == 4, 0).when(code == 5, 6).otherwise(2)
    return lines.join(orders, "thread_id").select(
        _listing_key("o_custkey", "o_orderkey").alias("listing_id"),
        F.col("thread_id").alias("buyer_id"),
        "thread_id",
        F.col("l_shipdate").alias("event_time"),
        F.when(flag == "N", 0).when(flag == "A", 1).otherwise(2).alias("offer_type"),
        status.alias("status_id"),
        F.when(free, None).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 400).alias("offer_price"),
        F.when(free, None)
        .otherwise(F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), F.col("l_shipdate")))
        .alias("response_time"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )


def listings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    done = F.col("o_orderstatus") == "F"
    keys = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", _listing_key("o_custkey", "o_orderkey").alias("listing_id"))
        .agg(
            (F.min(F.when(done, F.col("o_totalprice"))) / 500).alias("item_price"),
            F.min(F.when(done, F.col("o_orderkey"))).cast("string").alias("buyer_id"),
        )
    )
    nation = F.col("c_nationkey")
    return keys.join(cust, cust.c_custkey == keys.o_custkey).select(
        "listing_id",
        nation.cast("string").alias("seller_id"),
        F.col("c_mktsegment").alias("category"),
        F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal") / 8).alias("start_price"),
        "item_price",
        F.when(F.col("c_custkey") % 5 == 0, None)
        .when(F.col("c_custkey") % 2 == 0, 3000)
        .otherwise(1000)
        .alias("condition_id"),
        F.when(nation % 6 == 0, None).otherwise(90 + nation % 10).alias("feedback"),
        "buyer_id",
        F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0).alias("bo_ck"),
        F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0).alias("bin_rev"),
        F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_custkey") % 40).alias("count4"),
    )


def thread_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread keys straight from the line scan, to look for hot threads in."""
    key = F.col("l_orderkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(key.alias("thread_id"), key.alias("buyer_id"))

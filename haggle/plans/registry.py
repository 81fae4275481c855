"""Named queries: a Spark builder and the SQL that checks it.

`view()` names a common table expression; a query's SQL gets the views it
mentions prepended. Doubles are rounded on both sides, since the order of
addition is free in a parallel sum."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.session import scratch_path

Builder = Callable[[SparkSession, str], DataFrame]

VIEWS: dict[str, str] = {}
QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    rounded: dict[str, int]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if not self.rounded:
            return df
        return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in self.rounded.items()})

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_views(self.sql)
        if not self.rounded:
            return body
        parts = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in self.rounded.items())
        return f"SELECT * REPLACE ({parts}) FROM ({body}) q"


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def with_views(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 8) -> Callable[[Builder], Builder]:
    """Register a builder. `doubles` lists result columns to round, as
    `name` or `name:digits`."""
    rounded = {}
    for item in doubles.split():
        col, _, d = item.partition(":")
        rounded[col] = int(d) if d else digits

    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, fn, sql, rounded)
        return fn

    return wrap


view("v_turns", """
SELECT CONCAT(CAST(o.o_custkey AS STRING), '-', CAST(o.o_orderkey % 5 AS STRING)) AS listing_id,
       CAST(l.l_orderkey AS STRING) AS buyer_id,
       CAST(l.l_orderkey AS STRING) AS thread_id,
       l.l_shipdate AS event_time,
       CASE l.l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS offer_type,
       CASE l.l_partkey % 20 WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN 8
            WHEN 4 THEN 0 WHEN 5 THEN 6 ELSE 2 END AS status_id,
       CASE WHEN l.l_tax = 0 THEN NULL
            ELSE l.l_extendedprice * (1 - l.l_discount) / 400 END AS offer_price,
       CASE WHEN l.l_tax = 0 THEN NULL
            ELSE l.l_shipdate + to_hours(CAST(l.l_quantity AS INTEGER)) END AS response_time,
       l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")

view("v_listings", """
SELECT k.listing_id,
       CAST(c.c_nationkey AS STRING) AS seller_id,
       c.c_mktsegment AS category,
       CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal / 8 END AS start_price,
       k.item_price,
       CASE WHEN c.c_custkey % 5 = 0 THEN NULL WHEN c.c_custkey % 2 = 0 THEN 3000 ELSE 1000 END AS condition_id,
       CASE WHEN c.c_nationkey % 6 = 0 THEN NULL ELSE 90 + c.c_nationkey % 10 END AS feedback,
       k.buyer_id,
       CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS bo_ck,
       CASE WHEN c.c_custkey % 4 = 0 THEN 1 ELSE 0 END AS bin_rev,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_custkey % 40 END AS count4
FROM customer c
JOIN (SELECT o_custkey,
             CONCAT(CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 5 AS STRING)) AS listing_id,
             MIN(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 500 AS item_price,
             CAST(MIN(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS STRING) AS buyer_id
      FROM orders GROUP BY 1, 2) k ON k.o_custkey = c.c_custkey""")


_STAGED: dict[tuple[str, ...], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], write: Callable[[str], None]) -> str:
    """Path of an input that several queries read, written once per session to the shared
    folder. Tables that changed since (names, lengths, times of files) make a new one."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in tables]).select("path", "length", "modificationTime")
    state = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, sf_dir, name, str(state))
    if key not in _STAGED:
        path = scratch_path(spark, name)
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input view in portable SQL, read by Spark from the same tables. Only
    inputs are built this way; what is checked runs through the operators."""
    sql = with_views(f"SELECT * FROM {name}")
    for t in _TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)

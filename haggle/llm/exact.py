"""Exact duplicates by an extendible-hash index in shared files, in DataFrame operations only.

A document's place is the leading bits of a 64-bit hash of its text. The directory
doubles until a bucket's texts fit the capacity; where they do not, the bucket splits
on the next bit. Entries of one bucket are written by one owner, equal hashes chained
after their bytes were compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.session import scratch_path

#: Bytes of text of one bucket before it splits.
CAPACITY = 64 << 20

#: Bits of the directory at most: 2^20 buckets. It bounds the directory, not the
#: rows: a bucket that is overfull at this depth stays whole and spills.
MAX_DEPTH = 20


def directory(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, depth) of the buckets: a slot is the leading `depth` bits of `h`.

    `rows` has h bigint and size bigint. Sizes are summed for each prefix at the
    finest depth in question, and each prefix keeps the first depth at which it fits.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    finest = min(MAX_DEPTH, (max(1, total // capacity)).bit_length() + 3)
    fine = rows.groupBy(F.shiftrightunsigned("h", 64 - finest).alias("fine")).agg(F.sum("size").alias("size"))
    levels = fine.select("fine", "size", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth"))
    slot = F.expr(f"shiftright(fine, {finest} - depth)")
    sized = levels.withColumn("slot", slot).withColumn("total", F.sum("size").over(Window.partitionBy("depth", "slot")))
    fits = F.min(F.when((F.col("total") <= capacity) | (F.col("depth") == finest), F.col("depth")))
    return sized.groupBy("fine").agg(fits.alias("depth")).select("fine", "depth", F.lit(finest).alias("finest"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("size"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> str:
    """Write the index of the distinct texts and return its path.

    An entry has bucket and depth, h, size, sha, chain (its place among the texts
    with the same hash), keep_id, n and twin (another text has the same hash, size
    and digest). Texts of twins, if there are any, stand in a table beside it.
    """
    spark = docs.sparkSession
    rows = _hashed(docs, id_col, text_col)
    places = directory(rows.select("h", "size"), capacity)
    finest = places.agg(F.max("finest")).first()[0] or 0
    # copies meet before the shuffle: a row per task and text, equal by all their bytes
    texts = rows.groupBy("h", "size", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    fine = F.shiftrightunsigned("h", 64 - finest) if finest else F.lit(0).cast("long")
    entries = texts.select("h", "size", _sha(F.col("text")).alias("sha"), "keep_id", "n", fine.alias("fine"))
    # the directory has 2^20 rows at most, by MAX_DEPTH
    owned = entries.join(F.broadcast(places.drop("finest")), "fine").withColumn("bucket", F.expr(f"shiftright(fine, {finest} - depth)"))
    chained = owned.drop("fine").repartition("bucket", "depth").withColumns({
        "chain": F.row_number().over(Window.partitionBy("bucket", "depth", "h").orderBy("size", "sha", "keep_id")),
        "twin": F.count(F.lit(1)).over(Window.partitionBy("bucket", "depth", "h", "size", "sha")) > 1,
    })
    path = scratch_path(spark, "hash-index")
    chained.sortWithinPartitions("bucket", "depth", "h", "chain").write.parquet(f"{path}/entries")
    twins = spark.read.parquet(f"{path}/entries").where("twin").select("h", "size", "sha")
    if not twins.isEmpty():
        same = texts.withColumn("sha", _sha(F.col("text"))).join(twins.distinct(), ["h", "size", "sha"], "left_semi")
        same.select("text", "sha", "keep_id", "n").write.parquet(f"{path}/twins")
    return path


def look_up(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs in the index: its id, keep_id, group_size, kept and text_sha256."""
    spark = docs.sparkSession
    rows = _hashed(docs, id_col, text_col).withColumn("sha", _sha(F.col("text")))
    entries = spark.read.parquet(f"{index}/entries")
    plain = entries.where(~F.col("twin")).select("h", "size", "sha", "keep_id", "n")
    found = rows.drop("text").join(plain, ["h", "size", "sha"]).select("id", "keep_id", "n", "sha")
    if not entries.where("twin").isEmpty():
        found = found.unionByName(rows.join(spark.read.parquet(f"{index}/twins"), ["text", "sha"]).select("id", "keep_id", "n", "sha"))
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.col("sha").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: its id, keep_id (the largest id with the same text),
    group_size, kept and text_sha256.

    Texts are equal when all their bytes are. A null text counts as empty, so nulls
    and empty texts are one group. A repeated row is a row of its own; copies with
    one id are all marked kept. A null id is kept only where its group has no other.
    Other columns are not read; an empty table gives an empty result.
    """
    return look_up(docs, build_index(docs, id_col, text_col, capacity), id_col, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """docs without exact copies: of equal texts the row with the largest id stays,
    one row where that id is repeated. All columns are kept as they are."""
    entries = docs.sparkSession.read.parquet(f"{build_index(docs, id_col, text_col, capacity)}/entries")
    stay = entries.select(F.col("keep_id").alias("__stay_id"), F.col("sha").alias("__stay_sha"))
    rows = docs.withColumn("__sha", _sha(F.coalesce(F.col(text_col), F.lit(""))))
    same = rows["__sha"] == stay["__stay_sha"]
    kept = rows.join(stay, same & rows[id_col].eqNullSafe(stay["__stay_id"]), "left_semi")
    return kept.dropDuplicates([id_col, "__sha"]).drop("__sha")

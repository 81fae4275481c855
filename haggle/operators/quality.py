"""Cleaning and checks: quarantine, typed projections, duplicates, profiles."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haggle.functions.scalar import first_match, row_hash
from haggle.operators.ordered import done, grouped, with_previous, with_row_number, with_running
from haggle.operators.tasks import STATUSES, decode_codes
from haggle.session import scratch_path, written


def quarantine(df: DataFrame, rules: dict[str, Column], examples: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, bad rows with the first broken rule, and per reason the count
    and the first hashes in order (Q1). Values never leave the bad rows. The
    hashes are chosen by a bounded aggregate: min_by keeps `examples` per task."""
    marked = df.withColumn("reason", first_match(rules))
    good, bad = marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
    hashed = bad.select("reason", row_hash(df.columns).alias("h"))
    counts = hashed.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    # the rank filter is a grouped limit: Spark keeps the top rows per task first
    top = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy("h"))).filter(F.col("_r") <= examples)
    shown = top.groupBy("reason").agg(F.array_sort(F.collect_list("h")).alias("example_hashes"))
    return good, bad, counts.join(shown, "reason")


def thread_rules() -> dict[str, Column]:
    """Row rules of the turn source, in order (Q2)."""
    blank = F.lit(False)
    for c in ("anon_thread_id", "anon_item_id", "anon_byr_id", "anon_slr_id"):
        blank = blank | (F.coalesce(c, F.lit("")) == "")
    return {
        "missing_required_thread_identifier": blank,
        "unknown_status_id": ~F.coalesce(F.col("status_id").isin([str(k) for k in STATUSES]), F.lit(False)),
        "unknown_offr_type_id": ~F.coalesce(F.col("offr_type_id").isin("0", "1", "2"), F.lit(False)),
    }


def drop_exact_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows, and how many were dropped (Q7). The group key is the whole
    row, so copies are combined before the shuffle."""
    per = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per.drop("_n"), per.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def dedupe_key(df: DataFrame, key: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """First row per key by ordinal, and the later ones (Q8): an aggregate and a
    join, so a key held by a third of all rows is not sorted in one task."""
    first = df.groupBy(key).agg(F.min(ordinal).alias("_first"))
    j = df.join(first, key)
    keep = F.col(ordinal) == F.col("_first")
    return j.filter(keep).drop("_first"), j.filter(~keep).drop("_first").withColumn("reason", F.lit(f"duplicate_{key}"))


def limit_threads(df: DataFrame, thread: str, ordinal: str, n: int) -> DataFrame:
    """Rows of the first n threads in source order (Q9)."""
    first = df.groupBy(thread).agg(F.min(ordinal).alias("_o")).orderBy("_o").limit(n).select(thread)
    return df.join(first, thread, "left_semi")


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def safe_double(c: str) -> Column:
    return _text(c).try_cast("double")


def safe_int(c: str) -> Column:
    return _text(c).try_cast("double").cast("long")


def safe_flag(c: str) -> Column:
    return F.when(_text(c) == "1", True).when(_text(c) == "0", False)


MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _iso_text(t: Column) -> Column:
    """01may2012 11:00:00 as 2012-05-01 11:00:00, so that the plain cast reads it."""
    at = F.instr(F.lit(MONTHS), F.substring(t, 3, 3))
    month = F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0")
    day = F.concat(F.substring(t, 6, 4), F.lit("-"), month, F.lit("-"), F.substring(t, 1, 2))
    return F.when((at > 0) & (at % 3 == 1), F.concat(day, F.substring(t, 10, 9)))


def source_date(c: str) -> Column:
    """01may2012 as a date. Cells of another length go through the slower parser."""
    t = F.lower(_text(c))
    return F.when(F.length(t) == 9, _iso_text(t).try_cast("date")).otherwise(F.try_to_timestamp(F.initcap(t), F.lit("ddMMMyyyy")).cast("date"))


def source_time(c: str) -> Column:
    """01may2012 11:00:00 as a timestamp."""
    t = F.lower(_text(c))
    return F.when(F.length(t) == 18, _iso_text(t).try_cast("timestamp")).otherwise(F.try_to_timestamp(F.initcap(t), F.lit("ddMMMyyyy HH:mm:ss")))


TURN_CASTS = {
    "amount": ("offr_price", safe_double), "event_date": ("src_cre_dt", source_date), "event_time": ("src_cre_date", source_time),
    "response_time": ("response_time", source_time), "seller_feedback_score_at_offer": ("fdbk_score_src", safe_int),
    "seller_feedback_positive_at_offer": ("fdbk_pstv_src", safe_double), "seller_best_offer_thread_history": ("slr_hist", safe_int),
    "buyer_best_offer_thread_history": ("byr_hist", safe_int), "has_message": ("any_mssg", safe_flag), "buyer_us": ("byr_us", safe_flag),
}
LISTING_CASTS = {
    "listing_price": ("start_price_usd", safe_double), "excluded_reference_price_ref_price4": ("ref_price4", safe_double),
    "excluded_reference_count4": ("count4", safe_int), "start_time": ("auct_start_dt", source_date), "end_time": ("auct_end_dt", source_date),
    "final_sale_price": ("item_price", safe_double), "sold_by_best_offer": ("bo_ck_yn", safe_flag), "photo_count": ("photo_count", safe_int),
    "view_count": ("view_item_count", safe_int), "watcher_count": ("wtchr_count", safe_int), "auto_decline_price": ("decline_price", safe_double),
    "auto_accept_price": ("accept_price", safe_double), "seller_us": ("slr_us", safe_flag), "buyer_us_if_sold": ("buyer_us", safe_flag),
}


def cast_failed(casts: dict) -> Column:
    """A cell with text that does not cast (Q4)."""
    bad = F.lit(False)
    for src, fn in casts.values():
        bad = bad | (_text(src).isNotNull() & fn(src).isNull())
    return bad


def normalize_turns(raw: DataFrame, text_order: bool = False, drop_duplicates: bool = False, version: str = "normalized-v1",
                    probe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed turns numbered inside their thread, and the ids of the rows whose
    cells do not cast. Numbers are given before that rejection, so a rejected
    turn leaves a gap (Q5). With text_order the price sorts as text, as in old
    files. With drop_duplicates copies of a row are left out in the same pass:
    they share the thread and are neighbours in its order.

    Cells are cast once, before the one shuffle, which then moves typed columns
    instead of text, and the rows' hashes as bytes, which sort as their digits do."""
    ids = {"thread_id": "anon_thread_id", "listing_id": "anon_item_id", "buyer_id": "anon_byr_id", "seller_id": "anon_slr_id"}
    cells = [src for src, _ in TURN_CASTS.values()]
    cast = raw.select(
        F.unhex(row_hash(raw.columns)).alias("source_row_id"), *[F.col(c).alias(n) for n, c in ids.items()],
        F.col("offr_type_id").cast("int").alias("_k"), F.col("status_id").cast("int").alias("status_id"),
        *[fn(src).alias(f"_c_{name}") for name, (src, fn) in TURN_CASTS.items()], *[_text(c).isNotNull().alias(f"_has_{c}") for c in cells],
        (F.col("offr_price") if text_order else F.lit(None)).alias("_text"))
    bad = F.lit(False)
    for name, (src, _) in TURN_CASTS.items():
        bad = bad | (F.col(f"_has_{src}") & F.col(f"_c_{name}").isNull())
    typed = cast.select("source_row_id", *ids, "_k", "status_id", "_text", *[F.col(f"_c_{n}").alias(n) for n in TURN_CASTS], bad.alias("_bad"))
    order = ["event_time", "_k", "_text" if text_order else "amount", "source_row_id"]
    g = grouped(typed, ["thread_id"], order, probe)
    if drop_duplicates:
        g = with_previous(g, {"_before": "source_row_id"})
        fresh = F.when(F.col("_is_first") | (F.col("_before") != F.col("source_row_id")), 1).otherwise(0)
        d = done(with_running(g, sums={"turn_index": fresh})).filter(F.col("_is_first") | (F.col("_before") != F.col("source_row_id")))
        d = d.withColumn("turn_index", F.col("turn_index").cast("int"))
    else:
        d = done(with_row_number(g, "turn_index"))
    coded = decode_codes(d.withColumn("source_row_id", F.hex("source_row_id")), "_k", "status_id")
    good = coded.filter(~F.col("_bad")).select("source_row_id", *ids, "turn_index", "actor", "action", "status", "status_id", *TURN_CASTS,
                                               F.lit(version).alias("transformation_version"))
    return good, coded.filter("_bad").select("source_row_id", "thread_id", "turn_index", F.lit("thread_normalization_error").alias("reason"))


# Fixed value: the product id that stands for none.
NO_PRODUCT = "547957"


def normalize_listings(raw: DataFrame, version: str = "normalized-v1") -> tuple[DataFrame, DataFrame]:
    """Typed listings; the later reference price is set apart, never a feature (Q6)."""
    bad = cast_failed(LISTING_CASTS)
    text = {"title_code": "anon_title_code", "category": "anon_leaf_categ_id", "meta_category": "meta_categ_id", "condition": "item_cndtn_id", "buyer_id_if_sold": "anon_buyer_id"}
    good = raw.filter(~bad).select(
        F.col("anon_item_id").alias("listing_id"), row_hash(raw.columns).alias("source_row_id"), F.col("anon_slr_id").alias("seller_id"), *[_text(s).alias(t) for t, s in text.items()],
        F.when(F.col("anon_product_id") != NO_PRODUCT, _text("anon_product_id")).alias("product_id"), F.lit(None).cast("double").alias("reference_price"),
        *[fn(src).alias(name) for name, (src, fn) in LISTING_CASTS.items()], F.lit(version).alias("transformation_version"))
    return good, raw.filter(bad).withColumn("reason", F.lit("listing_normalization_error"))


def linked_listings(listings: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings some thread refers to, and matched and unmatched counts."""
    ids = turns.select("listing_id").distinct()
    kept = listings.join(ids, "listing_id", "left_semi")
    mark = ids.join(listings.select("listing_id", F.lit(1).alias("_m")).distinct(), "listing_id", "left")
    return kept, mark.agg(F.count(F.lit(1)).alias("referenced"), F.count("_m").alias("matched"), F.count_if(F.col("_m").isNull()).alias("unmatched"))


def normalization_summary(turns: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows, ranges, distinct ids and code counts as (section, key, value) text
    rows (Q16)."""
    def rows(df: DataFrame, section: str, cols: dict[str, Column]) -> DataFrame:
        r = df.agg(*[c.alias(k) for k, c in cols.items()])
        return r.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in cols])))

    t = rows(turns, "turns", {"rows": F.count(F.lit(1)), "event_time_min": F.min("event_time"), "event_time_max": F.max("event_time"), "response_time_min": F.min("response_time"),
                              "response_time_max": F.max("response_time")})
    ids = [rows(turns.select(c).distinct(), "turns", {f"distinct_{c}": F.count(c)}) for c in ("thread_id", "listing_id", "buyer_id")]
    ids += [rows(listings.select(c).distinct(), "listings", {f"distinct_{c}": F.count(c)}) for c in ("listing_id", "seller_id", "category")]
    n = rows(listings, "listings", {"rows": F.count(F.lit(1))})
    top = listings.filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(25)
    out = t.unionByName(n).unionByName(top.select(F.lit("top_category").alias("section"), F.col("category").alias("key"), F.col("n").cast("string").alias("value")))
    for d in ids:
        out = out.unionByName(d)
    for c in ("status", "action"):
        out = out.unionByName(turns.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("section"), F.col(c).alias("key"), F.col("n").cast("string").alias("value")))
    return out


# The date formats a profile tries, in order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "ddMMMyyyy", "ddMMMyyyy HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd", "yyyyMMdd"]


#: Lines that one quoted record may span; one that goes on longer has no closing quote and is rejected as one.
RECORD_LINES = 1_000


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files, one row each: file, record (from 0; the header), value (null where it spans
    too many lines), lines and bytes.

    A line begins a record where the quotes before it in its file are even. Splits count their
    own quotes, a running sum in the order of the file tells the parity at each line, so the
    files may be cut anywhere."""
    source = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    own = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    held = scratch_path(spark, "csv-lines")
    source.withColumn("quotes", own.cast("long")).write.parquet(held)  # places of lines are fixed from here on
    lines = spark.read.parquet(held)
    g = with_running(grouped(lines, ["file"], ["block", "at"], lines.select("file")), sums={"upto": F.col("quotes")})
    begins = (F.col("upto") - F.col("quotes")) % 2 == 0
    rows = done(with_running(replace(g, df=g.df.withColumn("begins", begins)), sums={"record": F.col("begins").cast("long")}))
    rows = rows.withColumns({"record": F.col("record") - 1, "ends": F.col("upto") % 2 == 0, "bytes": F.octet_length("value") + 1})
    plain = rows.where("begins AND ends").select("file", "record", "value", F.lit(1).cast("long").alias("lines"), F.col("bytes").cast("long").alias("bytes"))
    parts = rows.where("NOT (begins AND ends)")
    size = parts.groupBy("file", "record").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"))
    short = parts.drop("bytes").join(size.where(F.col("lines") <= RECORD_LINES), ["file", "record"])
    joined = short.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("value"),
                                                 F.first("lines").alias("lines"), F.first("bytes").alias("bytes"))
    endless = size.where(F.col("lines") > RECORD_LINES).select("file", "record", F.lit(None).cast("string").alias("value"), "lines", "bytes")
    return plain.unionByName(joined).unionByName(endless)


def csv_cells(value: Column, delimiter: str = ",") -> Column:
    """The cells of a record; quoted ones without their quotes, doubled quotes as one."""
    d = re.escape(delimiter)
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), value), F.lit(rf'{d}("[^"]*+(?:""[^"]*+)*+"[^{d}]*|[^{d}]*)'), F.lit(1))
    whole = F.lit(r'(?s)^\s*"(.*)"\s*$')
    return F.transform(cells, lambda c: F.when(c.rlike(r'(?s)^\s*".*"\s*$'), F.replace(F.regexp_replace(c, whole, F.lit("$1")), F.lit('""'), F.lit('"'))).otherwise(c))


def profile_lines(lines: DataFrame, fields: int, date_field: int, delimiter: str = ",") -> DataFrame:
    """Profile of CSV records (column `value`, bytes if known) in one aggregate: accepted and
    rejected by field count, parseable dates and their range, bytes (Q10)."""
    parts = csv_cells(F.col("value"), delimiter)
    cell = F.initcap(F.trim(F.try_element_at(parts, F.lit(date_field + 1))))
    when = F.coalesce(*[F.try_to_timestamp(cell, F.lit(f)) for f in DATE_FORMATS])
    ok = F.coalesce(F.size(parts) == fields, F.lit(False))
    size = F.col("bytes") if "bytes" in lines.columns else F.octet_length("value") + 1
    return lines.agg(
        F.count_if(ok).alias("accepted_rows"), F.count_if(~ok).alias("rejected_rows"), F.count_if(ok & when.isNotNull()).alias("dated_rows"),
        F.min(F.when(ok, when)).alias("min_date"), F.max(F.when(ok, when)).alias("max_date"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def profile_csv(spark: SparkSession, path: str, fields: int, date_field: int) -> DataFrame:
    """Profile of CSV files (plain or gz). The first record of each file is its header: left
    out of the counts, and hashed (the first file's). Quoted cells may hold separators and line feeds."""
    records = csv_records(spark, path)
    head = records.where("record = 0").agg(F.min_by(F.sha2("value", 256), "file").alias("header_hash"))
    # one row each
    return profile_lines(records.where("record > 0"), fields, date_field).crossJoin(F.broadcast(head))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A fixed sample of n rows: the smallest seeded hashes, a distributed top-k (Q11)."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def chronological_samples(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The n earliest, n latest and n nearest the midpoint in time (Q12)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    mid = df.agg(((F.min(us) + F.max(us)) / 2).alias("_mid")).withColumn("_k", F.lit(1))
    d = df.withColumn("_k", F.lit(1)).join(F.broadcast(mid), "_k").drop("_k")
    parts = {"earliest": [F.col(ts), F.col(key)], "latest": [F.desc(ts), F.col(key)], "midpoint": [F.abs(us - F.col("_mid")), F.col(key)]}
    out = None
    for name, order in parts.items():
        s = d.orderBy(*order).limit(n).drop("_mid").withColumn("slice", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def redact(df: DataFrame, cols: list[str]) -> DataFrame:
    """Identifiers to 16 hex digits of their hash (Q13)."""
    return df.withColumns({c: F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 16) for c in cols})


#: Rows of a leaf of a table's hash tree.
LEAF_ROWS = 1_024


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed rows in file order to pieces of leaves: a whole leaf as its hash, and what a task
    holds only a part of (LEAF_ROWS row hashes at most) as text. One piece is open at a time."""
    open_at, text = None, b""  # file, first row and row hashes of the open piece

    def piece(at: tuple[str, int], text: bytes) -> tuple:
        n = len(text) // 64
        whole = n == LEAF_ROWS and at[1] % LEAF_ROWS == 0
        return at[0], at[1] // LEAF_ROWS, at[1], n, hashlib.sha256(text).hexdigest() if whole else None, None if whole else text.decode()

    def packed(pieces: list[tuple]) -> pa.RecordBatch:
        kinds = {"file": pa.string(), "leaf": pa.int64(), "at": pa.int64(), "rows": pa.int64(), "h": pa.string(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pieces], t) for i, t in enumerate(kinds.values())], list(kinds))

    for batch in batches:
        if not batch.num_rows:
            continue
        file, row = batch.column("file").dictionary_encode(), batch.column("row").to_numpy()
        which, hashes = file.indices.to_numpy(zero_copy_only=False), batch.column("h").to_numpy(zero_copy_only=False)
        cut = (which[1:] != which[:-1]) | (row[1:] != row[:-1] + 1) | (row[1:] % LEAF_ROWS == 0)
        starts, out = np.flatnonzero(np.append(True, cut)), []
        for a, b in zip(starts, [*starts[1:], len(row)]):
            name, first = file.dictionary[int(which[a])].as_py(), int(row[a])
            goes_on = open_at is not None and name == open_at[0] and first == open_at[1] + len(text) // 64 and first % LEAF_ROWS
            if not goes_on:
                if open_at is not None:
                    out.append(piece(open_at, text))
                open_at, text = (name, first), b""
            text += "".join(hashes[a:b]).encode()
        if out:
            yield packed(out)
    if open_at is not None:
        yield packed([piece(open_at, text)])


def partition_hashes(spark: SparkSession, path: str) -> DataFrame:
    """partition, rows and sha256 of every partition of a Parquet table (Q15): the folder inside the
    table, or the file where there is none.

    Rows are hashed, LEAF_ROWS of them in file order make a leaf, a file's leaves its hash, a
    partition's files its own, so a row of this job never holds more than a leaf. A scan gives rows
    in file order, so leaves are hashed where they are read; only pieces at a task's borders are
    shuffled as row hashes. The result, a row per partition, is written, as its readers take it twice."""
    data = spark.read.parquet(path)
    cells = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in data.columns]
    at = F.col("_metadata.file_path")
    rows = data.select(at.alias("file"), F.col("_metadata.row_index").alias("row"), F.sha2(F.concat_ws("\x1f", *cells), 256).alias("h"))
    pieces = rows.mapInArrow(_runs, "file string, leaf bigint, at bigint, rows bigint, h string, text string")

    def over(df: DataFrame, keys: list[str], place: str, part: str = "h") -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(place, part))), lambda x: x[part])
        return df.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.coalesce(F.max("h") if part != "h" else F.lit(None), F.sha2(F.array_join(ordered, ""), 256)).alias("h"))

    leaves = over(pieces, ["file", "leaf"], "at", "text")
    inside = F.regexp_extract("file", r"((?:[^/]+=[^/]+/)+)[^/]*$", 1)
    name = F.when(inside != "", F.rtrim(inside, F.lit("/"))).otherwise(F.element_at(F.split("file", "/"), -1))
    files = over(leaves, ["file"], "leaf").withColumn("partition", name)
    return written(over(files, ["partition"], "file").withColumnRenamed("h", "sha256"), "partition-hashes")


def verify_partitions(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Failures of a table (partition, rows, sha256) against its manifest: partition, failure, and the
    rows listed and found. A partition is listed twice, missing, unknown, of other rows or of
    another hash; `(table)` stands for the sums of rows."""
    m = manifest.groupBy("partition").agg(F.min("sha256").alias("_want"), F.min("rows").alias("listed_rows"), F.count(F.lit(1)).alias("_n"))
    j = found.select("partition", "sha256", F.col("rows").alias("found_rows")).join(m, "partition", "full")
    code = (F.when(F.col("_n") > 1, "duplicate_partition").when(F.col("sha256").isNull(), "missing_partition").when(F.col("_want").isNull(), "unknown_partition")
            .when(F.col("found_rows") != F.col("listed_rows"), "row_count_mismatch").when(F.col("sha256") != F.col("_want"), "hash_mismatch"))
    single = j.withColumn("failure", code).filter("failure IS NOT NULL").select("partition", "failure", "listed_rows", "found_rows")
    # one row each
    total = manifest.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("listed_rows")).crossJoin(F.broadcast(found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("found_rows"))))
    sums = total.where("listed_rows <> found_rows").select(F.lit("(table)").alias("partition"), F.lit("row_sum_mismatch").alias("failure"), "listed_rows", "found_rows")
    return single.unionByName(sums)


# ---- row checks of the other inputs


def pilot_rules(money: list[str], counts: list[str]) -> dict[str, Column]:
    """Checks of a pilot row (Q17); absent columns are null."""
    neg = lambda cs: [F.coalesce(F.col(c) < 0, F.lit(False)) for c in cs]
    any_of = lambda xs: F.array_contains(F.array(*xs, F.lit(False)), True)
    return {
        "missing_event_time": F.col("event_time").isNull(), "available_before_event": F.coalesce(F.col("available_at") < F.col("event_time"), F.lit(False)),
        "response_before_event": F.coalesce(F.col("response_time") < F.col("event_time"), F.lit(False)),
        "bad_currency": ~F.coalesce(F.col("currency"), F.lit("USD")).rlike("^[A-Z]{3}$"), "negative_money": any_of(neg(money)), "negative_count": any_of(neg(counts))}


def snapshot_rules() -> dict[str, Column]:
    """Checks of a decision snapshot (Q18)."""
    ratio, offer, asking = F.col("offer_to_asking_ratio"), F.col("buyer_offer_amount"), F.col("asking_price")
    return {
        "missing_decision_id": F.coalesce("decision_id", F.lit("")) == "", "cutoff_after_decision": F.coalesce(F.col("observation_cutoff") > F.col("decision_time"), F.lit(False)),
        "action_not_available": ~F.exists("available_actions", lambda a: a["action"] == F.col("action")),
        "ratio_mismatch": F.coalesce(F.abs(ratio - offer / asking) > 1e-3, F.lit(False)) | (offer.isNotNull() & ratio.isNull()),
        "outcome_inconsistent": F.coalesce(F.col("returned") & ~F.col("buyer_paid"), F.lit(False))}


def offer_event_rules() -> dict[str, Column]:
    """Checks of an offer event by its type (Q19)."""
    kind = F.col("event_type")
    parts = F.col("final_sale_price") - F.col("fees") - F.col("refund_amount") - F.col("cost")
    return {
        "unknown_event_type": ~kind.isin("merchant_consent", "offer_opened", "merchant_decision", "outcome_matured", "shadow_recommendation"),
        "offer_without_actions": (kind == "offer_opened") & (F.coalesce(F.size("available_actions"), F.lit(0)) == 0),
        "decision_without_action": (kind == "merchant_decision") & F.col("selected_action").isNull(),
        "paid_and_cancelled": (kind == "outcome_matured") & F.coalesce(F.col("buyer_paid") & F.col("cancelled"), F.lit(False)),
        "margin_mismatch": (kind == "outcome_matured") & F.coalesce(F.abs(F.col("mature_contribution_margin") - parts) > 0.01, F.lit(False))}


def episode_rules(body: Column) -> dict[str, Column]:
    """Checks of a captured episode (Q20)."""
    return {
        "missing_episode_id": F.coalesce("episode_id", F.lit("")) == "", "no_features": F.coalesce(F.size("features"), F.lit(0)) <= 0,
        "non_numeric_feature": F.exists(F.map_values("features"), lambda v: v.isNull() | F.isnan(v)),
        "outcome_before_decision": F.coalesce(F.col("outcome_time") < F.col("decision_time"), F.lit(False)), "source_hash_mismatch": F.sha2(body, 256) != F.col("source_hash")}


def research_rules(json_col: str) -> dict[str, Column]:
    """Checks of a research payload (Q26): money keys are whole minor units, no
    number has a fraction, pseudonyms are present."""
    j = F.col(json_col)
    return {
        "missing_pseudonym": ~F.coalesce(F.get_json_object(j, "$.buyer_pseudonym"), F.lit("")).rlike("^cp_[a-z0-9_]+_[a-f0-9]{32}$"),
        "money_without_minor_units": j.rlike(r'"[a-z_]*(price|amount|cost|fee|margin)"\s*:\s*-?\d'), "fractional_number": j.rlike(r':\s*-?\d+\.\d')}


def capture_status(episodes: DataFrame, as_of: str) -> DataFrame:
    """Episodes by phase, with overdue and missed follow-ups."""
    t = F.lit(as_of).cast("timestamp")
    d = episodes.select("phase", "episode_id", F.explode_outer("followups").alias("f"))
    per = d.groupBy("phase", "episode_id").agg(F.count_if((F.col("f.status") == "open") & (F.col("f.due") < t)).alias("o"), F.count_if(F.col("f.status") == "missed").alias("m"))
    return per.groupBy("phase").agg(F.count(F.lit(1)).alias("episodes"), F.sum("o").alias("overdue"), F.sum("m").alias("missed"))

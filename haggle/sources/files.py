"""Readers and writers: source CSV with a fixed header, partitioned tables,
pilot datasets, snapshots, event logs, webhook payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haggle.operators.quality import partition_hashes, verify_partitions
from haggle.session import written

# The header lines of the source files, in order.
LISTING_COLUMNS = (
    "anon_item_id anon_title_code anon_product_id anon_leaf_categ_id anon_slr_id anon_buyer_id auct_start_dt fdbk_score_start "
    "fdbk_pstv_start auct_end_dt start_price_usd photo_count to_lst_cnt bo_lst_cnt count1 ref_price1 count2 ref_price2 count3 "
    "ref_price3 item_cndtn_id view_item_count wtchr_count meta_categ_id item_price bo_ck_yn ship_time_slowest ship_time_fastest "
    "ship_time_chosen decline_price accept_price bin_rev lstg_gen_type_id store ref_price4 count4 slr_us buyer_us").split()
THREAD_COLUMNS = (
    "anon_item_id anon_thread_id anon_byr_id anon_slr_id src_cre_dt fdbk_score_src fdbk_pstv_src offr_type_id status_id offr_price "
    "src_cre_date response_time slr_hist byr_hist any_mssg byr_us").split()
SIMPLE_LISTING = "listing_id seller_id category condition listing_price reference_price start_time end_time".split()
SIMPLE_TURN = "thread_id listing_id buyer_id seller_id turn_index actor action amount status event_time".split()
CORRUPT = "_corrupt"


def _against(found: list[str], expected: Sequence[str]) -> dict[str, list[str] | bool]:
    return {"missing": [c for c in expected if c not in found], "unexpected": [c for c in found if c not in expected],
            "order_matches": found == list(expected)}


def header_report(spark: SparkSession, path: str, expected: Sequence[str]) -> dict[str, list[str] | bool]:
    """Missing, unexpected and misplaced columns of a CSV, from its first line."""
    line = spark.read.text(path).first()
    return _against([c.strip().strip('"') for c in line[0].split(",")] if line else [], expected)


def header_reports(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """The report of every file under a path, as file, missing, unexpected and order_matches.
    Lines are numbered as they are read and only the least number of each file is aggregated, so
    that no line is held or sorted; a second pass picks those lines. The readers below need no
    such pass, they refuse a file when they meet it. A file without any line has no row."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value")
    lines = lines.withColumn("_n", F.monotonically_increasing_id()).filter("_at = 0")
    # one number per file; lines of a file's start are numbered in file order
    least = written(lines.groupBy("file").agg(F.min("_n").alias("_n")), "first-lines")
    first = lines.join(least, ["file", "_n"]).withColumnRenamed("value", "_h")
    found = F.transform(F.split("_h", ","), lambda c: F.trim(F.translate(c, '"\r\ufeff', "")))
    want = F.array(*[F.lit(c) for c in expected])
    return first.select("file", F.array_except(want, found).alias("missing"), F.array_except(found, want).alias("unexpected"), (found == want).alias("order_matches"))


def _read_fixed(spark: SparkSession, path: str, columns: Sequence[str], partitions: int | None) -> DataFrame:
    """The first file's header is held against the list at once, that of every other file by
    the scan: with column pruning off the parser sees all columns of a file whichever a query
    reads, count() included, and a broken line is broken in every query. A file that differs
    stops the job; `header_reports` names all of them."""
    report = header_report(spark, path, columns)
    if not report["order_matches"]:
        raise ValueError(f"header of {path} does not match: {report}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .option("enforceSchema", False).option("columnPruning", False).csv(path))
    # a gz file is one task; spread its rows before any work on them
    if path.endswith(".gz"):
        return df.repartition(partitions) if partitions else df.repartition(spark.sparkContext.defaultParallelism)
    return df


def read_listings(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The 38-column listing source, all text; broken lines keep their text in `_corrupt`."""
    return _read_fixed(spark, path, LISTING_COLUMNS, partitions)


def read_threads(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The 16-column turn source, all text."""
    return _read_fixed(spark, path, THREAD_COLUMNS, partitions)


def read_simple(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Simple listings and turns, and the rows whose numbers or times do not parse."""
    out, bad = [], []
    plan = {"listings.csv": (SIMPLE_LISTING, {"listing_price": "double", "reference_price": "double", "start_time": "timestamp", "end_time": "timestamp"}),
            "turns.csv": (SIMPLE_TURN, {"turn_index": "int", "amount": "double", "event_time": "timestamp"})}
    for name, (columns, kinds) in plan.items():
        path = f"{folder}/{name}"
        missing = header_report(spark, path, columns)["missing"]
        if missing:
            raise ValueError(f"{path} lacks columns {missing}")
        raw = spark.read.option("header", True).csv(path)
        broken = F.lit(False)
        for c, kind in kinds.items():
            text = F.nullif(F.trim(c), F.lit(""))
            broken = broken | (text.isNotNull() & text.try_cast(kind).isNull())
        bad.append(raw.filter(broken).select(F.lit(name).alias("file"), F.to_json(F.struct("*")).alias("row")))
        out.append(raw.filter(~broken).withColumns({c: F.nullif(F.trim(c), F.lit("")).try_cast(k) for c, k in kinds.items()}))
    return out[0], out[1], bad[0].unionByName(bad[1])


def write_table(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Parquet clustered by key, with a manifest of its partitions' rows and hashes beside the data.
    Rows of one key meet in one file unless the optimiser splits a hot one."""
    spread = df.repartition(partitions, key) if partitions else df.repartition(key)
    spread.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    write_manifest(df.sparkSession, path)


def write_manifest(spark: SparkSession, path: str) -> None:
    """partition, rows and sha256 of a table's partitions, in a folder that its readers skip."""
    partition_hashes(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest")


def check_table(spark: SparkSession, path: str) -> DataFrame:
    """Failures of a table against the manifest written with it; none if it is whole."""
    return verify_partitions(partition_hashes(spark, path), spark.read.parquet(f"{path.rstrip('/')}/_manifest"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """csv, json, jsonl or parquet by extension; {"rows": [...]} is unwrapped."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("rows").alias("r")).select("r.*") if df.columns == ["rows"] else df


# The datasets of a seller pilot, and the extensions looked for in this order.
PILOT_DATASETS = ("listings", "offers", "orders", "fees", "shipping_costs", "cost_basis", "cancellations_unpaid", "returns_refunds", "inventory", "traffic")
PILOT_SUFFIXES = (".csv", ".json", ".jsonl", ".parquet")


def find_pilot(spark: SparkSession, folder: str, manifest: dict[str, str] | None = None) -> dict[str, str]:
    """File of each pilot dataset: the one its manifest names, else that of the dataset's own
    stem. A named file that is absent leaves its dataset out. Folders of part files count."""
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    named, found = manifest or {}, {}
    for name in PILOT_DATASETS:
        for file in [named[name]] if named.get(name) else [name + suffix for suffix in PILOT_SUFFIXES]:
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(home, file)):
                found[name] = file
                break
    return found


def read_pilot(spark: SparkSession, folder: str, manifest: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Pilot datasets by manifest or stem; an unknown dataset in the manifest is an error."""
    unknown = sorted(set(manifest or {}) - set(PILOT_DATASETS))
    if unknown:
        raise ValueError(f"unknown pilot datasets {unknown}")
    return {name: read_rows(spark, f"{folder}/{file}") for name, file in find_pilot(spark, folder, manifest).items()}


def apply_mapping(df: DataFrame, mapping: dict[str, str], required: list[str], optional: list[str]) -> DataFrame:
    """Source columns to canonical ones; 'ignore' drops a column. An unmapped
    source column, an unknown target or a missing required one is an error.
    Empty text and NaN become null."""
    unmapped = [c for c in df.columns if c not in mapping]
    targets = [t for t in mapping.values() if t != "ignore"]
    unknown = [t for t in targets if t not in [*required, *optional]]
    missing = [r for r in required if r not in targets]
    if unmapped or unknown or missing or len(set(targets)) != len(targets):
        raise ValueError(f"mapping: unmapped {unmapped}, unknown {unknown}, missing {missing}")
    kinds = dict(df.dtypes)

    def clean(c: str) -> Column:
        if kinds[c] == "string":
            return F.nullif(F.trim(c), F.lit(""))
        return F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)

    return df.select([clean(s).alias(t) for s, t in mapping.items() if t != "ignore" and s in df.columns])


ACTION = "struct<action:string,amount:double>"
SNAPSHOT_SCHEMA = (f"decision_id string, decision_time string, observation_cutoff string, pre_decision_context map<string,string>, "
                   f"available_actions array<{ACTION}>, action_taken {ACTION}, protected_outcome map<string,string>")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Decision snapshots: JSON lines, an array, or {"snapshots": [...]}."""
    if path.endswith(".jsonl"):
        return spark.read.schema(SNAPSHOT_SCHEMA).json(path)
    wrapped = spark.read.schema(f"{SNAPSHOT_SCHEMA}, snapshots array<string>").option("multiLine", True).json(path)
    plain = wrapped.filter("snapshots IS NULL").drop("snapshots")
    inner = wrapped.select(F.explode("snapshots").alias("j")).select(F.from_json("j", SNAPSHOT_SCHEMA).alias("s")).select("s.*")
    return plain.unionByName(inner)


LOG_SCHEMA = "record_id string, record_type string, written_at timestamp, previous_hash string, record_hash string, payload string"


def read_events(spark: SparkSession, path: str, record_type: str, merchant: str | None = None) -> DataFrame:
    """Records of one type (and merchant) of an append-only log. With folders
    record_type=... only the wanted ones are read."""
    df = spark.read.schema(LOG_SCHEMA).json(path).filter(F.col("record_type") == record_type)
    return df.filter(F.get_json_object("payload", "$.merchant_id") == merchant) if merchant else df


def event_stream(spark: SparkSession, path: str, record_type: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(path).filter(F.col("record_type") == record_type)


def minor(c: Column) -> Column:
    """Decimal money text to minor units; null when it is not money."""
    ok = F.trim(c).rlike(r"^-?\d{1,15}(\.\d{1,2})?$")
    return F.when(ok, (F.trim(c).cast("decimal(18,2)") * 100).cast("long"))


def reference(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("sha256:"), F.sha2(c.cast("string"), 256)))


ORDER_SCHEMA = ("id string, name string, currency string, total_price string, total_tax string, total_discounts string, test boolean, created_at string, "
                "financial_status string, checkout_token string, note_attributes array<struct<name:string,value:string>>, "
                "total_shipping_price_set struct<shop_money:struct<amount:string>>")
REFUND_SCHEMA = ("id string, order_id string, processed_at string, transactions array<struct<kind:string,status:string,amount:string,currency:string>>, "
                 "refund_line_items array<struct<subtotal:string,total_tax:string>>")
RETURN_SCHEMA = "id string, order_id string, status string, total_return_line_items long, updated_at string"


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("p", F.from_json("payload", schema))


def normalize_orders(df: DataFrame) -> DataFrame:
    """Web-order payloads to order rows: money in minor units, references hashed."""
    tx = F.try_element_at(F.filter("p.note_attributes", lambda a: a["name"] == "transaction_id"), F.lit(1))["value"]
    return _parsed(df, ORDER_SCHEMA).select(
        "delivery_id", tx.alias("transaction_id"), reference(F.col("p.id")).alias("order_reference_hash"), reference(F.col("p.name")).alias("order_name_reference_hash"),
        F.upper("p.currency").alias("currency"), minor(F.col("p.total_price")).alias("order_total_minor"), minor(F.col("p.total_tax")).alias("tax_total_minor"),
        minor(F.col("p.total_discounts")).alias("discount_total_minor"), minor(F.col("p.total_shipping_price_set.shop_money.amount")).alias("shipping_total_minor"),
        (F.lower("p.financial_status") == "paid").alias("paid"), (~F.coalesce("p.test", F.lit(False))).alias("production_evidence"))


def normalize_refunds(df: DataFrame) -> DataFrame:
    """Refund payloads: the amount is that of successful refund transactions,
    else of the refunded lines; mixed currencies give none."""
    t = F.filter("p.transactions", lambda x: (F.lower(x["kind"]) == "refund") & (F.lower(x["status"]) == "success"))
    by_tx = F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + minor(x["amount"]))
    by_line = F.aggregate("p.refund_line_items", F.lit(0).cast("long"), lambda s, x: s + minor(x["subtotal"]) + F.coalesce(minor(x["total_tax"]), F.lit(0)))
    some, lines = F.coalesce(F.size(t) > 0, F.lit(False)), F.coalesce(F.size("p.refund_line_items") > 0, F.lit(False))
    currencies = F.array_distinct(F.transform(t, lambda x: F.upper(x["currency"])))
    amount = F.when(some & (F.size(currencies) == 1), by_tx).when(~some & lines, by_line)
    return _parsed(df, REFUND_SCHEMA).select(
        "delivery_id", reference(F.col("p.id")).alias("refund_reference_hash"), reference(F.col("p.order_id")).alias("order_reference_hash"), amount.alias("refund_total_minor"),
        F.when(some & (F.size(currencies) == 1), currencies[0]).alias("currency"),
        F.when(some, "successful_refund_transactions").when(lines, "refund_line_items").otherwise("unavailable").alias("refund_amount_source"))


def normalize_returns(df: DataFrame) -> DataFrame:
    status = F.upper("p.status")
    return _parsed(df, RETURN_SCHEMA).select(
        "delivery_id", reference(F.col("p.id")).alias("return_reference_hash"), reference(F.col("p.order_id")).alias("order_reference_hash"), status.alias("return_status"),
        F.when(status.isin("CLOSED", "CANCELED", "DECLINED"), "closed").otherwise("open").alias("return_exposure_state"), F.col("p.total_return_line_items").alias("total_return_line_items"))


# Webhook topics of each transition, dots read as slashes.
TOPICS = {
    "order_created": ["orders/create", "orders/created"], "order_state": ["orders/paid", "orders/updated"],
    "refund": ["refunds/create", "refunds/created"], "return_opened": ["returns/request", "returns/approve", "returns/reopen", "returns/open", "returns/opened"],
    "return_closed": ["returns/close", "returns/decline", "returns/cancel", "returns/closed"], "cancelled": ["orders/cancelled", "orders/cancel"],
}


def topic_transition(topic: Column, payload: Column) -> Column:
    """Lifecycle transition of a webhook; null when the topic is not supported."""
    t = F.replace(F.lower(topic), F.lit("."), F.lit("/"))
    money, full = F.get_json_object(payload, "$.financial_status"), F.get_json_object(payload, "$.refund_status")
    return (
        F.when(t.isin(TOPICS["order_created"]), "order_created")
        .when(t.isin(TOPICS["order_state"]) & (money == "paid"), "paid").when(t.isin(TOPICS["order_state"]) & (money == "partially_paid"), "payment_pending")
        .when(t.isin(TOPICS["refund"]), F.when(full == "full", "fully_refunded").otherwise("partially_refunded"))
        .when(t.isin(TOPICS["return_opened"]), "return_opened").when(t.isin(TOPICS["return_closed"]), "return_closed").when(t.isin(TOPICS["cancelled"]), "cancelled"))


def normalize_webhooks(df: DataFrame, max_age_hours: int = 24) -> DataFrame:
    """Webhook deliveries to lifecycle events; only ids, times and money leave
    the payload. Works on batches and streams alike."""
    get = lambda p: F.get_json_object("payload", p)
    at = F.try_to_timestamp(F.coalesce(get("$.processed_at"), get("$.updated_at"), get("$.created_at")))
    money = F.coalesce(get("$.total_price"), get("$.amount"))
    d = df.withColumns({"transition_to": topic_transition(F.col("topic"), F.col("payload")), "occurred_at": at})
    age = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros("occurred_at")) / 3.6e9
    state = F.when(F.col("transition_to").isNull(), "unknown_topic").when(F.col("occurred_at").isNull(), "missing_time").when(
        age > max_age_hours, "stale").when(age < -1, "future").otherwise("accepted")
    return d.select("delivery_id", "transition_to", "occurred_at", reference(F.coalesce(get("$.order_id"), get("$.id"))).alias("order_reference_hash"),
                    minor(money).alias("amount_minor"), F.upper(get("$.currency")).alias("currency"), state.alias("delivery_state"))


OFFER_FIELDS = ["offer_amount", "currency", "quantity", "product_title", "product_id", "variant_id", "buyer_contact"]


def normalize_offers(df: DataFrame) -> DataFrame:
    """Storefront offers to events: only known fields, money text to minor
    units, contact hashed; anything else is named as the reason."""
    get = lambda f: F.get_json_object("payload", f"$.{f}")
    extra = F.array_except(F.json_object_keys("payload"), F.array(*[F.lit(f) for f in OFFER_FIELDS]))
    amount, quantity = minor(get("offer_amount")), get("quantity").try_cast("int")
    reason = F.when(F.json_object_keys("payload").isNull(), "not_an_object").when(F.size(extra) > 0, "unexpected_field").when(
        amount.isNull() | (amount <= 0), "bad_amount").when(~F.coalesce(get("currency"), F.lit("")).rlike("^[A-Z]{3}$"), "bad_currency").when(
        quantity.isNull() | (quantity < 1), "bad_quantity").when(F.length(get("product_title")) > 255, "bad_title")
    return df.select("delivery_id", reason.alias("reason"), amount.alias("offer_amount_minor"), get("currency").alias("currency"), quantity.alias("quantity"),
                     get("product_title").alias("product_title"), reference(get("product_id")).alias("product_reference_hash"), reference(F.lower(F.trim(get("buyer_contact")))).alias("buyer_contact_reference"))


# The fields that each merchant action may carry, and the event it becomes.
ACTION_FIELDS = {"accept": ("store_id",), "counter": ("store_id", "counter_amount", "currency"), "decline": ("store_id",)}
ACTION_EVENTS = {"accept": "merchant_accepted", "counter": "merchant_countered", "decline": "merchant_declined"}


def normalize_merchant_actions(df: DataFrame) -> DataFrame:
    """Merchant actions (delivery_id, action, payload) to events. A store id is text of 1 to 255
    characters once trimmed, a counter needs money above zero (text, or a plain number) and may
    name its currency, USD if it does not. The first rule an action breaks is its reason, and
    then no value leaves the payload."""
    parsed = F.try_parse_json("payload")
    kind = lambda f: F.try_variant_get(F.col("_v"), f"$.{f}", "variant")
    text = lambda f: F.when(F.schema_of_variant(kind(f)) == "STRING", F.trim(F.try_variant_get(F.col("_v"), f"$.{f}", "string")))
    d = df.withColumns({"_v": parsed, "_keys": F.json_object_keys("payload")})
    allowed = F.try_element_at(F.create_map(*[x for a, fields in ACTION_FIELDS.items() for x in (F.lit(a), F.array(*[F.lit(f) for f in fields]))]), F.col("action"))
    number = F.schema_of_variant(kind("counter_amount")).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    amount = F.when(number, F.try_variant_get(F.col("_v"), "$.counter_amount", "string")).otherwise(text("counter_amount"))
    money = F.when(amount.rlike(r"^(0|[1-9]\d{0,13})(\.\d{1,2})?$"), minor(amount))
    currency = F.when(F.array_contains("_keys", "currency"), F.upper(text("currency"))).otherwise("USD")
    counter, store = F.col("action") == "counter", text("store_id")
    reason = (
        F.when(allowed.isNull(), "unknown_action").when(F.col("_keys").isNull(), "not_an_object")
        .when(F.size(F.array_except("_keys", allowed)) > 0, "unexpected_field")
        .when(~F.coalesce(F.length(store).between(1, 255), F.lit(False)), "bad_store_id")
        .when(counter & ~F.coalesce(money > 0, F.lit(False)), "bad_amount")
        .when(counter & ~F.coalesce(currency.rlike("^[A-Z]{3}$"), F.lit(False)), "bad_currency"))
    good = lambda c, when=F.lit(True): F.when(F.col("reason").isNull() & when, c)
    event = F.try_element_at(F.create_map(*[x for a, e in ACTION_EVENTS.items() for x in (F.lit(a), F.lit(e))]), F.col("action"))
    return d.withColumn("reason", reason).select(
        "delivery_id", "reason", good(event).alias("transition_to"), good(store).alias("store_id"),
        good(money, counter).alias("counter_amount_minor"), good(currency, counter).alias("currency"))


def generate(spark: SparkSession, turns: int, listings: int) -> tuple[DataFrame, DataFrame]:
    """Deterministic listings and turns of any size, for load tests."""
    i = F.col("id")
    lst = spark.range(listings).select(
        F.concat(F.lit("l"), i.cast("string")).alias("listing_id"), F.concat(F.lit("s"), (i % 997).cast("string")).alias("seller_id"),
        F.concat(F.lit("c"), (i % 31).cast("string")).alias("category"), (F.lit(20.0) + (i * 7) % 900).alias("listing_price"))
    t = (i / 3).cast("long")
    trn = spark.range(turns).select(
        F.concat(F.lit("t"), t.cast("string")).alias("thread_id"), F.concat(F.lit("l"), (t % listings).cast("string")).alias("listing_id"),
        F.concat(F.lit("b"), (t % 7919).cast("string")).alias("buyer_id"), (i % 3 + 1).cast("int").alias("turn_index"),
        F.when(i % 3 == 1, 2).otherwise(F.when(i % 3 == 0, 0).otherwise(1)).alias("offer_type"), F.when(i % 3 == 2, F.when(t % 2 == 0, 1).otherwise(2)).otherwise(7).alias("status_id"),
        (F.lit(10.0) + (i * 13) % 700).alias("offer_price"), F.timestamp_add("SECOND", ((i * 60) % 31_536_000).cast("int"), F.lit("2012-05-01 00:00:00").cast("timestamp")).alias("event_time"))
    return lst, trn

"""Privacy: scans, pseudonyms, consent, retention, consent-gated datasets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haggle.operators.split import id_set_hash
from haggle.session import scratch_path

# Patterns of direct identifiers in text.
VALUE_PATTERNS = {
    "email address": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone number": r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s*|\d{3}[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)",
    "ip address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "postal address": r"(?i)\b\d{1,6}\s+[A-Z0-9.'-]+(?:\s+[A-Z0-9.'-]+){0,5}\s+(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|way|court|ct|place|pl)\b",
    "commerce identifier": r"(?i)\bgid://shopify/(?:customer|checkout|order|fulfillment|payment|cart)/",
    "url": r"(?i)^\s*https?://[^/\s]+",
}
_NAME_PARTS = r"[._:/\\ -]"
INTERNAL_TOKEN = r"^\s*(cp_[a-z0-9_]+_[a-f0-9]{16,64}|[a-f0-9]{24,128})\s*$"
REPORT_PATTERNS = {
    "raw commerce identifier": r"gid://shopify/", "checkout or order url": r"https?://\S+",
    "email address": VALUE_PATTERNS["email address"], "phone number": VALUE_PATTERNS["phone number"],
    "raw token": r"(?i)\b(?:access|refresh|token|secret)[-_A-Za-z0-9]{8,}\b",
}

# Names and name parts of direct identifiers.
DIRECT_KEYS = (
    "address billing_address buyer_email buyer_handle buyer_id buyer_name contact_email contact_id customer_email customer_gid customer_id "
    "customer_name email first_name full_name ip ip_address last_name name phone phone_number postal_address shipping_address "
    "shopify_customer_gid shopify_customer_id street_address user_id").split()
CONTEXT = "buyer client contact customer person shopper user".split()
IDENTIFIER = "account gid handle id ids name".split()
CONTACT = "address email ip phone".split()
FREE_TEXT = "comment memo message note notes".split()
OPERATIONAL = "checkout fulfillment payment shopify".split()
PSEUDONYM = "pseudo pseudonym pseudonymous hashed tokenized".split()


def _leaves(dtype: T.DataType, col: Column, path: str) -> list[tuple[str, Column]]:
    """Text leaves of a column as arrays of strings."""
    if isinstance(dtype, T.StringType):
        return [(path, F.array(col))]
    if isinstance(dtype, T.StructType):
        return [x for f in dtype.fields for x in _leaves(f.dataType, col[f.name], f"{path}.{f.name}")]
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return [(f"{path}[]", col)]
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return [x for f in dtype.elementType.fields for x in _leaves(T.ArrayType(f.dataType), col[f.name], f"{path}[].{f.name}")]
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
        return [(f"{path}{{}}", F.map_values(col))]
    return []


def pii_findings(df: DataFrame, columns: list[str], token_columns: list[str] | None = None) -> DataFrame:
    """Rows per (path, kind) whose text looks like a direct identifier (Q21). The
    counts come from one aggregate over the scan; no value is put out. Internal
    tokens pass in the columns that may hold them."""
    leaves = [x for c in columns for x in _leaves(df.schema[c].dataType, F.col(c), c)]
    counts = {}
    for path, texts in leaves:
        exempt = path.split(".")[0].split("[")[0] in (token_columns or [])
        for kind, pattern in VALUE_PATTERNS.items():
            hit = F.exists(texts, lambda t: F.coalesce(t.rlike(pattern), F.lit(False)) & (~F.coalesce(t.rlike(INTERNAL_TOKEN), F.lit(False)) if exempt else F.lit(True)))
            counts[(path, kind)] = F.count_if(F.coalesce(hit, F.lit(False)))
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("rows")) for i, (p, k) in enumerate(counts)]))).filter("rows > 0")


def report_leaks(df: DataFrame, text: str) -> DataFrame:
    """Rows of rendered report text per forbidden content (Q27)."""
    row = df.agg(*[F.count_if(F.col(text).rlike(p)).alias(f"c{i}") for i, p in enumerate(REPORT_PATTERNS.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("leak"), F.col(f"c{i}").alias("rows")) for i, k in enumerate(REPORT_PATTERNS)])))


#: What makes a name a person's, besides DIRECT_KEYS and unless it holds a part of PSEUDONYM: one of each
#: list of the first kind among its own parts, and one of each of the second among its own or those above it.
PERSON_RULES = (
    ((CONTACT + FREE_TEXT,), ()),
    ((OPERATIONAL, ["gid", "id", "ids", "url"]), ()),
    ((IDENTIFIER + FREE_TEXT,), (CONTEXT,)),
)


def name_parts(key: str) -> set[str]:
    return {t for t in re.split(_NAME_PARTS, key.lower()) if t}


def key_is_pii(key: str, context: set[str]) -> bool:
    """Whether a name points at a person, under names whose parts are `context`."""
    own = name_parts(key)
    ruled = any(all(own & set(x) for x in owns) and all((own | context) & set(x) for x in arounds) for owns, arounds in PERSON_RULES)
    return not own & set(PSEUDONYM) and (key.lower() in DIRECT_KEYS or ruled)


def person_key(key: Column, above: Column) -> Column:
    """key_is_pii for columns: a name and the array of the parts above it."""
    own = F.filter(F.split(F.lower(key), _NAME_PARTS), lambda x: x != "")
    around = F.concat(above, own)

    def one_of(parts: Column, names: list[str]) -> Column:
        return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in names]))

    ruled = F.lower(key).isin(DIRECT_KEYS)
    for owns, arounds in PERSON_RULES:
        held = F.lit(True)
        for x in owns:
            held = held & one_of(own, x)
        for x in arounds:
            held = held & one_of(around, x)
        ruled = ruled | held
    return ~one_of(own, PSEUDONYM) & ruled


def pii_schema_findings(schema: T.DataType, path: str = "$", context: frozenset = frozenset()) -> list[str]:
    """Paths of field names that point at a person, with inherited context (Q22)."""
    found = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            p = f"{path}.{f.name}"
            if key_is_pii(f.name, set(context)):
                found.append(p)
            below = context | name_parts(f.name)
            found += pii_schema_findings(f.dataType, p, frozenset(below))
    elif isinstance(schema, T.ArrayType):
        found += pii_schema_findings(schema.elementType, f"{path}[]", context)
    elif isinstance(schema, T.MapType):
        found += pii_schema_findings(schema.valueType, f"{path}{{}}", context)
    return found


#: Levels of a JSON text that are searched for names, and the finding of a text that goes on below them.
JSON_LEVELS, TOO_DEEP = 100, "(nested too deep)"


def pii_json_keys(df: DataFrame, json_col: str) -> DataFrame:
    """Rows per key of a JSON column that points at a person (Q22), at any depth and with the
    context of the names above it. Each level of nesting is one pass over the objects
    and arrays that the level above holds; nothing is parsed row by row.

    Text that is no JSON has no keys. A text nested beyond JSON_LEVELS, or beyond what
    the parser takes, is a finding of its own, since nobody has seen what it holds."""
    spark = df.sparkSession
    path = scratch_path(spark, "json")
    text = F.col(json_col)
    # brackets that open at once tell a text too deep for the parser from one that is no JSON
    deep = F.length(text) - F.length(F.regexp_replace(text, r"[\[{]", "")) > 1000
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.try_parse_json(text).alias("v"), deep.alias("deep")).where("v IS NOT NULL OR deep")
    rows.select("row", "v", F.array().cast("array<string>").alias("above")).write.parquet(path)
    level, found = spark.read.parquet(path), None
    for _ in range(JSON_LEVELS):
        held = level.where("v IS NOT NULL").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        inner = F.when(F.col("key").isNull(), F.col("above")).otherwise(F.array_distinct(F.concat("above", F.filter(F.split(F.lower("key"), _NAME_PARTS), lambda x: x != ""))))
        nested = F.try_variant_get("value", "$", "map<string,variant>").isNotNull() | F.try_variant_get("value", "$", "array<variant>").isNotNull()
        hit = F.when(F.col("key").isNotNull() & person_key(F.col("key"), F.col("above")), F.lower("key"))
        below = scratch_path(spark, "json")
        held.select("row", F.when(nested, F.col("value")).alias("v"), inner.alias("above"), hit.alias("hit")).where("v IS NOT NULL OR hit IS NOT NULL").write.parquet(below)
        level = spark.read.parquet(below)
        hits = level.where("hit IS NOT NULL").select("row", F.col("hit").alias("key"))
        found = hits if found is None else found.unionByName(hits)
        if level.where("v IS NOT NULL").isEmpty():
            break
    unseen = level.where("v IS NOT NULL").select("row").unionByName(spark.read.parquet(path).where("v IS NULL").select("row"))
    found = found.unionByName(unseen.select("row", F.lit(TOO_DEEP).alias("key")))
    return found.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC by its definition, from built-in hashes; hex."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def pseudonymize(df: DataFrame, column: str, namespace: str, key: bytes, rotation: str, merchant: str = "merchant_id", store: str = "store_id") -> DataFrame:
    """Keyed pseudonyms scoped by merchant, store, namespace and rotation (Q23)."""
    import re

    slug = re.sub(r"[^a-z0-9]+", "_", namespace.strip().lower()).strip("_") or "identifier"
    body = F.to_json(F.struct(F.col(merchant).cast("string").alias("merchant_id"), F.lit(slug).alias("namespace"), F.col(column).cast("string").alias("raw_identifier"),
                              F.lit(rotation).alias("rotation_id"), F.col(store).cast("string").alias("store_id")))
    return df.withColumn("pseudonymous_id", F.concat(F.lit(f"cp_{slug}_"), F.substring(hmac_sha256(key, body), 1, 32)))


def mapping_table(df: DataFrame, column: str) -> DataFrame:
    """Pseudonym to raw identifier, kept apart from the data."""
    return df.select("merchant_id", "store_id", F.col(column).cast("string").alias("raw_identifier"), "pseudonymous_id").distinct()


def delete_subjects(mapping: DataFrame, subjects: DataFrame) -> DataFrame:
    return mapping.join(subjects, ["merchant_id", "store_id", "raw_identifier"], "left_anti")


def _consent_changes(consents: DataFrame, purpose: str) -> DataFrame:
    """Points in time where a purpose's state changes, with their order: at one
    instant a prohibition comes after a grant, and a revocation closes."""
    named = F.array_contains("granted_purposes", purpose)
    barred = F.coalesce(F.array_contains("prohibited_purposes", purpose), F.lit(False))
    d = consents.withColumns({"_g": F.coalesce(named, F.lit(False)), "_b": barred}).filter("_g OR _b")
    rank = F.when(F.col("_b") & ~F.col("_g"), 2).otherwise(1)
    opens = d.select("merchant_id", "store_id", F.col("granted_at").alias("at"), rank.alias("prio"), "record_id", F.col("_g").alias("active"), "revoked_at")
    return opens


def consent_at(consents: DataFrame, purpose: str, as_of: str) -> DataFrame:
    """State of a purpose per (merchant, store) at one time."""
    t = F.lit(as_of).cast("timestamp")
    c = _consent_changes(consents, purpose).filter(F.col("at") <= t)
    last = c.groupBy("merchant_id", "store_id").agg(F.max_by(F.struct("active", "revoked_at"), F.struct("at", "prio", "record_id")).alias("l"))
    return last.select("merchant_id", "store_id", (F.col("l.active") & ~F.coalesce(F.col("l.revoked_at") <= t, F.lit(False))).alias("active"))


def consent_as_of(events: DataFrame, consents: DataFrame, purpose: str, ts: str = "occurred_at", row_id: str = "event_id") -> DataFrame:
    """State of a purpose at the time of every event: events and consents on one
    time line per (merchant, store), the last consent carried forward. A hot
    store is cut into time segments."""
    from haggle.operators.ordered import done, grouped, with_running

    keys = ["merchant_id", "store_id"]
    c = _consent_changes(consents, purpose).select(*keys, F.col("at").alias("_at"), "prio", F.col("record_id").alias("_id"), F.struct("at", "prio", "record_id", "active", "revoked_at").alias("_c"))
    e = events.select(*keys, F.col(ts).alias("_at"), F.lit(9).alias("prio"), F.col(row_id).cast("string").alias("_id"), F.lit(None).cast(c.schema["_c"].dataType).alias("_c"))
    # the greatest consent so far is the latest, as its struct starts with time and order
    g = with_running(grouped(c.unionByName(e), keys, ["_at", "prio", "_id"]), maxes={"last": F.col("_c")})
    out = done(g).filter("prio = 9")
    on = F.col("last.active") & ~F.coalesce(F.col("last.revoked_at") <= F.col("_at"), F.lit(False))
    return out.select(*keys, F.col("_id").alias(row_id), F.coalesce(on, F.lit(False)).alias("active"))


# Fixed value: the one purpose that several merchants' events may be trained on together for.
CROSS_MERCHANT = "cross_merchant_training"


def consent_lineage(pairs: DataFrame, consents: DataFrame, purpose: str, as_of: str) -> DataFrame:
    """The consent that decides for each (merchant, store) at one time: its record, times, a hash
    of them, and whether the purpose is active. A store that was never asked has no record."""
    t = F.lit(as_of).cast("timestamp")
    c = _consent_changes(consents, purpose).filter(F.col("at") <= t)
    last = c.groupBy("merchant_id", "store_id").agg(F.max_by(F.struct("record_id", "at", "revoked_at", "active"), F.struct("at", "prio", "record_id")).alias("l"))
    on = F.col("l.active") & ~F.coalesce(F.col("l.revoked_at") <= t, F.lit(False))
    text = F.concat_ws("|", F.lit(purpose), "merchant_id", "store_id", F.col("l.record_id").cast("string"), F.unix_micros("l.at").cast("string"),
                       F.coalesce(F.unix_micros(F.col("l.revoked_at")).cast("string"), F.lit("-")))
    return pairs.join(last, ["merchant_id", "store_id"], "left").select(
        "merchant_id", "store_id", F.lit(purpose).alias("purpose"), F.col("l.record_id").alias("record_id"), F.col("l.at").alias("granted_at"), F.col("l.revoked_at").alias("revoked_at"),
        F.when(F.col("l").isNotNull(), F.sha2(text, 256)).alias("consent_hash"), F.coalesce(on, F.lit(False)).alias("active"))


def training_dataset(events: DataFrame, consents: DataFrame, purpose: str, as_of: str, cross: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events of stores with active consent, the dataset's lineage (one row) and the consents
    behind it, one per store (A45). Several merchants need `cross`, and that needs the
    cross-merchant purpose; one store without consent stops the export. The id is made of
    the purpose, the number of events and a hash of them that does not depend on order."""
    if cross and purpose != CROSS_MERCHANT:
        raise ValueError("cross-merchant training requires the cross-merchant purpose")
    pairs = events.select("merchant_id", "store_id").distinct()
    behind = consent_lineage(pairs, consents, purpose, as_of)
    gate = behind.agg(F.countDistinct("merchant_id").alias("m"), F.bool_and("active").alias("ok")).first()
    if gate["m"] > 1 and not cross:
        raise ValueError("cross-merchant training is prohibited by default")
    if gate["ok"] is False:
        raise ValueError(f"a store has no active consent for {purpose}")
    body = F.to_json(F.struct(*sorted(events.columns)))
    sums = events.agg(F.count(F.lit(1)).alias("event_count"), F.coalesce(id_set_hash(body), F.lit("0")).alias("event_set_hash"))
    named = F.sha2(F.concat_ws("|", F.lit(purpose), F.col("event_count").cast("string"), "event_set_hash"), 256)
    return events, sums.select(F.lit(purpose).alias("purpose"), "event_count", "event_set_hash", named.alias("dataset_id")), behind


def retention_due(df: DataFrame, as_of: str) -> DataFrame:
    """Records whose retention has run out."""
    return df.filter(F.col("retention_expires_at") <= F.lit(as_of).cast("timestamp"))


def apply_deletions(df: DataFrame, due: DataFrame, keys: list[str], deleted_at: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Records without the deleted ones, and tombstones that hold no content."""
    ids = due.select(*keys).distinct()
    return df.join(ids, keys, "left_anti"), ids.withColumns({"deleted_at": F.lit(deleted_at).cast("timestamp"), "deletion_reason": F.lit(reason)})

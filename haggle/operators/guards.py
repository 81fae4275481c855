"""Leakage guards: feature contracts, reserved keys, controls, token exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haggle.functions.scalar import sha256_hex
from haggle.operators.rank import global_rank
from haggle.operators.split import id_set_hash

# Names allowed as features and names that never may be.
FEATURE_CONTRACT = [
    "category", "condition", "listing_price", "current_actor", "current_action", "current_amount",
    "offer_to_asking_ratio", "round_number", "prior_turn_count", "prior_counter_count", "event_hour",
]
FORBIDDEN_FEATURES = [
    "buyer_id", "seller_id", "listing_id", "thread_id", "row_id", "source_row_id", "status", "status_id",
    "event_time", "response_time", "reference_price", "ref_price4", "excluded_reference_price_ref_price4",
    "buyer_id_if_sold", "sold_by_best_offer", "bo_ck_yn", "item_price", "auto_accept_price", "auto_decline_price",
    "accept_price", "decline_price", "buyer_us_if_sold", "final_sale_price", "accepted_price", "outcome", "label",
    "future_status", "future_turn_count", "terminal_thread_state", "artifact_name",
]
FORBIDDEN_FUTURE = [
    "final_price", "agreement", "future_rounds", "final_status", "event_time", "status", "status_id",
    "response_time", "reference_price", "ref_price4", "excluded_reference_price_ref_price4", "buyer_id_if_sold",
    "sold_by_best_offer", "bo_ck_yn", "item_price", "final_sale_price", "auto_accept_price", "auto_decline_price",
    "accept_price", "decline_price", "accepted_price", "buyer_us_if_sold", "later_response_time", "total_rounds",
]
TERMINAL_TEXT = ["accepted", "declined", "expired", "finalized"]
# Identifiers that no model may use, and the features each canary adds to a case.
IDENTIFIERS = ["seller_id", "buyer_id", "thread_id", "listing_id", "row_id"]
CANARIES = {
    "future_status_canary": ["future_status"], "accepted_price_canary": ["accepted_price", "final_sale_price"],
    "identifier_memorization_canary": ["seller_id", "buyer_id", "thread_id"], "artifact_name_leakage_canary": ["artifact_name"],
}
POST_DECISION = ["observed_action", "later_outcomes", "outcomes", "adherence", "target", "label", "actual_action"]


def _names(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def contract_violations(names: list[str]) -> list[str]:
    """Column names that break the feature contract."""
    return sorted(n for n in set(names) if n in FORBIDDEN_FEATURES or n not in FEATURE_CONTRACT)


def feature_contract(df: DataFrame, features: str) -> DataFrame:
    """Per offending name, the rows whose feature map carries it."""
    keys = F.map_keys(F.col(features))
    bad = F.array_union(F.array_intersect(keys, _names(FORBIDDEN_FEATURES)), F.array_except(keys, _names(FEATURE_CONTRACT)))
    return df.select(F.explode(bad).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))


def no_future_leakage(df: DataFrame, features: str, history: str) -> DataFrame:
    """Rows with a future field in the features or the history (array of maps),
    or with a finished status in the history."""
    keys = F.map_keys(F.col(features))
    hist_keys = F.flatten(F.transform(F.col(history), lambda h: F.map_keys(h)))
    future = _names(FORBIDDEN_FUTURE)
    ended = F.exists(F.col(history), lambda h: F.coalesce(F.lower(F.try_element_at(h, F.lit("status"))).isin(TERMINAL_TEXT), F.lit(False)))
    reason = (
        F.when(F.arrays_overlap(keys, _names(FORBIDDEN_FEATURES)) | (F.size(F.array_except(keys, _names(FEATURE_CONTRACT))) > 0), "feature_contract")
        .when(F.arrays_overlap(keys, future), "future_feature")
        .when(F.arrays_overlap(hist_keys, future) | F.exists(hist_keys, lambda k: k.contains("future_")), "future_history_field")
        .when(ended, "finished_status_in_history")
    )
    return df.withColumn("leak", reason).filter("leak IS NOT NULL")


def reserved_paths(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of post-decision names anywhere in a schema."""
    found = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            p = f"{path}.{f.name}" if path else f.name
            if f.name.lower() in POST_DECISION:
                found.append(p)
            found += reserved_paths(f.dataType, p)
    elif isinstance(schema, T.ArrayType):
        found += reserved_paths(schema.elementType, f"{path}[]")
    elif isinstance(schema, T.MapType):
        found += reserved_paths(schema.valueType, f"{path}{{}}")
    return found


def pre_decision_guard(df: DataFrame, json_col: str, cutoff: str, decision: str) -> DataFrame:
    """Rows whose JSON snapshot carries a reserved key at any depth, or whose
    cutoff lies after the decision. Keys are read as text before a colon."""
    keys = F.transform(F.regexp_extract_all(F.col(json_col), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), lambda k: F.lower(k))
    reason = F.when(F.arrays_overlap(keys, _names(POST_DECISION)), "reserved_key").when(
        F.col(cutoff) > F.col(decision), "cutoff_after_decision")
    return df.withColumn("leak", reason).filter("leak IS NOT NULL")


def rotate_labels(df: DataFrame, order: list, label: str = "label") -> DataFrame:
    """Every row gets the label of the next row in order, the last that of the
    first: a join of rank r to rank r+1 instead of a global window."""
    ranked = global_rank(df, order, "_r", total="_tot")
    given = ranked.select(F.col("_r").alias("_from"), F.col(label).alias("rotated_label"))
    want = F.when(F.col("_r") == F.col("_tot"), 1).otherwise(F.col("_r") + 1)
    return ranked.withColumn("_from", want.cast("long")).join(given, "_from").drop("_from", "_r", "_tot")


def random_row_split(df: DataFrame, row_id: str) -> DataFrame:
    """Three fifths train, by the first 32 bits of the id's hash."""
    head = F.conv(F.substring(sha256_hex(F.col(row_id)), 1, 8), 16, 10).cast("long")
    return df.withColumn("region", F.when(head % 5 < 3, "train").otherwise("evaluation"))


def tied_timestamps(df: DataFrame, ts: str, part: list[str]) -> DataFrame:
    """Distinct times shared by more than one row, per target."""
    per = df.groupBy(*part, ts).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return per.groupBy(*part).agg(F.count(F.lit(1)).alias("tied_timestamps"), F.sum("n").alias("tied_rows"))


def censoring_control(manifest: DataFrame) -> DataFrame:
    """What counting unknown and censored rows as rejections would change; the
    manifest must never do it."""
    hit = F.col("unknown_outcome_rows") + F.col("censored_outcome_rows")
    return manifest.select("target", hit.alias("affected_rows"), (hit > 0).alias("variant_applicable"),
                           (F.col("supervised_rows") + hit == F.col("eligible_rows")).alias("adds_up"))


def canary_controls(df: DataFrame, features: str, part: list[str], used: list[str] | None = None) -> DataFrame:
    """Every row's feature map (null: empty) with each canary added, held against the contract in one
    aggregate: a control passes if all its rows are rejected, and `unchanged`, which adds nothing,
    if none is. The identifier control also wants none of them among the features `used` by a model."""
    keys = F.coalesce(F.map_keys(F.col(features)), F.array().cast("array<string>"))
    own = sorted(set(used or []) & set(IDENTIFIERS))

    def broken(names: list[str]) -> Column:
        seen = F.concat(keys, _names(names)) if names else keys
        return F.arrays_overlap(seen, _names(FORBIDDEN_FEATURES)) | (F.size(F.array_except(seen, _names(FEATURE_CONTRACT))) > 0)

    controls = {**CANARIES, "unchanged": []}
    row = df.groupBy(*part).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(broken(c)).alias(f"_{n}") for n, c in controls.items()])
    found = lambda n: ",".join(own) if n == "identifier_memorization_canary" else ""
    long = row.select(*part, "rows", F.inline(F.array(*[
        F.struct(F.lit(n).alias("control"), F.col(f"_{n}").alias("rejected_rows"), F.lit(found(n)).alias("identifiers_used")) for n in controls])))
    wanted = F.when(F.col("control") == "unchanged", 0).otherwise(F.col("rows"))
    return long.withColumn("passed", (F.col("rejected_rows") == wanted) & (F.col("identifiers_used") == ""))


def lineage(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of the training rows and their feature values."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [row_id, *columns]])
    return df.agg(F.count(F.lit(1)).alias("training_rows"),
                  id_set_hash(F.col(row_id)).alias("row_hash"),
                  id_set_hash(text).alias("feature_hash"))


def case_tokens(cases: DataFrame, content: list[str], source: str) -> DataFrame:
    """Content token and source token of every case."""
    body = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])
    return cases.withColumns({
        "content_token": sha256_hex(F.concat(F.lit("content|"), body)),
        "source_token": F.when(F.col(source).isNotNull(), sha256_hex(F.concat(F.lit("source|"), F.col(source)))),
    })


def exclude_tokens(cases: DataFrame, spent: DataFrame, strict: bool = True) -> DataFrame:
    """Cases none of whose two tokens was spent. Two anti joins on one token
    each, so no case is exploded. An empty token table, or no case left, is an
    error when strict."""
    if strict and spent.isEmpty():
        raise ValueError("no spent tokens given: a new holdout must stay blocked")
    tokens = spent.select("token").distinct()
    left = cases.join(tokens, cases["content_token"] == tokens["token"], "left_anti")
    left = left.join(tokens, left["source_token"] == tokens["token"], "left_anti")
    if strict and left.isEmpty():
        raise ValueError("every case was spent before")
    return left


def token_overlap(cases: DataFrame, spent: DataFrame) -> DataFrame:
    """Tokens of the cases that were spent before, counted."""
    mine = cases.select(F.col("content_token").alias("token")).union(cases.select("source_token")).filter("token IS NOT NULL")
    shared = mine.distinct().join(spent.select("token"), "token", "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("overlap"))



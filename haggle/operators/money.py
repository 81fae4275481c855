"""Decision accounting, money series and append-only ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.functions.scalar import money
from haggle.operators.commerce import latest_by
from haggle.operators.ordered import done, grouped, with_previous, with_row_number, with_running
from haggle.operators.rank import _range_sorted

CENT = "decimal(18,2)"


def decision_accounting(df: DataFrame, costs: list[str], material: list[str]) -> DataFrame:
    """Gross, costs and net per decision in half-up cents. An unknown material
    cost makes the decision ineligible; unknown others count as 0. Nothing is
    imputed (A37)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(material)]))
    ok = F.size("missing_material_costs") == 0
    total = sum((F.coalesce(money(F.col(c)), F.lit(0).cast(CENT)) for c in costs), F.lit(0).cast("decimal(28,2)"))
    gross = F.col("gross_value").cast("decimal(28,6)")
    d = df.withColumn("missing_material_costs", missing).withColumn("total_costs", F.when(ok, total.cast(CENT)))
    d = d.withColumn("net_value", F.when(ok, F.round(gross - F.col("total_costs"), 2).cast(CENT)))
    adj = F.coalesce(F.col("uncertainty_adjustment").cast("decimal(28,6)"), F.lit(0))
    return d.withColumns({"eligible": ok, "gross": money(F.col("gross_value")),
                          "conservative_net": F.round(F.col("net_value") - adj, 2).cast(CENT)})


def effective_entries(entries: DataFrame) -> DataFrame:
    """The latest entry of each decision, then the latest decision of each
    economic event (A38)."""
    last = latest_by(entries, ["decision_id"], ["seq"])
    keyed = last.withColumn("event_key", F.coalesce("economic_event_key", F.col("decision_id")))
    return latest_by(keyed, ["event_key"], ["decision_timestamp", "decision_id"])


def entry_value() -> Column:
    return F.coalesce(F.coalesce("realized_net_value", "conservative_expected_net_value"), F.lit(0)).cast(CENT)


def money_summary(entries: DataFrame) -> DataFrame:
    """Totals, and values by contract, strategy and source in the same pass.
    Paper and real entries together are an error."""
    eff = effective_entries(entries).withColumn("value", entry_value())
    keys = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("key")),
                   *[F.struct(F.lit(d).alias("dimension"), F.coalesce(c, F.lit("unknown")).alias("key"))
                     for d, c in (("contract", "contract_hash"), ("strategy", "strategy_id"), ("source", "source_id"))])
    out = eff.select("*", F.explode(keys).alias("g")).groupBy("g.dimension", "g.key").agg(
        F.count(F.lit(1)).alias("opportunities"), F.count_if(F.col("selected_action") == F.col("no_action_alternative")).alias("no_action"),
        F.sum("value").cast(CENT).alias("value"), F.sum(F.col("capital_required").cast(CENT)).cast(CENT).alias("capital_at_risk"),
        F.sum(F.col("maximum_possible_loss").cast(CENT)).cast(CENT).alias("maximum_possible_loss"), F.min("designation").alias("_a"), F.max("designation").alias("_b"))
    mixed = F.when(F.col("_a") != F.col("_b"), F.raise_error(F.lit("paper and real outcomes cannot be summarized together"))).otherwise(F.col("_a"))
    return out.withColumn("designation", mixed).drop("_a", "_b")


def max_drawdown(df: DataFrame, order: list[str], value: str, key: list[str]) -> DataFrame:
    """Largest fall of the cumulative curve per key, with the positions of peak
    and trough from 0. A key with too many rows is cut into segments."""
    g = with_running(grouped(df, key, order), sums={"cum": F.col(value)})
    g = with_row_number(g, "_pos")
    d = done(with_running(g, maxes={"peak": F.col("cum")}))
    d = d.withColumns({"drop": F.col("peak") - F.col("cum"), "pos": F.col("_pos") - 1})
    best = d.groupBy(*key).agg(F.max_by(F.struct("drop", "peak", F.col("pos").alias("trough")), F.struct("drop", -F.col("pos"))).alias("b"))
    hits = d.select(*key, "cum", "pos").join(best.select(*key, F.col("b.drop").alias("maximum_drawdown"), F.col("b.peak").alias("_p"), F.col("b.trough").alias("trough_index")), key)
    top = hits.filter((F.col("cum") == F.col("_p")) & (F.col("pos") <= F.col("trough_index")))
    out = top.groupBy(*key, "maximum_drawdown", "trough_index").agg(F.min("pos").alias("peak_index"))
    flat = F.col("maximum_drawdown") == 0
    return out.withColumns({"trough_index": F.when(flat, 0).otherwise(F.col("trough_index")), "peak_index": F.when(flat, 0).otherwise(F.col("peak_index"))})


def global_drawdown(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """The same over one series of the whole table: ranges are sorted in
    parallel, and one row per range carries sum and peak to the next."""
    ranked = _range_sorted(df.select(*order, F.col(value).alias("v")), order, None)
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    r = ranked.withColumn("_in", F.sum("v").over(inside))
    per = r.groupBy("_pid").agg(F.sum("v").alias("s"), F.max("_in").alias("m"), F.max("_pos").alias("last"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumns({"_base": F.coalesce(F.sum("s").over(before), F.lit(0)), "_off": F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0))})
    base = base.withColumn("_high", F.max(F.col("_base") + F.col("m")).over(before)).select("_pid", "_base", "_off", "_high")
    d = r.join(F.broadcast(base), "_pid").withColumns({"cum": F.col("_in") + F.col("_base"), "pos": F.col("_off") + F.col("_pos")})
    d = d.withColumn("peak", F.greatest(F.max("cum").over(inside), "_high"))
    d = d.withColumn("drop", F.col("peak") - F.col("cum")).select("cum", "pos", "peak", "drop")
    best = d.agg(F.max_by(F.struct("drop", "peak", F.col("pos").alias("trough")), F.struct("drop", -F.col("pos"))).alias("b")).select(
        F.col("b.drop").alias("maximum_drawdown"), F.col("b.peak").alias("_p"), F.col("b.trough").alias("trough_index"))
    top = d.join(F.broadcast(best), (F.col("cum") == F.col("_p")) & (F.col("pos") <= F.col("trough_index")))
    return top.groupBy("maximum_drawdown", "trough_index").agg(F.min("pos").alias("peak_index"))


def supersession_check(entries: DataFrame, immutable: list[str]) -> DataFrame:
    """First broken rule per entry."""
    keep = {f"_p_{c}": c for c in ["record_hash", "designation", "evidence_state", *immutable]}
    d = done(with_previous(grouped(entries, ["decision_id"], ["seq"]), keep))
    first = F.col("_is_first")
    same = F.lit(True)
    for c in immutable:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    explained = F.coalesce("correction_reason", F.lit("")) != ""
    rule = (
        F.when(first & F.col("supersedes_entry_hash").isNotNull(), "first_entry_supersedes")
        .when(~first & ~F.col("supersedes_entry_hash").eqNullSafe(F.col("_p_record_hash")), "not_linked_to_latest")
        .when(~first & (F.col("designation") != F.col("_p_designation")), "designation_mixed")
        .when(~first & ~same, "immutable_field_rewritten")
        .when(~first & (F.col("evidence_state") == F.col("_p_evidence_state")) & ~explained, "same_state_without_reason")
        .when(~first & F.col("_p_evidence_state").startswith("resolved") & ~explained, "changed_after_resolution")
    )
    return d.withColumn("violation", rule).drop(*keep, "_is_first")


def chain_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), payload), 256)


def verify_chain(records: DataFrame, ledger: list[str], seq: str = "seq") -> DataFrame:
    """Broken links of append-only logs (A41). Each row's own hash is recomputed
    in place; the link is an equality join to the row before, so one log of any
    length spreads over the cluster."""
    before = records.select(*ledger, (F.col(seq) + 1).alias(seq), F.col("record_hash").alias("_prev"))
    d = records.join(before, [*ledger, seq], "left")
    rule = F.when(F.col("record_hash") != chain_hash(F.col("previous_hash"), F.col("payload")), "record_hash_mismatch").when(
        ~F.coalesce("previous_hash", F.lit("")).eqNullSafe(F.coalesce("_prev", F.lit(""))), "previous_hash_mismatch")
    return d.withColumn("violation", rule).filter("violation IS NOT NULL").drop("_prev")


# How an action is taken.
ACTION_MODES = ["reactive", "interventional"]


def validate_contracts(df: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """First broken rule per contract: actions, modes, amounts, no-action."""
    ok = modes or ACTION_MODES
    a = "available_actions"
    rule = (
        F.when(F.coalesce("contract_id", F.lit("")) == "", "missing_contract_id")
        .when(F.size(a) == 0, "no_actions")
        .when(F.exists(a, lambda x: F.coalesce(x["action_id"], F.lit("")) == ""), "missing_action_id")
        .when(F.exists(a, lambda x: ~x["mode"].isin(ok)), "unknown_action_mode")
        .when(F.exists(a, lambda x: (x["capital_required"] < 0) | (x["fixed_costs"] < 0)), "negative_amount")
        .when(~F.exists(a, lambda x: x["action_id"] == F.col("no_action_alternative")), "no_action_missing")
        .when(F.size(F.array_distinct(F.transform(a, lambda x: x["action_id"]))) < F.size(a), "duplicate_action")
    )
    return df.withColumn("violation", rule)

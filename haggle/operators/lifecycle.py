"""Offer lifecycle: idempotent ingest, ordered replay, checks (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.operators.ordered import hot_limit, spread

TX = ["merchant_namespace", "transaction_id"]

# The states a transaction may enter from each state; "" is the start.
TRANSITIONS = {
    "": ["offer_submitted"],
    "offer_submitted": ["offer_expired", "merchant_accepted", "merchant_declined", "merchant_countered", "buyer_countered", "cancelled"],
    "merchant_countered": ["offer_expired", "buyer_accepted", "buyer_declined", "buyer_countered", "cancelled"],
    "buyer_countered": ["offer_expired", "merchant_accepted", "merchant_declined", "merchant_countered", "cancelled"],
    "merchant_accepted": ["checkout_created", "cancelled"],
    "buyer_accepted": ["checkout_created", "cancelled"],
    "checkout_created": ["checkout_expired", "order_created", "payment_pending", "cancelled"],
    "order_created": ["payment_pending", "paid", "cancelled"],
    "payment_pending": ["paid", "cancelled"],
    "paid": ["partially_refunded", "fully_refunded", "return_opened", "mature"],
    "partially_refunded": ["fully_refunded", "return_opened", "mature"],
    "fully_refunded": ["return_opened", "mature"],
    "return_opened": ["return_received", "return_closed"],
    "return_received": ["return_closed"],
    "return_closed": ["return_opened", "mature"],
    "offer_expired": [], "merchant_declined": [], "buyer_declined": [], "checkout_expired": [], "cancelled": [], "mature": [],
}
WEBHOOK_STATES = ["order_created", "payment_pending", "paid", "cancelled", "partially_refunded", "fully_refunded",
                  "return_opened", "return_received", "return_closed"]
ACTION_STATES = ["merchant_accepted", "merchant_declined", "merchant_countered", "checkout_created", "checkout_expired", "cancelled"]


def reachable(state: str) -> list[str]:
    """All states that can still follow."""
    seen: set[str] = set()
    todo = list(TRANSITIONS[state])
    while todo:
        s = todo.pop()
        if s not in seen:
            seen.add(s)
            todo += TRANSITIONS[s]
    return sorted(seen)


def _table(rows: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])


def pending_reason(state: Column, to: Column) -> Column:
    """Why a transition that is not allowed now is refused."""
    later = F.array_contains(F.element_at(_table({k: reachable(k) for k in TRANSITIONS}), state), to)
    return F.when(later, "missing_predecessor").otherwise("invalid_transition")


def outcome_of(state: Column, to: Column, bad_currency: Column) -> Column:
    """applied / pending / error code of one event in one state."""
    allowed = F.array_contains(F.element_at(_table(TRANSITIONS), state), to)
    reason = pending_reason(state, to)
    return (
        F.when(bad_currency, "currency_mismatch").when(allowed, "applied")
        .when(to.isin(WEBHOOK_STATES) & (reason == "missing_predecessor"), "pending").otherwise(reason)
    )


def ingest(events: DataFrame, key: list[str], body_hash: str, ordinal: str) -> DataFrame:
    """Per idempotency key: the first delivery is new, equal bodies are replays,
    other bodies are conflicts (T1). Counts per (key, body) first, so a key
    delivered a billion times costs one row per task."""
    per = events.groupBy(*key, body_hash).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return per.groupBy(*key).agg(
        F.min_by(body_hash, "first").alias("accepted_hash"), F.min_by("n", "first").alias("_same"), F.sum("n").alias("_all"),
    ).select(*key, "accepted_hash", (F.col("_same") - 1).alias("replays"), (F.col("_all") - F.col("_same")).alias("conflicts"))


_ORDER = ["occurred_at", "received_at", "event_id"]


def _with_currency_flag(events: DataFrame) -> DataFrame:
    """Mark events whose currency differs from the transaction's first one and
    that carry no conversion."""
    first = events.groupBy(*TX).agg(F.min_by("currency", F.when(F.col("currency").isNotNull(), F.struct(*_ORDER))).alias("_first"))
    j = events.join(first, TX)
    return j.withColumn("_bad", F.coalesce((F.col("currency") != F.col("_first")) & ~F.col("has_conversion"), F.lit(False))).drop("_first")


def _fold(events: Column) -> Column:
    """Run the transition table over an ordered array of events."""
    none = F.array().cast("array<struct<event_id:string,transition_to:string,outcome:string,state:string>>")
    start = F.struct(F.lit("").alias("state"), none.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        code = outcome_of(acc["state"], e["transition_to"], e["_bad"])
        item = F.struct(e["event_id"].alias("event_id"), e["transition_to"].alias("transition_to"), code.alias("outcome"), acc["state"].alias("state"))
        return F.struct(F.when(code == "applied", e["transition_to"]).otherwise(acc["state"]).alias("state"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(events, start, step)


#: Events of a transaction that fold as one array.
FOLD_EVENTS = 1_000


def _replay_arrays(events: DataFrame) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(*_ORDER, "transition_to", "_bad")))
    return events.groupBy(*TX).agg(packed.alias("_e")).select(*TX, _fold(F.col("_e")).alias("_r")).select(
        *TX, F.col("_r.state").alias("current_state"), F.inline("_r.out"))


def replay_lifecycle(events: DataFrame) -> DataFrame:
    """Every event with its outcome, and the state its transaction ends in.
    Events are folded in (occurred, received, id) order, so late ones take their
    place (T13). A transaction has tens of events and folds as one array. Those with
    more than FOLD_EVENTS (or haggle.hot.rows, if fewer) are spread over ranges, however
    many such transactions there are: each range's part is run once from every possible
    state, the parts are chained, and a second run starts each from its true state."""
    marked = _with_currency_flag(events)
    sizes = events.groupBy(*TX).agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.where(F.col("_n") > min(FOLD_EVENTS, hot_limit(events))).select(*TX)
    if long.isEmpty():
        return _replay_arrays(marked)
    return _replay_arrays(marked.join(long, TX, "left_anti")).unionByName(_replay_long(marked.join(long, TX, "left_semi")))


STATES = list(TRANSITIONS)


def _codes():
    import numpy as np

    index = {s: i for i, s in enumerate(STATES)}
    table = np.tile(np.arange(len(STATES)).reshape(-1, 1), (1, len(STATES)))
    for s, nxt in TRANSITIONS.items():
        for t in nxt:
            table[index[s], index[t]] = index[t]
    return index, table


def _replay_long(marked: DataFrame) -> DataFrame:
    seg = spread(marked.select(*TX, *_ORDER, "transition_to", "_bad"), TX, _ORDER).df.withColumnRenamed("_range_no", "_seg").drop("_range_at")
    parts = [*TX, "_seg"]

    def ends(pdf):
        import numpy as np
        import pandas as pd

        index, table = _codes()
        state = np.arange(len(STATES))
        pdf = pdf.sort_values(_ORDER)
        for t, bad in zip(pdf["transition_to"], pdf["_bad"]):
            if not bad and t in index:
                state = table[state, index[t]]
        row = {k: [pdf[k].iloc[0]] for k in parts}
        return pd.DataFrame({**row, "ends": [state.tolist()]})

    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seg.schema if f.name in parts)
    moves = seg.groupBy(*parts).applyInPandas(ends, f"{key_schema}, ends array<long>")
    # one row per range of a transaction: chain them
    chain = moves.groupBy(*TX).agg(F.array_sort(F.collect_list(F.struct("_seg", "ends"))).alias("s"))
    begin = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<_seg:int,start:long>>").alias("out")),
                        lambda a, x: F.struct(F.element_at(x["ends"], (a["at"] + 1).cast("int")).alias("at"),
                                              F.concat(a["out"], F.array(F.struct(x["_seg"].cast("int").alias("_seg"), a["at"].alias("start")))).alias("out")))
    starts = chain.select(*TX, begin.alias("b")).select(*TX, F.col("b.at").alias("_final"), F.inline("b.out"))
    ready = seg.join(starts, parts)

    def run(pdf):
        import pandas as pd

        index, _ = _codes()
        state = STATES[int(pdf["start"].iloc[0])]
        final = STATES[int(pdf["_final"].iloc[0])]
        rows = []
        pdf = pdf.sort_values(_ORDER)
        for eid, t, bad in zip(pdf["event_id"], pdf["transition_to"], pdf["_bad"]):
            before = state
            if bad:
                code = "currency_mismatch"
            elif t in TRANSITIONS[state]:
                code, state = "applied", t
            elif t in reachable(state):
                code = "pending" if t in WEBHOOK_STATES else "missing_predecessor"
            else:
                code = "invalid_transition"
            rows.append((eid, t, code, before))
        out = pd.DataFrame(rows, columns=["event_id", "transition_to", "outcome", "state"])
        for i, k in enumerate(TX):
            out.insert(i, k, pdf[k].iloc[0])
        out.insert(2, "current_state", final)
        return out

    tx_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seg.schema if f.name in TX)
    return ready.groupBy(*parts).applyInPandas(
        run, f"{tx_schema}, current_state string, event_id string, transition_to string, outcome string, state string")


def transaction_states(replayed: DataFrame) -> DataFrame:
    """State and counts per transaction."""
    o = F.col("outcome")
    return replayed.groupBy(*TX).agg(
        F.max("current_state").alias("current_state"), F.count(F.lit(1)).alias("events"), F.count_if(o == "applied").alias("applied"),
        F.count_if(o == "pending").alias("pending"), F.count_if(~o.isin("applied", "pending")).alias("errors"))


def admit(history: DataFrame, new: DataFrame) -> DataFrame:
    """Whether each new event may join its transaction (T4): it must not undo
    what was applied, and must itself apply, or wait as a webhook. At most one
    new event per transaction is judged at a time. A transaction's events meet once and are
    folded there without and with the new one; those too long for an array (as in
    `replay_lifecycle`) are replayed over ranges, and the outcomes joined."""
    columns = [*TX, *_ORDER, "transition_to", "currency", "has_conversion"]
    events = history.select(*columns, F.lit(False).alias("_new")).unionByName(new.select(*columns, F.lit(True).alias("_new")))
    # events without a transaction's name are in none
    events = events.filter(" AND ".join(f"{c} IS NOT NULL" for c in TX))
    sizes = events.groupBy(*TX).agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.where(F.col("_n") > min(FOLD_EVENTS, hot_limit(events))).select(*TX)
    if long.isEmpty():
        return _admit_arrays(events)
    return _admit_arrays(events.join(long, TX, "left_anti")).unionByName(_admit_long(history.join(long, TX, "left_semi"), new.join(long, TX, "left_semi")))


def _replayed(events: Column) -> Column:
    """Outcomes of an array of events, in replay order."""
    first = F.array_min(F.transform(F.filter(events, lambda x: x["currency"].isNotNull()), lambda x: F.struct(*[x[c].alias(c) for c in _ORDER], x["currency"].alias("currency"))))["currency"]
    bad = lambda x: F.coalesce((x["currency"] != first) & ~x["has_conversion"], F.lit(False))
    return _fold(F.array_sort(F.transform(events, lambda x: F.struct(*[x[c].alias(c) for c in _ORDER], x["transition_to"].alias("transition_to"), bad(x).alias("_bad")))))["out"]


def _admit_arrays(events: DataFrame) -> DataFrame:
    packed = events.groupBy(*TX).agg(F.collect_list(F.struct(*_ORDER, "transition_to", "currency", "has_conversion", "_new")).alias("_e"))
    both = packed.select(*TX, F.transform(F.filter("_e", lambda x: x["_new"]), lambda x: x["event_id"]).alias("_mine"),
                         _replayed(F.filter("_e", lambda x: ~x["_new"])).alias("_before"), _replayed(F.col("_e")).alias("_after"))
    applied = lambda c: F.transform(F.filter(c, lambda x: x["outcome"] == "applied"), lambda x: x["event_id"])
    ids = both.select(*TX, "_mine", "_after", applied("_before").alias("_was"), applied("_after").alias("_is"))
    lost = F.size(F.filter("_was", lambda i: ~F.coalesce(F.array_contains(F.col("_is"), i), F.lit(False)))).cast("long")
    mine = F.flatten(F.transform("_mine", lambda i: F.filter("_after", lambda x: x["event_id"] == i)))
    rows = ids.select(*TX, lost.alias("invalidated"), F.explode(mine).alias("_x"))
    ok = (F.col("invalidated") == 0) & F.col("_x.outcome").isin("applied", "pending")
    return rows.select(*TX, "_x.event_id", "_x.outcome", "invalidated", ok.alias("admitted"))


def _admit_long(history: DataFrame, new: DataFrame) -> DataFrame:
    before = replay_lifecycle(history).filter("outcome = 'applied'").select(*TX, "event_id")
    after = replay_lifecycle(history.unionByName(new)).select(*TX, "event_id", "outcome")
    lost = before.join(after.filter("outcome = 'applied'"), [*TX, "event_id"], "left_anti").groupBy(*TX).agg(F.count(F.lit(1)).alias("invalidated"))
    mine = new.select(*TX, "event_id", "transition_to").join(after, [*TX, "event_id"]).join(lost, TX, "left")
    n = F.coalesce("invalidated", F.lit(0))
    ok = (n == 0) & F.col("outcome").isin("applied", "pending")
    return mine.select(*TX, "event_id", "outcome", n.alias("invalidated"), ok.alias("admitted"))


def validate_lifecycle(events: DataFrame) -> DataFrame:
    """First broken rule per event, null when sound (T5)."""
    t = F.col("transition_to")
    rule = (
        F.when(F.coalesce("event_id", F.lit("")) == "", "missing_event_id")
        .when(~t.isin(STATES[1:]), "unknown_transition")
        .when(F.col("received_at") < F.col("occurred_at"), "received_before_occurred")
        .when(t.isin(ACTION_STATES) & F.col("executed_action").isNull(), "action_state_without_executed_action")
        .when(F.coalesce(F.col("shipping_discount_minor") < 0, F.lit(False)), "negative_discount")
        .when((t == "mature") & (F.col("fees_minor").isNull() | F.col("margin_minor").isNull()), "incomplete_mature_outcome")
        .when((t != "mature") & F.col("margin_minor").isNotNull(), "mature_outcome_outside_mature")
    )
    return events.withColumn("violation", rule)

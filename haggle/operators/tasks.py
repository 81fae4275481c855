"""Supervised cases from turns: five targets, labels, features, manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.functions.scalar import canonical_id, hour_fraction, safe_div, seconds_between
from haggle.operators.ordered import Grouped, done, grouped, with_next, with_running, with_totals

TARGETS = ["seller_next_action", "buyer_response_to_counter", "agreement", "final_price_ratio", "response_latency"]

# Offer type and status codes of the source.
OFFER_TYPES = {0: ("buyer", "offer"), 1: ("buyer", "counter"), 2: ("seller", "counter")}
STATUSES = {0: "expired", 1: "accepted", 2: "declined", 6: "auto_declined", 7: "countered",
            8: "declined_other_buyer_accepted", 9: "auto_accepted"}
NEGATIVE_ACTIONS = ["decline", "expire", "leave", "reject", "quit"]
NEGATIVE_STATUSES = ["declined", "expired", "rejected", "closed_no_agreement"]


def _lookup(c: Column, table: dict) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), c)


def decode_codes(df: DataFrame, type_col: str = "offer_type", status_col: str = "status_id") -> DataFrame:
    """Add actor, action and status from the source codes; unknown codes give null."""
    return df.withColumns({
        "actor": _lookup(F.col(type_col), {k: v[0] for k, v in OFFER_TYPES.items()}),
        "action": _lookup(F.col(type_col), {k: v[1] for k, v in OFFER_TYPES.items()}),
        "status": _lookup(F.col(status_col), STATUSES),
    })


def status_label(status: Column, counter_actor: str, next_actor: Column, next_action: Column) -> Column:
    """accept / decline / expire by status; a countered turn is a counter only
    when the other side really countered next; 8 and the rest stay null."""
    answered = next_actor.eqNullSafe(counter_actor) & next_action.eqNullSafe("counter")
    return (
        F.when(status.isin(1, 9), "accept")
        .when(status.isin(2, 6), "decline")
        .when(status == 0, "expire")
        .when((status == 7) & answered, "counter")
    )


def _agreement(order: str) -> tuple[dict[str, Column], Column, Column]:
    """Aggregates of a thread, and from those its label and whether another buyer won."""
    status, action = F.col("status_id"), F.lower(F.coalesce("action", F.lit("")))
    last = F.struct("status_id", action.alias("action"), F.lower(F.coalesce("status", F.lit(""))).alias("status"))
    aggs = {
        "_deal": F.bool_or(F.coalesce(status.isin(1, 9), F.lit(False))),
        "_other": F.bool_or(F.coalesce(status == 8, F.lit(False))),
        "_accepts": F.bool_or(action == "accept"),
        "_last": F.max_by(last, order),
    }
    lost = (
        F.coalesce(F.col("_last.status_id").isin(0, 2, 6), F.lit(False))
        | F.col("_last.action").isin(NEGATIVE_ACTIONS)
        | F.col("_last.status").isin(NEGATIVE_STATUSES)
    )
    label = F.when(F.col("_deal"), "1").when(F.col("_other"), None).when(F.col("_accepts"), "1").when(lost, "0")
    return aggs, label, F.col("_other")


def agreement_label(turns: DataFrame, key: str = "thread_id", order: str = "turn_index") -> DataFrame:
    """One label per thread: '1', '0', or null when the outcome is not known."""
    aggs, label, other = _agreement(order)
    per = turns.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
    return per.select(key, label.alias("label"), other.alias("has_other"))


def _annotated(turns: DataFrame, probe: DataFrame | None) -> Grouped:
    g = grouped(turns, ["thread_id"], ["turn_index"], probe)
    g = with_next(g, {"next_actor": "actor", "next_action": "action"})
    return with_running(g, sums={"prior_counter_count": F.when(F.col("action") == "counter", 1).otherwise(0),
                                 "prior_turn_count": F.lit(1)}, inclusive=False)


def annotate_turns(turns: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Next actor and action, prior counters and the thread's first listing,
    from one shuffle by thread."""
    return done(_annotated(turns, probe))


def turns_with_listing(turns: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their listing's columns, and the number of threads whose
    first turn names no known listing (J5). A thread's listing is that of its
    first turn."""
    first = turns.groupBy("thread_id").agg(F.min_by("listing_id", "turn_index").alias("listing_id"))
    known = first.join(listings, "listing_id")
    joined = turns.drop("listing_id", "seller_id").join(known, "thread_id")
    lost = first.join(listings.select("listing_id"), "listing_id", "left_anti")
    return joined, lost.agg(F.count(F.lit(1)).alias("excluded_threads"))


_IDS = ["thread_id", "listing_id", "seller_id", "buyer_id"]


def _features() -> list[Column]:
    amount, price = F.col("amount"), F.col("listing_price")
    ratio = F.when((amount != 0) & (price != 0), amount / price)
    return [
        F.col("category"), F.col("condition"), price.alias("listing_price"),
        F.col("actor").alias("current_actor"), F.col("action").alias("current_action"),
        amount.alias("current_amount"), ratio.alias("offer_to_asking_ratio"),
        F.col("turn_index").alias("round_number"),
        F.col("prior_turn_count").cast("long").alias("prior_turn_count"),
        F.col("prior_counter_count").cast("long").alias("prior_counter_count"),
        F.coalesce(hour_fraction(F.col("event_time")), F.lit(0.0)).alias("event_hour"),
    ]


@dataclass(frozen=True)
class _Case:
    """Which turns make a case of a target, and its outcome there."""

    target: str
    suffix: str
    when: Column
    label: Column | None
    value: Column | None
    censored: Column

    def columns(self) -> dict[str, Column]:
        per_turn = self.target not in (TARGETS[2], TARGETS[3])
        parts = [F.col("thread_id").cast("string")] + ([F.col("turn_index").cast("string")] if per_turn else [])
        label = (self.label if self.label is not None else F.lit(None)).cast("string")
        value = (self.value if self.value is not None else F.lit(None)).cast("double")
        state = F.when(label.isNotNull() | value.isNotNull(), "supervised").when(self.censored, "censored").otherwise("unknown")
        return {"row_id": F.concat_ws(":", *parts, F.lit(self.suffix)), "target": F.lit(self.target), "label": label, "value": value, "outcome_state": state}


def _emit(turns: DataFrame, cases: list[_Case]) -> DataFrame:
    """All cases of a turn from one pass over the turns. The features of a
    thread-level case are those of its first turn. Only the case's number is put
    beside the turn, so a reader pays for the columns it takes."""
    rest = [*_features(), *_IDS, F.col("event_time").alias("timestamp")]
    if len(cases) == 1:
        return turns.filter(cases[0].when).select(*[c.alias(n) for n, c in cases[0].columns().items()], *rest)
    which = F.explode(F.array_compact(F.array(*[F.when(c.when, F.lit(i)) for i, c in enumerate(cases)])))
    columns = [c.columns() for c in cases]
    out = []
    for name in columns[0]:
        picked = F.when(F.col("_case") == 0, columns[0][name])
        for i, c in enumerate(columns[1:-1], 1):
            picked = picked.when(F.col("_case") == i, c[name])
        out.append(picked.otherwise(columns[-1][name]).alias(name))
    return turns.withColumn("_case", which).select(*out, *rest)


def case_turns(turns: DataFrame, listings: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Turns with all that their cases are made of: listing, next turn, prior turns and the
    thread's outcome. One row a turn, so this is the form to store; `emit_cases` does the rest."""
    joined, _ = turns_with_listing(turns, listings)
    aggs, label, other = _agreement("turn_index")
    t = done(with_totals(_annotated(joined, probe), aggs)).withColumns({"agreed": label, "has_other": other})
    return t.select(*_IDS, "turn_index", "actor", "action", "amount", "status_id", "event_time", "response_time", "category", "condition", "listing_price",
                    "final_sale_price", "sold_by_best_offer", "next_actor", "next_action", "prior_turn_count", "prior_counter_count", "agreed", "has_other")


def emit_cases(t: DataFrame, target: str | None = None) -> DataFrame:
    """All eligible cases of turns from `case_turns`, of one target or of the five in one long table."""
    status, first = F.col("status_id"), F.col("turn_index") == 1
    is8 = F.coalesce(status == 8, F.lit(False))
    nxt = (F.col("next_actor"), F.col("next_action"))
    seconds = seconds_between(F.col("event_time"), F.col("response_time"))
    price = F.round(safe_div(F.col("final_sale_price"), F.col("listing_price")), 6)
    sold = F.col("sold_by_best_offer") & (F.col("agreed") == "1") & (F.col("listing_price") != 0)
    cases = [
        _Case(TARGETS[0], TARGETS[0], (F.col("actor") == "buyer") & F.col("action").isin("offer", "counter"),
              status_label(status, "seller", *nxt), None, is8),
        _Case(TARGETS[1], "buyer_response", (F.col("actor") == "seller") & (F.col("action") == "counter"),
              status_label(status, "buyer", *nxt), None, is8),
        _Case(TARGETS[2], TARGETS[2], first, F.col("agreed"), None, F.col("has_other")),
        _Case(TARGETS[3], TARGETS[3], first, None, F.when(sold, price), F.col("has_other")),
        _Case(TARGETS[4], TARGETS[4], F.lit(True), None, F.when(~is8 & (seconds >= 0), seconds), is8),
    ]
    return _emit(t, [c for c in cases if target in (None, c.target)])


def build_cases(turns: DataFrame, listings: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """All eligible cases of the five targets in one long table.
    Text labels are in `label`, numbers in `value`."""
    return emit_cases(case_turns(turns, listings, probe))


def build_tasks(turns: DataFrame, listings: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Only the supervised rows."""
    return build_cases(turns, listings, probe).filter(F.col("outcome_state") == "supervised")


def build_tasks_simple(turns: DataFrame, listings: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """The five targets over simple turns, labelled by the next turn's action."""
    joined = turns.drop("seller_id").join(listings, "listing_id")
    g = grouped(joined, ["thread_id"], ["turn_index"], probe)
    g = with_next(g, {"next_actor": "actor", "next_action": "action", "next_time": "event_time"})
    g = with_running(g, sums={"prior_counter_count": F.when(F.col("action") == "counter", 1).otherwise(0),
                              "prior_turn_count": F.lit(1)}, inclusive=False)
    deal = ((F.col("action") == "accept") | F.coalesce(F.col("status_id").isin(1, 9), F.lit(False))) & F.col("amount").isNotNull()
    deals = turns.groupBy("thread_id").agg(
        F.min_by("amount", F.when(deal, F.col("turn_index"))).alias("accepted_amount"), F.bool_or(deal).alias("has_deal"))
    labels = agreement_label(turns).withColumnRenamed("label", "agreed")
    t = done(g).join(labels, "thread_id").join(deals, "thread_id")
    nxt, no, first = F.col("next_action"), F.lit(False), F.col("turn_index") == 1
    next_is = F.coalesce(F.col("next_actor"), F.lit(""))
    return _emit(t, [
        _Case(TARGETS[0], TARGETS[0], (F.col("actor") == "buyer") & (next_is == "seller"),
              F.when(nxt.isin("accept", "counter", "decline"), nxt).otherwise("expire"), None, no),
        _Case(TARGETS[1], "buyer_response", (F.col("actor") == "seller") & (F.col("action") == "counter") & (next_is == "buyer"),
              F.when(nxt.isin("accept", "counter", "expire"), nxt).otherwise("leave"), None, no),
        _Case(TARGETS[2], TARGETS[2], first & F.col("agreed").isNotNull(), F.col("agreed"), None, no),
        _Case(TARGETS[3], TARGETS[3], first & F.col("has_deal"), None,
              F.round(safe_div(F.col("accepted_amount"), F.col("listing_price")), 6), no),
        _Case(TARGETS[4], TARGETS[4], ~F.col("_is_last"), None, seconds_between(F.col("event_time"), F.col("next_time")), no),
    ])


def history_rows(turns: DataFrame) -> DataFrame:
    """Sanitised turns, one row each. A case's history is the rows of its thread
    with turn_index up to its round_number: kept as a relation, so no group is
    ever packed into one array."""
    return turns.select("thread_id", "turn_index", "actor", "action", "amount")


def with_history(cases: DataFrame, turns: DataFrame) -> DataFrame:
    """Cases with the observed prefix as an array, for readers that need it. The
    array is the result itself: its length is the length of the case's history.
    A thread's turns meet its cases once, by thread, as one array, of which each case
    takes its part there: prefixes are not shuffled."""
    item = F.struct("turn_index", "actor", "action", "amount")
    whole = history_rows(turns).groupBy("thread_id").agg(F.array_sort(F.collect_list(item)).alias("_turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("_turns")), lambda i: F.try_element_at("_turns", i)["turn_index"] == F.col("round_number"))
    met = cases.join(whole, "thread_id", "left").withColumn("_end", F.explode_outer(ends))
    rest = [c for c in cases.columns if c not in ("thread_id", "round_number")]
    return met.select("thread_id", "round_number", *rest, F.when(F.col("_end").isNotNull(), F.slice("_turns", F.lit(1), F.col("_end"))).alias("observed_history"))


#: Turns of a chunk of a thread's history.
CHUNK_TURNS = 64


def history_chunks(turns: DataFrame, size: int = CHUNK_TURNS) -> DataFrame:
    """thread_id, chunk (from 0) and turns: each turn once, `size` to a chunk, so that a
    thread of any length is stored once and none of its rows grows with it."""
    item = F.struct("turn_index", "actor", "action", "amount")
    chunk = F.floor((F.col("turn_index") - 1) / size).cast("long")
    return history_rows(turns).groupBy("thread_id", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("turns"))


def with_history_tail(cases: DataFrame, turns: DataFrame, size: int = CHUNK_TURNS) -> DataFrame:
    """Cases with `chunks`, the whole chunks of their history, and `tail`, the fewer than `size`
    turns behind those. Cases of a thread share its chunks, so output grows with turns.
    A case stands behind its last turn in one order of turns and cases, so what already lies
    by thread is not shuffled; both are null where the thread has no such turn."""
    item = F.struct("turn_index", "actor", "action", "amount")
    chunk = lambda at: F.floor((F.col(at) - 1) / size).cast("long")
    rows = history_rows(turns).select("thread_id", F.col("turn_index").alias("_at"), chunk("turn_index").alias("_chunk"), F.lit(0).alias("_case"), item.alias("_turn"))
    asked = cases.withColumns({"_at": F.col("round_number"), "_chunk": chunk("round_number"), "_case": F.lit(1)})
    upto = Window.partitionBy("thread_id", "_chunk").orderBy("_at", "_case").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asked, allowMissingColumns=True).withColumn("_seen", F.collect_list("_turn").over(upto)).where("_case = 1")
    known = F.col("thread_id").isNotNull() & (F.try_element_at("_seen", F.lit(-1))["turn_index"] == F.col("_at"))
    whole = F.size("_seen") == size
    rest = [c for c in cases.columns if c not in ("thread_id", "round_number")]
    tail = F.when(whole, F.array().cast(both.schema["_seen"].dataType)).otherwise(F.col("_seen"))
    return both.select("thread_id", "round_number", *rest, F.when(known, F.col("_chunk") + whole.cast("long")).alias("chunks"), F.when(known, tail).alias("tail"))


def expand_history(cases: DataFrame, chunks: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """`keys` of cases, which tell cases of a thread apart, and columns to `keep`, with their whole
    observed_history as an array, from chunks and tail: for readers that want it, at the length of
    the history itself. A thread's chunks meet its cases once, by thread, as one array, of which each
    case takes its part there. Where keys repeat, a chunk comes once for each of their rows."""
    names = list(dict.fromkeys([*keys, *(keep or [])]))
    pieces = cases.select(*dict.fromkeys([*names, "thread_id", "chunks", "tail"]))
    packed = chunks.where("chunk >= 0").groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "turns"))).alias("_packed"))
    pieces = pieces.withColumn("_upto", F.collect_list("chunks").over(Window.partitionBy("thread_id", *keys)))
    taken = lambda x: F.flatten(F.array_repeat(x["turns"], F.size(F.filter("_upto", lambda n: n > x["chunk"]))))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    before = F.when(known, F.flatten(F.transform("_packed", taken)))
    met = pieces.join(packed, "thread_id", "left")
    return met.select(*names, F.concat(F.coalesce(before, F.array().cast(chunks.schema["turns"].dataType)), "tail").alias("observed_history"))


def task_manifest(cases: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Eligible, supervised, unknown and censored rows per target; every target
    also counts the threads that had no listing."""
    state = F.col("outcome_state")
    out = cases.groupBy("target").agg(
        F.count(F.lit(1)).alias("eligible_rows"),
        F.count_if(state == "supervised").alias("supervised_rows"),
        F.count_if(state == "unknown").alias("unknown_outcome_rows"),
        F.count_if(state == "censored").alias("censored_outcome_rows"),
    )
    if excluded is None:
        return out
    one = excluded.select(F.lit(1).alias("_k"), F.col("excluded_threads").alias("excluded_rows"))
    return out.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")


def canonical_cases(cases: DataFrame) -> DataFrame:
    return cases.withColumns({c: canonical_id(F.col(c)) for c in _IDS})

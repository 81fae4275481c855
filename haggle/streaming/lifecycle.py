"""Streaming forms of the lifecycle operators, by processors with typed state.

State is kept per transaction or idempotency key in the state store: single events in a
map, what a fold needs to go on in one value. Results agree with the batch forms,
however the input is cut into batches. Timers in event time retire what is settled."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from haggle.operators.lifecycle import TRANSITIONS, WEBHOOK_STATES, reachable
from haggle.streaming.pages import by_page

_REACH = {s: set(reachable(s)) for s in TRANSITIONS}
TERMINAL = [s for s, nxt in TRANSITIONS.items() if s and not nxt]

#: Milliseconds of a day.
DAY = 86_400_000

#: The store that holds maps, lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_START = ("", 0, 0, 0, None)  # state, applied, pending, errors, currency


def fold_on(at: tuple, rows: list[tuple]) -> tuple:
    """Go on from (state, applied, pending, errors, currency) with events in replay order.
    Rows are (occurred, received, id, transition, currency, has_conversion)."""
    state, applied, pending, errors, currency = at
    for _, _, _, to, cur, conv in rows:
        currency = currency or cur
        if cur and cur != currency and not conv:
            errors += 1
        elif to in TRANSITIONS[state]:
            state, applied = to, applied + 1
        elif to in WEBHOOK_STATES and to in _REACH[state]:
            pending += 1
        else:
            errors += 1
    return state, applied, pending, errors, currency


def fold(rows: list[tuple]) -> dict:
    """State and counts of one transaction's events."""
    state, applied, pending, errors, _ = fold_on(_START, sorted(rows))
    return {"current_state": state, "events": len(rows), "applied": applied, "pending": pending, "errors": errors}


#: Stands for a missing time, which comes before all others.
_NEVER = -(1 << 62)

#: Rows of a key that are put in order together.
_RUN = 10_000


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


class _Lifecycle(StatefulProcessor):
    """The fold's last place and result in `head`, all events in a map. Events behind the last
    place go on from there; only one that belongs before it brings the others back."""

    def __init__(self, retire_ms: int | None):
        self.retire_ms = retire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_id string", "occurred bigint, received bigint, transition_to string, currency string, has_conversion boolean")
        self.head = handle.getValueState("head", "occurred bigint, received bigint, event_id string, state string, applied bigint, pending bigint, errors bigint, currency string, events bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[tuple]:
        head = self.head.get()
        last, at, count = (tuple(head[:3]), tuple(head[3:8]), head[8]) if head else (None, _START, 0)
        fresh: dict[str, tuple] = {}
        for row in rows:
            i = row["event_id"]
            if i not in fresh and not (head and self.events.containsKey((i,))):
                o, r = row["_occurred"], row["_received"]
                fresh[i] = (_NEVER if o is None else o, _NEVER if r is None else r, i, row["transition_to"], row["currency"], bool(row["has_conversion"]))
        new = sorted(fresh.values())
        if not new and head:
            return
        for o, r, i, t, c, h in new:
            self.events.updateValue((i,), (o, r, t, c, h))
        if last is None or new[0][:3] > last:
            at, last = fold_on(at, new), new[-1][:3]
        else:
            every = sorted((v[0], v[1], k[0], v[2], v[3], v[4]) for k, v in self.events.iterator())
            at, last = fold_on(_START, every), every[-1][:3]
        count += len(new)
        self.head.update((*last, *at, count))
        if self.retire_ms is not None and at[0] in TERMINAL:
            self.handle.registerTimer(max(last[0] // 1000 + self.retire_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield *key, at[0], count, *at[1:4]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[tuple]:
        head = self.head.get()
        # a later event has its own timer, or reopened the transaction
        if head and head[3] in TERMINAL and head[0] // 1000 + self.retire_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.head.clear()
            self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, retire_after: str | None = None) -> DataFrame:
    """Current state per transaction, updated as events arrive. A late event takes its
    place among the earlier ones, never dropped; an event id counts once. Transactions in a
    terminal state leave the store `retire_after` event time later, when the stream carries
    a watermark; without it their events stay."""
    millis = int(pd.Timedelta(retire_after).total_seconds() * 1000) if retire_after else None
    timed = events.withColumns({"_occurred": _micros("occurred_at"), "_received": _micros("received_at")})
    return by_page(timed, ["merchant_namespace", "transaction_id"], ["event_id", "_occurred", "_received", "transition_to", "currency", "has_conversion"], _Lifecycle(millis),
                   "merchant_namespace string, transaction_id string, current_state string, events long, applied long, pending long, errors long",
                   "Update", "EventTime" if retire_after else "None", "occurred_at" if retire_after else None)


class _Ingest(StatefulProcessor):
    """Deliveries of a key by body: how many, and the first ordinal. Rows come as they are, since
    keys are many and their deliveries few: a frame per key would cost more than the work."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bodies = handle.getMapState("bodies", "body string", "n bigint, first bigint", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[tuple]:
        fresh: dict[str, tuple[int, int]] = {}
        for row in rows:
            body = row["body_hash"] or ""
            n, first = fresh.get(body, (0, row["ordinal"]))
            fresh[body] = (n + 1, min(first, row["ordinal"]))
        held = {k[0]: tuple(v) for k, v in self.bodies.iterator()}
        for body, (n, first) in fresh.items():
            if body in held:
                n, first = n + held[body][0], min(first, held[body][1])
            held[body] = (n, first)
            self.bodies.updateValue((body,), held[body])
        _, accepted, n = min((first, body, n) for body, (n, first) in held.items())
        yield key[0], accepted or None, n - 1, sum(m for m, _ in held.values()) - n

    def close(self) -> None:
        pass


def ingest_stream(events: DataFrame, key: str, body_hash: str, keep: str | None = None) -> DataFrame:
    """Idempotent delivery: the body of the least ordinal is accepted, its repeats are replays,
    other bodies conflicts, in whatever batches they come. `keep` is the processing time after
    which the store forgets a body that did not come again."""
    millis = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    src = events.select(F.col(key).cast("string").alias("idempotency_key"), F.col(body_hash).alias("body_hash"), "ordinal")
    return by_page(src, ["idempotency_key"], ["body_hash", "ordinal"], _Ingest(millis),
                   "idempotency_key string, accepted_hash string, replays long, conflicts long", "Update", "ProcessingTime" if keep else "None")


class _Maturity(StatefulProcessor):
    """What a transaction's maturity depends on, and whether it has been reported."""

    def __init__(self, span_ms: int, keep_ms: int):
        self.span_ms, self.keep_ms = span_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "paid bigint, total bigint, refund bigint, exposed boolean, returned bigint, reported boolean, seen bigint")

    def _row(self, key, status: str, net: int) -> tuple:
        return key[0], status, net

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[tuple]:
        paid, total, refund, exposed, returned, reported, seen = self.held.get() or (None, 0, 0, False, _NEVER, False, 0)
        before = total - refund, exposed
        for run in batched(rows, _RUN):
            for row in sorted(run, key=lambda x: (x["_occurred"] is None, x["_occurred"] or 0)):
                t, at, amount, ret = row["event_type"], row["_occurred"], row["amount_minor"], row["return_exposure_state"]
                millis = (_NEVER if at is None else at) // 1000
                seen = max(seen, millis)
                if t == "paid":
                    paid, total = millis, int(amount)
                elif t == "refund_recorded":
                    refund += int(amount)
                elif t == "return_status_recorded" and millis >= returned:
                    exposed, returned = ret == "open", millis
        self.held.update((paid, total, refund, exposed, returned, reported, seen))
        now = timerValues.getCurrentWatermarkInMs() + 1
        if reported and (total - refund, exposed) != before:
            yield self._row(key, "stale", total - refund)
        elif not reported and paid is not None and not exposed:
            self.handle.registerTimer(max(paid + self.span_ms, now))
        self.handle.registerTimer(max(seen + self.span_ms + self.keep_ms, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[tuple]:
        held = self.held.get()
        if not held:
            return
        paid, total, refund, exposed, returned, reported, seen = held
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if not reported and paid is not None and not exposed and fired >= paid + self.span_ms:
            reported = True
            self.held.update((paid, total, refund, exposed, returned, reported, seen))
            yield self._row(key, "mature", total - refund)
        # an open return waits for its closing; all else leaves the store
        if fired >= seen + self.span_ms + self.keep_ms and not (paid is not None and exposed and not reported):
            self.held.clear()

    def close(self) -> None:
        pass


def maturity_stream(payments: DataFrame, window_days: int, keep_days: int = 365) -> DataFrame:
    """transaction_id, status and net_revenue_minor: `mature` when the watermark reaches a paid
    transaction's time plus the window, unless a return is open then, which keeps it waiting
    for its closing; `stale` when a refund or return comes after that. A transaction
    leaves the store `keep_days` after window and last event, also one that was never
    paid; one with an open return stays."""
    return by_page(payments.withColumn("_occurred", _micros("occurred_at")), ["transaction_id"], ["event_type", "_occurred", "amount_minor", "return_exposure_state"],
                   _Maturity(window_days * DAY, keep_days * DAY), "transaction_id string, status string, net_revenue_minor long", "Append", "EventTime", "occurred_at")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> int:
    """Drain the available input; every batch is one folder of parquet, rewritten
    when the batch is repeated, so a restart leaves no doubles. Returns how many rows
    (partial sums, where an aggregate combines them first) came behind the watermark."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    # typed state needs this store; the setting counts when a query starts
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for o in p["stateOperators"])


def latest_rows(spark, path: str, keys: list[str]) -> DataFrame:
    """The last emitted row per key of an update stream."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in [*keys, "batch"]]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")

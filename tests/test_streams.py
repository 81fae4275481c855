"""Streaming forms on small inputs, cut into batches in several ways."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import Row

from haggle.streaming import funnels as U
from haggle.streaming import lifecycle as S

PAY = "transaction_id string, event_type string, occurred_at timestamp, amount_minor long, return_exposure_state string"
LIFE = "merchant_namespace string, transaction_id string, event_id string, occurred_at timestamp, received_at timestamp, transition_to string, currency string, has_conversion boolean"


def drained(spark, tmp_path, schema, batches, build, mode="update", watermark=None):
    """Rows that a stream puts out, one file of input per batch, with the number of the batch."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    text = schema.replace("timestamp", "string")
    for rows in batches:
        df = spark.createDataFrame(rows, text)
        df.select([df[c.split()[0]].cast(c.split()[1]) for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.run_to_table(build(stream.withWatermark("occurred_at", watermark) if watermark else stream), out, str(tmp_path / "cp"), mode=mode)
    return spark.read.parquet(out)


def test_maturity_timer_and_stale_refunds(spark, tmp_path):
    batches = [
        [("a", "paid", "2024-01-01", 1000, None), ("b", "paid", "2024-01-01", 500, None), ("b", "return_status_recorded", "2024-01-02", 0, "open"), ("c", "paid", "2024-01-03", 70, None)],
        [("a", "refund_recorded", "2024-01-05", 300, None), ("z", "paid", "2024-03-01", 1, None)],
        [("y", "paid", "2024-03-02", 1, None)],
        [("a", "refund_recorded", "2024-03-03", 50, None), ("b", "return_status_recorded", "2024-03-03", 0, "closed"), ("w", "refund_recorded", "2024-03-03", 9, None)],
        [("x", "paid", "2024-03-04", 1, None)],
        [("x", "seen", "2024-03-05", 1, None)],
    ]
    got = drained(spark, tmp_path, PAY, batches, lambda s: S.maturity_stream(s, 14, keep_days=200), "append", "1 hour")
    rows = {(r["transaction_id"], r["status"], r["net_revenue_minor"]) for r in got.collect()}
    # a and c mature, the first refund taken off; a's second one is stale; b waits for its return to close; w was never paid, the rest are too young
    assert rows == {("a", "mature", 700), ("c", "mature", 70), ("a", "stale", 650), ("b", "mature", 500)} and got.count() == 4


@pytest.mark.parametrize("cut", [[8], [3, 5], [1] * 8])
def test_lifecycle_by_any_batches(spark, tmp_path, cut):
    """Late, repeated and mismatched events give the state of the batch form however the input is cut."""
    steps = [(4, "paid", "USD"), (0, "offer_submitted", None), (2, "checkout_created", "USD"), (1, "merchant_accepted", "USD"), (3, "order_created", "EUR"), (3, "order_created", "USD"), (4, "paid", "USD"), (5, "return_opened", "USD")]
    events = [("m", "t", f"e{d}{c}", f"2024-01-0{d + 1} 00:00:00", f"2024-01-0{d + 1} 00:00:00", to, c, False) for d, to, c in steps]
    batches, at = [], 0
    for n in cut:
        batches.append(events[at : at + n])
        at += n
    got = S.latest_rows(spark, str(tmp_path / "out"), ["merchant_namespace", "transaction_id"]) if drained(spark, tmp_path, LIFE, batches, S.lifecycle_stream) else None
    known = list({e[2]: (e[3], e[4], e[2], e[5], e[6], e[7]) for e in events}.values())
    want = S.fold(known)
    assert want["events"] == 7 and want["errors"] >= 1
    assert [r.asDict() for r in got.collect()] == [{"merchant_namespace": "m", "transaction_id": "t", **want}]


def test_terminal_transactions_leave_the_store(spark, tmp_path):
    """After its time a settled transaction is forgotten: a later event starts anew."""
    event = lambda i, to, at: ("m", "t", i, at, at, to, "USD", False)
    other = lambda at: ("m", "u" + at, "x", at, at, "offer_submitted", "USD", False)
    end = S.TERMINAL[0]
    path = next(p for p in ([("offer_submitted"), end],) if end in S.TRANSITIONS[p[0]])
    batches = [[event("1", path[0], "2024-01-01"), event("2", path[1], "2024-01-02")], [other("2024-02-01")], [other("2024-02-02")], [event("3", "offer_submitted", "2024-02-03")]]
    got = drained(spark, tmp_path, LIFE, batches, lambda s: S.lifecycle_stream(s, retire_after="3 days"), watermark="1 hour").where("transaction_id = 't'")
    assert sorted((r["batch"], r["events"], r["current_state"]) for r in got.collect()) == [(0, 2, end), (3, 1, "offer_submitted")]


def test_ingest_accepts_the_least_ordinal(spark, tmp_path):
    schema = "k string, body string, ordinal long, occurred_at timestamp"
    batches = [[("a", "two", 2, "2024-01-01"), ("b", "x", 1, "2024-01-01")], [("a", "one", 1, "2024-01-01"), ("a", "two", 3, "2024-01-01")], [("a", "one", 9, "2024-01-01"), ("b", None, 4, "2024-01-01")]]
    drained(spark, tmp_path, schema, batches, lambda s: S.ingest_stream(s, "k", "body"))
    got = {r["idempotency_key"]: (r["accepted_hash"], r["replays"], r["conflicts"]) for r in S.latest_rows(spark, str(tmp_path / "out"), ["idempotency_key"]).collect()}
    assert got == {"a": ("one", 1, 2), "b": ("x", 0, 1)}


def test_replayed_and_late_events_fold_alike():
    rows = [(f"t{i}", f"t{i}", f"e{i}", s, "USD", False) for i, s in enumerate(["offer_submitted", "merchant_accepted", "checkout_created", "order_created", "paid"])]
    assert S.fold(rows) == S.fold(list(reversed(rows))) == {"current_state": "paid", "events": 5, "applied": 5, "pending": 0, "errors": 0}


def test_late_rows_are_counted(spark, tmp_path):
    """What comes behind the watermark is in no window, but the drain says how much it was."""
    schema = "user long, event_type string, ts timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "view", "2024-01-01 00:10:00"), (1, "click", "2024-01-01 00:20:00")], [(1, "view", "2024-01-02 00:00:00")], [(1, "view", "2024-01-02 00:05:00")], [(1, "purchase", "2024-01-01 00:30:00")], [(1, "end", "2024-01-05 00:00:00")], [(1, "end", "2024-01-06 00:00:00")]]
    for rows in batches:
        spark.createDataFrame(rows, "user long, event_type string, ts string").selectExpr("user", "event_type", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("ts", "1 hour")
    late = S.run_to_table(U.tumbling_funnel(stream, "1 hour", ["view", "click", "purchase"]), out, str(tmp_path / "cp"), mode="append")
    got = sorted((str(r["window_start"]), r["n_0"], r["n_1"], r["n_2"], r["depth"]) for r in spark.read.parquet(out).collect())
    assert late == 1 and got[:2] == [("2024-01-01 00:00:00", 1, 1, 0, 2), ("2024-01-02 00:00:00", 2, 0, 0, 1)]


class _Held(dict):
    """A map state in memory."""

    def iterator(self):
        return iter([(k, v) for k, v in self.items()])

    updateValue = dict.__setitem__


def test_keys_are_taken_as_rows():
    """Many keys with few events each: a key's rows come and go as they are, with no frame built for each."""
    p = S._Ingest(None)
    p.bodies = _Held()
    for ordinals in ([(5, "x"), (2, "y")], [(1, "x"), (7, None)]):
        got = list(p.handleInputRows(("k",), iter([Row(body_hash=b, ordinal=o) for o, b in ordinals]), None))
    assert got == [Row(idempotency_key="k", accepted_hash="x", replays=1, conflicts=2)]

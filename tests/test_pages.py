"""Keys of a stream in pages: what the store is asked, timers, what is forgotten, large keys."""

from __future__ import annotations

import json

import pandas as pd
import pytest

from haggle.streaming import lifecycle as S
from haggle.streaming import pages as G


class Store:
    """A handle whose list state lies in memory; counts what it is asked."""

    def __init__(self):
        self.runs, self.asked, self.timers = [], 0, set()

    def getListState(self, name, schema):
        return self

    def _did(self):
        self.asked += 1

    def get(self):
        self._did()
        return iter(self.runs)

    def put(self, runs):
        self._did()
        self.runs = list(runs)

    def appendValue(self, run):
        self._did()
        self.runs.append(run)

    def clear(self):
        self.runs = []

    def registerTimer(self, at):
        self.timers.add(at)


class Now:
    def __init__(self, processing=0, watermark=0):
        self.processing, self.watermark = processing, watermark

    def getCurrentProcessingTimeInMs(self):
        return self.processing

    def getCurrentWatermarkInMs(self):
        return self.watermark


def page(inner, keys, out, time="None"):
    p, store = G.Pages(inner, keys, out, time), Store()
    p.init(store)
    return p, store


def fed(p, rows, now=None, cut=1000):
    frames = [pd.DataFrame({"page": 1, "row": [json.dumps(r) for r in rows[i : i + cut]]}) for i in range(0, len(rows), cut)]
    return [tuple(r) for f in p.handleInputRows((1,), iter(frames), now or Now()) for r in f.itertuples(index=False)]


def expired(p, at, now):
    return [tuple(r) for f in p.handleExpiredTimer((1,), now, None) for r in f.itertuples(index=False)]


INGEST = ["idempotency_key", "accepted_hash", "replays", "conflicts"]


def delivered(k, body, ordinal):
    return {"idempotency_key": k, "body_hash": body, "ordinal": ordinal}


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_the_store_is_asked_by_page_and_not_by_key(cut):
    """500 keys in three batches cost a few calls, and give what all deliveries at once would."""
    p, store = page(S._Ingest(None), ["idempotency_key"], INGEST)
    got = {}
    for rows in ([delivered(f"k{i}", "b", 5) for i in range(500)], [delivered(f"k{i}", "a", 3) for i in range(0, 500, 2)], [delivered("k0", "b", 9), delivered(None, None, 1)]):
        got |= {r[0]: r[1:] for r in fed(p, rows, cut=cut)}
    assert store.asked <= 6 and len(got) == 501
    assert got["k0"] == ("a", 0, 2) and got["k2"] == ("a", 0, 1) and got["k1"] == ("b", 0, 0) and got[None] == (None, 0, 0)


def test_runs_of_a_page_become_one():
    """A key that did not change is not written again, and many runs are read as one after RUNS batches."""
    p, store = page(S._Ingest(None), ["idempotency_key"], INGEST)
    fed(p, [delivered(f"k{i}", "b", 5) for i in range(2000)])
    size = len(store.runs[0][0])
    for n in range(3 * G.RUNS):
        rows = fed(p, [delivered("k7", "b", n)])
        assert len(store.runs) <= G.RUNS and (n >= G.RUNS - 1 or len(store.runs[-1][0]) < size / 10)
    assert rows == [("k7", "b", 3 * G.RUNS, 0)]


def test_many_rows_of_a_key_wait_in_a_file(monkeypatch):
    """They come in the order they came, whatever is held in memory."""
    monkeypatch.setattr(G, "HELD_ROWS", 10)
    seen = {}

    class Kept(S._Ingest):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            seen[key[0]] = [r["ordinal"] for r in rows]
            return super().handleInputRows(key, iter(rows), timerValues)

    p, _ = page(Kept(None), ["idempotency_key"], INGEST)
    got = fed(p, [delivered("hot" if i % 3 else "k", "b", i) for i in range(100)], cut=9)
    assert seen == {"hot": [i for i in range(100) if i % 3], "k": list(range(0, 100, 3))}
    assert sorted(got) == [("hot", "b", 65, 0), ("k", "b", 33, 0)]


def test_bodies_are_forgotten_in_processing_time():
    """A body that does not come again leaves after its time; one that does stays."""
    p, store = page(S._Ingest(100), ["idempotency_key"], INGEST, "ProcessingTime")
    fed(p, [delivered("a", "x", 1), delivered("b", "x", 1)], Now(1000))
    assert fed(p, [delivered("a", "x", 2)], Now(1099)) == [("a", "x", 1, 0)]
    assert fed(p, [delivered("b", "x", 2)], Now(1100)) == [("b", "x", 0, 0)]
    assert fed(p, [delivered("a", "y", 3)], Now(1150)) == [("a", "x", 1, 1)]
    assert {1100, 1199} <= store.timers
    assert expired(p, 1250, Now(1250)) == [] and p._load()[0] == {}


def test_timers_fire_by_key():
    """Keys of a page mature each at its own time; those that are done leave the page."""
    day = S.DAY
    p, store = page(S._Maturity(14 * day, 5 * day), ["transaction_id"], ["transaction_id", "status", "net_revenue_minor"], "EventTime")
    event = lambda k, t, at, n, ret=None: {"transaction_id": k, "event_type": t, "_occurred": at * day * 1000, "amount_minor": n, "return_exposure_state": ret}
    assert fed(p, [event("a", "paid", 10, 100), event("b", "paid", 12, 70), event("c", "paid", 10, 5), event("c", "return_status_recorded", 11, None, "open")]) == []
    assert store.timers == {24 * day}
    assert expired(p, 24 * day, Now(watermark=25 * day)) == [("a", "mature", 100)]
    assert fed(p, [event("a", "refund_recorded", 26, 30)], Now(watermark=25 * day)) == [("a", "stale", 70)]
    assert expired(p, 26 * day, Now(watermark=40 * day)) == [("b", "mature", 70)]
    # an open return stays, a stays for its refund, b has left
    assert set(p._load()[0]) == {("a",), ("c",)}
    assert expired(p, 45 * day, Now(watermark=60 * day)) == [] and set(p._load()[0]) == {("c",)}

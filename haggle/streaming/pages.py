"""Many keys of a stream in one state: pages.

A processor with typed state asks the state store several times per key, by a socket from
Python, which costs far more than its work when keys are many and their events few. Here the
keys are dealt to pages by hash. A page's keys lie in the store together; the processor itself
is run for each key as before, with its states held in memory meanwhile. What a batch changed is
appended to the page as one run, so a key that did not change is not written again; after
RUNS of them the page is written whole."""

from __future__ import annotations

import gc
import json
import pickle
import tempfile
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle

#: Pages of a stream. A stream that goes on from its checkpoint must keep their number.
PAGES = 2_048

#: Runs of a page that are read together before they become one.
RUNS = 8

#: Rows of a key that are held in memory; the rest of a batch waits in a file.
HELD_ROWS = 10_000


class _Rows:
    """Rows of a key that come in numbers: those beyond HELD_ROWS wait in a file, in the order they came."""

    def __init__(self, rows: list[dict]):
        self.rows, self.file = rows, tempfile.TemporaryFile()

    def append(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) >= HELD_ROWS:
            pickle.dump(self.rows, self.file, protocol=5)
            self.rows = []

    def __iter__(self) -> Iterator[dict]:
        with self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows


class _Value:
    """A value state of the key at hand."""

    def __init__(self, pages: Pages, name: str):
        self.pages, self.name = pages, name

    def get(self):
        return self.pages.at.get(self.name)

    def update(self, value: tuple) -> None:
        self.pages.at[self.name] = value

    def clear(self) -> None:
        self.pages.at.pop(self.name, None)


class _Map:
    """A map state of the key at hand. A value that is kept for a time lies beside the processing time
    at which it is forgotten, under a key of one column there is no tuple: pages are smaller so."""

    def __init__(self, pages: Pages, name: str, keep_ms: int | None):
        self.pages, self.name, self.keep_ms = pages, name, keep_ms

    def containsKey(self, key: tuple) -> bool:
        held = self.pages.at.get(self.name)
        k = key[0] if len(key) == 1 else key
        return held is not None and k in held and (self.keep_ms is None or held[k][1] > self.pages.now)

    def updateValue(self, key: tuple, value: tuple) -> None:
        held = self.pages.at.setdefault(self.name, {})
        held[key[0] if len(key) == 1 else key] = value if self.keep_ms is None else (value, self.pages.now + self.keep_ms)

    def iterator(self) -> Iterator[tuple]:
        held = self.pages.at.get(self.name, {}).items()
        if self.keep_ms is not None:
            held = [(k, v) for k, (v, until) in held if until > self.pages.now]
        return iter([(k if type(k) is tuple else (k,), v) for k, v in held])

    def clear(self) -> None:
        self.pages.at.pop(self.name, None)


class Pages(StatefulProcessor):
    """Runs `inner` for every key of a page; the rows it puts out have the fields of `out`, in that order. A key's record holds its states by name and, under "",
    the times of its timers."""

    def __init__(self, inner: StatefulProcessor, keys: list[str], out: list[str], time: str):
        self.inner, self.keys, self.out, self.time = inner, keys, out, time

    # ---- what the inner processor asks its handle for

    def getValueState(self, name: str, schema: str, ttlDurationMs: int | None = None) -> _Value:
        return _Value(self, name)

    def getMapState(self, name: str, userKeySchema: str, valueSchema: str, ttlDurationMs: int | None = None) -> _Map:
        if ttlDurationMs is not None:
            self.forget.append(name)
        return _Map(self, name, ttlDurationMs)

    def registerTimer(self, at: int) -> None:
        self.at[""] = self.at.get("", frozenset()) | {at}

    # ---- pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "keys binary")
        self.forget: list[str] = []
        self.at: dict = {}
        self.now = 0
        self.inner.init(self)

    def _load(self) -> tuple[dict, int]:
        held, n = {}, 0
        for (run,) in self.runs.get():
            n += 1
            run = bytes(run)
            held |= pickle.loads(pa.decompress(run[8:], int.from_bytes(run[:8], "little"), codec="zstd", asbytes=True))
        return {k: v for k, v in held.items() if v}, n

    def _save(self, held: dict, changed: dict, n: int) -> None:
        """Append what changed (an empty record for a key that has left), or write the page whole."""
        whole = n >= RUNS
        keep = {k: v for k, v in held.items() if v} if whole else changed
        if whole and not keep:
            self.runs.clear()
        elif keep:
            text = pickle.dumps(keep, protocol=5)
            run = (len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True),)
            self.runs.put([run]) if whole else self.runs.appendValue(run)
        if self.time != "None" and (due := min((t for v in held.values() for t in self._times(v)), default=None)) is not None:
            self.handle.registerTimer(due)

    def _times(self, record: dict) -> Iterator[int]:
        """When something is to be done about a key."""
        yield from record.get("", ())
        for name in self.forget:
            yield from (until for _, until in record.get(name, {}).values())

    def _drop_forgotten(self) -> None:
        for name in self.forget:
            kept = {k: v for k, v in self.at.get(name, {}).items() if v[1] > self.now}
            if kept:
                self.at[name] = kept
            else:
                self.at.pop(name, None)

    def _frames(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gc.disable()  # a page's objects are many, none of them in a cycle
        try:
            return self._frames(self._handled(rows, timerValues))
        finally:
            gc.enable()

    def _handled(self, rows: Iterator[pd.DataFrame], timerValues) -> list[tuple]:
        waiting: dict[tuple, list | _Rows] = {}
        key_of = itemgetter(*self.keys) if len(self.keys) > 1 else lambda row, c=self.keys[0]: (row[c],)
        for frame in rows:
            for row in json.loads(f"[{','.join(frame['row'])}]"):
                k = key_of(row)
                of = waiting.get(k)
                if of is None:
                    waiting[k] = [row]
                else:
                    if type(of) is list and len(of) >= HELD_ROWS:
                        of = waiting[k] = _Rows(of)
                    of.append(row)
        self.now = timerValues.getCurrentProcessingTimeInMs()
        held, n = self._load()
        out, changed = [], {}
        for k, of in waiting.items():
            self.at = held.setdefault(k, {})
            if self.forget:
                self._drop_forgotten()
            out += self.inner.handleInputRows(k, iter(of), timerValues)
            changed[k] = self.at
        self._save(held, changed, n)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now = timerValues.getCurrentProcessingTimeInMs()
        upto = self.now if self.time == "ProcessingTime" else timerValues.getCurrentWatermarkInMs()
        held, n = self._load()
        out, changed = [], {}
        for k, record in held.items():
            if all(t > upto for t in self._times(record)):
                continue
            self.at = record
            self._drop_forgotten()
            for t in sorted(t for t in record.get("", ()) if t <= upto):
                self.at[""] -= {t}
                out += self.inner.handleExpiredTimer(k, timerValues, ExpiredTimerInfo(t))
            if not self.at.get(""):
                self.at.pop("", None)
            changed[k] = self.at
        if changed:
            self._save(held, changed, n)
        return self._frames(out)

    def close(self) -> None:
        self.inner.close()


def by_page(rows: DataFrame, keys: list[str], columns: list[str], inner: StatefulProcessor, schema: str, mode: str, time: str, event_time: str | None = None) -> DataFrame:
    """`inner` run over the rows of each key, which it gets as `columns` by name: what
    groupBy(keys).transformWithState does, with the keys of a page in one state. Columns are texts, whole
    numbers or flags, and come to Python as one text a row. `event_time` is the column that carries the
    watermark, by which late rows are put out before."""
    row = F.to_json(F.struct(*keys, *columns), {"ignoreNullFields": "false"})
    paged = rows.select(F.pmod(F.xxhash64(*keys), F.lit(PAGES)).cast("int").alias("page"), row.alias("row"), *([event_time] if event_time else []))
    out = [c.split()[0] for c in schema.split(", ")]
    return paged.groupBy("page").transformWithStateInPandas(Pages(inner, keys, out, time), schema, mode, time)

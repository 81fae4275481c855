"""Funnels in event time: how many events of each step fall into a window, and how far it got.

Windows are tumbling, sliding or sessions of a key. A watermark closes them: a closed
window is put out once and leaves the store; rows that come later are counted, not lost
unseen. The same function serves streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _funnel(events: DataFrame, window: Column, keys: list[str], steps: list[str], step: str, ts: str) -> DataFrame:
    counts = [F.count_if(F.col(step) == s).alias(f"n_{i}") for i, s in enumerate(steps)]
    firsts = [F.min(F.when(F.col(step) == s, F.col(ts))).alias(f"_first_{i}") for i, s in enumerate(steps)]
    rows = events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), *counts, *firsts)
    # a step counts as reached when its first event does not come before the step's ahead of it
    reached, depth = F.lit(True), F.lit(0)
    for i in range(len(steps)):
        held = F.col(f"_first_{i}").isNotNull()
        reached = reached & (held if i == 0 else held & (F.col(f"_first_{i}") >= F.col(f"_first_{i - 1}")))
        depth = depth + F.coalesce(reached, F.lit(False)).cast("int")
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events", *[f"n_{i}" for i in range(len(steps))], depth.alias("depth"))


def tumbling_funnel(events: DataFrame, width: str, steps: list[str], keys: list[str] = [], step: str = "event_type", ts: str = "ts") -> DataFrame:  # noqa: B006
    """Steps by windows of `width` side by side."""
    return _funnel(events, F.window(ts, width), keys, steps, step, ts)


def sliding_funnel(events: DataFrame, width: str, slide: str, steps: list[str], keys: list[str] = [], step: str = "event_type", ts: str = "ts") -> DataFrame:  # noqa: B006
    """Steps by windows of `width`, one every `slide`; an event is in all that cover it."""
    return _funnel(events, F.window(ts, width, slide), keys, steps, step, ts)


def session_funnel(events: DataFrame, gap: str, steps: list[str], keys: list[str], step: str = "event_type", ts: str = "ts") -> DataFrame:
    """Steps by sessions of a key: runs of events with no more than `gap` between one and the next."""
    return _funnel(events, F.session_window(ts, gap), keys, steps, step, ts)

"""Debounce of file events: of those that follow each other closely, the last one counts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str = "path", action: str = "action", ts: str = "ts", gap: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """key, action, ts, events: a row for each run of events of a key with gaps shorter than gap.

    Works on batches and streams alike; a stream needs a watermark, behind which a run is closed.
    """
    rows = events.withWatermark(ts, watermark) if watermark else events
    grouped = rows.groupBy(F.col(key), F.session_window(F.col(ts), gap))
    out = grouped.agg(F.max_by(action, ts).alias(action), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"))
    return out.select(key, action, F.col("last_ts").alias(ts), "events")


STATE = "action string, since double, last double, events int, tries int"
SETTLED = "path string, action string, events int, tries int, problem string"


def settled(events: DataFrame, problem_of: Callable[[str], str | None], gap: float = 0.5, retry: float = 0.5, longest: float = 60.0, tries: int = 8) -> DataFrame:
    """path, action, events, tries, problem: one row for each burst of changes of a path in a stream (path, action).

    The state of a path is its last action and when that came; a timer, set anew by each event, ends the burst once
    there was none for `gap` seconds. Then the file is looked at by problem_of, in the task that has its state: one
    that can't be taken yet stays in the state and is looked at again after `retry` seconds, twice as many the next
    time, up to `longest`. After so many `tries` it is handed on with its problem. A new event begins anew. States
    and timers are in the stream's checkpoint, so a restart goes on with the bursts and retries that were open.
    """

    def run(key, batches, state):
        now = state.getCurrentProcessingTimeMs() / 1000
        known = state.get if state.exists else None
        if state.hasTimedOut and known is not None:
            action, since, _, n, tried = known
            problem = problem_of(key[0]) if action != "delete" else None
            if problem is None or tried + 1 >= tries:
                state.remove()
                yield pd.DataFrame({"path": [key[0]], "action": [action], "events": [n], "tries": [tried + 1], "problem": [problem]})
                return
            state.update((action, since, now, n, tried + 1))
            state.setTimeoutDuration(int(1000 * min(retry * 2**tried, longest)))
            return
        rows = pd.concat(list(batches))
        last = rows.sort_values(["at", "poll"]).iloc[-1] if {"at", "poll"} <= set(rows.columns) else rows.iloc[-1]
        state.update((str(last["action"]), known[1] if known is not None else now, now, (known[3] if known is not None else 0) + len(rows), 0))
        state.setTimeoutDuration(max(1, int(1000 * gap)))

    return events.groupBy("path").applyInPandasWithState(run, SETTLED, STATE, "append", "ProcessingTimeTimeout")

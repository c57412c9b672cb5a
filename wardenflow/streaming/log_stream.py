"""Behaviour of addresses over a stream (W1-W4, W8 and section 2.11): state by address, one alert for each kind.

Rows come with ip, ms (event time), idx (arrival), failed, success, error and hit flags. State holds the marks still in
the window and what has fired. An address's rows within a micro-batch are taken in time order, all of them by one task
that holds their times and flags; rows of a later micro-batch come
after them, however old: no watermark drops any, and :func:`late_rows` counts what comes late. State of an address that is silent for ``idle_s`` goes, if that is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT = "ip string, kind string, ms long, oldest long, n long"
STATE = "fails array<long>, errors array<long>, requests array<long>, fired array<string>"


def detector(window_ms: int, failures: int, errors: int, requests: int, idle_ms: int | None):
    """The state function for ``applyInPandasWithState``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"ip": pd.Series(dtype=str), "kind": pd.Series(dtype=str), "ms": pd.Series(dtype="int64"), "oldest": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
            return
        marks = {k: list(v) for k, v in zip(("fails", "errors", "requests"), state.get[:3] if state.exists else ([], [], []), strict=True)}
        fired = set(state.get[3]) if state.exists else set()
        out = []

        def alert(kind: str, ms: int, oldest: int, n: int) -> None:
            if kind not in fired:
                fired.add(kind)
                out.append((key[0], kind, ms, oldest, n))

        def mark(name: str, kind: str, ms: int, least: int) -> None:
            if kind in fired:
                return
            held = marks[name]
            held.append(ms)
            while held and held[0] < ms - window_ms:
                held.pop(0)
            if len(held) >= least:
                alert(kind, ms, held[0], len(held))
                held.clear()

        # an address's rows come in several Arrow batches; their order in time is that of all of them
        for row in pd.concat([b.drop(columns="ip") for b in batches]).sort_values(["ms", "idx"]).itertuples():
            ms = int(row.ms)
            mark("requests", "request-burst", ms, requests + 1)
            if row.hit and "scan-behavior" in fired:
                alert("recon-hit", ms, ms, 1)
            if row.error:
                mark("errors", "scan-behavior", ms, errors)
            if row.failed:
                mark("fails", "brute-force", ms, failures)
            elif row.success and "brute-force" in fired:
                alert("credential-compromise", ms, ms, 1)
        state.update((marks["fails"], marks["errors"], marks["requests"], sorted(fired)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["ip", "kind", "ms", "oldest", "n"])

    return step


def alerts(stream: DataFrame, window_s: int = 60, failures: int = 20, errors: int = 15, requests: int = 300, idle_s: int | None = None) -> DataFrame:
    """Alerts of a stream. ``idle_s`` is for streams that never end: with a timeout, a stream that is to stop once it
    has been read would wait for it.
    """
    step = detector(window_s * 1000, failures, errors, requests, idle_s and idle_s * 1000)
    chosen = stream.select("ip", "ms", "idx", "failed", "success", "error", "hit").filter("ip is not null and ms is not null")
    return chosen.groupBy("ip").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_s else GroupStateTimeout.NoTimeout)


def late_rows(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Rows by minute with the watermark's delay, for a count of what comes late."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 minute")).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Each finding key once within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)

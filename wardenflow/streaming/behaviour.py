"""Behaviour of addresses over a stream, in event time (W1-W4, W8 and section 2.11): bounded state, late rows, caps.

Rows wait in state until the watermark has passed them, so an address's rows are taken in the order of their times, whichever
micro-batch brought them; rows that come later than the watermark are dropped by Spark, which counts them. What is
kept of an address is bounded: the rows between the watermark and now, 24 bytes each, and of each kind fewer marks than its
threshold, as a kind that reaches it fires and is done. An address that is silent is forgotten by a timer.

The RocksDB state store keeps many addresses off the heap: ``spark.sql.streaming.stateStore.providerClass``, see :data:`STORE`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardenflow.storage import shared_dir

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ALERT = "ip string, kind string, ms long, oldest long, n long"
FLAGS = ("failed", "success", "error", "hit")
STATE = "waiting binary, marks string, fired string, last long"


@dataclass
class Watch:
    """What is known of one address: marks by kind, all within the window of the last, and the kinds that have fired."""

    window_ms: int
    failures: int
    errors: int
    requests: int
    marks: dict[str, list[int]] = field(default_factory=dict)
    fired: set[str] = field(default_factory=set)

    def _mark(self, kind: str, ms: int, least: int) -> list[tuple]:
        if kind in self.fired:
            return []
        held = [x for x in self.marks.get(kind, ()) if x >= ms - self.window_ms] + [ms]
        self.marks[kind] = held
        return self._fire(kind, ms, self.marks.pop(kind)[0], len(held)) if len(held) >= least else []

    def _fire(self, kind: str, ms: int, oldest: int, n: int) -> list[tuple]:
        if kind in self.fired:
            return []
        self.fired.add(kind)
        return [(kind, ms, oldest, n)]

    def see(self, ms: int, failed: bool, success: bool, error: bool, hit: bool) -> list[tuple]:
        """Alerts of the next row in time."""
        out = self._mark("request-burst", ms, self.requests + 1)
        if hit and "scan-behavior" in self.fired:
            out += self._fire("recon-hit", ms, ms, 1)
        if error:
            out += self._mark("scan-behavior", ms, self.errors)
        if failed:
            out += self._mark("brute-force", ms, self.failures)
        elif success and "brute-force" in self.fired:
            out += self._fire("credential-compromise", ms, ms, 1)
        return out


def behaviour(watch: dict[str, int], bucket_ms: int, idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Rows of an address wait until the watermark has passed the end of their bucket; its state comes and goes with its rows, not by calls."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, marks, fired, last = state.get if state.exists else (b"", "{}", "[]", None)
        rows = np.concatenate([np.frombuffer(held, np.int64).reshape(-1, 3), *[f[["ms", "idx", "flags"]].to_numpy(np.int64) for f in frames if len(f)]])
        now, ends = state.getCurrentWatermarkMs(), (rows[:, 0] // bucket_ms + 1) * bucket_ms
        ripe, rest, ends = rows[ends <= now], rows[ends > now], ends[ends > now]
        out = []
        if len(ripe):
            seen = Watch(**watch, marks=json.loads(marks), fired=set(json.loads(fired)))
            for ms, _, flags in sorted(ripe.tolist()):
                out += [(key[0], *a) for a in seen.see(ms, *(bool(flags >> n & 1) for n in range(len(FLAGS))))]
                last = ms
            marks, fired = json.dumps(seen.marks), json.dumps(sorted(seen.fired))
        silent = idle_ms is not None and last is not None and not len(rest)
        if silent and now >= last + idle_ms:
            state.remove()
        else:
            state.update((rest.tobytes(), marks, fired, last))
            if len(rest) or silent:
                state.setTimeoutTimestamp(int(ends.min()) if len(rest) else last + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["ip", "kind", "ms", "oldest", "n"])

    return step


def alerts_in_time(stream: DataFrame, time: str = "at", delay: str = "10 minutes", window_s: int = 60, failures: int = 20, errors: int = 15, requests: int = 300, bucket_s: int = 60, idle_s: int | None = None) -> DataFrame:
    """One alert of each kind for an address. ``stream``: ip, ``time``, idx (order at equal times), failed, success, error, hit.

    Rows without address or time go. A row counts once the watermark has passed the end of its bucket of ``bucket_s``.
    """
    rows = stream.filter(F.col("ip").isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    flags = sum((F.when(F.col(f), 1 << n).otherwise(0) for n, f in enumerate(FLAGS)), F.lit(0).cast("long"))
    rows = rows.select("ip", time, F.unix_millis(time).alias("ms"), F.coalesce(F.col("idx").cast("long"), F.lit(0)).alias("idx"), flags.alias("flags")).withWatermark(time, delay)
    watch = {"window_ms": window_s * 1000, "failures": failures, "errors": errors, "requests": requests}
    return rows.groupBy("ip").applyInPandasWithState(behaviour(watch, bucket_s * 1000, idle_s and idle_s * 1000), ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def capped_writer(folder: str, group: str, order: list[str], most: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the first ``most`` rows of each group over the whole run go to ``folder``/kept, counts of the others to ``folder``/left_out.

    Each micro-batch writes a folder of its own and replaces it when it is run again, so nothing is written twice. What
    earlier batches have kept is counted by group before the batch is cut.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("turn__", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
        kept = _batches(spark, f"{folder}/kept", batch.drop("turn__"), number)
        room = batch if kept is None else batch.join(kept.groupBy(group).agg(F.count(F.lit(1)).alias("had__")), group, "left")
        had = F.lit(0) if kept is None else F.coalesce("had__", F.lit(0))
        marked = room.withColumn("fits__", F.col("turn__") + had <= most)
        marked.filter("fits__").drop("turn__", "had__", "fits__").write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
        marked.filter("not fits__").groupBy(group).agg(F.count(F.lit(1)).alias("left_out")).write.mode("overwrite").parquet(f"{folder}/left_out/batch={number}")

    return write


def _batches(spark: SparkSession, folder: str, like: DataFrame, before: int) -> DataFrame | None:
    """What the micro-batches before one have written, None for the first."""
    if not before:
        return None
    return spark.read.schema(like.schema).option("basePath", folder).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*[f"{folder}/batch={n}" for n in range(before)])


@dataclass
class Run:
    """A stream that has been read to its end: its sink's folder, rows that came too late, and rows held in state at the end."""

    folder: str
    late: int
    state_rows: int


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> Run:
    """Read what is there, write the rows to ``folder``/out or hand them to ``sink``, and wait for the end."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    return Run(folder, *_counted(query))


def _counted(query: StreamingQuery) -> tuple[int, int]:
    late, held = 0, 0
    for progress in query.recentProgress:
        states = progress["stateOperators"] if isinstance(progress, dict) else json.loads(progress.json)["stateOperators"]
        late += sum(s["numRowsDroppedByWatermark"] for s in states)
        held = sum(s["numRowsTotal"] for s in states)
    return late, held

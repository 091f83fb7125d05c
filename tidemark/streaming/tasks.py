"""States of tasks from a stream of their events, kept by task and bounded by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an event makes of a task's status, and the statuses it needs (none: any).
MOVES = {"start": ("running", ()), "complete": ("completed", ()), "fail": ("failed", ()), "cancel": ("cancelled", ("pending",))}
ENDED = ("completed", "failed", "cancelled")

_STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("progress", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("late", T.LongType()), T.StructField("at", T.LongType())])


class _Tasks(StatefulProcessor):
    def __init__(self, timeout: int | None, keep: int | None):
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def _row(self, key: tuple, state: tuple, reason: str | None) -> dict:
        return {"task_id": key[0], "seq": state[2], "status": state[0], "progress": state[1], "late": state[3], "reason": reason}

    def _wake(self, state: tuple) -> None:
        """One timer a task: for its end if it falls silent, or for forgetting it once it has ended."""
        wait = self.keep if state[0] in ENDED else self.timeout
        if self.timeout is None and self.keep is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wait is not None:
            self.handle.registerTimer(state[4] + wait)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")  # a group can come in many Arrow batches
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        for seq, kind, pct, at in zip(events["seq"].tolist(), events["kind"].tolist(), events["pct"].tolist(), events["at_ms"].tolist(), strict=True):
            at = int(at) if at == at and at is not None else 0
            if state is None:
                if kind == "submit":
                    state = ("pending", 0, seq, 0, at)
                    out.append(self._row(key, state, None))
                continue
            status, progress, last, late, was = state
            if seq <= last:
                state = (status, progress, last, late + 1, was)
                continue
            to, needs = MOVES.get(kind, (status, ()))
            if needs and status not in needs:
                to = status
            if kind == "progress" and pct == pct and pct is not None:
                progress = int(pct)
            elif kind == "complete":
                progress = 100
            state = (to, progress, seq, late, max(at, was))
            out.append(self._row(key, state, None))
        if state is not None:
            self.state.update(state)
            self._wake(state)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, progress, seq, late, _ = tuple(self.state.get())
        if status in ENDED:
            self.state.clear()
            return
        state = ("failed", progress, seq, late, expiredTimerInfo.getExpiryTimeInMs())
        self.state.update(state)
        if self.keep is not None:
            self.handle.registerTimer(state[4] + self.keep)
        yield pd.DataFrame([self._row(key, state, "timeout")])

    def close(self) -> None:
        pass


def task_states(events: DataFrame, timeout_ms: int | None = None, keep_ms: int | None = None, lateness: str = "1 minute") -> DataFrame:
    """(task_id, seq, status, progress, late, reason) of a stream, a row for each event that a known task takes.

    ``events``: task_id, seq, kind (submit, start, progress, complete, fail, cancel), pct and, where
    timers are asked for, at. A task is pending once submitted, and events of others are ignored.
    Starting, completing and failing set its status, cancelling only that of a pending task. What
    comes with a number not above the last one is late: counted, and left out.

    With ``timeout_ms`` a task that hasn't ended and is silent so long fails (reason: timeout); with
    ``keep_ms`` one that has ended is forgotten after that, so that state doesn't grow with the
    tasks there have ever been. Both go by event time, behind a watermark of ``lateness``. The
    session's state store becomes the one that such states need.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = timeout_ms is not None or keep_ms is not None
    at = F.unix_millis("at") if "at" in events.columns else F.lit(None).cast("long")
    rows = events.withWatermark("at", lateness) if timed else events
    rows = rows.select("task_id", F.col("seq").cast("long").alias("seq"), "kind", F.col("pct").cast("int").alias("pct"), at.alias("at_ms"), *(["at"] if timed else []))
    kind = rows.schema["task_id"].dataType.simpleString()
    out = f"task_id {kind}, seq long, status string, progress int, late long, reason string"
    return rows.groupBy("task_id").transformWithStateInPandas(_Tasks(timeout_ms, keep_ms), out, "append", "eventTime" if timed else "none")

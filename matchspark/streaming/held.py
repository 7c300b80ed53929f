"""Conditions that must hold for a while before they alert, on a stream and as its batch twin.

Rows are first reduced to steps of fixed length (a windowed aggregate, so a hot target is combined before
any shuffle); the state of a target is one open breach, whatever the number of its rows. A breach opens with
the first step that meets the condition, fires once it has held for ``hold`` steps and is resolved by a step
that does not meet it. A step without rows does not meet it either: a timer in event time resolves the
breach, so nothing has to arrive for the target itself, only time has to move on.

NULL values do not count; a step without any value, or of a target without a baseline, does not meet its condition.
Rows with a NULL target form a target of their own (without a baseline).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT = "target string, state string, since timestamp, at timestamp, steps bigint"
OPEN = "since bigint, last bigint, n bigint"


def _timed(df: DataFrame, late: str) -> DataFrame:
    """Every row moves the time on, also one without values or history, so nothing is filtered before."""
    return df.withWatermark("ts", late) if df.isStreaming else df


def _steps(df: DataFrame, step: str, *aggs: Column) -> DataFrame:
    return df.groupBy(F.window("ts", step).alias("w"), "target").agg(*aggs)


def accuracy_steps(df: DataFrame, tolerance: float, limit: float, step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Steps, each with the flag that the share of predictions within ``tolerance`` of the actual is below ``limit``."""
    hit = (F.abs(F.col("predicted") - F.col("actual")) <= tolerance).cast("int")
    return _steps(_timed(df, late), step, F.avg(hit).alias("value")).select("target", "w", (F.col("value") < limit).alias("met"))


def drift_steps(
    df: DataFrame, baseline: DataFrame, limit: float, step: str = "5 minutes", late: str = "1 hour", eps: float = 1e-6
) -> DataFrame:
    """Steps, each with the flag that mean and deviation have moved from the target's ``baseline`` (target, hm, hs) by more than ``limit``."""
    known = _timed(df, late).join(baseline.select("target", "hm", "hs"), "target", "left")
    out = _steps(known, step, F.avg("predicted").alias("bm"), F.stddev_pop("predicted").alias("bs"),
                 F.max("hm").alias("hm"), F.max("hs").alias("hs"))
    score = (F.abs(F.col("bm") - F.col("hm")) + F.abs(F.col("bs") - F.col("hs"))) / (F.col("hs") + eps) / 2
    return out.select("target", "w", (score > limit).alias("met"))


def held_batch(steps: DataFrame, hold: int, step_seconds: int, until: Column | None = None) -> DataFrame:
    """A row ``firing`` for each breach of ``hold`` steps or more, and a row ``resolved`` for each that has ended.

    ``until`` is the time reached: steps that end later are not seen, and a breach has ended when the step after it is over.
    """
    ends = F.unix_micros(F.col("w.end"))
    now = F.lit(None).cast("bigint") if until is None else F.unix_micros(until)
    size = step_seconds * 1_000_000
    seen = steps.select("target", "met", F.unix_micros("w.start").alias("s"), now.alias("_now")).filter(
        F.col("_now").isNull() | (ends <= F.col("_now"))
    )
    n = F.row_number().over(Window.partitionBy("target").orderBy("s")).cast("bigint")
    runs = seen.filter("met").withColumn("_run", F.col("s") - n * size).groupBy("target", "_run").agg(
        F.min("s").alias("since"), F.max("s").alias("last"), F.count("*").alias("n"), F.max("_now").alias("_now")
    ).filter(F.col("n") >= hold)
    over = F.col("last") + size
    fired = F.struct(F.lit("firing").alias("state"), (F.col("since") + hold * size).alias("at"), F.lit(hold).cast("bigint").alias("steps"))
    ended = F.struct(F.lit("resolved").alias("state"), over.alias("at"), F.col("n").alias("steps"))
    is_over = F.col("_now").isNull() | (over + size <= F.col("_now"))
    rows = runs.select("target", "since", F.explode(F.when(is_over, F.array(fired, ended)).otherwise(F.array(fired))).alias("e"))
    return rows.select("target", "e.state", F.timestamp_micros("since").alias("since"), F.timestamp_micros("e.at").alias("at"), "e.steps")


class Follow(StatefulProcessor):
    """The open breach of a target: start of its first and last step in milliseconds, and the number of steps."""

    def __init__(self, hold: int, size: int) -> None:
        self.hold, self.size = hold, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events: list[tuple] = []
        since, last, n = self.open.get() if self.open.exists() else (0, 0, 0)
        if n:
            self.handle.deleteTimer(self._over(last))
        arrived = pd.concat(list(rows)).sort_values("start")
        for start, met in zip(arrived["start"].tolist(), arrived["met"].tolist()):
            if n and (not met or start != last + self.size):
                events += self._resolved(key, since, last, n)
                n = 0
            if met:
                since, last, n = (since if n else start), start, n + 1
                if n == self.hold:
                    events.append((key[0], "firing", since, start + self.size, n))
        # the step after the last one may be over already
        if n and self._over(last) < timerValues.getCurrentWatermarkInMs():
            events += self._resolved(key, since, last, n)
            n = 0
        if n:
            self.open.update((since, last, n))
            self.handle.registerTimer(self._over(last))
        else:
            self.open.clear()
        yield self._rows(events)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = self._resolved(key, *self.open.get()) if self.open.exists() else []
        self.open.clear()
        yield self._rows(events)

    def _over(self, last: int) -> int:
        """The last millisecond of the step after ``last``."""
        return last + 2 * self.size - 1

    def _resolved(self, key: tuple, since: int, last: int, n: int) -> list[tuple]:
        return [(key[0], "resolved", since, last + self.size, n)] if n >= self.hold else []

    @staticmethod
    def _rows(events: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(events, columns=["target", "state", "since", "at", "steps"])
        for c in ("since", "at"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="ms")
        return out.astype({"steps": "int64"})


def held_stream(steps: DataFrame, hold: int, step_seconds: int) -> DataFrame:
    """The same rows from a stream, each written once: when the watermark passes the step that decides it.

    Steps reach the state after the watermark has closed them, so those of one batch are complete and in order after a
    sort; a batch holds a few steps a target, and the state three numbers. Timers need the RocksDB state store:
    ``spark.sql.streaming.stateStore.providerClass`` must name it when the stream starts.
    """
    size = step_seconds * 1000  # event time counts milliseconds

    flat = steps.select("target", "w", F.unix_millis("w.start").alias("start"), F.coalesce("met", F.lit(False)).alias("met"))
    return flat.groupBy("target").transformWithStateInPandas(Follow(hold, size), EVENT, "append", "eventTime")

"""Flags on a stream: each session's last keys are kept in state, and every row is scored against a fitted model.

Rows are taken in the order of their time, whatever order they arrive in: a row waits in state until the watermark
has passed it, so a stream gives the flags of a batch run over the same rows. Rows that arrive behind the
watermark are dropped. The state of a session that has been quiet for long enough is removed by a timer; its next row begins
the session anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seqwarden.operators.model import UNKNOWN_CONTEXT, longest_known_by_row, top_k_table

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class SessionContexts(StatefulProcessor):
    """Emits every row with its position in the session and the keys before it, once the watermark has passed the row."""

    def __init__(self, session: Sequence[str], width: int, idle_ms: int):
        self.session, self.width, self.idle_ms = list(session), width, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, tie bigint, key int")
        self.last = handle.getValueState("last", "us bigint, seq bigint, keys array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for batch in rows:
            keys = [None if pd.isna(k) else int(k) for k in batch["row_key"]]
            new += zip(_micros(batch["row_time"]), batch["row_tie"].tolist(), keys)
        for row in new:
            self.waiting.appendValue(row)
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def _released(self, session, watermark_ms: int) -> Iterator[pd.DataFrame]:
        waiting = sorted(self.waiting.get() if self.waiting.exists() else [], key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if r[0] <= watermark_ms * 1000]
        left = waiting[len(ready) :]
        at, seq, keys = self.last.get() if self.last.exists() else (None, 0, [])
        keys, out = list(keys or []), []
        for us, tie, key in ready:
            if at is not None and us - at > self.idle_ms * 1000:
                seq, keys = 0, []  # the timer may come later than a row that is behind it
            out.append((*session, us, tie, seq, key, list(keys)))
            keys, seq, at = [*keys, key][-self.width :], seq + 1, us
        if ready:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            self.last.update((at, seq, keys))
        if left:
            self.handle.registerTimer(-(-left[0][0] // 1000))
        elif at is not None:
            due = at // 1000 + self.idle_ms + 1
            if due <= watermark_ms:
                self.last.clear()
            else:
                self.handle.registerTimer(due)
        if out:
            frame = pd.DataFrame(out, columns=[*self.session, "row_us", "row_tie", "seq", "row_key", "ctx"])
            frame["row_key"] = frame["row_key"].astype("Int32")
            yield frame

    def close(self) -> None:
        pass


def stream_contexts(events: DataFrame, session: Sequence[str], time: str, tie: str, key: str, width: int, delay: str = "1 hour", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """(session, time, tie, seq, key, ctx) of a stream: position in the session and up to ``width`` keys before.

    Rows of one session are ordered by time, then by ``tie``, a whole number. ``delay`` says how far a row may lag behind the
    latest one. A null time is dropped; a null key stays a null, as does a null session.
    """
    if width < 1:
        raise ValueError(f"width must be at least 1, got {width}")
    spark: SparkSession = events.sparkSession
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        raise RuntimeError(f"set {STATE_STORE} to {ROCKSDB}: only that store keeps lists and timers")
    fields = [events.schema[c] for c in session]
    narrow = events.filter(F.col(time).isNotNull()).select(
        *session, F.col(time).alias("row_time"), F.col(tie).cast("long").alias("row_tie"), F.col(key).cast("int").alias("row_key")
    )
    shape = T.StructType(
        [*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in (("row_us", "long"), ("row_tie", "long"), ("seq", "long"), ("row_key", "int"), ("ctx", "array<int>"))]]
    )
    found = narrow.withWatermark("row_time", delay).groupBy(*session).transformWithStateInPandas(
        statefulProcessor=SessionContexts(session, width, idle_ms), outputStructType=shape, outputMode="append", timeMode="EventTime"
    )
    return found.select(*session, F.timestamp_micros("row_us").alias(time), F.col("row_tie").alias(tie), "seq", F.col("row_key").alias(key), "ctx")


def stream_flags(contexts: DataFrame, model: DataFrame, key: str, width: int, k: int = 9, backoff: bool = False) -> DataFrame:
    """The rows of ``stream_contexts`` with ``flag``: the key is outside the ``k`` most expected ones; a stream joined to the fitted counts.

    The first ``width`` rows of a session are normal. Without ``backoff`` a context that the model does not know is an anomaly.
    """
    if backoff:
        found = longest_known_by_row(contexts, model, width, k)
    else:
        found = contexts.join(top_k_table(model, k), "ctx", "left")
    expected = F.coalesce(F.array_contains("top", F.col(key)), F.lit(UNKNOWN_CONTEXT)) & F.coalesce(F.col(key) >= 0, F.lit(False))
    return found.withColumn("flag", (F.col("seq") >= width) & ~expected).select(*contexts.columns, "flag")

"""Sessions kept in streaming state: the gate that opens with a session's first request of a kind, and idle expiry."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from tarnstone.streaming.counters import IDLE

#: Requests that open a session, and those that need none.
OPENS, FREE = ("view",), ("click",)
#: Seconds between two heartbeats to an open session.
HEARTBEAT = 25
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile keep their state in RocksDB, which state variables and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Gate(StatefulProcessor):
    """Tells of each request whether its session was open. State of a session: place (time, number) of what opened it."""

    def __init__(self, opens: tuple[str, ...] = OPENS, free: tuple[str, ...] = FREE):
        self.opens, self.free = opens, free

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", StructType([StructField("ts", LongType()), StructField("event_id", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A session's requests of one trigger; which one opens it is known when all are seen.
        held = pd.concat(list(rows), ignore_index=True)
        at = list(zip(held["ts"].astype("datetime64[us]").astype("int64"), held["event_id"], strict=True))
        first = [tuple(self.opened.get())] if self.opened.exists() else []
        places = first + [p for p, kind in zip(at, held["event_type"], strict=True) if kind in self.opens]
        opened = min(places, default=None)
        if opened is not None and opened not in first:
            self.opened.update((int(opened[0]), int(opened[1])))
        accepted = [kind in self.free or (opened is not None and p >= opened) for p, kind in zip(at, held["event_type"], strict=True)]
        yield pd.DataFrame({"session": key[0], "event_id": held["event_id"], "accepted": accepted})

    def close(self) -> None:
        pass


class Life(StatefulProcessor):
    """Tells of each session its heartbeats and its end. State: first and last time, events, and the last heartbeat told.

    An event-time timer stands at the moment a session has been idle for long enough; when the watermark passes it, the
    session is told as closed and its state goes. Events after that begin another session.
    """

    def __init__(self, idle_ms: int, beat_ms: int):
        self.idle, self.beat = idle_ms, beat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", StructType([StructField(c, LongType()) for c in ("start", "last", "n")]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for pdf in rows:
            for t in pdf["ts"].astype("datetime64[us]").astype("int64"):
                found.append((int(t), int(t), 1))
            found = self._joined(found)
        self.open.put(found)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._wake(found)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        found = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        mark = timerValues.getCurrentWatermarkInMs()
        done = [s for s in found if self._due(s) <= mark]
        left = [s for s in found if self._due(s) > mark]
        if left:
            self.open.put(left)
            self._wake(left)
        else:
            self.open.clear()
        if done:
            times = [pd.to_datetime([s[i] for s in done], unit="us", utc=True) for i in (0, 1)]
            yield pd.DataFrame({"user_id": key[0], "start": times[0], "last": times[1], "n": [s[2] for s in done], "beats": [(s[1] - s[0] + self.idle * 1000) // (self.beat * 1000) for s in done]})

    def close(self) -> None:
        pass

    def _due(self, session: tuple[int, int, int]) -> int:
        """The first whole millisecond at which the session has been idle for long enough."""
        return -(-session[1] // 1000) + self.idle

    def _wake(self, found: list[tuple[int, int, int]]) -> None:
        self.handle.registerTimer(min(self._due(s) for s in found))

    def _joined(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Sessions that lie nearer to each other than the idle time are one."""
        out: list[tuple[int, int, int]] = []
        for start, last, n in sorted(found):
            if out and start < out[-1][1] + self.idle * 1000:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
            else:
                out.append((start, last, n))
        return out


def gate_stream(events: DataFrame, checkpoint: str, sink: str, trigger: dict[str, Any] | None = None):
    """session, event_id, accepted of a stream of requests (user_id, event_id, ts, event_type), appended to a table folder.

    A request counts if it needs no session or does not come before the one that opened its session. State outlives
    triggers and restarts; across triggers, what has been told is not taken back.
    """
    with rocks(events.sparkSession):
        asked = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
        told = asked.groupBy("user_id").transformWithStateInPandas(Gate(), "session long, event_id long, accepted boolean", "Append", "None")
        return told.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def life_stream(events: DataFrame, checkpoint: str, sink: str, idle_minutes: int = 60, late: str = "10 minutes", trigger: dict[str, Any] | None = None):
    """user_id, start, last, n, beats of each session of a stream (user_id, ts) once it has been idle for long enough.

    beats: heartbeats, one each HEARTBEAT seconds from the start, that the session gets while it is open. The watermark
    stands `late` behind the newest event; events behind it are left out, and sessions it has not passed stay open in state.
    """
    with rocks(events.sparkSession):
        seen = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
        told = seen.groupBy("user_id").transformWithStateInPandas(Life(idle_minutes * 60_000, HEARTBEAT * 1000), StructType([StructField("user_id", LongType()), StructField("start", TimestampType()), StructField("last", TimestampType()), StructField("n", LongType()), StructField("beats", LongType())]), "Append", "EventTime")
        return told.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def session_stream(events: DataFrame, checkpoint: str, sink: str, idle: str = IDLE, late: str = "10 minutes", trigger: dict[str, Any] | None = None):
    """user_id, start, n of each session of a stream, by a session window in Spark's own state, once the watermark has passed
    its end."""
    seen = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    counted = seen.groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
    return counted.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

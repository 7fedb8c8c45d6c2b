"""Streams whose answers wait for event time: debounced changes and rate limits that take requests in their order.

Both keep what is still open of each key in state and set a timer for the moment from which nothing can change it:
once the watermark is past that moment, no earlier row can come any more. Rows may therefore arrive in any order
within the lateness, over any number of micro-batches, and the answers are those of the sorted feed. State is keyed,
so every key's rows are worked on where its state lives, and holds a key's rows of the last ``late`` and the waiting
time only. A stream that resumes from its checkpoint goes on with the state it had.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; queries that the session starts from now on use it."""
    spark.conf.set(_STORE, _ROCKS)


# Processors are classes within functions, so that they travel as a whole: the process in which the driver sets them up
# does not have the files that are added to the session.


def _debouncer(quiet: int) -> StatefulProcessor:
    """Map state of a path's recent changes, by time and number; the timer of each comes after the quiet time."""

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.recent = handle.getMapState("recent", "us long, seq long", "change string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            for r in rows:
                self.recent.updateValue((r.us, r.seq), (r.change,))
                self.handle.registerTimer((r.us + quiet) // 1000 + 1)
                if r.change == "unlink":
                    yield Row(path=key[0], us=r.us, change=r.change)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now = timerValues.getCurrentWatermarkInMs() * 1000
            held = sorted((k[0], k[1], v[0]) for k, v in self.recent.iterator())
            for k, (us, seq, change) in enumerate(held):
                if us + quiet > now:
                    break
                if change != "unlink" and (k + 1 == len(held) or held[k + 1][0] - us >= quiet):
                    yield Row(path=key[0], us=us, change=change)
                # what came before is settled too, so nothing needs this one as its follower
                self.recent.removeKey((us, seq))

        def close(self) -> None:
            pass

    return Processor()


def debounce(changes: DataFrame, quiet_ms: int = 200, late: str = "1 second") -> DataFrame:
    """(path, ts, change) of a stream of (path, ts, seq, change): what ``aggregate.debounced`` gives for the same rows.

    A delete comes out in the micro-batch that brings it and takes back the change that waits; any other change comes
    out once the quiet time has passed in event time without another change of its path. Changes with the time and
    number of one before replace it; those without a time, or later than ``late``, are left out.
    """
    with_timers(changes.sparkSession)
    timed = changes.where("ts IS NOT NULL").withWatermark("ts", late)
    own = timed.select("path", "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "change")
    kind = changes.schema["path"].dataType.simpleString()
    out = own.groupBy("path").transformWithState(_debouncer(1000 * quiet_ms), f"path {kind}, us long, change string", "Append", "EventTime")
    return out.select("path", F.timestamp_micros("us").alias("ts"), "change")


def _limiter(window: int, most: int) -> StatefulProcessor:
    """Map state of a key's requests that may still be preceded by others, and value state of its open window."""

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "us long", "n long")
            self.open = handle.getValueState("open", "began long, n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            counted: dict[int, int] = {}
            for r in rows:
                counted[r.us] = counted.get(r.us, 0) + 1
            for us, n in counted.items():
                before = self.waiting.getValue((us,)) if self.waiting.containsKey((us,)) else None
                self.waiting.updateValue((us,), (n + (before[0] if before else 0),))
                self.handle.registerTimer(us // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now = timerValues.getCurrentWatermarkInMs() * 1000
            due = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] < now)
            began, n = tuple(self.open.get()) if self.open.exists() else (0, 0)
            for us, times in due:
                if n == 0 or us - began >= window:
                    began, n = us, 0
                for _ in range(times):
                    n += 1
                    yield Row(ip=key[0], us=us, allowed=n <= most)
                self.waiting.removeKey((us,))
            if n and began + window > now:
                self.open.update((began, n))
                self.handle.registerTimer((began + window) // 1000 + 1)
            elif n:
                self.open.clear()  # whoever comes next begins a window

        def close(self) -> None:
            pass

    return Processor()


def ordered_rate_limit(requests: DataFrame, seconds: int = 60, most: int = 10, late: str = "60 seconds") -> DataFrame:
    """(ip, ts, allowed) of a stream of (ip, ts): a fixed window begins at a key's first request and lets ``most`` through.

    Requests are judged in the order of their times once the watermark is past them, whatever order they come in, so
    the answers are those of ``aggregate.limited``. Requests without a time, or later than ``late``, are left out.
    """
    with_timers(requests.sparkSession)
    timed = requests.where("ts IS NOT NULL").withWatermark("ts", late).select("ip", "ts", F.unix_micros("ts").alias("us"))
    kind = requests.schema["ip"].dataType.simpleString()
    out = timed.groupBy("ip").transformWithState(_limiter(1_000_000 * seconds, most), f"ip {kind}, us long, allowed boolean", "Append", "EventTime")
    return out.select("ip", F.timestamp_micros("us").alias("ts"), "allowed")

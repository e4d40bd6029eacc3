"""2.J, D13: keyed state in the stream: the newest page of every address, the last good movies of every venue.

State lies in the state store, by key; a batch reads and writes the keys that it brings and no others. Timers forget what has
not been seen for long.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from .. import model

DAY_MS = 86_400_000
#: What a venue lists at one time, and what counts for it then. `seq` orders the listings of a venue; movies are JSON.
LISTED = "cinema STRING, seq LONG, movies ARRAY<STRING>"
CURRENT = "cinema STRING, seq LONG, movies ARRAY<STRING>, stale BOOLEAN"


def with_state_store(spark: SparkSession) -> None:
    """The state of these operators needs the store that keeps typed values and timers.

    Timers go off in batches that bring data: batches without any, for timers alone, would never let a query end that takes
    what is there and stops.
    """
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Forgetful(StatefulProcessor):
    """A value for each key, forgotten `keep` days after it was last renewed."""

    schema: str

    def __init__(self, keep: float) -> None:
        self.keep = int(keep * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.schema)

    def renew(self, timers) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Newest(_Forgetful):
    schema = "at LONG, digest LONG"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = max(rows, key=lambda r: (r["at"], r["digest"]), default=None)
        if best is not None:
            self.renew(timerValues)
            old = self.value.get() if self.value.exists() else None
            if old is None or (best["at"], best["digest"]) > (old[0], old[1]):
                self.value.update((best["at"], best["digest"]))
                if old is None or best["digest"] != old[1]:
                    yield Row(source=key[0], url=key[1], fetched_at=best["fetched_at"], status=best["status"], body=best["body"])


def changed_pages(arriving: DataFrame, keep: float = 90) -> DataFrame:
    """model.LANDING of the good pages that are newer than what the stream has seen of their address, and differ from it.

    Of an address the state holds the time and a digest, not the page. Pages without source or address, that failed or
    are empty go. What has not landed for `keep` days is forgotten.
    """
    good = arriving.where("status = 200 and body <> '' and source is not null and url is not null and fetched_at is not null")
    marked = good.withColumns({"at": F.unix_micros("fetched_at"), "digest": F.xxhash64("body")})
    return marked.groupBy("source", "url").transformWithState(statefulProcessor=_Newest(keep), outputStructType=model.LANDING, outputMode="Update", timeMode="ProcessingTime")


class _LastGood(_Forgetful):
    schema = "seq LONG, movies ARRAY<STRING>"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.value.get() if self.value.exists() else None
        newest = max(rows, key=lambda r: (r["seq"], sorted(r["movies"] or [])), default=None)
        if newest is None or old is not None and newest["seq"] <= old[0]:
            return
        if newest["movies"]:
            self.value.update((newest["seq"], newest["movies"]))
            self.renew(timerValues)
            yield Row(cinema=key[0], seq=newest["seq"], movies=newest["movies"], stale=False)
        elif old is not None:  # the listing failed: what was good last counts on
            yield Row(cinema=key[0], seq=newest["seq"], movies=old[1], stale=True)


def last_good(listed: DataFrame, keep: float = 14) -> DataFrame:
    """CURRENT for every venue that LISTED anew: its movies, or if there are none those of its last listing that had some.

    Listings that come late, or twice, change nothing. What was good counts for `keep` days.
    """
    return listed.where("cinema is not null and seq is not null").groupBy("cinema").transformWithState(statefulProcessor=_LastGood(keep), outputStructType=CURRENT, outputMode="Update", timeMode="ProcessingTime")



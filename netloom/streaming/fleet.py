"""Fleet state that changes by itself: liveness by timers, counts that expire, heartbeats joined with reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ONLINE, DEGRADED, OFFLINE = "online", "degraded", "offline"


class LivenessProcessor(StatefulProcessor):
    """A device's state: its latest heartbeat with the status, and the heartbeats that the watermark has not passed yet.

    Heartbeats take effect in the order of their times once the watermark passes
    them, whatever the order and the batches in which they came; so do the changes
    to degraded and offline. Timers wake a device up for its next change, also in a
    batch without any heartbeat of its own. All times are milliseconds.

    A call of the state store costs far more than a heartbeat, so waiting heartbeats
    are kept as arrays of times, one for each piece of a batch, and a device has one
    timer for the first of them: a batch costs a few calls a device.
    """

    def __init__(self, online_s: float, offline_s: float):
        # A device is online up to this age, and degraded up to that one.
        self.online, self.offline = int(online_s * 1000) + 1, int(offline_s * 1000) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "seen long, status string")
        self.pending = handle.getListState("pending", "times binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        first = None
        for frame in rows:
            times = np.unique(frame["at"].to_numpy(np.int64))
            if len(times):
                self.pending.appendValue((times.tobytes(),))
                first = int(times[0]) if first is None else min(first, int(times[0]))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        now = timerValues.getCurrentWatermarkInMs()
        seen, status = self.latest.get() or (None, None)
        held = [np.frombuffer(t[0], np.int64) for t in self.pending.get()]
        times = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        due = int(np.searchsorted(times, now, "right"))
        out: list[tuple[str, int]] = []
        for at in times[:due].tolist():
            seen, status = self._aged(seen, status, at, out)
            if status != ONLINE:
                out.append((ONLINE, at))
            seen, status = at, ONLINE
        if due == len(times):
            self.pending.clear()
        elif due:
            self.pending.put([(times[due:].tobytes(),)])
        if due < len(times):
            self.handle.registerTimer(int(times[due]))
        if seen is not None:
            # A change at exactly ``now`` has happened.
            seen, status = self._aged(seen, status, now + 1, out)
            self.latest.update((seen, status))
            if status != OFFLINE:
                self.handle.registerTimer(seen + (self.online if status == ONLINE else self.offline))
        return iter([self._changes(key, out)] if out else [])

    def _aged(self, seen: int | None, status: str | None, at: int, out: list[tuple[str, int]]) -> tuple[int | None, str | None]:
        """The status just before ``at``; changes on the way are added to ``out``."""
        for new, old, age in ((DEGRADED, ONLINE, self.online), (OFFLINE, DEGRADED, self.offline)):
            if status == old and seen + age < at:
                out.append((new, seen + age))
                status = new
        return seen, status

    @staticmethod
    def _changes(key: tuple, rows: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({"device": pd.Series([key[0]] * len(rows), dtype="int64"), "status": pd.Series([r[0] for r in rows], dtype=object), "at": pd.Series([r[1] for r in rows], dtype="int64")})

    def close(self) -> None:
        pass


def transitions(heartbeats: DataFrame, online_s: float = 30, offline_s: float = 600, late: str = "1 minute") -> DataFrame:
    """(device, status, at): every change of a device's status, from a stream of (device, seen_at). Append mode, RocksDB state store.

    A device is online up to ``online_s`` after a heartbeat, then degraded, and after
    ``offline_s`` offline; both changes come by timers on the watermark, without a
    heartbeat. A heartbeat more than ``late`` behind the latest one of any device is
    dropped; one that is not counts in its place. Null devices and times are left out.
    """
    rows = heartbeats.filter(F.col("device").isNotNull() & F.col("seen_at").isNotNull()).withWatermark("seen_at", late)
    rows = rows.select(F.col("device").cast("long").alias("device"), "seen_at", F.unix_millis("seen_at").alias("at"))
    out = rows.groupBy("device").transformWithStateInPandas(LivenessProcessor(online_s, offline_s), "device long, status string, at long", "Append", "EventTime")
    return out.select("device", "status", F.timestamp_millis("at").alias("at"))


class ExpiringCounts(StatefulProcessor):
    """A router's rounds and its last positive count, each kept for a time of its own after it came (state with a time to live)."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rounds = handle.getMapState("rounds", "round int", "n long", self.keep)
        self.positive = handle.getValueState("positive", "n long", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        for frame in rows:
            out = []
            for number, n in frame.sort_values("round")[["round", "n"]].itertuples(index=False):
                if self.rounds.containsKey((int(number),)):
                    continue
                self.rounds.updateValue((int(number),), (int(n),))
                if n > 0:
                    self.positive.update((int(n),))
                shown = int(n) if n > 0 else (self.positive.get()[0] if self.positive.exists() else 0)
                out.append((key[0], int(number), int(n), shown))
            yield pd.DataFrame(out, columns=["router_id", "round", "n", "shown"])

    def close(self) -> None:
        pass


def shown_counts(reports: DataFrame, keep: str = "24 hours") -> DataFrame:
    """(router_id, round, n, shown) from (router_id, round, n): a count of 0 shows the last positive one that came within ``keep``.

    A round counts once within ``keep``. Rows are taken a batch at a time, so a router
    with very many takes no more memory. Append mode, RocksDB state store; the time is
    the engine's own clock.
    """
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = reports.select("router_id", F.col("round").cast("int").alias("round"), F.col("n").cast("long").alias("n"))
    return rows.groupBy("router_id").transformWithStateInPandas(ExpiringCounts(ms), "router_id string, round int, n long, shown long", "Append", "ProcessingTime")


def reports_with_heartbeats(reports: DataFrame, heartbeats: DataFrame, within: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Each report (device, at, ...) with every heartbeat (device, seen_at) of its device at most ``within`` apart, or with none.

    Both sides have watermarks, so either one's rows are kept for ``within`` and
    ``late`` only; a report without a heartbeat comes out once none can come any
    more. Later rows are dropped and counted (``late_rows``). Also a batch join.
    """
    beats = heartbeats.select(F.col("device").alias("beat_device"), "seen_at")
    if reports.isStreaming:
        reports = reports.withWatermark("at", late)
    if beats.isStreaming:
        beats = beats.withWatermark("seen_at", late)
    near = F.expr(f"device = beat_device AND seen_at BETWEEN at - INTERVAL {within} AND at + INTERVAL {within}")
    return reports.join(beats, near, "leftOuter").drop("beat_device")


def late_rows(query: object) -> int:
    """Rows that a finished query's stateful operators dropped behind the watermark, of its recent batches."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)

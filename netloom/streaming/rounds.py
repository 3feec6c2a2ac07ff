"""Streaming forms of the fleet's timed loops. Inputs and outputs are streaming DataFrames.

The aggregations are the batch expressions; only watermarks, output modes and
keyed state are added. Times must be timestamps with a zone: watermarks reject others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from netloom.functions import columns as C
from netloom.operators import federated


def with_zone(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def attack_stream(spark: SparkSession, routers: int = 5, per_second: int = 1, seed: int = 0) -> DataFrame:
    """(router_id, tick, attacks): seeded Poisson attacks of each router at every tick of a rate source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    rows = ticks.select(F.col("value").alias("tick"), "timestamp", F.explode(F.sequence(F.lit(1), F.lit(routers))).alias("n"))
    return federated.attack_ticks(rows.select("tick", "timestamp", C.router_id(F.col("n")).alias("router_id")), seed=seed)


def round_counts(events: DataFrame) -> DataFrame:
    """(router_id, round, n): what a counter that is drained once a round would read, exactly once. Complete or update mode."""
    return events.groupBy("router_id", "round").agg(F.sum("label").alias("n"))


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 day", size: str = "24 hours", slide: str | None = None) -> DataFrame:
    """(window_start, router_id, anomalies, total) over tumbling or sliding windows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = events.withWatermark(ts, late).groupBy(window, "router_id").agg(F.sum("label").alias("anomalies"), F.count(F.lit(1)).alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "router_id", "anomalies", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(session_start, session_end, router_id, total): runs of events less than ``gap`` apart."""
    counts = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "router_id").agg(F.count(F.lit(1)).alias("total"))
    return counts.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "router_id", "total")


def liveness(heartbeats: DataFrame) -> DataFrame:
    """(device, seen_at): the latest heartbeat. Complete or update mode."""
    return heartbeats.groupBy("device").agg(F.max("seen_at").alias("seen_at"))


def statuses(latest: DataFrame, now: Column, online: float = 30, degraded: float = 600) -> DataFrame:
    """Statuses of a liveness table at ``now``; without a stream's own clock, so that a rerun agrees."""
    age = F.unix_micros(now) / 1e6 - F.unix_micros("seen_at") / 1e6
    return latest.withColumn("status", C.status_by_age(age, online, degraded))


def cumulative_once(reports: DataFrame, ts: str = "at", late: str = "1 day") -> DataFrame:
    """(router_id, cumulative): running totals in which a round counts once per router, however often it is reported."""
    once = reports.withWatermark(ts, late).dropDuplicatesWithinWatermark(["router_id", "round"])
    return once.groupBy("router_id").agg(F.sum("n").alias("cumulative"))


class CumulativeProcessor(StatefulProcessor):
    """State of a router: total, last round counted and the last positive count with its time.

    A round that was counted before adds nothing. While the current count is 0, the
    last positive one of the past 24 hours is shown.
    """

    TTL = pd.Timedelta(hours=24)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "total long, round int, shown long, at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total, last, shown, at = self.state.get() if self.state.exists() else (0, -1, 0, None)
        out = []
        every = pd.concat(list(rows)).sort_values(["round", "at"])
        for number, n, when in zip(every["round"], every["n"], every["at"], strict=True):
            if number <= last:
                continue
            total, last = total + int(n), int(number)
            if n > 0:
                shown, at = int(n), when
            fresh = at is not None and when - pd.Timestamp(at) < self.TTL
            out.append((key[0], last, int(n), total, int(n) if n > 0 else (shown if fresh else 0)))
        self.state.update((total, last, shown, at))
        yield pd.DataFrame(out, columns=["router_id", "round", "n", "cumulative", "shown"])

    def close(self) -> None:
        pass


def cumulative_state(reports: DataFrame) -> DataFrame:
    """(router_id, round, n, cumulative, shown) with keyed state; needs the RocksDB state store.

    reports: router_id, round, n, at. Rounds of a router come in order.
    """
    return reports.groupBy("router_id").transformWithStateInPandas(
        CumulativeProcessor(), "router_id string, round int, n long, cumulative long, shown long", "Append", "None"
    )


def write_rounds(df: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Append each batch of finished rounds as JSON, one folder per round; exactly once by batch number."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over all available input into Parquet folders, one per batch, beside its checkpoint, and return the rows.

    Of a complete result the last batch counts, otherwise all. A batch that is
    repeated after a failure replaces its own folder.
    """
    return run_watched(df, name, checkpoint, mode)[0]


def run_watched(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> tuple[DataFrame, StreamingQuery]:
    """``run_available``'s rows, and the finished query with its progress."""
    written: list[str] = []

    def sink(batch: DataFrame, number: int) -> None:
        path = f"{checkpoint}-{name}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    query = df.writeStream.outputMode(mode).queryName(name).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = df.sparkSession.read.schema(df.schema)
    rows = read.parquet(*(written[-1:] if mode == "complete" else dict.fromkeys(written))) if written else df.sparkSession.createDataFrame([], df.schema)
    return rows, query

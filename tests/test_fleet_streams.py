"""Timers, expiring state, stream-stream joins and the heartbeat source, against plain replays and batch joins."""

import datetime as dt
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.sources import heartbeats
from netloom.streaming import fleet, rounds

BEATS = "device int, seen_at timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def write(spark, path, rows, schema=BEATS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=BEATS, per_batch=1000):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def replay(beats, until, online=30, offline=600):
    """Changes up to ``until``, a device at a time."""
    out = []
    for device in {d for d, _ in beats}:
        times, status = sorted({t for d, t in beats if d == device and t <= until}), None
        for t, after in zip(times, [*times[1:], until + 0.001], strict=False):
            if status != "online":
                out.append((device, "online", t))
            status = "online"
            for new, age in (("degraded", online), ("offline", offline)):
                if t + age + 0.001 < after:
                    out.append((device, new, round(t + age + 0.001, 3)))
                    status = new
    return sorted(out)


def seen(rows):
    return sorted((r.device, r.status, round((r.at.replace(tzinfo=dt.timezone.utc) - START).total_seconds(), 3)) for r in rows)


def test_status_changes_without_a_heartbeat(spark, tmp_path):
    """One device's heartbeats move the clock for all: the other goes degraded and offline in batches that hold none of its own."""
    path = str(tmp_path / "in")
    beats = [(1, 0), (2, 0), (2, 20), (2, 100), (2, 200), (2, 700), (2, 1500)]
    for device, t in beats:
        write(spark, path, [(device, at(t))])
        time.sleep(0.01)
    out, query = rounds.run_watched(fleet.transitions(stream(spark, path, per_batch=1), late="10 seconds"), "alive", str(tmp_path / "c"), "append")
    expected = replay(beats, 1490)
    assert seen(out.collect()) == expected
    assert (1, "degraded", 30.001) in expected and (1, "offline", 600.001) in expected and (2, "online", 700) in expected


def test_any_batches_and_a_restart_give_the_same_changes(spark, tmp_path):
    rng = random.Random(4)
    beats = sorted({(d, rng.randrange(0, 5000)) for d in (1, 2, 3) for _ in range(40)}, key=lambda b: b[1])
    late = [(1, 3), (2, 1)]
    # A minute's worth of disorder stays within the watermark.
    mixed = sorted(beats, key=lambda b: b[1] + rng.uniform(0, 50))
    parts = [mixed[i : i + 20] for i in range(0, len(mixed), 20)]
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    write(spark, whole, [(d, at(t)) for d, t in beats])
    one = rounds.run_available(fleet.transitions(stream(spark, whole)), "whole", str(tmp_path / "c1"), "append")
    rows = []
    for k, part in enumerate([*parts, [(d, t) for d, t in late]]):
        write(spark, cut, [(d, at(t)) for d, t in part])
        got, query = rounds.run_watched(fleet.transitions(stream(spark, cut)), f"cut{k}", str(tmp_path / "c2"), "append")
        rows += got.collect()
    assert seen(one.collect()) == seen(rows) == replay(beats, max(t for _, t in beats) - 60)
    assert fleet.late_rows(query) == 2


def test_counts_expire(spark, tmp_path):
    """A time to live needs the engine's clock, with which a stream never runs out of batches: it is stopped once its input is read."""
    schema, path, folder = "router_id string, round int, n long", str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, [("r1", 1, 5), ("r1", 1, 5), ("r1", 2, 0), ("r2", 1, 0)], schema)
    shown = fleet.shown_counts(stream(spark, path, schema), "6 seconds")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")
    query = shown.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    rows = lambda: sorted((r.router_id, r.round, r.n, r.shown) for r in spark.read.schema("router_id string, round int, n long, shown long").parquet(folder).collect()) if os.path.isdir(folder) else []

    def wait(n):
        end = time.time() + 60
        while len(rows()) < n and time.time() < end:
            time.sleep(0.3)
        return rows()

    try:
        assert wait(3) == [("r1", 1, 5, 5), ("r1", 2, 0, 5), ("r2", 1, 0, 0)]
        time.sleep(8)
        write(spark, path, [("r1", 3, 0)], schema)
        assert ("r1", 3, 0, 0) in wait(4)
        write(spark, path, [("r1", 4, 2), ("r1", 1, 7)], schema)
        assert [r for r in wait(6) if r[1] in (1, 4)] == [("r1", 1, 5, 5), ("r1", 1, 7, 7), ("r1", 4, 2, 2), ("r2", 1, 0, 0)]
    finally:
        query.stop()


def test_reports_join_heartbeats_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    reports = [(d, at(t), t) for d in (1, 2, 3) for t in rng.sample(range(0, 4000, 7), 25)]
    beats = [(d, at(t)) for d in (1, 2) for t in rng.sample(range(0, 4000), 60)]
    schema = "device int, at timestamp, n int"
    left, right = str(tmp_path / "reports"), str(tmp_path / "beats")
    end = [(9, at(20_000), 0)], [(9, at(20_000))]
    for k in range(3):
        write(spark, left, reports[k::3], schema)
        write(spark, right, beats[k::3])
    batch = fleet.reports_with_heartbeats(spark.read.schema(schema).parquet(left), spark.read.schema(BEATS).parquet(right))
    expected = sorted(str(tuple(r)) for r in batch.collect())
    assert any("None" in r for r in expected) and any("None" not in r for r in expected)
    rows = []
    for k, more in enumerate([None, end, ([(1, at(5), -1)], [(1, at(6))])]):
        if more:
            write(spark, left, more[0], schema)
            write(spark, right, more[1])
        joined = fleet.reports_with_heartbeats(stream(spark, left, schema), stream(spark, right), late="2 hours")
        got, query = rounds.run_watched(joined, f"join{k}", str(tmp_path / "c"), "append")
        rows += [r for r in got.collect() if r.device != 9]
    assert sorted(str(tuple(r)) for r in rows) == expected
    assert fleet.late_rows(query) >= 1


def beat(folder, device, seconds):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/device_{device}.heartbeat"
    open(path, "a").close()
    os.utime(path, (1_700_000_000 + seconds,) * 2)


def test_heartbeat_stream(spark, tmp_path):
    heartbeats.register(spark)
    folders = [str(tmp_path / f"f{k}") for k in range(3)]
    beat(folders[0], 1, 0)
    beat(folders[1], 2, 5)
    open(f"{folders[0]}/notes.txt", "w").close()
    source = lambda: spark.readStream.format("heartbeat").load(",".join(folders))
    run = lambda k: sorted((r.device, int(r.s) - 1_700_000_000) for r in rounds.run_available(source(), f"beats{k}", str(tmp_path / "c"), "append").select("device", F.unix_seconds("seen_at").alias("s")).collect())
    assert run(0) == [(1, 0), (2, 5)]
    beat(folders[0], 1, 9)
    beat(folders[2], 3, 8)
    # A restart goes on from the stored offset; an unchanged file does not come again.
    assert run(1) == [(1, 9), (3, 8)]
    beat(folders[1], 2, 12)
    assert run(2) == [(2, 12)]
    table = spark.read.format("heartbeat").load(",".join(folders))
    assert table.rdd.getNumPartitions() == 3
    assert sorted((r.device, r.s - 1_700_000_000) for r in table.select("device", F.unix_seconds("seen_at").alias("s")).collect()) == [(1, 9), (2, 12), (3, 8)]


@pytest.mark.parametrize("column", ["device", "seen_at"])
def test_null_heartbeats_are_left_out(spark, tmp_path, column):
    row = {"device": 1, "seen_at": at(0)} | {column: None}
    write(spark, str(tmp_path / "in"), [(row["device"], row["seen_at"]), (2, at(0)), (2, at(300))])
    out = rounds.run_available(fleet.transitions(stream(spark, str(tmp_path / "in"))), f"nulls_{column}", str(tmp_path / "c"), "append")
    assert {r.device for r in out.collect()} == {2}


class CountedState:
    """One device's value, list or map state that counts the calls of the store."""

    def __init__(self, calls):
        self.calls, self.value, self.items, self.map = calls, None, [], {}

    def __getattribute__(self, name):
        own = object.__getattribute__(self, name)
        if callable(own):
            object.__getattribute__(self, "calls").append(name)
        return own

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.items) if self.items else self.value

    def update(self, value):
        self.value = value

    def appendValue(self, value):  # noqa: N802
        self.items.append(value)

    def put(self, values):
        self.items[:] = values

    def clear(self):
        self.items.clear()

    def containsKey(self, key):  # noqa: N802
        return key in self.map

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        self.map.pop(key)

    def keys(self):
        return list(self.map)


class CountedHandle:
    def __init__(self):
        self.calls, self.timers = [], []

    def state(self, *_):
        return CountedState(self.calls)

    getValueState = getListState = getMapState = state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("registerTimer")
        self.timers.append(at)


def test_calls_of_the_state_store_do_not_grow_with_the_heartbeats():
    class Clock:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 400_000

    handle, processor = CountedHandle(), fleet.LivenessProcessor(30, 600)
    processor.init(handle)
    times = [t * 1000 for t in range(500)]
    frames = iter([pd.DataFrame({"at": times[:300]}), pd.DataFrame({"at": times[290:]})])
    list(processor.handleInputRows((1,), frames, Clock()))
    out = pd.concat(list(processor.handleExpiredTimer((1,), Clock(), None)))
    assert [tuple(r) for r in out.itertuples(index=False)] == [(1, "online", 0)]
    assert processor.latest.value == (400_000, "online")
    # The next heartbeat and the next change each have a timer.
    assert {401_000, 430_001} <= set(handle.timers)
    assert len(handle.calls) < 20


def test_formats_of_numbers_beyond_three_digits(spark, tmp_path):
    from netloom.plans import queries
    from tests.oracle import assert_same, connect

    connect("/root/testdata/sf0.001").execute(f"COPY (SELECT * REPLACE (user_id * 1237 AS user_id) FROM events) TO '{tmp_path}/events.parquet'")
    assert_same(queries.fleet_formats(spark, str(tmp_path)), queries.ORACLE["fleet_formats"], str(tmp_path))

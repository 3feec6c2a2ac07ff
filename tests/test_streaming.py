"""Streams over all available input give the batch result."""

import datetime as dt

from pyspark.sql import functions as F

from netloom.streaming import rounds


def _reports(spark, path, rows):
    spark.createDataFrame(rows, "router_id string, round int, n long, at timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("router_id string, round int, n long, at timestamp").parquet(path)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_cumulative_counts_a_round_once(spark, tmp_path):
    stream = _reports(spark, str(tmp_path / "in"), [("r1", 1, 3, at(1)), ("r1", 1, 3, at(1)), ("r1", 2, 4, at(2)), ("r2", 1, 5, at(1))])
    out = rounds.run_available(rounds.cumulative_once(stream), "once", str(tmp_path / "c"))
    assert sorted((r.router_id, r.cumulative) for r in out.collect()) == [("r1", 7), ("r2", 5)]


def test_keyed_state(spark, tmp_path):
    rows = [("r1", 1, 3, at(1)), ("r1", 2, 0, at(1, 20)), ("r1", 3, 0, at(3)), ("r2", 1, 0, at(1))]
    stream = _reports(spark, str(tmp_path / "in"), rows)

    def run(frame):
        sink = lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))
        writer = rounds.cumulative_state(frame).writeStream.outputMode("append").foreachBatch(sink)
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert sorted(tuple(r) for r in run(stream).collect()) == [("r1", 1, 3, 3, 3), ("r1", 2, 0, 3, 3), ("r1", 3, 0, 3, 0), ("r2", 1, 0, 0, 0)]
    # The next run goes on from the state: the repeated round adds nothing.
    out = run(_reports(spark, str(tmp_path / "in"), [("r1", 3, 9, at(3)), ("r1", 4, 2, at(4))]))
    assert {r.router_id: r.c for r in out.groupBy("router_id").agg(F.max("cumulative").alias("c")).collect()} == {"r1": 5, "r2": 0}


def test_windows_and_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("r1", 1, at(1, 1)), ("r1", 0, at(1, 2)), ("r1", 1, at(2, 1)), ("r2", 1, at(1, 23))]
    spark.createDataFrame(rows, "router_id string, label int, ts timestamp").write.parquet(path)
    stream = spark.readStream.schema("router_id string, label int, ts timestamp").parquet(path)
    daily = rounds.run_available(rounds.windowed_counts(stream), "daily_test", str(tmp_path / "c1"))
    assert sorted((r.router_id, r.anomalies, r.total) for r in daily.collect()) == [("r1", 1, 1), ("r1", 1, 2), ("r2", 1, 1)]
    runs = rounds.run_available(rounds.sessions(stream, gap="2 hours"), "sessions_test", str(tmp_path / "c2"))
    assert sorted((r.router_id, r.total) for r in runs.collect()) == [("r1", 1), ("r1", 2), ("r2", 1)]


def test_attacks_and_sink(spark, tmp_path):
    query = rounds.attack_stream(spark, 2, 5).writeStream.format("memory").queryName("attacks").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("attacks").count():
                break
    finally:
        query.stop()
    assert spark.table("attacks").filter("attacks >= 0").count() > 0
    stream = _reports(spark, str(tmp_path / "in"), [("r1", 1, 3, at(1))])
    rounds.write_rounds(stream, str(tmp_path / "json"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "json")).count() == 1

"""Readers and sinks on small files."""

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from netloom.sources import heartbeats, sinks, tables


def test_flow_file(spark, tmp_path):
    text = "a, b ,c\n1,NA,x\n2,null\n3,4,5,6\n NA ,-,\n"
    (tmp_path / "f.csv").write_text(text)
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write(text)
    for name in ("f.csv", "g.csv.gz"):
        df = tables.read_flows(spark, str(tmp_path / name))
        assert df.columns == ["a", "b", "c"]
        assert set(dict(df.dtypes).values()) == {"string"}
        assert sorted((tuple(r) for r in df.collect()), key=str) == sorted([("1", None, "x"), ("2", None, None), (" NA ", "-", None)], key=str)
        assert df.count() == 3
    with pytest.raises(Exception, match="(?i)path"):
        tables.read_flows(spark, str(tmp_path / "none.csv"))


def test_inferred_types(spark, tmp_path):
    (tmp_path / "f.csv").write_text("x,y,label\n1,a,0\n2.5,b,1\n,c,0\n")
    df = tables.read_inferred(spark, str(tmp_path / "f.csv"))
    assert df.dtypes == [("x", "double"), ("y", "string"), ("label", "double")]
    table, features = tables.supervised(df.drop("y"))
    assert features == ["x"]
    assert table.dtypes == [("x", "float"), ("label", "int")]
    with pytest.raises(ValueError, match="label"):
        tables.supervised(df.drop("label"))


def test_round_files(spark, tmp_path):
    for n in (1, 2, 3, 10):
        (tmp_path / f"round_{n:03d}_metrics.json").write_text(json.dumps({"round": n, "timestamp": "2024-01-01 00:00 UTC", "anomalies_by_router": {"router-001": n}, "total_anomalies": n}))
    (tmp_path / "round_004_metrics.json").write_text("{broken")
    assert sorted(r["round"] for r in tables.round_metrics(spark, str(tmp_path)).collect()) == [1, 2, 3, 10]
    assert tables.latest_metrics(spark, str(tmp_path)).first()["round"] == 10
    assert [r["round"] for r in tables.last_metrics(spark, str(tmp_path), 2).collect()] == [3, 10]
    (tmp_path / "round_011_metrics.json").write_text("{broken")
    assert tables.latest_metrics(spark, str(tmp_path)).count() == 0


def test_heartbeat_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"device_{n}.heartbeat").touch()
        os.utime(tmp_path / f"device_{n}.heartbeat", (1_700_000_000 + n, 1_700_000_000 + n))
    (tmp_path / "other.txt").touch()
    heartbeats.register(spark)
    rows = spark.read.format("heartbeat").load(str(tmp_path)).select("device", F.unix_seconds("seen_at").alias("s")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1_700_000_001), (2, 1_700_000_002)]


def test_feature_lists_and_paths(spark, tmp_path):
    (tmp_path / "features.txt").write_text(" b \n\na\n")
    assert tables.feature_list(spark, str(tmp_path / "features.txt")) == ["b", "a"]
    (tmp_path / "empty.txt").write_text("\n")
    with pytest.raises(ValueError, match="no features"):
        tables.feature_list(spark, str(tmp_path / "empty.txt"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.KERAS").touch()
    (tmp_path / "b.keras").touch()
    assert [os.path.basename(p) for p in tables.files_by_suffix(spark, str(tmp_path), [".keras"])] == ["A.KERAS", "b.keras"]
    assert tables.first_existing(spark, ["/none", str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, ["/none"])


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("device_id", (F.col("id") % 3 + 1).cast("int"))
    sinks.write_shards(df, str(tmp_path / "shards"))
    assert tables.device_shards(spark, str(tmp_path / "shards"), [2, 9]).count() == 3
    sinks.write_shards(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    for n in (1, 2):
        sinks.write_if_absent(spark.createDataFrame([(f"plan {n}",)], "plan string"), str(tmp_path / "profile"))
    assert tables.profile(spark, str(tmp_path / "profile")).first().plan == "plan 1"
    metrics = spark.createDataFrame([(1, {"r": 2}, 2), (2, {}, 0)], "round int, anomalies_by_router map<string,int>, total_anomalies int")
    sinks.write_round_metrics(metrics, str(tmp_path / "rounds"))
    assert [r["round"] for r in spark.read.json(str(tmp_path / "rounds")).collect()] == [1]
    sinks.write_parameters({"codes": df}, str(tmp_path / "parameters"))
    assert sinks.read_parameters(spark, str(tmp_path / "parameters"), ["codes"])["codes"].count() == 10
    for second in (1, 2):
        sinks.append_heartbeats(spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, second))], "device int, seen_at timestamp"), str(tmp_path / "beats"))
    assert spark.read.parquet(str(tmp_path / "beats")).count() == 2
    assert json.loads(sinks.json_payload(df.orderBy("id").limit(1)).first().payload) == {"id": 0, "device_id": 1}

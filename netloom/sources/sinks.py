"""Writers: shards, weights by round, round metrics, parameters, reports, heartbeats, JSON payloads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One table partitioned by device_id; ``kind`` csv writes a header."""
    writer = df.repartition("device_id").write.mode("overwrite").partitionBy("device_id")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_round(df: DataFrame, path: str, number: int) -> DataFrame:
    """A round's table in its own partition folder, re-read."""
    own = f"{path}/round={number}"
    df.write.mode("overwrite").parquet(own)
    return df.sparkSession.read.schema(df.schema).parquet(own)


def write_round_metrics(metrics: DataFrame, path: str) -> None:
    """Append rounds that at least one router reported, as JSON partitioned by round."""
    some = metrics.filter(F.size("anomalies_by_router") > 0)
    some.withColumn("in_round", F.col("round")).repartition("in_round").write.mode("append").partitionBy("in_round").json(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("ignore").json(path)


def write_parameters(tables: dict[str, DataFrame], path: str) -> None:
    """Fitted parameters: a small table each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def read_parameters(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_heartbeats(df: DataFrame, path: str) -> None:
    """Append (device, seen_at) rows; the latest one per device counts when they are read."""
    df.select("device", "seen_at").write.mode("append").parquet(path)


def json_payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """Each row as JSON."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where it is unset, an own one, for a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from it."""
    path = f"{shared_folder(df.sparkSession)}/netloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A stored table of at most so many rows, each of a few short values, may be broadcast.
SMALL_ROWS = 200_000


def small_side(df: DataFrame, name: str, limit: int = SMALL_ROWS) -> DataFrame:
    """A stored table, to be broadcast if it was counted within ``limit``; otherwise its join shuffles."""
    table = stored(df, name)
    return F.broadcast(table) if table.count() <= limit else table

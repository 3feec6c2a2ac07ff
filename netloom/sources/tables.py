"""Readers: delimited flow files, device shards, round metrics, feature lists, heartbeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import columns as C

ROUND_METRICS = "round int, timestamp string, anomalies_by_router map<string,int>, total_anomalies int"
PROFILE = "plan string, next_bill string, due_date string, billing_cycle string, router_model string, uptime double, speed_consistency double"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """A flow file with all columns as text: rows with too few fields are filled with nulls, those with too many go.

    Header names are trimmed; tokens for "no value" become null. Compressed files
    are read by their suffix. A missing path raises.
    """
    names = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "__extra"]])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.filter(F.col("__extra").isNull()).drop("__extra")
    return rows.select(*[C.null_tokens(F.col(f"`{c}`")).alias(c) for c in names])


def infer_types(flows: DataFrame) -> DataFrame:
    """Text columns whose every value is a number become doubles: one pass over all columns."""
    bad = flows.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & C.to_number(F.col(f"`{c}`")).isNull()).alias(c) for c in flows.columns]).first()
    return flows.select(*[(C.to_number(F.col(f"`{c}`")) if bad[i] == 0 else F.col(f"`{c}`")).alias(c) for i, c in enumerate(flows.columns)])


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    return infer_types(read_flows(spark, path))


def supervised(df: DataFrame, label: str = "label") -> tuple[DataFrame, list[str]]:
    """(table, features): every other column as float, the label as int."""
    if label not in df.columns:
        raise ValueError(f"missing columns: {[label]}")
    features = [c for c in df.columns if c != label]
    return df.select(*[F.col(f"`{c}`").cast("float").alias(c) for c in features], F.col(label).cast("int").alias(label)), features


def device_shards(spark: SparkSession, path: str, devices: Sequence[int] | None = None) -> DataFrame:
    """One table partitioned by device_id; devices without data are simply not there. Only their folders are read."""
    df = spark.read.parquet(path)
    return df if devices is None else df.filter(F.col("device_id").isin(*devices))


def round_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Round-metrics files that parse, with the file's round number as ``file_round``."""
    read = spark.read.schema(f"{ROUND_METRICS}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "round_*_metrics.json")
    rows = read.json(path).select("*", C.round_of_file(F.col("_metadata.file_name")).alias("file_round"))
    return rows.filter(F.col("_bad").isNull() & F.col("round").isNotNull()).drop("_bad")


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of the latest file; no row if that file doesn't parse, without falling back on an earlier one."""
    read = spark.read.option("wholetext", True).option("pathGlobFilter", "round_*_metrics.json").text(path)
    last = read.select("value", C.round_of_file(F.col("_metadata.file_name")).alias("file_round")).orderBy(F.col("file_round").desc()).limit(1)
    parsed = last.select(F.from_json("value", ROUND_METRICS).alias("m"), "file_round")
    return parsed.filter(F.col("m.round").isNotNull()).select("m.*", "file_round")


def last_metrics(spark: SparkSession, path: str, n: int = 6) -> DataFrame:
    """The n latest rounds that parse, oldest first."""
    return round_metrics(spark, path).orderBy(F.col("file_round").desc()).limit(n).orderBy("file_round")


def profile(spark: SparkSession, path: str) -> DataFrame:
    """A client's profile; a file that doesn't parse gives one row of nulls."""
    return spark.read.schema(PROFILE).option("multiLine", True).json(path)


def feature_list(spark: SparkSession, path: str) -> list[str]:
    """The non-blank lines of a text file, trimmed, in order; an empty file is an error."""
    lines = [r.value.strip() for r in spark.read.option("wholetext", True).text(path).select(F.explode(F.split("value", "\n")).alias("value")).collect()]
    names = [x for x in lines if x]
    if not names:
        raise ValueError(f"no features in {path}")
    return names


def files_by_suffix(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> list[str]:
    """Files below a folder of any store that Spark reads, with one of the suffixes in any case: URIs by lower-case name and then path."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).inputFiles()
    name = lambda uri: uri.rpartition("/")[2].lower()
    return sorted((uri for uri in listed if name(uri).endswith(tuple(x.lower() for x in suffixes))), key=lambda uri: (name(uri), uri))


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists, in whatever store Spark reads it from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        if path.getFileSystem(conf).exists(path):
            return candidate
    raise FileNotFoundError(f"none of {list(candidates)}")

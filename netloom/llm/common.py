"""Pieces that several operators share: shared-folder tables, checked broadcasts, native words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words between ASCII blanks: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"

#: A side of at most so many bytes may be broadcast.
BROADCAST_BYTES = 24 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where unset, an own one, for a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/netloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        own = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType).cast("long")) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.size(value) * 8
        return F.greatest(F.coalesce(own, F.lit(0)), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when its summed bytes are within ``limit``; otherwise leave the join to a shuffle. ``df`` should be a stored table."""
    each = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= limit else df


def words_of(text: Column, separators: str = BLANKS) -> Column:
    """The non-empty words of a text (null: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

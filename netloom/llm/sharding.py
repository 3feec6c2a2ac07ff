"""Sharding by extendible hashing.

A directory indexed by hash-prefix bits names each document's shard. A shard
splits on its next bit while it is over the byte limit, and only then, so the
directory follows the data. Sizes are summed once over fine prefixes; the tree
of splits is worked out on those sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import common

SHARD_BYTES = 16 * 2**20
#: Bits of a hash; rows whose hashes agree in all of them stay together.
BITS = 60
#: Prefix bits that one pass looks at beyond those that an even spread would need.
AHEAD = 6


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits from id and text, so that equal ids alone don't pile up in a shard."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def _leaves(cells: DataFrame, top: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """From (h, bytes, low, high) at ``depth`` bits: the shards (depth, prefix, bytes) and the nodes still too large at ``depth``.

    ``top``: the nodes of that depth are known to be too large (0: the root is looked at too).
    """
    levels = F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth")
    nodes = cells.select("h", "bytes", "low", "high", levels).groupBy("depth", _prefix(F.col("h"), F.col("depth")).alias("prefix"))
    nodes = nodes.agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    nodes = common.materialize(nodes.withColumn("fits", (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))), "nodes")
    splits = nodes.filter(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    below = nodes.filter(F.col("fits")).withColumn("parent", F.shiftright("prefix", 1))
    leaves = below.join(splits, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes")
    if top == 0:
        leaves = leaves.unionByName(below.filter("depth = 0").select("depth", "prefix", "bytes"))
    return leaves, nodes.filter(~F.col("fits") & (F.col("depth") == depth)).select("prefix")


def shards(sized: DataFrame, limit: int = SHARD_BYTES) -> tuple[DataFrame, int, DataFrame]:
    """The directory for rows of (h, bytes): (leaves, bits, deep).

    leaves: (depth, prefix, bytes) of all shards of depth <= bits; deep: (h,
    depth, prefix, bytes) for the rows of the few cells that are too large at ``bits``.
    """
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    sums = [F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")]
    cells = sized.groupBy(_prefix(F.col("h"), F.lit(bits)).alias("cell")).agg(*sums)
    leaves, large = _leaves(cells.withColumn("h", F.call_function("shiftleft", F.col("cell"), F.lit(BITS - bits))), 0, bits, limit)
    at, parts = bits, []
    while at < BITS and not (large := common.materialize(large, "large")).isEmpty():
        rows = sized.withColumn("prefix", _prefix(F.col("h"), F.lit(at))).join(common.maybe_broadcast(large), "prefix", "left_semi")
        rows = common.materialize(rows.groupBy("h").agg(F.sum("bytes").alias("bytes")), "rows")
        deeper = min(BITS, at + 12)
        more, large = _leaves(rows.select("h", "bytes", F.col("h").alias("low"), F.col("h").alias("high")), at, deeper, limit)
        more = more.filter(F.col("depth") > at)
        for d in range(at + 1, deeper + 1):
            own = more.filter(F.col("depth") == d).withColumnRenamed("bytes", "shard_bytes")
            parts.append(rows.select("h", _prefix(F.col("h"), F.lit(d)).alias("prefix")).join(own, "prefix").select("h", "depth", "prefix", "shard_bytes"))
        at = deeper
    deep = sized.sparkSession.createDataFrame([], "h long, depth int, prefix long, shard_bytes long")
    for p in parts:
        deep = deep.unionByName(p)
    return leaves, bits, deep


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Add n_bytes (UTF-8 bytes of the text; null: 0), shard (its prefix bits as text, "" for a single shard) and shard_bytes.

    Every shard holds at most ``limit`` bytes, but for one whose rows are all
    equal in id and text (such as a single longer document), which can't split.
    An empty table gives no rows. Other columns stay; those of the three names are replaced.
    """
    sized = docs.select(F.struct("*").alias("row"), hash_bits(F.col("doc_id"), F.col("text")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    small = common.materialize(sized.select("h", F.col("n_bytes").alias("bytes")), "sizes")
    leaves, bits, deep = shards(small, limit)
    leaves, deep = common.materialize(leaves, "leaves"), common.materialize(deep, "deep")
    # The directory: one entry for each value of the first ``bits`` bits.
    entries = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits) - F.col("depth"))
    first = F.call_function("shiftleft", F.col("prefix"), F.lit(bits) - F.col("depth"))
    directory = leaves.select(F.explode(F.sequence(first, first + entries - 1)).alias("cell"), "depth", "prefix", F.col("bytes").alias("shard_bytes"))
    out = sized.withColumn("cell", _prefix(F.col("h"), F.lit(bits))).join(common.maybe_broadcast(directory), "cell", "left")
    rare = deep.toDF("h", "deep_depth", "deep_prefix", "deep_bytes")
    out = out.join(common.maybe_broadcast(rare), "h", "left")
    shard = F.expr("lpad(bin(coalesce(prefix, deep_prefix)), coalesce(depth, deep_depth), '0')")
    shard = F.when(F.coalesce("depth", "deep_depth") == 0, F.lit("")).otherwise(shard)
    new = {"n_bytes": F.col("n_bytes"), "shard": shard, "shard_bytes": F.coalesce("shard_bytes", "deep_bytes")}
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])

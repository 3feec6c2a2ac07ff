"""Line removal by site-relative frequency, in native column expressions.

Within each host, a line that more than ``ratio`` of the host's pages hold, and
more than one page, is boilerplate and goes from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import common

RATIO = 0.3
#: Blanks that are trimmed from a line's ends.
BLANKS = " \t\x0b\x0c"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port or path, an address in brackets with them; empty for null and for what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """The non-blank lines of a page, trimmed; a line ends at a line feed, a carriage return or both, and a tag begins a new one."""
    cut = F.split(F.replace(F.coalesce(html, F.lit("")), F.lit("<"), F.lit("\n<")), "[\r\n]+")
    return F.filter(F.transform(cut, lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")


def boilerplate(lines: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, common): from rows of (host, hashes), the line hashes that more than ``ratio`` of the host's pages hold.

    At most (mean lines of a page / ratio) hashes for a host, however many pages it has.
    """
    pages = lines.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = lines.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    often = held.join(pages, "host").filter((F.col("n") > 1) & (F.col("n") > F.col("pages") * ratio))
    return often.groupBy("host").agg(F.collect_list("hash").alias("common"))


def drop_boilerplate(pages: DataFrame, key: str = "page_id", ratio: float = RATIO) -> DataFrame:
    """Per page: ``key``, host, n_lines, n_dropped and kept (the remaining lines, joined by line feeds).

    Lines are compared by 64-bit hashes. A null page has no lines; pages with a
    null or odd URL share the host ""; repeated rows count as pages and each get
    a row; a host's only page keeps all lines; long pages are read whole; columns besides ``key``, url and html are not read.
    """
    split = pages.select(F.col(key), host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    common_lines = common.materialize(boilerplate(split.select("host", hashes.alias("hashes")), ratio), "boilerplate")
    joined = split.join(common.maybe_broadcast(common_lines), "host", "left")
    left = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", F.xxhash64(x))))
    joined = joined.select(key, "host", F.size("lines").cast("long").alias("n_lines"), left.alias("left"))
    return joined.select(key, "host", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept"))

"""Fleet questions: anomaly rates, liveness, alerts, rounds, participation and summaries.

Inputs: devices (device, region), flows (device, ts, label), heartbeats
(device, seen_at) and round counts (round, router_id, n, at). ``now`` is always an
argument. Joins are on device or router; every side is one row per device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import columns as C
from netloom.operators.filters import trailing, within_ttl


def device_anomalies(flows: DataFrame, devices: DataFrame | None = None, now: Column | None = None, window: str = "24 hours") -> DataFrame:
    """(device, anomalies, total, rate, window): counts of label 1; with ``devices``, also those without flows.

    With ``now``, only the trailing window counts. The rate divides by at least 1.
    """
    rows = flows if now is None else trailing(flows, "ts", now, window)
    counts = rows.groupBy("device").agg(F.count_if(F.col("label") == 1).alias("anomalies"), F.count(F.lit(1)).alias("total"))
    if devices is not None:
        counts = devices.select("device").join(counts, "device", "left").fillna(0, ["anomalies", "total"])
    tag = F.lit("all" if now is None else window.replace(" hours", "h"))
    return counts.select("device", "anomalies", "total", (F.col("anomalies") / F.greatest("total", F.lit(1))).alias("rate"), tag.alias("window"))


def last_seen(heartbeats: DataFrame) -> DataFrame:
    return heartbeats.groupBy("device").agg(F.max("seen_at").alias("seen_at"))


def age_seconds(seen_at: Column, now: Column) -> Column:
    return F.unix_micros(now) / 1e6 - F.unix_micros(seen_at) / 1e6


def fleet_status(heartbeats: DataFrame, now: Column, online: float = 30, degraded: float = 600, since_start: Column | None = None) -> DataFrame:
    """(device, seen_at, status, status_overview) by the operator's rule, with grace after a start."""
    seen = last_seen(heartbeats)
    age = age_seconds(F.col("seen_at"), now)
    status = C.status_by_age(age, online, degraded) if since_start is None else C.status_with_grace(age, since_start, 60, online, degraded)
    return seen.withColumn("status", status).withColumn("status_overview", C.overview_status(F.col("status")))


def fleet_status_for_client(heartbeats: DataFrame, now: Column, degraded: float = 30, offline: float = 60) -> DataFrame:
    """(device, seen_at, status) by the client's rule."""
    return last_seen(heartbeats).withColumn("status", C.status_for_client(age_seconds(F.col("seen_at"), now), degraded, offline))


def latest_round(rounds: DataFrame) -> DataFrame:
    """The rows of the latest round."""
    return rounds.join(F.broadcast(rounds.agg(F.max("round").alias("round"))), "round", "left_semi")


def latest_rounds(rounds: DataFrame, n: int = 6) -> DataFrame:
    """The rows of the n latest rounds."""
    return rounds.join(F.broadcast(rounds.select("round").distinct().orderBy(F.col("round").desc()).limit(n)), "round", "left_semi")


def round_metrics(reports: DataFrame) -> DataFrame:
    """(round, anomalies_by_router, total_anomalies): the last report of a router in a round counts.

    reports: round, router_id, n, seq; rows without router or count are left out.
    """
    valid = reports.filter(F.col("router_id").isNotNull() & F.col("n").isNotNull())
    last = valid.groupBy("round", "router_id").agg(F.max_by("n", "seq").alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("router_id", "n"))))
    return last.groupBy("round").agg(entries.alias("anomalies_by_router"), F.sum("n").alias("total_anomalies"))


def by_router(metrics: DataFrame) -> DataFrame:
    """(round, router_id, n) from the maps of round metrics."""
    return metrics.select("round", F.explode("anomalies_by_router").alias("router_id", "n"))


def cumulative(counts: DataFrame) -> DataFrame:
    """(router_id, round, n, cumulative): running totals by router; a round counts once, however often it was reported."""
    once = counts.groupBy("router_id", "round").agg(F.max("n").alias("n"))
    order = Window.partitionBy("router_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return once.withColumn("cumulative", F.sum("n").over(order))


def shown_count(current: Column, last_count: Column, last_at: Column, now: Column) -> Column:
    """The current count, or the last known one of the past 24 hours when it is 0."""
    return F.when((current == 0) & (last_count > 0) & within_ttl(last_at, now), last_count).otherwise(current)


def chart(metrics: DataFrame, n: int = 6) -> DataFrame:
    """(round, label, usage, speed) of the latest rounds, oldest first."""
    total = F.col("total_anomalies")
    last = latest_rounds(metrics, n).select("round", F.concat(F.lit("R"), F.col("round").cast("string")).alias("label"), total.alias("usage"), C.speed_proxy(total).alias("speed"))
    return last.orderBy("round")


def device_records(devices: DataFrame, anomalies: DataFrame, rounds: DataFrame, totals: DataFrame, status: DataFrame) -> DataFrame:
    """One record per device: region, anomalies, rate, the latest round's count, running total and status.

    All joins are left joins of one row per device; the small sides are broadcast by size.
    """
    out = devices.withColumn("router_id", C.router_id(F.col("device")))
    out = out.join(anomalies.select("device", "anomalies", "total", "rate"), "device", "left")
    out = out.join(latest_round(rounds).select("router_id", F.col("n").alias("round_count")), "router_id", "left")
    out = out.join(totals.groupBy("router_id").agg(F.max_by("cumulative", "round").alias("cumulative")), "router_id", "left")
    out = out.join(status.select("device", "seen_at", "status", "status_overview"), "device", "left")
    return out.fillna(0, ["anomalies", "total", "rate", "round_count", "cumulative"]).fillna("offline", ["status"]).fillna("degraded", ["status_overview"])


def device_detail(records: DataFrame, router_id: str) -> DataFrame:
    """One device's record, no row if there is none: the filter moves below the joins."""
    return records.filter(F.col("router_id") == router_id).limit(1)


def summary(records: DataFrame) -> DataFrame:
    """One row: total, online, degraded, offline (by the overview's status) and the sum of anomalies."""
    s = F.col("status_overview")
    return records.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == x).alias(x) for x in ("online", "degraded", "offline")], F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"))


def summary_for_client(status: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: total, online, degraded, alerts_24h."""
    s = F.col("status")
    counts = status.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "online").alias("online"), F.count_if(s == "degraded").alias("degraded"))
    return counts.join(F.broadcast(alerts.agg(F.count(F.lit(1)).alias("alerts_24h"))), how="cross")


def alerts_by_count(counts: DataFrame) -> DataFrame:
    """(router_id, n, severity, title) for positive counts."""
    severity = C.severity_by_count(F.col("n"))
    return counts.filter(F.col("n") > 0).select("router_id", "n", severity.alias("severity"), F.concat(F.lit("Anomalies on "), "router_id").alias("title"))


def alerts_by_rate(records: DataFrame) -> DataFrame:
    """(router_id, rate, severity): up to two alerts of a device."""
    return records.select("router_id", "rate", F.explode(C.severities_by_rate(F.col("rate"), F.col("status"))).alias("severity"))


def participation(counts: DataFrame, devices: DataFrame) -> DataFrame:
    """(round, reported, percent): routers that reported out of all devices, cut to a whole percent."""
    total = devices.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    reported = counts.groupBy("round").agg(F.count_distinct("router_id").alias("reported"))
    return reported.join(F.broadcast(total), how="cross").select("round", "reported", F.floor(F.col("reported") / F.col("total") * 100).cast("int").alias("percent"))


def router_status(counts: DataFrame, heartbeats: DataFrame, now: Column, degraded: float = 30, offline: float = 60) -> DataFrame:
    """(router_id, n, status): heartbeats meet routers by the digits of their ids; without a heartbeat, online."""
    seen = last_seen(heartbeats).select(F.col("device").cast("int").alias("device"), "seen_at")
    joined = counts.withColumn("device", C.digits(F.col("router_id"))).join(seen, "device", "left")
    return joined.select("router_id", "n", C.status_for_client(age_seconds(F.col("seen_at"), now), degraded, offline).alias("status"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of ``first``, or those of ``second`` if there are none; decided within the plan."""
    return first.unionByName(second.join(first.limit(1).select(F.lit(1).alias("__some")), how="left_anti"))


def first_devices(records: DataFrame, n: int = 4, order: str = "device") -> DataFrame:
    """The first n devices in their own order."""
    return records.orderBy(order).limit(n)


def top_devices(records: DataFrame, by: str, n: int = 4) -> DataFrame:
    """The n devices with the largest ``by``."""
    return records.orderBy(F.col(by).desc(), "router_id").limit(n)


def best_paths(paths: DataFrame, tokens: list[str]) -> DataFrame:
    """The path whose name holds most of the tokens, then the newest, then the first by name.

    paths: path, modified.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    score = sum((name.contains(t.lower()).cast("int") for t in tokens), F.lit(0))
    return paths.withColumn("score", score).orderBy(F.col("score").desc(), F.col("modified").desc(), name, "path").limit(1)

"""The dashboards' answers as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import columns as C
from netloom.operators import fleet


# Fixed values of a client's answer: a device's place and model, and what stands for nothing.
ROOM, MODEL, NONE = "Client site", "Federated-IDS", "-"


def _ordered(df: DataFrame, order: list[str], row: Column, name: str) -> DataFrame:
    """One row: an array of ``row`` in the order of columns. Fleet tables have a row per device or round."""
    packed = F.array_sort(F.collect_list(F.struct(*order, row.alias("row"))))
    return df.agg(F.transform(packed, lambda x: x["row"]).alias(name))


def client_payload(counts: DataFrame, metrics: DataFrame, heartbeats: DataFrame, profile: DataFrame, now: Column, degraded: float = 30, offline: float = 60, stamp: Column | None = None) -> DataFrame:
    """One row: summary, top_devices, chart, devices, alerts, service.

    counts: the latest (router_id, n), reported at ``stamp`` (text, the metrics' own
    time; none: "-"). Without any, the devices come from heartbeats, each with its own
    time and no usage.
    """
    stamp = F.coalesce(F.lit(None).cast("string") if stamp is None else stamp, F.lit(NONE))
    ranked = fleet.router_status(counts, heartbeats, now, degraded, offline)
    usage = F.concat(F.col("n").cast("string"), F.lit(" alerts"))
    ranked = ranked.select("router_id", F.col("n").cast("long").alias("n"), "status", stamp.alias("last_seen"), usage.alias("usage"))
    spare = fleet.fleet_status_for_client(heartbeats, now, degraded, offline)
    spare = spare.select(F.concat(F.lit("router-"), F.col("device").cast("string")).alias("router_id"), F.lit(0).cast("long").alias("n"), "status", F.coalesce(C.utc_time(F.col("seen_at")), F.lit(NONE)).alias("last_seen"), F.lit(NONE).alias("usage"))
    devices = fleet.with_fallback(ranked, spare)
    alerts = fleet.alerts_by_count(counts)
    device = F.struct(F.col("router_id").alias("name"), F.lit(ROOM).alias("room"), "status", "last_seen", F.lit(NONE).alias("firmware"), F.col("usage").alias("usage_24h"), F.lit(MODEL).alias("model"))
    alert = F.struct(F.col("router_id").alias("title"), F.concat(F.col("n").cast("string"), F.lit(" anomalies detected in the last round.")).alias("message"), stamp.alias("time"), "severity")
    tops = fleet.first_devices(devices, 4, "router_id")
    chart = fleet.chart(metrics)
    packed = chart.agg(F.array_sort(F.collect_list(F.struct("round", "label", "usage", "speed"))).alias("c"))
    packed = packed.select(F.struct(F.transform("c", lambda x: x["label"]).alias("labels"), F.transform("c", lambda x: x["usage"]).alias("usage"), F.transform("c", lambda x: x["speed"]).alias("speed")).alias("chart"))
    parts = [
        fleet.summary_for_client(devices, alerts).select(F.struct("total", "online", "degraded", "alerts_24h").alias("summary")),
        _ordered(tops, ["router_id"], F.struct(F.col("router_id").alias("name"), F.concat(F.col("n").cast("string"), F.lit(" anomalies")).alias("usage")), "top_devices"),
        packed,
        _ordered(devices, ["router_id"], device, "devices"),
        _ordered(alerts, ["router_id"], alert, "alerts"),
        profile.limit(1).select(F.struct("*").alias("service")),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.join(F.broadcast(part), how="cross")
    return out


def operator_index(records: DataFrame) -> DataFrame:
    """One row: summary, devices and the chart arrays of the operator's page."""
    device = F.struct("device", "router_id", "region", "status", "status_overview", "anomalies", "rate", "cumulative")
    series = F.struct("router_id", "anomalies", C.participation(F.col("status")).alias("participation"))
    left = fleet.summary(records).select(F.struct("*").alias("summary"))
    return left.join(F.broadcast(_ordered(records, ["device"], device, "devices")), how="cross").join(F.broadcast(_ordered(records, ["device"], series, "chart")), how="cross")


def model_page(scores: DataFrame, counts: DataFrame, devices: DataFrame, weights_file: Column) -> DataFrame:
    """One row: the latest round's number, participation, and accuracy, recall and fpr as text. One scan of the test rows."""
    latest = fleet.participation(fleet.latest_round(counts), devices).select("round", "percent")
    figures = scores.select(*[F.format_string("%.4f", F.col(c)).alias(c) for c in ("accuracy", "recall", "fpr")])
    return figures.join(F.broadcast(latest), how="cross").withColumn("file_round", C.round_of_file(weights_file))


def client_view(payload: DataFrame) -> DataFrame:
    """A payload's parts with the client's defaults for what is missing."""
    s = F.col("service")
    return payload.select(
        F.coalesce(F.col("summary.total"), F.lit(0)).alias("total"), F.coalesce(F.col("summary.online"), F.lit(0)).alias("online"),
        F.transform("devices", lambda d: F.struct(d["name"].alias("name"), C.enum_state(d["status"]).alias("state"))).alias("devices"),
        F.transform("alerts", lambda a: F.struct(a["title"].alias("title"), C.enum_severity(a["severity"]).alias("severity"))).alias("alerts"),
        C.scaled_series(F.transform("chart.usage", lambda x: x.cast("double"))).alias("usage_line"),
        F.coalesce(s["plan"], F.lit("Unknown")).alias("plan"), F.coalesce(s["uptime"], F.lit(0.0)).alias("uptime"),
    )

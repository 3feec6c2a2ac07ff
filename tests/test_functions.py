"""Edges of the scalar rules."""

import math

import pytest
from pyspark.sql import functions as F

from netloom.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("age", "operator", "client"), [(29, "online", "online"), (30, "degraded", "degraded"), (59, "degraded", "degraded"), (60, "degraded", "offline"), (599, "degraded", "offline"), (600, "offline", "offline")])
def test_status(spark, age, operator, client):
    assert one(spark, C.status_by_age(F.lit(age))) == operator
    assert one(spark, C.status_for_client(F.lit(age))) == client
    assert one(spark, C.status_with_grace(F.lit(age), F.lit(59))) == "online"
    assert one(spark, C.status_with_grace(F.lit(age), F.lit(60))) == operator


def test_status_without_heartbeat(spark):
    none = F.lit(None).cast("double")
    assert one(spark, C.status_by_age(none)) == "offline"
    assert one(spark, C.status_for_client(none)) == "online"


@pytest.mark.parametrize(("n", "severity"), [(0, None), (1, "low"), (4, "low"), (5, "medium"), (9, "medium"), (10, "high")])
def test_severity(spark, n, severity):
    assert one(spark, C.severity_by_count(F.lit(n))) == severity


@pytest.mark.parametrize(("rate", "status", "expected"), [(0.2, "online", ["high"]), (0.1, "offline", ["medium", "low"]), (0.0, "offline", ["low"]), (0.0, "online", [])])
def test_severities_by_rate(spark, rate, status, expected):
    assert one(spark, C.severities_by_rate(F.lit(rate), F.lit(status))) == expected


@pytest.mark.parametrize(("text", "number"), [("1.5", 1.5), (" 2 ", 2.0), ("1d", None), ("-", None), ("", None), ("NaN", None), (".5", 0.5), ("1e3", 1000.0), ("0x10", None), ("inf", math.inf)])
def test_to_number(spark, text, number):
    assert one(spark, C.to_number(F.lit(text))) == number


def test_missing_and_infinite(spark):
    assert one(spark, C.finite_or_zero(F.lit(float("inf")))) == 0
    assert one(spark, C.finite_or_zero(F.lit(float("nan")))) == 0
    assert one(spark, C.finite_or_zero(F.lit(None).cast("double"))) == 0
    assert one(spark, C.log1p_clipped(F.lit(-3.0))) == 0
    assert one(spark, C.clean_categorical(F.lit("-"))) == "missing"
    assert one(spark, C.clean_categorical(F.lit(" -"))) == " -"
    assert one(spark, C.label_from_type(F.lit(None).cast("string"))) == 1
    assert one(spark, C.label_from_type(F.lit("NORMAL"))) == 0


def test_formats(spark):
    assert one(spark, C.digits(F.lit("router-001"))) == one(spark, C.digits(F.lit("router-1"))) == 1
    assert one(spark, C.digits(F.lit("router"))) is None
    assert one(spark, C.round_of_file(F.lit("round_012_metrics.json"))) == 12
    assert one(spark, C.percent(F.lit(0.1234))) == "12.3%"
    assert one(spark, C.speed_proxy(F.lit(45))) == 10
    assert one(spark, C.speed_proxy(F.lit(3))) == 47
    assert one(spark, C.scaled_series(F.array(F.lit(2.0), F.lit(2.0)))) == [0.0, 0.0]
    assert one(spark, C.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, C.map_total(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))) == 5
    assert one(spark, C.state_entry(F.lit("7"))).asDict() == {"count": 7, "ts": None, "round": None}
    assert one(spark, C.local_time(F.timestamp_seconds(F.lit(1719828000)))).endswith("13:00 EET")

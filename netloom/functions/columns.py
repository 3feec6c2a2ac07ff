"""Scalar expressions: cleaning, labels, fleet status and severity, formats. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "missing"

# Tokens that a delimited file writes for "no value", compared exactly and untrimmed.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_tokens(c: Column) -> Column:
    """Null for a token that stands for no value."""
    return F.when(~c.isin(*NA_TOKENS), c)


def clean_categorical(c: Column) -> Column:
    """``missing`` for null and for exactly "-"."""
    return F.when(c.isNull() | (c == "-"), F.lit(MISSING)).otherwise(c)


def to_number(c: Column) -> Column:
    """A double, or null for what isn't a plain number: type suffixes such as "1d" don't count as numbers."""
    plain = F.trim(c.cast("string"))
    shape = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)$"
    return F.when(plain.rlike(shape), plain).try_cast("double")


def finite_or_zero(c: Column) -> Column:
    """0 for null, NaN and both infinities."""
    return F.when(F.abs(c) == float("inf"), F.lit(0.0)).otherwise(zero_if_missing(c))


def zero_if_missing(c: Column) -> Column:
    """0 for null and NaN; infinities stay."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def log1p_clipped(c: Column) -> Column:
    """log(1 + x) of a number that is cut off at 0 below."""
    return F.log1p(F.greatest(c, F.lit(0.0)))


def label_from_type(c: Column) -> Column:
    """1 unless the class is ``normal`` in any case; a null class counts as an attack."""
    return F.coalesce((F.lower(c) != "normal").cast("int"), F.lit(1))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def argmax(c: Column) -> Column:
    """0-based position of an array's largest element, the first of equals."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    """Probabilities of an array of class scores; the largest score is taken off first, so none overflows."""
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def focal_loss(probabilities: Column, truth: Column, alpha: Column, gamma: float = 2.0) -> Column:
    """-alpha (1 - p)^gamma ln p of the true class; probabilities are scaled to sum 1, then kept 1e-7 away from 0 and 1.

    probabilities, alpha: arrays by class; truth: 0-based class. Gamma 0 and alpha 1 give cross-entropy.
    """
    p = F.get(probabilities, truth) / F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    p = clip(p, 1e-7, 1 - 1e-7)
    return -F.get(alpha, truth) * F.pow(1 - p, F.lit(float(gamma))) * F.log(p)


def min_max(c: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); x - min where the column is constant. Values outside the range are not cut."""
    return (c - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def z_score(c: Column, mean: Column, deviation: Column) -> Column:
    """(x - mean) / deviation, a deviation of 0 counting as 1."""
    return (c - mean) / F.coalesce(F.nullif(deviation, F.lit(0.0)), F.lit(1.0))


def one_hot(code: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == code).cast("float"))


# --- fleet --------------------------------------------------------------------


def status_by_age(age: Column, online: float = 30, degraded: float = 600) -> Column:
    """Operator's rule on seconds since a device was seen: online, degraded, else offline; never seen is offline."""
    return F.when(age < online, "online").when(age < degraded, "degraded").otherwise("offline")


def status_with_grace(age: Column, since_start: Column, grace: float = 60, online: float = 30, degraded: float = 600) -> Column:
    """The same, but everything is online while the application has just started."""
    return F.when(since_start < grace, "online").otherwise(status_by_age(age, online, degraded))


def status_for_client(age: Column, degraded: float = 30, offline: float = 60) -> Column:
    """Client's rule: offline from ``offline`` seconds on, degraded from ``degraded`` on; never seen is online."""
    return F.when(age >= offline, "offline").when(age >= degraded, "degraded").otherwise("online")


def overview_status(status: Column) -> Column:
    """The overview shows offline devices as degraded."""
    return F.when(status == "offline", "degraded").otherwise(status)


def severity_by_count(n: Column) -> Column:
    """high from 10 on, medium from 5 on, low above 0, null otherwise."""
    return F.when(n >= 10, "high").when(n >= 5, "medium").when(n > 0, "low")


def severities_by_rate(rate: Column, status: Column) -> Column:
    """Array of the alerts of a device: high from 0.2 on or medium above 0, and low if it is offline as well."""
    return F.array_compact(F.array(F.when(rate >= 0.2, "high").when(rate > 0, "medium"), F.when(status == "offline", "low")))


def participation(status: Column) -> Column:
    return F.when(status != "offline", 100).otherwise(0)


def speed_proxy(total: Column) -> Column:
    """max(10, 50 - min(total, 40))."""
    return F.greatest(F.lit(10), 50 - F.least(total, F.lit(40)))


def enum_state(c: Column) -> Column:
    """A device state in any case; everything unknown is online."""
    return F.when(F.lower(c).isin("online", "degraded", "offline"), F.lower(c)).otherwise("online")


def enum_severity(c: Column) -> Column:
    """An alert severity in any case; everything unknown is low."""
    return F.when(F.lower(c).isin("low", "medium", "high"), F.lower(c)).otherwise("low")


# --- ids, times, formats --------------------------------------------------------


def router_id(device: Column) -> Column:
    return F.concat(F.lit("router-00"), device.cast("string"))


def digits(c: Column) -> Column:
    """The integer that an id's digits spell, null without any: router-001 and router-1 are both 1."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("int")


def round_of_file(name: Column) -> Column:
    """The round number in a name such as round_012_metrics.json, null without one."""
    return F.regexp_extract(name, r"round_(\d+)", 1).try_cast("int")


def local_time(ts: Column, zone: str = "Europe/Bucharest", suffix: str = "EET") -> Column:
    """A time in a zone, with a suffix that doesn't follow summer time."""
    return F.date_format(F.from_utc_timestamp(ts, zone), f"yyyy-MM-dd HH:mm '{suffix}'")


def utc_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")


def parse_time(c: Column) -> Column:
    """An ISO time, null for what isn't one."""
    return F.try_to_timestamp(c)


def percent(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{places}f", c * 100), F.lit("%"))


def scaled_series(c: Column) -> Column:
    """A numeric array scaled to its own range; a range under 0.001 counts as 1."""
    low = F.array_min(c)
    width = F.array_max(c) - low
    return F.transform(c, lambda x: (x - low) / F.when(width < 0.001, F.lit(1.0)).otherwise(width))


def map_total(c: Column) -> Column:
    """The sum of a map's values, 0 for an empty or null map."""
    return F.coalesce(F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def state_entry(c: Column) -> Column:
    """A state entry (JSON text): struct(count, ts, round), also from the old form of a bare number."""
    parsed = F.from_json(c, "count long, ts string, round int")
    bare = c.try_cast("long")
    return F.when(bare.isNotNull(), F.struct(bare.alias("count"), F.lit(None).cast("string").alias("ts"), F.lit(None).cast("int").alias("round"))).otherwise(parsed)

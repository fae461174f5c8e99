"""Anomaly rules: missing fields, temperature bounds, and spikes against the previous reading.

The previous reading is that of the same tenant, device and metric in order of
arrival, over complete readings only.  Ratios are exact decimals, rounded half
up at ten digits before they meet the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text
from .history import with_last

#: Incomplete readings have no history; they are dealt over so many chunks of the null key.
SALT = 1024


def complete() -> Column:
    return has_text(F.col("seen.tenantId")) & has_text(F.col("seen.deviceId")) & has_text(F.col("seen.metric")) & F.col("seen.value").isNotNull()


def with_previous(events: DataFrame, order: str = "seq", span: int = 1 << 22) -> DataFrame:
    """Adds ``complete`` and ``previous``, the last complete reading of the same key.

    ``order`` is a whole number of arrival; a window holds a key's readings of ``span`` arrivals at most.
    """
    out = events.withColumn("complete", complete())
    keys = {k: F.when(F.col("complete"), F.col(f"seen.{k}")) for k in ("tenantId", "deviceId", "metric")}
    chunk = F.when(F.col("complete"), F.floor(F.col(order) / span)).otherwise(F.pmod(F.xxhash64(order), F.lit(SALT)))
    last = with_last(out.withColumn("_value", F.col("seen.value")), keys, [order], "_value", chunk, "previous")
    return last.drop("_value").withColumn("previous", F.when(F.col("complete"), F.col("previous")))


def change_ratio(value: Column, previous: Column) -> Column:
    """|value - previous| / |previous| at ten digits; null without a previous reading or after zero."""
    return F.when(previous != 0, F.round(F.abs(value - previous) / F.abs(previous), 10))


def reasons() -> Column:
    """array<string> of what is wrong, in the rules' order."""
    missing = [F.when(~has_text(F.col(f"seen.{f}")), F.lit(f"{f} is required")) for f in ("tenantId", "deviceId", "metric")]
    missing.append(F.when(F.col("seen.value").isNull(), F.lit("value is required")))
    heat = F.col("complete") & (F.col("seen.metric") == "temperature")
    ratio = change_ratio(F.col("seen.value"), F.col("previous"))
    percent = F.round(ratio * 100, 1).cast("string")
    rules = [
        F.when(heat & (F.col("seen.value") > 80), F.lit("temperature is above maximum threshold")),
        F.when(heat & (F.col("seen.value") < -40), F.lit("temperature is below minimum threshold")),
        F.when(ratio > 0.5, F.concat(F.lit("value spike detected: changed by "), percent, F.lit("% from previous reading"))),
    ]
    return F.filter(F.array(*missing, *rules), lambda r: r.isNotNull())


def judged(events: DataFrame) -> DataFrame:
    """Adds reasons, anomalous and severity to events that have ``complete`` and ``previous``."""
    out = events.withColumn("reasons", reasons()).withColumn("anomalous", F.size("reasons") > 0)
    return out.withColumn("severity", F.when(~F.col("anomalous"), "NONE").when(F.col("complete"), "WARNING").otherwise("CRITICAL"))


def detected(events: DataFrame, order: str = "seq") -> DataFrame:
    """All rules over events with a detection view."""
    return judged(with_previous(events, order))

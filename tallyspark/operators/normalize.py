"""The two views of an event: what detection sees, and what is sent on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lowered, or_default, trimmed, trimmed_or_kept
from ..functions.time import clock
from ..schema import SERVICE


def detection_view(events: DataFrame) -> DataFrame:
    """Adds ``seen``: the flat, trimmed event, with names of kinds in lower case. Null payloads give nulls."""
    p = F.col("payload")
    seen = {
        "eventId": trimmed(F.col("eventId")),
        "tenantId": trimmed(F.col("tenantId")),
        "eventType": lowered(F.col("eventType")),
        "timestamp": F.col("timestamp"),
        "source": trimmed(F.col("source")),
        "version": trimmed(F.col("version")),
        "deviceId": trimmed(p["deviceId"]),
        "deviceType": lowered(p["deviceType"]),
        "metric": lowered(p["metric"]),
        "value": p["value"],
        "unit": lowered(p["unit"]),
        "location": trimmed(p["location"]),
    }
    return events.withColumn("seen", F.struct(*(c.alias(name) for name, c in seen.items())))


def outbound(events: DataFrame, event_type: str, now: Column | None = None, *more: str) -> DataFrame:
    """The envelope that is sent on: trimmed, never lower-cased, with this service as its source."""
    p = F.col("payload")
    payload = F.struct(*((p[f] if f == "value" else trimmed_or_kept(p[f])).alias(f) for f in ("deviceId", "deviceType", "metric", "value", "unit", "location")))
    return events.select(
        *more,
        trimmed_or_kept(F.col("eventId")).alias("eventId"),
        trimmed_or_kept(F.col("tenantId")).alias("tenantId"),
        F.lit(event_type).alias("eventType"),
        F.coalesce(F.col("timestamp"), clock(now)).alias("timestamp"),
        F.lit(SERVICE).alias("source"),
        or_default(F.col("version"), "1.0").alias("version"),
        payload.alias("payload"),
    )


def processed(events: DataFrame, now: Column | None = None, *more: str) -> DataFrame:
    return outbound(events, "telemetry.processed", now, *more)


def anomaly(detected: DataFrame, now: Column | None = None, *more: str) -> DataFrame:
    """Anomalous events only, with severity, reasons and the time of detection."""
    return outbound(detected.where("anomalous"), "telemetry.anomaly", now, *more, "severity", "reasons").withColumn("detectedAt", clock(now))

"""Validation of incoming events and their message keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, not_blank, trimmed
from ..functions.time import clock
from ..schema import HEADERS, INGESTION
from ..sources.log import Log

NO_KEY = "IllegalArgumentException: no usable message key"

#: How times go into JSON: all their digits.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: Required fields in the order in which violations are told.
TEXTS = ["eventId", "tenantId", "eventType", "source", "version"]
PAYLOAD_TEXTS = ["deviceId", "deviceType", "metric", "unit", "location"]


def violations() -> Column:
    """array<struct<field, message>>: all that is wrong with an event of columns eventId ... payload."""
    there = F.col("payload").isNotNull()
    checks = [(f, ~not_blank(F.col(f))) for f in TEXTS]
    checks += [("timestamp", F.col("timestamp").isNull()), ("payload", ~there)]
    checks += [(f"payload.{f}", there & ~not_blank(F.col(f"payload.{f}"))) for f in PAYLOAD_TEXTS]
    checks += [("payload.value", there & F.col("payload.value").isNull())]
    found = [F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(f"{f.split('.')[-1]} is required").alias("message"))) for f, bad in checks]
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def validated(events: DataFrame) -> DataFrame:
    """Adds ``violations`` and ``status``: 202 accepted, 400 rejected."""
    out = events.withColumn("violations", violations())
    return out.withColumn("status", F.when(F.size("violations") == 0, 202).otherwise(400))


def message_key(event_id: Column, tenant_id: Column) -> Column:
    """The trimmed event id, else the trimmed tenant, else null: such a record can't be published."""
    return F.coalesce(F.when(has_text(event_id), trimmed(event_id)), F.when(has_text(tenant_id), trimmed(tenant_id)))


def described(error: Column, message: Column, unknown: str = "Unknown processing failure") -> Column:
    """``Error: message``, the error alone without a message, or that nothing is known."""
    return F.when(error.isNull(), F.lit(unknown)).when(has_text(message), F.concat_ws(": ", error, message)).otherwise(error)


def dead_letters(decoded: DataFrame, now: Column | None = None, *more: str) -> DataFrame:
    """What the ingestion side can't publish: lines that are no events, and valid events without a usable key.

    ``decoded`` has value, event and malformed. Events that validation rejects are the sender's to mend and stay out.
    """
    key = message_key(F.col("event.eventId"), F.col("event.tenantId"))
    checked = validated(decoded.select(*more, "value", "malformed", "event", F.when(~F.col("malformed"), key).alias("key"), "event.*"))
    error = F.when(F.col("malformed"), described(F.lit("MalformedEvent"), F.lit("the line is no event"))).when((F.col("status") == 202) & F.col("key").isNull(), F.lit(NO_KEY))
    return checked.select(*more, "key", "event", error.alias("errorMessage"), F.lit(INGESTION).alias("sourceService"), clock(now).alias("failedAt")).where("errorMessage is not null")


def publish(events: DataFrame, log: Log, run_id: str, order: list[str], now: Column | None = None) -> int:
    """Appends the accepted events that have a key to the raw log, as one run in the order of the two columns ``order``; returns how many.

    A run that is in the log already is not written again.
    """
    fields = F.struct(*(c for c in ("eventId", "tenantId", "eventType", "timestamp", "source", "version", "payload")))
    keyed = validated(events).where("status = 202").withColumn("key", message_key(F.col("eventId"), F.col("tenantId"))).where("key is not null")
    sent = keyed.select("key", F.to_json(fields, MICROS).alias("value"), F.lit(None).cast(HEADERS).alias("headers"), clock(now).cast("timestamp").alias("ts"), *order)
    return log.append(sent, run_id, order)
